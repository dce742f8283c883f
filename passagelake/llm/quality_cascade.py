"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Each rule rejects a document by one measure of its text. The rules' order is found on a sample of bounded size:
each rule is run over the sample alone, several times, for its cost and its share of rejected rows, and rules are ordered by
rejection per cost, best first. The verdict is one CASE in that order, so a rule is computed only for rows that
all rules before it let pass. The order changes the work and the reported reason, never who is kept.

Words are runs of characters other than the six ASCII white-space characters. A text of up to LONG bytes is measured in
its row, by arrays of its words. A longer one would not fit there: it is cut at white space into slices, its words and
lines become rows, and joins and windows that can spill find the same measures.
Defined cases: a null or empty text has no words and is rejected; rows with equal or null ids are judged each for
itself; an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
SAMPLE_ROWS = 600
RUNS = 2
LONG = 4 << 20  # bytes
SLICE = 1 << 19  # characters


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def repeat_words(w: Column) -> Column:
    """Words in windows of three that the text holds twice or more. Windows are sorted by hash, then by their words, so equal ones stand together."""
    window = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))
    same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

    def positions(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    covered = lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(covered(let(F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window)), positions))).cast("long")


def share(w: Column, is_one: Callable[[Column], Column]) -> Column:
    """Hundredths of the words for which is_one holds."""
    return F.size(F.filter(w, is_one)) * 100 / F.greatest(F.size(w), F.lit(1))


def shouts(word: Column) -> Column:
    """Two capitals or more and no small letter."""
    return word.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$")


def measures(text: Column, w: Column | None = None) -> dict[str, Column]:
    """Expressions over a text that is not null, and its words where they are known; nothing is computed until a row needs it."""
    w = words(text) if w is None else w
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(w),
        "shouted": share(w, shouts),
        "exclaimed": F.regexp_count(text, F.lit("!!+")).cast("long"),
    }


def sliced(texts: DataFrame, at: str, size: int) -> DataFrame:
    """row, number, slice: the texts (row, text) cut before characters that match `at`, in slices of about `size` characters."""
    count = F.greatest(F.ceil(F.length("text") / size), F.lit(1)).cast("int")
    each = texts.select("row", "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("number"))
    found = F.regexp_instr(F.substring("text", F.col("number") * size + 1, F.lit(size)), F.lit(at))
    begin = F.when(F.col("number") == 0, 1).when(found > 0, F.col("number") * size + found)
    begins = each.select("row", "number", begin.alias("begin")).filter("begin IS NOT NULL")
    begins = begins.withColumn("next", F.lead("begin").over(Window.partitionBy("row").orderBy("number")))
    return texts.join(begins, "row").select("row", "number", F.substring("text", F.col("begin"), F.coalesce(F.col("next"), F.length("text") + 1) - F.col("begin")).alias("slice"))


def measures_of_long(texts: DataFrame, size: int = SLICE) -> DataFrame:
    """row and all measures() of texts (row, text) of any length."""
    slices = stored(sliced(texts, SPACE, size), "slices")
    of_slices = slices.groupBy("row").agg(F.sum(F.regexp_count("slice", F.lit(SYMBOLS))).alias("n_symbols"), F.sum(F.regexp_count("slice", F.lit("!!+"))).alias("exclaimed"))
    places = Window.partitionBy("row").orderBy("number", "i")
    spoken = slices.select("row", "number", F.posexplode(words(F.col("slice"))).alias("i", "a"))
    spoken = stored(spoken.select("row", "a", F.row_number().over(places).alias("at"), F.lead("a").over(places).alias("b"), F.lead("a", 2).over(places).alias("c")), "words")
    of_words = spoken.groupBy("row").agg(F.count("*").alias("n_words"), F.sum(F.length("a")).alias("word_chars"), F.count_if(shouts(F.col("a"))).alias("n_shouted"))
    windows = spoken.filter("c IS NOT NULL")
    twice = windows.groupBy("row", "a", "b", "c").count().filter("count > 1")
    ordered_places = Window.partitionBy("row").orderBy("at")
    covered = windows.join(twice, ["row", "a", "b", "c"], "left_semi").select("row", F.least(F.lit(3), F.coalesce(F.col("at") - F.lag("at").over(ordered_places), F.lit(3))).alias("n"))
    lines = sliced(texts, "\n", size).select("row", F.explode(F.split("slice", "\n", -1)).alias("line")).filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    of_lines = lines.groupBy("row", "line").count().groupBy("row").agg(F.sum("count").alias("n_lines"), F.sum(F.col("count") - 1).alias("n_dup_lines"))
    out = texts.select("row")
    for part in (of_slices, of_words, of_lines, covered.groupBy("row").agg(F.sum("n").alias("n_repeat_words"))):
        out = out.join(part, "row", "left")
    out = out.na.fill(0)
    whole = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "exclaimed")
    return out.select("row", *[F.col(c).cast("long").alias(c) for c in whole], (F.col("n_shouted") * 100 / F.greatest(F.col("n_words"), F.lit(1))).alias("shouted"))


#: Of the base: too short, or more than half in repeated windows.
BASE = {"too_short": lambda m: m["n_words"] < 50, "repetitive": lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]}
#: Thresholds: a symbol for ten words; two of five lines said before; words shorter than 2.5 or longer than 12 on average; a third in capitals; a "!!" for twenty words.
RULES = {
    "symbols": lambda m: 10 * m["n_symbols"] > m["n_words"],
    "repeated_lines": lambda m: 10 * m["n_dup_lines"] > 4 * m["n_lines"],
    "word_length": lambda m: ~(10 * m["word_chars"]).between(25 * m["n_words"], 120 * m["n_words"]),
    "shouting": lambda m: m["shouted"] > 33,
    "exclaiming": lambda m: 20 * m["exclaimed"] > m["n_words"],
}


def ordered(rows: DataFrame, rules: dict[str, Column], sample_rows: int = SAMPLE_ROWS, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[list[str], dict[str, tuple[float, float]]]:
    """The rules' names by rejection per cost, and (seconds, share rejected) of each, from a sample of about sample_rows rows.

    `prepare` adds the columns that the rules read; it is applied to the sample alone. A rule's cost is the fastest of
    RUNS runs over the cached sample, less the fastest run that computes nothing, so a busy moment does not decide."""
    total = rows.count()
    sample = prepare(rows.sample(min(1.0, sample_rows / max(1, total)), seed=11)).coalesce(4).persist()
    try:
        n = sample.count()

        def run(condition: Column) -> tuple[float, int]:
            began = time.perf_counter()
            hits = sample.agg(F.count_if(condition)).first()[0]
            return time.perf_counter() - began, hits

        idle = min(run(F.lit(False)) for _ in range(RUNS))[0]
        found = {}
        for name, reject in rules.items():
            seconds, hits = min(run(F.coalesce(reject, F.lit(False))) for _ in range(RUNS))
            found[name] = (max(seconds - idle, 1e-3), hits / max(1, n))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda x: (-found[x][1] / found[x][0], x)), found


def cascade(rules: dict[str, Column], order: list[str]) -> Column:
    """The first rule, in that order, that rejects the row; null where none does."""
    verdict = F.when(F.coalesce(rules[order[0]], F.lit(False)), F.lit(order[0]))
    for name in order[1:]:
        verdict = verdict.when(F.coalesce(rules[name], F.lit(False)), F.lit(name))
    return verdict


def _by_length(docs: DataFrame, text: Column, long: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows with texts of up to `long` bytes, and the others, if there are any, stored with a number `_row`; for columns without such a name."""
    over = F.octet_length(text) > long
    if docs.filter(F.coalesce(over, F.lit(False))).isEmpty():
        return docs, None
    return docs.filter(F.coalesce(~over, F.lit(True))), stored(docs.filter(over).withColumn("_row", F.monotonically_increasing_id()), "long")


def filter_quality(docs: DataFrame, text_column: str = "text", long: int = LONG, size: int = SLICE) -> DataFrame:
    """The rows that no rule, of the base or else, rejects; columns as they were. A text is split into its words once."""
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in own.items()])
    text = F.coalesce(F.col(own[text_column]), F.lit(""))
    short, others = _by_length(renamed, text, long)
    rules = lambda m: {k: f(m) for k, f in (BASE | RULES).items()}
    order, _ = ordered(short.select(text.alias("_text")), rules(measures(F.col("_text"), F.col("_words"))), prepare=lambda rows: rows.withColumn("_words", words(F.col("_text"))))
    kept = short.filter(let(words(text), lambda w: cascade(rules(measures(text, w)), order)).isNull())
    if others is not None:
        found = measures_of_long(others.select(F.col("_row").alias("row"), text.alias("text")), size)
        passed = found.filter(cascade(rules({c: F.col(c) for c in found.columns}), order).isNull()).select(F.col("row").alias("_row"))
        kept = kept.unionByName(others.join(passed, "_row", "left_semi").drop("_row"))
    return kept.select(*[F.col(o).alias(c) for c, o in own.items()])


def judge_quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", long: int = LONG, size: int = SLICE) -> DataFrame:
    """Every row's measures and verdict; `rejected_by` names the rule."""
    # the measures that are returned are computed for every row, once; the rules read those columns
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    lazy = docs.select(F.col(f"`{id_column}`").alias("_id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("_text"))
    short, others = _by_length(lazy, F.col("_text"), long)
    over = measures(F.col("_text"), F.col("_words"))
    known = over | {x: F.col(x) for x in shown}
    measured = lambda rows: rows.withColumn("_words", words(F.col("_text"))).withColumns({x: over[x] for x in shown})
    order, _ = ordered(short.select("_text"), {k: f(known) for k, f in RULES.items()}, prepare=measured)

    def judged(rows: DataFrame, m: dict[str, Column]) -> DataFrame:
        base = F.coalesce(BASE["too_short"](m) | BASE["repetitive"](m), F.lit(False))
        rows = rows.withColumn("base_failed", base)
        rejected = F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade({k: f(m) for k, f in RULES.items()}, order))
        return rows.withColumn("rejected_by", rejected).select(F.col("_id").alias(id_column), *shown[:5], "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")

    out = judged(measured(short), known)
    if others is not None:
        found = measures_of_long(others.select(F.col("_row").alias("row"), F.col("_text").alias("text")), size)
        rows = others.select("_id", F.col("_row").alias("row")).join(found, "row")
        out = out.unionByName(judged(rows, {c: F.col(c) for c in found.columns}))
    return out
