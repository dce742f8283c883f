import random
import re

import numpy as np
import regex
from test_texts import components, removed

import corpus_pipeline
from passagelake.llm import suffix_dedup, surrogates
from passagelake.llm.common import tokenizer_path
from passagelake.llm.pieces import library


def test_stages(spark, tmp_path):
    words = lambda k, n: " ".join(f"{chr(97 + i % 26)}{chr(97 + k % 26)}word{i * 31 + k * 1009}" for i in range(n))
    passage = words(99, 60)
    texts = [words(1, 80), words(1, 80) + " tail", words(2, 90) + " " + passage, words(3, 90) + " " + passage, "### $$$ " * 60, words(4, 80) + " mail x.y@mail.example.com", None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(seen["quality rules"]) == [0, 1, 2, 3, 5] and sorted(seen["n-gram Jaccard join"]) == [0, 2, 3, 5]
    assert all(passage[20:-20] not in t for t in seen["suffix-array dedup"].values()) and "x.y@mail" not in seen["PII"][5] and "@" in seen["PII"][5]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {0, 2, 3, 5}


def test_repeated_rows_and_null_ids_keep_one_document(spark, tmp_path):
    words = lambda k: " ".join(f"{chr(97 + i % 26)}{chr(97 + k % 26)}word{i * 31 + k * 1009}" for i in range(80))
    # a repeated row, null-id copies, a null-id copy of a row with an id, and an id whose rows are a copy and a text of its own
    rows = [(1, words(1)), (1, words(1)), (None, words(2)), (None, words(2)), (None, words(3)), (4, words(3)), (5, words(5)), (6, words(5) + " tail"), (6, words(6)), (None, words(7))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = [(1, words(1)), (None, words(2)), (4, words(3)), (5, words(5)), (6, words(6)), (None, words(7))]
    stages = dict(corpus_pipeline.STAGES)
    for name in ("n-gram Jaccard join", "suffix-array dedup", "PII"):
        docs = corpus_pipeline.stored(stages[name](spark, docs, str(tmp_path)), "test")
        assert sorted(map(repr, ((r.doc_id, r.text) for r in docs.collect()))) == sorted(map(repr, kept)), name
    # no whole text is lost on the way to packing: each kept document's ids and its end id
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = [(r.doc_id, r.doc_tokens) for r in pieces if r.start == 0]
    assert sorted(str(i) for i, _ in whole) == sorted(str(i) for i, _ in kept) and all(n > 80 for _, n in whole)
    assert sum(r.length for r in pieces) == sum(n for _, n in whole)
    spark.createDataFrame([], docs.schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def passes(text):
    """The quality rules, told anew."""
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    loud = sum(bool(regex.fullmatch(r"\P{Ll}*\p{Lu}\P{Ll}*\p{Lu}\P{Ll}*", w)) for w in words)
    n, chars = len(words), sum(map(len, words))
    return not (n < 50 or 100 * len(again) > 50 * n or 10 * len(re.findall(r"[#*$%&|<>]", text)) > n or 10 * (len(lines) - len(set(lines))) > 4 * len(lines) or not 25 * n <= 10 * chars <= 120 * n or 100 * loud > 33 * n or 20 * len(re.findall("!!+", text)) > n)


def test_stages_equal_brute_force(spark, tmp_path):
    r = random.Random(6)
    vocabulary = [f"{a}{b}{c}n" for a in "bcdfgl" for b in "aeiou" for c in "mnprst"]
    said = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passages = [said(60) for _ in range(3)]
    texts = [said(r.randint(30, 120)) for _ in range(40)]
    texts += [f"{said(60)} {r.choice(passages)} {said(60)}" for _ in range(12)]
    texts += [t + " one more" for t in texts[:10]] + texts[5:15] + [texts[20]] * 9  # near and exact copies, a larger group
    texts += [said(70) + e for e in (" by Ms Ada Li", " by Ms Ada Li", " to a.b@mail.example.com", " from 10.1.2.3", " by Dr Li")]
    texts += ["SHOUT IT LOUD " * 5 + said(40).upper(), "a # " * 60, (said(9) + "\n") * 12, said(55) + " !!" * 9, None, "", " \n "]
    ids = [None if r.random() < 0.15 else i if r.random() < 0.8 else r.randrange(20) for i in range(len(texts))]
    rows = [(i, t, f"k{n}", n, len(t or "")) for n, (i, t) in enumerate(zip(ids, texts))]
    rows += [rows[3], rows[41]]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, _row int, n_chars long")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, stages = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(corpus_pipeline.STAGES)

    def run(name):
        nonlocal docs
        before = [tuple(x) for x in docs.collect()]
        docs = corpus_pipeline.stored(stages[name](spark, docs, str(tmp_path)), "test")
        assert docs.columns == df.columns
        return before, [tuple(x) for x in docs.collect()]

    alike = lambda a, b: sorted(map(repr, a)) == sorted(map(repr, b))
    before, after = run("quality rules")
    assert alike(after, [x for x in before if passes(x[1])]) and 40 < len(after) < len(before) - 8
    before, after = run("n-gram Jaccard join")
    group = [c for *_, c in components([(n, x[1]) for n, x in enumerate(before)], 5, 80)]
    for g in set(group):
        of = [x for x, own in zip(before, group) if own == g]
        kept = [x for x in after if x in of]
        # one row, and none of a lesser id
        assert len(kept) == 1 and kept[0][0] == min((x[0] for x in of if x[0] is not None), default=None)
    assert len(after) == len(set(group)) < len(before)
    before, after = run("suffix-array dedup")
    cut = {x[2]: x for x in after}
    assert len(cut) == len(after) == len(before)
    for x, (n, gone, _, kept) in zip(before, removed([x[1].encode() for x in before], suffix_dedup.SPAN)):
        own = cut[x[2]]
        assert suffix_dedup.hashlib.sha256(own[1].encode()).hexdigest() == kept and own[4] == len(own[1]) == n - gone and own[:1] + own[2:4] == x[:1] + x[2:4]
    assert sum(x[4] for x in after) < sum(x[4] for x in before) - 1000
    before, after = run("PII")
    new = {x[2]: x for x in after}
    shown = {}
    for x in before:
        found = [m[0] for m in regex.finditer(surrogates.ANY, x[1])]
        if not found:
            assert new[x[2]] == x
            continue
        shape = regex.fullmatch("(.*)".join(map(re.escape, regex.split(surrogates.ANY, x[1]))), new[x[2]][1])
        for old, drawn in zip(found, shape.groups()):
            assert shown.setdefault(old, drawn) == drawn != old
    assert len(set(shown.values())) == len(shown) >= 3
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    coded = library(tokenizer_path("word_bpe_49k.json"))
    expected = sorted(len(coded.encode(x[1], add_special_tokens=False).ids) + 1 for x in after)
    assert sorted(p.doc_tokens for p in pieces if p.start == 0) == expected and sum(p.length for p in pieces) == sum(expected)
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for spans in by.values():
        ends = np.cumsum([n for _, n in sorted(spans)])
        assert [o for o, _ in sorted(spans)] == [0, *ends[:-1].tolist()] and (ends[-1] == 2048 or ends[-1] & (ends[-1] - 1) == 0)
