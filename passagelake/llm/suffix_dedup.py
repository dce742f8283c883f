"""Removal of repeated byte strings through enhanced suffix arrays of anchored suffixes.

A byte is removed if a string of SPAN bytes that covers it also starts somewhere else in the table.

1. Anchors. Of the GRAM-byte strings inside every SPAN-byte window the one of least hash is the window's anchor, so
   equal windows have equal anchors at equal places, and about one place in seventy is an anchor. Around it stands
   its context: all windows that may hold it.
2. Anchors meet by their string's hash. One that meets none has no repeated window. Where whole contexts are equal (by
   64 bits of XXH3 over their bytes, beside the string's own 64), all their windows are repeated, and one goes on.
3. What differs is compared by its bytes. The suffixes from the anchors are sorted into a suffix array with the
   common prefixes of neighbours; a stack scan gives the tree of common-prefix intervals. In an interval the
   occurrences are sorted by what stands before them, and a second scan over the common extents to the left tells
   where they differ there: each of its intervals is a maximal repeat with all its occurrences, which neither a
   longer string on the right nor one on the left has too. Every occurrence's bytes go where the repeat is long enough.
4. A group of over GROUP contexts is not gathered: it is dealt out in parts of about GROUP to as many tasks; of each
   part's windows the repeated ones are marked at once, and one row for each distinct window meets those of the other
   parts by 128 bits of its bytes. Strings with very many anchors, found on a sample of the anchors, are dealt out in
   step 2 by their contexts, and contexts with very many are decided where they lie. This moves rows, never results.

Equal texts are handled once: spans depend on the text alone, and a text of at least SPAN bytes that occurs twice
goes whole. Rows meet in sorted streams, so no group is held in memory beyond about GROUP contexts.

Defined cases: a null or empty text has no bytes; rows with equal or null ids count as documents of their own;
extra columns are ignored; an empty table gives an empty result. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lane_hashes, mixed, prefix_hash, slices, stored, window_hash

SPAN = 200
GRAM = 64
GROUP = 16_384  # contexts of one anchor that a task holds: 5.5 MB
SHARE = 2000  # a string with more than GROUP anchors and one of so many of all is dealt out by its contexts
SAMPLE = 16  # one of so many anchors is counted for that
SALTS = 4096
BROADCAST_ROWS = 250_000  # a table of up to so many rows of 16 bytes is sent to all executors


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every `width` neighbours."""
    out, done = x, 1
    while done * 2 <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    last = width - done
    return pick(out[:-last], out[last:]) if last else out


def anchors(data: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, hash of the string there, hash of the context) of a text's anchors."""
    n, wide = len(data), span - gram + 1
    if n < span:
        return (np.zeros(0, np.int64),) + (np.zeros(0, np.uint64),) * 2
    grams = mixed(window_hash(prefix_hash(data), gram))
    least = sliding(grams, wide, np.minimum)
    padding = np.zeros(wide - 1, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate([padding, least, padding]), wide, np.maximum) == grams)
    start, stop = np.maximum(at - (wide - 1), 0), np.minimum(at + span, n)
    shape = ((at - start) * 65537 + (stop - start)).astype(np.uint64)
    raw = data.tobytes()
    context = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), stop.tolist())), np.uint64, len(at))
    return at, grams[at], mixed(context + shape * np.uint64(0xD6E8FEB86659FD93))


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def intervals(prefixes: list[int], least: int):
    """(common prefix, first, last) of the suffix array's intervals with at least `least`, by a stack scan over neighbours' prefixes."""
    stack: list[tuple[int, int]] = []
    for i, p in enumerate([*prefixes, 0]):
        first = i
        while stack and stack[-1][0] > p:
            depth, first = stack.pop()
            yield depth, first, i
        if p >= least and (not stack or stack[-1][0] < p):
            stack.append((p, first))


def maximal_repeats(contexts: list[tuple[bytes, bytes]], span: int = SPAN, gram: int = GRAM):
    """Of (bytes before the anchor, bytes from it) the maximal repeats of at least `span` bytes around the anchors, the bytes after cut to `span`: (bytes to the left, bytes to the right, all occurrences). Of repeats in one interval the longest come first."""
    order = sorted(range(len(contexts)), key=lambda i: contexts[i][1])
    before = [left[::-1] for left, _ in contexts]
    rank = {i: r for r, i in enumerate(sorted(range(len(contexts)), key=before.__getitem__))}
    neighbours = [min(span, common(contexts[a][1], contexts[b][1])) for a, b in zip(order[:-1], order[1:])]
    for depth, first, last in intervals(neighbours, gram):
        child = [0, *accumulate(p == depth for p in neighbours[first:last])]  # members of one child share more on the right
        places = sorted(range(last + 1 - first), key=lambda p: rank[order[first + p]])
        members, child = [order[first + p] for p in places], [child[p] for p in places]
        extents = [common(before[a], before[b]) for a, b in zip(members[:-1], members[1:])]
        # left diversity: between the groups of a common extent the bytes before it differ
        for extent, a, b in intervals(extents, max(1, span - depth)):
            if min(child[a : b + 1]) < max(child[a : b + 1]):
                yield extent, depth, members[a : b + 1]
        if depth >= span and min(extents) == 0:
            yield 0, depth, members


def repeated_windows(contexts: list[tuple[bytes, bytes]], span: int = SPAN, gram: int = GRAM) -> list[list[tuple[int, int]]]:
    """For each (bytes before the anchor, bytes from it): ranges of distances before the anchor at which a window begins that another context holds too."""
    found: list[dict[int, int]] = [{} for _ in contexts]
    for extent, depth, members in maximal_repeats(contexts, span, gram):
        for i in members:
            if found[i].get(depth, -1) < extent:
                found[i][depth] = extent
    return [[(span - depth, extent) for depth, extent in x.items()] for x in found]


def merged(starts, ends) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


ANCHOR = ("gram", "context", "k1", "k2", "at")


def met(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of neighbouring rows of sorted anchors: equal gram, equal gram and context."""
    gram = x["gram"][1:] == x["gram"][:-1]
    return gram, gram & (x["context"][1:] == x["context"][:-1])


def verdicts(batches):
    """Of anchors sorted by ANCHOR those that meet another one: 0 their contexts differ, 1 its whole context is repeated, 2 so too, and it goes on for all equal ones. Those of a `hot` string meet others for sure."""
    held, before = None, 0  # the last row waits for what follows it; `before` rows in front of it are only looked at

    def judged(x, first, last):
        gram, equal = met(x)
        off = np.zeros(1, bool)
        gram_before, gram_after = np.concatenate([off, gram]), np.concatenate([gram, off])
        equal_before, equal_after = np.concatenate([off, equal]), np.concatenate([equal, off])
        verdict = np.where(equal_before, 1, np.where(equal_after, 2, 0)).astype(np.int32)
        rows = np.flatnonzero(gram_before | gram_after | x["hot"])
        rows = rows[(rows >= first) & (rows < last)]
        return _batch(**{n: x[n][rows] for n in ("gram", "k1", "k2", "at")}, verdict=verdict[rows])

    for batch in batches:
        x = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in (*ANCHOR, "hot")}
        if held is not None:
            x = {n: np.concatenate([held[n], v]) for n, v in x.items()}
        if not len(x["gram"]):
            continue
        # one place of one text, found by several tasks, is one anchor
        new = np.concatenate([[True], np.any([x[n][1:] != x[n][:-1] for n in ANCHOR], axis=0)])
        x = {n: v[new] for n, v in x.items()}
        n = len(x["gram"])
        yield judged(x, before, n - 1)
        held, before = {k: v[max(0, n - 2) :] for k, v in x.items()}, min(1, n - 1)
    if held is not None:
        yield judged(held, before, before + 1)


def keyed_docs(docs: DataFrame, text_column: str = "text", *keep: str) -> DataFrame:
    """k1, k2 (128 bits of the text) and text, never null, beside the columns in `keep`."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(*keep, F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(17), text, F.lit(29)).alias("k2"), text.alias("text"))


def repeated_spans(keyed: DataFrame, span: int = SPAN, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """k1, k2, and `spans`: the (start, end) of the text's repeated bytes, in any order, ends maybe beyond the text's."""
    left = span - gram

    def find(batches):
        seen = set()
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            for k1, k2, text in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text")):
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                at, gram_hash, context = anchors(np.frombuffer(text.as_buffer(), np.uint8), span, gram)
                out.append((gram_hash.view(np.int64), context.view(np.int64), np.full(len(at), k1, np.int64), np.full(len(at), k2, np.int64), at.astype(np.int32)))
            if out:
                yield _batch(**{n: np.concatenate(x) for n, x in zip(ANCHOR, zip(*out))})

    found = keyed.filter(F.octet_length("text") >= span).select("k1", "k2", "text").mapInArrow(find, "gram long, context long, k1 long, k2 long, at int")
    found = stored(found, "anchors")
    rows, direct = found.withColumn("hot", F.lit(False)), None
    n = found.count()
    most = max(group, n // SHARE)
    if n > most:
        counted = found.filter(F.pmod(F.xxhash64("k1", "k2", "at"), F.lit(SAMPLE)) == 0).groupBy("gram").count()
        hot = [r["gram"] for r in counted.filter(F.col("count") * SAMPLE >= most).select("gram").collect()]  # SHARE numbers or so
        if hot:
            rows = found.withColumn("hot", F.col("gram").isin(hot))  # a set to look up, not a join: most anchors may be hot
            where = F.struct("k1", "k2", "at")
            full = rows.filter("hot").groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(where).alias("one"), F.max(where).alias("other"))
            full = stored(full.filter((F.col("n") >= most) & (F.col("one") != F.col("other"))).select("gram", "context", "one"), "hot-contexts")  # SHARE rows at most
            of_full = rows.filter("hot").join(F.broadcast(full), ["gram", "context"])
            direct = of_full.select("gram", "k1", "k2", "at", F.when(where == F.col("one"), 2).otherwise(1).alias("verdict"))
            rows = rows.join(F.broadcast(full.select("gram", "context", F.lit(True).alias("done"))), ["gram", "context"], "left").filter("done IS NULL").drop("done")
    salt = F.when(F.col("hot"), F.pmod("context", F.lit(SALTS))).otherwise(0).cast("int")
    judged = rows.withColumn("salt", salt).repartition("gram", "salt").sortWithinPartitions(*ANCHOR).drop("salt").mapInArrow(verdicts, "gram long, k1 long, k2 long, at int, verdict int")
    judged = stored(judged if direct is None else judged.unionByName(direct), "judged")
    discard(found)

    def contexts(batches):
        seen = set()
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in range(7)]
            for k1, k2, text, places in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text"), batch.column("places")):
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                raw = text.as_buffer().to_pybytes()
                for place in places.as_py():
                    at = place["at"]
                    for part, x in zip(out, (place["gram"], place["part"], k1, k2, at, raw[max(0, at - left) : at], raw[at : at + span])):
                        part.append(x)
            yield _batch(gram=pa.array(out[0], pa.int64()), part=pa.array(out[1], pa.int32()), k1=pa.array(out[2], pa.int64()), k2=pa.array(out[3], pa.int64()), at=pa.array(out[4], pa.int32()), before=pa.array(out[5], pa.binary()), after=pa.array(out[6], pa.binary()))

    # a group of over `group` contexts is dealt out in parts; -1: a group that one task holds
    going = judged.filter("verdict <> 1")
    large = stored(going.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > group), "large-groups")
    n_large = large.count()
    if n_large:
        going = going.join(F.broadcast(large) if n_large <= BROADCAST_ROWS else large, "gram", "left")
        part = F.coalesce(F.pmod(F.xxhash64("k1", "k2", "at"), F.ceil(F.col("n") / group)), F.lit(-1))
    else:
        part = F.lit(-1)
    places = going.withColumn("part", part.cast("int")).groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "gram", "part")).alias("places"))
    around = keyed.join(places, ["k1", "k2"]).select("k1", "k2", "text", "places").mapInArrow(contexts, "gram long, part int, k1 long, k2 long, at int, before binary, after binary")

    def compare(batches):
        names = ("gram", "part", "k1", "k2", "at", "before", "after")
        current, rows, hot, out, last = None, [], False, [], None

        def windows():
            """The windows of the waiting part of a large group: repeated ones are marked, each distinct one is dealt out once."""
            found = []
            for k1, k2, at, before, after in rows:
                data = np.frombuffer(before + after, np.uint8)
                if len(data) >= span:
                    one, two = (x[: len(before) + 1].view(np.int64) for x in lane_hashes(data, span))
                    found.append((np.full(len(one), k1), np.full(len(one), k2), at - len(before) + np.arange(len(one)), one, two))
            rows.clear()
            if not found:
                return
            k1, k2, start, one, two = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((start, k2, k1, two, one))
            k1, k2, start, one, two = (x[order] for x in (k1, k2, start, one, two))
            new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            # a window that two anchors of one place share is one occurrence
            other = (k1 != k1[first]) | (k2 != k2[first]) | (start != start[first])
            twice = np.zeros(len(new), bool)
            twice[first[other]] = True
            marked = twice[first]
            last = None
            for a, b, c in zip(k1[marked].tolist(), k2[marked].tolist(), start[marked].tolist()):
                if last != (a, b, c):
                    out.append((a, b, c, c + span, None, None))
                last = (a, b, c)
            out.extend(zip(k1[new].tolist(), k2[new].tolist(), start[new].tolist(), (start[new] + span).tolist(), one[new].tolist(), two[new].tolist()))

        def close():
            if hot:
                windows()
            elif len(rows) > 1:
                for (k1, k2, at, _, _), ranges in zip(rows, repeated_windows([r[3:] for r in rows], span, gram)):
                    out.extend((k1, k2, a, b, None, None) for a, b in merged([at - hi for _, hi in ranges], [at - lo + span for lo, _ in ranges]))

        def flush():
            columns = list(zip(*out)) if out else [()] * 6
            out.clear()
            return _batch(k1=pa.array(columns[0], pa.int64()), k2=pa.array(columns[1], pa.int64()), start=pa.array(columns[2], pa.int32()), end=pa.array(columns[3], pa.int32()), w1=pa.array(columns[4], pa.int64()), w2=pa.array(columns[5], pa.int64()))

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in names)):
                if row[:5] == last:
                    continue
                last = row[:5]
                if row[:2] != current:
                    close()
                    current, rows, hot = row[:2], [], row[1] >= 0
                rows.append(row[2:])
                if hot and len(rows) > group:
                    windows()
                if len(out) > 50_000:
                    yield flush()
        close()
        yield flush()

    compared = stored(around.repartition("gram", "part").sortWithinPartitions("gram", "part", "k1", "k2", "at").mapInArrow(compare, "k1 long, k2 long, start int, end int, w1 long, w2 long"), "windows")
    single = compared.filter("w1 IS NOT NULL").distinct()
    where = F.struct("k1", "k2", "start")
    twice = single.groupBy("w1", "w2").agg(F.min(where).alias("a"), F.max(where).alias("b")).filter("a <> b").select("w1", "w2")
    spans = (
        judged.filter("verdict > 0").select("k1", "k2", F.greatest(F.col("at") - left, F.lit(0)).alias("start"), (F.col("at") + span).alias("end"))
        .unionByName(compared.filter("w1 IS NULL").select("k1", "k2", "start", "end"))
        .unionByName(single.join(twice, ["w1", "w2"], "left_semi").select("k1", "k2", "start", "end"))
        .unionByName(keyed.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("end")).filter(F.expr(f"n > 1 AND end >= {span}")).select("k1", "k2", F.lit(0).alias("start"), "end"))
    )
    return spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, group: int = GROUP, text_column: str = "text", digests: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """`keep` columns, n_bytes, n_removed, n_spans, and kept_sha256 (digests) or the kept text (characters that a cut splits go)."""
    if any(c in keep for c in ("k1", "k2", "text")):
        raise ValueError("rename the kept columns k1, k2 or text first")
    keyed = keyed_docs(docs, text_column, *keep)
    spans = repeated_spans(keyed, span, gram, group)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.select(*keep).schema]

    def cut(batches):
        for batch in slices(batches, "text"):
            counts, kept = [], []
            for text, found in zip(batch.column("text"), batch.column("spans")):
                raw = text.as_buffer().to_pybytes()
                found = found.as_py() or []
                runs = merged([s["start"] for s in found], [min(s["end"], len(raw)) for s in found])
                at, parts = 0, []
                for a, b in runs:
                    parts.append(raw[at:a])
                    at = b
                parts.append(raw[at:])
                left_over = b"".join(parts)
                counts.append((len(raw), len(raw) - len(left_over), len(runs)))
                kept.append(hashlib.sha256(left_over).hexdigest() if digests else left_over.decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3)), pa.array(kept, pa.string())], names=[*keep, "n_bytes", "n_removed", "n_spans", "kept"])

    out = keyed.join(spans, ["k1", "k2"], "left").select(*keep, "text", "spans").mapInArrow(cut, ", ".join([*kinds, "n_bytes long, n_removed long, n_spans long, kept string"]))
    return out.withColumnRenamed("kept", "kept_sha256" if digests else "kept_text")


def without_repeats(docs: DataFrame, span: int = SPAN, text_column: str = "text") -> DataFrame:
    """docs with the repeated strings removed from the text; all other columns as they were."""
    others = [c for c in docs.columns if c != text_column]
    safe = [f"_{i}" for i in range(len(others))]
    renamed = docs.select(*[F.col(f"`{c}`").alias(s) for c, s in zip(others, safe)], F.col(f"`{text_column}`").alias("text"))
    out = remove_repeats(renamed, span, keep=tuple(safe)).withColumnRenamed("kept_text", "text")
    names = dict(zip(others, safe)) | {text_column: "text"}
    return out.select(*[F.col(names[c]).alias(c) for c in docs.columns])
