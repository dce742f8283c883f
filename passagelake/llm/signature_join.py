"""Documents linked by the Jaccard similarity of their word n-grams, through signature trees.

A document's set holds the hashes of its distinct n-grams of lower-cased words; equal sets are one node.

1. Candidates. Linked sets differ in few elements: at most d for their size. Each set is dealt into (d + 1) / 2 blocks
   of three segments by its elements' hash; of two linked sets one block at least differs in one element at most, so
   two of its segments are equal. A row for each pair of segments brings equal ones together in a sorted stream; each
   set is tied to the first one of its row. Sizes are taken in levels, and a set near a level's end is dealt out for
   both, so no link is lost.
2. Each set has a bitmap of the parities of its elements' hashes; two bitmaps differ in no more bits than their sets
   in elements. Of the sets tied to one set those go on whose bitmaps differ in few enough bits for a link, tied to
   each other (sets of over HELD bytes of rows stay tied as they are). What is then tied together, directly or not,
   forms a candidate group; it is verified by itself. A group of over LIMIT elements is taken apart: the sets tied to one set are verified together, so a set goes on once for each set that it
   is tied to. If these are over LIMIT, they are cut into blocks by size and hash, and pairs of blocks of fitting sizes
   are verified.
3. In a group the sets are leaves of a signature tree. Its nodes hold the range of their sets' sizes and the OR (and
   AND) of their bitmaps, in which the group's shared elements have a bit each. Two nodes are traversed together
   unless their greatest possible overlap is too small for a link, or all their sets are connected already. Pairs of
   leaves are decided by the exact overlap.
4. Components are those of the found links.

Defined cases: a null, empty or blank text has the empty set, is linked with nothing and is its own component; rows
with equal ids are documents of their own, a component's id is the least non-null id in it; a null id of an unlinked
row stays null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mixed, slices, stored
from .graphs import components

LIMIT = 3_000_000  # elements that one verifying task holds of a group
LEAF = 32
LEVEL = 1.4
HELD = 32 << 20  # bytes of bitmaps and of their rows that one task compares
ROW_BYTES = 256
WIDEST = 1 << 16  # bits of a parity bitmap at most
BROADCAST_ROWS = 250_000  # a table of up to so many rows of 32 bytes is sent to all executors, a larger one is shuffled
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def word_hashes(letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64 bits of BLAKE2b for each of the words that stand one after another in `letters`; each distinct word is hashed once."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))]).dictionary_encode()
    distinct = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in words.dictionary.to_pylist()), "<u8")
    return distinct[words.indices.to_numpy()]


def gram_sets(texts: pa.Array, n: int = 4) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; of a text with fewer words one hash of them all."""
    raw = [(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts]
    joined = _LOWER[np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)]
    space = _SPACE[joined]
    begins, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    word = word_hashes(joined[~space], ends - begins)
    gram = word
    for k in range(1, n):
        gram = mixed(gram[:-1] * _B + word[k:]) if len(gram) > 1 else gram[:0]
    places = np.cumsum([0] + [len(r) + 1 for r in raw]) + 1
    bounds = np.searchsorted(begins, places)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(gram[a : b - n + 1]))
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                short = mixed(short * _C + word[k : k + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    one = mixed(grams ^ _A).sum(dtype=np.uint64, keepdims=True)
    two = mixed(mixed(grams * _B + _C).sum(dtype=np.uint64, keepdims=True) + np.full(1, len(grams), np.uint64))
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])


def parities(grams: np.ndarray) -> bytes:
    """A bitmap of a power of two of bits, at least one for each element up to WIDEST, of the parities of their hashes."""
    width = min(WIDEST, max(64, 1 << max(0, len(grams) - 1).bit_length()))
    at = (mixed(grams ^ _B) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def possible_links(sizes: list[int], bitmaps: list[bytes], percent: int) -> list[int]:
    """For each set the first one that it is joined with through pairs whose bitmaps allow a link."""
    n = len(sizes)
    size, width = np.asarray(sizes, np.int64), np.asarray([len(b) for b in bitmaps])
    widths = np.unique(width).tolist()
    folded, row = {}, {}
    for w in widths:
        wider = np.flatnonzero(width >= w)
        row[w] = np.full(n, -1)
        row[w][wider] = np.arange(len(wider))
        # halves laid over each other: the bitmap of half the bits
        folded[w] = np.stack([np.bitwise_xor.reduce(np.frombuffer(bitmaps[i], np.uint64).reshape(-1, w // 8), axis=0) for i in wider])
    root, left = [-1] * n, np.arange(n)
    for first in range(n):
        if root[first] >= 0:
            continue
        root[first], stack = first, [first]
        left = left[left != first]
        while stack and len(left):
            i, found = stack.pop(), []
            for w in widths:
                if w > width[i]:
                    break
                to = left[width[left] >= w] if w == width[i] else left[width[left] == w]
                if len(to):
                    apart = np.bitwise_count(folded[w][row[w][to]] ^ folded[w][row[w][i]]).sum(-1, dtype=np.int64)
                    total = size[to] + size[i]
                    near = (100 + percent) * apart <= (100 - percent) * total
                    near &= 100 * np.minimum(size[to], size[i]) >= percent * np.maximum(size[to], size[i])
                    found += to[near].tolist()
            if found:
                for j in found:
                    root[j] = first
                stack += found
                left = left[~np.isin(left, found)]
    return root


def ceilings(percent: int) -> list[int]:
    """Greatest sizes of the levels; up to the first, linked sets must be equal."""
    out = [max(1, ((100 + percent) - 1) // (2 * (100 - percent)))]
    while out[-1] < 1 << 40:
        out.append(int(out[-1] * LEVEL) + 1)
    return out


def segments(grams: np.ndarray, percent: int, tops: list[int]) -> np.ndarray:
    """Hashes of the pairs of segments, for each level that a linked set's size may belong to."""
    n, out = len(grams), []
    first = int(np.searchsorted(tops, n))
    last = int(np.searchsorted(tops, n * 100 // percent))
    for level in range(first, last + 1):
        # of sets a, b with overlap i: 100 i >= percent (a + b - i), so they differ in (a + b) (100 - percent) / (100 + percent) at most
        differ = 2 * tops[level] * (100 - percent) // (100 + percent)
        salt = np.full(1, level, np.uint64)
        salted = mixed(grams + salt * _B)
        values = mixed(salted ^ _C)
        if not differ:
            out.append(mixed(values.sum(dtype=np.uint64, keepdims=True) + salt * _C))
            continue
        blocks = differ // 2 + 1
        spare = min(blocks // 12, 2 + blocks // 40)  # so many more blocks differ in one element at most
        blocks += spare
        at = ((salted >> np.uint64(32)) * np.uint64(3 * blocks) >> np.uint64(32)).astype(np.int64)
        held = np.zeros(3 * blocks, np.uint64)
        np.add.at(held, at, values)
        held = held.reshape(blocks, 3)
        empty = held == 0
        pairs = np.concatenate([held[:, i] * _A + held[:, j] for i, j in ((0, 1), (0, 2), (1, 2))])
        keys = mixed(mixed(pairs) + np.arange(3 * blocks, dtype=np.uint64) * _A + salt * _C)
        # two empty segments say nothing; without them a linked set is still met while no more blocks than `spare` hold two
        if (empty.sum(axis=1) > 1).sum() <= spare:
            keys = keys[np.concatenate([~(empty[:, i] & empty[:, j]) for i, j in ((0, 1), (0, 2), (1, 2))])]
        out.append(keys)
    return np.concatenate(out)


class Union:
    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def roots(self, a: int, b: int) -> np.ndarray:
        r = self.parent[a:b]
        while True:
            up = self.parent[r]
            if (up == r).all():
                self.parent[a:b] = r
                return r
            r = up


class SignatureTree:
    """Sets sorted by size under nodes of LEAF sets, then of two nodes each."""

    def __init__(self, sets: list[np.ndarray], percent: int, bits: int = 1 << 27):
        self.percent = percent
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
        self.order = np.asarray(order)
        self.sets = [sets[i] for i in order]
        self.sizes = np.asarray([len(s) for s in self.sets], np.int64)
        every = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        values, number, count = np.unique(every, return_inverse=True, return_counts=True)
        shared = np.cumsum(count > 1) - 1  # elements of one set alone need no bit
        width = int(shared[-1]) + 1 if len(shared) else 0
        self.exact = width * len(sets) <= bits
        row = np.repeat(np.arange(len(sets)), self.sizes)
        keep = count[number] > 1
        bit = shared[number][keep]
        if not self.exact:
            width = max(64, bits // max(1, len(sets)))
            bit = bit % width
        self.words = max(1, -(-width // 64))
        self.bitmaps = np.zeros((len(sets), self.words), np.uint64)
        np.bitwise_or.at(self.bitmaps, (row[keep], bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        self.own = np.bincount(row[~keep], minlength=len(sets))  # elements without a bit
        self.union = Union(len(sets))
        # level 0: leaves; a node is (first set, end, OR, AND, least own elements, greatest size)
        self.levels = [[self._node(a, min(len(sets), a + LEAF)) for a in range(0, len(sets), LEAF)]]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([self._over(below[i : i + 2]) for i in range(0, len(below), 2)])

    def _node(self, a: int, b: int):
        return a, b, np.bitwise_or.reduce(self.bitmaps[a:b]), np.bitwise_and.reduce(self.bitmaps[a:b])

    def _over(self, nodes):
        return nodes[0][0], nodes[-1][1], np.bitwise_or.reduce([x[2] for x in nodes]), np.bitwise_and.reduce([x[3] for x in nodes])

    def _linked(self, overlap, sizes):
        return (100 + self.percent) * overlap >= self.percent * sizes

    def _may_link(self, x, y) -> bool:
        """Whether the greatest possible overlap of a set below x and one below y is enough."""
        high_x, high_y = int(self.sizes[x[1] - 1]), int(self.sizes[y[1] - 1])
        most = min(high_x - int(np.bitwise_count(x[3] & ~y[2]).sum()), high_y - int(np.bitwise_count(y[3] & ~x[2]).sum()))
        if self.exact:
            most = min(most, int(np.bitwise_count(x[2] & y[2]).sum()))
        low = int(self.sizes[x[0]]) + int(self.sizes[y[0]])
        return bool(self._linked(most, low))

    def _connected(self, x, y) -> bool:
        r = self.union.roots(x[0], x[1])
        return bool((r == r[0]).all() and (self.union.roots(y[0], y[1]) == r[0]).all())

    def _leaves(self, x, y) -> None:
        a, b = self.bitmaps[x[0] : x[1]], self.bitmaps[y[0] : y[1]]
        overlap = np.bitwise_count(a[:, None, :] & b[None, :, :]).sum(-1, dtype=np.int64)
        sizes = self.sizes[x[0] : x[1], None] + self.sizes[None, y[0] : y[1]]
        if not self.exact:  # bits stand for several elements: a bound first, then the sets themselves
            miss_a = np.bitwise_count(a[:, None, :] & ~b[None, :, :]).sum(-1, dtype=np.int64)
            miss_b = np.bitwise_count(b[None, :, :] & ~a[:, None, :]).sum(-1, dtype=np.int64)
            overlap = np.minimum(self.sizes[x[0] : x[1], None] - miss_a, self.sizes[None, y[0] : y[1]] - miss_b)
        for i, j in zip(*np.nonzero(self._linked(overlap, sizes))):
            i, j = int(i) + x[0], int(j) + y[0]
            if i < j and self.union.root(i) != self.union.root(j):
                if self.exact or self._linked(len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)), int(self.sizes[i] + self.sizes[j])):
                    self.union.join(i, j)

    def link(self) -> np.ndarray:
        """For each given set the number of a set that it is connected with, the same for all of a component."""
        top = len(self.levels) - 1
        stack = [(top, 0, 0)] if self.sets else []
        while stack:
            level, i, j = stack.pop()
            x, y = self.levels[level][i], self.levels[level][j]
            if (i != j and not self._may_link(x, y)) or self._connected(x, y):
                continue
            if level == 0:
                self._leaves(x, y)
                continue
            n = len(self.levels[level - 1])
            below = [(p, q) for p in (2 * i, 2 * i + 1) for q in (2 * j, 2 * j + 1) if p < n and q < n and p <= q]
            # a node with itself first: what it connects is pruned afterwards
            stack += [(level - 1, p, q) for p, q in sorted(below, key=lambda b: b[0] == b[1])]
        out = np.empty(len(self.sets), np.int64)
        out[self.order] = self.order[self.union.roots(0, len(self.sets))] if self.sets else 0
        return out


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def _node(s1: str, s2: str):
    return F.struct(F.col(s1).alias("s1"), F.col(s2).alias("s2"))


def linked(docs: DataFrame, n: int = 4, percent: int = 85, limit: int = LIMIT, held: int = HELD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every row."""
    kind = docs.schema[id_column].dataType.simpleString()
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    source = docs.select(F.col(f"`{id_column}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(17), text, F.lit(29)).alias("h2"))
    tops = [t for t in ceilings(percent) if t < 1 << 34]

    def sketch(batches):
        for batch in slices(batches, "text"):
            sets = gram_sets(batch.column("text"), n)
            marks = [fingerprint(s) for s in sets]
            yield _batch(id=batch.column("id"), h1=batch.column("h1"), h2=batch.column("h2"), n_shingles=pa.array([len(s) for s in sets], pa.int64()), s1=pa.array([p[0] for p in marks], pa.int64()), s2=pa.array([p[1] for p in marks], pa.int64()), bitmap=pa.array([parities(s) if len(s) else b"" for s in sets], pa.binary()))

    def deal(batches):
        seen = set()
        for batch in slices(batches, "text"):
            rows: list[list] = [[], [], []]
            for s in gram_sets(batch.column("text"), n):
                p = fingerprint(s)
                if len(s) and p not in seen:
                    seen.add(p)
                    x = segments(s, percent, tops).view(np.int64)
                    for part, y in zip(rows, (x, np.full(len(x), p[0]), np.full(len(x), p[1]))):
                        part.append(y)
            if rows[0]:
                yield _batch(segment=np.concatenate(rows[0]), s1=np.concatenate(rows[1]), s2=np.concatenate(rows[2]))

    def tie(batches):
        """Of rows sorted by segment: each set with the first set of its segment."""
        held = None
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("segment", "s1", "s2")])
            if not x.shape[1]:
                continue
            if held is not None:
                x = np.concatenate([held, x], axis=1)
            begins = np.concatenate([[True], x[0, 1:] != x[0, :-1]])
            first = np.flatnonzero(begins)[np.cumsum(begins) - 1]
            held = x[:, first[-1:]]
            apart = (x[1] != x[1, first]) | (x[2] != x[2, first])
            ties = np.unique(np.concatenate([x[1:, apart], x[1:, first[apart]]]), axis=1)
            yield _batch(s1=ties[0], s2=ties[1], g1=ties[2], g2=ties[3])

    dealt = source.select("text").mapInArrow(deal, "segment long, s1 long, s2 long")
    ties = dealt.repartition("segment").sortWithinPartitions("segment", "s1", "s2").mapInArrow(tie, "s1 long, s2 long, g1 long, g2 long")
    ties = stored(ties.distinct(), "ties")
    tied = ties.unionByName(ties.select(F.col("g1").alias("s1"), F.col("g2").alias("s2"), "g1", "g2").distinct())
    sketches = stored(source.mapInArrow(sketch, f"id {kind}, h1 long, h2 long, n_shingles long, s1 long, s2 long, bitmap binary"), "sketches")

    def compare(batches):
        key, rows, bytes_held, over_held = None, {}, 0, False

        def close():
            nodes = list(rows)
            if len(nodes) < 2:
                return []
            found = possible_links([rows[x][0] for x in nodes], [rows[x][1] for x in nodes], percent)
            return [(*nodes[i], *nodes[j]) for i, j in enumerate(found) if i != j]

        def edges(pairs):
            columns = list(zip(*pairs)) if pairs else [()] * 4
            return _batch(**{c: pa.array(x, pa.int64()) for c, x in zip(("s1", "s2", "r1", "r2"), columns)})

        for batch in batches:
            out = []
            for s1, s2, *k, size, bitmap in zip(*(batch.column(c).to_pylist() for c in ("s1", "s2", "g1", "g2", "n_shingles", "bitmap"))):
                if k != key:
                    out += close()
                    key, rows, bytes_held, over_held = k, {}, 0, False
                if over_held:
                    out.append((s1, s2, *k))
                elif (s1, s2) not in rows:
                    rows[s1, s2] = (size, bitmap)
                    bytes_held += len(bitmap) + ROW_BYTES
                    if bytes_held > held:
                        out += [(*x, *k) for x in rows]
                        rows, over_held = {}, True
            yield edges(out)
        yield edges(close())

    bitmaps = sketches.select("s1", "s2", "n_shingles", "bitmap").join(tied.select("s1", "s2").distinct(), ["s1", "s2"], "left_semi").dropDuplicates(["s1", "s2"])
    near = tied.join(bitmaps, ["s1", "s2"]).repartition("g1", "g2").sortWithinPartitions("g1", "g2").mapInArrow(compare, "s1 long, s2 long, r1 long, r2 long")
    groups = components(near.select(_node("s1", "s2").alias("a"), _node("r1", "r2").alias("b")))
    groups = stored(groups.select(F.col("node.s1").alias("s1"), F.col("node.s2").alias("s2"), F.col("root.s1").alias("g1"), F.col("root.s2").alias("g2")), "candidates")
    # one text of each candidate set is read again
    place = sketches.groupBy("s1", "s2").agg(F.min(F.struct("h1", "h2")).alias("h")).select("s1", "s2", "h.*")
    placed = stored(groups.join(place, ["s1", "s2"]), "places")
    if placed.count() <= BROADCAST_ROWS:
        placed = F.broadcast(placed)

    def with_set(batches):
        seen = set()
        for batch in slices(batches, "text"):
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("s1", "s2", "g1", "g2"))))
            new = []
            for i, k in enumerate(keys):
                if k[:2] not in seen:
                    seen.add(k[:2])
                    new.append(i)
            sets = gram_sets(batch.column("text").take(pa.array(new, pa.int64())), n)
            columns = list(zip(*(keys[i] for i in new))) if new else [()] * 4
            yield _batch(**{c: pa.array(x, pa.int64()) for c, x in zip(("s1", "s2", "g1", "g2"), columns)}, size=pa.array([len(s) for s in sets], pa.int64()), grams=pa.array([s.tobytes() for s in sets], pa.binary()))

    members = source.select("text", "h1", "h2").join(placed, ["h1", "h2"]).select("text", "s1", "s2", "g1", "g2").mapInArrow(with_set, "s1 long, s2 long, g1 long, g2 long, size long, grams binary")
    members = stored(members, "sets")
    group = ["g1", "g2"]
    over = lambda rows: rows.groupBy(*group).agg(F.sum("size").alias("total")).filter(F.col("total") > limit).select(*group)
    task = lambda rows: rows.select("s1", "s2", "g1", "g2", F.lit(0).alias("x"), F.lit(0).alias("y"), "grams")
    large = stored(over(members), "large-groups")
    split = not large.isEmpty()
    whole = task(members.join(large, group, "left_anti") if split else members)
    if split:
        apart = members.join(large, group, "left_semi").drop(*group).join(tied, ["s1", "s2"])
        sizes = members.join(large, group, "left_semi").select("s1", "s2", "size").join(tied, ["s1", "s2"])
        huge = stored(over(sizes), "large-ties")
        if huge.isEmpty():
            whole = whole.unionByName(task(apart))
        else:
            whole = whole.unionByName(task(apart.join(huge, group, "left_anti")))
            # blocks: by size, so that linked sets are at most three classes apart, and by hash where a class is large
            size_class = F.floor(F.log(F.col("size").cast("double")) / F.lit(float(np.log(100 / percent) / 2) * 1.000001)).cast("int").alias("c")
            classes = sizes.join(huge, group, "left_semi").groupBy(*group, size_class).agg(F.ceil(F.sum("size") * 2 / limit).cast("int").alias("k"))
            blocks = classes.withColumn("h", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("block", F.col("c") * 65536 + F.col("h")).select(*group, "c", "block")
            other = blocks.select(*group, F.col("c").alias("c2"), F.col("block").alias("y"))
            pairs = blocks.join(other, group).filter((F.col("c2") - F.col("c")).between(0, 3) & (F.col("block") <= F.col("y"))).select(*group, F.col("block").alias("x"), "y")
            placed = apart.withColumn("c", size_class).join(classes, [*group, "c"]).withColumn("block", F.col("c") * 65536 + F.pmod("s1", F.col("k")))
            side = lambda name, rows: placed.join(rows.withColumn("block", F.col(name)), [*group, "block"]).select("s1", "s2", "g1", "g2", "x", "y", "grams")
            whole = whole.unionByName(side("x", pairs)).unionByName(side("y", pairs.filter("x <> y")))

    def verify(batches):
        key, rows = None, []

        def close():
            unique = {(r[0], r[1]): r[2] for r in rows}
            nodes = sorted(unique)
            found = SignatureTree([np.frombuffer(unique[k], np.uint64) for k in nodes], percent).link()
            pairs = [(*nodes[i], *nodes[j]) for i, j in enumerate(found.tolist()) if i != j]
            columns = list(zip(*pairs)) if pairs else [()] * 4
            return _batch(**{c: pa.array(x, pa.int64()) for c, x in zip(("s1", "s2", "r1", "r2"), columns)})

        for batch in batches:
            for s1, s2, *k, grams in zip(*(batch.column(c).to_pylist() for c in ("s1", "s2", "g1", "g2", "x", "y", "grams"))):
                if k != key and rows:
                    yield close()
                    rows = []
                key = k
                rows.append((s1, s2, grams))
        if rows:
            yield close()

    links = whole.repartition("g1", "g2", "x", "y").sortWithinPartitions("g1", "g2", "x", "y").mapInArrow(verify, "s1 long, s2 long, r1 long, r2 long")
    # a group that was verified whole gives its components at once; those of split groups meet in further links
    roots = links.select("s1", "s2", "r1", "r2")
    if split:
        joined = components(links.select(_node("s1", "s2").alias("a"), _node("r1", "r2").alias("b")))
        roots = joined.select(F.col("node.s1").alias("s1"), F.col("node.s2").alias("s2"), F.col("root.s1").alias("r1"), F.col("root.s2").alias("r2"))
    roots = stored(roots, "roots")
    rows = sketches.drop("bitmap").join(roots, ["s1", "s2"], "left")
    rows = rows.select("id", "n_shingles", F.coalesce("r1", "s1").alias("r1"), F.coalesce("r2", "s2").alias("r2"))
    # stored: a join with a table can be split where one component is large, one with an aggregate cannot
    least = stored(rows.filter("n_shingles > 0").groupBy("r1", "r2").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("r1", "r2", "least"), "least")
    out = rows.join(least, ["r1", "r2"], "left")
    return out.select(F.col("id").alias(id_column), "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("least", "id")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with one row of each component: that of the least non-null id, among equal ids that of the least text hash, then of the first row. Each row, repeated or of a null id, is a document of its own."""
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no name of the input meets one that is made here
    numbered = stored(docs.select(*[F.col(f"`{c}`").alias(o) for c, o in own.items()], F.monotonically_increasing_id().alias("row")), "numbered")
    id_, text = F.col(own[id_column]), F.col(own[text_column])
    key = F.struct(id_.isNull().alias("none"), id_.alias("id"), F.xxhash64(text).alias("hash"), F.col("row"))
    found = linked(numbered.select(key.alias("key"), text.alias("text")), n, percent, id_column="key")
    losing = found.filter(F.col("component_id") < F.col("key")).select(F.col("key.row").alias("row"))
    return numbered.join(losing, "row", "left_anti").select(*[F.col(o).alias(c) for c, o in own.items()])
