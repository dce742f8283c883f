"""Token ids in a file format compressed by Re-Pair.

Ids are written in ascending order of document id, in shards. Within a shard frequent pairs of neighbouring
symbols are replaced by new symbols, round after round, until no pair occurs LEAST times: a rule takes 12 bytes of the
file and saves a symbol of two bytes or four at each of its places, so rarer pairs do not pay. A round counts all
pairs at once; where frequent pairs overlap the commoner one goes first, as if the commonest were replaced one after
another. A pair that was rare once stays rare, so later rounds look only at what the last one left or made. A
shard's file holds the rules, how many ids each symbol stands for, a sampled index from symbols to ids, and the remaining
symbols; ids_at() decodes any range of ids from it without expanding the rest.

The shards are rows of a Parquet table of binary payloads, so any store that Spark writes to can hold them and
its commit makes lost or repeated tasks harmless.

Defined cases: a null or empty text is its end id alone; null document ids come first; equal document ids follow
each other in the order of their texts' hash; extra columns are ignored; an empty table gives no shards.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, shared_dir, slices, trimming
from .pieces import encoder, releasing

MAGIC = b"RPID1\0\0\0"
SHARD_IDS = 1 << 20
LEAST = 8
SAMPLE = 256
_HEAD = struct.Struct("<8sQQQQQQ")
_SALTS = np.random.default_rng(20240607).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def compress(ids: np.ndarray, first_rule: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rule k replaces its pair (left, right) by the symbol first_rule + k. No pair is left that stands `least` times without overlap."""
    symbols, rules, made, salt = ids.astype(np.uint32), [], 0, 0
    live = np.ones(max(0, len(symbols) - 1), bool)  # places whose pair may still be frequent
    while True:
        at = np.flatnonzero(live)
        if len(at) < least:
            break
        code = symbols[at].astype(np.uint64)
        code <<= np.uint64(32)
        code |= symbols[1:][at]
        bits = max(10, len(at).bit_length())
        slot = code * _SALTS[salt % len(_SALTS)]
        slot >>= np.uint64(64 - bits)
        slot = slot.view(np.int64)
        salt += 1
        # pairs share slots, so a slot's count is a bound
        often = (np.bincount(slot, minlength=1 << bits) >= least)[slot]
        live[at[~often]] = False
        at = at[often]  # one after the other: each old array goes before the next new one comes
        code = code[often]
        slot = slot[often]
        # of pairs that overlap in a run of one symbol every second one counts
        twins = np.flatnonzero(code >> np.uint64(32) == code & np.uint64(0xFFFFFFFF))
        counts = np.ones(len(at), bool)
        if len(twins):
            place = at[twins]
            begins = np.concatenate([[True], np.diff(place) > 1])
            counts[twins] = (place - place[begins][np.cumsum(begins) - 1]) % 2 == 0
        pair = np.zeros(1 << bits, np.uint64)
        pair[slot] = code
        alone = pair[slot] == code  # the others wait for another salt
        n = np.bincount(slot[alone & counts], minlength=1 << bits)
        enough = (n >= least)[slot]
        live[at[alone & ~enough]] = False
        ready = alone & counts & enough
        if not ready.any():
            waiting = np.unique(code[~alone & counts], return_counts=True)[1]
            if waiting.max(initial=0) < least:
                break
            continue
        at = at[ready]
        code = code[ready]
        slot = slot[ready]
        code *= _SALTS[0]
        code >>= np.uint64(32)
        rank = n[slot].astype(np.uint64)
        rank <<= np.uint64(32)
        rank |= code
        del n, code
        near = np.diff(at) == 1
        wins = np.ones(len(at), bool)
        wins[1:] &= ~(near & (rank[1:] <= rank[:-1]))
        wins[:-1] &= ~(near & (rank[:-1] < rank[1:]))
        at, slot = at[wins], slot[wins]
        del rank
        chosen = np.flatnonzero(np.bincount(slot, minlength=1 << bits) >= least)
        number = np.zeros(1 << bits, np.uint32)
        number[chosen] = first_rule + made + np.arange(len(chosen))
        rules.append(pair[chosen])
        made += len(chosen)
        new = number[slot]
        at, new = at[new > 0], new[new > 0]
        symbols[at] = new
        # pairs with a new symbol are looked at anew
        live[np.maximum(at - 1, 0)] = True
        live[at[at + 1 < len(live)] + 1] = True
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols = symbols[stay]
        live = np.concatenate([live, [False]])
        live[at] = True
        live = live[stay][:-1]
    flat = np.concatenate(rules) if rules else np.zeros(0, np.uint64)
    return symbols, np.stack([flat >> np.uint64(32), flat & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)


class Grammar:
    """Rules, opened: how many ids each symbol stands for, and which."""

    def __init__(self, rules: np.ndarray, first_rule: int):
        symbols = rules.astype(np.int64)
        self.widths = np.ones(first_rule + len(rules), np.int64)
        latest, levels, done = symbols.max(axis=1, initial=0) - first_rule, [], 0
        while done < len(rules):  # rules made of symbols before `done`
            waits = np.flatnonzero(latest[done:] >= done)
            stop = done + int(waits[0]) if len(waits) else len(rules)
            self.widths[first_rule + done : first_rule + stop] = self.widths[symbols[done:stop]].sum(axis=1)
            levels.append((done, stop))
            done = stop
        self.starts = np.cumsum(self.widths) - self.widths
        self.arena = np.empty(int(self.widths.sum()), np.uint32)
        self.arena[:first_rule] = np.arange(first_rule, dtype=np.uint32)
        for a, b in levels:
            ids = self.expand(symbols[a:b].ravel())
            at = self.starts[first_rule + a]
            self.arena[at : at + len(ids)] = ids

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        widths = self.widths[symbols]
        source = np.repeat(self.starts[symbols] - (np.cumsum(widths) - widths), widths)
        source += np.arange(len(source))
        return self.arena[source]


def pack_shard(ids: np.ndarray, first_rule: int) -> bytes:
    symbols, rules = compress(ids, first_rule)
    widths = Grammar(rules, first_rule).widths
    lengths, of_symbols = widths[first_rule:], widths[symbols]
    index = (np.cumsum(of_symbols) - of_symbols)[::SAMPLE].astype("<u4")
    kind = "<u2" if first_rule + len(rules) <= 1 << 16 else "<u4"
    head = _HEAD.pack(MAGIC, len(ids), len(symbols), len(rules), first_rule, len(index), np.dtype(kind).itemsize)
    return head + rules.astype("<u4").tobytes() + lengths.astype("<u4").tobytes() + index.tobytes() + symbols.astype(kind).tobytes()


class Shard:
    """A shard's bytes, opened: n ids, of which ids_at() decodes any range."""

    def __init__(self, payload: bytes):
        magic, self.n, n_symbols, n_rules, self.first, n_index, width = _HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = _HEAD.size

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(payload, kind, count, at)
            at += out.nbytes
            return out

        rules, self.lengths, self.index = take("<u4", 2 * n_rules).reshape(-1, 2), take("<u4", n_rules), take("<u4", n_index)
        self.symbols = take(f"<u{width}", n_symbols)
        self.grammar = Grammar(rules, self.first)

    def ids(self) -> np.ndarray:
        return self.grammar.expand(self.symbols) if self.n else np.zeros(0, np.uint32)

    def ids_at(self, start: int, count: int) -> np.ndarray:
        """ids[start:start+count], decoding only the symbols around them."""
        count = min(count, self.n - start)
        if count <= 0:
            return np.zeros(0, np.uint32)
        block = int(np.searchsorted(self.index, start, "right")) - 1
        last = int(np.searchsorted(self.index, start + count, "left"))
        found = self.grammar.expand(self.symbols[block * SAMPLE : last * SAMPLE])
        return found[start - int(self.index[block]) :][:count]


def write_ids(docs: DataFrame, path: str, out: str, end_id: int = 0, shard_ids: int = SHARD_IDS, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Writes every row's ids and end_id to the folder `out`. A shard ends with the document that fills it."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        table, part, shard, done = encoder(path), TaskContext.get().partitionId(), 0, 0
        first_rule, ids, marks, held = table.tokenizer.get_vocab_size(), [], [], 0
        id_type = pa.int64()

        def flush():
            nonlocal shard, done, ids, marks, held
            flat = np.concatenate(ids)
            ids = []
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([done], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([[d for d, _ in marks]], pa.list_(id_type)), pa.array([[n for _, n in marks]], pa.list_(pa.int64())), pa.array([pack_shard(flat, first_rule)], pa.binary())], names=["part", "shard", "start", "n_ids", "docs", "lengths", "payload"])
            done, shard, marks, held = done + len(flat), shard + 1, [], 0
            return row

        for batch in slices(batches, text_column):
            id_type = batch.column(id_column).type
            for doc, coded in zip(batch.column(id_column).to_pylist(), table.encode(filled(batch.column(text_column)))):
                coded = np.append(coded, np.uint32(end_id))
                ids.append(coded)
                marks.append((doc, len(coded)))
                held += len(coded)
                if held >= shard_ids:
                    yield flush()
        if held:
            yield flush()

    ordered = docs.select(id_column, text_column).repartitionByRange(id_column).sortWithinPartitions(F.col(id_column).asc_nulls_first(), F.xxhash64(text_column))
    ordered.mapInArrow(trimming(releasing(path, run)), f"part int, shard int, start long, n_ids long, docs array<{kind}>, lengths array<long>, payload binary").write.parquet(out)


def read_ids(spark, out: str) -> DataFrame:
    """The shards of write_ids(), with `start` counted over the whole folder."""
    shards = spark.read.parquet(out)
    # one row for each partition that wrote: their number is set by the session, not by the data
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    before, bases = 0, []
    for row in sorted(totals, key=lambda r: r["part"]):
        bases.append((row["part"], before))
        before += row["n"]
    bases = spark.createDataFrame(bases, "part int, base long")
    return shards.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("start")).drop("base")


def documents_of(shards: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """From read_ids(): each document's id, start, n_tokens and the CRC-32 of its ids, decoded from the files."""
    kind = shards.schema["docs"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw = np.ascontiguousarray(Shard(batch.column("payload")[i].as_py()).ids(), "<u4")
                lengths = np.asarray(batch.column("lengths")[i].as_py(), np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(raw[b - n : b]) for b, n in zip(ends, lengths)]
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("docs")[i].as_py(), batch.column("docs").type.value_type), pa.array(ends - lengths + batch.column("start")[i].as_py()), pa.array(lengths), pa.array(crc, pa.int64())], names=[id_column, "start", "n_tokens", "ids_crc32"])

    return shards.select("start", "docs", "lengths", "payload").mapInArrow(trimming(run), f"`{id_column}` {kind}, start long, n_tokens long, ids_crc32 long")
