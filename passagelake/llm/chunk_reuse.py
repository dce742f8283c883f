"""Encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts each text where the last WIDTH bytes hash to a fixed pattern, so passages that
documents share fall into equal chunks wherever they stand. A worker encodes each distinct chunk once and keeps
the ids between the chunk's first and last stable place (white space: no token of the file crosses it). The joins
are then repaired: the text from the last stable place before a cut to the first one after it, through as many
chunks as have none, is encoded anew; with stable places on both sides the result is exact.

Defined cases: a null or empty text has no ids and decodes to the empty text; rows with equal or null ids are
handled each for itself; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import filled, mixed, prefix_hash, slices, window_hash
from .pieces import encoder, library, releasing

WIDTH = 32
MASK_BITS = 11  # chunks of 2 KiB on average
#: Bytes of chunk text that a worker keeps with their ids; then it starts anew.
KEPT_BYTES = 24 << 20
NOTHING = np.zeros(0, np.uint32)
SPACES = b" \n"


def cuts(data: np.ndarray, width: int = WIDTH, bits: int = MASK_BITS) -> np.ndarray:
    """Places at which content says to cut; each depends on the `width` bytes before it alone."""
    if len(data) <= width:
        return np.zeros(0, np.int64)
    hashed = mixed(window_hash(prefix_hash(data), width))
    return np.flatnonzero(hashed >> np.uint64(64 - bits) == 0) + width


class ChunkEncoder:
    def __init__(self, path: str):
        self.table = encoder(path)
        self.kept: dict[bytes, tuple] = {}
        self.size = self.reused = self.coded = 0

    def _chunks(self, chunks: list[bytes]) -> dict[bytes, tuple]:
        """(head, ids, tail) of each distinct chunk; head and tail reach to its stable places; ids is None where it has fewer than two."""
        if self.size > KEPT_BYTES:
            self.kept, self.size = {}, 0
        new = list(dict.fromkeys(c for c in chunks if c not in self.kept))
        self.reused += len(chunks) - len(new)
        self.coded += len(new)
        inner, bounds = [], []
        for c in new:
            first = min((x for x in map(c.find, (b" ", b"\n")) if x >= 0), default=-1)
            last = max(c.rfind(b" "), c.rfind(b"\n"))
            bounds.append((first, last))
            inner.append(c[first:last].decode() if last > first >= 0 else "")
        for c, (first, last), ids in zip(new, bounds, self.table.encode(pa.array(inner, pa.string()))):
            self.kept[c] = (c[:first], ids, c[last:]) if last > first >= 0 else (c, None, b"")
            self.size += len(c) + ids.nbytes
        return self.kept

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        raw = [x.encode() for x in texts.to_pylist()]
        joined = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(x) for x in raw])
        places, documents, everything = cuts(joined), [], []
        for x, end in zip(raw, ends):
            begin = end - len(x)
            lo, hi = np.searchsorted(places, (begin + WIDTH, end))
            at = [0, *(places[lo:hi] - begin).tolist(), len(x)]
            # a chunk holds whole characters: a cut inside one moves to its end
            at = [p + next(k for k in range(4) if p + k >= len(x) or x[p + k] & 0xC0 != 0x80) if p else 0 for p in at]
            documents.append([x[a:b] for a, b in zip(at[:-1], at[1:]) if b > a])
            everything += documents[-1]
        kept = self._chunks(everything)
        repairs, plans = [], []
        for chunks in documents:
            plan, bridge = [], b""
            for c in chunks:
                head, ids, tail = kept[c]
                bridge += head
                if ids is not None:
                    plan += [len(repairs), ids]
                    repairs.append(bridge.decode())
                    bridge = tail
            plan.append(len(repairs))
            repairs.append(bridge.decode())
            plans.append(plan)
        repaired = self.table.encode(pa.array(repairs, pa.string()))
        return [np.concatenate([repaired[p] if isinstance(p, int) else p for p in plan]) if len(plan) > 1 else repaired[plan[0]] for plan in plans]


class Decoder:
    """decode(ids) as the library does without skipping special tokens: for a file without a decoder, the tokens joined by single spaces."""

    def __init__(self, path: str):
        self.whole = library(path)
        self.plain = self.whole.decoder is None
        if self.plain:
            tokens = [(self.whole.id_to_token(i) or "").encode() + b" " for i in range(self.whole.get_vocab_size())]
            self.lengths = np.asarray([len(t) for t in tokens], np.int64)
            self.starts = np.cumsum(self.lengths) - self.lengths
            self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        if not self.plain:
            return self.whole.decode(ids.tolist(), skip_special_tokens=False).encode()
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        source = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        source += np.arange(len(source))
        return self.bytes[source].tobytes()[:-1]


_WORKER: dict[str, tuple] = {}


def worker(path: str) -> tuple[ChunkEncoder, Decoder]:
    if path not in _WORKER:
        _WORKER[path] = ChunkEncoder(path), Decoder(path)
    return _WORKER[path]


def encode(docs: DataFrame, path: str, digests: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_tokens and the ids with the decoded text, or (digests) the SHA-256 of each. For files that drop white space."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        chunks, decoder = worker(path)
        for batch in slices(batches, text_column):
            coded = chunks.encode(filled(batch.column(text_column)))
            decoded = [decoder.decode(x) for x in coded]
            columns = [batch.column(id_column), pa.array([len(x) for x in coded], pa.int64())]
            if digests:
                columns += [pa.array([hashlib.sha256(np.ascontiguousarray(x, "<u4")).hexdigest() for x in coded], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())]
            else:
                columns += [pa.array([x.astype(np.int32) for x in coded], pa.list_(pa.int32())), pa.array([x.decode() for x in decoded], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_column, "n_tokens", "a", "b"])
        chunks.kept, chunks.size = {}, 0  # the worker outlives the task

    found = docs.select(id_column, text_column).mapInArrow(releasing(path, run), f"`{id_column}` {kind}, n_tokens long, " + ("a string, b string" if digests else "a array<int>, b string"))
    return found.withColumnsRenamed({"a": "ids_sha256", "b": "decoded_sha256"} if digests else {"a": "ids", "b": "decoded"})
