"""Packing by minimum bin slack.

Each document's ids and an end id are cut into whole sequences and a remainder. Remainders wait in a window.
For each sequence the longest waiting one is taken, then a subset-sum over the multiset of waiting lengths (a
bitset of reachable sums for each distinct length, counts split into powers of two) finds the sum nearest to the
room that is left, and walking back through the bitsets gives how many of each length to take. Room that no
multiset fills is filled with the front of a waiting piece, as documents may be cut freely. What remains at a
partition's end is cut into sequences of powers of two, so that no sequence needs padding.

Each partition packs its own rows in one pass: no shuffle, and memory bounded by the window.
Defined cases: a null or empty text is its end id alone; rows with equal or null ids are packed each for itself;
extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import filled, slices
from .pieces import encoder, releasing

CAPACITY = 2048
WINDOW = 2048  # remainders that wait at most
LENGTHS = 48  # distinct lengths that a first subset-sum looks at; all follow where it misses an exact fill


def nearest_multiset(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of the multiset length -> count, how many of each length to take so that their sum is nearest to room, not above it."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length, count in counts.items():
        part = 1
        while count > 0 and not reach >> room & 1:
            take = min(part, count)
            if take * length > room:
                break
            steps.append((length, take, reach))
            reach |= reach << (take * length) & mask
            count, part = count - take, part * 2
    left, taken = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> left & 1:  # this sum needs the step
            taken[length] += take
            left -= take * length
    return taken


class Packer:
    """add() whole documents, then finish(); rows: (document, start, ids, document's ids, sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY, window: int = WINDOW):
        self.capacity, self.window, self.sequence, self.rows = capacity, window, 0, []
        self.waiting: dict[int, list] = defaultdict(list)
        self.n_waiting = 0

    def _wait(self, piece) -> None:
        if len(piece[2]):
            self.waiting[len(piece[2])].append(piece)
            self.n_waiting += 1

    def _pop(self, length: int):
        piece = self.waiting[length].pop()
        if not self.waiting[length]:
            del self.waiting[length]
        self.n_waiting -= 1
        return piece

    def _cut(self, piece, at: int):
        doc, start, ids, total = piece
        return (doc, start, ids[:at], total), (doc, start + at, ids[at:], total)

    def _emit(self, pieces) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, ids, total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def _fill(self) -> None:
        """One full sequence; there are at least so many waiting ids."""
        taken = [self._pop(max(self.waiting))]
        room = self.capacity - len(taken[0][2])
        if room:
            fit = sorted((x for x in self.waiting if x <= room), reverse=True)
            near = fit[:: max(1, -(-len(fit) // LENGTHS))]
            found = nearest_multiset({x: len(self.waiting[x]) for x in near}, room)
            if len(near) < len(fit) and sum(x * n for x, n in found.items()) < room:
                found = nearest_multiset({x: len(self.waiting[x]) for x in fit}, room)
            for length, count in found.items():
                taken += [self._pop(length) for _ in range(count)]
                room -= length * count
        while room and self.n_waiting:
            piece = self._pop(min((x for x in self.waiting if x >= room), default=max(self.waiting)))
            front, back = self._cut(piece, min(room, len(piece[2])))
            taken.append(front)
            self._wait(back)
            room -= len(front[2])
        self._emit(taken)

    def add(self, doc, ids: np.ndarray) -> None:
        piece = (doc, 0, ids, len(ids))
        while len(piece[2]) >= self.capacity:
            whole, piece = self._cut(piece, self.capacity)
            self._emit([whole])
        self._wait(piece)
        while self.n_waiting > self.window:
            self._fill()

    def finish(self) -> None:
        left = sum(n * len(x) for n, x in self.waiting.items())
        while left >= self.capacity:
            self._fill()
            left -= self.capacity
        rest = [p for n in sorted(self.waiting, reverse=True) for p in self.waiting[n]]
        self.waiting.clear()
        self.n_waiting = 0
        while left:
            size, taken = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                front, back = self._cut(rest.pop(0), size)
                taken.append(front)
                size -= len(front[2])
                if len(back[2]):
                    rest.insert(0, back)
            self._emit(taken)


def pack(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, window: int = WINDOW, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each piece; with_ids adds the piece's ids. sequence_id is unique: the partition in the upper bits."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        table, packer, part, id_type = encoder(path), Packer(capacity, window), TaskContext.get().partitionId() << 36, pa.int64()

        def out():
            rows, packer.rows = packer.rows, []
            columns = list(zip(*rows)) if rows else [()] * 6
            arrays = [pa.array(columns[0], id_type), pa.array(columns[1], pa.int64()), pa.array([len(x) for x in columns[2]], pa.int64()), pa.array([zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in columns[2]], pa.int64()), pa.array(columns[3], pa.int64()), pa.array([part + x for x in columns[4]], pa.int64()), pa.array(columns[5], pa.int64())]
            names = [id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in columns[2]], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in slices(batches, text_column):
            id_type = batch.column(id_column).type
            for doc, ids in zip(batch.column(id_column).to_pylist(), table.encode(filled(batch.column(text_column)))):
                packer.add(doc, np.append(ids, np.uint32(end_id)))
            yield out()
        packer.finish()
        if packer.rows:
            yield out()

    schema = f"`{id_column}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(id_column, text_column).mapInArrow(releasing(path, run), schema)
