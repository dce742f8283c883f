"""Splitting a text into overlapping passages of bounded bytes.

A window of `size` bytes ends after its last blank line, or, only if it has none, after its last line feed; either
must lie beyond a quarter of the size. The next window starts `overlap` bytes before the end. Windows are trimmed,
blank ones dropped; offsets count bytes of the trimmed text, before the window's own trim. Each window's start
depends on the one before, so a text is walked sequentially; texts are walked in parallel.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from passagelake.functions.text import WHITE_SPACE

CHUNK_SIZE = 512
CHUNK_OVERLAP = 64
HELD_CHARS = 4 << 20  # of passages that a worker holds, whatever the texts' lengths


def _forward(raw: bytes, at: int) -> int:
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def _window_end(raw: bytes, start: int, size: int) -> int:
    end = _forward(raw, min(start + size, len(raw)))
    if end == len(raw):
        return end
    least = start + size // 4
    for mark in (b"\n\n", b"\n"):
        at = raw.rfind(mark, start, end)
        if at >= 0:
            return at + len(mark) if at > least else end
    return end


def chunk_text(text: str | None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[tuple[int, str]]:
    """(byte offset, passage) in order."""
    if size < 1 or overlap < 0:
        raise ValueError("chunk size must be positive and overlap not negative")
    trimmed = (text or "").strip(WHITE_SPACE)
    raw = trimmed.encode()
    if len(raw) <= size:
        return [(0, trimmed)] if raw else []
    out, start = [], 0
    while start < len(raw):
        end = _window_end(raw, start, size)
        passage = raw[start:end].decode().strip(WHITE_SPACE)
        if passage:
            out.append((start, passage))
        start = end if end - start <= overlap else _forward(raw, end - overlap)
    return out


def chunk(files: DataFrame, key: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """key, chunk_ord, byte_offset, text for every passage; null texts have none. No shuffle."""
    if size < 1 or overlap < 0:
        raise ValueError("chunk size must be positive and overlap not negative")
    kind = files.schema[key].dataType.simpleString()

    def walk(batches):
        for batch in batches:
            rows, held = [], 0
            keys = batch.column(0)

            def out():
                return pa.RecordBatch.from_arrays([keys.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.string())], names=[key, "chunk_ord", "byte_offset", "text"])

            for i, value in enumerate(batch.column(1)):
                for n, (offset, passage) in enumerate(chunk_text(value.as_py(), size, overlap)):
                    rows.append((i, n, offset, passage))
                    held += len(passage)
                if held > HELD_CHARS:
                    yield out()
                    rows, held = [], 0
            yield out()

    return files.select(key, text).mapInArrow(walk, f"`{key}` {kind}, chunk_ord int, byte_offset long, text string")


def chunk_files(files: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """A head row for each of files (path, path_key, hash, text), and a row for each of its passages, in one pass without a shuffle.

    `file` is a number that a file's rows share and no other's have. Only heads have path, path_key, hash and n_chunks (null
    where there is no text), only passages chunk_ord, byte_offset, text and text_hash (the SHA-256 as bytes)."""
    if size < 1 or overlap < 0:
        raise ValueError("chunk size must be positive and overlap not negative")
    schema = pa.schema([("file", pa.int64()), ("path", pa.string()), ("path_key", pa.list_(pa.string())), ("hash", pa.string()), ("n_chunks", pa.int64()), ("chunk_ord", pa.int32()), ("byte_offset", pa.int64()), ("text", pa.string()), ("text_hash", pa.binary())])

    def walk(batches):
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            columns, held = [[] for _ in schema], 0
            paths, keys, hashes, texts = (batch.column(i) for i in range(4))

            def out():
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

            for i in range(batch.num_rows):
                text = texts[i].as_py()
                found = chunk_text(text, size, overlap)
                n = len(found)
                offsets, passages = zip(*found) if found else ((), ())
                nothing = [None] * n
                head = paths[i].as_py(), keys[i].as_py(), hashes[i].as_py(), None if text is None else n
                for column, value, rest in zip(columns, (number, *head, None, None, None, None), ([number] * n, nothing, nothing, nothing, nothing, range(n), offsets, passages, [hashlib.sha256(p.encode()).digest() for p in passages])):
                    column.append(value)
                    column.extend(rest)
                number += 1
                held += sum(map(len, passages))
                if held > HELD_CHARS:
                    yield out()
                    columns, held = [[] for _ in schema], 0
            yield out()

    return files.select("path", "path_key", "hash", "text").mapInArrow(walk, "file long, path string, path_key array<string>, hash string, n_chunks long, chunk_ord int, byte_offset long, text string, text_hash binary")
