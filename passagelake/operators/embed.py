"""Embedding providers. Each names its model and backend, has a dimension, and turns a column of texts into unit vectors."""

from __future__ import annotations

import hashlib
import math
from pathlib import Path
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BATCH = 128
ROWS = 2048  # texts whose vectors a worker holds at once
BUCKETS, BUCKET_LETTERS = 100_000, 64  # words and their letters that a provider's table holds
LETTERS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))  # of a word; other bytes part words


class Provider(Protocol):
    model_id: str
    backend_id: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class _Buckets(dict):
    """The buckets of words, each computed once while the table is not full."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: bytes) -> int:
        bucket = int(hashlib.md5(word).hexdigest()[:8], 16) % self.dim
        if len(word) <= BUCKET_LETTERS:
            if len(self) >= BUCKETS:
                self.clear()
            self[word] = bucket
        return bucket

    def __reduce__(self):  # tasks begin with an empty table
        return _Buckets, (self.dim,)


class HashingProvider:
    """Offline and lexical: words are counted in buckets of their MD5 and the counts scaled to a unit vector. No semantic model."""

    backend_id = "hashing-md5"

    def __init__(self, dim: int = 64):
        self.dim, self.model_id, self._buckets = dim, f"hashing-{dim}", _Buckets(dim)

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            words = text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split()
            if words:
                out[i] = np.bincount(np.fromiter(map(self._buckets.__getitem__, words), np.int64, len(words)), minlength=self.dim)
                out[i] /= math.sqrt(float((out[i] * out[i]).sum()))
        return out.astype(np.float32)


def pool_and_normalize(states, mask, seq: int, hidden: int) -> np.ndarray:
    """Mean of the unmasked token states, scaled to a unit vector; zeros if all are masked."""
    x, m = np.asarray(states, np.float32).reshape(seq, hidden), np.asarray(mask, bool)[:seq]
    if not m.any():
        return np.zeros(hidden, np.float32)
    mean = x[m].sum(axis=0, dtype=np.float32) / np.float32(m.sum())
    size = np.sqrt((mean * mean).sum(dtype=np.float32))
    return mean / size if size > 0 else mean


class OnnxProvider:
    """A local ONNX sentence encoder: model.onnx, tokenizer.json and config.json in one folder."""

    FILES = ("model.onnx", "tokenizer.json", "config.json")

    def __init__(self, folder: str, model_id: str, backend_id: str | None = None):
        import json
        import platform

        missing = [f for f in self.FILES if not (Path(folder) / f).exists()]
        if missing:
            raise FileNotFoundError(f"model files missing in {folder}: {', '.join(missing)}")
        self.folder, self.model_id = folder, model_id
        # vectors of different systems may differ in their last digits
        self.backend_id = backend_id or f"onnx-fp32-{platform.system().lower()}-{platform.machine().lower()}"
        self.dim = int(json.loads((Path(folder) / "config.json").read_text())["hidden_size"])
        self._loaded = None

    def __getstate__(self):
        return self.__dict__ | {"_loaded": None}

    def embed(self, texts: list[str]) -> np.ndarray:
        if self._loaded is None:  # once for each worker
            import onnxruntime
            from tokenizers import Tokenizer

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1
            tokenizer = Tokenizer.from_file(f"{self.folder}/tokenizer.json")
            tokenizer.enable_padding()
            self._loaded = onnxruntime.InferenceSession(f"{self.folder}/model.onnx", options), tokenizer
        session, tokenizer = self._loaded
        coded = tokenizer.encode_batch(texts)
        ids, mask = np.array([e.ids for e in coded], np.int64), np.array([e.attention_mask for e in coded], np.int64)
        states = session.run(None, {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)})[0]
        return np.stack([pool_and_normalize(s, m, s.shape[0], s.shape[1]) for s, m in zip(states, mask)])


def half_and_norm(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows rounded to binary16 values, and their norms: half_vector() and norm() of whole matrices."""
    with np.errstate(over="ignore", invalid="ignore"):
        half = vectors.astype(np.float16).astype(np.float32)
        total = np.zeros(len(half), np.float32)
        for j in range(half.shape[1]):  # in index order and single precision
            total += half[:, j] * half[:, j]
    return half, np.sqrt(total.astype(np.float64)).astype(np.float32)


def embed(texts: DataFrame, provider: Provider, text: str = "text", out: str = "embedding", stored_form: bool = False) -> DataFrame:
    """texts with the provider's vectors. Within a batch texts are embedded by length, BATCH at a time, and put back in order.

    stored_form: vectors as an index holds them, rounded to binary16 values, and with their norms in `<out>_norm`."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                yield made_of(batch.slice(begin, ROWS))

    def made_of(batch):
        values = [v or "" for v in batch.column(text).to_pylist()]
        order = sorted(range(len(values)), key=lambda i: len(values[i].encode()))
        vectors = np.zeros((len(values), provider.dim), np.float32)
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            made = np.asarray(provider.embed([values[i] for i in part]), np.float32)
            if made.shape != (len(part), provider.dim):
                raise ValueError(f"the embedding backend returned {' x '.join(map(str, made.shape))} values for {len(part)} texts of {provider.dim} dimensions")
            vectors[part] = made
        if stored_form:
            vectors, norms = half_and_norm(vectors)
        column = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * provider.dim), pa.array(vectors.ravel()))
        batch = batch.append_column(out, column)
        return batch.append_column(f"{out}_norm", pa.array(norms)) if stored_form else batch

    return texts.mapInArrow(run, f"{fields}, `{out}` array<float>" + (f", `{out}_norm` float" if stored_form else ""))
