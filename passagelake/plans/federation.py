"""Searching one or several stored indexes: which ones, whether they fit together, and the merged result."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelake.functions.text import human_bytes, preview
from passagelake.operators.search import resolve_hits, top_k
from passagelake.sources import files, store
from passagelake.sources.config import INDEX_DIR, Config


@dataclass(frozen=True)
class Spec:
    path: str
    name: str | None = None

    @property
    def label(self) -> str:
        return self.name or self.path


def resolve(indexes: list[str] | None = None, config: str | None = None, only: list[str] | None = None, folder: str = ".") -> list[Spec]:
    """An explicit configuration, then explicit indexes, then a configuration found in the folder, then the default index."""
    if indexes and (config or only):
        raise ValueError("give indexes or a configuration, not both")
    if config is None and indexes:
        return [Spec(p) for p in indexes]
    found = Path(config) if config else Config.locate(folder)
    if found is None:
        if only:
            raise ValueError("names need a configuration")
        return [Spec(str(Path(folder) / INDEX_DIR) if folder != "." else INDEX_DIR)]
    loaded = Config.load(found)
    return [Spec(str(loaded.output_of(e)), e.name) for e in loaded.selected(only)]


def validate(metas: list[tuple[str, store.Meta]], model: str | None = None) -> str:
    """The model that all indexes share; differing models or dimensions are errors, differing backends a warning."""
    for label, meta in metas:
        if meta.format_version != store.FORMAT_VERSION:
            raise ValueError(f"{label}: unsupported format {meta.format_version}; index again")
    if len({m.model_id for _, m in metas}) > 1:
        raise ValueError("indexes use different models: " + ", ".join(f"{l}: {m.model_id}" for l, m in metas))
    if len({m.hidden_size for _, m in metas}) > 1:
        raise ValueError("indexes have different embedding dimensions: " + ", ".join(f"{l}: {m.hidden_size}" for l, m in metas))
    own = metas[0][1].model_id
    if model and model != own:
        raise ValueError(f"the indexes use model {own}, not {model}")
    if len(backends := sorted({m.embedding_backend for _, m in metas})) > 1:
        warnings.warn(f"indexes use different embedding backends: {', '.join(backends)}", stacklevel=2)
    return own


def search(spark: SparkSession, specs: list[Spec], query: str, provider, k: int = 5, model: str | None = None) -> DataFrame:
    """The k best passages: index_name, index, root_dir, source, score, byte_offset, text, best first."""
    metas = [(s.label, store.load_meta(s.path)) for s in specs]
    validate(metas, model)
    vector = provider.embed([query])[0]
    if len(vector) != metas[0][1].hidden_size:
        raise ValueError(f"query has {len(vector)} dimensions, the index {metas[0][1].hidden_size}")
    parts = []
    for order, spec in enumerate(specs):
        index = store.load(spark, spec.path)
        hits = top_k(index.texts, vector.tolist(), k)
        found = resolve_hits(hits, index.occurrences, index.sources, index.texts)
        parts.append(found.select(F.lit(spec.name).cast("string").alias("index_name"), F.lit(spec.path).alias("index"), F.lit(index.meta.root_dir).alias("root_dir"), F.col("path").alias("source"), "score", "byte_offset", "text", F.lit(order).alias("index_order"), "text_id"))
    return reduce(DataFrame.unionByName, parts).orderBy(F.col("score").desc(), "index_order", "text_id").limit(max(0, k))


def as_json(hits: DataFrame) -> str:
    """A compact array; a missing index name is left out."""
    columns = ("index_name", "index", "root_dir", "source", "score", "byte_offset", "text")
    rows = [{c: (None if r[c] != r[c] else r[c]) for c in columns if not (c == "index_name" and r[c] is None)} for r in hits.collect()]
    return json.dumps(rows, ensure_ascii=False, separators=(",", ":"))


def as_text(hits: DataFrame, full: bool = False) -> str:
    rows = hits.collect()
    if not rows:
        return "No results found."
    out = []
    for n, r in enumerate(rows, 1):
        where = f"{r['index_name']}: {r['source']}" if r["index_name"] else r["source"]
        out.append(f"{n}. {where} (score {r['score']:.4f}, offset {r['byte_offset']})")
        out += [f"   {line}" for line in (r["text"] if full else preview(r["text"])).splitlines()]
    return "\n".join(out)


def info(spark: SparkSession, spec: Spec) -> dict[str, object]:
    """What the index holds, from its head and its files' sizes; vectors are not read."""
    meta = store.load_meta(spec.path)
    size = files.size(files.joined(spec.path, store.current(spec.path)))
    index = store.load(spark, spec.path)
    return {"index": spec.label, "path": spec.path, "root": meta.root_dir, "model": meta.model_id, "backend": meta.embedding_backend, "format": meta.format_version, "dimensions": meta.hidden_size, "files": index.file_hashes.count(), "sources": index.sources.count(), "chunks": meta.num_chunks, "unique texts": meta.num_unique_texts, "duplicates": max(0, meta.num_chunks - meta.num_unique_texts), "chunking": f"{meta.chunk_size}/{meta.chunk_overlap} bytes", "created": meta.created_at, "size": human_bytes(size)}
