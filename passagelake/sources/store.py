"""An index, on a local disk or in any store that Spark writes to: versions of four Parquet tables and a JSON head, committed by renaming one pointer file."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from passagelake.sources import files

FORMAT_VERSION = 1
SCHEMAS = {
    "sources": "source_id long, path string",
    "texts": "text_id long, text string, text_hash string, embedding array<float>, embedding_norm float",
    "occurrences": "occ_ord long, source_id long, text_id long, byte_offset long",
    "file_hashes": "path string, hash string",
}


@dataclass
class Meta:
    model_id: str
    hidden_size: int
    root_dir: str
    chunk_size: int
    chunk_overlap: int
    embedding_backend: str = ""
    num_chunks: int = 0
    num_unique_texts: int = 0
    created_at: str = "unknown"
    format_version: int = 0
    hash_algo: str = "sha2-256"

    def reusable_for(self, model: str, backend: str, size: int, overlap: int) -> bool:
        return (self.format_version, self.model_id, self.embedding_backend, self.chunk_size, self.chunk_overlap) == (FORMAT_VERSION, model, backend, size, overlap)

    @classmethod
    def parse(cls, text: str) -> "Meta":
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in json.loads(text).items() if k in known})


@dataclass
class Index:
    meta: Meta
    sources: DataFrame
    texts: DataFrame
    occurrences: DataFrame
    file_hashes: DataFrame

    def check(self) -> None:
        """Every occurrence's ids exist; else an error."""
        for table, key in ((self.sources, "source_id"), (self.texts, "text_id")):
            bad = self.occurrences.join(table.select(key), key, "left_anti").first()
            if bad:
                raise ValueError(f"invalid {key.split('_')[0]} ID {bad[key]}")


def current(folder: str) -> str:
    pointer = files.joined(folder, "CURRENT")
    if not files.exists(pointer):
        raise FileNotFoundError(f"No index found at {folder}")
    return files.read_text(pointer).strip()


def load_meta(folder: str) -> Meta:
    return Meta.parse(files.read_text(files.joined(folder, current(folder), "meta.json")))


def load(spark: SparkSession, folder: str) -> Index:
    """Pinned to the version that is current now; tables are read when used."""
    version = files.joined(folder, current(folder))
    tables = {name: spark.read.schema(schema).parquet(files.for_spark(files.joined(version, name))) for name, schema in SCHEMAS.items()}
    return Index(Meta.parse(files.read_text(files.joined(version, "meta.json"))), **tables)


def save(folder: str, index: Index) -> str:
    """A new version; readers see it once it is whole."""
    taken = [int(name[2:]) for name in files.names(folder) if name.startswith("v=") and name[2:].isdigit()]
    name = f"v={max(taken, default=0) + 1}"
    version = files.joined(folder, name)
    for table, schema in SCHEMAS.items():
        columns = [c.split()[0] for c in schema.replace(", ", ",").split(",")]
        getattr(index, table).select(*columns).write.option("compression", "zstd").parquet(files.for_spark(files.joined(version, table)))
    files.write_text(files.joined(version, "meta.json"), json.dumps(asdict(index.meta), indent=2))
    files.write_text(files.joined(folder, "CURRENT.tmp"), name)
    files.replace(files.joined(folder, "CURRENT.tmp"), files.joined(folder, "CURRENT"))
    return name
