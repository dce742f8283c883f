"""The configuration file: global defaults and a list of indexes."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from passagelake.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE

#: Fixed values of the format.
CONFIG_NAMES = ("rag.toml", ".rag.toml")
INDEX_DIR = ".rag"
DEFAULT_MODEL = "sentence-transformers/all-MiniLM-L6-v2"


@dataclass
class IndexEntry:
    name: str
    path: str
    output: str | None = None
    model: str | None = None
    chunk_size: int | None = None
    chunk_overlap: int | None = None
    extensions: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)


@dataclass
class Config:
    folder: Path
    indexes: list[IndexEntry]
    model: str | None = None
    chunk_size: int | None = None
    chunk_overlap: int | None = None

    @staticmethod
    def locate(folder: str | Path = ".") -> Path | None:
        return next((p for n in CONFIG_NAMES if (p := Path(folder) / n).exists()), None)

    @classmethod
    def load(cls, path: str | Path) -> "Config":
        raw = tomllib.loads(Path(path).read_text())
        entries = raw.pop("index", [])
        unknown = set(raw) - {"model", "chunk_size", "chunk_overlap"}
        for e in entries:
            unknown |= set(e) - set(IndexEntry.__dataclass_fields__)
            if "name" not in e or "path" not in e:
                raise ValueError("an index needs a name and a path")
        if unknown:
            raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
        if not entries:
            raise ValueError("the configuration defines no index")
        names = [e["name"] for e in entries]
        if len(set(names)) < len(names):
            raise ValueError("duplicate index names")
        return cls(Path(path).parent, [IndexEntry(**e) for e in entries], **raw)

    def selected(self, only: list[str] | None = None) -> list[IndexEntry]:
        """In the file's order; a name that is not there is an error."""
        if not only:
            return self.indexes
        if missing := set(only) - {e.name for e in self.indexes}:
            raise ValueError(f"unknown index: {', '.join(sorted(missing))}")
        return [e for e in self.indexes if e.name in only]

    def output_of(self, e: IndexEntry) -> Path:
        return self.folder / (e.output or f"{INDEX_DIR}/{e.name}")

    def settings_of(self, e: IndexEntry) -> tuple[str, int, int]:
        pick = lambda *values: next(v for v in values if v is not None)
        return pick(e.model, self.model, DEFAULT_MODEL), pick(e.chunk_size, self.chunk_size, CHUNK_SIZE), pick(e.chunk_overlap, self.chunk_overlap, CHUNK_OVERLAP)

    def models(self, only: list[str] | None = None) -> list[str]:
        return list(dict.fromkeys([self.settings_of(e)[0] for e in self.selected(only)] if only else [*([self.model] if self.model else []), *[self.settings_of(e)[0] for e in self.indexes]]))


def models_to_fetch(override: str | None = None, config: Config | None = None, only: list[str] | None = None) -> list[str]:
    return [override] if override else config.models(only) if config else [DEFAULT_MODEL]


def portable(path: str) -> str:
    """The path without "." components; ".." and absolute paths stay."""
    parts = [p for p in path.split("/") if p not in (".",)]
    return ("/" if path.startswith("/") else "") + "/".join(p for p in parts if p) or "."
