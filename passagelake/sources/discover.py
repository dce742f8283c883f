"""Which files of a folder are indexed: as a walk that prunes, and as the same rules over a column of relative paths."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions, file names and pruned folders of the format.
EXTENSIONS = ("txt", "md", "tex", "org", "rst", "csv", "tsv", "log", "toml", "conf", "cfg", "ini", "env", "tf", "hcl", "nix", "xml", "html", "sql", "proto", "graphql", "dockerfile", "makefile", "cmake")
FILENAMES = ("Makefile", "Dockerfile", "Rakefile", "Gemfile", "LICENSE", "README", "CHANGELOG", "CONTRIBUTING", "Justfile", "Taskfile", "Vagrantfile", ".gitignore", ".dockerignore", ".editorconfig")
READ_BYTES = 32 << 20  # bytes of files that a task holds at once (one larger file is held alone)
SKIPPED_DIRS = ("node_modules", "target", "__pycache__", ".git", "vendor", "dist", "build")


def normalize_extension(spec: str) -> str | None:
    return spec.strip().lstrip(".").lower() or None


@dataclass(frozen=True)
class Discovery:
    """Extra extensions, and names or relative paths (with a slash) to leave out or to bring back."""

    extensions: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    include: tuple[str, ...] = ()

    def allowed_extensions(self) -> frozenset[str]:
        return frozenset(EXTENSIONS) | {e for e in map(normalize_extension, self.extensions) if e}


def matches_spec(spec: str, path: str, name: str) -> bool:
    if "/" not in spec:
        return name == spec
    spec = spec.strip("/")
    return path == spec or path.startswith(spec + "/")


def enters(d: Discovery, path: str) -> bool:
    """Whether the walk goes into this folder."""
    name = path.rsplit("/", 1)[-1]
    any_of = lambda specs: any(matches_spec(s, path, name) for s in specs)
    return any_of(d.include) or not (name.startswith(".") or name in SKIPPED_DIRS or any_of(d.exclude))


def accepts(d: Discovery, path: str) -> bool:
    """Whether a file is indexed, its folders apart."""
    name = path.rsplit("/", 1)[-1]
    any_of = lambda specs: any(matches_spec(s, path, name) for s in specs)
    at = name.rfind(".")
    known = name in FILENAMES or (at > 0 and name[at + 1 :].lower() in d.allowed_extensions())
    return known and (any_of(d.include) or not any_of(d.exclude))


def walk(root: str, d: Discovery = Discovery()) -> list[str]:
    """Relative paths in component order. Links are followed, and what several paths lead to is listed under each;
    a link that leads nowhere or back to a folder above it is an error, as is a folder that cannot be read."""
    found: list[str] = []
    waiting = [("", (os.path.realpath(root),))]
    while waiting:
        inside, above = waiting.pop()
        for entry in os.scandir(os.path.join(root, inside)):
            path = inside + entry.name
            if entry.is_symlink() and not os.path.exists(entry.path):
                raise FileNotFoundError(f"broken link: {path}")
            if entry.is_dir():
                real = os.path.realpath(entry.path)
                if entry.is_symlink() and real in above:
                    raise OSError(f"link to a folder above it: {path}")
                if enters(d, path):
                    waiting.append((path + "/", (*above, real)))
            elif entry.is_file() and accepts(d, path):
                found.append(path)
    return sorted(found, key=lambda p: p.split("/"))


def path_key(path: Column) -> Column:
    """Sorts paths by their components."""
    return F.split(path, "/")


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _matches(specs: tuple[str, ...], path: Column, name: Column) -> Column:
    return _any([(path == s.strip("/")) | path.startswith(s.strip("/") + "/") if "/" in s else name == s for s in specs])


def discovered(path: Column, d: Discovery = Discovery()) -> Column:
    """The walk's rules over relative paths: every folder above is entered and the file is accepted."""
    parts = F.split(path, "/")
    depth = F.size(parts)
    name = F.element_at(parts, -1)

    def entered(i: Column) -> Column:
        folder, own = F.array_join(F.slice(parts, F.lit(1), i), "/"), F.get(parts, i - 1)
        return _matches(d.include, folder, own) | ~(own.startswith(".") | own.isin(*SKIPPED_DIRS) | _matches(d.exclude, folder, own))

    above = F.when(depth > 1, F.forall(F.sequence(F.lit(1), F.greatest(depth - 1, F.lit(1))), entered)).otherwise(True)
    extension = F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))
    known = name.isin(*FILENAMES) | ((extension != "") & extension.isin(*sorted(d.allowed_extensions())))
    return above & known & (_matches(d.include, path, name) | ~_matches(d.exclude, path, name))


def read_files(spark: SparkSession, root: str, d: Discovery = Discovery(), only: DataFrame | None = None) -> DataFrame:
    """path, path_key, hash (SHA-256) and text of the discovered files, or of those whose `path` is in `only`; text is null
    where the bytes are no UTF-8.

    A file is read once, in its task, for both hash and text; names that Spark's own listing hides are included."""
    paths = walk(root, d)
    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    if only is not None:
        listed = listed.join(only.select("path"), "path", "left_semi")
    listed = listed.repartition(max(1, min(len(paths) // 64 + 1, 4096)))

    def load(batches):
        import pyarrow as pa

        def rows(part):
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.string()), pa.array([c for _, c in part], pa.binary())], names=["path", "content"])

        for batch in batches:
            part, held = [], 0
            for p in batch.column("path").to_pylist():
                part.append((p, Path(root, p).read_bytes()))
                held += len(part[-1][1])
                if held > READ_BYTES:
                    yield rows(part)
                    part, held = [], 0
            yield rows(part)

    content = listed.mapInArrow(load, "path string, content binary")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return content.select("path", path_key(F.col("path")).alias("path_key"), F.sha2("content", 256).alias("hash"), text.alias("text"))
