"""Building an index, whole or from the one before it."""

from __future__ import annotations

import time
import warnings
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelake.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, chunk_files
from passagelake.operators.embed import Provider, embed
from passagelake.operators.ids import dense_ids
from passagelake.sources import store
from passagelake.sources.config import Config, portable
from passagelake.sources.discover import Discovery, read_files, walk
from passagelake.sources.scratch import stored

HASHES = 1_000_000  # so many paths of changed files are sent to all tasks, as hashes; more are joined


@dataclass
class Report:
    """What a build did; version is None where nothing had changed."""

    version: str | None
    unchanged: int = 0
    dirty: int = 0
    deleted: int = 0
    new_texts: int = 0
    skipped: int = 0


def with_vectors(texts: DataFrame, provider: Provider) -> DataFrame:
    return embed(texts, provider, stored_form=True)


def diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """path and status (unchanged, dirty, deleted) of two (path, hash) tables."""
    both = current.select("path", F.col("hash").alias("new")).join(previous.select("path", F.col("hash").alias("old")), "path", "full_outer")
    return both.select("path", F.when(F.col("new").isNull(), "deleted").when(F.col("new").eqNullSafe(F.col("old")), "unchanged").otherwise("dirty").alias("status"))


def of_paths(files: DataFrame, paths: DataFrame) -> DataFrame:
    """The files with one of these paths, and perhaps some more whose path has the same hash. Texts are not shuffled unless the paths are very many."""
    if paths.count() > HASHES:
        return files.join(paths, "path", "left_semi")
    hashes = paths.select(F.xxhash64("path").alias("h"))
    return files.join(F.broadcast(hashes), F.xxhash64(files["path"]) == hashes["h"], "left_semi")


def compact(sources: DataFrame, texts: DataFrame, occurrences: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without what no occurrence names; ids are dense again, in the old order. Ids that do not exist are an error."""
    def remap(table: DataFrame, key: str) -> DataFrame:
        ids = dense_ids(occurrences.select(key).distinct(), [key], "new_id")
        if bad := ids.join(table.select(key), key, "left_anti").first():
            raise ValueError(f"invalid {key.split('_')[0]} ID {bad[key]}")
        return ids

    s, t = remap(sources, "source_id"), remap(texts, "text_id")
    renumber = lambda table, ids, key: table.join(ids, key).drop(key).withColumnRenamed("new_id", key)
    moved = renumber(renumber(occurrences, s, "source_id"), t, "text_id")
    return renumber(sources, s, "source_id"), renumber(texts, t, "text_id"), moved


def build(files: DataFrame, provider: Provider, root_dir: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, previous: store.Index | None = None, seen: DataFrame | None = None) -> tuple[store.Index, Report]:
    """files: path, path_key, hash, text. With a reusable previous index only changed files are chunked and only new texts embedded.

    seen (path, hash) are all files where `files` holds only the changed ones; a file in both has the hash of `files`, which goes with its text.

    Passages are written once with their texts. They get their places from their files' counts, meet by hashes, and a text is
    shuffled once, on its way to its vector."""
    if previous is not None and seen is None:
        # first the hashes of all files, then the texts of the changed ones
        seen = stored(files.select("path", "hash"), "seen")
        changed = stored(diff(seen, previous.file_hashes).filter("status = 'dirty'").select("path"), "changed")
        files = of_paths(files, changed)
    rows = stored(chunk_files(files, size, overlap), "chunks")
    heads, pieces = rows.filter("chunk_ord IS NULL"), rows.filter("chunk_ord IS NOT NULL")
    hashes = heads.select("path", "hash")
    heads = heads.select("file", "path", "path_key", "n_chunks")
    report = Report(None)
    last = lambda df, key: (-1 if (top := df.agg(F.max(key)).first()[0]) is None else top)
    occ_base = text_base = source_base = n_kept = 0
    if seen is not None:
        hashes = seen.select("path", "hash").join(hashes, "path", "left_anti").unionByName(hashes)
    hashes = stored(hashes, "hashes")
    if previous is not None:
        status = stored(diff(hashes, previous.file_hashes), "diff")
        n = {r["status"]: r["n"] for r in status.groupBy("status").agg(F.count("*").alias("n")).collect()}
        report = Report(None, n.get("unchanged", 0), n.get("dirty", 0), n.get("deleted", 0))
        previous.check()
        same = previous.sources.join(status.filter("status = 'unchanged'"), "path", "left_semi").select("source_id")
        kept = previous.occurrences.join(same, "source_id", "left_semi").select("occ_ord", "source_id", "text_id", "byte_offset")
        heads = stored(heads.join(status.filter("status = 'dirty'"), "path", "left_semi"), "heads")
        occ_base, text_base, source_base = (last(table, key) + 1 for table, key in ((previous.occurrences, "occ_ord"), (previous.texts, "text_id"), (previous.sources, "source_id")))
    report.skipped = heads.filter(F.col("n_chunks").isNull()).count()
    # a passage's place is its file's, which follows from the counts of the files before, and its number
    files = dense_ids(heads.filter("n_chunks > 0"), ["path_key"], "source_id", 0, {"base": ("n_chunks", occ_base)})
    sources = files.select("source_id", "path")
    if previous is not None:
        files = files.drop("source_id").join(previous.sources.select("path", "source_id"), "path", "left")
        unknown = dense_ids(files.filter(F.col("source_id").isNull()).drop("source_id"), ["path_key"], "source_id", source_base)
        files = stored(files.filter(F.col("source_id").isNotNull()).unionByName(unknown), "files")
        sources = previous.sources.unionByName(unknown.select("source_id", "path"))
    places = files.select("file", "source_id", "base").hint("shuffle_hash")
    placed = stored(pieces.select("file", "chunk_ord", "byte_offset", "text_hash").join(places, "file").select("file", "chunk_ord", (F.col("base") + F.col("chunk_ord")).alias("occ_ord"), "source_id", "byte_offset", "text_hash"), "placed")
    firsts = placed.groupBy("text_hash").agg(F.min(F.struct("occ_ord", "file", "chunk_ord")).alias("f")).select("text_hash", "f.*")
    if previous is not None:
        firsts = stored(firsts.join(previous.texts.select(F.unhex("text_hash").alias("text_hash"), "text_id"), "text_hash", "left"), "firsts")
    fresh = firsts if previous is None else firsts.filter(F.col("text_id").isNull()).drop("text_id")
    fresh = dense_ids(fresh, ["occ_ord"], "text_id", text_base)
    ids = fresh.select("text_hash", "text_id")
    if previous is not None:
        ids = ids.unionByName(firsts.filter(F.col("text_id").isNotNull()).select("text_hash", "text_id"))
    numbers = fresh.select("file", "chunk_ord", "text_id").hint("shuffle_hash")
    named = pieces.select("file", "chunk_ord", "text", "text_hash").join(numbers, ["file", "chunk_ord"]).select("text_id", "text", F.lower(F.hex("text_hash")).alias("text_hash"))
    texts = stored(with_vectors(named, provider), "texts")
    report.new_texts = texts.count()
    if report.new_texts != fresh.count():
        raise ValueError("texts were lost")
    occurrences = placed.join(ids, "text_hash").select("occ_ord", "source_id", "text_id", "byte_offset")
    if previous is not None:
        texts = previous.texts.unionByName(texts.select(*previous.texts.columns))
        occurrences = stored(kept.unionByName(occurrences), "occurrences")
        n_kept = kept.count()
        sources, texts, occurrences = compact(sources, texts, occurrences)
    occurrences = stored(occurrences, "occurrences")
    texts = texts.select("text_id", "text", "text_hash", "embedding", "embedding_norm")
    meta = store.Meta(provider.model_id, provider.dim, root_dir, size, overlap, provider.backend_id, occurrences.count(), texts.count(), time.strftime("%Y-%m-%dT%H:%M:%S%z"), store.FORMAT_VERSION)
    # the joins above find each id or drop the row, so with none dropped all ids exist
    if meta.num_chunks != n_kept + (heads.agg(F.sum("n_chunks")).first()[0] or 0):
        raise ValueError("occurrences were lost")
    return store.Index(meta, sources.select("source_id", "path"), texts, occurrences, hashes), report


def index_folder(spark: SparkSession, root: str, folder: str, provider: Provider, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, discovery: Discovery = Discovery(), metadata_root: str | None = None) -> Report:
    """Builds or refreshes the index in `folder`; without changes nothing is written. Files that are no UTF-8 are counted, warned of and left out."""
    if not Path(root).exists():
        raise FileNotFoundError(f"path does not exist: {root}")
    if not Path(root).is_dir():
        raise NotADirectoryError(f"not a directory: {root}")
    root_dir = portable(metadata_root) if metadata_root is not None else str(Path(root).resolve())
    previous = None
    try:
        meta = store.load_meta(folder)
        if meta.reusable_for(provider.model_id, provider.backend_id, size, overlap) and meta.root_dir == root_dir:
            previous = store.load(spark, folder)
    except FileNotFoundError:
        pass
    files, seen = read_files(spark, root, discovery), None
    if previous is not None:
        # first the hashes of all files, then the texts of the changed ones
        seen = stored(files.select("path", "hash"), "seen")
        changed = stored(diff(seen, previous.file_hashes).filter("status <> 'unchanged'"), "changed")
        if changed.isEmpty():
            return Report(None, previous.file_hashes.count())
        if seen.isEmpty():
            raise ValueError(f"no indexable files in {root}")
        files = read_files(spark, root, discovery, changed.filter("status = 'dirty'"))
    elif not walk(root, discovery):
        raise ValueError(f"no indexable files in {root}")
    index, report = build(files, provider, root_dir, size, overlap, previous, seen)
    if report.skipped:
        warnings.warn(f"{report.skipped} files in {root} are no UTF-8 and were left out", stacklevel=2)
    if not index.meta.num_chunks:
        raise ValueError("no text to index")
    report.version = store.save(folder, index)
    return report


def index_from_config(spark: SparkSession, config: Config, provider_of, only: list[str] | None = None) -> dict[str, Report]:
    """Each entry in the file's order; the first failure stops, entries before it stay saved."""
    out = {}
    for e in config.selected(only):
        model, size, overlap = config.settings_of(e)
        try:
            out[e.name] = index_folder(spark, str(config.folder / e.path), str(config.output_of(e)), provider_of(model), size, overlap, Discovery(tuple(e.extensions), tuple(e.exclude), tuple(e.include)), e.path)
        except Exception as error:
            raise RuntimeError(f"index {e.name}: {error}") from error
    return out
