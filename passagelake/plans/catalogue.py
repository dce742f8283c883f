"""Registered queries over whole tables, and for each the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelake.functions.text import human_bytes_column, preview_column
from passagelake.functions.vectors import cosine, dot, half_vector, masked_mean, norm, to_half
from passagelake.operators.chunking import chunk
from passagelake.operators.dedup import counts, representatives, text_hash, unique_texts, unknown_texts
from passagelake.operators.embed import HashingProvider, embed
from passagelake.operators.ids import dense_ids
from passagelake.operators.search import batch_top_k, federated_top_k, resolve_hits, top_k
from passagelake.plans import federation
from passagelake.plans.build import build, compact, diff, with_vectors
from passagelake.sources import store
from passagelake.sources.discover import EXTENSIONS, FILENAMES, SKIPPED_DIRS, Discovery, discovered, path_key
from passagelake.sources.scratch import shared_dir, stored

SIZE, OVERLAP, DIM = 512, 64, 64
QUERY = "the tion and of the rest with an answer"
CUSTOM = Discovery(extensions=(".MDX", "rs"), exclude=("docs/src1", "README"), include=("dist", "node_modules/"))


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path() -> Column:
    """A made-up path for each document, the same in SQL."""
    folder = F.element_at(F.array(*[F.lit(x) for x in FOLDERS]), (F.col("doc_id") % 8 + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(x) for x in NAMES]), (F.col("doc_id") % 9 + 1).cast("int"))
    return F.concat(folder, F.lit("/"), F.col("source"), F.lit("/"), F.when(name.startswith("."), F.concat(F.lit("d"), F.col("doc_id").cast("string"), name)).otherwise(name))


FOLDERS = ("docs", "node_modules", ".hid", "dist", "a", "a-b", "docs/vendor", "src")
NAMES = (".md", ".MDX", ".rs", ".txt", "README", "readme", ".json", "..notes.md", ".html")
PATH_SQL = f"({list(FOLDERS)})[CAST(doc_id % 8 + 1 AS INT)] || '/' || source || '/' || (CASE WHEN ({list(NAMES)})[CAST(doc_id % 9 + 1 AS INT)] LIKE '.%' THEN 'd' || doc_id ELSE '' END) || ({list(NAMES)})[CAST(doc_id % 9 + 1 AS INT)]"


def _discover(d: Discovery):
    def run(spark, sf_dir):
        return _t(spark, sf_dir, "documents").select("doc_id", _path().alias("path")).filter(discovered(F.col("path"), d))

    return run


EXTENSION_SQL = "(" + ",".join(f"'{e}'" for e in EXTENSIONS)
NAMES_SQL = "(" + ",".join(f"'{n}'" for n in FILENAMES) + ")"


def _discover_sql(folder_rule: str, file_rule: str, extra: str = "") -> str:
    return f"""
WITH p AS (SELECT doc_id, {PATH_SQL} AS path FROM documents),
s AS (SELECT doc_id, path, string_split(path, '/') AS parts FROM p),
f AS (SELECT doc_id, path, parts[-1] AS name, list_transform(range(1, len(parts)), lambda i: {{'path': array_to_string(parts[1:i], '/'), 'name': parts[i]}}) AS above FROM s)
SELECT doc_id, path FROM f
WHERE len(list_filter(above, lambda d: NOT ({folder_rule}))) = 0
  AND (name IN {NAMES_SQL} OR (strpos(name[2:], '.') > 0 AND lower(regexp_extract(name, '([^.]*)$', 1)) IN {EXTENSION_SQL}{extra}))) AND ({file_rule})"""


PLAIN_DIR = "d.name LIKE '.%' OR d.name IN (" + ",".join(f"'{n}'" for n in SKIPPED_DIRS) + ")"
DISCOVER = _discover_sql(f"NOT ({PLAIN_DIR})", "true")
DISCOVER_CUSTOM = _discover_sql(
    f"d.name = 'dist' OR d.path = 'node_modules' OR d.path LIKE 'node\\_modules/%' ESCAPE '\\' OR NOT ({PLAIN_DIR} OR d.path = 'docs/src1' OR d.path LIKE 'docs/src1/%' OR d.name = 'README')",
    "path LIKE 'node\\_modules/%' ESCAPE '\\' OR NOT (path LIKE 'docs/src1/%' OR name = 'README')",
    ",'mdx','rs'",
)


def q_path_order(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", _path().alias("path")).withColumn("key", F.concat(path_key(F.col("path")), F.array(F.lpad(F.col("doc_id").cast("string"), 12, "0"))))
    return dense_ids(rows, ["key"], "position").select("doc_id", "path", "position")


PATH_ORDER = f"SELECT doc_id, path, row_number() OVER (ORDER BY list_append(string_split(path, '/'), lpad(CAST(doc_id AS VARCHAR), 12, '0'))) - 1 AS position FROM (SELECT doc_id, {PATH_SQL} AS path FROM documents)"


def q_content_hash(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("n_bytes"))


def _chunks(spark, sf_dir) -> DataFrame:
    return chunk(_t(spark, sf_dir, "documents"), "doc_id", "text", SIZE, OVERLAP)


def q_chunk(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", F.col("chunk_ord").cast("long").alias("chunk_ord"), "byte_offset", "text")


def _joined(spark, sf_dir) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"))


def q_chunk_paragraph(spark, sf_dir):
    return chunk(_joined(spark, sf_dir), "conv_id", "text", SIZE, OVERLAP).select("conv_id", F.col("chunk_ord").cast("long").alias("chunk_ord"), "byte_offset", "text")


WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"


def _chunk_ctes(key: str, source: str, size: int = SIZE, overlap: int = OVERLAP) -> str:
    """CTEs ending in `chunks`(key, chunk_ord, byte_offset, text). Bytes are walked on a shape with one character a byte: 1 leads, 2 continues."""
    forward = lambda at: f"({at} + length(regexp_extract(substr(s, CAST({at} + 1 AS BIGINT), 3), '^' || chr(2) || '*')))"
    return f"""
src AS ({source}),
base AS (SELECT {key}, t, regexp_replace(regexp_replace(regexp_replace(t, '[\\x{{80}}-\\x{{7ff}}]', chr(1)||chr(2), 'g'), '[\\x{{800}}-\\x{{ffff}}]', chr(1)||chr(2)||chr(2), 'g'), '[\\x{{10000}}-\\x{{10ffff}}]', chr(1)||chr(2)||chr(2)||chr(2), 'g') AS s
  FROM (SELECT {key}, trim(coalesce(text, ''), {WS}) AS t FROM src)),
sized AS (SELECT *, length(s) AS n FROM base WHERE length(s) > 0),
walk AS (
  SELECT {key}, CAST(0 AS BIGINT) AS w, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS e, CAST(0 AS BIGINT) AS nxt FROM sized WHERE n > {size}
  UNION ALL
  SELECT {key}, w, b, e, CAST(CASE WHEN e - b <= {overlap} THEN e ELSE {forward('(e - ' + str(overlap) + ')')} END AS BIGINT) FROM (
    SELECT {key}, w, b, s, CAST(CASE
        WHEN e0 = n THEN e0
        WHEN p2 > 0 THEN CASE WHEN length(win) - p2 - 1 > {size // 4} THEN b + length(win) - p2 + 1 ELSE e0 END
        WHEN p1 > 0 THEN CASE WHEN length(win) - p1 > {size // 4} THEN b + length(win) - p1 + 1 ELSE e0 END
        ELSE e0 END AS BIGINT) AS e FROM (
      SELECT *, strpos(reverse(win), chr(10)||chr(10)) AS p2, strpos(reverse(win), chr(10)) AS p1 FROM (
        SELECT *, substr(s, b + 1, e0 - b) AS win FROM (
          SELECT walk.{key}, w + 1 AS w, nxt AS b, s, n, CAST({forward(f'least(nxt + {size}, n)')} AS BIGINT) AS e0 FROM walk JOIN sized USING ({key}) WHERE nxt < n))))
),
windows AS (SELECT {key}, w, b, e FROM walk WHERE w > 0 UNION ALL SELECT {key}, 1, 0, n FROM sized WHERE n <= {size}),
passages AS (SELECT {key}, w, b AS byte_offset, trim(substr(t, 1 + length(replace(substr(s, 1, b), chr(2), '')), length(replace(substr(s, b + 1, e - b), chr(2), ''))), {WS}) AS text FROM windows JOIN sized USING ({key})),
chunks AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY w) - 1 AS chunk_ord, byte_offset, text FROM passages WHERE text <> '')"""


DOCS = "SELECT doc_id, text FROM documents"
CONVERSATIONS = "SELECT conv_id, string_agg(text, chr(10)||chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"


def q_chunk_stats(spark, sf_dir):
    return counts(_chunks(spark, sf_dir)).select(F.col("n_chunks").cast("long").alias("n_chunks"), "n_unique_texts", F.col("n_duplicates").cast("long").alias("n_duplicates"))


def q_dedup_unique(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return unique_texts(docs, ["doc_id"]).select("text_id", F.col("doc_id").alias("first_doc"), "text_hash", "n_occurrences")


def q_dedup_rate(spark, sf_dir):
    return counts(_t(spark, sf_dir, "documents")).select(F.col("n_chunks").cast("long").alias("n_chunks"), "n_unique_texts", F.col("n_duplicates").cast("long").alias("n_duplicates"))


def q_representative(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("text_hash"))
    return representatives(docs, "text_hash", F.col("doc_id"), "doc_id", "source", "lang")


def _vectors(spark, sf_dir) -> DataFrame:
    v = _t(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("raw"))
    return v.withColumn("embedding", half_vector(F.col("raw"))).withColumn("embedding_norm", norm(F.col("embedding")))


HALF = lambda x: f"CAST(CASE WHEN {x} = 0 THEN {x} ELSE round_even(CAST({x} AS DOUBLE) / pow(2.0, greatest(floor(log2(abs(CAST({x} AS DOUBLE)))), -14) - 10), 0) * pow(2.0, greatest(floor(log2(abs(CAST({x} AS DOUBLE)))), -14) - 10) END AS FLOAT)"
FOLD = lambda items: f"list_reduce(list_prepend(CAST(0 AS FLOAT), {items}), lambda a, b: CAST(a + b AS FLOAT))"
DOT = lambda a, b: FOLD(f"list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] * z[2] AS FLOAT))")
NORM = lambda v: f"CAST(sqrt(CAST({FOLD(f'list_transform({v}, lambda x: CAST(x * x AS FLOAT))')} AS DOUBLE)) AS FLOAT)"
VECTORS = f"v0 AS (SELECT vec_id, label, embedding AS raw, list_transform(embedding, lambda x: {HALF('x')}) AS e FROM embeddings), v AS (SELECT *, {NORM('e')} AS n FROM v0)"
SCORE = lambda q, e, n: f"CASE WHEN {n} = 0 THEN CAST(0 AS FLOAT) ELSE CAST(CAST({DOT(q, e)} AS DOUBLE) / CAST({n} AS DOUBLE) AS FLOAT) END"


def q_f16_quantize(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", "i", to_half(F.col("x")).alias("half"), to_half(F.col("x") * F.lit(30000.0).cast("float")).alias("scaled"))


def q_norm(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", "embedding_norm", norm(F.col("raw")).alias("raw_norm"))


def _first_query(v: DataFrame) -> list[float]:
    return list(v.orderBy("vec_id").select("raw").first()[0])


def q_cosine_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return top_k(v, _first_query(v), 10, "vec_id")


def q_cosine_tie(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    twice = v.unionByName(v.withColumn("vec_id", F.col("vec_id") + 1_000_000))
    return top_k(twice, _first_query(v), 7, "vec_id")


def q_dot(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    q = F.array(*[F.lit(x).cast("float") for x in _first_query(v)])
    return v.select("vec_id", dot(q, F.col("embedding")).alias("dot"), cosine(q, F.col("embedding"), F.col("embedding_norm")).alias("cosine"))


def q_batch_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    queries = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("raw").alias("query"))
    return batch_top_k(v.select("vec_id", "embedding", "embedding_norm"), queries, 5)


def q_federated_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumnRenamed("vec_id", "text_id")
    return federated_top_k([v.filter(f"label % 3 = {i}") for i in range(3)], list(v.orderBy("text_id").select("raw").first()[0]), 12)


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "text")
    path = F.concat(F.col("source"), F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".md"))
    first = docs.select(path.alias("path"), "text")
    second = docs.filter("doc_id % 10 <> 0").select(path.alias("path"), F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")).alias("text"))
    copies = docs.filter("doc_id % 10 = 2").select(F.concat(F.lit("copy/"), path).alias("path"), "text")
    return first, second.unionByName(copies)


PATHS = "source || '/d' || doc_id || '.md'"
VERSIONS = f"one AS (SELECT {PATHS} AS path, text FROM documents), two AS (SELECT {PATHS} AS path, CASE WHEN doc_id % 10 = 1 THEN text || ' edited' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT 'copy/' || {PATHS}, text FROM documents WHERE doc_id % 10 = 2)"


def _hashed(df: DataFrame) -> DataFrame:
    return df.select("path", F.sha2("text", 256).alias("hash"))


def q_diff(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return diff(_hashed(new), _hashed(old))


def q_deleted(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return diff(_hashed(new), _hashed(old)).filter("status = 'deleted'").select("path")


def q_incremental_plan(spark, sf_dir):
    return q_diff(spark, sf_dir).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("unchanged", "dirty", "deleted")])


def q_vector_reuse(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    pieces = lambda df: stored(chunk(df, "path", "text", SIZE, OVERLAP).select(text_hash(F.col("text")).alias("text_hash")).distinct(), "pieces")
    now = pieces(new)
    fresh = unknown_texts(now, pieces(old)).withColumn("fresh", F.lit(True))
    return now.join(fresh, "text_hash", "left").select("text_hash", F.col("fresh").isNull().alias("reused"))


def q_compact(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    sources = docs.select(F.col("doc_id").alias("source_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"))
    texts = docs.select(F.col("doc_id").alias("text_id"), F.sha2("text", 256).alias("text_hash"))
    occurrences = docs.filter("doc_id % 3 = 1").select(F.col("doc_id").alias("source_id"), (F.col("doc_id") - F.col("doc_id") % 2).alias("text_id"))
    s, t, o = compact(sources, texts, occurrences)
    return o.join(s, "source_id").join(t, "text_id").select("source_id", "path", "text_id", "text_hash")


def q_info(spark, sf_dir):
    found = _chunks(spark, sf_dir)
    files = _t(spark, sf_dir, "documents").agg(F.count("*").alias("n_files"), F.sum(F.octet_length("text")).alias("n"))
    table = counts(found).crossJoin(found.agg(F.countDistinct("doc_id").alias("n_sources"))).crossJoin(files)  # one row each
    return table.select("n_files", "n_sources", F.col("n_chunks").cast("long").alias("n_chunks"), "n_unique_texts", F.col("n_duplicates").cast("long").alias("n_duplicates"), human_bytes_column(F.col("n")).alias("size"))


def q_preview(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", preview_column(F.col("text")).alias("preview"))


def q_pool(spark, sf_dir):
    states = _t(spark, sf_dir, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("i", "x"))
    whole = F.floor(F.col("x").cast("double") * 64)
    return states.groupBy("label", "i").agg(masked_mean(whole, F.col("vec_id") % 4).alias("mean"))


def q_hash_embed(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return embed(docs, HashingProvider(DIM)).select("doc_id", F.posexplode("embedding").alias("bucket", "x"))


def _indexed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    found = stored(_chunks(spark, sf_dir), "chunks")
    return found, stored(with_vectors(unique_texts(found, ["doc_id", "chunk_ord"]), HashingProvider(DIM)), "texts")


def q_search_topk(spark, sf_dir):
    found, texts = _indexed(spark, sf_dir)
    hits = top_k(texts, HashingProvider(DIM).embed([QUERY])[0].tolist(), 5)
    places = found.select(text_hash(F.col("text")).alias("text_hash"), F.col("doc_id").alias("source_id"), "byte_offset", F.struct("doc_id", "chunk_ord").alias("occ_ord"))
    occurrences = places.join(F.broadcast(texts.select("text_id", "text_hash")), "text_hash")  # resolve_hits filters it to the hits' ids
    sources = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.col("source").alias("path"))
    return resolve_hits(hits, occurrences, sources, texts).select("text_id", "score", F.col("source_id").alias("doc_id"), "byte_offset", "text")


def _files(df: DataFrame) -> DataFrame:
    return df.select("path", path_key(F.col("path")).alias("path_key"), F.sha2("text", 256).alias("hash"), "text")


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: path, path_key, hash, text."""
    return _files(_versions(spark, sf_dir)[0])


def _built(spark, sf_dir, refresh: bool = False):
    """The engine's index of the first version, or of the second one refreshed from it, and what the build reports."""
    old, new = _versions(spark, sf_dir)
    first = build(_files(old), HashingProvider(DIM), "corpus", SIZE, OVERLAP)
    return build(_files(new), HashingProvider(DIM), "corpus", SIZE, OVERLAP, first[0]) if refresh else first


def q_build(spark, sf_dir):
    index, _ = _built(spark, sf_dir)
    return index.occurrences.join(index.sources, "source_id").join(index.texts.select("text_id", "text_hash"), "text_id").select("occ_ord", "source_id", "path", "text_id", "byte_offset", "text_hash")


def q_refresh(spark, sf_dir):
    index, _ = _built(spark, sf_dir, True)
    return index.occurrences.join(index.sources, "source_id").join(index.texts.select("text_id", "text_hash"), "text_id").select("path", "byte_offset", "text_hash")


def q_refresh_texts(spark, sf_dir):
    index, _ = _built(spark, sf_dir, True)
    return index.texts.select("text_id", "text_hash", "embedding_norm")


def q_refresh_sources(spark, sf_dir):
    return _built(spark, sf_dir, True)[0].sources.select("source_id", "path")


def q_refresh_report(spark, sf_dir):
    index, r = _built(spark, sf_dir, True)
    return spark.createDataFrame([(r.unchanged, r.dirty, r.deleted, r.new_texts, index.meta.num_chunks, index.meta.num_unique_texts, index.file_hashes.count())], "n_unchanged long, n_dirty long, n_deleted long, n_new_texts long, n_chunks long, n_unique_texts long, n_files long")


def _saved(spark, df: DataFrame, name: str) -> federation.Spec:
    folder = shared_dir(spark, name)
    store.save(folder, build(_files(df), HashingProvider(DIM), name, SIZE, OVERLAP)[0])
    return federation.Spec(folder, name)


def q_stored_search(spark, sf_dir):
    specs = [_saved(spark, df, name) for df, name in zip(_versions(spark, sf_dir), ("old", "new"))]
    hits = federation.search(spark, specs, QUERY, HashingProvider(DIM), 12)
    return hits.select("index_name", "root_dir", "source", "score", "byte_offset", "text")


def q_stored_info(spark, sf_dir):
    i = federation.info(spark, _saved(spark, _versions(spark, sf_dir)[0], "old"))
    return spark.createDataFrame([tuple(i[k] for k in ("model", "files", "sources", "chunks", "unique texts", "duplicates"))], "model string, n_files long, n_sources long, n_chunks long, n_unique_texts long, n_duplicates long")


def q_passage_match(spark, sf_dir):
    _, texts = _indexed(spark, sf_dir)
    texts = texts.select("text_id", "embedding", "embedding_norm")
    items = embed(_t(spark, sf_dir, "benchmark").select("item_id", "text"), HashingProvider(DIM)).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("query"))
    return batch_top_k(texts, items, 3, "text_id")


BUCKETS = lambda t: f"list_transform(regexp_extract_all(lower({t}), '[a-z0-9]+'), lambda w: CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % {DIM})"


def _embed_sql(key: str, source: str, name: str) -> str:
    """CTE `name`(key, e): unit vectors of counts, zero without words."""
    return f"""{name}_b AS (SELECT {key}, {BUCKETS('text')} AS b FROM ({source})),
{name}_c AS (SELECT {key}, list_transform(range({DIM}), lambda i: CAST(len(list_filter(b, lambda x: x = i)) AS DOUBLE)) AS c FROM {name}_b),
{name}_n AS (SELECT {key}, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n FROM {name}_c),
{name} AS (SELECT {key}, list_transform(c, lambda x: CAST(CASE WHEN n = 0 THEN 0 ELSE x / n END AS FLOAT)) AS e FROM {name}_n)"""


TEXTS = f"""{_chunk_ctes('doc_id', DOCS)},
firsts AS (SELECT text, min((doc_id, chunk_ord)) AS f FROM chunks GROUP BY text),
texts AS (SELECT row_number() OVER (ORDER BY f) - 1 AS text_id, text FROM firsts),
{_embed_sql('text_id', 'SELECT text_id, text FROM texts', 'raw')},
h AS (SELECT text_id, list_transform(e, lambda x: {HALF('x')}) AS e FROM raw),
vec AS (SELECT text_id, e, {NORM('e')} AS n FROM h)"""


def queries() -> dict:
    return {
        "q_discover_default": _discover(Discovery()),
        "q_discover_custom": _discover(CUSTOM),
        "q_path_order": q_path_order,
        "q_content_hash": q_content_hash,
        "q_chunk": q_chunk,
        "q_chunk_paragraph": q_chunk_paragraph,
        "q_chunk_stats": q_chunk_stats,
        "q_dedup_unique": q_dedup_unique,
        "q_dedup_rate": q_dedup_rate,
        "q_representative": q_representative,
        "q_f16_quantize": q_f16_quantize,
        "q_norm": q_norm,
        "q_dot": q_dot,
        "q_cosine_topk": q_cosine_topk,
        "q_cosine_tie": q_cosine_tie,
        "q_batch_topk": q_batch_topk,
        "q_federated_topk": q_federated_topk,
        "q_diff": q_diff,
        "q_deleted": q_deleted,
        "q_incremental_plan": q_incremental_plan,
        "q_vector_reuse": q_vector_reuse,
        "q_compact": q_compact,
        "q_info": q_info,
        "q_preview": q_preview,
        "q_pool": q_pool,
        "q_hash_embed": q_hash_embed,
        "q_search_topk": q_search_topk,
        "q_passage_match": q_passage_match,
        "q_build": q_build,
        "q_refresh": q_refresh,
        "q_refresh_texts": q_refresh_texts,
        "q_refresh_sources": q_refresh_sources,
        "q_refresh_report": q_refresh_report,
        "q_stored_search": q_stored_search,
        "q_stored_info": q_stored_info,
    }


def oracle_sql() -> dict:
    dedup = lambda source: f"SELECT count(*) AS n_chunks, count(DISTINCT text) AS n_unique_texts, greatest(count(*) - count(DISTINCT text), 0) AS n_duplicates FROM {source}"
    human = "CASE WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0) ELSE n || ' B' END"
    pieces = lambda table, name: _chunk_ctes("path", f"SELECT path, text FROM {table}").replace("src AS", f"{name}_src AS").replace("FROM src", f"FROM {name}_src")

    def renamed(ctes: str, name: str) -> str:
        import re

        return re.sub(r"\b(base|sized|walk|windows|passages|chunks)\b", rf"{name}_\1", ctes)

    hashes = f"{VERSIONS}, h1 AS (SELECT path, sha256(text) AS h FROM one), h2 AS (SELECT path, sha256(text) AS h FROM two), d AS (SELECT coalesce(h1.path, h2.path) AS path, CASE WHEN h2.h IS NULL THEN 'deleted' WHEN h1.h = h2.h THEN 'unchanged' ELSE 'dirty' END AS status FROM h1 FULL JOIN h2 USING (path))"
    two_versions = f"{VERSIONS}, {renamed(pieces('one', 'a'), 'a')}, {renamed(pieces('two', 'b'), 'b')}"
    # texts of a version by first occurrence along the path's components and the chunk's number
    firsts = lambda v: f"{v}_first AS (SELECT text, min((string_split(path, '/'), chunk_ord)) AS f FROM {v}_chunks GROUP BY text), {v}_texts AS (SELECT text, f, row_number() OVER (ORDER BY f) - 1 AS id FROM {v}_first)"
    # after a refresh: what was known keeps its order, what is new follows
    refreshed = f"{two_versions}, {firsts('a')}, {firsts('b')}, r AS (SELECT b.text, row_number() OVER (ORDER BY a.id NULLS LAST, b.f) - 1 AS text_id FROM b_texts b LEFT JOIN a_texts a USING (text))"
    query = _embed_sql("q", f"SELECT 1 AS q, '{QUERY}' AS text", "qe")
    return {
        "q_discover_default": DISCOVER,
        "q_discover_custom": DISCOVER_CUSTOM,
        "q_path_order": PATH_ORDER,
        "q_content_hash": "SELECT doc_id, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents",
        "q_chunk": f"WITH RECURSIVE {_chunk_ctes('doc_id', DOCS)} SELECT doc_id, chunk_ord, byte_offset, text FROM chunks",
        "q_chunk_paragraph": f"WITH RECURSIVE {_chunk_ctes('conv_id', CONVERSATIONS)} SELECT conv_id, chunk_ord, byte_offset, text FROM chunks",
        "q_chunk_stats": f"WITH RECURSIVE {_chunk_ctes('doc_id', DOCS)} {dedup('chunks')}",
        "q_dedup_unique": "SELECT row_number() OVER (ORDER BY f) - 1 AS text_id, f AS first_doc, sha256(text) AS text_hash, n AS n_occurrences FROM (SELECT text, min(doc_id) AS f, count(*) AS n FROM documents GROUP BY text)",
        "q_dedup_rate": dedup("documents"),
        "q_representative": "SELECT sha256(text) AS text_hash, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text",
        "q_f16_quantize": f"SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, {HALF('x')} AS half, {HALF('y')} AS scaled FROM (SELECT *, CAST(x * CAST(30000 AS FLOAT) AS FLOAT) AS y FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))",
        "q_norm": f"WITH {VECTORS} SELECT vec_id, n AS embedding_norm, {NORM('raw')} AS raw_norm FROM v",
        "q_dot": f"WITH {VECTORS}, q AS (SELECT raw AS q FROM v ORDER BY vec_id LIMIT 1) SELECT vec_id, {DOT('q.q', 'e')} AS dot, {SCORE('q.q', 'e', 'n')} AS cosine FROM v, q",
        "q_cosine_topk": f"WITH {VECTORS}, q AS (SELECT raw AS q FROM v ORDER BY vec_id LIMIT 1) SELECT vec_id, {SCORE('q.q', 'e', 'n')} AS score FROM v, q ORDER BY score DESC, vec_id LIMIT 10",
        "q_cosine_tie": f"WITH {VECTORS}, q AS (SELECT raw AS q FROM v ORDER BY vec_id LIMIT 1), u AS (SELECT vec_id, e, n FROM v UNION ALL SELECT vec_id + 1000000, e, n FROM v) SELECT vec_id, {SCORE('q.q', 'e', 'n')} AS score FROM u, q ORDER BY score DESC, vec_id LIMIT 7",
        "q_batch_topk": f"WITH {VECTORS}, s AS (SELECT q.vec_id AS query_id, v.vec_id, {SCORE('q.raw', 'v.e', 'v.n')} AS score FROM v, v q WHERE q.vec_id % 50 = 0) SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5",
        "q_federated_topk": f"WITH {VECTORS}, q AS (SELECT raw AS q FROM v ORDER BY vec_id LIMIT 1) SELECT vec_id AS text_id, {SCORE('q.q', 'e', 'n')} AS score, CAST(label % 3 AS INTEGER) AS index_order FROM v, q ORDER BY score DESC, index_order, vec_id LIMIT 12",
        "q_diff": f"WITH {hashes} SELECT path, status FROM d",
        "q_deleted": f"WITH {VERSIONS} SELECT path FROM one WHERE path NOT IN (SELECT path FROM two)",
        "q_incremental_plan": f"WITH {hashes} SELECT count(*) FILTER (status = 'unchanged') AS n_unchanged, count(*) FILTER (status = 'dirty') AS n_dirty, count(*) FILTER (status = 'deleted') AS n_deleted FROM d",
        "q_vector_reuse": f"WITH RECURSIVE {VERSIONS}, {renamed(pieces('one', 'a'), 'a')}, {renamed(pieces('two', 'b'), 'b')} SELECT sha256(text) AS text_hash, text IN (SELECT text FROM a_chunks) AS reused FROM (SELECT DISTINCT text FROM b_chunks)",
        "q_compact": "WITH o AS (SELECT doc_id AS s, doc_id - doc_id % 2 AS t FROM documents WHERE doc_id % 3 = 1), si AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS source_id FROM (SELECT DISTINCT s FROM o)), ti AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS text_id FROM (SELECT DISTINCT t FROM o)) SELECT source_id, 'd' || s AS path, text_id, sha256(text) AS text_hash FROM o JOIN si USING (s) JOIN ti USING (t) JOIN documents ON doc_id = t",
        "q_info": f"WITH RECURSIVE {_chunk_ctes('doc_id', DOCS)}, c AS ({dedup('chunks')}), f AS (SELECT count(*) AS n_files, CAST(sum(strlen(text)) AS BIGINT) AS n FROM documents) SELECT n_files, (SELECT count(DISTINCT doc_id) FROM chunks) AS n_sources, n_chunks, n_unique_texts, n_duplicates, {human} AS size FROM c, f",
        "q_preview": r"SELECT doc_id, CASE WHEN strlen(text) <= 200 THEN text ELSE substr(text, 1, n) || '...' END AS preview FROM (SELECT doc_id, text, len(list_filter(range(1, 201), lambda k: strlen(substr(text, 1, CAST(k - 1 AS BIGINT))) < 200)) AS n FROM documents)",
        "q_pool": "SELECT label, CAST(i - 1 AS INTEGER) AS i, coalesce(avg(CASE WHEN vec_id % 4 <> 0 THEN floor(CAST(x AS DOUBLE) * 64) END), 0.0) AS mean FROM (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i",
        "q_hash_embed": f"WITH {_embed_sql('doc_id', DOCS, 'd')} SELECT doc_id, CAST(i - 1 AS INTEGER) AS bucket, x FROM (SELECT doc_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM d)",
        "q_search_topk": f"WITH RECURSIVE {TEXTS}, {query}, s AS (SELECT text_id, {SCORE('qe.e', 'vec.e', 'vec.n')} AS score FROM vec, qe), k AS (SELECT * FROM s ORDER BY score DESC, text_id LIMIT 5) SELECT text_id, score, c.doc_id, c.byte_offset, text FROM k JOIN texts USING (text_id) JOIN firsts USING (text) JOIN chunks c USING (text) WHERE (c.doc_id, c.chunk_ord) = f",
        "q_build": f"WITH RECURSIVE {two_versions}, {firsts('a')}, s AS (SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS source_id FROM (SELECT DISTINCT path FROM a_chunks)) SELECT row_number() OVER (ORDER BY string_split(path, '/'), chunk_ord) - 1 AS occ_ord, source_id, path, id AS text_id, byte_offset, sha256(text) AS text_hash FROM a_chunks JOIN s USING (path) JOIN a_texts USING (text)",
        "q_refresh": f"WITH RECURSIVE {two_versions} SELECT path, byte_offset, sha256(text) AS text_hash FROM b_chunks",
        "q_refresh_texts": f"WITH RECURSIVE {refreshed}, {_embed_sql('text_id', 'SELECT text_id, text FROM r', 'raw')}, h AS (SELECT text_id, list_transform(e, lambda x: {HALF('x')}) AS e FROM raw) SELECT text_id, sha256(text) AS text_hash, {NORM('e')} AS embedding_norm FROM h JOIN r USING (text_id)",
        "q_refresh_sources": f"WITH RECURSIVE {two_versions} SELECT row_number() OVER (ORDER BY path NOT IN (SELECT path FROM a_chunks), string_split(path, '/')) - 1 AS source_id, path FROM (SELECT DISTINCT path FROM b_chunks)",
        "q_refresh_report": f"WITH RECURSIVE {two_versions}, d AS (SELECT one.text AS o, two.text AS n FROM one FULL JOIN two USING (path)) SELECT count(*) FILTER (o = n) AS n_unchanged, count(*) FILTER (n IS NOT NULL AND (o IS NULL OR o <> n)) AS n_dirty, count(*) FILTER (n IS NULL) AS n_deleted, (SELECT count(DISTINCT text) FROM b_chunks WHERE text NOT IN (SELECT text FROM a_chunks)) AS n_new_texts, (SELECT count(*) FROM b_chunks) AS n_chunks, (SELECT count(DISTINCT text) FROM b_chunks) AS n_unique_texts, (SELECT count(*) FROM two) AS n_files FROM d",
        "q_stored_search": f"WITH RECURSIVE {two_versions}, {firsts('a')}, {firsts('b')}, u AS (SELECT 0 AS i, 'old' AS index_name, id, text, f FROM a_texts UNION ALL SELECT 1, 'new', id, text, f FROM b_texts), {_embed_sql('text', 'SELECT DISTINCT text FROM u', 'raw')}, h AS (SELECT text, list_transform(e, lambda x: {HALF('x')}) AS e FROM raw), vec AS (SELECT text, e, {NORM('e')} AS n FROM h), {query}, s AS (SELECT text, {SCORE('qe.e', 'vec.e', 'vec.n')} AS score FROM vec, qe), k AS (SELECT u.*, score FROM u JOIN s USING (text) ORDER BY score DESC, i, id LIMIT 12), p AS (SELECT 0 AS i, * FROM a_chunks UNION ALL SELECT 1, * FROM b_chunks) SELECT k.index_name, k.index_name AS root_dir, p.path AS source, score, byte_offset, k.text FROM k JOIN p ON p.i = k.i AND p.text = k.text AND (string_split(p.path, '/'), p.chunk_ord) = k.f",
        "q_stored_info": f"WITH RECURSIVE {two_versions}, c AS ({dedup('a_chunks')}) SELECT 'hashing-{DIM}' AS model, (SELECT count(*) FROM one) AS n_files, (SELECT count(DISTINCT path) FROM a_chunks) AS n_sources, n_chunks, n_unique_texts, n_duplicates FROM c",
        "q_passage_match": f"WITH RECURSIVE {TEXTS}, {_embed_sql('item_id', 'SELECT item_id, text FROM benchmark', 'qe')}, s AS (SELECT item_id AS query_id, text_id, {SCORE('qe.e', 'vec.e', 'vec.n')} AS score FROM vec, qe) SELECT query_id, text_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, text_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 3",
    }
