import hashlib
import json
import pickle
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagelake.functions.vectors import cosine, half_vector, norm, to_half
from passagelake.operators import embed as embed_module
from passagelake.operators.embed import HashingProvider, OnnxProvider, embed, pool_and_normalize
from passagelake.operators.ids import dense_ids
from passagelake.operators.search import batch_top_k, federated_top_k, resolve_hits, top_k
from passagelake.plans import build as build_module
from passagelake.plans import federation
from passagelake.plans.build import build, compact, index_folder
from passagelake.sources import store
from passagelake.sources.scratch import stored

P = HashingProvider(32)


def content(spark, folder):
    i = store.load(spark, folder)
    return Counter((r.path, r.byte_offset, r.text) for r in i.occurrences.join(i.sources, "source_id").join(i.texts, "text_id").collect())


def test_build_refresh_search(spark, tmp_path):
    docs, out, whole = tmp_path / "docs", str(tmp_path / "index"), str(tmp_path / "whole")
    docs.mkdir()
    for n in range(6):
        (docs / f"d{n}.md").write_text(f"shared line about lakes\n\n{'word%d ' % n * 60}")
    (docs / "empty.md").write_text(" ")
    (docs / "bad.md").write_bytes(b"\xff\xff")
    with pytest.warns(UserWarning, match="1 files"):
        r = index_folder(spark, str(docs), out, P, 120, 20)
    assert r.skipped == 1 and r.version == "v=1" and store.load(spark, out).file_hashes.count() == 8 and store.load(spark, out).sources.count() == 6
    assert index_folder(spark, str(docs), out, P, 120, 20).version is None and store.current(out) == "v=1"
    (docs / "d0.md").unlink()
    (docs / "d1.md").write_text("rivers and seas " * 20)
    (docs / "d9.md").write_text((docs / "d2.md").read_text())
    r = index_folder(spark, str(docs), out, P, 120, 20)
    assert (r.version, r.unchanged, r.dirty, r.deleted) == ("v=2", 6, 2, 1)
    index_folder(spark, str(docs), whole, P, 120, 20)
    assert content(spark, out) == content(spark, whole)
    i = store.load(spark, out)
    i.check()
    ids = sorted(x.text_id for x in i.texts.collect())
    assert ids == list(range(len(ids))) and i.meta.num_unique_texts == len(ids) == i.texts.select("text").distinct().count()
    # same texts again: no vector is computed anew
    assert r.new_texts < i.meta.num_unique_texts
    hits = json.loads(federation.as_json(federation.search(spark, [federation.Spec(out)], "rivers seas", P, 3)))
    assert hits[0]["source"] == "d1.md" and "index_name" not in hits[0] and len(hits) == 3
    both = federation.search(spark, [federation.Spec(out, "a"), federation.Spec(whole, "b")], "rivers seas", P, 2).collect()
    assert [x.index_name for x in both] == ["a", "b"] and both[0].score == both[1].score
    assert "1. a: d1.md" in federation.as_text(federation.search(spark, [federation.Spec(out, "a")], "rivers seas", P, 1))
    assert federation.info(spark, federation.Spec(out))["chunks"] == i.meta.num_chunks
    # the same in a store that only Spark's file systems reach
    url = f"file://{tmp_path}/url"
    for version in ("v=1", "v=2"):
        assert store.save(url, i) == version == store.current(url)
    assert content(spark, url) == content(spark, out) and federation.info(spark, federation.Spec(url))["chunks"] == i.meta.num_chunks
    # other settings: built anew
    assert index_folder(spark, str(docs), out, P, 100, 20).unchanged == 0
    for bad, error in ((str(tmp_path / "none"), FileNotFoundError), (str(docs / "d2.md"), NotADirectoryError)):
        with pytest.raises(error):
            index_folder(spark, bad, out, P)
    (tmp_path / "blank").mkdir()
    with pytest.raises(ValueError, match="no indexable"):
        index_folder(spark, str(tmp_path / "blank"), out, P)
    (tmp_path / "blank/a.md").write_text("  ")
    with pytest.raises(ValueError, match="no text"):
        index_folder(spark, str(tmp_path / "blank"), str(tmp_path / "x"), P)
    with pytest.raises(FileNotFoundError, match="No index found"):
        federation.search(spark, [federation.Spec(str(tmp_path / "y"))], "q", P)


def test_validate():
    meta = lambda **k: store.Meta(**({"model_id": "m", "hidden_size": 2, "root_dir": ".", "chunk_size": 1, "chunk_overlap": 0, "embedding_backend": "x", "format_version": store.FORMAT_VERSION} | k))
    assert federation.validate([("a", meta()), ("b", meta())]) == "m"
    for other, error in (({"model_id": "o"}, "different models"), ({"hidden_size": 3}, "different embedding dimensions"), ({"format_version": 0}, "format")):
        with pytest.raises(ValueError, match=error):
            federation.validate([("a", meta()), ("b", meta(**other))])
    with pytest.raises(ValueError):
        federation.validate([("a", meta())], "other")
    with pytest.warns(UserWarning, match="backends"):
        federation.validate([("a", meta()), ("b", meta(embedding_backend="y"))])


def test_compaction(spark):
    sources = spark.createDataFrame([(0, "removed.md"), (1, "kept.md")], "source_id long, path string")
    texts = spark.createDataFrame([(0, "removed"), (1, "kept")], "text_id long, text string")
    occ = lambda *rows: spark.createDataFrame(list(rows), "source_id long, text_id long, byte_offset long")
    s, t, o = compact(sources, texts, occ((1, 1, 42)))
    assert [tuple(r) for r in s.select("source_id", "path").collect()] == [(0, "kept.md")]
    assert [(r.source_id, r.text_id, r.byte_offset) for r in o.collect()] == [(0, 0, 42)]
    assert [(r.text_id, r.text) for r in t.collect()] == [(0, "kept")]
    with pytest.raises(ValueError, match="invalid source ID"):
        compact(sources.limit(0), texts.limit(0), occ((0, 0, 0)))


def test_top_k(spark):
    t = spark.createDataFrame([(0, [0.0, 1.0], 1.0), (1, [1.0, 0.0], 1.0), (2, [0.0, 0.0], 0.0)], "text_id long, embedding array<float>, embedding_norm float")
    assert [r.text_id for r in top_k(t, [1.0, 0.0], 2).collect()] == [1, 0]
    assert top_k(t, [1.0, 0.0], 0).count() == 0 and top_k(t, [1.0, 0.0], 10).count() == 3
    assert [(r.index_order, r.text_id) for r in federated_top_k([t, t], [1.0, 0.0], 3).collect()] == [(0, 1), (1, 1), (0, 0)]


def test_batch_top_k_equals_single(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=5 if i % 4 else 3).tolist(), float(r.random() * (i % 7 > 0))) for i in range(60)] + [(100 + i, [1.0, 0.0, 0.0, 0.0, 0.0], 1.0) for i in range(5)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>, embedding_norm float")
    queries = [(k, r.normal(size=5).tolist()) for k in range(4)] + [(9, [1.0, 0.0, 0.0, 0.0, 0.0])]
    q = spark.createDataFrame(queries, "query_id long, query array<float>")
    for block in (7, 1024):
        got = {}
        for x in batch_top_k(t, q, 6, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append((x.vec_id, x.score))
        assert got == {k: [(x.vec_id, x.score) for x in top_k(t, v, 6, "vec_id").collect()] for k, v in queries}
    assert batch_top_k(t.limit(0), q, 3).count() == 0 == batch_top_k(t, q.limit(0), 3).count()


def test_hits_with_bad_ids_are_errors(spark):
    hits = spark.createDataFrame([(0, 0.5), (1, 0.25)], "text_id long, score float")
    texts = spark.createDataFrame([(0, "a"), (1, "b")], "text_id long, text string")
    sources = spark.createDataFrame([(0, "s.md")], "source_id long, path string")
    occ = lambda *rows: spark.createDataFrame([(n, *x) for n, x in enumerate(rows)], "occ_ord long, source_id long, text_id long, byte_offset long")
    found = resolve_hits(hits, occ((0, 1, 7), (0, 0, 3), (0, 1, 9)), sources, texts).collect()
    assert sorted((r.text_id, r.path, r.byte_offset, r.text) for r in found) == [(0, "s.md", 3, "a"), (1, "s.md", 7, "b")]
    with pytest.raises(ValueError, match="text ID 1 has no occurrence"):
        resolve_hits(hits, occ((0, 0, 3)), sources, texts)
    with pytest.raises(ValueError, match="invalid source ID 4"):
        resolve_hits(hits, occ((0, 0, 3), (4, 1, 0)), sources, texts)


def test_vectors_are_counted(spark):
    class Short(HashingProvider):
        def embed(self, texts):
            return super().embed(texts)[:-1]

    with pytest.raises(Exception, match="the embedding backend returned"):
        embed(spark.createDataFrame([("a b",), ("c",)], "text string"), Short(8)).collect()


def test_half_precision(spark):
    x = np.concatenate([np.random.default_rng(1).normal(size=3000).astype(np.float32) * np.float32(10.0) ** np.arange(-9, 6).repeat(200), np.asarray([0, 65504, 65520, 70000, 6e-8, 2.0**-14, -1.5], np.float32)])
    df = spark.createDataFrame([(x.tolist(),)], "v array<float>")
    got = np.asarray(df.select(half_vector(df.v).alias("h")).first().h, np.float32)
    with np.errstate(over="ignore"):
        assert (got == x.astype(np.float16).astype(np.float32)).all()
    assert to_half is not None


@pytest.mark.parametrize("states, mask, expected", [([3, 4], [1], [0.6, 0.8]), ([3, 4, 1000, 1000], [1, 0], [0.6, 0.8]), ([1, 0, 0, 1], [1, 1], [0.70711, 0.70711]), ([5, 5], [0], [0, 0])])
def test_pooling(states, mask, expected):
    assert np.allclose(pool_and_normalize(states, mask, len(mask), 2), expected, atol=1e-5)


def test_dense_ids_and_missing_models(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id * 7 % 1000 AS k")
    assert sorted((r.k, r.n) for r in dense_ids(rows, ["k"], "n", 5).collect()) == [(i, i + 5) for i in range(1000)]
    assert dense_ids(rows.limit(0), ["k"], "n").count() == 0
    with pytest.raises(FileNotFoundError):
        OnnxProvider(str(tmp_path), "m")


def test_stored_form_equals_the_columns(spark):
    rows = [(i, t) for i, t in enumerate(["", None, "a b a", "İK one Two-2 ſé x", "word " * 70_000, "é " * 5])]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r for r in embed(df, P, stored_form=True).collect()}
    plain = embed(df, P)
    for r in plain.select("id", half_vector(plain.embedding).alias("h")).withColumn("n", norm("h")).collect():
        assert (got[r.id].embedding, got[r.id].embedding_norm) == (r.h, r.n)


def test_words_are_runs_of_ascii_letters():
    texts = ["İstanbul K2 naïve_x\x00y ſ", "A1b2 " * 9, "", "　", "x" * 300 + " x"]
    vectors = P.embed(texts)
    for text, vector in zip(texts, vectors):
        counts = Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % P.dim for w in re.findall("[a-z0-9]+", text.lower()))
        whole = np.array([counts[i] for i in range(P.dim)], float)
        assert (vector == (whole / (np.sqrt((whole * whole).sum()) or 1)).astype(np.float32)).all()


def test_tables_of_words_are_bounded(monkeypatch):
    monkeypatch.setattr(embed_module, "BUCKETS", 50)
    p = HashingProvider(8)
    p.embed([" ".join(f"w{i}" for i in range(1000)), "long" * 100])
    assert len(p._buckets) <= 50 and b"long" * 100 not in p._buckets
    assert not pickle.loads(pickle.dumps(p))._buckets  # tasks get no words that the driver has met


def test_top_k_of_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1.0), (2, None, 1.0), (3, [1.0], None), (4, [None, 1.0], 1.0), (5, [1.0, 0.0, None], 1.0), (6, [nan, 0.0], 1.0), (7, None, 0.0), (8, [], 2.0), (9, [0.5], 2.0)]
    t = spark.createDataFrame(rows, "text_id long, embedding array<float>, embedding_norm float")
    q = F.array(*[F.lit(x).cast("float") for x in (1.0, 0.5)])
    expected = t.select("text_id", cosine(q, t.embedding, t.embedding_norm).alias("score")).orderBy(F.desc("score"), "text_id").collect()
    assert list(map(repr, top_k(t, [1.0, 0.5], 20).collect())) == list(map(repr, expected))


def test_running_sums(spark):
    rows = spark.range(500).selectExpr("id * 7 % 500 AS k", "id % 3 AS n")
    got = sorted((r.k, r.i, r.before, r.n) for r in dense_ids(rows, ["k"], "i", 2, {"before": ("n", 10)}).collect())
    before = 10
    for i, (k, number, sum_before, n) in enumerate(got):
        assert (k, number, sum_before) == (i, i + 2, before)
        before += n
    assert dense_ids(rows.limit(0), ["k"], "i", 0, {"before": ("n", 0)}).columns == ["k", "n", "i", "before"]


def written(spark, run):
    """MB that the call's tasks wrote to tables and to shuffles."""
    seen = lambda: sum(s.outputBytes() + s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size())))
    status = spark.sparkContext._jsc.sc().statusStore()
    everything = lambda: status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    stages = everything()
    before = seen()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = everything()
    return (seen() - before) / 1e6


def test_a_text_is_written_thrice_at_most(spark):
    r = np.random.default_rng(3)
    texts = [r.bytes(45_000).hex() for _ in range(100)]  # does not shrink by much
    rows = [(f"d/{i}.md", ["d", f"{i}.md"], str(i), t) for i, t in enumerate(texts)]
    files = spark.createDataFrame(rows, "path string, path_key array<string>, hash string, text string").localCheckpoint()
    first = []
    # passages, their way to the vectors, the texts: each 1.15 times the 9 MB; hashes and vectors of 512 bytes of text
    assert written(spark, lambda: first.append(build(files, P, "w")[0])) < 40
    changed = files.withColumn("hash", F.when(F.col("path") == "d/1.md", "new").otherwise(F.col("hash")))
    # one file is new: nothing that grows with the other texts is written
    assert written(spark, lambda: build(changed, P, "w", previous=first[0])) < 9


def test_a_refresh_equals_a_build(spark):
    def files(*rows):
        return spark.createDataFrame([(p, p.split("/"), h, t) for p, h, t in rows], "path string, path_key array<string>, hash string, text string")

    rows = lambda i: Counter((r.path, r.byte_offset, r.text) for r in i.occurrences.join(i.sources, "source_id").join(i.texts, "text_id").collect())
    old = files(("a", "1", "one " * 40), ("a-b/c", "2", "two " * 90), ("a/b", "3", None), ("e", "4", "  "), ("gone", "5", "only here"), ("same", "6", "one " * 40))
    new = files(("a", "1", "one " * 40), ("a-b/c", "7", "two " * 90 + "more"), ("a/b", "3", None), ("e", "8", "now text"), ("same", "6", "one " * 40), ("Z", "9", "one " * 40), ("n", "10", None))
    first, r = build(old, P, "r", 100, 10)
    assert (r.skipped, r.new_texts, first.file_hashes.count(), first.sources.count()) == (1, first.meta.num_unique_texts, 6, 4)
    second, r = build(new, P, "r", 100, 10, previous=first)
    assert (r.unchanged, r.dirty, r.deleted, r.skipped) == (3, 4, 1, 1)
    assert rows(second) == rows(build(new, P, "r", 100, 10)[0]) and second.meta.num_chunks == sum(rows(second).values())
    assert sorted(x.source_id for x in second.sources.collect()) == list(range(5))
    assert {x.path: x.source_id for x in second.sources.collect()} == {"a": 0, "a-b/c": 1, "same": 2, "Z": 3, "e": 4}
    # by a join where the changed paths are many, by their hashes else: the same rows
    for many in (0, 100):
        build_module.HASHES, kept = many, build_module.HASHES
        try:
            assert rows(build(new, P, "r", 100, 10, previous=first)[0]) == rows(second)
        finally:
            build_module.HASHES = kept
    # read again, a file has become what it was: it counts as unchanged and keeps its passages
    seen = new.select("path", F.when(F.col("path") == "a", "passing").otherwise(F.col("hash")).alias("hash"))
    third, r = build(new.filter("path IN ('a', 'a-b/c', 'e', 'Z', 'n')"), P, "r", 100, 10, previous=first, seen=seen)
    assert (r.unchanged, r.dirty) == (3, 4) and rows(third) == rows(second)
    assert build(new.filter("path = 'n'"), P, "r")[0].meta.num_chunks == 0


def test_tables_are_compressed_with_zstd(spark, tmp_path):
    table = stored(spark.range(10), "codec")
    assert all(".zstd." in f for f in table.inputFiles())
    files = spark.createDataFrame([("a", ["a"], "1", "one text")], "path string, path_key array<string>, hash string, text string")
    store.save(str(tmp_path / "i"), build(files, P, "r")[0])
    assert all(".zstd." in f for f in store.load(spark, str(tmp_path / "i")).texts.inputFiles())
