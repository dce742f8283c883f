import collections
import hashlib
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passagelake.llm import chunk_reuse, common, packing, repair_store, token_counts
from passagelake.llm.common import tokenizer_path
from passagelake.llm.pieces import encoder, library

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
ODD = ["", " ", "  a  b", "a b ", " lead", "x<|endoftext|> y", "a\n b", "don't 's stop", "é ́x", "İstanbul ǅ ΣΑΣ", "a b  c", "\n\nfoo bar\n", "the " * 3000 + "end", "日本 語 текст", "x" * 5000]
ROWS = [(i, t) for i, t in enumerate(ODD)] + [(3, "a b "), (None, "null id"), (99, None), (98, "shared passage of words " * 300), (97, "other start " + "shared passage of words " * 300)]


def docs(spark, rows=ROWS):
    # an extra column whose name the operators use themselves
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_tokens string")


def ids_of(path, text):
    return library(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab'sé \n\t ́Σİ0<|>endoftx.日", max_size=30), min_size=1, max_size=4))
def test_pieces_equal_the_library(path, texts):
    assert [x.tolist() for x in encoder(path).encode(pa.array(texts, pa.string()))] == [ids_of(path, t) for t in texts]


def test_counts(spark):
    for chunk, overlap in ((1 << 15, 512), (400, 4)):
        out = token_counts.token_counts(docs(spark), BYTE, chunk=chunk, overlap=overlap).collect()
        expected = [(i, len((t or "").encode()), len(ids_of(BYTE, t)), len(ids_of(BYTE, t)) > 1024) for i, t in ROWS]
        assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, expected))
    assert token_counts.token_counts(docs(spark, []), BYTE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text("ab \n'", max_size=300), st.integers(5, 40), st.integers(1, 8))
def test_splicing(text, chunk, overlap):
    assert token_counts.spliced_count(text, lambda t: library(BYTE).encode(t, add_special_tokens=False).offsets, chunk, overlap)[0] == len(ids_of(BYTE, text))


def test_chunk_reuse(spark):
    out = chunk_reuse.encode(docs(spark), WORD).collect()
    expected = [(i, len(ids_of(WORD, t)), ids_of(WORD, t), library(WORD).decode(ids_of(WORD, t), skip_special_tokens=False)) for i, t in ROWS]
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, expected))
    digest = {r.doc_id: r.ids_sha256 for r in chunk_reuse.encode(docs(spark), WORD, digests=True).collect()}
    assert digest[97] == hashlib.sha256(np.asarray(ids_of(WORD, ROWS[-1][1]), "<u4").tobytes()).hexdigest()
    assert chunk_reuse.encode(docs(spark, []), WORD).count() == 0


def test_shared_chunks_are_encoded_once():
    e = chunk_reuse.ChunkEncoder(WORD)
    text = " ".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(2000))
    e.encode(pa.array([text]))
    first = e.coded
    e.encode(pa.array(["a new start " + text, text + " end"]))
    assert first > 10 and e.coded - first <= 6


def test_store(spark, tmp_path):
    out = f"file://{tmp_path}/ids"
    repair_store.write_ids(docs(spark), BYTE, out, shard_ids=2000)
    shards = repair_store.read_ids(spark, out)
    assert shards.count() > 2
    got = sorted(map(tuple, repair_store.documents_of(shards).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i or 0))
    start, texts = 0, collections.defaultdict(list)
    for i, t in ROWS:
        texts[i].append(ids_of(BYTE, t) + [0])
    for doc, at, n, crc in got:
        assert at == start and any(n == len(x) and crc == zlib.crc32(np.asarray(x, "<u4").tobytes()) for x in texts[doc])
        start += n
    repair_store.write_ids(docs(spark, []), BYTE, out + "-none")
    assert repair_store.documents_of(repair_store.read_ids(spark, out + "-none")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=400), st.integers(0, 420), st.integers(0, 50))
def test_random_access(ids, start, count):
    flat = np.asarray(ids * 9, np.uint32)
    shard = repair_store.Shard(repair_store.pack_shard(flat, 6))
    assert (shard.ids() == flat).all() and (shard.ids_at(start, count) == flat[start : start + count]).all()


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=8), st.integers(1, 120))
def test_nearest_multiset(counts, room):
    sums = {0}
    for n, c in counts.items():
        sums |= {s + n * k for s in sums for k in range(c + 1)}
    taken = packing.nearest_multiset(counts, room)
    assert sum(n * c for n, c in taken.items()) == max(s for s in sums if s <= room) and all(c <= counts[n] for n, c in taken.items())


def test_packing(spark):
    rows = ROWS + [(1000 + i, "word " * (i * 37 % 900)) for i in range(300)]
    out = packing.pack(docs(spark, rows), WORD, capacity=256, window=50, with_ids=True).collect()
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.ids, r.doc_tokens))
    # two rows of one id are packed each for itself
    twice = [ids_of(WORD, t) + [1] for i, t in rows if i == 3]
    assert sorted(n for start, _, n in pieces[3] if start == 0) == sorted(map(len, twice)) and sorted(x for _, ids, _ in pieces[3] for x in ids) == sorted(x for ids in twice for x in ids)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0
    for i, t in rows:
        if i != 3:
            got = [x for _, ids, _ in sorted(pieces[i]) for x in ids]
            assert got == ids_of(WORD, t) + [1] and all(n == len(got) for *_, n in pieces[i])
    assert packing.pack(docs(spark, []), WORD).count() == 0


def test_packing_sees_every_waiting_length():
    packer = packing.Packer(2048)
    # 1001 = 301 + 300 + 400; without the one odd length no sum is odd
    for doc, n in enumerate([1047, 301, *range(200, 402, 2)]):
        packer.add(doc, np.zeros(n, np.uint32))
    packer._fill()
    assert sum(len(ids) for _, _, ids, *_ in packer.rows) == 2048 and all(len(ids) == total for _, _, ids, total, *_ in packer.rows)


def apart(symbols):
    """How often each pair of neighbours stands without overlap."""
    count, last = collections.Counter(), {}
    for i, p in enumerate(zip(symbols, symbols[1:])):
        if last.get(p) != i - 1:
            count[p] += 1
            last[p] = i
    return count


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=120), st.lists(st.integers(0, 3), max_size=30), st.integers(2, 9))
def test_grammar_leaves_no_repeated_pair(front, phrase, times):
    ids = np.asarray(front + phrase * times + [4] * times * 5, np.uint32)
    for least in (2, 4):
        symbols, rules = repair_store.compress(ids, 5, least)
        assert max(apart(symbols.tolist()).values(), default=0) < least
        assert repair_store.Grammar(rules, 5).expand(symbols.astype(np.int64)).tolist() == ids.tolist()


def test_grammar_sees_all_symbols():
    r = np.random.default_rng(3)
    phrase = r.integers(0, 40_000, 500).astype(np.uint32)
    ids = np.concatenate([np.concatenate([phrase, r.integers(0, 40_000, 20).astype(np.uint32)]) for _ in range(40)])
    symbols, rules = repair_store.compress(ids, 40_000)
    # one symbol stands for the phrase in each of its places
    assert repair_store.Grammar(rules, 40_000).widths.max() >= 500 and len(symbols) <= 40 * 21
    assert max(apart(symbols.tolist()).values()) < repair_store.LEAST


def test_grammar_takes_few_bytes_for_each_symbol():
    r = np.random.default_rng(4)
    ids = r.integers(0, 100, 1 << 18).astype(np.uint32)  # nearly all pairs are frequent
    tracemalloc.start()
    try:
        symbols, rules = repair_store.compress(ids, 40_000)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(rules) > 1000 and repair_store.Grammar(rules, 40_000).expand(symbols.astype(np.int64)).tolist() == ids.tolist()
    assert peak < 75 * len(ids)


def test_workers_give_freed_memory_back():
    def anonymous():
        return int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024

    def task(batches):
        # what a step leaves: small blocks, of which the last one stays
        held = [bytearray(100_000) for _ in range(1000)]
        last = held.pop()
        yield anonymous()
        held.clear()
        yield last

    run = common.trimming(task)(iter([]))
    peak = next(run)
    list(run)
    assert anonymous() < peak - 60
