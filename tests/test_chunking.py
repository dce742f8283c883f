import pytest
from hypothesis import given
from hypothesis import strategies as st

from passagelake.functions.text import WHITE_SPACE, human_bytes, preview
from passagelake.operators.chunking import chunk, chunk_text

CASES = [
    ("a" * 1000, 512, 64, [(0, 512), (448, 512), (896, 104), (936, 64)]),
    ("a" * 500 + "\n\n" + "b" * 500, 600, 50, [(0, 500), (452, 550), (952, 50)]),
    ("p" * 5 + "\n\n" + "q" * 20 + "\n" + "r" * 30, 40, 4, [(0, 40), (36, 22), (54, 4)]),
    ("q" * 20 + "\n" + "r" * 30, 40, 4, [(0, 20), (17, 34), (47, 4)]),
    ("q" * 20 + "\r\n\r\n" + "r" * 30, 40, 4, [(0, 20), (20, 30), (50, 4)]),
    ("é" * 10, 7, 2, [(0, 8), (6, 8), (12, 8), (18, 2)]),
    ("\U0001f600" * 4, 6, 1, [(0, 8), (8, 8)]),
    ("  \n" + "x" * 12, 10, 2, [(0, 10), (8, 4), (10, 2)]),
    ("x" * 10, 10, 2, [(0, 10)]),
    ("abcdefghij", 4, 4, [(0, 4), (4, 4), (8, 2)]),
    ("a" * 8 + " " * 12 + "b" * 8, 10, 2, [(0, 8), (16, 6), (24, 4), (26, 2)]),
    (" hi ", 512, 64, [(0, 2)]),
    ("\x1fhi\x1f", 512, 64, [(0, 4)]),
    ("hello world", 1000, 100, [(0, 11)]),
    ("", 512, 64, []),
]


@pytest.mark.parametrize("text, size, overlap, expected", CASES)
def test_cases(text, size, overlap, expected):
    assert [(o, len(t.encode())) for o, t in chunk_text(text, size, overlap)] == expected


@given(st.text("ab\n é　\U0001f600", max_size=200), st.integers(1, 30), st.integers(0, 30))
def test_passages_stand_at_their_offsets(text, size, overlap):
    raw = text.strip(WHITE_SPACE).encode()
    for offset, passage in chunk_text(text, size, overlap):
        assert passage == passage.strip(WHITE_SPACE) != ""
        assert raw[offset:].decode().lstrip(WHITE_SPACE).startswith(passage)


def test_table(spark):
    rows = [(i, t) for i, (t, *_) in enumerate(CASES)] + [(99, None)]
    out = chunk(spark.createDataFrame(rows, "id long, text string"), "id", "text", 40, 4).collect()
    assert {(r.id, r.chunk_ord, r.byte_offset, r.text) for r in out} == {(i, n, o, t) for i, text in rows for n, (o, t) in enumerate(chunk_text(text, 40, 4))}
    with pytest.raises(ValueError):
        chunk(spark.createDataFrame(rows, "id long, text string"), "id", "text", 0)


def test_previews_and_sizes():
    assert preview("x" * 200) == "x" * 200 and preview("x" * 201) == "x" * 200 + "..."
    assert preview("x" * 199 + "é" * 3) == "x" * 199 + "é..."
    assert [human_bytes(n) for n in (5, 2048, 3 << 20, 5 << 30)] == ["5 B", "2.0 KB", "3.0 MB", "5.00 GB"]
