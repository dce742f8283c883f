"""Token counts by overlap resynchronisation.

A text of up to CHUNK characters is one chunk. A longer one is encoded as chunks that overlap; within the
overlap both encodings, laid side by side by their offsets, must show a token boundary at the same stable
place: a space between two other characters, which no token crosses whatever stands around it. There the
encodings are spliced. Where the overlap has no such place it is widened, at last to the end of the text.

Defined cases: a null or empty text has 0 tokens; rows with equal or null ids are each counted; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import filled, slices
from .pieces import encoder, library, releasing

CHUNK = 1 << 15
OVERLAP = 1 << 9


def stable(text: str, at: int) -> bool:
    """No token crosses this place: a space between two characters that are no white space."""
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()


def boundaries(encode, text: str, start: int, stop: int) -> np.ndarray:
    """Ends of the tokens of text[start:stop], as places in the whole text, one for each token."""
    return np.asarray([b for _, b in encode(text[start:stop])], np.int64) + start


def spliced_count(text: str, encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
    """Tokens of the text, and how often an overlap had to be widened. encode gives the tokens' (start, end) offsets."""
    n, widened, count, start = len(text), 0, 0, 0
    stop = min(n, chunk)
    ends = boundaries(encode, text, start, stop)
    while stop < n:
        width = overlap
        while True:
            low = max(start + 1, stop - width)
            last = min(n, max(stop + chunk, low + chunk))
            following = boundaries(encode, text, low, last)
            common = np.intersect1d(ends[ends >= low], following[following <= stop])
            join = next((int(x) for x in common if stable(text, int(x))), None)
            if join is not None:
                # the left encoding began at a stable place, so it is exact up to the next one; the right one is exact after it
                count += int(np.searchsorted(ends, join, "right"))
                ends, start, stop = following[following > join], join, last
                break
            widened += 1
            if low == start + 1:  # the chunk has no stable place: take more text from its start
                stop = min(n, stop + (stop - start))
                ends = boundaries(encode, text, start, stop)
                if stop == n:
                    break
            width *= 2
    return count + len(ends), widened


def token_counts(docs: DataFrame, path: str, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (more than `limit` tokens) for every row, as the tokenizers file at `path` counts them."""
    kind = docs.schema[id_column].dataType.simpleString()

    def count(batches):
        table, whole = encoder(path), library(path)

        def offsets(text):
            return whole.encode(text, add_special_tokens=False).offsets

        for batch in slices(batches, text_column):
            texts = filled(batch.column(text_column))
            raw = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]).astype(np.int64)
            long = np.flatnonzero(raw > chunk)
            if len(long):
                short = pa.array([None if i in set(long) else x for i, x in enumerate(texts.to_pylist())], pa.string()).fill_null("")
            else:
                short = texts
            counts = np.fromiter(map(len, table.encode(short)), np.int64, len(texts))
            for i in long:
                counts[i] = spliced_count(texts[int(i)].as_py(), offsets, chunk, overlap)[0]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(raw), pa.array(counts), pa.array(counts > limit)], names=[id_column, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_column, text_column).mapInArrow(releasing(path, count), f"`{id_column}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
