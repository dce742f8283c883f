"""Text helpers: Unicode trimming, previews, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points with the White_Space property (fixed values).
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
PREVIEW_BYTES = 200


def preview(text: str, limit: int = PREVIEW_BYTES) -> str:
    """The text, cut after `limit` bytes at the next character boundary with "..."."""
    raw = text.encode()
    if len(raw) <= limit:
        return text
    end = limit
    while end < len(raw) and raw[end] & 0xC0 == 0x80:
        end += 1
    return raw[:end].decode() + "..."


def preview_column(text: Column, limit: int = PREVIEW_BYTES) -> Column:
    """preview() as an expression: characters that begin before byte `limit` are kept."""
    head = F.left(text, F.lit(limit))
    step = F.struct(F.lit("").alias("t"), F.lit(0).alias("n"))
    grown = F.aggregate(F.split(head, ""), step, lambda a, c: F.when(a["n"] < limit, F.struct(F.concat(a["t"], c).alias("t"), (a["n"] + F.octet_length(c)).alias("n"))).otherwise(a), lambda a: a["t"])
    cut = F.when(F.octet_length(head) == F.length(head), head).otherwise(grown)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(cut, F.lit("...")))


def human_bytes(n: int) -> str:
    for size, unit, digits in ((1 << 30, "GB", 2), (1 << 20, "MB", 1), (1 << 10, "KB", 1)):
        if n >= size:
            return f"{n / size:.{digits}f} {unit}"
    return f"{n} B"


def human_bytes_column(n: Column) -> Column:
    scaled = lambda size, form: F.format_string(form, n / F.lit(float(size)))
    return F.when(n >= 1 << 30, scaled(1 << 30, "%.2f GB")).when(n >= 1 << 20, scaled(1 << 20, "%.1f MB")).when(n >= 1 << 10, scaled(1 << 10, "%.1f KB")).otherwise(F.format_string("%d B", n))
