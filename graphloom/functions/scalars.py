"""Column functions that operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fnv1a(c: Column) -> Column:
    """FNV-1a of the text's code points, 32 bits, as eight hexadecimal digits."""
    codes = F.transform(F.split(c, ""), lambda ch: F.ascii(ch).cast("long"))
    h = F.aggregate(F.filter(codes, lambda x: x != 0), F.lit(2166136261).cast("long"), lambda h, x: F.pmod(h.bitwiseXOR(x) * 16777619, F.lit(1 << 32)))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def number_or(c: Column, default: float) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def flag_or(c: Column, default: bool) -> Column:
    return F.coalesce(c.try_cast("boolean"), F.lit(default))


def first_of(items: Column, n: int) -> Column:
    return F.slice(F.array_distinct(items), 1, n)


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
