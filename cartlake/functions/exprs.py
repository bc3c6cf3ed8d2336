"""Reusable column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's str.strip()/str.split() treat as
# whitespace (str.isspace), so stripping matches Python exactly.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
                 "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# the same set as a regex character class (for splitting on runs)
PY_WHITESPACE_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in PY_WHITESPACE) + "]"


def ustrip(c: Column) -> Column:
    """Python str.strip(): a set trim (codegen, no regex)."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def md5_pick(key: Column, salt: str, n, suffix: Column | None = None) -> Column:
    """Deterministic, partition-independent pick in [0, n): the first 32 bits
    of md5(key ':' salt [':' suffix]) modulo n. Reproducible in DuckDB."""
    text = [key.cast("string"), F.lit(":" + salt)] + ([] if suffix is None else [F.lit(":"), suffix.cast("string")])
    h = F.conv(F.substring(F.md5(F.concat(*text)), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, n if isinstance(n, Column) else F.lit(n))


def md5_unit(key: Column, salt: str) -> Column:
    """Deterministic uniform value in [0, 1)."""
    return md5_pick(key, salt, 1 << 30) / F.lit(float(1 << 30))


def line_amount(qty: str = "quantity", price: str = "unit_price", disc: str = "discount") -> Column:
    return F.col(qty) * F.col(price) - F.col(disc)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    na = norm(a) if na is None else na
    nb = norm(b) if nb is None else nb
    return dot(a, b) / (na * nb)


def money(c: Column, places: int = 2) -> Column:
    """Round half up to ``places`` decimals with plain IEEE operations
    (floor(x*10^p + 0.5) / 10^p), so every engine yields the same double.
    Spark's round() rounds the shortest decimal string of the double, which
    differs from other engines at .xx5 boundaries."""
    s = 10 ** places
    return F.floor(c * s + 0.5) / s


def money_sql(expr: str, places: int = 2) -> str:
    s = 10 ** places
    return f"(floor(({expr}) * {s} + 0.5) / {s})"
