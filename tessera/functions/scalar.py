"""Scalar expressions; all are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def similarity_band(percent: Column) -> Column:
    return F.when(percent >= 88, "high").when(percent >= 72, "mid").otherwise("low")


def percent(cosine: Column) -> Column:
    """Cosine as a whole percent, never below 0 (this library's own choice)."""
    return F.round(100 * F.greatest(F.lit(0.0), cosine)).cast("int")


def valid_phone(c: Column) -> Column:
    """Missing and empty values pass."""
    return F.coalesce(c, F.lit("")).rlike(r"^(\+?[\d\s\-]{10,15})?\z")


def password_strength(c: Column) -> Column:
    met = sum(c.rlike(p).cast("int") for p in ("[A-Z]", "[a-z]", "[0-9]", "[^A-Za-z0-9]"))
    return F.when(F.length(c) < 8, "weak").when(met == 4, "strong").when(met >= 2, "medium").otherwise("weak")


def basename(c: Column) -> Column:
    """What follows the last backslash."""
    return F.element_at(F.split(c, r"\\"), -1)


def or_default(c: Column, default: str) -> Column:
    """Null and empty become the default."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def truthy(c: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(c, F.lit("")) != ""


def get_or(m: Column, key: str, default: str) -> Column:
    """The value of a key, which may be null; the default only where the map lacks the key."""
    return F.when(F.map_contains_key(m, key), F.element_at(m, key)).otherwise(default)


def with_entry(m: Column, condition: Column, key: str, value: Column) -> Column:
    """The map with one more entry where the condition holds."""
    return F.when(condition, F.map_concat(m, F.create_map(F.lit(key), value))).otherwise(m)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def head_fingerprint(content: Column, head: int = 65536) -> Column:
    return F.sha2(F.substring(content, 1, head), 256)


def envelope(success: Column, message: Column, data: Column) -> Column:
    return F.struct(success.alias("success"), message.alias("message"), data.alias("data"))
