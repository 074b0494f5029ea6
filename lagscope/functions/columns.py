"""Small column functions, all built from JVM expressions."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CLASS_MULTIPLIER, DEFAULTS, PRIORITIES, Thresholds


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a TIMESTAMP column."""
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def no_prefix(name: Column | str, prefixes: Iterable[str]) -> Column:
    """True when the name starts with none of the prefixes."""
    col = F.col(name) if isinstance(name, str) else name
    keep = F.lit(True)
    for p in prefixes:
        keep = keep & ~col.startswith(p)
    return keep


def severity_label(score: Column | str, cfg: Thresholds = DEFAULTS) -> Column:
    """Severity name of a score in 0..1."""
    s = F.col(score) if isinstance(score, str) else score
    return (
        F.when(s >= cfg.critical_score, "CRITICAL")
        .when(s >= cfg.high_score, "HIGH")
        .when(s >= cfg.medium_score, "MEDIUM")
        .otherwise("LOW")
    )


def class_multiplier(cls: Column | str) -> Column:
    """Score multiplier of a lag class; 1 for a name that is not one of the six."""
    c = F.col(cls) if isinstance(cls, str) else cls
    out = None
    for name, value in CLASS_MULTIPLIER.items():
        out = F.when(c == name, value) if out is None else out.when(c == name, value)
    return out.otherwise(1.0)


def priority_rank(priority: Column | str) -> Column:
    """0 for the most urgent priority, rising; unknown names sort last."""
    p = F.col(priority) if isinstance(priority, str) else priority
    out = None
    for i, name in enumerate(PRIORITIES):
        out = F.when(p == name, i) if out is None else out.when(p == name, i)
    return out.otherwise(len(PRIORITIES)).cast("int")


def stable_id(text: Column) -> Column:
    """Integer id of a text: the first 15 hex digits of its md5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def snapshot_id(text: Column) -> Column:
    """Integer id of a snapshot time: the first 16 hex digits of its md5, modulo 2^63."""
    number = F.conv(F.substring(F.md5(text), 1, 16), 16, 10).cast("decimal(20,0)")
    return (number % F.lit(Decimal(2**63))).cast("bigint")


def iso_time(ts: Column) -> Column:
    """ISO text of a time, with the fraction left out when it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros(ts) % 1_000_000 == 0, whole).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )


def strip(text: Column) -> Column:
    """Text without ASCII white space at both ends."""
    return F.regexp_replace(text, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")


def dot(a: Column, b: Column) -> Column:
    """Inner product in DOUBLE, added up from left to right."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors; null when one of them has length zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
