"""Column functions on ``array<double>`` vectors, hashes and small distributions (Z1-Z8); all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda a, b: a + b)


def dot(x, y) -> Column:
    return total(F.zip_with(_c(x), _c(y), lambda a, b: a * b))


def squared_distance(x, y) -> Column:
    return total(F.zip_with(_c(x), _c(y), lambda a, b: (a - b) * (a - b)))


def euclidean(x, y) -> Column:
    return F.sqrt(squared_distance(x, y))


def chebyshev(x, y) -> Column:
    return F.array_max(F.zip_with(_c(x), _c(y), lambda a, b: F.abs(a - b)))


def norm(x) -> Column:
    return F.sqrt(total(F.transform(_c(x), lambda a: a * a)))


def scaled(x, by) -> Column:
    return F.transform(_c(x), lambda a: a * by)


def log_sum_exp(x) -> Column:
    top = F.array_max(_c(x))
    return top + F.log(total(F.transform(_c(x), lambda a: F.exp(a - top))))


def softmax(x) -> Column:
    whole = log_sum_exp(x)
    return F.transform(_c(x), lambda a: F.exp(a - whole))


def priority(seed: int, key) -> Column:
    """Order-free random rank key: the SHA-256 of ``seed:key`` in hex; equal in any engine."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), _c(key).cast("string")), 256)


def hash_uniform(seed: int, key) -> Column:
    """In [0, 1): the first 52 bits of :func:`priority`."""
    return F.conv(F.substring(priority(seed, key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def entropy_term(p) -> Column:
    return F.when(_c(p) > 0, -_c(p) * F.log2(_c(p))).otherwise(0.0)


def js_term(p, q) -> Column:
    """One class's part of the Jensen-Shannon divergence in bits."""
    p, q = _c(p), _c(q)
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return (part(p) + part(q)) / 2


def quantile(x, q: float | list[float]) -> Column:
    """Exact, linear between ranks."""
    return F.percentile(_c(x), F.array(*[F.lit(v) for v in q]) if isinstance(q, list) else F.lit(q))


def safe_name(x) -> Column:
    return F.regexp_replace(_c(x), "[^A-Za-z0-9_.-]+", "_")


def finite(x) -> Column:
    """Non-finite numbers as null: how an undefined metric is stored."""
    return F.when(F.isnan(_c(x)) | (F.abs(_c(x)) == float("inf")), F.lit(None)).otherwise(_c(x))


def finite_all(x) -> Column:
    return F.transform(_c(x), finite)


def seconds_between(start, end) -> Column:
    return (F.unix_micros(F.to_timestamp(_c(end))) - F.unix_micros(F.to_timestamp(_c(start)))) / 1e6
