"""Vector arithmetic as columns; all of it runs in the JVM, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Dot product; null if the lengths differ or an operand is null, or if the result is NaN."""
    s = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return F.nanvl(F.when(F.size(a) == F.size(b), s), F.lit(None).cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_guard(v: Column) -> Column:
    """Divided by its norm only if that exceeds 1e-9."""
    n = norm(v)
    return F.when(n > EPS, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def l2_clip(v: Column) -> Column:
    """Divided by its norm, or by 1e-9 if that is larger."""
    n = F.greatest(norm(v), F.lit(EPS))
    return F.transform(doubles(v), lambda x: x / n)


def pool_mean(tokens: Column, length: Column) -> Column:
    """Mean of the first `length` token vectors; the divisor is 1e-9 at least."""
    used = F.slice(tokens, F.lit(1), length)
    start = F.transform(tokens[0], lambda x: F.lit(0.0))
    total = F.aggregate(used, start, lambda acc, t: F.zip_with(acc, doubles(t), lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.greatest(length.cast("double"), F.lit(EPS)))


def pool_cls(tokens: Column) -> Column:
    """The first token's vector."""
    return tokens[0]


def pool_last(tokens: Column, length: Column) -> Column:
    """The vector of the last real token, of the first one if there is none."""
    return F.get(tokens, F.greatest(length - 1, F.lit(0)))


def score(raw: Column) -> Column:
    """A similarity as it is reported; ranking uses the unrounded value."""
    return F.round(raw, 4) + F.lit(0.0)  # no negative zero
