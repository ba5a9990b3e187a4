"""Column expressions shared by the operators.

ANSI mode is on in Spark 4, so every division and cast here is the ``try_`` form:
a bad value becomes NULL, and NULL fails every gate.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c) -> Column:
    """Text or number to double; unreadable, NaN and infinite values become NULL."""
    value = col(c).try_cast("double")
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def truthy(c, accepted=("1", "true", "yes", "y", "qualified", "pass")) -> Column:
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin(*accepted), F.lit(False))


def ratio(a, b) -> Column:
    """a / b, NULL when b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def ieee_ratio(a, b) -> Column:
    """a / b as floating point has it: infinite when b is zero, NaN when both are."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(F.try_divide(a, b))


def pct(a, b) -> Column:
    """Percent change from b to a."""
    return (ratio(a, b) - 1) * 100


def rounded(c, digits: int) -> Column:
    """Half away from zero of the scaled double, as SQL rounds doubles.

    Spark's ``round`` goes by the shortest decimal text: 0.5176875, whose double lies below, goes up.
    """
    c, scale = col(c), F.lit(float(10**digits))
    return F.when(F.abs(c) < 1e290, F.round(c * scale) / scale).otherwise(c)


def clip(c, lo=None, hi=None) -> Column:
    """Bound a value; unlike greatest/least alone, NULL stays NULL."""
    c = col(c)
    bounded = c
    if lo is not None:
        bounded = F.greatest(bounded, F.lit(lo))
    if hi is not None:
        bounded = F.least(bounded, F.lit(hi))
    return F.when(c.isNotNull(), bounded)


def log1p_floor(c) -> Column:
    return F.log1p(clip(c, lo=0.0))


def signed_log(c) -> Column:
    return F.signum(col(c)) * F.log1p(F.abs(col(c)))


def safe_ln(c) -> Column:
    return F.when(col(c) > 0, F.ln(col(c)))


def share(cond: Column) -> Column:
    """0/1 indicator in which NULL counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("double")


def holds(cond: Column) -> Column:
    """Boolean with NULL read as false."""
    return F.coalesce(cond, F.lit(False))


def hash_int(*parts) -> Column:
    """60-bit integer from md5 of the parts joined with '|', equal on every run."""
    text = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def hash_unit(*parts) -> Column:
    return hash_int(*parts) / F.lit(float(2**60))


def minute_of_day(slot) -> Column:
    """'HH:MM' to minutes since midnight."""
    piece = F.split(col(slot), ":")
    return piece[0].cast("int") * 60 + piece[1].cast("int")


def all_of(conds) -> Column:
    return reduce(lambda a, b: a & b, [holds(c) for c in conds], F.lit(True))


def erfc(x: Column) -> Column:
    """Complementary error function of a value of 0 or more, to about 1e-13 relative.

    A series of positive terms near zero, a continued fraction from 2.5 on, both of fixed
    length; NULL stays NULL.
    """
    x = x.cast("double")
    square = 2 * x * x
    step = lambda acc, n: acc["t"] * square / (2 * n + 1)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("t"), x.alias("s")),
        lambda acc, n: F.struct(step(acc, n).alias("t"), (acc["s"] + step(acc, n)).alias("s")), lambda acc: acc["s"],
    )
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), F.lit(0.0), lambda f, k: (k / 2) / (x + f))
    scale = F.exp(-x * x) / math.sqrt(math.pi)
    return F.when(x < 2.5, 1 - 2 * scale * series).when(x >= 2.5, scale / (x + fraction))
