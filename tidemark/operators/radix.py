"""Order statistics of groups of any size: prefix sums and selection by an order-preserving key.

A value's key ascends with it and grows with the logarithm of its size, so its leading digits
split any numbers into buckets that partial aggregates count. No group is sorted in one task,
nothing is measured before the plan is made, and small and huge groups take the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import col

#: Coarse buckets of a doubling of the value, and fine buckets of a coarse one. A group has at most
#: 2 * 2,200 * COARSE coarse buckets, whatever its size.
COARSE, FINE = 16, 4096


def _number(df: DataFrame, value: Column) -> Column:
    """The value as a double that ascends with it (not strictly, for wide integers and text)."""
    kind = df.select(value).schema[0].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("double")
    if isinstance(kind, T.StringType):
        start = F.rpad(F.substring(value.cast("binary"), 1, 6), 6, F.lit(b"\0"))
        return F.conv(F.hex(start), 16, 10).cast("double")
    if isinstance(kind, T.BooleanType):
        return value.cast("int").cast("double")
    return value.cast("double")


def order_key(number: Column) -> Column:
    """Ascends with a double: sign, exponent and mantissa as one number of bounded size.

    ``e + |x| / 2**e`` is continuous where the exponent steps, so a logarithm that is rounded to
    the wrong side of a power of two moves no value past another one's bucket.
    """
    size = F.abs(number)
    e = F.floor(F.log2(size)).cast("double")
    grown = F.when(size == 0, 0.0).when(size == float("inf"), 2300.0).otherwise(e + size / F.pow(F.lit(2.0), e) + 1100.0)
    return F.when(F.isnan(number), 2400.0).when(number < 0, -grown).otherwise(grown)


def _bucketed(df: DataFrame, value: Column) -> DataFrame:
    scaled = order_key(_number(df, value)) * COARSE
    return df.withColumn("_k", scaled).withColumns({"_b1": F.floor("_k").cast("int"), "_b2": F.floor((F.col("_k") - F.floor("_k")) * FINE).cast("int")}).drop("_k")


def _stacked(rows: DataFrame, heads: DataFrame, by: list[str], order: list[Column], names: list[str]) -> DataFrame:
    """Running sums of ``rows`` in ``order`` within ``by``, on top of what ``heads`` (one row a key) brings along.

    Heads travel in the same shuffle as the rows, so nothing is joined. Adds ``{name}_before`` and
    ``{name}_total``.
    """
    both = rows.withColumn("_head", F.lit(1)).unionByName(heads.withColumn("_head", F.lit(0)), allowMissingColumns=True)
    key = Window.partitionBy(*by)
    run = key.orderBy("_head", *order).rowsBetween(Window.unboundedPreceding, -1)
    sums = {}
    for n in names:
        inside = F.sum(F.when(F.col("_head") == 1, F.col(n))).over(run)
        sums[f"{n}_before"] = F.coalesce(inside, F.lit(0)) + F.max(f"{n}_base").over(key)
        sums[f"{n}_total"] = F.max(f"{n}_all").over(key)
    return both.withColumns(sums).where("_head = 1").drop("_head", *[f"{n}_{x}" for n in names for x in ("base", "all")])


def prefix_sums(cells: DataFrame, by: list[str], value: str, names: list[str]) -> DataFrame:
    """Adds to each cell what the group's cells with smaller values sum to, and the group's total.

    ``cells`` has one row per group and value. Three levels: coarse buckets of a group, fine
    buckets of a coarse one, cells of a fine one; each level's window is bounded by the number of
    buckets, not by the group. Adds ``{name}_before`` and ``{name}_total``.
    """
    own = cells.columns
    cells = _bucketed(cells, F.col(value)).withColumn("_every", F.lit(0))
    group = [*by, "_every"]
    fine = cells.groupBy(*group, "_b1", "_b2").agg(*[F.sum(n).alias(n) for n in names])
    coarse = fine.groupBy(*group, "_b1").agg(*[F.sum(n).alias(n) for n in names])
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_b1").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.select(*group, "_b1", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_base") for n in names], *[F.sum(n).over(whole).alias(f"{n}_all") for n in names])
    fine = _stacked(fine, coarse, [*group, "_b1"], [F.col("_b2")], names)
    fine = fine.select(*group, "_b1", "_b2", *[F.col(f"{n}_before").alias(f"{n}_base") for n in names], *[F.col(f"{n}_total").alias(f"{n}_all") for n in names])
    done = _stacked(cells, fine, [*group, "_b1", "_b2"], [F.col(value)], names)
    return done.select(*own, *[f"{n}_{x}" for n in names for x in ("before", "total")])


def with_cells(df: DataFrame, value: Column, out: str) -> DataFrame:
    """Adds the number of the value's fine bucket; it ascends with the value, nulls come first."""
    cell = F.coalesce(F.col("_b1").cast("long") * FINE + F.col("_b2"), F.lit(-(2**62)))
    return _bucketed(df, value).withColumn(out, cell).drop("_b1", "_b2")


def cell_ranks(rows: DataFrame, cell: str) -> DataFrame:
    """Each cell's rows (``_size``), those in smaller cells (``_before``) and all there are (``_rows``)."""
    fine = rows.groupBy(cell).agg(F.count(F.lit(1)).alias("_c")).withColumn("_b1", F.floor(F.col(cell) / FINE).cast("long"))
    coarse = fine.groupBy("_b1").agg(F.sum("_c").alias("_c")).withColumn("_every", F.lit(0))
    whole = Window.partitionBy("_every")
    before = whole.orderBy("_b1").rowsBetween(Window.unboundedPreceding, -1)
    heads = coarse.select("_b1", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c_base"), F.sum("_c").over(whole).alias("_c_all"))
    found = _stacked(fine, heads, ["_b1"], [F.col(cell)], ["_c"])
    return found.select(cell, F.col("_c").alias("_size"), F.col("_c_before").alias("_before"), F.col("_c_total").alias("_rows"))


def running_max(rows: DataFrame, by: list[str], order: Column, name: str, out: str, inclusive: bool) -> DataFrame:
    """The largest ``name`` of the group's rows with a smaller ``order`` (or an equal one, if ``inclusive``).

    Three levels as in ``prefix_sums``: buckets bring what came before them, and a bucket's own
    rows are gone through in order. Nulls of ``name`` count for nothing; ``order`` is a number.
    """
    own = rows.columns
    rows = _bucketed(rows.withColumn("_o", order), F.col("_o")).withColumn("_every", F.lit(0))
    group = [*by, "_every"]
    fine = rows.groupBy(*group, "_b1", "_b2").agg(F.max(name).alias("_m"))
    coarse = fine.groupBy(*group, "_b1").agg(F.max("_m").alias("_m"))
    earlier = lambda keys, at: F.max("_m").over(Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    heads = coarse.select(*group, "_b1", earlier(group, "_b1").alias("_base"))
    fine = fine.unionByName(heads.withColumn("_b2", F.lit(-1)), allowMissingColumns=True)
    key = [*group, "_b1"]
    fine = fine.withColumn("_base", F.greatest(F.max("_base").over(Window.partitionBy(*key)), earlier(key, "_b2"))).where("_b2 >= 0")
    both = rows.withColumn("_head", F.lit(1)).unionByName(fine.select(*key, "_b2", "_base", F.lit(0).alias("_head")), allowMissingColumns=True)
    whole = Window.partitionBy(*key, "_b2")
    value = F.when(F.col("_head") == 1, F.col(name))
    run = whole.orderBy(F.col("_o").asc_nulls_first())  # a head has no order
    inside = F.max(value).over(run.rangeBetween(Window.unboundedPreceding, Window.currentRow) if inclusive else run.rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn(out, F.greatest(F.max("_base").over(whole), inside)).where("_head = 1").select(*own, out)


def select_values(df: DataFrame, by: list[str], value: Column, weight: Column | None, targets: dict[str, tuple]) -> DataFrame:
    """One row per group: for each target the smallest value whose cumulative weight reaches it.

    ``targets`` maps an output to a function of the group's total weight. Histograms are narrowed
    in three rounds: coarse bucket, fine bucket, values; each scans ``df`` and shuffles partial
    sums alone, first of buckets and in the last round of the values in the buckets sought.
    Groups without values (or weight) give no row.
    """
    w = F.lit(1) if weight is None else weight
    rows = df.select(*by, value.alias("_v"), w.alias("_w")).where("_v IS NOT NULL AND _w IS NOT NULL")
    rows = _bucketed(rows, F.col("_v")).withColumn("_every", F.lit(0))
    group = [*by, "_every"]
    first = rows.groupBy(*group, "_b1").agg(F.sum("_w").alias("_w"))
    total = F.sum("_w").over(Window.partitionBy(*group))
    first = first.withColumns({"_t": total, "_cum": F.sum("_w").over(Window.partitionBy(*group).orderBy("_b1"))}).where("_t > 0")
    wanted = F.array(*[F.struct(F.lit(k).alias("_i"), F.least(fn(F.col("_t")), F.col("_t")).cast("double").alias("_need")) for k, fn in enumerate(targets.values())])
    first = first.select("*", F.explode(wanted).alias("_x")).select(*group, "_b1", "_w", "_cum", "_x.*")
    first = _hit(first).select(*group, "_b1", "_i", "_need")
    second = _narrowed(rows, first, [*group, "_b1"]).groupBy(*group, "_b1", "_i", "_b2").agg(F.sum("_w").alias("_w"), F.max("_need").alias("_need"))
    run = Window.partitionBy(*group, "_i")
    second = _hit(second.withColumn("_cum", F.sum("_w").over(run.orderBy("_b2")))).select(*group, "_b1", "_b2", "_i", "_need")
    third = _narrowed(rows, second, [*group, "_b1", "_b2"]).groupBy(*group, "_i", "_v").agg(F.sum("_w").alias("_w"), F.max("_need").alias("_need"))
    third = third.withColumns({"_cum": F.sum("_w").over(run.orderBy("_v")), "_last": F.max("_v").over(run)})
    # sums in another order may miss the need by a rounding error: then it's the last value sought
    reached = F.coalesce(F.min(F.when(F.col("_cum") >= F.col("_need"), F.col("_v"))), F.max("_last"))
    found = third.groupBy(*group, "_i").agg(reached.alias("_v"))
    return found.groupBy(*group).agg(*[F.max(F.when(F.col("_i") == k, F.col("_v"))).alias(n) for k, n in enumerate(targets)]).drop("_every")


def _hit(cells: DataFrame) -> DataFrame:
    """Cells in which the need is reached, with what is needed inside them; a need of nothing is met by the first."""
    before = F.col("_cum") - F.col("_w")
    inside = (F.col("_cum") >= F.col("_need")) & ((before < F.col("_need")) | ((F.col("_need") <= 0) & (before <= 0))) & (F.col("_w") > 0)
    return cells.where(inside).withColumn("_need", F.col("_need") - before)


def _narrowed(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in the buckets found; those are as many as groups and targets."""
    a, b = rows.alias("a"), found.alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same).select("a.*", "b._i", "b._need")


def quantiles(df: DataFrame, by: list[str], value, qs: dict[str, float]) -> DataFrame:
    """Linear quantiles of each group, exact: ``by`` and a column for each of ``qs``."""
    targets = {}
    for k, q in enumerate(qs.values()):
        targets[f"_lo{k}"] = lambda n, q=q: F.floor((n - 1) * F.lit(q)) + 1
        targets[f"_hi{k}"] = lambda n, q=q: F.ceil((n - 1) * F.lit(q)) + 1
    picked = select_values(df, by, col(value).cast("double"), None, targets)
    sizes = df.where(col(value).isNotNull()).groupBy(*by, F.lit(0).alias("_every")).agg(F.count("*").alias("_n"))
    a, b = picked.withColumn("_every", F.lit(0)).alias("a"), sizes.alias("b")
    same = F.lit(True)
    for k in (*by, "_every"):
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    at = {n: (F.col("b._n") - 1) * F.lit(q) for n, q in qs.items()}
    lo, hi = (lambda k: F.col(f"a._lo{k}")), (lambda k: F.col(f"a._hi{k}"))
    # a rank between none needs no difference, which infinite values don't have
    mix = lambda k, x: F.when(x == F.floor(x), lo(k)).otherwise(lo(k) + (hi(k) - lo(k)) * (x - F.floor(x)))
    return a.join(b, same).select(*[F.col(f"a.{c}") for c in by], *[mix(k, x).alias(n) for k, (n, x) in enumerate(at.items())])
