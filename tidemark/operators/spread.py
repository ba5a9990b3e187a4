"""Group-wise building blocks that stay exact when one group is huge.

A plain Spark window puts a whole group into one task. That is the cheapest plan
while groups are small. Whether they are is declared where a data contract says it, so the
same plan is chosen for every input and choosing it costs no job:

* ``bound``, or ``known_groups``, gives the largest size of these groups, or
* a group key is in ``CONTRACT``: one instrument or one trading day bounds its rows.

Groups by other keys alone have no contract: a key-only ``groupBy.count`` (map-side
combined, memoised) tells their size, unless all scanned inputs are below the limit.

Above ``spark.tidemark.maxGroupRows`` rows the group is cut into range partitions on
``(by, order)``. Each piece is scanned by its own task, and only the running totals of
groups that cross a cut are carried over. At most two such rows exist per cut, so that
carry table is bounded by the partition count and may be broadcast. Results are the
same on both paths.

The range-partitioned input is checkpointed, because the cut positions must be the same
for both readers and must survive a lost executor.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import col
from . import radix

LIMIT = "spark.tidemark.maxGroupRows"
DEFAULT_LIMIT = 1_000_000
BYTES_PER_ROW = 64

#: Largest number of rows that one value of a key has by contract: an instrument's history
#: in five-minute bars, and a day's bars and snapshots of all instruments.
CONTRACT = {"code": 500_000, "day": 500_000}

_measured: dict = {}
_known: ContextVar = ContextVar("known_group_bounds", default=None)


def group_limit(spark) -> int:
    return int(spark.conf.get(LIMIT, str(DEFAULT_LIMIT)))


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the scanned inputs; joins are not multiplied out.

    Read off the analyzed plan, so the check costs no optimizer run.
    """
    try:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        found = [leaves.apply(i) for i in range(leaves.size())]
        # a table that the plan reads several times counts once
        sizes = {_source_name(leaf): int(str(leaf.stats().sizeInBytes())) for leaf in found}
        return sum(sizes.values())
    except Exception:  # no JVM handle on a remote session
        return None


def _source_name(leaf) -> str:
    try:
        return leaf.relation().location().rootPaths().toString()
    except Exception:  # not a file relation
        return str(leaf.semanticHash())


def largest_group(df: DataFrame, by: list[str]) -> int:
    keys = df.select(*by) if by else df.select(F.lit(1).alias("_k"))
    names = keys.columns
    token = (df.sparkSession.sparkContext.applicationId, keys.semanticHash(), tuple(names))
    if token not in _measured:
        top = keys.groupBy(*names).count().agg(F.max("count")).first()[0]
        _measured[token] = top or 0
    return _measured[token]


def fits(df: DataFrame, by: list[str], bound: int | None = None) -> bool:
    """True when every group is small enough for one task."""
    limit = group_limit(df.sparkSession)
    known = _known.get()
    if bound is None and known is not None:
        bound = known.get(tuple(by))
    if bound is None:
        bound = min((CONTRACT[k] for k in by if k in CONTRACT), default=None)
    if bound is None:
        size = input_bytes(df)
        small = size is not None and size <= limit * BYTES_PER_ROW
        bound = 1 if small else largest_group(df, by)
        if known is not None:
            known[tuple(by)] = bound
    return bound <= limit


def declared(df: DataFrame, by: list[str], bound: int | None = None) -> bool:
    """Whether groups have a size that is declared, by argument or contract, and fits one task."""
    limit = group_limit(df.sparkSession)
    if bound is not None:
        return bound <= limit
    sizes = [CONTRACT[b] for b in by if b in CONTRACT]
    return bool(sizes) and min(sizes) <= limit


def measured_once(fn):
    """For operators that never add rows: measure each key set on its first use only."""

    @wraps(fn)
    def call(*args, **kwargs):
        if _known.get() is not None:
            return fn(*args, **kwargs)
        token = _known.set({})
        try:
            return fn(*args, **kwargs)
        finally:
            _known.reset(token)

    return call


@contextmanager
def known_groups(bounds: dict):
    """Declare largest group sizes, ``{("code",): 5000}``, where a data contract fixes them.

    A wrong value costs speed or memory, never a row: both paths give the same result.
    """
    token = _known.set({**(_known.get() or {}), **bounds})
    try:
        yield
    finally:
        _known.reset(token)


def _shared_folder(df: DataFrame) -> str:
    """The folder that the cluster names for checkpoints; a temporary one only in local mode."""
    sc = df.sparkSession.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder the cluster names."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_shared_folder(df))
    return df.checkpoint()


def stored(df: DataFrame, *order: str) -> DataFrame:
    """``df`` written once as columns, sorted by ``order`` inside its files so that filters skip pages.

    For rows that several jobs read: each would otherwise compute them again.
    """
    path = f"{df.sparkSession.sparkContext.getCheckpointDir() or _shared_folder(df)}/stored-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*order) if order else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _pieces(df: DataFrame, by, order) -> DataFrame:
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = df.repartitionByRange(n, *[F.col(b) for b in by], *order)
    return durable(cut.withColumn("_part", F.spark_partition_id()))


_OVER = {
    "sum": F.sum,
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "product": F.product,
    "first": lambda c: F.first(c, ignorenulls=True),
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _total(kind: str, value: Column) -> Column:
    if kind == "first":
        return F.min_by(value, F.when(value.isNotNull(), F.col("_rn")))
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.col("_rn")))
    return _OVER[kind](value)


def _merge(kind: str, earlier: Column, here: Column) -> Column:
    """Combine the total of earlier pieces with the running value in this one."""
    if kind == "count":
        return F.coalesce(earlier, F.lit(0)) + F.coalesce(here, F.lit(0))
    if kind == "min":
        return F.least(earlier, here)
    if kind == "max":
        return F.greatest(earlier, here)
    if kind == "first":
        return F.coalesce(earlier, here)
    if kind == "last":
        return F.coalesce(here, earlier)
    both = earlier * here if kind == "product" else earlier + here
    return F.coalesce(both, earlier, here)


def running(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    aggs: dict[str, tuple[str, Column]],
    bound: int | None = None,
    current: bool = True,
) -> DataFrame:
    """Running aggregates from the first row of the group to this row.

    ``aggs`` maps an output name to ``(kind, value)`` with kind one of sum, count, min,
    max, product, first, last. ``current=False`` stops one row earlier. ``order`` must
    be a total order inside a group.
    """
    end = 0 if current else -1
    if fits(df, by, bound):
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return df.withColumns({n: _OVER[k](col(v)).over(w) for n, (k, v) in aggs.items()})
    out = df.columns + [n for n in aggs if n not in df.columns]
    values = {f"_v{i}": col(v) for i, (_, v) in enumerate(aggs.values())}
    kinds = [k for k, _ in aggs.values()]
    pieces = _pieces(df.withColumns(values), by, order)
    w = Window.partitionBy(*by, "_part").orderBy(*order)
    frame = w.rowsBetween(Window.unboundedPreceding, end)
    local = pieces.withColumn("_rn", F.row_number().over(w)).withColumns(
        {f"_l{i}": _OVER[k](F.col(f"_v{i}")).over(frame) for i, k in enumerate(kinds)}
    )
    totals = local.groupBy(*by, "_part").agg(
        *[_total(k, F.col(f"_v{i}")).alias(f"_t{i}") for i, k in enumerate(kinds)]
    )
    # at most one row per (group, piece); a group with one piece needs no carry
    carry = _carry(totals, by, kinds)
    carry = F.broadcast(carry)
    joined = local.alias("l").join(carry.alias("r"), _keys([*by, "_part"]), "left")
    merged = {
        n: _merge(k, F.col(f"r._c{i}"), F.col(f"l._l{i}"))
        for i, (n, k) in enumerate(zip(aggs, kinds))
    }
    return joined.select(*[merged[c].alias(c) if c in merged else F.col(f"l.{c}") for c in out])


def _carry(totals: DataFrame, by, kinds) -> DataFrame:
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    fold = {**_OVER, "count": F.sum}
    return (
        totals.withColumn("_n", F.count(F.lit(1)).over(whole))
        .filter("_n > 1")
        .select(
            *by,
            "_part",
            *[fold[k](F.col(f"_t{i}")).over(before).alias(f"_c{i}") for i, k in enumerate(kinds)],
        )
    )


def position(df, by, order, out="_pos", bound=None) -> DataFrame:
    """1-based row number inside the group; ``order`` must be total."""
    if fits(df, by, bound):
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return running(df, by, order, {out: ("count", F.lit(1))}, bound=bound)


def nearby(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    build: Callable,
    back: int = 1,
    ahead: int = 0,
    bound: int | None = None,
) -> DataFrame:
    """Add window columns that look at most ``back`` rows back and ``ahead`` forward.

    ``build(w)`` gets the ordered window and returns ``{name: Column}``. A huge group is
    cut into chunks of consecutive rows; the rows next to a cut are copied to the
    neighbouring chunk so that each frame is complete, and the copies are dropped again.
    """
    if fits(df, by, bound):
        return df.withColumns(build(Window.partitionBy(*by).orderBy(*order)))
    size = max(group_limit(df.sparkSession), back + ahead + 1)
    numbered = position(df, by, order, "_pos", bound)
    home = F.floor((F.col("_pos") - 1) / size)
    offset = (F.col("_pos") - 1) % size
    copies = F.array(
        F.col("_home"),
        F.when(offset >= size - back, F.col("_home") + 1),
        F.when((offset < ahead) & (F.col("_home") > 0), F.col("_home") - 1),
    )
    chunked = numbered.withColumn("_home", home).withColumn(
        "_chunk", F.explode(F.array_compact(copies))
    )
    w = Window.partitionBy(*by, "_chunk").orderBy("_pos")
    done = chunked.withColumns(build(w)).filter("_home = _chunk")
    return done.drop("_home", "_chunk", "_pos")


def group_table(df: DataFrame, by: list[str], aggs: dict, bound: int | None = None) -> DataFrame:
    """One row per group. A value is an aggregate Column or ``("quantile", column, q)``.

    An exact percentile keeps all distinct values of a group in one task; only groups with a
    declared size take it, all others are selected by ``radix.quantiles``.
    """
    plain = {n: a for n, a in aggs.items() if not isinstance(a, tuple)}
    quantiles = {n: a for n, a in aggs.items() if isinstance(a, tuple)}
    if not quantiles or declared(df, by, bound):
        cols = {
            n: F.percentile(col(a[1]), a[2]) if isinstance(a, tuple) else a for n, a in aggs.items()
        }
        return df.groupBy(*by).agg(*[c.alias(n) for n, c in cols.items()])
    result = df.groupBy(*by).agg(*[c.alias(n) for n, c in plain.items()]) if plain else (
        df.select(*by).distinct()
    )
    inputs: dict[str, tuple[Column, dict]] = {}
    for name, (_, value, q) in quantiles.items():
        inputs.setdefault(str(value), (col(value), {}))[1][name] = q
    for value, qs in inputs.values():
        picked = radix.quantiles(df, by, value, qs)
        result = result.alias("l").join(picked.alias("r"), _keys(by), "left").select(
            "l.*", *[F.col(f"r.{n}") for n in qs]
        )
    return result.select(*by, *aggs)


#: Rows of a series with one row a day, at most: five centuries of trading days.
CALENDAR = 150_000


def calendar_rows(df: DataFrame, by: list[str]) -> DataFrame:
    """A series with one row a day in each group; fails where a group has more than ``CALENDAR`` rows.

    The windows over such a series take that bound as theirs.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    message = F.concat(F.lit("a daily series has more rows than a calendar: "), n.cast("string"))
    return df.withColumn("_days_ok", F.when(n > CALENDAR, F.raise_error(message)).otherwise(F.lit(True))).where("_days_ok").drop("_days_ok")


def _keys(by) -> Column:
    conds = [F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}")) for b in by]
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def weighted_positions(df, by, value: Column) -> DataFrame:
    """Distinct values of each group with their count, last rank and group size."""
    counted = (
        df.select(*by, value.alias("_value")).filter("_value is not null")
        .groupBy(*by, "_value").agg(F.count(F.lit(1)).alias("_ties"))
    )
    ranked = radix.prefix_sums(counted, by, "_value", ["_ties"])
    return ranked.select(*by, "_value", "_ties", (F.col("_ties_before") + F.col("_ties")).alias("_last"), F.col("_ties_total").alias("_size"))


def group_values(df: DataFrame, by: list[str], aggs: dict, bound: int | None = None) -> DataFrame:
    """Add whole-group aggregates to every row.

    Groups of a declared size use one unordered window; otherwise the partial-aggregated group
    table is joined back, where adaptive execution splits a skewed left side.
    """
    if declared(df, by, bound):
        w = Window.partitionBy(*by)
        return df.withColumns(
            {
                n: (F.percentile(col(a[1]), F.lit(a[2])) if isinstance(a, tuple) else a).over(w)
                for n, a in aggs.items()
            }
        )
    table = group_table(df, by, aggs, bound)
    kept = [c for c in df.columns if c not in aggs]
    return (
        df.select(*kept).alias("l").join(table.alias("r"), _keys(by), "left")
        .select("l.*", *[F.col(f"r.{n}") for n in aggs])
    )


def tie_ranks(df, by, value: Column, prefix="_", bound=None) -> DataFrame:
    """Lowest and highest 1-based rank of the value among non-NULL values, and their count.

    Adds ``{prefix}lo``, ``{prefix}hi`` and ``{prefix}n``; the average rank is their middle.
    """
    lo, hi, n = f"{prefix}lo", f"{prefix}hi", f"{prefix}n"
    if declared(df, by, bound):
        w = Window.partitionBy(*by)
        upto = w.orderBy(value.asc_nulls_last())
        known = value.isNotNull()
        return df.withColumns(
            {
                lo: F.when(known, F.rank().over(upto)),
                hi: F.when(
                    known,
                    F.count(value).over(upto.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
                ),
                n: F.count(value).over(w),
            }
        )
    ranked = weighted_positions(df, by, value)
    left = df.withColumn("_value", value)
    joined = left.alias("l").join(
        ranked.alias("r"), _keys(by) & (F.col("l._value") == F.col("r._value")), "left"
    )
    found = joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        (F.col("r._last") - F.col("r._ties") + 1).alias(lo),
        F.col("r._last").alias(hi),
    )
    return group_values(found, by, {n: F.count(hi)}, bound)


def _middle_rank(by, value: Column) -> Column:
    """Average-tie rank of a value as one window expression; NULL stays NULL."""
    upto = Window.partitionBy(*by).orderBy(value.asc_nulls_last())
    below = F.count(value).over(upto.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(value.isNotNull(), (F.rank().over(upto) + below) / 2)


def percentile_ranks(df, by, ranks: dict, bound=None) -> DataFrame:
    """Average-tie percentile ranks in (0, 1]; NULL stays NULL.

    ``ranks`` maps an output to a column or to ``(column, descending)``.
    """
    spec = {n: v if isinstance(v, tuple) else (v, False) for n, v in ranks.items()}
    values = {n: -col(c) if down else col(c) for n, (c, down) in spec.items()}
    if declared(df, by, bound):
        w = Window.partitionBy(*by)
        return df.withColumns(
            {n: F.try_divide(_middle_rank(by, v), F.count(v).over(w)) for n, v in values.items()}
        )
    for n, v in values.items():
        df = tie_ranks(df, by, v, "_pr_", bound)
        middle = (F.col("_pr_lo") + F.col("_pr_hi")) / 2
        df = df.withColumn(n, F.try_divide(middle, F.col("_pr_n"))).drop("_pr_lo", "_pr_hi", "_pr_n")
    return df


def rank_sum(df, by, weights: dict[str, float], out: str, keep: list[str], bound=None) -> DataFrame:
    """``keep`` and the weighted sum of the percentile ranks of the ``weights`` columns; NULL ranks as 0.

    In groups of a declared size each value is an argsort of its column, so a row is neither sorted
    nor buffered once per rank; other groups take ``percentile_ranks``.
    """
    if not declared(df, by, bound):
        ranked = percentile_ranks(df, by, {f"_q_{c}": c for c in weights}, bound)
        score = sum((F.coalesce(F.col(f"_q_{c}"), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
        return ranked.select(*keep, score.alias(out))
    inputs = {f"_v{i}": F.col(c).cast("double") for i, c in enumerate(weights)}
    narrow = df.select(*keep, *[v.alias(n) for n, v in inputs.items()], *[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)])
    parts = list(zip(inputs, weights.values()))

    def ranks_of(values: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Average-tie percentile ranks of the known values of one section, 0 for the others; NaN is the largest, as Spark has it."""
        found = np.zeros(len(values))
        seen = values[known]
        if len(seen):
            order = np.argsort(seen)
            ordered = seen[order]
            fresh = np.concatenate([[True], ~((ordered[1:] == ordered[:-1]) | (np.isnan(ordered[1:]) & np.isnan(ordered[:-1])))])
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(ordered))
            ranks = np.empty(len(ordered))
            ranks[order] = ((first + 1 + last) / 2 / len(ordered))[np.cumsum(fresh) - 1]
            found[known] = ranks
        return found

    def scored(section: pa.Table) -> pa.Table:
        total = np.zeros(section.num_rows)
        for name, w in parts:
            column = section.column(name).combine_chunks()
            known = column.is_valid().to_numpy(zero_copy_only=False)
            total += ranks_of(column.fill_null(0.0).to_numpy(zero_copy_only=False), known) * w
        return section.select(keep).append_column(out, pa.array(total))

    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(out, T.DoubleType())])
    return narrow.groupBy(*[f"_by{i}" for i in range(len(by))]).applyInArrow(scored, schema)


def percentile_rank(df, by, value, out, desc=False, bound=None) -> DataFrame:
    return percentile_ranks(df, by, {out: (value, desc)}, bound)


def average_ranks(df, by, ranks: dict, bound=None) -> DataFrame:
    """Average-tie ranks, ``{output: column}``."""
    if declared(df, by, bound):
        return df.withColumns({n: _middle_rank(by, col(c)) for n, c in ranks.items()})
    for n, c in ranks.items():
        df = tie_ranks(df, by, col(c), "_ar_", bound)
        df = df.withColumn(n, (F.col("_ar_lo") + F.col("_ar_hi")) / 2).drop("_ar_lo", "_ar_hi", "_ar_n")
    return df


def average_rank(df, by, value, out, bound=None) -> DataFrame:
    return average_ranks(df, by, {out: value}, bound)


def best_rows(df, by, order, k: int) -> DataFrame:
    """First k rows of each group.

    ``row_number <= k`` is what Spark turns into a group limit on both sides of the
    shuffle, so a huge group ships at most k rows per task.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_pick", F.row_number().over(w)).filter(F.col("_pick") <= k).drop("_pick")
