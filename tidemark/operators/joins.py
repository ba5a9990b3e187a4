"""Join operators: declared cardinality, as-of, intervals, calendar offsets, grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import holds
from .spread import declared, running


def unique_rows(df: DataFrame, on: list[str], side: str) -> DataFrame:
    """``df``, failing when it is read if a key has more than one row; no job of its own.

    The count is a window over the join's own keys, so the join needs no further shuffle.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*on))
    key = F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in on])
    message = F.concat(F.lit(f"{side} side has "), n.cast("string"), F.lit(" rows for "), key)
    return df.withColumn("_one", F.when(n > 1, F.raise_error(message)).otherwise(F.lit(True))).where("_one").drop("_one")


def left_join_checked(left, right, on, validate="m:1") -> DataFrame:
    if validate not in ("1:1", "m:1"):
        raise ValueError(f"unknown cardinality {validate}")
    if validate == "1:1":
        left = unique_rows(left, on, "left")
    return left.join(unique_rows(right, on, "right"), on, "left")


def inner_join_identities(left, ids, on) -> DataFrame:
    """Restrict to the required identities; reading it fails when one has no row."""
    found = ids.select(*on).distinct().join(left.withColumn("_hit", F.lit(True)), on, "left")
    key = F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in on])
    lost = F.raise_error(F.concat(F.lit("missing identity "), key))
    return found.withColumn("_hit", F.when(F.col("_hit").isNull(), lost).otherwise(F.col("_hit"))).where("_hit").select(*left.columns)


def outer_join_families(frames, on) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, "full"), frames)


def semi_join_universe(df, universe, on) -> DataFrame:
    return df.join(universe, on, "left_semi")


def anti_join_missing(df, universe, on) -> DataFrame:
    return df.join(universe, on, "left_anti")


def asof_join_backward(left, right, by, l_time, r_time, cols, tie=(), tolerance=None) -> DataFrame:
    """Latest right row with ``r_time <= l_time`` per key, equal times included.

    Both sides are stacked and the last right row is carried down, so the work is one
    shuffle and one scan whatever the match distance; sides that both lie by keys of ``by``
    are not shuffled again. Adds ``cols``, ``asof_time`` and ``lag_minutes``; a match older
    than ``tolerance`` seconds is dropped.
    """
    # a second copy of a key inside the row would hide how the side is dealt
    rest = [c for c in left.columns if c not in by] or by
    hit = F.struct(F.col(r_time).alias("asof_time"), *cols)
    ties = [f"_tie{i}" for i in range(len(tie))]
    right_rows = right.select(
        *by, F.col(r_time).alias("_t"), F.lit(0).alias("_side"),
        *[F.col(c).alias(n) for c, n in zip(tie, ties)], hit.alias("_hit"),
    )
    left_rows = left.select(
        *by, F.col(l_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*rest).alias("_row")
    )
    stacked = left_rows.unionByName(right_rows, allowMissingColumns=True)
    order = [F.col("_t"), F.col("_side"), *[F.col(n) for n in ties]]
    filled = running(stacked, by, order, {"_hit": ("last", F.col("_hit"))}).filter("_side = 1")
    seconds = F.timestamp_diff("SECOND", F.col("_hit.asof_time"), F.col("_t"))
    if tolerance is not None:
        filled = filled.withColumn("_hit", F.when(seconds <= tolerance, F.col("_hit")))
    own = [F.col(c).cast(left.schema[c].dataType).alias(c) if c in by else F.col(f"_row.{c}") for c in left.columns]
    return filled.select(*own, "_hit.*", (seconds / 60).alias("lag_minutes"))


def _newest(a: Column, b: Column) -> Column:
    return F.when(holds(b["_from"] >= a["_from"]) | a.isNull(), b).otherwise(a)


#: Sizes of cells: powers of two of a day, up to some 1,400 years.
_CELL_SIZES = 20


def _aligned(k: Column) -> Column:
    """The cells of size ``2**k`` of the days ``[_s, _e)``: those at its ends that no larger cell takes."""
    size = F.pow(F.lit(2.0), k)
    a, b = F.ceil(F.col("_s") / size), F.floor(F.col("_e") / size)
    cell = lambda at: F.struct(k.alias("_k"), at.cast("bigint").alias("_at"))
    return F.array_compact(F.array(F.when((a < b) & (a % 2 == 1), cell(a)), F.when((a < b) & (b % 2 == 1), cell(b - 1))))


def _covered(asked: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """The asked rows that meet a cell, with its ``_closed``.

    Keys of a declared size: cells are stacked on the rows, which stay where they lie. Other keys take a join.
    """
    if not declared(asked, by):
        return asked.join(cells, [*by, "_k", "_at"])
    stacked = asked.withColumn("_asked", F.lit(True)).unionByName(cells.repartition(*by), allowMissingColumns=True)
    met = stacked.withColumn("_closed", F.max("_closed").over(Window.partitionBy(*by, "_k", "_at")))
    known = F.col("_asked") & F.col("_closed").isNotNull()
    for b in by:
        known = known & F.col(b).isNotNull()
    return met.where(known)


def asof_join_interval(left, right, by, date, lo, hi, cols, pk, end_inclusive=False) -> DataFrame:
    """Among intervals active on the day, the one that started last; NULL when none is.

    Open intervals never expire, so they are a plain as-of lookup. A closed interval is cut into
    aligned cells of one, two, four, ... days, at most two of a size; of the intervals that cover a
    whole cell only the one that started last can win, so a cell is one row. A day is looked up in
    its cell of every size: each lookup meets one row at most, whatever the intervals overlap.
    """
    still = right.filter(F.col(hi).isNull())
    if declared(left, by):
        still = still.repartition(*by)
    base = asof_join_backward(
        left, still.withColumn("_from", F.col(lo)), by, date, lo, ["_from", *cols]
    ).drop("asof_time", "lag_minutes")
    base = base.select(*left.columns, F.when(F.col("_from").isNotNull(), F.struct("_from", *cols)).alias("_open"))
    sizes = F.sequence(F.lit(0), F.lit(_CELL_SIZES - 1))
    day = lambda c: F.unix_date(F.to_date(c)).cast("bigint") + (1 << _CELL_SIZES)
    closed = right.filter(F.col(hi) >= F.col(lo)).withColumns({"_s": day(F.col(lo)), "_e": day(F.col(hi)) + (1 if end_inclusive else 0)})
    cells = closed.select(*by, F.col(lo).alias("_from"), *cols, F.explode(F.flatten(F.transform(sizes, _aligned))).alias("_cell"))
    cells = cells.groupBy(*by, "_cell._k", "_cell._at").agg(F.max(F.struct("_from", *cols)).alias("_closed"))
    dated = left.select(*pk, *[b for b in by if b not in pk], *([date] if date not in pk else []))
    asked = dated.withColumn("_d", day(F.col(date))).select("*", F.explode(sizes).alias("_k")).withColumn("_at", F.expr("shiftright(_d, _k)"))
    active = _covered(asked, cells, by).groupBy(*pk).agg(F.max("_closed").alias("_closed"))
    both = base.join(active, pk, "left").withColumn("_win", _newest(F.col("_open"), F.col("_closed")))
    both = both.withColumn("_win", F.when(F.col("_closed").isNull(), F.col("_open")).otherwise(F.col("_win")))
    return both.select(*left.columns, F.col("_win._from").alias("active_from"), *[f"_win.{c}" for c in cols])


def interval_flag_join(left, right, by, date, lo, hi, fallback: Column, out="flag") -> DataFrame:
    """True when any closed interval [lo, hi] of the key covers the day.

    Starts count +1 and ends -1 on the stacked rows, so overlaps need no pair-wise test.
    Keys without a single interval take ``fallback``.
    """
    rows = left.select(
        *by, F.col(date).alias("_t"), F.lit(1).alias("_side"), F.lit(0).alias("_step"),
        F.struct(*left.columns).alias("_row"),
    )
    starts = right.select(*by, F.col(lo).alias("_t"), F.lit(0).alias("_side"), F.lit(1).alias("_step"))
    ends = right.filter(F.col(hi).isNotNull()).select(
        *by, F.col(hi).alias("_t"), F.lit(2).alias("_side"), F.lit(-1).alias("_step")
    )
    stacked = rows.unionByName(starts, True).unionByName(ends, True)
    swept = running(stacked, by, [F.col("_t"), F.col("_side")], {"_open": ("sum", F.col("_step"))})
    flagged = swept.filter("_side = 1").select("_row.*", (F.col("_open") > 0).alias("_on"))
    known = right.select(*by).distinct().withColumn("_known", F.lit(True))
    joined = flagged.join(known, by, "left")
    return joined.withColumn(out, F.when(F.col("_known"), F.col("_on")).otherwise(holds(fallback))).drop("_on", "_known")


def shifted_days(calendar, steps, day="day", out="source_day") -> DataFrame:
    """(day, source_day) with the source ``steps`` open days earlier (negative: later)."""
    a = calendar.select(day, (F.col("idx") - steps).alias("_at"))
    b = calendar.select(F.col(day).alias(out), F.col("idx").alias("_at"))
    return a.join(b, "_at").drop("_at")


def prev_period_join(left, right, calendar, on, lag=1, day="day") -> DataFrame:
    """Facts of the open day ``lag`` days before, by calendar and not by row."""
    # one row an open day: a broadcast, where a shuffle by day would send every row
    dated = left.join(F.broadcast(shifted_days(calendar, lag, day)), day, "left")
    facts = right.withColumnRenamed(day, "source_day")
    return dated.join(facts, [*on, "source_day"], "left")


def next_period_join(left, right, calendar, on, lead=1, day="day") -> DataFrame:
    return prev_period_join(left, right, calendar, on, -lead, day)


def exact_offset_join(df, key, time, offset, cols) -> DataFrame:
    """Values of the same key at exactly ``time + offset`` (an interval text)."""
    past = df.select(
        *key, F.expr(f"{time} - interval {offset}").alias(time), *[F.col(c).alias(f"{c}_at") for c in cols]
    )
    return df.join(past, [*key, time], "left")


def micros(time) -> Column:
    """A stamp as a long, for ranges of a window."""
    return F.unix_micros((F.col(time) if isinstance(time, str) else time).cast("timestamp"))


def interval_micros(spark, text: str) -> int:
    """Microseconds of an interval text of days or less."""
    start = "timestamp_ntz'1970-01-01 00:00:00'"
    return spark.sql(f"SELECT timestampdiff(MICROSECOND, {start}, {start} + interval {text}) AS n").first()[0]


def session_offset_values(df, by, time, offset, cols) -> DataFrame:
    """As ``exact_offset_join`` for stamps of one session: a range of a single stamp, no join."""
    at = interval_micros(df.sparkSession, offset)
    w = Window.partitionBy(*by).orderBy(micros(time)).rangeBetween(at, at)
    known = F.col(time).isNotNull()
    for k in by:
        known = known & F.col(k).isNotNull()
    return df.withColumns({f"{c}_at": F.when(known, F.max(c).over(w)) for c in cols})


def lookback_join(left, events, calendar, by, k, day="day") -> DataFrame:
    """Events of the k previous open days with their age in open days.

    Each event is copied to the k days it is visible on, so the match is an equi-join.
    """
    ahead = calendar.select(F.col(day).alias("event_day"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("age"), "idx")
    target = ahead.withColumn("_at", F.col("idx") + F.col("age")).drop("idx").join(
        calendar.select(day, F.col("idx").alias("_at")), "_at"
    ).drop("_at")
    visible = events.withColumnRenamed(day, "event_day").join(target, "event_day")
    return left.join(visible, [*by, day])


def time_aligned_pair_join(a, b, on) -> DataFrame:
    return unique_rows(a, on, "first").join(unique_rows(b, on, "second"), on)


def mapped_code_join(series, mapping, specs, day="day", code="code") -> DataFrame:
    """Generic code to the day's dated contract to its series; a mapping must be unique."""
    return (
        specs.join(unique_rows(mapping, [day, "generic"], "mapping"), "generic").join(
            series.withColumnRenamed(code, "contract"), [day, "contract"], "left"
        )
    )


def grid_rows(grid: list[dict]) -> Column:
    """A configured threshold grid as an array of structs; its size is set by the caller."""
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in row.items()]) for row in grid])


def grid_cross_join(df, grid: list[dict], pass_expr, loosest: Column | None = None) -> DataFrame:
    """Candidate rows once per grid row they pass.

    ``loosest`` drops rows that fail every grid row before they are copied.
    """
    if loosest is not None:
        df = df.filter(holds(loosest))
    return df.select("*", F.inline(grid_rows(grid))).filter(holds(pass_expr))


def bounded_array(column: Column, largest: int) -> Column:
    """An array column that fails the query where it is longer than declared."""
    message = F.concat(F.lit("a cross-section has more rows than declared: "), F.size(column).cast("string"))
    return F.when(F.size(column) > largest, F.raise_error(message)).otherwise(column)


def pairwise_self_join(df, cs, key, features, target, largest=64) -> DataFrame:
    """Difference examples from all labelled rows of each cross-section.

    The caller brings a shortlist (``topk_per_group``). A cross-section of more than
    ``largest`` rows fails, so pairs are built inside one small array and no join is
    needed. Pairs with equal targets are skipped.
    """
    short = df.filter(F.col(target).isNotNull())
    fields = F.struct(*[F.col(c).alias(f"k_{c}") for c in key], F.col(target).alias("_y"), *features)
    packed = short.groupBy(*cs).agg(F.sort_array(F.collect_list(fields)).alias("_m"))
    packed = packed.withColumn("_m", bounded_array(F.col("_m"), largest))
    left = packed.select(*cs, "_m", F.posexplode("_m").alias("_i", "_a"))
    right = F.explode(F.slice("_m", F.col("_i") + 2, F.greatest(F.size("_m") - F.col("_i") - 1, F.lit(0))))
    pairs = left.select(*cs, F.size("_m").alias("_n"), "_a", right.alias("_b"))
    a, b = F.col("_a"), F.col("_b")
    close = F.abs(a["_y"] - b["_y"]) <= 1e-8 + 1e-5 * F.abs(b["_y"])
    return pairs.filter(~close).select(
        *cs,
        *[a[f"k_{c}"].alias(f"{c}_a") for c in key],
        *[b[f"k_{c}"].alias(f"{c}_b") for c in key],
        *[(a[f] - b[f]).alias(f) for f in features],
        (a["_y"] > b["_y"]).cast("int").alias("label"),
        (F.lit(1.0) / (F.col("_n") * (F.col("_n") - 1))).alias("weight"),
    )


def session_forward_bar_join(df, bars, by, delta, time="ts", cols=("close",)) -> DataFrame:
    """The bar stamped exactly ``time + delta``; a duplicate stamp keeps the last row."""
    pick = bars.select(*by, F.expr(f"{time} - interval {delta}").alias(time), *[F.col(c).alias(f"fwd_{c}") for c in cols])
    return df.join(pick, [*by, time], "left")


def identity_overlap_compare(a, b, on) -> DataFrame:
    left = a.select(*on).distinct().withColumn("_l", F.lit(1))
    right = b.select(*on).distinct().withColumn("_r", F.lit(1))
    both = left.join(right, on, "full")
    return both.agg(
        F.count(F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), 1)).alias("common"),
        F.count(F.when(F.col("_r").isNull(), 1)).alias("only_left"),
        F.count(F.when(F.col("_l").isNull(), 1)).alias("only_right"),
    )
