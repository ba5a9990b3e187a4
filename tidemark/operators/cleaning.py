"""Coverage, projection and predicate operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import all_of, holds, minute_of_day, number, truthy
from .policy import gate_column
from .spread import nearby, running

# fixed values: code prefixes of each board
BOARD_PREFIXES = {
    "main_board": ("600", "601", "603", "605", "000", "001", "002", "003"),
    "chinext": ("300",),
    "star": ("688",),
    "bse": ("4", "8", "9"),
}


def coverage_islands(df, key, start="start", end="end", gap_days=1) -> DataFrame:
    """Merge intervals that overlap or lie at most ``gap_days`` apart.

    Equal intervals are one row with a count, so the order is total and both scans see the same.
    An interval without a start follows all others and joins the island before it.
    """
    spans = df.groupBy(*key, start, end).agg(F.count(F.lit(1)).alias("_parts"))
    order = [F.col(start).asc_nulls_last(), F.col(end).asc_nulls_last()]
    seen = running(spans, key, order, {"_reach": ("max", F.col(end))}, current=False)
    opens = F.col("_reach").isNull() | holds(F.datediff(start, "_reach") > gap_days)
    numbered = running(
        seen.withColumn("_new", opens.cast("int")), key, order, {"_island": ("sum", F.col("_new"))}
    )
    return numbered.groupBy(*key, "_island").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.sum("_parts").alias("parts")
    ).drop("_island")


def coverage_gaps(df, key, start, end, lo, hi) -> DataFrame:
    """Days of [lo, hi] that no interval of the key covers, as closed intervals."""
    islands = coverage_islands(df, key, start, end)
    lo, hi = F.to_date(F.lit(lo)), F.to_date(F.lit(hi))

    def build(w):
        return {"_next": F.lead(start).over(w), "_prev": F.lag(end).over(w)}

    seen = nearby(islands, key, [F.col(start)], build, back=1, ahead=1)
    head = F.when(
        F.col("_prev").isNull() & (lo < F.col(start)),
        F.struct(lo.alias("gap_start"), F.date_sub(start, 1).alias("gap_end")),
    )
    after = F.greatest(F.date_add(end, 1), lo)
    until = F.coalesce(F.date_sub("_next", 1), hi)
    tail = F.when(after <= until, F.struct(after.alias("gap_start"), until.alias("gap_end")))
    gaps = seen.select(*key, F.inline(F.array_compact(F.array(head, tail))))
    return gaps


def required_stock_months(df, date, key) -> DataFrame:
    """Months to fetch per key with the days needed; a month holds at most 31 days."""
    month = F.date_format(date, "yyyyMM").alias("month")
    days = df.select(month, *key, F.col(date).cast("date").alias("_d")).distinct()
    return days.groupBy("month", *key).agg(
        F.sort_array(F.collect_list("_d")).alias("days"), F.count(F.lit(1)).alias("n_days")
    )


def coerce_numeric(df, cols) -> DataFrame:
    return df.withColumns({c: number(c) for c in cols})


def coerce_boolean(df, cols, accepted=("1", "true", "yes", "y", "qualified", "pass")) -> DataFrame:
    return df.withColumns({c: truthy(c, accepted) for c in cols})


def normalize_trade_date(df, name, out=None) -> DataFrame:
    """YYYY-MM-DD, YYYYMMDD or YYYYMMDD.0 text to a date, anything else NULL."""
    text = F.regexp_replace(F.trim(F.col(name).cast("string")), r"-|\.0+$", "")
    eight = F.when(text.rlike(r"^\d{8}$"), text)
    return df.withColumn(out or name, F.try_to_date(eight, "yyyyMMdd"))


def parse_event_time(df, name, date, out) -> DataFrame:
    """Read a clock or timestamp text of the day ``date`` by its shape.

    H:MM[:SS], or 4 / 6 digits (clock), or 12 / 14 digits (full stamp). Other readable
    timestamps count only when they fall on the row's own day.
    """
    raw = F.trim(F.col(name).cast("string"))
    raw = F.when(~F.lower(raw).isin("", "0", "none", "nan", "nat", "--"), raw)
    digits = F.regexp_replace(raw, r"\D", "")
    day = F.date_format(date, "yyyyMMdd")
    clock = F.regexp_extract(raw, r"^(\d{1,2}):(\d{2})(?::(\d{2}))?$", 0) != ""
    piece = F.split(raw, ":")
    padded = F.concat(
        F.lpad(piece[0], 2, "0"), piece[1], F.coalesce(F.get(piece, F.lit(2)), F.lit("00"))
    )

    def stamp(text):
        return F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss"))

    free = raw.try_cast("timestamp")
    size = F.length(digits)
    by_shape = (
        F.when(clock, stamp(F.concat(day, padded)))
        .when(size == 4, stamp(F.concat(day, digits, F.lit("00"))))
        .when(size == 6, stamp(F.concat(day, digits)))
        .when(size == 12, stamp(F.concat(digits, F.lit("00"))))
        .when(size == 14, stamp(digits))
    )
    fallback = F.when(F.to_date(free) == F.col(date), free)
    return df.withColumn(out, F.coalesce(by_shape, fallback))


def board_from_code(df, code, out="board", rules=None) -> DataFrame:
    head = F.split(F.col(code).cast("string"), r"\.")[0]
    label = F.lit("other")
    for board, prefixes in reversed((rules or BOARD_PREFIXES).items()):
        label = F.when(head.rlike("^(" + "|".join(prefixes) + ")"), board).otherwise(label)
    return df.withColumn(out, label)


def valid_code_filter(df, code, pattern) -> DataFrame:
    return df.filter(holds(F.col(code).cast("string").rlike(pattern)))


def excluded_code_count(df, code, pattern) -> DataFrame:
    ok = holds(F.col(code).cast("string").rlike(pattern)).cast("int")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(1 - ok).alias("excluded"))


def session_filter(df, time, ranges=(("09:30", "11:30"), ("13:00", "15:00"))) -> DataFrame:
    clock = F.date_format(time, "HH:mm")
    keep = F.lit(False)
    for lo, hi in ranges:
        keep = keep | clock.between(lo, hi)
    return df.filter(keep)


def observation_slots(df, slot_ts, back=6, ahead=1, step="5 minutes", out="obs_ts") -> DataFrame:
    """Rows for the warm-up slots, the slot itself and the execution slot."""
    n, unit = step.split()
    gap = F.expr(f"interval {n} {unit}")
    lo = F.expr(f"{slot_ts} - interval {int(n) * back} {unit}")
    hi = F.expr(f"{slot_ts} + interval {int(n) * ahead} {unit}")
    return df.withColumn(out, F.explode(F.sequence(lo, hi, gap)))


def execution_eligibility(df, gates: dict, barred: list[str] = (), out="execution_eligible") -> DataFrame:
    """Whether a row passes every gate and carries none of the barring flags.

    ``gates`` are named ``(column, sign, limit)`` triples as for ``apply_thresholds``; a NULL
    fails its gate. A NULL flag does not bar.
    """
    open_gates = [gate_column(g) for g in gates.values()]
    return df.withColumn(out, all_of([*open_gates, *[~truthy(flag) for flag in barred]]))


def freshness_gate(df, age, lo=-60, hi=600, null_ok=False, out="fresh") -> DataFrame:
    ok = holds(F.col(age).between(lo, hi))
    return df.withColumn(out, ok | F.col(age).isNull() if null_ok else ok)


def slot_to_minute(df, slot="slot", base="14:20", out="slot_minute") -> DataFrame:
    h, m = base.split(":")
    return df.withColumn(out, minute_of_day(slot) - (int(h) * 60 + int(m)))


def listing_age_days(df, date, listed, out="listing_days") -> DataFrame:
    return df.withColumn(out, F.datediff(date, listed))


def labelled_rows(df, required, flag: Column | None = None) -> DataFrame:
    conds = [F.col(c).isNotNull() for c in required]
    return df.filter(all_of(conds + ([flag] if flag is not None else [])))
