"""Data-quality contracts as jobs: each returns violations or metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hash_int, holds, ratio, share
from .spread import best_rows, group_table

# fixed values: name parts that give away an outcome
OUTCOME_TOKENS = ("target", "label", "net_return", "gross_return", "exit_", "t1_", "future", "next_")


def _count():
    return F.count(F.lit(1))


def _n(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def assert_unique(df, key, examples=5) -> DataFrame:
    """Duplicate identities: how many, and the first few of them."""
    dup = df.groupBy(*key).agg(_count().alias("_n")).filter("_n > 1")
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    total = dup.agg(_count().alias("duplicates"))
    few = best_rows(dup.select(F.lit(1).alias("_g"), text.alias("_t")), ["_g"], [F.col("_t")], examples)
    few = few.groupBy("_g").agg(F.array_join(F.sort_array(F.collect_list("_t")), ",").alias("examples"))
    return total.withColumn("_g", F.lit(1)).join(few, "_g", "left").drop("_g").na.fill("", ["examples"])


def assert_outcome_blind(df, tokens=OUTCOME_TOKENS) -> None:
    """Schema check only; raises when a column name carries an outcome token."""
    bad = sorted(c for c in df.columns if any(t in c.lower() for t in tokens))
    if bad:
        raise ValueError(f"outcome-bearing columns: {bad}")


def assert_causal(df, source, signal, strict=False, by=()) -> DataFrame:
    """Rows whose source is later than the signal (or not earlier, if strict)."""
    late = F.col(source) >= F.col(signal) if strict else F.col(source) > F.col(signal)
    return df.groupBy(*by).agg(
        _count().alias("rows"), F.coalesce(F.sum(share(late)), F.lit(0.0)).cast("bigint").alias("violations"),
        _n(F.col(source).isNull()).alias("missing"),
    )


def universe_coverage(df, expected, day, code, minimum) -> DataFrame:
    """Per day: expected codes, those observed, coverage and whether it suffices."""
    seen = df.select(day, code).distinct().withColumn("_seen", F.lit(1))
    t = expected.select(day, code).distinct().join(seen, [day, code], "left").groupBy(day).agg(
        _count().alias("expected"), F.count("_seen").alias("observed")
    )
    return t.withColumn("coverage", ratio("observed", "expected")).withColumn("passed", F.col("coverage") >= minimum)


def snapshot_gap_list(df, eligible, on, min_n) -> DataFrame:
    """Eligible identities with fewer than ``min_n`` snapshots."""
    have = df.groupBy(*on).agg(_count().alias("snapshots"))
    return eligible.select(*on).distinct().join(have, on, "left").na.fill(0, ["snapshots"]).filter(F.col("snapshots") < min_n)


def feature_coverage(df, features, minimum=0.95) -> DataFrame:
    """Non-null rate per feature and of complete rows, from one wide aggregate."""
    full = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features])
    items = [F.struct(F.lit(f).alias("feature"), F.avg(F.col(f).isNotNull().cast("int")).alias("coverage")) for f in features]
    items.append(F.struct(F.lit("complete_rows").alias("feature"), F.avg(full.cast("int")).alias("coverage")))
    return df.agg(F.array(*items).alias("_a")).select(F.inline("_a")).withColumn("passed", F.col("coverage") >= minimum)


def coverage_breakdown(df, by, count_col, shallow, features) -> DataFrame:
    """Why rows are incomplete: no peers, thin group, or only some features missing."""
    full = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features])
    n = F.coalesce(F.col(count_col), F.lit(0))
    return group_table(
        df, list(by),
        {
            "rows": _count(), "complete": _n(full), "no_peers": _n(n == 0), "shallow": _n((n > 0) & (n < shallow)),
            "other_missing": _n((n >= shallow) & ~full), "median_peers": ("quantile", n, 0.5), "q10_peers": ("quantile", n, 0.1),
        },
    ).withColumn("complete_rate", ratio("complete", "rows"))


def activity_coverage(df, day, flags) -> DataFrame:
    """Share of rows, and of days, on which each flag is set."""
    per_day = df.groupBy(day).agg(_count().alias("_n"), *[F.sum(share(F.col(f) > 0)).alias(f"_s_{f}") for f in flags])
    items = [
        F.struct(
            F.lit(f).alias("flag"), ratio(F.sum(f"_s_{f}"), F.sum("_n")).alias("row_rate"), F.avg(share(F.col(f"_s_{f}") > 0)).alias("day_rate"))
        for f in flags
    ]
    return per_day.agg(F.array(*items).alias("_a")).select(F.inline("_a"))


def feature_parity(a, b, pk, features, atol=1e-9) -> DataFrame:
    """Compare two builds on common identities, per feature."""
    left = a.select(*pk, *[F.col(f).alias(f"_a_{f}") for f in features], F.lit(1).alias("_l"))
    right = b.select(*pk, *[F.col(f).alias(f"_b_{f}") for f in features], F.lit(1).alias("_r"))
    both = left.join(right, pk, "full")
    common = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    items = []
    for f in features:
        x, y = F.col(f"_a_{f}"), F.col(f"_b_{f}")
        off = (x.isNull() != y.isNull()) | holds(F.abs(x - y) > atol)
        items.append(F.struct(
            F.lit(f).alias("feature"), _n(common).alias("common"), _n(common & off).alias("mismatches"),
            F.max(F.when(common, F.abs(x - y))).alias("max_abs_diff"), _n(F.col("_r").isNull()).alias("only_left"), _n(F.col("_l").isNull()).alias("only_right")))
    return both.agg(F.array(*items).alias("_a")).select(F.inline("_a"))


def feature_diversity(df, features, least=10, exact=True) -> DataFrame:
    """Distinct values per feature; the sketch form avoids the distinct shuffle."""
    distinct = F.countDistinct if exact else F.approx_count_distinct
    items = [F.struct(F.lit(f).alias("feature"), distinct(f).alias("distinct_values")) for f in features]
    return df.agg(F.array(*items).alias("_a")).select(F.inline("_a")).withColumn("diverse", F.col("distinct_values") >= least)


def tape_audit(df, by, day, code, time, key, pattern, expected_day: Column, ordered: Column) -> DataFrame:
    """Event-feed checks per feed: codes, dates, duplicates, parse rate, time order."""
    counts = df.groupBy(*by).agg(
        _count().alias("rows"), _n(~holds(F.col(code).cast("string").rlike(pattern))).alias("bad_codes"),
        _n(~holds(F.col(day) == expected_day)).alias("wrong_day"), F.avg(F.col(time).isNotNull().cast("int")).alias("parse_rate"),
        _n(~holds(ordered)).alias("disordered"),
    )
    dup = df.groupBy(*by, *key).agg(_count().alias("_n")).groupBy(*by).agg(F.sum(F.col("_n") - 1).alias("duplicates"))
    return counts.join(dup, list(by))


def ohlc_consistency(df, by=(), o="open", h="high", lo="low", c="close") -> DataFrame:
    present = reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in (o, h, lo, c)])
    high_ok = F.col(h) >= F.greatest(o, lo, c)
    low_ok = F.col(lo) <= F.least(o, h, c)
    return df.groupBy(*by).agg(
        _count().alias("rows"), _n(~present).alias("missing"), _n(present & ~high_ok).alias("high_violations"), _n(present & ~low_ok).alias("low_violations")
    )


def cross_section_probe(df, day, code, required, cols, min_rows) -> DataFrame:
    """Per date: rows, duplicates, required codes present, worst numeric coverage, verdict."""
    per_code = df.groupBy(day, code).agg(_count().alias("_n"), *[F.count(c).alias(f"_k_{c}") for c in cols])
    t = per_code.groupBy(day).agg(
        F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("duplicates"), _n(F.col(code).isin(*required)).alias("required_present"),
        *[F.sum(f"_k_{c}").alias(f"_k_{c}") for c in cols],
    )
    rates = [ratio(f"_k_{c}", "rows") for c in cols]
    t = t.withColumn("numeric_coverage", F.least(*rates) if len(rates) > 1 else rates[0])
    ok = (F.col("rows") >= min_rows) & (F.col("duplicates") == 0) & (F.col("required_present") == len(required))
    return t.withColumn("passed", ok).drop(*[f"_k_{c}" for c in cols])


def stock_slot_audit(df, cs, code, groups, cols, least) -> DataFrame:
    """Per slot: rows, codes, coverage of each column and number of large groups."""
    base = df.groupBy(*cs).agg(
        _count().alias("rows"), F.countDistinct(code).alias("codes"),
        *[F.avg(F.col(c).isNotNull().cast("int")).alias(f"{c}_coverage") for c in cols],
    )
    for g in groups:
        sizes = df.filter(F.col(g).isNotNull()).groupBy(*cs, g).agg(F.countDistinct(code).alias("_n"))
        base = base.join(sizes.groupBy(*cs).agg(_n(F.col("_n") >= least).alias(f"{g}_large_groups")), list(cs), "left")
    return base.na.fill(0, [f"{g}_large_groups" for g in groups])


def mapping_exactness(df, dates, specs: list, day, name) -> DataFrame:
    """Expected (date x spec) set against the mapping; specs are a configured list."""
    want = dates.select(day).distinct().withColumn(name, F.explode(F.array(*[F.lit(s) for s in specs]))).withColumn("_w", F.lit(1))
    have = df.groupBy(day, name).agg(_count().alias("_h"))
    both = want.join(have, [day, name], "full")
    return both.agg(
        _n(F.col("_w") == 1).alias("expected"), _n(F.col("_h").isNotNull()).alias("mapped"), _n(F.col("_h").isNull()).alias("missing"),
        _n(F.col("_w").isNull()).alias("unexpected"), _n(F.col("_h") > 1).alias("ambiguous"),
    )


def outcome_consistency(df, ret, label, by=()) -> DataFrame:
    """Label must be known with the return and equal to (return > 0)."""
    r, y = F.col(ret), F.col(label)
    return df.groupBy(*by).agg(
        _count().alias("rows"), _n(r.isNull() != y.isNull()).alias("availability_mismatch"),
        _n(r.isNotNull() & (y.cast("int") != (r > 0).cast("int"))).alias("label_mismatch"),
    )


def ledger_invariants(ledger, day, code, cohort="cohort", status="status", price="entry_price", declared=None) -> DataFrame:
    """Violations per rule: unique and disjoint cohorts, counts as declared, status against price."""
    per = ledger.groupBy(day, code).agg(_count().alias("_n"), F.countDistinct(cohort).alias("_c"))
    keys = per.agg(_n(F.col("_c") > 1).alias("cohorts_overlap"), _n(F.col("_n") > F.col("_c")).alias("duplicate_candidate"))
    s, p = F.col(status), F.col(price)
    rows = ledger.agg(
        _n((s == "SETTLED") & ~holds(p > 0)).alias("settled_without_price"),
        _n((s == "NON_FILL") & p.isNotNull()).alias("non_fill_with_price"),
        _n(~holds(s.isin("PENDING", "SETTLED", "NON_FILL"))).alias("unknown_status"),
    )
    parts = [(keys, ("cohorts_overlap", "duplicate_candidate")), (rows, ("settled_without_price", "non_fill_with_price", "unknown_status"))]
    if declared is not None:
        have = ledger.groupBy(day).agg(_count().alias("_have"))
        off = declared.join(have, day, "full").agg(
            _n(~F.coalesce("_have", F.lit(0)).eqNullSafe(F.coalesce("candidates", F.lit(0)))).alias("count_mismatch"))
        parts.append((off, ("count_mismatch",)))
    longs = [f.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in names]))) for f, names in parts]
    return reduce(DataFrame.unionByName, longs)


def table_digest(df, by, cols=None) -> DataFrame:
    """Order-free content digest per partition: row count and summed row hashes.

    Each row is rendered to one text with NULLs marked; sums do not depend on row order
    or partitioning. The 60-bit hashes are summed as decimals, so nothing overflows.
    """
    names = sorted(c for c in (cols or df.columns))
    text = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in names]
    return df.groupBy(*by).agg(
        _count().alias("rows"), (F.sum(hash_int(*text).cast("decimal(38,0)")) % F.lit(2**61 - 1)).cast("bigint").alias("digest")
    )


def shard_completeness(df, manifest, shard, day) -> DataFrame:
    """Row counts and day bounds of each shard against its manifest row."""
    have = df.groupBy(shard).agg(_count().alias("_rows"), F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    both = manifest.join(have, shard, "full")
    same = (F.col("rows") == F.col("_rows")) & (F.col("first_day") == F.col("_lo")) & (F.col("last_day") == F.col("_hi"))
    status = (
        F.when(F.col("_rows").isNull(), "missing").when(F.col("rows").isNull(), "unexpected").when(holds(same), "complete").otherwise("mismatch")
    )
    return both.select(shard, F.col("rows").alias("declared_rows"), F.col("_rows").alias("actual_rows"), status.alias("status"))


def evaluation_window(df, day, start, end, strict=True) -> DataFrame:
    """Rows of [start, end]; fails unless both boundary days have rows."""
    lo, hi = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    if strict:
        edge = df.filter(F.col(day).isin(lo, hi)).select(day).distinct().count()
        if edge < len({str(start), str(end)}):
            raise ValueError(f"evaluation window {start}..{end} is not covered at both ends")
    return df.filter(F.col(day).between(lo, hi))


def calendar_depth(calendar, start, required, day="day") -> DataFrame:
    """Open days before the evaluation start against the warm-up they must cover."""
    t = calendar.agg(_n(F.col(day) < F.to_date(F.lit(start))).alias("available_days"))
    return t.withColumns({"required_days": F.lit(required), "sufficient": F.col("available_days") >= required})
