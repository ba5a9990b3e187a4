"""Top-k, first crossing, caps, shortlists, set operations."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hash_int, holds
from . import radix
from .spread import CALENDAR, best_rows, calendar_rows, fits, position

from pyspark.sql import Window


def topk_per_group(df, by, order, k) -> DataFrame:
    return best_rows(df, by, order, k)


def first_crossing(df, cond: Column, day, code, slot_order) -> DataFrame:
    """Earliest qualifying row of each stock-day."""
    return best_rows(df.filter(holds(cond)), [*day, *code], slot_order, 1)


def first_signal_daily_cap(df, cond, day, code, slot, score, k) -> DataFrame:
    """First k distinct stocks of a day in slot order, best score first inside a slot."""
    order = [F.col(slot), F.col(score).desc_nulls_last(), *[F.col(c) for c in code]]
    first = best_rows(df.filter(holds(cond)), [*day, *code], order, 1)
    return best_rows(first, day, order, k)


def score_first_daily_cap(df, cond, day, code, slot, score, k) -> DataFrame:
    """First crossing per stock-day, then the k best scores of the day."""
    best = F.col(score).desc_nulls_last()
    first = best_rows(df.filter(holds(cond)), [*day, *code], [F.col(slot), best], 1)
    return best_rows(first, day, [best, F.col(slot), *[F.col(c) for c in code]], k)


def one_slot_license(slots, rows, day, slot, score, order, n) -> DataFrame:
    """The best slot of each day, then the top n rows of that slot."""
    best = best_rows(slots, day, [F.col(score).desc_nulls_last(), F.col(slot)], 1)
    inside = rows.join(best.select(*day, slot), [*day, slot], "left_semi")
    return best_rows(inside, [*day, slot], order, n)


def _source_flags(df, cs, pk, sources: dict[str, list[Column]], k) -> DataFrame:
    """One boolean per source: row is in that source's top k of its cross-section.

    Small cross-sections rank all sources over one shuffle. Otherwise each source takes
    its own group-limited top k and the short lists are joined back.
    """
    if fits(df, cs):
        ranked = df.withColumns(
            {f"_{n}": F.row_number().over(Window.partitionBy(*cs).orderBy(*o)) for n, o in sources.items()}
        )
        return ranked.withColumns({f"_{n}": F.col(f"_{n}") <= k[n] for n in sources})
    short = reduce(
        DataFrame.unionByName,
        [best_rows(df, cs, o, k[n]).select(*pk, F.lit(n).alias("_source")) for n, o in sources.items()],
    )
    flags = short.groupBy(*pk).agg(
        *[F.max(F.col("_source") == n).alias(f"_{n}") for n in sources]
    )
    return df.join(flags, pk, "left").na.fill(False, [f"_{n}" for n in sources])


def union_topk_prune(df, cs, pk, scores, k, tie, safest=None) -> DataFrame:
    """Rows in the top k of any score; ``safest`` is a column whose smallest values count too."""
    ties = [F.col(c) for c in tie]
    sources = {s: [F.col(s).desc_nulls_last(), *ties] for s in scores}
    if safest:
        sources[safest] = [F.col(safest).asc_nulls_last(), *ties]
    flagged = _source_flags(df, cs, pk, sources, dict.fromkeys(sources, k))
    keep = reduce(lambda a, b: a | b, [F.col(f"_{n}") for n in sources])
    return flagged.filter(keep).drop(*[f"_{n}" for n in sources])


def recall_frontier(df, cs, pk, sources: dict[str, bool], k, explore, seed=0) -> DataFrame:
    """Union of each source's top k and a hash-ordered exploration sample.

    ``sources`` maps a column to True when small values are best. Adds ``from_<source>``,
    ``source_count`` and the sorted source list.
    """
    ties = [F.col(c) for c in pk if c not in cs]
    order = {
        s: [F.col(s).asc_nulls_last() if asc else F.col(s).desc_nulls_last(), *ties]
        for s, asc in sources.items()
    }
    order["exploration"] = [hash_int(*pk, F.lit(seed)), *ties]
    sizes = {**dict.fromkeys(sources, k), "exploration": explore}
    flagged = _source_flags(df, cs, pk, order, sizes)
    for s in sources:
        flagged = flagged.withColumn(f"_{s}", F.col(f"_{s}") & F.col(s).isNotNull())
    names = sorted(order)
    found = F.array_compact(F.array(*[F.when(F.col(f"_{n}"), F.lit(n)) for n in names]))
    out = flagged.withColumn("_found", found).filter(F.size("_found") > 0)
    return out.withColumns(
        {
            **{f"from_{n}": F.col(f"_{n}").cast("int") for n in names},
            "source_count": F.size("_found"),
            "source_list": F.array_join("_found", "|"),
        }
    ).drop("_found", *[f"_{n}" for n in names])


def recall_audit(source, frontier, on, labels: list[str]) -> DataFrame:
    """Share of rows, and of rows with each label, that the frontier keeps."""
    kept = frontier.select(*on).withColumn("_in", F.lit(1))
    joined = source.join(kept, on, "left")
    inside = F.coalesce(F.col("_in"), F.lit(0))
    aggs = [F.count(F.lit(1)).alias("rows"), F.sum(inside).alias("kept"), F.avg(inside).alias("kept_share")]
    for label in labels:
        aggs.append(F.avg(F.when(holds(F.col(label)), inside)).alias(f"{label}_recall"))
    return joined.agg(*aggs)


def dual_cohort_select(df, day, passed, pool, order_q, order_o, n=5) -> DataFrame:
    """All qualified rows ranked, plus the n nearest misses of each day."""
    qualified = position(df.filter(holds(passed)), day, order_q, "cohort_rank")
    near = df.filter(holds(pool) & ~holds(passed))
    w = Window.partitionBy(*day).orderBy(*order_o)
    near = near.withColumn("cohort_rank", F.row_number().over(w)).filter(F.col("cohort_rank") <= n)
    return qualified.withColumn("cohort", F.lit("QUALIFIED")).unionByName(
        near.withColumn("cohort", F.lit("OBSERVATION"))
    )


def nth_threshold(eligible, by, day, score, rate, totals) -> DataFrame:
    """Score of the ``ceil(rate * days)``-th best daily maximum per group.

    ``totals`` has one row per group with ``total_days``. A group without an eligible day
    gets +infinity, which selects nothing.
    """
    daily = eligible.groupBy(*by, day).agg(F.max(score).alias("_top"))
    daily = calendar_rows(daily.filter("_top is not null"), by)
    ranked = position(daily, by, [F.col("_top").desc(), F.col(day)], "_r", bound=CALENDAR)
    seen = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"))
    want = F.greatest(F.lit(1), F.ceil(F.lit(rate) * F.col("total_days")))
    pick = totals.join(seen, by, "left").withColumn("_r", F.least(want, F.col("_m")))
    found = pick.join(ranked.select(*by, "_r", "_top"), [*by, "_r"], "left")
    return found.select(*by, want.cast("int").alias("target_days"), F.coalesce("_top", F.lit(float("inf"))).alias("threshold"))


def deterministic_sample(df, by, pk, n, seed=0) -> DataFrame:
    """First n rows of each group in md5 order, whatever the partitioning."""
    return best_rows(df, by, [hash_int(*pk, F.lit(seed)), *[F.col(c) for c in pk]], n)


def near_miss_policies(metrics, gates: dict[str, tuple[str, str, float]], n=20) -> DataFrame:
    """Policies ordered by gates passed, then by summed relative closeness to the gates."""
    passed, close = F.lit(0), F.lit(0.0)
    for column, sign, limit in gates.values():
        value = F.coalesce(F.col(column), F.lit(float("-inf") if sign == ">=" else float("inf")))
        ok = value >= limit if sign == ">=" else value <= limit
        gap = F.greatest(F.lit(limit) - value if sign == ">=" else value - F.lit(limit), F.lit(0.0))
        passed = passed + ok.cast("int")
        close = close - F.least(gap / max(abs(limit), 1e-9), F.lit(1.0))
    return (
        metrics.withColumns({"passed_gates": passed, "proximity": close})
        .orderBy(F.desc("passed_gates"), F.desc("proximity"), "policy").limit(n)
    )


#: Points that a task holds to prune with; the pruning needn't find all dominated ones.
_PRUNERS = 256


def _pruned(batches):
    """Points of one task that none of its first good ones dominates: less to shuffle, nothing lost."""
    front = None
    for pdf in batches:
        v = pdf.to_numpy()
        if front is None:
            front = v[np.argsort(-v.sum(axis=1), kind="stable")[:_PRUNERS]]
        worse = np.zeros(len(v), bool)
        for p in front:
            worse |= (p >= v).all(axis=1) & (p > v).any(axis=1)
        yield pdf[~worse]


def _undominated(points: DataFrame, dims: list[str]) -> DataFrame:
    """Distinct points that no other one is at least as large as in every dimension; one to three of these.

    One: the largest. Two: down the first, the second must exceed all before it. Three: points
    with equal firsts are two-dimensional; for the others the ranks of the firsts are halved again
    and again, and on each level the half with larger firsts is laid over the other one, which is
    two-dimensional too. A point is in one half a level, so ``n`` points make ``n log n`` rows.
    """
    if len(dims) == 1:
        return points.agg(F.max(dims[0]).alias(dims[0])).where(F.col(dims[0]).isNotNull())
    *keys, last = dims
    best = points.groupBy(*keys).agg(F.max(last).alias(last))
    above = radix.running_max(best, keys[:-1], -F.col(keys[-1]), last, "_above", inclusive=False)
    best = above.where(F.col("_above").isNull() | (F.col(last) > F.col("_above"))).drop("_above")
    if len(dims) == 2:
        return best
    first, second = keys
    ranks = radix.prefix_sums(best.select((-F.col(first)).alias("_down")).distinct().withColumn("_one", F.lit(1)), [], "_down", ["_one"])
    ranked = best.join(ranks, -F.col(first) == F.col("_down")).withColumn("_r", F.col("_one_before").cast("bigint"))
    levels = F.sequence(F.lit(0), F.floor(F.log2(F.col("_one_total"))).cast("int"))
    halved = ranked.select(*dims, "_r", F.explode(levels).alias("_level")).select(
        *dims, "_level", F.expr("shiftright(_r, _level + 1)").alias("_block"), (F.expr("shiftright(_r, _level)") % 2 == 1).alias("_under"),
    )
    halved = halved.withColumn("_over", F.when(~F.col("_under"), F.col(last)))
    covered = radix.running_max(halved, ["_level", "_block"], -F.col(second), "_over", "_above", inclusive=True)
    gone = covered.where("_under").groupBy(*dims).agg(F.max((F.col("_above") >= F.col(last)).cast("int")).alias("_gone")).where("_gone = 1")
    return best.join(gone, dims, "left_anti")


def pareto_mask(df, maximise: list[str], out="efficient") -> DataFrame:
    """Flag rows that no other row dominates, in one to three measures; nulls are the worst value.

    Tasks first drop points that a few of their own dominate; what is left goes through prefix
    maxima over value buckets (``_undominated``), so no task holds a front and no pairs are formed.
    """
    if not 1 <= len(maximise) <= 3:
        raise ValueError("one to three measures")
    low = F.lit(float("-inf"))
    values = df.select(*[F.coalesce(F.col(c).cast("double"), low).alias(f"_m_{c}") for c in maximise]).distinct()
    dims = values.columns
    values = values.mapInPandas(_pruned, ", ".join(f"`{c}` double" for c in dims)).distinct()
    marked = _undominated(values, dims).select(*dims, F.lit(True).alias("_front"))
    on = [F.coalesce(F.col(c).cast("double"), low) == F.col(f"_m_{c}") for c in maximise]
    joined = df.join(marked, reduce(lambda a, b: a & b, on), "left")
    return joined.withColumn(out, F.col("_front").isNotNull()).drop("_front", *dims)


def union_families(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedup_keep_last(df, key, order) -> DataFrame:
    return best_rows(df, key, [F.col(o).desc() if isinstance(o, str) else o for o in order], 1)


def exact_dedup(df) -> DataFrame:
    return df.distinct()


def identity_intersection(a, b, on) -> DataFrame:
    return a.select(*on).intersect(b.select(*on))


def identity_difference(a, b, on) -> DataFrame:
    """Set difference of identities (each identity once)."""
    return a.select(*on).subtract(b.select(*on))
