"""Delayed-execution outcomes: fills, three-way labels, exit contracts, truth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import all_of, holds, pct, ratio
from .joins import unique_rows
from .spread import group_table, group_values, measured_once, percentile_ranks


@dataclass(frozen=True)
class Execution:
    """Execution contract; the defaults are the published ones."""

    slippage_bps: float = 10.0
    cost_bps: float = 25.0
    non_fill_penalty: float = -10.0
    severe_loss: float = -2.0
    min_amount: float = 50_000.0
    max_share_of_amount: float = 0.10
    order_notional: float = 5_000.0
    min_dist_up: float = 0.5
    min_dist_down: float = 0.5
    top_fraction: float = 0.2

    @property
    def cost_pct(self):
        return self.cost_bps / 100


def entry_fillable(df, cfg: Execution, price="entry_price", amount="entry_amount", dist="entry_dist_up", lag="entry_lag", out="entry_ok") -> DataFrame:
    """Exact bar, positive price, enough amount for the order, away from the up limit."""
    return df.withColumn(
        out,
        all_of([
            F.col(price) > 0,
            F.col(amount) >= cfg.min_amount,
            F.col(amount) * cfg.max_share_of_amount >= cfg.order_notional,
            F.col(dist) >= cfg.min_dist_up,
            F.col(lag) == 0,
        ]),
    )


def exit_fillable(df, close="t1_close", vol="t1_vol", down="t1_down_limit", out="exit_ok") -> DataFrame:
    free = F.col(down).isNull() | (F.col(close) > F.col(down) * 1.0001)
    return df.withColumn(out, all_of([F.col(close).isNotNull(), F.col(vol) > 0, free]))


@measured_once
def supervised_labels(df, cs, cfg: Execution, eligible="eligible", entry_ref="entry_ref", exit_price="exit_price", signal="price", truth=None) -> DataFrame:
    """Three-way outcome labels; rows whose truth is not out yet stay NULL.

    Entry miss: return 0. Failed exit: penalty and severe. Round trip: net return after
    slippage and cost. Only the round trip needs ``eligible``.
    """
    entry, leave, ok = holds(F.col("entry_ok")), holds(F.col("exit_ok")), holds(F.col(eligible))
    paid = F.col(entry_ref) * (1 + cfg.slippage_bps / 10_000)
    gross = pct(exit_price, paid)
    exit_known = holds(F.col(exit_price) > 0) | ~leave
    if truth is not None:
        exit_known = exit_known & holds(F.col(truth))
    known = holds(F.col(signal) > 0) & (holds(F.col(entry_ref) > 0) | ~entry) & (~entry | exit_known)
    df = df.withColumns({"entry_price": paid, "conditional_gross": gross, "conditional_net": gross - cfg.cost_pct, "label_available": known})
    df = df.withColumn("round_trip", ok & entry & leave & known)
    seen, trip, net = F.col("label_available"), F.col("round_trip"), F.col("conditional_net")
    positive, severe = (net > 0).cast("int"), (net <= cfg.severe_loss).cast("int")
    df = df.withColumns(
        {
            "target_entry": F.when(seen, entry.cast("int")),
            "target_exit": F.when(seen & entry, leave.cast("int")),
            "gross_return": F.when(trip, F.col("conditional_gross")).when(seen & ~entry, 0.0),
            "net_return": F.when(trip, net).when(seen & ~entry, 0.0).when(seen & entry & ~leave, cfg.non_fill_penalty),
            "target_positive": F.when(seen, F.coalesce(F.when(trip, positive), F.lit(0))),
            "target_severe": F.when(seen, F.when(entry & ~leave, 1).when(trip, severe).otherwise(0)),
            "target_conditional_positive": F.when(trip, positive),
            "target_conditional_severe": F.when(trip, severe),
            "_all": F.when(ok & seen, F.lit(1)),
        }
    )
    df = df.withColumns({"_all": F.when(F.col("_all") == 1, F.col("net_return")), "_cond": F.when(trip, net)})
    df = percentile_ranks(df, cs, {"net_rank": "_all", "conditional_rank": "_cond"})
    df = group_values(df, cs, {"_median": ("quantile", "_cond", 0.5)})
    return df.withColumns(
        {
            "conditional_residual": F.col("_cond") - F.col("_median"),
            "target_top": F.when(trip, (F.col("conditional_rank") >= 1 - cfg.top_fraction).cast("int")),
        }
    ).drop("_all", "_cond", "_median")


def _all_in(entry, leave, conditional, cfg):
    """Cash when not entered, penalty when stuck, otherwise the contract's return."""
    return F.when(~entry, 0.0).when(~leave, cfg.non_fill_penalty).otherwise(conditional)


def open_exit_contract(df, cfg: Execution) -> DataFrame:
    """Sell at the next adjusted open unless it is pinned at the down limit."""
    entry = holds(F.col("entry_ok"))
    free = F.col("t1_down_limit").isNull() | (F.col("t1_open") > F.col("t1_down_limit") + 0.005)
    leave = all_of([F.col("t1_open") > 0, F.col("t1_vol") > 0, free])
    adjusted = F.col("t1_open") * F.when((F.col("adj") > 0) & (F.col("t1_adj") > 0), ratio("t1_adj", "adj"))
    df = df.withColumn("exit_open_ok", leave)
    net = pct(adjusted, "entry_price") - cfg.cost_pct
    return df.withColumn("net_open", _all_in(entry, F.col("exit_open_ok"), net, cfg))


def take_profit_contract(df, targets_bps, tick, cfg: Execution, close_net="net_close") -> DataFrame:
    """Limit order one tick through the target, otherwise the close contract."""
    entry, close_ok = holds(F.col("entry_ok")), holds(F.col("exit_ok"))
    for bps in targets_bps:
        goal = F.col("entry_price") * (1 + (cfg.cost_bps + bps) / 10_000)
        raw = ratio(goal, ratio("t1_adj", "adj"))
        hit = all_of([entry, F.col("t1_high") >= raw + tick - 1e-9, F.col("t1_vol") > 0])
        df = df.withColumn(f"hit_{bps}", hit).withColumn(f"exit_tp_{bps}_ok", F.col(f"hit_{bps}") | close_ok)
        value = F.when(F.col(f"hit_{bps}"), bps / 100).otherwise(F.col(close_net))
        df = df.withColumn(f"net_tp_{bps}", _all_in(entry, F.col(f"exit_tp_{bps}_ok"), value, cfg))
    return df


def tail_exit_contracts(df, bars, slots, cfg: Execution, by, day="t1_day", covered="covered") -> DataFrame:
    """One outcome per exit slot of the next day, long form with a ``contract`` column.

    ``slots`` maps contract name to the exit bar's slot. Slots become rows before the bar
    join, so all contracts share one equi-join.
    """
    spec = F.array(*[F.struct(F.lit(n).alias("contract"), F.lit(s).alias("exit_slot")) for n, s in slots.items()])
    wide = df.select("*", F.inline(spec))
    exits = bars.select(
        *by, F.col("day").alias(day), F.col("slot").alias("exit_slot"),
        F.col("close").alias("exit_bar_price"), F.col("amount").alias("exit_bar_amount"), F.col("vol").alias("exit_bar_vol"),
    )
    df = wide.join(exits, [*by, day, "exit_slot"], "left")
    entry, cov = holds(F.col("entry_ok")), holds(F.col(covered))
    price, amount = F.col("exit_bar_price"), F.col("exit_bar_amount")
    leave = all_of([
        cov, F.col("t1_adj") > 0, F.col("adj") > 0, price > 0, amount >= cfg.min_amount,
        amount * cfg.max_share_of_amount >= cfg.order_notional, F.col("exit_bar_vol") > 0,
        F.col("t1_down_limit").isNull() | (price > F.col("t1_down_limit") * 1.0001),
    ])
    df = df.withColumn("exit_contract_ok", leave)
    got = price * ratio("t1_adj", "adj") * (1 - cfg.slippage_bps / 10_000)
    net = pct(got, "entry_price") - cfg.cost_pct
    pending = entry & ~cov
    return df.withColumns(
        {
            "contract_label_available": ~pending,
            "contract_net": F.when(~pending, _all_in(entry, F.col("exit_contract_ok"), net, cfg)),
        }
    )


def fast_entry_outcome(cands, bars, by, delay, cfg: Execution, time="ts") -> DataFrame:
    """Outcome of entering on the one bar stamped exactly ``time + delay``."""
    pick = bars.select(
        *by, F.expr(f"{time} - interval {delay}").alias(time),
        F.col("close").alias("bar_close"), F.col("amount").alias("bar_amount"), F.col("vol").alias("bar_vol"),
    )
    df = cands.join(pick, [*by, time], "left")
    up = pct("up_limit", "bar_close")
    down = pct("bar_close", "down_limit")
    exact = F.col("bar_close").isNotNull()
    full = all_of([exact, F.col("bar_close") > 0, F.col("bar_amount") >= 0, F.col("bar_vol") >= 0, up.isNotNull(), down.isNotNull()])
    fill = all_of([
        full, F.col("eligible"), F.col("bar_amount") >= cfg.min_amount,
        F.col("bar_amount") * cfg.max_share_of_amount >= cfg.order_notional, F.col("bar_vol") > 0,
        up >= cfg.min_dist_up, down >= cfg.min_dist_down,
    ])
    df = df.withColumns({"bar_exact": exact, "entry_complete": full, "fast_entry_ok": fill})
    entry, leave = F.col("fast_entry_ok"), holds(F.col("exit_ok"))
    seen = F.col("entry_complete") & holds(F.col("source_label")) & (~entry | ~leave | holds(F.col("exit_price") > 0))
    df = df.withColumn("fast_label_available", seen)
    paid = F.col("bar_close") * (1 + cfg.slippage_bps / 10_000)
    net = pct("exit_price", paid) - cfg.cost_pct
    return df.withColumn("fast_net", F.when(F.col("fast_label_available"), _all_in(entry, leave, net, cfg)))


def materialize_contract(df, net, fill, name, cfg: Execution) -> DataFrame:
    """Map one contract's columns onto the standard label columns."""
    value = F.col(net)
    return df.withColumns(
        {
            "net_return": value,
            "exit_ok": holds(F.col(fill)),
            "target_positive": holds(value > 0).cast("int"),
            "target_severe": holds(value <= cfg.severe_loss).cast("int"),
            "exit_contract": F.lit(name),
        }
    )


def truth_hydration(pending, truth, on, due, asof, cols) -> DataFrame:
    """Fill NULL outcome columns from published truth whose due day has come."""
    facts = truth.select(*on, *[F.col(c).alias(f"_t_{c}") for c in cols])
    facts = unique_rows(facts, on, "truth")
    joined = pending.join(facts, on, "left")
    ready = F.col(due) <= F.to_date(F.lit(asof))
    filled = joined.withColumns(
        {c: F.coalesce(F.col(c), F.when(ready, F.col(f"_t_{c}"))) for c in cols}
    )
    return filled.drop(*[f"_t_{c}" for c in cols]).withColumn(
        "truth_status", F.when(F.col(cols[0]).isNotNull(), "SETTLED").otherwise("PENDING")
    )


def paired_contract_delta(a, b, pk, day, value) -> DataFrame:
    """Challenger minus baseline on common identities, row level and day-equal."""
    pair = a.select(*pk, F.col(value).alias("_a")).join(b.select(*pk, F.col(value).alias("_b")), pk)
    pair = pair.filter("_a is not null and _b is not null").withColumn("_d", F.col("_b") - F.col("_a"))
    rows = group_table(
        pair.withColumn("_all", F.lit(1)), ["_all"],
        {
            "pairs": F.count(F.lit(1)), "mean_delta": F.avg("_d"), "median_delta": ("quantile", "_d", 0.5),
            "improved_share": F.avg((F.col("_d") > 0).cast("int")),
        },
    )
    days = pair.groupBy(day).agg(F.avg("_d").alias("_m")).groupBy(F.lit(1).alias("_all")).agg(
        F.avg("_m").alias("day_equal_delta"), F.count(F.lit(1)).alias("days")
    )
    return rows.join(days, "_all").drop("_all")
