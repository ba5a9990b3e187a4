"""Structured Streaming forms of the intraday steps.

Every operator takes and returns streaming DataFrames; event time must be TIMESTAMP (use
``event_time`` for NTZ columns). All keep bounded state: a watermark closes windows and
joins, and a heartbeat (see ``state``) closes what the last rows leave open. Results equal the
batch operators on rows that are not late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import holds, ieee_ratio, share
from ..sources.tables import scratch


def event_time(df, name="ts") -> DataFrame:
    """Zone-free stamps to TIMESTAMP; watermarks do not accept the former."""
    return df.withColumn(name, F.col(name).cast("timestamp"))


def drain(stream: DataFrame, mode="append", closing=None, at=None) -> DataFrame:
    """Run a stream over what is available now and read the finished rows back.

    With a heartbeat ``closing`` among its inputs, what the last watermark leaves open is closed
    by a beat at time ``at``.
    """
    spark = stream.sparkSession
    path, state = scratch(spark), scratch(spark)

    def run():
        query = (
            stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state)
            .outputMode(mode).trigger(availableNow=True).start()
        )
        query.awaitTermination()

    run()
    if closing is not None:
        closing.beat(at)
        run()
    return spark.read.schema(stream.schema).parquet(path)


def stream_bars(s, key, ts, value, width, watermark) -> DataFrame:
    """Ticks to fixed bars per key; a bar appears once, when its window is closed."""
    w = s.withWatermark(ts, watermark).groupBy(*key, F.window(ts, width).alias("window"))
    return w.agg(
        F.min_by(value, ts).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"),
        F.max_by(value, ts).alias("close"), F.sum(value).alias("amount"), F.count(F.lit(1)).alias("ticks"),
    ).select(*key, F.col("window.start").alias("bar_start"), F.col("window.end").alias("bar_end"), "open", "high", "low", "close", "amount", "ticks")


def stream_sliding_activity(s, ts, width, slide, conds: dict[str, Column], watermark) -> DataFrame:
    """Event counts of the last ``width``, refreshed every ``slide``."""
    w = s.withWatermark(ts, watermark).groupBy(F.window(ts, width, slide).alias("window"))
    out = w.agg(*[F.sum(share(c)).cast("bigint").alias(n) for n, c in conds.items()])
    return out.select(F.col("window.end").alias("slot_end"), *conds)


def stream_dedup_bars(s, key, ts, watermark) -> DataFrame:
    """Replayed and live copies of the same bar collapse to one."""
    return s.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([*key, ts])


def stream_freshness(s, code, ts, arrival, max_age, width, watermark, universe: int) -> DataFrame:
    """Per slot: bars, stale bars, distinct codes and their share of the universe.

    Codes are counted by two chained aggregations, (slot, code) then slot, so no set of
    codes is kept in one state row.
    """
    age = F.unix_timestamp(arrival) - F.unix_timestamp(ts)
    fresh = holds(age.between(-60, max_age))
    per_code = (
        s.withWatermark(ts, watermark).groupBy(F.window(ts, width).alias("window"), code)
        .agg(F.count(F.lit(1)).alias("_n"), F.sum((~fresh).cast("int")).alias("_stale"))
    )
    slot = F.window(F.window_time("window"), width).alias("slot")
    out = per_code.groupBy(slot).agg(
        F.sum("_n").alias("bars"), F.sum("_stale").alias("stale_bars"), F.count(F.lit(1)).alias("codes")
    )
    return out.select(
        F.col("slot.end").alias("slot_end"), "bars", "stale_bars", "codes", (F.col("codes") / F.lit(universe)).alias("coverage")
    )


def stream_static_enrich(s, static, on) -> DataFrame:
    """Bars with reference data; the static side is planned and sized like any join."""
    return s.join(static, on, "left")


def stream_slot_context(s, key, ts, value, width, watermark, path, checkpoint):
    """Market breadth of each closed slot.

    All keys of a window close in the same micro-batch, so ``foreachBatch`` sees whole
    cross-sections and can use the batch operator. A bar that opens at zero has an infinite return
    (or NaN, if it closes there too) and counts like any other. Returns the streaming query;
    starting it again with the same ``checkpoint`` goes on where it ended.
    """
    from ..operators.windows import market_context

    bars = stream_bars(s, key, ts, value, width, watermark)
    bars = bars.withColumn("ret", ieee_ratio("close", "open") * 100 - 100)

    def write(batch, batch_id):
        context = market_context(batch, ["bar_start"], "ret")
        out = context.select("bar_start", *key, "ret", "market_return", "market_breadth_0", "market_dispersion")
        # one folder per batch: a retried batch replaces its own output
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        bars.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def _settle(left, right, on, due, seen, within, watermark):
    """Outer interval join: right rows inside [due, due + within] of the left row."""
    a = left.withWatermark(due, watermark).alias("l")
    b = right.withWatermark(seen, watermark).alias("r")
    cond = F.expr(f"r.{seen} >= l.{due} and r.{seen} <= l.{due} + interval {within}")
    for k in on:
        cond = cond & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    keep = [F.col(f"r.{c}").alias(f"{c}" if c not in left.columns else f"{c}_r") for c in right.columns if c not in on]
    return a.join(b, cond, "left").select("l.*", *keep)


def stream_entry_settle(signals, bars, on, due, seen, watermark, reasons: dict[str, Column], within="0 seconds") -> DataFrame:
    """Settle each signal on its execution bar; a bar that never comes is a NON_FILL.

    ``reasons`` are conditions over the signal's and the bar's columns, in order, that bar a fill;
    all that hold are named in ``reason``, and one that can't be told counts as holding. The
    missing-bar row comes from the outer join when the watermark passes the due time, so nothing
    waits for a driver-side timeout.
    """
    out = _settle(signals, bars.withColumn("_bar", F.lit(True)), on, due, seen, within, watermark)
    named = [F.when(~holds(~c), F.lit(name)) for name, c in reasons.items()]
    reason = F.when(F.col("_bar").isNull(), "missing_bar").otherwise(F.array_join(F.array_compact(F.array(*named)), "|"))
    return out.withColumn("reason", reason).withColumn("status", F.when(F.col("reason") == "", "SETTLED").otherwise("NON_FILL")).drop("_bar")


def ledger_current_state(events, key, seq) -> DataFrame:
    """Append-only ledger events to the latest state per candidate."""
    rest = [c for c in events.columns if c not in key]
    last = events.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_s"))
    return last.select(*key, "_s.*")
