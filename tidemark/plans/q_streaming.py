"""Streaming queries: run over what is available and closed by a heartbeat, compared with batch SQL over all rows."""

import datetime as dt

from pyspark.sql import functions as F

from ..functions import ieee_ratio
from ..sources.tables import scratch
from ..streaming import operators as op
from ..streaming import state
from .registry import query


def live(t, where=None):
    """The event table as a stream."""
    schema = t.events.schema
    s = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    s = op.event_time(s)
    return s.filter(where) if where else s


def close_time(t):
    """Well behind the last event."""
    return t.events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0] + dt.timedelta(days=4)


def closed(t, build, where=None):
    """Run ``build(stream)`` over the events and close it by a heartbeat."""
    beat = state.Heartbeat(t.spark)
    return op.drain(build(beat.join(live(t, where), "ts")), closing=beat, at=close_time(t))


def stamp(*cols):
    return {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in cols}


def text(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


BARS = f"""SELECT user_id, s, s + INTERVAL 6 HOUR AS e, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, sum(value) AS amount, count(*) AS ticks FROM (
  SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS s FROM events) GROUP BY user_id, s"""


@query("stream_bars", "user_id:i bar_start:s bar_end:s open:r high:r low:r close:r amount:r ticks:i",
       f"SELECT user_id, {text('s')} AS bar_start, {text('e')} AS bar_end, open, high, low, close, amount, ticks FROM ({BARS})")
def _(t):
    out = closed(t, lambda s: op.stream_bars(s, ["user_id"], "ts", "value", "6 hours", "1 hour"))
    return out.withColumns(stamp("bar_start", "bar_end"))


@query("stream_sliding_activity", "slot_end:s errors:i clicks:i",
       f"""SELECT {text('e')} AS slot_end, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM (
       SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '2024-01-01') + (k + 1) * INTERVAL 30 MINUTE AS e FROM events, range(2) r(k)) GROUP BY e""")
def _(t):
    conds = {"errors": F.col("event_type") == "error", "clicks": F.col("event_type") == "click"}
    out = closed(t, lambda s: op.stream_sliding_activity(s, "ts", "60 minutes", "30 minutes", conds, "1 hour"))
    return out.withColumns(stamp("slot_end"))


@query("stream_dedup_bars", "event_id:i user_id:i value:r", "SELECT event_id, user_id, value FROM events")
def _(t):
    twice = live(t).union(live(t, "event_type = 'click'"))
    return op.drain(op.stream_dedup_bars(twice, ["event_id"], "ts", "1 hour"))


AGE = "floor(value)"


@query("stream_freshness", "slot_end:s bars:i stale_bars:i codes:i coverage:r",
       f"""SELECT {text('s + INTERVAL 1 HOUR')} AS slot_end, count(*) AS bars, count(*) FILTER (WHERE NOT {AGE} BETWEEN -60 AND 100) AS stale_bars, count(DISTINCT user_id) AS codes, count(DISTINCT user_id) / 100.0::DOUBLE AS coverage FROM (
       SELECT *, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2024-01-01') AS s FROM events) GROUP BY s""")
def _(t):
    arrival = F.expr("ts + make_dt_interval(0, 0, 0, cast(value as bigint))")
    out = closed(t, lambda s: op.stream_freshness(s.withColumn("arrival", arrival), "user_id", "ts", "arrival", 100, "1 hour", "1 hour", 100))
    return out.withColumns(stamp("slot_end"))


@query("stream_static_enrich", "event_id:i fine:i coarse:i", "SELECT event_id, fine, coarse FROM events LEFT JOIN ufine ON code = user_id")
def _(t):
    static = t.ufine.withColumnRenamed("code", "user_id")
    return op.drain(op.stream_static_enrich(live(t).select("event_id", "user_id"), static, ["user_id"]))


@query("stream_slot_context", "bar_start:s user_id:i ret:r market_return:r market_breadth_0:r market_dispersion:r",
       f"""SELECT {text('s')} AS bar_start, user_id, r AS ret, median(r) OVER w AS market_return, avg((r > 0)::INT) OVER w AS market_breadth_0, stddev_samp(r) OVER w AS market_dispersion FROM (SELECT *, close / open * 100 - 100 AS r FROM ({BARS})) WINDOW w AS (PARTITION BY s)""")
def _(t):
    path, checkpoint, beat = scratch(t.spark), scratch(t.spark), state.Heartbeat(t.spark)
    run = lambda: op.stream_slot_context(beat.join(live(t), "ts"), ["user_id"], "ts", "value", "6 hours", "1 hour", path, checkpoint).awaitTermination()
    run()
    beat.beat(close_time(t))
    run()
    return t.spark.read.parquet(path).withColumns(stamp("bar_start"))


HIT, FROZE = "value > 50", "strftime(ts, '%H:%M:%S.%f') <= '18:20:00.000000'"


@query("stream_first_signal", "day:d user_id:i first_seen:s event_id:i value:r appearances:i last_seen:s refused:i status:s",
       f"""SELECT d AS day, user_id, {text('min(ts) FILTER (WHERE k)')} AS first_seen, arg_min(event_id, ts) FILTER (WHERE k) AS event_id, arg_min(value, ts) FILTER (WHERE k) AS value, count(*) FILTER (WHERE k) AS appearances,
       {text('max(ts) FILTER (WHERE k)')} AS last_seen, count(*) FILTER (WHERE NOT k) AS refused, 'FROZEN' AS status FROM (SELECT *, CAST(ts AS DATE) AS d, {FROZE} AS k FROM events WHERE {HIT}) GROUP BY d, user_id HAVING bool_or(k)""")
def _(t):
    beat = state.Heartbeat(t.spark)
    s = state.stream_first_signal(beat.join(live(t), "ts"), "user_id", "ts", F.col("value") > 50, "event_id", ["event_id", "value"], "1 hour", "18:20")
    out = state.current_signals(state.updates(s, beat, close_time(t)), "user_id", ["event_id", "value"])
    return out.withColumns(stamp("first_seen", "last_seen"))


SIG = "SELECT event_id, user_id, date_trunc('hour', ts) + INTERVAL 1 HOUR AS due FROM events WHERE event_type = 'click'"
BAR = "SELECT user_id, date_trunc('hour', ts) AS bar_ts, date_trunc('hour', ts + INTERVAL 10 MINUTE) AS bar_slot, value AS price, value * 10 AS amount, event_id % 7 * 60 AS age FROM events WHERE event_type = 'view'"


@query("stream_entry_settle", "event_id:i user_id:i due:s price:r status:s reason:s",
       f"""SELECT event_id, user_id, {text('due')} AS due, price, CASE WHEN reason = '' THEN 'SETTLED' ELSE 'NON_FILL' END AS status, reason FROM (SELECT s.*, price, CASE WHEN bar_ts IS NULL THEN 'missing_bar' ELSE concat_ws('|', CASE WHEN NOT price > 0 THEN 'bad_price' END,
       CASE WHEN bar_slot <> due THEN 'wrong_bar' END, CASE WHEN amount < 300 THEN 'thin_bar' END, CASE WHEN amount * 0.1::DOUBLE < 40 THEN 'order_capacity' END, CASE WHEN (100 / price - 1) * 100 < 1 THEN 'near_limit' END, CASE WHEN NOT age BETWEEN -60 AND 300 THEN 'stale_bar' END) END AS reason
       FROM ({SIG}) s LEFT JOIN ({BAR}) b ON b.user_id = s.user_id AND bar_ts = due) s""")
def _(t):
    beats = state.Heartbeat(t.spark)
    signals = beats.join(live(t, "event_type = 'click'"), "ts", user_id=-1).select("event_id", "user_id", F.expr("date_trunc('hour', ts) + interval 1 hour").alias("due"))
    bars = beats.join(live(t, "event_type = 'view'"), "ts", user_id=-1).select(
        "user_id", F.date_trunc("hour", "ts").alias("bar_ts"), F.expr("date_trunc('hour', ts + interval 10 minutes)").alias("bar_slot"), F.col("value").alias("price"),
        (F.col("value") * 10).alias("amount"), (F.col("event_id") % 7 * 60).alias("age"),
    )
    price, amount = F.col("price"), F.col("amount")
    reasons = {
        "bad_price": ~(price > 0), "wrong_bar": F.col("bar_slot") != F.col("due"), "thin_bar": amount < 300, "order_capacity": amount * 0.1 < 40,
        "near_limit": (ieee_ratio(F.lit(100.0), price) - 1) * 100 < 1, "stale_bar": ~F.col("age").between(-60, 300),
    }
    out = op.drain(op.stream_entry_settle(signals, bars, ["user_id"], "due", "bar_ts", "2 hours", reasons), closing=beats, at=close_time(t))
    return out.where("event_id IS NOT NULL").withColumns(stamp("due"))


FREEZE = ["00", "06", "12", "18"]
ENT = f"""SELECT CAST(ts AS DATE) AS d, user_id, min(ts) AS opened, CASE WHEN arg_min(value, ts) > 50 THEN 'QUALIFIED' ELSE 'OBSERVATION' END AS cohort FROM events WHERE event_type = 'click' AND {FROZE} GROUP BY 1, 2"""


@query("stream_freeze", "day:d rows:i qualified:i observations:i pending:i refused:i missing_slots:s status:s",
       f"""SELECT d AS day, rows, qualified, observations, pending, refused, m AS missing_slots, CASE WHEN m <> '' THEN 'INCOMPLETE' WHEN pending > 0 THEN 'INCOMPLETE_ENTRY' WHEN observations <> 2 THEN 'INCOMPLETE_OBSERVATION' ELSE 'COMPLETE' END AS status FROM (
       SELECT CAST(ts AS DATE) AS d, count(*) FILTER (WHERE k AND event_type = 'error') AS rows, count(*) FILTER (WHERE NOT k AND event_type IN ('error', 'click')) AS refused,
         concat_ws('|', {', '.join(f"CASE WHEN count(*) FILTER (WHERE k AND event_type = 'error' AND strftime(ts, '%H') = '{x}') = 0 THEN '{x}' END" for x in FREEZE)}) AS m FROM (SELECT *, {FROZE} AS k FROM events) GROUP BY 1 HAVING bool_or(k AND event_type IN ('error', 'click'))) a
       LEFT JOIN (SELECT d, count(*) FILTER (WHERE cohort = 'QUALIFIED') AS qualified, count(*) FILTER (WHERE cohort = 'OBSERVATION') AS observations, count(*) FILTER (WHERE NOT paid) AS pending FROM (
         SELECT e.*, EXISTS (SELECT 1 FROM events p WHERE event_type IN ('purchase', 'signup', 'view') AND p.user_id = e.user_id AND CAST(p.ts AS DATE) = d AND p.ts >= opened) AS paid FROM ({ENT}) e) GROUP BY d) b USING (d)""")
def _(t):
    beat = state.Heartbeat(t.spark)
    ident = F.concat_ws("/", F.col("user_id"), F.to_date("ts"))
    slots = beat.join(live(t, "event_type = 'error'"), "ts").withColumn("slot", F.date_format("ts", "HH"))
    entries = live(t, "event_type = 'click'").withColumns({"ident": ident, "cohort": F.when(F.col("value") > 50, "QUALIFIED").otherwise("OBSERVATION")})
    settled = live(t, "event_type IN ('purchase', 'signup', 'view')").withColumn("ident", ident)
    frozen = state.stream_freeze(slots, entries, settled, "ts", "slot", "event_id", "ident", "cohort", FREEZE, "18:20", "1 hour", grace="8 hours", buckets=4)
    return state.session_status(state.updates(frozen, beat, close_time(t)), FREEZE, 2)


@query("stream_late_tier", "event_id:i tier:s behind:b prospective:b",
       """SELECT event_id, tier, behind, tier = 'prospective' AND NOT behind AS prospective FROM (
       SELECT *, coalesce(ts < max(ts) OVER (PARTITION BY user_id ORDER BY arrival, ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 30 MINUTE, FALSE) AS behind FROM (
       SELECT *, CASE WHEN w <= 3600 THEN 'prospective' WHEN CAST(ts + w * INTERVAL 1 SECOND AS DATE) = CAST(ts AS DATE) THEN 'same_day_recovered' ELSE 'late' END AS tier, ts + w * INTERVAL 1 SECOND AS arrival FROM (SELECT *, CAST(floor(value) AS BIGINT) * 100 AS w FROM events)))""")
def _(t):
    s = live(t).withColumn("arrival", F.expr("ts + make_dt_interval(0, 0, 0, cast(value as bigint) * 100)"))
    tagged = state.stream_late_tier(s.select("event_id", "user_id", "ts", "arrival"), "user_id", "event_id", "ts", "arrival", 3600, 1800)
    main, side = state.split_late(tagged, scratch(t.spark), scratch(t.spark))
    return main.unionByName(side)


@query("stream_truth_settle", "event_id:i user_id:i due:s settled_at:s truth_value:r status:s",
       f"""SELECT event_id, user_id, {text('due')} AS due, {text('seen')} AS settled_at, v AS truth_value, CASE WHEN seen IS NOT NULL THEN 'SETTLED' WHEN due + INTERVAL 1 DAY <= (SELECT max(ts) FROM events WHERE event_type IN ('signup', 'purchase')) THEN 'EXPIRED' ELSE 'PENDING' END AS status FROM (
       SELECT l.event_id, l.user_id, due, min(p.ts) AS seen, arg_min(p.value, p.ts) AS v FROM (SELECT *, date_trunc('day', ts) + INTERVAL 1 DAY AS due FROM events WHERE event_type = 'signup') l
       LEFT JOIN events p ON p.event_type = 'purchase' AND p.user_id = l.user_id AND p.ts >= due AND p.ts < due + INTERVAL 1 DAY GROUP BY ALL)""")
def _(t):
    book = state.TruthLedger(t.spark, scratch(t.spark), ["user_id"], "event_id", {"user_id": "bigint", "event_id": "bigint"}, "1 day")
    candidates = live(t, "event_type = 'signup'").withColumn("due", F.expr("date_trunc('day', ts) + interval 1 day"))
    book.run(book.rows(candidates, live(t, "event_type = 'purchase'")), scratch(t.spark))
    return book.ledger().withColumns(stamp("due", "settled_at"))


@query("ledger_current_state", "user_id:i event_id:i event_type:s value:r",
       "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def _(t):
    return op.ledger_current_state(t.events.select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")
