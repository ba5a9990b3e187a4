"""Keyed state for streams: first signals, session freezes, rows behind their key, ledger merges.

State processors only see narrow rows (key, time in microseconds, identity, the rest packed as
JSON) and keep one small value per key; tables are written per micro-batch into folders that a
retried batch replaces.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import holds
from ..sources.tables import scratch

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


class Heartbeat:
    """A source of its own for rows that only say how late it is.

    A watermark moves with the rows that come in, so the last windows, timers and pending joins
    of a stream stay open. A heartbeat is a row with nothing but the event time: it qualifies
    for no rule and opens a window that stays open itself, but all before it closes.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, scratch(spark)
        self._write([])

    def _write(self, times: list[dt.datetime]) -> None:
        self.spark.createDataFrame([(t,) for t in times], "beat timestamp").coalesce(1).write.mode("append").parquet(self.folder)

    def join(self, stream: DataFrame, ts: str, **values) -> DataFrame:
        """The stream with heartbeats among its rows.

        Their other columns are null or the given ``values``: a stream that is joined needs a key
        of no real row, since rows with null keys are dropped before the watermark.
        """
        beats = self.spark.readStream.schema("beat timestamp").parquet(self.folder)
        return stream.unionByName(beats.select(F.col("beat").alias(ts), *[F.lit(v).alias(c) for c, v in values.items()]), allowMissingColumns=True)

    def beat(self, at: dt.datetime) -> None:
        self._write([at])


def of_rows(ts: str, condition: Column) -> Column:
    """A condition that is checked behind the watermark, so that rows which fail it still move the watermark.

    A filter on other columns than the event time is pushed below the watermark.
    """
    return F.coalesce(F.when(F.col(ts).isNotNull(), condition), F.lit(False))


def _bucket(by: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int")


def _stateful(stream: DataFrame, key: list[str], processor: StatefulProcessor, schema: str, mode: str, time: str) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    return stream.groupBy(*key).transformWithStateInPandas(processor, schema, mode, time)


def write_updates(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """Run a stream over what there is; a batch's rows go to a folder that a retried batch replaces."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def updates(stream: DataFrame, closing: Heartbeat | None = None, at: dt.datetime | None = None) -> DataFrame:
    """All rows that an update-mode stream has given so far, with the ``batch`` that gave them."""
    spark = stream.sparkSession
    path, checkpoint = scratch(spark), scratch(spark)
    write_updates(stream, path, checkpoint)
    if closing is not None:
        closing.beat(at)
        write_updates(stream, path, checkpoint)
    return spark.read.option("basePath", path).schema(f"{_ddl(stream)}, batch bigint").parquet(path)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


class _FirstSignal(StatefulProcessor):
    """State of one bucket of a day: for each key the first row as it was, its time, appearances, last sighting and identities seen.

    A bucket's keys are one value, read and written once a batch: a call per key would cost more
    than all else.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.signals = handle.getValueState("signals", "entries string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        some = pd.concat(list(rows), ignore_index=True).sort_values(["at_us", "ident"])
        out = []
        known = {k: (packed, first, count, last, set(seen)) for k, packed, first, count, last, seen in self._held()}
        new, changed = not known, {}
        for who, us, ident, packed, refused in zip(some["key_text"], some["at_us"].tolist(), some["ident"], some["packed"], some["refused"]):
            if refused:
                out.append((key[0], who, "REFUSED", packed, us, 0, us))
                continue
            held = known.get(who)
            if held is None:
                known[who] = (packed, us, 1, us, {ident})
                changed[who] = "NEW"
            elif ident not in held[4]:
                held[4].add(ident)
                known[who] = (held[0], held[1], held[2] + 1, max(held[3], us), held[4])
                changed.setdefault(who, "SEEN")
        if changed:
            self.signals.update((json.dumps([(k, *held[:4], list(held[4])) for k, held in known.items()]),))
            if new:
                self.handle.registerTimer(int(some["freeze_ms"].iloc[0]))
        out += [(key[0], who, event, *known[who][:4]) for who, event in changed.items()]
        if out:
            yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.signals.exists():
            held = self._held()
            self.signals.clear()
            yield self._rows([(key[0], k, "FROZEN", *rest) for k, *rest, _ in held])

    def _held(self) -> list:
        return json.loads(self.signals.get()[0]) if self.signals.exists() else []

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["day_text", "key_text", "event", "packed", "first_us", "appearances", "last_us"])

    def close(self) -> None:
        pass


def _day_and_freeze(df: DataFrame, ts: str, freeze_at: str) -> DataFrame:
    hours, minutes = freeze_at.split(":")[:2]
    freeze = F.date_trunc("day", ts) + F.expr(f"interval {int(hours)} hours {int(minutes)} minutes")
    return df.withColumns({"at_us": F.unix_micros(ts), "day_text": F.date_format(ts, "yyyy-MM-dd"), "freeze_ms": F.unix_millis(freeze), "refused": F.col(ts) > freeze})


def stream_first_signal(s, code: str, ts: str, cond: Column, ident: str, cols: list[str], watermark: str, freeze_at: str = "23:59", buckets: int = 128) -> DataFrame:
    """Changes of a stock-day's first qualifying row, as they happen (update mode).

    A row (``event``) comes out when the signal is first seen (NEW), with each batch that sees it
    again (SEEN), when an event-time timer closes the day at ``freeze_at`` (FROZEN; the state goes
    then), and for each row after the freeze (REFUSED). The first row with its ``cols`` never
    changes, not even where an earlier one comes later. A row whose ``ident`` was seen before is a
    replay and changes nothing. ``current_signals`` gives the state that the changes lead to.
    A day's keys are dealt over ``buckets``, each with one state and one timer.
    """
    rows = s.withWatermark(ts, watermark).filter(of_rows(ts, holds(cond)))
    rows = _day_and_freeze(rows, ts, freeze_at).select(
        ts, "day_text", F.col(code).cast("string").alias("key_text"), "at_us", F.col(ident).cast("string").alias("ident"), "refused", "freeze_ms",
        F.to_json(F.struct(code, *cols), _JSON).alias("packed"),
    ).withColumn("bucket_no", _bucket("key_text", buckets))
    out = _stateful(rows, ["day_text", "bucket_no"], _FirstSignal(), "day_text string, key_text string, event string, packed string, first_us bigint, appearances bigint, last_us bigint", "update", "EventTime")
    kinds = ", ".join(f"`{c}` {s.schema[c].dataType.simpleString()}" for c in (code, *cols))
    return out.withColumn("_p", F.from_json("packed", kinds, _JSON)).select(
        F.to_date("day_text").alias("day"), "event", F.timestamp_micros("first_us").alias("first_seen"), "_p.*", "appearances", F.timestamp_micros("last_us").alias("last_seen"),
    )


def current_signals(changes: DataFrame, code: str, cols: list[str]) -> DataFrame:
    """Latest state of each stock-day: its first row, appearances, rows refused, OPEN or FROZEN."""
    kept = F.col("event") != "REFUSED"
    last = F.max_by(F.when(kept, F.struct("first_seen", *cols, "appearances", "last_seen")), F.when(kept, F.col("appearances")))
    frozen = F.max((F.col("event") == "FROZEN").cast("int")) == 1
    out = changes.groupBy("day", code).agg(last.alias("_s"), F.sum((~kept).cast("int")).cast("bigint").alias("refused"), F.when(frozen, "FROZEN").otherwise("OPEN").alias("status"))
    return out.where("_s IS NOT NULL").select("day", code, "_s.*", "refused", "status")


class _SessionFreeze(StatefulProcessor):
    """State of one bucket of a day: rows, slots covered, and each entry's cohort and whether it is pending."""

    def __init__(self, slots: list[str], grace_ms: int):
        self.slots, self.grace_ms = slots, grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.day = handle.getValueState("day", "rows bigint, covered array<boolean>, turn bigint")
        self.entries = handle.getMapState("entries", "ident string", "cohort string, pending boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        some = pd.concat(list(rows), ignore_index=True).sort_values("at_us")
        new = not self.day.exists()
        count, covered, turn = (0, [False] * len(self.slots), 0) if new else self.day.get()
        opens = ~some["refused"]
        slots = some[(some["kind"] == "slot") & opens]
        covered = [bool(c) or x in set(slots["slot"]) for c, x in zip(covered, self.slots)]
        changed = self._entries(some[some["kind"] != "slot"])
        refused = int((~opens & (some["kind"] != "settle")).sum())
        if refused:
            yield self._row(key, 0, 0, [], [], refused)
        if new and not opens.any():
            return
        self.day.update((count + len(slots), covered, turn))
        if new:
            self.handle.registerTimer(int(some["freeze_ms"].iloc[0]))
        elif turn and changed:
            yield self._close(key)

    def _entries(self, some: pd.DataFrame) -> bool:
        changed = False
        for kind, ident, cohort, refused in zip(some["kind"], some["ident"], some["cohort"], some["refused"]):
            known = self.entries.containsKey((ident,))
            if kind == "entry" and not known and not refused:
                self.entries.updateValue((ident,), (cohort, True))
            elif kind == "settle" and known:
                held = self.entries.getValue((ident,))
                changed |= bool(held[1])
                self.entries.updateValue((ident,), (held[0], False))
        return changed

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.day.exists():
            return
        if self.day.get()[2]:
            self.day.clear()
            self.entries.clear()
            return
        yield self._close(key)
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.grace_ms)

    def _close(self, key) -> pd.DataFrame:
        rows, covered, turn = self.day.get()
        self.day.update((rows, covered, turn + 1))
        return self._row(key, turn + 1, rows, [x for x, c in zip(self.slots, covered) if c], [v for _, v in self.entries.iterator()], 0)

    def _row(self, key, turn, rows, covered, entries, refused) -> pd.DataFrame:
        kinds = [c for c, _ in entries]
        values = [*key, turn, rows, covered, kinds.count("QUALIFIED"), kinds.count("OBSERVATION"), sum(bool(p) for _, p in entries), refused]
        return pd.DataFrame([values], columns=["day_text", "bucket_no", "turn", "rows", "covered", "qualified", "observations", "pending", "refused"])

    def close(self) -> None:
        pass


def stream_freeze(slots, entries, settled, ts: str, slot: str, spread: str, ident: str, cohort: str, expected_slots: list[str], freeze_at: str, watermark: str,
                  grace: str = "1 hour", buckets: int = 16) -> DataFrame:
    """Sessions as an event-time timer closes them at ``freeze_at``: one row per day and bucket (update mode).

    Three inputs: slot rows, entries (an ``ident`` with its ``cohort``, pending from then on) and
    settlements of entries. What comes after the freeze is refused and counted, but for
    settlements within ``grace``: they give the bucket's row anew with a higher ``turn``. No later
    data is needed but a watermark past the freeze. A day is dealt over ``buckets`` by ``spread``
    (slot rows) or ``ident`` (entries), so no task holds a whole day; ``session_status`` adds them up.
    """
    mark = lambda df, kind, by, *cols: df.select(ts, F.lit(kind).alias("kind"), by.cast("string").alias("_by"), *cols)
    none = F.lit(None).cast("string")
    rows = mark(slots, "slot", F.col(spread), F.col(slot).alias("slot"), none.alias("ident"), none.alias("cohort"))
    rows = rows.unionByName(mark(entries, "entry", F.col(ident), none.alias("slot"), F.col(ident).cast("string").alias("ident"), F.col(cohort).alias("cohort")))
    rows = rows.unionByName(mark(settled, "settle", F.col(ident), none.alias("slot"), F.col(ident).cast("string").alias("ident"), none.alias("cohort")))
    rows = rows.withWatermark(ts, watermark).filter(of_rows(ts, F.col("_by").isNotNull()))
    rows = _day_and_freeze(rows, ts, freeze_at).withColumn("bucket_no", _bucket("_by", buckets)).drop("_by")
    amount, unit = grace.split()
    grace_ms = int(amount) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]
    schema = "day_text string, bucket_no int, turn bigint, rows bigint, covered array<string>, qualified bigint, observations bigint, pending bigint, refused bigint"
    out = _stateful(rows, ["day_text", "bucket_no"], _SessionFreeze(expected_slots, grace_ms), schema, "update", "EventTime")
    return out.select(F.to_date("day_text").alias("day"), F.col("bucket_no").alias("bucket"), "turn", "rows", "covered", "qualified", "observations", "pending", "refused")


def session_status(frozen: DataFrame, expected_slots: list[str], observation_target: int) -> DataFrame:
    """Integrity of each frozen session from its buckets' latest rows: what is missing decides, in order."""
    counts = ["rows", "qualified", "observations", "pending"]
    last = frozen.groupBy("day", "bucket").agg(F.max_by(F.struct(*counts, "covered"), "turn").alias("_s"), F.sum("refused").alias("refused"), F.max("turn").alias("turn"))
    flags = [F.max(F.array_contains("_s.covered", x).cast("int")).alias(f"_f{k}") for k, x in enumerate(expected_slots)]
    day = last.groupBy("day").agg(*[F.sum(f"_s.{c}").alias(c) for c in counts], F.sum("refused").alias("refused"), F.max("turn").alias("turn"), *flags).where("turn > 0")
    missing = F.array_compact(F.array(*[F.when(F.col(f"_f{k}") == 0, F.lit(x)) for k, x in enumerate(expected_slots)]))
    out = day.withColumn("missing_slots", F.array_join(missing, "|"))
    status = (
        F.when(F.col("missing_slots") != "", "INCOMPLETE").when(F.col("pending") > 0, "INCOMPLETE_ENTRY")
        .when(F.col("observations") != observation_target, "INCOMPLETE_OBSERVATION").otherwise("COMPLETE")
    )
    return out.select("day", *counts, "refused", "missing_slots", status.alias("status"))


class _HighWater(StatefulProcessor):
    """State of a bucket of keys: for each, the latest event time of the rows that came in."""

    def __init__(self, lateness_us: int):
        self.lateness_us = lateness_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.high = handle.getValueState("high", "marks string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        some = pd.concat(list(rows), ignore_index=True).sort_values(["arrived_us", "at_us", "ident"])
        low = -(1 << 62)
        high = dict(json.loads(self.high.get()[0])) if self.high.exists() else {}
        held = pd.Series([high.get(k, low) for k in some["key_text"]], index=some.index, dtype="int64")
        by = some.groupby("key_text", sort=False, dropna=False)["at_us"]
        marks = by.cummax()
        before = marks.groupby(some["key_text"], sort=False, dropna=False).shift(fill_value=low).clip(lower=held)
        top = by.max()
        for k, us in zip((None if k is None or k != k else k for k in top.index), top.tolist()):
            high[k] = max(us, high.get(k, low))
        self.high.update((json.dumps(list(high.items())),))
        yield pd.DataFrame({"packed": some["packed"], "behind": (before > low) & (some["at_us"] < before - self.lateness_us)})

    def close(self) -> None:
        pass


def stream_late_tier(s, key: str, ident: str, ts: str, arrival: str, limit_seconds: int, lateness_seconds: int, buckets: int = 256) -> DataFrame:
    """All rows with how late they are: ``tier``, ``prospective``, and ``behind`` their key's other rows.

    A row is ``behind`` if its key had a row more than ``lateness_seconds`` later when it arrived:
    what a watermark would drop silently. Such rows are never prospective. Only one time a key is
    kept (keys are dealt over ``buckets``), a micro-batch's rows of a key are gone through in order
    of arrival, and no row is lost.
    Rows without an event time or arrival are ``late`` and not behind.
    """
    wait = F.unix_timestamp(arrival) - F.unix_timestamp(ts)
    tier = F.when(wait <= limit_seconds, "prospective").when(F.to_date(arrival) == F.to_date(ts), "same_day_recovered").otherwise("late")
    tagged = s.withColumn("tier", tier)
    rows = tagged.select(
        F.col(key).cast("string").alias("key_text"), F.col(ident).cast("string").alias("ident"), F.coalesce(F.unix_micros(arrival), F.lit(0)).alias("arrived_us"),
        F.coalesce(F.unix_micros(ts), F.lit(-(1 << 61))).alias("at_us"), F.to_json(F.struct(*tagged.columns), _JSON).alias("packed"),
    ).withColumn("bucket_no", _bucket("key_text", buckets))
    out = _stateful(rows, ["bucket_no"], _HighWater(lateness_seconds * 1_000_000), "packed string, behind boolean", "append", "None")
    full = out.withColumn("_p", F.from_json("packed", _ddl(tagged), _JSON)).select("_p.*", "behind")
    full = full.withColumn("behind", F.col("behind") & F.col(ts).isNotNull())
    return full.withColumn("prospective", (F.col("tier") == "prospective") & ~F.col("behind"))


def split_late(tagged: DataFrame, path: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Run a stream of ``stream_late_tier`` into a main table and a side table of the rows that are behind."""
    def write(batch: DataFrame, batch_id: int) -> None:
        # in one go: the batch's state is computed anew for each write
        batch.withColumn("side", F.col("behind")).write.mode("overwrite").partitionBy("side").parquet(f"{path}/batch={batch_id}")

    tagged.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    out = tagged.sparkSession.read.option("basePath", path).schema(f"{_ddl(tagged)}, batch bigint, side boolean").parquet(path)
    return out.where("not side").drop("batch", "side"), out.where("side").drop("batch", "side")


class TruthLedger:
    """Candidates and the truth that settles them, merged batch by batch into a ledger of files.

    Batch ``b`` is made of its own rows and of what batch ``b - 1`` left open, and replaces its
    own folders: a batch that is tried again, or runs again after a restart, gives the same
    ledger. ``closed`` has each candidate once, in the batch that closed it; ``open`` has what may
    still be settled, so a batch's work follows what is open and not what the ledger has seen.

    A candidate (``key``, ``ident``, ``due``) is SETTLED by the first truth of its key seen in
    ``[due, due + within)``. It is EXPIRED once the ledger's clock, the latest event time of any
    row, has passed that range, and PENDING before. A candidate that comes again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], ident: str, kinds: dict[str, str], within: str):
        self.spark, self.path, self.key, self.ident, self.within = spark, path, key, ident, F.expr(f"interval {within}")
        self.types = {**{c: kinds[c] for c in (*key, ident)}, "ts": "timestamp", "due": "timestamp", "value": "double", "kind": "string"}
        self.schema = ", ".join(f"`{c}` {t}" for c, t in self.types.items())

    def rows(self, candidates: DataFrame, truth: DataFrame) -> DataFrame:
        """Candidates (``key, ident, ts, due``) and truth (``key, ts, value``) as one stream."""
        shaped = [
            df.withColumn("kind", F.lit(kind)).select(*[(F.col(c) if c in (*df.columns, "kind") else F.lit(None)).cast(t).alias(c) for c, t in self.types.items()])
            for df, kind in ((candidates, "candidate"), (truth, "truth"))
        ]
        return shaped[0].unionByName(shaped[1])

    def _read(self, table: str, schema: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{table}").schema(f"{schema}, batch bigint").parquet(f"{self.path}/{table}")

    def _closed(self) -> DataFrame:
        own = ", ".join(f"`{c}` {self.types[c]}" for c in (*self.key, self.ident))
        return self._read("closed", f"{own}, due timestamp, settled_at timestamp, truth_value double, status string")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        names = list(self.types)
        rows = batch.select(*names, F.lit(True).alias("new"))
        if batch_id:
            held = self._read("open", self.schema).where(F.col("batch") == batch_id - 1)
            rows = rows.unionByName(held.select(*names, F.lit(False).alias("new")))
        # two scalars of the batch: its clock, and how far back its candidates reach
        clock, low = rows.agg(F.max("ts"), F.min(F.when(F.col("new") & (F.col("kind") == "candidate"), F.col("due")))).first()
        who = [*self.key, self.ident]
        cand = rows.where("kind = 'candidate'").groupBy(*who).agg(F.min(F.struct("new", "ts", "due")).alias("_c")).select(*who, "_c.ts", "_c.due")
        if batch_id and low is not None:
            before = self._closed().where((F.col("batch") < batch_id) & (F.col("due") >= F.lit(low)))
            cand = cand.join(before.select(*who), who, "left_anti")
        truth = rows.where("kind = 'truth'").select(*self.key, "ts", "value").distinct()
        a, b = cand.alias("a"), truth.alias("b")
        hit = (F.col("b.ts") >= F.col("a.due")) & (F.col("b.ts") < F.col("a.due") + self.within)
        for k in self.key:
            hit = hit & (F.col(f"a.{k}") == F.col(f"b.{k}"))
        first = a.join(b, hit, "left").groupBy(*[F.col(f"a.{c}") for c in (*who, "ts", "due")]).agg(F.min(F.struct("b.ts", "b.value")).alias("_t"))
        now = F.lit(clock).cast("timestamp")
        status = F.when(F.col("_t.ts").isNotNull(), "SETTLED").when(holds(now >= F.col("due") + self.within), "EXPIRED").otherwise("PENDING")
        state = first.withColumn("status", status)
        done = state.where("status <> 'PENDING'").select(*who, "due", F.col("_t.ts").alias("settled_at"), F.col("_t.value").alias("truth_value"), "status")
        done.write.mode("overwrite").parquet(f"{self.path}/closed/batch={batch_id}")
        still = state.where("status = 'PENDING'").withColumns({"value": F.lit(None).cast("double"), "kind": F.lit("candidate")}).select(*names)
        usable = rows.where("kind = 'truth'").where(F.col("ts") + self.within > now).select(*names).distinct()
        # the clock outlives the rows that set it
        tick = self.spark.createDataFrame([(clock,)], "ts timestamp").select(*[(F.col("ts") if c == "ts" else F.lit("clock" if c == "kind" else None)).cast(t).alias(c) for c, t in self.types.items()])
        still.unionByName(usable).unionByName(tick).write.mode("overwrite").parquet(f"{self.path}/open/batch={batch_id}")

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Merge what there is of a stream of ``rows``."""
        stream.writeStream.foreachBatch(self.merge).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def ledger(self) -> DataFrame:
        """All candidates with their status; those still open are PENDING."""
        last = self._read("open", self.schema).agg(F.max("batch")).first()[0]
        done = self._closed().where(F.col("batch") <= last).drop("batch")
        still = self._read("open", self.schema).where((F.col("batch") == last) & (F.col("kind") == "candidate"))
        return done.unionByName(still.select(*self.key, self.ident, "due", F.lit(None).cast("timestamp").alias("settled_at"), F.lit(None).cast("double").alias("truth_value"), F.lit("PENDING").alias("status")))
