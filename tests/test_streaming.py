"""Streams fed by several files agree with the batch result; state, timers and merges keep their promises."""

import datetime as dt
import os

from pyspark.sql import functions as F

from tidemark.streaming import operators as st
from tidemark.streaming import state

START = dt.datetime(2024, 1, 1)
SCHEMA = "code string, ts timestamp, value double"


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def add(spark, folder, rows, schema, order):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    for f in os.listdir(folder):
        path = os.path.join(folder, f)
        if f.endswith(".parquet") and os.stat(path).st_mtime > 1_700_000_000:
            os.utime(path, (1_600_000_000 + order, 1_600_000_000 + order))


def read(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def feed(spark, folder, batches):
    """Write the batches as files, oldest first."""
    for i, rows in enumerate(batches):
        add(spark, folder, [(c, at(m), v) for c, m, v in rows], SCHEMA, i)
    return read(spark, folder, SCHEMA)


BATCHES = [[("a", 1, 1.0), ("a", 4, 3.0), ("b", 2, 9.0)], [("a", 6, 5.0), ("b", 7, 2.0)], [("a", 31, 7.0)]]
BARS = [("a", 1.0, 3.0, 2), ("a", 5.0, 5.0, 1), ("b", 2.0, 2.0, 1), ("b", 9.0, 9.0, 1)]


def test_bars_over_micro_batches(spark, tmp_path):
    s = feed(spark, str(tmp_path / "in"), BATCHES)
    out = st.drain(st.stream_bars(s, ["code"], "ts", "value", "5 minutes", "10 minutes"))
    assert sorted((r["code"], r["open"], r["close"], r["ticks"]) for r in out.collect()) == BARS


def test_heartbeat_closes_the_last_window(spark, tmp_path):
    # three batches and a row that is late for all windows
    s = feed(spark, str(tmp_path / "in"), [*BATCHES, [("a", 32, 8.0)], [("b", 3, 1.0)]])
    beat = state.Heartbeat(spark)
    bars = st.stream_bars(beat.join(s, "ts"), ["code"], "ts", "value", "5 minutes", "10 minutes")
    out = st.drain(bars, closing=beat, at=at(500))
    assert sorted((r["code"], r["open"], r["close"], r["ticks"]) for r in out.collect()) == sorted([*BARS, ("a", 7.0, 8.0, 2)])


SIGNAL = "code string, ts timestamp, id long, value double"


def test_first_signal_is_emitted_at_once_and_never_changes(spark, tmp_path):
    folder = str(tmp_path / "in")
    batches = [
        [("a", at(10), 1, 1.0), ("a", at(12), 2, 5.0), ("b", at(11), 3, 1.0)],
        [("a", at(20), 4, 6.0), ("a", at(12), 2, 5.0), ("b", at(21), 5, 7.0)],  # 2 is replayed
        [("a", at(9), 6, 8.0), ("b", at(700), 7, 9.0), ("c", at(701), 8, 9.0)],  # 6 is earlier than the first, 7 and 8 come after the freeze
    ]
    for i, rows in enumerate(batches):
        add(spark, folder, rows, SIGNAL, i)
    beat = state.Heartbeat(spark)
    s = state.stream_first_signal(beat.join(read(spark, folder, SIGNAL), "ts"), "code", "ts", F.col("value") >= 5, "id", ["id", "value"], "30 minutes", "11:00")
    changes = state.updates(s, beat, at(3000))
    rows = changes.orderBy("batch", "code").collect()
    told = [(r.batch, r.code, r.event, r.id, r.appearances, r.last_seen) for r in rows if r.event in ("NEW", "SEEN")]
    assert told[:3] == [(0, "a", "NEW", 2, 1, at(12)), (1, "a", "SEEN", 2, 2, at(20)), (1, "b", "NEW", 5, 1, at(21))]
    assert told[3][1:] == ("a", "SEEN", 2, 3, at(20))  # the first stays, though a row before it came
    assert {(r.code, r.id) for r in rows if r.event == "REFUSED"} == {("b", 7), ("c", 8)}
    assert {r.code for r in rows if r.event == "FROZEN"} == {"a", "b"}
    last = {r.code: (r.first_seen, r.id, r.value, r.appearances, r.refused, r.status) for r in state.current_signals(changes, "code", ["id", "value"]).collect()}
    assert last["a"] == (at(12), 2, 5.0, 3, 0, "FROZEN") and last["b"][1:] == (5, 7.0, 1, 1, "FROZEN") and "c" not in last


def test_rows_that_fail_the_condition_still_move_the_clock(spark, tmp_path):
    folder = str(tmp_path / "in")
    for i, rows in enumerate([[("a", at(10), 1, 5.0)], [("a", at(3000), 2, 0.0)]]):
        add(spark, folder, rows, SIGNAL, i)
    s = state.stream_first_signal(read(spark, folder, SIGNAL), "code", "ts", F.col("value") >= 5, "id", ["id"], "30 minutes", "11:00")
    assert [r.event for r in state.updates(s).orderBy("batch").collect()] == ["NEW", "FROZEN"]


def test_missing_bar_becomes_non_fill_and_all_reasons_are_told(spark, tmp_path):
    signals = feed(spark, str(tmp_path / "s"), [[("a", 1, 1.0), ("b", 1, 1.0), ("c", 1, 1.0)], [("d", 2, 1.0)], [("e", 600, 1.0)]])
    bars = feed(spark, str(tmp_path / "b"), [[("a", 6, 10.0), ("c", 6, -1.0)], [("d", 7, 4.0)], []])
    beat = state.Heartbeat(spark)
    signals = beat.join(signals, "ts", code="-").withColumn("due", F.expr("ts + interval 5 minutes")).select("code", "due")
    bars = beat.join(bars, "ts", code="-").select("code", F.col("ts").alias("bar_ts"), F.col("value").alias("price"), (F.col("value") * 100).alias("amount"), F.lit(None).cast("double").alias("age"))
    reasons = {"bad_price": ~(F.col("price") > 0), "thin_bar": F.col("amount") < 500, "stale_bar": F.col("age").isNotNull() & (F.col("age") > 9)}
    out = st.drain(st.stream_entry_settle(signals, bars, ["code"], "due", "bar_ts", "10 minutes", reasons), closing=beat, at=at(2000))
    got = {r["code"]: (r["status"], r["reason"]) for r in out.collect()}
    assert got == {"a": ("SETTLED", ""), "b": ("NON_FILL", "missing_bar"), "c": ("NON_FILL", "bad_price|thin_bar"), "d": ("NON_FILL", "thin_bar"), "e": ("NON_FILL", "missing_bar")}


EVENTS = "kind string, ts timestamp, name string, cohort string"


def test_freeze_by_timer_over_slots_and_entries(spark, tmp_path):
    day = 1440
    batches = [
        [("slot", at(5), "00", None), ("entry", at(6), "x", "QUALIFIED"), ("entry", at(7), "y", "OBSERVATION"), ("slot", at(day + 5), "00", None)],
        [("slot", at(day + 61), "01", None), ("settle", at(day + 62), "nobody", None), ("entry", at(day + 63), "z", "OBSERVATION")],
        [("settle", at(day + 70), "z", None), ("slot", at(2 * day + 1), "00", None), ("slot", at(2 * day + 61), "01", None)],
        [("settle", at(3), "x", None), ("slot", at(2 * day + 130), "01", None), ("slot", at(3 * day + 1), "00", None)],  # too late, after the freeze
    ]
    folder = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        add(spark, folder, rows, EVENTS, i)
    part = lambda kind: read(spark, folder, EVENTS).where(F.col("kind") == kind)
    beat = state.Heartbeat(spark)
    frozen = state.stream_freeze(beat.join(part("slot"), "ts"), part("entry"), part("settle"), "ts", "name", "ts", "name", "cohort", ["00", "01"], "02:00", "10 minutes", "1 hour", buckets=3)
    out = state.session_status(state.updates(frozen, beat, at(20 * day)), ["00", "01"], 1)
    got = {(r.day - START.date()).days: (r.rows, r.qualified, r.observations, r.pending, r.refused, r.missing_slots, r.status) for r in out.collect()}
    assert got == {
        0: (1, 1, 1, 2, 0, "01", "INCOMPLETE"), 1: (2, 0, 1, 0, 0, "", "COMPLETE"), 2: (2, 0, 0, 0, 1, "", "INCOMPLETE_OBSERVATION"), 3: (1, 0, 0, 0, 0, "01", "INCOMPLETE"),
    }


def test_settlement_in_grace_refreshes_a_frozen_session(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [[("slot", at(5), "00", None), ("entry", at(6), "x", "QUALIFIED")], [("slot", at(140), "01", None)], [("slot", at(141), "01", None)], [("settle", at(145), "x", None)]]
    for i, some in enumerate(rows):
        add(spark, folder, some, EVENTS, i)
    part = lambda kind: read(spark, folder, EVENTS).where(F.col("kind") == kind)
    frozen = state.stream_freeze(part("slot"), part("entry"), part("settle"), "ts", "name", "name", "name", "cohort", ["00"], "02:00", "10 minutes", "1 hour", buckets=1)
    told = state.updates(frozen)
    assert [(r.turn, r.pending) for r in told.where("turn > 0").orderBy("turn").collect()] == [(1, 1), (2, 0)]
    assert state.session_status(told, ["00"], 0).first().status == "COMPLETE"


def test_late_rows_go_to_a_side_table(spark, tmp_path):
    schema = "code string, id long, ts timestamp, arrival timestamp"
    batches = [
        [("a", 1, at(10), at(10)), ("a", 2, at(60), at(60)), ("b", 3, at(5), at(61))],
        [("a", 4, at(20), at(62)), ("a", 5, at(55), at(63)), ("b", 6, at(6), at(64)), ("c", 7, None, at(64))],
        [("b", 8, at(500), at(500)), ("b", 9, at(499), at(501)), ("b", 10, at(100), at(502))],
    ]
    folder = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        add(spark, folder, rows, schema, i)
    tagged = state.stream_late_tier(read(spark, folder, schema), "code", "id", "ts", "arrival", 600, 1800)
    main, side = state.split_late(tagged, str(tmp_path / "out"), str(tmp_path / "check"))
    assert {r.id for r in side.collect()} == {4, 10} and main.count() + side.count() == 10
    assert {r.id for r in main.where("prospective").collect()} == {1, 2, 5, 8, 9} and side.where("prospective").count() == 0
    assert main.where("id = 7").first().tier == "late"


def test_late_rows_of_many_keys_are_few_states(spark, tmp_path):
    folder, calls = str(tmp_path / "in"), spark.sparkContext.accumulator(0)

    class Counted(state._HighWater):
        def handleInputRows(self, key, rows, timerValues):
            calls.add(1)
            yield from super().handleInputRows(key, rows, timerValues)

    plain, schema = state._HighWater, "code string, id long, ts timestamp, arrival timestamp"
    for i, (t, a) in enumerate([(100, 100), (60, 101)]):
        rows = [(f"k{k}", 1000 * i + k, at(t), at(a)) for k in range(300)]
        add(spark, folder, [*rows, (None, 5000 + i, at(t), at(a))], schema, i)
    state._HighWater = Counted
    try:
        tagged = state.stream_late_tier(read(spark, folder, schema), "code", "id", "ts", "arrival", 600, 1800, buckets=5)
        main, side = state.split_late(tagged, str(tmp_path / "out"), str(tmp_path / "check"))
    finally:
        state._HighWater = plain
    assert {r.id for r in main.collect()} == {*range(300), 5000} and {r.id for r in side.collect()} == {*range(1000, 1300), 5001}
    assert calls.value <= 2 * 6  # a bucket more for none; each batch's state is computed once


def test_truth_ledger_survives_replays_and_restarts(spark, tmp_path):
    cand, truth = "code string, id long, ts timestamp, due timestamp", "code string, ts timestamp, value double"
    folders = [str(tmp_path / x) for x in ("c", "t")]
    candidates = [
        [("a", 1, at(0), at(100)), ("b", 2, at(0), at(100)), ("c", 3, at(1), at(100))],
        [("a", 1, at(0), at(100)), ("d", 4, at(90), at(900))],  # 1 comes again while open
        [("a", 1, at(0), at(100)), ("e", 5, at(200), at(1000))],  # and when closed
    ]
    truths = [[("a", at(50), 0.5)], [("a", at(110), 1.0), ("a", at(120), 2.0)], [("a", at(130), 3.0), ("b", at(185), 4.0), ("d", at(190), 9.0)]]
    for i in range(3):
        add(spark, folders[0], candidates[i], cand, i)
        add(spark, folders[1], truths[i], truth, i)
    path, check = str(tmp_path / "book"), str(tmp_path / "check")
    book = state.TruthLedger(spark, path, ["code"], "id", {"code": "string", "id": "bigint"}, "1 hour")
    stream = lambda: book.rows(read(spark, folders[0], cand), read(spark, folders[1], truth))
    book.run(stream(), check)
    show = lambda: sorted((r.id, r.settled_at, r.truth_value, r.status) for r in book.ledger().collect())
    want = [(1, at(110), 1.0, "SETTLED"), (2, None, None, "EXPIRED"), (3, None, None, "EXPIRED"), (4, None, None, "PENDING"), (5, None, None, "PENDING")]
    assert show() == want
    # a batch that runs again replaces its own output and nothing else
    last = max(int(x.split("=")[1]) for x in os.listdir(f"{path}/closed"))
    again = spark.createDataFrame([(*x, None, "candidate") for x in candidates[2]], "code string, id long, ts timestamp, due timestamp, value double, kind string").unionByName(
        spark.createDataFrame([(c, None, t, None, v, "truth") for c, t, v in truths[2]], "code string, id long, ts timestamp, due timestamp, value double, kind string"))
    book.merge(again, last)
    assert show() == want
    # a restart goes on from the open rows
    add(spark, folders[1], [("d", at(930), 6.0), ("e", at(999), 1.0)], truth, 9)
    state.TruthLedger(spark, path, ["code"], "id", {"code": "string", "id": "bigint"}, "1 hour").run(stream(), check)
    assert show() == [*want[:3], (4, at(930), 6.0, "SETTLED"), (5, None, None, "PENDING")]


def test_first_signals_of_many_keys_are_few_states(spark, tmp_path):
    folder, calls = str(tmp_path / "in"), spark.sparkContext.accumulator(0)

    class Counted(state._FirstSignal):
        def handleInputRows(self, key, rows, timerValues):
            calls.add(1)
            yield from super().handleInputRows(key, rows, timerValues)

    plain = state._FirstSignal
    add(spark, folder, [(f"k{k}", at(k % 600), k, 5.0) for k in range(400)], SIGNAL, 0)
    state._FirstSignal = Counted
    try:
        s = state.stream_first_signal(read(spark, folder, SIGNAL), "code", "ts", F.col("value") >= 5, "id", ["id"], "30 minutes", "11:00", buckets=5)
        got = state.updates(s).collect()
    finally:
        state._FirstSignal = plain
    assert {r.event for r in got} == {"NEW"} and len({r.code for r in got}) == 400
    assert calls.value <= 5
