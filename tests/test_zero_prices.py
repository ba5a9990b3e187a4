"""Streaming queries over events of value zero give the rows of their SQL."""

import datetime as dt
import math

import duckdb

from tidemark.plans import REGISTRY

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def both(spark, folder, name, rows):
    """Rows of a query and of its SQL over these events (``hour, minute, user, type, value``)."""
    events = [(k, dt.datetime(2024, 1, 1 + h // 24, h % 24, m), user, kind, value, "{}") for k, (h, m, user, kind, value) in enumerate(rows)]
    path = f"{folder}/events.parquet"
    part = f"{folder}/parts"
    spark.createDataFrame(events, EVENTS).coalesce(1).write.parquet(part)
    con = duckdb.connect()
    con.execute(f"copy (select * from '{part}/*.parquet') to '{path}' (format parquet)")
    con.execute(f"create view events as select * from '{path}'")
    query = REGISTRY[name]
    text = lambda row: tuple("null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) and math.isfinite(v) else str(v) for v in row)
    got = query.dataframe(spark, str(folder))
    want = con.execute(query.oracle())
    assert got.columns == [c[0] for c in want.description]
    return sorted(map(text, got.collect())), sorted(map(text, want.fetchall()))


def test_entry_on_a_bar_of_price_zero(spark, tmp_path):
    rows = [(9, 30, 1, "click", 5.0), (10, 0, 1, "view", 0.0), (9, 31, 2, "click", 5.0), (10, 0, 2, "view", 70.0), (9, 32, 3, "click", 5.0)]
    # bars count by the hour they open in
    rows += [(20, 0, 4, "view", 90.0), (20, 0, 4, "click", 1.0)]
    got, want = both(spark, tmp_path, "stream_entry_settle", rows)
    assert got == want and any("bad_price" in r[-1] for r in got)


def test_slot_context_with_bars_that_open_at_zero(spark, tmp_path):
    # first cross-section: one infinite return; second: most are infinite or NaN; third: none
    rows = [(1, 0, 1, "view", 0.0), (2, 0, 1, "view", 5.0), (1, 0, 2, "view", 4.0), (2, 0, 2, "view", 6.0), (1, 0, 3, "click", 8.0)]
    rows += [(7, 0, u, "view", 0.0) for u in (1, 2, 3)] + [(8, 0, 1, "view", 5.0), (8, 0, 2, "view", 6.0), (7, 0, 4, "view", 2.0), (8, 0, 4, "view", 1.0), (8, 0, 5, "view", 1.0)]
    rows += [(13, 0, u, "view", u + 1.0) for u in (1, 2, 3)] + [(14, 0, u, "view", 4.0) for u in (1, 2, 3)]
    got, want = both(spark, tmp_path, "stream_slot_context", rows)
    assert got == want and any("inf" in r for r in got)
