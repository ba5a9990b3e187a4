"""Session features take one shuffle of lines for bars and one for candidates, and none of their own."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import session_features as sf

SHUFFLES = {"minute_microstructure": 2, "full_session_path": 2, "post_alert_confirmation": 2}


@pytest.mark.parametrize("name", SHUFFLES)
def test_shuffles_of_lines_alone(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == SHUFFLES[name] and "Join" not in plan


def test_keys_that_are_null_see_no_bars(spark):
    bars = spark.sql("SELECT code, 'd' AS day, timestamp_ntz'2024-03-04 09:40:00' AS ts, 1D AS open, 1D AS high, 1D AS low, 1D AS close, 1D AS amount, 1D AS vol FROM VALUES ('a'), (NULL) AS t(code)")
    cands = bars.select("code", "day", F.lit("s").alias("slot"), F.col("close").alias("price"), F.expr("ts + interval 5 minutes").alias("cutoff"))
    for make, rows in ((sf.minute_microstructure, "m_rows"), (sf.full_session_path, "s_rows")):
        got = {r.code: r[rows] for r in make(cands, bars, ["code", "day", "slot"], **({"start": "09:30"} if rows == "m_rows" else {})).collect()}
        assert got == {"a": 1, None: 0}
