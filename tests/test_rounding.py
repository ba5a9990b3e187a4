"""Values that lie between two last digits are rounded as their SQL rounds them."""

import duckdb
import pytest
from test_zero_prices import both

from tidemark.functions import rounded


@pytest.mark.parametrize("digits", [2, 6, 9])
def test_ties_as_in_sql(spark, digits):
    values = [sign * float(f"{k}.{tail:0{digits}d}5") for k in (0, 1, 37, 901) for tail in range(1, 10**digits, max(1, 10**digits // 997)) for sign in (1, -1)]
    values += [0.5176875, 1.7e308, float("inf"), float("-inf"), float("nan"), None, -0.0, 12345678901.2345678]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(rounded("x", digits)).collect()]
    want = [r[0] for r in duckdb.execute(f"select round(x, {digits}) from (select unnest(?::double[]) x)", [values]).fetchall()]
    assert list(map(repr, [None if v is None else v + 0.0 for v in got])) == list(map(repr, [None if v is None else v + 0.0 for v in want]))


def test_breadth_between_two_digits(spark, tmp_path):
    # 41 of 640 bars rise: a breadth of 0.0640625
    rows = [(1, 0, u, "view", 2.0) for u in range(640)] + [(2, 0, u, "view", 3.0 if u < 41 else 1.0) for u in range(640)]
    got, want = both(spark, tmp_path, "stream_slot_context", rows)
    assert got == want and len(got) == 640
