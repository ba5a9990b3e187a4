"""Islands of equal intervals, whatever the order of their rows."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import cleaning, spread

D = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)


def islands(spark, rows):
    df = spark.createDataFrame([(c, *(None if x is None else D(x) for x in ab)) for c, *ab in rows], "code int, start date, end date").repartition(5)
    return sorted((r.code, str(r.start), str(r.end), r.parts) for r in cleaning.coverage_islands(df, ["code"]).collect())


def test_equal_intervals(spark):
    rows = [(1, a, a + 4) for a in (0, 10, 30) for _ in range(6)] + [(1, 15, 16)] * 4 + [(2, 3, 9)] * 3
    want = [(1, str(D(0)), str(D(4)), 6), (1, str(D(10)), str(D(16)), 10), (1, str(D(30)), str(D(34)), 6), (2, str(D(3)), str(D(9)), 3)]
    assert islands(spark, rows) == want
    spark.conf.set(spread.LIMIT, "3")
    try:
        assert islands(spark, rows) == want
    finally:
        spark.conf.unset(spread.LIMIT)


def test_intervals_without_dates(spark):
    rows = [(1, None, None), (1, 0, 4), (1, 20, 24), (1, None, None), (2, None, None), (2, None, None)]
    assert islands(spark, rows) == [(1, str(D(0)), str(D(4)), 1), (1, str(D(20)), str(D(24)), 3), (2, "None", "None", 2)]


def test_equal_intervals_are_one_row_of_the_windows(spark, monkeypatch):
    sizes, plain = [], cleaning.running

    def counted(df, *args, **kwargs):
        sizes.append(df.count())
        return plain(df, *args, **kwargs)

    monkeypatch.setattr(cleaning, "running", counted)
    df = spark.range(60).select(F.lit(1).alias("code"), F.lit(D(0)).alias("start"), F.lit(D(3)).alias("end"))
    assert cleaning.coverage_islands(df, ["code"]).first().parts == 60
    assert sizes == [1, 1]
