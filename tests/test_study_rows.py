"""The study's summary reads the rows it selected; the panel isn't computed again for each metric."""

import __spark_entry__ as entry


def test_study_rows_are_kept(spark):
    df = entry.queries()["flagship_study"](spark, "/root/testdata/sf0.001")
    assert all("stored-" in name for name in df.inputFiles())
    assert "l_orderkey" not in df._jdf.queryExecution().optimizedPlan().toString()
