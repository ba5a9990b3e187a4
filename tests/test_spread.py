"""Both paths of the group building blocks must agree."""

from pyspark.sql import functions as F

from tidemark.functions import hash_int
from tidemark.operators import spread


def sample(spark):
    base = spark.range(400).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 11)).alias("k"),
        F.col("id").alias("t"),
        (hash_int("id") % 50).cast("double").alias("v"),
    )
    return base.withColumn("v", F.when(F.col("t") % 7 != 0, F.col("v")))


def both(spark, build):
    df = sample(spark)
    spark.conf.set(spread.LIMIT, "100000")
    plain = sorted(map(tuple, build(df).collect()), key=str)
    spark.conf.set(spread.LIMIT, "7")
    cut = sorted(map(tuple, build(df).collect()), key=str)
    spark.conf.unset(spread.LIMIT)
    assert plain == cut and len(plain) > 0
    return plain


def test_running(spark):
    aggs = {k: (k, F.col("v")) for k in ("sum", "count", "min", "max", "first", "last")}
    both(spark, lambda d: spread.running(d, ["k"], [F.col("t")], aggs))
    both(spark, lambda d: spread.running(d, ["k"], [F.col("t").desc()], aggs, current=False))


def test_nearby(spark):
    def build(w):
        return {
            "prev": F.lag("v", 2).over(w),
            "nxt": F.lead("v", 1).over(w),
            "m": F.max("v").over(w.rowsBetween(-4, 0)),
        }

    both(spark, lambda d: spread.nearby(d, ["k"], [F.col("t")], build, back=4, ahead=1))


def test_ranks_and_quantiles(spark):
    both(spark, lambda d: spread.percentile_rank(d, ["k"], "v", "r", desc=True))
    both(spark, lambda d: spread.average_rank(d, ["k"], "v", "r"))
    both(
        spark,
        lambda d: spread.group_values(
            d, ["k"], {"q": ("quantile", "v", 0.5), "p": ("quantile", "v", 0.9), "s": F.sum("v")}
        ).withColumn("p", F.round("p", 9)),
    )


def test_rank_matches_pandas(spark):
    df = sample(spark)
    got = spread.percentile_rank(df, ["k"], "v", "r").toPandas()
    want = got.groupby("k")["v"].rank(method="average", pct=True)
    assert ((got["r"] - want).abs().fillna(0) < 1e-12).all()
    assert (got["r"].isna() == want.isna()).all()
