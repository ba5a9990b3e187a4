"""Registered queries give the same rows when every group counts as huge."""

import pytest

from tidemark.operators import spread
from tidemark.plans import REGISTRY

SF = "/root/testdata/sf0.001"
NAMES = [
    "lagged_returns", "rolling_drawdown", "expanding_path", "cs_percentile_rank", "market_context", "asof_join_backward",
    "interval_flag_join", "coverage_gaps", "loo_peer_features", "binary_rank_auc", "weighted_quantile", "score_quantile_summary",
]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    query = REGISTRY[name]
    plain = sorted(map(str, query.dataframe(spark, SF).collect()))
    spark.conf.set(spread.LIMIT, "3")
    try:
        cut = sorted(map(str, query.dataframe(spark, SF).collect()))
    finally:
        spark.conf.unset(spread.LIMIT)
    assert plain == cut and plain
