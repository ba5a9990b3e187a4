"""The registered model queries fit models of the operators' default size."""

import pytest

import __spark_entry__ as entry
from tidemark.operators import models


class Asked(Exception):
    pass


@pytest.mark.parametrize("name", ["fit_logistic_blend", "fit_return_blend", "walk_forward_blend"])
def test_default_size(spark, monkeypatch, name):
    def asked(**kw):
        raise Asked(kw["maxIter"], kw["maxDepth"])

    monkeypatch.setattr(models, "GBTClassifier", asked)
    monkeypatch.setattr(models, "GBTRegressor", asked)
    with pytest.raises(Asked) as e:
        entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert e.value.args == (10, 3)
