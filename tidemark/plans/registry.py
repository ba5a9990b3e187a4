"""Query registry: a Spark callable, its typed output and an independent SQL text.

The output spec lists ``name:type`` pairs. Types: i bigint, r double rounded to six
decimals, m double rounded to two (large sums), d date as text, b boolean, s string.
Both engines get the same casts, so only values are compared.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rounded
from .tables import VIEWS, Tables

REGISTRY: dict[str, "Query"] = {}


@dataclass
class Query:
    name: str
    run: Callable
    out: list[tuple[str, str]]
    sql: str | None

    def dataframe(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.run(Tables(spark, sf_dir))
        return df.select(*[_spark_cast(n, t) for n, t in self.out])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = ", ".join(_sql_cast(n, t) for n, t in self.out)
        return f"{with_views(self.sql)} SELECT {cols} FROM ({self.sql}) q"


def _spark_cast(name, kind):
    c = F.col(name)
    if kind == "i":
        c = c.cast("bigint")
    elif kind == "r":
        c = rounded(c.cast("double"), 6) + F.lit(0.0)
    elif kind == "m":
        c = rounded(c.cast("double"), 2) + F.lit(0.0)
    elif kind in "ds":
        c = c.cast("string")
    elif kind == "b":
        c = c.cast("boolean")
    return c.alias(name)


def _sql_cast(name, kind):
    form = {
        "i": "CAST({n} AS BIGINT)",
        "r": "round(CAST({n} AS DOUBLE), 6) + 0.0::DOUBLE",
        "m": "round(CAST({n} AS DOUBLE), 2) + 0.0::DOUBLE",
        "d": "CAST({n} AS VARCHAR)",
        "s": "CAST({n} AS VARCHAR)",
        "b": "CAST({n} AS BOOLEAN)",
    }[kind]
    return form.format(n=name) + f" AS {name}"


def with_views(sql: str) -> str:
    """WITH clause for the fixture views a text uses, in dependency order."""
    needed: list[str] = []

    def visit(text):
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return ""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)


def query(name: str, out: str, sql: str | None = None):
    spec = [tuple(p.split(":")) for p in out.split()]

    def register(fn):
        assert name not in REGISTRY, name
        REGISTRY[name] = Query(name, fn, spec, sql)
        return fn

    return register
