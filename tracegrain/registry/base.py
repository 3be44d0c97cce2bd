"""Registration of runnable queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Source:
    """Views of one scale-factor folder by attribute: `src.log`, `src.documents`."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return views.view(self.spark, self.sf_dir, name)

    def sql(self, text: str) -> DataFrame:
        return views.sql(self.spark, self.sf_dir, text)


def query(name: str, oracle: str | None = None) -> Callable[[Callable[[Source], DataFrame]], Callable]:
    """Register `fn(src)` under `name`; `oracle` may use `@view` references."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Source(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = views.oracle(oracle)
        return fn

    return register
