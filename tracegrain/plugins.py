"""Extension points: embedders, rerankers and table functions supplied by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from .operators.facts import RuleBook  # noqa: F401  (rule registration lives with the rules)


def embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[Column], Column]:
    """A column function from text to vector; `load` runs once per task and returns the batch function."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model(texts.fillna("").tolist()))

    return lambda text: embed(text)


def embed_entities(entities: DataFrame, text: Column, model: Callable[[Column], Column], version: str) -> DataFrame:
    """Entity rows with their vector and its version tag."""
    return entities.withColumns({"vector": model(text), "version": F.lit(version)})


def reranker(load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[[Column, Column], Column]:
    """A column function scoring (query, text) pairs in batches."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, texts in batches:
            yield pd.Series(model(queries.tolist(), texts.tolist()))

    return lambda query, text: score(query, text)


class _Fragments:
    """Lines of a text as rows: the shape of a 1 to n extractor written in Python."""

    def eval(self, text: str):
        for number, line in enumerate((text or "").splitlines(), start=1):
            if line.strip():
                yield number, line.strip()


def register_fragments(spark: SparkSession, name: str = "text_fragments") -> None:
    spark.udtf.register(name, udtf(_Fragments, returnType="line int, fragment string"))
