"""Query registry: every operator's showcase query paired with its DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    name: str
    fn: QueryFn
    sql: str | None
    operators: tuple[str, ...]


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None, operators: tuple[str, ...] = ()) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain_types(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = Entry(name, run, sql, operators)
        return fn
    return deco


def plain_types(df: DataFrame) -> DataFrame:
    """Result boundary: DECIMAL columns are delivered as DOUBLE (the exact decimal value
    rounded once), so results compare the same across engines."""
    if not any(isinstance(f.dataType, T.DecimalType) for f in df.schema.fields):
        return df
    return df.select([F.col(f.name).cast("double").alias(f.name)
                      if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
                      for f in df.schema.fields])
