"""Registered queries with, where SQL can express them, an equivalent statement."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# train rows were shipped before this day, test rows on or after it
CUT = "2000-06-17"
LINE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def line_halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, folder, "lineitem")
    early = F.col("l_shipdate") < F.lit(CUT).cast("timestamp_ntz")
    return lines.filter(early), lines.filter(~early)


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Doubles rounded for comparison; all double columns unless some are named."""
    chosen = cols or [f.name for f in df.schema if f.dataType.typeName() == "double"]
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if c in chosen else F.col(f"`{c}`") for c in df.columns])


TRAIN_SQL = f"SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUT}'"
TEST_SQL = f"SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '{CUT}'"
