"""Column profiles that add up: profiles of single files merge without a scan of their rows.

A state holds counts, mean and squared deviations, ends and a sketch of the distinct values (HyperLogLog) for each column.
Daily states may become monthly ones and those a yearly one. ``nunique`` is an estimate with a relative standard error of about
``1.04 / sqrt(2 ** lg)``, and different groupings may differ by as much; everything else is as exact as in one scan.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import comparable, long_stats
from .roles import FLOATS, INTEGERS

LG = 12
STATE_SCHEMA = ("column_name string, rows bigint, count bigint, mean double, squares double, min_value double, max_value double, "
                "min_text string, max_text string, sketch string")


def profile_state(df: DataFrame, cols: Sequence[str] | None = None, lg: int = LG) -> DataFrame:
    """One row per column with what merging needs; one aggregate per 100 columns, no value is shuffled.

    NaN counts as null. A table without rows gives zero counts and null ends. The sketch is base64 text, so a state fits a JSON sidecar.
    """
    names = list(df.columns if cols is None else cols)
    numbers = {f.name for f in df.schema if isinstance(f.dataType, (*INTEGERS, *FLOATS))}
    items = {}
    for f in df.schema:
        x = F.col(f"`{f.name}`")
        items[f.name] = F.when(~F.isnan(x), x + F.lit(0.0).cast(f.dataType)) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else x
    clean = df.select(*[items[n].alias(n) for n in names])

    def stats(kind: bool):
        def of(x: Column) -> dict[str, Column]:
            number = x.cast("double") if kind else F.lit(None).cast("double")
            text = F.lit(None).cast("string") if kind else x.cast("string")
            return {"rows": F.count(F.lit(1)), "count": F.count(x), "mean": F.avg(number), "squares": F.var_pop(number) * F.count(number),
                    "min_value": F.min(number), "max_value": F.max(number), "min_text": F.min(text), "max_text": F.max(text)}
        return of

    parts = [long_stats(clean, some, stats(kind), key="column_name")
             for kind in (True, False) if (some := [n for n in names if (n in numbers) == kind])]
    # doubles are sketched as the text of their value
    texts = clean.select(*[comparable(n, clean.schema[n].dataType)[1].cast("string").alias(n) for n in names])
    sketches = long_stats(texts, names, lambda x: {"sketch": F.base64(F.hll_sketch_agg(x, F.lit(lg)))}, key="column_name")
    return reduce(DataFrame.unionByName, parts).join(F.broadcast(sketches), "column_name")


def merge_states(states: DataFrame) -> DataFrame:
    """One state per column out of any number of them (a union of states); squared deviations are taken about the common mean."""
    centre = states.groupBy("column_name").agg((F.sum(F.col("count") * F.col("mean")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("count")))).alias("centre"))
    moved = F.col("squares") + F.col("count") * F.pow(F.col("mean") - F.col("centre"), 2)
    joined = states.join(F.broadcast(centre), "column_name")
    return joined.groupBy("column_name").agg(
        F.sum("rows").alias("rows"), F.sum("count").alias("count"), F.first("centre").alias("mean"), F.sum(moved).alias("squares"),
        F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.min("min_text").alias("min_text"), F.max("max_text").alias("max_text"),
        F.base64(F.hll_union_agg(F.unbase64("sketch"), True)).alias("sketch"))


def state_profile(states: DataFrame) -> DataFrame:
    """Readable form: missing cells, count, mean, std, ends and the estimated number of distinct values."""
    std = F.when(F.col("count") > 1, F.sqrt(F.col("squares") / (F.col("count") - 1)))
    return states.select("column_name", (F.col("rows") - F.col("count")).alias("n_missing"), "count", "mean", std.alias("std"), "min_value", "max_value",
                         "min_text", "max_text", F.hll_sketch_estimate(F.unbase64("sketch")).alias("nunique"))


def write_state(states: DataFrame, path: str) -> None:
    """A sidecar of JSON lines beside the column profile, one per column."""
    states.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_states(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """States of one or more sidecars, to be merged."""
    return spark.read.schema(STATE_SCHEMA).json(paths if isinstance(paths, str) else list(paths))
