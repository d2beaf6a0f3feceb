"""One-pass statistics of many columns, returned in long form."""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS_PER_JOB = 100


def long_stats(df: DataFrame, cols: Sequence[str], stats: Callable[[Column], Mapping[str, Column]],
               key: str = "feature") -> DataFrame:
    """One row per column with the named statistics, from one aggregate per 100 columns.

    The statistics are computed in a single wide aggregate (map-side combined, one row leaves
    each task) and only that one row is turned into long form.
    """
    parts = []
    for at in range(0, len(cols), COLUMNS_PER_JOB):
        block = list(cols[at:at + COLUMNS_PER_JOB])
        aggs, structs = [], []
        for i, c in enumerate(block):
            made = stats(F.col(f"`{c}`"))
            aggs += [v.alias(f"{i}_{s}") for s, v in made.items()]
            structs.append(F.struct(F.lit(c).alias(key), *[F.col(f"{i}_{s}").alias(s) for s in made]))
        parts.append(df.agg(*aggs).select(F.inline(F.array(*structs))))
    return reduce(DataFrame.unionByName, parts)


def comparable(name: str, dtype: T.DataType) -> tuple[str, Column]:
    """A value as a long, a double or text: equal there exactly when equal as it is."""
    x = F.col(f"`{name}`")
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return "long", x.cast("long")
    if isinstance(dtype, T.TimestampType):
        return "long", F.unix_micros(x)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double", x.cast("double")
    if isinstance(dtype, T.BinaryType):
        return "string", F.hex(x)
    if isinstance(dtype, (T.ArrayType, T.StructType)):
        return "string", F.when(x.isNotNull(), F.to_json(F.struct(x.alias("x"))))
    return "string", x.cast("string")


def distinct_counts(df: DataFrame, cols: Sequence[str], key: str = "feature", out: str = "nunique") -> DataFrame:
    """Exact number of distinct non-null values of each column, one row per column (none for an empty table).

    Rows turn into (column, value) items that each task combines, so only distinct values are shuffled. Several distinct
    aggregates side by side would copy every row once for each column and shuffle the copies on all columns.
    """
    parts = []
    for at in range(0, len(cols), COLUMNS_PER_JOB):
        block = list(cols[at:at + COLUMNS_PER_JOB])
        made = [comparable(c, df.schema[c].dataType) for c in block]
        kinds = sorted({kind for kind, _ in made})
        items = [F.struct(F.lit(i).alias("__at"), *[(value if kind == k else F.lit(None).cast(k)).alias(f"__{k}") for k in kinds])
                 for i, (kind, value) in enumerate(made)]
        some = F.greatest(*[F.col(f"__{k}").isNotNull() for k in kinds], F.lit(False))
        counted = df.select(F.inline(F.array(*items))).distinct().groupBy("__at").agg(F.count(F.when(some, 1)).alias(out))
        parts.append(counted.select(F.element_at(F.array(*[F.lit(c) for c in block]), F.col("__at") + 1).alias(key), out))
    return reduce(DataFrame.unionByName, parts)


def with_distinct(stats: DataFrame, df: DataFrame, cols: Sequence[str], key: str = "feature", out: str = "nunique") -> DataFrame:
    """``stats`` (one row per column) with the distinct count of each column; both sides have as many rows as there are columns."""
    found = distinct_counts(df, cols, key, "__d")
    return stats.join(F.broadcast(found), key, "left").withColumn(out, F.coalesce("__d", F.lit(0))).drop("__d")


def collect_stats(df: DataFrame, cols: Sequence[str], stats: Callable[[Column], Mapping[str, Column]]) -> dict[str, dict]:
    """The same statistics on the driver: one small row per column."""
    if not cols:
        return {}
    return {r["feature"]: r.asDict() for r in long_stats(df, cols, stats).collect()}


def value_counts(df: DataFrame, cols: Sequence[str], feature: str = "feature", value: str = "value") -> DataFrame:
    """Counts of every value of every column (values as text), map-side combined."""
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
    return (texts.unpivot([], list(cols), feature, value)
            .groupBy(feature, value).agg(F.count(F.lit(1)).alias("n")))


