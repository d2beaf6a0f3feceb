"""Column profiles and the numbers behind the usual exploratory charts."""
from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import collect_stats, long_stats, value_counts, with_distinct
from ..functions.quantiles import exact_quantiles
from .roles import (apply_time_formats, category_boundary, family_rule, infer_time_formats, nominal_columns, numeric_columns,
                    percent_layout, storage_kind, time_columns)


def profile_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    return with_distinct(long_stats(df, cols, lambda x: {
        "count": F.count(x), "mean": F.avg(x.cast("double")), "std": F.stddev_samp(x.cast("double")),
        "min": F.min(x).cast("double"), "max": F.max(x).cast("double")}), df, cols)


def profile_category(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, nunique, least and most common level per column; equal counts: smaller text first."""
    counts = value_counts(df, list(cols or nominal_columns(df)))
    seen = F.col("value").isNotNull()
    return counts.groupBy("feature").agg(
        F.coalesce(F.sum(F.when(seen, F.col("n"))), F.lit(0)).alias("count"),
        F.min_by("value", F.when(seen, F.struct("n", "value"))).alias("least_common"),
        F.min_by("value", F.when(seen, F.struct(-F.col("n"), F.col("value")))).alias("most_common"),
        F.count(F.when(seen, 1)).alias("nunique"))


def profile_columns(df: DataFrame) -> DataFrame:
    """One row per column: types, quality flag and the six-number description.

    Text and whole-number columns whose every value is a date or time are profiled as such.
    """
    layouts = infer_time_formats(df)
    df = apply_time_formats(df, layouts)
    kinds = {f.name: storage_kind(f.dataType) for f in df.schema}
    rows = df.count()
    boundary = F.lit(category_boundary(rows))
    parts = []

    def shaped(part: DataFrame, initial: str, advised: Column, process: Column) -> DataFrame:
        constant = F.when((F.col("nunique") <= 1) & F.col("max").isin("0", "0.0"), 2) \
            .when(F.col("nunique") <= 1, 1).otherwise(0)
        return part.select(F.col("feature").alias("column_name"), F.lit(initial).alias("initial_dtype"),
                           advised.alias("advise_dtype"), process.alias("dtype_for_process"),
                           constant.alias("data_quality"), F.col("count"), F.col("mean"), F.col("std"),
                           F.col("min"), F.col("max"), F.col("nunique"))

    for kind in ("int", "float"):
        cols = [c for c, k in kinds.items() if k == kind]
        if cols:
            raw = profile_numeric(df, cols)
            # the type rule counts null as one more value, the description does not
            distinct = F.col("nunique") + F.when(F.col("count") < rows, 1).otherwise(0)
            process = family_rule(kind, distinct, F.col("max_value"), boundary)
            # whole numbers are written without a fraction
            def text(c: str) -> Column:
                return (F.col(c).cast("long") if kind == "int" else F.col(c)).cast("string")
            raw = raw.select("feature", "count", "mean", "std", "nunique", F.col("max").alias("max_value"),
                             text("min").alias("min"), text("max").alias("max"))
            advised = F.when(process == "object", "category").otherwise("numerical")
            parts.append(shaped(raw, "numerical", advised, process))
    times = time_columns(df)
    if times:
        raw = with_distinct(long_stats(df, times, lambda x: {
            "count": F.count(x), "mean": F.lit(None).cast("double"), "std": F.lit(None).cast("double"),
            "min": F.min(x).cast("string"), "max": F.max(x).cast("string")}), df, times)
        process = F.lit("%Y-%m-%d %H:%M:%S")
        for c, layout in layouts.items():
            process = F.when(F.col("feature") == c, percent_layout(layout)).otherwise(process)
        parts.append(shaped(raw, "timestamp", F.lit("datetime"), process))
    nominal = [c for c, k in kinds.items() if k == "text"]
    if nominal:
        raw = (profile_category(df, nominal).withColumnRenamed("least_common", "min")
               .withColumnRenamed("most_common", "max")
               .withColumn("mean", F.lit(None).cast("double")).withColumn("std", F.lit(None).cast("double")))
        parts.append(shaped(raw, "category", F.lit("category"), F.lit("object")))
    return reduce(DataFrame.unionByName, parts)


def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Median, moments and spread of each column; skewness and kurtosis are bias-corrected."""
    spark = df.sparkSession
    quart = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    rows = []
    moments = collect_stats(df, cols, lambda x: {
        "n": F.count(x), "mean": F.avg(x.cast("double")), "std": F.stddev_samp(x.cast("double")),
        "var": F.var_samp(x.cast("double")), "min": F.min(x).cast("double"), "max": F.max(x).cast("double"),
        "g1": F.skewness(x.cast("double")), "g2": F.kurtosis(x.cast("double"))})
    for c in cols:
        m, (q1, q2, q3) = moments[c], quart[c]
        n = m["n"]
        skew = m["g1"] * (n * (n - 1)) ** 0.5 / (n - 2) if n > 2 and m["g1"] is not None else None
        kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * m["g2"] + 6) if n > 3 and m["g2"] is not None else None
        rows.append((c, q2, m["mean"], m["std"], m["var"], m["max"], m["min"], skew, kurt, q1, q3, (q3 - q1) / 2,
                     m["var"] / m["std"] if m["std"] else None, m["max"] - m["min"]))
    names = ["median", "mean", "std", "var", "max", "min", "skew", "kurt", "q1", "q3", "qd", "coef", "range"]
    return spark.createDataFrame(rows, "feature string, " + ", ".join(f"`{n}` double" for n in names))


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return long_stats(df, list(cols or df.columns), lambda x: {
        "n_missing": F.count(F.when(x.isNull(), 1)), "ratio": F.avg(x.isNull().cast("double"))})


def missing_patterns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """How often each combination of missing columns occurs (1 marks a missing cell)."""
    bits = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in (cols or df.columns)])
    return df.groupBy(bits.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def category_counts(df: DataFrame, cols: Sequence[str] | None = None, top: int = 30) -> DataFrame:
    """The ``top`` most frequent levels of each nominal column."""
    counts = value_counts(df, list(cols or nominal_columns(df))).filter(F.col("value").isNotNull())
    # rank-limited windows are pruned before the shuffle, so a wide column stays cheap
    rank = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("n"), F.asc("value")))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= top)


def top_k_filter(df: DataFrame, col: str, k: int = 30) -> DataFrame:
    """Rows whose level is among the k most frequent; at most k levels are broadcast."""
    best = (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
            .orderBy(F.desc("__n"), F.asc(col)).limit(k).select(col))
    return df.join(F.broadcast(best), col, "left_semi").select(*df.columns)


def outlier_fences(df: DataFrame, cols: Sequence[str], k: float, zero_spread: float | None = None) -> dict[str, tuple]:
    quart = exact_quantiles(df, cols, [0.25, 0.75])
    out = {}
    for c, (q1, q3) in quart.items():
        if q1 is None:
            continue
        spread = q3 - q1
        factor = zero_spread if spread == 0 and zero_spread is not None else k
        out[c] = (q1 - factor * spread, q3 + factor * spread, q1, q3)
    return out


def box_summary(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Quartiles, extremes and the number and percent of values outside the fences."""
    quart = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    live = [c for c in cols if quart[c][0] is not None]

    def stats(name: str, x: Column) -> dict[str, Column]:
        q1, q2, q3 = quart[name]
        out = ~x.cast("double").between(q1 - k * (q3 - q1), q3 + k * (q3 - q1))
        return {"min": F.min(x).cast("double"), "q1": F.lit(q1), "median": F.lit(q2), "q3": F.lit(q3),
                "max": F.max(x).cast("double"), "n_outliers": F.count(F.when(out, 1)),
                "percent": F.round(100 * F.count(F.when(out, 1)) / F.count(F.lit(1)), 2)}

    aggs, structs = [], []
    for i, c in enumerate(live):
        made = stats(c, F.col(c))
        aggs += [v.alias(f"{i}_{s}") for s, v in made.items()]
        structs.append(F.struct(F.lit(c).alias("feature"), *[F.col(f"{i}_{s}").alias(s) for s in made]))
    return df.agg(*aggs).select(F.inline(F.array(*structs)))


def skew_report(df: DataFrame, cols: Sequence[str], threshold: float = 0.75) -> DataFrame:
    return (long_stats(df, cols, lambda x: {"skew": F.skewness(x.cast("double"))})
            .filter(F.abs("skew") > threshold))


def kde_grid(df: DataFrame, col: str, points: int = 100, low: float | None = None, high: float | None = None) -> DataFrame:
    """Gaussian density with Scott bandwidth on an even grid, and its unit-step gradient.

    The grid is a literal array and each grid point is one sum, so rows are never multiplied:
    every task reduces its rows to one row of partial sums.
    """
    x = F.col(col).cast("double")
    s = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.stddev_samp(x).alias("sd")).first()
    low, high = s["lo"] if low is None else low, s["hi"] if high is None else high
    width = s["sd"] * s["n"] ** -0.2
    grid = [low + (high - low) * i / (points - 1) for i in range(points)]
    scale = 1.0 / (s["n"] * width * (2 * 3.141592653589793) ** 0.5)
    sums = [F.sum(F.exp(-0.5 * F.pow((F.lit(g) - x) / width, 2))).alias(f"g{i}") for i, g in enumerate(grid)]
    dense = df.agg(*sums)
    # numpy-style gradient with step one: central inside, one-sided at the ends
    at = [F.col(f"g{i}") * scale for i in range(points)]
    slope = [at[1] - at[0]] + [(at[i + 1] - at[i - 1]) / 2 for i in range(1, points - 1)] + [at[-1] - at[-2]]
    rows = [F.struct(F.lit(i).alias("point"), F.lit(g).alias("position"), at[i].alias("density"), slope[i].alias("gradient"))
            for i, g in enumerate(grid)]
    return dense.select(F.inline(F.array(*rows)))


def kde_compare(left: DataFrame, right: DataFrame, col: str, points: int = 100) -> DataFrame:
    """Densities of one column in two tables on a common grid."""
    ends = [t.agg(F.min(F.col(col).cast("double")), F.max(F.col(col).cast("double"))).first() for t in (left, right)]
    low, high = min(e[0] for e in ends), max(e[1] for e in ends)
    a = kde_grid(left, col, points, low, high).select(F.lit("train").alias("dataset"), "*")
    return a.unionByName(kde_grid(right, col, points, low, high).select(F.lit("test").alias("dataset"), "*"))


def kde_overlay(first: DataFrame, second: DataFrame, cols: Sequence[str], points: int = 100,
                names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """``dataset, feature, point, position, density`` of many columns in two tables, each column on a grid common to both.

    Two scans in all: one for ends and spreads, one in which every Arrow batch adds its kernels to one row of sums per column;
    a task sends (columns x points) numbers on. Null, NaN and infinite values take no part. A column with fewer than two
    different values in either table has no density and gives no rows.
    """
    def finite(c: str) -> Column:
        x = F.col(f"`{c}`").cast("double")
        return F.when(F.abs(x) < float("inf"), x).alias(c)

    tag = spare_name(cols, "dataset")
    # a number marks the table: text would be turned into Python objects row by row
    both = (first.select(F.lit(0).alias(tag), *[finite(c) for c in cols])
            .unionByName(second.select(F.lit(1).alias(tag), *[finite(c) for c in cols])))
    facts: dict[str, dict[str, dict]] = {c: {} for c in cols}
    for name, part in ((n, both.filter(F.col(tag) == i)) for i, n in enumerate(names)):
        for c, s in collect_stats(part, cols, lambda x: {"n": F.count(x), "lo": F.min(x), "hi": F.max(x), "sd": F.stddev_samp(x)}).items():
            facts[c][name] = s
    live = [c for c in cols if all(facts[c][n]["sd"] for n in names)]
    schema = "dataset string, feature string, point int, position double, density double"
    if not live:
        return first.sparkSession.createDataFrame([], schema)
    grids = {c: np.linspace(min(facts[c][n]["lo"] for n in names), max(facts[c][n]["hi"] for n in names), points) for c in live}
    widths = {(c, n): facts[c][n]["sd"] * facts[c][n]["n"] ** -0.2 for c in live for n in names}

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            tags = batch.column(0).to_numpy()
            for i, c in enumerate(live):
                x = batch.column(i + 1).to_numpy(zero_copy_only=False)
                for k, n in enumerate(names):
                    some = x[(tags == k) & ~np.isnan(x)]
                    total = held.setdefault((n, c), np.zeros(points))
                    for at in range(0, len(some), 4096):
                        # one buffer for all steps
                        z = grids[c][:, None] - some[None, at:at + 4096]
                        z /= widths[c, n]
                        z *= z
                        z *= -0.5
                        total += np.exp(z, out=z).sum(axis=1)
        if held:
            keys = list(held)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]),
                                              pa.array([held[k].tolist() for k in keys], pa.list_(pa.float64()))], ["dataset", "feature", "sums"])

    parts = both.select(tag, *[f"`{c}`" for c in live]).mapInArrow(sums, "dataset string, feature string, sums array<double>")
    added = parts.select("dataset", "feature", F.posexplode("sums").alias("point", "s")).groupBy("dataset", "feature", "point").agg(F.sum("s").alias("s"))
    rows = [(n, c, i, float(grids[c][i]), float(1 / (facts[c][n]["n"] * widths[c, n] * math.sqrt(2 * math.pi))))
            for c in live for n in names for i in range(points)]
    frame = first.sparkSession.createDataFrame(rows, "dataset string, feature string, point int, position double, scale double")
    return frame.join(added, ["dataset", "feature", "point"]).select("dataset", "feature", "point", "position", (F.col("s") * F.col("scale")).alias("density"))


def spare_name(taken: Sequence[str], name: str) -> str:
    while name in taken:
        name += "_"
    return name


def kde_slope(grid: DataFrame, points: Sequence[float]) -> DataFrame:
    """Gradient at the first grid position past each point, 0 beyond the grid."""
    past = [F.struct(F.lit(float(p)).alias("point"), F.col(f"s{i}").alias("slope")) for i, p in enumerate(points)]
    return (grid.agg(*[F.coalesce(F.min_by("gradient", F.when(F.col("position") > p, F.col("position"))), F.lit(0.0)).alias(f"s{i}")
                       for i, p in enumerate(points)])
            .select(F.inline(F.array(*past))))
