"""Bundles: the exploratory report, the upload check and the table-job dispatcher."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import association, cleaning, modeling, profiling, reshape, roles
from ..sources import tables


def _long(section: str, df: DataFrame, name: str, stats: Sequence[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    cells = [F.struct(F.lit(s).alias("stat"),
                      (F.lit(None) if kinds[s] == "string" else F.col(s)).cast("double").alias("value"),
                      (F.col(s) if kinds[s] == "string" else F.lit(None).cast("string")).alias("text")) for s in stats]
    return df.select(F.lit(section).alias("section"), F.col(name).alias("feature"), F.inline(F.array(*cells)))


def eda_report(df: DataFrame, target: str | None = None, top: int = 30, numeric: Sequence[str] | None = None,
               nominal: Sequence[str] | None = None) -> DataFrame:
    """(section, feature, stat, value, text) of missing cells, levels, boxes, skewness and correlation."""
    numeric = list(roles.numeric_columns(df) if numeric is None else numeric)
    nominal = list(roles.nominal_columns(df) if nominal is None else nominal)
    parts = [_long("missing", profiling.missing_counts(df), "feature", ["n_missing", "ratio"])]
    if nominal:
        counts = profiling.category_counts(df, nominal, top)
        parts.append(counts.select(F.lit("levels").alias("section"), "feature", F.col("value").alias("stat"),
                                   F.col("n").cast("double").alias("value"), F.lit(None).cast("string").alias("text")))
    if numeric:
        parts.append(_long("box", profiling.box_summary(df, numeric), "feature", ["min", "q1", "median", "q3", "max", "n_outliers", "percent"]))
        parts.append(_long("skew", profiling.skew_report(df, numeric), "feature", ["skew"]))
        if target in numeric:
            parts.append(_long("correlation", association.corr_levels(df, numeric, target), "feature", ["r", "level"]))
    return reduce(DataFrame.unionByName, parts)


def eda_compare(first: DataFrame, second: DataFrame, key: Sequence[str], **options) -> DataFrame | None:
    """Adversarial comparison of two tables with equal roles; ``None`` when they are equal."""
    if (roles.numeric_columns(first), roles.nominal_columns(first)) != (roles.numeric_columns(second), roles.nominal_columns(second)):
        raise ValueError("the features of the two tables differ")
    if reshape.frames_equal(first, second):
        return None
    cols = [c for c in (*roles.numeric_columns(first), *roles.nominal_columns(first)) if c not in key]
    return modeling.adversarial_table(first, second, cols, key, **options)


def eda_compare_report(first: DataFrame, second: DataFrame, key: Sequence[str], points: int = 50, model: bool = True,
                       names: tuple[str, str] = ("train", "test"), **options) -> DataFrame:
    """The numbers of the two-table report: ``section, dataset, feature, stat, position, value``.

    ``rows``: the size of each table. ``overlay``: densities of each numeric column on a common grid. ``patterns``: how often each
    combination of missing columns occurs in each table (one digit per feature, in ``feature_order``). ``levels``: the share
    of each level of the nominal columns in each table (the 30 commonest). ``adversarial``: for each round (``position``) the auc of
    telling the tables apart, every feature's importance and whether the leading one was removed; nothing where the
    tables are equal. Both tables must have the same roles.
    """
    if (roles.numeric_columns(first), roles.nominal_columns(first)) != (roles.numeric_columns(second), roles.nominal_columns(second)):
        raise ValueError("the features of the two tables differ")
    numeric = [c for c in roles.numeric_columns(first) if c not in key]
    nominal = [c for c in roles.nominal_columns(first) if c not in key]
    none, no_place = F.lit(None).cast("string"), F.lit(None).cast("double")
    parts = []
    for name, df in zip(names, (first, second)):
        tag = F.lit(name).alias("dataset")
        parts.append(df.agg(F.count(F.lit(1)).cast("double").alias("value"))
                     .select(F.lit("rows").alias("section"), tag, none.alias("feature"), F.lit("n").alias("stat"), no_place.alias("position"), "value"))
        parts.append(profiling.missing_patterns(df, [*numeric, *nominal]).select(
            F.lit("patterns").alias("section"), tag, none.alias("feature"), F.col("pattern").alias("stat"), no_place.alias("position"), F.col("n").cast("double").alias("value")))
        if nominal:
            counts = profiling.category_counts(df, nominal)
            whole = df.agg(F.count(F.lit(1)).alias("__all"))
            parts.append(counts.join(F.broadcast(whole)).select(
                F.lit("levels").alias("section"), tag, "feature", F.col("value").alias("stat"), F.col("rank").cast("double").alias("position"),
                (F.col("n") / F.col("__all")).alias("value")))
    if numeric:
        overlay = profiling.kde_overlay(first, second, numeric, points, names)
        parts.append(overlay.select(F.lit("overlay").alias("section"), "dataset", "feature", F.lit("density").alias("stat"), "position", F.col("density").alias("value")))
    if model and not reshape.frames_equal(first, second):
        log = modeling.adversarial_validation(first, second, [*numeric, *nominal], key, **options)
        rows = []
        for r in log:
            at = float(r["round"])
            rows += [("adversarial", None, None, "auc", at, r["auc"]), ("adversarial", None, r["feature"], "removed", at, float(r["removed"]))]
            rows += [("adversarial", None, c, "importance", at, float(v)) for c, v in r["importances"].items()]
        parts.append(first.sparkSession.createDataFrame(rows, "section string, dataset string, feature string, stat string, position double, value double"))
    return reduce(DataFrame.unionByName, parts)


def upload_check(df: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """Purged table, its column profile and the facts stored beside it."""
    tables.check_head(df.columns)
    clean, found = cleaning.purge_impurities(df)
    facts = {"length": len(clean.columns), "impurity_value": sorted({t for v in found.values() for t in v})}
    return clean, profiling.profile_columns(clean), facts


def upload_check_file(spark: SparkSession, path: str, out: str, sep: str = ",") -> dict:
    """Check a csv for a header, purge it, write the table and its profile."""
    tables.require_header(spark, path, sep=sep)
    tables.check_head(tables.first_line(spark, path))
    clean, profile, facts = upload_check(tables.read_table(spark, path, sep=sep))
    tables.write_table(clean, f"{out}/table")
    tables.write_profile(profile, f"{out}/profile", facts)
    return facts


def reconstruct(mode: str, first: DataFrame, second: DataFrame | None = None, **options):
    """Table jobs by name: split, combine, label_combine, column_filter, data_leakage."""
    if mode == "split":
        return reshape.split(first, **options)
    if mode == "combine":
        return reshape.combine(first, second)
    if mode == "label_combine":
        return reshape.label_combine(first, second, **options)
    if mode == "column_filter":
        return first.select(*options["columns"])
    if mode == "data_leakage":
        return cleaning.drop_near_duplicates(first, **options)
    raise ValueError(f"unknown mode {mode}")
