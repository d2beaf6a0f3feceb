"""Appending, binding, splitting and comparing tables, and input checks."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import ROWS_PER_RANGE, ordered_scan
from ..functions.quantiles import value_at_rank
from .roles import CheckError, numeric_columns


def combine(first: DataFrame, second: DataFrame) -> DataFrame:
    if first.columns != second.columns:
        raise CheckError(2021)
    return first.union(second)


def tagged_union(first: DataFrame, second: DataFrame, tag: str = "dataset",
                 names: tuple = ("train", "test")) -> DataFrame:
    return (first.withColumn(tag, F.lit(names[0]))
            .unionByName(second.withColumn(tag, F.lit(names[1])), allowMissingColumns=True))


def label_combine(first: DataFrame, second: DataFrame, key: str | None = None,
                  order_by: tuple[Sequence[str], Sequence[str]] | None = None,
                  rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Bind the columns of two tables of equal length, by key or by position in a given order.

    Keys must match one to one; a null, repeated or missing key is an error, as rows would be lost or doubled.
    """
    n1, n2 = first.count(), second.count()
    if n1 != n2:
        raise CheckError(2031, f"{n1}|{n2}")
    shared = [c for c in first.columns if c in second.columns and c != key]
    if shared:
        raise CheckError(2032, shared)
    if key is not None:
        both = first.select(key, F.lit(1).alias("__a"), F.lit(0).alias("__b")).union(second.select(key, F.lit(0), F.lit(1)))
        odd = both.groupBy(key).agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))
        odd = odd.filter((F.col("__a") != 1) | (F.col("__b") != 1) | F.col(key).isNull()).count()
        if odd:
            raise CheckError(2031, f"{odd} keys do not match one to one")
        return first.join(second, key)
    left = ordered_scan(first, order_by[0], row_number="__pos", rows_per_range=rows_per_range)
    right = ordered_scan(second, order_by[1], row_number="__pos", rows_per_range=rows_per_range)
    return left.join(right, "__pos").drop("__pos")


def split(df: DataFrame, size: float, keys: Sequence[str], shuffle: bool = True, stratify: Sequence[str] = (),
          seed: int = 0, rows_per_range: int = ROWS_PER_RANGE) -> tuple[DataFrame, DataFrame]:
    """Two parts, the second with exactly ``ceil(size * n)`` rows.

    ``keys`` identify a row and give the order when ``shuffle`` is off (the second part is the
    tail). Unstratified, the rank of the cut is turned into a key value by counting, so both
    parts are plain filters and the wide rows are never shuffled.
    """
    if stratify:
        return _split_strata(df, size, keys, shuffle, list(stratify), seed, rows_per_range)
    # a double holds a 53-bit hash exactly
    order = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 11).cast("double")
    single = not shuffle and len(keys) == 1 and keys[0] in numeric_columns(df)
    if single:
        order = F.col(keys[0]).cast("double")
    if shuffle or single:
        marked = df.withColumn("__cut", order)
        rows = marked.count()
        first_rows = rows - math.ceil(size * rows)
        at = value_at_rank(marked, "__cut", first_rows)
        if at is not None and marked.filter(F.col("__cut") < at).count() == first_rows:
            return marked.filter(F.col("__cut") < at).drop("__cut"), marked.filter(F.col("__cut") >= at).drop("__cut")
        if at is None:
            return df, df.limit(0)
    # several order columns or equal keys at the cut: number the rows
    by = [*(["__cut"] if shuffle else []), *keys]
    base = df.withColumn("__cut", order) if shuffle else df
    rows = base.count()
    numbered = ordered_scan(base, by, row_number="__pos", rows_per_range=rows_per_range)
    first_rows = rows - math.ceil(size * rows)
    drop = ["__pos", "__cut"]
    return numbered.filter(F.col("__pos") <= first_rows).drop(*drop), numbered.filter(F.col("__pos") > first_rows).drop(*drop)


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (all, when there are fewer), chosen by a seeded hash of the row key."""
    rows = df.count()
    return df if rows <= n else split(df, (n - 0.5) / rows, keys, seed=seed)[1]


def _split_strata(df, size, keys, shuffle, stratify, seed, rows_per_range):
    # the size of a stratum comes out of the scan, so no join meets a hot stratum; a null is a stratum of its own
    order = F.xxhash64(*keys, F.lit(seed)) if shuffle else F.lit(0)
    marked = ordered_scan(df.withColumn("__cut", order), ["__cut", *keys], stratify, row_number="__pos", size="__all", rows_per_range=rows_per_range)
    tail = F.col("__pos") > F.col("__all") - F.round(F.col("__all") * size).cast("long")
    return (marked.filter(~tail).select(*df.columns), marked.filter(tail).select(*df.columns))


def frames_differ(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows that occur a different number of times in the two tables (empty when equal).

    Both sides are counted by one map-side combined aggregate, whatever the number of copies.
    """
    both = (first.select("*", F.lit(1).alias("__a"), F.lit(0).alias("__b"))
            .union(second.select("*", F.lit(0).alias("__a"), F.lit(1).alias("__b"))))
    return (both.groupBy(*first.columns).agg(F.sum("__a").alias("n_first"), F.sum("__b").alias("n_second"))
            .filter(F.col("n_first") != F.col("n_second")))


def _tallies_differ(first: DataFrame, second: DataFrame) -> bool:
    """Whether rows or sums of row hashes differ, which proves the tables differ; equal ones prove nothing."""
    both = first.select("*", F.lit(1).alias("__side")).union(second.select("*", F.lit(-1).alias("__side")))
    h, side = F.xxhash64(*[F.col(f"`{c}`") for c in first.columns]), F.col("__side").cast("long")
    # short parts of a hash, so that their sums never overflow
    parts = [side, side * F.shiftright(h, 40), side * h.bitwiseAND(F.lit(0xFFFFFF))]
    return any(both.agg(*[F.coalesce(F.sum(p), F.lit(0)) for p in parts]).first())


def frames_equal(first: DataFrame, second: DataFrame) -> bool:
    if first.columns != second.columns:
        return False
    # text under a collation may be equal without being the same bytes
    plain = not any("collate" in t or "map<" in t for _, t in (*first.dtypes, *second.dtypes))
    if plain and first.columns and _tallies_differ(first, second):
        return False
    return frames_differ(first, second).isEmpty()


def level_presence(train: DataFrame, test: DataFrame, col: str) -> DataFrame:
    """Rows of each level in both tables; one aggregate instead of two distincts and a join."""
    both = (train.select(F.col(col).alias("level"), F.lit(1).alias("a"), F.lit(0).alias("b"))
            .union(test.select(F.col(col).alias("level"), F.lit(0).alias("a"), F.lit(1).alias("b"))))
    return both.groupBy("level").agg(F.sum("a").alias("n_train"), F.sum("b").alias("n_test"))


def category_mismatch(train: DataFrame, test: DataFrame, col: str) -> DataFrame:
    """Levels present in only one of the two tables."""
    return level_presence(train, test, col).filter((F.col("n_train") == 0) | (F.col("n_test") == 0))


def check_format(train: DataFrame, test: DataFrame, label: str, nominal: bool = True) -> DataFrame:
    """(code, detail, n) per violated input rule; empty when the pair is usable."""
    spark = train.sparkSession
    constant = 3102 if label in numeric_columns(train) else 3103
    found = train.agg(F.count(F.when(F.col(label).isNull(), 1)).alias("missing"),
                      F.min(label).eqNullSafe(F.max(label)).alias("same")).first()
    rows = []
    if found["missing"]:
        rows.append((3101, label, found["missing"]))
    if found["same"]:
        rows.append((constant, label, 1))
    rows += [(3204, c, 1) for c in train.columns if c not in test.columns and c != label]
    static = spark.createDataFrame(rows, "code int, detail string, n long")
    if not nominal or label not in test.columns:
        return static
    unseen = (level_presence(train, test, label).filter((F.col("n_train") == 0) & F.col("level").isNotNull())
              .select(F.lit(3104).alias("code"), F.col("level").cast("string").alias("detail"), F.col("n_test").alias("n")))
    return static.union(unseen)


def duplicate_features(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """(feature, same_as) for columns identical to an earlier column.

    Order-free fingerprints (sums of hashes of row key and value) propose pairs in one aggregate;
    only proposed pairs are compared cell by cell in a second one.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    cols = [c for c in df.columns if c not in key]
    def mark(c: str):
        return F.sum(F.xxhash64(*key, F.col(c)).cast("decimal(38,0)")).alias(c)
    prints = df.agg(*[mark(c) for c in cols]).first()
    pairs = [(b, a) for i, b in enumerate(cols) for a in cols[:i] if prints[a] == prints[b] and kinds[a] == kinds[b]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "feature string, same_as string")
    same = df.agg(*[F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(str(i)) for i, (b, a) in enumerate(pairs)]).first()
    first: dict[str, str] = {}
    for i, (b, a) in enumerate(pairs):
        if same[str(i)]:
            first.setdefault(b, a)
    return df.sparkSession.createDataFrame(list(first.items()), "feature string, same_as string")


def drop_duplicate_features(df: DataFrame, key: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    extra = [r["feature"] for r in duplicate_features(df, key).collect() if r["feature"] not in keep]
    return df.drop(*extra)
