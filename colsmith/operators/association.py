"""Association between columns: Pearson, Spearman, Cramer's V, correlation ratio."""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import collect_stats, distinct_counts
from ..functions.ordered import ROWS_PER_RANGE
from .ranks import pairwise_spearman, rank_bounds

_NARROW = 16
#: Pairs whose correlations one aggregate of plain expressions gives; a longer one no longer compiles as a whole.
_FEW = 20
#: Columns of a block of the matrix: six sums of this many squared doubles in a worker.
BLOCK_COLUMNS = 1000


def _safe_corr(a: str, b: str) -> Column:
    # a constant side has no correlation
    value = F.corr(F.col(a).cast("double"), F.col(b).cast("double"))
    return F.when(~F.isnan(value), value)


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> dict[tuple[str, str], float | None]:
    """Pairwise-complete Pearson correlations of the named pairs (driver dictionary)."""
    cols = sorted({c for p in pairs for c in p})
    if len(pairs) <= _FEW:
        if not pairs:
            return {}
        row = df.agg(*[_safe_corr(a, b).alias(str(i)) for i, (a, b) in enumerate(pairs)]).first()
        return {p: row[str(i)] for i, p in enumerate(pairs)}
    sides = [sorted({p[k] for p in pairs}) for k in (0, 1)]
    if len(sides[0]) * len(sides[1]) <= 4 * len(pairs) and max(map(len, sides)) <= BLOCK_COLUMNS:
        # one rectangle of the matrix, such as many features beside one target
        means = collect_stats(df, cols, lambda x: {"m": F.avg(x.cast("double"))})
        data = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
        left, right = (np.array([cols.index(c) for c in side]) for side in sides)
        part = _block_correlations(data, left, right, np.array([means[c]["m"] or 0.0 for c in cols]))
        places = [{c: i for i, c in enumerate(side)} for side in sides]
        values = {(a, b): part[places[0][a], places[1][b]] for a, b in pairs}
        return {p: None if np.isnan(r) else float(r) for p, r in values.items()}
    matrix = correlation_matrix(df, cols)
    at = {c: i for i, c in enumerate(cols)}
    return {(a, b): (None if np.isnan(matrix[at[a], at[b]]) else float(matrix[at[a], at[b]])) for a, b in pairs}


def correlation_matrix(df: DataFrame, cols: Sequence[str], centre: np.ndarray | None = None) -> np.ndarray:
    """Pairwise-complete Pearson matrix of many columns, one pass over the rows for ``BLOCK_COLUMNS`` of them.

    Each Arrow batch is reduced to matrix products of values and presence masks; a task emits
    one set of sums, so the shuffled volume depends on the width only. More columns are taken block by block
    against each other, so a worker and the driver hold the sums of one pair of blocks and the driver the result.
    Values are centred on given values, else on the column means of a first pass, to keep the sums well conditioned.
    """
    p = len(cols)
    if centre is None:
        means = collect_stats(df, cols, lambda x: {"m": F.avg(x.cast("double"))})
        centre = np.array([means[c]["m"] or 0.0 for c in cols])
    data = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    out = np.full((p, p), np.nan)
    blocks = [np.arange(n, min(n + BLOCK_COLUMNS, p)) for n in range(0, p, BLOCK_COLUMNS)]
    for i, left in enumerate(blocks):
        for right in blocks[i:]:
            part = _block_correlations(data, left, right, centre)
            out[np.ix_(left, right)] = part
            out[np.ix_(right, left)] = part.T
    return out


def _block_correlations(data: DataFrame, left: np.ndarray, right: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Correlations of the columns ``left`` with the columns ``right`` of ``x0, x1, ...``."""
    used = np.union1d(left, right)
    rows = data.select(*[f"x{i}" for i in used])
    a, b = np.searchsorted(used, left), np.searchsorted(used, right)
    shape = pa.schema([("row", pa.int32()), ("part", pa.int32()), ("vals", pa.binary())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(left), len(right)))
        for batch in batches:
            block = np.column_stack([np.asarray(batch.column(i).to_numpy(zero_copy_only=False), dtype=float) for i in range(len(used))])
            mask = np.isfinite(block)
            x = np.where(mask, block - centre[used], 0.0)
            m = mask.astype(float)
            xa, ma, xb, mb = x[:, a], m[:, a], x[:, b], m[:, b]
            # number, then sums of either side over the common rows, their squares and their product
            for k, (u, v) in enumerate(((ma, mb), (xa, mb), (ma, xb), (xa * xa, mb), (ma, xb * xb), (xa, xb))):
                total[k] += u.T @ v
        yield pa.record_batch({"row": list(range(len(left))) * 6, "part": [k for k in range(6) for _ in left],
                               "vals": [total[k, i].tobytes() for k in range(6) for i in range(len(left))]}, schema=shape)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row, part, vals in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                held[row, part] = held.get((row, part), 0.0) + np.frombuffer(vals)
        yield pa.record_batch({"row": [r for r, _ in held], "part": [k for _, k in held], "vals": [v.tobytes() for v in held.values()]}, schema=shape)

    # one packed line of a matrix per row and part, added up where its key is shuffled to
    names = "row int, part int, vals binary"
    summed = rows.mapInArrow(sums, names).repartition("row", "part").mapInArrow(add, names).toArrow()
    s = np.zeros((6, len(left), len(right)))
    for row, part, vals in zip(*[summed.column(k).to_pylist() for k in range(3)]):
        s[part, row] = np.frombuffer(vals)
    n, sa, sb, saa, sbb, sab = s
    with np.errstate(divide="ignore", invalid="ignore"):
        def spread(squares: np.ndarray, total: np.ndarray) -> np.ndarray:
            var = squares - total * total / n
            return np.where(var > 1e-12 * np.maximum(squares, 1e-300), var, np.nan)
        return np.clip((sab - sa * sb / n) / np.sqrt(spread(saa, sa) * spread(sbb, sb)), -1.0, 1.0)


def pearson_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long form (a, b, r) of every pair with a before b."""
    pairs = list(combinations(cols, 2))
    if len(cols) > _NARROW:
        found = correlations(df, pairs)
        return df.sparkSession.createDataFrame([(a, b, found[a, b]) for a, b in pairs], "a string, b string, r double")
    row = df.agg(*[_safe_corr(a, b).alias(str(i)) for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(str(i)).alias("r"))
                                         for i, (a, b) in enumerate(pairs)])))


def cross_corr(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Correlation of each left column with each right column, clipped to [-1, 1]."""
    pairs = [(a, b) for a in left for b in right]
    found = correlations(df, pairs)
    rows = [(a, b, None if found[a, b] is None else max(-1.0, min(1.0, found[a, b]))) for a, b in pairs]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def label_correlation(df: DataFrame, cols: Sequence[str], label: str) -> dict[str, float | None]:
    found = correlations(df, [(c, label) for c in cols if c != label])
    return {a: r for (a, _), r in found.items()}


def label_corr_filter(df: DataFrame, cols: Sequence[str], label: str, threshold: float) -> DataFrame:
    """(feature, r, keep): features whose absolute correlation with the label is large enough."""
    found = label_correlation(df, cols, label)
    return df.sparkSession.createDataFrame([(c, r, abs(r or 0.0) >= threshold) for c, r in found.items()],
                                           "feature string, r double, keep boolean")


def corr_levels(df: DataFrame, cols: Sequence[str], target: str, top: int | None = None) -> DataFrame:
    """Rounded correlations with the target, graded micro / low / medium / high by size; ``top`` asks for the first columns only."""
    found = label_correlation(df, [c for c in cols if c != target][:top], target)
    base = df.sparkSession.createDataFrame(list(found.items()), "feature string, r double")
    # graded as shown: by the rounded figure
    size = F.abs(F.round("r", 2))
    grade = F.when(size <= 0.25, "micro").when(size <= 0.5, "low").when(size <= 0.75, "medium").otherwise("high")
    return base.select("feature", F.round("r", 2).alias("r"), F.when(size.isNotNull(), grade).alias("level"))


def top_correlated(df: DataFrame, cols: Sequence[str], target: str, k: int = 3) -> DataFrame:
    found = label_correlation(df, cols, target)
    base = df.sparkSession.createDataFrame(list(found.items()), "feature string, r double")
    return base.filter(F.col("r").isNotNull()).orderBy(F.desc(F.abs("r")), "feature").limit(k)


def spearman(df: DataFrame, cols: Sequence[str], rows_per_range: int = ROWS_PER_RANGE) -> dict[tuple[str, str], float | None]:
    """Rank correlations of all pairs, each over the rows that are complete for the pair."""
    return pairwise_spearman(df, list(combinations(cols, 2)), rows_per_range)


def spearman_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(a, b, r) for (a, b), r in spearman(df, cols).items()],
                                           "a string, b string, rho double")


def pair_counts(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Contingency counts (a, b, u, v, n) of all nominal pairs in one job.

    Rows that agree in all these columns are counted first where that leaves a quarter of them at most. Each then contributes
    one (pair, level, level) item per pair of columns, combined map-side; the shuffled table has at most the number of
    non-empty cells.
    """
    cols = list(dict.fromkeys(c for pair in pairs for c in pair))
    rows = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(cols)], F.lit(1).cast("long").alias("n"))
    at = {c: f"c{i}" for i, c in enumerate(cols)}
    if len(pairs) > len(cols) - 1:
        total, kinds = rows.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*at.values()))).first()
        if kinds * 4 <= total:
            rows = rows.groupBy(*at.values()).agg(F.count(F.lit(1)).alias("n"))
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(at[a]).alias("u"), F.col(at[b]).alias("v")) for a, b in pairs]
    return (rows.select("n", F.inline(F.array(*cells))).filter(F.col("u").isNotNull() & F.col("v").isNotNull())
            .groupBy("a", "b", "u", "v").agg(F.sum("n").alias("n")))


def cramers_v(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(a, b, v) per pair, no continuity correction; 0 for an empty or independent table.

    ``phi2 = sum(n_ij^2 / (n_i n_j)) - 1`` needs the margins, which are sums of the cell counts
    joined back to them. The cells are kept while the three small jobs read them, so the rows
    are scanned once.
    """
    cells = pair_counts(df, pairs).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = cells.groupBy("a", "b", "u").agg(F.sum("n").alias("n_u"))
        cols = cells.groupBy("a", "b", "v").agg(F.sum("n").alias("n_v"))
        shape = (rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("r"))
                 .join(cols.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")), ["a", "b"]))
        joined = cells.join(rows, ["a", "b", "u"]).join(cols, ["a", "b", "v"])
        share = F.col("n") * F.col("n") / (F.col("n_u") * F.col("n_v").cast("double"))
        phi2 = joined.groupBy("a", "b").agg((F.sum(share) - 1).alias("phi2"))
        least = F.least("r", "c") - 1
        value = F.when((least > 0) & (F.col("phi2") > 1e-12), F.sqrt(F.col("phi2") / least)).otherwise(0.0)
        found = phi2.join(shape, ["a", "b"]).select("a", "b", value.alias("v")).collect()     # one row per pair
    finally:
        cells.unpersist()
    known = {(r["a"], r["b"]): r["v"] for r in found}
    return df.sparkSession.createDataFrame([(a, b, float(known.get((a, b), 0.0))) for a, b in pairs], "a string, b string, v double")


def correlation_ratio(df: DataFrame, numeric: Sequence[str], nominal: Sequence[str]) -> DataFrame:
    """(feature, by, ratio): between-level share of ``n`` times the sample variance.

    Rows fan out once per nominal column and are reduced map-side to one row per level; totals
    follow from those rows. Values are centred on their overall means first, so the sums of
    squares do not cancel.
    """
    means = collect_stats(df, numeric, lambda x: {"m": F.avg(x.cast("double"))})
    items = F.inline(F.array(*[F.struct(F.lit(c).alias("by"), F.col(c).cast("string").alias("level")) for c in nominal]))
    values = [(F.col(c).cast("double") - (means[c]["m"] or 0.0)).alias(f"x{i}") for i, c in enumerate(numeric)]
    stats = [s for i in range(len(numeric)) for s in (
        F.count(f"x{i}").alias(f"n{i}"), F.avg(f"x{i}").alias(f"m{i}"), F.coalesce(F.var_pop(f"x{i}"), F.lit(0.0)).alias(f"v{i}"))]
    levels = df.select(items, *values).filter(F.col("level").isNotNull()).groupBy("by", "level").agg(*stats)
    long = levels.select("by", F.inline(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v"))
        for i, c in enumerate(numeric)])))
    n, m = F.col("n"), F.col("m")
    sums = long.groupBy("by", "feature").agg(F.sum("n").alias("n"), F.sum(n * F.col("v")).alias("within"),
                                             (F.sum(n * m * m) - F.pow(F.sum(n * m), 2) / F.sum("n")).alias("raw"))
    between = F.greatest("raw", F.lit(0.0))
    total = F.col("within") + between
    ratio = F.when(total > 0, between / (total / (F.col("n") - 1) * F.col("n"))).otherwise(0.0)
    return sums.select("feature", "by", F.coalesce(ratio, F.lit(0.0)).alias("ratio"))


def correlated_columns(df: DataFrame, nominal: Sequence[str], numeric: Sequence[str], threshold: float = 0.95,
                       cell_limit: int | None = 10_000) -> list[tuple[str, str, str]]:
    """(dropped, kept, kind): of nominal pairs the later goes, of numeric pairs the earlier.

    Nominal pairs with more possible cells than ``cell_limit`` are not compared (two near-unique columns always look
    associated); ``None`` compares all. Numeric pairs count when the signed correlation exceeds the threshold.
    """
    dropped: list[tuple[str, str, str]] = []
    gone: set[str] = set()
    if len(nominal) > 1:
        pairs = list(combinations(nominal, 2))
        if cell_limit is not None:
            wide = {r["feature"]: r["nunique"] for r in distinct_counts(df, nominal).collect()}
            pairs = [(a, b) for a, b in pairs if wide.get(a, 0) * wide.get(b, 0) <= cell_limit]
        strength = {(r["a"], r["b"]): r["v"] for r in cramers_v(df, pairs).collect()} if pairs else {}
        for a, b in pairs:
            if a not in gone and b not in gone and strength.get((a, b), 0.0) > threshold:
                gone.add(b)
                dropped.append((b, a, "nominal"))
    if len(numeric) > 1:
        pairs = list(combinations(numeric, 2))
        found = correlations(df, pairs)
        for a in numeric:
            later = [b for x, b in pairs if x == a and (found[a, b] or 0.0) > threshold]
            if later:
                dropped.append((a, later[0], "numeric"))
    return dropped


def binned_rank_correlations(df: DataFrame, cols: Sequence[str], bins: int = 200) -> dict[tuple[str, str], float | None]:
    """Pairwise-complete rank correlations from per-column quantile grids: no row is shuffled.

    Values between two grid values share their mean rank, which changes a correlation by about ``1 / bins ** 2``; columns
    of at most ``bins`` values are exact.
    """
    out: dict[tuple[str, str], float | None] = {}
    for block in rank_bounds(df, cols, bins):
        for i, a in enumerate(block.left):
            for j, b in enumerate(block.right):
                if a < b:
                    out[cols[a], cols[b]] = None if np.isnan(block.estimate[i, j]) else float(block.estimate[i, j])
    return out


def candidate_filter(df: DataFrame, candidates: Sequence[str], originals: Sequence[str], threshold: float = 0.9,
                     method: str = "spearman") -> list[str]:
    """Candidates not strongly correlated with an original or an earlier candidate, each pair over its complete rows.

    By ranks, bounds from quantile grids settle most pairs at any number of columns; pairs whose bounds enclose the
    threshold are ranked exactly. Only pairs that may exceed the threshold are kept on the driver.
    """
    cols = [*originals, *candidates]
    if not candidates:
        return []
    if method != "spearman":
        found = correlations(df, list(combinations(cols, 2)))
        strong = {b for (_, b), r in found.items() if r is not None and abs(r) > threshold}
    else:
        above: set[int] = set()
        unsure: list[tuple[int, int]] = []
        for block in rank_bounds(df, cols):
            rows, places = np.nonzero(block.high > threshold)
            for i, j in zip(rows.tolist(), places.tolist()):
                a, b = block.left[i], block.right[j]
                if a >= b or b < len(originals):
                    continue
                if block.low[i, j] > threshold:
                    above.add(b)
                else:
                    unsure.append((a, b))
        exact = pairwise_spearman(df, [(cols[a], cols[b]) for a, b in unsure if b not in above])
        strong = {cols[b] for b in above} | {b for (_, b), r in exact.items() if r is not None and abs(r) > threshold}
    return [c for c in candidates if c not in strong]
