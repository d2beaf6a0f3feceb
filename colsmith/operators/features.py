"""New columns from old ones: calendar parts, steps, powers, crosses, bins, group statistics."""
from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from itertools import combinations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import collect_stats, value_counts
from ..functions.lookup import broadcast_fits, level_lookup
from ..functions.ordered import ROWS_PER_RANGE, RangeCut, ordered_scan, range_cut
from ..session import cut_lineage
from .association import correlations
from .roles import numeric_columns

UNKNOWN, OTHERS = "unknown", "others"
CANDIDATE_LIMIT = 7500


def seconds(col: Column) -> Column:
    """Seconds since the epoch with microseconds; a timestamp without zone counts its own clock, whatever the session's zone."""
    clock = F.unix_date(col.cast("date")) * 86400 + F.hour(col) * 3600 + F.minute(col) * 60 + F.date_part(F.lit("SECOND"), col)
    return F.when(F.typeof(col) == "timestamp_ntz", clock.cast("double")).otherwise(F.unix_micros(col.cast("timestamp")) / 1e6)


# ---- time ---------------------------------------------------------------------------------

def calendar_exprs(name: str, position: int, layout: str = "yyyy-MM-dd HH:mm:ss") -> dict[str, Column]:
    """Calendar parts as categories, one per component the layout holds; Monday is 0."""
    t, made = F.col(name), {}
    if "y" in layout:
        made |= {f"year_{position}": F.year(t), f"quarter_{position}": F.quarter(t), f"week_{position}": F.weekday(t)}
    if "M" in layout:
        made[f"month_{position}"] = F.month(t)
    if "d" in layout:
        made |= {f"day_{position}": F.dayofmonth(t), f"dayofweek_{position}": F.weekday(t)}
    for letter, part, fn in (("H", "hour", F.hour), ("m", "minute", F.minute), ("s", "second", F.second)):
        if letter in layout:
            made[f"{part}_{position}"] = fn(t)
    return {n: c.cast("string") for n, c in made.items()}


def calendar_parts(df: DataFrame, layouts: Mapping[str, str]) -> DataFrame:
    made = [c.alias(n) for i, (name, layout) in enumerate(layouts.items()) for n, c in calendar_exprs(name, i, layout).items()]
    return df.select("*", *made)


def timestamp_differences(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``a_sub_b`` = seconds from a to b for each pair of time columns."""
    return df.select("*", *[(seconds(F.col(b)) - seconds(F.col(a))).alias(f"{a}_sub_{b}") for a, b in combinations(cols, 2)])


def time_delta(df: DataFrame, col: str, order_by: Sequence[str], partition_by: Sequence[str] = (),
               fill: float | None = None, rows_per_range: int = ROWS_PER_RANGE, cut: RangeCut | None = None) -> DataFrame:
    """Seconds since the previous row, rounded to 0.1; first rows get the most common gap."""
    scan = ordered_scan(df, order_by, partition_by, lag={"__prev": seconds(F.col(col))}, rows_per_range=rows_per_range, cut=cut)
    gaps = scan.select(*df.columns, F.round(seconds(F.col(col)) - F.col("__prev"), 1).alias(f"{col}_delta"))
    if fill is None:
        fill = modal_value(gaps, f"{col}_delta")
    return gaps.select(*df.columns, F.coalesce(F.col(f"{col}_delta"), F.lit(fill)).alias(f"{col}_delta"))


def modal_gap(df: DataFrame, col: str, rows_per_range: int = ROWS_PER_RANGE) -> float | None:
    """Commonest gap between consecutive rows in the order of ``col``, in seconds rounded to 0.1: ordered are the distinct times alone.

    Rows of equal time are 0 apart; each distinct time has one gap to the one before.
    """
    times = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("__n")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        scan = ordered_scan(times, [col], lag={"__prev": seconds(F.col(col))}, rows_per_range=rows_per_range)
        gap = F.round(seconds(F.col(col)) - F.col("__prev"), 1)
        gaps = scan.select(F.inline(F.array(F.struct(F.lit(0.0).alias("gap"), (F.col("__n") - 1).alias("n")), F.struct(gap.alias("gap"), F.lit(1).cast("long").alias("n")))))
        counts = gaps.filter(F.col("gap").isNotNull() & (F.col("n") > 0)).groupBy("gap").agg(F.sum("n").alias("n"))
        return counts.agg(F.min_by("gap", F.struct(-F.col("n"), F.col("gap")))).first()[0]
    finally:
        times.unpersist()


def modal_value(df: DataFrame, col: str):
    """Commonest non-null value, the smallest of equals: counted per value, then one maximum."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
    row = counts.agg(F.min_by(col, F.struct(-F.col("__n"), F.col(col)))).first()
    return row[0]


def fit_step_difference(df: DataFrame, cols: Sequence[str], ruler: str, order_by: Sequence[str],
                        partition_by: Sequence[str] = (), rows_per_range: int = ROWS_PER_RANGE, cut: RangeCut | None = None) -> dict:
    """Which columns change in proportion to elapsed time (``ruler`` holds the row gap)."""
    total, common = df.groupBy(ruler).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    flags = {c: False for c in cols}
    if total and common / total < 0.9:
        scan = ordered_scan(df, order_by, partition_by, running={"__elapsed": ruler}, rows_per_range=rows_per_range, cut=cut)
        found = correlations(scan, [(c, "__elapsed") for c in cols])
        flags = {c: abs(found[c, "__elapsed"] or 0.0) >= 0.5 for c in cols}
    return {"ruler": ruler, "divide": flags, "order_by": list(order_by), "partition_by": list(partition_by)}


def apply_step_difference(df: DataFrame, state: Mapping, rows_per_range: int = ROWS_PER_RANGE, cut: RangeCut | None = None) -> DataFrame:
    """``<col>_delta``: change since the previous row, per second where the state says so.

    A zero gap gives no rate; the last known rate is carried forward. Both scans share one cut of the order.
    """
    cols, ruler = list(state["divide"]), F.col(state["ruler"])
    order, part = state["order_by"], state["partition_by"]
    cut = cut or range_cut(df, [*part, *order], rows_per_range)
    scan = ordered_scan(df, order, part, lag={f"__p_{c}": F.col(c).cast("double") for c in cols}, cut=cut)
    step = {c: F.coalesce(F.col(c).cast("double") - F.col(f"__p_{c}"), F.lit(0.0)) for c in cols}
    rate = [c for c in cols if state["divide"][c]]
    out = scan.select(*df.columns, *[(F.when(ruler != 0, step[c] / ruler) if c in rate else step[c]).alias(f"{c}_delta") for c in cols])
    if rate:
        filled = ordered_scan(out, order, part, fill={f"__f_{c}": f"{c}_delta" for c in rate}, cut=cut)
        out = filled.select(*[F.col(f"__f_{c[:-6]}").alias(c) if c[:-6] in rate and c.endswith("_delta") and c not in df.columns
                              else F.col(c) for c in out.columns])
    return out


def fit_time_steps(df: DataFrame, time: str, cols: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = (),
                   rows_per_range: int = ROWS_PER_RANGE, cut: RangeCut | None = None) -> dict:
    """``time_delta`` and ``fit_step_difference`` in one go: one cut of the order, one count of the gaps, one scan of sums."""
    cut = cut or range_cut(df, [*partition_by, *order_by], rows_per_range)
    prev = ordered_scan(df, order_by, partition_by, lag={"__prev": seconds(F.col(time))}, cut=cut, marked=True)
    gap = F.round(seconds(F.col(time)) - F.col("__prev"), 1)
    counts = prev.groupBy(gap.alias("gap")).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("gap").isNotNull()
    total, missing, common, fill = counts.agg(
        F.sum("n"), F.sum(F.when(~known, F.col("n"))), F.max(F.when(known, F.col("n"))),
        F.min_by("gap", F.when(known, F.struct(-F.col("n"), F.col("gap"))))).first()
    # first rows take the commonest gap and count as such
    common = (common or 0) + (missing or 0)
    flags = {c: False for c in cols}
    if total and fill is not None and common / total < 0.9:
        timed = prev.withColumn("__gap", F.coalesce(gap, F.lit(fill)))
        scan = ordered_scan(timed, order_by, partition_by, running={"__elapsed": "__gap"}, cut=cut)
        found = correlations(scan, [(c, "__elapsed") for c in cols])
        flags = {c: abs(found[c, "__elapsed"] or 0.0) >= 0.5 for c in cols}
    return {"time": time, "fill": fill, "divide": flags, "order_by": list(order_by), "partition_by": list(partition_by)}


def apply_time_steps(df: DataFrame, state: Mapping, rows_per_range: int = ROWS_PER_RANGE, cut: RangeCut | None = None) -> DataFrame:
    """``<time>_delta`` and, as ``apply_step_difference`` does, ``<col>_delta``; rows are shuffled and sorted once."""
    time, cols = state["time"], list(state["divide"])
    order, part = state["order_by"], state["partition_by"]
    cut = cut or range_cut(df, [*part, *order], rows_per_range)
    lags = {"__prev": seconds(F.col(time)), **{f"__p_{c}": F.col(c).cast("double") for c in cols}}
    scan = ordered_scan(df, order, part, lag=lags, cut=cut, marked=True)
    ruler = F.coalesce(F.round(seconds(F.col(time)) - F.col("__prev"), 1), F.lit(state["fill"]).cast("double"))
    step = {c: F.coalesce(F.col(c).cast("double") - F.col(f"__p_{c}"), F.lit(0.0)) for c in cols}
    rate = [c for c in cols if state["divide"][c]]
    made = [F.when(ruler != 0, step[c] / ruler).alias(f"__r_{c}") if c in rate else step[c].alias(f"__r_{c}") for c in cols]
    out = scan.select(*df.columns, "__rg", "__ent", ruler.alias(f"{time}_delta"), *made)
    if rate:
        out = ordered_scan(out, order, part, fill={f"__k_{c}": f"__r_{c}" for c in rate}, cut=cut)
    return out.select(*df.columns, f"{time}_delta", *[F.col(f"__k_{c}" if c in rate else f"__r_{c}").alias(f"{c}_delta") for c in cols])


# ---- powers, waves and crosses ------------------------------------------------------------

def nonnegative(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [c for c, s in collect_stats(df, cols, lambda x: {"lo": F.min(x).cast("double")}).items()
            if s["lo"] is not None and s["lo"] >= 0]


def polynomial_exprs(cols: Sequence[str], root_cols: Sequence[str]) -> dict[str, Column]:
    made = {f"pow({c})": F.col(c).cast("double") * F.col(c).cast("double") for c in cols}
    # roots are decided at fit; a negative value met later has none
    made |= {f"sqrt({c})": F.when(F.col(c) >= 0, F.sqrt(F.col(c).cast("double"))) for c in root_cols}
    return made


def trigonometry_exprs(cols: Sequence[str]) -> dict[str, Column]:
    return {f"{n}({c})": f(F.col(c).cast("double")) for n, f in (("sin", F.sin), ("cos", F.cos), ("tan", F.tan)) for c in cols}


def interaction_exprs(cols: Sequence[str]) -> dict[str, Column]:
    """Products, ratios, sums and differences of each pair (the later over / minus the earlier)."""
    made: dict[str, Column] = {}
    for a, b in combinations(cols, 2):
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        made[f"{a}_multiply_{b}"] = x * y
        made[f"{a}_divide_{b}"] = F.coalesce(F.try_divide(y, x), F.lit(0.0))
        made[f"{a}_add_{b}"] = x + y
        made[f"{a}_subtract_{b}"] = y - x
    return made


def add_columns(df: DataFrame, made: Mapping[str, Column]) -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in made.items()])


def row_norm(cols: Sequence[str]) -> Column:
    return F.sqrt(sum((F.pow(F.col(c).cast("double"), 2) for c in cols), F.lit(0.0)))


def cross_count(n_numeric: int, n_nominal: int) -> int:
    """Number of candidates that crosses of so many columns make."""
    return n_numeric * n_nominal * 4 + n_numeric * (5 + (n_numeric - 1) * 2)


def synthesis_budget(n_numeric: int, n_nominal: int, limit: int = CANDIDATE_LIMIT) -> bool:
    """Whether crosses of so many columns stay within the candidate limit."""
    return cross_count(n_numeric, n_nominal) <= limit


def column_arithmetic(a: Column, b: Column) -> dict[str, Column]:
    """Sum, difference, product; a quotient in which one missing side counts as 0."""
    x, y = a.cast("double"), b.cast("double")
    num, den = F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))
    inf = F.lit(float("inf"))
    by_zero = F.when(num > 0, inf).when(num < 0, -inf).otherwise(F.lit(float("nan")))
    quotient = F.when(x.isNull() & y.isNull(), F.lit(None).cast("double")).when(den == 0, by_zero).otherwise(F.try_divide(num, den))
    return {"add": x + y, "sub": x - y, "divide": quotient, "multiply": x * y}


# ---- bins ---------------------------------------------------------------------------------

def fit_kmeans_bins(df: DataFrame, cols: Sequence[str] | None = None, size: int = 10, max_iter: int = 50,
                    tolerance: float = 1e-4) -> dict[str, list[float]]:
    """Inner edges of one-dimensional k-means bins for columns with more than ``size`` values.

    In one dimension a cluster is the interval between two midpoints, so a Lloyd step is one
    grouped mean. All columns step together, over counts per distinct value, from evenly spread
    quantiles; a column stops when its centres move by less than ``tolerance`` of its spread.
    """
    cols = list(cols or numeric_columns(df))
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols]
    counts = (df.select(F.inline(F.array(*cells))).filter(F.col("v").isNotNull() & ~F.isnan("v"))
              .groupBy("feature", "v").agg(F.count(F.lit(1)).alias("w")).persist(StorageLevel.MEMORY_AND_DISK))
    try:
        spread = {r["feature"]: r for r in counts.groupBy("feature").agg(
            F.count(F.lit(1)).alias("d"), F.percentile_approx("v", [(k + 0.5) / size for k in range(size)], 10_000).alias("start"),
            (F.max("v") - F.min("v")).alias("range")).collect()}
        wide = [c for c in cols if c in spread and spread[c]["d"] > size]
        centres = {c: sorted(set(spread[c]["start"])) for c in wide}
        live = list(wide)
        for _ in range(max_iter):
            if not live:
                break
            place = F.lit(None).cast("int")
            for c in live:
                place = F.when(F.col("feature") == c, bin_expr(F.col("v"), _midpoints(centres[c]))).otherwise(place)
            moved = (counts.filter(F.col("feature").isin(live)).groupBy("feature", place.alias("bin"))
                     .agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("centre")).collect())
            for c in list(live):
                fresh = list(centres[c])
                for r in moved:
                    if r["feature"] == c:
                        fresh[r["bin"]] = r["centre"]
                shift = max(abs(a - b) for a, b in zip(fresh, centres[c]))
                centres[c] = sorted(fresh)
                if shift <= tolerance * spread[c]["range"]:
                    live.remove(c)
    finally:
        counts.unpersist()
    return {c: _midpoints(centres[c]) for c in wide}


def _midpoints(centres: Sequence[float]) -> list[float]:
    return [(a + b) / 2 for a, b in zip(centres, centres[1:])]


def bin_expr(col: Column, edges: Sequence[float]) -> Column:
    """Index of the right-closed interval that holds the value."""
    below = F.array(*[F.lit(float(e)) for e in sorted(edges)]) if edges else F.array().cast("array<double>")
    index = F.size(F.filter(below, lambda e: e < col.cast("double")))
    return F.when(col.isNotNull(), index)


def apply_bins(df: DataFrame, edges: Mapping[str, Sequence[float]], suffix: str = "binned") -> DataFrame:
    return df.select("*", *[bin_expr(F.col(c), e).cast("string").alias(f"{c}_{suffix}") for c, e in edges.items()])


# ---- skewness -----------------------------------------------------------------------------

def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    # each branch only sees its own sign: a power of a negative base is not a number
    return F.when(x >= 0, up).otherwise(down)


def _likelihoods(df: DataFrame, grids: Mapping[str, Sequence[float]]) -> dict[str, list[float]]:
    aggs = []
    for i, (c, grid) in enumerate(grids.items()):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias(f"j{i}")]
        aggs += [F.var_pop(yeo_johnson(x, lam)).alias(f"v{i}_{k}") for k, lam in enumerate(grid)]
    row = df.agg(*aggs).first()
    out = {}
    for i, (c, grid) in enumerate(grids.items()):
        out[c] = [(-row[f"n{i}"] / 2 * math.log(v) + (lam - 1) * row[f"j{i}"]) if (v := row[f"v{i}_{k}"]) and math.isfinite(v) and v > 0
                  else -math.inf for k, lam in enumerate(grid)]
    return out


def fit_yeo_johnson(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.5,
                    rounds: int = 4, block: int = 8) -> dict[str, dict]:
    """Maximum-likelihood lambda per skewed column, from a grid refined around its best point.

    All skewed columns of a block share one aggregate per round.
    """
    cols = list(cols or numeric_columns(df))
    skewed = [c for c, s in collect_stats(df, cols, lambda x: {"s": F.skewness(x.cast("double"))}).items()
              if s["s"] is not None and abs(s["s"]) > threshold]
    fitted: dict[str, dict] = {}
    for at in range(0, len(skewed), block):
        span = {c: (-4.0, 4.0) for c in skewed[at:at + block]}
        for _ in range(rounds):
            grids = {c: [lo + (hi - lo) * k / 20 for k in range(21)] for c, (lo, hi) in span.items()}
            for c, scores in _likelihoods(df, grids).items():
                best = max(range(21), key=scores.__getitem__)
                width = (span[c][1] - span[c][0]) / 20
                span[c] = (grids[c][best] - width, grids[c][best] + width)
        lam = {c: (lo + hi) / 2 for c, (lo, hi) in span.items()}
        made = df.agg(*[F.avg(yeo_johnson(F.col(c).cast("double"), v)).alias(c) for c, v in lam.items()]).first()
        for c, v in lam.items():
            fitted[c] = {"lambda": v, "factor": made[c] / 10 if made[c] > 10_000 else 1.0}
    return fitted


def apply_yeo_johnson(df: DataFrame, state: Mapping[str, Mapping], suffix: str | None = "_PT") -> DataFrame:
    """With a suffix new columns are added; with ``None`` the originals are replaced."""
    made = {c: yeo_johnson(F.col(c).cast("double"), s["lambda"]) / s["factor"] for c, s in state.items()}
    if suffix is not None:
        return df.select("*", *[v.alias(c + suffix) for c, v in made.items()])
    return df.select(*[made[c].alias(c) if c in made else F.col(c) for c in df.columns])


def fit_log_sqrt(df: DataFrame, cols: Sequence[str], threshold: float = 0.5) -> dict[str, dict[str, float]]:
    """Columns skewed to the right get a logarithm, to the left a root, after a shift to >= 0."""
    state: dict[str, dict[str, float]] = {"log": {}, "sqrt": {}}
    for c, s in collect_stats(df, cols, lambda x: {"s": F.skewness(x.cast("double")), "lo": F.min(x).cast("double")}).items():
        if s["s"] is None:
            continue
        shift = abs(min(0.0, s["lo"]))
        if s["s"] > threshold:
            state["log"][c] = shift
        elif s["s"] < -threshold:
            state["sqrt"][c] = shift
    return state


def apply_log_sqrt(df: DataFrame, state: Mapping[str, Mapping[str, float]]) -> DataFrame:
    def change(c: str) -> Column:
        if c in state["log"]:
            x = F.col(c).cast("double") + state["log"][c]
            return F.coalesce(F.when(x > -1, F.log1p(x)), F.lit(-1.0)).alias(c)
        if c in state["sqrt"]:
            x = F.col(c).cast("double") + state["sqrt"][c]
            return F.coalesce(F.when(x >= 0, F.sqrt(x)), F.lit(-1.0)).alias(c)
        return F.col(c)
    return df.select(*[change(c) for c in df.columns])


def invert_log_sqrt(df: DataFrame, state: Mapping[str, Mapping[str, float]]) -> DataFrame:
    def change(c: str) -> Column:
        x = F.col(c).cast("double")
        if c in state["log"]:
            return F.when(x == -1, 0.0).otherwise(F.expm1(x) - state["log"][c]).alias(c)
        if c in state["sqrt"]:
            return F.when(x == -1, 0.0).otherwise(x * x - state["sqrt"][c]).alias(c)
        return F.col(c)
    return df.select(*[change(c) for c in df.columns])


# ---- rare levels --------------------------------------------------------------------------

def fit_rare(df: DataFrame, cols: Sequence[str], min_levels: int = 15, share: float = 0.005) -> dict[str, list[str]]:
    """Levels to keep, for columns with more than ``min_levels``; at most ``1 / share`` each."""
    if not cols:
        return {}
    rows = df.count()
    counts = value_counts(df, cols).filter(F.col("value").isNotNull())
    sizes = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("levels")).filter(F.col("levels") > min_levels)
    wide = [r["feature"] for r in sizes.collect()]
    keep: dict[str, list[str]] = {c: [] for c in cols if c in wide}
    if keep:
        kept = counts.filter(F.col("feature").isin(wide) & ((F.col("n") / rows >= share) | (F.col("value") == UNKNOWN)))
        for r in kept.collect():
            keep[r["feature"]].append(r["value"])
    return {c: sorted(v) for c, v in keep.items()}


def apply_rare(df: DataFrame, keep: Mapping[str, Sequence[str]]) -> DataFrame:
    def change(c: str) -> Column:
        x = F.coalesce(F.col(c), F.lit(UNKNOWN))
        return F.when(x.isin([*keep[c], UNKNOWN]), x).otherwise(F.lit(OTHERS)).alias(c)
    return df.select(*[change(c) if c in keep else F.col(c) for c in df.columns])


# ---- group statistics ---------------------------------------------------------------------

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "max": F.max, "min": F.min, "mean": F.avg, "std": F.stddev_samp, "var": F.var_samp}


def group_name(category: str, numeric: str, agg: str) -> str:
    return f"{category}_{numeric}_groupBy_{agg}"


def group_tables(df: DataFrame, cats: Sequence[str], nums: Sequence[str], aggs: Sequence[str] = ("max", "min", "mean", "std"),
                 functions: Mapping[str, Callable[[Column], Column]] | None = None) -> dict[str, DataFrame]:
    """One table per category column: level, row count and every aggregate of every numeric."""
    known = {**AGGREGATES, **(functions or {})}
    unknown = [a for a in aggs if a not in known]
    if unknown or not aggs:
        raise ValueError(f"unknown aggregates: {unknown}")
    return {c: df.filter(F.col(c).isNotNull()).groupBy(c).agg(
        F.count(F.lit(1)).alias("__n"),
        *[known[a](F.col(x).cast("double")).alias(group_name(c, x, a)) for a in aggs for x in nums]) for c in cats}


def group_aggregates(df: DataFrame, cats: Sequence[str], nums: Sequence[str],
                     aggs: Sequence[str] = ("max", "min", "mean", "std"), source: DataFrame | None = None,
                     functions: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Every row with the aggregates of its levels; ``functions`` names further aggregates as functions of a column.

    A window would move every wide row to the task of its level; instead the level tables
    (map-side combined) are looked up, by broadcast when their counted size is small.
    """
    base = df if source is None else source
    sizes = base.agg(F.count(F.lit(1)).alias("__rows"), *[F.approx_count_distinct(c).alias(c) for c in cats]).first()
    small = {c: broadcast_fits(sizes[c], len(nums) * len(aggs)) for c in cats}
    tables = group_tables(base, cats, nums, aggs, functions)
    wide_seen = False
    for c in sorted(cats, key=lambda x: not small[x]):
        if not small[c] and wide_seen:
            df = cut_lineage(df)            # a wide lookup reads its input twice: do not nest that
        wide_seen = wide_seen or not small[c]
        df = level_lookup(df, tables[c], c, "__n", sizes["__rows"], small[c])
    return df
