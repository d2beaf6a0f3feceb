"""Row and value cleaning: text, tokens, impurities, outliers, near duplicates."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import collect_stats, distinct_counts, long_stats, value_counts, with_distinct
from ..functions.ordered import ROWS_PER_RANGE, ordered_scan
from ..functions.quantiles import exact_quantiles
from ..session import cut_lineage
from .profiling import outlier_fences
from .roles import numeric_columns, time_columns

NULL_TOKENS = ("NA", "na")


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def _replace(df: DataFrame, cols: Sequence[str], change) -> DataFrame:
    chosen = set(cols)
    return df.select(*[change(F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns])


def null_tokens(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    return _replace(df, _text_columns(df), lambda c: F.when(~c.isin(*tokens), c))


def infinite_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Infinities and NaN become null, so every later aggregate skips them."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return _replace(df, cols or floats, lambda c: F.when(F.abs(c) < float("inf"), c))


def strip_non_numeric(col: Column) -> Column:
    """Keep digits and dots, then cast; null when nothing numeric is left."""
    return F.regexp_replace(col, "[^0-9.]", "").try_cast("double")


def clean_text(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return _replace(df, cols or _text_columns(df), lambda c: F.lower(F.trim(c)))


def fit_split_alnum(df: DataFrame, col: str) -> list[int]:
    """Positions of the letter / non-letter pieces that hold more than one value."""
    pieces = F.regexp_extract_all(F.col(col), F.lit("([A-Za-z]+|[^A-Za-z]+)"), 1)
    spread = df.select(F.posexplode(pieces).alias("at", "piece")).groupBy("at").agg(F.min("piece").alias("lo"), F.max("piece").alias("hi"))
    return sorted(r["at"] for r in spread.filter("lo <> hi").select("at").collect())      # at most the pieces of the longest text


def apply_split_alnum(df: DataFrame, col: str, positions: Sequence[int]) -> DataFrame:
    pieces = F.regexp_extract_all(F.col(col), F.lit("([A-Za-z]+|[^A-Za-z]+)"), 1)
    return df.select("*", *[F.get(pieces, i).alias(f"{col}_{i}") for i in positions])


def fit_winsor(df: DataFrame, cols: Sequence[str] | None = None, low: float = 0.01, high: float = 0.99) -> dict[str, list]:
    return exact_quantiles(df, list(cols or numeric_columns(df)), [low, high])


def apply_winsor(df: DataFrame, limits: Mapping[str, Sequence[float]]) -> DataFrame:
    def clamp(name: str) -> Column:
        lo, hi = limits[name]
        x = F.col(name).cast("double")
        return F.when(x < lo, lo).when(x > hi, hi).otherwise(x).alias(name)
    return df.select(*[clamp(c) if c in limits and limits[c][0] is not None else F.col(c) for c in df.columns])


def iqr_outliers(df: DataFrame, col: str, k: float = 100.0) -> DataFrame:
    """Rows outside the fences; a zero spread uses k = 3, which selects what differs."""
    low, high, *_ = outlier_fences(df, [col], k, zero_spread=3.0)[col]
    return df.filter(~F.col(col).cast("double").between(low, high))


def near_target(df: DataFrame, label: str, target: float, bound: float) -> DataFrame:
    """Rows whose label lies within ``bound`` of the label range around the clamped target."""
    lo, hi = df.agg(F.min(label), F.max(label)).first()
    centre = min(max(target, lo), hi)
    reach = bound * (hi - lo)
    return df.filter(F.col(label).between(centre - reach, centre + reach))


def find_impurities(df: DataFrame, max_tokens: int = 4, unique_threshold: int = 256) -> dict[str, list[str]]:
    """Text columns that become numeric once rows with at most four odd tokens are deleted.

    Columns are judged one after the other on the surviving rows, so the tokens found so far
    filter each later check. A set of odd tokens is collected up to one more than allowed.
    One scan of all columns first leaves out those that no deletion of rows could make match:
    without an odd token, or with too few values.
    """
    texts = _text_columns(df)

    def odd_token(c: str) -> Column:
        return F.when(F.col(c).try_cast("double").isNull(), F.col(c))
    screen = collect_stats(df, texts, lambda x: {"wide": F.approx_count_distinct(x), "odd": F.count(F.when(x.try_cast("double").isNull(), x))})
    found: dict[str, list[str]] = {}
    for c in texts:
        if screen[c]["odd"] == 0 or screen[c]["wide"] <= unique_threshold // 2:
            continue
        rest = drop_tokens(df, found)
        odd = odd_token(c)
        wide, n_odd = rest.agg(F.approx_count_distinct(c), F.approx_count_distinct(odd)).first()
        if wide <= unique_threshold * 2:        # near the limit only an exact count decides
            if wide <= unique_threshold // 2 or rest.agg(F.count_distinct(c)).first()[0] <= unique_threshold:
                continue
        if n_odd > max_tokens * 2:
            continue
        tokens = [r[0] for r in rest.filter(odd.isNotNull()).select(c).distinct().limit(max_tokens + 1).collect()]
        if 0 < len(tokens) <= max_tokens:
            found[c] = sorted(tokens)
    return found


def drop_tokens(df: DataFrame, tokens: Mapping[str, Sequence[str]]) -> DataFrame:
    for c, bad in tokens.items():
        df = df.filter(F.col(c).isNull() | ~F.col(c).isin(list(bad)))
    return df


def purge_impurities(df: DataFrame, max_tokens: int = 4, unique_threshold: int = 256) -> tuple[DataFrame, dict[str, list[str]]]:
    found = find_impurities(df, max_tokens, unique_threshold)
    kept = drop_tokens(df, found)
    return kept.select(*[F.col(c).try_cast("double").alias(c) if c in found else F.col(c) for c in df.columns]), found


def drop_near_duplicates(df: DataFrame, order_by: Sequence[str] | None = None, remove_quantile: float = 0.25,
                         cols: Sequence[str] | None = None, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Drop rows closer to their predecessor than the given quantile of such distances.

    The first row has no predecessor and is dropped too. ``order_by`` must be a total order.
    """
    order_by = list(order_by or time_columns(df)[:1])
    cols = list(cols or [c for c in numeric_columns(df) if c not in order_by])
    scan = ordered_scan(df, order_by, lag={f"__prev_{c}": F.col(c).cast("double") for c in cols},
                        rows_per_range=rows_per_range)
    square = sum((F.pow(F.col(c).cast("double") - F.col(f"__prev_{c}"), 2) for c in cols), F.lit(0.0))
    # the cutoff needs several passes over the distances: write them once
    far = cut_lineage(scan.select(*df.columns, F.sqrt(square).alias("__distance")))
    cutoff = exact_quantiles(far, ["__distance"], [remove_quantile])["__distance"][0]
    return far.filter(F.col("__distance") >= cutoff).select(*df.columns)


def constant_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(feature, all_zero, constant) for every column."""
    cols = list(cols or df.columns)
    numeric = set(numeric_columns(df))
    aggs, structs = [], []
    for i, c in enumerate(cols):
        x = F.col(c)
        zero = F.coalesce(F.bool_and(F.coalesce(x == 0, F.lit(False))), F.lit(False)) if c in numeric else F.lit(False)
        aggs += [zero.alias(f"z{i}"), (F.min(x).eqNullSafe(F.max(x)) & (F.count(x) > 0)).alias(f"c{i}")]
        structs.append(F.struct(F.lit(c).alias("feature"), F.col(f"z{i}").alias("all_zero"), F.col(f"c{i}").alias("constant")))
    return df.agg(*aggs).select(F.inline(F.array(*structs)))


def high_cardinality(df: DataFrame, limit: int = 256, cols: Sequence[str] | None = None) -> DataFrame:
    return distinct_counts(df, list(cols or _text_columns(df)), out="n_distinct").filter(F.col("n_distinct") > limit)


def quasi_constant(df: DataFrame, cols: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """Columns whose commonest value (null counts as ``unknown``) covers the threshold share."""
    counts = value_counts(df, cols)
    shares = counts.groupBy("feature").agg((F.max("n") / F.sum("n")).alias("share"))
    return shares.filter(F.col("share") >= threshold)


SERIAL_NAMES = ("id", "code", "number", "serial", "sn", "s/n", "sequence")


def serial_columns(df: DataFrame, cols: Sequence[str] | None = None, order_by: Sequence[str] | None = None,
                   rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(feature, serial): consecutive numbers, or an id-like name over strictly rising numbers.

    With ``order_by`` consecutive rows are compared. Without it the order-free form is used:
    all values differ and span exactly their count (an id-like name only needs all different).
    """
    numeric = [c for c in (cols or df.columns) if c in numeric_columns(df)]
    named = {c: c.lower() in SERIAL_NAMES for c in numeric}
    if order_by:
        scan = ordered_scan(df, order_by, lag={f"__p_{c}": c for c in numeric}, row_number="__rn",
                            rows_per_range=rows_per_range)
        def verdict(c: str) -> Column:
            step = F.col(c) - F.col(f"__p_{c}")
            rule = F.bool_and(F.when(F.col("__rn") > 1, F.coalesce(step == 1, F.lit(False))))
            rising = F.bool_and(F.when(F.col("__rn") > 1, F.coalesce(step > 0, F.lit(False))))
            return F.coalesce(rule | (F.lit(named[c]) & rising), F.lit(True))
        made = scan.agg(*[verdict(c).alias(f"v{i}") for i, c in enumerate(numeric)])
        return made.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("serial"))
                                              for i, c in enumerate(numeric)])))
    spans = long_stats(df, numeric, lambda x: {"rows": F.count(F.lit(1)), "span": (F.max(x) - F.min(x)).cast("double")})
    step = (F.col("span") == F.col("rows") - 1) | F.col("feature").isin([c for c in numeric if named[c]])
    whole = F.col("d") == F.col("rows")
    return with_distinct(spans, df, numeric, out="d").select("feature", (whole & step).alias("serial"))


def clean_plan(df: DataFrame, exclude: Sequence[str] = (), limit: int = 256, order_by: Sequence[str] | None = None) -> list[str]:
    """Columns to drop: constant, all zero, too many levels, running numbers, excluded."""
    out = [c for c in df.columns if c in exclude]
    rest = [c for c in df.columns if c not in exclude]
    texts = [c for c in _text_columns(df) if c in rest]
    drop = {r["feature"] for r in constant_columns(df, rest).collect() if r["constant"] or r["all_zero"]}
    if texts:
        drop |= {r["feature"] for r in high_cardinality(df, limit, texts).collect()}
    nums = [c for c in numeric_columns(df) if c in rest]
    if nums:
        # cheap necessary condition first: a running number spans at least its row count
        bounds = collect_stats(df, nums, lambda x: {"lo": F.min(x).cast("double"), "hi": F.max(x).cast("double"),
                                                    "n": F.count(x), "rows": F.count(F.lit(1))})
        maybe = [c for c, s in bounds.items() if s["n"] == s["rows"] and s["lo"] is not None
                 and (s["hi"] - s["lo"] == s["n"] - 1 or c.lower() in SERIAL_NAMES)]
        if maybe:
            drop |= {r["feature"] for r in serial_columns(df, maybe, order_by).collect() if r["serial"]}
    return out + [c for c in rest if c in drop]


def data_clean(df: DataFrame, exclude: Sequence[str] = (), limit: int = 256, order_by: Sequence[str] | None = None) -> DataFrame:
    return df.drop(*clean_plan(df, exclude, limit, order_by))
