"""Categories to numbers and back.

A fitted column is a dictionary ``level -> value``, or, with more than ``TABLE_LEVELS`` levels, the path of a Parquet
table of its levels (``path#column``), so the width of a column is not limited and the state stays JSON. Such tables
lie in the folder of ``colsmith.levels.dir``, else in the shared folder; keep them as long as the state.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lookup import LITERAL_LEVELS, broadcast_fits, level_lookup
from ..functions.ordered import ordered_scan
from ..session import cut_lineage, shared_table

UNSEEN = "Unknown"
#: Levels of one column that a fitted state holds as a dictionary; wider columns become a table of levels.
TABLE_LEVELS = 10_000
#: Levels of one column that may come to the driver where a dictionary is the only form. Wider columns are an error.
FEW_LEVELS = 1_000_000
#: Levels of one column that tree models index and bin.
TREE_LEVELS = 10_000


def levels_of(df: DataFrame, cols: Sequence[str], limit: int = FEW_LEVELS) -> dict[str, list[str]]:
    """Sorted distinct levels; a fitted state must stay small, so a wider column is refused."""
    out = {}
    for c in cols:
        found = [r[0] for r in df.select(F.col(c).cast("string")).filter(F.col(c).isNotNull()).distinct().limit(limit + 1).collect()]
        if len(found) > limit:
            raise ValueError(f"column {c} has more than {limit} levels; combine rare levels first")
        out[c] = sorted(found)
    return out


def map_values(df: DataFrame, maps: Mapping[str, Mapping], out: Mapping[str, str] | None = None,
               default: Mapping[str, object] | None = None) -> DataFrame:
    """Replace (or add, see ``out``) columns by a lookup of their value; unseen gives the default or null."""
    out, default = dict(out or {}), dict(default or {})
    return map_many(df, [(c, out.get(c, c), m, default.get(c)) for c, m in maps.items()])


def map_many(df: DataFrame, lookups: Sequence[tuple[str, str, Mapping, object]]) -> DataFrame:
    """Several lookups (source, output, map, default) in one projection.

    Small maps become literal map lookups; the larger maps of one source column share one join with a table of its
    levels, which is broadcast when the measured keys and the values fit the broadcast budget. Level tables are looked
    up where they lie, hot levels by broadcast.
    """
    names = list(df.columns)
    made: dict[str, Column] = {}
    wide: dict[str, list] = {}
    stored: dict[tuple[str, str], list] = {}
    for source, name, mapping, base in lookups:
        if isinstance(mapping, str):
            path, _, column = mapping.rpartition("#")
            stored.setdefault((source, path), []).append((name, column, base))
            continue
        sample = next((v for v in mapping.values() if v is not None), None)
        vtype = T.StringType() if isinstance(sample, str) else T.LongType() if isinstance(sample, int) else T.DoubleType()
        if len(mapping) > LITERAL_LEVELS:
            wide.setdefault(source, []).append((name, mapping, base, vtype))
            continue
        pairs = [F.lit(x).cast(t) for k, v in mapping.items() for x, t in ((str(k), T.StringType()), (v, vtype))]
        found = F.try_element_at(F.create_map(*pairs), F.col(source).cast("string")) if pairs else F.lit(None).cast(vtype)
        made[name] = F.coalesce(found, F.lit(base).cast(vtype))
    for i, (source, group) in enumerate(wide.items()):
        fields = [T.StructField(f"__k{i}", T.StringType()), *[T.StructField(f"__v{i}_{j}", g[3]) for j, g in enumerate(group)]]
        keys = sorted({str(k) for g in group for k in g[1]})
        text = [{str(k): v for k, v in g[1].items()} for g in group]
        rows = [(k, *[t.get(k) for t in text]) for k in keys]
        table = df.sparkSession.createDataFrame(rows, T.StructType(fields))
        small = broadcast_fits(len(rows), len(group), 32 + max(1, sum(map(len, keys)) // max(1, len(keys))))
        df = df.join(F.broadcast(table) if small else table, F.col(source).cast("string") == F.col(f"__k{i}"), "left")
        for j, (name, _, base, vtype) in enumerate(group):
            made[name] = F.coalesce(F.col(f"__v{i}_{j}"), F.lit(base).cast(vtype))
    for i, ((source, path), group) in enumerate(stored.items()):
        levels = df.sparkSession.read.parquet(path)
        levels = levels.select(F.col("level").alias(f"__t{i}"), F.col("n").alias(f"__n{i}"), *[F.col(c).alias(f"__x{i}_{j}") for j, (_, c, _) in enumerate(group)])
        if i:
            df = cut_lineage(df)            # a wide lookup reads its input twice: do not nest that
        df = _looked_up(df.withColumn(f"__t{i}", F.col(f"`{source}`").cast("string")), levels, f"__t{i}", f"__n{i}")
        for j, (name, _, base) in enumerate(group):
            made[name] = F.coalesce(F.col(f"__x{i}_{j}"), F.lit(base).cast(levels.schema[f"__x{i}_{j}"].dataType))
    return df.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in names],
                     *[v.alias(n) for n, v in made.items() if n not in names])


def _looked_up(df: DataFrame, levels: DataFrame, key: str, count: str) -> DataFrame:
    """``df`` with the columns of a table of levels, whose size is measured first."""
    size = levels.agg(F.count(F.lit(1)).alias("levels"), F.sum(count).alias("rows"), F.avg(F.octet_length(F.col(key).cast("string"))).alias("bytes")).first()
    small = broadcast_fits(size["levels"], len(levels.columns) - 2, 32 + int(size["bytes"] or 0))
    return level_lookup(df, levels, key, count, size["rows"] or 0, small)


def store_levels(levels: DataFrame) -> str:
    """The path of a new table of ``level, n`` and values."""
    return shared_table(levels, "levels", levels.sparkSession.conf.get("colsmith.levels.dir", None))


def inverse_map(mapping: Mapping[str, float], digits: int | None = None) -> dict:
    """Value -> level; where levels share a value the first level in sorted order wins."""
    out: dict = {}
    for k in sorted(mapping):
        v = mapping[k] if digits is None else round(mapping[k], digits)
        out.setdefault(v, k)
    return out


def inverse_value_map(df: DataFrame, maps: Mapping[str, Mapping[str, float]], tolerance: float = 1e-9) -> DataFrame:
    """Encoded numbers back to the level with the same number (within a relative tolerance), else null."""
    return closest_level(df, maps, tolerance)


def closest_level(df: DataFrame, maps: Mapping[str, Mapping[str, float]], tolerance: float | None = None) -> DataFrame:
    """Numbers to the level whose code is nearest, of equally near ones the first by level; null stays null.

    With a ``tolerance``, a code further away (relative to its size, 1 at least) gives null. The sorted codes of a
    column are one broadcast array and a value is found by binary search, so the width of the map costs little. Where
    the map is a table, the distinct values and the codes are scanned in order together.
    """
    spark = df.sparkSession
    made = {}
    names = df.columns
    for i, c in enumerate(names):
        if isinstance(maps.get(c), str):
            df = _closest_in_table(df, c, maps[c], tolerance, f"__c{i}")
            made[c] = F.col(f"__c{i}")
            continue
        if not maps.get(c):
            made[c] = F.lit(None).cast("string") if c in maps and tolerance is not None else F.col(f"`{c}`")
            continue
        pairs = sorted((float(v), k) for v, k in inverse_map(maps[c]).items())
        made[c] = _search(spark.sparkContext.broadcast(([v for v, _ in pairs], [k for _, k in pairs])), tolerance)(F.col(f"`{c}`").cast("double"))
    return df.select(*[made[c].alias(c) for c in names])


def _closest_in_table(df: DataFrame, c: str, stored: str, tolerance: float | None, out: str) -> DataFrame:
    """``df`` with the level ``out`` whose code in the table is nearest to column ``c``."""
    path, _, column = stored.rpartition("#")
    key = F.col(f"`{c}`").cast("double")
    codes = df.sparkSession.read.parquet(path).select(F.col(column).cast("double").alias("v"), "level").filter("v is not null")
    codes = codes.groupBy("v").agg(F.min("level").alias("level"))
    asked = df.select(key.alias("v")).filter("v is not null and not isnan(v)").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    both = codes.select("v", F.lit(0).alias("asked"), "level", F.lit(0).cast("long").alias("n"))
    both = both.unionByName(asked.select("v", F.lit(1).alias("asked"), F.lit(None).cast("string").alias("level"), "n")).withColumn("falling", -F.col("v"))

    def kept(rows: DataFrame, name: str) -> DataFrame:
        # a scan reads its rows four times, and the second would run the first as often
        return df.sparkSession.read.parquet(shared_table(rows, name))
    both = kept(both, "codes")
    code = F.when(F.col("asked") == 0, F.struct("v", "level"))
    both = kept(ordered_scan(both, ["v", "asked"], fill={"below": code}), "below")
    both = ordered_scan(both, ["falling", "asked"], fill={"above": code}).filter("asked = 1")
    far_below, far_above = F.abs(F.col("v") - F.col("below.v")), F.abs(F.col("v") - F.col("above.v"))
    first = F.col("above").isNull() | (far_below < far_above) | ((far_below == far_above) & (F.col("below.level") < F.col("above.level")))
    best = F.when(F.col("below").isNotNull() & first, F.col("below")).otherwise(F.col("above"))
    found = both.select("v", "n", best.alias("best"))
    if tolerance is not None:
        found = found.filter(F.abs(F.col("v") - F.col("best.v")) <= tolerance * F.greatest(F.lit(1.0), F.abs("best.v")))
    found = df.sparkSession.read.parquet(shared_table(found.select(F.col("v").alias(f"{out}v"), F.col("n").alias(f"{out}n"), F.col("best.level").alias(out)), "closest"))
    return _looked_up(df.withColumn(f"{out}v", key), found, f"{out}v", f"{out}n").drop(f"{out}v")


def _search(shared, tolerance: float | None):
    @F.pandas_udf("string")
    def search(x: pd.Series) -> pd.Series:
        codes, levels = np.array(shared.value[0]), np.array(shared.value[1], dtype=object)
        value = x.to_numpy(float, na_value=np.nan)
        right = np.searchsorted(codes, value).clip(0, len(codes) - 1)
        left = (right - 1).clip(0)
        far_left, far_right = np.abs(value - codes[left]), np.abs(value - codes[right])
        first = (far_left < far_right) | (far_left == far_right) & (levels[left] < levels[right])
        at = np.where(first, left, right)
        out = levels[at].copy()
        missing = np.isnan(value)
        if tolerance is not None:
            missing |= np.abs(value - codes[at]) > tolerance * np.maximum(1.0, np.abs(codes[at]))
        out[missing] = None
        return pd.Series(out)
    return search


# ---- one-hot and ordinal codes ------------------------------------------------------------

def fit_one_hot(df: DataFrame, cols: Sequence[str], limit: int = 1000) -> dict[str, list[str]]:
    return levels_of(df, cols, limit)


def apply_one_hot(df: DataFrame, levels: Mapping[str, Sequence[str]], drop: bool = True) -> DataFrame:
    """``<col>_<level>`` indicators for exactly the fitted levels; a new level is all zero."""
    made = [F.coalesce((F.col(c).cast("string") == lv).cast("int"), F.lit(0)).alias(f"{c}_{lv}") for c, lvs in levels.items() for lv in lvs]
    rest = [F.col(c) for c in df.columns if not (drop and c in levels)]
    return df.select(*rest, *made)


def apply_one_hot_sparse(df: DataFrame, codes: Mapping[str, Mapping[str, int] | str]) -> DataFrame:
    """Each column as a sparse indicator vector over its label codes (``fit_label_codes``), for columns too wide for a column a level.

    A new level or null is all zero; the place of ``Unknown`` is set by that very level only.
    """
    spark = df.sparkSession
    sizes = {c: spark.read.parquet(m.rpartition("#")[0]).count() if isinstance(m, str) else len(m) for c, m in codes.items()}
    places = {c: f"__place{i}" for i, c in enumerate(codes)}
    placed = map_values(df, codes, out=places, default=sizes)
    # sizes come from the codes, not from the rows; the extra place of unseen levels is the last and dropped
    largest = spark.createDataFrame([tuple(float(sizes[c] - 1) for c in codes)], T.StructType([T.StructField(p, T.DoubleType()) for p in places.values()]))
    vectors = {p: f"{p}_vector" for p in places.values()}
    model = OneHotEncoder(inputCols=list(vectors), outputCols=list(vectors.values()), handleInvalid="keep", dropLast=True).fit(largest)
    made = model.transform(placed)
    return made.select(*[F.col(vectors[places[c]]).alias(c) if c in codes else F.col(f"`{c}`") for c in df.columns])


def fit_label_codes(df: DataFrame, cols: Sequence[str]) -> dict[str, dict[str, int] | str]:
    """Codes by sorted level; ``Unknown`` takes part in the order and receives unseen levels."""
    out: dict[str, dict[str, int] | str] = {}
    for c in cols:
        counts = df.select(F.col(f"`{c}`").cast("string").alias("level")).filter("level is not null").groupBy("level").agg(F.count(F.lit(1)).alias("n"))
        found = [r[0] for r in counts.select("level").limit(TABLE_LEVELS + 1).collect()]
        if len(found) <= TABLE_LEVELS:
            out[c] = {lv: i for i, lv in enumerate(sorted({*found, UNSEEN}))}
            continue
        unseen = df.sparkSession.createDataFrame([(UNSEEN, 0)], "level string, n long")
        levels = counts.unionByName(unseen).groupBy("level").agg(F.sum("n").alias("n"))
        levels = df.sparkSession.read.parquet(shared_table(levels, "counts"))      # counted once, read by each step of the scan
        numbered = ordered_scan(levels, ["level"], row_number="rank")
        out[c] = store_levels(numbered.select("level", "n", (F.col("rank") - 1).alias("v0"))) + "#v0"
    return out


def apply_label_codes(df: DataFrame, codes: Mapping[str, Mapping[str, int] | str]) -> DataFrame:
    def unseen(m: Mapping[str, int] | str) -> int:
        if not isinstance(m, str):
            return m[UNSEEN]
        path, _, column = m.rpartition("#")
        return df.sparkSession.read.parquet(path).filter(F.col("level") == UNSEEN).select(column).first()[0]
    return map_values(df, codes, default={c: unseen(m) for c, m in codes.items()})


# ---- target statistics --------------------------------------------------------------------

def _level_stats(df: DataFrame, cols: Sequence[str], targets: Mapping[str, Column]) -> tuple[dict[str, list | DataFrame], dict]:
    """Per level count, mean and squared deviation of each target, and the means of all rows.

    Columns of few levels are counted together and come as rows, wide ones as a table each.
    """
    wide = wide_columns(df, cols)
    stats: dict[str, list | DataFrame] = {c: [] for c in cols if c not in wide}
    aggs = [F.count("t0").alias("n")]
    for i in range(len(targets)):
        aggs += [F.avg(f"t{i}").alias(f"m{i}"), F.coalesce(F.var_pop(f"t{i}"), F.lit(0.0)).alias(f"v{i}")]
    values = [t.cast("double").alias(f"t{i}") for i, t in enumerate(targets.values())]
    if stats:
        cells = F.inline(F.array(*[F.struct(F.lit(c).alias("by"), F.col(f"`{c}`").cast("string").alias("level")) for c in stats]))
        for r in df.select(cells, *values).filter(F.col("level").isNotNull()).groupBy("by", "level").agg(*aggs).collect():
            stats[r["by"]].append(r)
    for c in wide:
        stats[c] = df.select(F.col(f"`{c}`").cast("string").alias("level"), *values).filter(F.col("level").isNotNull()).groupBy("level").agg(*aggs)
    total = df.agg(*[F.avg(t.cast("double")).alias(n) for n, t in targets.items()]).first().asDict()
    return {c: stats[c] for c in cols}, total


def wide_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns whose levels are kept as a table. Near the limit the estimate may go either way; both forms give the same codes."""
    found = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(f"d{i}") for i, c in enumerate(cols)]).first() if cols else ()
    return [c for c, d in zip(cols, found) if d > TABLE_LEVELS]


def smoothing(n: float, k: float, f: float) -> float:
    from math import exp
    return 1.0 / (1.0 + exp(min(700.0, -(n - k) / f)))


def _smoothed(mean: str, prior: float, k: float, f: float) -> Column:
    """The same as a column of a table of levels."""
    return prior + (F.col(mean) - prior) / (1.0 + F.exp(F.least(F.lit(700.0), -(F.col("n") - k) / f)))


def fit_target(df: DataFrame, cols: Sequence[str], target: Column, k: float = 20.0, f: float = 10.0) -> dict:
    """Level -> mean of the target pulled to the overall mean by a sigmoid of the level count."""
    stats, total = _level_stats(df, cols, {"y": target})
    prior = total["y"]
    maps = {c: store_levels(rows.filter("m0 is not null").select("level", "n", _smoothed("m0", prior, k, f).alias("v0"))) + "#v0" if isinstance(rows, DataFrame)
            else {r["level"]: prior + (r["m0"] - prior) * smoothing(r["n"], k, f) for r in rows if r["m0"] is not None}
            for c, rows in stats.items()}
    return {"maps": maps, "default": dict.fromkeys(cols, prior)}


def binary_target(df: DataFrame, label: str) -> Column:
    """0 / 1 by sorted label level (order-free, unlike first-seen)."""
    low = df.agg(F.min(F.col(label).cast("string"))).first()[0]
    return F.when(F.col(label).isNotNull(), (F.col(label).cast("string") != low).cast("double"))


def fit_target_multiclass(df: DataFrame, cols: Sequence[str], label: str, k: float = 20.0, f: float = 10.0) -> dict:
    """One-vs-rest target encoding: ``<col>_<class>`` for each class."""
    classes = levels_of(df, [label], 1000)[label]
    stats, prior = _level_stats(df, cols, {y: (F.col(label).cast("string") == y).cast("double") for y in classes})
    maps: dict[str, dict] = {}
    for c, rows in stats.items():
        if isinstance(rows, DataFrame):
            path = store_levels(rows.select("level", "n", *[_smoothed(f"m{i}", prior[y], k, f).alias(f"v{i}") for i, y in enumerate(classes)]))
            maps[c] = {y: f"{path}#v{i}" for i, y in enumerate(classes)}
        else:
            maps[c] = {y: {r["level"]: prior[y] + (r[f"m{i}"] - prior[y]) * smoothing(r["n"], k, f) for r in rows} for i, y in enumerate(classes)}
    return {"maps": maps, "default": prior, "classes": classes}


def apply_target_multiclass(df: DataFrame, state: Mapping) -> DataFrame:
    keep = [F.col(f"`{c}`") for c in df.columns if c not in state["maps"]]
    made = [(c, f"{c}_{y}", m, state["default"][y]) for c, per_class in state["maps"].items() for y, m in per_class.items()]
    return map_many(df, made).select(*keep, *[F.col(f"`{name}`") for _, name, _, _ in made])


def fit_shrinkage(df: DataFrame, cols: Sequence[str], target: Column, binomial: bool = False) -> dict:
    """Random-intercept effects per level by moment estimates.

    Gaussian: ``B (mean_g - mean)`` with ``B = t2 / (t2 + s2 / n_g)``; ``s2`` pools the variance
    within levels and ``t2`` is the between-level variance left after it. Binomial: the same on
    the logit of the rate with one half added to hits and misses.
    """
    from math import log
    stats, total = _level_stats(df, cols, {"y": target})
    maps: dict[str, dict[str, float] | str] = {}
    default: dict[str, float] = {}
    for c, rows in stats.items():
        if isinstance(rows, DataFrame):
            path = store_levels(_shrunk(rows.filter("n > 0"), binomial))
            maps[c] = f"{path}#v0"
            default[c] = df.sparkSession.read.parquet(path).agg(F.max_by("v0", F.struct("n", "level"))).first()[0]
            continue
        rows = [r for r in rows if r["n"]]
        n, g = sum(r["n"] for r in rows), len(rows)
        if binomial:
            logit = {r["level"]: log((r["n"] * r["m0"] + 0.5) / (r["n"] * (1 - r["m0"]) + 0.5)) for r in rows}
            noise = {r["level"]: 1 / (r["n"] * r["m0"] + 0.5) + 1 / (r["n"] * (1 - r["m0"]) + 0.5) for r in rows}
            mean = sum(r["n"] * logit[r["level"]] for r in rows) / n
            spread = sum((v - mean) ** 2 for v in logit.values()) / max(g - 1, 1)
            t2 = max(0.0, spread - sum(noise.values()) / g)
            maps[c] = {lv: (t2 / (t2 + noise[lv]) if t2 else 0.0) * (logit[lv] - mean) for lv in logit}
        else:
            mean = sum(r["n"] * r["m0"] for r in rows) / n
            s2 = sum(r["n"] * r["v0"] for r in rows) / max(n - g, 1)
            n0 = (n - sum(r["n"] ** 2 for r in rows) / n) / max(g - 1, 1)
            between = sum(r["n"] * (r["m0"] - mean) ** 2 for r in rows) / max(g - 1, 1)
            t2 = max(0.0, (between - s2) / n0) if n0 else 0.0
            maps[c] = {r["level"]: (t2 / (t2 + s2 / r["n"]) if t2 else 0.0) * (r["m0"] - mean) for r in rows}
    # an unseen level takes the effect of the commonest level
    top = {c: max(rows, key=lambda r: (r["n"], r["level"]))["level"] for c, rows in stats.items() if isinstance(rows, list) and rows}
    return {"maps": maps, "default": default | {c: maps[c][top[c]] for c in top}}


def _shrunk(rows: DataFrame, binomial: bool) -> DataFrame:
    """``level, n, v0``: the same moment estimates from a table of levels."""
    rows = rows.sparkSession.read.parquet(shared_table(rows.select("level", "n", "m0", "v0"), "moments"))
    n, hits, misses = F.col("n"), F.col("n") * F.col("m0") + 0.5, F.col("n") * (1 - F.col("m0")) + 0.5
    effect, noise = (F.log(hits / misses), 1 / hits + 1 / misses) if binomial else (F.col("m0"), F.lit(0.0))
    s = rows.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), (F.sum(n * effect) / F.sum(n)).alias("mean"), F.sum(n * F.col("v0")).alias("within"),
                 F.sum(n * n).alias("squares"), F.avg(noise).alias("noise")).first()
    away = (effect - s["mean"]) * (effect - s["mean"])
    spread = rows.agg(F.sum(away if binomial else n * away)).first()[0] / max(s["g"] - 1, 1)
    if binomial:
        t2 = max(0.0, spread - s["noise"])
        weight = t2 / (t2 + noise)
    else:
        s2 = s["within"] / max(s["n"] - s["g"], 1)
        n0 = (s["n"] - s["squares"] / s["n"]) / max(s["g"] - 1, 1)
        t2 = max(0.0, (spread - s2) / n0) if n0 else 0.0
        weight = t2 / (t2 + s2 / n)
    return rows.select("level", "n", ((weight if t2 else F.lit(0.0)) * (effect - s["mean"])).alias("v0"))


def apply_target(df: DataFrame, state: Mapping) -> DataFrame:
    return map_values(df, state["maps"], default=state["default"])
