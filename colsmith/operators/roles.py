"""Column roles, type inference, problem type and text timestamps."""
from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import collect_stats, with_distinct

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType, T.DecimalType)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)

BINARY, MULTICLASS, REGRESSION = "binary", "multiclass", "regression"


class CheckError(ValueError):
    """A failed input check; the text starts with its code, as in ``3104@A,B``."""

    def __init__(self, code: int, detail: object = "") -> None:
        super().__init__(f"{code}@{detail}")
        self.code = code


def columns_of(df: DataFrame, *kinds) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, *INTEGERS, *FLOATS)


def nominal_columns(df: DataFrame) -> list[str]:
    return columns_of(df, T.StringType, T.BooleanType)


def time_columns(df: DataFrame) -> list[str]:
    return columns_of(df, *TIMES)


def select_roles(df: DataFrame, types: Mapping[str, str] | None = None) -> DataFrame:
    """Numeric, then nominal (as text), then time columns; anything else is dropped.

    ``types`` may name columns that are categories although their storage type is a number.
    """
    forced = {c for c, t in (types or {}).items() if t in ("object", "category", "bool")}
    numeric = [c for c in numeric_columns(df) if c not in forced]
    nominal = [c for c in df.columns if c in forced or c in nominal_columns(df)]
    return df.select(*[F.col(c) for c in numeric],
                     *[F.col(c).cast("string").alias(c) for c in nominal],
                     *[F.col(c) for c in time_columns(df) if c not in forced])


def category_boundary(rows: int) -> int:
    return int(math.sqrt(rows) // math.log10(rows)) if rows > 1 else 0


def family_rule(kind: str, distinct: Column, maximum: Column, boundary: Column) -> Column:
    """Type family from the storage kind, the number of distinct values and the maximum."""
    if kind == "int":
        few = (distinct <= 4) | ((distinct <= boundary) & (maximum < 250))
        return F.when(few, F.lit("object")).otherwise(F.lit("int"))
    if kind == "float":
        return F.when((distinct <= 3) & (maximum <= 3), F.lit("object")).otherwise(F.lit("float"))
    return F.lit({"time": "datetime"}.get(kind, "object"))


def storage_kind(dtype: T.DataType) -> str:
    if isinstance(dtype, INTEGERS):
        return "int"
    if isinstance(dtype, FLOATS):
        return "float"
    return "time" if isinstance(dtype, TIMES) else "text"


def feature_types(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(feature, n_distinct, family) for every column, from one aggregate and one count of distinct values."""
    cols = list(cols or df.columns)
    kinds = {c: storage_kind(df.schema[c].dataType) for c in cols}
    aggs = [F.count(F.lit(1)).alias("rows")]
    structs = []
    for i, c in enumerate(cols):
        numeric = kinds[c] in ("int", "float")
        if numeric:
            aggs.append(F.max(F.col(c).cast("double")).alias(f"m{i}"))
        structs.append(F.struct(F.lit(c).alias("feature"), F.lit(kinds[c]).alias("kind"),
                                (F.col(f"m{i}") if numeric else F.lit(None).cast("double")).alias("top"), F.col("rows")))
    stats = with_distinct(df.agg(*aggs).select(F.inline(F.array(*structs))), df, cols, out="n_distinct")
    boundary = F.floor(F.sqrt("rows") / F.log10("rows"))
    family = F.lit(None).cast("string")
    for kind in sorted(set(kinds.values())):
        family = F.when(F.col("kind") == kind, family_rule(kind, F.col("n_distinct"), F.col("top"), boundary)).otherwise(family)
    return stats.select("feature", "n_distinct", family.alias("family"))


def infer_types(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, str]:
    return {r["feature"]: r["family"] for r in feature_types(df, cols).collect()}


def problem_type_table(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(label, n, n_distinct, problem_type) for each candidate label column."""
    aggs, structs = [], []
    for i, c in enumerate(labels):
        kind = storage_kind(df.schema[c].dataType)
        x = F.col(c)
        integral = F.bool_and(x == F.floor(x)) if kind == "float" else F.lit(True)
        aggs += [F.count(x).alias(f"n{i}"), integral.alias(f"w{i}")]
        structs.append(F.struct(F.lit(c).alias("label"), F.col(f"n{i}").alias("n"), F.lit(kind == "text").alias("text"),
                                F.col(f"w{i}").alias("whole")))
    stats = with_distinct(df.agg(*aggs).select(F.inline(F.array(*structs))), df, labels, "label", "n_distinct")
    n, d = F.col("n"), F.col("n_distinct")
    threshold = F.when(n > 1000, 0.05).otherwise(0.1)
    classes = F.col("text") | ((d / n <= threshold) & (d <= 1000) & F.col("whole"))
    verdict = F.when(d == 2, BINARY).when(classes, MULTICLASS).otherwise(REGRESSION)
    return stats.select("label", "n", "n_distinct", F.when(n > 0, verdict).alias("problem_type"))


def problem_type(df: DataFrame, label: str) -> str:
    found = problem_type_table(df, [label]).first()["problem_type"]
    if found is None:
        raise CheckError(3105)
    return found


def split_label(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    if label not in df.columns:
        raise CheckError(3106, label)
    return df.drop(label), df.select(label)


# ---- timestamps stored as text ------------------------------------------------------------

# Accepted layouts: a date layout alone or followed by a time layout, or digits only.
_DATES = [(r"\d{1,2}-\d{1,2}-\d{4}", "d-M-yyyy"), (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
          (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"), (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"),
          (r"\d{1,2}\s[A-Za-z]{3}\s\d{4}", "d MMM yyyy"), (r"\d{1,2}\s[A-Za-z]{4,}\s\d{4}", "d MMMM yyyy")]
_TIMES = [("", ""), (r"\s\d{1,2}:\d{2}", " H:mm"), (r"\s\d{1,2}:\d{2}:\d{2}", " H:mm:ss"),
          (r"\s\d{1,2}:\d{2}:\d{2}\.\d{6}", " H:mm:ss.SSSSSS"), (r"\s\d{1,2}:\d{2}:\d{2}:\d{6}", " H:mm:ss:SSSSSS")]
_DIGITS = [(r"\d{8}", "yyyyMMdd"), (r"\d{12}", "yyyyMMddHHmm"), (r"\d{8}\s\d{4}", "yyyyMMdd HHmm"),
           (r"\d{14}", "yyyyMMddHHmmss"), (r"\d{8}\s\d{6}", "yyyyMMdd HHmmss"), (r"\d{8}T\d{6}", "yyyyMMdd'T'HHmmss"),
           (r"\d{20}", "yyyyMMddHHmmssSSSSSS"), (r"\d{8}\s\d{12}", "yyyyMMdd HHmmssSSSSSS")]
TIME_LAYOUTS = [(re.compile(f"^{p}$"), f) for p, f in _DIGITS] + [
    (re.compile(f"^{dp}{tp}$"), df_ + tf) for tp, tf in _TIMES for dp, df_ in _DATES]


# Pattern letters and the percent codes written to profiles.
_PERCENT = {"'T'": "T", "yyyy": "%Y", "MMMM": "%B", "MMM": "%b", "MM": "%m", "M": "%m", "dd": "%d", "d": "%d", "HH": "%H", "H": "%H",
            "mm": "%M", "ss": "%S", "SSSSSS": "%f"}


def percent_layout(layout: str) -> str:
    """The layout in percent codes, as column profiles store it."""
    return re.sub("'T'|yyyy|M{1,4}|d{1,2}|H{1,2}|mm|ss|S{6}", lambda m: _PERCENT[m.group()], layout)


def parse_time(col: Column, layout: str) -> Column:
    text = col.cast("string")
    if "MMM" in layout:
        text = F.initcap(text)
    if "ssSSSSSS" in layout:        # a fraction needs a separator to be told from the seconds
        text, layout = F.regexp_replace(text, r"(\d{6})$", ".$1"), layout.replace("ssSSSSSS", "ss.SSSSSS")
    return F.try_to_timestamp(text, F.lit(layout))


def infer_time_formats(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, str]:
    """Layout of each text or integer column whose every value parses as a timestamp.

    One value proposes layouts (any value will do, since all must parse); a second pass
    verifies all proposals together. The last layout that parses the whole column wins.
    """
    cols = [c for c in (cols or df.columns) if isinstance(df.schema[c].dataType, (T.StringType, *INTEGERS))]
    if not cols:
        return {}
    probe = df.agg(*[F.min(F.col(c)).cast("string").alias(f"v{i}") for i, c in enumerate(cols)]).first()
    proposals = [(c, layout) for i, c in enumerate(cols) if probe[f"v{i}"] is not None
                 for pattern, layout in TIME_LAYOUTS if pattern.match(probe[f"v{i}"])]
    if not proposals:
        return {}
    failed = df.agg(*[F.count(F.when(F.col(c).isNotNull() & parse_time(F.col(c), f).isNull(), 1)).alias(f"f{i}")
                      for i, (c, f) in enumerate(proposals)]).first()
    return {c: f for i, (c, f) in enumerate(proposals) if failed[f"f{i}"] == 0}


def apply_time_formats(df: DataFrame, formats: Mapping[str, str], check: bool = False) -> DataFrame:
    """Parse the named columns; with ``check`` a value that does not parse raises 3202."""
    if check and formats:
        bad = df.agg(*[F.count(F.when(F.col(c).isNotNull() & parse_time(F.col(c), f).isNull(), 1)).alias(c)
                       for c, f in formats.items()]).first()
        for c, f in formats.items():
            if bad[c]:
                raise CheckError(3202, f"{c};{f}")
    ready = {c for c in formats if isinstance(df.schema[c].dataType, TIMES)}
    return df.select(*[parse_time(F.col(c), formats[c]).alias(c) if c in formats and c not in ready else F.col(c)
                       for c in df.columns])


# ---- storage width ------------------------------------------------------------------------

_INT_STEPS = [("tinyint", 8), ("smallint", 16), ("int", 32)]


def narrow_plan(df: DataFrame) -> dict[str, str]:
    """Smallest storage type of each numeric column that holds every value unchanged."""
    ints, floats = columns_of(df, *INTEGERS), columns_of(df, T.FloatType, T.DoubleType)
    plan: dict[str, str] = {}
    for c, s in collect_stats(df, ints, lambda x: {"lo": F.min(x).cast("long"), "hi": F.max(x).cast("long")}).items():
        fits = [t for t, bits in _INT_STEPS
                if s["lo"] is not None and s["lo"] > -(1 << (bits - 1)) and s["hi"] < (1 << (bits - 1)) - 1]
        plan[c] = fits[0] if fits else "bigint"
    lossless = {"same": lambda x: F.bool_and(x.cast("float").cast("double").eqNullSafe(x.cast("double")))}
    for c, s in collect_stats(df, floats, lambda x: {k: f(x) for k, f in lossless.items()}).items():
        plan[c] = "float" if s["same"] else "double"
    return plan


def narrow_types(df: DataFrame, plan: Mapping[str, str] | None = None) -> DataFrame:
    plan = narrow_plan(df) if plan is None else plan
    return df.select(*[F.col(c).cast(plan[c]).alias(c) if c in plan else F.col(c) for c in df.columns])


# ---- names --------------------------------------------------------------------------------

_EAST_ASIAN = re.compile("[一-龥゠-ヿ぀-ゟ]")


def rename_plan(cols: Sequence[str], label: str | None = None) -> dict[str, str]:
    """Names with Chinese or Japanese characters become ``column_<position>``; the label ``label``."""
    plan = {c: f"column_{i}" for i, c in enumerate(cols) if _EAST_ASIAN.search(c)}
    if label is not None:
        plan[label] = "label"
    return plan


def rename_columns(df: DataFrame, plan: Mapping[str, str], inverse: bool = False) -> DataFrame:
    return df.withColumnsRenamed({v: k for k, v in plan.items()} if inverse else dict(plan))
