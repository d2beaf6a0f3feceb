"""Preparation for the input search: deskew, target-encode text, scale everything to [0, 1]."""
from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import encoding, features, roles, scaling


def fit_regression(df: DataFrame, label: str, cols: Sequence[str] | None = None) -> dict:
    """One JSON-able state: renames, shifts, level maps and ranges, in the original column order."""
    cols = list(cols or [c for c in df.columns if c != label])
    renames = roles.rename_plan([*cols], label)
    view = roles.rename_columns(df.select(*cols, label), renames)
    names = [renames.get(c, c) for c in cols]
    numeric = [c for c in names if c in roles.numeric_columns(view)]
    nominal = [c for c in names if c in roles.nominal_columns(view)]
    skew = features.fit_log_sqrt(view, numeric)
    flat = features.apply_log_sqrt(view, skew)
    coded = encoding.fit_target(flat, nominal, F.col("label")) if nominal else {"maps": {}, "default": {}}
    ranges = scaling.fit_min_max(encoding.apply_target(flat, coded) if nominal else flat, [*numeric, *nominal])
    return {"renames": renames, "columns": names, "numeric": numeric, "nominal": nominal, "skew": skew,
            "encoder": coded, "ranges": ranges, "label": label}


def apply_regression(df: DataFrame, state: Mapping) -> DataFrame:
    """Scaled features in the original order, then ``label`` when the table has one."""
    view = roles.rename_columns(df, state["renames"])
    tail = ["label"] if "label" in view.columns else []
    flat = features.apply_log_sqrt(view.select(*state["columns"], *tail), state["skew"])
    coded = encoding.apply_target(flat, state["encoder"]) if state["nominal"] else flat
    return scaling.apply_min_max(coded, state["ranges"]).select(*state["columns"], *tail)


def invert_regression(df: DataFrame, state: Mapping) -> DataFrame:
    """Scaled features back to original values, levels and names."""
    wide = scaling.invert_min_max(df, state["ranges"])
    if state["nominal"]:
        wide = nearest_level(wide, state["encoder"]["maps"])
    plain = features.invert_log_sqrt(wide, state["skew"])
    return roles.rename_columns(plain, {k: v for k, v in state["renames"].items() if v in plain.columns}, inverse=True)


def nearest_level(df: DataFrame, maps: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """The level whose code is nearest: a searched input rarely hits a code exactly."""
    return encoding.closest_level(df, maps)


def to_json(state: Mapping) -> str:
    return json.dumps(state, ensure_ascii=False, sort_keys=True)
