"""The composite preparation: fit on a train table, replay on any table.

``fit`` runs the bounded set of aggregate jobs and returns a ``Mold``; ``synthesise`` and
``transform`` replay it. The train output is produced by the same replay, so nothing learned at
fit can differ from what is applied later.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordered import RangeCut, range_cut
from ..operators import association, cleaning, drift, encoding, features, groups, imputation, modeling, roles, scaling, selection
from ..operators.reshape import duplicate_features
from ..operators.roles import BINARY, REGRESSION, CheckError
from .mold import Mold, setup

UNKNOWN = features.UNKNOWN


def _typed(df: DataFrame, types: Mapping[str, str], layouts: Mapping[str, str], label: str, problem: str,
           key: Sequence[str]) -> DataFrame:
    """Columns in their working types: doubles, category text, timestamps."""
    out: list[Column] = []
    for c in df.columns:
        kind = types.get(c)
        if c in key and c not in types:
            out.append(F.col(c))
        elif c == label:
            out.append((F.col(c).cast("double") if problem == REGRESSION else F.col(c).cast("string")).alias(c))
        elif c in layouts:
            ready = isinstance(df.schema[c].dataType, roles.TIMES)
            out.append((F.col(c).cast("timestamp") if ready else roles.parse_time(F.col(c), layouts[c])).alias(c))
        elif kind in ("int", "float", "numerical"):
            x = F.col(c).try_cast("double")
            out.append(F.when(F.abs(x) < float("inf"), x).alias(c))
        elif kind in ("object", "category", "bool"):
            out.append(F.col(c).cast("string").alias(c))
    return df.select(*out)


def _time_cuts(typed: DataFrame, layouts: Mapping[str, str], key: Sequence[str]) -> dict[str, RangeCut]:
    """The order of each time column, cut on the plain rows: cutting a scanned frame would scan it twice more, and each scan on top of it again."""
    return {c: range_cut(typed, [c, *key]) for c in layouts}


def _time_block(df: DataFrame, layouts: Mapping[str, str], key: Sequence[str], fills: Mapping[str, float], cuts: Mapping[str, RangeCut]) -> DataFrame:
    """Calendar parts, pairwise differences and, for a series (which has ``cuts``), the gap to the previous row."""
    for c, cut in cuts.items():
        df = features.time_delta(df, c, [c, *key], fill=fills.get(c), cut=cut)
    df = features.calendar_parts(df, layouts)
    return features.timestamp_differences(df, list(layouts)) if len(layouts) > 1 else df


def _time_names(layouts: Mapping[str, str], time_series: bool) -> tuple[list[str], list[str]]:
    names = list(layouts)
    numeric = [f"{c}_delta" for c in names] if time_series else []
    numeric += [f"{a}_sub_{b}" for i, a in enumerate(names) for b in names[i + 1:]]
    nominal = [n for i, (c, f) in enumerate(layouts.items()) for n in features.calendar_exprs(c, i, f)]
    return numeric, nominal


def _unary_exprs(kinds: Sequence[str], numeric: Sequence[str], roots: Sequence[str]) -> dict[str, Column]:
    made: dict[str, Column] = {}
    if "polynomial" in kinds:
        made |= features.polynomial_exprs(numeric, roots)
    if "trigonometry" in kinds:
        made |= features.trigonometry_exprs(numeric)
    if "interaction" in kinds:
        made |= features.interaction_exprs(numeric)
    return made


def _pick(df: DataFrame, candidates: Sequence[str], natives: Sequence[str], label: str, problem: str, params: Mapping) -> list[str]:
    """Union of the importance and the target-correlation choice among the candidates."""
    if not candidates:
        return []
    weights = selection.importances(df, [*natives, *candidates], label, problem, params["trees"], params["boosts"], seed=params["seed"],
                                    class_boosts=params.get("class_boosts", 5))
    chosen = set(selection.importance_select(weights, params["seed"]))
    if problem == REGRESSION:
        coded = df.withColumn("__code", F.col(label).cast("double"))
    else:
        codes = {lv: float(i) for i, lv in enumerate(encoding.levels_of(df, [label], 1000)[label])}
        coded = encoding.map_values(df, {label: codes}, out={label: "__code"})
    chosen |= {c for c, _ in selection.target_corr_select(coded, candidates, natives, "__code")}
    return [c for c in candidates if c in chosen]


def fit(train: DataFrame, label: str, test: DataFrame | None = None, types: Mapping[str, str] | None = None,
        key: Sequence[str] = (), functions: groups.Functions | None = None, **params) -> Mold:
    """Learn the whole preparation from a train table (and an optional test table for drift).

    ``key`` names columns that identify a row: they order equal timestamps and stay out of the
    features unless ``types`` lists them. ``functions`` names aggregates of one's own for the
    setting ``groupby``; the mold keeps their values, so replaying does not need them.
    """
    return _fit(train, label, test, types, key, functions, **params)[0]


def _fit(train: DataFrame, label: str, test: DataFrame | None, types: Mapping[str, str] | None, key: Sequence[str],
         functions: groups.Functions | None, **params) -> tuple[Mold, bool]:
    """The mold, and whether the synthesised rows may hold copies.

    The table is kept only until its typed rows are made, so whatever it comes from is worked out once.
    """
    params = setup(**params)
    if label not in train.columns:
        raise CheckError(3106, label)
    level = train.storageLevel
    ours = not (level.useMemory or level.useDisk)
    if ours:
        train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        typed, problem, types, layouts = _typed_train(train, label, types, key)
    finally:
        if ours:
            train.unpersist()
    made = None
    try:
        synthesis, cuts = _fit_synthesis(typed, label, problem, types, layouts, key, params, functions)
        synthesis["unique_label"] = None if problem == REGRESSION else encoding.levels_of(typed, [label], 1000)[label]
        mold = Mold(params=params, synthesis=synthesis)
        copies = _may_repeat(typed, [c for c in key if c not in types])
        made = _replayed(mold, typed, cuts)
        made = (made.dropDuplicates() if copies else made).persist(StorageLevel.MEMORY_AND_DISK)
        made.count()
        typed.unpersist()
        rest = made
        if params["drop_duplicate"]:
            cols = [c for c in made.columns if c not in key]
            extra = [r["feature"] for r in duplicate_features(made.select(*key, *cols), list(key) or cols[:1]).collect()
                     if r["feature"] not in (*params["conserve_columns"], label)]
            synthesis["duplicates"] = extra
            mold = mold.with_part(synthesis=synthesis)
            rest = rest.drop(*extra)
        if test is not None and params["statistic"] and label in test.columns:
            mold = mold.with_part(statistic=_fit_statistic(rest, synthesise(mold, test), label, problem, key, params))
            rest = rest.drop(*mold.statistic["to_remove"])
        return mold.with_part(transform=_fit_transform(rest, label, problem, key, params)), copies
    finally:
        typed.unpersist()
        if made is not None:
            made.unpersist()


def _may_repeat(rows: DataFrame, key: Sequence[str]) -> bool:
    """Whether two rows share their key. Where none do, rows that hold the key differ, and need not be compared in full."""
    return not key or not rows.groupBy(*[F.col(f"`{c}`") for c in key]).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").isEmpty()


def _typed_train(train: DataFrame, label: str, types: Mapping[str, str] | None, key: Sequence[str]) -> tuple[DataFrame, str, dict, dict]:
    """Kept rows in their working types, the problem, the type of each column and the layouts of the times."""
    problem = roles.problem_type(train, label)
    body = [c for c in train.columns if c != label and c not in key]
    if types is None:
        layouts = roles.infer_time_formats(train, body)
        types = roles.infer_types(train, body)
    else:
        types = {c: t for c, t in types.items() if c != label}
        layouts = roles.infer_time_formats(train, [c for c, t in types.items() if t == "datetime"])
    layouts = {**layouts, **{c: "yyyy-MM-dd HH:mm:ss" for c in body if isinstance(train.schema[c].dataType, roles.TIMES)}}
    types = {c: ("datetime" if c in layouts else t) for c, t in types.items()}
    layouts = {c: layouts[c] for c in body if c in layouts}

    typed = _typed(train, types, layouts, label, problem, key).persist(StorageLevel.MEMORY_AND_DISK)
    typed.count()
    return typed, problem, types, layouts


def _fit_synthesis(typed: DataFrame, label: str, problem: str, types: Mapping[str, str], layouts: Mapping[str, str],
                   key: Sequence[str], params: Mapping, functions: groups.Functions | None = None) -> tuple[dict, dict[str, RangeCut]]:
    conserve = list(params["conserve_columns"])
    drop_key = [c for c in key if c not in types]
    series = bool(params["time_series"] and layouts)
    fills: dict[str, float] = {}
    time_keep: list[str] = []
    timed = typed
    cuts = _time_cuts(typed, layouts, key) if series else {}
    if layouts:
        if series:
            for c in layouts:
                mode = features.modal_gap(typed, c)
                fills[c] = float(mode) if mode is not None else 0.0
        timed = _time_block(typed, layouts, key, fills, cuts).persist(StorageLevel.MEMORY_AND_DISK)
        numeric, nominal = _time_names(layouts, series)
        lost = {d for d, *_ in association.correlated_columns(timed, nominal, numeric, cell_limit=params.get("cell_limit"))}
        if series:
            lost.discard(f"{next(iter(layouts))}_delta")        # the ruler of the step differences
        time_keep = [c for c in [*numeric, *nominal] if c not in lost]

    body = typed.drop(label, *layouts, *drop_key)
    gone = set(cleaning.clean_plan(body, [*conserve, *params["exclude_columns"]])) - set(conserve)
    left = [c for c in body.columns if c not in gone and c not in conserve]
    numeric = [c for c in left if isinstance(typed.schema[c].dataType, T.DoubleType)]
    nominal = [c for c in left if c not in numeric]
    kept_conserve = [c for c in conserve if c in typed.columns]
    num_conserve = [c for c in kept_conserve if isinstance(typed.schema[c].dataType, T.DoubleType)]

    fill = imputation.fit_constants(typed, [], [c for c in [*nominal, *kept_conserve] if c not in num_conserve])
    if params["impute"] == "chained" or params["impute"] == "mean":
        chained = imputation.fit_chained(typed, numeric) if numeric else None
    else:
        chained = None
        fill |= imputation.fit_constants(typed, numeric, [], params["impute"])
    if chained is not None and not chained["equations"]:
        fill |= {c: chained["means"][c] for c in numeric}       # no hole in train, one may come later
        chained = None
    # a conserved column with a hole takes its own mean
    fill |= imputation.fit_constants(typed, num_conserve, [])
    filled = imputation.apply_constants(imputation.apply_chained(typed, chained) if chained else typed, fill)

    if params["filter_correlation"]:
        lost = {d for d, *_ in association.correlated_columns(filled, nominal, numeric, cell_limit=params.get("cell_limit"))}
        numeric, nominal = [c for c in numeric if c not in lost], [c for c in nominal if c not in lost]
    numeric += num_conserve
    nominal += [c for c in kept_conserve if c not in num_conserve]

    state = {
        "label": label, "problem_type": problem, "types": dict(types), "layouts": dict(layouts), "key": list(key),
        "time_fill": fills, "time_features": time_keep, "fill": fill, "chained": chained, "numeric": numeric, "nominal": nominal,
        "bins": features.fit_kmeans_bins(filled, numeric, params["bucket_size"]) if params["bucket_size"] else {},
        "deskew": features.fit_yeo_johnson(filled, numeric, params["deskew_threshold"]) if params["deskew_threshold"] else {},
        "rare": features.fit_rare(filled, nominal, share=params["combine_rare_category"]) if params["combine_rare_category"] else {},
        "step": None, "unary": [], "roots": [], "groups": {}, "duplicates": [],
    }
    if series and numeric:
        ruler = next(iter(layouts))
        timed_filled = imputation.apply_constants(imputation.apply_chained(timed, chained) if chained else timed, fill)
        state["step"] = features.fit_step_difference(timed_filled, numeric, f"{ruler}_delta", [ruler, *key], cut=cuts[ruler])

    crosses, limit = features.cross_count(len(numeric), len(nominal)), params.get("candidate_limit", features.CANDIDATE_LIMIT)
    # the mold tells whether crosses were left out and how many there would be
    state["crosses"] = {"candidates": crosses, "limit": limit, "made": limit is None or crosses <= limit}
    if numeric and state["crosses"]["made"]:
        rare = features.apply_rare(filled, state["rare"])
        if params["unary"]:
            roots = features.nonnegative(filled, numeric)
            exprs = _unary_exprs(params["unary"], numeric, roots)
            # names with brackets are awkward in ml and arrow: work on positions
            alias = {f"__u{i}": n for i, n in enumerate(exprs)}
            wide = filled.select(label, *numeric, *[F.coalesce(exprs[n], F.lit(0.0)).alias(a) for a, n in alias.items()])
            kept = association.candidate_filter(wide, list(alias), numeric)
            state["roots"] = roots
            state["unary"] = [alias[a] for a in _pick(wide, kept, numeric, label, problem, params)]
        if params["groupby"] and nominal:
            wide = features.group_aggregates(rare, nominal, numeric, params["groupby"], functions=functions)
            names = [features.group_name(c, x, a) for c in nominal for a in params["groupby"] for x in numeric]
            stats = wide.agg(*[F.count(F.when(F.col(f"`{n}`").isNull(), 1)).alias(f"m{i}") for i, n in enumerate(names)],
                             *[F.min(f"`{n}`").eqNullSafe(F.max(f"`{n}`")).alias(f"c{i}") for i, n in enumerate(names)]).first()
            names = [n for i, n in enumerate(names) if not stats[f"m{i}"] and not stats[f"c{i}"]]
            found = association.candidate_filter(wide, names, [], method="pearson")
            picked = _pick(wide.select(label, *numeric, *found), found, numeric, label, problem, params)
            state["groups"] = groups.fit_groups(rare, nominal, numeric, params["groupby"], functions, picked)
    if timed is not typed:
        timed.unpersist()
    return state, cuts


def synthesise(mold: Mold, df: DataFrame) -> DataFrame:
    """Replay the learned synthesis; the label is kept when the table has it."""
    s, params = mold.synthesis, mold.params
    label, problem, layouts, key = s["label"], s["problem_type"], s["layouts"], s["key"]
    missing = [c for c in [*s["numeric"], *s["nominal"], *layouts] if c not in df.columns]
    if missing:
        raise CheckError(3204, missing)
    typed = _typed(df, s["types"], layouts, label, problem, key)
    return _replayed(mold, typed, _time_cuts(typed, layouts, key) if params["time_series"] and layouts else {})


def _replayed(mold: Mold, typed: DataFrame, cuts: Mapping[str, RangeCut]) -> DataFrame:
    """``synthesise`` of rows in their working types; a series has ``cuts``."""
    s, params = mold.synthesis, mold.params
    label, layouts, key, numeric, nominal = s["label"], s["layouts"], s["key"], s["numeric"], s["nominal"]
    out = _time_block(typed, layouts, key, s["time_fill"], cuts) if layouts else typed
    if s["chained"]:
        out = imputation.apply_chained(out, s["chained"])
    out = imputation.apply_constants(out, s["fill"])
    out = features.apply_rare(out, s["rare"])
    step_names: list[str] = []
    if s["step"]:
        out = features.apply_step_difference(out, s["step"], cut=cuts[next(iter(layouts))])
        step_names = [f"{c}_delta" for c in s["step"]["divide"]]
    out = groups.apply_groups(out, s["groups"]) if s["groups"] else out
    unary = _unary_exprs(params["unary"] or [], numeric, s["roots"])
    deskewed = {c: features.yeo_johnson(F.col(c), v["lambda"]) / v["factor"] for c, v in s["deskew"].items()}
    final = [deskewed[c].alias(c) if c in deskewed else F.col(c) for c in numeric] + [F.col(c) for c in nominal]
    final += [F.col(c) for c in s["time_features"]]
    final += [F.coalesce(unary[n], F.lit(0.0)).alias(n) for n in s["unary"]]
    final += [F.col(f"`{n}`") for g in s["groups"].values() for n in g["default"]]
    final += [features.bin_expr(F.col(c), e).cast("string").alias(f"{c}_binned") for c, e in s["bins"].items()]
    final += [F.col(c) for c in step_names if c not in s["time_features"]]
    keys = [F.col(c) for c in key if c not in s["types"]]
    final += [F.col(label)] if label in typed.columns else []
    return out.select(*keys, *final).drop(*s["duplicates"])


def _feature_kinds(df: DataFrame, label: str, key: Sequence[str]) -> tuple[list[str], list[str]]:
    body = [f for f in df.schema if f.name != label and f.name not in key]
    nominal = [f.name for f in body if isinstance(f.dataType, T.StringType)]
    return [f.name for f in body if f.name not in nominal], nominal


def _plain_names(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    return {c: f"f{i}" for i, c in enumerate(cols)}


def _fit_statistic(made: DataFrame, other: DataFrame, label: str, problem: str, key: Sequence[str], params: Mapping) -> dict:
    numeric, nominal = _feature_kinds(made, label, key)
    # bracketed feature names are replaced by positions while measuring
    short = _plain_names(made, [*numeric, *nominal])
    back = {v: k for k, v in short.items()}

    def plain(df: DataFrame) -> DataFrame:
        return df.select(*key, *[F.col(f"`{c}`").alias(n) for c, n in short.items()], F.col(label).alias("__label"))
    a, b = plain(made).persist(StorageLevel.MEMORY_AND_DISK), plain(other).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        conserve = [short[c] for c in params["conserve_columns"] if c in short]
        remove = drift.drift_filter(a, b, "__label", problem, [short[c] for c in numeric], [short[c] for c in nominal],
                                    allow_correlation=params["allow_correlation"], allow_divergence=params["allow_divergence"],
                                    allow_mismatch=params["allow_mismatch"], conserve=conserve)
        if params["adversarial_valid"] and key:
            rest = [n for n in back if n not in remove]
            log = modeling.adversarial_validation(a, b, rest, key, seed=params["seed"])
            remove += [r["feature"] for r in log if r["removed"] and r["feature"] not in conserve]
    finally:
        a.unpersist()
        b.unpersist()
    return {"to_remove": [back[n] for n in remove]}


def _fit_transform(made: DataFrame, label: str, problem: str, key: Sequence[str], params: Mapping) -> dict:
    numeric, nominal = _feature_kinds(made, label, key)
    state: dict = {"encoder": params["category_encoder"], "encoder_map": None, "scaler": params["normalization"],
                   "normalize": {}, "pca": None, "numeric": numeric, "nominal": nominal}
    kind = params["category_encoder"]
    if nominal and kind == "OneHotEncoder":
        state["encoder_map"] = encoding.fit_one_hot(made, nominal)
    elif nominal and kind == "LabelEncoder":
        state["encoder_map"] = encoding.fit_label_codes(made, nominal)
    elif nominal and kind == "TargetEncoder":
        if problem == REGRESSION:
            state["encoder_map"] = encoding.fit_shrinkage(made, nominal, F.col(label))
        elif problem == BINARY:
            state["encoder_map"] = encoding.fit_shrinkage(made, nominal, encoding.binary_target(made, label), binomial=True)
        else:
            state["encoder_map"] = encoding.fit_target_multiclass(made, nominal, label)
    elif kind not in (None, False, "OneHotEncoder", "LabelEncoder", "TargetEncoder"):
        raise ValueError(f"unknown category encoder {kind}")
    coded = _encode(made, state, problem)
    cols = [c for c in coded.columns if c != label and c not in key and not isinstance(coded.schema[c].dataType, T.StringType)]
    short = _plain_names(coded, cols)
    back = {v: k for k, v in short.items()}
    flat = coded.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in short.items()])
    if params["normalization"] == "StandardScaler":
        got = scaling.fit_standard(flat, flat.columns)
    elif params["normalization"] == "MinMaxScaler":
        got = scaling.fit_min_max(flat, flat.columns)
    elif params["normalization"] in (None, False):
        got = {}
    else:
        raise ValueError(f"unknown normalization {params['normalization']}")
    state["normalize"] = {back[n]: v for n, v in got.items()}
    state["columns"] = cols
    if params["pca"]:
        state["pca"] = scaling.fit_pca(_scale(flat, got, params["normalization"]), flat.columns, params["pca"])
    return state


def _encode(df: DataFrame, state: Mapping, problem: str) -> DataFrame:
    maps = state["encoder_map"]
    if not maps:
        return df
    if state["encoder"] == "OneHotEncoder":
        return encoding.apply_one_hot(df, maps)
    if state["encoder"] == "LabelEncoder":
        return encoding.apply_label_codes(df, maps)
    if problem in (REGRESSION, BINARY):
        return encoding.apply_target(df, maps)
    return encoding.apply_target_multiclass(df, maps)


def _scale(df: DataFrame, state: Mapping, kind: str | None) -> DataFrame:
    return scaling.apply_standard(df, state) if kind == "StandardScaler" else scaling.apply_min_max(df, state) if state else df


def transform(mold: Mold, df: DataFrame) -> DataFrame:
    """Encode, scale and reduce an already synthesised table."""
    s, t = mold.synthesis, mold.transform
    label, key = s["label"], [c for c in s["key"] if c not in s["types"]]
    # work under positions, as at fit, then restore the names
    coded = _encode(df.drop(*mold.statistic.get("to_remove", [])), t, s["problem_type"])
    cols = t["columns"]
    short = _plain_names(coded, cols)
    rest = [c for c in coded.columns if c in key or c == label]
    flat = coded.select(*rest, *[F.col(f"`{c}`").cast("double").alias(n) for c, n in short.items()])
    flat = _scale(flat, {short[c]: v for c, v in t["normalize"].items()}, t["scaler"])
    if t["pca"]:
        return scaling.apply_pca(flat, t["pca"])
    keys = [F.col(c) for c in key if c in flat.columns]
    tail = [F.col(label)] if label in flat.columns else []
    return flat.select(*keys, *[F.col(n).alias(c) for c, n in short.items()], *tail)


def cast(train: DataFrame, label: str, test: DataFrame | None = None, types: Mapping[str, str] | None = None,
         key: Sequence[str] = (), functions: groups.Functions | None = None, **params) -> tuple[Mold, DataFrame]:
    """Fit, then the train output by replay (equal synthesised rows are kept once)."""
    mold, copies = _fit(train, label, test, types, key, functions, **params)
    made = synthesise(mold, train)
    return mold, transform(mold, made.dropDuplicates() if copies else made)


def shape(mold: Mold, df: DataFrame) -> DataFrame:
    """Replay on another table; a label level unseen at fit raises 3104."""
    s = mold.synthesis
    if s["label"] in df.columns and s["unique_label"] is not None:
        label = F.col(s["label"]).cast("string")
        bad = [r[0] for r in df.select(label).filter(label.isNotNull() & ~label.isin(s["unique_label"])).distinct().limit(20).collect()]
        if bad:
            raise CheckError(3104, sorted(bad))
    return transform(mold, synthesise(mold, df))
