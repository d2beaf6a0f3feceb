"""Models on tables: assembling, search, leaderboard, metrics, scoring and saved runs."""
from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggregates import COLUMNS_PER_JOB, collect_stats
from ..functions.ordered import ROWS_PER_RANGE, RangeCut, ordered_scan, split_points
from ..functions.quantiles import exact_quantiles
from ..session import ROWS_PER_TASK, batches_by_count, shared_folder, spread
from . import cells
from .boosting import BoostedClasses, fit_boosted
from .encoding import TREE_LEVELS, levels_of
from .roles import BINARY, REGRESSION, nominal_columns, numeric_columns, problem_type


# ---- metrics ------------------------------------------------------------------------------

def regression_metrics(df: DataFrame, label: str, prediction: str, digits: int = 3) -> DataFrame:
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    ok = (y > -1) & (p > -1)
    log_gap = F.when(ok, F.pow(F.log1p(p) - F.log1p(y), 2))
    mse = F.avg(F.pow(y - p, 2))
    # rmsle is undefined when any value is at or below -1
    return df.filter(y.isNotNull() & p.isNotNull()).agg(
        F.round(1 - mse / F.nullif(F.var_pop(y), F.lit(0.0)), digits).alias("r2"), F.round(mse, digits).alias("mse"),
        F.round(F.sqrt(mse), digits).alias("rmse"), F.round(F.avg(F.abs(y - p)), digits).alias("mae"),
        F.round(F.when(F.bool_and(ok), F.sqrt(F.avg(log_gap))), digits).alias("rmsle"))


def confusion_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).cast("string").alias("actual"), F.col(prediction).cast("string").alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, label: str, prediction: str, classes: Sequence[str]) -> DataFrame:
    """One row per actual class, counts per predicted class, row error, and a Total row."""
    counts = confusion_counts(df, label, prediction)
    per = [F.coalesce(F.sum(F.when(F.col("predicted") == c, F.col("n"))), F.lit(0)).alias(c) for c in classes]
    error = (1 - F.coalesce(F.sum(F.when(F.col("predicted") == F.col("actual"), F.col("n"))), F.lit(0)) / F.sum("n"))
    cells = counts.groupBy("actual").agg(*per, error.alias("e"))
    total = counts.agg(F.lit("Total").alias("actual"), *per, error.alias("e"))
    text = F.concat(F.format_number(F.col("e") * 100, 1), F.lit(" %"))
    return cells.unionByName(total).select("actual", *classes, text.alias("error"))


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    hit = (F.col(label).cast("string") == F.col(prediction).cast("string")).cast("double")
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), (1 - F.avg(hit)).alias("error"))


def best_threshold(df: DataFrame, label: str, score: str, positive: object = 1, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Threshold (predict positive at or above it) with the best accuracy; equal: the highest.

    Rows reduce to counts per distinct score; the counts below each score are running sums.
    """
    is_pos = (F.col(label) == F.lit(positive)).cast("long")
    counts = (df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("threshold"))
              .agg(F.sum(is_pos).alias("pos"), F.sum(1 - is_pos).alias("neg")).persist(StorageLevel.MEMORY_AND_DISK))
    try:
        total = counts.agg(F.sum("pos"), F.sum("neg")).first()
        scan = ordered_scan(counts, ["threshold"], running={"__p": "pos", "__q": "neg"}, rows_per_range=rows_per_range)
        right = F.lit(total[0]) - (F.col("__p") - F.col("pos")) + (F.col("__q") - F.col("neg"))
        rated = scan.select("threshold", (right / F.lit((total[0] or 0) + (total[1] or 0))).alias("accuracy"))
        best = rated.agg(F.max(F.struct("accuracy", "threshold")).alias("b")).first()["b"]
    finally:
        counts.unpersist()
    rows = [(float(best["threshold"]), float(best["accuracy"]))] if best else []
    return df.sparkSession.createDataFrame(rows, "threshold double, accuracy double")


ROWS_PER_BLOCK = 1 << 20       # rows a task sorts at a time
SCORES_PER_PIECE = 1 << 8      # a piece is one record of 4 KB, and ten thousand records may be one batch


def area_under_roc(df: DataFrame, label: str, score: str, rows_per_range: int = ROWS_PER_RANGE) -> float:
    """Exact area: the share of (positive, negative) pairs the score puts in order, ties as one half.

    Few distinct scores (those of trees) are counted and scanned as one range. Otherwise tasks sort their rows block by block
    into counts per distinct score and cut these at the bounds of score ranges, so only packed counts are shuffled, once: a
    range adds up the pairs of its own scores, and the totals of the ranges tell the others. All sums are whole numbers, so
    reruns agree. Without positives it is 0, without negatives 1, without rows one half.
    """
    rows = df.select(F.col(score).cast("double").alias("s"), F.coalesce(F.col(label) > 0.5, F.lit(False)).alias("p")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total, pos, scores = rows.agg(F.count(F.lit(1)), F.count_if("p"), F.approx_count_distinct("s")).first()
        neg = total - pos
        if not pos or not neg:
            return 0.5 if not pos and not neg else 0.0 if not pos else 1.0
        twice = _pairs_of_few(rows) if scores <= rows_per_range else _pairs_by_range(rows, split_points(rows, ["s"], rows_per_range, total))
        return float(twice) / 2 / pos / neg
    finally:
        rows.unpersist()


def _pairs_of_few(rows: DataFrame) -> int:
    """Twice the pairs in order, ties as one half, of the scores ``s`` with sides ``p``; one range holds the counts of all scores."""
    counts = rows.groupBy("s").agg(F.count_if("p").alias("pos"), F.count_if(~F.col("p")).alias("neg"))
    scan = ordered_scan(counts, ["s"], running={"__q": "neg"}, cut=RangeCut(("s",)))
    twice = F.col("pos").cast("decimal(19,0)") * (F.col("__q") * 2 - F.col("neg")).cast("decimal(19,0)")
    return int(scan.filter(F.col("pos") > 0).agg(F.sum(twice.cast("decimal(38,0)"))).first()[0])


def _pairs_by_range(rows: DataFrame, bounds: Sequence[tuple]) -> int:
    """The same from packed counts of each range between ``bounds``; the driver gets the totals of the ranges."""
    pieces, pairs = _pair_tasks(np.array([b for b, in bounds if b is not None]))
    cut = rows.mapInArrow(pieces, "rg int, positive boolean, scores binary, counts binary").repartition("rg").sortWithinPartitions("rg")
    with batches_by_count(rows.sparkSession):
        found = cut.mapInArrow(pairs, "rg int, pos long, neg long, twice string").collect()
    twice = below = 0
    for r in sorted(found):
        twice += int(r["twice"]) + 2 * r["pos"] * below
        below += r["neg"]
    return twice


def _pair_tasks(bounds: np.ndarray) -> tuple[Callable, Callable]:
    """The two passes of the area: packed counts per distinct score of each side from rows, and the pairs of each range from those."""
    def cut(scores: np.ndarray, positive: bool) -> Iterator[tuple]:
        scores = np.sort(scores)        # NaN last; they are equal to each other
        firsts = np.flatnonzero(np.r_[True, (scores[1:] != scores[:-1]) & ~np.isnan(scores[:-1])])
        counts, scores = np.diff(np.r_[firsts, len(scores)]), scores[firsts]
        ends = np.r_[0, np.searchsorted(scores, bounds), len(scores)]
        for rg in np.flatnonzero(np.diff(ends)):
            for at in range(ends[rg], ends[rg + 1], SCORES_PER_PIECE):
                piece = slice(at, min(at + SCORES_PER_PIECE, ends[rg + 1]))
                yield rg, positive, scores[piece].tobytes(), counts[piece].tobytes()

    def packed(block: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(block)
        positive = table.column(1).to_numpy()
        known = table.column(0).is_valid().to_numpy()
        scores = table.column(0).fill_null(0.0).to_numpy()
        out = []
        for side in (True, False):
            mine = scores[known & (positive == side)]
            if len(mine):
                out += cut(mine, side)
            missing = int((~known & (positive == side)).sum())
            if missing:         # rows without a score are a range below all others
                out.append((-1, side, np.zeros(1).tobytes(), np.array([missing]).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*out), (pa.int32(), pa.bool_(), pa.binary(), pa.binary()))],
                                          ["rg", "positive", "scores", "counts"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = [], 0
        for batch in batches:
            block.append(batch)
            held += batch.num_rows
            if held >= ROWS_PER_BLOCK:
                yield packed(block)
                block, held = [], 0
        if held:
            yield packed(block)

    def merged(held: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Ascending scores of one side, and their counts."""
        scores, counts = (np.frombuffer(b"".join(part), kind) for part, kind in zip(zip(*held) if held else ((), ()), ("<f8", "<i8")))
        at = np.argsort(scores)
        return scores[at], counts[at]

    def added(rg: int, held: dict[bool, list]) -> pa.RecordBatch:
        (high, pos), (low, neg) = merged(held[True]), merged(held[False])
        p, n = int(pos.sum()), int(neg.sum())
        below = np.r_[0, np.cumsum(neg)]
        if p * n >= 1 << 62:            # twice the pairs may not fit 64 bits
            pos = pos.astype(object)
        twice = int((pos * (below[np.searchsorted(low, high, "left")] + below[np.searchsorted(low, high, "right")])).sum())
        return pa.RecordBatch.from_pylist([{"rg": rg, "pos": p, "neg": n, "twice": str(twice)}],
                                          pa.schema([("rg", pa.int32()), ("pos", pa.int64()), ("neg", pa.int64()), ("twice", pa.string())]))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {True: [], False: []}
        for batch in batches:
            for rg, side, scores, counts in zip(*(column.to_pylist() for column in batch.columns)):
                if now is not None and rg != now:
                    yield added(now, held)
                    held = {True: [], False: []}
                now = rg
                held[side].append((scores, counts))
        if now is not None:
            yield added(now, held)

    return pieces, pairs


# ---- assembling ---------------------------------------------------------------------------

def features_with_values(df: DataFrame, features: Sequence[str]) -> list[str]:
    """``features`` without the numeric ones that have no value at all: nothing could stand in for what they miss."""
    numeric = [c for c in features if c in numeric_columns(df)]
    found = collect_stats(df, numeric, lambda x: {"n": F.count(F.when(x.isNotNull() & ~F.isnan(x.cast("double")), 1))})
    return [c for c in features if c not in found or found[c]["n"]]


def feature_stages(df: DataFrame, features: Sequence[str]) -> list:
    """Index nominal features (alphabetical, new levels kept apart) and assemble everything; numeric columns without a value are left out."""
    return _stages(df, features_with_values(df, features))


def _stages(df: DataFrame, features: Sequence[str]) -> list:
    if not features:
        raise ValueError("no feature has a value")
    nominal = [c for c in features if c in nominal_columns(df)]
    numeric = [c for c in features if c in numeric_columns(df)]
    stages = []
    if numeric:
        # missing numbers take the training mean, as trees and linear models refuse NaN
        stages.append(Imputer(inputCols=numeric, outputCols=[f"__n_{c}" for c in numeric], strategy="mean"))
    if nominal:
        stages.append(StringIndexer(inputCols=nominal, outputCols=[f"__i_{c}" for c in nominal],
                                    stringOrderType="alphabetAsc", handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=[*[f"__n_{c}" for c in numeric], *[f"__i_{c}" for c in nominal]], outputCol="features", handleInvalid="keep"))
    return stages


def feature_order(df: DataFrame, features: Sequence[str]) -> list[str]:
    return [c for c in features if c in numeric_columns(df)] + [c for c in features if c in nominal_columns(df)]


def max_bins(df: DataFrame, features: Sequence[str]) -> int:
    """Tree bins that hold every level; a column too wide to index on the driver is refused."""
    nominal = [c for c in features if c in nominal_columns(df)]
    if not nominal:
        return 32
    wide = df.agg(*[F.approx_count_distinct(c).alias(c) for c in nominal]).first().asDict()
    over = [c for c, n in wide.items() if n > TREE_LEVELS]
    if over:
        raise ValueError(f"columns {over} have more than {TREE_LEVELS} levels; target-encode them or combine rare levels first")
    return max(32, int(max(wide.values()) * 1.1) + 3)


def holdout(df: DataFrame, key: Sequence[str], share: float, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Reproducible split by a hash of the row key; it does not depend on partitioning."""
    test = _held_out(key, share, seed)
    return df.filter(~test), df.filter(test)


def _held_out(key: Sequence[str], share: float, seed: int) -> Column:
    return F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)


# ---- search -------------------------------------------------------------------------------

@dataclass
class Trial:
    """One grid point of a search: its mean metric over the folds."""
    model: str
    params: dict
    value: float
    folds: list[float]
    seconds: float


@dataclass
class Run:
    """Outcome of a model search: the best fitted pipeline of each family in leaderboard order, and every trial."""
    target: str
    problem: str
    features: list[str]
    classes: list[str]
    models: list[tuple[str, float, PipelineModel]] = field(default_factory=list)
    seconds: float = 0.0
    trials: list[Trial] = field(default_factory=list)
    left_out: list[str] = field(default_factory=list)

    @property
    def leader(self) -> PipelineModel:
        return self.models[0][2]

    def metric(self) -> str:
        return "r2" if self.problem == REGRESSION else "auc" if self.problem == BINARY else "accuracy"


def _candidates(problem: str, bins: int, seed: int) -> list[tuple[str, object, list]]:
    if problem == REGRESSION:
        lin, tree = LinearRegression(), DecisionTreeRegressor(seed=seed, maxBins=bins)
        forest, boost = RandomForestRegressor(seed=seed, maxBins=bins), GBTRegressor(seed=seed, maxBins=bins, maxIter=10)
        out = [("linear", lin, ParamGridBuilder().addGrid(lin.regParam, [0.0, 0.1]).build())]
    else:
        lin, tree = LogisticRegression(maxIter=20), DecisionTreeClassifier(seed=seed, maxBins=bins)
        forest, boost = RandomForestClassifier(seed=seed, maxBins=bins), GBTClassifier(seed=seed, maxBins=bins, maxIter=10)
        out = [("logistic", lin, ParamGridBuilder().addGrid(lin.regParam, [0.0, 0.1]).build())]
    out.append(("tree", tree, ParamGridBuilder().addGrid(tree.maxDepth, [4]).build()))
    out.append(("forest", forest, ParamGridBuilder().addGrid(forest.numTrees, [20]).addGrid(forest.maxDepth, [5]).build()))
    if problem in (BINARY, REGRESSION):
        out.append(("boosted", boost, ParamGridBuilder().addGrid(boost.maxDepth, [3]).build()))
    else:
        # trees of all classes grow together (see ``boosting``)
        out.append(("boosted", None, [{"depth": 3}]))
    return out


def _raw_auc(scored: DataFrame, label: str) -> float:
    """Area under the curve of a two-class model's raw prediction."""
    return area_under_roc(scored.select(F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("__raw"), label), label, "__raw")


def _metric(problem: str, label: str) -> Callable[[DataFrame], float]:
    if problem == BINARY:
        return lambda scored: _raw_auc(scored, label)
    found = (RegressionEvaluator(labelCol=label, metricName="r2") if problem == REGRESSION
             else MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy"))
    return lambda scored: float(found.evaluate(scored))


def _fold_values(rows: DataFrame, numeric: Sequence[str]) -> dict[int, tuple[int, dict[str, int]]]:
    """Rows of each fold that has any, and how many of them have a value in each numeric column."""
    found: dict[int, tuple[int, dict[str, int]]] = {}
    for at in range(0, max(len(numeric), 1), COLUMNS_PER_JOB):
        block = list(numeric[at:at + COLUMNS_PER_JOB])
        some = [F.count(F.when(F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double")), 1)).alias(f"__{i}") for i, c in enumerate(block)]
        for r in rows.groupBy("__fold").agg(F.count(F.lit(1)).alias("__n"), *some).collect():
            found.setdefault(r["__fold"], (r["__n"], {}))[1].update(zip(block, r[2:]))
    return found


def _folds_with_own_levels(rows: DataFrame, nominal: Sequence[str]) -> set[int]:
    """Folds that hold a level no other fold holds: their training rows do not know it."""
    if not nominal:
        return set()
    cells = [F.struct(F.lit(i).alias("__at"), F.col(f"`{c}`").cast("string").alias("__level")) for i, c in enumerate(nominal)]
    ends = (rows.select("__fold", F.inline(F.array(*cells))).filter(F.col("__level").isNotNull()).groupBy("__at", "__level")
            .agg(F.min("__fold").alias("__lo"), F.max("__fold").alias("__hi")))
    return {r[0] for r in ends.filter(F.col("__lo") == F.col("__hi")).select("__lo").distinct().collect()}


def _fold_sets(rows: DataFrame, features: Sequence[str], folds: int) -> tuple[list[tuple[PipelineModel, DataFrame, DataFrame]], list[DataFrame]]:
    """Preparation, training rows and check rows of each fold, and last of the whole table (nothing to check); and the frames kept for them.

    The preparation is fitted on the training rows alone. A fold without rows on one side is left out. Where no number is
    missing and the training rows know every level, their preparation makes the same vectors as that of the whole table:
    such folds read the whole table's rows, so the vectors are made and kept once instead of once a fold.
    """
    numeric = [c for c in features if c in numeric_columns(rows)]
    values = _fold_values(rows, numeric)
    total = sum(n for n, _ in values.values())
    filled = all(have[c] == n for n, have in values.values() for c in numeric)
    apart = _folds_with_own_levels(rows, [c for c in features if c in nominal_columns(rows)])
    kept: list[DataFrame] = []

    def prepared(train: DataFrame, folds_in: Sequence[int]) -> tuple[PipelineModel, DataFrame]:
        live = [c for c in features if c not in numeric or any(values[f][1][c] for f in folds_in)]
        prep = Pipeline(stages=_stages(train, live)).fit(train)
        kept.append(spread(prep.transform(rows).select("features", "__y", "__fold")).persist(StorageLevel.MEMORY_AND_DISK))
        return prep, kept[-1]

    whole = prepared(rows, list(values)) if total else None
    sets = []
    for fold in range(folds):
        if fold not in values or values[fold][0] == total:
            continue
        others = [f for f in values if f != fold]
        prep, ready = whole if filled and fold not in apart else prepared(rows.filter(F.col("__fold") != fold), others)
        sets.append((prep, ready.filter(F.col("__fold") != fold), ready.filter(F.col("__fold") == fold)))
    if whole:
        sets.append((*whole, whole[1].limit(0)))
    return sets, kept


def _boost_all(sets: Sequence[tuple], classes: int, rounds: int, depth: int) -> list[BoostedClasses]:
    """Class-wise boosted trees of all training sets in one run of jobs."""
    parts = [train.select(F.lit(m).alias("m"), F.lit(True).alias("train"), F.col("__y").cast("int").alias("y"), vector_to_array("features").alias("x"))
             for m, (_, train, _) in enumerate(sets)]
    # the sets are persisted; their rows are read three times: for their width, the cut points and the bins
    return [BoostedClasses.of(m) for m in fit_boosted(reduce(DataFrame.union, parts), len(sets), classes, rounds, depth)]


def auto_train(df: DataFrame, target: str, features: Sequence[str] | None = None, budget_seconds: float = 600.0,
               max_models: int = 25, folds: int = 3, seed: int = 1, parallelism: int = 2, boosts: int = 10) -> Run:
    """Cross-validated search over linear, tree, forest and boosted models.

    A text target means classification. Every grid point is a trial, listed with its folds; ``max_models`` and the budget
    are checked between trials, and the best point of each family is fitted on all rows. Folds follow a hash of the row
    (copies of a row share a fold), so they do not depend on the cluster; imputation and indexing are fitted on each
    fold's training rows. Numeric features without any value are left out (``left_out``). ``parallelism`` folds are
    fitted side by side; boosted trees of more than two classes grow for all folds at once.
    """
    start = time.monotonic()
    problem = problem_type(df, target) if target in nominal_columns(df) or target not in numeric_columns(df) else REGRESSION
    features = list(features or [c for c in df.columns if c != target and c in (*numeric_columns(df), *nominal_columns(df))])
    bins = max_bins(df, features)
    rows = df.filter(F.col(target).isNotNull())
    used = features_with_values(rows, features)
    classes: list[str] = []
    if problem == REGRESSION:
        rows = rows.withColumn("__y", F.col(target).cast("double"))
    else:
        levels_of(rows, [target], 1000)         # refuses a label that is no class label
        indexer = StringIndexer(inputCol=target, outputCol="__y", stringOrderType="alphabetAsc", handleInvalid="skip").fit(rows)
        classes = list(indexer.labels)
        rows = indexer.transform(rows)
    fold = F.pmod(F.xxhash64(*used, target, F.lit(seed)), F.lit(folds)).cast("int").alias("__fold")
    rows = rows.select(*used, "__y", fold)
    run = Run(target, problem, used, classes, left_out=[c for c in features if c not in used])
    sets, kept = _fold_sets(rows, used, folds)
    checks, (prep, whole, _) = sets[:-1], sets[-1]
    metric = _metric(problem, "__y")
    try:
        for name, estimator, grid in _candidates(problem, bins, seed):
            best: tuple[float, object] | None = None
            for point in grid:
                if run.trials and (time.monotonic() - start > budget_seconds or len(run.trials) >= max_models):
                    break
                began = time.monotonic()
                made = None
                if estimator is None:
                    made = _boost_all(sets, len(classes), boosts, point["depth"])
                    values = [metric(m.transform(check)) for m, (_, _, check) in zip(made, checks)]
                else:
                    asked = estimator.copy({estimator.getParam("labelCol"): "__y", **point})
                    with ThreadPoolExecutor(max(1, parallelism)) as pool:
                        run_fold = inheritable_thread_target(df.sparkSession)(lambda s: metric(asked.fit(s[1]).transform(s[2])))
                        values = list(pool.map(run_fold, checks))
                value = sum(values) / len(values) if values else float("nan")
                run.trials.append(Trial(name, {getattr(k, "name", k): v for k, v in point.items()}, value, values, round(time.monotonic() - began, 3)))
                if best is None or value > best[0]:
                    best = (value, made[-1] if made else asked)
            if best is not None:
                fitted = best[1] if isinstance(best[1], BoostedClasses) else best[1].fit(whole)
                run.models.append((name, best[0], PipelineModel(stages=[prep, fitted])))
    finally:
        for frame in kept:
            frame.unpersist()
    run.models.sort(key=lambda m: -m[1])
    run.trials.sort(key=lambda t: -t.value)
    run.seconds = time.monotonic() - start
    return run


def leaderboard(spark, run: Run) -> DataFrame:
    """Every trial, best first; ``fitted`` marks the trial behind each family's fitted model."""
    seen: set[str] = set()
    rows = []
    for i, t in enumerate(run.trials):
        rows.append((i + 1, t.model, json.dumps(t.params, sort_keys=True), run.metric(), t.value, t.folds, t.model not in seen))
        seen.add(t.model)
    return spark.createDataFrame(rows, "rank int, model string, params string, metric string, value double, folds array<double>, fitted boolean").orderBy("rank")


def feature_importance(df: DataFrame, run: Run, top: int = 10) -> DataFrame:
    """Importances of the best model that has them, scaled to the largest."""
    for name, _, model in run.models:
        last = model.stages[-1]
        if hasattr(last, "featureImportances"):
            raw = [float(v) for v in last.featureImportances.toArray()]
            peak = max(raw) or 1.0
            rows = [(name, c, v, v / peak) for c, v in zip(feature_order(df, run.features), raw)]
            base = df.sparkSession.createDataFrame(rows, "model string, feature string, importance double, scaled double")
            return base.orderBy(F.desc("importance"), "feature").limit(top)
    return df.sparkSession.createDataFrame([], "model string, feature string, importance double, scaled double")


def _predicted(scored: DataFrame, run: Run) -> Column:
    if run.problem == REGRESSION:
        return F.col("prediction")
    names = F.array(*[F.lit(c) for c in run.classes])
    return F.get(names, F.col("prediction").cast("int"))


def score(df: DataFrame, model: PipelineModel, run: Run) -> DataFrame:
    scored = model.transform(df)
    return scored.select(*df.columns, _predicted(scored, run).alias("predict"))


def batch_predict(df: DataFrame, run: Run) -> tuple[str, DataFrame]:
    """Input columns plus ``predict``; with a target in the table the best scoring model is used."""
    best = run.models[0]
    if run.target in df.columns:
        def quality(model: PipelineModel) -> float:
            out = score(df, model, run)
            if run.problem == REGRESSION:
                return regression_metrics(out, run.target, "predict", 12).first()["r2"] or float("-inf")
            return classification_metrics(out, run.target, "predict").first()["accuracy"]
        best = max(run.models, key=lambda m: quality(m[2]))
    return best[0], score(df, best[2], run)


def save_run(spark, run: Run, folder: str) -> None:
    """Every model under its two-digit rank, plus one JSON table of run facts."""
    for i, (_, _, model) in enumerate(run.models):
        model.write().overwrite().save(f"{folder}/models/{i + 1:02d}")
    rows = [json.dumps({"rank": i + 1, "model": n, "metric": run.metric(), "value": v, "target": run.target,
                        "problem": run.problem, "features": run.features, "classes": run.classes,
                        "seconds": run.seconds, "total_models": len(run.models), "path": f"models/{i + 1:02d}",
                        "trials": [asdict(t) for t in run.trials], "left_out": run.left_out})
            for i, (n, v, _) in enumerate(run.models)]
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/run_info")


def load_run(spark, folder: str) -> Run:
    facts = sorted((json.loads(r.value) for r in spark.read.text(f"{folder}/run_info").collect()), key=lambda r: r["rank"])
    first = facts[0]
    run = Run(first["target"], first["problem"], first["features"], first["classes"], seconds=first["seconds"],
              trials=[Trial(**t) for t in first["trials"]], left_out=first["left_out"])
    run.models = [(r["model"], r["value"], PipelineModel.load(f"{folder}/{r['path']}")) for r in facts]
    return run


# ---- surrogate regression and input search ------------------------------------------------

def surrogate_regression(df: DataFrame, target: str, features: Sequence[str], key: Sequence[str], share: float = 0.2,
                         seed: int = 1, boosts: int = 20, direct_rows: int = ROWS_PER_TASK) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """Linear and boosted regressors with train and holdout errors; r2 is of truth against prediction.

    Trees of more than ``direct_rows`` rows learn from all of them as weighted cells (see ``cells``), whose errors add up to
    those of the rows; then no row is kept.
    """
    bins = max_bins(df, features)
    rows = df.filter(F.col(target).isNotNull())
    known, unknown = holdout(rows, key, share, seed)
    # what is learned about the features, too, comes from the training part alone
    prep = Pipeline(stages=feature_stages(known, features)).fit(known)
    parts = [prep.transform(part).select(*{*key, target}, "features") for part in (known, unknown)]
    linear, boosted = LinearRegression(labelCol=target), GBTRegressor(labelCol=target, seed=seed, maxIter=boosts, maxDepth=4, maxBins=bins)
    results, models = [], {}

    def errors(fitted, part: DataFrame) -> list[float]:
        m = regression_metrics(fitted.transform(part), target, "prediction", 12).first()
        return [m["mse"], m["r2"]]

    if rows.select(target).count() > direct_rows:
        fitted = linear.fit(parts[0])
        models["linear"] = PipelineModel(stages=[prep, fitted])
        results.append(("linear", *[e for part in parts for e in errors(fitted, part)]))
        fitted, scores = _boosted_on_cells(rows, target, _held_out(key, share, seed), prep, boosted, bins)
        models["boosted"] = PipelineModel(stages=[prep, fitted])
        results.append(("boosted", *scores))
    else:
        # both models and all four scores read the same narrow assembled rows
        kept = [spread(part).persist(StorageLevel.MEMORY_AND_DISK) for part in parts]
        try:
            for name, est in (("linear", linear), ("boosted", boosted)):
                fitted = est.fit(kept[0])
                models[name] = PipelineModel(stages=[prep, fitted])
                results.append((name, *[e for part in kept for e in errors(fitted, part)]))
        finally:
            for part in kept:
                part.unpersist()
    table = df.sparkSession.createDataFrame(results, "model string, train_mse double, train_r2 double, test_mse double, test_r2 double")
    return table, models


def _boosted_on_cells(rows: DataFrame, target: str, held_out: Column, prep: PipelineModel, est: GBTRegressor, bins: int) -> tuple[GBTRegressionModel, list[float | None]]:
    """A boosted model of the rows not held out, learned from their cells, and mse and r2 of both parts."""
    ready = prep.transform(rows)
    inputs = prep.stages[-1].getInputCols()
    levels = {c: len(labels) + 1 for s in prep.stages if isinstance(s, StringIndexerModel) for c, labels in zip(s.getOutputCols(), s.labelsArray)}
    plain = ready.select(F.col(target).cast("double").alias("__y"), held_out.alias("__held"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(inputs)])
    cut = cells.cut_points(plain.filter(~F.col("__held")), [f"x{i}" for i, c in enumerate(inputs) if c not in levels], bins)
    # the bin of an indexed level is its index
    cuts = {f"x{i}": np.arange(levels[c] - 1) + 0.5 if c in levels else cut[f"x{i}"] for i, c in enumerate(inputs)}
    found = cells.coded(plain, cuts, ["__y", "__held"]).groupBy("code", "__held").agg(
        F.avg("__y").alias("__y"), (F.var_pop("__y") * F.count("__y")).alias("__s"), F.count(F.lit(1)).alias("__w"))
    kept, number, _ = cells.kept_cells(found)
    try:
        coded = cells.with_codes(kept, cuts).withColumn("features", F.col("features").alias("features", metadata=ready.schema["features"].metadata))
        few = cells.dealt(coded, number).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            model = est.copy({est.labelCol: "__y", est.weightCol: "__w", est.maxBins: max(bins, cells.bins_that_hold(number))}).fit(few.filter(~F.col("__held")))
            scored = model.transform(few).select("__held", "__w", "__y", "__s", "prediction")
            scores: list[float | None] = []
            for held in (False, True):
                part = scored.filter(F.col("__held") == held)
                # of a cell's rows the spread around their mean, then that of the means
                n, mean, lost = part.agg(F.sum("__w"), F.sum(F.col("__w") * F.col("__y")) / F.sum("__w"),
                                         F.sum(F.col("__s") + F.col("__w") * F.pow(F.col("__y") - F.col("prediction"), 2))).first()
                if not n:
                    scores += [None, None]
                    continue
                whole = part.agg(F.sum(F.col("__s") + F.col("__w") * F.pow(F.col("__y") - F.lit(mean), 2))).first()[0]
                scores += [round(lost / n, 12), round(1 - lost / whole, 12) if whole else None]
        finally:
            few.unpersist()
    finally:
        kept.unpersist()
    return _cut_by_value(model, list(cuts.values())).setFeaturesCol("features"), scores


def _cut_by_value(model: GBTRegressionModel, cuts: Sequence[np.ndarray]) -> GBTRegressionModel:
    """A model that splits by numbers of bins, as one that splits by the cuts between them: stored, rewritten and loaded."""
    spark = SparkSession.active()
    path = f"{shared_folder(spark)}/boosted-{uuid.uuid4().hex}"
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    made = []
    for row in nodes.collect():
        node = row["nodeData"].asDict(recursive=True)
        split = node["split"]
        if split["numCategories"] == -1 and split["featureIndex"] >= 0 and split["leftCategoriesOrThreshold"]:
            split["leftCategoriesOrThreshold"] = [float(cuts[split["featureIndex"]][math.floor(split["leftCategoriesOrThreshold"][0])])]
        made.append({**row.asDict(), "nodeData": node})
    # its few nodes, in one file
    spark.createDataFrame(made, nodes.schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
    return GBTRegressionModel.load(path)


START_QUANTILES = (0.25, 0.375, 0.5, 0.625, 0.75)


def candidate_starts(near: DataFrame, features: Sequence[str], probs: Sequence[float] = START_QUANTILES) -> DataFrame:
    """One start per quantile: that quantile of every feature over the rows near the target."""
    found = exact_quantiles(near, features, probs)
    rows = [(float(p), *[found[c][i] for c in features]) for i, p in enumerate(probs)]
    return near.sparkSession.createDataFrame(rows, "quantile double, " + ", ".join(f"`{c}` double" for c in features))


def feature_bounds(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Two rows, ``min`` and ``max`` of every feature."""
    aggs = [f(F.col(c).cast("double")).alias(f"{t}_{c}") for c in features for t, f in (("min", F.min), ("max", F.max))]
    rows = [F.struct(F.lit(t).alias("bound"), *[F.col(f"{t}_{c}").alias(c) for c in features]) for t in ("min", "max")]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def recommend_inputs(near: DataFrame, bounds: DataFrame, model, features: Sequence[str], target: float, keep: int = 5,
                     rounds: int = 6, moves: int = 64, seed: int = 7) -> DataFrame:
    """Inputs whose prediction meets the target, best first, ``keep`` per start.

    Two advisors: ``rows`` scores every observed near-target row as it is; ``search`` moves the
    quantile starts by seeded random steps inside the feature bounds, keeps the best of each
    start and halves the step. Every round is one transform over the exploded moves.
    """
    lim = {r["bound"]: r for r in bounds.collect()}
    span = {c: (lim["min"][c], lim["max"][c]) for c in features}
    gap = F.abs(F.col("prediction") - F.lit(target))

    observed = model.transform(near.select(*[F.col(c).cast("double").alias(c) for c in features]))
    observed = (observed.select(F.lit("rows").alias("advisor"), F.lit(None).cast("double").alias("quantile"), *features, "prediction")
                .orderBy(gap, *features).limit(keep))

    here = candidate_starts(near, features)
    step = 0.5
    for r in range(rounds):
        # move 0 keeps the start itself, so a round never loses ground
        tries = here.select("*", F.explode(F.sequence(F.lit(0), F.lit(moves - 1))).alias("move"))
        def moved(i: int, c: str) -> Column:
            lo, hi = span[c]
            unit = F.pmod(F.xxhash64(F.col("quantile"), F.col("move"), F.lit(i), F.lit(r), F.lit(seed)), F.lit(2_000_001)) / 1_000_000.0 - 1
            to = F.col(c) + F.when(F.col("move") == 0, 0.0).otherwise(unit) * step * (hi - lo)
            return F.least(F.greatest(to, F.lit(lo)), F.lit(hi)).alias(c)
        tries = tries.select("quantile", "move", *[moved(i, c) for i, c in enumerate(features)])
        scored = model.transform(tries).select("quantile", "move", *features, "prediction")
        # ``moves`` tries of a start at most; the best leads on, the last round gives ``keep``
        tried = F.sort_array(F.collect_list(F.struct(gap.alias("gap"), F.col("move"), F.struct(*features, "prediction").alias("b"))))
        best = scored.groupBy("quantile").agg(F.slice(tried, 1, keep if r == rounds - 1 else 1).alias("tried"))
        rows = best.select("quantile", F.explode("tried").alias("t")).select("quantile", "t.b.*").collect()
        step /= 2
        here = near.sparkSession.createDataFrame([(x["quantile"], *[x[c] for c in features]) for x in rows],
                                                 "quantile double, " + ", ".join(f"`{c}` double" for c in features))
    found = near.sparkSession.createDataFrame([("search", x["quantile"], *[x[c] for c in features], x["prediction"]) for x in rows],
                                              "advisor string, quantile double, " + ", ".join(f"`{c}` double" for c in features) + ", prediction double")
    every = observed.unionByName(found)
    deviation = F.col("prediction") - F.lit(target)
    return (every.select("advisor", "quantile", deviation.alias("deviation"), F.col("prediction").alias("target"), *features)
            .orderBy(F.abs("deviation"), "advisor", "quantile"))


# ---- adversarial validation ---------------------------------------------------------------

def adversarial_validation(train: DataFrame, test: DataFrame, features: Sequence[str], key: Sequence[str],
                           limit: float = 0.6, max_rounds: int | None = None, trees: int = 20, depth: int = 5, seed: int = 1) -> list[dict]:
    """Remove, one by one, the features that best tell train from test rows while AUC > limit.

    It ends at the limit or at the last feature; ``max_rounds`` ends it earlier, after an entry that still says ``removed``.
    Returns one entry per round: auc on a 20 % holdout, the leading feature, whether it went.
    The tagged rows are prepared once and kept for all rounds. A missing number stands as the mean of all rows and, beside
    it, as a mark of its own, so nulls that came or went count as drift; a feature's importance is that of both together.
    Null levels are a level. A feature without any value in either table says nothing and is never the leading one.
    """
    order = feature_order(train, features)
    both = (train.select(*key, *features).withColumn("__test", F.lit(0.0))
            .unionByName(test.select(*key, *features).withColumn("__test", F.lit(1.0))))
    nominal = [c for c in order if c in nominal_columns(train)]
    numeric = [c for c in order if c not in nominal]
    bins = max_bins(both, features)

    def number(x: Column) -> Column:
        return F.when(F.abs(x.cast("double")) < float("inf"), x.cast("double"))
    found = collect_stats(both, numeric, lambda x: {"m": F.avg(number(x)), "n": F.count(number(x)), "k": F.count(F.lit(1))})
    slots = {c: [f"__v_{c}"] + [f"__m_{c}"] * (found[c]["n"] < found[c]["k"]) for c in numeric if found[c]["n"]} | {c: [f"__i_{c}"] for c in nominal}
    if nominal:
        both = StringIndexer(inputCols=nominal, outputCols=[f"__i_{c}" for c in nominal], stringOrderType="alphabetAsc",
                             handleInvalid="keep").fit(both).transform(both)
    values = [F.coalesce(number(F.col(f"`{c}`")), F.lit(found[c]["m"])).alias(f"__v_{c}") for c in numeric if c in slots]
    marks = [number(F.col(f"`{c}`")).isNull().cast("double").alias(f"__m_{c}") for c in numeric if len(slots.get(c, ())) > 1]
    # the key is read once, for the holdout; what the rounds read does not hold it
    check = _held_out([*key, "__test"], 0.2, seed).alias("__check")
    both = both.select(check, "__test", *values, *marks, *[F.col(f"`__i_{c}`") for c in nominal]).persist(StorageLevel.MEMORY_AND_DISK)
    left, log = [c for c in order if c in slots], []
    try:
        fit_rows, check_rows = both.filter(~F.col("__check")), both.filter("__check")
        for round_number in range(len(left) if max_rounds is None else max_rounds):
            used = [(c, slot) for c in left for slot in slots[c]]
            stage = VectorAssembler(inputCols=[slot for _, slot in used], outputCol="features", handleInvalid="keep")
            model = RandomForestClassifier(labelCol="__test", numTrees=trees, maxDepth=depth, maxBins=bins, seed=seed).fit(stage.transform(fit_rows))
            auc = _raw_auc(model.transform(stage.transform(check_rows)), "__test")
            weights = dict.fromkeys(left, 0.0)
            for (c, _), v in zip(used, model.featureImportances.toArray()):
                weights[c] += float(v)
            top = max(left, key=lambda c: weights[c])
            remove = auc > limit and len(left) > 1
            log.append({"round": round_number, "auc": float(auc), "feature": top, "removed": remove, "importances": weights})
            if not remove:
                break
            left.remove(top)
    finally:
        both.unpersist()
    return log


def adversarial_table(train: DataFrame, test: DataFrame, features: Sequence[str], key: Sequence[str], **options) -> DataFrame:
    log = adversarial_validation(train, test, features, key, **options)
    return train.sparkSession.createDataFrame([(r["round"], r["auc"], r["feature"], r["removed"]) for r in log],
                                              "round int, auc double, feature string, removed boolean")
