"""Boosted trees for any number of classes, several training sets at once.

Every round grows one small tree for each class on the gradient of the softmax loss. Rows are cut into bins once, and rows
of one class whose values lie in the same bins are counted: trees cut between bins only, so they cannot tell them apart.
A level of the trees of all classes, and of all training sets (the folds of a search and the whole table), is one scan of
those counts that adds up gradients by (training set, class, node, feature, bin). So the jobs are rounds times depth,
however many classes there are, and what leaves a task depends on the trees alone.
"""
from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weight that pulls leaf values towards 0, and the least curvature of a leaf.
SHRINK = 1.0
LEAST_LEAF = 1.0


def leaf_of(x: np.ndarray, tree: Mapping, depth: int) -> np.ndarray:
    """The node of every row, ``depth`` levels down, counted from 0 within the level. A missing value goes left."""
    at = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    for level in range(depth):
        node = (1 << level) - 1 + at
        at = 2 * at + (x[rows, tree["feature"][node]] > tree["cut"][node])
    return at


def class_scores(x: np.ndarray, model: Mapping) -> np.ndarray:
    """Raw scores (rows, classes)."""
    out = np.tile(np.asarray(model["base"], float), (len(x), 1))
    for trees in model["rounds"]:
        for k, tree in enumerate(trees):
            out[:, k] += tree["leaf"][leaf_of(x, tree, model["depth"])]
    return out


def shares(scores: np.ndarray) -> np.ndarray:
    made = np.exp(scores - scores.max(1, keepdims=True))
    return made / made.sum(1, keepdims=True)


def _code_type(bins: int) -> str:
    """Codes of a value: the bin, 0 to ``bins - 1``, and ``bins`` for NaN."""
    return "u1" if bins < 256 else "<u2"


def _coded(rows: DataFrame, edges: list[list[np.ndarray]], bins: int) -> DataFrame:
    """``m, y, code, w``: the training rows by their bins, and how many there are of each kind."""
    kind = _code_type(bins)
    shared = rows.sparkSession.sparkContext.broadcast(edges)  # cut points, not data

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column(0).to_numpy()
            codes = np.empty(batch.num_rows, object)
            for s in np.unique(m).tolist():
                mine = np.flatnonzero(m == s)
                x = _matrix(batch.column(2).take(pa.array(mine)))
                made = np.stack([np.where(np.isnan(x[:, f]), bins, np.searchsorted(e, x[:, f], "left")) for f, e in enumerate(shared.value[s])], 1)
                raw, width = made.astype(kind).tobytes(), made.shape[1] * np.dtype(kind).itemsize
                codes[mine] = [raw[n:n + width] for n in range(0, len(raw), width)]
            yield pa.record_batch({"m": batch.column(0), "y": batch.column(1), "code": pa.array(codes, pa.binary())})

    coded = rows.filter("train").select("m", "y", "x").mapInArrow(code, "m int, y int, code binary")
    return coded.groupBy("m", "y", "code").agg(F.count(F.lit(1)).alias("w"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _edges(rows: DataFrame, sets: int, bins: int) -> list[list[np.ndarray]]:
    """Cut points of every feature of every training set, from its own rows."""
    width = {r["m"]: r["w"] for r in rows.groupBy("m").agg(F.max(F.size("x")).alias("w")).collect()}
    probs = [i / bins for i in range(1, bins)]
    out: list[list[np.ndarray]] = [[] for _ in range(sets)]
    for first in range(0, max(width.values()), 40):
        block = range(first, min(first + 40, max(width.values())))
        found = rows.filter("train").groupBy("m").agg(*[F.percentile_approx(F.get("x", F.lit(i)), probs, 100 * bins).alias(f"q{i}") for i in block]).collect()
        for r in found:
            out[r["m"]] += [np.unique(np.asarray(r[f"q{i}"] or [], float)) for i in block if i < width[r["m"]]]
    return out


def fit_boosted(rows: DataFrame, sets: int, classes: int, rounds: int = 10, depth: int = 3, rate: float = 0.3, bins: int = 32) -> list[dict]:
    """One model for each training set ``m`` from ``m int, train boolean, y int, x array<double>``; only ``train`` rows teach.

    ``rows`` are read three times. A class without rows in a set gets the least score there.
    """
    edges = _edges(rows, sets, bins)
    kinds = _coded(rows, edges, bins).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _grown(kinds, edges, sets, classes, rounds, depth, rate, bins)
    finally:
        kinds.unpersist()


def _grown(kinds: DataFrame, edges: list[list[np.ndarray]], sets: int, classes: int, rounds: int, depth: int, rate: float, bins: int) -> list[dict]:
    counts = np.zeros((sets, classes))
    for r in kinds.groupBy("m", "y").agg(F.sum("w").alias("w")).collect():
        counts[r["m"], r["y"]] = r["w"]
    models = [{"base": np.log((c + 0.5) / (c.sum() + 0.5 * classes)), "depth": depth, "rounds": [], "gains": np.zeros(len(e))} for c, e in zip(counts, edges)]
    spark = kinds.sparkSession.sparkContext
    for _ in range(rounds):
        growing = [[{"feature": np.zeros((1 << depth) - 1, np.int64), "cut": np.full((1 << depth) - 1, np.inf), "leaf": np.zeros(1 << depth)}
                    for _ in range(classes)] for _ in range(sets)]
        for level in range(depth):
            shared = spark.broadcast((models, growing, edges, level, classes, bins))
            try:
                for m, k, sums in _histograms(kinds, shared):
                    _split(growing[m][k], sums.reshape(1 << level, len(edges[m]), bins, 2), edges[m], level, models[m]["gains"], rate * (classes - 1) / classes, level + 1 == depth)
            finally:
                shared.unpersist()
        for m in range(sets):
            models[m]["rounds"].append(growing[m])
    return models


def _histograms(kinds: DataFrame, shared) -> Iterator[tuple[int, int, np.ndarray]]:
    """Sums of gradients and curvatures by (node, feature, bin) for every training set and class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, growing, edges, level, classes, bins = shared.value
        totals = [np.zeros((classes, 1 << level, len(e), bins, 2)) for e in edges]
        for batch in batches:
            m, y, w = (batch.column(n).to_numpy() for n in (0, 1, 3))
            for s in np.unique(m).tolist():
                mine = np.flatnonzero(m == s)
                coded = np.frombuffer(b"".join(batch.column(2).take(pa.array(mine)).to_pylist()), kind).reshape(len(mine), -1).astype(np.int64)
                missing = coded == bins
                # any value of a bin takes the way of all its rows; a missing one is counted beyond the last cut, and goes left
                x = np.stack([np.append(e, np.inf)[np.minimum(coded[:, f], len(e))] for f, e in enumerate(edges[s])], 1)
                x[missing] = np.nan
                coded = np.where(missing, [len(e) for e in edges[s]], coded)
                p = shares(class_scores(x, models[s]))
                for k in range(classes):
                    node = leaf_of(x, growing[s][k], level)
                    slope, bend = w[mine] * ((y[mine] == k) - p[:, k]), w[mine] * p[:, k] * (1 - p[:, k])
                    for f in range(len(edges[s])):
                        at = node * bins + coded[:, f]
                        for part, weight in enumerate((slope, bend)):
                            totals[s][k, :, f, :, part] += np.bincount(at, weight, bins << level).reshape(1 << level, bins)
        named = [(s * classes + k, totals[s][k].tobytes()) for s in range(len(edges)) for k in range(classes)]
        yield pa.record_batch({"key": pa.array([n for n, _ in named], pa.int32()), "sums": pa.array([v for _, v in named], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[key] = held.get(key, 0.0) + np.frombuffer(raw)
        yield pa.record_batch({"key": pa.array(list(held), pa.int32()), "sums": pa.array([v.tobytes() for v in held.values()], pa.binary())})

    classes, kind = shared.value[4], _code_type(shared.value[5])
    # no number of partitions: small ones are joined, and the iterator below runs a job for each
    summed = kinds.mapInArrow(run, "key int, sums binary").repartition("key").mapInArrow(add, "key int, sums binary")
    for key, raw in summed.toLocalIterator():
        yield key // classes, key % classes, np.frombuffer(bytes(raw))


def _split(tree: dict, sums: np.ndarray, edges: list[np.ndarray], level: int, gains: np.ndarray, rate: float, last: bool) -> None:
    """The best cut of every node of a level; of equal ones the first feature and lowest cut. The last level sets leaf values."""
    def worth(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return g * g / (h + SHRINK)
    below = np.cumsum(sums, axis=2)[:, :, :-1]
    for node in range(1 << level):
        whole = sums[node, 0].sum(0) if len(edges) else np.zeros(2)
        at, best = None, 1e-9
        for f, cuts in enumerate(edges):
            left = below[node, f, :len(cuts)]
            right = whole - left
            gain = worth(left[:, 0], left[:, 1]) + worth(right[:, 0], right[:, 1]) - worth(whole[0], whole[1])
            gain = np.where((left[:, 1] >= LEAST_LEAF) & (right[:, 1] >= LEAST_LEAF), gain, -1.0)
            if len(gain) and gain.max() > best:
                b = int(gain.argmax())
                at, best = (f, b), float(gain[b])
        sides = [whole, np.zeros(2)]
        if at is not None:
            f, b = at
            tree["feature"][(1 << level) - 1 + node], tree["cut"][(1 << level) - 1 + node] = f, edges[f][b]
            gains[f] += best
            sides = [below[node, f, b], whole - below[node, f, b]]
        if last:
            for n, (g, h) in enumerate(sides):
                tree["leaf"][2 * node + n] = rate * g / (h + SHRINK) if h > 0 else 0.0


class BoostedClasses(Transformer, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted model of ``fit_boosted`` as a pipeline stage."""

    trees = Param(Params._dummy(), "trees", "the model as JSON", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, trees: str = "", featuresCol: str = "features", predictionCol: str = "prediction", probabilityCol: str = "probability"):
        super().__init__()
        self._set(**self._input_kwargs)

    @staticmethod
    def of(model: Mapping) -> "BoostedClasses":
        plain = {"base": list(map(float, model["base"])), "depth": model["depth"], "gains": list(map(float, model["gains"])),
                 "rounds": [[{n: [None if v == np.inf else v for v in t[n].tolist()] for n in t} for t in trees] for trees in model["rounds"]]}
        return BoostedClasses(trees=json.dumps(plain))

    def model(self) -> dict:
        held = json.loads(self.getOrDefault(self.trees))
        held["rounds"] = [[{"feature": np.array(t["feature"], np.int64), "cut": np.array([np.inf if v is None else v for v in t["cut"]], float),
                            "leaf": np.array(t["leaf"], float)} for t in trees] for trees in held["rounds"]]
        return held

    @property
    def featureImportances(self) -> DenseVector:
        gains = np.asarray(self.model()["gains"])
        return DenseVector(gains / (gains.sum() or 1.0))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = dataset.sparkSession.sparkContext.broadcast(self.model())  # a model, not data

        @F.pandas_udf("array<double>")
        def told(x: pd.Series) -> pd.Series:
            return pd.Series(list(shares(class_scores(np.stack(x.to_numpy()), shared.value))) if len(x) else [], dtype=object)

        made = dataset.withColumn("__p", told(vector_to_array(F.col(self.getFeaturesCol()))))
        best = (F.array_position("__p", F.array_max("__p")) - 1).cast("double")
        return made.withColumns({self.getPredictionCol(): best, self.getProbabilityCol(): array_to_vector("__p")}).drop("__p")
