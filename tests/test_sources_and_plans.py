"""Files, models, saved state and the composite flows."""
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colsmith import session
from colsmith.operators import boosting, cells, encoding, groups, modeling, selection
from colsmith.operators.roles import CheckError
from colsmith.plans import mold as molds
from colsmith.plans import preparation, regression_prep, reports
from colsmith.sources import tables


@pytest.fixture()
def csv(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    rows = ["name,size,when"] + [f"n{i},{i % 7 + 0.5},2024-01-{i % 28 + 1:02d}" for i in range(300)]
    (tmp_path / "t.csv").write_text("\n".join(rows) + "\n")
    return path


def test_csv_reading(spark, csv):
    df = tables.read_table(spark, csv, usecols=["size", "name"], nrows=10)
    assert df.columns == ["size", "name"] and df.count() == 10
    skipped = tables.read_table(spark, csv, header=False, skiprows=1, names=["a", "b", "c"])
    assert skipped.count() == 300 and skipped.filter("a = 'name'").count() == 0


def test_first_lines_of_every_file_are_skipped(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for n in range(3):
        (folder / f"{n}.csv").write_text(f"note {n}\nmore,{n}\na,b\n" + "".join(f"{n}{i},{i}\n" for i in range(5)))
    df = tables.read_table(spark, str(folder), skiprows=2, fmt="csv")
    assert df.columns == ["a", "b"] and df.count() == 15 and df.agg(F.sum("b")).first()[0] == 30


def test_models_accept_missing_numbers(spark, signal):
    holed = signal.withColumn("noise", F.when(F.col("rid") % 5 > 0, F.col("noise")))
    table, models = modeling.surrogate_regression(holed, "y", ["a", "noise"], ["rid"])
    assert {r.model for r in table.collect()} == {"linear", "boosted"}
    near = signal.filter(F.abs(F.col("y") - 1.5) < 0.5)
    found = modeling.recommend_inputs(near, modeling.feature_bounds(signal, ["a", "noise"]), models["linear"], ["a", "noise"], 1.5, keep=3, rounds=3).collect()
    starts = [r.quantile for r in found if r.advisor == "search"]
    assert len(starts) == 15 and all(starts.count(q) == 3 for q in modeling.START_QUANTILES)


def test_headers(spark, csv, tmp_path):
    assert tables.has_header(spark, csv)
    (tmp_path / "bare.csv").write_text("".join(f"a,{i % 3},b\n" for i in range(50)))
    assert not tables.has_header(spark, str(tmp_path / "bare.csv"))
    with pytest.raises(CheckError, match="1002"):
        tables.require_header(spark, str(tmp_path / "bare.csv"))
    tables.check_head(tables.first_line(spark, csv))
    with pytest.raises(CheckError, match="3001"):
        tables.check_head("a,b$,c")


def test_upload_check_and_profile_round_trip(spark, tmp_path):
    rows = ["id,v,kind"] + [f"{i},{i * 1.5 if i % 100 else 'bad'},{'xyz'[i % 3]}" for i in range(1, 901)]
    (tmp_path / "u.csv").write_text("\n".join(rows) + "\n")
    facts = reports.upload_check_file(spark, str(tmp_path / "u.csv"), str(tmp_path / "out"))
    assert facts == {"length": 3, "impurity_value": ["bad"]}
    assert tables.read_table(spark, str(tmp_path / "out/table"), fmt="csv").count() == 891
    profile = tables.read_profile(spark, str(tmp_path / "out/profile"))
    assert tables.profile_types(profile) == {"id": "int", "v": "float", "kind": "object"}
    assert tables.profile_schema(profile)["v"].dataType.typeName() == "double"
    assert sorted(tables.profile_roles(profile)[0]) == ["id", "v"] and json.loads(profile.first().extra)["length"] == 3


def test_column_roles(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    tables.write_column_roles(df, "s", str(tmp_path / "roles"))
    assert json.loads(spark.read.text(str(tmp_path / "roles")).first().value) == {
        "label": "s", "length": 2, "col_types": {"n": "numeric", "s": "enum"}}


def test_dispatcher(spark):
    df = spark.range(10).withColumn("v", F.col("id") * 2.0)
    assert reports.reconstruct("column_filter", df, columns=["v"]).columns == ["v"]
    assert [p.count() for p in reports.reconstruct("split", df, size=0.3, keys=["id"])] == [7, 3]
    with pytest.raises(ValueError):
        reports.reconstruct("nothing", df)


# ---- models -------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(6)
    n = 1200
    pdf = pd.DataFrame({"rid": range(n), "a": rng.normal(size=n), "noise": rng.normal(size=n), "g": rng.choice(list("xyz"), n)})
    pdf["y"] = 2 * pdf.a + (pdf.g == "x") * 3
    pdf["flag"] = np.where(pdf.y > 1, "yes", "no")
    return spark.createDataFrame(pdf).repartition(4).cache()


def test_search_save_load_predict(spark, signal, tmp_path):
    run = modeling.auto_train(signal, "flag", ["a", "noise", "g"], budget_seconds=30, folds=2)
    assert run.problem == "binary" and run.models[0][1] > 0.95
    board = modeling.leaderboard(spark, run).collect()
    assert [r["value"] for r in board] == sorted((r["value"] for r in board), reverse=True)
    modeling.save_run(spark, run, str(tmp_path / "run"))
    again = modeling.load_run(spark, str(tmp_path / "run"))
    name, out = modeling.batch_predict(signal, again)
    assert out.columns == [*signal.columns, "predict"]
    assert modeling.classification_metrics(out, "flag", "predict").first().accuracy > 0.8
    assert modeling.feature_importance(signal, run).first().feature == "a"


def test_area_under_roc_counts_pairs(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"y": rng.integers(0, 2, 3000).astype(float), "s": np.where(rng.random(3000) < 0.3, 0.5, rng.normal(size=3000))})
    pdf["s"] += pdf.y * (pdf.s != 0.5) * 0.4
    pos, neg = pdf.s[pdf.y == 1].to_numpy(), pdf.s[pdf.y == 0].to_numpy()
    want = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))
    df = spark.createDataFrame(pdf).repartition(3)
    for size in (250_000, 100):
        assert modeling.area_under_roc(df, "y", "s", size) == pytest.approx(want, abs=1e-12)
    assert [modeling.area_under_roc(df.filter(f), "y", "s") for f in ("y = 0", "y = 1", "y = 2")] == [0.0, 1.0, 0.5]


def test_area_of_many_scores_shuffles_packed_counts(spark, monkeypatch):
    """Rows with many scores are not grouped and scanned again: nulls lowest, NaN highest, a hot score, several blocks and pieces."""
    rng = np.random.default_rng(9)
    scores = [None if k < 0.05 else float("nan") if k < 0.1 else 0.25 if k < 0.4 else float(v) for k, v in zip(rng.random(2500), rng.normal(size=2500))]
    made = [(v, float(y)) for v, y in zip(scores, rng.integers(0, 2, 2500))] + [(-0.0, 1.0), (0.0, 0.0), (0.5, None), (float("-inf"), 1.0)]
    place = [-np.inf if v is None else np.inf if v != v else float(np.clip(v, -1e9, 1e9)) for v, _ in made]
    truth = np.array([y == 1.0 for _, y in made])
    pos, neg = np.array(place)[truth], np.array(place)[~truth]
    want = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))
    df = spark.createDataFrame(made, "s double, y double").repartition(3)
    assert modeling.area_under_roc(df, "y", "s") == want        # few scores: one range
    monkeypatch.setattr(modeling, "ordered_scan", None)
    monkeypatch.setattr(modeling, "ROWS_PER_BLOCK", 400)
    monkeypatch.setattr(modeling, "SCORES_PER_PIECE", 16)
    for size in (10, 200, 1000):
        assert modeling.area_under_roc(df, "y", "s", size) == want


def test_batches_by_count_puts_the_setting_back(spark):
    before = spark.conf.get(session.BATCH_BYTES, None)
    for own in (before, "1000000"):
        if own:
            spark.conf.set(session.BATCH_BYTES, own)
        outer, inner = session.batches_by_count(spark), session.batches_by_count(spark)
        outer.__enter__()
        inner.__enter__()
        outer.__exit__(None, None, None)        # threads leave in any order
        assert spark.conf.get(session.BATCH_BYTES) == str(2 ** 31 - 1)
        inner.__exit__(None, None, None)
        assert spark.conf.get(session.BATCH_BYTES, None) == own
    spark.conf.unset(session.BATCH_BYTES) if before is None else spark.conf.set(session.BATCH_BYTES, before)


def test_folds_share_vectors_only_where_their_preparation_agrees(spark, signal):
    rows = signal.select("a", "g", (F.col("y") > 1).cast("double").alias("__y"), F.pmod(F.col("rid"), F.lit(3)).cast("int").alias("__fold"))

    def vectors(df):
        return sorted((r["__fold"], r["__y"], *r["features"].toArray()) for r in df.collect())
    some = F.when(F.col("__fold") != 1, F.col("a")).alias("a")
    alone = F.when((F.col("__fold") == 2) & (F.col("g") == "x"), "own").otherwise(F.col("g")).alias("g")
    for case, want in ((rows, 1), (rows.select(some, "g", "__y", "__fold"), 4), (rows.select("a", alone, "__y", "__fold"), 2)):
        sets, kept = modeling._fold_sets(case, ["a", "g"], 3)
        assert len(kept) == want and len(sets) == 4 and sets[-1][2].isEmpty()
        for fold, (_, train, check) in enumerate(sets[:-1]):
            plain = modeling.Pipeline(stages=modeling.feature_stages(case, ["a", "g"])).fit(case.filter(F.col("__fold") != fold)).transform(case)
            assert vectors(train) == vectors(plain.filter(F.col("__fold") != fold)) and vectors(check) == vectors(plain.filter(F.col("__fold") == fold))
        for frame in kept:
            frame.unpersist()


def test_search_keeps_nothing(spark, signal):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    modeling.auto_train(signal, "flag", ["a", "g"], max_models=1, folds=2)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


@pytest.fixture(scope="module")
def bands(signal):
    """Twelve classes, a column with nulls and one without any value."""
    band = F.least(F.greatest(F.floor(F.col("a") * 3 + 6), F.lit(0)), F.lit(11)).cast("string")
    return (signal.withColumn("band", F.concat(F.lit("b"), band)).withColumn("noise", F.when(F.col("rid") % 5 > 0, F.col("noise")))
            .withColumn("none", F.lit(None).cast("double")).cache())


def test_many_classes_are_boosted_and_every_trial_is_listed(spark, bands, tmp_path):
    run = modeling.auto_train(bands, "band", ["a", "noise", "g", "none"], folds=2, boosts=4)
    board = modeling.leaderboard(spark, run).collect()
    assert sorted((r.model, json.loads(r.params).get("regParam")) for r in board) == [
        ("boosted", None), ("forest", None), ("logistic", 0.0), ("logistic", 0.1), ("tree", None)]
    assert [r["rank"] for r in board] == [1, 2, 3, 4, 5] and all(len(r.folds) == 2 for r in board)
    assert sum(r.fitted for r in board) == len(run.models) == 4 and run.left_out == ["none"] and len(run.classes) == 12
    assert {name: value for name, value, _ in run.models}["boosted"] > 0.8
    model = next(m for name, _, m in run.models if name == "boosted")
    modeling.save_run(spark, run, str(tmp_path / "run"))
    again = modeling.load_run(spark, str(tmp_path / "run"))
    loaded = next(m for name, _, m in again.models if name == "boosted")
    a, b = (modeling.score(bands, m, run).orderBy("rid").select("predict").collect() for m in (model, loaded))
    assert a == b and again.trials == run.trials and again.left_out == ["none"]
    weights = model.stages[-1].featureImportances.toArray()
    assert weights[0] > 0.9 and len(weights) == 3


def test_boosting_scans_each_kind_of_row_once(spark, monkeypatch):
    """Rows of a class in the same bins count as one row with a weight, at every level of every tree."""
    rng = np.random.default_rng(3)
    made = [(0, True, int(c), [float(a), None if a == 7 else float(b)]) for a, b, c in rng.integers(0, 8, (2000, 3))]
    made = [(m, t, y % 3, [float("nan") if v is None else v for v in x]) for m, t, y, x in made]
    rows = spark.createDataFrame(made, "m int, train boolean, y int, x array<double>").repartition(3)
    seen = []
    real = boosting._histograms
    monkeypatch.setattr(boosting, "_histograms", lambda kinds, shared: seen.append((kinds.count(), kinds.agg(F.sum("w")).first()[0])) or real(kinds, shared))
    model, = boosting.fit_boosted(rows, 1, 3, rounds=2, depth=2, bins=16)
    kinds = len({(y, x[0], str(x[1])) for _, _, y, x in made})
    assert seen == [(kinds, 2000)] * 4 and kinds < 200
    assert len(model["rounds"]) == 2 and model["gains"].sum() > 0


def test_importances_bound_the_rows_of_a_task(spark, monkeypatch):
    """A split of a file may hold any number of rows; what a task reads again and again must not grow with it."""
    from colsmith import session
    df = spark.range(2500).repartition(2)
    assert session.bounded(df, 2500, 1000).rdd.getNumPartitions() == 3
    assert session.bounded(df, 2500, 5000) is df and session.bounded(df.limit(0), 0).count() == 0
    parts = []
    monkeypatch.setattr(selection, "bounded", lambda d, rows: parts.append(rows) or session.bounded(d, rows, 100))
    data = df.selectExpr("CAST(id % 17 AS DOUBLE) AS a", "CAST(id % 5 AS DOUBLE) AS b", "IF(id % 17 > 8, 'x', 'y') AS y")
    assert selection.importances(data, ["a", "b"], "y", "binary", trees=3, boosts=2)["a"] == 1.0 and parts == [2500]


def test_trees_on_cells_equal_trees_on_rows(spark):
    """Up to 10,000 rows Spark cuts by all rows, too: the same splits and importances, of classes and of numbers."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    rng = np.random.default_rng(4)
    n = 5000
    pdf = pd.DataFrame({"a": rng.integers(0, 50, n) * 1.0, "b": rng.normal(size=n), "c": rng.random(n) * (rng.random(n) < 0.4)})
    pdf["y"], pdf["z"] = (pdf.a * (1 + pdf.b * 0.2) > 25) * 1.0, pdf.a + pdf.b * 30 * pdf.c
    data = spark.createDataFrame(pdf).cache()
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(data)
    cuts = cells.cut_points(data, ["a", "b", "c"])
    for label, kind in (("y", GBTClassifier), ("z", GBTRegressor)):
        coded = cells.coded(data, cuts, [label])
        found = (coded.groupBy("code", label).agg(F.count(F.lit(1)).alias("__w")) if label == "y"
                 else coded.groupBy("code").agg(F.avg(label).alias(label), F.count(F.lit(1)).alias("__w")))
        kept, number, total = cells.kept_cells(found)
        assert total == n and number < n
        few = kind(labelCol=label, weightCol="__w", maxIter=4, maxDepth=4, seed=3, maxBins=cells.bins_that_hold(number)).fit(cells.dealt(cells.with_codes(kept, cuts), number))
        whole = kind(labelCol=label, maxIter=4, maxDepth=4, seed=3).fit(rows)
        np.testing.assert_allclose(few.featureImportances.toArray(), whole.featureImportances.toArray(), atol=1e-9)
        kept.unpersist()


def test_importances_read_every_row(spark, monkeypatch):
    """No tree draws rows, and three rows of 30,000 have their cut."""
    from pyspark.ml.classification import RandomForestClassifier
    seen = []

    class Watched(RandomForestClassifier):
        def fit(self, rows, params=None):
            seen.append((rows.agg(F.sum("__w")).first()[0], self.getSubsamplingRate(), self.getBootstrap()))
            return super().fit(rows, params)

    monkeypatch.setattr(selection, "RandomForestClassifier", Watched)
    data = spark.range(30_000).selectExpr("CAST(id % 10000 = 7 AS DOUBLE) AS rare", "CAST(id % 13 AS DOUBLE) AS b", "rand(3) AS c", "IF(id % 10000 = 7, 'x', 'y') AS y")
    assert selection.importances(data, ["rare", "b", "c"], "y", "binary", trees=6, boosts=2) == pytest.approx({"rare": 1.0, "b": 0.0, "c": 0.0}, abs=1e-3)
    assert seen == [(30_000, 1.0, False)]
    cuts = cells.cut_points(data, ["rare", "c"])
    assert cuts["rare"].tolist() == [0.5] and len(cuts["c"]) == 31
    shares = np.diff([0, *(data.filter(F.col("c") <= float(v)).count() for v in cuts["c"][::10])]) / 30_000
    np.testing.assert_allclose(shares, [1 / 32, 10 / 32, 10 / 32, 10 / 32], atol=1e-3)


def test_boosting_equals_a_plain_version(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)).round(1)
    x[:, 2] = 1.0
    y = np.where(x[:, 0] > 0.3, 2, (x[:, 1] > 0).astype(int))
    rows = spark.createDataFrame([(m, bool(n % 3 != m), int(c), r.tolist()) for m in range(2) for n, (r, c) in enumerate(zip(x, y))],
                                 "m int, train boolean, y int, x array<double>").repartition(5).cache()
    models = boosting.fit_boosted(rows, 2, 3, rounds=3, depth=2, bins=16)
    edges = boosting._edges(rows, 2, 16)
    for m, model in enumerate(models):
        mine = np.arange(300) % 3 != m
        xs, ys = x[mine], y[mine]
        score = np.tile(np.log((np.bincount(ys, minlength=3) + 0.5) / (len(ys) + 1.5)), (len(xs), 1))
        for trees in model["rounds"]:
            p = boosting.shares(score)
            for k, tree in enumerate(trees):
                g, h = (ys == k) - p[:, k], p[:, k] * (1 - p[:, k])

                def best(some):
                    worth = lambda q: g[q].sum() ** 2 / (h[q].sum() + 1)
                    cuts = [(worth(some & (xs[:, f] <= c)) + worth(some & (xs[:, f] > c)) - worth(some), -f, -c) for f in range(3) for c in edges[m][f]
                            if min(h[some & (xs[:, f] <= c)].sum(), h[some & (xs[:, f] > c)].sum()) >= 1]
                    return max(cuts, default=(0.0, 0, -np.inf))
                root = best(np.ones(len(xs), bool))
                assert root[0] <= 1e-9 or (tree["feature"][0], tree["cut"][0]) == (-root[1], -root[2])
                at = boosting.leaf_of(xs, tree, 2)
                for leaf in np.unique(at):
                    here = at == leaf
                    assert tree["leaf"][leaf] == pytest.approx(0.3 * 2 / 3 * g[here].sum() / (h[here].sum() + 1))
                score[:, k] = score[:, k] + tree["leaf"][at]
        made = boosting.class_scores(xs, model)
        np.testing.assert_allclose(made, score)
        assert (made.argmax(1) == ys).mean() > 0.9


def test_surrogate_learns_from_the_training_part(spark, bands):
    table, models = modeling.surrogate_regression(bands, "y", ["a", "noise", "none"], ["rid"])
    assert {r.model for r in table.collect()} == {"linear", "boosted"}
    train = modeling.holdout(bands, ["rid"], 0.2)[0]
    imputer = models["linear"].stages[0].stages[0]
    assert imputer.surrogateDF.first()["noise"] == pytest.approx(train.agg(F.avg("noise")).first()[0])


def test_surrogate_on_cells_equals_that_on_rows(spark):
    """Scores of both parts, and predictions for rows of either and for a level never seen."""
    rng = np.random.default_rng(8)
    n = 4000
    pdf = pd.DataFrame({"rid": range(n), "a": rng.integers(0, 40, n) * 1.0, "b": rng.normal(size=n), "g": rng.choice(list("xyz"), n)})
    pdf["y"] = pdf.a * (1 + 0.3 * pdf.b) + (pdf.g == "y") * 20
    data = spark.createDataFrame(pdf).withColumn("b", F.when(F.col("rid") % 11 > 0, F.col("b"))).repartition(3).cache()
    whole, first = modeling.surrogate_regression(data, "y", ["a", "b", "g"], ["rid"], boosts=5)
    few, second = modeling.surrogate_regression(data, "y", ["a", "b", "g"], ["rid"], boosts=5, direct_rows=100)
    for x, y in zip(whole.collect(), few.collect()):
        assert x.model == y.model and list(x)[1:] == pytest.approx(list(y)[1:], rel=1e-6)
    asked = data.unionByName(spark.createDataFrame([(n, 7.0, 0.1, "new", 0.0), (n + 1, -5.0, 9.0, "x", 0.0)], data.schema))
    for name in ("linear", "boosted"):
        a, b = ({r.rid: r.prediction for r in m[name].transform(asked).select("rid", "prediction").collect()} for m in (first, second))
        assert a == pytest.approx(b, rel=1e-6)


def test_adversarial_counts_missing_values(signal):
    """Values alike, but missing in the second table only; a column without any value is no feature."""
    first, second = (signal.filter(f"rid % 2 = {n}").withColumn("none", F.lit(None).cast("double")) for n in (0, 1))
    second = second.withColumn("noise", F.when(F.col("rid") % 10 > 6, F.col("noise")))
    log = modeling.adversarial_validation(first, second, ["a", "noise", "g", "none"], ["rid"], trees=5)
    assert log[0]["feature"] == "noise" and log[0]["removed"] and log[0]["auc"] > 0.7 and "none" not in log[0]["importances"]
    assert not log[-1]["removed"]


def test_regression_target_is_searched_as_regression(signal):
    run = modeling.auto_train(signal, "y", ["a", "g"], budget_seconds=0, folds=2)
    assert run.problem == "regression" and len(run.models) == 1         # no time left after the first


def test_best_threshold_by_brute_force(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"score": rng.integers(0, 40, 400) / 40})
    pdf["y"] = (pdf.score + rng.normal(size=400) * 0.3 > 0.5).astype(int)
    got = modeling.best_threshold(spark.createDataFrame(pdf), "y", "score", rows_per_range=6).first()
    best = max(((((pdf.score >= t) == pdf.y).mean()), t) for t in pdf.score.unique())
    assert (got.accuracy, got.threshold) == (pytest.approx(best[0]), best[1])


def test_adversarial_finds_the_shift(signal):
    first, second = signal.filter("rid % 2 = 0"), signal.filter("rid % 2 = 1").withColumn("noise", F.col("noise") + 3)
    log = modeling.adversarial_validation(first, second, ["a", "noise", "g"], ["rid"], trees=5)
    assert log[0]["feature"] == "noise" and log[0]["removed"] and not log[-1]["removed"]
    assert reports.eda_compare(first, first, ["rid"]) is None


def test_selection_prefers_the_signal(signal):
    weights = selection.importances(signal, ["a", "noise"], "flag", "binary", trees=10, boosts=3)
    assert weights["a"] > weights["noise"]
    # twelve classes are boosted like two: the noise gets no share from a second forest
    twelve = signal.withColumn("band", F.least(F.greatest(F.floor(F.col("a") * 4 + 6), F.lit(0)), F.lit(11)).cast("string"))
    many = selection.importances(twelve, ["a", "noise"], "band", "multiclass", trees=10, class_boosts=1, depth=3)
    assert many == {"a": 1.0, "noise": 0.0}
    assert selection.importance_select({"a": 1.0, **{f"n{i}": 0.01 for i in range(20)}, "z": 0.001})[0] == "a"
    verdict = selection.boruta_select(signal, ["a", "noise"], "flag", "binary", ["rid"], rounds=8, trees=5, rows_per_range=300)
    assert verdict["a"] == "confirmed"


def test_boruta_joins_the_shadow_rows_once_a_round(spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    held = []

    class Watched(RandomForestClassifier):
        def fit(self, rows, params=None):
            held.append((rows.is_cached, rows))
            return super().fit(rows, params)

    monkeypatch.setattr(selection, "RandomForestClassifier", Watched)
    data = spark.range(400).selectExpr("id AS rid", "CAST(id % 37 AS DOUBLE) AS a", "CAST(id * 7 % 11 AS DOUBLE) AS b", "IF(id % 37 > 18, 'x', 'y') AS flag")
    selection.boruta_select(data, ["a", "b"], "flag", "binary", ["rid"], rounds=2, trees=2)
    # the forest's passes read kept rows, and no round leaves its rows behind
    assert [cached for cached, _ in held] == [True, True]
    assert not any(rows.is_cached for _, rows in held)


def test_boruta_query_plays_all_rounds(spark, monkeypatch, tmp_path):
    """The query leaves rounds and trees to the operator."""
    from colsmith.catalog import learning
    asked = []
    monkeypatch.setattr(selection, "boruta_select", lambda *a, **named: asked.append(named) or {"l_tax": "rejected"})
    (spark.range(20).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "id AS l_partkey", "1.0D AS l_quantity", "2.0D AS l_extendedprice",
                                "0.1D AS l_discount", "0.0D AS l_tax", "'A' AS l_returnflag").write.parquet(str(tmp_path / "lineitem.parquet")))
    assert learning.boruta_select(spark, str(tmp_path)).count() == 1 and asked == [{}]


def test_shadows_are_permutations(spark):
    data = spark.range(5000).selectExpr("CAST(id % 2 AS DOUBLE) AS __y", "CAST(id AS DOUBLE) AS f0", "CAST(id AS DOUBLE) * 2 AS f1").repartition(3).localCheckpoint()
    made, again, later = (np.array([r.x for r in selection._with_shadows(data, 2, seed).orderBy(F.get("x", F.lit(0))).collect()]) for seed in ((7, 1), (7, 1), (7, 2)))
    np.testing.assert_array_equal(made, again)
    np.testing.assert_array_equal(made[:, 1], made[:, 0] * 2)
    for x in (made, later):
        # every value once, moved, each column by itself
        np.testing.assert_array_equal(np.sort(x[:, 2]), x[:, 0])
        assert (x[:, 2] == x[:, 0]).mean() < 0.01 and (x[:, 3] == x[:, 2] * 2).mean() < 0.01 and abs(np.corrcoef(x[:, 0], x[:, 2])[0, 1]) < 0.1
    assert (made[:, 2] == later[:, 2]).mean() < 0.01


def test_recommended_inputs_meet_the_target_within_bounds(spark, signal):
    table, models = modeling.surrogate_regression(signal, "y", ["a", "noise"], ["rid"])
    assert {r.model for r in table.collect()} == {"linear", "boosted"}
    near = signal.filter(F.abs(F.col("y") - 1.5) < 0.5)
    found = modeling.recommend_inputs(near, modeling.feature_bounds(signal, ["a", "noise"]), models["linear"], ["a", "noise"], 1.5, rounds=4).collect()
    assert abs(found[0].deviation) < 0.05 and [abs(r.deviation) for r in found] == sorted(abs(r.deviation) for r in found)
    lo, hi = signal.agg(F.min("a"), F.max("a")).first()
    assert all(lo <= r.a <= hi for r in found)


# ---- flows --------------------------------------------------------------------------------

def test_regression_preparation_round_trip(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"温度": np.exp(rng.normal(size=300)) - 1, "k": rng.choice(list("ab"), 300), "y": rng.normal(size=300)})
    df = spark.createDataFrame(pdf)
    state = json.loads(regression_prep.to_json(regression_prep.fit_regression(df, "y")))
    ready = regression_prep.apply_regression(df, state)
    assert ready.columns == ["column_0", "k", "label"]
    lo, hi = ready.agg(F.min("column_0"), F.max("column_0")).first()
    assert (lo, hi) == (pytest.approx(0), pytest.approx(1))
    back = regression_prep.invert_regression(ready.drop("label"), state).toPandas()
    np.testing.assert_allclose(np.sort(back["温度"]), np.sort(pdf["温度"]), atol=1e-9)
    assert sorted(back.k) == sorted(pdf.k)


@pytest.fixture(scope="module")
def flow(spark):
    rng = np.random.default_rng(14)
    n = 700
    pdf = pd.DataFrame({"rid": range(n), "when": pd.date_range("2024-01-01", periods=n, freq="7h").strftime("%Y-%m-%d %H:%M"),
                        "v": np.exp(rng.normal(size=n)), "w": rng.normal(size=n), "kind": rng.choice(list("pqrs"), n),
                        "zero": 0, "shift": rng.normal(size=n)})
    pdf["y"] = np.where(pdf.v * (1 + (pdf.kind == "p")) > 1.2, "hi", "lo")
    train, test = spark.createDataFrame(pdf[:500]), spark.createDataFrame(pdf[500:]).withColumn("shift", F.col("shift") + 30)
    train = train.withColumn("w", F.when(F.col("rid") % 9 != 0, F.col("w")))
    mold, out = preparation.cast(train, "y", test, key=["rid"], trees=3, boosts=2, unary=["polynomial"], groupby=["mean"], bucket_size=4)
    return train, test, mold, out


def test_flow_learns_and_replays(spark, flow, tmp_path):
    train, test, mold, out = flow
    assert mold.synthesis["layouts"] == {"when": "yyyy-M-d H:mm"} and "zero" not in mold.synthesis["numeric"]
    assert "shift" in mold.statistic["to_remove"] and "shift" not in out.columns
    assert out.count() == 500 and out.columns[0] == "rid" and out.columns[-1] == "y"
    numbers = [c for c in out.columns if c not in ("rid", "y")]
    means = out.agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in numbers]).first().asDict()
    assert all(abs(v) < 1e-6 for v in means.values())
    # stored and reloaded state gives the same table
    molds.save_mold(spark, mold, str(tmp_path / "mold"))
    again = preparation.shape(molds.load_mold(spark, str(tmp_path / "mold")), train.repartition(3))
    cols = sorted(out.columns)
    a, b = (t.select(*[F.col(f"`{c}`") for c in cols]).toPandas().sort_values("rid").reset_index(drop=True) for t in (out, again))
    pd.testing.assert_frame_equal(a, b, atol=1e-9)


def test_flow_never_learns_from_the_new_table(flow):
    _, test, mold, _ = flow
    cols = [c for c in preparation.shape(mold, test).columns if not c.endswith("_delta")]
    whole = preparation.shape(mold, test).select(*[F.col(f"`{c}`") for c in cols]).toPandas().set_index("rid")
    part = preparation.shape(mold, test.filter("rid < 520")).select(*[F.col(f"`{c}`") for c in cols]).toPandas().set_index("rid").sort_index()
    pd.testing.assert_frame_equal(whole.loc[part.index], part, atol=1e-9)
    assert whole.drop(columns="y").notna().all().all()


def test_flow_reads_its_table_once(spark):
    """Whatever the train table comes from is worked out once in a fit; copies of a row with a key that repeats are still one row."""
    rng = np.random.default_rng(5)
    n = 300
    pdf = pd.DataFrame({"rid": range(n), "when": pd.date_range("2024-01-01", periods=n, freq="7h"), "v": np.exp(rng.normal(size=n)), "kind": rng.choice(list("pqr"), n)})
    pdf["y"] = np.where(pdf.v > 1.1, "hi", "lo")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    plain = spark.createDataFrame(pdf)
    settings = {"key": ["rid"], "trees": 2, "boosts": 1, "unary": ["polynomial"], "groupby": ["mean"], "bucket_size": 3}
    train = plain.mapInArrow(counted, plain.schema)
    mold = preparation.fit(train, "y", **settings)
    assert seen.value == n and not train.storageLevel.useMemory
    kept = train.persist()
    assert preparation.fit(kept, "y", **settings).transform["columns"] == mold.transform["columns"] and kept.storageLevel.useMemory
    kept.unpersist()
    assert preparation._may_repeat(plain.union(plain.limit(1)), ["rid"]) and not preparation._may_repeat(plain, ["rid"]) and preparation._may_repeat(plain, [])
    twice = plain.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(0)))).drop("copy")
    assert preparation.cast(twice, "y", **settings, time_series=False)[1].count() == n


def test_flow_checks(flow):
    train, test, mold, _ = flow
    with pytest.raises(CheckError, match="3104"):
        preparation.shape(mold, test.withColumn("y", F.lit("never")))
    with pytest.raises(CheckError, match="3204"):
        preparation.shape(mold, test.drop("kind"))
    with pytest.raises(CheckError, match="3106"):
        preparation.fit(train, "absent")
    with pytest.raises(ValueError):
        molds.setup(nonsense=1)
    with pytest.raises(ValueError):
        molds.setup(pca=1.0)


def test_row_wise_state_applies_to_a_stream(spark, tmp_path):
    """Everything that works row by row also runs on a streaming table."""
    from colsmith.operators import encoding, scaling
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b")], "x double, c string")
    df.write.parquet(str(tmp_path / "in"))
    scale, hot = scaling.fit_standard(df, ["x"]), encoding.fit_one_hot(df, ["c"])
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = (encoding.apply_one_hot(scaling.apply_standard(live, scale), hot).writeStream.format("memory")
             .queryName("prepared").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    query.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("prepared").collect()) == [(-1.0, 1, 0), (1.0, 0, 1)]


def test_group_state_of_two_million_levels(spark):
    """Wide group state is a table: it never passes the driver, and null and unseen levels take the overall aggregate."""
    levels = 2_000_000
    base = spark.range(levels + levels // 2).select(F.concat(F.lit("k"), F.col("id") % levels).alias("c"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("d"),
                                                    (F.col("id") * 1.0).alias("v"))
    state = groups.fit_groups(base, ["c", "d"], ["v"], ["mean", "spread"], {"spread": lambda x: F.max(x) - F.min(x)})
    assert isinstance(state["c"]["maps"]["c_v_groupBy_mean"], str) and len(state["d"]["maps"]["d_v_groupBy_mean"]) == 2
    assert len(json.dumps(state)) < 2000
    asked = spark.createDataFrame([("k5", "x"), ("k1999999", "y"), ("never", "never"), (None, None)], "c string, d string")
    got = {r.c: (r.c_v_groupBy_mean, r.c_v_groupBy_spread) for r in groups.apply_groups(asked, state).collect()}
    whole = (levels * 1.5 - 1) / 2
    assert got == {"k5": (1_000_005.0, 2_000_000.0), "k1999999": (1_999_999.0, 0.0), "never": (whole, levels * 1.5 - 1), None: (whole, levels * 1.5 - 1)}


def test_flow_with_an_aggregate_of_ones_own_and_stored_levels(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(encoding, "TABLE_LEVELS", 3)
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"rid": range(400), "kind": rng.choice(list("abcdefgh"), 400), "v": rng.normal(size=400), "w": rng.normal(size=400)})
    pdf["y"] = pdf.v + pdf.kind.map(lambda k: pdf.v[pdf.kind == k].max() - pdf.v[pdf.kind == k].min()) * 5
    train = spark.createDataFrame(pdf)
    mold, out = preparation.cast(train, "y", key=["rid"], trees=3, boosts=2, unary=None, groupby=["span", "mean"], bucket_size=0, statistic=False,
                                 functions={"span": lambda x: F.max(x) - F.min(x)})
    stored = mold.synthesis["groups"]
    assert "kind_v_groupBy_span" in stored["kind"]["default"] and all(isinstance(m, str) for m in stored["kind"]["maps"].values())
    molds.save_mold(spark, mold, str(tmp_path / "mold"))
    again = preparation.shape(molds.load_mold(spark, str(tmp_path / "mold")), train.repartition(3))
    a, b = (t.toPandas().sort_values("rid").reset_index(drop=True) for t in (out, again))
    pd.testing.assert_frame_equal(a, b[a.columns], atol=1e-9)
