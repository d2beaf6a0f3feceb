"""Operators against hand-computed or pandas results, including every judgement call."""
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colsmith.functions import lookup
from colsmith.functions import tests_of_fit as tof
from colsmith.functions.ordered import range_cut
from colsmith.operators import association, cleaning, drift, encoding, features, imputation, merging, modeling, profiling, ranks, reshape, roles, scaling
from colsmith.operators.roles import CheckError
from colsmith.plans import reports


# ---- roles --------------------------------------------------------------------------------

@pytest.mark.parametrize("text, layout, want", [
    ("20240305", "yyyyMMdd", "2024-03-05 00:00:00"), ("5-3-2024", "d-M-yyyy", "2024-03-05 00:00:00"),
    ("2024/3/5 7:08", "yyyy/M/d H:mm", "2024-03-05 07:08:00"), ("5 mar 2024", "d MMM yyyy", "2024-03-05 00:00:00"),
    ("5 March 2024 07:08:09", "d MMMM yyyy H:mm:ss", "2024-03-05 07:08:09"), ("20240305T070809", "yyyyMMdd'T'HHmmss", "2024-03-05 07:08:09"),
    ("20240305070809123456", "yyyyMMddHHmmssSSSSSS", "2024-03-05 07:08:09.123456"),
    ("2024-03-05 07:08:09.123456", "yyyy-M-d H:mm:ss.SSSSSS", "2024-03-05 07:08:09.123456"),
    ("3/5/2024 07:08:09:123456", "M/d/yyyy H:mm:ss:SSSSSS", "2024-03-05 07:08:09.123456")])
def test_time_layouts(spark, text, layout, want):
    df = spark.createDataFrame([(text,), (None,)], "t string")
    found = roles.infer_time_formats(df)
    assert found == {"t": layout}
    assert sorted(str(r.t) for r in roles.apply_time_formats(df, found).collect()) == sorted([want, "None"])


def test_one_bad_value_rules_a_layout_out(spark):
    df = spark.createDataFrame([("2024-03-05",), ("soon",)], "t string")
    assert roles.infer_time_formats(df) == {}
    with pytest.raises(CheckError, match="3202@t;yyyy-M-d"):
        roles.apply_time_formats(df, {"t": "yyyy-M-d"}, check=True)


def test_problem_types(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("two"), (F.col("id") % 50).alias("few"), F.col("id").alias("many"),
                                  ((F.col("id") % 50) * 1.0).alias("whole"), ((F.col("id") % 50) + 0.5).alias("half"),
                                  (F.col("id") % 3).cast("string").alias("text"))
    want = dict(two="binary", few="multiclass", many="regression", whole="multiclass", half="regression", text="multiclass")
    assert {c: roles.problem_type(df, c) for c in want} == want
    with pytest.raises(CheckError, match="3105"):
        roles.problem_type(df.filter("id < 0"), "two")


def test_family_rules(spark):
    df = spark.range(10_000).select((F.col("id") % 4).alias("i4"), (F.col("id") % 20).alias("i20"), (F.col("id") % 20 + 300).alias("big"),
                                    (F.col("id") % 3 * 1.0).alias("f3"), (F.col("id") % 3 + 9.0).alias("f9"), (F.col("id") > 5).alias("b"))
    assert roles.infer_types(df) == dict(i4="object", i20="object", big="int", f3="object", f9="float", b="object")
    assert roles.category_boundary(10_000) == 25


def test_booleans_are_kept_as_categories(spark):
    df = spark.createDataFrame([(True, 1)], "b boolean, n int")
    assert roles.select_roles(df).collect()[0].asDict() == {"n": 1, "b": "true"}


def test_narrowing_bounds(spark):
    df = spark.createDataFrame([(126, 127, 0.5, 0.1, 40_000), (-127, 0, 2.0, 0.2, 0)], "a long, b long, c double, d double, e long")
    assert roles.narrow_plan(df) == {"a": "tinyint", "b": "smallint", "c": "float", "d": "double", "e": "int"}
    assert roles.narrow_types(df).collect()[0].a == 126


def test_rename_and_inverse(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["温度", "x", "y"])
    plan = roles.rename_plan(df.columns, "y")
    assert plan == {"温度": "column_0", "y": "label"}
    assert roles.rename_columns(roles.rename_columns(df, plan), plan, inverse=True).columns == df.columns


# ---- cleaning -----------------------------------------------------------------------------

def numbers_with(spark, tokens):
    rows = [(str(i / 2),) for i in range(400)] + [(t,) for t in tokens for _ in range(3)] + [(None,)]
    return spark.createDataFrame(rows, "v string")


def test_impurities_up_to_four_tokens(spark):
    clean, found = cleaning.purge_impurities(numbers_with(spark, ["a", "b", "c", "d"]))
    assert found == {"v": ["a", "b", "c", "d"]} and clean.count() == 401 and dict(clean.dtypes)["v"] == "double"
    clean, found = cleaning.purge_impurities(numbers_with(spark, ["a", "b", "c", "d", "e"]))
    assert found == {} and clean.count() == 400 + 15 + 1


def test_few_distinct_texts_are_left_alone(spark):
    df = spark.createDataFrame([(str(i % 200),) for i in range(600)] + [("x",)], "v string")
    assert cleaning.find_impurities(df) == {}


def test_near_duplicates_drop_first_and_close_rows(spark):
    rows = [(i, float(v)) for i, v in enumerate([0, 10, 10.1, 20, 20.2, 40])]
    df = spark.createDataFrame(rows, "t int, v double").repartition(3)
    kept = cleaning.drop_near_duplicates(df, ["t"], 0.5, ["v"], rows_per_range=2)
    # distances 10, .1, 9.9, .2, 19.8; their median is 9.9
    assert sorted(r.t for r in kept.collect()) == [1, 3, 5]


def test_serial_rules(spark):
    df = spark.createDataFrame([(i, i + 5, i * 3, i * 3, 7) for i in range(50)], "pos int, run int, id int, jump int, same int").repartition(4)
    free = {r.feature: r.serial for r in cleaning.serial_columns(df, ["run", "id", "jump", "same"]).collect()}
    assert free == dict(run=True, id=True, jump=False, same=False)
    walked = {r.feature: r.serial for r in cleaning.serial_columns(df, ["run", "id", "jump", "same"], ["pos"], rows_per_range=7).collect()}
    assert walked == free
    falling = df.withColumn("run", -F.col("run"))
    assert not {r.feature: r.serial for r in cleaning.serial_columns(falling, ["run"], ["pos"]).collect()}["run"]


def test_infinite_and_tokens(spark):
    df = spark.createDataFrame([(float("inf"), "NA"), (float("nan"), "na"), (1.0, "Na")], "x double, s string")
    out = cleaning.null_tokens(cleaning.infinite_to_null(df)).collect()
    assert [tuple(r) for r in out] == [(None, None), (None, None), (1.0, "Na")]


def test_outliers_with_zero_spread(spark):
    df = spark.createDataFrame([(1.0,)] * 20 + [(2.0,)], "x double")
    assert [r.x for r in cleaning.iqr_outliers(df, "x", 100).collect()] == [2.0]


def test_split_alnum_drops_constant_pieces(spark):
    df = spark.createDataFrame([("A12b",), ("A13c",), ("A14",)], "s string")
    assert cleaning.fit_split_alnum(df, "s") == [1, 2]
    assert cleaning.apply_split_alnum(df, "s", [1, 2]).collect()[2].asDict() == {"s": "A14", "s_1": "14", "s_2": None}


def test_clean_plan(spark):
    df = spark.range(600).select("id", F.lit(0).alias("z"), F.lit("k").alias("k"), F.concat(F.lit("t"), "id").alias("t"),
                                 (F.col("id") % 7).alias("ok"), (F.col("id") % 5).alias("skip"))
    assert sorted(cleaning.clean_plan(df, ["skip"])) == ["id", "k", "skip", "t", "z"]


# ---- reshape ------------------------------------------------------------------------------

def test_combine_and_bind_errors(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(1, 2)], "y int, x int")
    with pytest.raises(CheckError, match="2021"):
        reshape.combine(a, b)
    with pytest.raises(CheckError, match=r"2031@1\|2"):
        reshape.label_combine(a, spark.createDataFrame([(1,), (2,)], "z int"), order_by=(["x"], ["z"]))
    with pytest.raises(CheckError, match="2032"):
        reshape.label_combine(a, b, order_by=(["x"], ["y"]))


def test_split_sizes_are_exact_and_reproducible(spark):
    df = spark.range(1003).repartition(7)
    first, second = reshape.split(df, 0.2, ["id"], seed=5)
    again = reshape.split(df.repartition(3), 0.2, ["id"], seed=5)[1]
    assert (first.count(), second.count()) == (802, 201)
    assert {r.id for r in second.collect()} == {r.id for r in again.collect()}
    tail = reshape.split(df, 0.2, ["id"], shuffle=False)[1]
    assert sorted(r.id for r in tail.collect()) == list(range(802, 1003))


def test_split_with_equal_keys(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"))
    first, second = reshape.split(df, 0.25, ["k"], rows_per_range=9)
    assert (first.count(), second.count()) == (75, 25)


def test_stratified_split_keeps_shares(spark):
    df = spark.range(900).withColumn("s", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    first, second = reshape.split(df, 0.1, ["id"], stratify=["s"], rows_per_range=100)
    assert {r.s: r["count"] for r in second.groupBy("s").count().collect()} == {"a": 30, "b": 60}
    assert first.count() == 810 and first.intersect(second).count() == 0


def test_a_hot_stratum_is_cut_into_ranges(spark):
    """Half of the rows in one stratum, the rest in thousands: exact shares, no piece above two ranges, no join on the stratum."""
    rows, per = 12_000, 300
    df = spark.range(rows).withColumn("s", F.when(F.col("id") % 2 == 0, -1).otherwise(F.floor(F.col("id") / 4)))
    first, second = reshape.split(df, 0.25, ["id"], stratify=["s"], rows_per_range=per)
    got = {r.s: r["count"] for r in second.groupBy("s").count().collect()}
    assert got.pop(-1) == rows // 8 and set(got.values()) <= {0, 1}
    assert first.count() + second.count() == rows and first.intersect(second).count() == 0
    cut = range_cut(df, ["s", "id"], per)
    pieces = cut.mark(df, "rg").groupBy("rg").count().agg(F.max("count"), F.avg("count")).first()
    assert pieces[0] <= 2 * pieces[1]


@pytest.mark.parametrize("per_range", [2, 1000])
def test_time_steps_equal_the_separate_steps(spark, per_range):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 3)), float(t), float(t) * 0.5 + float(rng.normal()), float(rng.normal()))
            for i, t in enumerate(np.cumsum(rng.integers(0, 5, 120)))]
    df = spark.createDataFrame(rows, "k int, e int, at double, v double, w double").withColumn("at", F.timestamp_seconds("at"))
    gaps = features.time_delta(df, "at", ["at", "k"], ["e"], rows_per_range=per_range)
    state = features.fit_step_difference(gaps, ["v", "w"], "at_delta", ["at", "k"], ["e"], rows_per_range=per_range)
    want = features.apply_step_difference(gaps, state, rows_per_range=per_range).orderBy("k").collect()
    fused = features.fit_time_steps(df, "at", ["v", "w"], ["at", "k"], ["e"], rows_per_range=per_range)
    assert fused["divide"] == state["divide"] and any(fused["divide"].values())
    assert features.apply_time_steps(df, fused, rows_per_range=per_range).orderBy("k").collect() == want
    none = df.filter("k < 0")
    assert features.apply_time_steps(none, features.fit_time_steps(none, "at", ["v"], ["at", "k"])).count() == 0


def test_frames_equal_ignores_order(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "n int, s string")
    assert reshape.frames_equal(a, a.orderBy(F.desc("n")))
    assert not reshape.frames_equal(a, a.dropDuplicates())


def test_constant_label_is_reported(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "y string, x int")
    assert [(r.code, r.detail) for r in reshape.check_format(df, df, "y").collect()] == [(3103, "y")]
    num = spark.createDataFrame([(1, 1), (1, 2)], "y int, x int")
    assert [r.code for r in reshape.check_format(num, num, "y").collect()] == [3102]


def test_duplicate_features(spark):
    df = spark.createDataFrame([(1, 5, 5, 6), (2, None, None, 6)], "k int, a int, b int, c int").repartition(2)
    assert [tuple(r) for r in reshape.duplicate_features(df, ["k"]).collect()] == [("b", "a")]
    assert reshape.drop_duplicate_features(df, ["k"], keep=["b"]).columns == df.columns


# ---- profile and association --------------------------------------------------------------

@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(11)
    n = 800
    a = rng.normal(size=n)
    pdf = pd.DataFrame({"a": a, "b": a * 2 + rng.normal(size=n) * 0.1, "c": np.exp(a), "d": rng.integers(0, 4, n).astype(float)})
    pdf.loc[::9, "b"] = np.nan
    return pdf


@pytest.mark.parametrize("block", [1000, 3, 1])
def test_correlation_matrix_is_pairwise_complete(spark, frame, block, monkeypatch):
    monkeypatch.setattr(association, "BLOCK_COLUMNS", block)
    df = spark.createDataFrame(frame).select([F.when(~F.isnan(c), F.col(c)).alias(c) for c in frame]).repartition(6)
    np.testing.assert_allclose(association.correlation_matrix(df, list(frame)), frame.corr().values, atol=1e-12)
    small = association.correlations(df, [("a", "b"), ("b", "d")])
    assert small["a", "b"] == pytest.approx(frame.corr().loc["a", "b"], abs=1e-12)


@pytest.mark.parametrize("wide", [False, True])
def test_spearman_equals_pandas(spark, frame, wide, monkeypatch):
    if wide:        # the path for columns with too many levels to broadcast
        monkeypatch.setattr(ranks, "broadcast_fits", lambda *_: False)
    full = frame.dropna()
    got = association.spearman(spark.createDataFrame(full).repartition(5), list(full), rows_per_range=100)
    want = full.corr("spearman")
    for (x, y), r in got.items():
        assert r == pytest.approx(want.loc[x, y], abs=1e-9)


def test_spearman_of_copies(spark):
    rows = [(1.0, 1.0)] * 50 + [(2.0, 5.0), (3.0, 4.0), (4.0, 9.0)]
    want = pd.DataFrame(rows).corr("spearman").iloc[0, 1]
    assert association.spearman(spark.createDataFrame(rows, "x double, y double"), ["x", "y"])["x", "y"] == pytest.approx(want)


def test_binned_ranks_are_close(spark, frame):
    got = association.binned_rank_correlations(spark.createDataFrame(frame[["a", "c", "d"]]), ["a", "c", "d"])
    want = frame[["a", "c", "d"]].corr("spearman")
    assert all(abs(r - want.loc[x, y]) < 2e-3 for (x, y), r in got.items())


def test_candidate_filter_keeps_the_first(spark, frame):
    df = spark.createDataFrame(frame.dropna())
    df = df.withColumn("minus", -F.col("d")).withColumn("e", F.col("d") * F.col("a")).withColumn("e2", F.col("e") + 1).withColumn("f", F.sin("a"))
    kept = association.candidate_filter(df, ["c", "minus", "e", "e2"], ["a", "d"])
    assert kept == ["e"]
    assert association.candidate_filter(df, ["c", "minus", "e", "e2", "f"], ["a", "d"])[:1] == ["e"]


def test_correlated_columns_rules(spark):
    df = spark.range(300).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"), (-F.col("id") * 1.0).alias("z"),
                                 (F.col("id") % 3).cast("string").alias("p"), (F.col("id") % 3 + 5).cast("string").alias("q"),
                                 F.concat(F.lit("u"), "id").alias("u"), F.concat(F.lit("v"), "id").alias("v"))
    got = association.correlated_columns(df, ["p", "q", "u", "v"], ["x", "y", "z"])
    # numeric: the earlier goes, negative correlation does not count; u and v determine p, u x v is not compared
    assert got == [("q", "p", "nominal"), ("u", "p", "nominal"), ("v", "p", "nominal"), ("x", "y", "numeric")]
    assert association.correlated_columns(df, ["u", "v"], []) == []


def test_cramers_v_of_independent_and_equal(spark):
    df = spark.range(400).select((F.col("id") % 2).cast("string").alias("a"), (F.floor(F.col("id") / 2) % 2).cast("string").alias("b"),
                                 F.lit("k").alias("one"))
    got = {(r.a, r.b): r.v for r in association.cramers_v(df, [("a", "b"), ("a", "a"), ("a", "one")]).collect()}
    assert got == {("a", "b"): 0.0, ("a", "a"): pytest.approx(1.0), ("a", "one"): 0.0}


def test_profile_quality_flags(spark):
    df = spark.range(50).select(F.lit(0).alias("zero"), F.lit(3).alias("three"), "id", F.lit(None).cast("string").alias("none"))
    got = {r.column_name: (r.data_quality, r["count"]) for r in profiling.profile_columns(df).collect()}
    assert got == {"zero": (2, 50), "three": (1, 50), "id": (0, 50), "none": (1, 0)}


def test_profile_finds_text_times(spark):
    df = spark.createDataFrame([("5 Mar 2024 07:08", 20240305, "x"), ("6 Apr 2024 09:10", 20240406, "y")], "t string, n int, s string")
    got = {r.column_name: (r.initial_dtype, r.dtype_for_process) for r in profiling.profile_columns(df).collect()}
    assert got == {"t": ("timestamp", "%d %b %Y %H:%M"), "n": ("timestamp", "%Y%m%d"), "s": ("category", "object")}
    assert roles.percent_layout("yyyyMMdd'T'HHmmss") == "%Y%m%dT%H%M%S"


def test_sample_size_is_exact(spark):
    df = spark.range(500).repartition(3)
    assert reshape.sample_rows(df, 37, ["id"]).distinct().count() == 37
    assert reshape.sample_rows(df, 501, ["id"]).count() == 500


# ---- drift --------------------------------------------------------------------------------

def brute_ks(x, y):
    at = np.sort(np.concatenate([x, y]))
    return np.max(np.abs(np.searchsorted(np.sort(x), at, "right") / len(x) - np.searchsorted(np.sort(y), at, "right") / len(y)))


@pytest.fixture(scope="module")
def halves(spark):
    rng = np.random.default_rng(21)

    def normal(n):
        return rng.permutation([NormalDist().inv_cdf((i + 0.5) / n) for i in range(n)])
    train = pd.DataFrame({"y": rng.choice(list("ABC"), 900), "x": rng.normal(50, 5, 900).round(1), "s": normal(900), "k": 1.0})
    test = pd.DataFrame({"y": rng.choice(list("ABD"), 500), "x": rng.normal(50, 5, 500).round(1), "s": normal(500), "k": 1.0})
    test.loc[test.y == "B", "x"] += 4
    return train, test


@pytest.mark.parametrize("per_range", [50, 10**6])
def test_ordinal_tests_equal_brute_force(spark, halves, per_range):
    train, test = halves
    a, b = spark.createDataFrame(train), spark.createDataFrame(test)
    cells = [("x", "x", "y"), ("s", "s", "y"), ("k", "k", "y")]
    rows = {(r["feature"], r["label"]): r for r in drift.ordinal_tests(a, b, cells, per_range)}
    for f in ("x", "s"):
        for lab in "AB":
            assert rows[f, lab]["ks"] == pytest.approx(brute_ks(train[train.y == lab][f], test[test.y == lab][f]))
    assert rows["x", "B"]["p"] < 0.05 < rows["x", "A"]["p"] and rows["x", "A"]["test"] == "ks"
    assert rows["k", "A"]["identical"] and rows["x", "D"]["n_train"] == 0
    # x: B shifted and D missing in train; k: equal values everywhere are skipped, also for D
    def count(f):
        sides = [(train[train.y == lab][f], test[test.y == lab][f]) for lab in "AB"]
        return 1 + sum(tof.ks_two_sample_p(brute_ks(p, q), len(p), len(q)) < 0.05 for p, q in sides)
    assert drift.label_drift(a, b, cells, per_range) == {"x": (count("x"), 3), "s": (count("s"), 3), "k": (0, 3)}


def test_standard_normal_sides_use_the_t_test(spark, halves):
    train, test = (spark.createDataFrame(t) for t in halves)
    got = {r.feature: (r.test, r.statistic) for r in drift.ordinal_drift(train, test, ["s", "x", "k"]).collect()}
    x, y = halves[0].s, halves[1].s
    pooled = ((len(x) - 1) * x.var() + (len(y) - 1) * y.var()) / (len(x) + len(y) - 2)
    assert got["s"] == ("t", pytest.approx((x.mean() - y.mean()) / np.sqrt(pooled * (1 / len(x) + 1 / len(y)))))
    assert got["x"][0] == "ks" and got["k"] == ("none", 0.0)


def test_nominal_drift_scopes(spark):
    train = spark.createDataFrame([("A", "u"), ("A", "u"), ("B", "v"), ("B", "w")], "y string, c string")
    test = spark.createDataFrame([("A", "u"), ("A", "v"), ("B", "w"), ("B", "z")], "y string, c string")
    table = drift.nominal_drift(train, test, ["c"], "y").first()
    label = drift.nominal_drift(train, test, ["c"], "y", mismatch_scope="label").first()
    assert table.divergence == label.divergence == pytest.approx(0.5)
    assert table.mismatch == pytest.approx(0.25) and label.mismatch == pytest.approx(0.5)


def test_drift_keeps_all_when_all_would_go(spark, halves):
    train, test = (spark.createDataFrame(t) for t in halves)
    far = test.withColumn("x", F.col("x") + 100).withColumn("s", F.col("s") + 100)
    assert drift.drift_filter(train, far, "y", "multiclass", ["x", "s"], []) == []
    assert drift.drift_filter(train, far, "y", "multiclass", ["x", "k"], []) == ["x"]
    assert drift.drift_filter(train, far.drop("y"), "y", "multiclass", ["x", "k"], []) == []


# ---- features -----------------------------------------------------------------------------

def test_step_difference_divides_and_carries(spark):
    rows = [(0, 0.0, 0.0), (1, 10.0, 1.0), (2, 30.0, 3.0), (3, 30.0, 4.0), (4, 70.0, 7.0)]
    df = spark.createDataFrame([(k, t, v, 5.0 - k % 2) for k, t, v in rows], "k int, t double, v double, w double")
    df = df.withColumn("gap", F.when(F.col("k") == 0, 10.0).when(F.col("k") == 1, 10.0).when(F.col("k") == 2, 20.0).when(F.col("k") == 3, 0.0).otherwise(40.0))
    state = features.fit_step_difference(df, ["v", "w"], "gap", ["k"], rows_per_range=2)
    assert state["divide"] == {"v": True, "w": False}
    got = features.apply_step_difference(df.repartition(3), state, rows_per_range=2).orderBy("k").collect()
    np.testing.assert_allclose([r.v_delta for r in got], [0, 0.1, 0.1, 0.1, 0.075])     # no time passed: last rate stays
    assert [r.w_delta for r in got] == [0, -1, 1, -1, 1]


def test_bins_are_right_closed_and_separate_clusters(spark):
    df = spark.createDataFrame([(float(c * 100 + i),) for c in range(3) for i in range(10)] + [(None,)], "x double")
    edges = features.fit_kmeans_bins(df, ["x"], 3)
    assert edges == {"x": [54.5, 154.5 + 0.0]} or edges["x"] == pytest.approx([54.5, 154.5])
    made = features.apply_bins(spark.createDataFrame([(54.5,), (54.6,), (None,), (999.0,)], "x double"), edges)
    assert [r.x_binned for r in made.collect()] == ["0", "1", None, "2"]
    assert features.fit_kmeans_bins(df, ["x"], 30) == {}


def test_yeo_johnson_removes_skew_and_handles_signs(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"x": np.exp(rng.normal(size=1500)) - 1.5, "n": rng.normal(size=1500)}))
    state = features.fit_yeo_johnson(df)
    assert list(state) == ["x"] and state["x"]["factor"] == 1.0
    assert abs(features.apply_yeo_johnson(df, state).agg(F.skewness("x_PT")).first()[0]) < 0.3
    y = features.yeo_johnson(F.col("x"), 2.0)
    got = spark.createDataFrame([(-3.0,), (3.0,)], "x double").select(y.alias("y")).collect()
    assert [r.y for r in got] == pytest.approx([-np.log(4), 7.5])


def test_log_sqrt_round_trip_subtracts_the_shift(spark):
    df = spark.createDataFrame([(float(np.exp(i / 4)) - 5, float(i) ** 0.2) for i in range(40)], "x double, y double")
    state = features.fit_log_sqrt(df, ["x", "y"])
    assert state["log"] == {"x": pytest.approx(4.0)} and list(state["sqrt"]) == ["y"]
    back = features.invert_log_sqrt(features.apply_log_sqrt(df, state), state)
    np.testing.assert_allclose(back.toPandas().values, df.toPandas().values, atol=1e-9)
    missing = features.apply_log_sqrt(spark.createDataFrame([(None, None)], "x double, y double"), state).first()
    assert (missing.x, missing.y) == (-1.0, -1.0)


def test_rare_levels_become_others(spark):
    rows = [("common",)] * 500 + [(f"r{i}",) for i in range(20)] + [("unknown",)]
    df = spark.createDataFrame(rows, "c string")
    keep = features.fit_rare(df, ["c"])
    assert keep == {"c": ["common", "unknown"]}
    out = features.apply_rare(spark.createDataFrame([("common",), ("r1",), ("new",), (None,)], "c string"), keep)
    assert [r.c for r in out.collect()] == ["common", "others", "others", "unknown"]
    assert features.fit_rare(df.filter("c in ('common','r1')"), ["c"]) == {}


@pytest.mark.parametrize("fits", [True, False])
def test_group_aggregates_equal_pandas(spark, fits, monkeypatch):
    monkeypatch.setattr(features, "broadcast_fits", lambda *_: fits)
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": np.where(rng.random(300) < 0.4, "hot", rng.integers(0, 30, 300).astype(str)),
                        "h": rng.integers(0, 5, 300).astype(str), "v": rng.normal(size=300), "i": range(300)})
    got = features.group_aggregates(spark.createDataFrame(pdf), ["g", "h"], ["v"]).toPandas().sort_values("i")
    for c in ("g", "h"):
        for agg in ("max", "min", "mean", "std"):
            np.testing.assert_allclose(got[f"{c}_v_groupBy_{agg}"], pdf.groupby(c)["v"].transform(agg))
    with pytest.raises(ValueError):
        features.group_tables(spark.createDataFrame(pdf), ["g"], ["v"], ["median"])


def test_budget_and_quotients(spark):
    assert features.synthesis_budget(50, 10) and not features.synthesis_budget(60, 10)
    df = spark.createDataFrame([(6.0, 3.0), (6.0, None), (None, 3.0), (None, None), (6.0, 0.0)], "a double, b double")
    got = [r.q for r in df.select(features.column_arithmetic(F.col("a"), F.col("b"))["divide"].alias("q")).collect()]
    assert got == [2.0, float("inf"), 0.0, None, float("inf")]


# ---- encoding, scaling, imputation --------------------------------------------------------

def test_value_maps_literal_and_joined(spark):
    df = spark.createDataFrame([("k3",), ("zz",), (None,)], "c string")
    for size in (10, 500):
        mapping = {f"k{i}": float(i) for i in range(size)}
        assert [r.c for r in encoding.map_values(df, {"c": mapping}).orderBy(F.col("c").desc_nulls_last()).collect()] == [3.0, None, None]
        assert sorted(r.c for r in encoding.map_values(df, {"c": mapping}, default={"c": 9.0}).collect()) == [3.0, 9.0, 9.0]


def test_one_hot_ignores_new_levels(spark):
    levels = encoding.fit_one_hot(spark.createDataFrame([("b",), ("a",)], "c string"), ["c"])
    out = encoding.apply_one_hot(spark.createDataFrame([("a",), ("z",), (None,)], "c string"), levels)
    assert out.columns == ["c_a", "c_b"] and [tuple(r) for r in out.collect()] == [(1, 0), (0, 0), (0, 0)]


def test_sparse_one_hot_of_any_width(spark, monkeypatch):
    df = spark.createDataFrame([("b", "x"), ("a", "y"), ("c", "x")], "c string, d string")
    new = spark.createDataFrame([("c", "x"), ("zz", None), ("a", "y")], "c string, d string")
    for limit in (10, 2):
        monkeypatch.setattr(encoding, "TABLE_LEVELS", limit)
        out = encoding.apply_one_hot_sparse(new, encoding.fit_label_codes(df, ["c", "d"]))
        assert sorted((str(r.c), str(r.d)) for r in out.collect()) == sorted([("(4,[3],[1.0])", "(3,[1],[1.0])"), ("(4,[],[])", "(3,[],[])"), ("(4,[1],[1.0])", "(3,[2],[1.0])")])


def test_label_codes_place_unknown_in_order(spark):
    codes = encoding.fit_label_codes(spark.createDataFrame([("A",), ("Z",)], "c string"), ["c"])
    assert codes == {"c": {"A": 0, "Unknown": 1, "Z": 2}}
    out = encoding.apply_label_codes(spark.createDataFrame([("Z",), ("new",)], "c string"), codes)
    assert [r.c for r in out.collect()] == [2, 1]


def test_wide_columns_are_refused_not_cut(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError, match="combine rare levels"):
        encoding.levels_of(df, ["c"], 20)


@pytest.mark.parametrize("budget", [None, 0])
def test_level_tables_code_like_dictionaries(spark, monkeypatch, budget):
    """A column of any width is coded: with the limit at 5 levels all encoders keep tables, with the codes of the dictionaries."""
    if budget is not None:
        monkeypatch.setattr(lookup, "BROADCAST_BYTES", budget)
    rows = [(f"k{i % 23 if i % 3 else 0}" if i % 11 else None, "few", float(i * 7 % 31), "abc"[i % 3]) for i in range(400)]
    df = spark.createDataFrame(rows, "c string, d string, y double, z string")
    new = spark.createDataFrame([("k3", "few", 0.0), ("k0", "few", 1.0), ("new", "other", 2.0), (None, None, 3.0)], "c string, d string, i double")
    y, hit = F.col("y"), (F.col("y") > 12).cast("double")

    def coded():
        states = [encoding.fit_target(df, ["c", "d"], y), encoding.fit_shrinkage(df, ["c", "d"], y), encoding.fit_shrinkage(df, ["c", "d"], hit, binomial=True)]
        many, codes = encoding.fit_target_multiclass(df, ["c", "d"], "z"), encoding.fit_label_codes(df, ["c", "d"])
        outs = [encoding.apply_target(new, s) for s in states] + [encoding.apply_target_multiclass(new, many), encoding.apply_label_codes(new, codes)]
        turned = encoding.closest_level(new.select(F.col("i").alias("c"), "d").withColumn("c", F.col("c") * 5), {"c": codes["c"]})
        exact = encoding.inverse_value_map(encoding.apply_target(df.select("c", "y"), {"maps": {"c": states[0]["maps"]["c"]}, "default": {}}), {"c": states[0]["maps"]["c"]})
        plain = [[tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in o.collect()] for o in [*outs, turned, exact]]
        return [sorted(rows, key=repr) for rows in plain], states[0]["maps"]

    want, maps = coded()
    assert isinstance(maps["c"], dict)
    monkeypatch.setattr(encoding, "TABLE_LEVELS", 5)
    got, maps = coded()
    assert isinstance(maps["c"], str) and isinstance(maps["d"], dict)
    assert got == want


def test_inverse_map_with_shared_codes():
    assert encoding.inverse_map({"b": 1.0, "a": 1.0, "c": 2.0}) == {1.0: "a", 2.0: "c"}


def test_shrinkage_pulls_small_levels_harder(spark):
    rows = [("big", 10.0 + i % 3) for i in range(90)] + [("small", 20.0), ("small", 22.0)] + [("mid", 5.0 + i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "c string, y double")
    state = encoding.fit_shrinkage(df, ["c"], F.col("y"))
    eff = state["maps"]["c"]
    mean = np.mean([r[1] for r in rows])
    assert 0 < eff["small"] < 21 - mean and eff["mid"] < 0
    assert state["default"]["c"] == eff["big"]


def test_scalers_on_constants(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0)], "x double, k double")
    assert [tuple(r) for r in scaling.apply_standard(df, scaling.fit_standard(df, ["x", "k"])).collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    state = scaling.fit_min_max(df, ["x", "k"])
    assert [tuple(r) for r in scaling.apply_min_max(df, state).collect()] == [(0.0, 0.0), (1.0, 0.0)]


def test_pca_equals_numpy(spark, frame):
    data = frame[["a", "c", "d"]]
    df = spark.createDataFrame(data)
    state = scaling.fit_pca(df, ["a", "c", "d"], 0.8)
    centred = data.values - data.values.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    share = s**2 / (s**2).sum()
    k = int(np.searchsorted(share.cumsum(), 0.8) + 1)
    assert len(state["components"]) == k
    got = np.abs(scaling.apply_pca(df, state).toPandas().values)
    np.testing.assert_allclose(got, np.abs(centred @ vt[:k].T), atol=1e-8)
    with pytest.raises(ValueError):
        scaling.fit_pca(df, ["a"], 1.0)


def test_chained_imputation_recovers_a_line(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"x": rng.normal(size=500), "z": rng.normal(size=500)})
    pdf["y"] = 3 * pdf.x - 2 * pdf.z + 1
    holed = pdf.copy()
    holed.loc[::7, "y"] = None
    holed.loc[3::11, "x"] = None
    df = spark.createDataFrame(holed).select([F.when(~F.isnan(c), F.col(c)).alias(c) for c in holed])
    state = imputation.fit_chained(df, ["x", "z", "y"], rounds=6)
    filled = imputation.apply_chained(df, state).toPandas()
    one = holed.y.isna() & holed.x.notna()
    assert np.abs(filled.y[one] - pdf.y[one]).max() < 0.15
    # state is fitted once: another table is filled from it, not from its own values
    other = imputation.apply_chained(spark.createDataFrame([(1.0, 1.0, None)], "x double, z double, y double"), state).first()
    assert other.y == pytest.approx(2.0, abs=0.15)


def plain_chain(x, rounds, ridge):
    """Chained regressions over whole rows: fill by the equations so far, fit each holed column on all others."""
    gone = np.isnan(x)
    means = np.nan_to_num(np.nanmean(x, 0))
    holes = sorted((i for i in range(x.shape[1]) if gone[:, i].any()), key=lambda i: gone[:, i].sum())
    equations = {}

    def filled():
        out = np.where(gone, means, x)
        for c in holes:
            if c in equations:
                out[gone[:, c], c] = (out @ equations[c][1:] + equations[c][0])[gone[:, c]]
        return out
    for _ in range(rounds):
        for c in holes:
            z = filled()[~gone[:, c]]
            others = [i for i in range(x.shape[1]) if i != c and z[:, i].std() > 1e-9]
            centred = (z[:, others] - z[:, others].mean(0)) / z[:, others].std(0)
            w = np.linalg.solve(centred.T @ centred / len(z) + ridge * np.eye(len(others)), centred.T @ (z[:, c] - z[:, c].mean()) / len(z)) / z[:, others].std(0)
            b = np.zeros(x.shape[1] + 1)
            b[1:][others] = w
            b[0] = z[:, c].mean() - z[:, others].mean(0) @ w
            equations[c] = b
    return filled(), len(holes)


@pytest.mark.parametrize("on_driver", [True, False])
def test_chained_imputation_equals_whole_rows(spark, on_driver, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 6))
    x[:, 1] += 2 * x[:, 0]
    x[:, 3] = 1000 + x[:, 1] - x[:, 2] + 0.1 * rng.normal(size=400)
    x[:, 5] = 7.0
    x[rng.random((400, 6)) < [0.3, 0.1, 0.2, 0.05, 0, 0.1]] = np.nan
    if not on_driver:
        monkeypatch.setattr(imputation, "PATTERN_BYTES", 0)
        monkeypatch.setattr(imputation, "TASK_BYTES", 1)
    names = [f"c {i}" for i in range(6)]
    df = spark.createDataFrame([(n, *[None if np.isnan(v) else float(v) for v in r]) for n, r in enumerate(x)], "n int, " + ", ".join(f"`{c}` double" for c in names)).repartition(5)
    want, holes = plain_chain(x, 3, 1e-6)
    state = imputation.fit_chained(df, names, rounds=3, tolerance=0.0)
    got = imputation.apply_chained(df, state).orderBy("n").toPandas()[names].to_numpy()
    np.testing.assert_allclose(got, want, atol=1e-6)
    assert len(state["equations"]) == holes


def test_chained_imputation_of_an_empty_column(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.0, None), (3.0, None, None), (float("inf"), 8.0, None)], "a double, b double, c double")
    state = imputation.fit_chained(df, ["a", "b", "c"], ridge=0.0)
    got = imputation.apply_chained(df, state).collect()
    assert got[2].b == pytest.approx(6.0, abs=0.2) and got[3].a == pytest.approx(4.0, abs=0.2) and all(r.c == 0.0 for r in got)


def test_constant_imputation_modes(spark):
    df = spark.createDataFrame([(1.0, "b"), (1.0, "a"), (4.0, None), (None, "a"), (None, "b")], "x double, c string")
    assert imputation.fit_constants(df, method="mode", nominal_method="mode") == {"x": 1.0, "c": "a"}
    assert imputation.fit_constants(df, method="median") == {"x": 1.0, "c": "unknown"}
    assert imputation.apply_constants(df, imputation.fit_constants(df)).collect()[3].x == 2.0


def test_null_strata_are_kept(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else "a", i % 2) for i in range(100)], "id int, s string, t int")
    first, second = reshape.split(df, 0.2, ["id"], stratify=["s", "t"])
    assert first.count() + second.count() == 100 and second.filter("s is null").count() == 5


def test_keys_must_match_one_to_one(spark):
    a = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "k int, x int")
    for keys in ([1, 2, 4], [1, 2, 2], [1, 2, None]):
        with pytest.raises(ValueError, match="2031"):
            reshape.label_combine(a, spark.createDataFrame([(k, 0) for k in keys], "k int, y int"), "k")
    assert reshape.label_combine(a, spark.createDataFrame([(k, 0) for k in (3, 1, 2)], "k int, y int"), "k").count() == 3


def test_spearman_is_pairwise(spark):
    rng = np.random.default_rng(3)
    data = pd.DataFrame({"a": rng.normal(size=200).round(1), "b": rng.normal(size=200), "c": rng.normal(size=200)})
    data["b"] += data["a"]
    data.loc[::2, "c"] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in data.to_numpy()], "a double, b double, c double")
    got, want = association.spearman(df, ["a", "b", "c"]), data.corr("spearman")
    assert all(v == pytest.approx(want.loc[p]) for p, v in got.items())


def holed_frame(n=700, seed=8):
    """Columns that share null masks, columns with their own, ties, a constant and one without any value."""
    rng = np.random.default_rng(seed)
    a = rng.normal(size=n)
    data = pd.DataFrame({"a": a, "b": a + rng.normal(size=n) * 0.2, "c": np.where(np.arange(n) % 3 == 0, -5 * a, a), "d": rng.integers(0, 5, n).astype(float),
                         "e": rng.normal(size=n) + a, "f": np.exp(a), "k": 4.0, "none": np.nan})
    data.loc[np.arange(n) % 3 == 0, ["a", "f"]] = np.nan
    data.loc[np.arange(n) % 7 == 0, "b"] = np.nan
    data.loc[rng.random(n) < 0.3, "d"] = np.nan
    return data


def as_table(spark, data):
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in data.to_numpy()]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(5)


def test_null_groups(spark):
    data = holed_frame()
    got = ranks.null_groups(as_table(spark, data))
    masks = [tuple(data[c].isna()) for c in data]
    assert [[x == y for y in got] for x in got] == [[x == y for y in masks] for x in masks]
    assert got[list(data).index("c")] == got[list(data).index("k")] == 0


@pytest.mark.parametrize("together", [20, 2])
def test_pairwise_spearman_of_many_columns(spark, together, monkeypatch):
    monkeypatch.setattr(ranks, "COLUMNS_TOGETHER", together)
    monkeypatch.setattr(ranks, "FEW_PAIRS", 40 if together == 20 else 0)
    data = holed_frame()
    got, want = association.spearman(as_table(spark, data), list(data), rows_per_range=200), data.corr("spearman")
    assert len(got) == 28
    for pair, r in got.items():
        assert (r is None) == np.isnan(want.loc[pair]) and (r is None or r == pytest.approx(want.loc[pair], abs=1e-9)), pair


@pytest.mark.parametrize("bins,block", [(200, 2000), (8, 2000), (8, 3)])
def test_rank_bounds_hold(spark, bins, block, monkeypatch):
    monkeypatch.setattr(ranks, "BLOCK_COLUMNS", block)
    data = holed_frame()
    want = data.corr("spearman").to_numpy()
    seen = set()
    for part in ranks.rank_bounds(as_table(spark, data), list(data), bins):
        for i, a in enumerate(part.left):
            for j, b in enumerate(part.right):
                seen.add((min(a, b), max(a, b)))
                if np.isnan(want[a, b]):
                    assert not part.high[i, j] > 0.0 or bins == 8
                else:
                    assert part.low[i, j] - 1e-9 <= abs(want[a, b]) <= part.high[i, j] + 1e-9
                    assert abs(part.estimate[i, j] - want[a, b]) < (5e-3 if bins == 200 else 0.2)
    assert len(seen) == 36


def test_candidate_verdicts_do_not_depend_on_width(spark):
    data = holed_frame()
    want = data.corr("spearman").abs()
    df = as_table(spark, data)
    verdicts = {}
    for cols in (["a", "c"], ["a", "c", "b", "d", "e"], ["a", "c", "b", "d", "e", "f", "k", "none"]):
        kept = association.candidate_filter(df, cols[1:], cols[:1], threshold=0.9)
        assert kept == [c for n, c in enumerate(cols) if n and not any(want.loc[b, c] > 0.9 for b in cols[:n])]
        verdicts[len(cols)] = "c" in kept
    # b is a copy of a where both are there, whatever stands elsewhere
    assert set(verdicts.values()) == {False}


def test_null_shares_count_as_drift(spark):
    train = spark.createDataFrame([("x",)] * 10, "c string")
    test = spark.createDataFrame([("x",)] * 5 + [(None,)] * 5, "c string")
    row = drift.nominal_drift(train, test, ["c"]).first()
    assert (row.divergence, row.mismatch) == (0.25, 0.0)


def test_clocks_without_zone_ignore_the_session(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("select timestamp_ntz'2024-03-10 00:00:00' a, timestamp_ntz'2024-03-11 00:00:00.25' b, "
                       "timestamp'2024-03-10 00:00:00' c, timestamp'2024-03-11 00:00:00' d")
        row = features.timestamp_differences(df, ["a", "b"]).first()
        assert row.a_sub_b == 86400.25
        assert features.timestamp_differences(df, ["c", "d"]).first().c_sub_d == 82800
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_levels_are_found_by_search(spark):
    df = spark.createDataFrame([(0.0,), (1.4,), (1.6,), (9.0,), (None,), (1.5,)], "c double")
    maps = {"c": {"b": 1.0, "a": 2.0, "z": 2.0}}
    assert [r.c for r in encoding.closest_level(df, maps).collect()] == ["b", "b", "a", "a", None, "a"]
    exact = spark.createDataFrame([(1.0 + 1e-12,), (1.1,), (2.0,)], "c double")
    assert [r.c for r in encoding.inverse_value_map(exact, maps).collect()] == ["b", None, "a"]
    assert encoding.inverse_value_map(df, {"c": {}}).filter("c is not null").count() == 0


# ---- mergeable profiles and the overlay of two tables --------------------------------------

def test_states_merge_in_any_grouping(spark, tmp_path):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"i": rng.integers(0, 700, 2000), "x": np.where(rng.random(2000) < 0.1, np.nan, 1e9 + rng.normal(size=2000)),
                        "s": rng.integers(0, 5000, 2000).astype(str)})
    df = spark.createDataFrame(pdf).withColumn("none", F.lit(None).cast("double")).withColumn("part", F.pmod(F.col("i"), F.lit(4)))
    parts = [merging.profile_state(df.filter(F.col("part") == p), ["i", "x", "s", "none"]) for p in (0, 1, 2, 3, 9)]   # 9: no rows
    for n, part in enumerate(parts):
        merging.write_state(part, f"{tmp_path}/{n}")
    every = merging.merge_states(merging.read_states(spark, [f"{tmp_path}/{n}" for n in range(5)]))
    pair = merging.merge_states(parts[0].union(parts[1]))
    nested = merging.merge_states(pair.union(merging.merge_states(parts[2].union(parts[3]))).union(parts[4]))
    whole = merging.state_profile(merging.profile_state(df, ["i", "x", "s", "none"])).toPandas().set_index("column_name")
    for merged in (every, nested):
        got = merging.state_profile(merged).toPandas().set_index("column_name").loc[whole.index]
        np.testing.assert_allclose(got["nunique"], whole["nunique"], rtol=0.05)  # estimates depend on the grouping, within the error
        for c in ("n_missing", "count", "min_text", "max_text", "min_value", "max_value"):
            assert got[c].astype(object).where(got[c].notna(), None).tolist() == whole[c].astype(object).where(whole[c].notna(), None).tolist()
        np.testing.assert_allclose(got["std"].astype(float), whole["std"].astype(float), rtol=1e-6)
    assert abs(whole.loc["i", "nunique"] / pdf["i"].nunique() - 1) < 0.06 and whole.loc["none", "nunique"] == 0
    assert whole.loc["x", "std"] == pytest.approx(pdf["x"].std(), rel=1e-6)


def test_overlay_equals_plain_kernels(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=300), rng.normal(2, 3, size=200)
    first = spark.createDataFrame(pd.DataFrame({"dataset": a, "one": 1.0})).union(spark.createDataFrame([(None, 1.0), (float("nan"), 1.0)], "dataset double, one double"))
    second = spark.createDataFrame(pd.DataFrame({"dataset": b, "one": 1.0}))
    got = profiling.kde_overlay(first.repartition(3), second, ["dataset", "one"], 15).toPandas()
    assert set(got["feature"]) == {"dataset"}                                   # a constant has no density; the name clashes with the tag
    grid = np.linspace(min(a.min(), b.min()), max(a.max(), b.max()), 15)
    for name, x in (("train", a), ("test", b)):
        h = x.std(ddof=1) * len(x) ** -0.2
        want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
        mine = got[got["dataset"] == name].sort_values("point")
        np.testing.assert_allclose(mine["density"], want, rtol=1e-9)
        np.testing.assert_allclose(mine["position"], grid)
    assert profiling.kde_overlay(first.limit(0), second, ["dataset"]).count() == 0


def test_two_table_report(spark):
    df = spark.range(400).select("id", (F.col("id") % 17).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("s"))
    same = reports.eda_compare_report(df, df, ["id"], points=5)
    assert {r.section for r in same.select("section").distinct().collect()} == {"rows", "patterns", "levels", "overlay"}
    far = df.withColumn("x", F.col("x") + 100)
    log = reports.eda_compare_report(df, far, ["id"], points=5, trees=5).filter("section = 'adversarial'").toPandas()
    first = log[log["position"] == 0]
    assert first[first["stat"] == "auc"]["value"].item() == 1.0 and first[first["stat"] == "removed"]["feature"].item() == "x"
    assert set(first[first["stat"] == "importance"]["feature"]) == {"x", "s"}
    with pytest.raises(ValueError, match="differ"):
        reports.eda_compare_report(df, df.drop("x"), ["id"])


def test_unequal_tables_are_told_apart_without_moving_rows(spark, monkeypatch):
    df = spark.createDataFrame([(1, 0.0, "a", [1]), (2, float("nan"), None, None), (2, float("nan"), None, None), (3, None, "b", [2])], "id int, x double, s string, l array<int>")
    same = df.select(F.col("id").cast("long").alias("id"), F.when(F.col("x") == 0, F.lit(-0.0)).otherwise(F.col("x")).alias("x"), "s", "l").repartition(3)
    assert reshape.frames_equal(df, same) and reshape.frames_equal(df.limit(0), df.limit(0)) and not reshape.frames_equal(df, df.limit(0))
    # moved values keep every column's counts; a doubled row keeps the distinct ones
    moved = df.withColumn("s", F.when(F.col("id") == 1, "b").when(F.col("id") == 3, "a"))
    asked = []
    monkeypatch.setattr(reshape, "frames_differ", lambda a, b: asked.append(1) or a.limit(0))
    assert not reshape.frames_equal(df, moved) and not reshape.frames_equal(df, df.union(df.limit(1))) and not asked
    assert reshape.frames_equal(df, same) and asked == [1]          # equal sums prove nothing


def test_adversarial_rounds_keep_no_key(spark, monkeypatch):
    df = spark.range(600).select("id", (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    kept, plain = [], type(df).persist
    monkeypatch.setattr(type(df), "persist", lambda self, *a: kept.append(self.columns) or plain(self, *a))
    log = modeling.adversarial_validation(df, df.withColumn("x", F.col("x") + 4), ["x", "y"], ["id"], trees=5, max_rounds=2)
    assert log[0]["feature"] == "x" and log[0]["removed"] and 0.6 < log[0]["auc"] < 1.0
    assert kept and not any("id" in cols for cols in kept)


# ---- scans that read their rows once ------------------------------------------------------

def test_wide_decoding_scans_stored_rows(spark, monkeypatch):
    levels = spark.range(50).selectExpr("CONCAT('v', id) AS level", "1L AS n", "id AS v0")
    stored = encoding.store_levels(levels) + "#v0"
    plans = []

    def watched(rows, *args, **options):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return real(rows, *args, **options)

    real = encoding.ordered_scan
    monkeypatch.setattr(encoding, "ordered_scan", watched)
    df = spark.range(60).select("id", F.col("id").cast("double").alias("c"))
    found = {r.id: r.c for r in encoding.inverse_value_map(df, {"c": stored}).collect()}
    assert found == {i: f"v{i}" if i < 50 else None for i in range(60)}
    # neither scan runs the table or the other scan again
    assert len(plans) == 2 and not any("Range (" in p or "Window" in p for p in plans)


def test_step_difference_takes_a_cut_made_before(spark, monkeypatch):
    from colsmith.functions import ordered

    rows = [(i, float(i // 3), float(i * i % 17), float(i // 3 - (i - 1) // 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "rid long, t double, x double, gap double")
    state = {"ruler": "gap", "divide": {"x": True}, "order_by": ["t", "rid"], "partition_by": []}
    want = sorted(map(tuple, features.apply_step_difference(df, state).collect()))
    cut = range_cut(df, ["t", "rid"], 5)
    assert cut.ranges > 1

    def refuse(*args, **options):
        raise AssertionError("the order is cut once")
    monkeypatch.setattr(ordered, "range_cut", refuse)
    monkeypatch.setattr(features, "range_cut", refuse)
    assert sorted(map(tuple, features.apply_step_difference(df, state, cut=cut).collect())) == want


def test_modal_gap_equals_that_of_all_rows(spark):
    """From distinct times alone: equal times are 0 apart, nulls have no gap, of equal counts the smallest gap wins."""
    rng = np.random.default_rng(11)
    for step, size in ((60, 40), (7, 4000), (1, 90)):
        pdf = pd.DataFrame({"rid": range(400), "at": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, size, 400) * step, unit="s")})
        df = spark.createDataFrame(pdf).withColumn("at", F.when(F.col("rid") % 9 > 0, F.col("at")))
        rows = features.time_delta(df, "at", ["at", "rid"], fill=float("nan"))
        wanted = features.modal_value(rows.filter(~F.isnan("at_delta")), "at_delta")
        assert features.modal_gap(df, "at", rows_per_range=50) == wanted
    assert features.modal_gap(df.filter("rid < 0"), "at") is None


def test_pair_counts_of_rows_that_agree(spark, monkeypatch):
    """Rows with the same levels in all columns are counted before they fan out to pairs; the counts are those of the rows."""
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({c: rng.choice(list("pqrs")[:k] + [None], 2000) for c, k in (("a", 2), ("b", 3), ("c", 4))})
    df = spark.createDataFrame(pdf, "a string, b string, c string")
    pairs = [("a", "b"), ("a", "c"), ("b", "c")]
    made = association.pair_counts(df, pairs)
    got = {(r.a, r.b, r.u, r.v): r.n for r in made.collect()}
    want = {(x, y, u, v): n for x, y in pairs for (u, v), n in pdf.dropna(subset=[x, y]).groupby([x, y]).size().items()}
    assert got == want
    # two aggregates, one before the pairs
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2
