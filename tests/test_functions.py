"""Scale paths of the building blocks, forced on small data and compared with brute force."""
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colsmith.functions import tests_of_fit as tof
from colsmith.functions.lookup import broadcast_fits, level_lookup
from colsmith.functions.ordered import average_ranks, ordered_scan, range_cut, range_id, split_points
from colsmith.functions.quantiles import exact_quantiles, value_at_rank


def series(n=600, seed=1):
    rng = np.random.default_rng(seed)
    # a third of all rows belong to one entity
    ent = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 40, n))
    val = np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n).round(3))
    return pd.DataFrame({"ent": ent, "ts": rng.permutation(n) // 3, "rid": np.arange(n), "v": val, "w": rng.integers(0, 9, n)})


@pytest.mark.parametrize("per_range", [10, 37, 10_000])
@pytest.mark.parametrize("entity", [["ent"], []])
def test_ordered_scan_equals_pandas(spark, per_range, entity):
    pdf = series()
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(5)
    got = ordered_scan(df, ["ts", "rid"], entity, lag={"prev": "w"}, running={"cum": "w"}, fill={"seen": "v"}, row_number="rn",
                       rows_per_range=per_range).toPandas().sort_values("rid").reset_index(drop=True)
    want = pdf.sort_values([*entity, "ts", "rid"])
    groups = want.groupby(entity) if entity else want.groupby(lambda _: 0)
    want = want.assign(prev=groups["w"].shift(1), cum=groups["w"].cumsum(), seen=groups["v"].ffill(), rn=groups.cumcount() + 1)
    want = want.sort_values("rid").reset_index(drop=True)
    for c in ("prev", "cum", "seen", "rn"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), err_msg=c)


def test_ranges_split_a_hot_entity_and_use_two_levels(spark):
    df = spark.createDataFrame(series(4000))
    bounds = split_points(df, ["ent", "ts", "rid"], 40)
    assert len(bounds) > 64                                     # more than one literal array
    sizes = df.groupBy(range_id(df, ["ent", "ts", "rid"], bounds).alias("r")).count().toPandas()
    assert sizes["r"].between(0, len(bounds)).all()
    assert sizes["count"].max() < 4000 / 10                     # the hot third is spread
    order = df.withColumn("r", range_id(df, ["ent", "ts", "rid"], bounds)).toPandas().sort_values(["ent", "ts", "rid"])
    assert order["r"].is_monotonic_increasing


def test_average_ranks(spark):
    pdf = pd.DataFrame({"x": np.random.default_rng(3).integers(0, 50, 500).astype(float)})
    counts = spark.createDataFrame(pdf).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    got = {r["x"]: r["avg_rank"] for r in average_ranks(counts, "x", rows_per_range=7).collect()}
    want = pdf["x"].rank()
    assert all(got[x] == r for x, r in zip(pdf["x"], want))


QUANTILE_TABLES = {
    "continuous": lambda r: r.normal(size=3000),
    "heavy ties": lambda r: np.where(r.random(3000) < 0.6, 5.0, r.normal(size=3000)),
    "integers": lambda r: r.integers(0, 6, 3000).astype(float),
    "one value": lambda r: np.full(3000, 2.5),
    "long tail": lambda r: np.exp(r.normal(size=3000) * 6),
}


@pytest.mark.parametrize("name", QUANTILE_TABLES)
@pytest.mark.parametrize("small", [5, 200_000])
def test_exact_quantiles(spark, name, small):
    values = QUANTILE_TABLES[name](np.random.default_rng(5))
    df = spark.createDataFrame(pd.DataFrame({"x": values, "y": -values}))
    probs = [0.0, 0.01, 0.25, 0.5, 0.937, 1.0]
    got = exact_quantiles(df, ["x", "y"], probs, small)
    np.testing.assert_allclose(got["x"], np.quantile(values, probs), rtol=1e-12)
    np.testing.assert_allclose(got["y"], np.quantile(-values, probs), rtol=1e-12)


def test_quantiles_skip_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (float("nan"),)], "x double").withColumn("none", F.lit(None).cast("double"))
    assert exact_quantiles(df, ["x", "none"], [0.5]) == {"x": [2.0], "none": [None]}


@pytest.mark.parametrize("rank", [0, 1, 1234, 2998, 2999])
def test_value_at_rank(spark, rank):
    values = np.random.default_rng(8).normal(size=3000)
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    assert value_at_rank(df, "x", rank, small=9) == np.sort(values)[rank]
    assert value_at_rank(df, "x", 3000) is None


@pytest.mark.parametrize("small", [True, False])
def test_level_lookup_with_copies_and_nulls(spark, small):
    # half of the rows are copies of one row; some keys are null or unseen
    rows = [("hot", 1)] * 500 + [(f"k{i}", i) for i in range(400)] + [(None, 7), ("new", 8)]
    df = spark.createDataFrame(rows, "k string, x int")
    levels = df.filter(F.col("k").isNotNull() & (F.col("k") != "new")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"))
    out = level_lookup(df, levels, "k", "n", len(rows), small).toPandas()
    assert len(out) == len(rows)
    assert (out[out.k == "hot"].s == 500).all() and (out.k == "hot").sum() == 500
    assert out[out.k.isna() | (out.k == "new")].s.isna().all()
    assert (out[out.k.fillna("").str.startswith("k")].s == out[out.k.fillna("").str.startswith("k")].x).all()


def test_broadcast_budget():
    assert broadcast_fits(10_000, 20) and not broadcast_fits(10_000_000, 20)


# ---- p-values: published table values -----------------------------------------------------

def test_known_p_values():
    assert tof.kolmogorov_tail(1.3581) == pytest.approx(0.05, abs=1e-4)
    assert tof.kolmogorov_tail(1.6276) == pytest.approx(0.01, abs=1e-4)
    assert tof.kolmogorov_tail(0.1) == 1.0
    t, p = tof.student_t(11, 2.228, 0.0, 11, 0.0, 0.0)
    assert p == 0.0 and math.isinf(t)
    # t = 2.0860 with 20 degrees of freedom is the 5 % point
    assert tof.incomplete_beta(10, 0.5, 20 / (20 + 2.08596 ** 2)) == pytest.approx(0.05, abs=1e-5)
    high, low = tof.binomial_tails(8, 10)
    assert high == pytest.approx(56 / 1024) and low == pytest.approx(1013 / 1024)


@settings(max_examples=50, deadline=None)
@given(st.floats(0.05, 40), st.floats(0.05, 40), st.floats(0.001, 0.999))
def test_incomplete_beta_symmetry(a, b, x):
    assert tof.incomplete_beta(a, b, x) + tof.incomplete_beta(b, a, 1 - x) == pytest.approx(1.0, abs=1e-9)


def test_normal_cdf_column(spark):
    df = spark.createDataFrame([(x / 4,) for x in range(-16, 17)], "x double")
    got = tof.with_normal_cdf(df, F.col("x"), "p", F.lit(True)).collect()
    for r in got:
        assert r["p"] == pytest.approx(0.5 * (1 + math.erf(r["x"] / math.sqrt(2))), abs=2e-7)


@pytest.mark.parametrize("n,m", [(1, 1), (1, 4), (3, 3), (3, 5), (4, 6), (6, 6), (5, 7)])
def test_two_sample_distances_by_enumeration(n, m):
    """Every order of the two samples is equally likely."""
    from itertools import combinations
    found = []
    for first in combinations(range(n + m), n):
        i = j = 0
        most = 0.0
        for at in range(n + m):
            i, j = (i + 1, j) if at in first else (i, j + 1)
            most = max(most, abs(i / n - j / m))
        found.append(most)
    for d in {round(v, 12) for v in found}:
        want = sum(v >= d - 1e-9 for v in found) / len(found)
        assert tof.ks_two_sample_p(d, n, m) == pytest.approx(want, abs=1e-12) and tof.ks_two_sample_p(d, m, n) == pytest.approx(want, abs=1e-12)


def test_critical_distances_of_published_tables():
    # two samples of equal size, 5 %: the least numerator k with P(D >= k / n) <= 0.05
    for n, k in ((5, 5), (8, 6), (10, 7), (15, 8), (20, 9), (25, 10), (30, 11), (40, 13)):
        assert tof.ks_two_sample_p(k / n, n, n) <= 0.05 < tof.ks_two_sample_p((k - 1) / n, n, n)
    # one sample, 5 %: three published digits
    for n, d in ((5, 0.563), (10, 0.409), (20, 0.294), (50, 0.188), (100, 0.134)):
        assert tof.ks_one_sample_p(d, n) == pytest.approx(0.05, abs=0.002)
    assert tof.ks_one_sample_p(0.274, 10) == pytest.approx(1 - 0.6284796154565, abs=1e-9)
    # both forms meet where they change over
    for n in (900, 2000):
        assert tof.ks_two_sample_p(1.3 / math.sqrt(n / 2), n, n) == pytest.approx(tof.kolmogorov_tail(1.3), abs=0.01)
    assert tof.ks_one_sample_p(1.2 / math.sqrt(1000), 1000) == pytest.approx(tof.kolmogorov_tail(1.2), abs=0.01)
    assert tof.ks_two_sample_p(0.0, 7, 9) == 1.0 and tof.ks_one_sample_p(0.0, 7) == 1.0


@pytest.mark.parametrize("entity", [["ent"], []])
def test_fine_ranges_and_carries_in_blocks(spark, entity):
    """Bounds in two levels, a stored table below literals: the same results, sizes of entities too."""
    pdf = series(3000)
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(4)
    df = df.withColumn("ent", F.when(F.col("ent") > 0, F.col("ent")))               # null is an entity of its own, and the hot one
    cut = range_cut(df, [*entity, "ts", "rid"], 10, coarse=6)
    assert cut.fine and cut.ranges > 150 and len(cut.bounds) <= 6
    placed = cut.mark(df, "rg").toPandas().sort_values([*entity, "ts", "rid"], na_position="first")
    assert placed["rg"].is_monotonic_increasing and placed["rg"].value_counts().max() < 60
    got = ordered_scan(df, ["ts", "rid"], entity, lag={"prev": "w"}, running={"cum": "w"}, fill={"seen": "v"}, row_number="rn", size="n",
                       cut=cut).toPandas().sort_values("rid").reset_index(drop=True)
    want = pdf.sort_values([*entity, "ts", "rid"])
    groups = want.groupby(entity) if entity else want.groupby(lambda _: 0)
    want = want.assign(prev=groups["w"].shift(1), cum=groups["w"].cumsum(), seen=groups["v"].ffill(), rn=groups.cumcount() + 1,
                       n=groups["rid"].transform("size")).sort_values("rid").reset_index(drop=True)
    for c in ("prev", "cum", "seen", "rn", "n"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), err_msg=c)


def test_a_cut_serves_one_order_only(spark):
    df = spark.createDataFrame(series(50))
    with pytest.raises(ValueError, match="not by"):
        ordered_scan(df, ["rid"], row_number="n", cut=range_cut(df, ["ts", "rid"]))


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 600])
def test_range_search_counts_the_bounds_not_above(spark, n):
    from bisect import bisect_right

    from colsmith.functions import ordered

    df = spark.range(300).selectExpr("CAST(id % 5 AS STRING) AS a", "CAST(id * 37 % 211 AS DOUBLE) AS b")
    df = df.unionByName(spark.createDataFrame([(None, 1.0), ("3", None), ("9", float("nan"))], "a string, b double"))
    bounds = [(str(i // 130), float(i % 130)) for i in range(n)]
    keys = [ordered._sort_key(b) for b in bounds]
    place = range_id(df, ["a", "b"], bounds)
    assert all(r.r == bisect_right(keys, ordered._sort_key((r.a, r.b))) for r in df.select("a", "b", place.alias("r")).collect())
    # no level compares a key with more than a few bounds
    assert ordered._STEP <= 16


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 65, 600])
def test_compiled_range_search_counts_the_bounds_not_above(spark, n):
    from bisect import bisect_right

    from colsmith.functions import ordered

    df = spark.range(300).selectExpr("CAST(id % 5 AS STRING) AS a", "CAST(id * 37 % 211 AS DOUBLE) AS b")
    df = df.unionByName(spark.createDataFrame([(None, 1.0), ("3", None), ("9", float("nan")), (None, None)], "a string, b double"))
    bounds = [(None, 0.5), *[(str(i // 130), float(i % 130)) for i in range(n)]][:n]
    keys = [ordered._sort_key(b) for b in bounds]
    found = ordered.RangeCut(("a", "b"), tuple(bounds), None, n + 1).mark(df, "r")
    assert found.columns == ["a", "b", "r"] and found.schema["r"].dataType.typeName() == "long"
    assert all(r.r == bisect_right(keys, ordered._sort_key((r.a, r.b))) for r in found.collect())
    # functions of array elements are interpreted row by row
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan.lower()
