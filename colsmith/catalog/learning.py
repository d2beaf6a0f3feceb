"""Feature choice, models, metrics and the composite flows."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import modeling, selection
from ..plans import preparation, regression_prep, reports
from ..session import table
from .registry import TEST_SQL, TRAIN_SQL, line_halves, register, rounded


def _signals(spark, d):
    """Lineitem with a label that depends on quantity and discount, and noise columns."""
    lines = table(spark, d, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    flag = F.when(F.col("l_quantity") * (1 - 4 * F.col("l_discount")) > 18, "high").otherwise("low")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                        net.alias("net"), flag.alias("flag"))


@register("importance_select")
def importance_select(spark, d):
    data = _signals(spark, d)
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    weights = selection.importances(data, cols, "flag", "binary", trees=20, boosts=5)
    kept = set(selection.importance_select(weights))
    return spark.createDataFrame([(c, w, c in kept) for c, w in weights.items()], "feature string, weight double, kept boolean")


@register("target_corr_select", """
WITH x AS (SELECT l_extendedprice * (1 - l_discount) AS y, l_quantity a, l_extendedprice b, l_quantity * l_extendedprice p, l_extendedprice * 2 q,
  l_discount * l_extendedprice r, sqrt(l_extendedprice) + l_tax * 500 s FROM lineitem),
c AS (SELECT 'p' AS feature, abs(corr(p, y)) AS r, greatest(abs(corr(p, a)), abs(corr(p, b))) AS n FROM x
 UNION ALL SELECT 'q', abs(corr(q, y)), greatest(abs(corr(q, a)), abs(corr(q, b))) FROM x
 UNION ALL SELECT 'r', abs(corr(r, y)), greatest(abs(corr(r, a)), abs(corr(r, b))) FROM x
 UNION ALL SELECT 's', abs(corr(s, y)), greatest(abs(corr(s, a)), abs(corr(s, b))) FROM x)
SELECT feature, round(r, 6) AS r FROM c WHERE n <= 0.9 AND r >= 0.3""")
def target_corr_select(spark, d):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    data = table(spark, d, "lineitem").select((p * (1 - F.col("l_discount"))).alias("y"), q.alias("a"), p.alias("b"), (q * p).alias("p"),
                                              (p * 2).alias("q"), (F.col("l_discount") * p).alias("r"), (F.sqrt(p) + F.col("l_tax") * 500).alias("s"))
    found = selection.target_corr_select(data, ["p", "q", "r", "s"], ["a", "b"], "y")
    return rounded(spark.createDataFrame(found, "feature string, r double"), 6)


@register("boruta_select")
def boruta_select(spark, d):
    found = selection.boruta_select(_signals(spark, d), ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], "flag", "binary",
                                    ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
    return spark.createDataFrame(list(found.items()), "feature string, verdict string")


# ---- metrics on deterministic predictions -------------------------------------------------

PREDICTED = "(SELECT l_extendedprice AS y, l_extendedprice * 0.9 + (l_linenumber - 4) * 100 + 2000 AS p FROM lineitem)"


@register("regression_metrics", f"""
SELECT round(1 - avg(pow(y - p, 2)) / var_pop(y), 3) AS r2, round(avg(pow(y - p, 2)), 3) AS mse, round(sqrt(avg(pow(y - p, 2))), 3) AS rmse,
 round(avg(abs(y - p)), 3) AS mae, round(sqrt(avg(pow(ln(1 + p) - ln(1 + y), 2))), 3) AS rmsle FROM {PREDICTED}""")
def regression_metrics(spark, d):
    price = F.col("l_extendedprice")
    scored = table(spark, d, "lineitem").select(price.alias("y"), (price * 0.9 + (F.col("l_linenumber") - 4) * 100 + 2000).alias("p"))
    return modeling.regression_metrics(scored, "y", "p")


GUESS = "(SELECT l_returnflag AS y, CASE WHEN l_linenumber = 2 THEN 'N' WHEN l_quantity > 45 THEN 'A' ELSE l_returnflag END AS p FROM lineitem)"


def _guesses(spark, d):
    guess = F.when(F.col("l_linenumber") == 2, "N").when(F.col("l_quantity") > 45, "A").otherwise(F.col("l_returnflag"))
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("y"), guess.alias("p"))


@register("classification_metrics", f"""
SELECT count(*) AS n, round(avg((y = p)::INT), 6) AS accuracy, round(1 - avg((y = p)::INT), 6) AS error FROM {GUESS}""")
def classification_metrics(spark, d):
    return rounded(modeling.classification_metrics(_guesses(spark, d), "y", "p"), 6)


@register("confusion_matrix", f"""
SELECT coalesce(y, 'Total') AS actual, count(*) FILTER (p = 'A') AS "A", count(*) FILTER (p = 'N') AS "N", count(*) FILTER (p = 'R') AS "R",
 printf('%.1f %%', 100 * (1 - avg((y = p)::INT))) AS error FROM {GUESS} GROUP BY GROUPING SETS ((y), ())""")
def confusion_matrix(spark, d):
    return modeling.confusion_matrix(_guesses(spark, d), "y", "p", ["A", "N", "R"])


@register("best_threshold", """
WITH s AS (SELECT l_extendedprice / 1000 + CASE WHEN l_quantity > 25 THEN 5 ELSE 0 END AS t, (l_quantity * 1000 + l_extendedprice > 70000)::INT AS y FROM lineitem),
g AS (SELECT t, sum(y) p, sum(1 - y) q FROM s GROUP BY t),
c AS (SELECT t, (sum(p) OVER () - sum(p) OVER (ORDER BY t) + p + sum(q) OVER (ORDER BY t) - q) / (sum(p) OVER () + sum(q) OVER ()) AS a FROM g)
SELECT round(t, 6) AS threshold, round(a, 6) AS accuracy FROM c ORDER BY a DESC, t DESC LIMIT 1""")
def best_threshold(spark, d):
    price, qty = F.col("l_extendedprice"), F.col("l_quantity")
    scored = table(spark, d, "lineitem").select((price / 1000 + F.when(qty > 25, 5).otherwise(0)).alias("score"),
                                                (qty * 1000 + price > 70000).cast("int").alias("y"))
    return rounded(modeling.best_threshold(scored, "y", "score"), 6)


# ---- models -------------------------------------------------------------------------------

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]


def _search(spark, d):
    return modeling.auto_train(_signals(spark, d), "flag", FEATURES, budget_seconds=60, folds=2)


@register("auto_train")
def auto_train(spark, d):
    data = _signals(spark, d)
    run = modeling.auto_train(data, "net", [c for c in FEATURES if c != "l_returnflag"], budget_seconds=60, folds=2)
    return modeling.regression_metrics(modeling.score(data, run.leader, run), "net", "predict")


@register("leaderboard")
def leaderboard(spark, d):
    return modeling.leaderboard(spark, _search(spark, d))


@register("leaderboard_classes", " UNION ALL ".join(
    f"SELECT '{m}' AS model, {n} AS trials, 2 AS folds, true AS fitted, 12 AS classes" for m, n in (("boosted", 1), ("forest", 1), ("logistic", 2), ("tree", 1))))
def leaderboard_classes(spark, d):
    """Twelve classes, two columns with nulls: every grid point of every family is on the board, boosted trees too."""
    lines = table(spark, d, "lineitem")
    band = F.concat("l_returnflag", "l_linestatus", F.when(F.col("l_quantity") > 25, "+").otherwise("-"))
    data = lines.select(band.alias("band"), F.when(F.col("l_linenumber") != 1, F.col("l_quantity")).alias("l_quantity"), "l_extendedprice", "l_discount",
                        F.when(F.col("l_linenumber") != 2, F.year("l_shipdate")).alias("year"))
    run = modeling.auto_train(data, "band", folds=2, boosts=3)
    return modeling.leaderboard(spark, run).groupBy("model").agg(
        F.count(F.lit(1)).cast("int").alias("trials"), F.max(F.size("folds")).alias("folds"), F.max("fitted").alias("fitted"),
        F.lit(len(run.classes)).alias("classes"))


@register("feature_importance")
def feature_importance(spark, d):
    return modeling.feature_importance(_signals(spark, d), _search(spark, d))


@register("batch_predict")
def batch_predict(spark, d):
    return modeling.batch_predict(_signals(spark, d), _search(spark, d))[1]


@register("surrogate_regression")
def surrogate_regression(spark, d):
    return modeling.surrogate_regression(_signals(spark, d), "net", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                                         ["l_orderkey", "l_linenumber", "l_partkey"])[0]


NEAR = """(SELECT l_quantity, l_extendedprice, l_discount FROM (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem),
 (SELECT min(l_extendedprice * (1 - l_discount)) lo, max(l_extendedprice * (1 - l_discount)) hi FROM lineitem)
 WHERE net BETWEEN 40000 - 0.1 * (hi - lo) AND 40000 + 0.1 * (hi - lo))"""


def _near(spark, d):
    from ..operators.cleaning import near_target
    return near_target(_signals(spark, d).select("l_quantity", "l_extendedprice", "l_discount", "net"), "net", 40000.0, 0.1)


@register("candidate_starts", " UNION ALL ".join(
    f"SELECT {q}::DOUBLE AS quantile, " + ", ".join(f"round(quantile_cont({c}, {q}), 4) AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount")) +
    f" FROM {NEAR}" for q in (0.25, 0.375, 0.5, 0.625, 0.75)))
def candidate_starts(spark, d):
    starts = modeling.candidate_starts(_near(spark, d), ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(starts, 4, "l_quantity", "l_extendedprice", "l_discount")


@register("feature_bounds", """
WITH s AS (SELECT (CASE WHEN l_discount < 0.09 THEN ln(1 + l_extendedprice) END) AS x, l_quantity AS q FROM lineitem)
SELECT 'min' AS bound, round(min(x), 6) AS price, min(q) AS l_quantity FROM s UNION ALL SELECT 'max', round(max(x), 6), max(q) FROM s""")
def feature_bounds(spark, d):
    lines = table(spark, d, "lineitem").select(F.when(F.col("l_discount") < 0.09, F.col("l_extendedprice")).alias("price"), "l_quantity")
    bounds = modeling.feature_bounds(lines, ["price", "l_quantity"])
    # the bounds take the same fitted transform as the data
    from ..operators.features import apply_log_sqrt
    return rounded(apply_log_sqrt(bounds, {"log": {"price": 0.0}, "sqrt": {}}), 6)


@register("recommend_inputs")
def recommend_inputs(spark, d):
    data = _signals(spark, d)
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    prep = regression_prep.fit_regression(data.select(*cols, "net"), "net")
    ready = regression_prep.apply_regression(data.select(*cols, "net"), prep)
    _, models = modeling.surrogate_regression(ready.withColumn("key", F.xxhash64(*cols, "label")), "label", cols, ["key"])
    from ..operators.cleaning import near_target
    near = near_target(ready, "label", 40000.0, 0.1)
    bounds = regression_prep.apply_regression(modeling.feature_bounds(data, cols).drop("bound"), prep)
    limits = modeling.feature_bounds(bounds, cols)
    found = modeling.recommend_inputs(near, limits, models["boosted"], cols, 40000.0, rounds=4)
    return regression_prep.invert_regression(found, prep)


# ---- composite flows ----------------------------------------------------------------------

def _flow_tables(spark, d):
    train, test = line_halves(spark, d)
    def view(t):
        order = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
        return t.join(order, "l_orderkey").select(
            F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("row_key"), "l_shipdate",
            F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("l_quantity"), "l_extendedprice", "l_discount",
            "l_returnflag", "l_linestatus", "o_orderpriority",
            (F.col("l_extendedprice") * (1 - F.col("l_discount")) > 40000).cast("string").alias("large"))
    return view(train), view(test)


FLOW = {"key": ["row_key"], "trees": 10, "boosts": 5, "unary": ["polynomial", "interaction"], "groupby": ["mean", "std"]}


@register("cast_train")
def cast_train(spark, d):
    train, test = _flow_tables(spark, d)
    return preparation.cast(train, "large", test, **FLOW)[1]


@register("shape_test")
def shape_test(spark, d):
    train, test = _flow_tables(spark, d)
    return preparation.shape(preparation.fit(train, "large", **FLOW), test)


@register("prepare_for_regression", f"""
WITH b AS (SELECT l_orderkey, l_quantity q, l_extendedprice p, l_returnflag f, l_extendedprice * (1 - l_discount) AS y FROM lineitem),
m AS (SELECT avg(y) m FROM b), k AS (SELECT f, m + (avg(y) - m) * (1 / (1 + exp(-(count(*) - 20) / 10.0))) AS c FROM b, m GROUP BY f, m),
z AS (SELECT l_orderkey, q, p, c, y FROM b JOIN k ON b.f = k.f),
s AS (SELECT min(q) a, max(q) b, min(p) c0, max(p) c1, min(c) e, max(c) g,
 (avg(pow(p, 3)) - 3 * avg(p) * avg(pow(p, 2)) + 2 * pow(avg(p), 3)) / pow(var_pop(p), 1.5) AS sk FROM z)
SELECT round((q - a) / (b - a), 6) AS l_quantity, round((p - c0) / (c1 - c0), 6) AS l_extendedprice, round((c - e) / (g - e), 6) AS l_returnflag,
 round(y, 4) AS label FROM z, s WHERE abs(sk) <= 0.5""")
def prepare_for_regression(spark, d):
    data = _signals(spark, d).select("l_quantity", "l_extendedprice", "l_returnflag", "net")
    state = regression_prep.fit_regression(data, "net")
    out = regression_prep.apply_regression(data, state)
    return rounded(rounded(out, 4, "label"), 6, "l_quantity", "l_extendedprice", "l_returnflag")


@register("prepare_inverse", "SELECT round(l_quantity, 4) AS l_quantity, round(l_extendedprice, 4) AS l_extendedprice, l_returnflag FROM lineitem")
def prepare_inverse(spark, d):
    data = _signals(spark, d).select("l_quantity", "l_extendedprice", "l_returnflag", "net")
    state = regression_prep.fit_regression(data, "net")
    back = regression_prep.invert_regression(regression_prep.apply_regression(data, state).drop("label"), state)
    return rounded(back, 4)


EDA_COLS = ["value", "user_id"]
EDA_SQL = " UNION ALL ".join(
    [f"SELECT 'missing' AS section, '{c}' AS feature, '{k}' AS stat, 0.0::DOUBLE AS value, NULL AS text FROM events HAVING count(*) = count({c})"
     for c in (*EDA_COLS, "event_type") for k in ("n_missing", "ratio")] +
    ["SELECT 'levels', 'event_type', event_type, count(*)::DOUBLE, NULL FROM events GROUP BY event_type"] +
    [f"SELECT 'box', '{c}', '{k}', round({e}, 4)::DOUBLE, NULL FROM events, (SELECT quantile_cont({c}, 0.25) a, quantile_cont({c}, 0.5) m, quantile_cont({c}, 0.75) b FROM events)"
     for c in EDA_COLS for k, e in (
         ("min", f"min({c})"), ("q1", "max(a)"), ("median", "max(m)"), ("q3", "max(b)"), ("max", f"max({c})"),
         ("n_outliers", f"count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a))"),
         ("percent", f"round(100 * count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) / count(*), 2)"))] +
    [f"SELECT 'skew', '{c}', 'skew', round(s, 4), NULL FROM (SELECT avg(pow({c} - m, 3)) / pow(var_pop({c}), 1.5) AS s FROM events, (SELECT avg({c}) m FROM events)) WHERE abs(s) > 0.75"
     for c in EDA_COLS] +
    ["SELECT 'correlation', 'user_id', 'r', round(corr(user_id, value), 2), NULL FROM events",
     "SELECT 'correlation', 'user_id', 'level', NULL, CASE WHEN abs(corr(user_id, value)) <= 0.25 THEN 'micro' WHEN abs(corr(user_id, value)) <= 0.5 THEN 'low' "
     "WHEN abs(corr(user_id, value)) <= 0.75 THEN 'medium' ELSE 'high' END FROM events"])


@register("eda_report", EDA_SQL)
def eda_report(spark, d):
    events = table(spark, d, "events").select("value", "user_id", "event_type")
    return rounded(reports.eda_report(events, "value"), 4, "value")


def _compared(spark, d):
    """Early and late lines: prices of late ones are moved far off, and their quantities are missing on the first two lines of an order."""
    train, test = line_halves(spark, d)
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag"]
    moved = test.withColumn("l_extendedprice", F.col("l_extendedprice") + 200000).withColumn("l_quantity", F.when(F.col("l_linenumber") > 2, F.col("l_quantity")))
    return train.select(*cols), moved.select(*cols), ["l_orderkey", "l_linenumber", "l_partkey"]


COMPARE_A = f"SELECT l_quantity, l_extendedprice, l_tax, l_returnflag FROM ({TRAIN_SQL})"
COMPARE_B = ("SELECT CASE WHEN l_linenumber > 2 THEN l_quantity END AS l_quantity, l_extendedprice + 200000 AS l_extendedprice, l_tax, l_returnflag "
             f"FROM ({TEST_SQL})")


def _compare_sql(points):
    out = []
    for name, t in (("train", "a"), ("test", "b")):
        out.append(f"SELECT 'rows' AS section, '{name}' AS dataset, NULL AS feature, 'n' AS stat, NULL::DOUBLE AS position, count(*)::DOUBLE AS value FROM {t}")
        bits = " || ".join(f"(CASE WHEN {c} IS NULL THEN '1' ELSE '0' END)" for c in ("l_quantity", "l_extendedprice", "l_tax", "l_returnflag"))
        out.append(f"SELECT 'patterns', '{name}', NULL, {bits}, NULL, count(*) FROM {t} GROUP BY 4")
        out.append(f"SELECT 'levels', '{name}', 'l_returnflag', l_returnflag, row_number() OVER (ORDER BY count(*) DESC, l_returnflag), "
                   f"round(count(*) / (SELECT count(*) FROM {t}), 6) FROM {t} WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag")
        for c in ("l_quantity", "l_extendedprice", "l_tax"):
            out.append(f"""SELECT 'overlay', '{name}', '{c}', 'density', round(p, 4), round((SELECT sum(exp(-0.5 * pow((p - {c}) / h, 2))) FROM {t}) / (n * h * sqrt(2 * pi())), 6)
FROM (SELECT count({c}) n, stddev_samp({c}) * pow(count({c}), -0.2) h FROM {t}) s,
 (SELECT lo + (hi - lo) * i / {points - 1} AS p FROM (SELECT min({c}) lo, max({c}) hi FROM (SELECT {c} FROM a UNION ALL SELECT {c} FROM b)) g, range({points}) r(i))""")
    out.append("SELECT 'adversarial', NULL, 'l_extendedprice', 'removed', 0, 1")
    out.append("SELECT 'adversarial', NULL, 'l_quantity', 'removed', 1, 1")
    return f"WITH a AS ({COMPARE_A}), b AS ({COMPARE_B}) " + " UNION ALL ".join(out)


@register("eda_compare_report", _compare_sql(20))
def eda_compare_report(spark, d):
    """Everything of the report that is determined: all but auc and importances, and the removals of planted drift."""
    first, second, key = _compared(spark, d)
    out = reports.eda_compare_report(first, second, key, 20, trees=10, max_rounds=2)
    out = out.filter((F.col("section") != "adversarial") | (F.col("stat") == "removed"))
    return rounded(rounded(out, 4, "position"), 6, "value")


KEPT = "(SELECT * FROM lineitem WHERE NOT (l_returnflag = 'A' AND l_linenumber = 7))"


@register("upload_check", f"""
SELECT 'l_orderkey' AS column_name, 'numerical' AS initial_dtype, 'numerical' AS advise_dtype, 'int' AS dtype_for_process, 0 AS data_quality,
  count(*) AS count, round(avg(l_orderkey), 4) AS mean, round(stddev_samp(l_orderkey), 4) AS std, min(l_orderkey)::VARCHAR AS min, max(l_orderkey)::VARCHAR AS max,
  count(DISTINCT l_orderkey) AS nunique FROM {KEPT}
UNION ALL SELECT 'price', 'numerical', 'numerical', 'float', 0, count(*), round(avg(l_extendedprice), 4), round(stddev_samp(l_extendedprice), 4),
  min(l_extendedprice)::VARCHAR, max(l_extendedprice)::VARCHAR, count(DISTINCT l_extendedprice) FROM {KEPT}
UNION ALL SELECT 'l_returnflag', 'category', 'category', 'object', 0, count(*), NULL, NULL,
  (SELECT l_returnflag FROM {KEPT} GROUP BY 1 ORDER BY count(*), 1 LIMIT 1), (SELECT l_returnflag FROM {KEPT} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
  count(DISTINCT l_returnflag) FROM {KEPT}
UNION ALL SELECT 'l_shipdate', 'timestamp', 'datetime', '%Y-%m-%d %H:%M:%S', 0, count(*), NULL, NULL, min(l_shipdate)::VARCHAR, max(l_shipdate)::VARCHAR,
  count(DISTINCT l_shipdate) FROM {KEPT}""")
def upload_check(spark, d):
    lines = table(spark, d, "lineitem")
    odd = F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 7), "missing")
    dirty = lines.select("l_orderkey", F.coalesce(odd, F.col("l_extendedprice").cast("string")).alias("price"), "l_returnflag", "l_shipdate")
    return rounded(reports.upload_check(dirty)[1], 4, "mean", "std")
