"""New columns: calendar, steps, powers, crosses, bins, rare levels."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordered import range_cut
from ..operators import features
from ..session import table
from .registry import register, rounded


@register("calendar_parts", """
SELECT event_id, year(ts)::VARCHAR AS year_0, quarter(ts)::VARCHAR AS quarter_0, (isodow(ts) - 1)::VARCHAR AS week_0, month(ts)::VARCHAR AS month_0,
 day(ts)::VARCHAR AS day_0, (isodow(ts) - 1)::VARCHAR AS dayofweek_0, hour(ts)::VARCHAR AS hour_0, minute(ts)::VARCHAR AS minute_0,
 second(ts)::VARCHAR AS second_0 FROM events""")
def calendar_parts(spark, d):
    return features.calendar_parts(table(spark, d, "events").select("event_id", "ts"), {"ts": "yyyy-MM-dd HH:mm:ss"}).drop("ts")


@register("timestamp_differences", """
SELECT l_orderkey, l_linenumber, round(epoch_us(l_shipdate) / 1e6 - epoch_us(o_orderdate) / 1e6, 3) AS o_orderdate_sub_l_shipdate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def timestamp_differences(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    both = lines.join(orders, "l_orderkey")
    return rounded(features.timestamp_differences(both, ["o_orderdate", "l_shipdate"]).drop("o_orderdate", "l_shipdate"), 3)


GAPS = "SELECT event_id, user_id, ts, value, round(epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER ({w}), 1) AS g FROM events"


@register("time_delta", f"""
WITH g AS ({GAPS.replace('{w}', 'ORDER BY ts, event_id')}), m AS (SELECT g AS v FROM g WHERE g IS NOT NULL GROUP BY g ORDER BY count(*) DESC, g LIMIT 1)
SELECT event_id, coalesce(g, v) AS ts_delta FROM g, m""")
def time_delta(spark, d):
    events = table(spark, d, "events").select("event_id", "ts")
    return features.time_delta(events, "ts", ["ts", "event_id"]).select("event_id", "ts_delta")


@register("time_delta_entity", f"""
WITH g AS ({GAPS.replace('{w}', 'PARTITION BY user_id ORDER BY ts, event_id')}),
m AS (SELECT g AS v FROM g WHERE g IS NOT NULL GROUP BY g ORDER BY count(*) DESC, g LIMIT 1)
SELECT event_id, user_id, coalesce(g, v) AS ts_delta FROM g, m""")
def time_delta_entity(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    return features.time_delta(events, "ts", ["ts", "event_id"], ["user_id"]).select("event_id", "user_id", "ts_delta")


@register("step_difference", f"""
WITH g AS ({GAPS.replace('{w}', 'ORDER BY ts, event_id')}), m AS (SELECT g AS v FROM g WHERE g IS NOT NULL GROUP BY g ORDER BY count(*) DESC, g LIMIT 1),
x AS (SELECT event_id, ts, coalesce(g, v) AS gap, value, event_id * 1.5 + value / 1000 AS clock,
 coalesce(value - lag(value) OVER (ORDER BY ts, event_id), 0) AS dv,
 coalesce(event_id * 1.5 + value / 1000 - lag(event_id * 1.5 + value / 1000) OVER (ORDER BY ts, event_id), 0) AS dc FROM g, m)
SELECT event_id, round(dv, 6) AS value_delta,
 round(last_value(CASE WHEN gap <> 0 THEN dc / gap END IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS clock_delta FROM x""")
def step_difference(spark, d):
    events = table(spark, d, "events").select("event_id", "ts", "value", (F.col("event_id") * 1.5 + F.col("value") / 1000).alias("clock"))
    cut = range_cut(events, ["ts", "event_id"])
    state = features.fit_time_steps(events, "ts", ["value", "clock"], ["ts", "event_id"], cut=cut)
    return rounded(features.apply_time_steps(events, state, cut=cut).select("event_id", "value_delta", "clock_delta"), 6)


def _lines(spark, d, *cols):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *cols)


@register("polynomial", """
SELECT l_orderkey, l_linenumber, round(l_quantity * l_quantity, 4) AS "pow(l_quantity)", round(centred * centred, 4) AS "pow(centred)",
 round(sqrt(l_quantity), 6) AS "sqrt(l_quantity)" FROM (SELECT *, l_extendedprice / 1000 - 20 AS centred FROM lineitem)""")
def polynomial(spark, d):
    lines = _lines(spark, d, "l_quantity", (F.col("l_extendedprice") / 1000 - 20).alias("centred"))
    cols = ["l_quantity", "centred"]
    out = features.add_columns(lines, features.polynomial_exprs(cols, features.nonnegative(lines, cols))).drop(*cols)
    return rounded(rounded(out, 4, "pow(l_quantity)", "pow(centred)"), 6, "sqrt(l_quantity)")


@register("trigonometry", """
SELECT l_orderkey, l_linenumber, round(sin(l_quantity), 6) AS "sin(l_quantity)", round(sin(l_discount), 6) AS "sin(l_discount)",
 round(cos(l_quantity), 6) AS "cos(l_quantity)", round(cos(l_discount), 6) AS "cos(l_discount)",
 round(tan(l_quantity), 4) AS "tan(l_quantity)", round(tan(l_discount), 4) AS "tan(l_discount)" FROM lineitem""")
def trigonometry(spark, d):
    cols = ["l_quantity", "l_discount"]
    out = features.add_columns(_lines(spark, d, *cols), features.trigonometry_exprs(cols)).drop(*cols)
    tans = [f"tan({c})" for c in cols]
    return rounded(rounded(out, 4, *tans), 6)


def _cross_sql(cols):
    made = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            made += [f'round({a} * {b}, 4) AS "{a}_multiply_{b}"', f'round(CASE WHEN {a} = 0 THEN 0 ELSE {b} / {a} END, 4) AS "{a}_divide_{b}"',
                     f'round({a} + {b}, 4) AS "{a}_add_{b}"', f'round({b} - {a}, 4) AS "{a}_subtract_{b}"']
    return "SELECT l_orderkey, l_linenumber, " + ", ".join(made) + " FROM lineitem"


@register("interaction", _cross_sql(["l_quantity", "l_discount", "l_tax"]))
def interaction(spark, d):
    cols = ["l_quantity", "l_discount", "l_tax"]
    return rounded(features.add_columns(_lines(spark, d, *cols), features.interaction_exprs(cols)).drop(*cols), 4)


@register("row_norm", """
SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax), 6) AS norm FROM lineitem""")
def row_norm(spark, d):
    cols = ["l_quantity", "l_discount", "l_tax"]
    lines = _lines(spark, d, *cols)
    return rounded(lines.select("l_orderkey", "l_linenumber", features.row_norm(cols).alias("norm")), 6)


@register("column_arithmetic", """
SELECT l_orderkey, l_linenumber, round(a + b, 4) AS "add", round(a - b, 4) AS sub, round(a * b, 4) AS multiply,
 CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN coalesce(b, 0) = 0 THEN
   (CASE WHEN coalesce(a, 0) > 0 THEN 'inf' WHEN coalesce(a, 0) < 0 THEN '-inf' ELSE 'nan' END)
  ELSE round(coalesce(a, 0) / b * 1000, 0)::BIGINT::VARCHAR END AS divide
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS a, CASE WHEN l_returnflag <> 'A' THEN l_discount END AS b FROM lineitem)""")
def column_arithmetic(spark, d):
    lines = _lines(spark, d, F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("a"),
                   F.when(F.col("l_returnflag") != "A", F.col("l_discount")).alias("b"))
    made = features.column_arithmetic(F.col("a"), F.col("b"))
    q = made["divide"]
    text = F.when(F.isnan(q), "nan").when(q == float("inf"), "inf").when(q == float("-inf"), "-inf") \
        .when(q.isNotNull(), F.round(F.when(F.abs(q) < 1e300, q) * 1000, 0).cast("long").cast("string"))
    return rounded(lines.select("l_orderkey", "l_linenumber", made["add"].alias("add"), made["sub"].alias("sub"),
                                made["multiply"].alias("multiply"), text.alias("divide")), 4)


@register("kmeans_bins")
def kmeans_bins(spark, d):
    lines = table(spark, d, "lineitem")
    edges = features.fit_kmeans_bins(lines, ["l_extendedprice", "l_quantity", "l_linenumber"], 8)
    cols = list(edges)
    binned = features.apply_bins(lines.select(*cols), edges)
    return binned.groupBy(*[f"{c}_binned" for c in cols]).agg(F.count(F.lit(1)).alias("n"))


@register("apply_bins", """
SELECT l_orderkey, l_linenumber, (CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 24.5 THEN 1 WHEN l_quantity <= 40 THEN 2 ELSE 3 END)::VARCHAR AS l_quantity_binned
FROM lineitem""")
def apply_bins(spark, d):
    return features.apply_bins(_lines(spark, d, "l_quantity"), {"l_quantity": [10.0, 24.5, 40.0]}).drop("l_quantity")


@register("yeo_johnson_apply", """
SELECT l_orderkey, l_linenumber, round(CASE WHEN x >= 0 THEN (pow(x + 1, 0.4) - 1) / 0.4 ELSE -(pow(1 - x, 1.6) - 1) / 1.6 END, 6) AS "x_PT",
 round(CASE WHEN l_tax >= 0 THEN ln(l_tax + 1) ELSE 0 END, 6) AS "l_tax_PT"
FROM (SELECT *, l_extendedprice / 1000 - 20 AS x FROM lineitem)""")
def yeo_johnson_apply(spark, d):
    lines = _lines(spark, d, (F.col("l_extendedprice") / 1000 - 20).alias("x"), "l_tax")
    state = {"x": {"lambda": 0.4, "factor": 1.0}, "l_tax": {"lambda": 0.0, "factor": 1.0}}
    return rounded(features.apply_yeo_johnson(lines, state).drop("x", "l_tax"), 6)


@register("yeo_johnson_fit", """
WITH g AS (SELECT (i - 800) * 0.005 AS lam FROM range(1601) r(i)),
l AS (SELECT lam, -count(*) / 2.0 * ln(var_pop(CASE WHEN abs(lam) < 1e-9 THEN ln(value + 1) ELSE (pow(value + 1, lam) - 1) / lam END))
  + (lam - 1) * sum(ln(value + 1)) AS score FROM events, g GROUP BY lam)
SELECT 'value' AS feature, round(arg_max(lam, score), 1) AS lambda FROM l""")
def yeo_johnson_fit(spark, d):
    events = table(spark, d, "events").select("value", "user_id")
    state = features.fit_yeo_johnson(events, ["value", "user_id"])
    return spark.createDataFrame([(c, round(s["lambda"], 1)) for c, s in state.items()], "feature string, lambda double")


SKEWED = "(SELECT event_id, value - 3 AS value, sqrt(sqrt(user_id)) AS root FROM events)"


@register("deskew_log_sqrt", f"""
WITH s AS (SELECT abs(least(0, min(value))) cv, abs(least(0, min(root))) cr,
  (avg(pow(value, 3)) - 3 * avg(value) * avg(pow(value, 2)) + 2 * pow(avg(value), 3)) / pow(var_pop(value), 1.5) AS sv,
  (avg(pow(root, 3)) - 3 * avg(root) * avg(pow(root, 2)) + 2 * pow(avg(root), 3)) / pow(var_pop(root), 1.5) AS sr FROM {SKEWED})
SELECT event_id, round(CASE WHEN sv > 0.5 THEN ln(value + cv + 1) WHEN sv < -0.5 THEN sqrt(value + cv) ELSE value END, 6) AS value,
 round(CASE WHEN sr > 0.5 THEN ln(root + cr + 1) WHEN sr < -0.5 THEN sqrt(root + cr) ELSE root END, 6) AS root FROM {SKEWED}, s""")
def deskew_log_sqrt(spark, d):
    skewed = _skewed(spark, d)
    return rounded(features.apply_log_sqrt(skewed, features.fit_log_sqrt(skewed, ["value", "root"])), 6)


def _skewed(spark, d):
    return table(spark, d, "events").select("event_id", (F.col("value") - 3).alias("value"), F.sqrt(F.sqrt("user_id")).alias("root"))


@register("deskew_inverse", f"SELECT event_id, round(value, 6) AS value, round(root, 6) AS root FROM {SKEWED}")
def deskew_inverse(spark, d):
    skewed = _skewed(spark, d)
    state = features.fit_log_sqrt(skewed, ["value", "root"])
    return rounded(features.invert_log_sqrt(features.apply_log_sqrt(skewed, state), state), 6)


@register("combine_rare", """
WITH b AS (SELECT c_custkey, n_name || CASE WHEN c_acctbal > 9000 THEN '-' || c_mktsegment ELSE '' END AS place FROM customer JOIN nation ON c_nationkey = n_nationkey),
k AS (SELECT place, count(*) / (SELECT count(*) FROM b) AS share FROM b GROUP BY place)
SELECT c_custkey, CASE WHEN share < 0.005 THEN 'others' ELSE b.place END AS place FROM b JOIN k ON b.place = k.place""")
def combine_rare(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    # 25 nations at every scale
    named = table(spark, d, "customer").join(F.broadcast(nation), "c_nationkey")
    rich = F.when(F.col("c_acctbal") > 9000, F.concat(F.lit("-"), "c_mktsegment")).otherwise("")
    placed = named.select("c_custkey", F.concat("n_name", rich).alias("place"))
    return features.apply_rare(placed, features.fit_rare(placed, ["place"]))
