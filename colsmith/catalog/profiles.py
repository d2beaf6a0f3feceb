"""Column profiles, chart numbers and column checks."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import distinct_counts
from ..operators import cleaning, features, groups, imputation, merging, profiling, roles
from ..session import table
from .registry import LINE_NUMERIC, TEST_SQL, TRAIN_SQL, line_halves, register, rounded


def _union(template: str, cols: list[str]) -> str:
    return " UNION ALL ".join(template.replace("{c}", c) for c in cols)


HOLES = "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END"


def _with_holes(lines):
    return lines.withColumn("l_quantity", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")))


@register("profile_numeric", _union(f"""
SELECT '{{c}}' AS feature, count({{c}}) AS count, round(avg({{c}}), 4) AS mean, round(stddev_samp({{c}}), 4) AS std,
  min({{c}})::DOUBLE AS min, max({{c}})::DOUBLE AS max, count(DISTINCT {{c}}) AS nunique
FROM (SELECT * REPLACE ({HOLES} AS l_quantity) FROM lineitem)""", [*LINE_NUMERIC, "l_linenumber", "l_partkey"]))
def profile_numeric(spark, d):
    lines = _with_holes(table(spark, d, "lineitem"))
    return rounded(profiling.profile_numeric(lines, [*LINE_NUMERIC, "l_linenumber", "l_partkey"]), 4)


@register("profile_category", _union("""
SELECT '{c}' AS feature, (SELECT count({c}) FROM orders) AS count,
  (SELECT {c} FROM orders GROUP BY {c} ORDER BY count(*), {c} LIMIT 1) AS least_common,
  (SELECT {c} FROM orders GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS most_common,
  (SELECT count(DISTINCT {c}) FROM orders) AS nunique""", ["o_orderstatus", "o_orderpriority"]))
def profile_category(spark, d):
    return profiling.profile_category(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@register("profile_columns", """
WITH n AS (SELECT count(*) c, floor(floor(sqrt(count(*)) / log10(count(*)))) b FROM orders)
SELECT 'o_orderkey' AS column_name, 'numerical' AS initial_dtype, 'numerical' AS advise_dtype, 'int' AS dtype_for_process, 0 AS data_quality,
  count(o_orderkey) AS count, round(avg(o_orderkey), 4) AS mean, round(stddev_samp(o_orderkey), 4) AS std, count(DISTINCT o_orderkey) AS nunique FROM orders
UNION ALL SELECT 'o_custkey', 'numerical', 'numerical', 'int', 0, count(o_custkey), round(avg(o_custkey), 4), round(stddev_samp(o_custkey), 4), count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 'o_totalprice', 'numerical', 'numerical', 'float', 0, count(*), round(avg(o_totalprice), 4), round(stddev_samp(o_totalprice), 4), count(DISTINCT o_totalprice) FROM orders
UNION ALL SELECT 'weekday', 'numerical', 'category', 'object', 0, count(*), round(avg(isodow(o_orderdate) - 1), 4), round(stddev_samp(isodow(o_orderdate) - 1), 4), 7 FROM orders
UNION ALL SELECT 'zero', 'numerical', 'category', 'object', 2, count(*), 0.0, 0.0, 1 FROM orders
UNION ALL SELECT 'o_orderdate', 'timestamp', 'datetime', '%Y-%m-%d %H:%M:%S', 0, count(*), NULL, NULL, count(DISTINCT o_orderdate) FROM orders
UNION ALL SELECT 'o_orderstatus', 'category', 'category', 'object', 0, count(*), NULL, NULL, count(DISTINCT o_orderstatus) FROM orders
UNION ALL SELECT 'o_orderpriority', 'category', 'category', 'object', 0, count(*), NULL, NULL, count(DISTINCT o_orderpriority) FROM orders
UNION ALL SELECT 'always', 'category', 'category', 'object', 1, count(*), NULL, NULL, 1 FROM orders""")
def profile_columns(spark, d):
    orders = table(spark, d, "orders").withColumn("weekday", F.weekday("o_orderdate")) \
        .withColumn("zero", F.lit(0)).withColumn("always", F.lit("x"))
    return rounded(profiling.profile_columns(orders).drop("min", "max"), 4)


@register("feature_types", """
WITH n AS (SELECT floor(sqrt(count(*)) / log10(count(*))) b FROM lineitem)
SELECT 'l_orderkey' AS feature, count(DISTINCT l_orderkey) AS n_distinct, 'int' AS family FROM lineitem
UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber), CASE WHEN count(DISTINCT l_linenumber) <= 4 OR
  (count(DISTINCT l_linenumber) <= max(b) AND max(l_linenumber) < 250) THEN 'object' ELSE 'int' END FROM lineitem, n
UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity), CASE WHEN count(DISTINCT l_quantity) <= 3 AND max(l_quantity) <= 3
  THEN 'object' ELSE 'float' END FROM lineitem
UNION ALL SELECT 'l_discount', count(DISTINCT l_discount), CASE WHEN count(DISTINCT l_discount) <= 3 AND max(l_discount) <= 3
  THEN 'object' ELSE 'float' END FROM lineitem
UNION ALL SELECT 'half', 2, 'object' FROM lineitem HAVING count(*) > 0
UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag), 'object' FROM lineitem
UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate), 'datetime' FROM lineitem""")
def feature_types(spark, d):
    lines = table(spark, d, "lineitem").withColumn("half", F.when(F.col("l_quantity") > 25, 0.5).otherwise(1.0))
    return roles.feature_types(lines, ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "half", "l_returnflag", "l_shipdate"])


@register("problem_type", """
WITH f AS (
 SELECT 'l_linestatus' AS label, count(l_linestatus) n, count(DISTINCT l_linestatus) u, true AS txt, true AS whole FROM lineitem UNION ALL
 SELECT 'l_returnflag', count(l_returnflag), count(DISTINCT l_returnflag), true, true FROM lineitem UNION ALL
 SELECT 'l_linenumber', count(l_linenumber), count(DISTINCT l_linenumber), false, true FROM lineitem UNION ALL
 SELECT 'l_quantity', count(l_quantity), count(DISTINCT l_quantity), false, bool_and(l_quantity = floor(l_quantity)) FROM lineitem UNION ALL
 SELECT 'l_discount', count(l_discount), count(DISTINCT l_discount), false, bool_and(l_discount = floor(l_discount)) FROM lineitem UNION ALL
 SELECT 'l_extendedprice', count(l_extendedprice), count(DISTINCT l_extendedprice), false, bool_and(l_extendedprice = floor(l_extendedprice)) FROM lineitem)
SELECT label, n, u AS n_distinct, CASE WHEN u = 2 THEN 'binary' WHEN txt THEN 'multiclass'
  WHEN u / n <= CASE WHEN n > 1000 THEN 0.05 ELSE 0.1 END AND u <= 1000 AND whole THEN 'multiclass' ELSE 'regression' END AS problem_type FROM f""")
def problem_type(spark, d):
    return roles.problem_type_table(table(spark, d, "lineitem"), [
        "l_linestatus", "l_returnflag", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice"])


@register("column_stats", _union("""
SELECT '{c}' AS feature, round(median({c}), 4) AS median, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  round(var_samp({c}), 2) AS var, max({c}) AS max, min({c}) AS min, round(skewness({c}), 4) AS skew, round(kurtosis({c}), 4) AS kurt,
  round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.75), 4) AS q3,
  round((quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / 2, 4) AS qd, round(var_samp({c}) / stddev_samp({c}), 4) AS coef,
  round(max({c}) - min({c}), 4) AS "range" FROM lineitem""", LINE_NUMERIC))
def column_stats(spark, d):
    out = profiling.column_stats(table(spark, d, "lineitem"), LINE_NUMERIC)
    return rounded(rounded(out, 2, "var"), 4, "median", "mean", "std", "skew", "kurt", "q1", "q3", "qd", "coef", "range")


HOLED = """(SELECT l_orderkey, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS l_quantity,
 CASE WHEN l_returnflag = 'A' AND l_linenumber < 5 THEN NULL ELSE l_discount END AS l_discount, l_returnflag FROM lineitem)"""


def _holed(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.select("l_orderkey", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("l_quantity"),
                        F.when(~((F.col("l_returnflag") == "A") & (F.col("l_linenumber") < 5)), F.col("l_discount")).alias("l_discount"),
                        "l_returnflag")


@register("missing_counts", _union(f"""
SELECT '{{c}}' AS feature, count(*) - count({{c}}) AS n_missing, round((count(*) - count({{c}})) / count(*), 6) AS ratio FROM {HOLED}""",
                                   ["l_orderkey", "l_quantity", "l_discount", "l_returnflag"]))
def missing_counts(spark, d):
    return rounded(profiling.missing_counts(_holed(spark, d)), 6)


@register("missing_patterns", f"""
SELECT '0' || CASE WHEN l_quantity IS NULL THEN '1' ELSE '0' END || CASE WHEN l_discount IS NULL THEN '1' ELSE '0' END || '0' AS pattern,
 count(*) AS n FROM {HOLED} GROUP BY 1""")
def missing_patterns(spark, d):
    return profiling.missing_patterns(_holed(spark, d))


@register("category_counts", _union("""
SELECT '{c}' AS feature, value, n, "rank"::INT AS "rank" FROM (SELECT {c} AS value, count(*) n,
  row_number() OVER (ORDER BY count(*) DESC, {c}) AS "rank" FROM part GROUP BY {c}) WHERE "rank" <= 10""", ["p_name", "p_brand", "p_type"]))
def category_counts(spark, d):
    return profiling.category_counts(table(spark, d, "part"), ["p_name", "p_brand", "p_type"], 10)


@register("box_summary", _union("""
SELECT '{c}' AS feature, min({c}) AS min, round(max(a), 4) AS q1, round(max(m), 4) AS median, round(max(b), 4) AS q3, max({c}) AS max,
  count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS n_outliers,
  round(100 * count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) / count(*), 2) AS percent
FROM lineitem, (SELECT quantile_cont({c}, 0.25) a, quantile_cont({c}, 0.5) m, quantile_cont({c}, 0.75) b FROM lineitem)""",
                                ["l_quantity", "l_extendedprice", "l_tax"]))
def box_summary(spark, d):
    return rounded(profiling.box_summary(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]), 4, "q1", "median", "q3")


@register("skew_report", """
WITH s AS (SELECT 'value' AS feature, avg(pow(value - m, 3)) / pow(var_pop(value), 1.5) AS skew FROM events, (SELECT avg(value) m FROM events)
UNION ALL SELECT 'user_id', avg(pow(user_id - m, 3)) / pow(var_pop(user_id), 1.5) FROM events, (SELECT avg(user_id) m FROM events))
SELECT feature, round(skew, 6) AS skew FROM s WHERE abs(skew) > 0.75""")
def skew_report(spark, d):
    return rounded(profiling.skew_report(table(spark, d, "events"), ["value", "user_id"]), 6)


def _kde_sql(source: str, grid: str, col: str, points: int) -> str:
    return f"""
SELECT i AS point, p AS position, (SELECT sum(exp(-0.5 * pow((p - {col}) / h, 2))) FROM {source}) / (n * h * sqrt(2 * pi())) AS density
FROM (SELECT count(*) n, stddev_samp({col}) * pow(count(*), -0.2) h FROM {source}) s,
     (SELECT i, lo + (hi - lo) * i / {points - 1} AS p FROM ({grid}) g, range({points}) r(i))"""


KDE_EVENTS = _kde_sql("events", "SELECT min(value) lo, max(value) hi FROM events", "value", 100)
SLOPED = f"""
SELECT point, position, density, CASE WHEN point = 0 THEN lead(density) OVER w - density WHEN point = 99 THEN density - lag(density) OVER w
  ELSE (lead(density) OVER w - lag(density) OVER w) / 2 END AS gradient FROM ({KDE_EVENTS}) WINDOW w AS (ORDER BY point)"""


@register("kde_grid", f"""
SELECT point::INT AS point, round(position, 6) AS position, round(density, 8) AS density, round(gradient, 8) AS gradient FROM ({SLOPED})""")
def kde_grid(spark, d):
    return rounded(rounded(profiling.kde_grid(table(spark, d, "events"), "value"), 6, "position"), 8, "density", "gradient")


@register("kde_slope", f"""
WITH g AS ({SLOPED}), p AS (SELECT unnest([10.0, 100.0, 250.0, 100000.0]) AS x)
SELECT x::DOUBLE AS point, round(coalesce((SELECT arg_min(gradient, position) FROM g WHERE position > x), 0), 8) AS slope FROM p""")
def kde_slope(spark, d):
    grid = profiling.kde_grid(table(spark, d, "events"), "value")
    return rounded(profiling.kde_slope(grid, [10.0, 100.0, 250.0, 100000.0]), 8, "slope")


COMMON = "SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem"


@register("kde_compare", f"""
WITH a AS ({TRAIN_SQL}), b AS ({TEST_SQL})
SELECT 'train' AS dataset, point::INT AS point, round(position, 4) AS position, round(density * 1e6, 6) AS density FROM ({_kde_sql("a", COMMON, "l_extendedprice", 30)})
UNION ALL SELECT 'test', point::INT, round(position, 4), round(density * 1e6, 6) FROM ({_kde_sql("b", COMMON, "l_extendedprice", 30)})""")
def kde_compare(spark, d):
    train, test = line_halves(spark, d)
    out = profiling.kde_compare(train, test, "l_extendedprice", 30)
    return out.select("dataset", "point", F.round("position", 4).alias("position"), F.round(F.col("density") * 1e6, 6).alias("density"))


def _group_sql(cats, nums, aggs):
    names = {"max": "max", "min": "min", "mean": "avg", "std": "stddev_samp"}
    cols = [f'round({names[a]}({x}) OVER (PARTITION BY {c}), 4) AS "{c}_{x}_groupBy_{a}"' for c in cats for a in aggs for x in nums]
    return f"SELECT l_orderkey, l_linenumber, {', '.join(cols)} FROM lineitem"


@register("group_aggregates", _group_sql(["l_returnflag", "l_suppkey"], ["l_extendedprice", "l_quantity"], ["max", "min", "mean", "std"]))
def group_aggregates(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey", "l_extendedprice", "l_quantity")
    out = features.group_aggregates(lines, ["l_returnflag", "l_suppkey"], ["l_extendedprice", "l_quantity"])
    return rounded(out.drop("l_returnflag", "l_suppkey", "l_extendedprice", "l_quantity"), 4)


FITTED_CATS = ["l_orderkey", "l_suppkey", "l_returnflag"]
FITTED = {"mean": "avg({x})", "std": "stddev_samp({x})", "span": "max({x}) - min({x})"}


def _fitted_sql() -> str:
    cols, joins = [], []
    for c in FITTED_CATS:
        aggs = ", ".join(f"{f.format(x=x)} AS {x}_{a}" for a, f in FITTED.items() for x in ("price", "size"))
        joins.append(f"LEFT JOIN (SELECT {c}, {aggs} FROM a GROUP BY {c}) t_{c} ON t.{c} = t_{c}.{c}")
        cols += [f"round(coalesce(t_{c}.{x}_{a}, (SELECT {f.format(x=x)} FROM a)), 6) AS {c}_{x}_groupBy_{a}" for a, f in FITTED.items() for x in ("price", "size")]
    logs = "*, ln(l_extendedprice) AS price, sqrt(l_quantity) AS size"
    return f"WITH a AS (SELECT {logs} FROM ({TRAIN_SQL})), t AS ({TEST_SQL}) SELECT t.l_orderkey, t.l_linenumber, {', '.join(cols)} FROM t " + " ".join(joins)


@register("group_features_fitted", _fitted_sql())
def group_features_fitted(spark, d):
    """What the levels' train rows say about test rows: one column wide enough for a stored table of levels, one aggregate of one's own."""
    train, test = line_halves(spark, d)
    train = train.withColumns({"price": F.log("l_extendedprice"), "size": F.sqrt("l_quantity")})
    state = groups.fit_groups(train, FITTED_CATS, ["price", "size"], list(FITTED), {"span": lambda x: F.max(x) - F.min(x)})
    made = groups.apply_groups(test, state)
    return rounded(made.select("l_orderkey", "l_linenumber", *[n for g in state.values() for n in g["default"]]), 6)


# ---- column checks ------------------------------------------------------------------------

@register("constant_columns", """
SELECT 'l_quantity' AS feature, false AS all_zero, false AS constant FROM lineitem HAVING count(DISTINCT l_quantity) > 1
UNION ALL SELECT 'zero', true, true FROM lineitem HAVING count(*) > 0
UNION ALL SELECT 'same', false, true FROM lineitem HAVING count(*) > 0
UNION ALL SELECT 'l_returnflag', false, count(DISTINCT l_returnflag) = 1 FROM lineitem""")
def constant_columns(spark, d):
    lines = table(spark, d, "lineitem").select("l_quantity", F.lit(0).alias("zero"), F.lit("x").alias("same"), "l_returnflag")
    return cleaning.constant_columns(lines)


@register("high_cardinality", """
SELECT 'c_name' AS feature, count(DISTINCT c_name) AS n_distinct FROM customer HAVING count(DISTINCT c_name) > 256
UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) FROM customer HAVING count(DISTINCT c_mktsegment) > 256""")
def high_cardinality(spark, d):
    return cleaning.high_cardinality(table(spark, d, "customer"))


@register("quasi_constant", """
WITH s AS (SELECT 'rare' AS feature, max(n) / sum(n) AS share FROM (SELECT l_linenumber = 7 AND l_quantity > 40 AS v, count(*) n FROM lineitem GROUP BY 1)
UNION ALL SELECT 'l_returnflag', max(n) / sum(n) FROM (SELECT l_returnflag, count(*) n FROM lineitem GROUP BY 1))
SELECT feature, round(share, 6) AS share FROM s WHERE share >= 0.9""")
def quasi_constant(spark, d):
    lines = table(spark, d, "lineitem").select(((F.col("l_linenumber") == 7) & (F.col("l_quantity") > 40)).alias("rare"), "l_returnflag")
    return rounded(cleaning.quasi_constant(lines, ["rare", "l_returnflag"]), 6)


@register("serial_columns", """
WITH e AS (SELECT event_id, event_id * 3 AS id, user_id, lag(event_id) OVER (ORDER BY event_id) p FROM events)
SELECT 'event_id' AS feature, bool_and(event_id - p = 1) AS serial FROM e
UNION ALL SELECT 'id', bool_and(event_id > p) FROM e
UNION ALL SELECT 'user_id', count(DISTINCT user_id) = count(*) FROM e""")
def serial_columns(spark, d):
    events = table(spark, d, "events").select("event_id", (F.col("event_id") * 3).alias("id"), "user_id")
    return cleaning.serial_columns(events, order_by=["event_id"])


@register("data_clean", """
SELECT user_id, event_type, value FROM events""")
def data_clean(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.lit(1).alias("one"), F.lit(0).alias("zero"),
                                              F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("tag"), F.col("value").alias("skip"))
    return cleaning.data_clean(events, exclude=["skip"])


@register("impute_constant", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN 'unknown' ELSE l_returnflag END AS flag,
  CASE WHEN l_linenumber = 5 THEN (SELECT l_linestatus FROM lineitem WHERE l_linenumber <> 5 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
  ELSE l_linestatus END AS status FROM lineitem""")
def impute_constant(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber",
                                               F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")).alias("flag"),
                                               F.when(F.col("l_linenumber") != 5, F.col("l_linestatus")).alias("status"))
    fill = imputation.fit_constants(lines, [], ["flag"]) | imputation.fit_constants(lines, [], ["status"], nominal_method="mode")
    return imputation.apply_constants(lines, fill)


@register("impute_mean", """
WITH h AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN l_quantity END q,
  CASE WHEN l_linenumber <> 4 THEN l_extendedprice END p FROM lineitem), s AS (SELECT avg(q) mq, median(p) mp FROM h)
SELECT l_orderkey, l_linenumber, round(coalesce(q, mq), 4) AS quantity, round(coalesce(p, mp), 4) AS price FROM h, s""")
def impute_mean(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber",
                                               F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("quantity"),
                                               F.when(F.col("l_linenumber") != 4, F.col("l_extendedprice")).alias("price"))
    fill = imputation.fit_constants(lines, ["quantity"], []) | imputation.fit_constants(lines, ["price"], [], method="median")
    return rounded(imputation.apply_constants(lines, fill), 4)


@register("impute_iterative_line", """
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem WHERE l_linenumber <> 3)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, round(CASE WHEN l_linenumber <> 3 THEN l_extendedprice ELSE i + s * l_quantity END, 4) AS l_extendedprice
FROM lineitem, f""")
def impute_iterative_line(spark, d):
    """One column with holes and one predictor: the equation is the least-squares line."""
    lines = table(spark, d, "lineitem")
    holed = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                         F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("l_extendedprice"))
    state = imputation.fit_chained(holed, ["l_quantity", "l_extendedprice"], ridge=0.0)
    return rounded(imputation.apply_chained(holed, state), 4, "l_extendedprice")


@register("impute_iterative")
def impute_iterative(spark, d):
    lines = table(spark, d, "lineitem")
    total = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    holed = lines.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                         F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("l_discount"),
                         F.when(F.col("l_linenumber") != 5, total).alias("total"))
    cols = ["l_quantity", "l_extendedprice", "l_discount", "total"]
    return imputation.apply_chained(holed, imputation.fit_chained(holed, cols, rounds=5))


def _two_holes_sql(rounds: int) -> str:
    """Both lines round by round: y is filled from x and x from y, the column with fewer holes first."""
    parts = ["""h AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 6 THEN l_quantity END AS x, CASE WHEN l_linenumber NOT IN (3, 4) THEN ln(l_extendedprice) END AS y FROM lineitem)""",
             "e0 AS (SELECT 0.0 AS a, 0.0 AS b, avg(y) AS c, 0.0 AS d FROM h)"]
    for n in range(1, rounds + 1):
        # x = a + b y over rows with x, y filled by the line of the round before; then y = c + d x over rows with y
        parts.append(f"f{n} AS (SELECT regr_intercept(x, coalesce(y, c + d * x)) AS a, regr_slope(x, coalesce(y, c + d * x)) AS b FROM h, e{n - 1} WHERE x IS NOT NULL)")
        parts.append(f"e{n} AS (SELECT any_value(a) AS a, any_value(b) AS b, regr_intercept(y, coalesce(x, a + b * y)) AS c, regr_slope(y, coalesce(x, a + b * y)) AS d FROM h, f{n} WHERE y IS NOT NULL)")
    return "WITH " + ", ".join(parts) + f"""
SELECT l_orderkey, l_linenumber, round(coalesce(x, a + b * coalesce(y, m)), 5) AS x, round(coalesce(y, c + d * coalesce(x, a + b * m)), 5) AS y
FROM h, e{rounds}, (SELECT avg(y) AS m FROM h)"""


@register("impute_iterative_two_holes", _two_holes_sql(3))
def impute_iterative_two_holes(spark, d):
    """Two columns with holes, each the other's predictor, for three rounds."""
    number = F.col("l_linenumber")
    holed = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(number != 6, F.col("l_quantity").cast("double")).alias("x"),
                                               F.when(~number.isin(3, 4), F.log("l_extendedprice")).alias("y"))
    state = imputation.fit_chained(holed, ["x", "y"], rounds=3, tolerance=0.0, ridge=0.0)
    return rounded(imputation.apply_chained(holed, state), 5, "x", "y")


MERGED = ["l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]


@register("merged_profile", f"WITH t AS (SELECT l_orderkey, {HOLES} AS l_quantity, l_extendedprice, l_returnflag, l_shipdate FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing, count({c}) AS count, " +
    (f"round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, "
     if c in MERGED[:3] else "NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value, ") +
    ("min(l_returnflag) AS min_text, max(l_returnflag) AS max_text, " if c == "l_returnflag" else "NULL AS min_text, NULL AS max_text, ") +
    "true AS near FROM t" for c in MERGED))
def merged_profile(spark, d):
    """Profile states of the lines by third of their numbers, merged without their rows; ``near``: the estimate is within 6 % of the distinct count."""
    lines = _with_holes(table(spark, d, "lineitem")).select("l_linenumber", *MERGED)
    parts = [merging.profile_state(lines.filter(F.col("l_linenumber") % 3 == i), MERGED) for i in range(3)]
    merged = merging.state_profile(merging.merge_states(reduce(DataFrame.unionByName, parts)))
    near = merged.join(distinct_counts(lines, MERGED, "column_name", "exact"), "column_name").withColumn("near", F.abs(F.col("nunique") / F.col("exact") - 1) <= 0.06)
    text = F.col("column_name") == "l_returnflag"
    shown = near.select("column_name", "n_missing", "count", "mean", "std", "min_value", "max_value",
                        F.when(text, F.col("min_text")).alias("min_text"), F.when(text, F.col("max_text")).alias("max_text"), "near")
    return rounded(shown, 6, "mean", "std")
