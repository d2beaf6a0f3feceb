"""Encoders, scalers and reduction."""
from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import encoding, scaling
from ..session import table
from .registry import CUT, TRAIN_SQL, line_halves, register, rounded


@register("one_hot", "SELECT o_orderkey, " + ", ".join(
    f"(o_orderpriority = '{p}')::INT AS \"o_orderpriority_{p}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders")
def one_hot(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return encoding.apply_one_hot(orders, encoding.fit_one_hot(orders, ["o_orderpriority"]))


@register("one_hot_sparse", "SELECT o_orderkey, " + ", ".join(
    f"(o_orderpriority = '{p}')::DOUBLE AS p{i}" for i, p in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "Unknown"))) + " FROM orders")
def one_hot_sparse(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    coded = encoding.apply_one_hot_sparse(orders, encoding.fit_label_codes(orders, ["o_orderpriority"]))
    return coded.select("o_orderkey", *[vector_to_array("o_orderpriority")[i].alias(f"p{i}") for i in range(6)])


@register("label_encode", """
WITH k AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS code FROM (SELECT DISTINCT o_orderstatus AS level FROM orders WHERE o_orderstatus <> 'F' UNION SELECT 'Unknown'))
SELECT o_orderkey, code AS o_orderstatus FROM orders JOIN k ON level = CASE WHEN o_orderstatus = 'F' THEN 'Unknown' ELSE o_orderstatus END""")
def label_encode(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    codes = encoding.fit_label_codes(orders.filter(F.col("o_orderstatus") != "F"), ["o_orderstatus"])
    return encoding.apply_label_codes(orders, codes)


def _order_levels(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("level"))
    return orders, encoding.fit_label_codes(orders, ["level"])


@register("label_encode_wide", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey::VARCHAR) - 1 AS level FROM orders")
def label_encode_wide(spark, d):
    orders, codes = _order_levels(spark, d)
    return encoding.apply_label_codes(orders, codes)


@register("label_decode_wide", "SELECT o_orderkey, o_orderkey::VARCHAR AS level FROM orders")
def label_decode_wide(spark, d):
    orders, codes = _order_levels(spark, d)
    return encoding.inverse_value_map(encoding.apply_label_codes(orders, codes), codes)


def _sigmoid(n: str) -> str:
    return f"(1 / (1 + exp(-({n} - 20) / 10.0)))"


@register("target_encode", f"""
WITH t AS ({TRAIN_SQL}), p AS (SELECT avg(l_extendedprice) m FROM t),
k AS (SELECT l_suppkey, l_linenumber, count(*) n, avg(l_extendedprice) a FROM t GROUP BY GROUPING SETS ((l_suppkey), (l_linenumber)))
SELECT l_orderkey, round(coalesce(m + (s.a - m) * {_sigmoid('s.n')}, m), 4) AS supplier, round(coalesce(m + (q.a - m) * {_sigmoid('q.n')}, m), 4) AS line
FROM lineitem x CROSS JOIN p LEFT JOIN (SELECT * FROM k WHERE l_linenumber IS NULL) s ON x.l_suppkey = s.l_suppkey
LEFT JOIN (SELECT * FROM k WHERE l_suppkey IS NULL) q ON x.l_linenumber = q.l_linenumber""")
def target_encode(spark, d):
    def view(t):
        return t.select("l_orderkey", F.col("l_suppkey").cast("string").alias("supplier"), F.col("l_linenumber").cast("string").alias("line"), "l_extendedprice")
    state = encoding.fit_target(view(line_halves(spark, d)[0]), ["supplier", "line"], F.col("l_extendedprice"))
    return rounded(encoding.apply_target(view(table(spark, d, "lineitem")).drop("l_extendedprice"), state), 4)


@register("target_encode_wide", f"""
WITH p AS (SELECT avg(l_extendedprice) m FROM lineitem), k AS (SELECT l_orderkey, count(*) n, avg(l_extendedprice) a FROM lineitem GROUP BY 1)
SELECT l_linenumber, l_suppkey, round(m + (a - m) * {_sigmoid('n')}, 4) AS orderkey FROM lineitem x JOIN k ON x.l_orderkey = k.l_orderkey, p""")
def target_encode_wide(spark, d):
    lines = table(spark, d, "lineitem").select("l_linenumber", "l_suppkey", F.col("l_orderkey").cast("string").alias("orderkey"), "l_extendedprice")
    state = encoding.fit_target(lines, ["orderkey"], F.col("l_extendedprice"))
    return rounded(encoding.apply_target(lines.drop("l_extendedprice"), state), 4)


def _class(c: str) -> str:
    return f"(p{c} + (a{c} - p{c}) * {_sigmoid('n')})"


@register("target_encode_multiclass", """
WITH p AS (SELECT avg((l_returnflag = 'A')::INT) pA, avg((l_returnflag = 'N')::INT) pN, avg((l_returnflag = 'R')::INT) pR FROM lineitem),
k AS (SELECT l_suppkey, count(*) n, avg((l_returnflag = 'A')::INT) aA, avg((l_returnflag = 'N')::INT) aN, avg((l_returnflag = 'R')::INT) aR FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, """ + ", ".join(f'round({_class(c)}, 6) AS "supplier_{c}"' for c in "ANR") + """
FROM lineitem x JOIN k ON x.l_suppkey = k.l_suppkey, p""")
def target_encode_multiclass(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("supplier"), "l_returnflag")
    state = encoding.fit_target_multiclass(lines, ["supplier"], "l_returnflag")
    return rounded(encoding.apply_target_multiclass(lines.drop("l_returnflag"), state), 6)


@register("shrinkage_encode", """
WITH k AS (SELECT l_suppkey, count(*) n, avg(l_extendedprice) a, var_pop(l_extendedprice) v FROM lineitem GROUP BY 1),
t AS (SELECT sum(n) n, count(*) g, sum(n * a) / sum(n) m, sum(n * v) / (sum(n) - count(*)) s2, (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) n0 FROM k),
b AS (SELECT greatest(0, (sum(k.n * pow(a - m, 2)) / (max(g) - 1) - max(s2)) / max(n0)) t2 FROM k, t)
SELECT l_orderkey, l_linenumber, round(CASE WHEN t2 > 0 THEN t2 / (t2 + s2 / k.n) ELSE 0 END * (a - m), 4) AS supplier
FROM lineitem x JOIN k ON x.l_suppkey = k.l_suppkey, t, b""")
def shrinkage_encode(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("supplier"), "l_extendedprice")
    state = encoding.fit_shrinkage(lines, ["supplier"], F.col("l_extendedprice"))
    return rounded(encoding.apply_target(lines.drop("l_extendedprice"), state), 4)


@register("shrinkage_encode_wide", """
WITH r AS (SELECT *, l_quantity + 10 * (l_orderkey % 7) AS y FROM lineitem),
k AS (SELECT l_orderkey, count(*) n, avg(y) a, var_pop(y) v FROM r GROUP BY 1),
t AS (SELECT sum(n) n, count(*) g, sum(n * a) / sum(n) m, sum(n * v) / (sum(n) - count(*)) s2, (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) n0 FROM k),
b AS (SELECT greatest(0, (sum(k.n * pow(a - m, 2)) / (max(g) - 1) - max(s2)) / max(n0)) t2 FROM k, t)
SELECT l_linenumber, l_suppkey, round(CASE WHEN t2 > 0 THEN t2 / (t2 + s2 / k.n) ELSE 0 END * (a - m), 4) AS orderkey
FROM lineitem x JOIN k ON x.l_orderkey = k.l_orderkey, t, b""")
def shrinkage_encode_wide(spark, d):
    lines = table(spark, d, "lineitem").select("l_linenumber", "l_suppkey", F.col("l_orderkey").cast("string").alias("orderkey"),
                                               (F.col("l_quantity") + 10 * (F.col("l_orderkey") % 7)).alias("y"))
    state = encoding.fit_shrinkage(lines, ["orderkey"], F.col("y"))
    return rounded(encoding.apply_target(lines.drop("y"), state), 4)


@register("shrinkage_encode_binary", """
WITH k AS (SELECT l_linenumber, count(*) n, avg((l_linestatus <> 'F')::INT) a FROM lineitem GROUP BY 1),
e AS (SELECT *, ln((n * a + 0.5) / (n * (1 - a) + 0.5)) lo, 1 / (n * a + 0.5) + 1 / (n * (1 - a) + 0.5) s FROM k),
m AS (SELECT sum(n * lo) / sum(n) m, avg(s) s0, count(*) g FROM e),
t AS (SELECT greatest(0, sum(pow(lo - m, 2)) / (max(g) - 1) - max(s0)) t2 FROM e, m)
SELECT l_orderkey, x.l_linenumber::VARCHAR AS number, round(CASE WHEN t2 > 0 THEN t2 / (t2 + s) ELSE 0 END * (lo - m), 8) AS line
FROM lineitem x JOIN e ON x.l_linenumber = e.l_linenumber, m, t""")
def shrinkage_encode_binary(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("line"), "l_linestatus")
    state = encoding.fit_shrinkage(lines, ["line"], encoding.binary_target(lines, "l_linestatus"), binomial=True)
    out = lines.select("l_orderkey", F.col("line").alias("number"), "line")
    return rounded(encoding.apply_target(out, state), 8)


@register("inverse_value_map", "SELECT l_orderkey, l_linenumber, l_suppkey::VARCHAR AS supplier FROM lineitem")
def inverse_value_map(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("supplier"), "l_extendedprice")
    state = encoding.fit_target(lines, ["supplier"], F.col("l_extendedprice"))
    coded = encoding.apply_target(lines.drop("l_extendedprice"), state)
    return encoding.inverse_value_map(coded, state["maps"])


@register("standardize", """
SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity,
 round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) AS l_extendedprice, 0.0::DOUBLE AS same FROM lineitem""")
def standardize(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.lit(4.0).alias("same"))
    return rounded(scaling.apply_standard(lines, scaling.fit_standard(lines, ["l_quantity", "l_extendedprice", "same"])), 6)


@register("min_max_scale", f"""
WITH t AS ({TRAIN_SQL}), s AS (SELECT min(l_quantity) a, max(l_quantity) b, min(l_extendedprice) c, max(l_extendedprice) e FROM t)
SELECT l_orderkey, l_linenumber, round((l_quantity - a) / (b - a), 6) AS l_quantity, round((l_extendedprice - c) / (e - c), 6) AS l_extendedprice FROM lineitem, s""")
def min_max_scale(spark, d):
    cols = ["l_quantity", "l_extendedprice"]
    state = scaling.fit_min_max(line_halves(spark, d)[0], cols)
    return rounded(scaling.apply_min_max(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *cols), state), 6)


@register("min_max_inverse", "SELECT l_orderkey, l_linenumber, round(l_quantity, 4) AS l_quantity, round(l_extendedprice, 4) AS l_extendedprice FROM lineitem")
def min_max_inverse(spark, d):
    cols = ["l_quantity", "l_extendedprice"]
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *cols)
    state = scaling.fit_min_max(lines, cols)
    return rounded(scaling.invert_min_max(scaling.apply_min_max(lines, state), state), 4)


@register("pca_pair", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS q, l_extendedprice / 1000 AS p FROM lineitem),
c AS (SELECT avg(q) AS mq, avg(p) AS mp, var_samp(q) AS a, var_samp(p) AS b, covar_samp(q, p) AS k FROM x),
e AS (SELECT *, (a + b) / 2 + sqrt(pow((a - b) / 2, 2) + k * k) AS top FROM c),
v AS (SELECT *, k / sqrt(k * k + pow(top - a, 2)) AS vq, (top - a) / sqrt(k * k + pow(top - a, 2)) AS vp FROM e),
s AS (SELECT *, CASE WHEN (CASE WHEN abs(vq) >= abs(vp) THEN vq ELSE vp END) < 0 THEN -1 ELSE 1 END AS sign1,
  CASE WHEN (CASE WHEN abs(vp) >= abs(vq) THEN -vp ELSE vq END) < 0 THEN -1 ELSE 1 END AS sign2 FROM v)
SELECT l_orderkey, l_linenumber, l_partkey, round(sign1 * ((q - mq) * vq + (p - mp) * vp), 3) + 0.0 AS pca_0,
 round(sign2 * ((q - mq) * -vp + (p - mp) * vq), 3) + 0.0 AS pca_1 FROM x, s""")
def pca_pair(spark, d):
    """Both components of two columns, which have a closed form."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", (F.col("l_extendedprice") / 1000).alias("price"))
    return rounded(scaling.apply_pca(lines, scaling.fit_pca(lines, ["l_quantity", "price"], 0.99999)), 3, "pca_0", "pca_1")


@register("pca")
def pca(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_extendedprice") / 1000).alias("price"),
                                               F.col("l_discount") * 100, (F.col("l_quantity") * 2 + F.col("l_tax")).alias("twice"))
    lines = lines.toDF("l_orderkey", "l_linenumber", "l_quantity", "price", "discount", "twice")
    return scaling.apply_pca(lines, scaling.fit_pca(lines, ["l_quantity", "price", "discount", "twice"], 0.9))
