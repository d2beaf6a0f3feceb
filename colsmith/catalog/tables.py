"""Reading, projecting, cleaning, joining and splitting tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, encoding, profiling, reshape, roles
from ..session import table
from ..sources.tables import read_table
from .registry import CUT, TEST_SQL, TRAIN_SQL, line_halves, register, rounded


@register("scan_select", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity < 24""")
def scan_select(spark, d):
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    return read_table(spark, f"{d}/lineitem.parquet", usecols=cols).filter(F.col("l_quantity") < 24)


@register("column_filter", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def column_filter(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")


@register("role_select", """
SELECT c_custkey, c_acctbal, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer""")
def role_select(spark, d):
    customer = table(spark, d, "customer").withColumn("parts", F.array(F.lit(1)))      # not a tabular type: dropped
    return roles.select_roles(customer, {"c_nationkey": "category"})


@register("rename_columns", """
SELECT o_orderkey AS column_0, o_totalprice AS column_1, o_orderstatus AS label, o_orderpriority AS priority FROM orders""")
def rename_columns(spark, d):
    named = table(spark, d, "orders").select(F.col("o_orderkey").alias("注文"), F.col("o_totalprice").alias("価格"),
                                             "o_orderstatus", F.col("o_orderpriority").alias("priority"))
    return roles.rename_columns(named, roles.rename_plan(named.columns, "o_orderstatus"))


@register("near_target", """
WITH s AS (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, s
WHERE l_extendedprice BETWEEN least(greatest(30000.0, lo), hi) - 0.1 * (hi - lo) AND least(greatest(30000.0, lo), hi) + 0.1 * (hi - lo)""")
def near_target(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return cleaning.near_target(lines, "l_extendedprice", 30000.0, 0.1)


@register("purge_impurities", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price FROM lineitem
WHERE NOT (l_returnflag = 'A' AND l_linenumber = 7) AND NOT (l_returnflag = 'R' AND l_linenumber = 1)""")
def purge_impurities(spark, d):
    lines = table(spark, d, "lineitem")
    odd = F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 7), "missing") \
        .when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), "n/k")
    dirty = lines.select("l_orderkey", "l_linenumber", F.coalesce(odd, F.col("l_extendedprice").cast("string")).alias("price"))
    return rounded(cleaning.purge_impurities(dirty)[0], 2)


@register("narrow_types", """
WITH i AS (
  SELECT 'l_orderkey' AS feature, min(l_orderkey) lo, max(l_orderkey) hi FROM lineitem UNION ALL
  SELECT 'l_partkey', min(l_partkey), max(l_partkey) FROM lineitem UNION ALL
  SELECT 'l_suppkey', min(l_suppkey), max(l_suppkey) FROM lineitem UNION ALL
  SELECT 'l_linenumber', min(l_linenumber), max(l_linenumber) FROM lineitem),
f AS (
  SELECT 'l_quantity' AS feature, bool_and(l_quantity::FLOAT::DOUBLE = l_quantity) ok FROM lineitem UNION ALL
  SELECT 'l_extendedprice', bool_and(l_extendedprice::FLOAT::DOUBLE = l_extendedprice) FROM lineitem UNION ALL
  SELECT 'l_discount', bool_and(l_discount::FLOAT::DOUBLE = l_discount) FROM lineitem UNION ALL
  SELECT 'l_tax', bool_and(l_tax::FLOAT::DOUBLE = l_tax) FROM lineitem)
SELECT feature, CASE WHEN lo > -128 AND hi < 127 THEN 'tinyint' WHEN lo > -32768 AND hi < 32767 THEN 'smallint'
  WHEN lo > -2147483648 AND hi < 2147483647 THEN 'int' ELSE 'bigint' END AS type FROM i
UNION ALL SELECT feature, CASE WHEN ok THEN 'float' ELSE 'double' END FROM f""")
def narrow_types(spark, d):
    return spark.createDataFrame(list(roles.narrow_plan(table(spark, d, "lineitem")).items()), "feature string, type string")


@register("parse_time", """
SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS seconds, 'M/d/yyyy H:mm' AS layout FROM orders""")
def parse_time(spark, d):
    text = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "M/d/yyyy H:mm").alias("t"))
    found = roles.infer_time_formats(text, ["t"])
    return roles.apply_time_formats(text, found).select(
        "o_orderkey", F.unix_timestamp(F.col("t")).alias("seconds"), F.lit(found["t"]).alias("layout"))


@register("inf_to_null", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 6) END AS ratio FROM lineitem""")
def inf_to_null(spark, d):
    lines = table(spark, d, "lineitem")
    by_zero = F.when(F.col("l_tax") > 0, float("inf")).otherwise(float("nan"))
    ratio = F.when(F.col("l_discount") == 0, by_zero).otherwise(F.try_divide("l_tax", "l_discount"))
    return rounded(cleaning.infinite_to_null(lines.select("l_orderkey", "l_linenumber", ratio.alias("ratio"))), 6)


@register("null_tokens", """
SELECT o_orderkey, CASE WHEN o_orderstatus IN ('P', 'F') THEN NULL ELSE o_orderstatus END AS status, o_orderpriority FROM orders""")
def null_tokens(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "NA").when(F.col("o_orderstatus") == "F", "na").otherwise(F.col("o_orderstatus"))
    return cleaning.null_tokens(table(spark, d, "orders").select("o_orderkey", status.alias("status"), "o_orderpriority"))


@register("strip_non_numeric", """
SELECT c_custkey, CAST(regexp_replace(c_name, '[^0-9.]', '', 'g') AS DOUBLE) AS number FROM customer""")
def strip_non_numeric(spark, d):
    return table(spark, d, "customer").select("c_custkey", cleaning.strip_non_numeric(F.col("c_name")).alias("number"))


@register("clean_text", "SELECT p_partkey, lower(p_type) AS p_type, lower(p_brand) AS p_brand FROM part")
def clean_text(spark, d):
    padded = table(spark, d, "part").select("p_partkey", F.concat(F.lit("  "), "p_type", F.lit(" ")).alias("p_type"), "p_brand")
    return cleaning.clean_text(padded)


@register("split_alnum", """
SELECT p_partkey, p_brand, regexp_extract_all(p_brand, '([A-Za-z]+|[^A-Za-z]+)')[2] AS p_brand_1 FROM part""")
def split_alnum(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    return cleaning.apply_split_alnum(part, "p_brand", cleaning.fit_split_alnum(part, "p_brand"))


@register("winsorize", """
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) a, quantile_cont(l_extendedprice, 0.99) b,
                  quantile_cont(l_quantity, 0.01) c, quantile_cont(l_quantity, 0.99) e FROM lineitem)
SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, a), b), 4) AS l_extendedprice,
       round(least(greatest(l_quantity, c), e), 4) AS l_quantity FROM lineitem, q""")
def winsorize(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return rounded(cleaning.apply_winsor(lines, cleaning.fit_winsor(lines, ["l_extendedprice", "l_quantity"])), 4)


@register("iqr_outliers", """
WITH q AS (SELECT quantile_cont(value, 0.25) a, quantile_cont(value, 0.75) b FROM events)
SELECT event_id, event_type, value FROM events, q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""")
def iqr_outliers(spark, d):
    return cleaning.iqr_outliers(table(spark, d, "events").select("event_id", "event_type", "value"), "value", 1.5)


@register("drop_near_duplicates", """
WITH g AS (SELECT event_id, sqrt(pow(user_id - lag(user_id) OVER w, 2) + pow(value - lag(value) OVER w, 2)) AS distance
           FROM events WINDOW w AS (ORDER BY ts, event_id)),
q AS (SELECT quantile_cont(distance, 0.25) AS cutoff FROM g)
SELECT event_id, user_id, round(value, 6) AS value FROM g JOIN events USING (event_id), q WHERE distance >= cutoff""")
def drop_near_duplicates(spark, d):
    events = table(spark, d, "events").select("event_id", "ts", "user_id", "value")
    kept = cleaning.drop_near_duplicates(events, ["ts", "event_id"], 0.25, ["user_id", "value"])
    return rounded(kept.select("event_id", "user_id", "value"), 6)


@register("drop_duplicate_rows", """
SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem""")
def drop_duplicate_rows(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount").dropDuplicates()


@register("top_k_filter", """
SELECT p_partkey, p_brand FROM part WHERE p_brand IN (
  SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 10)""")
def top_k_filter(spark, d):
    return profiling.top_k_filter(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", 10)


# ---- joins, unions, splits ----------------------------------------------------------------

@register("label_combine", """
SELECT a.o_orderkey, a.o_totalprice, a.o_custkey, b.o_orderpriority AS label
FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey""")
def label_combine(spark, d):
    orders = table(spark, d, "orders")
    return reshape.label_combine(orders.select("o_orderkey", "o_totalprice", "o_custkey"),
                                 orders.select("o_orderkey", F.col("o_orderpriority").alias("label")), "o_orderkey")


@register("label_combine_positional", """
SELECT a.o_orderkey, b.price_key, b.price FROM
 (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) p FROM orders) a JOIN
 (SELECT o_orderkey AS price_key, o_totalprice AS price, row_number() OVER (ORDER BY o_totalprice, o_orderkey) p FROM orders) b
 ON a.p = b.p""")
def label_combine_positional(spark, d):
    orders = table(spark, d, "orders")
    right = orders.select(F.col("o_orderkey").alias("price_key"), F.col("o_totalprice").alias("price"))
    return reshape.label_combine(orders.select("o_orderkey"), right, order_by=(["o_orderkey"], ["price", "price_key"]))


@register("value_map", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.75 WHEN '3-MEDIUM' THEN 0.5 END::DOUBLE AS urgency
FROM orders""")
def value_map(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    codes = {"1-URGENT": 1.0, "2-HIGH": 0.75, "3-MEDIUM": 0.5}
    return encoding.map_values(orders, {"o_orderpriority": codes}, out={"o_orderpriority": "urgency"}).drop("o_orderpriority")


def _month():
    return F.date_format("l_shipdate", "yyyy-MM").alias("month")


@register("category_mismatch", f"""
WITH t AS (SELECT strftime(l_shipdate, '%Y-%m') AS level, count(*) n FROM ({TRAIN_SQL}) GROUP BY 1),
     s AS (SELECT strftime(l_shipdate, '%Y-%m') AS level, count(*) n FROM ({TEST_SQL}) GROUP BY 1)
SELECT level, coalesce(t.n, 0)::BIGINT AS n_train, coalesce(s.n, 0)::BIGINT AS n_test FROM t FULL JOIN s USING (level)
WHERE t.n IS NULL OR s.n IS NULL""")
def category_mismatch(spark, d):
    train, test = (t.select(_month()) for t in line_halves(spark, d))
    return reshape.category_mismatch(train, test, "month")


@register("combine", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def combine(spark, d):
    first, second = (t.select("l_orderkey", "l_linenumber", "l_quantity") for t in line_halves(spark, d))
    return reshape.combine(first, second)


@register("tagged_union", f"""
SELECT l_orderkey, l_linenumber, l_quantity, 'train' AS dataset FROM ({TRAIN_SQL}) UNION ALL
SELECT l_orderkey, l_linenumber, l_quantity, 'test' FROM ({TEST_SQL})""")
def tagged_union(spark, d):
    first, second = (t.select("l_orderkey", "l_linenumber", "l_quantity") for t in line_halves(spark, d))
    return reshape.tagged_union(first, second)


@register("split_holdout", """
WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) p, count(*) OVER () n FROM orders)
SELECT o_orderkey, o_totalprice, CASE WHEN p <= n - ceil(0.2 * n) THEN 'train' ELSE 'test' END AS part FROM r""")
def split_holdout(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return reshape.tagged_union(*reshape.split(orders, 0.2, ["o_orderkey"], shuffle=False), tag="part")


@register("split_shuffled", """
SELECT part, n FROM (SELECT 'test' AS part, CAST(ceil(0.2 * count(*)) AS BIGINT) AS n FROM orders UNION ALL
SELECT 'train', CAST(count(*) - ceil(0.2 * count(*)) AS BIGINT) FROM orders)""")
def split_shuffled(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    both = reshape.tagged_union(*reshape.split(orders, 0.2, ["o_orderkey"], seed=3), tag="part")
    return both.groupBy("part").agg(F.count_distinct("o_orderkey").alias("n"))


@register("sample_rows", """
SELECT least(count(*), 1200) AS n, least(count(*), 1200) AS n_known FROM orders""")
def sample_rows(spark, d):
    orders = table(spark, d, "orders")
    picked = reshape.sample_rows(orders, 1200, ["o_orderkey"], seed=4)
    known = picked.select("o_orderkey").distinct().join(orders.select("o_orderkey"), "o_orderkey", "left_semi")
    return picked.agg(F.count(F.lit(1)).alias("n")).withColumn("n_known", F.lit(known.count()))


@register("split_stratified", """
WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) p,
                  count(*) OVER (PARTITION BY o_orderstatus) n FROM orders)
SELECT o_orderkey, o_orderstatus, CASE WHEN p > n - round(0.2 * n) THEN 'test' ELSE 'train' END AS part FROM r""")
def split_stratified(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return reshape.tagged_union(*reshape.split(orders, 0.2, ["o_orderkey"], shuffle=False, stratify=["o_orderstatus"]), tag="part")


@register("split_stratified_nulls", """
WITH o AS (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY o_orderkey) p, count(*) OVER (PARTITION BY status) n FROM o)
SELECT o_orderkey, status, CASE WHEN p > n - round(0.2 * n) THEN 'test' ELSE 'train' END AS part FROM r""")
def split_stratified_nulls(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("status"))
    return reshape.tagged_union(*reshape.split(orders, 0.2, ["o_orderkey"], shuffle=False, stratify=["status"]), tag="part")


@register("frames_differ", """
WITH a AS (SELECT l_returnflag, l_linenumber, l_quantity, count(*) n FROM lineitem GROUP BY ALL),
b AS (SELECT l_returnflag, l_linenumber, CASE WHEN l_linenumber = 7 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, count(*) n
      FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linenumber, l_quantity, coalesce(a.n, 0)::BIGINT AS n_first, coalesce(b.n, 0)::BIGINT AS n_second
FROM a FULL JOIN b USING (l_returnflag, l_linenumber, l_quantity) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def frames_differ(spark, d):
    first = table(spark, d, "lineitem").select("l_returnflag", "l_linenumber", "l_quantity")
    bumped = F.when(F.col("l_linenumber") == 7, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    return reshape.frames_differ(first, first.withColumn("l_quantity", bumped))


@register("check_format", f"""
SELECT 3101 AS code, 'label' AS detail, count(*)::BIGINT AS n FROM lineitem WHERE l_linenumber = 3 AND l_shipdate < TIMESTAMP '{CUT}'
UNION ALL SELECT 3204, 'l_tax', 1
UNION ALL SELECT 3104, label, count(*) FROM (SELECT 'R' || CAST(l_suppkey % 7 AS VARCHAR) AS label FROM ({TEST_SQL})
  WHERE l_returnflag = 'R') GROUP BY label""")
def check_format(spark, d):
    train, test = line_halves(spark, d)
    train = train.select("l_quantity", "l_tax", F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")).alias("label"))
    odd = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("R"), (F.col("l_suppkey") % 7).cast("string"))).otherwise(F.col("l_returnflag"))
    return reshape.check_format(train, test.select("l_quantity", odd.alias("label")), "label")


@register("duplicate_features", """
SELECT * FROM (VALUES ('copy_of_price', 'l_extendedprice'), ('same_flag', 'l_returnflag')) t(feature, same_as)
WHERE (SELECT count(*) FROM lineitem) > 0""")
def duplicate_features(spark, d):
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag", "l_linestatus",
        F.col("l_extendedprice").alias("copy_of_price"), F.col("l_returnflag").alias("same_flag"), "l_tax")
    return reshape.duplicate_features(lines, ["l_orderkey", "l_linenumber", "l_partkey"])
