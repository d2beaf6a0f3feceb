"""Association between columns and drift between tables."""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import association, drift, modeling
from ..session import table
from .registry import LINE_NUMERIC, TEST_SQL, TRAIN_SQL, line_halves, register, rounded

# numeric columns with some dependence between them
MIXED = "(SELECT *, l_extendedprice * (1 - l_discount) AS net, l_quantity * l_quantity AS square FROM lineitem)"


def _mixed(spark, d):
    return table(spark, d, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount"))) \
        .withColumn("square", F.col("l_quantity") * F.col("l_quantity"))


MIXED_COLS = ["l_quantity", "l_extendedprice", "l_discount", "net", "square"]


@register("pearson_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM {MIXED}" for a, b in combinations(MIXED_COLS, 2)))
def pearson_matrix(spark, d):
    return rounded(association.pearson_matrix(_mixed(spark, d), MIXED_COLS), 6)


WIDE = [f"w{i}" for i in range(18)]


@register("pearson_matrix_wide", "WITH w AS (SELECT " + ", ".join(
    f"CASE WHEN l_linenumber <> {i % 7 + 1} THEN l_quantity * {i + 1} + l_extendedprice / {i + 1} END AS w{i}" for i in range(18)) +
    " FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM w" for a, b in combinations(WIDE, 2)))
def pearson_matrix_wide(spark, d):
    lines = table(spark, d, "lineitem")
    wide = lines.select(*[F.when(F.col("l_linenumber") != i % 7 + 1, F.col("l_quantity") * (i + 1) + F.col("l_extendedprice") / (i + 1)).alias(f"w{i}")
                          for i in range(18)])
    return rounded(association.pearson_matrix(wide, WIDE), 6)


@register("cross_corr", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(least(1, greatest(-1, corr({a}, {b}))), 6) AS r FROM {MIXED}"
    for a in ("l_quantity", "l_tax") for b in ("net", "square")))
def cross_corr(spark, d):
    return rounded(association.cross_corr(_mixed(spark, d), ["l_quantity", "l_tax"], ["net", "square"]), 6)


@register("top_correlated", f"""
SELECT feature, round(r, 6) AS r FROM ({' UNION ALL '.join(f"SELECT '{c}' AS feature, corr({c}, net) AS r FROM {MIXED}"
                                                            for c in ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'square'])})
ORDER BY abs(r) DESC, feature LIMIT 3""")
def top_correlated(spark, d):
    return rounded(association.top_correlated(_mixed(spark, d), ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "square"], "net"), 6)


@register("corr_levels", f"""
SELECT feature, r, CASE WHEN abs(r) <= 0.25 THEN 'micro' WHEN abs(r) <= 0.5 THEN 'low' WHEN abs(r) <= 0.75 THEN 'medium' ELSE 'high' END AS level
FROM (SELECT feature, round(r, 2) AS r FROM ({' UNION ALL '.join(f"SELECT '{c}' AS feature, corr({c}, net) AS r FROM {MIXED}" for c in ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'square'])}))""")
def corr_levels(spark, d):
    return association.corr_levels(_mixed(spark, d), ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "square"], "net")


MANY = [f"w{i}" for i in range(34)]


@register("corr_levels_many", "WITH w AS (SELECT l_extendedprice AS y, " + ", ".join(
    f"l_quantity * {3 * i + 1} - l_discount * {100 * (i % 5)} + l_extendedprice / {i + 1} AS {c}" for i, c in enumerate(MANY)) + """ FROM lineitem)
SELECT feature, r, CASE WHEN abs(r) <= 0.25 THEN 'micro' WHEN abs(r) <= 0.5 THEN 'low' WHEN abs(r) <= 0.75 THEN 'medium' ELSE 'high' END AS level
FROM (SELECT feature, round(r, 2) AS r FROM (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, y) AS r FROM w" for c in MANY) + "))")
def corr_levels_many(spark, d):
    """More columns than a chart shows: all are graded."""
    q, p, disc = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")
    wide = table(spark, d, "lineitem").select(p.alias("y"), *[(q * (3 * i + 1) - disc * (100 * (i % 5)) + p / (i + 1)).alias(c) for i, c in enumerate(MANY)])
    return association.corr_levels(wide, MANY, "y")


@register("label_corr_filter", f"""
SELECT feature, round(r, 6) AS r, abs(r) >= 0.1 AS keep FROM ({' UNION ALL '.join(
    f"SELECT '{c}' AS feature, corr({c}, net) AS r FROM {MIXED}" for c in ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'])})""")
def label_corr_filter(spark, d):
    return rounded(association.label_corr_filter(_mixed(spark, d), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "net", 0.1), 6)


def _rank(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


@register("spearman", f"""
WITH r AS (SELECT {_rank('l_quantity')} a, {_rank('l_discount')} b, {_rank('net')} c FROM {MIXED})
SELECT 'l_quantity' AS a, 'l_discount' AS b, round(corr(r.a, r.b), 6) AS rho FROM r UNION ALL
SELECT 'l_quantity', 'net', round(corr(r.a, r.c), 6) FROM r UNION ALL SELECT 'l_discount', 'net', round(corr(r.b, r.c), 6) FROM r""")
def spearman(spark, d):
    return rounded(association.spearman_matrix(_mixed(spark, d), ["l_quantity", "l_discount", "net"]), 6)


def _pair_rho(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS a, '{b}' AS b, round(corr(x, y), 6) AS rho FROM (SELECT {_rank(a)} x, {_rank(b)} y
 FROM {HOLED} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


HOLED = "(SELECT l_quantity, CASE WHEN l_linenumber <> 1 THEN l_discount END AS l_discount, CASE WHEN l_linenumber <> 2 THEN l_extendedprice END AS l_extendedprice FROM lineitem)"


@register("spearman_nulls", " UNION ALL ".join(_pair_rho(a, b) for a, b in combinations(["l_quantity", "l_discount", "l_extendedprice"], 2)))
def spearman_nulls(spark, d):
    number = F.col("l_linenumber")
    holed = table(spark, d, "lineitem").select("l_quantity", F.when(number != 1, F.col("l_discount")).alias("l_discount"),
                                               F.when(number != 2, F.col("l_extendedprice")).alias("l_extendedprice"))
    return rounded(association.spearman_matrix(holed, ["l_quantity", "l_discount", "l_extendedprice"]), 6)


NOMINAL = "(SELECT l_returnflag, l_linestatus, l_linenumber::VARCHAR AS line, l_returnflag || (l_linenumber % 2)::VARCHAR AS mix FROM lineitem)"


def _nominal(spark, d):
    line = F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", line.cast("string").alias("line"),
                                              F.concat("l_returnflag", (line % 2).cast("string")).alias("mix"))


NOMINAL_COLS = ["l_returnflag", "l_linestatus", "line", "mix"]


def _cramer_sql(a: str, b: str, source: str) -> str:
    return f"""(SELECT coalesce(sqrt(greatest(sum(n * n / (nu * nv)) - 1, 0) / (least(count(DISTINCT u), count(DISTINCT v)) - 1)), 0) FROM (
 SELECT u, v, n::DOUBLE n, (sum(n) OVER (PARTITION BY u))::DOUBLE nu, (sum(n) OVER (PARTITION BY v))::DOUBLE nv
 FROM (SELECT {a} u, {b} v, count(*) n FROM {source} GROUP BY 1, 2)))"""


@register("cramers_v", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round({_cramer_sql(a, b, NOMINAL)}, 6) AS v" for a, b in combinations(NOMINAL_COLS, 2)))
def cramers_v(spark, d):
    return rounded(association.cramers_v(_nominal(spark, d), list(combinations(NOMINAL_COLS, 2))), 6)


def _eta_sql(x: str, g: str, source: str) -> str:
    return f"""(SELECT sum(n * pow(a - m, 2)) / max(t) FROM (SELECT count(*) n, avg({x}) a FROM {source} GROUP BY {g}),
 (SELECT avg({x}) m, var_samp({x}) * count(*) t FROM {source}))"""


@register("correlation_ratio", " UNION ALL ".join(
    f"SELECT '{x}' AS feature, '{g}' AS by, round({_eta_sql(x, g, 'lineitem')}, 8) AS ratio"
    for x in ("l_extendedprice", "l_quantity", "l_discount") for g in ("l_returnflag", "l_linenumber", "l_suppkey")))
def correlation_ratio(spark, d):
    return rounded(association.correlation_ratio(table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity", "l_discount"],
                                                 ["l_returnflag", "l_linenumber", "l_suppkey"]), 8)


@register("correlated_columns", f"""
WITH n AS (SELECT 'flag_copy' AS dropped, 'l_returnflag' AS kept, 'nominal' AS kind,
  {_cramer_sql('l_returnflag', "lower(l_returnflag)", 'lineitem')} AS v),
m AS (SELECT 'l_extendedprice' AS dropped, 'net' AS kept, 'numeric' AS kind, corr(l_extendedprice, net) AS v FROM {MIXED}
 UNION ALL SELECT 'l_quantity', 'square', 'numeric', corr(l_quantity, square) FROM {MIXED})
SELECT dropped, kept, kind FROM (SELECT * FROM n UNION ALL SELECT * FROM m) WHERE v > 0.95""")
def correlated_columns(spark, d):
    lines = _mixed(spark, d).withColumn("flag_copy", F.lower("l_returnflag"))
    found = association.correlated_columns(lines, ["l_returnflag", "l_linestatus", "flag_copy"], MIXED_COLS)
    return spark.createDataFrame(found, "dropped string, kept string, kind string")


LEVELS_200 = "(SELECT 'p' || l_partkey % 200 AS u, 'q' || (l_partkey % 200) * 7 AS v, 's' || l_orderkey % 150 AS w FROM lineitem)"


@register("correlated_columns_levels", f"""
SELECT dropped, kept, 'nominal' AS kind FROM (SELECT 'v' AS dropped, 'u' AS kept, {_cramer_sql('u', 'v', LEVELS_200)} AS x
 UNION ALL SELECT 'w', 'u', {_cramer_sql('u', 'w', LEVELS_200)}) WHERE x > 0.95""")
def correlated_columns_levels(spark, d):
    """Pairs of 200 by 200 and 200 by 150 levels are compared like any other."""
    part = F.col("l_partkey") % 200
    lines = table(spark, d, "lineitem").select(F.concat(F.lit("p"), part).alias("u"), F.concat(F.lit("q"), part * 7).alias("v"),
                                               F.concat(F.lit("s"), F.col("l_orderkey") % 150).alias("w"))
    return spark.createDataFrame(association.correlated_columns(lines, ["u", "v", "w"], [], cell_limit=None), "dropped string, kept string, kind string")


@register("candidate_filter", f"""
WITH r AS (SELECT {_rank('l_quantity')} q, {_rank('l_extendedprice')} p, {_rank('net')} n, {_rank('l_quantity * l_extendedprice')} x FROM {MIXED}),
c AS (SELECT greatest(abs(corr(q, n)), abs(corr(p, n))) net, greatest(abs(corr(q, x)), abs(corr(p, x)), abs(corr(n, x))) prod FROM r)
SELECT feature FROM (SELECT 'square' AS feature, 1.0 AS top UNION ALL SELECT 'net', net FROM c UNION ALL SELECT 'prod', prod FROM c) WHERE top <= 0.9""")
def candidate_filter(spark, d):
    lines = _mixed(spark, d).withColumn("prod", F.col("l_quantity") * F.col("l_extendedprice"))
    kept = association.candidate_filter(lines, ["square", "net", "prod"], ["l_quantity", "l_extendedprice"])
    return spark.createDataFrame([(c,) for c in kept], "feature string")


# turned where the other side is null: ranks of the whole column and ranks of the common rows tell different stories
HOLES = {"price": ("l_extendedprice", "l_linenumber <> 1"), "turned": ("CASE WHEN l_linenumber = 1 THEN -l_extendedprice ELSE l_extendedprice END", "l_linenumber <> 2"),
         "net": ("l_extendedprice * (1 - l_discount)", "l_linenumber <> 1"), "quantity": ("l_quantity", "l_linenumber <> 3"),
         "square": ("l_quantity * l_quantity", "l_linenumber < 6"), "discount": ("l_discount", "l_orderkey % 5 <> 0"),
         "prod": ("l_discount * l_extendedprice", "l_orderkey % 5 <> 0"), "mix": ("l_tax + l_discount", "l_orderkey % 3 <> 0"), "tax": ("l_tax", "true")}


def _holes_sql(cols: list[str], width: int) -> str:
    rho = " UNION ALL ".join(f"""SELECT '{b}' AS feature, abs(corr(x, y)) AS r FROM (SELECT {_rank(a)} x, {_rank(b)} y FROM h WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
                             for a, b in combinations(cols, 2))
    return f"SELECT {width} AS width, feature FROM ({rho}) GROUP BY feature HAVING max(r) <= 0.9"


@register("candidate_filter_nulls", "WITH h AS (SELECT " + ", ".join(f"CASE WHEN {ok} THEN {x} END AS {c}" for c, (x, ok) in HOLES.items()) + " FROM lineitem) "
          + _holes_sql(list(HOLES)[:6], 6) + " UNION ALL " + _holes_sql(list(HOLES)[:7], 7) + " UNION ALL " + _holes_sql(list(HOLES), 9))
def candidate_filter_nulls(spark, d):
    """Columns with nulls in different rows: the verdict on a column is the same beside six, seven or nine others."""
    holed = table(spark, d, "lineitem").select(*[F.expr(f"CASE WHEN {ok} THEN {x} END").alias(c) for c, (x, ok) in HOLES.items()])
    rows = [(width, c) for width in (6, 7, 9) for c in association.candidate_filter(holed, list(HOLES)[1:width], list(HOLES)[:1])]
    return spark.createDataFrame(rows, "width int, feature string")


# ---- drift --------------------------------------------------------------------------------

# a category with a label-dependent and a time-dependent share, so that drift is visible
SHIFT = "CASE WHEN l_shipdate >= TIMESTAMP '2001-01-01' AND l_linenumber > 5 THEN 'late' ELSE l_linestatus END"
A = f"(SELECT l_returnflag, l_linestatus, l_extendedprice, l_quantity, l_discount, {SHIFT} AS state, l_linenumber::VARCHAR AS line FROM ({TRAIN_SQL}))"
B = (f"(SELECT l_returnflag, l_linestatus, l_extendedprice + CASE WHEN l_returnflag = 'N' THEN 2500 ELSE 0 END AS l_extendedprice, l_quantity, l_discount, "
     f"{SHIFT} AS state, l_linenumber::VARCHAR AS line FROM ({TEST_SQL}))")


def _halves(spark, d):
    late = (F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp_ntz")) & (F.col("l_linenumber") > 5)
    state = F.when(late, "late").otherwise(F.col("l_linestatus"))
    train, test = (t.select("l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity", "l_discount", state.alias("state"),
                            F.col("l_linenumber").cast("string").alias("line")) for t in line_halves(spark, d))
    lifted = F.col("l_extendedprice") + F.when(F.col("l_returnflag") == "N", 2500).otherwise(0)
    return train, test.withColumn("l_extendedprice", lifted)


def _shares(c: str) -> str:
    return f"""SELECT '{c}' AS feature, v, sum(p) p, sum(q) q FROM (
 SELECT {c} v, count(*) / (SELECT count(*) FROM {A})::DOUBLE p, 0 q FROM {A} GROUP BY 1 UNION ALL
 SELECT {c}, 0, count(*) / (SELECT count(*) FROM {B})::DOUBLE FROM {B} GROUP BY 1) GROUP BY v"""


@register("nominal_drift_unlabeled", f"""
SELECT feature, round(sum(abs(p - q)) / 2, 6) AS divergence, round(coalesce(sum(q) FILTER (p = 0), 0), 6) AS mismatch,
 NOT (coalesce(sum(q) FILTER (p = 0), 0) > 0.05 OR sum(abs(p - q)) / 2 > 0.4) AS passed
FROM ({_shares('state')} UNION ALL {_shares('line')}) GROUP BY feature""")
def nominal_drift_unlabeled(spark, d):
    return rounded(drift.nominal_drift_unlabeled(*_halves(spark, d), ["state", "line"], 0.05, 0.4), 6)


def _labelled_shares(c: str) -> str:
    return f"""SELECT '{c}' AS feature, l, v, sum(a) a, sum(b) b FROM (
 SELECT l_returnflag l, {c} v, count(*) a, 0 b FROM {A} GROUP BY 1, 2 UNION ALL SELECT l_returnflag, {c}, 0, count(*) FROM {B} GROUP BY 1, 2) GROUP BY l, v"""


NOMINAL_DRIFT = f"""
WITH c AS ({_labelled_shares('state')} UNION ALL {_labelled_shares('line')}),
k AS (SELECT *, sum(a) OVER (PARTITION BY feature, l) n, sum(b) OVER (PARTITION BY feature, l) m, sum(a) OVER (PARTITION BY feature, v) seen,
      sum(b) OVER (PARTITION BY feature) t FROM c)
SELECT feature, sum(abs(a / n - b / m) / 2 * m / t) AS divergence, coalesce(sum(b / t) FILTER (seen = 0), 0) AS mismatch FROM k WHERE m > 0 GROUP BY feature"""


@register("nominal_drift", f"SELECT feature, round(divergence, 6) AS divergence, round(mismatch, 6) AS mismatch FROM ({NOMINAL_DRIFT})")
def nominal_drift(spark, d):
    return rounded(drift.nominal_drift(*_halves(spark, d), ["state", "line"], "l_returnflag"), 6)


@register("nominal_drift_nulls", f"""
WITH c AS (SELECT l, v, sum(a) a, sum(b) b FROM (SELECT l_returnflag l, line v, count(*) a, 0 b FROM {A} GROUP BY 1, 2 UNION ALL
 SELECT l_returnflag, nullif(line, '1'), 0, count(*) FROM {B} GROUP BY 1, 2) GROUP BY l, v),
k AS (SELECT *, sum(a) OVER (PARTITION BY l) n, sum(b) OVER (PARTITION BY l) m, sum(a) OVER (PARTITION BY v) seen, sum(b) OVER () t FROM c)
SELECT 'line' AS feature, round(sum(abs(a / n - b / m) / 2 * m / t) FILTER (v IS NOT NULL), 6) AS divergence,
 round(coalesce(sum(b / t) FILTER (seen = 0 AND v IS NOT NULL), 0), 6) AS mismatch FROM k WHERE m > 0""")
def nominal_drift_nulls(spark, d):
    train, test = _halves(spark, d)
    return rounded(drift.nominal_drift(train, test.withColumn("line", F.nullif(F.col("line"), F.lit("1"))), ["line"], "l_returnflag"), 6)


def _ks_sql(x: str, label: str, where: str = "true") -> str:
    """KS distance and asymptotic p per label; values are far from standard normal, so t never applies."""
    return f"""SELECT '{x}' AS feature, l, max(n) n, max(m) m, max(abs(ca / n - cb / m)) AS ks FROM (
 SELECT l, sum(a) OVER (PARTITION BY l ORDER BY v) ca, sum(b) OVER (PARTITION BY l ORDER BY v) cb,
  sum(a) OVER (PARTITION BY l) n, sum(b) OVER (PARTITION BY l) m FROM (
  SELECT l, v, sum(a)::DOUBLE a, sum(b)::DOUBLE b FROM (SELECT {label} l, {x} v, 1 a, 0 b FROM {A} UNION ALL SELECT {label}, {x}, 0, 1 FROM {B}) GROUP BY 1, 2)) GROUP BY l"""


P_VALUE = """least(1, greatest(0, 2 * (SELECT sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * k * k * ks * ks * n * m / (n + m))) FROM range(1, 101) r(k))))"""
KS_COLS = ["l_extendedprice", "l_quantity", "l_discount"]


@register("ks_two_sample", f"""
SELECT feature, 'ks' AS test, round(ks, 8) AS statistic FROM ({' UNION ALL '.join(_ks_sql(x, "'all'") for x in ("l_extendedprice", "l_quantity"))})""")
def ks_two_sample(spark, d):
    found = drift.ordinal_drift(*_halves(spark, d), ["l_extendedprice", "l_quantity"])
    return rounded(found.select("feature", "test", "statistic"), 8)


DRIFTED = f"""SELECT feature, count(*) FILTER (p < 0.05) AS n_drifted, count(*) AS n_labels FROM (
 SELECT *, {P_VALUE} AS p FROM ({' UNION ALL '.join(_ks_sql(x, 'l_returnflag') for x in ("l_extendedprice", "l_quantity"))})) GROUP BY feature"""


@register("label_drift_count", DRIFTED)
def label_drift_count(spark, d):
    return drift.label_drift_count(*_halves(spark, d), ["l_extendedprice", "l_quantity"], "l_returnflag")


CLASS_DRIFT = f"""
SELECT feature, n_drifted / n_labels AS divergence, 0.0 AS mismatch, CASE feature
  WHEN 'l_extendedprice' THEN {_eta_sql('l_extendedprice', 'l_returnflag', A)} - {_eta_sql('l_extendedprice', 'l_returnflag', B)}
  ELSE {_eta_sql('l_quantity', 'l_returnflag', A)} - {_eta_sql('l_quantity', 'l_returnflag', B)} END AS corr_gap FROM ({DRIFTED})
UNION ALL SELECT feature, divergence, mismatch, CASE feature
  WHEN 'state' THEN {_cramer_sql('state', 'l_returnflag', A)} - {_cramer_sql('state', 'l_returnflag', B)}
  ELSE {_cramer_sql('line', 'l_returnflag', A)} - {_cramer_sql('line', 'l_returnflag', B)} END FROM ({NOMINAL_DRIFT})"""


@register("drift_classification", f"""
SELECT feature, round(divergence, 6) AS divergence, round(mismatch, 6) AS mismatch, round(corr_gap, 6) AS corr_gap FROM ({CLASS_DRIFT})""")
def drift_classification(spark, d):
    rows = drift.measure_drift(*_halves(spark, d), "l_returnflag", "multiclass", ["l_extendedprice", "l_quantity"], ["state", "line"])
    out = spark.createDataFrame([(r["feature"], float(r["divergence"]), float(r["mismatch"]), float(r["corr_gap"])) for r in rows],
                                "feature string, divergence double, mismatch double, corr_gap double")
    return rounded(out, 6)


@register("drift_filter", f"""
WITH x AS ({CLASS_DRIFT})
SELECT feature, round(divergence, 6) AS divergence, round(mismatch, 6) AS mismatch, round(corr_gap, 6) AS corr_gap,
  abs(corr_gap) >= 0.4 OR divergence >= 0.3 OR mismatch >= 0.05 AS dropped FROM x""")
def drift_filter(spark, d):
    return rounded(drift.drift_table(*_halves(spark, d), "l_returnflag", "multiclass", ["l_extendedprice", "l_quantity"], ["state", "line"],
                                     allow_divergence=0.3), 6)


def _label_ks(g: str) -> str:
    return f"""(SELECT count(*) FILTER (m > 0 AND (n = 0 OR p < 0.05)) / count(*) FILTER (m > 0) FROM (
 SELECT n, m, {P_VALUE} AS p FROM ({_ks_sql('l_extendedprice', g)})))"""


@register("drift_regression", f"""
SELECT feature, round(divergence, 6) AS divergence, 0.0 AS mismatch, round(corr_gap, 6) AS corr_gap FROM (
SELECT feature, ks AS divergence, CASE feature
  WHEN 'l_quantity' THEN (SELECT corr(l_quantity, l_extendedprice) FROM {A}) - (SELECT corr(l_quantity, l_extendedprice) FROM {B})
  ELSE (SELECT corr(l_discount, l_extendedprice) FROM {A}) - (SELECT corr(l_discount, l_extendedprice) FROM {B}) END AS corr_gap
 FROM (SELECT * FROM ({_ks_sql('l_quantity', "'all'")}) UNION ALL SELECT * FROM ({_ks_sql('l_discount', "'all'")}))
UNION ALL SELECT 'line', {_label_ks('line')}, {_eta_sql('l_extendedprice', 'line', A)} - {_eta_sql('l_extendedprice', 'line', B)}
UNION ALL SELECT 'l_returnflag', {_label_ks('l_returnflag')}, {_eta_sql('l_extendedprice', 'l_returnflag', A)} - {_eta_sql('l_extendedprice', 'l_returnflag', B)})""")
def drift_regression(spark, d):
    rows = drift.measure_drift(*_halves(spark, d), "l_extendedprice", "regression", ["l_quantity", "l_discount"], ["line", "l_returnflag"])
    out = spark.createDataFrame([(r["feature"], float(r["divergence"]), float(r["mismatch"]), float(r["corr_gap"])) for r in rows],
                                "feature string, divergence double, mismatch double, corr_gap double")
    return rounded(out, 6)


@register("adversarial_validation")
def adversarial_validation(spark, d):
    train, test = line_halves(spark, d)
    shifted = test.withColumn("l_extendedprice", F.col("l_extendedprice") + 20000)
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]
    return modeling.adversarial_table(train, shifted, cols, ["l_orderkey", "l_linenumber", "l_partkey"])


@register("adversarial_planted", """
SELECT 0 AS round, 'moved' AS feature, true AS removed UNION ALL SELECT 1, 'holed', true UNION ALL SELECT 2, 'bent', true""")
def adversarial_planted(spark, d):
    """Planted drift goes in the order of its size: values, then nulls that only one table has, then a small shift."""
    lines = table(spark, d, "lineitem").withColumn("side", F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"), F.lit(2)))
    later = F.col("side") == 1
    data = lines.select("l_orderkey", "l_linenumber", "l_partkey", "side", "l_tax", F.when(F.col("l_suppkey") % 3 > 0, F.col("l_discount")).alias("l_discount"),
                        F.when(later, F.col("l_extendedprice") + 200000).otherwise(F.col("l_extendedprice")).alias("moved"),
                        F.when(~later | (F.col("l_linenumber") < 4), F.col("l_quantity")).alias("holed"),
                        F.when(later & (F.col("l_suppkey") % 2 == 0), F.lit(-1)).otherwise(F.col("l_suppkey") % 50).alias("bent"))
    train, test = data.filter(~later), data.filter(later)
    made = modeling.adversarial_table(train, test, ["l_tax", "l_discount", "moved", "holed", "bent"], ["l_orderkey", "l_linenumber", "l_partkey"], trees=10)
    return made.filter("removed").select("round", "feature", "removed")
