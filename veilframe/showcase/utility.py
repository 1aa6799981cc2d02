"""Utility measures on whole tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import key_hash
from ..operators import association, efficacy, marginals, quality, scores
from .registry import Tables, query

# The synthetic side is every line item, disturbed.
LINES_SQL = """
real AS (SELECT l_quantity, l_extendedprice, CASE WHEN l_linenumber <> 7 THEN l_discount END AS l_discount,
                l_returnflag, CASE WHEN l_linenumber <> 5 THEN l_linestatus END AS l_linestatus,
                CASE WHEN l_linenumber <= 2 THEN 'head' ELSE 'tail' END AS place FROM lineitem),
synth AS (SELECT l_quantity * 0.8 + l_linenumber AS l_quantity, l_extendedprice * 1.05 + l_quantity AS l_extendedprice,
                 CASE WHEN l_linenumber <> 6 THEN l_discount / 2 END AS l_discount,
                 CASE WHEN l_linenumber = 1 THEN 'X' ELSE l_returnflag END AS l_returnflag,
                 CASE WHEN l_quantity > 40 THEN 'F' ELSE l_linestatus END AS l_linestatus,
                 CASE WHEN l_linenumber <= 3 THEN 'head' ELSE 'tail' END AS place FROM lineitem)"""
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]
LABELS = ["l_returnflag", "l_linestatus", "place"]


def lines(t: Tables) -> tuple[DataFrame, DataFrame]:
    n = F.col("l_linenumber")
    real = t.lineitem.select(
        "l_quantity", "l_extendedprice", F.when(n != 7, F.col("l_discount")).alias("l_discount"), "l_returnflag",
        F.when(n != 5, F.col("l_linestatus")).alias("l_linestatus"), F.when(n <= 2, "head").otherwise("tail").alias("place"))
    synth = t.lineitem.select(
        (F.col("l_quantity") * 0.8 + n).alias("l_quantity"),
        (F.col("l_extendedprice") * 1.05 + F.col("l_quantity")).alias("l_extendedprice"),
        F.when(n != 6, F.col("l_discount") / 2).alias("l_discount"),
        F.when(n == 1, "X").otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        F.when(F.col("l_quantity") > 40, "F").otherwise(F.col("l_linestatus")).alias("l_linestatus"),
        F.when(n <= 3, "head").otherwise("tail").alias("place"))
    return real, synth


def _long_sql(columns: list[str], cast: str) -> str:
    return "\nUNION ALL\n".join(f"SELECT 1 AS y, '{c}' AS col, CAST({c} AS {cast}) AS v FROM real UNION ALL "
                                f"SELECT 0, '{c}', CAST({c} AS {cast}) FROM synth" for c in columns)


JSD_SQL = f"""
num AS (SELECT * FROM ({_long_sql(NUMBERS, 'DOUBLE')}) WHERE v IS NOT NULL),
spans AS (SELECT col, min(v) AS lo, max(v) AS hi, sum(y) AS nr, sum(1 - y) AS ns FROM num GROUP BY col),
bins AS (SELECT col, CAST(least(floor((v - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS b, sum(y) AS r, sum(1 - y) AS s
         FROM num JOIN spans USING (col) GROUP BY 1, 2),
grid AS (SELECT col, CAST(i AS INTEGER) AS b FROM spans, range(50) g(i)),
shares AS (SELECT col, (coalesce(r, 0) / nr / ((hi - lo) / 50) + 1e-10::DOUBLE) AS p,
                  (coalesce(s, 0) / ns / ((hi - lo) / 50) + 1e-10::DOUBLE) AS q
           FROM grid JOIN spans USING (col) LEFT JOIN bins USING (col, b)),
norm AS (SELECT col, p / sum(p) OVER (PARTITION BY col) AS p, q / sum(q) OVER (PARTITION BY col) AS q FROM shares),
jsd AS (SELECT col, sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2 AS jsd FROM norm GROUP BY col)"""

TVD_SQL = f"""
lab AS (SELECT * FROM ({_long_sql(LABELS, 'VARCHAR')}) WHERE v IS NOT NULL),
sizes AS (SELECT col, sum(y) AS nr, sum(1 - y) AS ns FROM lab GROUP BY col),
tvd AS (SELECT col, sum(abs(r / nr - s / ns)) / 2 AS tvd
        FROM (SELECT col, v, sum(y) AS r, sum(1 - y) AS s FROM lab GROUP BY 1, 2) JOIN sizes USING (col) GROUP BY col)"""


@query("jsd_numeric", f'WITH {LINES_SQL}, {JSD_SQL} SELECT col AS "column", round(jsd, 6) AS jsd FROM jsd')
def jsd_numeric(t: Tables) -> DataFrame:
    return marginals.jsd_numeric(*lines(t)).withColumn("jsd", F.round("jsd", 6))


@query("tvd_categorical", f'WITH {LINES_SQL}, {TVD_SQL} SELECT col AS "column", round(tvd, 6) AS tvd FROM tvd')
def tvd_categorical(t: Tables) -> DataFrame:
    return marginals.tvd_categorical(*lines(t)).withColumn("tvd", F.round("tvd", 6))


@query("stat_deltas", f"WITH {LINES_SQL}\n" + "\nUNION ALL\n".join(f"""
SELECT '{c}' AS "column", round((SELECT avg({c}) FROM real) - (SELECT avg({c}) FROM synth), 4) AS mean_delta,
       round((SELECT stddev_samp({c}) FROM real) - (SELECT stddev_samp({c}) FROM synth), 4) AS std_delta,
       round(CAST((SELECT median(CAST({c} AS DOUBLE)) FROM real) - (SELECT median(CAST({c} AS DOUBLE)) FROM synth) AS DOUBLE), 4)
       AS median_delta""" for c in NUMBERS))
def stat_deltas(t: Tables) -> DataFrame:
    return marginals.stat_deltas(*lines(t))


@query("marginal_summary", f"""
WITH {LINES_SQL}, {JSD_SQL}, {TVD_SQL}
SELECT (SELECT round(avg(round(jsd, 6)), 6) FROM jsd) AS mean_jsd, (SELECT round(avg(round(tvd, 6)), 6) FROM tvd) AS mean_tvd""")
def marginal_summary(t: Tables) -> DataFrame:
    return marginals.marginal_summary(*lines(t))


def _corr_sql(source: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{a}|{b}' AS pair, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM {source}"
        for a, b in combinations(NUMBERS, 2))


@query("pearson_mae", f"""
WITH {LINES_SQL}, a AS ({_corr_sql('real')}), b AS ({_corr_sql('synth')})
SELECT round(avg(abs(a.r - b.r)), 6) AS pearson_corr_mae, count(*) - count(a.r - b.r) AS undefined_pairs FROM a JOIN b USING (pair)""")
def pearson_mae(t: Tables) -> DataFrame:
    return association.pearson_mae(*lines(t))


def _cramer_sql(source: str, columns: list[str]) -> str:
    """Dense χ² over the full contingency grid of each pair."""
    return "\nUNION ALL\n".join(f"""
SELECT '{a}' AS a, '{b}' AS b, (
  WITH t AS (SELECT CAST({a} AS VARCHAR) AS x, CAST({b} AS VARCHAR) AS y FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
  r AS (SELECT x, count(*) AS rn FROM t GROUP BY x), c AS (SELECT y, count(*) AS cn FROM t GROUP BY y),
  o AS (SELECT x, y, count(*) AS n FROM t GROUP BY x, y), k AS (SELECT count(*) AS total FROM t),
  g AS (SELECT pow(coalesce(n, 0) - rn * cn / total, 2) / (rn * cn / total) AS e FROM r CROSS JOIN c CROSS JOIN k LEFT JOIN o USING (x, y))
  SELECT coalesce(sqrt((SELECT sum(e) FROM g) / nullif((SELECT total FROM k)
         * (least((SELECT count(*) FROM r), (SELECT count(*) FROM c)) - 1), 0)), 0)) AS v""" for a, b in combinations(columns, 2))


@query("cramers_v", f"""
WITH pairs AS ({_cramer_sql('orders', ['o_orderstatus', 'o_orderpriority'])})
SELECT a, b, round(v, 6) AS v FROM pairs""")
def cramers_v(t: Tables) -> DataFrame:
    return association.cramers_v(t.orders, ["o_orderstatus", "o_orderpriority"]).withColumn("v", F.round("v", 6))


@query("cramers_v_mae", f"""
WITH {LINES_SQL}, p AS ({_cramer_sql('real', LABELS)}), q AS ({_cramer_sql('synth', LABELS)})
SELECT round(avg(abs(p.v - q.v)), 6) AS cramers_v_mae FROM p JOIN q USING (a, b)""")
def cramers_v_mae(t: Tables) -> DataFrame:
    return association.cramers_v_mae(*lines(t))


# -------------------------------------------------------------------- scores
# A given prediction: the status guessed from the price, and the price from the priority.

GUESS_SQL = """
guess AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority,
                 CASE WHEN o_totalprice < 80000 THEN 'F' WHEN o_totalprice < 320000 THEN 'O' ELSE 'Z' END AS predicted,
                 o_totalprice * 0.9 + (o_custkey % 17) * 1000.0::DOUBLE AS predicted_price FROM orders)"""


def guesses(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
        F.when(price < 80000, "F").when(price < 320000, "O").otherwise("Z").alias("predicted"),
        (price * 0.9 + (F.col("o_custkey") % 17) * 1000.0).alias("predicted_price"))


@query("weighted_f1", f"""
WITH {GUESS_SQL},
per_class AS (SELECT y, (SELECT count(*) FROM guess WHERE o_orderstatus = y) AS support,
                     (SELECT count(*) FROM guess WHERE predicted = y) AS guessed,
                     (SELECT count(*) FROM guess WHERE o_orderstatus = y AND predicted = y) AS hits
              FROM (SELECT DISTINCT o_orderstatus AS y FROM guess))
SELECT round(sum(support * 2.0::DOUBLE * hits / (support + guessed)) / sum(support), 4) AS f1_weighted FROM per_class""")
def weighted_f1(t: Tables) -> DataFrame:
    return scores.weighted_f1(guesses(t), "o_orderstatus", "predicted")


@query("roc_auc_rank", f"""
WITH {GUESS_SQL},
r AS (SELECT o_orderstatus = 'F' AS y, rank() OVER (ORDER BY floor(predicted_price / 10)) AS lowest,
             count(*) OVER (PARTITION BY floor(predicted_price / 10)) AS ties FROM guess)
SELECT round((sum(lowest + (ties - 1) / 2) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2)
             / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 4) AS roc_auc FROM r""")
def roc_auc_rank(t: Tables) -> DataFrame:
    scored = guesses(t).withColumn("score", F.floor(F.col("predicted_price") / 10))
    return scores.roc_auc(scored, F.col("o_orderstatus") == "F", "score")


@query("roc_auc_one_vs_rest", f"""
WITH {GUESS_SQL},
classes AS (SELECT DISTINCT o_orderstatus AS class FROM guess),
long AS (SELECT class, o_orderstatus = class AS y,
                floor(predicted_price / 10) * CASE class WHEN 'F' THEN -1 WHEN 'O' THEN 1 ELSE 2 END AS score FROM guess, classes),
r AS (SELECT class, y, rank() OVER (PARTITION BY class ORDER BY score) AS lowest,
             count(*) OVER (PARTITION BY class, score) AS ties FROM long),
a AS (SELECT class, (sum(lowest + (ties - 1) / 2) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2)
             / (count(*) FILTER (y) * count(*) FILTER (NOT y)) AS auc, count(*) FILTER (y) AS n FROM r GROUP BY class)
SELECT round(sum(auc * n) / sum(n), 4) AS roc_auc FROM a""")
def roc_auc_one_vs_rest(t: Tables) -> DataFrame:
    classes = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.lit(w).alias("w"))
                                  for c, w in (("F", -1), ("O", 1), ("P", 2))])).alias("e")
    long = guesses(t).select("o_orderstatus", "predicted_price", classes).select(
        "e.class", (F.floor(F.col("predicted_price") / 10) * F.col("e.w")).alias("score"),
        (F.col("o_orderstatus") == F.col("e.class")).alias("is_true"))
    return scores.roc_auc_one_vs_rest(long)


@query("regression_scores", f"""
WITH {GUESS_SQL}, m AS (SELECT avg(o_totalprice) AS m FROM guess)
SELECT round(avg(abs(o_totalprice - predicted_price)), 4) AS mae,
       round(1 - sum(pow(o_totalprice - predicted_price, 2)) / sum(pow(o_totalprice - m, 2)), 4) AS r2 FROM guess, m""")
def regression_scores(t: Tables) -> DataFrame:
    return scores.regression_scores(guesses(t), "o_totalprice", "predicted_price")


@query("label_encode", """
WITH texts AS (SELECT s_suppkey AS id, true AS is_train, CASE WHEN s_nationkey <> 2 THEN s_name END AS name FROM supplier
               UNION ALL SELECT c_custkey, false, CASE WHEN c_nationkey <> 2 THEN c_name END FROM customer)
SELECT id, is_train, dense_rank() OVER (ORDER BY coalesce(name, 'nan')) - 1 AS name FROM texts""")
def label_encode(t: Tables) -> DataFrame:
    train = t.supplier.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") != 2, F.col("s_name")).alias("name"))
    test = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") != 2, F.col("c_name")).alias("name"))
    a, b = efficacy.encode_labels(train, test, ["name"])
    return a.withColumn("is_train", F.lit(True)).unionByName(b.withColumn("is_train", F.lit(False)))


KS_SQL = f"""
{JSD_SQL.split('spans AS')[0].rstrip().rstrip(',')},
step AS (SELECT col, v, sum(y) AS r, sum(1 - y) AS s FROM num GROUP BY 1, 2),
ecdf AS (SELECT col, sum(r) OVER w / sum(r) OVER (PARTITION BY col) AS f, sum(s) OVER w / sum(s) OVER (PARTITION BY col) AS g
         FROM step WINDOW w AS (PARTITION BY col ORDER BY v ROWS UNBOUNDED PRECEDING)),
ks AS (SELECT col, max(abs(f - g)) AS ks FROM ecdf GROUP BY col)"""


@query("column_shapes", f"""
WITH {LINES_SQL}, {KS_SQL}, {TVD_SQL}
SELECT col AS "column", round(1 - ks, 6) AS score FROM ks UNION ALL SELECT col, round(1 - tvd, 6) FROM tvd""")
def column_shapes(t: Tables) -> DataFrame:
    return quality.column_shapes(*lines(t)).withColumn("score", F.round("score", 6))


def _pair_table_sql(source: str) -> str:
    cut = {n: f"CASE WHEN {n} < lo_{n} THEN '-1' WHEN {n} > hi_{n} THEN '10' ELSE "
              f"CAST(CAST(least(floor(({n} - lo_{n}) / ((hi_{n} - lo_{n}) / 10)), 9) AS INTEGER) AS VARCHAR) END" for n in NUMBERS}
    pairs = [(a, b, b) for a, b in combinations(LABELS, 2)] + [(c, n, cut[n]) for c in LABELS for n in NUMBERS]
    return "\nUNION ALL\n".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {e} AS y, count(*) AS n FROM {source}, edges "
                                f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL" for a, b, e in pairs)


@query("quality_score", f"""
WITH {LINES_SQL}, {KS_SQL}, {TVD_SQL},
edges AS (SELECT {", ".join(f"min({n}) AS lo_{n}, max({n}) AS hi_{n}" for n in NUMBERS)} FROM real),
p AS ({_pair_table_sql('real')}), q AS ({_pair_table_sql('synth')}),
ps AS (SELECT *, n / sum(n) OVER (PARTITION BY a, b) AS w FROM p), qs AS (SELECT *, n / sum(n) OVER (PARTITION BY a, b) AS w FROM q),
lab_pairs AS (SELECT a, b, 1 - sum(abs(coalesce(ps.w, 0) - coalesce(qs.w, 0))) / 2 AS score
              FROM ps FULL JOIN qs USING (a, b, x, y) GROUP BY a, b),
ca AS ({_corr_sql('real')}), cb AS ({_corr_sql('synth')}),
trends AS (SELECT score FROM lab_pairs UNION ALL SELECT 1 - abs(ca.r - cb.r) / 2 FROM ca JOIN cb USING (pair)),
shapes AS (SELECT 1 - ks AS score FROM ks UNION ALL SELECT 1 - tvd FROM tvd),
m AS (SELECT (SELECT avg(score) FROM shapes) AS s, (SELECT avg(score) FROM trends) AS t)
SELECT round((s + t) / 2, 4) AS overall_score, round(s, 4) AS column_shapes_score, round(t, 4) AS column_pair_trends_score FROM m""")
def quality_score(t: Tables) -> DataFrame:
    return quality.quality_score(*lines(t))


@query("pairwise_mutual_information", "WITH pairs AS (" + "\nUNION ALL\n".join(f"""
SELECT '{a}' AS a, '{b}' AS b, (
  WITH t AS (SELECT coalesce(CAST({a} AS VARCHAR), '?') AS x, coalesce(CAST({b} AS VARCHAR), '?') AS y FROM lineitem),
  o AS (SELECT x, y, count(*) AS n, sum(count(*)) OVER (PARTITION BY x) AS rn, sum(count(*)) OVER (PARTITION BY y) AS cn,
               sum(count(*)) OVER () AS total FROM t GROUP BY x, y)
  SELECT sum(n / total * ln(n * total / (rn * cn))) FROM o) AS mi"""
    for a, b in combinations(["l_returnflag", "l_linestatus", "l_linenumber", "l_discount"], 2))
    + ") SELECT a, b, round(mi, 6) AS mi FROM pairs")
def pairwise_mutual_information(t: Tables) -> DataFrame:
    out = association.pairwise_mutual_information(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount"])
    return out.withColumn("mi", F.round("mi", 6))


# ------------------------------------------------------------------ Spark ML

def documents(t: Tables) -> DataFrame:
    """Labelled documents with simple measures of their text."""
    return t.documents.join(t.labels, "doc_id").select(
        "quality", "lang", "source", "n_chars", F.size(F.split("text", r"\s+")).alias("n_words"),
        F.size(F.split("text", "\n")).alias("n_lines"),
        (F.xxhash64("doc_id") % 5 == 0).alias("is_test"))


@query("ml_trtr")
def ml_trtr(t: Tables) -> DataFrame:
    docs = documents(t)
    config = efficacy.EfficacyConfig("quality", n_estimators=20, max_depth=6)
    return efficacy.run_experiment(docs.where("NOT is_test").drop("is_test"), docs.where("is_test").drop("is_test"), config)


@query("ml_efficacy")
def ml_efficacy(t: Tables) -> DataFrame:
    docs = documents(t)
    train = docs.where("NOT is_test").drop("is_test")
    synth = train.withColumn("n_chars", (F.col("n_chars") * 1.1).cast("long")).withColumn("n_words", F.col("n_words") + 3)
    config = efficacy.EfficacyConfig("quality", n_estimators=20, max_depth=6)
    return efficacy.ml_efficacy(train, synth, docs.where("is_test").drop("is_test"), config)


@query("ml_regression")
def ml_regression(t: Tables) -> DataFrame:
    """How well a forest learns an order's price from its lines: trained on four of five orders, tested on the others."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("lines"),
                                                 F.sum("l_extendedprice").alias("price"))
    facts = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_totalprice", "o_orderpriority", "quantity", "lines", "price", (key_hash("o_orderkey", 5) < 858993459).alias("is_test"))
    config = efficacy.EfficacyConfig("o_totalprice", task="regression", n_estimators=20, max_depth=8)
    return efficacy.run_experiment(facts.where("NOT is_test").drop("is_test"), facts.where("is_test").drop("is_test"), config)
