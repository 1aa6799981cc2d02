"""Privacy measures on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import key_hash
from ..operators import anonymity, distances, encode
from .registry import Tables, query

BAND_SQL = "CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'middle' ELSE 'high' END"
PEOPLE_SQL = f"""
people AS (SELECT c_nationkey, CASE WHEN c_nationkey <> 3 THEN c_mktsegment END AS c_mktsegment,
                  CASE WHEN c_acctbal <= 9000 THEN {BAND_SQL} END AS band FROM customer),
reference AS (SELECT {BAND_SQL.replace('c_acctbal', 's_acctbal')} AS band FROM supplier)"""
QI = ["c_mktsegment", "c_nationkey"]


def band(balance: str = "c_acctbal") -> Column:
    return F.when(F.col(balance) < 0, "debt").when(F.col(balance) < 5000, "middle").otherwise("high")


def people(t: Tables) -> DataFrame:
    return t.customer.select("c_nationkey", F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment")).alias("c_mktsegment"),
                             F.when(F.col("c_acctbal") <= 9000, band()).alias("band"))


def bands(t: Tables) -> DataFrame:
    """The suppliers' balances, against which the customers' are held."""
    return t.supplier.select(band("s_acctbal").alias("band"))


GROUPED = f"{PEOPLE_SQL}, placed AS (SELECT * FROM people WHERE c_mktsegment IS NOT NULL AND c_nationkey IS NOT NULL)"


@query("k_anonymity", f"""
WITH {GROUPED} SELECT min(n) AS k_anonymity FROM (SELECT count(*) AS n FROM placed GROUP BY c_mktsegment, c_nationkey)""")
def k_anonymity(t: Tables) -> DataFrame:
    return anonymity.k_anonymity(people(t), QI)


@query("k_violations", """
SELECT o_custkey, o_orderpriority, count(*) AS "count" FROM orders GROUP BY 1, 2 HAVING count(*) < 3""")
def k_violations(t: Tables) -> DataFrame:
    return anonymity.k_violations(t.orders, ["o_custkey", "o_orderpriority"], 3)


@query("l_diversity", f"""
WITH {GROUPED} SELECT min(n) AS l_diversity
FROM (SELECT count(DISTINCT band) AS n FROM placed GROUP BY c_mktsegment, c_nationkey)""")
def l_diversity(t: Tables) -> DataFrame:
    return anonymity.l_diversity(people(t), QI, "band")


def _closeness_sql(reference: str, value: str, groups: list[str], source: str, only_global: bool = False) -> str:
    """Dense form: every group against every value of either side."""
    keys = ", ".join(groups)
    domain = f"SELECT DISTINCT {value} AS v FROM {reference} WHERE {value} IS NOT NULL"
    if not only_global:
        domain += f" UNION SELECT DISTINCT {value} FROM {source} WHERE {value} IS NOT NULL"
    return f"""
domain AS ({domain}),
shares AS (SELECT {value} AS v, count(*) / (SELECT count({value}) FROM {reference}) AS q FROM {reference}
           WHERE {value} IS NOT NULL GROUP BY 1),
cells AS (SELECT {keys}, {value} AS v, count(*) AS n FROM {source} GROUP BY ALL),
totals AS (SELECT {keys}, count({value}) AS total, count(*) AS n, count(DISTINCT {value}) AS l FROM {source} GROUP BY ALL),
grid AS (SELECT totals.*, domain.v, coalesce(shares.q, 0) AS q,
                coalesce((SELECT c.n FROM cells c WHERE {" AND ".join(f"c.{g} = totals.{g}" for g in groups)}
                          AND c.v = domain.v) / totals.total, 0) AS p
         FROM totals CROSS JOIN domain LEFT JOIN shares ON shares.v = domain.v),
per_group AS (SELECT {keys}, any_value(n) AS n, any_value(l) AS l, sum(abs(p - q)) / 2 AS t FROM grid GROUP BY ALL)"""


KLT_SQL = f"WITH {GROUPED}, {_closeness_sql('reference', 'band', QI, 'placed')}"
KLT_GLOBAL_SQL = f"WITH {GROUPED}, {_closeness_sql('reference', 'band', QI, 'placed', only_global=True)}"


@query("t_closeness", f"{KLT_SQL} SELECT round(max(t), 6) AS t_closeness FROM per_group")
def t_closeness(t: Tables) -> DataFrame:
    return anonymity.t_closeness(people(t), QI, "band", bands(t))


@query("t_closeness_global_only", f"{KLT_GLOBAL_SQL} SELECT round(max(t), 6) AS t_closeness FROM per_group")
def t_closeness_global_only(t: Tables) -> DataFrame:
    return anonymity.t_closeness(people(t), QI, "band", bands(t), global_values_only=True)


@query("classical_metrics", f"""
{KLT_SQL} SELECT min(n) AS k_anonymity, min(l) AS l_diversity, round(max(t), 6) AS t_closeness FROM per_group""")
def classical_metrics(t: Tables) -> DataFrame:
    return anonymity.classical_metrics(people(t), QI, "band", bands(t))


@query("check_klt", f"""
{KLT_GLOBAL_SQL} SELECT min(n) AS k_anonymity, min(l) AS l_diversity, round(max(t), 6) AS t_closeness,
                        min(n) >= 3 AND min(l) >= 2 AND max(t) < 0.9 AS passed FROM per_group""")
def check_klt(t: Tables) -> DataFrame:
    return anonymity.check_klt(people(t), QI, "band", bands(t), k=3, l=2, t=0.9)


# ------------------------------------------------------------------ distances
# Every customer is real (train or holdout by a hash of the key) and has a disturbed
# double in the synthetic table, with segments that train lacks or that are missing.

HASH7 = "((c_custkey % 2147483648) * 2654435761 + 7) % 4294967296"
WORLD_SQL = f"""
real AS (SELECT c_custkey, c_nationkey, c_acctbal, c_acctbal < 0 AS debtor,
                CASE WHEN c_nationkey <> 3 THEN c_mktsegment END AS segment, {HASH7} < 858993459 AS holdout
         FROM customer),
train AS (SELECT * FROM real WHERE NOT holdout), held AS (SELECT * FROM real WHERE holdout),
synth AS (SELECT c_custkey, CAST((c_nationkey * 3 + c_custkey) % 25 AS INTEGER) AS c_nationkey,
                 c_acctbal * 0.9 + 120 AS c_acctbal, c_acctbal * 0.9 + 120 < 0 AS debtor,
                 CASE WHEN c_nationkey = 7 THEN 'UNKNOWN' WHEN c_nationkey <> 4 THEN c_mktsegment END AS segment
          FROM customer),
span AS (SELECT min(c_nationkey) AS n0, max(c_nationkey) - min(c_nationkey) AS n1, min(c_acctbal) AS a0,
                max(c_acctbal) - min(c_acctbal) AS a1 FROM train)"""


def _pairs_sql(query: str, reference: str, keep: str) -> str:
    """All pairs of two tables with their distance."""
    return f"""
SELECT {keep}, sqrt(pow((x.c_nationkey - y.c_nationkey) / CAST(n1 AS DOUBLE), 2) + pow((x.c_acctbal - y.c_acctbal) / a1, 2)
       + pow(CAST(x.debtor AS INTEGER) - CAST(y.debtor AS INTEGER), 2)
       + CASE WHEN x.seg IS NOT DISTINCT FROM y.seg THEN 0
              ELSE CAST(x.seg IS NOT NULL AS INTEGER) + CAST(y.seg IS NOT NULL AS INTEGER) END) AS d
FROM (SELECT *, CASE WHEN segment IN (SELECT segment FROM train) THEN segment END AS seg FROM {query}) x
CROSS JOIN (SELECT *, CASE WHEN segment IN (SELECT segment FROM train) THEN segment END AS seg FROM {reference}) y
CROSS JOIN span"""


def real_customers(t: Tables) -> DataFrame:
    return t.customer.select(
        "c_custkey", "c_nationkey", "c_acctbal", (F.col("c_acctbal") < 0).alias("debtor"),
        F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment")).alias("segment"),
        (key_hash("c_custkey", 7) < 858993459).alias("holdout"))


def customer_world(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """train, holdout, synth."""
    real = real_customers(t)
    balance = F.col("c_acctbal") * 0.9 + 120
    synth = t.customer.select(
        "c_custkey", F.pmod(F.col("c_nationkey") * 3 + F.col("c_custkey"), F.lit(25)).cast("int").alias("c_nationkey"),
        balance.alias("c_acctbal"), (balance < 0).alias("debtor"),
        F.when(F.col("c_nationkey") == 7, "UNKNOWN").when(F.col("c_nationkey") != 4, F.col("c_mktsegment")).alias("segment"))
    return real.where("NOT holdout").drop("holdout"), real.where("holdout").drop("holdout"), synth


USED = ["c_nationkey", "c_acctbal", "debtor", "segment"]


@query("encode_minmax", f"""
WITH {WORLD_SQL}
SELECT c_custkey, round((c_nationkey - n0) / CAST(n1 AS DOUBLE), 6) AS c_nationkey, round((c_acctbal - a0) / a1, 6) AS c_acctbal,
       CAST(debtor AS DOUBLE) AS debtor, CASE WHEN segment IN (SELECT segment FROM train) THEN segment END AS segment
FROM synth, span""")
def encode_minmax(t: Tables) -> DataFrame:
    train, _, synth = customer_world(t)
    encoder = encode.fit_encoder(train.select(*USED))
    out = encode.encoded_table(synth, encoder, ["c_custkey"])
    return out.withColumns({c: F.round(c, 6) for c in ("c_nationkey", "c_acctbal")})


@query("dcr_synth", f"""
WITH {WORLD_SQL}, pairs AS ({_pairs_sql('synth', 'train', 'x.c_custkey')})
SELECT c_custkey, round(min(d), 6) AS dcr FROM pairs GROUP BY c_custkey""")
def dcr_synth(t: Tables) -> DataFrame:
    train, _, synth = customer_world(t)
    near = distances.dcr(synth, train, ["c_custkey"], columns=USED)
    return near.select("c_custkey", F.round("dcr", 6).alias("dcr"))


@query("dcr_summary", f"""
WITH {WORLD_SQL},
s AS (SELECT min(d) AS d FROM ({_pairs_sql('synth', 'train', 'x.c_custkey')}) GROUP BY c_custkey),
h AS (SELECT min(d) AS d FROM ({_pairs_sql('held', 'train', 'x.c_custkey')}) GROUP BY c_custkey),
a AS (SELECT min(d) AS a1, median(d) AS a2, avg(d) AS a3, quantile_cont(d, 0.05) AS a4 FROM s),
b AS (SELECT min(d) AS b1, median(d) AS b2, avg(d) AS b3, quantile_cont(d, 0.05) AS b4 FROM h)
SELECT round(a1, 6) AS synth_min, round(a2, 6) AS synth_median, round(a3, 6) AS synth_mean, round(a4, 6) AS synth_p5,
       round(b1, 6) AS holdout_min, round(b2, 6) AS holdout_median, round(b3, 6) AS holdout_mean,
       round(b4, 6) AS holdout_p5, a2 >= b2 AS privacy_preserved
FROM a, b""")
def dcr_summary(t: Tables) -> DataFrame:
    return distances.dcr_summary(distances.distance_frame(*customer_world(t), columns=USED))


@query("nndr", f"""
WITH {WORLD_SQL}, pairs AS ({_pairs_sql('synth', 'train', 'x.c_custkey')}),
near AS (SELECT c_custkey, min(d, 2) AS two FROM pairs GROUP BY c_custkey),
ratio AS (SELECT CASE WHEN two[2] > 0 THEN two[1] / two[2] ELSE 0 END AS r FROM near)
SELECT round(avg(r), 6) AS synth_mean, round(median(r), 6) AS synth_median,
       round(avg(CASE WHEN r < 0.1 THEN 1.0 ELSE 0.0 END), 6) AS share_below_0_1 FROM ratio""")
def nndr(t: Tables) -> DataFrame:
    return distances.nndr_summary(distances.distance_frame(*customer_world(t), columns=USED))


MIA_SQL = f"""
WITH {WORLD_SQL},
m AS (SELECT * FROM train ORDER BY ((c_custkey % 2147483648) * 2654435761 + 42) % 4294967296, c_custkey
      LIMIT (SELECT least((SELECT count(*) FROM train), (SELECT count(*) FROM held)))),
n AS (SELECT * FROM held ORDER BY ((c_custkey % 2147483648) * 2654435761 + 42) % 4294967296, c_custkey
      LIMIT (SELECT least((SELECT count(*) FROM train), (SELECT count(*) FROM held)))),
f AS (SELECT min(d) AS d, 1 AS y FROM ({_pairs_sql('m', 'synth', 'x.c_custkey')}) GROUP BY c_custkey
      UNION ALL SELECT min(d), 0 FROM ({_pairs_sql('n', 'synth', 'x.c_custkey')}) GROUP BY c_custkey)"""


def customer_attack(t: Tables) -> DataFrame:
    train, holdout, synth = customer_world(t)
    return distances.mia_features(train, holdout, synth, columns=USED, member_order=key_hash("c_custkey"))


@query("mia_features", f"""
{MIA_SQL} SELECT round(d, 6) AS distance, CAST(sum(y) AS BIGINT) AS members, CAST(sum(1 - y) AS BIGINT) AS non_members
FROM f GROUP BY round(d, 6)""")
def mia_features(t: Tables) -> DataFrame:
    return customer_attack(t).groupBy(F.round("distance", 6).alias("distance")).agg(
        F.sum("members").alias("members"), F.sum("non_members").alias("non_members"))


@query("mia_rank_auc", f"""
{MIA_SQL}, r AS (SELECT round(d, 12) AS d, y FROM f),
c AS (SELECT d, sum(y) AS pos, sum(1 - y) AS neg FROM r GROUP BY d),
w AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closer FROM c)
SELECT round(sum(neg * (closer + pos / 2.0)) / (sum(pos) * sum(neg)), 6) AS attack_auc,
       CAST(sum(pos) AS BIGINT) AS members, CAST(sum(neg) AS BIGINT) AS non_members FROM w""")
def mia_rank_auc(t: Tables) -> DataFrame:
    features = customer_attack(t).withColumn("distance", F.round("distance", 12))
    return distances.mia_rank_auc(features)


@query("mia_attack")
def mia_attack(t: Tables) -> DataFrame:
    return distances.membership_inference(customer_attack(t), n_estimators=20)


@query("nearest_orders", """
WITH v AS (SELECT o_orderkey, o_totalprice AS price, o_orderstatus AS s, o_orderpriority AS p, CAST(month(o_orderdate) AS DOUBLE) AS m FROM orders),
k AS (SELECT greatest(max(price) - min(price), 1e-300) AS dp, greatest(max(m) - min(m), 1e-300) AS dm FROM v),
d AS (SELECT x.o_orderkey, sqrt(pow((x.price * 1.01 + 3.0 - y.price) / dp, 2) + pow((x.m - y.m) / dm, 2)
             + CASE WHEN x.s = y.s THEN 0 ELSE 2 END + CASE WHEN x.p = y.p THEN 0 ELSE 2 END) AS d FROM v x CROSS JOIN v y CROSS JOIN k)
SELECT o_orderkey, round(two[1], 6) AS dcr, round(two[2], 6) AS d2 FROM (SELECT o_orderkey, min(d, 2) AS two FROM d GROUP BY o_orderkey)""")
def nearest_orders(t: Tables) -> DataFrame:
    """Every order with shifted price against all orders as they are."""
    used = ["o_totalprice", "o_orderstatus", "o_orderpriority", "month"]
    real = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", F.month("o_orderdate").alias("month"))
    synth = real.withColumn("o_totalprice", F.col("o_totalprice") * 1.01 + 3.0)
    near = distances.dcr(synth, real, ["o_orderkey"], columns=used)
    return near.select("o_orderkey", F.round("dcr", 6).alias("dcr"), F.round("d2", 6).alias("d2"))


@query("nearest_lines", """
WITH x AS (SELECT p_partkey, p_retailprice * 20 AS price, coalesce(CASE WHEN p_size <> 13 THEN CAST(p_size AS DOUBLE) END, 0) AS size,
                  ['A', 'N', 'R', 'X'][p_partkey % 4 + 1] AS flag FROM part),
y AS (SELECT l_extendedprice AS price, coalesce(CASE WHEN l_linenumber <> 7 THEN l_quantity END, 0) AS size,
             CASE WHEN l_linenumber <> 2 THEN l_returnflag END AS flag FROM lineitem),
k AS (SELECT max(price) - min(price) AS dp, max(size) - min(size) AS ds FROM y),
c AS (SELECT price, size, flag, count(*) AS n FROM y GROUP BY ALL),
u AS (SELECT p_partkey, price, size, CASE WHEN flag <> 'X' THEN flag END AS flag FROM x),
d AS (SELECT p_partkey, sqrt(pow((u.price - c.price) / dp, 2) + pow((u.size - c.size) / ds, 2)
             + CASE WHEN u.flag IS NOT DISTINCT FROM c.flag THEN 0 ELSE CAST(u.flag IS NOT NULL AS INTEGER) + CAST(c.flag IS NOT NULL AS INTEGER) END) AS d, n
      FROM u CROSS JOIN c CROSS JOIN k),
near AS (SELECT p_partkey, min(d) AS d1, arg_min(n, d) AS n1, min(d, 2) AS two FROM d GROUP BY p_partkey)
SELECT p_partkey, round(d1, 6) AS dcr, round(CASE WHEN n1 > 1 THEN d1 ELSE two[2] END, 6) AS d2 FROM near""")
def nearest_lines(t: Tables) -> DataFrame:
    """Every part against all order lines, on the columns both have; numbers and texts are partly missing. So few lines
    may be sent to every task that the search goes through a tree of cells."""
    parts = t.part.select("p_partkey", (F.col("p_retailprice") * 20).alias("price"), F.when(F.col("p_size") != 13, F.col("p_size").cast("double")).alias("size"),
                          F.element_at(F.array(*map(F.lit, "ANRX")), (F.col("p_partkey") % 4 + 1).cast("int")).alias("flag"), "p_name")
    lines = t.lineitem.select(F.col("l_extendedprice").alias("price"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("size"),
                              F.when(F.col("l_linenumber") != 2, F.col("l_returnflag")).alias("flag"), "l_orderkey")
    near = distances.dcr(parts, lines, ["p_partkey"], broadcast_values=10_000)
    return near.select("p_partkey", F.round("dcr", 6).alias("dcr"), F.round("d2", 6).alias("d2"))
