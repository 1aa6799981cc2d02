"""Cleaning, splitting and profiling on whole tables."""

from __future__ import annotations


from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import key_hash
from ..functions.values import bin_column, recode_contains, recode_equals, sanitize_nonfinite
from ..operators import clean, profile, roles, split
from .registry import Tables, query

# Orders with holes, for imputation: every totalprice above 300000 and every 'P' status is missing,
# and each row is present twice.
HOLED = """
holed AS (
  SELECT o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus,
         CASE WHEN o_totalprice <= 300000 THEN o_totalprice END AS o_totalprice,
         o_orderpriority
  FROM orders),
doubled AS (SELECT * FROM holed UNION ALL SELECT * FROM holed)"""


def holed_orders(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_totalprice") <= 300000, F.col("o_totalprice")).alias("o_totalprice"), "o_orderpriority")


@query("nullify_tokens", """
SELECT c_custkey, CASE WHEN c_mktsegment NOT IN ('BUILDING', '?') THEN c_mktsegment END AS c_mktsegment
FROM customer""")
def nullify_tokens(t: Tables) -> DataFrame:
    return clean.nullify(t.customer.select("c_custkey", "c_mktsegment"), ["BUILDING", "?"])


@query("dropna_any", f"""
WITH {HOLED} SELECT * FROM holed
WHERE o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL AND o_totalprice IS NOT NULL
  AND o_orderpriority IS NOT NULL""")
def dropna_any(t: Tables) -> DataFrame:
    return clean.dropna_any(holed_orders(t))


@query("drop_columns", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def drop_columns(t: Tables) -> DataFrame:
    return clean.drop_columns(t.customer, ["c_name", "c_acctbal", "no_such_column"])


@query("minimize_identifiers", "SELECT c_nationkey, c_acctbal, c_mktsegment FROM customer")
def minimize_identifiers(t: Tables) -> DataFrame:
    return clean.minimize(t.customer, ["c_custkey", "c_name", "email"])[0]


@query("minimize_high_cardinality", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def minimize_high_cardinality(t: Tables) -> DataFrame:
    return clean.minimize(t.customer, [], drop_high_cardinality=True, cardinality_threshold=0.9)[0]


@query("minimization_report", """
WITH m AS (SELECT count(DISTINCT c_name) * 1.0 / count(*) > 0.9 AS name_goes,
                  count(DISTINCT c_mktsegment) * 1.0 / count(*) > 0.9 AS segment_goes FROM customer)
SELECT 'c_custkey' AS removed_direct_identifiers,
       concat_ws(',', CASE WHEN name_goes THEN 'c_name' END,
                 CASE WHEN segment_goes THEN 'c_mktsegment' END) AS removed_high_cardinality,
       CAST(5 AS INTEGER) AS columns_before,
       CAST(4 - CAST(name_goes AS INTEGER) - CAST(segment_goes AS INTEGER) AS INTEGER) AS columns_after,
       true AS rows_unchanged
FROM m""")
def minimization_report(t: Tables) -> DataFrame:
    _, report = clean.minimize(t.customer, ["c_custkey", "email"], drop_high_cardinality=True)
    return report.to_frame(t.spark).withColumns({
        c: F.concat_ws(",", c) for c in ("removed_direct_identifiers", "removed_high_cardinality")})


@query("sample_rows_hash", """
SELECT o_orderkey, o_custkey, o_totalprice FROM (
  SELECT *, row_number() OVER (ORDER BY ((o_orderkey % 2147483648) * 2654435761 + 42) % 4294967296, o_orderkey) AS rn
  FROM orders) WHERE rn <= 5000""")
def sample_rows_hash(t: Tables) -> DataFrame:
    return split.sample_rows(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), 5000,
                             order=key_hash("o_orderkey"))


@query("preview_stats", """
WITH head AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 100)
SELECT 'c_custkey' AS "column", 'bigint' AS dtype, count(*) - count(c_custkey) AS null_count,
       count(DISTINCT c_custkey) AS unique_count, round(avg(c_custkey), 4) AS mean,
       CAST(min(c_custkey) AS DOUBLE) AS "min", CAST(max(c_custkey) AS DOUBLE) AS "max" FROM head
UNION ALL SELECT 'c_name', 'string', count(*) - count(c_name), count(DISTINCT c_name), NULL, NULL, NULL FROM head
UNION ALL SELECT 'c_nationkey', 'int', count(*) - count(c_nationkey), count(DISTINCT c_nationkey),
       round(avg(c_nationkey), 4), CAST(min(c_nationkey) AS DOUBLE), CAST(max(c_nationkey) AS DOUBLE) FROM head
UNION ALL SELECT 'c_acctbal', 'double', count(*) - count(c_acctbal), count(DISTINCT c_acctbal),
       round(avg(c_acctbal), 4), min(c_acctbal), max(c_acctbal) FROM head
UNION ALL SELECT 'c_mktsegment', 'string', count(*) - count(c_mktsegment), count(DISTINCT c_mktsegment),
       NULL, NULL, NULL FROM head""")
def preview_stats(t: Tables) -> DataFrame:
    return profile.preview_stats(t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal",
                                                   "c_mktsegment"), 100, ["c_custkey"])


@query("detect_column_roles", """
WITH d AS (SELECT count(DISTINCT l_orderkey) AS k, count(DISTINCT l_partkey) AS p, count(DISTINCT l_suppkey) AS s,
                  count(DISTINCT l_linenumber) AS n, count(DISTINCT l_quantity) AS q,
                  count(DISTINCT l_extendedprice) AS e, count(DISTINCT l_discount) AS di,
                  count(DISTINCT l_tax) AS t FROM lineitem)
SELECT 'l_orderkey' AS "column", 'ignored' AS role FROM d
UNION ALL SELECT 'l_partkey', CASE WHEN p <= 15 THEN 'categorical' ELSE 'continuous' END FROM d
UNION ALL SELECT 'l_suppkey', CASE WHEN s <= 15 THEN 'categorical' ELSE 'continuous' END FROM d
UNION ALL SELECT 'l_linenumber', CASE WHEN n <= 15 THEN 'categorical' ELSE 'continuous' END FROM d
UNION ALL SELECT 'l_quantity', 'categorical' FROM d
UNION ALL SELECT 'l_extendedprice', CASE WHEN e <= 15 THEN 'categorical' ELSE 'continuous' END FROM d
UNION ALL SELECT 'l_discount', 'continuous' FROM d
UNION ALL SELECT 'l_tax', CASE WHEN t <= 15 THEN 'categorical' ELSE 'continuous' END FROM d
UNION ALL SELECT 'l_returnflag', 'categorical' FROM d
UNION ALL SELECT 'l_linestatus', 'categorical' FROM d
UNION ALL SELECT 'l_shipdate', 'ignored' FROM d""")
def detect_column_roles(t: Tables) -> DataFrame:
    return roles.detect_column_roles(t.lineitem, exclude=["l_orderkey"], force_categorical=["l_quantity"],
                                     force_continuous=["l_discount"]).to_frame(t.spark)


@query("align_types", """
SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_custkey,
       o_orderstatus || '!' AS o_shippriority FROM orders""")
def align_types(t: Tables) -> DataFrame:
    real = t.orders.select("o_orderkey", "o_totalprice", "o_custkey", F.lit(1).alias("o_shippriority"))
    synth = t.orders.select(F.col("o_orderkey").cast("string").alias("o_orderkey"),
                            F.col("o_totalprice").cast("string").alias("o_totalprice"),
                            F.col("o_custkey").cast("double").alias("o_custkey"),
                            F.concat("o_orderstatus", F.lit("!")).alias("o_shippriority"))
    return clean.align_types(synth, real)


@query("generalize_bins", """
SELECT l_orderkey, l_linenumber, l_quantity,
       CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 'small' WHEN l_quantity > 10 AND l_quantity <= 30 THEN 'medium'
            WHEN l_quantity > 30 AND l_quantity <= 45 THEN 'large' END AS quantity_bin
FROM lineitem""")
def generalize_bins(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity",
                             bin_column(F.col("l_quantity"), (0, 10, 30, 45), ("small", "medium", "large"))
                             .alias("quantity_bin"))


@query("recode_values", """
SELECT o_orderkey, CASE WHEN contains(o_orderpriority, 'URGENT') THEN 'urgent' ELSE 'normal' END AS urgency,
       CASE WHEN o_orderstatus = 'F' THEN o_orderstatus ELSE 'open' END AS state
FROM orders""")
def recode_values(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey",
                           recode_contains(F.col("o_orderpriority"), "URGENT", "urgent", "normal").alias("urgency"),
                           recode_equals(F.col("o_orderstatus"), "F", "open").alias("state"))


@query("sanitize_nonfinite", """
SELECT c_custkey, CASE WHEN c_nationkey % 3 = 2 THEN c_acctbal END AS c_acctbal FROM customer""")
def sanitize_non_finite(t: Tables) -> DataFrame:
    broken = (F.when(F.col("c_nationkey") % 3 == 0, F.lit(float("nan")))
              .when(F.col("c_nationkey") % 3 == 1, F.lit(float("-inf"))).otherwise(F.col("c_acctbal")))
    return sanitize_nonfinite(t.customer.select("c_custkey", broken.alias("c_acctbal")))


@query("dedup_rows", f"WITH {HOLED} SELECT DISTINCT * FROM doubled")
def dedup_rows(t: Tables) -> DataFrame:
    holed = holed_orders(t)
    return clean.drop_duplicates(holed.unionByName(holed))


@query("impute_median", f"""
WITH {HOLED}
SELECT o_custkey, round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM holed)), 4) AS o_totalprice
FROM holed""")
def impute_median(t: Tables) -> DataFrame:
    filled = clean.impute(holed_orders(t).select("o_custkey", "o_totalprice"))
    return filled.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("impute_mode", f"""
WITH {HOLED},
best AS (SELECT o_orderstatus FROM holed WHERE o_orderstatus IS NOT NULL
         GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT o_custkey, coalesce(o_orderstatus, (SELECT * FROM best)) AS o_orderstatus FROM holed""")
def impute_mode(t: Tables) -> DataFrame:
    return clean.impute(holed_orders(t).select("o_custkey", "o_orderstatus"))


PREPROCESS_SQL = f"""{HOLED},
slim AS (SELECT DISTINCT * FROM doubled),
best AS (SELECT o_orderstatus FROM slim WHERE o_orderstatus IS NOT NULL
         GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
filled AS (SELECT o_custkey, coalesce(o_orderstatus, (SELECT * FROM best)) AS o_orderstatus,
                  coalesce(o_totalprice, (SELECT median(o_totalprice) FROM slim)) AS o_totalprice,
                  o_orderpriority
           FROM slim)"""


@query("preprocess", f"""
WITH {PREPROCESS_SQL}
SELECT o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice, o_orderpriority FROM filled""")
def preprocess(t: Tables) -> DataFrame:
    holed = holed_orders(t)
    return clean.preprocess(holed.unionByName(holed)).withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("impute_from_train", """
WITH priced AS (SELECT p_partkey, p_size >= 40 AS is_test,
                       CASE WHEN p_size % 4 <> 0 THEN p_retailprice END AS p_retailprice,
                       CASE WHEN p_brand <> 'Brand#11' THEN p_brand END AS p_brand FROM part),
fills AS (SELECT (SELECT median(p_retailprice) FROM priced WHERE NOT is_test) AS price,
                 (SELECT p_brand FROM priced WHERE NOT is_test AND p_brand IS NOT NULL
                  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS brand)
SELECT p_partkey, is_test, round(coalesce(p_retailprice, price), 4) AS p_retailprice,
       coalesce(p_brand, brand) AS p_brand
FROM priced, fills""")
def impute_from_train(t: Tables) -> DataFrame:
    priced = t.part.select("p_partkey", (F.col("p_size") >= 40).alias("is_test"),
                           F.when(F.col("p_size") % 4 != 0, F.col("p_retailprice")).alias("p_retailprice"),
                           F.when(F.col("p_brand") != "Brand#11", F.col("p_brand")).alias("p_brand"))
    train, test = clean.impute_from_train(priced.where("NOT is_test"), priced.where("is_test"))
    return train.unionByName(test).withColumn("p_retailprice", F.round("p_retailprice", 4))


# ------------------------------------------------------------------ splitting

ORDER_HASH_SQL = "((o_orderkey % 2147483648) * 2654435761 + 42) % 4294967296, o_orderkey"

HOLDOUT_SQL = f"""
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {ORDER_HASH_SQL})
       <= ceil(0.2 * (SELECT count(*) FROM orders)) THEN 'holdout' ELSE 'train' END AS split
FROM orders"""

STRATIFIED_SQL = f"""
WITH facts AS (SELECT CAST(count(*) AS BIGINT) AS rows, CAST(ceil(0.2 * count(*)) AS BIGINT) AS wanted FROM orders),
sizes AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1),
parts AS (SELECT o_orderpriority, (n * wanted) // rows AS w, (n * wanted) % rows AS r, wanted FROM sizes, facts),
quota AS (SELECT o_orderpriority,
                 w + CASE WHEN row_number() OVER (ORDER BY r DESC, o_orderpriority)
                          <= wanted - sum(w) OVER () THEN 1 ELSE 0 END AS quota FROM parts),
placed AS (SELECT o_orderkey, o_orderpriority,
                  row_number() OVER (PARTITION BY o_orderpriority ORDER BY {ORDER_HASH_SQL}) AS rn FROM orders)
SELECT o_orderkey, o_orderpriority, CASE WHEN rn <= quota THEN 'holdout' ELSE 'train' END AS split
FROM placed JOIN quota USING (o_orderpriority)"""


@query("holdout_split", HOLDOUT_SQL)
def holdout_split(t: Tables) -> DataFrame:
    return split.random_split(t.orders.select("o_orderkey"), 0.2, order=key_hash("o_orderkey"))


def split_orders(t: Tables) -> DataFrame:
    return split.stratified_split(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", 0.2,
                                  order=key_hash("o_orderkey"))


@query("stratified_split", STRATIFIED_SQL)
def stratified_split(t: Tables) -> DataFrame:
    return split_orders(t)


@query("split_summary", f"SELECT split, count(*) AS rows FROM ({STRATIFIED_SQL}) GROUP BY split")
def split_summary(t: Tables) -> DataFrame:
    return split.split_summary(split_orders(t))


# ------------------------------------------------------------------ profiling

def _continuous_sql(table: str, columns: list[str]) -> str:
    return "\nUNION ALL\n".join(f"""
SELECT '{c}' AS "column", count(*) - count({c}) AS null_count,
       round((count(*) - count({c})) / count(*), 4) AS null_pct, CAST(min({c}) AS DOUBLE) AS "min",
       CAST(max({c}) AS DOUBLE) AS "max", round(avg({c}), 4) AS mean, round(CAST(median({c}) AS DOUBLE), 4) AS median,
       round(stddev_samp({c}), 4) AS std FROM {table}""" for c in columns)


@query("profile_continuous", _continuous_sql("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity",
                                                          "l_extendedprice"]))
def profile_continuous(t: Tables) -> DataFrame:
    found = roles.detect_column_roles(t.lineitem, exclude=["l_shipdate"], force_categorical=["l_discount", "l_tax"],
                                      force_continuous=["l_orderkey", "l_partkey", "l_suppkey", "l_quantity"])
    return profile.profile_continuous(t.lineitem, found).withColumn("median", F.round("median", 4))


def _counts_sql(table: str, columns: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {table} GROUP BY 2" for c in columns)


@query("profile_categorical_topk", f"""
WITH c AS ({_counts_sql("(SELECT *, CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS flag FROM lineitem)",
                        ["flag", "l_linestatus", "l_linenumber"])}),
r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value ASC NULLS LAST) AS rank FROM c),
f AS (SELECT col, coalesce(sum(n) FILTER (value IS NULL), 0) AS nulls, sum(n) AS rows, count(value) AS u
      FROM c GROUP BY col)
SELECT col AS "column", CAST(nulls AS BIGINT) AS null_count, round(nulls / rows, 4) AS null_pct, u AS n_unique,
       CAST(rank AS INTEGER) AS rank, value, n AS value_count
FROM r JOIN f USING (col) WHERE rank <= 5""")
def profile_categorical_topk(t: Tables) -> DataFrame:
    df = t.lineitem.select(F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("flag"),
                           "l_linestatus", "l_linenumber")
    return profile.profile_categorical(df, roles.detect_column_roles(df))


@query("profile_summary", """
SELECT count(*) AS total_rows, CAST(5 AS INTEGER) AS total_columns, 'c_name,c_mktsegment' AS categorical_columns,
       'c_custkey,c_nationkey,c_acctbal' AS continuous_columns FROM customer""")
def profile_summary(t: Tables) -> DataFrame:
    df = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    out = profile.profile_summary(df, roles.detect_column_roles(df))
    return out.withColumns({c: F.concat_ws(",", c) for c in ("categorical_columns", "continuous_columns")})


def _describe_number_sql(table: str, c: str) -> str:
    quart = ", ".join(f"round(quantile_cont(CAST({c} AS DOUBLE), {p}), 4) AS {n}"
                      for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")))
    return f"""SELECT '{c}' AS "column", count({c}) AS "count", CAST(NULL AS BIGINT) AS "unique",
       CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, round(avg({c}), 4) AS mean,
       round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS "min", {quart},
       CAST(max({c}) AS DOUBLE) AS "max" FROM {table}"""


def _describe_label_sql(table: str, c: str) -> str:
    return f"""SELECT '{c}', (SELECT count({c}) FROM {table}), (SELECT count(DISTINCT {c}) FROM {table}),
       {c}, count(*), NULL, NULL, NULL, NULL, NULL, NULL, NULL
       FROM {table} GROUP BY {c} QUALIFY row_number() OVER (ORDER BY count(*) DESC, {c}) = 1"""


@query("describe_all", "\nUNION ALL\n".join(
    [_describe_number_sql("orders", c) for c in ("o_orderkey", "o_custkey", "o_totalprice")]
    + [_describe_label_sql("orders", c) for c in ("o_orderstatus", "o_orderpriority")]
    + ["SELECT 'o_orderdate', count(o_orderdate), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM orders"]))
def describe_all(t: Tables) -> DataFrame:
    out = profile.describe_all(t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus",
                                               "o_orderpriority", "o_orderdate"))
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "p25", "p50", "p75")})


@query("value_frequencies", f"""
WITH c AS ({_counts_sql("orders", ["o_orderstatus", "o_orderpriority"])})
SELECT col AS "column", value, round(n / sum(n) OVER (PARTITION BY col), 6) AS frequency FROM c
WHERE value IS NOT NULL""")
def value_frequencies(t: Tables) -> DataFrame:
    out = profile.value_frequencies(t.orders, ["o_orderstatus", "o_orderpriority"])
    return out.withColumn("frequency", F.round("frequency", 6))
