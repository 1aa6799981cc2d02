"""Synthesizers, budgets and whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import key_hash
from ..operators.verdict import Thresholds
from ..operators.roles import ColumnRoles
from ..plans import pipeline, reports
from ..plans.prepare import PrepareConfig, prepare
from ..session import materialize, scratch_path
from ..sources import catalog
from ..synth import fit_copula, fit_marginal, fit_private_tree, fit_tree, load_model
from ..synth.ledger import budget_ledger, default_delta_frame, estimate_max_steps
from ..synth.model import intervals
from .privacy import USED, customer_world
from .preparing import PREPROCESS_SQL, holed_orders
from .registry import Tables, query

LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_linenumber"]
LINE_ROLES = ColumnRoles(("l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_linenumber"), ("l_quantity", "l_extendedprice"),
                         (), tuple(LINE_COLUMNS))
LINE_BOUNDS = {"l_quantity": (0.0, 51.0), "l_extendedprice": (0.0, 110000.0)}


def lines(t: Tables) -> DataFrame:
    return t.lineitem.select(*LINE_COLUMNS)


@query("fit_marginals", """
WITH c AS (SELECT 'o_orderstatus' AS target, o_orderstatus AS token, count(*) AS n FROM orders GROUP BY 2
           UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2),
s AS (SELECT *, sum(n) OVER (PARTITION BY target ORDER BY token ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY target) AS total FROM c)
SELECT target, token, round((upto - n) / total, 6) AS a, round(upto / total, 6) AS b FROM s""")
def fit_marginals(t: Tables) -> DataFrame:
    counts = t.orders.unpivot([], ["o_orderstatus", "o_orderpriority"], "target", "token").groupBy("target", "token") \
        .agg(F.count(F.lit(1)).alias("n")).withColumn("parent_token", F.lit(""))
    return intervals(counts, ordered=True).select("target", "token", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("synth_marginal")
def synth_marginal(t: Tables) -> DataFrame:
    return fit_marginal(lines(t), LINE_ROLES).sample()


@query("synth_copula")
def synth_copula(t: Tables) -> DataFrame:
    return fit_copula(lines(t), LINE_ROLES).sample()


@query("synth_tree")
def synth_tree(t: Tables) -> DataFrame:
    return fit_tree(lines(t), LINE_ROLES).sample()


@query("synth_dp_tree")
def synth_dp_tree(t: Tables) -> DataFrame:
    return fit_private_tree(lines(t), LINE_ROLES, epsilon=3.0, preprocessor_eps=0.5, seed=1).sample()


@query("synth_dp_sigma")
def synth_dp_sigma(t: Tables) -> DataFrame:
    return fit_private_tree(lines(t), LINE_ROLES, sigma=20.0, bounds=LINE_BOUNDS, seed=1).sample()


@query("synth_conditional")
def synth_conditional(t: Tables) -> DataFrame:
    return fit_tree(lines(t), LINE_ROLES).sample(1000, condition="l_returnflag = 'R' AND l_quantity > 40")


@query("model_roundtrip")
def model_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "models") + "/orders_tree"
    orders = t.orders.select("o_totalprice", "o_orderstatus", "o_orderpriority")
    fit_tree(orders).save(path, run_id="run-1", dataset_name="orders", created_at="2024-05-01T10:00:00+00:00")
    return load_model(t.spark, path).sample()


@query("model_catalog")
def model_catalog(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "models")
    orders = t.orders.select("o_totalprice", "o_orderstatus", "o_orderpriority")
    fit_tree(orders).save(f"{folder}/orders_tree", run_id="run-1", dataset_name="orders", created_at="2024-05-01T10:00:00+00:00")
    fit_private_tree(orders, epsilon=2.0, bounds={"o_totalprice": (0.0, 600000.0)}, seed=3).save(f"{folder}/orders_private")
    return catalog.model_catalog(t.spark, folder)


@query("dp_report")
def dp_report(t: Tables) -> DataFrame:
    return fit_private_tree(lines(t), LINE_ROLES, epsilon=3.0, bounds=LINE_BOUNDS, seed=1).report_frame()


@query("dp_ledger")
def dp_ledger(t: Tables) -> DataFrame:
    return fit_private_tree(lines(t), LINE_ROLES, epsilon=3.0, bounds=LINE_BOUNDS, seed=1).ledger()


@query("dp_default_delta", """
SELECT count(*) AS rows, round(1 / (count(*) * sqrt(count(*))) * 1e9, 6) AS delta_times_1e9 FROM lineitem""")
def dp_default_delta(t: Tables) -> DataFrame:
    return default_delta_frame(t.lineitem).select("rows", F.round(F.col("delta") * 1e9, 6).alias("delta_times_1e9"))


# Releases of a run: the events of a user, each costing by its value.
RELEASES_SQL = """
releases AS (SELECT user_id AS run_id, event_id AS step, value / 10000 AS rho, CASE event_type WHEN 'signup' THEN 0.01 ELSE 0 END AS epsilon,
                    1e-6::DOUBLE AS delta FROM events)"""


def releases(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), (F.col("value") / 10000).alias("rho"),
                           F.when(F.col("event_type") == "signup", 0.01).otherwise(0.0).alias("epsilon"), F.lit(1e-6).alias("delta"))


@query("budget_ledger", f"""
WITH {RELEASES_SQL},
s AS (SELECT *, sum(rho) OVER w AS r, CAST(sum(epsilon) OVER w AS DOUBLE) AS e FROM releases
      WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS UNBOUNDED PRECEDING))
SELECT run_id, step, round(r, 6) AS rho_spent, round(e + r + 2 * sqrt(r * ln(1 / delta)), 6) AS epsilon_spent FROM s""")
def ledger(t: Tables) -> DataFrame:
    return budget_ledger(releases(t)).select("run_id", "step", F.round("rho_spent", 6).alias("rho_spent"),
                                             F.round("epsilon_spent", 6).alias("epsilon_spent"))


@query("estimate_max_steps", """
SELECT user_id AS run_id, CAST(floor(25000.0::DOUBLE / (max(value) / max(event_id + 1))) AS BIGINT) AS max_steps FROM events GROUP BY user_id""")
def max_steps(t: Tables) -> DataFrame:
    return estimate_max_steps(t.events.select(F.col("user_id").alias("run_id"), (F.col("event_id") + 1).alias("step"),
                                              F.col("value").alias("epsilon")), 25000.0)


# --------------------------------------------------------------- whole jobs

@query("prepare_dataset", f"""
WITH {PREPROCESS_SQL},
facts AS (SELECT CAST(ceil(0.2 * count(*)) AS BIGINT) AS wanted, CAST(count(*) AS BIGINT) AS rows FROM filled),
sizes AS (SELECT o_orderpriority, count(*) AS n FROM filled GROUP BY 1),
parts AS (SELECT o_orderpriority, (n * wanted) // rows AS w, (n * wanted) % rows AS r, wanted FROM sizes, facts),
quota AS (SELECT o_orderpriority, w + CASE WHEN row_number() OVER (ORDER BY r DESC, o_orderpriority) <= wanted - sum(w) OVER () THEN 1 ELSE 0 END AS quota
          FROM parts),
placed AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) % 2147483648 * 2654435761 % 4294967296,
                  o_orderstatus, o_totalprice, o_orderpriority) AS rn FROM filled)
SELECT o_orderstatus, round(o_totalprice, 2) AS o_totalprice, o_orderpriority, CASE WHEN rn <= quota THEN 'holdout' ELSE 'train' END AS split
FROM placed JOIN quota USING (o_orderpriority)""")
def prepare_dataset(t: Tables) -> DataFrame:
    holed = holed_orders(t)
    config = PrepareConfig(target="o_orderpriority", direct_identifiers=("o_custkey",))
    price = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")
    done = prepare(holed.unionByName(holed), config, order=key_hash(price, 0))
    return done.tagged.withColumn("o_totalprice", F.round("o_totalprice", 2))


def prepared_orders(t: Tables):
    config = PrepareConfig(target="o_orderstatus", direct_identifiers=("o_orderkey", "o_custkey"), exclude=("o_orderdate",))
    return prepare(t.orders.withColumn("month", F.month("o_orderdate")), config)


PRIVACY = reports.PrivacyConfig(quasi_identifiers=("o_orderpriority", "month"), sensitive_attribute="o_orderstatus", mia_n_estimators=10)
UTILITY = reports.UtilityConfig("o_orderstatus", n_estimators=10, max_depth=5)


@query("privacy_report")
def privacy_report(t: Tables) -> DataFrame:
    done = prepared_orders(t)
    train = done.roles.restrict(done.train)
    model = fit_private_tree(train, done.roles, epsilon=3.0, bounds={"o_totalprice": (0.0, 600000.0)}, seed=1)
    synth = materialize(model.sample(), "synth")    # read for every part of the report
    return reports.privacy_report(train, done.roles.restrict(done.holdout), synth, PRIVACY, model.report_frame())


@query("utility_report")
def utility_report(t: Tables) -> DataFrame:
    done = prepared_orders(t)
    train = done.roles.restrict(done.train)
    synth = materialize(fit_tree(train, done.roles).sample(), "synth")      # read for every part of the report
    return reports.utility_report(train, synth, done.roles.restrict(done.holdout), UTILITY)


@query("final_report")
def final_report(t: Tables) -> DataFrame:
    done = prepared_orders(t)
    return pipeline.run(done, lambda train, seed: fit_tree(train, seed=seed), PRIVACY, UTILITY, dataset="orders").report


@query("retry_until_ok")
def retry_until_ok(t: Tables) -> DataFrame:
    """Limits nothing can meet: every attempt fails and the last one is returned."""
    done = prepared_orders(t)
    off = reports.UtilityConfig("o_orderstatus", compute_correlations=False, compute_ml_efficacy=False)
    outcome = pipeline.run(done, lambda train, seed: fit_marginal(train, seed=seed), None, off, Thresholds(max_mean_jsd=-1.0), max_iterations=2)
    return outcome.report.select("verdict.*", F.lit(outcome.attempts).alias("attempts"))


@query("scorecard")
def scorecard(t: Tables) -> DataFrame:
    """Flagship: all measures of a synthetic customer table."""
    train, holdout, synth = customer_world(t)
    return reports.scorecard(train.select(*USED), holdout.select(*USED), synth.select(*USED), ["segment", "c_nationkey"], "debtor", USED)
