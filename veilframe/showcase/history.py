"""Verdicts, reports, run history and logs, on tables shaped from the driver's."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..operators import logs, runs, verdict
from ..sources import catalog, readers, registry, writers
from ..session import materialize, scratch_path
from .registry import Tables, query

# ----------------------------------------------------------------- verdicts
# One judged run per order; reports and metrics are missing for some of them.

JUDGED_SQL = """
judged AS (SELECT o_orderkey, o_custkey % 5 <> 0 AS has_utility, o_custkey % 7 <> 0 AS has_privacy, o_custkey % 11 <> 0 AS has_dp,
                  CASE WHEN o_custkey % 3 <> 0 THEN o_totalprice / 1600000 END AS utility_loss,
                  CASE WHEN o_custkey % 4 <> 0 THEN (o_totalprice / 100 - floor(o_totalprice / 100)) / 2 END AS mean_jsd,
                  0.45 + o_totalprice / 4000000 AS attack_auc, o_orderstatus <> 'P' AS dcr_privacy_preserved,
                  CASE o_orderpriority WHEN '1-URGENT' THEN false WHEN '2-HIGH' THEN NULL ELSE true END AS is_dp_enabled,
                  o_totalprice / 120000 AS spent_epsilon FROM orders),
lists AS (SELECT *, CASE WHEN utility_loss > 0.25 THEN 'Utility Loss ' || printf('%.3f', utility_loss) || ' > threshold 0.25' END AS i1,
                 CASE WHEN mean_jsd > 0.4 THEN 'Mean JSD ' || printf('%.4f', mean_jsd) || ' > threshold 0.4' END AS i2,
                 CASE WHEN attack_auc > 0.55 THEN 'MIA AUC ' || printf('%.3f', attack_auc) || ' > threshold 0.55 (leak risk)' END AS i3,
                 CASE WHEN NOT dcr_privacy_preserved THEN 'DCR: synthetic rows are too close to the training rows' END AS i4,
                 CASE WHEN NOT is_dp_enabled THEN 'DP is disabled' END AS i5,
                 CASE WHEN spent_epsilon > 3.5 THEN 'Spent epsilon ' || printf('%.3f', spent_epsilon) || ' > threshold 3.5' END AS i6
          FROM judged),
checked AS (SELECT *, CASE WHEN has_utility THEN i1 IS NULL AND i2 IS NULL END AS utility_ok,
                   CASE WHEN has_privacy THEN i3 IS NULL AND i4 IS NULL END AS privacy_ok,
                   CASE WHEN has_dp THEN i5 IS NULL AND i6 IS NULL END AS dp_ok FROM lists)"""


def judged(t: Tables) -> DataFrame:
    c, p = F.col("o_custkey"), F.col("o_totalprice")
    prio = F.col("o_orderpriority")
    return t.orders.select(
        "o_orderkey", (c % 5 != 0).alias("has_utility"), (c % 7 != 0).alias("has_privacy"), (c % 11 != 0).alias("has_dp"),
        F.when(c % 3 != 0, p / 1600000).alias("utility_loss"), F.when(c % 4 != 0, (p / 100 - F.floor(p / 100)) / 2).alias("mean_jsd"),
        (F.lit(0.45) + p / 4000000).alias("attack_auc"), (F.col("o_orderstatus") != "P").alias("dcr_privacy_preserved"),
        F.when(prio == "1-URGENT", False).when(prio != "2-HIGH", True).alias("is_dp_enabled"), (p / 120000).alias("spent_epsilon"))


LIMITS = verdict.Thresholds(max_spent_epsilon=3.5)


@query("verdict", f"""
WITH {JUDGED_SQL}
SELECT o_orderkey, utility_ok, privacy_ok, dp_ok,
       CASE WHEN NOT coalesce(utility_ok, true) OR NOT coalesce(privacy_ok, true) OR NOT coalesce(dp_ok, true) THEN 'FAIL'
            WHEN utility_ok IS NULL OR privacy_ok IS NULL OR dp_ok IS NULL THEN 'PARTIAL' ELSE 'PASS' END AS overall
FROM checked""")
def verdicts(t: Tables) -> DataFrame:
    return verdict.verdict(judged(t), LIMITS).select("o_orderkey", "utility_ok", "privacy_ok", "dp_ok", "overall")


@query("verdict_issues", f"""
WITH {JUDGED_SQL}
SELECT o_orderkey, concat_ws('; ', CASE WHEN has_utility THEN i1 END, CASE WHEN has_utility THEN i2 END,
       CASE WHEN has_privacy THEN i3 END, CASE WHEN has_privacy THEN i4 END, CASE WHEN has_dp THEN i5 END,
       CASE WHEN has_dp THEN i6 END) AS issues
FROM checked""")
def verdict_issues(t: Tables) -> DataFrame:
    return verdict.verdict(judged(t), LIMITS).select("o_orderkey", F.concat_ws("; ", "issues").alias("issues"))


def nested_reports(t: Tables) -> DataFrame:
    """One nested privacy, utility and generator report per customer; some are missing."""
    b, n = F.col("c_acctbal"), F.col("c_nationkey")
    s = lambda **kw: F.struct(*[v.alias(k) for k, v in kw.items()])
    privacy = s(
        empirical_risk=s(membership_inference=s(attack_auc=b / 20000),
                         distance_metrics=s(dcr=s(privacy_preserved=n > 3, synth_to_real=s(median=b), holdout_to_real=s(median=-b)))),
        dp_guarantees=s(spent_epsilon_final=b / 100, epochs_completed=n),
        diagnostic=s(classical=s(k_anonymity=F.col("c_custkey"), l_diversity=n.cast("long"), t_closeness=b / 10000)))
    utility = s(ml_efficacy=s(trtr=s(f1_weighted=b * 2), tstr=s(f1_weighted=b * 3), utility_loss=s(value=-b)),
                statistical=s(summary=s(mean_jsd=b / 4)), correlations=s(pearson_corr_mae=b / 5))
    dp = s(dp_config=s(is_dp_enabled=n != 2, epsilon_initial=b / 6, delta=F.lit(1e-5)),
           dp_spent=s(spent_epsilon_final=b / 7, epochs_completed=n, epochs_requested=n + 1))
    return t.customer.select("c_custkey", F.when(n != 5, privacy).alias("privacy"), F.when(n != 6, utility).alias("utility"),
                             F.when(n != 7, dp).alias("dp_report"))


@query("flatten_report", """
SELECT c_custkey, p.mia_auc, p.dcr_privacy_preserved, p.dcr_synth_median, p.dcr_holdout_median, p.spent_epsilon, p.epochs_completed,
       p.k_anonymity, p.l_diversity, p.t_closeness, u.trtr_f1, u.tstr_f1, u.utility_loss, u.mean_jsd,
       CAST(NULL AS DOUBLE) AS mean_tvd, u.pearson_corr_mae
FROM (SELECT c_custkey, CASE WHEN c_nationkey <> 5 THEN {'mia_auc': c_acctbal / 20000, 'dcr_privacy_preserved': c_nationkey > 3,
             'dcr_synth_median': c_acctbal, 'dcr_holdout_median': -c_acctbal, 'spent_epsilon': c_acctbal / 100,
             'epochs_completed': c_nationkey, 'k_anonymity': c_custkey, 'l_diversity': CAST(c_nationkey AS BIGINT),
             't_closeness': c_acctbal / 10000} END AS p,
             CASE WHEN c_nationkey <> 6 THEN {'trtr_f1': c_acctbal * 2, 'tstr_f1': c_acctbal * 3, 'utility_loss': -c_acctbal,
             'mean_jsd': c_acctbal / 4, 'pearson_corr_mae': c_acctbal / 5} END AS u FROM customer)""")
def flatten_report(t: Tables) -> DataFrame:
    reports = nested_reports(t)
    flat = verdict.flatten_privacy_metrics(reports, "privacy", ("c_custkey",))
    return flat.join(verdict.flatten_utility_metrics(reports, "utility", ("c_custkey",)), "c_custkey")


@query("dp_guarantees", """
SELECT c_custkey, c_nationkey <> 7 AS available, CASE WHEN c_nationkey <> 7 THEN c_nationkey <> 2 END AS is_dp_enabled,
       CASE WHEN c_nationkey <> 7 THEN c_acctbal / 6 END AS epsilon_initial,
       CASE WHEN c_nationkey <> 7 THEN CAST(1e-5 AS DOUBLE) END AS delta,
       CASE WHEN c_nationkey <> 7 THEN c_acctbal / 7 END AS spent_epsilon_final,
       CASE WHEN c_nationkey <> 7 THEN c_nationkey END AS epochs_completed,
       CASE WHEN c_nationkey <> 7 THEN c_nationkey + 1 END AS epochs_requested FROM customer""")
def dp_guarantees(t: Tables) -> DataFrame:
    return verdict.dp_guarantees(nested_reports(t), "dp_report", ("c_custkey",))


# -------------------------------------------------------------- run history
# Archived processes are the orders, active runs are the events; ids overlap.

PROCESS_SQL = """
processes AS (SELECT CAST(o_orderkey AS VARCHAR) AS process_id, o_orderdate AS start_time,
                     CASE WHEN o_custkey % 6 <> 0 THEN o_orderdate + to_seconds(CAST(o_custkey % 900 AS INTEGER)) END AS end_time,
                     CASE WHEN o_custkey % 6 = 0 THEN 'RUNNING' WHEN o_custkey % 6 = 1 THEN 'ERROR' WHEN o_orderstatus = 'F' THEN 'COMPLETED_FAIL'
                          WHEN o_orderstatus = 'O' THEN 'COMPLETED_PASS' ELSE 'COMPLETED_PARTIAL' END AS status,
                     CASE WHEN o_orderpriority <> '5-LOW' THEN '/data/raw.d/' || o_orderpriority || '.csv' ELSE '' END AS source_data_info,
                     'configs/run_' || o_orderstatus || '.v2.yaml' AS config_rout FROM orders),
archived AS (SELECT process_id AS run_id, CASE WHEN starts_with(status, 'COMPLETED_') THEN 'completed' WHEN status = 'RUNNING' THEN 'running'
                    ELSE 'failed' END AS status, CASE WHEN starts_with(status, 'COMPLETED_') THEN substr(status, 11) END AS verdict,
                    CASE WHEN source_data_info = '' THEN 'unknown' ELSE regexp_extract(source_data_info, '([^/]+)\\.csv$', 1) END AS dataset_name,
                    regexp_extract(config_rout, '([^/]+)\\.yaml$', 1) AS config_name, start_time AS started_at, end_time AS finished_at,
                    epoch_us(end_time) / 1e6::DOUBLE - epoch_us(start_time) / 1e6::DOUBLE AS duration_sec FROM processes),
active AS (SELECT CAST(event_id * 2 AS VARCHAR) AS run_id, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'queued'
                  WHEN 'error' THEN 'failed' ELSE 'completed' END AS status, CASE event_type WHEN 'purchase' THEN 'PASS' WHEN 'signup' THEN 'FAIL' END AS verdict,
                  'live' AS dataset_name, 'user_' || user_id AS config_name, ts AS started_at,
                  CASE WHEN event_type IN ('error', 'purchase', 'signup') THEN ts + to_seconds(CAST(floor(value) AS INTEGER)) END AS finished_at,
                  CASE WHEN event_type IN ('error', 'purchase', 'signup') THEN floor(value) END AS duration_sec FROM events),
merged AS (SELECT * FROM active UNION ALL SELECT * FROM archived WHERE run_id NOT IN (SELECT run_id FROM active))"""


def processes(t: Tables) -> DataFrame:
    c, s = F.col("o_custkey"), F.col("o_orderstatus")
    later = F.timestamp_micros(F.unix_micros("o_orderdate") + (c % 900) * 1_000_000)
    done = F.when(s == "F", "COMPLETED_FAIL").when(s == "O", "COMPLETED_PASS").otherwise("COMPLETED_PARTIAL")
    return t.orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")).select(
        F.col("o_orderkey").alias("process_id"), F.col("o_orderdate").alias("start_time"), F.when(c % 6 != 0, later).alias("end_time"),
        F.when(c % 6 == 0, "RUNNING").when(c % 6 == 1, "ERROR").otherwise(done).alias("status"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("/data/raw.d/"), "o_orderpriority", F.lit(".csv")))
        .otherwise("").alias("source_data_info"),
        F.concat(F.lit("configs/run_"), s, F.lit(".v2.yaml")).alias("config_rout"))


def active_runs(t: Tables) -> DataFrame:
    e = F.col("event_type")
    ended = e.isin("error", "purchase", "signup")
    ts = F.col("ts").cast("timestamp")
    end = F.when(ended, F.timestamp_micros(F.unix_micros(ts) + F.floor("value") * 1_000_000))
    return t.events.select(
        (F.col("event_id") * 2).cast("string").alias("run_id"),
        F.when(e == "click", "running").when(e == "view", "queued").when(e == "error", "failed").otherwise("completed").alias("status"),
        F.when(e == "purchase", "PASS").when(e == "signup", "FAIL").alias("verdict"), F.lit("live").alias("dataset_name"),
        F.concat(F.lit("user_"), "user_id").alias("config_name"), ts.alias("created_at"), ts.alias("started_at"),
        end.alias("finished_at"), runs.duration_sec(ts, end).alias("duration_sec"))


SECONDS = ["CAST(round(epoch_us(started_at) / 1e6::DOUBLE, 3) AS DOUBLE) AS started_at", "round(duration_sec, 3) AS duration_sec"]


def plain_times(df: DataFrame) -> DataFrame:
    return df.withColumn("started_at", F.round(F.unix_micros("started_at") / 1e6, 3)) \
        .withColumn("duration_sec", F.round("duration_sec", 3)).drop("created_at", "finished_at")


@query("parse_process_status", f"""
WITH {PROCESS_SQL} SELECT run_id, status, verdict, dataset_name, config_name, {", ".join(SECONDS)} FROM archived""")
def parse_process_status(t: Tables) -> DataFrame:
    return plain_times(runs.parse_process_status(processes(t)))


def history(t: Tables) -> DataFrame:
    return runs.run_history(active_runs(t), runs.parse_process_status(processes(t)))


@query("run_history_merge", f"""
WITH {PROCESS_SQL} SELECT run_id, status, verdict, dataset_name, config_name, {", ".join(SECONDS)} FROM merged""")
def run_history_merge(t: Tables) -> DataFrame:
    return plain_times(history(t))


@query("run_history_page", f"""
WITH {PROCESS_SQL}, kept AS (SELECT *, row_number() OVER (ORDER BY started_at DESC, run_id) AS rn, count(*) OVER () AS total
                             FROM merged WHERE status = 'completed' AND verdict = 'PASS')
SELECT run_id, dataset_name, {SECONDS[1]}, CAST(3 AS INTEGER) AS page, CAST(25 AS INTEGER) AS per_page, total,
       CAST(ceil(total / 25) AS BIGINT) AS pages FROM kept WHERE rn > 50 AND rn <= 75""")
def run_history_page(t: Tables) -> DataFrame:
    page = runs.run_page(history(t), 3, 25, status="completed", verdict="PASS")
    return page.select("run_id", "dataset_name", F.round("duration_sec", 3).alias("duration_sec"), "page", "per_page", "total", "pages")


@query("run_metrics", f"""
WITH {PROCESS_SQL}
SELECT 'runs_total' AS metric, status, coalesce(verdict, '') AS verdict, CAST(count(*) AS DOUBLE) AS value FROM merged GROUP BY 2, 3
UNION ALL SELECT 'queue_size', 'queued', NULL, CAST(count(*) AS DOUBLE) FROM merged WHERE status = 'queued'
UNION ALL SELECT 'queue_size', 'running', NULL, CAST(count(*) AS DOUBLE) FROM merged WHERE status = 'running'
UNION ALL SELECT 'run_duration_seconds_avg', NULL, NULL, round(avg(duration_sec), 2) FROM merged""")
def run_metrics(t: Tables) -> DataFrame:
    return runs.run_metrics(history(t))


# --------------------------------------------------------------------- logs

LINES_SQL = """
lines AS (SELECT 'service_' || user_id % 5 AS file, event_id AS line_no,
                 CASE event_type WHEN 'error' THEN '    File "job.py", in step ' || event_id WHEN 'signup' THEN 'Traceback (most recent call last):'
                      ELSE '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [run r' || lpad(CAST(user_id % 9 AS VARCHAR), 3, '0') || '] [INFO] ' || event_type END AS text
          FROM events),
marked AS (SELECT *, CASE WHEN contains(text, 'run r004') THEN true WHEN NOT regexp_matches(text, '^[ \\t]') THEN false END AS state,
                  nullif(regexp_extract(text, '^\\[([^\\]]*)\\] ', 1), '') AS own FROM lines),
carried AS (SELECT *, last_value(state IGNORE NULLS) OVER w AS inside, last_value(own IGNORE NULLS) OVER w AS ts FROM marked
            WINDOW w AS (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
kept AS (SELECT coalesce(ts, '') AS ts, file, line_no, text FROM carried WHERE coalesce(inside, false))"""


def log_lines(t: Tables) -> DataFrame:
    e = F.col("event_type")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    text = (F.when(e == "error", F.concat(F.lit('    File "job.py", in step '), "event_id"))
            .when(e == "signup", "Traceback (most recent call last):")
            .otherwise(F.concat(F.lit("["), stamp, F.lit("] [run r"), F.lpad((F.col("user_id") % 9).cast("string"), 3, "0"),
                                F.lit("] [INFO] "), e)))
    return t.events.select(F.concat(F.lit("service_"), F.col("user_id") % 5).alias("file"), F.col("event_id").alias("line_no"), text.alias("text"))


@query("run_log_extract", f"WITH {LINES_SQL} SELECT * FROM kept")
def run_log_extract(t: Tables) -> DataFrame:
    return logs.run_log(log_lines(t), "run r004", chunk_rows=1000)


@query("run_log_tail", f"WITH {LINES_SQL} SELECT * FROM kept ORDER BY ts DESC, file DESC, line_no DESC LIMIT 100")
def run_log_tail(t: Tables) -> DataFrame:
    return logs.run_log_tail(log_lines(t), "run r004", 100)


BUDGET_SQL = """
lines AS (SELECT user_id AS run_id, event_id AS line_no,
                 CASE event_type WHEN 'click' THEN 'Epoch ' || event_id || ', Loss G: 0.5, Loss D: 1.2'
                      WHEN 'view' THEN 'epsilon is ' || printf('%.3f', value) || ', alpha is ' || printf('%.2f', value) ELSE 'noise ' || event_type END AS text
          FROM events),
parsed AS (SELECT *, TRY_CAST(nullif(regexp_extract(text, 'Epoch (\\d+),', 1), '') AS INTEGER) AS ep,
                  TRY_CAST(nullif(regexp_extract(text, 'epsilon is ([0-9.]+(?:e[+-]?\\d+)?)', 1), '') AS DOUBLE) AS epsilon,
                  TRY_CAST(nullif(regexp_extract(text, 'alpha is ([0-9.]+(?:e[+-]?\\d+)?)', 1), '') AS DOUBLE) AS alpha FROM lines)"""


def budget_lines(t: Tables) -> DataFrame:
    e = F.col("event_type")
    text = (F.when(e == "click", F.concat(F.lit("Epoch "), "event_id", F.lit(", Loss G: 0.5, Loss D: 1.2")))
            .when(e == "view", F.format_string("epsilon is %.3f, alpha is %.2f", F.col("value"), F.col("value")))
            .otherwise(F.concat(F.lit("noise "), e)))
    return t.events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"), text.alias("text"))


@query("parse_budget_log", f"""
WITH {BUDGET_SQL},
c AS (SELECT *, last_value(ep IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS seen FROM parsed)
SELECT run_id, line_no, coalesce(seen, 0) AS epoch, epsilon FROM c WHERE epsilon IS NOT NULL""")
def parse_budget_log(t: Tables) -> DataFrame:
    return logs.parse_budget_log(budget_lines(t), chunk_rows=500)


@query("budget_totals", f"""
WITH {BUDGET_SQL}
SELECT run_id, arg_max(epsilon, line_no) FILTER (epsilon IS NOT NULL) AS spent_epsilon,
       arg_max(alpha, line_no) FILTER (alpha IS NOT NULL) AS best_alpha,
       arg_max(ep, line_no) FILTER (ep IS NOT NULL) AS epochs_completed FROM parsed GROUP BY run_id""")
def budget_totals(t: Tables) -> DataFrame:
    return logs.budget_totals(budget_lines(t))


@query("process_state", """
WITH e AS (SELECT user_id AS process_id, ts AS moment, CASE event_type WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'COMPLETED_PASS'
                  WHEN 'error' THEN 'ERROR' END AS status, CASE event_type WHEN 'view' THEN '/reports/' || event_id END AS report_location,
                  CASE event_type WHEN 'purchase' THEN '/synth/' || event_id END AS synthetic_data_location, event_type, props FROM events)
SELECT process_id, arg_max(status, moment) FILTER (status IS NOT NULL) AS status,
       arg_max(report_location, moment) FILTER (report_location IS NOT NULL) AS report_location,
       arg_max(synthetic_data_location, moment) FILTER (synthetic_data_location IS NOT NULL) AS synthetic_data_location,
       epoch_us(min(moment) FILTER (status = 'RUNNING')) AS start_us, epoch_us(max(moment) FILTER (status <> 'RUNNING')) AS end_us,
       arg_max(props, moment) FILTER (event_type = 'click') AS source_info, arg_max(props, moment) FILTER (event_type = 'view') AS generator_config,
       arg_max(props, moment) FILTER (event_type = 'error') AS privacy_report, arg_max(props, moment) FILTER (event_type = 'purchase') AS utility_report
FROM e GROUP BY process_id""")
def process_state(t: Tables) -> DataFrame:
    e, none = F.col("event_type"), F.lit(None).cast("string")
    ts = F.col("ts").cast("timestamp")
    events = t.events.select(
        F.col("user_id").alias("process_id"), ts.alias("at"),
        F.when(e == "click", "RUNNING").when(e == "purchase", "COMPLETED_PASS").when(e == "error", "ERROR").alias("status"),
        none.alias("source_data_info"), none.alias("config_rout"),
        F.when(e == "purchase", F.concat(F.lit("/synth/"), "event_id")).alias("synthetic_data_location"),
        F.when(e == "view", F.concat(F.lit("/reports/"), "event_id")).alias("report_location"), none.alias("log_id"))
    ids = registry.METADATA_TYPES
    kind = (F.when(e == "click", ids["source_info"]).when(e == "view", ids["generator_config"])
            .when(e == "error", ids["privacy_report"]).when(e == "purchase", ids["utility_report"]))
    metadata = t.events.select(F.col("user_id").alias("process_id"), kind.alias("metadata_type_id"),
                               F.col("props").alias("metadata_value"), ts.alias("created_at"))
    state = registry.process_state(events, metadata)
    return state.select("process_id", "status", "report_location", "synthetic_data_location",
                        F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"),
                        *list(ids))


# ------------------------------------------------------------------ sources

@query("read_csv_na", """
SELECT c_custkey, c_name, CASE WHEN c_nationkey <> 7 THEN CAST(c_nationkey AS BIGINT) END AS c_nationkey, c_acctbal,
       CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS c_mktsegment, c_acctbal < 0 AS debtor FROM customer""")
def read_csv_na(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    marked = t.customer.select(
        "c_custkey", "c_name", F.when(F.col("c_nationkey") == 7, "?").otherwise(F.concat(F.lit(" "), "c_nationkey")).alias("c_nationkey"),
        "c_acctbal", F.when(F.col("c_mktsegment") == "BUILDING", "n/a").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        (F.col("c_acctbal") < 0).alias("debtor"))
    marked.write.option("header", True).option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return readers.read_csv(t.spark, path, na_values=["?"])


@query("read_sql_query", """
SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority""")
def read_sql_query(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("orders")
    return readers.read_sql(t.spark, "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total "
                                     "FROM orders GROUP BY o_orderpriority")


@query("export_records_json", """
SELECT '{"r":' || c_custkey || ',"nation":' || CASE WHEN c_nationkey <> 3 THEN CAST(c_nationkey AS VARCHAR) ELSE 'null' END
       || ',"segment":"' || c_mktsegment || '"}' AS record FROM customer""")
def export_records_json(t: Tables) -> DataFrame:
    return writers.as_records(t.customer.select(
        F.col("c_custkey").alias("r"), F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("nation"),
        F.col("c_mktsegment").alias("segment")))


@query("dataset_summary")
def dataset_summary(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "datasets")
    for name in ("customer", "part", "supplier"):
        writers.write_csv(getattr(t, name), f"{folder}/{name}")
    return catalog.dataset_summary(t.spark, f"{folder}/*/*.csv")


@query("write_table_modes", """
SELECT c_custkey AS key, c_name AS name, 1 AS part FROM customer UNION ALL SELECT s_suppkey, s_name, 2 FROM supplier""")
def write_table_modes(t: Tables) -> DataFrame:
    """A catalog table: written, written anew, appended to, and read back."""
    table = f"veilframe_{uuid.uuid4().hex}"
    people = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit(1).alias("part"))
    more = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit(2).alias("part"))
    writers.write_table(more, table)
    writers.write_table(people, table, if_exists="replace")
    writers.write_table(more, table, if_exists="append")
    try:
        return materialize(t.spark.table(table), "table")
    finally:
        t.spark.sql(f"DROP TABLE {table}")


@query("report_round_trip", """
SELECT o_orderstatus AS status, count(*) AS orders, round(sum(o_totalprice), 2) AS total,
       'orders_' || o_orderstatus || '__tree__20240101_000000' AS report_name FROM orders GROUP BY o_orderstatus""")
def report_round_trip(t: Tables) -> DataFrame:
    """One report per order status, saved and read back together."""
    folder = scratch_path(t.spark, "reports")
    facts = materialize(t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total")), "facts")
    for row in facts.select("status").collect():  # one row per status
        writers.write_report(facts.where(F.col("status") == row["status"]), folder, f"orders_{row['status']}", "tree", datetime(2024, 1, 1))
    return writers.read_reports(t.spark, folder)


@query("publish_staged", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def publish_staged(t: Tables) -> DataFrame:
    """A staged table, published and read from its final place."""
    staged, final = scratch_path(t.spark, "staged"), scratch_path(t.spark, "final")
    t.orders.select("o_orderkey", "o_custkey", "o_totalprice").write.parquet(staged)
    writers.publish(t.spark, staged, final)
    return t.spark.read.parquet(final)


@query("registry_round_trip", """
SELECT 'nation-' || n_nationkey AS process_id, CASE WHEN n_nationkey % 5 = 4 THEN 'ERROR' ELSE 'COMPLETED_PASS' END AS status,
       n_name AS source_data_info, '/synth/' || n_nationkey AS synthetic_data_location,
       '{"customers": ' || count(c_custkey) || '}' AS privacy_report
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name""")
def registry_round_trip(t: Tables) -> DataFrame:
    """A process per nation: started, described and ended in the registry; its state is read back."""
    book = registry.ProcessRegistry(t.spark, scratch_path(t.spark, "registry"))
    sizes = t.customer.groupBy("c_nationkey").count()
    nations = t.nation.join(sizes, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", "n_name", F.coalesce("count", F.lit(0)).alias("n"))
    rows = nations.collect()  # 25 nations
    with book.batch():
        for r in rows:
            book.start(f"nation-{r['n_nationkey']}", r["n_name"], "/config")
    with book.batch():
        for r in rows:
            book.add_metadata(f"nation-{r['n_nationkey']}", "privacy_report", {"customers": r["n"]})
            book.finish(f"nation-{r['n_nationkey']}", "ERROR" if r["n_nationkey"] % 5 == 4 else "COMPLETED_PASS", f"/synth/{r['n_nationkey']}")
    book.compact("process_events")
    return book.state().select("process_id", "status", "source_data_info", "synthetic_data_location", "privacy_report")
