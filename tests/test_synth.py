"""Synthesizers, budget, storage, sources, history, and a whole run."""

import json
import os
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilframe.operators import logs, marginals, runs
from veilframe.operators.roles import ColumnRoles
from veilframe.operators.verdict import Thresholds
from veilframe.plans import pipeline, reports
from veilframe.plans.prepare import PrepareConfig, prepare
from veilframe.sources import catalog, readers, registry, writers
from veilframe.synth import SYNTHESIZERS, fit_private_tree, fit_tree, load_model
from veilframe.synth.fit import fit_copula, spanning_tree
from veilframe.synth import private
from veilframe.synth.conditional import column_predicates, conditioned
from veilframe.synth.ledger import epsilon_of, estimate_max_steps, rho_of
from veilframe.synth.noise import add_noise, cell_name, discrete_gaussian, release_key
from veilframe.synth.tokens import ColumnSpec


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 3000
    city = rng.choice(["north", "south", "east"], n, p=[0.6, 0.3, 0.1])
    pay = np.round(rng.lognormal(size=n) * np.where(city == "north", 1000, 4000), 2)
    pdf = pd.DataFrame({"city": city, "shop": np.where(rng.random(n) < 0.9, np.char.add("shop_", city), "none"), "pay": pay,
                        "age": rng.integers(18, 90, n), "member": np.where(rng.random(n) < 0.05, None, rng.random(n) < 0.5)})
    pdf["member"] = pdf["member"].astype(object)
    return spark.createDataFrame(pdf, "city string, shop string, pay double, age int, member boolean").cache()


@pytest.mark.parametrize("kind", sorted(SYNTHESIZERS))
def test_synthesizers(spark, table, kind):
    model = SYNTHESIZERS[kind](table)
    synth = model.sample(4000).cache()
    assert synth.count() == 4000 and synth.dtypes == table.dtypes
    facts = synth.agg(F.min("age"), F.max("age"), F.min("pay"), F.max("pay")).first()
    real = table.agg(F.min("age"), F.max("age"), F.min("pay"), F.max("pay")).first()
    assert facts[0] >= real[0] and facts[1] <= real[1] and facts[2] >= real[2] and facts[3] <= real[3]
    report = {(r["column"], r["metric"]): r["value"] for r in marginals.marginal_report(table, synth).collect()}
    assert max(v for (c, m), v in report.items() if m == "tvd") < 0.05 and report[("age", "jsd")] < 0.05
    linked = synth.where("shop = 'shop_north'").agg(F.avg((F.col("city") == "north").cast("int"))).first()[0]
    assert linked > 0.95 if kind == "tree" else linked < 0.95
    again = model.sample(4000).repartition(3)
    assert again.exceptAll(synth).count() == 0


def test_sampling_rules(spark, table):
    model = fit_tree(table)
    assert model.sample().count() == 3000
    with pytest.raises(ValueError):
        model.sample(-1)
    some = model.sample(200, condition="city = 'east' AND pay > 1000")
    assert some.count() == 200 and some.where("city <> 'east' OR pay <= 1000").count() == 0
    assert model.sample(10, condition="city = 'west'", max_tries=2).count() == 0


def test_conditions_are_put_into_the_tree(spark):
    """Exact shares of a small tree, rare combinations, bins that pass in part, and what is left to rejection."""
    n = 20_000
    rows = [("rare" if k == 0 else f"c{k % 4}", "x" if k < 5 else f"s{k % 4 if k % 10 else k % 3}", float(k % 1000), k) for k in range(n)]
    df = spark.createDataFrame(rows, "city string, shop string, pay double, age int")
    model = fit_tree(df, ColumnRoles(categorical=("city", "shop"), continuous=("pay", "age"), order=("city", "shop", "pay", "age")))
    wanted = "city = 'rare' AND shop = 'x'"
    predicates = column_predicates(spark, model.specs, wanted + " AND pay + age > 3 AND pay BETWEEN 100 AND 103.5")
    assert set(predicates) == {"city", "shop", "pay"}
    given, share = conditioned(model, column_predicates(spark, model.specs, wanted))
    # the same share by adding up the table of the pair
    total = df.count()
    assert share == pytest.approx(1 / total, rel=1e-6)
    many = model.sample(500, condition=wanted, max_tries=1)
    assert many.count() == 500 and many.where(f"NOT ({wanted})").count() == 0
    narrow = "pay >= 100 AND pay < 103.5 AND city = 'c1' AND pay + age > 3"
    some = model.sample(300, condition=narrow)
    assert some.count() == 300 and some.where(f"NOT ({narrow})").count() == 0
    assert some.agg(F.max("pay") - F.min("pay")).first()[0] > 2.5
    with pytest.warns(UserWarning, match="share of 0 "):
        assert model.sample(5, condition="city = 'nowhere'").count() == 0
    free = model.sample(4000).groupBy("shop").count().collect()
    held = {r["shop"]: r["count"] for r in model.sample(4000, condition="city IS NOT NULL").groupBy("shop").count().collect()}
    assert all(abs(held.get(r["shop"], 0) - r["count"]) < 250 for r in free)


def test_spanning_tree_takes_the_strongest_links():
    weights = {("a", "b"): 0.1, ("a", "c"): 0.5, ("b", "c"): 0.4}
    assert spanning_tree(["a", "b", "c"], weights) == [("a", None), ("c", "a"), ("b", "c")]
    assert set(weights) == set(combinations("abc", 2))


def test_budget_formulas():
    rho = rho_of(3.0, 1e-6)
    assert epsilon_of(rho, 1e-6) == pytest.approx(3.0, abs=1e-6) and epsilon_of(rho, 1e-6) <= 3.0


def test_private_tree_stays_in_budget(spark, table):
    model = fit_private_tree(table, epsilon=5.0, preprocessor_eps=0.5, seed=9, domains={"city": ["north", "south", "east", "west"]})
    spent = model.ledger().agg(F.max("epsilon_spent"), F.count("*")).first()
    assert spent[0] <= 5.0 and spent[0] > 4.99 and spent[1] == 1 + 5 + 4 + 4
    assert model.dp_spent["spent_epsilon_final"] == pytest.approx(spent[0])
    synth = model.sample()
    assert synth.count() == 3000 and synth.dtypes == table.dtypes
    tvd = {r["column"]: r["tvd"] for r in marginals.tvd_categorical(table, synth).collect()}
    assert tvd["city"] < 0.1
    by_sigma = fit_private_tree(table, sigma=30.0, bounds={"pay": (0.0, 50000.0), "age": (0.0, 120.0)}, seed=9)
    assert by_sigma.dp_config["epsilon_initial"] is None and by_sigma.dp_spent["spent_epsilon_final"] > 0
    row = by_sigma.report_frame().first()
    assert row["dp_config"]["is_dp_enabled"] and row["dp_config"]["domain_from_data"]


@pytest.mark.parametrize("options,message", [
    ({"epsilon": 0.0}, "positive"), ({"epsilon": 1.0, "preprocessor_eps": 1.0}, "preprocessor_eps"), ({"sigma": -1.0}, "sigma"), ({}, "bounds")])
def test_private_tree_refuses(table, options, message):
    with pytest.raises(ValueError, match=message):
        fit_private_tree(table, **options)


def test_noise_is_discrete_gaussian():
    key = release_key(4)
    for sigma in (0.7, 3.0, 25.0):
        drawn = discrete_gaussian([cell_name(("a", str(k), None)) for k in range(40_000)], sigma, key)
        places = np.arange(-int(12 * sigma) - 2, int(12 * sigma) + 3)
        weight = np.exp(-places ** 2 / (2 * sigma ** 2))
        weight /= weight.sum()
        seen = np.array([(drawn <= x).mean() for x in places])
        assert np.abs(seen - np.cumsum(weight)).max() < 1.95 / np.sqrt(len(drawn))  # Kolmogorov's bound at one in a thousand
        assert abs(drawn.std() / np.sqrt((weight * places ** 2).sum()) - 1) < 0.02
    assert (discrete_gaussian([b"x"] * 3, 5.0, key) == discrete_gaussian([b"x"], 5.0, key)[0]).all()
    assert cell_name(("a", "bc")) != cell_name(("ab", "c")) and cell_name((None,)) != cell_name(("",))
    assert release_key(None) != release_key(None)


def test_noise_does_not_depend_on_partitioning(spark):
    counts = spark.range(500).select(F.col("id").cast("string").alias("t"), F.lit("x").alias("u"), F.col("id").alias("n"))
    one = add_noise(counts.coalesce(1), "release", ["t", "u"], 9.0, release_key(1))
    two = add_noise(counts.repartition(7), "release", ["t", "u"], 9.0, release_key(1))
    assert one.exceptAll(two).count() == 0 and one.columns == counts.columns
    assert one.exceptAll(add_noise(counts, "other", ["t", "u"], 9.0, release_key(1))).count() > 400


def test_private_tree_of_open_domains(spark, monkeypatch):
    """Categories that few rows have are not released, and pair tables too large to list keep their strong cells."""
    rng = np.random.default_rng(8)
    n = 6000
    kind = rng.integers(0, 40, n)
    pdf = pd.DataFrame({"kind": np.char.add("k", kind.astype(str)), "twin": np.char.add("t", kind.astype(str)),
                        "name": [f"person {k}" for k in range(n)]})
    df = spark.createDataFrame(pdf)
    roles = ColumnRoles(categorical=("kind", "twin", "name"), order=("kind", "twin", "name"))
    model = fit_private_tree(df, roles, epsilon=8.0, seed=2)
    tokens = {r["token"] for r in model.cells.select("token").distinct().collect()}
    assert not any(t.startswith("person") for t in tokens) and {f"k{k}" for k in range(40)} <= tokens
    assert model.dp_config["delta_accounted"] == model.dp_config["delta"] / 2
    synth = model.sample(3000)
    assert synth.count() == 3000
    assert synth.where("substring(kind, 2) = substring(twin, 2)").count() > 2000
    monkeypatch.setattr(private, "LISTED_CELLS", 10)
    declared = {"kind": sorted(set(pdf["kind"])), "twin": sorted(set(pdf["twin"])), "name": ["nobody"]}
    large = fit_private_tree(df, roles, epsilon=8.0, seed=2, domains=declared)
    assert large.dp_config["domain_from_data"] is False and large.sample(3000).where("substring(kind, 2) = substring(twin, 2)").count() > 2000


def test_private_tree_needs_rows(table):
    with pytest.raises(ValueError, match="too few"):
        fit_private_tree(table.limit(5), bounds={})


def test_estimate_max_steps(spark):
    df = spark.createDataFrame([("r", 5, 0.5), ("r", 3, 0.2), ("z", 5, 0.0)], "run_id string, step int, epsilon double")
    assert {r["run_id"]: r["max_steps"] for r in estimate_max_steps(df, 2.55).collect()} == {"r": 25, "z": None}


def test_saved_model_samples_the_same(spark, table, tmp_path):
    model = fit_tree(table)
    model.save(f"{tmp_path}/m1", run_id="r1", dataset_name="shops", created_at="2024-05-01T10:00:00+00:00")
    back = load_model(spark, f"{tmp_path}/m1")
    assert back.specs == model.specs and back.kind == "tree" and isinstance(back.specs[0], ColumnSpec)
    assert back.sample(500).exceptAll(model.sample(500)).count() == 0
    fit_tree(table.select("city")).save(f"{tmp_path}/m2")
    with open(f"{tmp_path}/m2/meta.json", "w") as f:
        f.write("{broken")
    if os.path.exists(f"{tmp_path}/m2/.meta.json.crc"):
        os.truncate(f"{tmp_path}/m2/.meta.json.crc", 0)
        os.remove(f"{tmp_path}/m2/.meta.json.crc")
    rows = {r["model_id"]: r for r in catalog.model_catalog(spark, str(tmp_path)).collect()}
    assert rows["m1"]["dataset_name"] == "shops" and rows["m1"]["sample_size"] == 3000 and rows["m1"]["epsilon"] is None
    assert rows["m2"]["dataset_name"] == "unknown" and rows["m2"]["file_size_bytes"] > 0


# ------------------------------------------------------------------- sources

def test_csv(spark, tmp_path):
    with open(f"{tmp_path}/t.csv", "w") as f:
        f.write('n,x,flag,text,mixed\n1, 1.5,True, "a, ""b""",7\n?,NA,False,?,x\n3,2,true,,1e3\n')
    df = readers.read_csv(spark, f"{tmp_path}/t.csv")
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "double", "boolean", "string", "string"]
    assert [tuple(r) for r in df.collect()] == [(1, 1.5, True, 'a, "b"', "7"), (None, None, False, None, "x"), (3, 2.0, True, None, "1e3")]
    writers.write_csv(df, f"{tmp_path}/out/deep")
    assert readers.read_csv(spark, f"{tmp_path}/out/deep").exceptAll(df).count() == 0


def test_dataset_summary(spark, tmp_path):
    for name, text in {"a": 'x,"y,z"\n1,2\n3,4\n', "b": "q\n", "a_synth_1": "x\n1\n"}.items():
        with open(f"{tmp_path}/{name}.csv", "w") as f:
            f.write(text)
    got = {r["name"]: (r["rows"], r["columns"]) for r in catalog.dataset_summary(spark, f"{tmp_path}/*.csv").collect()}
    assert got == {"a": (2, 2), "b": (0, 1)}


def test_sql_records_and_publish(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("three")
    assert readers.read_sql(spark, "SELECT id FROM three WHERE id > 0").count() == 2
    with pytest.raises(ValueError, match="no rows"):
        readers.read_sql(spark, "SELECT id FROM three WHERE id > 9")
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert json.loads(writers.as_records(df).first()[0]) == {"a": 1, "b": None}
    writers.export_records(df, f"{tmp_path}/staged", "json")
    writers.publish(spark, f"{tmp_path}/staged", f"{tmp_path}/final/x")
    assert spark.read.json(f"{tmp_path}/final/x").count() == 1
    with pytest.raises(FileExistsError):
        writers.publish(spark, f"{tmp_path}/final/x", f"{tmp_path}/final/x")
    with pytest.raises(ValueError):
        writers.write_table(df, "t", if_exists="merge")


def test_registry(spark, tmp_path):
    reg = registry.ProcessRegistry(spark, f"{tmp_path}/registry")
    reg.start("p1", "/data/census.csv", "configs/a.yaml")
    reg.add_metadata("p1", "privacy_report", {"auc": float("nan"), "deep": [float("inf"), 1.0]})
    reg.start("p2", "/data/other.csv", "configs/b.yaml")
    reg.add_log("p1", "all good")
    reg.finish("p1", "COMPLETED_PASS", report_location="/reports/1.json")
    got = {r["process_id"]: r for r in reg.state().collect()}
    assert got["p1"]["status"] == "COMPLETED_PASS" and got["p1"]["end_time"] > got["p1"]["start_time"] and got["p1"]["log_id"]
    assert json.loads(got["p1"]["privacy_report"]) == {"auc": None, "deep": [None, 1.0]}
    assert got["p2"]["status"] == "RUNNING" and got["p2"]["end_time"] is None and got["p2"]["privacy_report"] is None
    parsed = {r["run_id"]: r for r in runs.parse_process_status(reg.state()).collect()}
    assert (parsed["p1"]["status"], parsed["p1"]["verdict"], parsed["p1"]["dataset_name"]) == ("completed", "PASS", "census")
    assert parsed["p2"]["status"] == "running" and parsed["p2"]["duration_sec"] is None


# ---------------------------------------------------------------------- logs

def test_run_log(spark):
    lines = ["no time yet", "[2026-04-21 12:06:58] [run A] [INFO] start", "  Traceback line 1", "\tline 2", "[2026-04-21 12:06:59] [run B] [INFO] x",
             "  belongs to B", "[2026-04-21 12:07:00] [run A] [ERROR] end", "not indented", "  lost"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file string, line_no long, text string").repartition(4)
    got = logs.run_log(df, "run A", chunk_rows=2).orderBy("ts", "file", "line_no").collect()
    assert [r["line_no"] for r in got] == [1, 2, 3, 6] and got[1]["ts"] == "2026-04-21 12:06:58"
    assert [r["line_no"] for r in logs.run_log_tail(df, "run A", 2).collect()] == [6, 3]


def test_budget_log(spark):
    lines = ["epsilon is 0.5, alpha is 9", "Epoch 5, Loss G: 1", "epsilon is 1.48, alpha is 10.2", "Epoch 6, Loss G: 1", "epsilon is 1e-2"]
    df = spark.createDataFrame([("r", i, t) for i, t in enumerate(lines)], "run_id string, line_no long, text string")
    got = logs.parse_budget_log(df, chunk_rows=2).orderBy("line_no").collect()
    assert [(r["epoch"], r["epsilon"]) for r in got] == [(0, 0.5), (5, 1.48), (6, 0.01)]
    assert tuple(logs.budget_totals(df).first()) == ("r", 0.01, 10.2, 6)


# ----------------------------------------------------------------- whole run

def test_whole_run_and_retry(spark, table):
    done = prepare(table, PrepareConfig(target="city"))
    privacy = reports.PrivacyConfig(("city", "member"), "shop", mia_n_estimators=3)
    utility = reports.UtilityConfig("city", n_estimators=5, max_depth=4)
    seeds = []

    def fit(train, seed):
        seeds.append(seed)
        return fit_tree(train, seed=seed)

    out = pipeline.run(done, fit, privacy, utility, Thresholds(max_mia_auc=0.7, require_dcr_privacy_preserved=False), dataset="shops")
    row = out.report.first()
    assert row["verdict"]["overall"] == "PASS" and out.attempts == 1 and row["dataset_name"] == "shops"
    assert row["privacy"]["metadata"]["synth_rows"] == done.train.count() == out.synth.count()
    assert row["utility"]["ml_efficacy"]["trtr"]["f1_weighted"] > 0.8
    off = reports.UtilityConfig("city", compute_correlations=False, compute_ml_efficacy=False)
    failed = pipeline.run(done, fit, None, off, Thresholds(max_mean_jsd=-1.0), max_iterations=2)
    assert failed.attempts == 2 and failed.report.first()["verdict"]["overall"] == "FAIL" and seeds == [42, 42, 43]


def test_reports_can_be_switched_off(spark, table):
    small = table.limit(300)
    config = reports.PrivacyConfig(compute_distance=False, compute_mia=False)
    row = reports.privacy_report(small, small, small, config).first()
    assert row["dp_guarantees"]["available"] is False and row["empirical_risk"]["distance_metrics"] is None and row["diagnostic"]["classical"] is None
    with pytest.raises(ValueError, match="not found"):
        reports.utility_report(small, small, small, reports.UtilityConfig("nope"))


def test_intervals_meet(spark, table):
    model = fit_private_tree(table, epsilon=5.0, preprocessor_eps=1.0, seed=3)
    for fitted in (model, fit_tree(table), fit_copula(table)):
        groups = {}
        for r in fitted.cells.collect():
            groups.setdefault((r["target"], r["parent_token"]), []).append((r["a"], r["b"]))
        for cells in groups.values():
            cells.sort()
            assert cells[0][0] == 0.0 and cells[-1][1] == 1.0
            assert all(x[1] == y[0] for x, y in zip(cells, cells[1:]))
    assert model.sample(5000).count() == 5000


def test_many_tokens_below_few_parents(spark):
    """One parent token with most of the children; tables of very different size."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 7, "big").otherwise(F.concat(F.lit("p"), F.col("id") % 50)).alias("parent"),
        F.when(F.col("id") % 10 < 7, F.concat(F.lit("c"), F.col("id") % 3000)).otherwise(F.concat(F.lit("d"), F.col("id") % 50)).alias("child"))
    model = fit_tree(rows, ColumnRoles(categorical=("parent", "child")))
    drawn = model.sample(6000)
    assert drawn.count() == 6000
    assert drawn.join(rows.distinct(), ["parent", "child"], "left_anti").count() == 0


def test_missing_rows_of_a_condition_are_told(table):
    with pytest.warns(UserWarning, match="10 of 10 rows are missing"):
        assert fit_tree(table).sample(10, condition="city = 'west'", max_tries=1).count() == 0
