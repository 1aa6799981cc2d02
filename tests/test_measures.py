"""Privacy, utility and verdict measures on small tables, against plain formulas."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilframe.operators import anonymity, association, efficacy, marginals, quality, scores, verdict


@pytest.fixture(scope="module")
def groups(spark):
    rows = [("a", "x")] * 2 + [("a", "y")] + [("b", "x")] * 2 + [(None, "y")]
    return spark.createDataFrame(rows, "g string, s string")


def test_k_l_t(spark, groups):
    assert anonymity.k_anonymity(groups, ["g"]).first()[0] == 2
    assert anonymity.l_diversity(groups, ["g"], "s").first()[0] == 1
    half = spark.createDataFrame([("x",), ("y",)], "s string")
    assert anonymity.t_closeness(groups, ["g"], "s", half).first()[0] == 0.5
    assert tuple(anonymity.classical_metrics(groups, ["g"], "s", half).first()) == (2, 1, 0.5)
    assert anonymity.check_klt(groups, ["g"], "s", half, 2, 1, 0.6).first()["passed"]
    assert not anonymity.check_klt(groups, ["g"], "s", half, 3, 1, 0.6).first()["passed"]
    assert [tuple(r) for r in anonymity.k_violations(groups, ["g"], 3).collect()] == [("b", 2)]
    with pytest.raises(ValueError, match="not found"):
        anonymity.k_anonymity(groups, ["nope"])
    assert anonymity.k_anonymity(groups.where("g IS NULL"), ["g"]).first()[0] is None


def test_t_of_unseen_and_missing_values(spark):
    df = spark.createDataFrame([("a", "z"), ("b", None)], "g string, s string")
    ref = spark.createDataFrame([("x",), ("y",)], "s string")
    got = {r["g"]: r["t"] for r in anonymity.group_distances(df, ["g"], "s", ref).collect()}
    assert got == {"a": 1.0, "b": 0.5}
    only = {r["g"]: r["t"] for r in anonymity.group_distances(df, ["g"], "s", ref, True).collect()}
    assert only["a"] == 0.5


def tables(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n) * (1 + seed)
    return pd.DataFrame({"x": x, "y": x * 0.5 + rng.normal(size=n), "z": np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 30, n)),
                         "k": 1.0, "a": rng.choice(list("pqr"), n), "b": rng.choice(["u", "v", None], n), "f": rng.random(n) < 0.5})


SCHEMA = "x double, y double, z double, k double, a string, b string, f boolean"


def both(spark):
    real, synth = tables(700, 1), tables(500, 2)
    make = lambda d: spark.createDataFrame(d.astype({"b": object}).where(d.notna(), None), SCHEMA)
    return real, synth, make(real), make(synth)


def plain_jsd(r, s):
    low, high = min(r.min(), s.min()), max(r.max(), s.max())
    edges = np.linspace(low, high, 51)
    p, q = (np.histogram(v, edges, density=True)[0] + 1e-10 for v in (r, s))
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return float((p * np.log(p / m) + q * np.log(q / m)).sum() / 2)


def test_marginals(spark):
    real, synth, r, s = both(spark)
    report = {(x["column"], x["metric"]): x["value"] for x in marginals.marginal_report(r, s).collect()}
    for c in ("x", "y", "z"):
        a, b = real[c].dropna(), synth[c].dropna()
        assert report[(c, "jsd")] == pytest.approx(plain_jsd(a, b), abs=2e-6)
        assert report[(c, "mean_delta")] == pytest.approx(a.mean() - b.mean(), abs=1e-4)
        assert report[(c, "std_delta")] == pytest.approx(a.std() - b.std(), abs=1e-4)
        assert report[(c, "median_delta")] == pytest.approx(a.median() - b.median(), abs=1e-4)
    assert report[("k", "jsd")] == 0.0
    for c in ("a", "b", "f"):
        p, q = (d[c].value_counts(normalize=True) for d in (real, synth))
        want = 0.5 * sum(abs(p.get(v, 0) - q.get(v, 0)) for v in {*p.index, *q.index})
        assert report[(c, "tvd")] == pytest.approx(want, abs=1e-6)


def test_a_table_compared_with_itself(spark):
    _, _, r, _ = both(spark)
    report = marginals.marginal_report(r, r.repartition(7)).collect()
    assert all(x["value"] == 0 for x in report)
    assert association.cramers_v_mae(r, r).first()[0] == 0
    pearson = association.pearson_mae(r, r).first()
    assert pearson["pearson_corr_mae"] == 0 and pearson["undefined_pairs"] == 3
    assert quality.quality_score(r, r).first()["overall_score"] == 1.0


def test_disjoint_columns(spark):
    low = spark.createDataFrame([(float(i), "a") for i in range(10)], "v double, c string")
    high = spark.createDataFrame([(float(i + 100), "b") for i in range(10)], "v double, c string")
    assert marginals.jsd_numeric(low, high).first()["jsd"] == pytest.approx(math.log(2), abs=1e-6)
    assert marginals.tvd_categorical(low, high).first()["tvd"] == 1.0


def test_pearson_forms_agree(spark, monkeypatch):
    real, _, r, _ = both(spark)
    cols = ["x", "y", "z", "k"]
    want = real[cols].corr()
    for limit in (100, 0):  # aggregate, then matrix products
        monkeypatch.setattr(association, "_PAIRS_PER_AGGREGATE", limit)
        got = {(x["a"], x["b"]): x["r"] for x in association.pearson_pairs(r, cols).collect()}
        for a, b in combinations(cols, 2):
            assert got[(a, b)] is None if "k" in (a, b) else got[(a, b)] == pytest.approx(want.loc[a, b], abs=1e-9)


def test_cramers_v(spark):
    same = spark.createDataFrame([("a", "a"), ("b", "b")] * 5, "p string, q string")
    free = spark.createDataFrame([(p, q) for p in "ab" for q in "ab"] * 5, "p string, q string")
    assert association.cramers_v(same, ["p", "q"]).first()["v"] == pytest.approx(1.0)
    assert association.cramers_v(free, ["p", "q"]).first()["v"] == 0.0
    real, _, r, _ = both(spark)
    got = association.cramers_v(r, ["a", "b"]).first()["v"]
    table = pd.crosstab(real["a"], real["b"]).to_numpy()
    e = np.outer(table.sum(1), table.sum(0)) / table.sum()
    assert got == pytest.approx(math.sqrt(((table - e) ** 2 / e).sum() / (table.sum() * (min(table.shape) - 1))), abs=1e-9)


def test_scores(spark):
    df = spark.createDataFrame([("a", "a", 0.9), ("a", "b", 0.4), ("b", "b", 0.4), ("c", "a", 0.1)], "y string, p string, s double")
    # a 1/2, b 2/3, c 0, weighted 2 : 1 : 1
    assert scores.weighted_f1(df, "y", "p").first()[0] == round((2 * 0.5 + 2 / 3) / 4, 4)
    assert scores.roc_auc(df, F.col("y") == "a", "s").first()[0] == round((1 + 1 + 0.5 + 1) / 4, 4)
    assert scores.roc_auc(df, F.col("y") == "none", "s").first()[0] is None
    num = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "y double, p double")
    got = scores.regression_scores(num, "y", "p").first()
    assert got["mae"] == 0.5 and got["r2"] == round(1 - 1.25 / (np.var([1, 2, 4]) * 3), 4)


def test_efficacy_learns_and_regresses(spark):
    rng = np.random.default_rng(3)
    x = rng.random(600)
    pdf = pd.DataFrame({"x": x, "c": np.where(x > 0.7, "hi", "lo"), "y": np.where(x > 0.5, "yes", "no"), "t": 3 * x})
    df = spark.createDataFrame(pdf)
    train, test = df.limit(400), df.subtract(df.limit(400))
    got = efficacy.ml_efficacy(train, train.withColumn("x", F.lit(0.5)).drop("c"), test,
                               efficacy.EfficacyConfig("y", n_estimators=5, max_depth=4, drop=("t",))).first()
    assert got["trtr_f1_weighted"] > 0.95 and got["utility_loss"] > 0.1 and got["interpretation"] == "degraded"
    reg = efficacy.run_experiment(train, test, efficacy.EfficacyConfig("t", "regression", 5, 5)).first()
    assert reg["r2"] > 0.9


# ------------------------------------------------------------------- verdict

BASE = {"has_utility": True, "has_privacy": True, "has_dp": True, "utility_loss": 0.10, "mean_jsd": 0.15, "attack_auc": 0.51,
        "dcr_privacy_preserved": True, "is_dp_enabled": True, "spent_epsilon": 2.5}
CASES = [
    ({}, {}, "PASS", None), ({"utility_loss": 0.5}, {}, "FAIL", "Utility Loss"), ({"mean_jsd": 0.5}, {}, "FAIL", "JSD"),
    ({"attack_auc": 0.75}, {}, "FAIL", "MIA"), ({"dcr_privacy_preserved": False}, {}, "FAIL", "DCR"),
    ({"is_dp_enabled": False}, {}, "FAIL", "DP"), ({"spent_epsilon": 3.5}, {"max_spent_epsilon": 2.0}, "FAIL", "epsilon"),
    ({"has_privacy": False}, {}, "PARTIAL", None), ({"has_utility": False}, {}, "PARTIAL", None),
    ({"has_utility": False, "has_privacy": False, "has_dp": False}, {}, "PARTIAL", None),
    ({"utility_loss": 0.5, "has_privacy": False}, {}, "FAIL", "Utility Loss"), ({"is_dp_enabled": None}, {}, "PASS", None),
    ({"is_dp_enabled": None}, {"strict_dp": True}, "FAIL", "DP"), ({"mean_jsd": float("nan")}, {}, "FAIL", "JSD is not a number"),
    ({"utility_loss": 0.25, "mean_jsd": 0.4, "attack_auc": 0.6}, {"max_mia_auc": 0.6}, "PASS", None),
]


@pytest.mark.parametrize("change,limits,overall,issue", CASES)
def test_verdict(spark, change, limits, overall, issue):
    row = {**BASE, **change}
    df = spark.createDataFrame([tuple(row[c] for c in verdict.METRICS)], ", ".join(f"{c} {t}" for c, t in verdict.METRICS.items()))
    got = verdict.verdict(df, verdict.Thresholds(**{"max_mia_auc": 0.60, **limits})).first()
    assert got["overall"] == overall
    assert (got["issues"] == []) if issue is None else (len(got["issues"]) == 1 and issue in got["issues"][0])
    for ok, present in (("utility_ok", "has_utility"), ("privacy_ok", "has_privacy"), ("dp_ok", "has_dp")):
        assert (got[ok] is None) == (not row[present])


def test_flatten_missing_parts(spark):
    df = spark.sql("SELECT struct(struct(struct(0.5D AS attack_auc) AS membership_inference) AS empirical_risk) AS privacy")
    got = verdict.flatten_privacy_metrics(df).first().asDict()
    assert got.pop("mia_auc") == 0.5 and set(got.values()) == {None}
