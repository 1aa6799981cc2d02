"""Cleaning, typing, minimising and splitting on small tables."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilframe.functions import quantiles
from veilframe.functions.quantiles import _pick
from veilframe.functions.ordered import carry_forward, dense_codes, ordered_ranges, running_totals
from veilframe.functions.values import bin_column, recode_contains, recode_equals, sanitize_nonfinite, split_at
from veilframe.operators import clean, profile, roles, split
from veilframe.plans.prepare import PrepareConfig, prepare


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(25.0, "low", 0.1, True), (30.0, "high", 0.5, False), (30.0, "high", 0.5, False),
            (None, "low", 0.3, True), (45.0, "high", None, True)]
    return spark.createDataFrame(rows, "age double, income string, score double, flag boolean")


def test_preprocess_dedups_then_fills(mixed):
    got = clean.preprocess(mixed)
    assert got.columns == mixed.columns
    rows = got.collect()
    assert len(rows) == 4 and all(v is not None for r in rows for v in r)
    assert {r["age"] for r in rows} == {25.0, 30.0, 45.0}
    assert [r["score"] for r in rows if r["age"] == 45.0] == [0.3]


def test_whole_number_column_keeps_a_half_median(spark):
    got = clean.impute(spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "v int"))
    assert sorted(r["v"] for r in got.collect()) == [1.0, 2.0, 2.5, 3.0, 4.0]


def test_mode_fill_and_ties(spark):
    city = spark.createDataFrame([("Moscow",), ("Kazan",), (None,), ("SPb",), ("Moscow",)], "city string")
    assert sorted(r["city"] for r in clean.impute(city).collect()) == ["Kazan", "Moscow", "Moscow", "Moscow", "SPb"]
    tie = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    assert clean.exact_modes(tie, ["c"]) == {"c": "a"}
    with pytest.raises(ValueError, match="without any value"):
        clean.impute(spark.createDataFrame([(None,), (None,)], "c string"))


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "v double")
    assert sorted(r["v"] for r in clean.impute(df).collect()) == [1.0, 2.0, 3.0]
    assert clean.dropna_any(df).count() == 2


@pytest.fixture(scope="module")
def typed(spark):
    rows = [(f"Person_{i}", i, i % 5, i * 1000.5, i % 2 == 0, datetime.datetime(2020 + i % 5, 1, 1), 101 + i) for i in range(20)]
    return spark.createDataFrame(rows, "name string, age int, education int, salary double, is_adult boolean, created_at timestamp, id int")


def test_roles(typed):
    got = roles.detect_column_roles(typed, exclude=["id"])
    assert got.categorical == ("name", "education", "is_adult")
    assert got.continuous == ("age", "salary")
    assert got.ignored == ("created_at", "id")
    assert sorted([*got.categorical, *got.continuous, *got.ignored]) == sorted(typed.columns)
    forced = roles.detect_column_roles(typed, exclude=["id"], force_categorical=["age", "id"], force_continuous=["age", "education"])
    assert "age" in forced.categorical and "education" in forced.continuous and "id" in forced.ignored


@pytest.mark.parametrize("distinct,role", [(15, "categorical"), (16, "continuous")])
def test_role_limit_is_exact(spark, distinct, role):
    df = spark.range(5000).select((F.col("id") % distinct).alias("v"))
    assert roles.detect_column_roles(df).role_of("v") == role


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "a@x.com", "Alice", 25, "low", "Moscow"), (2, "b@x.com", "Bob", 30, "high", "Moscow"), (3, "c@x.com", "Carol", 35, "low", "SPb"),
            (4, "d@x.com", "Dave", 40, "high", "SPb"), (5, "e@x.com", "Eve", 45, "low", "Moscow")]
    return spark.createDataFrame(rows, "id int, email string, name string, age int, income string, city string")


def test_minimize(people):
    kept, report = clean.minimize(people, ["id", "email", "phone"])
    assert report.removed_direct_identifiers == ["id", "email"] and kept.columns == ["name", "age", "income", "city"]
    assert (report.columns_before, report.columns_after, kept.count()) == (6, 4, 5)
    kept, report = clean.minimize(people, [], drop_high_cardinality=True, cardinality_threshold=0.9)
    assert report.removed_high_cardinality == ["email", "name"] and "id" in kept.columns and "city" in kept.columns
    assert clean.minimize(people, [])[0].columns == people.columns


def test_align_types_keeps_what_cannot_be_cast(spark):
    real = spark.createDataFrame([(1, 1.5)], "a int, b double")
    synth = spark.createDataFrame([("7", "x"), (None, "2.5")], "a string, b string")
    assert [f.dataType.simpleString() for f in clean.align_types(synth, real).schema.fields] == ["int", "string"]


# Coarse classes of the census columns.
CENSUS = {
    "age": ("age_bin", lambda c: F.coalesce(bin_column(c.try_cast("double"), (0, 30, 60, 100), ("<=30", "31-60", "61+")), F.lit("nan"))),
    "education-num": ("edu_bin", lambda c: split_at(c.try_cast("double"), 10, "low", "high")),
    "marital-status": ("marital_bin", lambda c: recode_contains(c, "Married", "married", "not-married")),
    "race": ("race_bin", lambda c: recode_equals(c, "White", "Non-White")),
}


def test_generalize_and_bins(spark):
    df = spark.createDataFrame([("30", 10, "Married-civ", "White"), ("31", 11, "Divorced", "Black"), ("?", None, None, None)],
                               "age string, `education-num` int, `marital-status` string, race string")
    got = clean.generalize(df, {"missing": ("x", lambda c: c), **CENSUS}).select("age_bin", "edu_bin", "marital_bin", "race_bin").collect()
    assert [tuple(r) for r in got] == [("<=30", "low", "married", "White"), ("31-60", "high", "not-married", "Non-White"),
                                       ("nan", "high", "not-married", "Non-White")]
    assert spark.range(1).select(bin_column(F.lit(0.0), (0, 1), ("x",)).alias("b")).first()["b"] is None


def test_sanitize(spark):
    df = spark.createDataFrame([(float("inf"), [1.0, float("nan")])], "a double, b array<double>")
    assert tuple(sanitize_nonfinite(df).first()) == (None, [1.0, None])


# ------------------------------------------------------------------ splitting

@pytest.mark.parametrize("share", [0.2, 0.33])
def test_stratified_split_is_exact(spark, share):
    df = spark.range(1003).select("id", F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b").otherwise("c").alias("y"))
    tagged = split.stratified_split(df, "y", share)
    rows = tagged.collect()
    assert sorted(r["id"] for r in rows) == list(range(1003))
    held = [r for r in rows if r["split"] == "holdout"]
    assert len(held) == math.ceil(share * 1003)
    for y in "abc":
        size = sum(r["y"] == y for r in rows)
        assert abs(sum(r["y"] == y for r in held) - share * size) < 1.01
    again = split.stratified_split(df.repartition(7), "y", share).where("split = 'holdout'")
    assert {r["id"] for r in again.collect()} == {r["id"] for r in held}


def test_split_and_sample_with_a_hot_row(spark):
    """A third of the table is one and the same row."""
    df = spark.range(2000).select(F.col("id").alias("v")).unionAll(spark.range(1000).select(F.lit(7).cast("long").alias("v")))
    tagged = split.random_split(df, 0.25)
    assert tagged.count() == 3000 and tagged.where("split = 'holdout'").count() == 750
    assert tagged.groupBy("v").count().where("v = 7").first()["count"] == 1001
    assert split.sample_rows(df, 1234).count() == 1234
    assert split.sample_rows(df, 0).count() == 3000 and split.sample_rows(df, 5000).count() == 3000


def test_split_refuses_bad_input(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "y string")
    with pytest.raises(ValueError, match="fewer than two"):
        split.stratified_split(df, "y")
    with pytest.raises(ValueError):
        split.random_split(df, 1.0)


def test_prepare(spark, typed):
    many = typed.unionAll(typed.withColumn("age", F.col("age") + 100)).unionAll(typed)
    done = prepare(many, PrepareConfig(target="is_adult", direct_identifiers=("name",), exclude=("id",)))
    assert done.train.count() == 32 and done.holdout.count() == 8
    assert "name" not in done.tagged.columns and "id" not in done.tagged.columns and "created_at" in done.tagged.columns
    assert "is_adult" in done.roles.categorical and "created_at" in done.roles.ignored
    assert done.roles.restrict(done.train).columns == ["age", "education", "salary", "is_adult"]
    header, continuous, categorical = done.profile()
    assert header.first()["total_rows"] == 40 and continuous.count() == 2 and categorical.where("column = 'is_adult'").count() == 2
    with pytest.raises(ValueError):
        prepare(typed, PrepareConfig(holdout=0.6))


# ------------------------------------------------------- distributed ordering

def test_exact_quantiles(spark, monkeypatch):
    rng = np.random.default_rng(0)
    values = {"a": rng.lognormal(size=5000), "b": rng.integers(0, 9, 5000).astype(float), "c": np.full(5000, 3.0)}
    df = spark.createDataFrame(pd.DataFrame(values))
    probs = [0.0, 0.05, 0.25, 0.5, 0.999, 1.0]
    for limit in (10_000, 40):  # the second forces the sketch-and-narrow path
        monkeypatch.setattr(quantiles, "RANK_LIMIT", limit)
        got = quantiles.exact_quantiles(df, dict.fromkeys(values, probs))
        for c, v in values.items():
            np.testing.assert_allclose(got[c], np.quantile(v, probs), rtol=1e-12)


def test_weighted_quantiles_with_little_to_rank(spark, monkeypatch):
    draw = np.random.default_rng(4)
    values = np.round(draw.normal(0, 50, 3000), 1)
    weights = draw.integers(0, 4, 3000)
    weights[7] = 9 * weights.sum()                   # one row has 90 % of the weight
    crowd = np.where(np.arange(3000) % 10 < 9, 12.5, values)   # one value has 90 % of the rows
    df = spark.createDataFrame([(float(a), float(b), int(w)) for a, b, w in zip(values, crowd, weights)], "v double, u double, w long").repartition(3)
    probs = [0.0, 0.01, 0.05, 0.5, 0.93, 0.97, 0.999, 1.0]
    for limit in (1, 20, 10_000):
        monkeypatch.setattr(quantiles, "RANK_LIMIT", limit)
        given = []
        monkeypatch.setattr(quantiles, "_pick", lambda base, index, copies, targets, pick=_pick: given.extend(targets) or pick(base, index, copies, targets))
        got = quantiles.exact_quantiles(df, {"v": probs, "u": probs}, "w")
        assert all(t.rows <= limit or t.low == t.high for t in given)
        for name, column in (("v", values), ("u", crowd)):
            np.testing.assert_allclose(got[name], np.quantile(np.repeat(column, weights), probs), rtol=1e-12)


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([(1.0, 3, 0), (2.0, 1, 0), (9.0, 0, 5), (4.0, 2, 1)], "v double, w int, x int")
    facts = {}
    got = quantiles.exact_quantiles(df.select("v", F.col("v").alias("u"), "w", "x"), {"v": [0.5], "u": [0.5]}, {"v": "w", "u": "x"}, facts)
    assert got == {"v": [np.median([1, 1, 1, 2, 4, 4])], "u": [9.0]}
    assert facts["v"]["n"] == 6 and facts["v"]["mean"] == pytest.approx(13 / 6) and facts["u"]["min"] == 4.0


def test_running_totals(spark):
    rng = np.random.default_rng(1)
    values = pd.DataFrame({"v": rng.permutation(3000) / 7.0, "n": rng.integers(1, 9, 3000), "g": rng.choice(["x", "y"], 3000)})
    df = spark.createDataFrame(values)
    plain = running_totals(df, "v", {"before": "n"}).toPandas().sort_values("v")
    assert (plain["before"].to_numpy() == plain["n"].cumsum().to_numpy() - plain["n"].to_numpy()).all()
    grouped = running_totals(df, "v", {"before": "n"}, by="g").toPandas().sort_values("v")
    want = grouped.groupby("g")["n"].cumsum() - grouped["n"]
    assert (grouped["before"] == want).all()


def test_carry_forward_crosses_chunks(spark):
    rows = [("f", i, "x" if i == 3 else "y" if i == 40 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "f string, i long, v string").repartition(5)
    got = {r["i"]: r["c"] for r in carry_forward(df, ["f"], "i", {"c": F.col("v")}, chunk_rows=10).collect()}
    assert [got[i] for i in (0, 2, 3, 39, 40, 99)] == [None, None, "x", "x", "y", "y"]


def test_dense_codes(spark):
    df = spark.createDataFrame([("a", f"v{i % 50:03d}") for i in range(400)] + [("b", "z"), ("b", "y")], "g string, v string")
    got = {(r["g"], r["v"]): r["code"] for r in dense_codes(df, "g", "v").collect()}
    assert all(got[("a", f"v{i:03d}")] == i for i in range(50)) and got[("b", "y")] == 0 and got[("b", "z")] == 1


def test_describe_matches_pandas(spark, mixed):
    got = {r["column"]: r for r in profile.describe_all(mixed).collect()}
    want = mixed.toPandas()["age"].describe()
    assert got["age"]["p50"] == want["50%"] and got["age"]["std"] == pytest.approx(want["std"])
    assert got["income"]["top"] == "high" and got["income"]["freq"] == 3


def test_ranges_of_a_group_are_not_dealt_by_the_group(spark):
    """Rows of a group must never meet their cuts in one task, whatever the optimizer guesses of the cuts' size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([("a", float(i), 1) for i in range(2000)] + [("b", 5.0, 1)], "g string, v double, n long")
        ranged = ordered_ranges(df, "v", "r", by="g")
        rows = ranged.collect()
        plan = ranged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert len(rows) == 2001 and len({r["r"] for r in rows if r["g"] == "a"}) > 200
