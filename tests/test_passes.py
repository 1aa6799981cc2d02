"""Counting, drawing, paging and summing in blocks against plain versions."""

import math
import os
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.functions import ordered
from veilframe.operators import association, clean, runs
from veilframe.sources import catalog
from veilframe.sources.registry import ProcessRegistry
from veilframe.synth import fit, ledger, packed

ROWS = [(i % 2, None if i % 7 == 0 else f"a{i % 5}", None if i % 11 == 0 else i % 3, f"c{i * i % 13}") for i in range(400)]
PAIRS = [("x", "y"), ("x", "z"), ("y", "z")]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(ROWS, "s int, x string, y int, z string")


@pytest.mark.parametrize("block", [3, 1 << 16])
@pytest.mark.parametrize("keep_null", [False, True])
def test_pair_counts_match_counting_row_by_row(spark, labels, monkeypatch, block, keep_null):
    monkeypatch.setattr(association, "BLOCK_ROWS", block)
    want = Counter()
    for row in ROWS:
        value = dict(zip("sxyz", row))
        for i, (a, b) in enumerate(PAIRS):
            if keep_null or (value[a] is not None and value[b] is not None):
                want[value["s"], i, *(association.NULL_VALUE if value[c] is None else str(value[c]) for c in (a, b))] += 1
    got = association.pair_counts(labels, PAIRS, "s", keep_null).collect()
    assert {tuple(r)[:4]: r["n"] for r in got} == want and len(got) == len(want)


def test_pair_counts_of_nothing(spark, labels):
    assert association.pair_counts(labels.limit(0), PAIRS).count() == 0
    empty = labels.select(F.lit(None).cast("string").alias("x"), "y", "z")
    assert {r["pair"] for r in association.pair_counts(empty, PAIRS).collect()} == {2}


def test_mutual_information_matches_its_definition(labels):
    got = {(r["a"], r["b"]): r["mi"] for r in association.pairwise_mutual_information(labels, ["x", "y", "z"]).collect()}
    for i, j in combinations(range(1, 4), 2):
        n, joint = len(ROWS), Counter((r[i], r[j]) for r in ROWS)
        left, right = Counter(r[i] for r in ROWS), Counter(r[j] for r in ROWS)
        want = sum(c / n * math.log(c * n / left[a] / right[b]) for (a, b), c in joint.items())
        assert got["sxyz"[i], "sxyz"[j]] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("kind", ["marginal", "copula", "tree"])
def test_packed_and_joined_draws_are_the_same(spark, labels, monkeypatch, kind):
    table = labels.select("x", "z", F.expr("CAST(y AS STRING) AS y"), (F.col("s") + F.col("y")).cast("double").alias("v"))
    model = fit.SYNTHESIZERS[kind](table, fit.ColumnRoles(("x", "z", "y"), ("v",), (), tuple(table.columns)))
    assert len(packed.pack(model.cells, model.order)) == 4
    want = sorted(map(repr, model.sample(500, seed=3).collect()))
    assert len(want) == 500
    for room in (0, 8):     # no column, and only the first ones
        monkeypatch.setattr(packed, "PACKED_CELLS", room)
        model.__dict__.pop("_packed", None)
        assert len(packed.pack(model.cells, model.order)) < 4
        assert sorted(map(repr, model.sample(500, seed=3).collect())) == want


def test_a_packed_draw_takes_the_interval_that_holds_its_place():
    rng = np.random.default_rng(1)
    first, size = np.array([0, 5, 5, 6]), np.array([5, 0, 1, 40])
    starts = np.concatenate([[0.0, *np.sort(rng.random(n - 1))] for n in size if n])
    column = packed.PackedColumn(0, 1, None, first, size, starts, np.arange(len(starts)))
    u, given = rng.random(3000), rng.choice([0, 2, 3], 3000)
    want = [first[p] + np.searchsorted(starts[first[p]:first[p] + size[p]], x, side="right") - 1 for x, p in zip(u, given)]
    assert (column.draw(u, given) == want).all()
    assert len(column.draw(u[:0], given[:0])) == 0
    with pytest.raises(ValueError, match="no tokens"):
        column.draw(u[:1], np.array([1]))


def test_score_correlations_of_arrays_and_joins_agree(labels, monkeypatch):
    names = ["x", "z"]
    tokens = labels.select(F.coalesce("x", F.lit("-")).alias("x"), "z")
    scores = fit.token_counts(tokens, names).select("target", "token", (F.xxhash64("token") % 97).cast("double").alias("score"))
    slots = {"x": 16, "z": 16}
    one = fit.score_correlations(tokens, names, scores, slots).first()
    for room in (0, 16):
        monkeypatch.setattr(fit, "PACKED_CELLS", room)
        assert fit.score_correlations(tokens, names, scores, slots).first()["r"] == pytest.approx(one["r"], abs=1e-12)


def test_pages_far_down_are_found_by_numbering(spark, monkeypatch):
    table = spark.createDataFrame([(f"r{i}", i // 4) for i in range(60)] + [("none", None)], "run_id string, created_at int") \
        .withColumns({"status": F.lit("completed"), "verdict": F.lit("PASS"), "dataset_name": F.lit("d")})
    near = [[tuple(r) for r in runs.run_page(table, page, 10).collect()] for page in range(1, 9)]
    monkeypatch.setattr(ordered, "PAGE_ROWS", 0)
    far = [[tuple(r) for r in runs.run_page(table, page, 10).collect()] for page in range(1, 9)]
    assert near == far and [len(p) for p in near] == [10] * 6 + [1, 0]


def test_budgets_of_a_run_with_most_releases(spark):
    rows = [("hot", i, 0.25) for i in range(500)] + [("small", i, 0.5) for i in range(3)] + [("none", 0, None), ("none", 1, 1.0), (None, 0, 2.0)]
    got = ledger.budget_ledger(spark.createDataFrame(rows, "run_id string, step int, rho double").withColumn("delta", F.lit(1e-6)))
    spent = {(r["run_id"], r["step"]): r["rho_spent"] for r in got.collect()}
    assert len(spent) == len(rows) and spent[None, 0] == 2.0
    assert all(spent["hot", i] == 0.25 * (i + 1) for i in range(500)) and all(spent["small", i] == 0.5 * (i + 1) for i in range(3))
    assert spent["none", 0] is None and spent["none", 1] == 1.0


def test_distinct_shares_are_exact_near_the_threshold(spark, monkeypatch):
    table = spark.range(2000).select(*[F.concat(F.lit("v"), F.col("id") % n).alias(f"c{n}") for n in (1799, 1800, 1801, 2000, 10)])
    assert clean.high_cardinality_columns(table) == ["c1801", "c2000"]
    assert clean.high_cardinality_columns(table.limit(0)) == []


def test_a_failing_batch_keeps_its_rows(spark, tmp_path):
    registry = ProcessRegistry(spark, str(tmp_path / "registry"))
    with pytest.raises(RuntimeError, match="stopped"), registry.batch():
        registry.start("p", "data.csv", "run.yaml")
        with registry.batch():
            registry.add_log("p", "last words")
        registry.finish("p", "ERROR")
        raise RuntimeError("stopped")
    assert registry.table("process_logs").first()["log_content"] == "last words"
    assert registry.table("process_events").count() == 3
    registry.start("q", "data.csv", "run.yaml")     # rows are written at once again
    assert registry.table("process_events").count() == 4


def test_listings_come_in_pages(spark, labels, tmp_path):
    for i in range(5):
        (tmp_path / f"d{i}.csv").write_text("x,y\n" + "1,2\n" * i)
        os.utime(tmp_path / f"d{i}.csv", (1_700_000_000 + i // 2, 1_700_000_000 + i // 2))
    (tmp_path / "d_synth_1.csv").write_text("x\n1\n")
    pages = [catalog.dataset_page(spark, f"{tmp_path}/*.csv", page, 2).collect() for page in (1, 2, 3, 4)]
    assert [[(r["name"], r["rows"]) for r in p] for p in pages] == [[("d4", 4), ("d2", 2)], [("d3", 3), ("d0", 0)], [("d1", 1)], []]
    assert {(r["total"], r["pages"], r["per_page"]) for p in pages for r in p} == {(5, 3, 2)}
    model = fit.fit_marginal(labels.select("x", "z"))
    for i in range(3):
        model.save(f"{tmp_path}/models/m{i}", created_at=f"2024-05-0{3 - i}T10:00:00+00:00")
    assert [r["model_id"] for r in catalog.model_page(spark, f"{tmp_path}/models", 2, 2).collect()] == ["m2"]
    with pytest.raises(ValueError, match="start at 1"):
        catalog.model_page(spark, f"{tmp_path}/models", 0)
