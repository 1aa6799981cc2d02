"""Nearest records against brute force, on both search paths."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilframe.operators import distances, neighbours


def world(n, seed, copies=0):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({
        "id": np.arange(n),
        "x": rng.normal(size=n).round(2),
        "y": rng.integers(0, 40, n).astype(float),
        "flag": rng.random(n) < 0.3,
        "city": rng.choice(["a", "b", "c", None, "d"], n, p=[.4, .3, .2, .05, .05]),
    })
    if copies:  # one record holds a third of the table
        hot = frame.iloc[[0] * copies].assign(id=np.arange(n, n + copies))
        frame = pd.concat([frame, hot], ignore_index=True)
    return frame


def dense(reference, query):
    """One-hot matrices in the plain form."""
    num = ["x", "y"]
    low, span = reference[num].min(), (reference[num].max() - reference[num].min()).replace(0, 1)
    cities = sorted(reference["city"].dropna().unique())

    def to_matrix(d):
        parts = [((d[num] - low) / span).to_numpy(), d[["flag"]].to_numpy(float)]
        parts += [(d["city"] == c).to_numpy(float)[:, None] for c in cities]
        return np.hstack(parts)

    a, b = to_matrix(query), to_matrix(reference)
    dist = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    dist.sort(axis=1)
    return dist[:, 0], dist[:, 1]


SCHEMA = "id long, x double, y double, flag boolean, city string"


def frames(spark):
    reference = world(900, 1, copies=450)
    query = world(300, 2, copies=150)
    query.loc[::11, "city"] = "unseen"
    to_spark = lambda d: spark.createDataFrame(d.astype({"city": object}).where(d.notna(), None), SCHEMA)
    return reference, query, to_spark(reference), to_spark(query)


@pytest.mark.parametrize("pruned", [False, True])
def test_two_nearest_match_brute_force(spark, monkeypatch, pruned):
    if pruned:
        for name, value in [("BROADCAST_VALUES", 10), ("CELL_ROWS", 6), ("FAN", 5), ("NODE_SAMPLE", 60), ("CHUNK_ROWS", 30)]:
            monkeypatch.setattr(neighbours, name, value)
    reference, query, ref_df, query_df = frames(spark)
    got = distances.dcr(query_df, ref_df, ["id"]).toPandas().sort_values("id")
    d1, d2 = dense(reference, query)
    assert len(got) == len(query)
    np.testing.assert_allclose(got["dcr"], d1, atol=1e-9)
    np.testing.assert_allclose(got["d2"], d2, atol=1e-9)


def test_partitioning_does_not_matter(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BROADCAST_VALUES", 10)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 60)
    _, _, ref_df, query_df = frames(spark)
    one = distances.dcr(query_df, ref_df, ["id"]).toPandas().sort_values("id")
    two = distances.dcr(query_df.repartition(7), ref_df.repartition(5, "x"), ["id"]).toPandas().sort_values("id")
    np.testing.assert_allclose(one["dcr"], two["dcr"], atol=1e-12)


def test_tiny_cases(spark):
    ref = spark.createDataFrame([(0.0,), (10.0,)], "v double")
    qry = spark.createDataFrame([(1, 0.0), (2, 5.0)], "id int, v double")
    got = {r["id"]: (r["dcr"], r["d2"]) for r in distances.dcr(qry, ref, ["id"]).collect()}
    assert got == {1: (0.0, 1.0), 2: (0.5, 0.5)}
    near = {r["id"]: r["r"] for r in distances.dcr(qry, ref, ["id"]).withColumn("d1", F.col("dcr"))
            .select("id", distances.nndr_ratio().alias("r")).collect()}
    assert near == {1: 0.0, 2: 1.0}


def test_category_costs(spark):
    ref = spark.createDataFrame([("a",), ("b",)], "c string")
    qry = spark.createDataFrame([(1, "a"), (2, "zz"), (3, None)], "id int, c string")
    got = {r["id"]: r for r in distances.dcr(qry, ref, ["id"]).collect()}
    assert got[1]["dcr"] == 0 and got[1]["d2"] == pytest.approx(2 ** 0.5)
    assert got[2]["dcr"] == 1 and got[3]["dcr"] == 1


def test_a_table_against_itself_is_at_distance_zero(spark):
    _, _, ref_df, _ = frames(spark)
    frame = distances.distance_frame(ref_df, ref_df, ref_df, columns=["x", "y", "flag", "city"])
    row = distances.dcr_summary(frame).first()
    assert row["synth_median"] == 0 and row["holdout_mean"] == 0 and row["privacy_preserved"]


def test_rank_auc(spark):
    rows = [(0.1, 3, 0), (0.2, 1, 1), (0.5, 0, 2), (0.7, 1, 2)]
    features = spark.createDataFrame(rows, "distance double, members long, non_members long")
    members = [d for d, m, _ in rows for _ in range(m)]
    others = [d for d, _, n in rows for _ in range(n)]
    want = np.mean([(1.0 if a < b else 0.5 if a == b else 0.0) for a in members for b in others])
    assert distances.mia_rank_auc(features).first()["attack_auc"] == pytest.approx(want, abs=1e-6)


def test_a_tree_of_several_levels_keeps_its_leaves_small(spark, monkeypatch):
    for name, value in [("CELL_ROWS", 6), ("FAN", 4), ("NODE_SAMPLE", 50)]:
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(3)
    rows = [([float(x), float(x > 0)], [int(c)], 1) for x, c in zip(rng.normal(size=600) ** 3, rng.integers(-1, 90, 600))]
    ref = spark.createDataFrame(rows, "num array<double>, cat array<long>, copies long")
    tree = neighbours._Tree(ref, 2, 1)
    sizes = [r["n"] for r in tree.leaves.groupBy("node").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 600 and max(sizes) <= 6 and len(tree.children) >= 3
    for level in tree.children:
        assert max(r["count"] for r in level.groupBy("node").count().collect()) <= 4


def test_bounds_of_boxes_hold(spark):
    rng = np.random.default_rng(4)
    num, cat = rng.normal(size=(200, 2)), rng.integers(-1, 100, (200, 2))
    index = neighbours.Index(num, cat, np.ones(200, np.int64), 10)
    q_num, q_cat = rng.normal(size=(40, 2)), rng.integers(-1, 100, (40, 2))
    least, most = index.boxes.bounds(q_num, q_cat)
    for k, (a, b) in enumerate(zip(index.starts, index.ends)):
        gap = ((q_num[:, None] - index.num[None, a:b]) ** 2).sum(2)
        x, y = q_cat[:, None], index.cat[None, a:b]
        gap = gap + ((x != y) * ((x >= 0) * 1.0 + (y >= 0))).sum(2)
        assert (least[:, k] <= gap.min(1) + 1e-9).all() and (most[:, k] >= gap.max(1) - 1e-9).all()


@pytest.mark.parametrize("indexed", [1, 10_000])
def test_leaves_are_compared_whole_or_as_an_index(spark, monkeypatch, indexed):
    for name, value in [("BROADCAST_VALUES", 10), ("CELL_ROWS", 200), ("LOCAL_CELL_ROWS", 5), ("INDEXED_QUERIES", indexed)]:
        monkeypatch.setattr(neighbours, name, value)
    reference, query, ref_df, query_df = frames(spark)
    got = distances.dcr(query_df, ref_df, ["id"]).toPandas().sort_values("id")
    d1, d2 = dense(reference, query)
    np.testing.assert_allclose(got["dcr"], d1, atol=1e-9)
    np.testing.assert_allclose(got["d2"], d2, atol=1e-9)


def test_boxes_are_looked_through_by_runs():
    """The same boxes as by trying all of them, at a small part of the bounds."""
    rng = np.random.default_rng(6)
    num, cat = rng.random((40_000, 2)), rng.integers(0, 4, (40_000, 2))
    boxes = neighbours.Index(num, cat, np.ones(40_000, np.int64), 40).boxes
    q_num, q_cat = rng.random((500, 2)), rng.integers(-1, 6, (500, 2))
    least, most = boxes.bounds(q_num, q_cat)
    tried = 0
    bounds = neighbours.Boxes.bounds

    def counted(self, n, c):
        nonlocal tried
        tried += len(n) * len(self.total)
        return bounds(self, n, c)

    neighbours.Boxes.bounds = counted
    try:
        best = boxes.fitting(q_num, q_cat)
        limit = np.full(500, 0.0005)
        found = {(a, b) for q, box, _ in boxes.below(q_num, q_cat, limit) for a, b in zip(q.tolist(), box.tolist())}
    finally:
        neighbours.Boxes.bounds = bounds
    score = least + 1e-6 * most
    np.testing.assert_allclose(score[np.arange(500), best], score.min(axis=1))
    assert found == set(zip(*(x.tolist() for x in np.nonzero(least < limit[:, None]))))
    assert tried < 0.5 * 2 * least.size


def test_rows_find_their_vector_whatever_the_sign_of_zero(spark):
    ref = spark.createDataFrame([(0.0, "a"), (10.0, "b")], "v double, c string")
    qry = spark.createDataFrame([(1, -0.0, "a"), (2, 0.0, "a"), (3, 0.0, None)], "id int, v double, c string")
    got = {r["id"]: r["dcr"] for r in distances.dcr(qry, ref, ["id"]).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 1.0}


def test_small_batches_are_compared_together():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(range(k * 10, k * 10 + 10))], names=["x"]) for k in range(5)]
    tables = list(neighbours._together(iter(batches), 25))
    assert [t.num_rows for t in tables] == [30, 20]
    assert [x for t in tables for x in t["x"].to_pylist()] == list(range(50))
    assert list(neighbours._together(iter([]), 25)) == []
