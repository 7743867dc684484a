"""The stored pair table, draws and the curve against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from strayframe.operators import conformal, sweeps

KEYS = ["source", "run", "id", "test"]


def test_draws_are_seeded_and_balanced():
    strata = {"a": [1, 3, 5, 7], "b": [2, 4, 6, 8]}
    drawn = sweeps.stratified_draws(strata, [2, 3, 8, 99], 4, seed=5)
    assert drawn == sweeps.stratified_draws(strata, [2, 3, 8, 99], 4, seed=5) != sweeps.stratified_draws(strata, [2, 3, 8, 99], 4, seed=6)
    by = {}
    for size, draw, run in drawn:
        by.setdefault((size, draw), []).append(run)
    assert set(by) == {(2, d) for d in range(4)} | {(3, d) for d in range(4)} | {(8, 0), (99, 0)}
    for (size, _), runs in by.items():
        assert len(set(runs)) == len(runs) == min(size, 8)
        odd = sum(r % 2 for r in runs)
        assert odd == min(size, 8) // 2


def x_of(r):
    return [x.r_id for x in r.near]


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 4))
    v[40] = v[3]  # equal points in two runs
    v[50] = v[51]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [("gt", i % 9, i, i % 9 >= 6, v[i].tolist()) for i in range(90)]
    query = spark.createDataFrame(rows, "source string, run int, id bigint, test boolean, v array<double>")
    pool = query.where("run < 6").select(F.col("id").alias("r_id"), F.col("run").alias("r_run"), F.col("v").alias("r"))
    return query, pool, v


def wanted(v, draws, k, point=lambda key, i: True):
    out = {}
    for key, runs in draws.items():
        for i in range(90):
            if i % 9 < 6 and i % 9 not in runs:
                continue
            near = sorted((round(1 - float(v[i] @ v[j]), 9), j) for j in range(90) if j % 9 in runs and j % 9 != i % 9 and point(key, j))
            if near:
                out[(*key, i)] = [j for _, j in near[:k]]
    return out


@pytest.mark.parametrize("listed", [1, 2, 20])
def test_subsets_of_runs_and_points_are_exact(spark, sides, monkeypatch, listed):
    """With short lists the bounds fail and rows are searched again; results stay the same."""
    query, pool, v = sides
    calls = []
    lists = sweeps.PairTable.lists
    monkeypatch.setattr(sweeps.PairTable, "lists", staticmethod(lambda *a, **b: calls.append(1) or lists(*a, **b)))
    table = sweeps.PairTable.store(query, pool, KEYS, listed, buckets=3)
    draws = {(2, 0): [0, 4], (2, 1): [1, 2], (5, 0): [0, 1, 2, 3, 5], (1, 0): [3]}
    frame = spark.createDataFrame([(*key, r) for key, runs in draws.items() for r in runs], "size int, draw int, member int")
    got = {(r.size, r.draw, r.id): x_of(r) for r in sweeps.nearest_of_draws(table, query, pool, frame, 4).collect() if x_of(r)}
    assert got == wanted(v, draws, 4)
    assert (len(calls) > 1) == (listed < 4)
    odd = sweeps.nearest_of_draws(table, query, pool, frame, 4, lambda x: (x + F.col("draw")) % 3 != 0)
    assert {(r.size, r.draw, r.id): x_of(r) for r in odd.collect() if x_of(r)} == wanted(v, draws, 4, lambda key, j: (j + key[1]) % 3 != 0)
    again = sweeps.PairTable(table.path, KEYS, listed, 3)  # opened by its path
    assert {r.r_run for r in again.read(spark, [2, 5]).collect()} == {2, 5}
    plan = again.read(spark, [2])._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:120]


def test_copies_of_a_point_need_no_second_search(spark, sides, monkeypatch):
    """A list of copies of one point ends at a tie, which ids decide."""
    query, pool, v = sides
    copied = pool.withColumn("r_id", F.explode(F.sequence(F.col("r_id"), F.col("r_id") + 2000, F.lit(100))))
    calls = []
    lists = sweeps.PairTable.lists
    monkeypatch.setattr(sweeps.PairTable, "lists", staticmethod(lambda *a, **b: calls.append(1) or lists(*a, **b)))
    table = sweeps.PairTable.store(query, copied, KEYS, 10, buckets=3)
    frame = spark.createDataFrame([(0, r) for r in range(6)], "draw int, member int")
    for r in sweeps.nearest_of_draws(table, query, copied, frame, 10).collect():
        first = min((j for j in range(90) if j % 9 < 6 and j % 9 != r.run), key=lambda j: (round(1 - float(v[r.id] @ v[j]), 9), j))
        if first not in (3, 40, 50, 51):  # those have equals in other runs
            assert x_of(r) == [first + 100 * c for c in range(10)]
    assert len(calls) == 1


@pytest.mark.parametrize(("listed", "way"), [(1, {}), (None, {"pool_bytes": 0, "block_rows": 60})])
def test_shares_of_points_are_exact(spark, sides, monkeypatch, listed, way):
    """From one list a row: as long as it takes at first where its length isn't given, and searched again where it is short."""
    query, pool, v = sides
    places = {(x.draw, x.r_id): x.place for x in pool.select("r_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("draw")).withColumn("place", sweeps.sample_place(F.col("draw"), F.col("r_id"))).collect()}
    rows = [(s, d, sorted(p for (x, _), p in places.items() if x == d)[round(60 * s) - 1]) for s, d in ((0.3, 0), (0.6, 0), (1.0, 0), (0.3, 1), (0.6, 1))]
    thresholds = spark.createDataFrame(rows, "share double, draw int, threshold bigint")
    held = {(s, d): {i for (x, i), p in places.items() if x == d and p <= t} for s, d, t in rows}
    calls, nearest = [], sweeps.knn.nearest
    monkeypatch.setattr(sweeps.knn, "nearest", lambda *a, **b: calls.append(b["by"]) or nearest(*a, **b))
    got = {(r.share, r.draw, r.id): x_of(r) for r in sweeps.nearest_of_shares(query, pool, KEYS, thresholds, 4, listed=listed, **way).collect() if x_of(r)}
    assert got == wanted(v, {key: range(6) for key in held}, 4, lambda key, j: j in held[key])
    assert "r_run" not in calls and (len(calls) > 1 if listed == 1 else len(calls) <= 2)


def test_nested_quantiles_are_numpy_s(spark):
    rng = np.random.default_rng(1)
    groups = {g: rng.choice(rng.normal(size=n), size=n).round(3) for g, n in (("a", 1), ("b", 2), ("c", 57), ("d", 200), ("e", 201))}
    rows = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs], "g string, score double")
    got = {(r.g, r.p): r.q for r in conformal.quantiles_higher(rows, ["g"], 200).collect()}
    assert got == {(g, i * 0.5): float(np.percentile(xs, i * 0.5, method="higher")) for g, xs in groups.items() for i in range(201)}


def test_shares_hold_as_many_points_as_asked(spark):
    points = spark.range(37).withColumnRenamed("id", "r_id")
    for r in sweeps.share_draws(points, [0.3, 0.5, 1.0], 3).collect():
        held = points.where(sweeps.sample_place(F.lit(r.draw), F.col("r_id")) <= r.threshold).count()
        assert held == round(r.share * 37)
