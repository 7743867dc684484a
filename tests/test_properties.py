"""Operators against NumPy and plain loops on drawn data."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from strayframe.functions import text
from strayframe.operators import concepts, conformal, density, evaluation, kinematics, knn, snapshot


def frames(spark, n, d, runs, seed):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(size=(n, d)), 2)
    rows = [(int(k % runs), int(k // runs), k, [float(x) for x in r]) for k, r in enumerate(v)]
    return v, spark.createDataFrame(rows, "run int, tick int, id long, v array<double>")


@pytest.mark.parametrize("way", [{}, {"pool_bytes": 0, "block_rows": 17}])
@pytest.mark.parametrize("apart", [None, ("run", "r_run")])
@pytest.mark.parametrize("kind", knn.KINDS)
@pytest.mark.parametrize("by", [None, "r_run"])
def test_nearest_rows_against_all_pairs(spark, monkeypatch, way, apart, kind, by):
    monkeypatch.setattr(knn, "TILE", 7)
    v, _ = frames(spark, 60, 5, 4, 1)
    v[40:50] = v[20:30]  # ties
    v = np.abs(v) + 0.01 if kind == "kl" else v
    v = v / np.linalg.norm(v, axis=1, keepdims=True) if kind == "cosine" else v
    f = spark.createDataFrame([(k % 4, k // 4, k, [float(x) for x in r]) for k, r in enumerate(v)], "run int, tick int, id long, v array<double>")
    q, r = v[:, None], v[None]
    d = 1 - (q * r).sum(axis=2) if kind == "cosine" else (q * np.log(q / r)).sum(axis=2) if kind == "kl" else np.sqrt(((q - r) ** 2).sum(axis=2))
    found = knn.nearest(f, knn.pool_of(f, [0, 1, 2]), 3, kind, apart=apart, by=by, **way)
    got = {}
    for x in found.collect():
        got.setdefault((x.id, x.r_run if by else None), []).append((x.n, x.r_id, x.d))
    for k in range(60):
        for run in (0, 1, 2) if by else (None,):
            pool = [j for j in range(60) if j % 4 != 3 and (run is None or j % 4 == run) and not (apart and j % 4 == k % 4)]
            want = sorted((round(d[k, j], 9), j) for j in pool)[:3]
            own = sorted(got.get((k, run), []))
            assert [j for _, j, _ in own] == [j for _, j in want]
            assert [x for _, _, x in own] == pytest.approx([x for x, _ in want], abs=1e-8)


def test_rows_without_a_direction_have_no_neighbours(spark):
    rows = [(0, 0, 0, [0.0, 0.0]), (0, 1, 1, [1.0, 0.0]), (1, 0, 2, [0.0, 2.0]), (1, 1, 3, None)]
    f = knn.unit_frames(spark.createDataFrame(rows, "run int, tick int, id long, v array<double>"))
    for way in ({}, {"pool_bytes": 0, "block_rows": 2}):
        found = knn.nearest(f, knn.pool_of(f, [0, 1]), 2, "cosine", **way).collect()
        assert sorted((r.id, r.r_id, r.n, r.d) for r in found) == [(1, 1, 1, 0.0), (1, 2, 2, 1.0), (2, 1, 2, 1.0), (2, 2, 1, 0.0)]
        assert knn.nearest(f.limit(0), knn.pool_of(f, [0, 1]), 2, "cosine", **way).collect() == []
        assert knn.nearest(f, knn.pool_of(f, []), 2, "cosine", **way).collect() == []


def shuffled_rows(spark, run):
    """Rows that Spark's stages shuffle while ``run`` runs."""
    def total():
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
        return sum(x.shuffleWriteRecords() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages))

    before = total()
    run()
    return total() - before


def test_a_large_pool_is_shuffled_in_proportion(spark):
    """Four times the rows on both sides are four times the shuffled rows, and not sixteen times."""
    many = []
    for n in (400, 1600):
        _, f = frames(spark, n, 5, 4, 1)
        found = knn.nearest(f, knn.pool_of(f, [0, 1, 2]), 3, "euclidean", by="r_run", pool_bytes=0, block_rows=10)
        many.append(shuffled_rows(spark, lambda found=found: found.write.format("noop").mode("overwrite").save()))
    assert 0 < many[1] <= 5 * many[0]


@pytest.mark.parametrize("way", [{}, {"pool_bytes": 0, "block_rows": 17}])
def test_lists_are_the_rows_in_order(spark, way):
    _, f = frames(spark, 80, 5, 3, 2)
    pool, how = knn.pool_of(f, [0, 1, 2]), {"apart": ("run", "r_run"), "by": "r_run", **way}
    want = {}
    for x in knn.nearest(f, pool, 4, "euclidean", **how).orderBy("n").collect():
        want.setdefault((x.id, x.r_run), []).append((x.d, x.r_id))
    got = {(x.id, x.r_run): [tuple(y) for y in x.near] for x in knn.nearest(f, pool, 4, "euclidean", listed=True, **how).collect()}
    assert got == want


def scored(spark, seed, n=300, ties=True):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), rng.randrange(5), k, float(rng.randrange(12)) if ties else rng.random()) for k in range(n)]
    return rows, spark.createDataFrame(rows, "series string, run int, tick int, score double")


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("ties", [True, False])
def test_order_statistics(spark, seed, ties):
    rows, df = scored(spark, seed, ties=ties)
    for q in (0.05, 0.5, 0.95, 1.0):
        own = {r.series: r.q_run for r in conformal.order_stat(df, ["series"], q).collect()}
        higher = {r.series: r.q_run for r in conformal.quantile_higher(df, ["series"], q).collect()}
        linear = {r.series: r.q_run for r in conformal.quantile_linear(df, ["series"], q).collect()}
        for s in "ab":
            x = sorted(r[3] for r in rows if r[0] == s)
            assert own[s] == x[min(max(math.ceil(q * len(x)), 1), len(x)) - 1]
            assert higher[s] == np.quantile(x, q, method="higher")
            assert linear[s] == pytest.approx(np.quantile(x, q))


@pytest.mark.parametrize("ties", [True, False])
def test_threshold_without_the_row_itself(spark, ties):
    rows, df = scored(spark, 3, 40, ties=ties)
    got = {r.tick: r.tau_loo for r in conformal.loo_conformal(df, ["series"], 0.9).collect()}
    for s, _, tick, _ in rows:
        rest = sorted(r[3] for r in rows if r[0] == s and r[2] != tick)
        assert got[tick] == rest[min(math.ceil(0.9 * (len(rest) + 1)), len(rest)) - 1]


def test_larger_alpha_never_raises_tau(spark):
    _, df = scored(spark, 4, ties=False)
    taus = [{r.series: r.tau for r in conformal.conformal_tau(df, ["series"], a).collect()} for a in (0.01, 0.05, 0.1, 0.3)]
    assert all(a[s] >= b[s] for a, b in zip(taus, taus[1:], strict=False) for s in "ab")


def test_auroc_is_the_area_of_the_roc(spark):
    rng = random.Random(5)
    rows = [(float(rng.randrange(30)), rng.random() < 0.3) for _ in range(400)]
    df = spark.createDataFrame(rows, "score double, positive boolean")
    pos, neg = [s for s, p in rows if p], [s for s, p in rows if not p]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert evaluation.auroc(df, []).first().auroc == pytest.approx(want)
    taus = spark.createDataFrame([(k - 0.5,) for k in range(31)], "tau double")
    assert evaluation.area(evaluation.roc(df, taus)).first().area == pytest.approx(want)


def test_a_copy_of_a_frame_does_not_change_its_score(spark):
    v, f = frames(spark, 40, 3, 1, 6)
    before = {r.id: r.score for r in snapshot.entry_scores(f, 3, plain=True).collect()}
    copy = spark.createDataFrame([(0, 40, 40, [float(x) for x in v[7]])], f.schema)
    after = {r.id: r.score for r in snapshot.entry_scores(f.union(copy), 3, plain=True).collect()}
    assert all(after[k] == pytest.approx(before[k]) for k in range(40) if k != 7 and k < 40)
    assert after[7] == after[40]


@pytest.mark.parametrize(("led", "width", "tolerance"), [(4000, 2, 0.045), (7, 2, 0.045), (1, 3, 0.3), (16, 64, 0.97), (5, 2, 9.0)])
def test_entries_within_a_tolerance(spark, led, width, tolerance):
    """All in one task, in rounds of a few, over whole vectors, and a pool that is one entry."""
    rng = random.Random(led)
    rows = [(0, k, (k * 37) % 200, [round(rng.random() * 3, 2), *(round(rng.random() * (1 if width > 2 else 0.2), 2) for _ in range(width - 1))]) for k in range(200)]
    got = {r.id: (r.entry, r.copies) for r in snapshot.distinct_entries(spark.createDataFrame(rows, "run int, tick int, id long, v array<double>"), tolerance, led).collect()}
    leaders, own = [], {}
    for _, _, i, v in sorted(rows, key=lambda r: r[2]):
        lead = next((j for j, w in leaders if max(abs(a - b) for a, b in zip(v, w, strict=True)) <= tolerance), None)
        if lead is None:
            leaders.append((i, v))
        own[i] = i if lead is None else lead
    assert got == {i: (e, list(own.values()).count(e)) for i, e in own.items()}
    assert snapshot.distinct_entries(spark.createDataFrame([], "id long, v array<double>"), tolerance, led).collect() == []


def test_labels_are_cleaned_as_one_by_one(spark):
    rng = random.Random(12)
    parts = ["Hay_Bale", " ", "  ", "x", "ÄÖ", "-", "9", "\x01", "\t", ".", "a b", "one two three", "_", "\n"]
    lists = [None, [], [None, "a"], ["a b c d e", "a b c d e f", "a  b  c  d  e"], ["ok", "OK", "o\x01k"]]
    lists += [["".join(rng.choice(parts) for _ in range(rng.randrange(0, 7))) for _ in range(rng.randrange(0, 30))] for _ in range(300)]

    def clean(items):
        out = []
        for x in items or []:
            tidy = re.sub(r"[^a-z0-9 \-]", "", (x or "").lower().replace("_", " ")).strip(" ")
            if tidy and len(tidy.split()) <= 5 and tidy not in out:
                out.append(tidy)
        return out[:20]

    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, l array<string>")
    got = {r.i: list(r.c or []) for r in df.select("i", text.clean_labels(F.col("l")).alias("c")).collect()}
    assert got == {i: clean(x) for i, x in enumerate(lists)}


def test_greedy_boxes(spark):
    rng = random.Random(8)
    rows = [(k % 6, rng.choice("abcdef"), round(rng.random(), 3), x := float(rng.randrange(20)), y := float(rng.randrange(20)), x + 5 + rng.randrange(9), y + 5 + rng.randrange(9)) for k in range(120)]
    got = sorted(map(tuple, concepts.greedy_boxes(spark.createDataFrame(rows, "frame int, concept string, score double, x0 double, y0 double, x1 double, y1 double"), 0.3, 4).collect()))
    want = []
    for frame in range(6):
        kept = []
        for r in sorted((r for r in rows if r[0] == frame), key=lambda r: (-r[2], r[3], r[4], r[1])):
            if len(kept) < 4 and all(r[1] != k[1] and _iou(r[3:], k[3:]) <= 0.3 for k in kept):
                kept.append(r)
        want += kept
    assert got == sorted(want)


def _iou(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def test_role_history(spark):
    """The present agent of each role at the last ticks, relative to the ego of that tick, in the present ego's direction;
    zeros where it was not there."""
    n, h = 14, 10
    ego = [(k, 0.9 * k, 0.02 * k, 0.01 * k, 9.0, 0.1 * k) for k in range(n)]
    other = {1: [(k, 0.9 * k + 15, 0.3, 0.0, 8.0, 0.0) for k in range(n) if k != 7], 2: [(k, 0.9 * k + 4, -3.5, 0.05, 9.5, 0.0) for k in range(6, n)]}
    cols = "x double, y double, yaw double, vx double, vy double"
    s = spark.createDataFrame([("a", *e) for e in ego], f"run string, tick int, {cols}")
    a = spark.createDataFrame([("a", o[0], i, *o[1:]) for i, rows in other.items() for o in rows], f"run string, tick int, agent int, {cols}")
    got = {r.tick: r.v for r in kinematics.role_history(s, a, history=h).collect()}
    assert sorted(got) == list(range(h - 1, n)) and {len(v) for v in got.values()} == {436}
    wrap = lambda x: math.atan2(math.sin(x), math.cos(x))
    for tick, v in got.items():
        _, ex, ey, eyaw, _, _ = ego[tick]
        turn = lambda dx, dy: (dx * math.cos(eyaw) + dy * math.sin(eyaw), -dx * math.sin(eyaw) + dy * math.cos(eyaw))  # noqa: B023, E731
        want = []
        for k in range(tick - h + 1, tick + 1):
            _, x, y, yaw, vx, vy = ego[k]
            want += [*turn(x - ex, y - ey), wrap(yaw - eyaw), vx * math.cos(yaw) + vy * math.sin(yaw)]
        assert v[36:76] == pytest.approx(want, abs=1e-9)
        blocks = {"lead": (0, 1), "left": (2, 2)}
        for role, (place, agent) in blocks.items():
            known = {o[0]: o for o in other[agent]}
            want = []
            for k in range(tick - h + 1, tick + 1):
                if k in known and tick in known:
                    _, x, y, yaw, vx, vy = known[k]
                    _, px, py, pyaw, pvx, pvy = ego[k]
                    want += [1.0, *turn(x - px, y - py), wrap(yaw - pyaw), *turn(vx - pvx, vy - pvy)]
                else:
                    want += [0.0] * 6
            if tick in known:
                assert v[76 + 60 * place : 136 + 60 * place] == pytest.approx(want, abs=1e-9), (tick, role)


@pytest.mark.parametrize("most", [20_000, 0])
def test_nearest_segments_near_and_far(spark, monkeypatch, most):
    """By broadcast, and in rounds of cells for a map that is too large for it."""
    monkeypatch.setattr(kinematics, "EDGES", most)
    rng = random.Random(13)
    edges = [(k, x := rng.uniform(-60, 60), y := rng.uniform(-60, 60), x + rng.uniform(-30, 30), y + rng.uniform(-2, 2)) for k in range(40)] + [(40, 1.0, 1.0, 1.0, 1.0)]
    points = [(k, rng.uniform(-90, 90), rng.uniform(-90, 90)) for k in range(150)] + [(150, 5000.0, 0.0), (151, -4000.0, 7000.0), (152, 1.0, 1.0)]

    def distance(x, y, ax, ay, bx, by):
        size = (bx - ax) ** 2 + (by - ay) ** 2
        t = min(max(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / size, 0.0), 1.0) if size else 0.0
        return math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))

    got = kinematics.nearest_segment(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(edges, "segment int, ax double, ay double, bx double, by double"), "id").collect()
    want = {i: min((distance(x, y, *e[1:]), e[0]) for e in edges) for i, x, y in points}
    assert len(got) == len(points)
    for r in got:
        assert r.d == pytest.approx(want[r.id][0], abs=1e-9) and r.segment == want[r.id][1]


def test_polygons_of_all_sizes(spark):
    rng = random.Random(14)
    rings = [[(cx + size * math.cos(a), cy + size * math.sin(a)) for a in sorted(rng.uniform(0, 2 * math.pi) for _ in range(7))] for size in (0.5, 3.0, 40.0, 900.0) for cx, cy in [(rng.uniform(-30, 30), rng.uniform(-30, 30)) for _ in range(4)]]
    edges = [(k, *a, *b) for k, ring in enumerate(rings) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]
    points = [(k, rng.uniform(-40, 40), rng.uniform(-40, 40)) for k in range(300)]
    inside = lambda x, y, ring: sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True)) % 2
    got = kinematics.inside(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(edges, "polygon int, ax double, ay double, bx double, by double"), "id")
    assert {(r.id, r.polygon) for r in got.collect()} == {(i, k) for i, x, y in points for k, ring in enumerate(rings) if inside(x, y, ring)}


def test_moments_by_run_are_added_up(spark):
    v, df = frames(spark, 500, 5, 7, 15)
    found, origin = density.moments_by_run(df.repartition(9))
    for run, m in found.items():
        own = v[np.arange(500) % 7 == run]
        assert m.n == len(own) and np.allclose(origin + m.mean(), own.mean(axis=0)) and np.allclose(m.covariance(True), np.cov(own.T))
