"""Small cases with values worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from strayframe.functions import geometry, text, vec
from strayframe.operators import conformal, density, evaluation, kinematics, knn

STATES = [(0, 0.0, 0.0, 0.0, 8.0, 0.0), (1, 0.8, 0.0, 0.0, 8.5, 0.0), (2, 1.7, 0.0, 0.01, 9.0, 0.09)]


def states(spark):
    return spark.createDataFrame([("a", *s) for s in STATES], "run string, tick int, x double, y double, yaw double, vx double, vy double")


def test_ego_kinematics(spark):
    r = kinematics.ego_kinematics(states(spark)).where("tick = 2").first()
    assert [round(x, 5) for x in (r.v_long, r.yaw_rate, r.a_long, r.a_lat, r.jerk)] == pytest.approx([9.00045, 0.1, 5.0045, 0.90005, 0.045], abs=2e-5)


def test_roles(spark):
    agents = [(1, 21.7, 0.2, 0.0, 6.0, 0.0), (2, 5.7, 3.5, 0.0, 9.0, 0.0), (3, 26.7, -3.0, 3.1, -8.0, 0.0), (4, 11.7, 10.0, -1.5, 0.0, -3.0), (5, 11.7, 8.0, 0.0, 9.0, 0.0)]
    a = spark.createDataFrame([("a", 2, *x) for x in agents], "run string, tick int, agent int, x double, y double, yaw double, vx double, vy double")
    rel = kinematics.relative(states(spark), a)
    got = {r.agent: r for r in kinematics.role_slots(rel).withColumn("ttc", geometry.time_to_collision(F.col("rel_x"), F.col("rel_vx"))).collect()}
    assert {k: r.role for k, r in got.items()} == {1: "lead", 2: "right", 3: "oncoming", 4: "crossing"}
    assert (got[1].rel_x, got[1].rel_y, got[1].rel_vx, got[1].ttc) == pytest.approx((20.001, -0.000007, -3.00075, 6.665334), abs=1e-5)
    assert (got[3].rel_x, got[3].rel_y) == pytest.approx((24.968751, -3.249846), abs=1e-5)


def test_role_ranges_and_order(spark):
    """Ranges 40, 25, 25, 25, 30, 25; lead and follower by distance along the lane, others by distance."""
    agents = [(1, 12.0, 1.9, 0.0), (2, 11.9, -1.9, 0.0), (3, -24.9, 0.0, 0.0), (4, -20.0, 1.9, 0.0), (5, 8.0, 3.0, 0.0), (6, 0.0, 5.4, 0.0), (7, 26.0, -3.0, 0.0), (8, 29.0, 3.0, 3.1), (9, 0.0, 26.0, 1.5)]
    far = [(1, 40.1, 0.0, 0.0), (2, -25.1, 0.0, 0.0), (3, 30.1, 0.0, 3.1), (4, 25.1, 0.0, 1.5)]
    kinds = "run string, tick int, agent int, x double, y double, yaw double, vx double, vy double"
    ego = spark.createDataFrame([("a", 2, 0.0, 0.0, 0.0, 0.0, 0.0)], "run string, tick int, x double, y double, yaw double, vx double, vy double")
    got = kinematics.role_slots(kinematics.relative(ego, spark.createDataFrame([("a", 2, *x, 0.0, 0.0) for x in agents], kinds)))
    assert {r.role: r.agent for r in got.collect()} == {"lead": 2, "follower": 4, "right": 6, "oncoming": 8}
    assert kinematics.role_slots(kinematics.relative(ego, spark.createDataFrame([("a", 2, *x, 0.0, 0.0) for x in far], kinds))).collect() == []


def test_entries_are_scaled_by_their_own_spread(spark):
    """Three equal frames and one other are two entries: the spread is that of 0 and 4, so 2."""
    from strayframe.operators import snapshot

    f = spark.createDataFrame([(0, k, k, [x]) for k, x in enumerate((0.0, 0.0, 0.0, 4.0))], "run int, tick int, id long, v array<double>")
    got = {r.id: r.score for r in snapshot.entry_scores(f, 1).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 0.0, 3: 2.0}


def pool(spark, rows):
    p = spark.createDataFrame([(0, i, i, list(map(float, v))) for i, v in enumerate(rows)], "run int, tick int, id long, v array<double>")
    return knn.pool_of(p, [0])


def query(spark, v):
    return spark.createDataFrame([(9, 0, 99, list(map(float, v)))], "run int, tick int, id long, v array<double>")


def test_neighbour_scores(spark):
    p, q = pool(spark, [(1, 0), (0, 1), (0.6, 0.8), (-1, 0)]), query(spark, (0.8, 0.6))
    for k, want in ((2, 0.12), (9, 0.61)):
        assert knn.mean_distance(knn.nearest(q, p, k, "cosine"), k).first().score == pytest.approx(want)
    p, q = pool(spark, [(0, 0), (2, 0), (0, 4), (2, 4)]), query(spark, (3, 4))
    of = knn.moments(p)
    assert knn.mean_distance(knn.nearest(knn.standardised(q, "v", of), knn.standardised(p, "r", of), 2, "euclidean"), 2).first().score == pytest.approx(1.618034, abs=1e-6)
    assert density.mahalanobis(q, p, 2).first().score == pytest.approx(1.401259, abs=1e-6)


def test_divergence(spark):
    p = pool(spark, [(0.5, 0.5), (0.9, 0.1)]).withColumn("r", vec.shares("r"))
    q = query(spark, (0.2, 0.8)).withColumn("v", vec.shares("v"))
    d = sorted(r.d for r in knn.nearest(q, p, 2, "kl").collect())
    assert d == pytest.approx([0.192744, 1.362729], abs=1e-5)
    assert q.crossJoin(knn.moments(p).select("mu")).select(vec.kl("v", "mu")).first()[0] == pytest.approx(0.534109, abs=1e-5)


def test_zero_vectors_have_no_direction(spark):
    assert query(spark, (0, 0)).select(vec.unit("v").alias("u")).first().u == [None, None]


@pytest.mark.parametrize(("n", "alpha", "rank", "over"), [(9, 0.1, 9, False), (8, 0.1, 8, True), (30, 0.1, 28, False), (20, 0.05, 20, False)])
def test_conformal_rank(spark, n, alpha, rank, over):
    rows = spark.createDataFrame([("s", float(k)) for k in range(1, n + 1)], "series string, score double")
    capped = conformal.conformal_tau(rows, ["series"], alpha, beyond="capped").first()
    assert (capped.tau, capped.n, capped.overflow) == (rank, n, over)
    assert conformal.conformal_tau(rows, ["series"], alpha).first().tau == (float("inf") if over else rank)


def test_order_statistics(spark):
    rows = spark.createDataFrame([(None, float(k)) for k in range(1, 21)], "series string, score double")
    assert conformal.order_stat(rows, ["series"], 0.95).first().q_run == 19
    assert conformal.quantile_higher(rows, ["series"], 0.95).first().q_run == 20


def test_auroc(spark):
    rows = spark.createDataFrame([(0.9, True), (0.5, True), (0.5, True), (0.5, False), (0.4, False), (0.1, False), (None, True)], "score double, positive boolean")
    assert evaluation.auroc(rows, []).first().auroc == pytest.approx(0.888889, abs=1e-6)
    assert evaluation.auroc(rows.where("positive"), []).first().auroc is None


def test_shrinkage(spark):
    _, cov, shrink = density.shrinkage(pool(spark, [(1, 0), (-1, 0), (0, 2), (0, -2)]))
    assert shrink == pytest.approx(0.944444, abs=1e-6)
    assert np.allclose(cov, np.diag([1.208333, 1.291667]), atol=1e-6)


def test_turns_and_windows(spark):
    yaw = [0, 0, 0.1, 0.2, 0.2, 0.2, 0.3, 0.3]
    s = spark.createDataFrame([("a", k, float(y)) for k, y in enumerate(yaw)], "run string, tick int, yaw double")
    assert sorted((r.start, r.stop) for r in kinematics.turns(s).collect()) == [(2, 3), (6, 6)]
    windows = spark.createDataFrame([("a", 0, 1, 3), ("a", 1, 2, 5)], "run string, window int, start int, stop int")
    ticks = spark.createDataFrame([("a", k) for k in range(6)], "run string, tick int")
    assert [r.window for r in evaluation.window_of(ticks, windows).orderBy("tick").collect()] == [-1, 0, 1, 1, 1, -1]


def test_texts(spark):
    one = spark.range(1)
    show = lambda c: one.select(c.alias("x")).first().x
    assert show(text.label_list(F.lit("Car, car ,picket_fence!, a b c d e f,, Traffic-Light"))) == ["car", "picket fence", "traffic-light"]
    assert show(text.described(F.array(*map(F.lit, ("tree beside the road", "car on the road", "car on the road"))))) == "a car on the road, a tree beside the road"
    assert show(text.described(F.array().cast("array<string>"))) == "nothing in particular"
    assert show(text.sentence(F.array(F.lit("empty sidewalk")))) == "I see an empty sidewalk."
    assert show(text.sentence(F.array(F.lit("cyclist on the sidewalk"), F.lit("mountains in the distance")))) == "I see a cyclist on the sidewalk and mountains in the distance."
    labels, score = text.judge(F.lit('x {"objects":["Car"],"unusual_objects":["hay_bale"],"anomaly_score":7} y'))
    assert show(labels) == ["car", "hay bale"] and show(score) == pytest.approx(0.7)
    labels, score = text.judge(F.lit("x {broken y"))
    assert show(labels) == [] and show(score) is None
    labels, score = text.judge(F.lit('{"objects":["Car"],"anomaly_score":"7"}'))  # a quoted number is no score
    assert show(labels) == ["car"] and show(score) is None
    assert show(text.seeds(F.lit("1-3,7"))) == [1, 2, 3, 7]
    assert show(text.seeds(F.lit("1-3,"))) == [1, 2, 3] and show(text.seeds(F.lit(",4,,9-9"))) == [4, 9] and show(text.seeds(F.lit(""))) == []


def test_pca_map_and_spread(spark):
    from strayframe.plans import scenes
    from strayframe.sources.tables import frames

    folder = "/root/testdata/sf0.001"
    rows = frames(spark, folder).orderBy("id").collect()
    x, run = np.array([r.v for r in rows], dtype=np.float64), np.array([r.run for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pool = x[run <= 5]
    values, axes = np.linalg.eigh(np.cov(pool.T))
    w = axes[:, ::-1][:, :2]
    w = w * np.sign(w[np.abs(w).argmax(axis=0), [0, 1]])
    want = (x - pool.mean(axis=0)) @ w
    got = {(r.run, r.tick): (r.x, r.y) for r in scenes.p13_pca_map(spark, folder).collect()}
    assert np.allclose([got[r.run, r.tick] for r in rows], want, atol=2e-6)
    found = density.spread(knn.pool_of(knn.unit_frames(frames(spark, folder)), [0, 1, 2, 3, 4, 5]))
    assert found["top2"] == pytest.approx(values[::-1][:2].sum() / values.sum()) and found["participation"] == pytest.approx(values.sum() ** 2 / (values**2).sum())
    cos = pool @ pool.T
    assert found["mean_distance"] == pytest.approx(1 - cos[~np.eye(len(pool), dtype=bool)].mean())


def test_unknown_scorers_are_named(spark):
    from strayframe.operators import scorers

    with pytest.raises(ValueError, match="no scorer nearest"):
        scorers.scored(query(spark, (1, 0)), pool(spark, [(1, 0)]), {"metric": "nearest"})


def test_density_queries_follow_whole_vectors(spark):
    """All 64 components count in the queries on covariances that have no SQL."""
    from strayframe.plans import neighbours
    from strayframe.sources.tables import frames

    folder = "/root/testdata/sf0.001"
    rows = frames(spark, folder).orderBy("id").collect()
    x, run = np.array([r.v for r in rows], dtype=np.float64), np.array([r.run for r in rows])
    pool, asked = x[run <= 5], x[run > 5]
    assert x.shape[1] == 64
    names = [(r.run, r.tick) for r in rows]

    def near(q, p):
        return np.sort(np.sqrt(((q[:, None] - p[None]) ** 2).sum(axis=2)), axis=1)[:, :5].mean(axis=1)

    def scores(query):
        found = {(r.run, r.tick): r.score for r in query(spark, folder).collect()}
        return lambda own: np.array([found[n] for n, o in zip(names, own, strict=True) if o])

    cov = np.cov(pool.T)
    values, vectors = np.linalg.eigh(np.linalg.pinv(cov))
    w = vectors * np.sqrt(np.clip(values, 0, None))
    assert np.allclose(scores(neighbours.c02_mahalanobis_whole)(run > 5), near(asked @ w, pool @ w), atol=2e-4)
    values, vectors = np.linalg.eigh(cov)
    keep = min(64, len(pool) // 10, int((values > 1e-12).sum()))
    w = vectors[:, ::-1][:, :keep] / np.sqrt(values[::-1][:keep])
    assert np.allclose(scores(neighbours.c08_pca_whiten)(run > 5), near((asked - pool.mean(axis=0)) @ w, (pool - pool.mean(axis=0)) @ w), atol=1e-5)

    def shrunk(p):
        y = p - p.mean(axis=0)
        n, d = y.shape
        s = y.T @ y / n
        mu = np.trace(s) / d
        beta = (((y * y).sum(axis=1) ** 2).sum() / n - (s * s).sum()) / (d * n)
        delta = ((s - mu * np.eye(d)) ** 2).sum() / d
        part = min(beta, delta) / delta
        return part, (1 - part) * s + part * mu * np.eye(d)

    apart = scores(neighbours.c12_ledoit_wolf_to_mean)
    found, expected = apart(run <= 5), np.zeros(int((run <= 5).sum()))
    for r in range(6):
        others = x[(run <= 5) & (run != r)]
        y = x[run == r] - others.mean(axis=0)
        expected[run[run <= 5] == r] = np.sqrt((y @ np.linalg.inv(shrunk(others)[1]) * y).sum(axis=1))
    assert np.allclose(found, expected, atol=1e-5)
    assert neighbours.g06_shrinkage(spark, folder).first().shrink == pytest.approx(shrunk(pool)[0], abs=1e-6)
    g05 = {(r.i, r.j): r["cov"] for r in neighbours.g05_covariance(spark, folder).collect()}
    assert len(g05) == 64 * 64 and np.allclose([g05[i + 1, j + 1] for i in range(64) for j in range(64)], cov.ravel(), atol=1e-6)
