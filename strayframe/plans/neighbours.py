"""Scores of frames against a nominal pool: nearest neighbours and densities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vec
from ..operators import conformal, density, evaluation, knn
from ..sources.tables import FRAMES, frames
from .registry import query, r6

POOL, LOO = [0, 1, 2, 3, 4, 5], list(range(9))
K = 5


def _score(df: DataFrame) -> DataFrame:
    return df.select("run", "tick", r6("score").alias("score"))


def _unit(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = knn.unit_frames(frames(spark, sf_dir))
    return f.where("run > 5"), knn.pool_of(f, POOL)


_BEST = """
best AS (SELECT run, tick, id, r_id, r_run, r_tick, d, row_number() OVER (PARTITION BY id ORDER BY d, r_id) AS n FROM pairs)"""
_MEAN = f"{_BEST} SELECT run, tick, round(avg(d), 6) AS score FROM best WHERE n <= {K} GROUP BY run, tick"


def _pairs(source: str, where: str, d: str) -> str:
    return f"pairs AS (SELECT q.run, q.tick, q.id, r.id AS r_id, r.run AS r_run, r.tick AS r_tick, {d} AS d FROM {source} q JOIN {source} r ON {where})"


_AWAY = "q.run > 5 AND r.run <= 5"
_APART = "q.run <= 8 AND r.run <= 8 AND q.run <> r.run"
_COS = "1 - list_dot_product(q.v, r.v)"


_FLAGS = f"""
WITH {FRAMES}, {_pairs("unit", "r.run <= 8 AND q.run <> r.run", _COS)}, {_BEST},
s AS (SELECT run, tick, avg(d) AS score FROM best WHERE n <= {K} GROUP BY run, tick),
o AS (SELECT run, tick, score, row_number() OVER (PARTITION BY run ORDER BY score) AS i, count(*) OVER (PARTITION BY run) AS c FROM s),
q AS (SELECT run, score AS q_run FROM o WHERE i = ceil(0.95::DOUBLE * c)),
t AS (SELECT run, q_run, row_number() OVER (ORDER BY q_run) AS i, count(*) OVER () AS c FROM q WHERE run <= 8),
tau AS (SELECT q_run AS tau FROM t WHERE i = ceil((c + 1) * (1 - 0.1::DOUBLE)))
SELECT s.run, count(*) AS n_frames, round(any_value(q_run), 6) AS q_run, round(any_value(tau), 6) AS tau, any_value(q_run) > any_value(tau) AS flagged,
    round(avg(CASE WHEN score > tau THEN 1.0 ELSE 0.0 END), 6) AS frac_above, min(CASE WHEN score > tau THEN tick END) AS first_above
FROM s JOIN q USING (run), tau GROUP BY s.run
"""


@query(_FLAGS)
def knn_cosine_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine neighbours among the other runs, leave-one-run-out conformal threshold, decision for each run."""
    f = knn.unit_frames(frames(spark, sf_dir))
    s = knn.mean_distance(knn.nearest(f, knn.pool_of(f, LOO), K, "cosine", apart=("run", "r_run")), K)
    q = conformal.order_stat(s, ["run"], 0.95)
    tau = conformal.conformal_tau(q.where("run <= 8"), [], 0.1, value="q_run").select("tau")
    rows = s.join(q, "run").crossJoin(F.broadcast(tau))  # one row
    return conformal.run_decision(rows, ["run", "tau"], F.col("tau"), F.col("q_run")).select("run", "n_frames", r6("q_run").alias("q_run"), r6("tau").alias("tau"), "flagged", r6("frac_above").alias("frac_above"), "first_above")


_C01 = f"WITH {FRAMES}, {_pairs('unit', _AWAY, _COS)}, {_MEAN}"


@query(_C01)
def c01_knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, pool = _unit(spark, sf_dir)
    return _score(knn.mean_distance(knn.nearest(q, pool, K, "cosine"), K))


@query(_C01)
def c01_knn_cosine_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows by blocks of matrix products, for pools that do not broadcast."""
    q, pool = _unit(spark, sf_dir)
    return _score(knn.mean_distance(knn.nearest(q, pool, K, "cosine", pool_bytes=0, block_rows=200), K))


@query(f"""
WITH {FRAMES}, f2 AS (SELECT run, tick, id, v[1] AS a, v[2] AS b FROM frames),
c AS (SELECT var_samp(a) AS aa, covar_samp(a, b) AS ab, var_samp(b) AS bb FROM f2 WHERE run <= 5),
pairs AS (SELECT q.run, q.tick, q.id, r.id AS r_id, r.run AS r_run, r.tick AS r_tick,
    sqrt((bb * (q.a - r.a) ** 2 - 2 * ab * (q.a - r.a) * (q.b - r.b) + aa * (q.b - r.b) ** 2) / (aa * bb - ab * ab)) AS d FROM f2 q JOIN f2 r ON {_AWAY}, c),
best AS (SELECT run, tick, d, row_number() OVER (PARTITION BY id ORDER BY d, r_id) AS n FROM pairs)
SELECT run, tick, round(avg(d), 4) AS score FROM best WHERE n <= {K} GROUP BY run, tick
""")
def c02_mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir, 2)
    return density.mahalanobis(f.where("run > 5"), knn.pool_of(f, POOL), K).select("run", "tick", F.round("score", 4).alias("score"))


@query()
def c02_mahalanobis_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As c02_mahalanobis, whose SQL knows two components, on whole vectors."""
    f = frames(spark, sf_dir)
    return density.mahalanobis(f.where("run > 5"), knn.pool_of(f, POOL), K).select("run", "tick", F.round("score", 4).alias("score"))


_MOMENTS = """
long AS (SELECT unnest(range(1, 65)) AS i, unnest(v) AS x FROM frames WHERE run <= 5),
m AS (SELECT list(m ORDER BY i) AS mu, list(CASE WHEN s < 1e-6 THEN 1.0 ELSE s END ORDER BY i) AS sigma FROM (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY i))"""


@query(f"""
WITH {FRAMES}, {_MOMENTS},
st AS (SELECT run, tick, id, list_transform(range(1, 65), lambda i: (v[i] - mu[i]) / sigma[i]) AS v FROM frames, m),
{_pairs("st", _AWAY, "list_distance(q.v, r.v)")}, {_MEAN}
""")
def c03_std_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    pool = knn.pool_of(f, POOL)
    of = knn.moments(pool)
    return _score(knn.mean_distance(knn.nearest(knn.standardised(f.where("run > 5"), "v", of), knn.standardised(pool, "r", of), K, "euclidean"), K))


@query(f"""
WITH {FRAMES}, best AS (SELECT q.run, (q.tick - 1) // 6 AS frame, q.id, min(greatest({_COS}, 0.0)) AS d FROM unit q JOIN unit r ON {_AWAY} GROUP BY q.run, q.tick, q.id),
o AS (SELECT run, frame, d, row_number() OVER (PARTITION BY run, frame ORDER BY d DESC) AS i, count(*) OVER (PARTITION BY run, frame) AS c FROM best)
SELECT run, CAST(frame AS INT) AS frame, round(avg(d), 6) AS score FROM o WHERE i <= greatest(1, round_even(0.4 * c, 0)) GROUP BY run, frame
""")
def c04_patch_worst_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six rows in a row are the patches of a frame: each one's nearest in the bank, then the mean of the worst 40 %."""
    q, pool = _unit(spark, sf_dir)
    best = knn.nearest(q, pool, 1, "cosine").select("run", F.floor((F.col("tick") - 1) / 6).cast("int").alias("frame"), F.greatest("d", F.lit(0.0)).alias("d"))
    return knn.worst_share(best, ["run", "frame"], "d", 0.4).select("run", "frame", r6("score").alias("score"))


@query(f"""
WITH {FRAMES}, lab AS (SELECT run, (tick - 1) // 4 AS frame, id, id % 90 AS label, v FROM unit),
pool AS (SELECT id AS r_id, v AS r FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS i FROM lab WHERE run <= 5) WHERE i = 1),
pairs AS (SELECT q.run, q.frame, q.id, 1 - list_dot_product(q.v, r) AS d, row_number() OVER (PARTITION BY q.id ORDER BY 1 - list_dot_product(q.v, r), r_id) AS n FROM lab q, pool WHERE q.run > 5 AND q.id % 5 <> 0),
s AS (SELECT run, frame, id, avg(d) AS s FROM pairs WHERE n <= {K} GROUP BY run, frame, id),
f AS (SELECT DISTINCT run, frame FROM lab WHERE run > 5)
SELECT f.run, CAST(f.frame AS INT) AS tick, round(max(s), 6) AS score FROM f LEFT JOIN s ON f.run = s.run AND f.frame = s.frame GROUP BY f.run, f.frame
""")
def c05_label_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a frame against the pool's distinct labels: a frame has the score of its worst label, none without labels."""
    f = knn.unit_frames(frames(spark, sf_dir)).withColumn("label", F.col("id") % 90).withColumn("frame", F.floor((F.col("tick") - 1) / 4).cast("int"))
    pool = knn.first_per_label(f.where(F.col("run").isin(POOL)), "label", "id")
    near = knn.nearest(f.where("run > 5 and id % 5 <> 0"), knn.pool_of(pool, POOL), K, "cosine").where(F.col("n") <= K)
    labels = near.groupBy("run", F.floor((F.col("tick") - 1) / 4).cast("int").alias("tick"), "id").agg(F.avg("d").alias("s")).groupBy("run", "tick").agg(F.max("s").alias("score"))
    return _score(f.where("run > 5").select("run", F.col("frame").alias("tick")).distinct().join(labels, ["run", "tick"], "left"))


_P = """
p AS (SELECT run, tick, id, list_transform(a, lambda x: (x + 1e-6) / (list_sum(a) + 64e-6)) AS v FROM (SELECT run, tick, id, list_transform(v, lambda x: abs(x)) AS a FROM frames))"""


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).withColumn("v", vec.shares(F.transform("v", F.abs)))


@query(f"""
WITH {FRAMES}, {_P}, m AS (SELECT list(x ORDER BY i) AS r FROM (SELECT i, avg(x) AS x FROM (SELECT unnest(range(1, 65)) AS i, unnest(v) AS x FROM p WHERE run <= 5) GROUP BY i))
SELECT run, tick, round(list_sum(list_transform(range(1, 65), lambda i: v[i] * ln(v[i] / r[i]))), 6) AS score FROM p, m WHERE run > 5
""")
def c06_kl_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of a frame's label distribution from the pool's mean one."""
    p = _shares(spark, sf_dir)
    mean = knn.moments(knn.pool_of(p, POOL)).select("mu")
    return _score(p.where("run > 5").crossJoin(F.broadcast(mean)).withColumn("score", vec.kl("v", "mu")))  # one row


@query(f"""
WITH {FRAMES}, {_P}, {_pairs("p", _AWAY, "list_sum(list_transform(range(1, 65), lambda i: q.v[i] * ln(q.v[i] / r.v[i])))")}, {_MEAN}
""")
def c07_kl_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _shares(spark, sf_dir)
    return _score(knn.mean_distance(knn.nearest(p.where("run > 5"), knn.pool_of(p, POOL), K, "kl"), K))


@query()
def c08_pca_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return density.pca_whitened(f.where("run > 5"), knn.pool_of(f, POOL), K)


@query(f"""
WITH {FRAMES}, {_MOMENTS}, c AS (SELECT run, tick, id, list_transform(range(1, 65), lambda i: v[i] - mu[i]) AS v FROM frames, m),
u AS (SELECT run, tick, id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM c), {_pairs("u", _AWAY, _COS)}, {_MEAN}
""")
def c09_centred_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    pool = knn.pool_of(f, POOL)
    of = knn.moments(pool).select("mu", "sigma")
    q, r = knn.centred(f.where("run > 5"), "v", of), knn.centred(pool, "r", of)
    return _score(knn.mean_distance(knn.nearest(q.withColumn("v", vec.unit("v")), r.withColumn("r", vec.unit("r")), K, "cosine"), K))


@query(f"WITH {FRAMES} SELECT run, tick, round(v[3], 6) AS score FROM frames WHERE run > 5")
def c10_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A component is a score already."""
    return _score(frames(spark, sf_dir).where("run > 5").withColumn("score", F.col("v")[2]))


@query(f"""
WITH {FRAMES}, {_pairs("unit", _APART, _COS)}, {_BEST}
SELECT run, tick, round(avg(d) FILTER (n <= 1), 6) AS cosine_k1, round(avg(d) FILTER (n <= 3), 6) AS cosine_k3, round(avg(d) FILTER (n <= 5), 6) AS cosine_k5, round(avg(d), 6) AS cosine_k10,
    string_agg(r_run || ':' || r_tick, ',' ORDER BY n) AS neighbours FROM best WHERE n <= 10 GROUP BY run, tick
""")
def c11_topk_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One top ten gives four scores and the neighbours themselves; never a neighbour of the own run."""
    f = knn.unit_frames(frames(spark, sf_dir)).where("run <= 8")
    best = knn.nearest(f, knn.pool_of(f, LOO), 10, "cosine", apart=("run", "r_run"))
    means = [r6(F.avg(F.when(F.col("n") <= k, F.col("d")))).alias(f"cosine_k{k}") for k in (1, 3, 5, 10)]
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat_ws(":", "r_run", "r_tick").alias("s")))), lambda x: x["s"]), ",")
    return best.groupBy("run", "tick").agg(*means, named.alias("neighbours"))


@query()
def c12_ledoit_wolf_to_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's distance to the mean of the others under their shrunk covariance; one fit a run."""
    return density.to_mean_apart(frames(spark, sf_dir), POOL)


@query(f"""
WITH {FRAMES}, long AS (SELECT id, unnest(range(1, 65)) AS i, unnest(v) AS x FROM frames WHERE run <= 5), n AS (SELECT count(*) AS n FROM frames WHERE run <= 5),
mu AS (SELECT i, avg(x) AS m FROM long GROUP BY i), y AS (SELECT id, l.i, x - m AS y FROM long l JOIN mu ON l.i = mu.i),
s AS (SELECT a.i, b.i AS j, sum(a.y * b.y) / any_value(n) AS s FROM y a JOIN y b USING (id), n GROUP BY a.i, b.i),
t AS (SELECT sum(CASE WHEN i = j THEN s END) AS tr, sum(s * s) AS sq FROM s), f AS (SELECT sum(q * q) AS f FROM (SELECT sum(y * y) AS q FROM y GROUP BY id)),
b AS (SELECT (f / n - sq) / (64 * n) AS beta, (sq - 2 * (tr / 64) * tr + 64 * (tr / 64) ** 2) / 64 AS delta, n FROM t, f, n)
SELECT n, round(CASE WHEN beta = 0 THEN 0.0 ELSE least(beta, delta) / delta END, 6) AS shrink FROM b
""")
def g06_shrinkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = knn.pool_of(frames(spark, sf_dir), POOL)
    _, _, shrink = density.shrinkage(pool)
    return pool.agg(F.count("*").alias("n")).withColumn("shrink", r6(F.lit(float(shrink))))


@query(f"""
WITH {FRAMES}, long AS (SELECT id, unnest(range(1, 65)) AS i, unnest(v) AS x FROM frames WHERE run <= 5)
SELECT CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, round(covar_samp(a.x, b.x), 6) AS cov FROM long a JOIN long b USING (id) GROUP BY a.i, b.i
""")
def g05_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cov, _ = density.covariance(knn.pool_of(frames(spark, sf_dir), POOL))
    rows = [(i + 1, j + 1, float(x)) for i, r in enumerate(cov) for j, x in enumerate(r)]
    return spark.createDataFrame(rows, "i int, j int, cov double").withColumn("cov", r6("cov"))


@query(f"WITH {FRAMES}, {_pairs('unit', 'q.run <= 5 AND r.run <= 5', _COS)}, {_MEAN}")
def c16_self_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference runs against the pool that holds them."""
    f = knn.unit_frames(frames(spark, sf_dir)).where("run <= 5")
    return _score(knn.mean_distance(knn.nearest(f, knn.pool_of(f, POOL), K, "cosine"), K))


@query(f"WITH {FRAMES}, {_pairs('unit', _APART, _COS)}, {_MEAN}")
def j02_leave_one_run_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = knn.unit_frames(frames(spark, sf_dir)).where("run <= 8")
    return _score(knn.mean_distance(knn.nearest(f, knn.pool_of(f, LOO), K, "cosine", apart=("run", "r_run")), K))


@query(f"""
WITH {FRAMES}, x AS (SELECT id % 17 AS label, id, v FROM frames WHERE run <= 5), o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS i FROM x)
SELECT label, id, round(v[1], 6) AS first FROM o WHERE i = 1
""")
def g19_first_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).where("run <= 5").withColumn("label", F.col("id") % 17)
    return knn.first_per_label(f, "label", "id").select("label", "id", r6(F.col("v")[0]).alias("first"))


_DRAWS = [(size, draw, run) for size in (2, 4, 6) for draw in range(3) for run in [(draw * 2 + k) % 9 for k in range(size)]]
_DRAW_ROWS = ", ".join(str(x) for x in _DRAWS)


@query(f"""
WITH {FRAMES}, draws(size, draw, r_run) AS (VALUES {_DRAW_ROWS}), {_pairs("unit", "r.run <= 8 AND q.run <> r.run", _COS)},
o AS (SELECT size, draw, run, tick, d, row_number() OVER (PARTITION BY size, draw, id ORDER BY d, r_id) AS n FROM pairs JOIN draws USING (r_run)),
s AS (SELECT size, draw, run, tick, avg(d) AS score FROM o WHERE n <= {K} GROUP BY size, draw, run, tick)
SELECT CAST(size AS INT) AS size, CAST(draw AS INT) AS draw, count(*) AS n, round(avg(score) FILTER (run = 9), 6) AS mean_test, round(avg(score) FILTER (run <= 8), 6) AS mean_nominal FROM s GROUP BY size, draw
""")
def p09_pool_size_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All draws of runs in one plan: each run's nearest are found once and each draw merges those of its runs."""
    draws = spark.createDataFrame(_DRAWS, "size int, draw int, r_run int")
    f = knn.unit_frames(frames(spark, sf_dir))
    pairs = knn.nearest(f, knn.pool_of(f, LOO), K, "cosine", apart=("run", "r_run"), by="r_run").drop("n")
    ranked = pairs.join(F.broadcast(draws), "r_run").withColumn("n", F.row_number().over(Window.partitionBy("size", "draw", "id").orderBy("d", "r_id"))).where(F.col("n") <= K)
    s = ranked.groupBy("size", "draw", "run", "tick").agg(F.avg("d").alias("score"))
    return s.groupBy("size", "draw").agg(F.count("*").alias("n"), r6(F.avg(F.when(F.col("run") == 9, F.col("score")))).alias("mean_test"), r6(F.avg(F.when(F.col("run") <= 8, F.col("score")))).alias("mean_nominal"))


@query(f"""
WITH {FRAMES}, shares(share) AS (VALUES (0.3), (0.5), (0.7), (1.0)), {_pairs("unit", _AWAY, _COS)},
o AS (SELECT share, run, tick, d, row_number() OVER (PARTITION BY share, id ORDER BY d, r_id) AS n FROM pairs JOIN shares ON r_id * 7919 % 1000 < 1000 * share),
s AS (SELECT share, run, tick, avg(d) AS score FROM o WHERE n <= {K} GROUP BY share, run, tick)
SELECT CAST(share AS DOUBLE) AS share, count(*) AS n, round(avg(score), 6) AS mean_score, round(max(score), 6) AS top_score FROM s GROUP BY share
""")
def p10_corpus_share_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A share's pool holds the smaller shares' pools, so the nearest of each ring are found once and merged."""
    shares = spark.createDataFrame([(x,) for x in (0.3, 0.5, 0.7, 1.0)], "share double")
    q, pool = _unit(spark, sf_dir)
    place = F.col("r_id") * 7919 % 1000
    ring = F.when(place < 300, 0.3).when(place < 500, 0.5).when(place < 700, 0.7).otherwise(1.0)
    pairs = knn.nearest(q, pool.withColumn("ring", ring), K, "cosine", by="ring").select("run", "tick", "id", "r_id", "ring", "d").join(F.broadcast(shares), F.col("ring") <= F.col("share"))
    s = pairs.withColumn("n", F.row_number().over(Window.partitionBy("share", "id").orderBy("d", "r_id"))).where(F.col("n") <= K).groupBy("share", "run", "tick").agg(F.avg("d").alias("score"))
    return s.groupBy("share").agg(F.count("*").alias("n"), r6(F.avg("score")).alias("mean_score"), r6(F.max("score")).alias("top_score"))


@query(f"""
WITH {FRAMES}, {_pairs("unit", "r.run <= 5 AND q.run >= 6 AND q.run <> r.run", _COS)}, {_BEST},
s AS (SELECT run, tick, avg(d) AS score FROM best WHERE n <= {K} GROUP BY run, tick)
SELECT round((sum(r) - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auroc, CAST(n1 AS BIGINT) AS n_pos, CAST(n0 AS BIGINT) AS n_neg FROM (
    SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r, run, count(*) FILTER (run = 9) OVER () AS n1, count(*) FILTER (run <> 9) OVER () AS n0 FROM s)
WHERE run = 9 GROUP BY n1, n0
""")
def g13_knn_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the neighbour score tells run 9 from runs 6 to 8."""
    q, pool = _unit(spark, sf_dir)
    s = knn.mean_distance(knn.nearest(q, pool, K, "cosine"), K).withColumn("positive", F.col("run") == 9)
    return evaluation.auroc(s, []).withColumn("auroc", r6("auroc"))


@query(f"""
WITH {FRAMES}, c AS (SELECT id % 5 AS g, v, 1.0 + id % 3 AS w FROM frames), l AS (SELECT g, w, unnest(range(1, 65)) AS i, unnest(v) AS x FROM c)
SELECT g, CAST(i AS INT) AS i, round(sum(w * x) / sum(w), 6) AS mean FROM l GROUP BY g, i
""")
def a10_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = frames(spark, sf_dir).select((F.col("id") % 5).alias("g"), F.posexplode("v").alias("i", "x"), (1.0 + F.col("id") % 3).alias("w"))
    return c.groupBy("g", (F.col("i") + 1).alias("i")).agg(r6(F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"))


@query(f"""
WITH {FRAMES} SELECT id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_sum(list_transform(v, lambda x: 1 / (1 + exp(-x)))) / 64, 6) AS mean_sigmoid,
    round(list_max(list_transform(v, lambda x: 1 / (1 + exp(-x)))), 6) AS top_sigmoid, round(list_distance(v, list_transform(v, lambda x: -x)), 6) AS to_mirror, round(list_sum(v[5:20]) / 16, 6) AS pooled FROM frames
""")
def a_vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    s = F.transform("v", lambda x: 1 / (1 + F.exp(-x)))
    return f.select("id", r6(vec.norm("v")).alias("norm"), r6(vec.total(s) / 64).alias("mean_sigmoid"), r6(F.array_max(s)).alias("top_sigmoid"), r6(vec.euclidean(F.col("v"), F.transform("v", lambda x: -x))).alias("to_mirror"), r6(vec.total(F.slice("v", 5, 16)) / 16).alias("pooled"))
