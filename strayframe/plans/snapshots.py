"""Single frames against a cache of distinct nominal entries; views on results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import knn, snapshot
from ..sources.tables import FRAMES, frames
from .registry import query, r6

# coarse vectors, so that some are equal
_COARSE = "coarse AS (SELECT run, tick, id, list_transform(v, lambda x: round(x * 1.6::DOUBLE) / 1.6::DOUBLE) AS v FROM frames WHERE run <= 5)"
_ENTRIES = "e AS (SELECT *, min(id) OVER (PARTITION BY v) AS entry, count(*) OVER (PARTITION BY v) AS copies FROM coarse)"


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).where("run <= 5").withColumn("v", F.transform("v", lambda x: F.round(x * 1.6) / 1.6 + 0.0))


@query(f"WITH {FRAMES}, {_COARSE}, {_ENTRIES} SELECT id, entry, copies FROM e")
def g18_distinct_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.distinct_entries(_coarse(spark, sf_dir)).select("id", "entry", "copies")


@query()
def g18_tolerance_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within a tolerance the first entry wins: a sequential rule over a cache of frames; held against a loop in the tests."""
    return snapshot.distinct_entries(frames(spark, sf_dir).where("run <= 5"), 0.35).select("id", "entry", "copies")


@query(f"""
WITH {FRAMES}, {_COARSE}, {_ENTRIES}, l AS (SELECT unnest(range(1, 65)) AS i, unnest(v) AS x FROM e WHERE id = entry), s AS (SELECT list(greatest(s, 0.05) ORDER BY i) AS s FROM (SELECT i, stddev_pop(x) AS s FROM l GROUP BY i)),
z AS (SELECT run, tick, id, entry, copies, list_transform(v, lambda x, i: x / s.s[i]) AS v FROM e, s),
d AS (SELECT a.run, a.tick, a.id, b.id AS r_id, list_distance(a.v, b.v) AS d FROM z a JOIN z b ON b.id = b.entry AND (a.entry <> b.id OR b.copies > 1)),
p AS (SELECT run, tick, id, d, row_number() OVER (PARTITION BY id ORDER BY d, r_id) AS n FROM d)
SELECT run, tick, id, round(avg(d), 6) AS score FROM p WHERE n <= 5 GROUP BY run, tick, id
""")
def c13_snapshot_physics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance to five entries; a frame's own entry counts only if another frame has it, too."""
    return snapshot.entry_scores(_coarse(spark, sf_dir), 5).select("run", "tick", "id", r6("score").alias("score"))


_SENT = """
sent AS (SELECT id, 's' || id % 40 * (id % 3) AS sentence FROM frames WHERE run <= 5),
vecs AS (SELECT 's' || id AS sentence, v, id % 10 = 0 AS fixed FROM unit),
cnt AS (SELECT sentence, count(*) AS copies FROM sent GROUP BY sentence)"""


@query(f"""
WITH {FRAMES}, {_SENT}, c AS (SELECT v.sentence, v.v, v.fixed, coalesce(copies, 0) AS copies FROM vecs v LEFT JOIN cnt USING (sentence) WHERE copies IS NOT NULL OR fixed),
p AS (SELECT s.id, CASE WHEN 1 - list_dot_product(o.v, c.v) < 1e-6 THEN 0 ELSE 1 - list_dot_product(o.v, c.v) END AS d, c.sentence FROM sent s JOIN vecs o ON o.sentence = s.sentence JOIN c ON c.sentence <> s.sentence OR c.copies > 1 OR c.fixed),
n AS (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d, sentence) AS n FROM p)
SELECT id, round(avg(d), 6) AS score FROM n WHERE n <= 5 GROUP BY id
""")
def c14_snapshot_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    sentence = F.concat(F.lit("s"), (F.col("id") % 40 * (F.col("id") % 3)).cast("string"))
    vectors = knn.unit_frames(f).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("sentence"), "v", (F.col("id") % 10 == 0).alias("fixed"))
    return snapshot.sentence_scores(f.where("run <= 5").select("id", sentence.alias("sentence")), vectors, 5).select("id", r6("score").alias("score"))


_MATCH = """
pt AS (SELECT id // 8 AS frame, id % 8 AS patch, v FROM unit),
m AS (SELECT q.frame AS id, q.patch, r.frame AS r_id, greatest(1 - list_dot_product(q.v, r.v), 0) AS d FROM pt q JOIN pt r ON q.frame <> r.frame),
b AS (SELECT id, patch, r_id, d FROM (SELECT *, row_number() OVER (PARTITION BY id, patch ORDER BY d, r_id) AS i FROM m) WHERE i = 1)"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = knn.unit_frames(frames(spark, sf_dir))
    q = u.select(F.floor(F.col("id") / 8).alias("id"), (F.col("id") % 8).alias("patch"), "v")
    return snapshot.patch_matches(q, q.select(F.col("id").alias("r_id"), F.col("v").alias("r")))


@query(f"WITH {FRAMES}, {_MATCH}, v AS (SELECT id, r_id, count(*) AS n_votes, avg(d) AS mean_d FROM b GROUP BY id, r_id), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n_votes DESC, round(mean_d, 9), r_id) AS rank FROM v) SELECT id, r_id, n_votes, round(mean_d, 6) AS mean_d, CAST(rank AS INT) AS rank FROM o WHERE rank <= 3")
def g22_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by how many patches they are nearest to."""
    return snapshot.votes(_matches(spark, sf_dir), 3).select("id", "r_id", "n_votes", r6("mean_d").alias("mean_d"), "rank")


@query(f"WITH {FRAMES}, {_MATCH}, o AS (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d DESC) AS i, count(*) OVER (PARTITION BY id) AS c FROM b) SELECT id, round(avg(d), 6) AS score FROM o WHERE i <= greatest(1, round_even(0.25 * c, 0)) GROUP BY id")
def c15_snapshot_vision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each patch's nearest patch of another frame; the mean of the worst quarter."""
    return knn.worst_share(_matches(spark, sf_dir), ["id"], "d", 0.25).select("id", r6("score").alias("score"))


@query(f"""
WITH {FRAMES}, s AS (SELECT run, tick, abs(v[1]) AS score FROM frames), st AS (SELECT run, avg(score) AS m, CASE WHEN stddev_pop(score) = 0 THEN 1 ELSE stddev_pop(score) END AS sd FROM s WHERE tick <= 30 GROUP BY run)
SELECT run, tick, round((score - m) / sd, 5) AS z, score > m + 1.5 * sd AS above FROM s JOIN st USING (run)
""")
def v1_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index view: each frame's z against the first thirty frames of its run, and whether it is above the threshold."""
    s = frames(spark, sf_dir, 1).select("run", "tick", F.abs(F.col("v")[0]).alias("score"))
    st = s.where("tick <= 30").groupBy("run").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("sd")).withColumn("sd", F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")))
    return s.join(F.broadcast(st), "run").select("run", "tick", F.round((F.col("score") - F.col("m")) / F.col("sd"), 5).alias("z"), (F.col("score") > F.col("m") + 1.5 * F.col("sd")).alias("above"))  # a row a run


@query(f"""
WITH {FRAMES}, p AS (SELECT q.run, q.tick, q.id, r.id AS r_id, 1 - list_dot_product(q.v, r.v) AS d FROM unit q JOIN unit r ON q.run > 7 AND r.run <= 5),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, r_id) AS n FROM p), o AS (SELECT id, abs(v[1]) AS own FROM frames)
SELECT run, tick, CAST(n AS INT) AS n, r_id, round(own, 6) AS own_score, round(d, 6) AS d FROM b JOIN o ON o.id = r_id WHERE n <= 3
""")
def v2_drill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame's neighbours, each with the score that it has itself."""
    f = frames(spark, sf_dir)
    u = knn.unit_frames(f)
    best = knn.nearest(u.where("run > 7"), knn.pool_of(u, [0, 1, 2, 3, 4, 5]), 3, "cosine")
    own = f.select(F.col("id").alias("r_id"), F.abs(F.col("v")[0]).alias("own"))
    return best.join(own, "r_id").select("run", "tick", "n", "r_id", r6("own").alias("own_score"), r6("d").alias("d"))


@query(f"""
WITH {FRAMES}, p AS (SELECT q.run, q.tick, q.id, r.id AS r_id, r.run AS r_run, r.tick AS r_tick, 1 - list_dot_product(q.v, r.v) AS d FROM unit q JOIN unit r ON q.run > 7 AND r.run <= 5),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, r_id) AS n FROM p)
SELECT run, tick, r_run, r_tick, round(1 - d, 4) AS cos FROM b WHERE n <= 3
""")
def k5_neighbour_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbour lists to JSON and back."""
    from ..sources import sinks

    u = knn.unit_frames(frames(spark, sf_dir))
    json = sinks.neighbour_json(knn.nearest(u.where("run > 7"), knn.pool_of(u, [0, 1, 2, 3, 4, 5]), 3, "cosine"))
    read = F.explode(F.from_json("knn", "array<struct<run: int, t: int, cos: double>>")).alias("k")
    return json.select("run", "tick", read).select("run", "tick", F.col("k.run").alias("r_run"), F.col("k.t").alias("r_tick"), F.col("k.cos").alias("cos"))


@query(f"WITH {FRAMES}, w AS (SELECT run, tick, v[1] AS s, v[1] - lag(v[1]) OVER (PARTITION BY run ORDER BY tick) AS step FROM frames) SELECT run, tick, round(step, 6) AS step FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC, tick) AS i FROM w WHERE step IS NOT NULL) WHERE i = 1")
def w06_largest_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tick of each run at which a score rises most; the first of equal ones."""
    f = frames(spark, sf_dir, 1).withColumn("step", F.col("v")[0] - F.lag(F.col("v")[0]).over(Window.partitionBy("run").orderBy("tick"))).where("step is not null")
    best = f.groupBy("run").agg(F.min(F.struct(-F.col("step"), F.col("tick").alias("tick"), F.col("step").alias("step"))).alias("m"))
    return best.select("run", "m.tick", r6("m.step").alias("step"))
