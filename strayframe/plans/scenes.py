"""Views, sweeps and searches over recordings: corridors, runways, turns, labels of frames, saved answers, metrics by kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import vec
from ..operators import concepts, conformal, density, evaluation, kinematics, knn, scorers, snapshot
from ..sources.tables import AGENTS, FRAMES, SCORES, STATES, agents, frames, scores, states, table
from .calibration import _WINDOWS, _windows
from .features import _ARC, _EDGE_SQL, _REL, _WRAP, _edges
from .neighbours import _AWAY, _COS, _MOMENTS, K, POOL
from .registry import query, r6


@query(f"WITH {STATES}, {AGENTS}, {_REL} SELECT run, tick, agent, round(rel_x, 6) AS ahead, round(rel_y, 6) AS aside FROM rel WHERE rel_x > 0 AND rel_x <= 20 AND abs(rel_y) <= 3")
def f08_corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents up to 20 m ahead and 3 m to either side."""
    rel = kinematics.relative(states(spark, sf_dir), agents(spark, sf_dir))
    return kinematics.in_corridor(rel, 20.0, 3.0).select("run", "tick", "agent", r6("rel_x").alias("ahead"), r6("rel_y").alias("aside"))


_TURNS = f"""
td AS (SELECT run, tick, abs({_WRAP.format("yaw - lag(yaw) OVER (PARTITION BY run ORDER BY tick)")}) AS d FROM states), th AS (SELECT run, tick FROM td WHERE d > 0.42),
tn AS (SELECT run, tick, sum(CASE WHEN p IS NULL OR tick - p > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY tick) AS part FROM (SELECT run, tick, lag(tick) OVER (PARTITION BY run ORDER BY tick) AS p FROM th)),
turns AS (SELECT run, min(tick) AS start, max(tick) AS stop FROM tn GROUP BY run, part)"""


@query(f"""
WITH {STATES}, {_TURNS}, ends AS (SELECT run, count(*) + 1 AS n FROM states GROUP BY run),
c AS (SELECT run, 10 AS s, n FROM ends UNION SELECT t.run, stop + 1, n FROM turns t JOIN ends e ON t.run = e.run WHERE stop + 1 < n AND stop + 1 >= 10),
r AS (SELECT c.run, s, coalesce((SELECT min(start) FROM turns t WHERE t.run = c.run AND t.start > c.s), n) - s AS runway FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY runway DESC, s) AS i FROM r)
SELECT run, CAST(CASE WHEN runway > 0 THEN s ELSE 10 END AS INT) AS tick, CAST(greatest(runway, 0) AS INT) AS runway FROM o WHERE i = 1
""")
def w05_best_runway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tick from 10 on with the longest straight drive behind it; the first of equal ones."""
    s = states(spark, sf_dir)
    ends = s.groupBy("run").agg((F.count("*") + 1).cast("int").alias("n"))
    return kinematics.best_runway(ends, kinematics.turns(s, step=0.42), 10)


@query(f"""
WITH {STATES}, {_ARC}, l AS (SELECT a.run, a.s, degrees(s.yaw) AS yaw FROM a JOIN states s ON a.run = s.run AND a.tick = s.tick),
n AS (SELECT run, s, yaw, lead(s) OVER w AS s1, lead(yaw) OVER w AS y1 FROM l WINDOW w AS (PARTITION BY run ORDER BY s)), top AS (SELECT run, max(s) AS m FROM a GROUP BY run)
SELECT n.run, round(min(s), 5) AS start, round(max(s1), 5) AS stop FROM n JOIN top ON n.run = top.run
WHERE s1 IS NOT NULL AND abs((y1 - yaw + 180) - 360 * floor((y1 - yaw + 180) / 360) - 180) / greatest(s1 - s, 1e-6) > 20 AND s >= m * 0.2 AND s1 <= m * 0.8 GROUP BY n.run
""")
def w10_turn_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where, in the middle three fifths of its path, a run turns by more than 20 degrees a metre."""
    line = kinematics.arc_length(states(spark, sf_dir), ["run"], "tick").withColumn("yaw", F.degrees("yaw"))
    top = line.groupBy("run").agg(F.max("s").alias("m"))
    span = top.select("run", (F.col("m") * 0.2).alias("s0"), (F.col("m") * 0.8).alias("s1"))
    return kinematics.turn_extent(line, span, 20.0).select("run", F.round("start", 5).alias("start"), F.round("stop", 5).alias("stop"))


@query(f"""
WITH {STATES}, {_ARC}, n AS (SELECT run, s, x, y, lead(s) OVER w AS s1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM a WINDOW w AS (PARTITION BY run ORDER BY s)),
p AS (SELECT run, i, i * 0.25::DOUBLE AS pl FROM (SELECT run, unnest(range(0, CAST(ceil(max(s) / 0.25::DOUBLE) AS BIGINT))) AS i FROM a GROUP BY run)),
j AS (SELECT p.run, i, x + coalesce((pl - s) / nullif(s1 - s, 0), 0) * coalesce(x1 - x, 0) AS x, y + coalesce((pl - s) / nullif(s1 - s, 0), 0) * coalesce(y1 - y, 0) AS y FROM p ASOF JOIN n ON p.run = n.run AND p.pl >= n.s)
SELECT run, CAST(i AS INT) AS i, round(x, 4) AS x, round(y, 4) AS y, round(atan2(coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y), coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x)), 4) AS heading
FROM j WINDOW w AS (PARTITION BY run ORDER BY i)
""")
def e16_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each path at every quarter of a metre, with the heading of the central difference."""
    found = kinematics.resampled(kinematics.arc_length(states(spark, sf_dir), ["run"], "tick"), 0.25)
    return found.select("run", "i", *(F.round(c, 4).alias(c) for c in ("x", "y", "heading")))


@query(f"""
WITH {STATES}, {_EDGE_SQL}, a AS (SELECT run, tick, x, y FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY tick) - 1 AS i FROM states) WHERE i % 10 = 0),
t AS (SELECT run, tick, x, y, ax, ay, bx, by_, least(greatest(((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2), 0), 1) AS t FROM a, edges),
d AS (SELECT run, tick, min(sqrt((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by_ - ay)) ** 2)) AS d FROM t GROUP BY run, tick)
SELECT run, CAST(min(tick) AS INT) AS tick FROM d WHERE d > 4 GROUP BY run
""")
def g24_off_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of every tenth tick that is more than four metres from the route."""
    edges = _edges(spark).withColumn("segment", F.col("polygon") * 10 + F.col("segment")).drop("polygon")
    return kinematics.off_route(states(spark, sf_dir), edges)


_NOUNS = {"bp0": "man", "bp1": "woman", "bp2": "child"}


@query(f"""
WITH {STATES}, {AGENTS}, g AS (SELECT run, tick, agent, CASE agent % 3 WHEN 0 THEN 'cyclist' WHEN 1 THEN 'walker' ELSE 'vehicle' END AS type, CASE agent % 3 WHEN 0 THEN 'cyclist' WHEN 1 THEN CASE WHEN agent = 4 THEN 'traffic conductor' ELSE 'pedestrian' END ELSE 'car' END AS obj,
    'bp' || tick % 4 AS bp, CASE (tick + agent) % 4 WHEN 0 THEN 'on the sidewalk' WHEN 1 THEN 'on the crosswalk' WHEN 2 THEN 'in the intersection' ELSE 'on the road' END AS pred, (tick * 37 + agent * 11) % 120 AS px, (tick % 6) * 0.5 AS m FROM agents),
p AS (SELECT *, CASE WHEN type = 'cyclist' THEN CASE WHEN pred = 'on the crosswalk' OR m <= 1.5 THEN 'on the crosswalk' ELSE 'on the sidewalk' END ELSE pred END AS q FROM g WHERE px >= 50),
l AS (SELECT run, tick, string_agg(CASE WHEN obj = 'pedestrian' THEN CASE bp WHEN 'bp0' THEN 'man' WHEN 'bp1' THEN 'woman' WHEN 'bp2' THEN 'child' ELSE obj END ELSE obj END || ' ' || q, '|' ORDER BY agent) AS own,
    bool_or(q = 'on the sidewalk') AS side, bool_or(q IN ('on the crosswalk', 'in the intersection')) AS cross_ FROM p GROUP BY run, tick)
SELECT s.run, s.tick, coalesce(own || '|', '') || CASE WHEN coalesce(side, false) THEN '' ELSE 'empty sidewalk|' END || CASE WHEN coalesce(cross_, false) THEN '' ELSE 'empty intersection|' END || 'mountains in the distance' AS labels
FROM states s LEFT JOIN l ON s.run = l.run AND s.tick = l.tick
""")
def t13_frame_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame's label texts: visible agents, what is empty, what is always there."""
    k, tick = F.col("agent"), F.col("tick")
    kind = lambda a, b, c: F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(c)
    place = (tick + k) % 4
    seen = agents(spark, sf_dir).select(
        "run", "tick", "agent", kind("cyclist", "walker", "vehicle").alias("type"), kind(F.lit("cyclist"), F.when(k == 4, "traffic conductor").otherwise("pedestrian"), F.lit("car")).alias("obj"), F.concat(F.lit("bp"), (tick % 4).cast("string")).alias("bp"),
        F.when(place == 0, "on the sidewalk").when(place == 1, "on the crosswalk").when(place == 2, "in the intersection").otherwise("on the road").alias("pred"), ((tick * 37 + k * 11) % 120).alias("px"), (tick % 6 * 0.5).alias("crosswalk_m"),
    )
    return concepts.frame_labels(states(spark, sf_dir), seen, nouns=_NOUNS).select("run", "tick", F.array_join("labels", "|").alias("labels"))


@query("""
WITH c AS (SELECT conv_id % 400 AS run, conv_id AS tick, role AS prompt, max_by(text, turn) AS output FROM conversations GROUP BY conv_id, role),
t AS (SELECT run, tick, count(*) FILTER (prompt IN ('user', 'assistant')) = 2 AS whole FROM c GROUP BY run, tick), r AS (SELECT run FROM t GROUP BY run HAVING bool_and(whole))
SELECT c.run, tick, md5(max(output) FILTER (prompt = 'user')) AS asked, md5(max(output) FILTER (prompt = 'assistant')) AS said FROM c JOIN r ON c.run = r.run GROUP BY c.run, tick
""")
def s12_saved_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers kept from an earlier pass, of the runs whose every tick has both prompts."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 400).alias("run"), F.col("conv_id").alias("tick"), F.col("role").alias("prompt"), F.col("text").alias("output"), "turn")
    found = concepts.saved_answers(rows, ["user", "assistant"], "turn")
    return found.select("run", "tick", F.md5(F.col("answers")["user"].cast("binary")).alias("asked"), F.md5(F.col("answers")["assistant"].cast("binary")).alias("said"))


@query("SELECT o_custkey AS key, len(list_filter(list_distinct(list(o_orderpriority[1])), lambda x: x IN ('1', '5'))) = 2 AS whole FROM orders GROUP BY o_custkey")
def u06_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all wanted keys are among a group's own."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.collect_set(F.substring("o_orderpriority", 1, 1)).alias("own"))
    return o.select("key", (F.size(F.array_except(F.array(F.lit("1"), F.lit("5")), "own")) == 0).alias("whole"))


@query(f"""
WITH {SCORES}, {_WINDOWS}, k AS (SELECT s.series, s.run, s.tick, s.score, coalesce(max(w), -1) AS w FROM scores s LEFT JOIN windows k ON s.run = k.run AND s.tick >= start AND s.tick < stop GROUP BY s.series, s.run, s.tick, s.score),
kinds AS (SELECT DISTINCT run, CASE WHEN run % 8 = 0 THEN 'box' ELSE 'glare' END AS kind FROM windows),
grp AS (SELECT run, 'total' AS kind FROM (SELECT DISTINCT run FROM scores) UNION ALL SELECT run, kind FROM kinds UNION ALL SELECT run, kind FROM (SELECT DISTINCT run FROM scores WHERE run NOT IN (SELECT run FROM kinds)), (SELECT DISTINCT kind FROM kinds)),
p AS (SELECT series, kind, avg(hit) AS tpr, count(*) AS n_windows FROM (SELECT series, run, w, CASE WHEN max(score) > 150 THEN 1.0 ELSE 0.0 END AS hit FROM k WHERE w >= 0 GROUP BY series, run, w) JOIN grp USING (run) GROUP BY series, kind),
f AS (SELECT series, kind, avg(CASE WHEN score > 150 THEN 1.0 ELSE 0.0 END) AS fpr, count(*) AS n_outside FROM k JOIN grp USING (run) WHERE w < 0 GROUP BY series, kind)
SELECT series, kind, round(tpr, 6) AS tpr, n_windows, round(fpr, 6) AS fpr, n_outside, round(1 - fpr, 6) AS tnr, round((tpr + 1 - fpr) / 2, 6) AS balanced FROM p JOIN f USING (series, kind)
""")
def p08_metrics_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series' detection rates over all runs and by kind; runs without a window count in every kind."""
    windows = _windows(spark, sf_dir)
    rows = evaluation.window_of(scores(spark, sf_dir).select("series", "run", "tick", "score"), windows)
    kinds = windows.select("run", F.when(F.col("run") % 8 == 0, "box").otherwise("glare").alias("kind")).distinct()
    m = evaluation.metrics_by_kind(rows, kinds, 150.0)
    return m.select(*(r6(c).alias(c) if c in ("tpr", "fpr", "tnr", "balanced") else c for c in m.columns))


@query(f"""
WITH {SCORES}, {_WINDOWS}, n AS (SELECT run, count(*) AS n FROM scores GROUP BY run), w AS (SELECT run, string_agg(start || '-' || stop, ',' ORDER BY start, stop) AS w FROM windows GROUP BY run)
SELECT n.run, 'k' || n.run % 5 AS kind, CASE WHEN n.run % 3 = 0 THEN 'pool' ELSE 'test' END AS role, n, coalesce(w, '') AS windows FROM n LEFT JOIN w ON n.run = w.run WHERE n.run % 3 <> 1
""")
def v3_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of a pool and those of none, with their frames and anomaly windows."""
    s = scores(spark, sf_dir)
    run = F.col("run")
    pools = F.when(run % 3 == 0, F.array(F.lit("a"))).when(run % 3 == 1, F.array(F.lit("b"))).otherwise(F.array().cast("array<string>"))
    plans = s.select("run").distinct().select("run", F.concat(F.lit("k"), (run % 5).cast("string")).alias("kind"), pools.alias("pools"))
    found = evaluation.run_index(plans, s, _windows(spark, sf_dir), "a")
    shown = F.transform("windows", lambda w: F.concat_ws("-", w["start"].cast("string"), w["stop"].cast("string")))
    return found.select("run", "kind", "role", "n", F.array_join(shown, ",").alias("windows"))


@query("""
WITH b AS (SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) // 3 AS INT) AS t, event_id % 6 AS id, event_type AS object, CASE WHEN value > 100 THEN 'near' ELSE 'far' END AS predicate FROM events),
r AS (SELECT run, t, string_agg(DISTINCT object || ' ' || predicate, '|' ORDER BY object || ' ' || predicate) AS recorded FROM b GROUP BY run, t),
e AS (SELECT DISTINCT run, t, CASE WHEN id = 1 THEN 'lorry' ELSE object END || ' ' || predicate AS c FROM b WHERE NOT (id = 3 AND run % 2 = 0)),
p AS (SELECT r.run, r.t, recorded, coalesce(c, '') AS corrected, coalesce(prompt, 'nothing in particular') AS prompt FROM r LEFT JOIN (SELECT run, t, string_agg(c, '|' ORDER BY c) AS c, string_agg('a ' || c, ', ' ORDER BY c) AS prompt FROM e GROUP BY run, t) x ON r.run = x.run AND r.t = x.t),
n AS (SELECT prompt, count(*) AS same_prompt FROM p WHERE run <= 30 GROUP BY prompt)
SELECT run, t, recorded, corrected, p.prompt, coalesce(same_prompt, 0) AS same_prompt FROM p LEFT JOIN n ON p.prompt = n.prompt
""")
def v4_label_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's labels as recorded and as corrected, and how many frames of the pool have the same prompt."""
    from pyspark.sql.window import Window

    t = F.floor(F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) / 3).cast("int")
    base = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), t.alias("t"), (F.col("event_id") % 6).alias("id"), F.col("event_type").alias("object"), F.when(F.col("value") > 100, "near").otherwise("far").alias("predicate"))
    tracks = base.select("run", "id").distinct().where("id = 1 or id = 3 and run % 2 = 0").select("run", "id", F.when(F.col("id") == 1, "lorry").alias("object"), F.lit(None).cast("string").alias("predicate"), (F.col("id") == 3).alias("drop"))
    none = base.select("run", "t", "id", "object", "predicate", F.lit(False).alias("drop")).limit(0)
    corrected = concepts.effective(base, tracks, none, base.select("run", "t", "object", "predicate").limit(0))
    found = concepts.label_view(base, corrected, list(range(31)))
    return found.select("run", "t", F.array_join("recorded", "|").alias("recorded"), F.array_join("corrected", "|").alias("corrected"), "prompt", "same_prompt")


@query("""
WITH i AS (SELECT s_suppkey AS name, s_suppkey * 37 % 100 AS made FROM supplier WHERE s_suppkey % 5 <> 0), s AS (SELECT s_suppkey AS name, s_suppkey * 53 % 100 AS changed FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT i.name FROM i LEFT JOIN s ON i.name = s.name WHERE changed IS NULL OR made < changed
""")
def v3_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of an index that are older than what they were made from."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"))
    return evaluation.stale(s.where("name % 5 <> 0").withColumn("made", F.col("name") * 37 % 100), s.where("name % 7 <> 0").withColumn("changed", F.col("name") * 53 % 100))


@query(f"""
WITH {FRAMES}, t AS (SELECT id, [v[1:16], v[17:32], v[33:48], v[49:64]] AS t, [id % 2, 1, CAST(id % 3 = 0 AS INT), id % 5 % 2] AS m, id % 4 AS pad FROM frames),
k AS (SELECT id, t, CASE WHEN pad = 0 THEN [0, 0, 0, 0] ELSE m END AS m FROM t)
SELECT id, round(t[2][3], 6) AS layer18, round(list_sum(list_transform(range(1, 5), lambda i: t[i][5] * m[i])) / greatest(list_sum(m), 1), 6) AS masked,
    round(CASE WHEN m[4] = 1 THEN t[4][1] WHEN m[3] = 1 THEN t[3][1] WHEN m[2] = 1 THEN t[2][1] WHEN m[1] = 1 THEN t[1][1] END, 6) AS last,
    round(CASE WHEN list_sum(m) > 0 THEN list_sum(list_transform(range(1, 5), lambda i: t[i][7] * m[i])) / list_sum(m) ELSE -1.0 END, 6) AS weighted FROM k
""")
def a09_pooled_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer by its name, the masked mean, the last token, and a weighted mean with a fallback."""
    i = F.col("id")
    mask = F.array(i % 2, F.lit(1).cast("bigint"), (i % 3 == 0).cast("bigint"), i % 5 % 2)
    f = frames(spark, sf_dir).select("id", F.array(*(F.slice("v", 1 + 16 * k, 16) for k in range(4))).alias("t"), F.when(i % 4 == 0, F.array_repeat(F.lit(0).cast("bigint"), 4)).otherwise(mask).alias("m"))
    names = F.array(*(F.lit(x) for x in (9, 18, 27, 36)))
    t, m = F.col("t"), F.col("m")
    weighted = vec.mean_or(t, F.transform(m, lambda x: x.cast("double")), F.array_repeat(F.lit(-1.0), 16))
    return f.select("id", r6(vec.layer(t, names, 18)[2]).alias("layer18"), r6(vec.masked_mean(t, m)[4]).alias("masked"), r6(vec.last_token(t, m)[0]).alias("last"), r6(weighted[6]).alias("weighted"))


@query(f"""
WITH {FRAMES}, {_MOMENTS}, st AS (SELECT run, tick, id, list_transform(range(1, 65), lambda i: (v[i] - mu[i]) / sigma[i]) AS v FROM frames, m),
p AS (SELECT 'cosine' AS series, q.run, q.tick, q.id, r.id AS r_id, {_COS} AS d FROM unit q JOIN unit r ON {_AWAY} UNION ALL SELECT 'std_euclidean', q.run, q.tick, q.id, r.id, list_distance(q.v, r.v) FROM st q JOIN st r ON {_AWAY}),
b AS (SELECT *, row_number() OVER (PARTITION BY series, id ORDER BY d, r_id) AS n FROM p)
SELECT series, run, tick, round(avg(d), 6) AS score FROM b WHERE n <= {K} GROUP BY series, run, tick UNION ALL SELECT 'raw', run, tick, round(v[1], 6) FROM frames WHERE run > 5
""")
def u_scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorers that a configuration names, each as a series."""
    f = frames(spark, sf_dir)
    found = scorers.scored(f.where("run > 5"), knn.pool_of(f, POOL), {"metrics": ["cosine", "std_euclidean", "raw"], "k": K})
    return found.select("series", "run", "tick", r6("score").alias("score"))


@query(f"""
WITH {FRAMES}, long AS (SELECT id, unnest(range(1, 65)) AS i, unnest(v) AS x FROM unit WHERE run <= 5), c AS (SELECT a.i, b.i AS j, covar_samp(a.x, b.x) AS c FROM long a JOIN long b USING (id) GROUP BY a.i, b.i),
s AS (SELECT sum(t * t) AS t2 FROM (SELECT sum(x) AS t FROM long GROUP BY i)), n AS (SELECT count(*) AS n FROM unit WHERE run <= 5)
SELECT round((SELECT sum(c) FROM c WHERE i = j) ** 2 / (SELECT sum(c * c) FROM c), 4) AS participation, round(1 - (t2 - n) / (n * (n - 1)), 6) AS mean_distance FROM s, n
""")
def g26_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many directions the pool spreads, and the mean distance of its pairs."""
    pool = knn.pool_of(knn.unit_frames(frames(spark, sf_dir)), POOL)
    found = density.spread(pool)
    return spark.createDataFrame([(round(found["participation"], 4), round(found["mean_distance"], 6))], "participation double, mean_distance double")


@query(f"""
WITH {FRAMES}, p AS (SELECT row_number() OVER (ORDER BY id) - 1 AS at, v, count(*) OVER () AS n FROM unit WHERE run <= 5),
t AS (SELECT i AS pair, (i * 7919 + 13) % n AS i, (i * 104729 + i // 3 + 71) % n AS j FROM range(5000) r(i), (SELECT any_value(n) AS n FROM p)),
d AS (SELECT 1 - list_dot_product(a.v, b.v) AS d FROM t JOIN p a ON a.at = t.i JOIN p b ON b.at = t.j WHERE t.i <> t.j)
SELECT count(*) AS pairs, round(avg(d), 6) AS mean_distance, round(quantile_cont(d, 0.5), 6) AS median_distance FROM d
""")
def g26_random_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and median distance of drawn pairs of the pool."""
    pool = knn.pool_of(knn.unit_frames(frames(spark, sf_dir)), POOL)
    d = density.random_pairs(pool, 5000)
    median = conformal.quantile_linear(d, [], 0.5, value="d", name="median_distance")
    return d.agg(F.count("*").alias("pairs"), r6(F.avg("d")).alias("mean_distance")).crossJoin(median).select("pairs", "mean_distance", r6("median_distance").alias("median_distance"))  # a row each


@query()
def g26_top_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many directions the pool spreads in, and the share of the first two; held against NumPy in the tests."""
    found = density.spread(knn.pool_of(knn.unit_frames(frames(spark, sf_dir)), POOL))
    return spark.createDataFrame([(round(found["participation"], 6), round(found["top2"], 6))], "participation double, top2 double")


@query()
def p13_pca_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames on the pool's first two principal components; held against NumPy in the tests."""
    f = knn.unit_frames(frames(spark, sf_dir))
    return density.projected(f, knn.pool_of(f, POOL)).select("run", "tick", r6(F.col("v")[0]).alias("x"), r6(F.col("v")[1]).alias("y"))


@query(f"""
WITH {STATES}, {AGENTS}, {_REL}, {_TURNS}, ends AS (SELECT run, count(*) + 1 AS n FROM states GROUP BY run),
a AS (SELECT s.run, s.tick, coalesce((SELECT min(start) FROM turns t WHERE t.run = s.run AND t.start > s.tick), n) - s.tick AS ahead FROM states s JOIN ends e ON s.run = e.run WHERE s.tick >= 5 AND sqrt(vx * vx + vy * vy) >= 3),
near AS (SELECT run, tick, agent, rel_yaw, rel_x + 18 AS rel_x, rel_y + 1 AS rel_y FROM rel),
c AS (SELECT rel.run, rel.tick, agent, abs(rel_y) * 3 + abs(rel_x - 12.5) AS score FROM near rel JOIN a ON rel.run = a.run AND rel.tick = a.tick WHERE ahead >= 3 AND cos(rel_yaw) >= 0.7 AND rel_x > 5 AND rel_x < 20 AND abs(rel_y) < 2)
SELECT run, tick, agent, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score, tick, agent) AS i FROM c) WHERE i = 1
""")
def w06_best_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all ticks and agents of a run, the one best placed ahead in the ego's lane on a straight drive."""
    s = states(spark, sf_dir)
    ends = s.groupBy("run").agg((F.count("*") + 1).cast("int").alias("n"))
    ahead = kinematics.ticks_to_next(s.select("run", "tick"), kinematics.turns(s, step=0.42), ends)
    rel = kinematics.relative(s, agents(spark, sf_dir)).withColumns({"rel_x": F.col("rel_x") + 18, "rel_y": F.col("rel_y") + 1})  # agents that fit
    return kinematics.best_lead(s, rel, ahead, runway=3, floor=5).select("run", "tick", "agent", r6("score").alias("score"))


@query(f"""
WITH {STATES}, d AS (SELECT event_id, x AS px, y AS py, cos(yaw) AS dx, sin(yaw) AS dy, x + 10 AS qx, y + 6 AS qy, cos(yaw + 1.2::DOUBLE) AS ex, sin(yaw + 1.2::DOUBLE) AS ey FROM states),
m AS (SELECT *, ((qx - px) * ey - (qy - py) * ex) / (dx * ey - dy * ex) AS t, 4.0 * tan(acos(dx * ex + dy * ey) / 2) AS reach FROM d), c AS (SELECT *, px + dx * t AS mx, py + dy * t AS my FROM m)
SELECT event_id, CAST(i AS INT) AS i, round((1 - i / 24) ** 2 * (mx - reach * dx) + 2 * (1 - i / 24) * (i / 24) * mx + (i / 24) ** 2 * (mx + reach * ex), 5) AS x,
    round((1 - i / 24) ** 2 * (my - reach * dy) + 2 * (1 - i / 24) * (i / 24) * my + (i / 24) ** 2 * (my + reach * ey), 5) AS y FROM c, range(0, 25) r(i)
""")
def e17_turn_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 points of the smooth turn from each state's heading into one 1.2 rad to its right."""
    s, yaw = states(spark, sf_dir), F.col("yaw")
    controls = g.fillet_controls(F.col("x"), F.col("y"), F.cos(yaw), F.sin(yaw), F.col("x") + 10, F.col("y") + 6, F.cos(yaw + 1.2), F.sin(yaw + 1.2), 4.0)
    return s.select("event_id", controls.alias("c")).select("event_id", F.posexplode(g.curve(F.col("c"))).alias("i", "p")).select("event_id", "i", F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))


@query("""
WITH f AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'here' ELSE 'there' END AS cache, CASE WHEN o_orderkey % 5 = 0 THEN 'odd' ELSE 'nominal' END AS grp, o_custkey AS idx FROM orders),
n AS (SELECT c_custkey AS idx, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer)
SELECT id, coalesce(CASE WHEN cache = 'here' AND grp = 'nominal' THEN position END, -1) AS excluded FROM f LEFT JOIN n ON f.idx = n.idx
""")
def j13_source_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of the nominal frame that a frame was made from, -1 if none."""
    key = F.col("o_orderkey")
    src = F.when(key % 3 != 0, F.struct(F.when(key % 3 == 1, "here").otherwise("there").alias("cache"), F.when(key % 5 == 0, "odd").otherwise("nominal").alias("group"), F.col("o_custkey").alias("idx")))
    nominal = conformal.ranks(table(spark, sf_dir, "customer").select("c_custkey"), [], "c_custkey").select(F.col("c_custkey").alias("idx"), (F.col("_lo") - 1).cast("bigint").alias("position"))
    return snapshot.source_positions(table(spark, sf_dir, "orders").select(key.alias("id"), src.alias("src")), nominal, "here").select("id", "excluded")


_ALARMS = f"{{head}} {SCORES}, f AS (SELECT series, run, avg(CASE WHEN score > 150 THEN 1.0 ELSE 0.0 END) > 0.2 AS flagged FROM scores GROUP BY series, run)"


@query(f"{_ALARMS.format(head='WITH')} SELECT 'all' AS rule, series, round(avg(CASE WHEN flagged THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) AS n FROM f GROUP BY series UNION ALL SELECT 'first', series, CASE WHEN flagged THEN 1.0 ELSE 0.0 END, 1 FROM f WHERE run = (SELECT min(run) FROM scores)")
def p06_false_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False alarms over all runs without an anomaly, and of the first one alone."""
    s = scores(spark, sf_dir)
    flagged = s.groupBy("series", "run").agg((F.avg((F.col("score") > 150).cast("double")) > 0.2).alias("flagged"))
    first = s.agg(F.min("run")).first()[0]
    both = evaluation.false_alarms(flagged).withColumn("rule", F.lit("all")).unionByName(evaluation.false_alarms(flagged, first).withColumn("rule", F.lit("first")))
    return both.select("rule", "series", r6("rate").alias("rate"), "n")
