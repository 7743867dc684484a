"""Checks of runs, splits, quotas, files, set operations and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality
from ..sources import files, sinks
from ..sources.shared import shared_path
from ..sources.tables import SCORES, scores, table
from ..streaming import online
from .registry import query, r6

_RUNS = "runs AS (SELECT o_custkey AS run, count(*) AS n_frames, count(*) - CASE WHEN o_custkey % 6 = 0 THEN 1 ELSE 0 END AS n_states, count(*) FILTER (o_orderstatus <> 'F') AS n_agents, o_custkey % 5 <> 0 AS success FROM orders GROUP BY o_custkey)"
_STATUS = """
st AS (SELECT run, n_frames, concat_ws('; ', CASE WHEN n_frames <> 15 THEN 'frames ' || n_frames END, CASE WHEN n_states <> 15 THEN 'states ' || n_states END, CASE WHEN n_agents = 0 THEN 'no agents' END, CASE WHEN NOT success THEN 'no success' END) AS problems FROM runs)"""


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    runs = o.groupBy(F.col("o_custkey").alias("run")).agg(F.count("*").alias("n_frames"), F.count_if(F.col("o_orderstatus") != "F").alias("n_agents"))
    runs = runs.withColumn("n_states", F.col("n_frames") - F.when(F.col("run") % 6 == 0, 1).otherwise(0)).withColumn("success", F.col("run") % 5 != 0)
    return quality.run_status(runs, 15)


@query(f"WITH {_RUNS}, {_STATUS} SELECT run, problems, CASE WHEN problems = '' THEN 'ok' ELSE 'failed' END AS status FROM st")
def f11_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir).select("run", "problems", "status")


@query("""
WITH r AS (SELECT c_name AS run, c_mktsegment AS seg, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_name) AS i FROM customer) SELECT run, CASE WHEN i <= 2 THEN 'reference' WHEN i <= 3 THEN 'calibration' ELSE 'negative' END AS role FROM r
""")
def f13_role_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("run"), "c_mktsegment", "c_nationkey")
    return quality.role_split(c, F.struct("c_mktsegment", "c_nationkey"), 2, 1).select("run", "role")


@query("""
WITH r AS (SELECT c_name AS run, c_mktsegment AS "group", row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name) AS i FROM customer) SELECT "group", run, CASE WHEN i <= 5 THEN 'reference' WHEN i <= 8 THEN 'calibration' ELSE 'negative' END AS role FROM r
""")
def k7_role_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role documents, written and read back."""
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("run"), F.col("c_mktsegment").alias("group"))
    path = shared_path(spark, "roles")
    sinks.write_role_configs(quality.role_split(c, F.col("group"), 5, 3), path)
    return files.role_configs(spark, path).select("group", "run", "role")


@query(f"""
WITH {_RUNS}, {_STATUS}, h AS (SELECT run % 7 AS kind, count(*) AS have FROM st WHERE problems = '' GROUP BY run % 7), q AS (SELECT CAST(k AS BIGINT) AS kind, CAST(4 * k AS BIGINT) AS wanted FROM range(0, 9) t(k))
SELECT kind, wanted, coalesce(have, 0) AS have, CAST(greatest(wanted - coalesce(have, 0), 0) AS BIGINT) AS missing FROM q LEFT JOIN h USING (kind)
""")
def g27_shortage(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotas = spark.range(9).select(F.col("id").alias("kind"), (F.col("id") * 4).alias("wanted"))
    return quality.shortage(_status(spark, sf_dir).withColumn("kind", F.col("run") % 7), quotas, ["kind"])


@query("SELECT l_orderkey AS o, l_linenumber AS n FROM lineitem WHERE abs(l_quantity - 25) > 20 OR abs(l_tax * 1000 - 40) > 30 OR l_discount * 100 > 9.5")
def f12_airborne(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_quantity") - 25) * 1.5).alias("roll"), (F.col("l_tax") * 1000 - 40).alias("pitch"), (F.col("l_discount") * 100 - 6.5).alias("vz"))
    return quality.airborne(i).select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"))


@query(f"WITH {SCORES} SELECT CAST(run AS VARCHAR) AS run, tick, round(max(score) FILTER (series = 'click'), 6) AS click, round(max(score) FILTER (series = 'view'), 6) AS view FROM scores WHERE series IN ('click', 'view') GROUP BY run, tick")
def k1_score_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide CSV of whole runs, written and read again."""
    path = shared_path(spark, "csv")
    s = scores(spark, sf_dir).where(F.col("series").isin("click", "view"))
    sinks.write_wide_csv(s, path, ["click", "view"])
    back = files.score_parts(spark, path, ["click", "view"])
    wide = back.groupBy("run", "tick").pivot("series", ["click", "view"]).agg(F.first("score"))
    return wide.select("run", "tick", r6("click").alias("click"), r6("view").alias("view"))


@query(f"WITH {SCORES} SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN NULL ELSE round(score, 6) END AS score FROM scores")
def k3_finite_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infinite and NaN scores come back from JSON as null."""
    path = shared_path(spark, "json")
    odd = F.when(F.col("event_id") % 4 == 0, float("inf")).when(F.col("event_id") % 4 == 1, float("nan")).otherwise(F.col("score"))
    sinks.write_json(scores(spark, sf_dir).select("event_id", odd.alias("score")), path)
    return spark.read.schema("event_id bigint, score double").json(path).select("event_id", r6("score").alias("score"))


@query("SELECT CAST(label AS INT) AS run, count(*) AS n, round(sum(embedding[2]::DOUBLE), 5) AS total FROM embeddings WHERE label IN (2, 5) GROUP BY label")
def k2_embedding_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in folders by encoder and run; a reader of two runs opens two."""
    path = shared_path(spark, "embeddings")
    e = table(spark, sf_dir, "embeddings").select(F.lit("base").alias("encoder"), F.col("label").alias("run"), F.col("vec_id").alias("tick"), "embedding")
    sinks.write_embeddings(e, path)
    back = spark.read.parquet(path).where("encoder = 'base' and run in (2, 5)")
    return back.groupBy(F.col("run").cast("int").alias("run")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("embedding")[1].cast("double")), 5).alias("total"))


@query(f"WITH {SCORES}, c AS (SELECT series || '::' || run % 5 AS key, score FROM scores) SELECT split_part(key, '::', 1) AS series, CAST(split_part(key, '::', 2) AS INT) AS run_index, count(*) AS n, round(sum(score), 4) AS total FROM c GROUP BY key")
def s14_calibration_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged score arrays by "series::i" as rows."""
    cache = scores(spark, sf_dir).groupBy(F.concat_ws("::", "series", (F.col("run") % 5).cast("string")).alias("key"), "run").agg(F.collect_list("score").alias("scores"))
    return files.calibration_cache(cache).groupBy("series", "run_index").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


@query(f"WITH {SCORES} SELECT run, tick, event_id FROM scores WHERE (tick - 1) % 5 = 0")
def s05_strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).where("(tick - 1) % 5 = 0").select("run", "tick", "event_id")


@query("""
SELECT kind, v FROM (SELECT 'union' AS kind, unnest(list_distinct(list_concat(a, b))) AS v FROM s UNION ALL SELECT 'both', unnest(list_intersect(a, b)) FROM s UNION ALL SELECT 'first only', unnest(list_filter(a, lambda x: NOT list_contains(b, x))) FROM s)
""".replace("FROM s", "FROM (SELECT list(DISTINCT user_id) FILTER (event_type = 'error') AS a, list(DISTINCT user_id) FILTER (event_type = 'signup' AND value > 150) AS b FROM events)"))
def u_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and difference of the runs of two series."""
    s = scores(spark, sf_dir)
    a, b = s.where("series = 'error'").select("run").distinct(), s.where("series = 'signup' and score > 150").select("run").distinct()
    named = lambda df, k: df.select(F.lit(k).alias("kind"), F.col("run").alias("v"))
    return named(a.union(b).distinct(), "union").union(named(a.join(b, "run", "left_semi"), "both")).union(named(a.join(b, "run", "left_anti"), "first only"))


_STREAM = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as they come, the tick being the event's number within the input order of its run."""
    return spark.readStream.schema(_STREAM).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query(f"""
WITH {SCORES}, w AS (SELECT run, event_id, count(*) OVER h AS n, avg(score) OVER h AS m FROM scores WINDOW h AS (PARTITION BY run ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT run, CAST(event_id AS INT) AS tick, round(m, 6) AS mean FROM w WHERE n = 10
""")
def st2_rolling_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed state: the mean of a run's last ten scores, once there are ten."""
    rows = _stream(spark, sf_dir).select(F.col("user_id").alias("run"), F.col("event_id").cast("int").alias("tick"), F.col("value").alias("score"))
    return online.drained(online.rolling(rows, 10), shared_path(spark, "stream")).select("run", "tick", r6("mean").alias("mean"))


@query("""
WITH RECURSIVE f AS (SELECT user_id AS run, CAST(event_id AS INT) AS tick, value > 60 AS hot, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT run, CAST(0 AS BIGINT) AS i, -1 AS tick, 0 AS above, -1 AS quiet, false AS rings FROM (SELECT DISTINCT run FROM f)
    UNION ALL
    SELECT run, i, tick, CASE WHEN a >= 2 AND tick > quiet THEN 0 ELSE a END, CASE WHEN a >= 2 AND tick > quiet THEN tick + 5 ELSE quiet END, a >= 2 AND tick > quiet
    FROM (SELECT r.run, f.i, f.tick, quiet, CASE WHEN NOT coalesce(hot, false) THEN 0 WHEN f.tick = r.tick + 1 THEN above + 1 ELSE 1 END AS a FROM r JOIN f ON f.run = r.run AND f.i = r.i + 1))
SELECT run, tick FROM r WHERE rings
""")
def st4_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state machine by run: two scores above 60 in a row alarm, then it rests."""
    rows = _stream(spark, sf_dir).select(F.col("user_id").alias("run"), F.col("event_id").cast("int").alias("tick"), F.col("value").alias("score"))
    return online.drained(online.alarms(rows, 60.0, 2, 5), shared_path(spark, "stream"))
