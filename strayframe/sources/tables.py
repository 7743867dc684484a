"""Recordings made of the driver's tables: frames of embeddings, ego states, agents, scores, labels. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FRAMES = """
frames AS (SELECT CAST(label AS INT) AS run, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INT) AS tick, vec_id AS id,
    CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
unit AS (SELECT run, tick, id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM frames)"""


def frames(spark: SparkSession, sf_dir: str, dimensions: int | None = None) -> DataFrame:
    """run, tick, id, v: a run is a label of ``embeddings``."""
    w = Window.partitionBy("label").orderBy("vec_id")
    v = vec.as_vector("embedding")
    v = v if dimensions is None else F.slice(v, 1, dimensions)
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("run"), F.row_number().over(w).alias("tick"), F.col("vec_id").alias("id"), v.alias("v"))


SCORES = """
scores AS (SELECT event_type AS series, user_id AS run, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS tick, value AS score FROM events)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, run, event_id, tick, score: event types as series, users as runs."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.col("user_id").alias("run"), "event_id", F.row_number().over(w).alias("tick"), F.col("value").alias("score"))


STATES = """
states AS (SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS tick, event_id,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 0.8::DOUBLE + (event_id % 3) * 0.1::DOUBLE AS x, (event_id % 7) * 0.3::DOUBLE AS y,
    (event_id % 13 - 6) * 0.05::DOUBLE AS yaw, 4.0::DOUBLE + (event_id % 11) * 0.5::DOUBLE AS vx, (event_id % 5) * 0.1::DOUBLE AS vy FROM events)"""


def states(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """run, tick, event_id, x, y, yaw, vx, vy of an ego vehicle, a user being a run. parts: into so many parts by run, whatever their size, as what
    is made of a few bytes may be much."""
    w = Window.partitionBy("run").orderBy("ts", "event_id")  # named first, so that rows count as dealt by run
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "ts", "event_id")
    e = (e.repartition(parts, "run") if parts else e).withColumn("tick", F.row_number().over(w)).drop("ts")
    i = F.col("event_id")
    return e.select("run", "tick", "event_id", (F.col("tick") * 0.8 + i % 3 * 0.1).alias("x"), (i % 7 * 0.3).alias("y"), ((i % 13 - 6) * 0.05).alias("yaw"), (4.0 + i % 11 * 0.5).alias("vx"), (i % 5 * 0.1).alias("vy"))


AGENTS = """
agents AS (SELECT run, tick, k AS agent, x + (k * 9.0::DOUBLE - 20.0::DOUBLE) + event_id % 3 AS x, y + (k * 1.7::DOUBLE - 4.0::DOUBLE) AS y, yaw + (k * 0.75::DOUBLE - 0.1::DOUBLE) AS yaw,
    CAST(event_id % (k + 3) AS DOUBLE) AS vx, k * 0.2::DOUBLE AS vy
    FROM states, (SELECT unnest(range(6)) AS k) WHERE (event_id + k) % 4 <> 0)"""


def agents_there(event_id: Column) -> Column:
    """The agents of a state's tick, in order."""
    return F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint")), lambda k: (event_id + k) % 4 != 0)


def agents(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """run, tick, agent, x, y, yaw, vx, vy: up to six agents around the ego, which come and go."""
    s = states(spark, sf_dir, parts).withColumn("agent", F.explode(agents_there(F.col("event_id"))))
    k, i = F.col("agent"), F.col("event_id")
    return s.select("run", "tick", "agent", (F.col("x") + (k * 9.0 - 20.0) + i % 3).alias("x"), (F.col("y") + (k * 1.7 - 4.0)).alias("y"), (F.col("yaw") + (k * 0.75 - 0.1)).alias("yaw"), (i % (k + 3)).cast("double").alias("vx"), (k * 0.2).alias("vy"))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, run, tick, id, test, window, v (unit): thirds of the labels as runs, the last six of them test runs from two sources."""
    w = Window.partitionBy("label", F.col("vec_id") % 3).orderBy("vec_id")
    rec = table(spark, sf_dir, "embeddings").select((F.col("label") * 3 + F.col("vec_id") % 3).cast("int").alias("run"), F.row_number().over(w).alias("tick"), F.col("vec_id").alias("id"), vec.as_vector("embedding").alias("v"))
    short = F.transform("v", lambda x, i: F.when(i >= 48, 0.0).otherwise(x))
    both = rec.select(F.lit("gt").alias("source"), "*").unionByName(rec.where("run >= 24").select(F.lit("owl").alias("source"), "run", "tick", "id", short.alias("v")))
    window = F.when((F.col("run") >= 24) & (F.expr("tick div 10") % 3 == 1), F.expr("tick div 30")).otherwise(-1).cast("int")
    return both.select("source", "run", "tick", "id", (F.col("run") >= 24).alias("test"), window.alias("window"), vec.unit("v").alias("v"))
