"""Instances named by number, by place or by tag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import places
from ..sources.tables import table
from .registry import query

_HOLDS = """abs((p.x - b.x) * cos(radians(b.yaw)) + (p.y - b.y) * sin(radians(b.yaw))) <= b.ex + 1 AND abs(-(p.x - b.x) * sin(radians(b.yaw)) + (p.y - b.y) * cos(radians(b.yaw))) <= b.ey + 1 AND abs(p.z - b.z) <= b.ez + 1"""


@query(f"""
WITH a AS (SELECT l_suppkey AS id, l_orderkey AS t, 'tag ' || l_partkey % 5 AS tag, l_orderkey * 7 % 1009 * 0.37::DOUBLE AS fx, l_partkey * 11 % 907 * 0.41::DOUBLE AS fy, l_suppkey % 5 * 0.5::DOUBLE AS fz FROM lineitem WHERE l_linenumber = 1),
act AS (SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 3 = 0),
b AS (SELECT p_partkey AS box, p_name AS name, p_partkey * 13 % 401 * 0.93::DOUBLE AS x, p_partkey * 29 % 397 * 0.94::DOUBLE AS y, p_size % 4 * 0.6::DOUBLE AS z, CASE WHEN p_partkey % 40 = 0 THEN 30.0 ELSE 0.3 END + p_size * 0.05::DOUBLE AS ex, 0.2::DOUBLE + p_size % 7 * 0.3::DOUBLE AS ey, 0.5::DOUBLE + p_size % 3 * 0.4::DOUBLE AS ez, p_partkey % 180 * 1.0::DOUBLE AS yaw FROM part),
q AS (SELECT t, 0 AS k, fx AS x, fy AS y, fz AS z FROM a WHERE id NOT IN (SELECT id FROM act) UNION ALL SELECT t, 1, fx + 1.5, fy - 1.25, fz + 0.5 FROM a WHERE id NOT IN (SELECT id FROM act)),
h AS (SELECT t, b.name, row_number() OVER (PARTITION BY t ORDER BY k, ex * ey * ez, box) AS n FROM q p JOIN b ON {_HOLDS})
SELECT a.t, coalesce(act.name, h.name, tag) AS object, CASE WHEN act.name IS NOT NULL THEN 'actor' WHEN h.name IS NOT NULL THEN 'place' ELSE 'tag' END AS src FROM a LEFT JOIN act USING (id) LEFT JOIN h ON h.t = a.t AND n = 1
""")
def j10_spatial_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances whose number no actor has are named by the smallest box around their foot, else around their middle, else by tag."""
    i = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    foot = (F.col("l_orderkey") * 7 % 1009 * 0.37, F.col("l_partkey") * 11 % 907 * 0.41, F.col("l_suppkey") % 5 * 0.5)
    at = lambda dx, dy, dz: F.struct((foot[0] + dx).alias("x"), (foot[1] + dy).alias("y"), (foot[2] + dz).alias("z"))
    instances = i.select(F.col("l_orderkey").alias("t"), F.col("l_suppkey").alias("id"), F.concat(F.lit("tag "), F.col("l_partkey") % 5).alias("tag"), at(0.0, 0.0, 0.0).alias("foot"), at(1.5, -1.25, 0.5).alias("middle"))
    actors = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    p, size = F.col("p_partkey"), F.col("p_size")
    boxes = table(spark, sf_dir, "part").select(
        p.alias("box"), F.col("p_name").alias("name"), (p * 13 % 401 * 0.93).alias("x"), (p * 29 % 397 * 0.94).alias("y"), (size % 4 * 0.6).alias("z"),
        (F.when(p % 40 == 0, 30.0).otherwise(0.3) + size * 0.05).alias("ex"), (0.2 + size % 7 * 0.3).alias("ey"), (0.5 + size % 3 * 0.4).alias("ez"), (p % 180 * 1.0).alias("yaw"),
    )
    return places.named_instances(instances, actors, boxes, ["t"])
