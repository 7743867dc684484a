"""Checks of recorded runs, splits into roles, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def run_status(runs: DataFrame, expected: int) -> DataFrame:
    """Adds status (ok, failed, or null for a run that was not recorded) and problems. runs: n_frames, n_states, n_agents, success."""
    problems = F.concat_ws(
        "; ", F.when(F.col("n_frames") != expected, F.concat(F.lit("frames "), F.col("n_frames"))), F.when(F.col("n_states") != expected, F.concat(F.lit("states "), F.col("n_states"))),
        F.when(F.col("n_agents") == 0, "no agents"), F.when(~F.col("success"), "no success"),
    )
    return runs.withColumn("problems", F.when(F.col("n_frames").isNotNull(), problems)).withColumn("status", F.when(F.col("problems") == "", "ok").when(F.col("problems").isNotNull(), "failed"))


def airborne(poses: DataFrame, degrees: float = 30.0, climb: float = 3.0) -> DataFrame:
    return poses.where((F.abs("roll") > degrees) | (F.abs("pitch") > degrees) | (F.col("vz") > climb))


def role_split(runs: DataFrame, group: Column, reference: int, calibration: int) -> DataFrame:
    """Adds role: by name within a group, the first runs are reference, the next calibration, the rest held out."""
    w = Window.partitionBy("_group").orderBy("run")
    n = F.row_number().over(w)
    return runs.withColumn("_group", group).withColumn("role", F.when(n <= reference, "reference").when(n <= reference + calibration, "calibration").otherwise("negative")).drop("_group")


def shortage(runs: DataFrame, quotas: DataFrame, keys: list[str]) -> DataFrame:
    """keys, wanted, have, missing: runs with status ok against quotas; a group without runs is there, too."""
    have = runs.where("status = 'ok'").groupBy(*keys).agg(F.count("*").alias("have"))
    joined = quotas.join(have, keys, "left").withColumn("have", F.coalesce("have", F.lit(0).cast("bigint")))
    return joined.withColumn("missing", F.greatest(F.col("wanted") - F.col("have"), F.lit(0)).cast("bigint"))
