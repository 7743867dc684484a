"""Readers for recorded runs. Every source has a declared schema; ticks come from the records and never from file order."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vec import number_or_null

AGENT = "struct<id: bigint, x: double, y: double, yaw: double, vx: double, vy: double>"
STATE_SCHEMA = f"run string, t double, ego {AGENT}, others array<{AGENT}>"
SNAPSHOT_SCHEMA = (
    "name string, plan struct<cache: string, group: string, idx: int, note: string, src: struct<cache: string, group: string, idx: int>>, "
    "history array<struct<tick: int, ego: struct<x: double, y: double, z: double, yaw: double, vx: double, vy: double>, others: array<struct<id: string, x: double, y: double, z: double, yaw: double, vx: double, vy: double, px: int, pred: string>>>>, "
    "agents map<string, struct<type: string, obj: string, bp: string>>, concepts array<string>, shift boolean"
)
INSTANCE_SCHEMA = "t int, instances array<struct<id: int, tag: string, px: int, box: array<int>, xyz: array<double>, lane: string, predicate: string, object: string, src: string, kerb: boolean>>"
TICK_SECONDS = 0.1


def _run_of() -> F.Column:
    """The folder that a file lies in."""
    return F.element_at(F.split(F.input_file_name(), "/"), -2)


def state_runs(spark: SparkSession, path: str) -> DataFrame:
    """run, tick, t, ego, others of ``<run>/states.jsonl`` files, or of files of many runs, whose lines name their run."""
    return spark.read.schema(STATE_SCHEMA).json(path).select(F.coalesce("run", _run_of()).alias("run"), F.round(F.col("t") / TICK_SECONDS).cast("int").alias("tick"), "t", "ego", "others")


def egos(runs: DataFrame) -> DataFrame:
    return runs.select("run", "tick", *(F.col(f"ego.{c}").alias(c) for c in ("x", "y", "yaw", "vx", "vy")))


def others(runs: DataFrame, metres: float = 60.0) -> DataFrame:
    """run, tick, agent, pose of the agents within a radius of the ego; filtered inside the array, before it is exploded."""
    near = F.filter("others", lambda o: F.pow(o["x"] - F.col("ego.x"), 2) + F.pow(o["y"] - F.col("ego.y"), 2) <= metres * metres)
    return runs.select("run", "tick", F.explode(near).alias("o")).select("run", "tick", F.col("o.id").alias("agent"), *(F.col(f"o.{c}").alias(c) for c in ("x", "y", "yaw", "vx", "vy")))


def instances(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(INSTANCE_SCHEMA).json(path)
    return rows.select(_run_of().alias("run"), "t", F.explode("instances").alias("i")).select("run", "t", "i.*")


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a file; ordered by plan.idx."""
    return spark.read.schema(SNAPSHOT_SCHEMA).option("multiLine", True).json(path)


def snapshot_lines(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots of files that hold one JSON document a line, of many frames and runs, which can be split."""
    return spark.read.schema(SNAPSHOT_SCHEMA).json(path)


def corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """run and the points (schema) of a written corpus."""
    return spark.read.schema(f"{schema}, run bigint").json(f"{path}/frames")


def role_configs(spark: SparkSession, path: str) -> DataFrame:
    """group, role, run of written role documents."""
    rows = spark.read.schema("group string, reference_runs array<string>, calibration_runs array<string>, negative_runs array<string>").json(path)
    listed = rows.select("group", F.explode(F.map_from_arrays(F.array(*(F.lit(r) for r in ("reference", "calibration", "negative"))), F.array("reference_runs", "calibration_runs", "negative_runs"))).alias("role", "runs"))
    return listed.select("group", "role", F.explode("runs").alias("run"))


def score_csv(spark: SparkSession, path: str, series: list[str]) -> DataFrame:
    """run, tick, series, score from wide score files; a blank is no score."""
    return _long_scores(_wide_scores(spark, path, "tick int", series).select(_run_of().alias("run"), "tick", *series), series)


def score_parts(spark: SparkSession, path: str, series: list[str]) -> DataFrame:
    """The same of files of many runs, whose rows name their run."""
    return _long_scores(_wide_scores(spark, path, "run string, tick int", series), series)


def _wide_scores(spark: SparkSession, path: str, keys: str, series: list[str]) -> DataFrame:
    return spark.read.schema(f"{keys}, " + ", ".join(f"`{s}` double" for s in series)).option("header", True).option("nullValue", "").csv(path)


def _long_scores(wide: DataFrame, series: list[str]) -> DataFrame:
    long = wide.unpivot(["run", "tick"], series, "series", "score")
    return long.withColumn("score", number_or_null("score"))


def npz(spark: SparkSession, path: str, dimensions_first: str = "embeddings") -> DataFrame:
    """run, tick, v of ``.npz`` files with ``embeddings`` (T, D) and ``ticks`` (T); without ticks rows count from 0. One file
    is decoded at a time."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import numpy as np

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    v = z[dimensions_first].astype(np.float64)
                    ticks = z["ticks"] if "ticks" in z.files else np.arange(len(v))
                    v = v.reshape(len(v), -1)
                    yield pd.DataFrame({"run": name.rsplit("/", 2)[-2], "tick": ticks.astype("int32"), "v": list(v)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "run string, tick int, v array<double>")


def calibration_cache(rows: DataFrame) -> DataFrame:
    """series, run_index, score from keys ``series::i`` (the series may hold "::" itself) and score arrays."""
    at = F.regexp_extract("key", r"^(.*)::(\d+)$", 1)
    i = F.regexp_extract("key", r"^(.*)::(\d+)$", 2)
    split = rows.withColumn("series", at).withColumn("run_index", F.when(i != "", i.cast("int")))
    bad = F.when(F.col("run_index").isNull(), F.raise_error(F.concat(F.lit("not a calibration key: "), F.col("key"))))
    return split.withColumn("run_index", F.coalesce("run_index", bad.cast("int"))).select("series", "run_index", F.explode("scores").alias("score"))


def checked_counts(frames: DataFrame, runs: DataFrame) -> DataFrame:
    """run, n for runs whose frames and states are as many; a run where they are not raises."""
    f, s = frames.groupBy("run").agg(F.count("*").alias("n")), runs.groupBy("run").agg(F.count("*").alias("n_states"))
    both = f.join(s, "run", "full")
    wrong = F.coalesce(F.col("n"), F.lit(-1)) != F.coalesce(F.col("n_states"), F.lit(-1))
    return both.withColumn("n", F.when(wrong, F.raise_error(F.concat(F.lit("frames and states differ in run "), F.col("run"))).cast("bigint")).otherwise(F.col("n"))).select("run", "n")


#: The data file of a configuration that names none.
DATA_FILE = "config/data.json"


def config(path: str, root: str | None = None) -> dict:
    """A configuration over the data file that it names (a path below ``root``, which is the folder above the
    configuration's); its own keys win. One that lists its runs itself needs no data file. Encoders are a list with
    ``<name>_params`` keys, or an object of parameters; the result has ``encoders`` as an object."""
    own = json.loads(Path(path).read_text())
    if "reference_runs" in own or "reference_run" in own:
        merged = own
    else:
        top = Path(root) if root else Path(path).resolve().parent.parent
        merged = json.loads((top / own.get("data", DATA_FILE)).read_text()) | own
    encoders = merged.get("encoders", {})
    if isinstance(encoders, list):
        encoders = {name: merged.get(f"{name}_params", {}) for name in encoders}
    return merged | {"encoders": encoders}


ROLES = ("reference", "anomaly", "negative", "calibration")


def run_roles(spark: SparkSession, merged: dict) -> DataFrame:
    """run, role, onset, until, type, kind of a configuration's run lists."""
    lists = {role: merged.get(f"{role}_runs", []) for role in ROLES}
    if not lists["reference"] and "reference_run" in merged:
        lists["reference"] = [merged["reference_run"]]  # older files name one run
    rows = [(r["run_name"], role, r.get("onset_tick"), r.get("offset_tick"), r.get("anomaly_type"), r.get("anomaly_kind")) for role, found in lists.items() for r in found]
    return spark.createDataFrame(rows, "run string, role string, onset int, until int, type string, kind string")


def evaluated(roles: DataFrame) -> DataFrame:
    return roles.where(F.col("role").isin("anomaly", "negative", "calibration"))


def series_names(encoders: dict) -> list[str]:
    """A series an encoder and metric: the encoder's name if it has one metric, else encoder/metric."""
    out = []
    for name, params in encoders.items():
        metrics = params.get("metrics") or [params.get("metric", "cosine")]
        out += [name] if len(metrics) == 1 else [f"{name}/{m}" for m in metrics]
    return out
