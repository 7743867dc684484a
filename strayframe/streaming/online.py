"""Online operators: state by run, fed tick by tick.

The batch operators are the reference for these: over the same rows they give the same result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_of(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1) -> DataFrame:
    """Rows of Parquet files as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def rolling(rows: DataFrame, length: int) -> DataFrame:
    """run, tick, mean of the last ``length`` scores; nothing until there are as many. rows: run (bigint), tick (int), score. State
    holds ``length`` scores a run."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(frames)).sort_values("tick", kind="stable")
        ticks, means = [], []
        for tick, score in zip(pdf["tick"], pdf["score"], strict=True):
            past = [*past, float(score)][-length:]
            if len(past) == length:
                ticks.append(tick)
                means.append(sum(past) / length)
        state.update((past,))
        yield pd.DataFrame({"run": [key[0]] * len(ticks), "tick": pd.Series(ticks, dtype="int32"), "mean": pd.Series(means, dtype="float64")})

    return rows.groupBy("run").applyInPandasWithState(step, "run long, tick int, mean double", "past array<double>", "append", GroupStateTimeout.NoTimeout)


def alarms(rows: DataFrame, tau: float, hold: int, cooldown: int) -> DataFrame:
    """run, tick at which a score has been above tau for ``hold`` ticks in a row; then nothing for ``cooldown`` ticks. State is two
    numbers a run."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        above, quiet, last = state.get if state.exists else (0, -1, -1)
        pdf = pd.concat(list(frames)).sort_values("tick", kind="stable")
        out = []
        for tick, score in zip(pdf["tick"].tolist(), pdf["score"].tolist(), strict=True):
            hot = score is not None and score == score and score > tau
            above = (above + 1 if tick == last + 1 else 1) if hot else 0
            last = tick
            if above >= hold and tick > quiet:
                out.append(tick)
                above, quiet = 0, tick + cooldown
        state.update((above, quiet, last))
        yield pd.DataFrame({"run": [key[0]] * len(out), "tick": pd.Series(out, dtype="int32")})

    return rows.groupBy("run").applyInPandasWithState(step, "run long, tick int", "above int, quiet int, last int", "append", GroupStateTimeout.NoTimeout)


def matched(frames: DataFrame, states: DataFrame, seconds: int = 5) -> DataFrame:
    """Camera frames and states of the same tick, whichever comes first; what waits longer than ``seconds`` is dropped. Both have
    run, tick, ts."""
    a = frames.withWatermark("ts", f"{seconds} seconds").alias("a")
    b = states.select(F.col("run").alias("s_run"), F.col("tick").alias("s_tick"), F.col("ts").alias("s_ts"), *(c for c in states.columns if c not in ("run", "tick", "ts"))).withWatermark("s_ts", f"{seconds} seconds")
    near = (F.col("s_ts") >= F.col("ts") - F.expr(f"interval {seconds} seconds")) & (F.col("s_ts") <= F.col("ts") + F.expr(f"interval {seconds} seconds"))
    return a.join(b, (F.col("run") == F.col("s_run")) & (F.col("tick") == F.col("s_tick")) & near).drop("s_run", "s_tick", "s_ts")


def windowed(rows: DataFrame, width: str, late: str) -> DataFrame:
    """An extension: event-time windows with a watermark. start, series, n, mean."""
    w = rows.withWatermark("ts", late).groupBy(F.window("ts", width), "series").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
    return w.select(F.col("window.start").alias("start"), "series", "n", "mean")


def drained(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over what there is and read its output. path: a folder that driver and executors share."""
    spark = stream.sparkSession
    schema = stream.schema
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out")
