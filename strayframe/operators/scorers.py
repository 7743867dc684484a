"""The scorers by name: what an encoder's configuration asks for, dispatched to the operators.

A scorer is a function of (query, pool, params) with frames (run, tick, id, v) and a pool (r_run, r_tick, r_id, r), which gives
run, tick, score. Others register their own with :func:`scorer`."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from . import density, knn

Scorer = Callable[[DataFrame, DataFrame, dict], DataFrame]
SCORERS: dict[str, Scorer] = {}


def scorer(name: str) -> Callable[[Scorer], Scorer]:
    def add(f: Scorer) -> Scorer:
        SCORERS[name] = f
        return f

    return add


@scorer("cosine")
def cosine(query: DataFrame, pool: DataFrame, params: dict) -> DataFrame:
    k = params.get("k", 5)
    return knn.mean_distance(knn.nearest(knn.unit_frames(query), pool.withColumn("r", vec.unit("r")), k, "cosine"), k)


@scorer("std_euclidean")
def std_euclidean(query: DataFrame, pool: DataFrame, params: dict) -> DataFrame:
    k, of = params.get("k", 5), knn.moments(pool)
    return knn.mean_distance(knn.nearest(knn.standardised(query, "v", of), knn.standardised(pool, "r", of), k, "euclidean"), k)


@scorer("mahalanobis")
def mahalanobis(query: DataFrame, pool: DataFrame, params: dict) -> DataFrame:
    return density.mahalanobis(query, pool, params.get("k", 5))


@scorer("pca_whiten")
def pca_whiten(query: DataFrame, pool: DataFrame, params: dict) -> DataFrame:
    return density.pca_whitened(query, pool, params.get("k", 5), params.get("components", 64))


@scorer("centred_cosine")
def centred_cosine(query: DataFrame, pool: DataFrame, params: dict) -> DataFrame:
    of = knn.moments(pool)
    return cosine(knn.centred(query, "v", of), knn.centred(pool, "r", of), params)


@scorer("kl_mean")
def kl_mean(query: DataFrame, pool: DataFrame, params: dict) -> DataFrame:
    mean = knn.moments(pool.withColumn("r", vec.shares("r"))).select("mu")
    return query.withColumn("v", vec.shares("v")).crossJoin(F.broadcast(mean)).select("run", "tick", vec.kl("v", "mu").alias("score"))  # one row


@scorer("kl_knn")
def kl_knn(query: DataFrame, pool: DataFrame, params: dict) -> DataFrame:
    k = params.get("k", 5)
    return knn.mean_distance(knn.nearest(query.withColumn("v", vec.shares("v")), pool.withColumn("r", vec.shares("r")), k, "kl"), k)


@scorer("to_mean")
def to_mean(query: DataFrame, pool: DataFrame, params: dict) -> DataFrame:
    return density.to_mean(query, pool)


@scorer("raw")
def raw(query: DataFrame, pool: DataFrame, params: dict) -> DataFrame:
    return query.select("run", "tick", F.element_at("v", params.get("at", 0) + 1).alias("score"))


def scored(query: DataFrame, pool: DataFrame, params: dict) -> DataFrame:
    """series, run, tick, score of each metric that an encoder's parameters name."""
    metrics = params.get("metrics") or [params.get("metric", "cosine")]
    unknown = [m for m in metrics if m not in SCORERS]
    if unknown:
        raise ValueError(f"no scorer {unknown[0]}; there are {', '.join(sorted(SCORERS))}")
    parts = [SCORERS[m](query, pool, params).select(F.lit(m).alias("series"), "run", "tick", "score") for m in metrics]
    return reduce(DataFrame.unionByName, parts)
