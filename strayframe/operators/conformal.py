"""Order statistics, conformal thresholds and run decisions over (series, run, tick, score) rows.

A null score is no score. All decisions are strictly above the threshold.

Ranks come from counts: rows are first summed up to distinct values of a group, values are dealt into ranges by approximate
quantiles, and only the ranges' totals are added up along the group. So no group is sorted in one task, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges of values that a group is dealt into.
RANGES = 200


def cumulative(rows: DataFrame, keys: list[str], value: str, sums: dict[str, Column], running: list[str] | None = None) -> DataFrame:
    """keys, value, ``sums`` by value, _range, and for each of ``running`` (all sums) x: x_upto, added up over the group's values up to
    this one, and x_all, over the whole group."""
    running = list(sums) if running is None else running
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*(c.alias(k) for k, c in sums.items()))
    at = F.array(*(F.lit(k / RANGES) for k in range(1, RANGES)))
    bounds = counted.agg(F.array_sort(F.array_distinct(F.percentile_approx(F.col(value).cast("double"), at, F.lit(10_000)))).alias("_bounds"))
    dealt = counted.crossJoin(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col(value)))).drop("_bounds")  # one row
    totals = dealt.groupBy(*keys, "_range").agg(*(F.sum(x).alias(f"_sum{i}") for i, x in enumerate(running)))
    w = Window.partitionBy(*keys)
    for i, x in enumerate(running):
        totals = totals.withColumn(f"_before{i}", F.sum(f"_sum{i}").over(w.orderBy("_range")) - F.col(f"_sum{i}")).withColumn(f"{x}_all", F.sum(f"_sum{i}").over(w)).drop(f"_sum{i}")
    names = {k: f"_k{i}" for i, k in enumerate([*keys, "_range"])}
    same = [F.col(k).eqNullSafe(F.col(f"t.{v}")) for k, v in names.items()]
    found = dealt.join(totals.select(*(F.col(k).alias(v) for k, v in names.items()), *(c for c in totals.columns if c not in names)).alias("t"), same).drop(*names.values())
    inside = Window.partitionBy(*keys, "_range").orderBy(value)
    for i, x in enumerate(running):
        found = found.withColumn(f"{x}_upto", F.col(f"_before{i}") + F.sum(x).over(inside)).drop(f"_before{i}")
    return found


def ranks(rows: DataFrame, keys: list[str], value: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """keys, value, _n (rows of the value), _lo and _hi (first and last rank), _of (rows of the group), and ``sums`` by value."""
    found = cumulative(rows, keys, value, {"_n": F.count("*"), **(sums or {})}, ["_n"]).drop("_range")
    return found.withColumnRenamed("_n_all", "_of").withColumnRenamed("_n_upto", "_hi").withColumn("_lo", F.col("_hi") - F.col("_n") + 1)


def quantiles_higher(rows: DataFrame, keys: list[str], steps: int, value: str = "score") -> DataFrame:
    """keys, p, q: for p = 0, 100 / steps, ..., 100 the value at place ceil(p / 100 (n - 1)), counted from 0. All from one ranking: a value
    tells by its ranks which p it answers."""
    p = lambda i: i * (100.0 / steps) / 100
    around = lambda rank: rank * F.lit(float(steps)) / F.greatest(F.col("_of") - 1, F.lit(1))
    first, last = F.greatest(F.floor(around(F.col("_lo") - 2)) - 1, F.lit(0)), F.least(F.ceil(around(F.col("_hi") - 1)) + 1, F.lit(steps))
    last = F.when(F.col("_of") == 1, steps).otherwise(last)
    place = lambda i: F.ceil(p(i) * (F.col("_of") - 1)) + 1
    near = F.filter(F.sequence(first.cast("int"), last.cast("int")), lambda i: (F.col("_lo") <= place(i)) & (place(i) <= F.col("_hi")))
    return ranks(rows, keys, value).select(*keys, F.col(value).alias("q"), F.explode(near).alias("_i")).select(*keys, (F.col("_i") * (100.0 / steps)).alias("p"), "q")


def _at(ranked: DataFrame, rank: Column) -> DataFrame:
    return ranked.withColumn("_rank", rank).where((F.col("_lo") <= F.col("_rank")) & (F.col("_rank") <= F.col("_hi")))


def order_stat(rows: DataFrame, keys: list[str], q: float, value: str = "score", name: str = "q_run") -> DataFrame:
    """The ceil(q n)-th smallest value of a group, between the first and the last."""
    at = F.least(F.greatest(F.ceil(F.lit(q) * F.col("_of")), F.lit(1)), F.col("_of"))
    return _at(ranks(rows, keys, value), at).select(*keys, F.col(value).alias(name))


def quantile_higher(rows: DataFrame, keys: list[str], q: float, value: str = "score", name: str = "q_run") -> DataFrame:
    """The value at place ceil(q (n - 1)), counted from 0."""
    return _at(ranks(rows, keys, value), F.ceil(F.lit(q) * (F.col("_of") - 1)) + 1).select(*keys, F.col(value).alias(name))


def quantile_linear(rows: DataFrame, keys: list[str], q: float, value: str = "score", name: str = "q_run") -> DataFrame:
    """The value at place q (n - 1), counted from 0, between two neighbours in proportion."""
    place = F.lit(q) * (F.col("_of") - 1)
    found = ranks(rows, keys, value).withColumn("_p", place)
    low, high = F.floor("_p") + 1, F.ceil("_p") + 1
    pick = lambda r: F.max(F.when((F.col("_lo") <= r) & (r <= F.col("_hi")), F.col(value)))
    both = found.groupBy(*keys).agg(pick(low).alias("_a"), pick(high).alias("_b"), F.first("_p").alias("_p"))
    return both.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_p") - F.floor("_p"))).alias(name))


def conformal_tau(rows: DataFrame, keys: list[str], alpha: float, value: str = "score", beyond: str = "infinite") -> DataFrame:
    """keys, tau, n, overflow: the value of rank ceil((n + 1)(1 - alpha)). Where n is too small for that rank, tau is
    infinite (``beyond`` = infinite) or the largest value (capped); overflow tells."""
    wanted = F.ceil((F.col("_of") + 1) * (1 - F.lit(alpha)))
    picked = _at(ranks(rows, keys, value), F.least(wanted, F.col("_of")))
    high = wanted > F.col("_of")
    tau = F.when(high, float("inf")).otherwise(F.col(value)) if beyond == "infinite" else F.col(value)
    return picked.select(*keys, tau.alias("tau"), F.col("_of").cast("bigint").alias("n"), high.alias("overflow"))


def loo_conformal(rows: DataFrame, keys: list[str], q: float, value: str = "score") -> DataFrame:
    """Adds tau_loo: the capped conformal threshold of the row's group without the row. One ranking serves all rows: it is the
    value at rank k = min(ceil(n q), n - 1) if the row lies above it, else the next one. Null for a row alone in its group."""
    k = F.least(F.ceil(F.col("_of") * F.lit(q)), F.col("_of") - 1)
    ranked = ranks(rows, keys, value).withColumn("_k", k)
    pick = lambda r: F.max(F.when((F.col("_lo") <= r) & (r <= F.col("_hi")), F.col(value)))
    both = ranked.groupBy(*keys).agg(pick(F.col("_k")).alias("_at"), pick(F.col("_k") + 1).alias("_next"), F.first("_k").alias("_k"))
    above = ranked.where(F.col("_lo") > F.col("_k")).groupBy(*keys).agg(F.min(value).alias("_first_above"))
    both = both.join(above, keys, "left")
    tau = F.when(F.col(value) >= F.col("_first_above"), F.col("_at")).otherwise(F.col("_next"))
    return rows.where(F.col(value).isNotNull()).join(both, keys).withColumn("tau_loo", tau).drop("_at", "_next", "_k", "_first_above")


def run_decision(rows: DataFrame, keys: list[str], tau: Column, q_run: Column) -> DataFrame:
    """keys, n_frames, q_run, flagged, frac_above, first_above. tau and q_run are columns of the rows."""
    scored = rows.where("score is not null").withColumn("_tau", tau).withColumn("_q", q_run)
    above = F.col("score") > F.col("_tau")
    return scored.groupBy(*keys).agg(
        F.count("*").alias("n_frames"), F.first("_q").alias("q_run"), (F.first("_q") > F.first("_tau")).alias("flagged"),
        F.avg(above.cast("double")).alias("frac_above"), F.min(F.when(above, F.col("tick"))).alias("first_above"),
    )
