"""Detection metrics over scored frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .conformal import ranks


def auroc(rows: DataFrame, keys: list[str], score: str = "score", positive: str = "positive") -> DataFrame:
    """Mann-Whitney with ties as halves, from mid-ranks of distinct scores. Null without both classes."""
    ranked = ranks(rows, keys, score, {"_p": F.sum(F.col(positive).cast("bigint"))})
    n1, n = F.sum("_p"), F.sum("_n")
    area = F.try_divide(F.sum(F.col("_p") * (F.col("_lo") + F.col("_hi")) / 2) - n1 * (n1 + 1) / 2, n1 * (n - n1))
    return ranked.groupBy(*keys).agg(area.alias("auroc"), n1.alias("n_pos"), (n - n1).alias("n_neg"))


def auroc_same_tick(run: DataFrame, twin: DataFrame, keys: list[str]) -> DataFrame:
    """AUROC of a run's frames against the twin run's frames of the same ticks; one value only on both sides gives 0.5."""
    both = run.where("score is not null").join(twin.where("score is not null").withColumnRenamed("score", "twin"), [*keys, "tick"])
    long = both.select(*keys, F.col("score"), F.lit(True).alias("positive")).unionByName(both.select(*keys, F.col("twin").alias("score"), F.lit(False).alias("positive")))
    found = auroc(long, keys)
    values = long.groupBy(*keys).agg(F.count_distinct("score").alias("_v"))
    return found.join(values, keys).withColumn("auroc", F.when(F.col("_v") < 2, 0.5).otherwise(F.col("auroc"))).drop("_v")


def window_of(ticks: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds ``window``: the number of the last window [start, stop) around the tick, -1 outside. windows: run, window, start, stop."""
    own = windows.groupBy("run").agg(F.collect_list(F.struct("window", "start", "stop")).alias("_w"))  # a recording's windows
    around = F.filter("_w", lambda w: (F.col("tick") >= w["start"]) & (F.col("tick") < w["stop"]))
    last = F.array_max(F.transform(around, lambda w: w["window"]))
    return ticks.join(own, "run", "left").withColumn("window", F.coalesce(last, F.lit(-1))).select(*ticks.columns, "window")


def window_metrics(rows: DataFrame, tau: float) -> DataFrame:
    """rows: run, tick, score, window. tpr over windows (by their peak), fpr over frames outside, tnr, balanced."""
    peaks = rows.where("window >= 0").groupBy("run", "window").agg(F.max("score").alias("peak"))
    tpr = peaks.agg(F.avg((F.col("peak") > tau).cast("double")).alias("tpr"), F.count("*").alias("n_windows"))
    fpr = rows.where("window < 0 and score is not null").agg(F.avg((F.col("score") > tau).cast("double")).alias("fpr"), F.count("*").alias("n_outside"))
    return tpr.crossJoin(fpr).withColumn("tnr", 1 - F.col("fpr")).withColumn("balanced", (F.col("tpr") + F.col("tnr")) / 2)  # one row each


def window_rates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tpr, fpr, balanced, n_windows, n_outside: window metrics by keys, tau among them. rows: keys, run, window, score."""
    above = (F.col("score") > F.col("tau")).cast("int")
    peaks = rows.where("window >= 0").groupBy(*keys, "run", "window").agg(F.max(above).alias("hit")).groupBy(*keys).agg(F.count("*").alias("n_windows"), F.sum("hit").alias("hits"))
    outside = rows.where("window < 0 AND score IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n_outside"), F.sum(above).alias("alarms"))
    tpr, fpr = F.try_divide(F.col("hits"), F.col("n_windows")), F.try_divide(F.col("alarms"), F.col("n_outside"))
    both = peaks.join(outside, keys, "full").na.fill(0, ["n_windows", "hits", "n_outside", "alarms"])
    return both.select(*keys, tpr.alias("tpr"), fpr.alias("fpr"), ((tpr + 1 - fpr) / 2).alias("balanced"), "n_windows", "n_outside")


def metrics_by_kind(rows: DataFrame, kinds: DataFrame, tau: float | Column) -> DataFrame:
    """series, kind, tpr, n_windows, fpr, n_outside, tnr, balanced: window metrics of each series for all runs (``total``) and for
    each kind, which has its own runs and all runs without a kind. rows: series, run, tick, score, window; kinds: run, kind.
    Runs are counted once; groups add up counts, so a run in many groups costs no row of its own."""
    above = (F.col("score") > tau).cast("int")
    peaks = rows.where("window >= 0").groupBy("series", "run", "window").agg(F.max(above).alias("hit"))
    inside = peaks.groupBy("series", "run").agg(F.count("*").alias("w"), F.sum("hit").alias("wh"))
    outside = rows.where("window < 0 and score is not null").groupBy("series", "run").agg(F.count("*").alias("o"), F.sum(above).alias("oh"))
    runs = inside.join(outside, ["series", "run"], "full").na.fill(0).join(kinds, "run", "left")
    names = kinds.select("kind").distinct().agg(F.collect_list("kind").alias("all"))
    groups = F.concat(F.array(F.lit("total")), F.when(F.col("kind").isNull(), F.col("all")).otherwise(F.array("kind")))
    parts = runs.crossJoin(F.broadcast(names)).withColumn("group", F.explode(groups))  # one row of names; a row a run and series
    found = parts.groupBy("series", F.col("group").alias("kind")).agg(*(F.sum(c).alias(c) for c in ("w", "wh", "o", "oh")))
    tpr, fpr = F.try_divide(F.col("wh"), F.col("w")), F.try_divide(F.col("oh"), F.col("o"))
    return found.select("series", "kind", tpr.alias("tpr"), F.col("w").alias("n_windows"), fpr.alias("fpr"), F.col("o").alias("n_outside"), (1 - fpr).alias("tnr"), ((tpr + 1 - fpr) / 2).alias("balanced"))


def run_index(plans: DataFrame, frames: DataFrame, windows: DataFrame, pool: str) -> DataFrame:
    """run, kind, role (pool or test), n frames, windows: the recorded runs of a pool and those of none. plans: run, kind, pools;
    windows: run, window, start, stop."""
    n = frames.groupBy("run").agg(F.count("*").alias("n"))
    own = windows.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("windows"))
    mine = F.array_contains("pools", pool)
    listed = plans.where(mine | (F.size("pools") == 0)).join(n, "run").join(own, "run", "left")
    return listed.select("run", "kind", F.when(mine, "pool").otherwise("test").alias("role"), "n", F.coalesce("windows", F.array().cast(own.schema["windows"].dataType)).alias("windows"))


def stale(index: DataFrame, sources: DataFrame) -> DataFrame:
    """The entries of an index that were made before their source last changed, or whose source is gone. index: name, made;
    sources: name, changed."""
    joined = index.join(sources, "name", "left")
    return joined.where(F.col("changed").isNull() | (F.col("made") < F.col("changed"))).select("name")


def roc(rows: DataFrame, taus: DataFrame) -> DataFrame:
    """(tau, tpr, fpr) of score > tau for each threshold. Scores are counted by the number of thresholds below them, so
    the running counts go over thresholds (a bounded list) and never over rows."""
    sorted_taus = taus.where("tau is not null").agg(F.array_sort(F.collect_set("tau")).alias("taus"))
    counted = rows.where("score is not null").crossJoin(F.broadcast(sorted_taus))  # one row
    counted = counted.groupBy(F.size(F.filter("taus", lambda t: t < F.col("score"))).alias("below")).agg(F.sum(F.col("positive").cast("int")).alias("p"), F.count("*").alias("n"))
    places = sorted_taus.select(F.posexplode("taus").alias("i", "tau"))
    n1, n0 = F.sum("p").over(Window.partitionBy(F.lit(0))), F.sum(F.col("n") - F.col("p")).over(Window.partitionBy(F.lit(0)))
    both = places.join(counted, F.col("i") + 1 == F.col("below"), "full").withColumn("at", F.coalesce(F.col("i") + 1, F.col("below"))).na.fill(0, ["p", "n"])
    up = Window.partitionBy(F.lit(0)).orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    ran = both.select("tau", (F.sum("p").over(up) / n1).alias("tpr"), (F.sum(F.col("n") - F.col("p")).over(up) / n0).alias("fpr"))
    return ran.where("tau is not null")


def area(points: DataFrame) -> DataFrame:
    """Trapezoid area under (fpr, tpr), closed at (0, 0) and (1, 1)."""
    ends = points.sparkSession.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "fpr double, tpr double")
    order = Window.partitionBy(F.lit(0)).orderBy("fpr", "tpr")
    steps = points.select("fpr", "tpr").unionByName(ends).withColumn("_x", F.lag("fpr").over(order)).withColumn("_y", F.lag("tpr").over(order))
    return steps.agg(F.sum((F.col("fpr") - F.col("_x")) * (F.col("tpr") + F.col("_y")) / 2).alias("area"))


def false_alarms(results: DataFrame, first: str | None = None) -> DataFrame:
    """series, rate, n of flagged runs without an anomaly: of all of them, or of the one named ``first`` (where thresholds come from
    leaving one run out). results: series, run, flagged."""
    own = results if first is None else results.where(F.col("run") == first)
    return own.groupBy("series").agg(F.avg(F.col("flagged").cast("double")).alias("rate"), F.count("*").alias("n"))


def rates_by_group(results: DataFrame) -> DataFrame:
    """Detection rate by type and by type/kind: a run counts in both. results: type, kind, flagged."""
    keys = F.array(F.col("type"), F.when(F.col("kind").isNotNull(), F.concat_ws("/", "type", "kind")))
    long = results.withColumn("group", F.explode(F.filter(keys, lambda k: k.isNotNull())))
    return long.groupBy("group").agg(F.avg(F.col("flagged").cast("double")).alias("rate"), F.count("*").alias("n"))
