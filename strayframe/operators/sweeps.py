"""Sweeps of the whole protocol over draws of the pool, all draws in one plan, from one stored table of nearest neighbours.

The pair table holds for each query row and each reference run the nearest points of that run, and ``bound`` and ``next``, the first point of
the run that is not listed. It is written once, in buckets of reference runs, so a subset of runs is answered by reading their buckets and a
subset of points by filtering the lists. What a subset leaves of the lists is the true answer if its k-th point comes before the bounds
of all its runs (by distance, then id, as there may be many copies of a point); rows for which it doesn't are searched again with longer lists, until they are answered.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Hashable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import shared_path
from . import conformal, evaluation, knn

#: Longer lists hold so many times as much.
LONGER = 8
#: Whether a draw has a point: from the point's id and the columns of the draw.
Mask = Callable[[Column], Column]


def stratified_draws(strata: dict[Hashable, list], sizes: list[int], draws: int, seed: int = 0) -> list[tuple[int, int, Hashable]]:
    """(size, draw, run): seeded draws of runs, each stratum giving an equal number (the last ones one more where that can't be). A size
    of all runs or more is one draw of all. strata: the runs of each; names of recordings, not data."""
    rng, everything = random.Random(seed), sorted(x for runs in strata.values() for x in runs)
    out = []
    for size in sizes:
        if size >= len(everything):
            out += [(size, 0, run) for run in everything]
            continue
        shares = [size * (i + 1) // len(strata) - size * i // len(strata) for i in range(len(strata))]
        for draw in range(draws):
            taken = [run for runs, n in zip(strata.values(), shares, strict=True) for run in rng.sample(runs, n)]
            out += [(size, draw, run) for run in sorted(taken)]
    return out


def _kept(df: DataFrame, tag: str) -> DataFrame:
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class PairTable:
    """A stored pair table, which is opened again by its path. keys: the columns that name a query row, run and test among them."""

    path: str
    keys: list[str]
    k: int
    buckets: int

    @staticmethod
    def lists(query: DataFrame, pool: DataFrame, keys: list[str], k: int, **how) -> DataFrame:
        """keys, r_run, near (by distance, then r_id), bound and next, distance and r_id of the first point that is not listed (infinite, null). query: keys, v;
        pool: r_id, r_run, r. No row meets points of its own run."""
        found = knn.nearest(query.select(*keys, "v"), pool.select("r_id", "r_run", "r"), k + 1, "cosine", apart=("run", "r_run"), by="r_run", listed=True, **how)
        after = F.get("near", F.lit(k))
        return found.select(*keys, "r_run", F.slice("near", 1, k).alias("near"), F.coalesce(after["d"], F.lit(float("inf"))).alias("bound"), after["r_id"].alias("next"))

    @classmethod
    def store(cls, query: DataFrame, pool: DataFrame, keys: list[str], k: int, *, buckets: int = 16, path: str | None = None, **how) -> PairTable:
        path = path or shared_path(query.sparkSession, "pairs")
        rows = cls.lists(query, pool, keys, k, **how).withColumn("bucket", F.pmod(F.xxhash64("r_run"), F.lit(buckets)).cast("int"))
        rows.write.partitionBy("bucket").parquet(path)
        return cls(path, keys, k, buckets)

    def read(self, spark: SparkSession, runs: list | None = None) -> DataFrame:
        """The table, or its rows of some reference runs: only their buckets are read."""
        rows = spark.read.parquet(self.path)
        if runs is None:
            return rows
        held = spark.createDataFrame([(x,) for x in runs], rows.select("r_run").schema)
        buckets = [r[0] for r in held.select(F.pmod(F.xxhash64("r_run"), F.lit(self.buckets)).cast("int")).distinct().collect()]  # self.buckets at most
        return rows.where(F.col("bucket").isin(buckets) & F.col("r_run").isin(runs))


def _merged(lists: DataFrame, keys: list[str], draws: DataFrame, k: int, points: Mask | None) -> DataFrame:
    """The draw's columns, keys, near (the k nearest of the draw's points that are listed), sure (no other point can be among them)."""
    draw = [c for c in draws.columns if c != "member"]
    members = draws.groupBy(*draw).agg(F.collect_set("member").alias("members"))  # names of recordings, a row a draw
    own = lists.repartition(*keys).groupBy(*keys).agg(F.collect_list(F.struct("r_run", "near", "bound", "next")).alias("runs"))  # a list a run: shuffled once for all draws
    rows = own.crossJoin(F.broadcast(members)).where("test OR array_contains(members, run)")
    rows = rows.select(*draw, *keys, F.filter("runs", lambda x: F.array_contains("members", x["r_run"])).alias("held")).where(F.size("held") > 0)
    near = F.flatten(F.transform("held", lambda x: F.filter(x["near"], lambda y: points(y["r_id"])) if points else x["near"]))
    bound = F.array_min(F.transform("held", lambda x: F.struct(x["bound"].alias("d"), x["next"].alias("r_id"))))
    merged = rows.select(*draw, *keys, F.slice(F.array_sort(near), 1, k).alias("near"), bound.alias("bound"))
    last = F.when(F.size("near") == k, F.get("near", F.lit(k - 1)))
    return merged.withColumn("sure", (F.col("bound.d") == float("inf")) | F.coalesce(last < F.col("bound"), F.lit(False))).drop("bound")


def nearest_of_draws(table: PairTable, query: DataFrame, pool: DataFrame, draws: DataFrame, k: int, points: Mask | None = None, **how) -> DataFrame:
    """The draw's columns, table.keys, near: of each query row its k nearest points among a draw's runs (and points), by distance, then id; a row that the
    draw has no point for has none, or an empty list. draws: columns of the draw and member, a run; pool rows are asked in the draws that have their run, test rows in all."""
    keys, draw = table.keys, [c for c in draws.columns if c != "member"]
    lists, length, found, wanted = table.read(query.sparkSession), table.k, [], None
    while True:
        rows = _merged(lists, keys, draws, k, points)
        if wanted is not None:
            rows = rows.join(wanted, [*draw, *keys], "left_semi")
        rows = _kept(rows, "merged")
        found.append(rows.where("sure").drop("sure"))
        wanted = rows.where("NOT sure").select(*draw, *keys)
        if wanted.isEmpty():
            break
        length *= LONGER
        lists = PairTable.lists(query.join(wanted.select(*keys).distinct(), keys, "left_semi"), pool, keys, length, **how)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def nearest_of_shares(query: DataFrame, pool: DataFrame, keys: list[str], thresholds: DataFrame, k: int, *, listed: int | None = None, **how) -> DataFrame:
    """share, draw, keys, near: of each query row its k nearest points among those of each draw of :func:`share_draws`, by distance, then id. As every
    draw has all runs, a row needs one list of its nearest points at all, of whatever run but its own: long enough to hold k points of the
    least share (three times the length that it takes on average, or ``listed``). Rows whose list holds fewer are searched again with a longer one. A point's
    places in the draws are digested once, and its list entries carry, for each draw, how many thresholds lie below its place."""
    rows = [(r.share, r.draw, r.threshold) for r in thresholds.select("share", "draw", "threshold").collect()]  # a row a share and draw
    of = {d: sorted(t for _, x, t in rows if x == d) for d in {d for _, d, _ in rows}}
    if not rows:
        raise ValueError("no draws")
    marks = {d: f"_m{n}" for n, d in enumerate(sorted(of))}
    below = lambda d: sum((sample_place(F.lit(d), F.col("r_id")) > t).cast("int") for t in of[d]).cast("byte")
    marked = _kept(pool.select("r_id", "r_run", "r", F.lit(0).alias("_all"), *(below(d).alias(m) for d, m in marks.items())), "marked")
    length, found, asked = listed or -int(-3 * k // min(s for s, _, _ in rows)), [], query
    while True:
        lists = knn.nearest(asked.select(*keys, "v"), marked, length, "cosine", apart=("run", "r_run"), by="_all", listed=True, carried=tuple(marks.values()), **how)
        lists = _kept(lists.select(*keys, "near"), "lists")
        enough = F.size("near") < length
        enough = enough | F.forall(F.array(*(F.size(_held("near", m, 0)) >= k for m in marks.values())), lambda x: x)  # the least share of each draw
        found.append(lists.where(enough))
        wanted = lists.where(~enough).select(*keys)
        if wanted.isEmpty():
            break
        asked, length = query.join(wanted, keys, "left_semi"), length * LONGER
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    drawn = [F.struct(F.lit(s).alias("share"), F.lit(d).alias("draw"), F.slice(_held("near", marks[d], sum(x < t for x in of[d])), 1, k).alias("near")) for s, d, t in rows]
    return out.select(*keys, F.explode(F.array(*drawn)).alias("x")).select("x.share", "x.draw", *keys, F.transform("x.near", lambda x: F.struct(x["d"].alias("d"), x["r_id"].alias("r_id"))).alias("near"))


def _held(near: str, mark: str, most: int) -> Column:
    """The entries whose mark is at most so much."""
    return F.filter(near, lambda x: x[mark] <= most)


def mean_scores(near: DataFrame, ks: list[int], digits: int = 9) -> DataFrame:
    """Adds k and score: the mean of the k smallest distances, for each of ks."""
    mean = F.aggregate(F.slice("near", 1, F.col("k")), F.lit(0.0), lambda a, x: a + x["d"]) / F.least(F.size("near"), F.col("k"))
    rows = near.where(F.size("near") > 0).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return rows.withColumn("score", F.round(mean, digits)).drop("near")


def evaluated(scores: DataFrame, keys: list[str], alpha_frame: float, alpha_run: float) -> DataFrame:
    """keys, source, tau, capped, tpr, fpr, balanced, n_windows, n_outside: thresholds from the left-out scores of each key's pool runs, and
    what they detect among its test rows. scores: keys, source, run, test, window (-1: none), score."""
    scores = _kept(scores, "scores")  # a ranking reads its rows three times
    q = _kept(conformal.quantile_higher(scores.where("NOT test"), [*keys, "run"], 1 - alpha_frame), "quantiles")
    tau = conformal.conformal_tau(q, keys, alpha_run, value="q_run", beyond="capped").select(*keys, "tau", F.col("overflow").alias("capped"))
    tau = _kept(tau, "thresholds")
    return evaluation.window_rates(scores.where("test").join(tau, keys), [*keys, "source", "tau", "capped"])


def two_thresholds(scores: DataFrame, keys: list[str], alpha_frame: float, alpha_run: float) -> tuple[DataFrame, DataFrame]:
    """(scores, stored; keys, rule, tau): the conformal threshold over the pool runs' quantiles, and the pooled one, the linear percentile of all
    their left-out scores together."""
    scores = _kept(scores, "scores")  # a ranking reads its rows three times
    loo = scores.where("NOT test")
    q = _kept(conformal.quantile_higher(loo, [*keys, "run"], 1 - alpha_frame), "quantiles")
    by_run = conformal.conformal_tau(q, keys, alpha_run, value="q_run", beyond="capped").select(*keys, F.lit("conformal").alias("rule"), "tau")
    pooled = conformal.quantile_linear(loo, keys, 1 - alpha_frame, name="tau").select(*keys, F.lit("pooled").alias("rule"), "tau")
    return scores, _kept(by_run.unionByName(pooled), "thresholds")


def sample_place(draw: Column, point: Column) -> Column:
    """A point's place in a draw, the same wherever it is computed: 52 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", draw.cast("string"), point.cast("string"))), 1, 13), 16, 10).cast("bigint")


def share_draws(points: DataFrame, shares: list[float], draws: int) -> DataFrame:
    """share, draw, threshold: a draw's points are those whose place is at most the threshold, round(share * n) of them. A draw's
    smaller shares lie in its larger ones. points: r_id."""
    placed = points.select("r_id", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("place", sample_place(F.col("draw"), F.col("r_id")))
    rank = lambda s: F.bround(s * F.col("_of")).cast("bigint")
    held = F.filter(F.array(*map(F.lit, shares)), lambda s: (F.col("_lo") <= rank(s)) & (rank(s) <= F.col("_hi")))
    found = conformal.ranks(placed, ["draw"], "place").select("draw", F.col("place").alias("threshold"), F.explode(held).alias("share"))
    return found.where("share < 1 OR draw = 0").select("share", "draw", "threshold")


def coverage(held: DataFrame, thresholds: DataFrame) -> DataFrame:
    """share, draw, coverage: the part of all concepts that the points of a draw hold. A concept is held from the least place of its
    points on. held: r_id, concept."""
    draws = thresholds.select("draw").distinct()
    first = held.join(F.broadcast(draws)).groupBy("draw", "concept").agg(F.min(sample_place(F.col("draw"), F.col("r_id"))).alias("first"))  # a row a draw
    both = first.join(F.broadcast(thresholds), "draw")  # a row a share and draw
    return both.groupBy("share", "draw").agg(F.avg((F.col("first") <= F.col("threshold")).cast("double")).alias("coverage"))


def roc_points(scores: DataFrame, keys: list[str], alpha_run: float, *, steps: int = 200, start: float = 75.0, eps: float = 1e-9) -> DataFrame:
    """keys, source, tau, p, tpr, fpr, accuracy, p_lo, _range, _up, _out: thresholds from the pool runs' p-th percentiles (p of a fixed ladder,
    from p_lo on: the highest p up to ``start`` at which every window is found), and beyond them the windows' peaks, at and just
    below each (p null). scores as for :func:`evaluated`; a window is found if its peak lies above the threshold."""
    scores = _kept(scores, "scores")  # a ranking reads its rows three times
    test = scores.where("test")
    q = _kept(conformal.quantiles_higher(scores.where("NOT test"), [*keys, "run"], steps), "quantiles")
    taus = _kept(conformal.conformal_tau(q, [*keys, "p"], alpha_run, value="q", beyond="capped").select(*keys, "p", "tau"), "thresholds")
    series = [*keys, "source"]
    peaks = _kept(test.where("window >= 0").groupBy(*series, "run", "window").agg(F.max("score").alias("value")), "peaks")
    size = peaks.groupBy(*series).agg((F.lit(eps) * F.greatest(F.lit(1.0), F.max(F.abs("value")))).alias("eps"), F.max("value").alias("hi"), F.min("value").alias("least"))
    null = F.lit(None).cast("double")
    made = [
        size.join(taus, keys).select(*series, F.col("tau").alias("value"), F.lit(0).alias("up"), F.lit(0).alias("out"), F.lit(True).alias("asked"), "p"),
        peaks.join(size, series).select(*series, F.explode(F.array(F.struct(F.col("value"), F.lit(1).alias("up")), F.struct((F.col("value") - F.col("eps")).alias("value"), F.lit(0).alias("up")))).alias("x")).select(*series, "x.value", "x.up", F.lit(0).alias("out"), F.lit(True).alias("asked"), null.alias("p")),
        test.where("window < 0").select(*series, F.col("score").alias("value"), F.lit(0).alias("up"), F.lit(1).alias("out"), F.lit(False).alias("asked"), null.alias("p")),
    ]
    events = _kept(made[0].unionByName(made[1]).unionByName(made[2]), "events")
    sums = {"up": F.sum("up"), "out": F.sum("out"), "ps": F.collect_set("p"), "free": F.max(F.col("asked") & F.col("p").isNull())}  # a ladder's p at most
    rows = conformal.cumulative(events, series, "value", sums, ["up", "out"]).where(F.col("free") | (F.size("ps") > 0))
    rows = rows.select(*series, F.col("value").alias("tau"), "ps", "free", "_range", (F.col("up_all") - F.col("up_upto")).alias("_up"), (F.col("out_all") - F.col("out_upto")).alias("_out"), F.try_divide(F.col("up_all") - F.col("up_upto"), F.col("up_all")).alias("tpr"), F.try_divide(F.col("out_all") - F.col("out_upto"), F.col("out_all")).alias("fpr"))
    rows = rows.withColumn("p", F.explode(F.concat("ps", F.when(F.col("free"), F.array(null)).otherwise(F.array().cast("array<double>"))))).drop("ps", "free")
    rows = _kept(rows, "rates")
    lowest = rows.where(f"p <= {start} AND tpr = 1").groupBy(*series).agg(F.max("p").alias("p_lo"))
    ends = size.join(lowest, series, "left").withColumn("p_lo", F.coalesce("p_lo", F.lit(0.0)))
    first = rows.join(ends.select(*series, "p_lo"), series).where("p = p_lo").select(*series, F.col("tau").alias("_first"))
    ends = ends.join(first, series).select(*series, "p_lo", "hi", F.least("_first", F.col("least") - F.col("eps")).alias("lo"))
    return rows.join(ends, series).where("tau BETWEEN lo AND hi AND (p IS NULL OR p >= p_lo)").select(*series, "tau", "p", "tpr", "fpr", ((F.col("tpr") + 1 - F.col("fpr")) / 2).alias("accuracy"), "p_lo", "_range", "_up", "_out")


def roc_area(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, p_lo, auroc: the area under the points of :func:`roc_points`, closed at (0, 0) and (1, 1). Neighbours are found within a range
    of thresholds; only the ranges' ends are put in order across them."""
    once = points.select(*keys, "p_lo", "tau", "tpr", "fpr", "_range").distinct()
    inside = Window.partitionBy(*keys, "_range").orderBy(F.desc("tau"))
    part = lambda x, y, x0, y0: (x - x0) * (y + y0) / 2
    steps = once.withColumn("_x", F.lag("fpr").over(inside)).withColumn("_y", F.lag("tpr").over(inside))
    end = F.struct("tau", "fpr", "tpr")
    ranges = steps.groupBy(*keys, "p_lo", "_range").agg(F.sum(part(F.col("fpr"), F.col("tpr"), F.col("_x"), F.col("_y"))).alias("a"), F.max(end).alias("top"), F.min(end).alias("low"))
    order = Window.partitionBy(*keys).orderBy(F.desc("_range"))  # conformal.RANGES at most
    joined = ranges.withColumn("_x", F.coalesce(F.lag("low").over(order)["fpr"], F.lit(0.0))).withColumn("_y", F.coalesce(F.lag("low").over(order)["tpr"], F.lit(0.0)))
    bridge = part(F.col("top.fpr"), F.col("top.tpr"), F.col("_x"), F.col("_y"))
    last = F.max_by("low", -F.col("_range"))
    closing = (1 - last["fpr"]) * (1 + last["tpr"]) / 2
    return joined.groupBy(*keys, "p_lo").agg((F.sum(F.coalesce("a", F.lit(0.0)) + bridge) + closing).alias("auroc"))
