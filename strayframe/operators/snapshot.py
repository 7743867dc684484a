"""Scores of single frames against a cache of distinct nominal entries, each nominal frame without itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import shared_path
from . import knn


#: Frames that are led in one task, and pairs that are compared at once.
LED, PAIRS = 4_000, 1_000_000


def _first_within(points: np.ndarray, leaders: np.ndarray, tolerance: float) -> np.ndarray:
    """For each point the first leader within the tolerance in every component, -1 if none. Pairs near in the first component are
    thinned out component by component."""
    out = np.full(len(points), len(leaders))
    if len(leaders) and len(points):
        order = np.argsort(leaders[:, 0], kind="stable")
        line, slack = leaders[order, 0], 1e-9 * (1 + np.abs(points[:, 0]))
        lo, hi = np.searchsorted(line, points[:, 0] - tolerance - slack), np.searchsorted(line, points[:, 0] + tolerance + slack, side="right")
        many, begin = np.cumsum(hi - lo), 0
        while begin < len(points):
            end = max(begin + 1, int(np.searchsorted(many, (many[begin - 1] if begin else 0) + PAIRS, side="right")))
            n = hi[begin:end] - lo[begin:end]
            i = np.repeat(np.arange(begin, end), n)
            j = order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[begin:end], n)]
            for c in range(points.shape[1]):
                near = np.abs(points[i, c] - leaders[j, c]) <= tolerance
                i, j = i[near], j[near]
            np.minimum.at(out, i, j)
            begin = end
    return np.where(out < len(leaders), out, -1)


def _led(rows: pa.Table, tolerance: float) -> pa.Table:
    """The leaders among rows (id, v) in the order of ids: each row that no earlier leader is within the tolerance of."""
    rows = rows.sort_by("id")
    v = knn._matrix(rows["v"])
    open_, first = np.ones(len(v), dtype=bool), []
    for i in range(len(v)):
        if open_[i]:
            first.append(i)
            at = np.flatnonzero(open_[i:]) + i
            open_[at[(np.abs(v[at] - v[i]) <= tolerance).all(axis=1)]] = False
            open_[i] = False
    return rows.take(pa.array(first, pa.int64()))


def distinct_entries(frames: DataFrame, tolerance: float = 0.0, led: int = LED) -> DataFrame:
    """Adds entry (the id of the entry's first frame) and copies (frames of the entry). Without a tolerance entries are equal
    vectors. With one, a frame joins the first entry within it in every component, by id. The rule is sequential, but only among frames
    that no entry has: in each round the first ``led`` of these are led in one task, all others meet the new entries (which are as
    many at most) where they are, and what joins none goes on. So a dense pool ends with the round that finds its entries. Ids are unique."""
    if tolerance == 0:
        w = Window.partitionBy("v")
        return frames.withColumn("entry", F.min("id").over(w)).withColumn("copies", F.count("*").over(w))
    spark = frames.sparkSession

    def kept(df: DataFrame, tag: str) -> DataFrame:
        path = shared_path(spark, tag)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    open_, joined = kept(frames.select(F.col("id").cast("bigint").alias("id"), "v"), "frames"), []
    while True:
        first = open_.orderBy("id").limit(led).toArrow()  # ``led`` rows
        if not first.num_rows:
            break
        new = spark.sparkContext.broadcast(_led(first, tolerance))

        def meet(batches: Iterator[pa.RecordBatch], new=new) -> Iterator[pa.RecordBatch]:
            names, leaders = new.value["id"].to_numpy(), knn._matrix(new.value["v"])
            for batch in batches:
                at = _first_within(knn._matrix(batch.column(1)), leaders, tolerance)
                entry = pa.array(names[at] if len(names) else np.zeros(len(at), np.int64), pa.int64(), mask=at < 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), entry], names=["id", "v", "entry"])

        met = kept(open_.mapInArrow(meet, "id bigint, v array<double>, entry bigint"), "met")
        joined.append(met.where("entry IS NOT NULL").select("id", "entry"))
        open_ = met.where("entry IS NULL").select("id", "v")
    if not joined:
        return frames.withColumn("entry", F.lit(None).cast("bigint")).withColumn("copies", F.lit(0).cast("bigint"))
    entries = joined[0]
    for more in joined[1:]:
        entries = entries.unionByName(more)
    sizes = entries.groupBy("entry").agg(F.count("*").alias("copies"))
    return frames.join(entries, "id").join(sizes, "entry").select(*frames.columns, "entry", "copies")


def entry_scores(nominal: DataFrame, k: int, *, floor: float = 0.05, plain: bool = False) -> DataFrame:
    """run, tick, id, score of nominal frames: mean distance to the k nearest entries. A frame's own entry counts unless the frame is
    the only one of it. Components are divided by their spread over the entries, at least ``floor`` (``plain``: not)."""
    known = distinct_entries(nominal)
    entries = known.where("id = entry").select(F.col("entry").alias("r_id"), F.col("v").alias("r"), F.col("copies").alias("r_copies"))
    if not plain:
        flat = entries.select(F.posexplode("r").alias("i", "x")).groupBy("i").agg(F.greatest(F.stddev_pop("x"), F.lit(floor)).alias("s"))
        scale = flat.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("s"))
        divide = lambda df, c: df.crossJoin(F.broadcast(scale)).withColumn(c, F.zip_with(c, "s", lambda x, s: x / s)).drop("s")
        known, entries = divide(known, "v"), divide(entries, "r")
    known = known.select("run", "tick", "id", "v", F.when(F.col("copies") == 1, F.col("entry")).otherwise(F.lit(-1)).alias("own"))
    best = knn.nearest(known, entries.withColumn("r_own", F.when(F.col("r_copies") == 1, F.col("r_id")).otherwise(F.lit(-2))), k, "euclidean", apart=("own", "r_own"))
    return best.groupBy("run", "tick", "id").agg(F.avg("d").alias("score"))


def sentence_scores(nominal: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """id, score: nominal (id, sentence) against the distinct sentences of the cache; vectors: (sentence, v, fixed). A sentence that
    no other frame has leaves the cache for its frame, unless it is fixed. Cosine distances below 1e-6 are 0."""
    counted = nominal.groupBy("sentence").agg(F.count("*").alias("copies"))
    cache = vectors.join(counted, "sentence", "left").where("copies is not null or fixed").select(F.col("sentence").alias("r_sentence"), F.col("v").alias("r"), F.coalesce("copies", F.lit(0)).alias("r_copies"), "fixed")
    own = nominal.join(vectors.select("sentence", "v"), "sentence")
    cache = cache.withColumn("r_own", F.when((F.col("r_copies") > 1) | F.col("fixed"), F.lit(None).cast("string")).otherwise(F.col("r_sentence")))
    best = knn.nearest(own.select("id", "sentence", "v"), cache.drop("fixed"), k, "cosine", apart=("sentence", "r_own"), snap=1e-6, order="r_sentence")
    return best.groupBy("id").agg(F.avg("d").alias("score"))


def patch_matches(query: DataFrame, bank: DataFrame) -> DataFrame:
    """query patches (id, patch, v) each with the nearest bank patch of another frame: id, patch, r_id, d (at least 0)."""
    best = knn.nearest(query.select("id", "patch", "v"), bank.select("r_id", "r"), 1, "cosine", apart=("id", "r_id"), snap=0.0)
    return best.select("id", "patch", "r_id", "d")


def votes(matches: DataFrame, most: int) -> DataFrame:
    """id, r_id, n_votes, mean_d, rank: frames by how many patches they are nearest to, then by mean distance."""
    counted = matches.groupBy("id", "r_id").agg(F.count("*").alias("n_votes"), F.avg("d").alias("mean_d"))
    w = Window.partitionBy("id").orderBy(F.desc("n_votes"), "mean_d", "r_id")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def source_positions(frames: DataFrame, nominal: DataFrame, cache: str) -> DataFrame:
    """frames (id, src: struct of cache, group, idx) with excluded: the position of the nominal frame that a frame was made from,
    -1 for frames made from none or from another cache's. nominal: idx, position."""
    own = (F.col("src.cache") == cache) & (F.col("src.group") == "nominal")
    keyed = frames.withColumn("_idx", F.when(own, F.col("src.idx")))
    known = nominal.select(F.col("idx").alias("_idx"), F.col("position").alias("excluded"))
    return keyed.join(known, "_idx", "left").drop("_idx").withColumn("excluded", F.coalesce("excluded", F.lit(-1)))
