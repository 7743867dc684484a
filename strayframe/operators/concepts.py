"""Concepts of frames: instances from pixels, hand corrections, detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from .conformal import cumulative


def instances(pixels: DataFrame, *, least: int = 250) -> DataFrame:
    """pixels: key, u, v, o, n (o, n break ties). key, px, box x0 y0 x1 y1 (end exclusive), foot_u, foot_v: the middle pixel by
    u of those in the lowest rows (v at its 95th percentile or more). Keys of fewer pixels go."""
    found = pixels.groupBy("key").agg(F.count("*").alias("px"), F.min("u").alias("x0"), F.min("v").alias("y0"), (F.max("u") + 1).alias("x1"), (F.max("v") + 1).alias("y1"), F.percentile("v", F.lit(0.95)).alias("_low")).where(F.col("px") >= least)
    low = pixels.join(found.select("key", "_low"), "key").where(F.col("v") >= F.col("_low"))
    w = Window.partitionBy("key")
    foot = low.withColumn("_i", F.row_number().over(w.orderBy("u", "o", "n"))).withColumn("_c", F.count("*").over(w)).where(F.col("_i") == F.floor(F.col("_c") / 2) + 1)
    return found.drop("_low").join(foot.select("key", F.col("u").alias("foot_u"), F.col("v").alias("foot_v")), "key")


def effective(base: DataFrame, tracks: DataFrame, frames: DataFrame, added: DataFrame) -> DataFrame:
    """run, t, concept. base: run, t, id, object, predicate. tracks: edits by run and id (object, predicate, drop; null: as it is);
    frames: by run, t and id, which come first. added: run, t, object, predicate."""
    edits = ("object", "predicate", "drop")
    tr = tracks.select("run", "id", *(F.col(c).alias(f"t_{c}") for c in edits))
    fr = frames.select("run", "t", "id", *(F.col(c).alias(f"f_{c}") for c in edits))
    joined = base.join(tr, ["run", "id"], "left").join(fr, ["run", "t", "id"], "left").where(~F.coalesce("f_drop", "t_drop", F.lit(False)))
    kept = joined.select("run", "t", F.coalesce("f_object", "t_object", "object").alias("object"), F.coalesce("f_predicate", "t_predicate", "predicate").alias("predicate"))
    return kept.unionByName(added).select("run", "t", F.concat_ws(" ", "object", "predicate").alias("concept"))


def top_labels(detections: DataFrame, least: float, most: int) -> DataFrame:
    """frame, label, score, n: the best box of each label with a score of ``least`` or more, and of those the first ``most``."""
    best = Window.partitionBy("frame", "label").orderBy(F.desc("score"), "box")
    one = detections.where(F.col("score") >= least).withColumn("_i", F.row_number().over(best)).where("_i = 1").drop("_i")
    return one.withColumn("n", F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("score"), "box"))).where(F.col("n") <= most)


def _iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    h = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    of = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    return F.coalesce(F.try_divide(w * h, of(a) + of(b) - w * h), F.lit(0.0))


def greedy_boxes(boxes: DataFrame, most_iou: float, most: int) -> DataFrame:
    """frame, concept, score, x0, y0, x1, y1: boxes by falling score, each kept unless it overlaps a kept one of the frame by more
    than ``most_iou`` or its concept is kept already; up to ``most`` a frame. What is kept depends on what was kept before, so
    a frame is a fold over its sorted boxes; a frame holds the boxes of one image."""
    row = F.struct((-F.col("score")).alias("down"), "x0", "y0", "concept", "x1", "y1")
    sorted_ = boxes.groupBy("frame").agg(F.array_sort(F.collect_list(row)).alias("b"))
    none = F.slice("b", 1, 0)
    clear = lambda kept, b: (F.size(kept) < most) & ~F.exists(kept, lambda k: (k["concept"] == b["concept"]) | (_iou(k, b) > most_iou))
    kept = F.aggregate("b", none, lambda kept, b: F.when(clear(kept, b), F.concat(kept, F.array(b))).otherwise(kept))
    return sorted_.select("frame", F.explode(kept).alias("k")).select("frame", "k.concept", (-F.col("k.down")).alias("score"), "k.x0", "k.y0", "k.x1", "k.y1")


def frame_labels(
    frames: DataFrame, agents: DataFrame, *, least: int = 50, near: float = 1.5, cyclist: tuple[str, str] = ("on the sidewalk", "on the crosswalk"),
    nouns: dict[str, str] | None = None, no_sidewalk: str = "empty sidewalk", no_crossing: str = "empty intersection", always: tuple[str, ...] = ("mountains in the distance",),
) -> DataFrame:
    """run, tick, labels of every frame (run, tick). agents: run, tick, agent, type, obj, bp, pred, px, crosswalk_m at that tick.

    An agent of ``least`` pixels or more is "<object> <predicate>". A cyclist's predicate is the second of ``cyclist`` on a
    crosswalk or within ``near`` metres of one, else the first; a pedestrian has the noun of its blueprint. Labels of agents
    come by agent, then what is empty, then what is always there."""
    on = (F.col("pred") == "on the crosswalk") | (F.col("crosswalk_m") <= near)
    pred = F.when(F.col("type") == "cyclist", F.when(F.coalesce(on, F.lit(False)), cyclist[1]).otherwise(cyclist[0])).otherwise(F.col("pred"))
    obj = F.col("obj")
    for name, noun in (nouns or {}).items():
        obj = F.when((F.col("obj") == "pedestrian") & (F.col("bp") == name), noun).otherwise(obj)
    seen = agents.where(F.coalesce("px", F.lit(0)) >= least).select("run", "tick", "agent", pred.alias("_p"), F.concat_ws(" ", obj, pred).alias("_l"))
    listed = seen.groupBy("run", "tick").agg(F.array_sort(F.collect_list(F.struct("agent", F.col("_l").alias("l")))).alias("_a"), F.collect_set("_p").alias("_p"))
    none = F.array().cast("array<string>")
    preds, own = F.coalesce("_p", none), F.coalesce(F.transform("_a", lambda a: a["l"]), none)
    sidewalk = F.when(F.array_contains(preds, "on the sidewalk"), none).otherwise(F.array(F.lit(no_sidewalk)))
    crossing = F.when(F.arrays_overlap(preds, F.array(F.lit("on the crosswalk"), F.lit("in the intersection"))), none).otherwise(F.array(F.lit(no_crossing)))
    return frames.select("run", "tick").join(listed, ["run", "tick"], "left").select("run", "tick", F.concat(own, sidewalk, crossing, F.array(*map(F.lit, always))).alias("labels"))


def saved_answers(rows: DataFrame, wanted: list[str], order: str) -> DataFrame:
    """run, tick, answers (prompt -> output) of the runs whose every tick has all wanted prompts; a run that lacks one is to be
    asked again whole. rows: run, tick, prompt, output and ``order``, the last of which counts."""
    last = rows.groupBy("run", "tick", "prompt").agg(F.max_by("output", order).alias("output"))
    ticks = last.groupBy("run", "tick").agg(F.map_from_entries(F.collect_list(F.struct("prompt", "output"))).alias("answers"))
    whole = F.size(F.array_except(F.array(*map(F.lit, wanted)), F.map_keys("answers"))) == 0
    runs = ticks.groupBy("run").agg(F.bool_and(whole).alias("_whole")).where("_whole").select("run")
    return ticks.join(runs, "run")


def label_view(base: DataFrame, corrected: DataFrame, pool: list[int]) -> DataFrame:
    """run, t, recorded and corrected concepts, prompt, same_prompt: the drill-down of a run's labels. base: run, t, object,
    predicate; corrected: run, t, concept; same_prompt: frames of the pool's runs with the same prompt."""
    tidy = lambda rows, c: rows.groupBy("run", "t").agg(F.array_sort(F.collect_set(c)).alias("c"))
    recorded = tidy(base, F.concat_ws(" ", "object", "predicate")).withColumnRenamed("c", "recorded")
    shown = recorded.join(tidy(corrected, "concept").withColumnRenamed("c", "corrected"), ["run", "t"], "left")
    shown = shown.withColumn("corrected", F.coalesce("corrected", F.array().cast("array<string>"))).withColumn("prompt", text.described(F.col("corrected")))
    counts = shown.where(F.col("run").isin(pool)).groupBy("prompt").agg(F.count("*").alias("same_prompt"))
    return shown.join(counts, "prompt", "left").select("run", "t", "recorded", "corrected", "prompt", F.coalesce("same_prompt", F.lit(0)).alias("same_prompt"))


def distinct_so_far(frames: DataFrame, place: str, concepts: str) -> DataFrame:
    """frames with seen: the number of distinct concepts up to each frame's place (frames of one place together). Only first
    appearances are counted, and added up by ranges of places."""
    first = frames.select(F.col(place), F.explode(concepts).alias("_c")).groupBy("_c").agg(F.min(place).alias(place))
    events = frames.select(place, F.lit(0).alias("_new")).unionByName(first.select(place, F.lit(1).alias("_new")))
    upto = cumulative(events, [], place, {"_new": F.sum("_new")}).select(place, F.col("_new_upto").alias("seen"))
    return frames.join(upto, place)
