"""Features of an ego vehicle and of the agents around it.

States are (run, tick, x, y, yaw, vx, vy) rows of the ego; agents are (run, tick, agent, x, y, yaw, vx, vy) rows. What is joined by tick grows
with the recordings and is never broadcast: Spark takes exploded rows for as small as the file that they come from.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions.vec import padded
from ..sources.shared import shared_path

POSE = ("x", "y", "yaw", "vx", "vy")


def _moving(states: DataFrame, dt: float) -> DataFrame:
    """states with v_long, yaw_rate, a_long, a_lat, jerk."""
    w = Window.partitionBy("run").orderBy("tick")
    v = states.withColumn("v_long", g.along_speed(F.col("vx"), F.col("vy"), F.col("yaw"))).withColumn("_yaw", F.lag("yaw").over(w))
    v = v.withColumn("_v1", F.lag("v_long", 1).over(w)).withColumn("_v2", F.lag("v_long", 2).over(w))
    rate = g.turn_rate(F.col("yaw"), F.col("_yaw"), dt)
    a1, a0 = (F.col("v_long") - F.col("_v1")) / dt, (F.col("_v1") - F.col("_v2")) / dt
    return v.select(*states.columns, "v_long", rate.alias("yaw_rate"), a1.alias("a_long"), (F.col("v_long") * rate).alias("a_lat"), ((a1 - a0) / dt).alias("jerk"))


def ego_kinematics(states: DataFrame, dt: float = 0.1) -> DataFrame:
    """run, tick, v_long, yaw_rate, a_long, a_lat, jerk from a state and the two before it; null until there are two."""
    return _moving(states, dt).select("run", "tick", "v_long", "yaw_rate", "a_long", "a_lat", "jerk")


def relative(states: DataFrame, agents: DataFrame) -> DataFrame:
    """run, tick, agent, rel_x, rel_y, rel_yaw, rel_vx, rel_vy, dist: agents in the ego's frame."""
    e = states.select("run", "tick", *(F.col(c).alias(f"e_{c}") for c in POSE))
    j = agents.join(e.hint("merge"), ["run", "tick"])
    rx, ry = g.rotated(F.col("x") - F.col("e_x"), F.col("y") - F.col("e_y"), F.col("e_yaw"))
    vx, vy = g.rotated(F.col("vx") - F.col("e_vx"), F.col("vy") - F.col("e_vy"), F.col("e_yaw"))
    return j.select("run", "tick", "agent", rx.alias("rel_x"), ry.alias("rel_y"), g.wrap(F.col("yaw") - F.col("e_yaw")).alias("rel_yaw"), vx.alias("rel_vx"), vy.alias("rel_vy"), F.hypot(F.col("x") - F.col("e_x"), F.col("y") - F.col("e_y")).alias("dist"))


def agent_yaw_rate(agents: DataFrame, dt: float = 0.1) -> DataFrame:
    """agents with yaw_rate: against the same agent one tick before, 0 where it was not there (a plain lag would bridge gaps)."""
    before = agents.select("run", "agent", (F.col("tick") + 1).alias("tick"), F.col("yaw").alias("_yaw"))
    return agents.join(before.hint("merge"), ["run", "agent", "tick"], "left").withColumn("yaw_rate", F.coalesce(g.turn_rate(F.col("yaw"), F.col("_yaw"), dt), F.lit(0.0))).drop("_yaw")


def nearest_agents(rel: DataFrame, most: int = 5, metres: float = 40.0) -> DataFrame:
    """The nearest agents within a range, with their rank from 1 (ties by agent)."""
    w = Window.partitionBy("run", "tick").orderBy("dist", "agent")
    return rel.where(F.col("dist") <= metres).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def physics_vector(states: DataFrame, agents: DataFrame, *, most: int = 5, metres: float = 40.0, dt: float = 0.1) -> DataFrame:
    """run, tick, v (36): ego x, y, yaw, vx, vy, yaw rate; then rel_x, rel_y, rel_yaw, rel_vx, rel_vy, rel_yaw_rate of the
    five nearest agents, zero-padded. From the second tick of a run on."""
    w = Window.partitionBy("run").orderBy("tick")
    ego = states.withColumn("_before", F.lag("yaw").over(w)).where("_before is not null").withColumn("e_rate", g.turn_rate(F.col("yaw"), F.col("_before"), dt)).drop("_before")
    rel = nearest_agents(relative(states, agents), most, metres).join(agent_yaw_rate(agents, dt).select("run", "tick", "agent", "yaw_rate").hint("merge"), ["run", "tick", "agent"])
    slots = rel.join(ego.select("run", "tick", "e_rate").hint("merge"), ["run", "tick"]).groupBy("run", "tick").agg(F.array_sort(F.collect_list(F.struct("rank", F.array("rel_x", "rel_y", "rel_yaw", "rel_vx", "rel_vy", (F.col("yaw_rate") - F.col("e_rate")).alias("r")).alias("f")))).alias("s"))
    flat = F.flatten(F.transform("s", lambda s: s["f"]))
    joined = ego.join(slots.hint("merge"), ["run", "tick"], "left")
    return joined.select("run", "tick", padded(F.concat(F.array(*POSE, "e_rate"), F.coalesce(flat, F.array().cast("array<double>"))), 6 + 6 * most).alias("v"))


def role_slots(rel: DataFrame) -> DataFrame:
    """run, tick, role, agent, rel_*: the nearest agent of each role within the role's range (ties by agent); lead and follower
    are the nearest along the lane, the other roles the nearest at all."""
    named = rel.withColumn("role", g.role(F.col("rel_x"), F.col("rel_y"), F.col("rel_yaw"))).where("role is not null").where(F.col("dist") <= g.role_range(F.col("role")))
    named = named.withColumn("_near", F.when(F.col("role").isin("lead", "follower"), F.abs("rel_x")).otherwise(F.col("dist")))
    w = Window.partitionBy("run", "tick", "role").orderBy("_near", "agent")
    return named.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_near")


def _scenes(states: DataFrame, agents: DataFrame) -> DataFrame:
    """A row a state: run, tick, x, y, yaw, vx, vy, and o, its tick's agents as (agent, dx, dy, turn, dvx, dvy) against the ego along the world's axes.
    Both sides are put together and not joined, so what is dealt by run stays where it is, and windows over a run need no more."""
    ego, other = F.struct(*POSE), F.struct("agent", *POSE)
    null = lambda df, c: F.lit(None).cast(df.select(c.alias("s")).schema[0].dataType)
    sides = states.select("run", "tick", ego.alias("e"), null(agents, other).alias("o")).unionByName(agents.select("run", "tick", null(states, ego).alias("e"), other.alias("o")))
    met = sides.groupBy("run", "tick").agg(F.first("e", ignorenulls=True).alias("e"), F.collect_list("o").alias("o")).where("e IS NOT NULL")  # a tick's agents are around one ego
    e = F.col("e")
    apart = lambda o: F.struct(o["agent"].alias("agent"), (o["x"] - e["x"]).alias("dx"), (o["y"] - e["y"]).alias("dy"), g.wrap(o["yaw"] - e["yaw"]).alias("turn"), (o["vx"] - e["vx"]).alias("dvx"), (o["vy"] - e["vy"]).alias("dvy"))
    return met.select("run", "tick", "e.*", F.transform("o", apart).alias("o"))


def _turned(dx: Column, dy: Column) -> tuple[Column, Column]:
    """:func:`geometry.rotated` by the row's yaw, of which cosine and sine are columns."""
    return dx * F.col("_cos") + dy * F.col("_sin"), -dx * F.col("_sin") + dy * F.col("_cos")


def _with_roles(scenes: DataFrame, dt: float) -> DataFrame:
    """scenes of :func:`_scenes` with the ego's motion, _cos and _sin of its yaw, v (36), the role vector, and r0 to r5, the nearest agent of
    each role as (role, near, agent, ...) or null."""
    fields = ("rel_x", "rel_y", "rel_vx", "rel_vy")
    moving = _moving(scenes, dt).withColumn("_cos", F.cos("yaw")).withColumn("_sin", F.sin("yaw"))

    def seen(o: Column) -> Column:
        x, y = _turned(o["dx"], o["dy"])
        vx, vy = _turned(o["dvx"], o["dvy"])
        return F.struct(o["agent"].alias("agent"), o["turn"].alias("rel_yaw"), x.alias("rel_x"), y.alias("rel_y"), vx.alias("rel_vx"), vy.alias("rel_vy"), F.hypot(o["dx"], o["dy"]).alias("dist"))

    def named(o: Column) -> Column:
        return F.struct(g.role(o["rel_x"], o["rel_y"], o["rel_yaw"]).alias("role"), o["dist"].alias("dist"), o["agent"].alias("agent"), *(o[f].alias(f) for f in fields))

    def ranked(o: Column) -> Column:
        near = F.when(o["role"].isin("lead", "follower"), F.abs(o["rel_x"])).otherwise(o["dist"])
        return F.struct(o["role"].alias("role"), near.alias("near"), o["agent"].alias("agent"), *(o[f].alias(f) for f in fields))

    there = F.filter(F.transform(F.transform("o", seen), named), lambda o: o["role"].isNotNull() & (o["dist"] <= g.role_range(o["role"])))
    listed = moving.withColumn("_in", F.transform(there, ranked))
    first = lambda r: F.array_min(F.filter("_in", lambda x: x["role"] == r))
    found = listed.select("*", *(first(r).alias(f"r{k}") for k, r in enumerate(g.ROLES))).drop("_in")
    empty = F.array_repeat(F.lit(0.0), 5)
    slot = lambda k: F.when(F.col(f"r{k}").isNull(), empty).otherwise(F.array(F.lit(1.0), *(F.coalesce(F.col(f"r{k}")[f], F.lit(0.0)) for f in fields)))
    lead = F.col(f"r{g.ROLES.index('lead')}")
    ttc = F.coalesce(g.time_to_collision(lead["rel_x"], lead["rel_vx"]), F.lit(10.0))
    return found.withColumn("v", F.concat(F.array("v_long", "yaw_rate", "a_long", "a_lat", "jerk"), *(slot(k) for k in range(len(g.ROLES))), F.array(ttc)))


def role_vector(states: DataFrame, agents: DataFrame, *, dt: float = 0.1) -> DataFrame:
    """run, tick, v (36): ego v_long, yaw_rate, a_long, a_lat, jerk; present, rel_x, rel_y, rel_vx, rel_vy of six roles; time to
    collision with the lead. From the third tick of a run on. A tick's agents are one list (those around one ego), from which each role
    takes its nearest (ties by agent), so there is no join and no sort by role."""
    return _with_roles(_scenes(states, agents), dt).where("jerk IS NOT NULL").select("run", "tick", "v")


def role_history(states: DataFrame, agents: DataFrame, *, history: int = 10, dt: float = 0.1) -> DataFrame:
    """run, tick, v (36 + 4 H + 36 H): the role vector; ego x, y, yaw, v_long of the last H ticks in the present ego frame; of
    each role's present agent, present, rel_x, rel_y, rel_yaw, rel_vx, rel_vy at those ticks (zeros where it was not there), each
    relative to the ego of its tick and rotated by the present yaw. The last H scenes are a window over the run, held a row at a time:
    a state's history is never dealt out, whatever H is."""
    rows = _with_roles(_scenes(states, agents), dt)
    last = Window.partitionBy("run").orderBy("tick").rangeBetween(1 - history, 0)
    past = F.collect_list(F.struct("x", "y", "yaw", "v_long", "o")).over(last)
    rows = rows.select("run", "tick", "x", "y", "yaw", "jerk", "_cos", "_sin", "v", *(F.col(f"r{k}.agent").alias(f"r{k}") for k in range(len(g.ROLES))), past.alias("h"))
    rows = rows.where((F.size("h") == history) & F.col("jerk").isNotNull())
    ego = F.flatten(F.transform("h", lambda p: F.array(*_turned(p["x"] - F.col("x"), p["y"] - F.col("y")), g.wrap(p["yaw"] - F.col("yaw")), p["v_long"])))
    zeros, none = F.array_repeat(F.lit(0.0), 6), F.array_repeat(F.lit(0.0), 6 * history)
    then = lambda o: F.array(F.lit(1.0), *_turned(o["dx"], o["dy"]), o["turn"], *_turned(o["dvx"], o["dvy"]))
    at = lambda p, r: F.coalesce(F.get(F.transform(F.filter(p["o"], lambda o: o["agent"] == r), then), F.lit(0)), zeros)
    role = lambda r: F.when(r.isNull(), none).otherwise(F.flatten(F.transform("h", lambda p: at(p, r))))
    return rows.select("run", "tick", F.concat("v", ego, *(role(F.col(f"r{k}")) for k in range(len(g.ROLES)))).alias("v"))


def turns(states: DataFrame, *, step: float = 0.05, gap: int = 2) -> DataFrame:
    """run, start, stop: ticks whose yaw changed by more than ``step``, joined where they are at most ``gap`` apart."""
    w = Window.partitionBy("run").orderBy("tick")
    hot = states.withColumn("_d", F.abs(g.wrap(F.col("yaw") - F.lag("yaw").over(w)))).where(F.col("_d") > step)
    hot = hot.withColumn("_new", F.coalesce((F.col("tick") - F.lag("tick").over(w) > gap).cast("int"), F.lit(1)))
    hot = hot.withColumn("_part", F.sum("_new").over(w))
    return hot.groupBy("run", "_part").agg(F.min("tick").alias("start"), F.max("tick").alias("stop")).drop("_part")


def ticks_to_next(ticks: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Adds ``ahead``: ticks to the first start after the tick, else to the run's end. A forward as-of join by one sort."""
    both = ticks.select("run", "tick", F.lit(None).cast("int").alias("start")).unionByName(starts.select("run", F.col("start").cast("int").alias("tick"), F.col("start").cast("int").alias("start")))
    w = Window.partitionBy("run").orderBy("tick").rangeBetween(1, Window.unboundedFollowing)
    found = both.withColumn("next", F.min("start").over(w)).where("start is null")
    return found.join(ends, "run").select("run", "tick", (F.coalesce("next", "n") - F.col("tick")).alias("ahead"))


def spells(rows: DataFrame, keys: list[str], holds: Column, least: int) -> DataFrame:
    """keys, start, stop, n: runs of at least ``least`` consecutive ticks in which the condition holds."""
    w = Window.partitionBy(*keys).orderBy("tick")
    on = rows.where(holds).withColumn("_part", F.col("tick") - F.row_number().over(w))
    return on.groupBy(*keys, "_part").agg(F.min("tick").alias("start"), F.max("tick").alias("stop"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_part")


def trip_summary(states: DataFrame, *, slow: float = 0.5) -> DataFrame:
    """run, distance, stopped_share, n: metres driven and the share of ticks below a speed."""
    w = Window.partitionBy("run").orderBy("tick")
    d = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return states.withColumn("_d", d).groupBy("run").agg(F.sum("_d").alias("distance"), F.avg((F.hypot("vx", "vy") < slow).cast("double")).alias("stopped_share"), F.count("*").alias("n"))


def arc_length(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """points with s: metres along the polyline."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    return points.withColumn("_step", step).withColumn("s", F.sum("_step").over(w)).drop("_step")


def along(points: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """x, y of places (keys, at) on polylines (keys, s, x, y): the last vertex at or before, then linear. Places beyond an end are
    at the end. An as-of join by one sort of both sides."""
    lines = points.groupBy(*keys).agg(F.max("s").alias("_top"))
    asked = places.join(lines, keys).withColumn("_s", F.least(F.greatest("at", F.lit(0.0)), F.col("_top")))
    w = Window.partitionBy(*keys).orderBy("s")
    segments = points.select(*keys, "s", "x", "y", F.lead("s").over(w).alias("s1"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"))
    both = segments.select(*keys, F.col("s").alias("_s"), F.lit(0).alias("_kind"), F.struct("s", "x", "y", "s1", "x1", "y1").alias("_seg"), F.lit(None).cast("double").alias("at"))
    both = both.unionByName(asked.select(*keys, "_s", F.lit(1).alias("_kind"), F.lit(None).cast(both.schema["_seg"].dataType).alias("_seg"), "at"))
    last = Window.partitionBy(*keys).orderBy("_s", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_seg", F.last("_seg", ignorenulls=True).over(last)).where("_kind = 1")
    t = F.coalesce(F.try_divide(F.col("_s") - F.col("_seg.s"), F.col("_seg.s1") - F.col("_seg.s")), F.lit(0.0))
    return found.select(*keys, "at", (F.col("_seg.x") + t * F.coalesce(F.col("_seg.x1") - F.col("_seg.x"), F.lit(0.0))).alias("x"), (F.col("_seg.y") + t * F.coalesce(F.col("_seg.y1") - F.col("_seg.y"), F.lit(0.0))).alias("y"))


#: Edges up to this number are broadcast; the side of the finest cells and bands in metres.
EDGES, BAND = 20_000, 4.0


def inside(points: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, polygon) of the points in each polygon (even-odd). edges: polygon, ax, ay, bx, by. Only edges at a point's height count, so
    both meet in bands of y: an edge lies in the level whose bands are as high as it is, three bands at most, and a point asks one
    band of each level that edges have. The bands of a small map are broadcast."""
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    placed = edges.withColumn("_level", F.greatest(F.ceil(F.log2(F.greatest(high - low, F.lit(BAND)) / BAND)), F.lit(0)).cast("int")).withColumn("_side", BAND * F.pow(F.lit(2.0), F.col("_level")))
    levels = placed.select("_level", "_side").distinct()  # doublings of a height: a few
    banded = placed.withColumn("_band", F.explode(F.sequence(F.floor(low / F.col("_side")), F.floor(high / F.col("_side"))))).drop("_side")
    asked = points.select(key, "x", "y").join(F.broadcast(levels)).withColumn("_band", F.floor(F.col("y") / F.col("_side"))).drop("_side")
    small = edges.limit(EDGES + 1).count() <= EDGES  # points of one height would be one task, and need not be where the map is small
    hit = asked.join(F.broadcast(banded) if small else banded.hint("merge"), ["_level", "_band"]).where(g.crosses(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    return hit.groupBy(key, "polygon").agg(F.count("*").alias("_n")).where("_n % 2 = 1").drop("_n")


def nearest_segment(points: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """key, d, segment: the nearest segment of map geometry (ties: the first). A small map is broadcast. On a larger one points ask the cells around
    their own, whose side doubles from round to round: what lies within a side is found, so a nearest one at most that far is final."""
    measured = lambda df: df.withColumn("d", g.segment_distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    best = lambda df: df.groupBy(key).agg(F.min(F.struct("d", "segment")).alias("b")).select(key, F.col("b.d").alias("d"), F.col("b.segment").alias("segment"))
    points, known = points.select(key, "x", "y"), edges.limit(EDGES + 1).count()
    if known <= EDGES:
        return best(measured(points.crossJoin(F.broadcast(edges))))
    spark, side, found = points.sparkSession, BAND, []
    span = edges.agg(F.max(F.greatest("ax", "bx")) - F.min(F.least("ax", "bx")), F.max(F.greatest("ay", "by")) - F.min(F.least("ay", "by"))).first()
    while True:
        cell = lambda c, side=side: F.floor(c / side)
        every = side > max(span)  # far points: each axis has two cells at most, and all segments are asked
        around = lambda c, side=side: F.explode(F.sequence(cell(F.col(c)) - 1, cell(F.col(c)) + 1))
        covered = lambda a, b, side=side: F.explode(F.sequence(cell(F.least(a, b)), cell(F.greatest(a, b))))
        celled = edges.withColumn("_cx", covered("ax", "bx")).withColumn("_cy", covered("ay", "by"))
        if every:
            corner = edges.agg(F.min(F.least("ax", "bx")).alias("_l"), F.min(F.least("ay", "by")).alias("_b"), F.max(F.greatest("ax", "bx")).alias("_r"), F.max(F.greatest("ay", "by")).alias("_t"))
            # a far point's nearest segment lies no further from its clamped place than the map's diagonal
            moved = points.crossJoin(F.broadcast(corner)).select(key, "x", "y", F.least(F.greatest("x", "_l"), F.col("_r")).alias("_px"), F.least(F.greatest("y", "_b"), F.col("_t")).alias("_py"))  # one row
            asked = moved.withColumn("_cx", around("_px")).withColumn("_cy", around("_py")).drop("_px", "_py")
        else:
            asked = points.withColumn("_cx", around("x")).withColumn("_cy", around("y"))
        path = shared_path(spark, "nearest")
        best(measured(asked.join(celled, ["_cx", "_cy"]))).write.parquet(path)
        near = spark.read.parquet(path)
        found.append(near if every else near.where(F.col("d") <= side))
        if every:
            break
        path = shared_path(spark, "open")
        points.join(found[-1].select(key), key, "left_anti").write.parquet(path)
        points, side = spark.read.parquet(path), side * 2
        if points.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def route_cursor(ticks: DataFrame, route: DataFrame, *, ahead: int = 10, off: float) -> DataFrame:
    """run, tick, k, off: the place on the run's route, searched forward only among the next ``ahead`` points (a route that doubles back
    would match further on), and the ticks in a row that no such point was within ``off`` metres (k stays). ticks: run, tick, x, y; route:
    run, seq (from 0), x, y. One fold a recording, with its own route. Runs without a route have no rows."""

    def follow(t: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        t, line = t.sort_values("tick"), r.sort_values("seq")[["x", "y"]].to_numpy()
        k = away = 0
        places, misses = [], []
        for p in t[["x", "y"]].to_numpy() if len(line) else ():
            d = np.sqrt(((line[k : k + ahead] - p) ** 2).sum(axis=1))
            j = int(d.argmin())
            k, away = (k + j, 0) if d[j] < off else (k, away + 1)
            places.append(k)
            misses.append(away)
        t = t if len(line) else t.iloc[:0]
        return pd.DataFrame({"run": t["run"], "tick": t["tick"], "k": pd.Series(places, index=t.index, dtype="int32"), "off": pd.Series(misses, index=t.index, dtype="int32")})

    return ticks.select("run", "tick", "x", "y").groupBy("run").cogroup(route.select("run", "seq", "x", "y").groupBy("run")).applyInPandas(follow, "run long, tick int, k int, off int")


def in_corridor(rel: DataFrame, length: float, half_width: float) -> DataFrame:
    """The agents ahead of the ego, within ``length`` along and ``half_width`` to either side."""
    return rel.where((F.col("rel_x") > 0) & (F.col("rel_x") <= length) & (F.abs("rel_y") <= half_width))


def best_runway(ticks: DataFrame, turning: DataFrame, floor: int) -> DataFrame:
    """run, tick, runway: of the ticks ``floor`` and those behind a turn, the first with the most ticks to the next turn or
    to the end. ticks: (run, n), one row a run; turning: (run, start, stop). A run that ends before ``floor`` has runway 0."""
    behind = turning.select("run", (F.col("stop") + 1).alias("tick")).join(ticks, "run").where((F.col("tick") < F.col("n")) & (F.col("tick") >= floor)).select("run", "tick")
    asked = ticks.select("run", F.lit(floor).cast("int").alias("tick")).unionByName(behind.withColumn("tick", F.col("tick").cast("int"))).distinct()
    found = ticks_to_next(asked, turning, ticks)
    best = found.groupBy("run").agg(F.max(F.struct("ahead", (-F.col("tick")).alias("up"))).alias("b"))
    some = F.col("b.ahead") > 0
    return best.select("run", F.when(some, -F.col("b.up")).otherwise(floor).alias("tick"), F.when(some, F.col("b.ahead")).otherwise(0).alias("runway"))


def turn_extent(line: DataFrame, span: DataFrame, least: float) -> DataFrame:
    """run, start, stop: where, within the span (run, s0, s1), the heading (degrees) of a polyline (run, s, yaw) turns by more than
    ``least`` degrees a metre: from the first such step's start to the last one's end."""
    w = Window.partitionBy("run").orderBy("s")
    steps = line.withColumn("_s", F.lead("s").over(w)).withColumn("_y", F.lead("yaw").over(w)).where("_s is not null").join(span, "run")
    rate = F.abs(g.wrap_degrees(F.col("_y") - F.col("yaw"))) / F.greatest(F.col("_s") - F.col("s"), F.lit(1e-6))
    hit = steps.where((rate > least) & (F.col("s") >= F.col("s0")) & (F.col("_s") <= F.col("s1")))
    return hit.groupBy("run").agg(F.min("s").alias("start"), F.max("_s").alias("stop"))


def resampled(points: DataFrame, step: float) -> DataFrame:
    """run, i, at, x, y, heading: the polyline (run, s, x, y) at every ``step`` metres before its end; heading: the direction of
    the central difference, of the one step there is at an end."""
    ends = points.groupBy("run").agg(F.max("s").alias("top"))
    many = F.ceil(F.col("top") / step).cast("int")
    places = ends.where(many > 0).withColumn("i", F.explode(F.sequence(F.lit(0), many - 1))).select("run", (F.col("i") * F.lit(step)).alias("at"))
    found = along(points, places, ["run"]).withColumn("i", F.round(F.col("at") / step).cast("int"))
    w = Window.partitionBy("run").orderBy("i")
    side = lambda c: F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))  # noqa: E731  twice the gradient inside
    return found.select("run", "i", "at", "x", "y", F.atan2(side("y"), side("x")).alias("heading"))


def off_route(states: DataFrame, edges: DataFrame, *, every: int = 10, metres: float = 4.0) -> DataFrame:
    """run, tick: the first of every ``every``-th ticks (from the run's first) that is farther from the route than ``metres``; runs
    that stay on it have none. edges: segment, ax, ay, bx, by."""
    w = Window.partitionBy("run").orderBy("tick")
    asked = states.withColumn("_i", F.row_number().over(w) - 1).where(F.col("_i") % every == 0).withColumn("_key", F.struct("run", "tick"))
    far = nearest_segment(asked, edges, "_key").where(F.col("d") > metres)
    return far.groupBy(F.col("_key.run").alias("run")).agg(F.min("_key.tick").alias("tick"))


def candidates(rel: DataFrame, *, least_px: int, least_speed: float) -> DataFrame:
    """run, tick, kind, agent, rank: the agents that could carry out each kind of manoeuvre, nearest first (ties by agent). rel: as
    :func:`relative` gives it, with px, speed, junction and lead (whether the agent is the ego's lead). An agent may be of
    several kinds."""
    ahead, side, c = F.col("rel_x"), F.abs("rel_y"), F.cos("rel_yaw")
    same, opposite, far = c > 0.9, c < -0.9, F.hypot("rel_x", "rel_y")
    leading = F.col("lead") & same & (side < 1.8) & (ahead > 6) & (ahead < 25)
    kinds = {
        "lead_swerve": leading,
        "lead_brake": leading,
        "cut_in": same & (side >= 2) & (side <= 5) & (ahead < 20),
        "oncoming_drift": opposite & (ahead > 8) & (ahead < 35) & (side > 2) & (side < 9),
        "random_swerve": (far < 25) & (same | opposite),
    }
    fit = rel.where((F.col("px") >= least_px) & (F.col("speed") >= least_speed) & (ahead > 3) & ~F.col("junction"))
    named = fit.withColumn("kind", F.explode(F.filter(F.array(*(F.when(holds, name) for name, holds in kinds.items())), lambda k: k.isNotNull())))
    order = Window.partitionBy("run", "tick", "kind").orderBy(far, "agent")
    return named.select("run", "tick", "kind", "agent", F.row_number().over(order).alias("rank"))


def lead_reason(lead: DataFrame) -> DataFrame:
    """lead with reason: the first gate that an ego's lead fails, or ok. lead: rel_x, rel_y, rel_yaw, off_lane, speed, junction;
    rel_x is null where there is no lead."""
    gates = (
        (F.col("rel_x").isNull(), "no lead"),
        (~F.col("rel_x").between(8, 30), "distance"),
        ((F.abs("rel_y") > 1.5) | (F.col("off_lane") > 1.5), "off the lane"),
        (F.cos("rel_yaw") < 0.9, "not aligned"),
        (F.col("speed") < 1, "not moving"),
        (F.coalesce("junction", F.lit(True)), "junction"),
    )
    out = F.lit("ok")
    for fails, name in reversed(gates):
        out = F.when(fails, name).otherwise(out)
    return lead.withColumn("reason", out)


def best_lead(states: DataFrame, rel: DataFrame, ahead: DataFrame, *, runway: int, floor: int = 0, clear: float | None = None) -> DataFrame:
    """run, tick, agent, score: the tick and agent ahead in the ego's lane with the least score 3 |aside| + |along - middle|; the first
    of equal ones. ahead: run, tick, ahead (ticks to the next turn), ``runway`` at least. clear: no agent may be nearer in the
    lane than that, and the agent is beyond it. Runs without a candidate have no row."""
    low = 5.0 if clear is None else clear
    ego = states.where((F.hypot("vx", "vy") >= 3) & (F.col("tick") >= floor)).select("run", "tick").join(ahead.where(F.col("ahead") >= runway).select("run", "tick"), ["run", "tick"])
    near = rel.where((F.cos("rel_yaw") >= 0.7) & (F.col("rel_x") > 0) & (F.col("rel_x") < 25) & (F.abs("rel_y") < 2)).join(ego, ["run", "tick"])
    if clear is not None:
        near = near.join(near.where(F.col("rel_x") < clear).select("run", "tick").distinct(), ["run", "tick"], "left_anti")
    score = F.abs("rel_y") * 3 + F.abs(F.col("rel_x") - (low + 20) / 2)
    found = near.where((F.col("rel_x") > low) & (F.col("rel_x") < 20)).select("run", "tick", "agent", score.alias("score"))
    best = found.groupBy("run").agg(F.min(F.struct("score", "tick", "agent")).alias("b"))
    return best.select("run", "b.tick", "b.agent", "b.score")
