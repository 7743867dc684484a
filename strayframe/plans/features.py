"""Kinematics and geometry of recorded states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import kinematics as kin
from ..sources.tables import AGENTS, STATES, agents, states, table
from .registry import query, r6

_WRAP = "atan2(sin({0}), cos({0}))"
_EGO = f"""
l AS (SELECT *, vx * cos(yaw) + vy * sin(yaw) AS v FROM states),
k AS (SELECT run, tick, v AS v_long, {_WRAP.format("yaw - lag(yaw) OVER w")} / 0.1::DOUBLE AS yaw_rate, (v - lag(v) OVER w) / 0.1::DOUBLE AS a_long, (v - 2 * lag(v) OVER w + lag(v, 2) OVER w) / 0.01::DOUBLE AS jerk FROM l WINDOW w AS (PARTITION BY run ORDER BY tick))"""
_REL = f"""
rel AS (SELECT run, tick, agent, (x - ex) * cos(eyaw) + (y - ey) * sin(eyaw) AS rel_x, -(x - ex) * sin(eyaw) + (y - ey) * cos(eyaw) AS rel_y, {_WRAP.format("yaw - eyaw")} AS rel_yaw,
    (vx - evx) * cos(eyaw) + (vy - evy) * sin(eyaw) AS rel_vx, -(vx - evx) * sin(eyaw) + (vy - evy) * cos(eyaw) AS rel_vy, sqrt((x - ex) ** 2 + (y - ey) ** 2) AS dist
    FROM agents JOIN (SELECT run, tick, x AS ex, y AS ey, yaw AS eyaw, vx AS evx, vy AS evy FROM states) USING (run, tick))"""
_ROLE = """
roles AS (SELECT *, CASE WHEN cos(rel_yaw) > 0.7 THEN CASE WHEN abs(rel_y) <= 2 THEN CASE WHEN rel_x > 0 THEN 'lead' ELSE 'follower' END WHEN abs(rel_y) <= 5.5 THEN CASE WHEN rel_y < 0 THEN 'left' ELSE 'right' END END
    WHEN cos(rel_yaw) < -0.7 THEN 'oncoming' ELSE 'crossing' END AS role FROM rel),
slots AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, tick, role ORDER BY CASE WHEN role IN ('lead', 'follower') THEN abs(rel_x) ELSE dist END, agent) AS i FROM roles WHERE role IS NOT NULL AND dist <= CASE role WHEN 'lead' THEN 40 WHEN 'oncoming' THEN 30 ELSE 25 END) WHERE i = 1)"""


@query(f"WITH {STATES}, {_EGO} SELECT run, tick, round(v_long, 5) AS v_long, round(yaw_rate, 5) AS yaw_rate, round(a_long, 5) AS a_long, round(v_long * yaw_rate, 5) AS a_lat, round(jerk, 4) AS jerk FROM k")
def e06_ego_kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = kin.ego_kinematics(states(spark, sf_dir))
    return k.select("run", "tick", *(F.round(c, 5).alias(c) for c in ("v_long", "yaw_rate", "a_long", "a_lat")), F.round("jerk", 4).alias("jerk"))


@query(f"WITH {STATES}, {AGENTS}, {_REL} SELECT run, tick, agent, round(rel_x, 6) AS rel_x, round(rel_y, 6) AS rel_y, round(rel_yaw, 6) AS rel_yaw, round(rel_vx, 6) AS rel_vx, round(rel_vy, 6) AS rel_vy, round(dist, 6) AS dist FROM rel")
def e04_relative_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = kin.relative(states(spark, sf_dir), agents(spark, sf_dir))
    return rel.select("run", "tick", "agent", *(r6(c).alias(c) for c in rel.columns[3:]))


@query(f"WITH {STATES}, {AGENTS}, {_REL}, o AS (SELECT *, row_number() OVER (PARTITION BY run, tick ORDER BY dist, agent) AS rank FROM rel WHERE dist <= 20) SELECT run, tick, agent, CAST(rank AS INT) AS rank, round(dist, 6) AS dist FROM o WHERE rank <= 3")
def f02_nearest_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = kin.nearest_agents(kin.relative(states(spark, sf_dir), agents(spark, sf_dir)), 3, 20.0)
    return near.select("run", "tick", "agent", "rank", r6("dist").alias("dist"))


@query(f"WITH {STATES}, {AGENTS}, {_REL}, {_ROLE} SELECT run, tick, role, agent, round(dist, 6) AS dist, CASE WHEN -rel_vx > 0.1 THEN round(least(greatest(rel_x / -rel_vx, 0), 10), 5) ELSE 10 END AS ttc FROM slots")
def e07_role_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest agent of each role, with the time to collision."""
    s = kin.role_slots(kin.relative(states(spark, sf_dir), agents(spark, sf_dir)))
    return s.select("run", "tick", "role", "agent", r6("dist").alias("dist"), F.round(g.time_to_collision(F.col("rel_x"), F.col("rel_vx")), 5).alias("ttc"))


@query(f"""
WITH {STATES}, {AGENTS}, l AS (SELECT *, lag(yaw) OVER w AS before, lag(tick) OVER w AS seen FROM agents WINDOW w AS (PARTITION BY run, agent ORDER BY tick))
SELECT run, tick, agent, CASE WHEN seen = tick - 1 THEN round({_WRAP.format("yaw - before")} / 0.1::DOUBLE, 5) ELSE 0 END AS yaw_rate FROM l
""")
def w03_agent_yaw_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the same agent one tick before; 0 where it was not there."""
    return kin.agent_yaw_rate(agents(spark, sf_dir)).select("run", "tick", "agent", F.round("yaw_rate", 5).alias("yaw_rate"))


def _show(v: str) -> list:
    """A vector's length, sum and alternating sum: scalars that any misplaced entry changes."""
    return [F.size(v).cast("int").alias("width"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 3).alias("total"), F.round(F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 2).alias("moment")]


@query(f"""
WITH {STATES}, {AGENTS}, {_REL}, rate AS (SELECT a.run, a.tick, a.agent, coalesce({_WRAP.format("a.yaw - b.yaw")} / 0.1::DOUBLE, 0) AS r FROM agents a LEFT JOIN agents b ON a.run = b.run AND a.agent = b.agent AND a.tick = b.tick + 1),
e AS (SELECT run, tick, x, y, yaw, vx, vy, {_WRAP.format("yaw - lag(yaw) OVER (PARTITION BY run ORDER BY tick)")} / 0.1::DOUBLE AS er FROM states),
n AS (SELECT *, row_number() OVER (PARTITION BY run, tick ORDER BY dist, agent) AS i FROM rel JOIN rate USING (run, tick, agent) WHERE dist <= 40),
f AS (SELECT run, tick, list([rel_x, rel_y, rel_yaw, rel_vx, rel_vy, r - er] ORDER BY i) AS f FROM n JOIN e USING (run, tick) WHERE i <= 5 GROUP BY run, tick),
v AS (SELECT e.run, e.tick, [x, y, yaw, vx, vy, er] || coalesce(flatten(f), []) AS v FROM e LEFT JOIN f ON e.run = f.run AND e.tick = f.tick WHERE er IS NOT NULL)
SELECT run, tick, CAST(36 AS INT) AS width, round(list_sum(v), 3) AS total, round(list_sum(list_transform(v, lambda x, i: x * i)), 2) AS moment FROM v
""")
def physics_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kin.physics_vector(states(spark, sf_dir), agents(spark, sf_dir)).select("run", "tick", *_show("v"))


def _dealt(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """States and agents that stay where they are once their events are dealt by run."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return states(spark, sf_dir, parts), agents(spark, sf_dir, parts)


_SLOT = "CASE WHEN role = '{0}' THEN [1, rel_x, rel_y, rel_vx, rel_vy] END"


@query(f"""
WITH {STATES}, {AGENTS}, {_EGO}, {_REL}, {_ROLE}, z AS (SELECT [0.0::DOUBLE, 0, 0, 0, 0] AS z),
r AS (SELECT run, tick, {", ".join(f"coalesce(max({_SLOT.format(x)}), any_value(z))" + f" AS r{i}" for i, x in enumerate(g.ROLES))},
    coalesce(max(CASE WHEN role = 'lead' THEN CASE WHEN -rel_vx > 0.1 THEN least(greatest(rel_x / -rel_vx, 0), 10) ELSE 10 END END), 10) AS ttc FROM slots, z GROUP BY run, tick),
v AS (SELECT k.run, k.tick, [v_long, yaw_rate, a_long, v_long * yaw_rate, jerk] || {" || ".join(f"coalesce(r{i}, z)" for i in range(6))} || [coalesce(ttc, 10.0)] AS v FROM k LEFT JOIN r ON k.run = r.run AND k.tick = r.tick, z WHERE jerk IS NOT NULL)
SELECT run, tick, CAST(len(v) AS INT) AS width, round(list_sum(v), 3) AS total, round(list_sum(list_transform(v, lambda x, i: x * i)), 2) AS moment FROM v
""")
def role_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kin.role_vector(*_dealt(spark, sf_dir)).select("run", "tick", *_show("v"))


@query()
def role_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """436 numbers a frame from ten ticks; held against a plain loop in the tests."""
    return kin.role_history(*_dealt(spark, sf_dir)).select("run", "tick", *_show("v"))


@query(f"""
WITH {STATES}, d AS (SELECT run, tick, abs({_WRAP.format("yaw - lag(yaw) OVER (PARTITION BY run ORDER BY tick)")}) AS d FROM states), h AS (SELECT run, tick FROM d WHERE d > 0.42),
n AS (SELECT run, tick, sum(CASE WHEN p IS NULL OR tick - p > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY tick) AS part FROM (SELECT run, tick, lag(tick) OVER (PARTITION BY run ORDER BY tick) AS p FROM h))
SELECT run, min(tick) AS start, max(tick) AS stop FROM n GROUP BY run, part
""")
def w04_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kin.turns(states(spark, sf_dir), step=0.42)


@query(f"""
WITH {STATES}, starts AS (SELECT run, tick AS start FROM states WHERE event_id % 9 = 0), n AS (SELECT run, CAST(count(*) AS INT) AS n FROM states GROUP BY run)
SELECT s.run, s.tick, coalesce((SELECT min(start) FROM starts t WHERE t.run = s.run AND t.start > s.tick), n.n) - s.tick AS ahead FROM states s JOIN n ON n.run = s.run
""")
def j14_ticks_to_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = states(spark, sf_dir)
    starts = s.where("event_id % 9 = 0").select("run", F.col("tick").alias("start"))
    return kin.ticks_to_next(s, starts, s.groupBy("run").agg(F.count("*").cast("int").alias("n")))


@query(f"""
WITH {STATES}, o AS (SELECT run, tick, tick - row_number() OVER (PARTITION BY run ORDER BY tick) AS part FROM states WHERE vx > 6)
SELECT run, min(tick) AS start, max(tick) AS stop, count(*) AS n FROM o GROUP BY run, part HAVING count(*) >= 3
""")
def w11_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kin.spells(states(spark, sf_dir), ["run"], F.col("vx") > 6, 3)


@query(f"""
WITH {STATES}, d AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM states WINDOW w AS (PARTITION BY run ORDER BY tick))
SELECT run, round(sum(d), 4) AS distance, round(avg(CASE WHEN sqrt(vx * vx + vy * vy) < 5 THEN 1.0 ELSE 0.0 END), 6) AS stopped_share, count(*) AS n FROM d GROUP BY run
""")
def g24_trip_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kin.trip_summary(states(spark, sf_dir), slow=5.0).select("run", F.round("distance", 4).alias("distance"), r6("stopped_share").alias("stopped_share"), "n")


_ARC = """
d AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS d FROM states WINDOW w AS (PARTITION BY run ORDER BY tick)),
a AS (SELECT run, tick, x, y, sum(d) OVER (PARTITION BY run ORDER BY tick) AS s FROM d)"""


@query(f"WITH {STATES}, {_ARC} SELECT run, tick, round(s, 5) AS s FROM a")
def e15_arc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kin.arc_length(states(spark, sf_dir), ["run"], "tick").select("run", "tick", F.round("s", 5).alias("s"))


@query(f"""
WITH {STATES}, {_ARC}, n AS (SELECT run, tick, x, y, s, lead(s) OVER w AS s1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM a WINDOW w AS (PARTITION BY run ORDER BY s)),
top AS (SELECT run, max(s) AS m FROM a GROUP BY run), p AS (SELECT run, CAST(k AS DOUBLE) * 1.7 + 0.313 AS pl, least(CAST(k AS DOUBLE) * 1.7 + 0.313, m) AS c FROM top, range(0, 20) t(k)),
j AS (SELECT p.run, p.pl, p.c, n.*, row_number() OVER (PARTITION BY p.run, p.pl ORDER BY n.s DESC) AS i FROM p JOIN n ON p.run = n.run AND n.s <= p.c)
SELECT run, round(pl, 3) AS "at", round(x + coalesce((c - s) / nullif(s1 - s, 0), 0) * coalesce(x1 - x, 0), 4) AS x, round(y + coalesce((c - s) / nullif(s1 - s, 0), 0) * coalesce(y1 - y, 0), 4) AS y FROM j WHERE i = 1
""")
def e14_along_polyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points at given lengths along each run's path: an as-of join and a straight line between vertices."""
    points = kin.arc_length(states(spark, sf_dir), ["run"], "tick")
    places = points.select("run").distinct().select("run", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k")).select("run", (F.col("k").cast("double") * 1.7 + 0.313).alias("at"))
    return kin.along(points, places, ["run"]).select("run", F.round("at", 3).alias("at"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_EDGES = [(p, i, float(ax), float(ay), float(bx), float(by)) for p, pts in enumerate(([(2, -1), (30, -1), (30, 1), (2, 1)], [(5, 0.2), (20, 1.5), (8, 2.0)])) for i, ((ax, ay), (bx, by)) in enumerate(zip(pts, pts[1:] + pts[:1], strict=True))]
_EDGE_SQL = "edges(polygon, segment, ax, ay, bx, by_) AS (VALUES " + ", ".join(f"({p}, {i}, {ax}::DOUBLE, {ay}::DOUBLE, {bx}::DOUBLE, {by}::DOUBLE)" for p, i, ax, ay, bx, by in _EDGES) + ")"


def _edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_EDGES, "polygon int, segment int, ax double, ay double, bx double, by double")


@query(f"""
WITH {STATES}, {_EDGE_SQL} SELECT event_id, CAST(polygon AS INT) AS polygon FROM states, edges WHERE (ay > y) <> (by_ > y) AND x < (bx - ax) * (y - ay) / nullif(by_ - ay, 0) + ax GROUP BY event_id, polygon HAVING count(*) % 2 = 1
""")
def e19_points_in_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kin.inside(states(spark, sf_dir), _edges(spark), "event_id")


@query(f"""
WITH {STATES}, {_EDGE_SQL}, t AS (SELECT event_id, x, y, polygon * 10 + segment AS segment, ax, ay, bx, by_, least(greatest(((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2), 0), 1) AS t FROM states, edges)
SELECT event_id, round(min(sqrt((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by_ - ay)) ** 2)), 6) AS d FROM t GROUP BY event_id
""")
def e20_nearest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark).withColumn("segment", F.col("polygon") * 10 + F.col("segment")).drop("polygon")
    return kin.nearest_segment(states(spark, sf_dir), edges, "event_id").select("event_id", r6("d").alias("d"))


@query("""
WITH b AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS w, l_extendedprice AS p FROM lineitem)
SELECT k, n, round((k % 256 + (n * 37 % 256) * 256.0 + (k % 2) * 65536.0) / 16777215.0 * 1000.0, 5) AS depth, CAST(((n % 30) << 16) | (k % 256 + (n % 256) * 256) AS BIGINT) AS key, round(100 - w / 2, 6) AS x0, round(100 + w / 2, 6) AS x1,
    round(sqrt(4 + 2 * 3 * greatest(w - 20, 0)), 6) AS cap, round((p + 180) - 360 * floor((p + 180) / 360) - 180, 4) AS degrees, round(0.25 * 1.0 + 0.5 * w + 0.25 * 9.0, 6) AS curve FROM b
""")
def e_pixel_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of a pixel, instance key, box corners, speed cap, wrapped degrees and a curve's middle."""
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("w"), F.col("l_extendedprice").alias("p"))
    k, n, w = F.col("k"), F.col("n"), F.col("w")
    x0, _, x1, _ = g.corners(F.lit(100.0), F.lit(0.0), w, F.lit(1.0))
    return b.select(
        "k", "n", F.round(g.depth(k % 256, n * 37 % 256, k % 2), 5).alias("depth"), g.instance_key(n % 30, k % 256, n % 256).cast("bigint").alias("key"), r6(x0).alias("x0"), r6(x1).alias("x1"),
        r6(g.speed_cap(F.lit(2.0), w - 20, F.lit(3.0))).alias("cap"), F.round(g.wrap_degrees(F.col("p")), 4).alias("degrees"), r6(g.bezier(F.lit(1.0), w, F.lit(9.0), F.lit(0.5))).alias("curve"),
    )


@query(f"""
WITH {STATES} SELECT event_id, CAST(k AS INT) AS k, round(x - vx * 0.1 * k, 6) AS x, round(y - vy * 0.1 * k, 6) AS y FROM states, range(0, 5) t(k)
""")
def e18_back_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constant velocity backwards, five steps."""
    s = states(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return s.select("event_id", "k", r6(F.col("x") - F.col("vx") * 0.1 * F.col("k")).alias("x"), r6(F.col("y") - F.col("vy") * 0.1 * F.col("k")).alias("y"))


@query(f"""
WITH {STATES}, c AS (SELECT event_id, (event_id % 64 - 32) * 2.0 / (32 / tan(45 * pi() / 180)) * 10 / 20 AS right_, (event_id % 48 - 24) * 1.0 AS dn, radians(event_id % 20 - 10.0) AS p, yaw, radians(event_id % 6 - 3.0) AS r, x, y FROM states),
d AS (SELECT *, (event_id % 64 - 32) * 8.0 / 32 AS ri, -(event_id % 48 - 24) * 8.0 / 32 AS up FROM c)
SELECT event_id, round(x + cos(p) * cos(yaw) * 8.0 + (cos(yaw) * sin(p) * sin(r) - sin(yaw) * cos(r)) * ri + (-cos(yaw) * sin(p) * cos(r) - sin(yaw) * sin(r)) * up, 5) AS wx,
    round(y + cos(p) * sin(yaw) * 8.0 + (sin(yaw) * sin(p) * sin(r) + cos(yaw) * cos(r)) * ri + (-sin(yaw) * sin(p) * cos(r) + cos(yaw) * sin(r)) * up, 5) AS wy, round(1.6 + sin(p) * 8.0 - cos(p) * sin(r) * ri + cos(p) * cos(r) * up, 5) AS wz FROM d
""")
def e11_back_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World position of a pixel of a 64 x 48 image with a view of 90 degrees, 8 metres away."""
    i = F.col("event_id")
    cam = {"x": F.col("x"), "y": F.col("y"), "z": F.lit(1.6), "pitch": i % 20 - 10.0, "yaw": F.degrees("yaw"), "roll": i % 6 - 3.0}
    wx, wy, wz = g.back_projected((i % 64).cast("double"), (i % 48).cast("double"), F.lit(8.0), cam, 64, 48, 90.0)
    return states(spark, sf_dir).select("event_id", F.round(wx, 5).alias("wx"), F.round(wy, 5).alias("wy"), F.round(wz, 5).alias("wz"))


@query(f"""
WITH {STATES}, b(obj, x, y, z, ex, ey, ez, yaw) AS (VALUES ('tree', 6.0, 0.9, 0.0, 2.0, 1.0, 1.0, 20.0), ('house', 9.0, 0.5, 0.0, 6.0, 3.0, 2.0, -35.0), ('sign', 12.0, 1.2, 0.0, 0.5, 0.5, 2.0, 0.0)),
h AS (SELECT event_id, obj, ex * ey * ez AS vol FROM states s JOIN b ON abs((s.x - b.x) * cos(radians(b.yaw)) + (s.y - b.y) * sin(radians(b.yaw))) <= ex + 1 AND abs(-(s.x - b.x) * sin(radians(b.yaw)) + (s.y - b.y) * cos(radians(b.yaw))) <= ey + 1)
SELECT event_id, obj FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY vol, obj) AS i FROM h) WHERE i = 1
""")
def f15_smallest_box_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the rotated boxes around a point, widened by a metre, the smallest."""
    boxes = spark.createDataFrame([("tree", 6.0, 0.9, 0.0, 2.0, 1.0, 1.0, 20.0), ("house", 9.0, 0.5, 0.0, 6.0, 3.0, 2.0, -35.0), ("sign", 12.0, 1.2, 0.0, 0.5, 0.5, 2.0, 0.0)], "obj string, bx double, by double, bz double, ex double, ey double, ez double, byaw double")
    box = {k: F.col(v) for k, v in {"x": "bx", "y": "by", "z": "bz", "ex": "ex", "ey": "ey", "ez": "ez", "yaw": "byaw"}.items()}
    hit = states(spark, sf_dir).join(F.broadcast(boxes), g.in_rotated_box(F.col("x"), F.col("y"), F.lit(0.0), box))  # map geometry
    return hit.groupBy("event_id").agg(F.min(F.struct(F.col("ex") * F.col("ey") * F.col("ez"), F.col("obj").alias("obj"))).alias("m")).select("event_id", "m.obj")


_CAND = "rich AS (SELECT *, (tick * 29 + agent * 13) % 500 AS px, (tick + agent) % 9 * 0.5::DOUBLE AS speed, tick % 11 = 0 AS junction, agent = 3 AS lead, (tick % 5) * 0.4::DOUBLE AS off_lane FROM rel)"


def _rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = F.col("tick"), F.col("agent")
    rel = kin.relative(states(spark, sf_dir), agents(spark, sf_dir))
    return rel.withColumns({"px": (t * 29 + k * 13) % 500, "speed": (t + k) % 9 * 0.5, "junction": t % 11 == 0, "lead": k == 3, "off_lane": t % 5 * 0.4})


@query(f"""
WITH {STATES}, {AGENTS}, {_REL}, {_CAND}, c AS (SELECT *, sqrt(rel_x ** 2 + rel_y ** 2) AS far, abs(rel_y) AS side, cos(rel_yaw) AS c FROM rich WHERE px >= 100 AND speed >= 1 AND rel_x > 3 AND NOT junction),
k AS (SELECT run, tick, agent, far, unnest(list_filter([CASE WHEN lead AND c > 0.9 AND side < 1.8 AND rel_x > 6 AND rel_x < 25 THEN 'lead_swerve' END, CASE WHEN lead AND c > 0.9 AND side < 1.8 AND rel_x > 6 AND rel_x < 25 THEN 'lead_brake' END,
    CASE WHEN c > 0.9 AND side BETWEEN 2 AND 5 AND rel_x < 20 THEN 'cut_in' END, CASE WHEN c < -0.9 AND rel_x > 8 AND rel_x < 35 AND side > 2 AND side < 9 THEN 'oncoming_drift' END, CASE WHEN far < 25 AND (c > 0.9 OR c < -0.9) THEN 'random_swerve' END], lambda x: x IS NOT NULL)) AS kind FROM c)
SELECT run, tick, kind, agent, CAST(row_number() OVER (PARTITION BY run, tick, kind ORDER BY far, agent) AS INT) AS rank FROM k
""")
def f09_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agents that could carry out each of five kinds of manoeuvre, the nearest first."""
    return kin.candidates(_rich(spark, sf_dir), least_px=100, least_speed=1.0)


@query(f"""
WITH {STATES}, {AGENTS}, {_REL}, {_CAND}, {_ROLE} SELECT s.run, s.tick, CASE WHEN rel_x IS NULL THEN 'no lead' WHEN rel_x NOT BETWEEN 8 AND 30 THEN 'distance' WHEN abs(rel_y) > 1.5 OR off_lane > 1.5 THEN 'off the lane' WHEN cos(rel_yaw) < 0.9 THEN 'not aligned'
    WHEN speed < 1 THEN 'not moving' WHEN junction THEN 'junction' ELSE 'ok' END AS reason FROM states s LEFT JOIN (SELECT r.* FROM rich r JOIN slots l ON r.run = l.run AND r.tick = l.tick AND r.agent = l.agent WHERE l.role = 'lead') x ON s.run = x.run AND s.tick = x.tick
""")
def f10_lead_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first gate that a frame's lead fails."""
    rich = _rich(spark, sf_dir)
    lead = kin.role_slots(rich).where("role = 'lead'")
    s = states(spark, sf_dir).select("run", "tick").join(lead, ["run", "tick"], "left")
    return kin.lead_reason(s).select("run", "tick", "reason")


@query(f"""
WITH {STATES}, w AS (SELECT run, tick, count(*) OVER h AS n, round(avg(vx) OVER h, 6) AS mean_vx, round(first_value(x) OVER h, 6) AS oldest_x FROM states WINDOW h AS (PARTITION BY run ORDER BY tick ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT run, tick, mean_vx, oldest_x FROM w WHERE n = 5
""")
def w02_trailing_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five states, only once there are five."""
    from pyspark.sql.window import Window

    h = Window.partitionBy("run").orderBy("tick").rowsBetween(-4, 0)
    s = states(spark, sf_dir).withColumn("h", F.collect_list(F.struct("x", "vx")).over(h)).where(F.size("h") == 5)
    return s.select("run", "tick", r6(F.aggregate("h", F.lit(0.0), lambda a, v: a + v["vx"]) / 5).alias("mean_vx"), r6(F.col("h")[0]["x"]).alias("oldest_x"))
