"""Points in rotated boxes against a plain loop."""

import math
import random

import pytest
from strayframe.operators import places

POINT, BOX = "k int, x double, y double, z double", "box int, x double, y double, z double, ex double, ey double, ez double, yaw double, name string"


def holds(p, b, margin=1.0):
    dx, dy, c, s = p[0] - b[1], p[1] - b[2], math.cos(math.radians(b[7])), math.sin(math.radians(b[7]))
    return abs(dx * c + dy * s) <= b[4] + margin and abs(-dx * s + dy * c) <= b[5] + margin and abs(p[2] - b[3]) <= b[6] + margin


def made(seed):
    """Boxes from half a metre to some kilometres, copies among them; keys with several points."""
    rng = random.Random(seed)
    boxes = []
    for k in range(120):
        size = rng.choice([0.5, 2.0, 30.0, 90.0, 900.0, 4000.0])
        boxes.append((k, rng.uniform(-150, 150), rng.uniform(-150, 150), rng.uniform(-2, 2), size * rng.uniform(0.2, 1), rng.choice([0.1, 1.0, size]), rng.uniform(0, 3), rng.uniform(-200, 200), f"b{k}"))
    boxes += [(1000 - b[0], *b[1:8], f"copy of {b[0]}") for b in boxes[:40]] + [(2000, None, 0.0, 0.0, 9.0, 9.0, 9.0, 0.0, "nowhere")]
    points = [(k % 700, rng.uniform(-170, 170), rng.uniform(-170, 170), rng.uniform(-3, 3)) for k in range(900)] + [(701, 0.0, None, 0.0), (702, 9e5, -9e5, 0.0)]
    points += [(703 + k, *b[1:4]) for k, b in enumerate(boxes[:120])]
    return points, boxes


@pytest.mark.parametrize("way", [{}, {"POINTS": 7}, {"PAIRS": 3}, {"POINTS": 40, "PAIRS": 50}])
def test_the_smallest_box_of_a_key(spark, monkeypatch, way):
    """Whatever a task holds and measures at once."""
    for k, v in way.items():
        monkeypatch.setattr(places, k, v)
    points, boxes = made(3)
    want = {}
    for k, *p in points:
        for b in boxes:
            if None not in p and b[1] is not None and holds(p, b):
                want[k] = min(want.get(k, (math.inf, 0, "")), (b[4] * b[5] * b[6], b[0], b[8]))
    got = places.boxes_around(spark.createDataFrame(points, POINT), spark.createDataFrame(boxes, BOX), ["k"]).collect()
    assert {r.k: (r.box, r.name) for r in got} == {k: v[1:] for k, v in want.items()} and len(got) == len(want) > 500


def test_no_boxes(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], POINT)
    assert places.boxes_around(points, spark.createDataFrame([], BOX), ["k"]).count() == 0


def test_pairs_of_points_and_boxes_are_no_rows(spark):
    """A crowd in one place meets a crowd of boxes without a join that gives, and an aggregate that sorts, their pairs."""
    points = spark.createDataFrame([(k, 0.01 * k, 0.0, 0.0) for k in range(300)], POINT)
    boxes = spark.createDataFrame([(k, 0.0, 0.01 * k, 0.0, 9.0 + k % 7, 9.0, 9.0, 0.0, "") for k in range(300)], BOX)
    df = places.boxes_around(points, boxes, ["k"])
    assert {(r.k, r.box) for r in df.collect()} == {(k, 0) for k in range(300)}
    assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
