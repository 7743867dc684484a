"""What stands at a place: points and rotated boxes meet in tiles, the boxes in order of their size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import geometry as g
from ..sources.shared import shared_path

#: Side of the finest cells in metres, and cells along the side of a tile; each further level doubles both in metres.
CELL, ACROSS = 4.0, 8
#: Points that a task holds at once, and pairs of points and boxes that it measures at once.
POINTS, PAIRS = 250_000, 500_000


def _kept(df: DataFrame, tag: str) -> DataFrame:
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _Tile:
    """Some points of a tile, and the first box that holds each, of boxes that come in order."""

    def __init__(self, level: int, tx: int, ty: int, margin: float, pairs: int):
        self.side, self.first, self.margin, self.pairs = CELL * 2.0**level, (tx * ACROSS, ty * ACROSS), margin, pairs
        self.given: list[pa.Table] = []
        self.open: tuple[np.ndarray, ...] | None = None

    def ask(self, points: pa.Table) -> None:
        self.given.append(points)

    def _cells(self, c: np.ndarray, axis: int) -> np.ndarray:
        """The cell of a coordinate along an axis, from the tile's first one on; those beside the tile are the nearest beside it."""
        return np.clip(np.floor(c / self.side) - self.first[axis], -1, ACROSS).astype(np.int64)

    def _start(self) -> None:
        rows = pa.concat_tables(self.given).combine_chunks()
        self.given = []
        x, y, z = (rows[c].to_numpy().astype(np.float64) for c in ("x", "y", "z"))
        cell = np.clip(self._cells(x, 0), 0, ACROSS - 1) * ACROSS + np.clip(self._cells(y, 1), 0, ACROSS - 1)
        order = np.argsort(cell, kind="stable")
        self.rows = rows.drop_columns(["x", "y", "z"])
        self.open = tuple(v[order] for v in (cell, np.arange(len(cell)), x, y, z))

    def meet(self, boxes: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """(rows of points, numbers of boxes) of the points that are held by one of these boxes and by none before."""
        if self.open is None:
            self._start()
        b = {c: boxes[c].to_numpy().astype(np.float64) for c in ("x", "y", "ex", "ey", "z", "ez", "cos", "sin", "radius")}
        low = [np.maximum(self._cells(b[c] - b["radius"], a), 0) for a, c in enumerate("xy")]
        high = [np.minimum(self._cells(b[c] + b["radius"], a), ACROSS - 1) for a, c in enumerate("xy")]
        wide = [np.maximum(h - lo + 1, 0) for lo, h in zip(low, high, strict=True)]
        box, at = _spread(wide[0] * wide[1])
        cx, cy = low[0][box] + at // wide[1][box], low[1][box] + at % wide[1][box]
        mx, my = (cx + self.first[0] + 0.5) * self.side - b["x"][box], (cy + self.first[1] + 0.5) * self.side - b["y"][box]
        reach = self.margin + 0.75 * self.side  # half a cell's diagonal and some
        cos, sin = b["cos"][box], b["sin"][box]
        reached = (np.abs(mx * cos + my * sin) <= b["ex"][box] + reach) & (np.abs(-mx * sin + my * cos) <= b["ey"][box] + reach)
        box, cell = box[reached], (cx * ACROSS + cy)[reached]
        done = 0
        while done < len(box) and len(self.open[0]):
            starts, ends = (np.searchsorted(self.open[0], np.arange(ACROSS * ACROSS), side=s) for s in ("left", "right"))
            many = (ends - starts)[cell[done:]]
            n = max(1, int(np.searchsorted(np.cumsum(many), self.pairs, side="right")))
            part = slice(done, done + n)
            done += n
            for lo in range(0, int(many[:n].max(initial=0)), self.pairs):  # one step, but where a cell holds more points than that
                yield from self._step(box[part], starts[cell[part]] + lo, np.clip(many[:n] - lo, 0, self.pairs), b)
            self._shrink()

    def _step(self, box: np.ndarray, start: np.ndarray, many: np.ndarray, b: dict[str, np.ndarray]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        which, at = _spread(many)
        own, point = box[which], start[which] + at
        _, number, x, y, z = self.open
        dx, dy, cos, sin = x[point] - b["x"][own], y[point] - b["y"][own], b["cos"][own], b["sin"][own]
        holds = (np.abs(dx * cos + dy * sin) <= b["ex"][own] + self.margin) & (np.abs(-dx * sin + dy * cos) <= b["ey"][own] + self.margin)
        holds &= np.abs(z[point] - b["z"][own]) <= b["ez"][own] + self.margin
        point, own = point[holds], own[holds]
        point, first = np.unique(point, return_index=True)  # pairs are in the order of boxes
        there = number[point] >= 0
        point, own = point[there], own[first[there]]
        if len(point):
            yield self.rows.take(pa.array(number[point])), own
            number[point] = -1

    def _shrink(self) -> None:
        left = self.open[1] >= 0
        if not left.all():
            self.open = tuple(v[left] for v in self.open)


def _spread(many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's number as often as said, and which of its times it is."""
    which = np.repeat(np.arange(len(many)), many)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)


def boxes_around(points: DataFrame, boxes: DataFrame, keys: list[str], *, margin: float = 1.0) -> DataFrame:
    """keys, box and the further columns of boxes: of the points of each key the smallest box (by volume, then number) that holds one, widened by a
    margin; points in none have no row. points: keys, x, y, z; boxes: box, x, y, z, ex, ey, ez, yaw (centre, half sizes, degrees).
    A box lies in the level whose tiles are half as long as its circle's radius or longer, in the tiles that it reaches; a point asks one tile of each
    level that boxes have. A task holds some points of a tile while the tile's boxes stream past in their order, and a point that is
    held by one meets no further one. So a pair is measured only up to a point's first box, nothing is sorted or sent by pair, and
    each side is shuffled once, boxes once for each POINTS points of a tile."""
    further = [c for c in boxes.columns if c not in {"x", "y", "z", "ex", "ey", "ez", "yaw"}]
    sized = boxes.withColumn("radius", F.hypot(F.col("ex") + margin, F.col("ey") + margin) + 1e-6)  # rounding loses no corner
    sized = sized.withColumn("_level", F.greatest(F.ceil(F.log2(F.greatest("radius", F.lit(CELL)) / (2 * CELL * ACROSS))), F.lit(0)).cast("int")).where("_level IS NOT NULL")
    levels = sorted(r[0] for r in sized.select("_level").distinct().collect())  # the doublings from a metre to a planet are few
    side = CELL * ACROSS * F.pow(F.lit(2.0), F.col("_level"))
    tile = lambda c: F.floor(c / side).cast("bigint")
    ask = F.array(*map(F.lit, levels)).cast("array<int>")
    asked = points.select(*keys, "x", "y", "z", F.explode(ask).alias("_level")).withColumn("_tx", tile(F.col("x"))).withColumn("_ty", tile(F.col("y"))).where("_tx IS NOT NULL AND _ty IS NOT NULL")
    across = lambda c: F.explode(F.sequence(tile(F.col(c) - F.col("radius")), tile(F.col(c) + F.col("radius"))))
    placed = sized.withColumn("_tx", across("x")).withColumn("_ty", across("y"))
    middle = [(F.col(c) + 0.5) * side for c in ("_tx", "_ty")]
    reached = {c: F.col(c) for c in ("x", "y", "z", "ex", "ey", "ez", "yaw")}
    placed = placed.where(g.in_rotated_box(*middle, F.col("z"), reached, margin + 0.75 * side))
    at = ["_level", "_tx", "_ty"]
    crowded = asked.groupBy(*at).count().where(F.col("count") > POINTS).select(*at, F.ceil(F.col("count") / POINTS).cast("int").alias("_parts"))  # a row for each POINTS points at most
    parts = F.coalesce("_parts", F.lit(1))
    crowded = F.broadcast(_kept(crowded, "crowded"))
    asked = asked.join(crowded, at, "left").withColumn("_part", F.pmod(F.xxhash64(*keys, "x", "y", "z"), parts).cast("int"))
    placed = placed.join(crowded, at, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))

    turned = [F.cos(F.radians("yaw")).alias("cos"), F.sin(F.radians("yaw")).alias("sin")]  # once a box and not once a pair
    p = F.struct(*keys, "x", "y", "z")
    b = F.struct((F.col("ex") * F.col("ey") * F.col("ez")).alias("volume"), *further, *turned, *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "ex", "ey", "ez", "radius")))
    kind = lambda df, c: df.select(c.alias("s")).schema[0].dataType
    of_p, of_b = kind(points, p), kind(sized, b)
    at = [*at, "_part"]
    sides = asked.select(*at, p.alias("p"), F.lit(None).cast(of_b).alias("b")).unionByName(placed.select(*at, F.lit(None).cast(of_p).alias("p"), b.alias("b")))
    dealt = sides.repartition(*at).sortWithinPartitions(*at, F.col("b.volume").asc_nulls_first(), F.col("b.box").asc_nulls_first())  # points have no box and come first
    schema = StructType([*(points.schema[k] for k in keys), StructField("volume", DoubleType()), *(boxes.schema[c] for c in further)])

    pairs = PAIRS

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            names = np.stack([batch.column(k).to_numpy() for k in range(4)], axis=1)
            has = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
            change = np.flatnonzero((names[1:] != names[:-1]).any(axis=1) | (has[1:] != has[:-1])) + 1
            for lo, hi in zip([0, *change], [*change, batch.num_rows], strict=True):
                if hi == lo:
                    continue
                if now is None or (names[lo] != now).any():
                    now, held = names[lo], _Tile(*map(int, names[lo][:3]), margin, pairs)
                part = batch.slice(lo, hi - lo)
                if not has[lo]:
                    held.ask(pa.Table.from_struct_array(part.column(4)).combine_chunks())
                elif held.given or held.open is not None:
                    table = pa.Table.from_struct_array(part.column(5))
                    for rows, own in held.meet(table):
                        found = table.select(["volume", *further]).take(pa.array(own))
                        yield from pa.Table.from_arrays([*rows.columns, *found.columns], schema=pa.schema([*rows.schema, *found.schema])).combine_chunks().to_batches()

    found = dealt.mapInArrow(meet, schema)
    best = found.groupBy(*keys).agg(F.min(F.struct("volume", *further)).alias("b"))
    return best.select(*keys, *(F.col(f"b.{c}").alias(c) for c in further))


def named_instances(instances: DataFrame, actors: DataFrame, boxes: DataFrame, keys: list[str], *, margin: float = 1.0) -> DataFrame:
    """keys, object, src: an instance is the actor of its number, else the object whose box holds its foot, else its middle, else what its tag
    says. instances: keys, id, tag, foot and middle (structs x, y, z); actors: id, name; boxes as for :func:`boxes_around` and name. Where
    instances share a key, a foot or middle of any counts for all."""
    known = _kept(instances.join(actors.select("id", F.col("name").alias("_actor")).hint("merge"), "id", "left"), "known")  # read four times
    found = known.where("_actor IS NULL").select(*keys, "foot", "middle")
    named = boxes.select("box", "x", "y", "z", "ex", "ey", "ez", "yaw", "name")
    held = lambda df: df.select(*keys, F.col("box").alias("_box"), F.col("name").alias("_place"))
    foot = _kept(held(boxes_around(found.select(*keys, "foot.*"), named, keys, margin=margin)), "feet")  # read twice
    rest = _kept(found.join(foot.hint("merge"), keys, "left_anti").select(*keys, "middle.*"), "rest")  # read twice
    middle = _kept(held(boxes_around(rest, named, keys, margin=margin)), "middles")
    placed = known.drop("id", "foot", "middle").join(foot.unionByName(middle).hint("merge"), keys, "left")  # a key is in one of them
    src = F.when(F.col("_actor").isNotNull(), "actor").when(F.col("_place").isNotNull(), "place").otherwise("tag")
    return placed.select(*keys, F.coalesce("_actor", "_place", "tag").alias("object"), src.alias("src"))
