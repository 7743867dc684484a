"""Distances of query rows to a pool of reference rows, and what is made of the nearest ones.

Frames are (run, tick, id, v) rows, a pool is (r_run, r_tick, r_id, r) rows. The distances are matrix products, taken for
CHUNK query rows and TILE pool rows at a time, so a worker's memory does not depend on either side; rows that may be among
the nearest are measured again one by one, which gives equal vectors equal distances. A pool of up to POOL_BYTES goes to
the workers by broadcast and nothing is shuffled but the query. For a larger one the query is cut into chunks and the pool into a few
blocks; a task holds one chunk while one block streams past it, so what is shuffled is each side a fixed number of times.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import vec
from ..sources.shared import shared_path

#: Pools of up to this many bytes of vectors are broadcast.
POOL_BYTES = 32 << 20
#: Fewer rows than this are not cut into chunks or blocks.
BLOCK_ROWS = 20_000
#: A larger pool is cut into so many blocks at most, the query into as many chunks as there are cores, LEAST_CHUNKS at least; more
#: if a chunk, with what is kept of its nearest, would take more than CHUNK_BYTES.
BLOCKS, LEAST_CHUNKS, CHUNK_BYTES = 4, 8, 64 << 20
CHUNK, TILE = 256, 8192
#: Products and distances measured one by one differ by less than this, in units of the vectors' size.
SLACK = 1e-9

KINDS = ("cosine", "euclidean", "kl")


def pool_of(frames: DataFrame, runs: list[int]) -> DataFrame:
    """The reference rows as r_run, r_tick, r_id, r."""
    return frames.where(F.col("run").isin(runs)).select(F.col("run").alias("r_run"), F.col("tick").alias("r_tick"), F.col("id").alias("r_id"), F.col("v").alias("r"))


def _products(kind: str, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """What orders the pool for each query row as the distance does, up to rounding."""
    if kind == "cosine":
        return 1 - q @ r.T
    if kind == "kl":
        return (q * np.log(q)).sum(axis=1)[:, None] - q @ np.log(r).T
    return (q * q).sum(axis=1)[:, None] + (r * r).sum(axis=1)[None] - 2 * (q @ r.T)


def _measured(kind: str, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The distances of pairs of rows."""
    if kind == "cosine":
        return 1 - np.einsum("ij,ij->i", q, r)
    if kind == "kl":
        return np.einsum("ij,ij->i", q, np.log(q / r))
    return np.sqrt(np.einsum("ij,ij->i", q - r, q - r))


Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


@dataclass
class _Search:
    """kind, k; snap: smaller distances count as 0; apart: whether pairs with equal marks are left out."""

    kind: str
    k: int
    snap: float | None
    apart: bool

    def tile(self, q: np.ndarray, mark: np.ndarray, r: np.ndarray, r_mark: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, pool row, distance) of all pool rows that may be among the k nearest. last: each query row's k-th distance so far."""
        with np.errstate(divide="ignore", invalid="ignore"):
            near = _products(self.kind, q, r)
        if self.apart and len(r_mark) and (r_mark == r_mark[0]).all():
            near[mark == r_mark[0]] = np.inf
        elif self.apart:
            near[mark[:, None] == r_mark[None]] = np.inf
        top = last if self.kind != "euclidean" else last**2
        for columns in (max(1024, 8 * self.k), near.shape[1]):  # the k-th of some is no nearer than the k-th of all
            open_rows = np.flatnonzero(np.isinf(top))
            if len(open_rows) and near.shape[1] > self.k:
                own = np.partition(near[open_rows, :columns], self.k - 1, axis=1)[:, self.k - 1]  # NaN comes last
                top[open_rows] = np.where(np.isnan(own), np.inf, own)
        if self.snap is not None:
            top = np.maximum(top, self.snap if self.kind != "euclidean" else self.snap**2)
        size = np.abs(q).max(axis=1, initial=1.0) ** 2 * q.shape[1] if self.kind == "euclidean" else 1.0
        i, j = np.nonzero(near <= (top + SLACK * size * (1 + np.abs(np.where(np.isfinite(top), top, 0))))[:, None])
        there = np.isfinite(near[i, j])
        i, j = i[there], j[there]
        d = np.concatenate([_measured(self.kind, q[i[a : a + 100_000]], r[j[a : a + 100_000]]) for a in range(0, len(i), 100_000)] or [np.zeros(0)])
        return i, j, np.where(d < self.snap, 0.0, d) if self.snap is not None else d

    @staticmethod
    def nothing() -> Found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def further(self, found: Found, q: np.ndarray, mark: np.ndarray, r: np.ndarray, r_mark: np.ndarray, at: int) -> Found:
        """(query row, pool row, distance, rank) of the k nearest among those found and r, pool rows that follow them in the order of ties, from row ``at`` on."""
        i, j, d, n = found
        for lo in range(0, len(r), TILE):
            last = np.full(len(q), np.inf)
            last[i[n == self.k]] = d[n == self.k]
            ti, tj, td = self.tile(q, mark, r[lo : lo + TILE], r_mark[lo : lo + TILE], last.copy())
            nearer = td < last[ti]  # of equal ones the first stay
            if not nearer.any():
                continue
            i, j, d = np.concatenate([i, ti[nearer]]), np.concatenate([j, tj[nearer] + lo + at]), np.concatenate([d, td[nearer]])
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            n = np.arange(len(i)) - np.searchsorted(i, i, side="left") + 1
            i, j, d, n = (x[n <= self.k] for x in (i, j, d, n))
        return i, j, d, n


def _matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of equal length, that of the vectors there are if it is not given; a null row or entry is NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = {x for x in column.value_lengths().unique().to_pylist() if x}
    width = width or max(sizes, default=0)
    out = np.full((len(column), width), np.nan)
    if sizes - {width}:
        raise ValueError(f"vectors of lengths {sorted(sizes | {width})}")
    if sizes:
        there = np.flatnonzero(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        out[there] = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(there), width)
    return out


def _codes(values: pa.ChunkedArray | pa.Array, known: dict, grow: bool) -> np.ndarray:
    """Numbers that are compared instead of marks: nulls are alike, what is not known is like nothing known."""
    values = values.to_pylist()
    if grow:
        for x in values:
            known.setdefault(x, len(known))
    return np.fromiter((-1 if x is None else known.get(x, -2) for x in values), dtype=np.int64, count=len(values))


@dataclass
class _Shape:
    """What is given of what is found: the columns that are kept apart, grouped by and that break ties; listed: a row a query row, with
    its nearest as an array, instead of a row a neighbour; width: of the vectors; carried: further columns of the pool in that array."""

    apart: tuple[str, str] | None
    by: str | None
    order: str
    listed: bool
    width: int
    carried: tuple[str, ...] = ()

    def schema(self, query: DataFrame, pool: DataFrame) -> StructType:
        kept = [f for f in query.schema.fields if f.name != "v"]
        if self.listed:
            near = ArrayType(StructType([StructField("d", DoubleType()), *(StructField(c, pool.schema[c].dataType) for c in (self.order, *self.carried))]))
            return StructType([*kept, pool.schema[self.by], StructField("near", near)])
        return StructType([*kept, *(f for f in pool.schema.fields if f.name != "r"), StructField("d", DoubleType()), StructField("n", IntegerType())])

    def table(self, q: pa.Table, r: pa.Table, found: Found) -> pa.Table:
        i, j, d, n = found
        if self.listed:
            first = np.flatnonzero(n == 1)
            told = [self.order, *self.carried]
            near = pa.StructArray.from_arrays([pa.array(d, pa.float64()), *(r[c].take(pa.array(j)).combine_chunks() for c in told)], names=["d", *told])
            out = q.take(pa.array(i[first])).append_column(self.by, r[self.by].take(pa.array(j[first])))
            return out.append_column("near", pa.ListArray.from_arrays(pa.array(np.append(first, len(i)), pa.int32()), near))
        left, right = q.take(pa.array(i)), r.take(pa.array(j))
        both = pa.Table.from_arrays([*left.columns, *right.columns], names=[*left.column_names, *right.column_names])
        return both.append_column("d", pa.array(d, pa.float64())).append_column("n", pa.array(n, pa.int32()))


def nearest(
    query: DataFrame, pool: DataFrame, k: int, kind: str, *, apart: tuple[str, str] | None = None, by: str | None = None, snap: float | None = None,
    order: str = "r_id", listed: bool = False, carried: tuple[str, ...] = (), pool_bytes: int = POOL_BYTES, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The columns of query (but v) and of pool (but r), d, n (rank from 1): the k nearest of each query row, ties by
    ``order``. A pool of fewer rows gives all.

    kind: cosine (of unit vectors), euclidean or kl. apart: columns of query and pool that may not be equal. by: a pool column;
    the k nearest of each of its values. snap: smaller distances count as 0. Rows with a null in their vector have no distance.
    listed (with by): the columns of query, by and near instead, the k nearest as an array of (d, order, carried), in their order."""
    if kind not in KINDS:
        raise ValueError(f"no distance {kind}")
    if listed and not by:
        raise ValueError("lists are by a column of the pool")
    width = pool.select(F.max(F.size("r")).alias("w")).first()[0] or 0
    if width < 1:
        pool, width = pool.limit(0), 1  # no vectors, no distances
    search, shape = _Search(kind, k, snap, apart is not None), _Shape(apart, by, order, listed, width, carried)
    fits = max(1, pool_bytes // (8 * width))
    held = pool.limit(fits + 1).toArrow()  # pool_bytes and a row at most
    if held.num_rows > fits:
        return _nearest_of_large(query, pool, search, shape, block_rows)
    if not held.num_rows:
        return query.sparkSession.createDataFrame([], shape.schema(query, pool))
    held = held.sort_by([*([(by, "ascending")] if by else []), (order, "ascending")])
    spread = query.repartition(int(query.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kept = query.sparkSession.sparkContext.broadcast((held.drop_columns(["r"]), _matrix(held["r"], width)))
    del held

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, w = kept.value
        known: dict = {}
        r_mark = _codes(r[apart[1]], known, True) if apart else np.zeros(len(w), np.int64)
        names = r[by].to_pylist() if by else []
        ends = [*(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(w)]
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                q = pa.Table.from_batches([batch.slice(lo, CHUNK)])
                v = _matrix(q["v"], width)
                mark = _codes(q[apart[0]], known, False) if apart else np.zeros(len(v), np.int64)
                for a, b in zip([0, *ends], ends, strict=False):
                    found = search.further(search.nothing(), v, mark, w[a:b], r_mark[a:b], a)
                    yield from shape.table(q.drop_columns(["v"]), r, found).combine_chunks().to_batches()

    return spread.mapInArrow(find, shape.schema(query, pool))


class _Chunk:
    """A chunk of the query, and the nearest of those pool rows that it has met."""

    def __init__(self, search: _Search, shape: _Shape):
        self.search, self.shape, self.known = search, shape, {}
        self.rows: list[pa.Table] = []
        self.vectors: list[np.ndarray] = []
        self.marks: list[np.ndarray] = []
        self.forget()

    def forget(self) -> None:
        self.found: list[Found] = [self.search.nothing() for _ in self.vectors]
        self.met: pa.Table | None = None

    def ask(self, q: pa.Table, v: pa.Array) -> None:
        """Query rows, CHUNK at most."""
        self.rows.append(q.take(pa.array(np.arange(q.num_rows))).combine_chunks())  # a copy: the batch may go
        self.vectors.append(_matrix(v, self.shape.width))
        self.marks.append(_codes(q[self.shape.apart[0]], self.known, True) if self.shape.apart else np.zeros(q.num_rows, np.int64))
        self.found.append(self.search.nothing())

    def meet(self, r: pa.Table, w: np.ndarray) -> None:
        """The next pool rows in the order of ties."""
        at = self.met.num_rows if self.met else 0
        mark = _codes(r[self.shape.apart[1]], self.known, False) if self.shape.apart else np.zeros(len(w), np.int64)
        self.met = pa.concat_tables([self.met, r]) if self.met else r
        self.found = [self.search.further(f, v, m, w, mark, at) for f, v, m in zip(self.found, self.vectors, self.marks, strict=True)]
        if self.met.num_rows > 8 * TILE:  # only what is among the nearest stays
            used = np.unique(np.concatenate([f[1] for f in self.found])) if self.found else np.zeros(0, np.int64)
            self.found = [(i, np.searchsorted(used, j), d, n) for i, j, d, n in self.found]
            self.met = self.met.take(pa.array(used)).combine_chunks()

    def answers(self) -> Iterator[pa.RecordBatch]:
        if self.met:
            for q, found in zip(self.rows, self.found, strict=True):
                if len(found[0]):
                    yield from self.shape.table(q, self.met, found).combine_chunks().to_batches()
        self.forget()


def _stretches(cells: list, sides: list, names: list) -> list[tuple[int, int]]:
    """Where cell, side and group stay the same."""
    ends = [k for k in range(1, len(cells)) if cells[k] != cells[k - 1] or sides[k] != sides[k - 1] or names[k] != names[k - 1]]
    return list(zip([0, *ends], [*ends, len(cells)], strict=True))


def _nearest_of_large(query: DataFrame, pool: DataFrame, search: _Search, shape: _Shape, block_rows: int) -> DataFrame:
    """Each chunk of the query meets each block of the pool in a task of its own, which holds the chunk while the block streams past it in the order of
    ties. Blocks are whole groups where there are groups; otherwise the best of the few blocks are ranked."""
    spark, by, order, schema = query.sparkSession, shape.by, shape.order, shape.schema(query, pool)
    path = shared_path(spark, "numbered")  # a task that runs again would number rows otherwise
    query.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    left = spark.read.schema(query.withColumn("_row", F.lit(0).cast("bigint")).schema).parquet(path)
    rows, points = left.count(), pool.count()
    held = rows * (8 * shape.width + 48 * search.k)
    chunks = max(1, min(-(-rows // block_rows), max(LEAST_CHUNKS, spark.sparkContext.defaultParallelism)), -(-held // CHUNK_BYTES))
    blocks = max(1, min(-(-points // block_rows), BLOCKS))

    asked = [c for c in left.columns if c != "v"]
    there = [c for c in pool.columns if c != "r"]
    q, r = F.struct(*asked), F.struct(*there)
    chunk = F.pmod(F.xxhash64("_row"), F.lit(chunks)).cast("int")
    block = F.pmod(F.xxhash64(by or order), F.lit(blocks)).cast("int")
    no_q, no_r = F.lit(None).cast(left.select(q.alias("x")).schema[0].dataType), F.lit(None).cast(pool.select(r.alias("x")).schema[0].dataType)
    sides = left.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: chunk * blocks + b)).alias("cell"), F.lit(0).alias("side"), q.alias("q"), no_r.alias("r"), F.col("v").alias("x"))
    sides = sides.unionByName(pool.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda c: c * blocks + block)).alias("cell"), F.lit(1).alias("side"), no_q.alias("q"), r.alias("r"), F.col("r").alias("x")))
    grouped = [F.col("r")[by]] if by else []
    dealt = sides.repartitionById(chunks * blocks, F.col("cell")).sortWithinPartitions("cell", "side", *grouped, F.col("r")[order].asc_nulls_last())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, waiting = (None, None), _Chunk(search, shape), []

        def met() -> None:
            if waiting:
                held.meet(pa.concat_tables([t for t, _ in waiting]).combine_chunks(), np.concatenate([w for _, w in waiting]))
                waiting.clear()

        for batch in batches:
            cells, sides = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names = batch.column(3).field(by).to_pylist() if by else [None] * len(cells)
            for a, b in _stretches(cells, sides, names):
                if (cells[a], names[a] if sides[a] else now[1]) != now:  # another group, or another chunk
                    met()
                    yield from held.answers()
                    if cells[a] != now[0]:
                        held = _Chunk(search, shape)
                    now = (cells[a], names[a])
                step = TILE if sides[a] else CHUNK
                for lo in range(a, b, step):
                    part = batch.slice(lo, min(step, b - lo))
                    table = pa.Table.from_struct_array(part.column(3 if sides[a] else 2))
                    if not sides[a]:
                        held.ask(table, part.column(4))
                        continue
                    waiting.append((table.take(pa.array(np.arange(table.num_rows))), _matrix(part.column(4), shape.width)))
                    if sum(len(w) for _, w in waiting) >= TILE:
                        met()
        met()
        yield from held.answers()

    number = left.schema["_row"]
    found = dealt.mapInArrow(meet, StructType([*schema.fields[: len(asked) - 1], number, *schema.fields[len(asked) - 1 :]]))
    if by:
        return found.drop("_row")
    found = found.drop("n")
    return found.withColumn("n", F.row_number().over(Window.partitionBy("_row").orderBy("d", order))).where(F.col("n") <= search.k).drop("_row")


def mean_distance(found: DataFrame, k: int) -> DataFrame:
    """run, tick, score: the mean of the k smallest distances."""
    return found.where(F.col("n") <= k).groupBy("run", "tick").agg(F.avg("d").alias("score"))


def unit_frames(frames: DataFrame) -> DataFrame:
    return frames.withColumn("v", vec.unit("v"))


def moments(pool: DataFrame, vector: str = "r") -> DataFrame:
    """One row: mu, sigma (population; below 1e-6 it counts as 1) by component."""
    flat = pool.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    flat = flat.withColumn("s", F.when(F.col("s") < 1e-6, 1.0).otherwise(F.col("s")))
    both = flat.agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("c"))  # as long as a vector
    return both.select(F.transform("c", lambda x: x["m"]).alias("mu"), F.transform("c", lambda x: x["s"]).alias("sigma"))


def standardised(df: DataFrame, vector: str, of: DataFrame) -> DataFrame:
    """(x - mu) / sigma with the one row of moments."""
    joined = df.crossJoin(F.broadcast(of))  # one row
    scaled = F.zip_with(F.zip_with(vector, "mu", lambda x, m: x - m), "sigma", lambda x, s: x / s)
    return joined.withColumn(vector, scaled).drop("mu", "sigma")


def centred(df: DataFrame, vector: str, of: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(of)).withColumn(vector, F.zip_with(vector, "mu", lambda x, m: x - m)).drop("mu", "sigma")


def first_per_label(rows: DataFrame, label: str, order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy(order))).where("_n = 1").drop("_n")


def worst_share(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Mean of the largest round(share * n) values of a group, one at least (half to even)."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("_n", F.row_number().over(w.orderBy(F.desc(value)))).withColumn("_m", F.greatest(F.lit(1), F.bround(F.count("*").over(w) * share).cast("int")))
    return ranked.where("_n <= _m").groupBy(*keys).agg(F.avg(value).alias("score"))
