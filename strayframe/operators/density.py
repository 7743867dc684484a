"""Scores from the pool's covariance. Moments are summed in Spark; only D x D matrices reach the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from . import knn
from .conformal import ranks


@dataclass
class Moments:
    """Sums over rows x, each less a common origin: how many, x, x x', |x|^4 and |x|^2 x. Those of a part can be taken away."""

    n: int
    one: np.ndarray
    two: np.ndarray
    four: float
    three: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        q = np.einsum("ij,ij->i", x, x)
        return cls(len(x), x.sum(axis=0), x.T @ x, float(q @ q), q @ x)

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.one + other.one, self.two + other.two, self.four + other.four, self.three + other.three)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.one - other.one, self.two - other.two, self.four - other.four, self.three - other.three)

    def mean(self) -> np.ndarray:
        return self.one / self.n

    def covariance(self, sample: bool = True) -> np.ndarray:
        m = self.mean()
        return (self.two - self.n * np.outer(m, m)) / (self.n - 1 if sample else self.n)

    def fourth(self) -> float:
        """Mean of |x - mean|^4, from |x - m|^2 = |x|^2 - 2 m.x + |m|^2."""
        m = self.mean()
        mm, q = float(m @ m), float(np.trace(self.two))
        return (self.four + 4 * m @ self.two @ m + self.n * mm * mm - 4 * m @ self.three + 2 * mm * q - 4 * mm * m @ self.one) / self.n

    def shrunk(self) -> tuple[np.ndarray, float]:
        """(covariance drawn towards a multiple of the identity, by what share). The share is the mean squared error of the
        covariance, estimated from the rows' own products, over its squared distance from that multiple, 1 at most (Ledoit and Wolf)."""
        raw = self.covariance(sample=False)
        level = np.trace(raw) / len(raw)
        target = level * np.eye(len(raw))
        far = np.square(raw - target).sum()
        error = (self.fourth() - np.square(raw).sum()) / self.n
        share = float(min(1.0, error / far)) if error and far else 0.0
        return raw + share * (target - raw), share


SUMS = "n bigint, one array<double>, two array<double>, four double, three array<double>"


def _row(m: Moments) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"n": [m.n], "one": [m.one.tolist()], "two": [m.two.ravel().tolist()], "four": [m.four], "three": [m.three.tolist()]})


def _read(row) -> Moments:
    d = len(row.one)
    return Moments(row.n, np.array(row.one), np.array(row.two).reshape(d, d), row.four, np.array(row.three))


def _less_origin(rows: DataFrame, vector: str) -> tuple[DataFrame, np.ndarray]:
    """The vectors less a first row's, which keeps the digits."""
    first = rows.select(vector).first()
    if first is None:
        raise ValueError("the pool is empty")
    shift = F.array(*(F.lit(float(x)) for x in first[0]))
    return rows.withColumn(vector, F.zip_with(vector, shift, lambda x, o: x - o)), np.array(first[0], dtype=np.float64)


def moments(pool: DataFrame, vector: str = "r") -> tuple[Moments, np.ndarray]:
    """(moments, their origin) in one pass."""
    moved, origin = _less_origin(pool, vector)
    d = len(origin)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Moments.of(np.zeros((0, d)))
        for batch in batches:
            total = total + Moments.of(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
        yield _row(total)

    parts = moved.select(vector).mapInArrow(sums, SUMS).collect()  # one row a task, D x D numbers
    return sum((_read(p) for p in parts[1:]), start=_read(parts[0])), origin


def moments_by_run(frames: DataFrame, vector: str = "v") -> tuple[dict, np.ndarray]:
    """(moments of each run, their origin). Sums are made by task and run, so no run is held whole; a row a run reaches the driver."""
    moved, origin = _less_origin(frames, vector)
    d = len(origin)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def given() -> Iterator[pa.RecordBatch]:
            for run, m in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([run], kind_of[0]), *_row(m).columns], names=["run", *_row(m).schema.names])
            held.clear()

        kind_of: list = []
        for batch in batches:
            kind_of[:] = [batch.schema.field(0).type]
            coded = batch.column(0).dictionary_encode()
            codes, x = coded.indices.to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for k, run in enumerate(coded.dictionary.to_pylist()):
                held[run] = held[run] + Moments.of(x[codes == k]) if run in held else Moments.of(x[codes == k])
            if len(held) > 256:
                yield from given()
        yield from given()

    def added(table: pa.Table) -> pa.Table:
        rows = table.drop_columns(["run"]).to_pylist()
        total = sum((_read(SimpleNamespace(**r)) for r in rows[1:]), start=_read(SimpleNamespace(**rows[0])))
        return pa.Table.from_batches([_row(total)]).add_column(0, table.schema.field("run"), table["run"].slice(0, 1))

    kind = dict(frames.dtypes)["run"]
    rows = moved.where("run IS NOT NULL").select("run", vector).mapInArrow(parts, f"run {kind}, {SUMS}").groupBy("run").applyInArrow(added, f"run {kind}, {SUMS}").collect()
    return {r.run: _read(r) for r in rows}, origin


def covariance(pool: DataFrame, vector: str = "r", sample: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, covariance, n)."""
    found, origin = moments(pool, vector)
    return origin + found.mean(), found.covariance(sample), found.n


def whitening(cov: np.ndarray) -> np.ndarray:
    """W with |W d|^2 = d' pinv(cov) d: the axes of the covariance, each over its spread; axes without spread go."""
    axes, variance, _ = np.linalg.svd(cov, hermitian=True)
    kept = variance > 1e-15 * variance.max(initial=0.0)
    return axes[:, kept].T / np.sqrt(variance[kept])[:, None]


def transformed(df: DataFrame, vector: str, matrix: np.ndarray, mean: np.ndarray | None = None) -> DataFrame:
    """vector -> matrix (vector - mean), as a projection of dot products."""
    rows = F.expr(f"array({', '.join('array(' + ', '.join(f'{float(x)!r}D' for x in r) + ')' for r in matrix)})")  # one call for D x D numbers
    moved = F.col(vector) if mean is None else F.zip_with(vector, F.array(*(F.lit(float(x)) for x in mean)), lambda x, m: x - m)
    return df.withColumn(vector, moved).withColumn(vector, F.transform(rows, lambda r: vec.dot(r, F.col(vector))))


def mahalanobis(query: DataFrame, pool: DataFrame, k: int, *, apart: tuple[str, str] | None = None) -> DataFrame:
    """Mean distance to the k nearest pool rows under the pool's inverse sample covariance: whitened once, then Euclidean."""
    w = whitening(covariance(pool)[1])
    return knn.mean_distance(knn.nearest(transformed(query, "v", w), transformed(pool, "r", w), k, "euclidean", apart=apart), k)


def pca_whitened(query: DataFrame, pool: DataFrame, k: int, most: int = 64) -> DataFrame:
    """Centred, projected on min(most, n / 10) components of unit spread, then Euclidean neighbours."""
    mean, cov, n = covariance(pool)
    values, vectors = np.linalg.eigh(cov)
    keep = max(1, min(most, n // 10, int((values > 1e-12).sum())))
    w = (vectors[:, ::-1][:, :keep] / np.sqrt(values[::-1][:keep])).T
    return knn.mean_distance(knn.nearest(transformed(query, "v", w, mean), transformed(pool, "r", w, mean), k, "euclidean"), k)


def shrinkage(pool: DataFrame, vector: str = "r") -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, shrunk covariance, share)."""
    found, origin = moments(pool, vector)
    return origin + found.mean(), *found.shrunk()


def to_mean(query: DataFrame, pool: DataFrame) -> DataFrame:
    """run, tick, score: distance to the pool's mean under the shrunk covariance."""
    mean, cov, _ = shrinkage(pool)
    moved = transformed(query, "v", whitening(cov), mean)
    return moved.select("run", "tick", vec.norm("v").alias("score"))


def to_mean_apart(frames: DataFrame, runs: list[int]) -> DataFrame:
    """run, tick, score of each run against the others: every fit is the sum over all runs less the run's own."""
    own = frames.where(F.col("run").isin(runs))
    by_run, origin = moments_by_run(own)
    total = sum(list(by_run.values())[1:], start=next(iter(by_run.values())))
    fits = {run: (origin + (total - m).mean(), whitening((total - m).shrunk()[0])) for run, m in by_run.items() if total.n > m.n}
    kept = frames.sparkSession.sparkContext.broadcast(fits)  # D x D numbers a run

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            run = np.array(batch.column(0).to_pylist())
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(run), -1)
            out = np.full(len(run), np.nan)
            for name in set(run.tolist()) & set(kept.value):
                mean, w = kept.value[name]
                rows = run == name
                out[rows] = np.linalg.norm((x[rows] - mean) @ w.T, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, mask=np.isnan(out))], names=["run", "tick", "score"])

    kinds = dict(frames.dtypes)
    return own.select("run", "tick", "v").mapInArrow(score, f"run {kinds['run']}, tick {kinds['tick']}, score double")


def spread(pool: DataFrame, vector: str = "r") -> dict[str, float]:
    """Participation ratio of the components and the share of the first two; for unit vectors also the mean cosine distance
    of two different rows, over all pairs (from the length of their sum)."""
    found, origin = moments(pool, vector)
    values = np.clip(np.linalg.eigvalsh(found.covariance()), 0, None)
    total = found.one + found.n * origin
    squares = float(np.trace(found.two) + 2 * origin @ found.one + found.n * origin @ origin)
    mean_cos = (float(total @ total) - squares) / (found.n * (found.n - 1))
    return {"participation": float(values.sum() ** 2 / (values**2).sum()), "top2": float(np.sort(values)[::-1][:2].sum() / values.sum()), "mean_distance": 1 - mean_cos}


def random_pairs(pool: DataFrame, pairs: int, vector: str = "r", key: str = "r_id") -> DataFrame:
    """pair, d: cosine distances of pairs of different rows of unit vectors, drawn by arithmetic on the rows' numbers (by key), so both
    sides are joined by number and no row meets all others."""
    numbered = ranks(pool.select(key), [], key).select(F.col(key).alias("_key"), (F.col("_lo") - 1).alias("_at"), F.col("_of").alias("_n"))
    rows = pool.select(F.col(key).alias("_key"), F.col(vector).alias("_v")).join(numbered.select("_key", "_at"), "_key").drop("_key")
    n = numbered.agg(F.coalesce(F.max("_n"), F.lit(1)).cast("bigint").alias("n"))
    drawn = pool.sparkSession.range(pairs).withColumnRenamed("id", "pair").crossJoin(F.broadcast(n))  # one row
    drawn = drawn.select("pair", ((F.col("pair") * 7919 + 13) % F.col("n")).alias("i"), ((F.col("pair") * 104729 + F.expr("pair div 3") + 71) % F.col("n")).alias("j")).where("i <> j")
    left = drawn.join(rows.select(F.col("_at").alias("i"), F.col("_v").alias("_a")), "i")
    both = left.join(rows.select(F.col("_at").alias("j"), F.col("_v").alias("_b")), "j")
    return both.select("pair", (1 - vec.dot("_a", "_b")).alias("d"))


def projected(rows: DataFrame, pool: DataFrame, vector: str = "v", components: int = 2) -> DataFrame:
    """rows with their vector on the pool's first principal components; each axis points to where its largest loading is positive."""
    mean, cov, _ = covariance(pool)
    _, axes = np.linalg.eigh(cov)
    w = axes[:, ::-1][:, :components].T
    w = w * np.sign(w[np.arange(len(w)), np.abs(w).argmax(axis=1)])[:, None]
    return transformed(rows, vector, w, mean)
