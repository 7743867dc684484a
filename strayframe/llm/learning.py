"""What the two text classifiers share: labelled samples and hashed word features."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_kept, given_back, text_or_empty

#: Entries of a worker's word table; it is emptied when full.
TABLE_WORDS = 300_000
#: Characters of text that a fit reads at most.
SAMPLE_BYTES = 32_000_000


def fold_of(doc_id):
    """The fold of a document: crc32 of doc_id as text, mod 4 (null: fold 0)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)), F.lit(0))


def training_labels(labels: DataFrame, label: str, held_out: int = 2) -> DataFrame:
    """doc_id, label, draw (hash of doc_id) of all labelled rows outside the held-out fold."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    return known.where(fold_of("doc_id") != held_out).withColumn("draw", F.xxhash64("doc_id"))


def sampled(docs: DataFrame, labels: DataFrame, label: str, rows: int, held_out: int = 2) -> DataFrame:
    """(draw, doc_id, text, label) of at most ``rows`` labelled rows outside the held-out fold, each label up to one half.
    The rows are those with the smallest hash of doc_id, so the sample is the same for any order of the input. Of several
    texts of a doc_id the one of the least hash counts."""
    known = training_labels(labels, label, held_out)
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy("draw", "doc_id").limit(rows // 2)
        picked = part if picked is None else picked.unionByName(part)
    wide = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    found = wide.join(F.broadcast(picked), "doc_id")  # ``rows`` rows at most
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"]
    return found.groupBy("draw", "doc_id", "label").agg(one.alias("text")).select("draw", "doc_id", "text", "label")


def fitted_by(docs: DataFrame, labels: DataFrame, label: str, rows: int, train: Callable[[list[tuple[str, int, int]], tuple[float, float]], object]) -> object:
    """What ``train`` makes of the sample, as (text, label, draw) rows, and of how many training labels a row of label 0
    and one of label 1 stands for. One task of an executor reads the sample, of at most ``rows`` rows and SAMPLE_BYTES of text,
    and trains; the driver sees the finished model alone. Texts are whole; the sample ends where the bytes are reached."""
    many = dict(training_labels(labels, label).groupBy("label").count().collect())  # two rows
    taken = sampled(docs, labels, label, rows).repartition(1).sortWithinPartitions("draw", "doc_id")  # ``rows`` rows at most

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        sample: list[tuple[str, int, int]] = []
        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                draw, _, text, value = (c[k].as_py() for c in batch.columns)
                if size < SAMPLE_BYTES:
                    sample.append((text, value, draw))
                    size += len(text)
        stands = tuple(max(1.0, many.get(v, 0) / max(1, sum(r[1] == v for r in sample))) for v in (0, 1))
        model = pickle.dumps(train(sample, stands))
        del sample
        given_back()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    made = taken.mapInArrow(fit, "model binary").first()
    return pickle.loads(made[0]) if made else train([], (1.0, 1.0))  # noqa: S301  written by our own task; none without rows


class WordTable:
    """Numbers for words; what is computed of a word is computed once per worker, for many words together."""

    def __init__(self, compute: Callable[[list[str]], np.ndarray]):
        self.compute = compute
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.values: np.ndarray | None = None
        self.size = 0

    def lookup(self, documents: list[list[str]]) -> np.ndarray:
        """The values of all words of the documents, one after the other."""
        flat = list(chain.from_iterable(documents))
        if self.size > TABLE_WORDS:
            self.clear()
        new = list(dict.fromkeys(w for w in flat if w not in self.number))
        if new or self.values is None:
            fresh = self.compute(new)
            if self.values is None:
                self.values = np.zeros((1 << 16, *fresh.shape[1:]), dtype=fresh.dtype)
            while self.size + len(new) > len(self.values):
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            self.values[self.size : self.size + len(new)] = fresh
            self.number.update(zip(new, range(self.size, self.size + len(new)), strict=True))
            self.size += len(new)
        return self.values[np.fromiter(map(self.number.__getitem__, flat), dtype=np.int64, count=len(flat))]


class Adam:
    """One array's steps."""

    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate, self.m, self.v, self.t = value, rate, np.zeros_like(value), np.zeros_like(value), 0

    def step(self, gradient: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.001 * (gradient * gradient - self.v)
        self.value -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def best_threshold(low: np.ndarray, high: np.ndarray, positives: np.ndarray, counts: np.ndarray, weights: tuple[float, float], default: float) -> float:
    """The score above which F1 is best, from bins of scores: the middle of the gap below the last accepted bin.
    low, high: the least and the greatest score of each bin; positives, counts: its rows of label 1 and all of its rows;
    weights: what a row of label 0 and one of label 1 stands for."""
    if positives.sum() < 5 or positives.sum() == counts.sum():
        return default
    order = np.argsort(-low, kind="stable")
    low, high, hits = low[order], high[order], np.cumsum(weights[1] * positives[order])
    f1 = 2 * hits / (np.cumsum(weights[0] * (counts - positives)[order]) + hits + hits[-1])
    best = int(np.argmax(f1))
    return float(low[best] / 2 + (high[best + 1] if best + 1 < len(low) else 0.0) / 2)
