"""Quality by supervised subword embeddings in numpy.

A document is the mean of the vectors of its words and of their character n-grams, all hashed into one table (a word that
repeats the one in front of it counts as a mark of that); a softmax layer tells the label. Vectors and output layer are trained together by stochastic gradient descent with a falling rate on
a bounded sample of labelled rows (SAMPLE_ROWS, half of each label where there are as many), in a task of an executor.

The output is linear in the mean, so a word adds a fixed amount to the difference of the two outputs; scoring adds up the
words' amounts over whole texts.

Defined cases: null, empty and wordless texts get the score of the bias alone. Equal texts get equal scores. Repeated rows
each get the result. Without labels of both kinds every score is the share of ones (0 without labels). An empty table gives
an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_or_empty
from .learning import WordTable, fitted_by, fold_of, sigmoid

SAMPLE_ROWS = 4000
BUCKETS = 1 << 17
DIMENSIONS = 8
N_GRAMS = (2, 3, 4)
EPOCHS = 8
RATE = 20.0
THRESHOLD = 0.7


#: Stands for a word that repeats the one in front of it.
SAME = "\x02"


def words_of(text: str) -> list[str]:
    words = text.split()
    return words[:1] + [SAME if a == b else b for a, b in pairwise(words)]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) pairs of all words: the word itself and its n-grams with marked ends. Rows of the vector table."""
    raw = [b"<" + w.encode() + b">" for w in words]
    data = np.frombuffer(b"".join(raw) + bytes(8), dtype=np.uint8).astype(np.uint32)
    sizes = np.array([len(x) for x in raw], dtype=np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(raw)), sizes)
    place = np.arange(int(ends[-1]) if len(ends) else 0)
    left = ends[owner] - place if len(ends) else place
    owners = [np.arange(len(raw))]
    rows = [np.array([zlib.crc32(x) % BUCKETS for x in raw], dtype=np.int64)]
    for n in N_GRAMS:
        at = place[left >= n]
        h = np.full(len(at), n, dtype=np.uint32)
        for k in range(n):
            h = (h ^ data[at + k]) * np.uint32(16777619)
            h ^= h >> np.uint32(15)
        owners.append(owner[at])
        rows.append((h % np.uint32(BUCKETS)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(rows)


@dataclass
class Model:
    """amounts: what a table row adds to the difference of the outputs."""

    amounts: np.ndarray
    bias: float

    def of_words(self, words: list[str]) -> np.ndarray:
        """(amount, number of features) of each word."""
        owners, rows = features(words)
        return np.column_stack([np.bincount(owners, self.amounts[rows], minlength=len(words)), np.bincount(owners, minlength=len(words))])

    def scores(self, documents: list[list[str]], table: WordTable) -> np.ndarray:
        values = table.lookup(documents)
        owner = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
        total, many = (np.bincount(owner, values[:, k], minlength=len(documents)) for k in (0, 1))
        return sigmoid(total / np.maximum(many, 1) + self.bias)


def train(sample: list[tuple[str, int, int]], _stands: tuple[float, float] = (1.0, 1.0), seed: int = 3) -> Model | float:
    """Fit on the sample, both labels counting alike; without both labels, the share of ones."""
    truth = np.array([r[1] for r in sample], dtype=np.int64)
    if not len(truth) or truth.min() == truth.max():
        return float(truth.mean()) if len(truth) else 0.0
    rng = np.random.default_rng(seed)
    rows, shares = [], []
    for text, *_ in sample:
        buckets, times = np.unique(features(words_of(text))[1], return_counts=True)
        rows.append(buckets.astype(np.int32))
        shares.append((times / max(1, times.sum())).astype(np.float32))
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    outputs, bias = np.zeros((DIMENSIONS, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    weight = 0.5 / np.maximum(np.bincount(truth, minlength=2) / len(truth), 1e-9)
    order, batch = np.arange(len(sample)), 16
    total, done = EPOCHS * ((len(order) + batch - 1) // batch), 0
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            rate, done = RATE * (1 - done / total) / 40, done + 1
            own = own[[len(rows[i]) > 0 for i in own]]
            if not len(own):
                continue
            hidden = np.array([shares[i] @ vectors[rows[i]] for i in own])
            logits = hidden @ outputs + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), truth[own]] -= 1
            p *= weight[truth[own]][:, None]
            back = (p @ outputs.T).astype(np.float32)
            outputs -= rate * (hidden.T @ p).astype(np.float32)
            bias -= rate * p.sum(axis=0).astype(np.float32) / len(own)
            for i, g in zip(own, back, strict=True):
                vectors[rows[i]] -= (rate * 40) * shares[i][:, None] * g
    return Model((vectors @ (outputs[:, 1] - outputs[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def fitted(docs: DataFrame, labels: DataFrame, sample_rows: int) -> Model | float:
    return fitted_by(docs, labels, "quality", sample_rows, train)


_tables: dict[int, tuple[float, WordTable]] = {}


def quality(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= THRESHOLD)."""
    spark = docs.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(fitted(docs, labels, sample_rows))  # BUCKETS numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        mark = 0.0 if isinstance(net, float) else float(net.amounts.sum())
        if 0 not in _tables or _tables[0][0] != mark:  # another model's words
            _tables[0] = (mark, WordTable(net.of_words) if not isinstance(net, float) else WordTable(lambda w: np.zeros((len(w), 2))))
        table = _tables[0][1]
        for batch in batches:
            out, held, size = [], [], 0
            for text in batch.column(2).to_pylist():
                held.append(words_of(text))
                size += len(held[-1])
                if size > 50_000:
                    out.append(net.scores(held, table) if not isinstance(net, float) else np.full(len(held), net))
                    held, size = [], 0
            if held:
                out.append(net.scores(held, table) if not isinstance(net, float) else np.full(len(held), net))
            s = np.concatenate([*out, np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (fold_of("doc_id") == 2).alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(score, "doc_id bigint, held_out boolean, score double, predicted int")
