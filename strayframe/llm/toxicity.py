"""Toxicity by a convolutional text classifier in numpy.

A word's embedding is the sum of the hashed embeddings of the word and of its first four and five letters (inflected forms
share those); filters of several widths run over the embeddings, each filter's maximum over the
document is kept, and a logistic layer scores the maxima. Embeddings, filters and the output layer are trained by Adam on
a bounded sample of labelled rows (SAMPLE_ROWS, half of each label where there are as many), in a task of an executor; each row counts as many
training labels as it stands for, so scores and thresholds refer to the labels' own rate at every size. One embedding dimension for
words and one for each kind of beginning start from the label's shrunken log odds in the sample, the others at random. A quarter
of the sample is left out of the fit. Thresholds are calibrated by language on all labelled rows outside the held-out
fold that the fit has not seen, counted by bins of scores; a language with fewer than 5 toxic rows there has the common one.

Scoring is exact over whole texts: a filter over embeddings is a sum of one table row for each of its words, so
scoring is table lookups and maxima.

Defined cases: null, empty and wordless texts get the score of the bias alone. Equal texts get equal scores. Repeated rows
each get the result. Without labels of both kinds every score is the share of toxic labels (0 without labels). An empty
table gives an empty result. Language never enters a score. Other columns of the input are ignored, or kept by the filter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import drop_kept, keeps, prepare, release, stored, text_or_empty
from .learning import Adam, WordTable, best_threshold, fitted_by, fold_of, sigmoid, training_labels

SAMPLE_ROWS = 6000
BUCKETS = 1 << 15
DIMENSIONS = 12
FILTERS = 8
BEGINNINGS = (4, 5)
WIDTHS = (1, 2, 3)
EPOCHS = 6
#: A small sample is gone through more often, up to so many steps of BATCH rows.
LEAST_STEPS, BATCH = 500, 64
THRESHOLD = 0.3
#: Bins of scores that thresholds are chosen between.
BINS = 1024
EDGES = "!?.,;:|()[]{}\"'`*_-…«»¡¿"


def words_of(text: str) -> list[str]:
    return text.lower().split()


def buckets(words: list[str]) -> np.ndarray:
    """Rows of the embedding table for each word: the word's and its beginnings'. Row 0 is the empty place between documents."""
    out = np.zeros((len(words), 1 + len(BEGINNINGS)), dtype=np.int32)
    for i, w in enumerate(words):
        w = w.strip(EDGES)
        out[i, 0] = zlib.crc32(w.encode()) % BUCKETS + 1
        for k, n in enumerate(BEGINNINGS):
            out[i, k + 1] = zlib.crc32(f"{n}|{w[:n]}".encode()) % BUCKETS + 1
    return out


@dataclass
class Network:
    """tables: what each place of each filter gets from a row of the embedding table (places x filters columns).
    seen: the draws of the rows that the fit has seen."""

    tables: np.ndarray
    offsets: np.ndarray
    weights: np.ndarray
    bias: float
    seen: tuple[int, ...] = ()

    def of_words(self, words: list[str]) -> np.ndarray:
        return self.tables[buckets(words)].sum(axis=1)

    def scores(self, documents: list[list[str]], table: WordTable) -> np.ndarray:
        if not documents:
            return np.zeros(0)
        sizes = np.array([len(d) for d in documents], dtype=np.int64)
        pad = max(2, *WIDTHS)
        starts = np.cumsum(np.concatenate([[0], sizes[:-1] + pad]))
        n = int(starts[-1] + sizes[-1]) + pad
        at = np.repeat(starts - np.cumsum(np.concatenate([[0], sizes[:-1]])), sizes) + np.arange(int(sizes.sum()))
        got = np.zeros((n + pad, self.tables.shape[1]), dtype=np.float32)
        got[at] = table.lookup(documents)
        parts = np.stack([starts, starts + sizes + 1], axis=1).ravel()  # a document's words and one empty place
        pooled, column = [], 0
        for w in WIDTHS:
            out = got[:n, column : column + FILTERS].copy()
            for j in range(1, w):
                out += got[j : n + j, column + j * FILTERS : column + (j + 1) * FILTERS]
            column += w * FILTERS
            pooled.append(np.maximum.reduceat(out, parts, axis=0)[::2])
        hidden = np.maximum(np.concatenate(pooled, axis=1) + self.offsets, 0)
        return sigmoid((hidden * self.weights).sum(axis=1) + self.bias)  # each row for itself: equal texts, equal scores


def train(sample: list[tuple[str, int, int]], weights_of: tuple[float, float] = (1.0, 1.0), seed: int = 5) -> Network | float:
    """Fit on the sample, whose rows of each label stand for ``weights_of`` rows; without both labels, the share of ones."""
    truth = np.array([r[1] for r in sample], dtype=np.float64)
    if not len(truth) or truth.min() == truth.max():
        return float(truth.mean()) if len(truth) else 0.0
    stands = np.where(truth == 1, weights_of[1], weights_of[0])
    stands /= stands.mean()
    rng = np.random.default_rng(seed)
    table = WordTable(buckets)
    ids = []
    for r in sample:
        ids.append(table.lookup([words_of(r[0])]))
        table.clear()
    aside = np.arange(len(sample)) % 4 == 3
    fit = np.flatnonzero(~aside)

    odds = np.zeros((2, BUCKETS + 1))
    for i in fit:
        np.add.at(odds[int(truth[i])], np.unique(ids[i]), 1)
    many = np.array([(truth[fit] == 0).sum(), (truth[fit] == 1).sum()]) + 1.0
    times = odds.sum(axis=0)
    seen = np.log((odds[1] + 0.5) / many[1]) - np.log((odds[0] + 0.5) / many[0])
    seen = np.clip(seen, -1, 4) * np.maximum(times - 1, 0) / (times + 4)
    embed = rng.normal(0, 0.02, (BUCKETS + 1, DIMENSIONS))
    for k in range(1 + len(BEGINNINGS)):  # rows are shared by all kinds, so each is known by its own use
        rows = np.unique(np.concatenate([np.unique(x[:, k]) for x in ids]))
        embed[rows, k] += seen[rows]
    embed[0] = 0
    kernels = {w: rng.normal(0, 0.1, (w, DIMENSIONS, FILTERS)) for w in WIDTHS}
    for w in WIDTHS:
        kernels[w][0, : 1 + len(BEGINNINGS)] += 0.5
    weights = np.full(FILTERS * len(WIDTHS), 0.1)
    offsets, bias = np.zeros(FILTERS * len(WIDTHS)), np.array([-1.0])
    steps = {"embed": Adam(embed, 0.01), "weights": Adam(weights, 0.02), "offsets": Adam(offsets, 0.02), "bias": Adam(bias, 0.02)} | {w: Adam(kernels[w], 0.01) for w in WIDTHS}

    batch = min(BATCH, max(1, len(fit) // 8))
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * batch // len(fit)))):
        rng.shuffle(fit)
        for lo in range(0, len(fit), batch):
            own = fit[lo : lo + batch]
            pad = max(WIDTHS)
            flat = np.concatenate([np.concatenate([ids[i], np.zeros((pad, ids[i].shape[1]), np.int32)]) for i in own])
            starts = np.cumsum([0, *(len(ids[i]) + pad for i in own[:-1])])
            n, pooled, places = len(flat), [], []
            flat = np.concatenate([flat, np.zeros((pad, flat.shape[1]), np.int32)])
            x = embed[flat].sum(axis=1)
            ends = np.append(starts[1:], n)
            for w in WIDTHS:
                out = sum(x[j : n + j] @ kernels[w][j] for j in range(w))
                best = np.array([a + out[a : b - pad + 1].argmax(axis=0) for a, b in zip(starts, ends, strict=True)])
                places.append(best)
                pooled.append(np.take_along_axis(out, best, axis=0))
            before = np.concatenate(pooled, axis=1) + offsets
            hidden = np.maximum(before, 0)
            error = stands[own] * (sigmoid(hidden @ weights + bias[0]) - truth[own]) / len(own)
            back = error[:, None] * weights * (before > 0)
            d_embed = np.zeros_like(embed)
            for k, w in enumerate(WIDTHS):
                g, d_kernel = back[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(kernels[w])
                for j in range(w):
                    word = x[places[k] + j]  # documents, filters, dimensions
                    d_kernel[j] = np.einsum("df,dfe->ef", g, word)
                    to, own_part = flat[places[k] + j].reshape(-1, flat.shape[1]), (g[:, :, None] * kernels[w][j].T[None]).reshape(-1, DIMENSIONS)
                    for column in to.T:
                        np.add.at(d_embed, column, own_part)
                steps[w].step(d_kernel)
            d_embed[0] = 0
            steps["embed"].step(d_embed)
            steps["weights"].step(hidden.T @ error + 1e-5 * weights)
            steps["offsets"].step(back.sum(axis=0))
            steps["bias"].step(np.array([error.sum()]))
    single = embed.astype(np.float32)
    return Network(np.concatenate([single @ kernels[w][j].astype(np.float32) for w in WIDTHS for j in range(w)], axis=1), offsets.astype(np.float32), weights.astype(np.float32), float(bias[0]), tuple(sample[i][2] for i in fit))


def fitted(docs: DataFrame, labels: DataFrame, sample_rows: int) -> Network | float:
    return fitted_by(docs, labels, "toxic", sample_rows, train)


_tables: dict[int, tuple[float, WordTable]] = {}
keeps("toxicity", _tables.clear)


def _score(net: Network | float, texts: list[str]) -> np.ndarray:
    if isinstance(net, float):
        return np.full(len(texts), net)
    out = np.zeros(len(texts))
    mark = float(net.tables.sum()) + net.bias
    if 0 not in _tables or _tables[0][0] != mark:  # another network's words
        _tables[0] = (mark, WordTable(net.of_words))
    table = _tables[0][1]
    held: list[list[str]] = []
    done = size = 0
    for i, text in enumerate(texts):
        held.append(words_of(text))
        size += len(held[-1])
        if size > 50_000 or i + 1 == len(texts):
            out[done : i + 1] = net.scores(held, table)
            held, done, size = [], i + 1, 0
    return out


def calibrated(scored: DataFrame, labels: DataFrame, net: Network | float) -> tuple[float, DataFrame]:
    """(common threshold, a row (cut_lang, cut) for each language with labelled rows). scored: doc_id, lang, score of all rows.
    Labelled rows that the fit has not seen are counted; each stands for its share of all labelled rows of its label."""
    spark = scored.sparkSession
    common, cuts = THRESHOLD, []
    if not isinstance(net, float):
        seen = spark.createDataFrame([(draw, True) for draw in net.seen], "draw bigint, seen boolean")
        rows = scored.join(training_labels(labels, "toxic"), "doc_id").join(F.broadcast(seen), "draw", "left")  # SAMPLE_ROWS rows at most
        bins = rows.groupBy("lang", "label", F.floor(F.col("score") * BINS).alias("bin")).agg(
            F.count_if(F.col("seen").isNull()).alias("n"), F.count("*").alias("many"), F.min(F.when(F.col("seen").isNull(), F.col("score"))).alias("low"), F.max(F.when(F.col("seen").isNull(), F.col("score"))).alias("high")
        ).collect()  # fmt: skip  # BINS rows a label and language at most
        weights = tuple(sum(r.many for r in bins if r.label == value) / max(1, sum(r.n for r in bins if r.label == value)) for value in (0, 1))

        def threshold(own: list, default: float) -> float:
            by_bin: dict[int, list] = {}
            for r in own:
                at = by_bin.setdefault(r.bin, [r.low, r.high, 0, 0])
                by_bin[r.bin] = [min(at[0], r.low), max(at[1], r.high), at[2] + r.label * r.n, at[3] + r.n]
            return best_threshold(*np.array([*by_bin.values()], dtype=np.float64).reshape(-1, 4).T, weights, default)

        bins = [r for r in bins if r.n]
        common = threshold(bins, THRESHOLD)
        by_lang: dict[str, list] = {}
        for r in bins:
            by_lang.setdefault(r.lang, []).append(r)
        cuts = [(lang, threshold(own, common)) for lang, own in by_lang.items() if lang is not None]
    return common, spark.createDataFrame(cuts, "cut_lang string, cut double")


def _lang(docs: DataFrame):
    return F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")


def toxicity(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= THRESHOLD), threshold of the row's language, rejected (score >= that)."""
    spark = docs.sparkSession
    prepare(spark)
    net = fitted(docs, labels, sample_rows)
    model = spark.sparkContext.broadcast(net)  # (BUCKETS + 1) x FILTERS x 6 floats

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(_score(model.value, batch.column(3).to_pylist()), pa.float64())], names=["doc_id", "held_out", "lang", "score"])
        drop_kept()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (fold_of("doc_id") == 2).alias("held_out"), _lang(docs).alias("lang"), text_or_empty().alias("text"))
    scored = stored(rows.mapInArrow(score, "doc_id bigint, held_out boolean, lang string, score double"), "scores")
    common, cuts = calibrated(scored, labels, net)
    found = scored.join(F.broadcast(cuts), F.col("lang") == F.col("cut_lang"), "left").withColumn("threshold", F.coalesce("cut", F.lit(common)))  # a row a language
    return found.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("rejected"))


def without_toxic(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs without the rows that the threshold of their language rejects; all columns stay as they are. Rows are stored
    with their scores, so each is scored once."""
    spark = docs.sparkSession
    prepare(spark)
    net = fitted(docs, labels, sample_rows)
    release(spark)
    model = spark.sparkContext.broadcast(net)
    text, name = docs.columns.index("text"), "score_of_text"
    while name in {c.lower() for c in docs.columns}:
        name += "_"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for batch in batches:
            s = _score(model.value, [x or "" for x in batch.column(text).to_pylist()])
            yield batch.append_column(name, pa.array(s, pa.float64()))
        drop_kept()

    scored = stored(docs.mapInArrow(score, StructType([*docs.schema.fields, StructField(name, DoubleType())])), "scored")
    common, cuts = calibrated(scored.select(F.col("doc_id").cast("bigint").alias("doc_id"), _lang(docs).alias("lang"), F.col(name).alias("score")), labels, net)
    cuts = cuts.select(F.col("cut_lang").alias(f"{name}_lang"), F.col("cut").alias(f"{name}_cut"))
    found = scored.join(F.broadcast(cuts), _lang(docs) == F.col(f"{name}_lang"), "left")  # a row a language
    return found.where(F.col(name) < F.coalesce(F.col(f"{name}_cut"), F.lit(common))).drop(name, f"{name}_lang", f"{name}_cut")
