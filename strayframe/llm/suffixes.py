"""Repeated passages by sparse suffix arrays.

A suffix starts at a minimiser: the word position whose gram of GRAM words has the smallest hash among WINDOW grams in a
row. Equal runs of WINDOW + GRAM - 1 words hold the same minimisers, so every repeat of that length, wherever it lies,
has a sampled suffix in each of its copies. The sampled suffixes whose gram occurs in two documents are sorted in ranges by the
words that follow; each is compared with the neighbours before and after it that come from another document, and the
match is extended to the right and to the left, word by word. Matches of ``least`` words or more are kept, and overlapping or
touching ones of a document become one span; a long repeat is covered by the matches of the minimisers along it.

Suffixes and the words left of them are held as RIGHT and LEFT hashes of three bytes a word, enough to reach the next
sampled suffix to either side. Neighbours across two ranges are compared in a last step over the ranges' ends. A passage
that a third of all documents have is a run of equal suffixes, which ranges split anywhere.

Where other suffixes that match less far left come between a suffix and its copy, the neighbours do not show the repeat.
So each window of ``least`` words belongs to the minimiser of its first WINDOW grams, and at a distance from it. Windows of a
suffix that the neighbours' matches do not cover but whose right part is no longer than the longest match to the right (no
copy can match further) are open. All suffixes of the gram, covered or not, then hash their windows at the open distances, and
equal hashes in two documents are repeats, too.

Every span is a real repeat, and all words of a repeat of ``least`` words or more are found. Words are compared by three
bytes of their hash, so once in 1.7e7 an end of a span may reach a word too far.

Defined cases: null, empty and short texts have no spans. Rows with equal doc_id and text are one document (one set of
spans); so copies under other ids are repeats. A null doc_id is reported as null. An empty table gives an empty result. Other
columns of the input are ignored. Words are what white space parts, with A-Z in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare, shuffle_partitions, stored, text_or_empty

GRAM, WINDOW = 10, 30
LEFT, RIGHT = 39, 60
WIDTH = 3
#: Grams with open windows are broadcast up to this number of them (about 50 bytes each).
BROADCAST_GRAMS = 400_000


def word_hashes(text: str) -> np.ndarray:
    one = xxhash.xxh3_64_intdigest
    return np.array([one(w) for w in text.encode().lower().split()], dtype=np.uint64)


def minimisers(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, gram hashes, reach) of the sampled suffixes. reach: the least and the greatest distance (times WINDOW
    and added) to the starts of the windows whose minimiser it is."""
    n = len(words) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gram = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        gram = (gram ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        gram ^= gram >> np.uint64(31)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    best = np.lib.stride_tricks.sliding_window_view(gram, WINDOW).argmin(axis=1) + np.arange(n - WINDOW + 1)
    at, first, many = np.unique(best, return_index=True, return_counts=True)  # best never falls
    return at, gram[at], (at - first - many + 1) + WINDOW * (at - first)


def _contexts(words: np.ndarray, at: np.ndarray, longest: int) -> tuple[list[bytes], list[bytes]]:
    """The words right of each place, and those left of it with the nearest first, WIDTH bytes each; what the text lacks is left out."""
    low = words.view(np.uint8).reshape(-1, 8)[:, :WIDTH]
    flat, back = low.tobytes(), low[::-1].tobytes()
    n = len(words)
    return [flat[a * WIDTH : (a + longest) * WIDTH] for a in at.tolist()], [back[(n - a) * WIDTH : (n - a + LEFT) * WIDTH] for a in at.tolist()]


def _matrix(values: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // WIDTH
    data = np.frombuffer(b"".join(v.ljust(length * WIDTH, b"\0") for v in values), dtype=np.uint8).reshape(len(values), length, WIDTH)
    return data, sizes


def _common(data: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words rows i and j have in common from the start."""
    out = np.zeros(len(i), dtype=np.int64)
    for lo in range(0, len(i), 4096):
        a, b = i[lo : lo + 4096], j[lo : lo + 4096]
        odd = (data[a] != data[b]).any(axis=2)
        first = np.where(odd.any(axis=1), odd.argmax(axis=1), data.shape[1])
        out[lo : lo + 4096] = np.minimum(first, np.minimum(sizes[a], sizes[b]))
    return out


def _neighbours(rows: dict[str, list], least: int, first: int, last: int) -> list[np.ndarray]:
    """(owner row, start, stop, twin row, 0) of the matches of rows first to last - 1 with the nearest rows of another
    document, and (row, 0, 0, row, the distances of the windows that these leave open as bits)."""
    dk = np.array(rows["dk"], dtype=np.int64)
    n = len(dk)
    new = np.flatnonzero(np.concatenate([[True], dk[1:] != dk[:-1]]))
    run = np.searchsorted(new, np.arange(n), side="right") - 1
    before, after = new[run] - 1, np.append(new, n)[run + 1]
    right, left = _matrix(rows["right"], max(RIGHT, least)), _matrix(rows["left"], LEFT)
    pos = np.array(rows["pos"], dtype=np.int64)
    own = np.arange(first, last)
    out, distance = [], np.arange(WINDOW)
    longest, covered = np.zeros(n, np.int64), np.zeros((last - first, WINDOW), bool)
    for other in (before, after):
        i = own[(other[own] >= 0) & (other[own] < n)]
        j = other[i]
        r, le = _common(*right, i, j), _common(*left, i, j)
        keep = (r >= GRAM) & (r + le >= least)
        out.append(np.stack([i[keep], (pos[i] - le)[keep], (pos[i] + r)[keep], j[keep], np.zeros(int(keep.sum()), np.int64)]))
        longest[i] = np.maximum(longest[i], r)
        covered[i - first] |= (distance <= le[:, None]) & (distance >= least - r[:, None])
    reach = np.array(rows["reach"], dtype=np.int64)[own]
    open_ = ~covered & (distance >= (reach % WINDOW)[:, None]) & (distance <= (reach // WINDOW)[:, None]) & (distance >= least - longest[own][:, None])
    bits = (open_ << distance).sum(axis=1)
    k = np.flatnonzero(bits)
    out.append(np.stack([own[k], np.zeros(len(k), np.int64), np.zeros(len(k), np.int64), own[k], bits[k]]))
    return out


def _windows(least: int):
    """(window hash, dk, doc_id, start, stop) of suffixes' windows at the wanted distances (a column of bits)."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = xxhash.xxh3_64_intdigest
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for dk, doc_id, pos, reach, right, left, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for b in range(reach % WINDOW, reach // WINDOW + 1):
                    if wanted >> b & 1 and len(right) >= (least - b) * WIDTH and len(left) >= b * WIDTH:
                        before = np.frombuffer(left[: b * WIDTH], np.uint8).reshape(b, WIDTH)[::-1].tobytes()
                        for column, value in zip(out, (one(before + right[: (least - b) * WIDTH]), dk, doc_id, pos - b, pos - b + least), strict=True):
                            column.append(value)
            hashes = np.array(out[0], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), *(pa.array(c, pa.int64()) for c in out[1:])], names=["window", "dk", "doc_id", "start", "stop"])

    return windows


SORTED = "dk bigint, doc_id bigint, pos int, reach int, right binary, left binary"
FOUND = "dk bigint, doc_id bigint, start bigint, stop bigint, twin_id bigint, edge boolean, shard int, pos int, reach int, right binary, left binary, window bigint"


def _emit(rows: dict[str, list], found: list[np.ndarray]) -> pa.RecordBatch:
    own, start, stop, twin, window = np.concatenate(found, axis=1)
    dk, ids = np.array(rows["dk"], dtype=np.int64), rows["doc_id"]
    n = len(own)
    return pa.RecordBatch.from_arrays([pa.array(dk[own]), pa.array([ids[k] for k in own.tolist()], pa.int64()), pa.array(start), pa.array(stop), pa.array([ids[k] for k in twin.tolist()], pa.int64()), pa.array(np.zeros(n, bool)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.array([rows["right"][k][: GRAM * WIDTH] if w else None for k, w in zip(own.tolist(), window.tolist(), strict=True)], pa.binary()), pa.nulls(n, pa.binary()), pa.array(window, mask=window == 0)], names=[x.split()[0] for x in FOUND.split(", ")])


def _edges(rows: dict[str, list], picked: list[int], shard: int) -> pa.RecordBatch:
    n, take = len(picked), lambda c: [rows[c][k] for k in picked]
    return pa.RecordBatch.from_arrays([pa.array(take("dk"), pa.int64()), pa.array(take("doc_id"), pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.ones(n, bool)), pa.array([shard] * n, pa.int32()), pa.array(take("pos"), pa.int32()), pa.array(take("reach"), pa.int32()), pa.array(take("right"), pa.binary()), pa.array(take("left"), pa.binary()), pa.nulls(n, pa.int64())], names=[x.split()[0] for x in FOUND.split(", ")])


def _compare(least: int, with_edges: bool):
    """A task over sorted suffixes. What it holds: a batch, and the last run of suffixes of one document."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        names = [x.split()[0] for x in SORTED.split(", ")]
        held: dict[str, list] = {c: [] for c in names}
        done, head = 0, with_edges  # rows of held that are done; the first two runs are still to be handed on

        def last_run() -> int:
            k = len(held["dk"]) - 1
            while k > 0 and held["dk"][k - 1] == held["dk"][-1]:
                k -= 1
            return k

        for batch in batches:
            if not batch.num_rows:
                continue
            for k, c in enumerate(names):
                held[c] += batch.column(k).to_pylist()
            cut = last_run()
            if head and cut:
                second = next(k for k in range(len(held["dk"])) if held["dk"][k] != held["dk"][0])
                yield _edges(held, [*range(second + 1)], shard)
                head = False
            if cut > done:
                yield _emit(held, _neighbours(held, least, done, cut))
                keep = cut - 1
                held = {c: held[c][keep:] for c in names}
                done = 1
        n = len(held["dk"])
        if n:
            if n > done:
                yield _emit(held, _neighbours(held, least, done, n))
            if with_edges:
                cut = last_run()
                yield _edges(held, [*range(0 if head else max(0, cut - 1), n)], shard)

    return compare


def repeats(docs: DataFrame, *, least: int = 50) -> DataFrame:
    """(doc_id, start, stop, n_words, twin_id): the spans of words that another document has, too. twin_id: the smallest
    doc_id met next to one of the span's suffixes or with one of its windows."""
    spark = docs.sparkSession
    prepare(spark)
    if least < WINDOW + GRAM - 1:
        raise ValueError(f"repeats of fewer than {WINDOW + GRAM - 1} words need not have a minimiser")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).withColumn("dk", F.xxhash64("doc_id", "text"))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                dks, keys, at = [], [], []
                for dk, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    where, gram, reach = minimisers(word_hashes(text))
                    dks.append(np.full(len(where), dk, dtype=np.int64))
                    keys.append(gram.view(np.int64))
                    at.append(where * WINDOW * WINDOW + reach)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(dks)), pa.array(np.concatenate(at))], names=["key", "dk", "place"])

    suffixes = rows.select("dk", "text").mapInArrow(sample, "key bigint, dk bigint, place bigint")
    shared = suffixes.groupBy("key").agg(F.min("dk").alias("a"), F.max("dk").alias("b")).where("a <> b").select("key")
    shared = stored(shared, "shared")  # a table of its own, so that a frequent gram's suffixes can be split in the join
    wanted = suffixes.join(shared.hint("merge"), "key").groupBy("dk").agg(F.collect_set("place").alias("places"))  # a document's own places
    wanted = stored(wanted, "places")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                columns: list[list] = [[], [], [], [], [], []]
                for dk, doc_id, text, places in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    at, reach = np.divmod(np.sort(np.array(places, dtype=np.int64)), WINDOW * WINDOW)
                    right, left = _contexts(word_hashes(text), at, max(RIGHT, least))
                    for c, v in zip(columns, ([dk] * len(at), [doc_id] * len(at), at.tolist(), reach.tolist(), right, left), strict=True):
                        c += v
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SORTED.split(", ")])

    texts = rows.join(wanted.hint("shuffle_hash"), "dk")
    held = texts.select("dk", "doc_id", "text", "places").mapInArrow(contexts, SORTED)
    order = ["right", "left", "dk", "pos"]
    held = stored(held, "suffixes")
    ranged = held.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    found = stored(ranged.select("dk", "doc_id", "pos", "reach", "right", "left").mapInArrow(_compare(least, True), FOUND), "matches")
    ends = found.where("edge").select("dk", "doc_id", "pos", "reach", "right", "left").repartition(1).sortWithinPartitions(*order).mapInArrow(_compare(least, False), FOUND)
    matched = stored(found.where("not edge").unionByName(ends).select("dk", "doc_id", "start", "stop", "twin_id", "window", "right"), "matched")
    open_ = matched.where("window is not null").groupBy(F.col("right").alias("gram")).agg(F.bit_or("window").alias("wanted"))
    open_ = stored(open_, "open")
    open_ = F.broadcast(open_) if open_.count() <= BROADCAST_GRAMS else open_.hint("merge")
    asked = held.withColumn("gram", F.substring("right", 1, GRAM * WIDTH)).join(open_, "gram").select("dk", "doc_id", "pos", "reach", "right", "left", "wanted")
    windows = stored(asked.mapInArrow(_windows(least), "window bigint, dk bigint, doc_id bigint, start bigint, stop bigint"), "asked")
    alike = windows.groupBy("window").agg(F.min(F.struct("doc_id", "dk")).alias("one"), F.min("dk").alias("a"), F.max("dk").alias("b")).where("a <> b").select("window", "one")
    alike = stored(windows.join(stored(alike, "alike"), "window"), "windows")
    second = alike.where("dk <> one.dk").groupBy("window").agg(F.min("doc_id").alias("next"))
    alike = alike.join(second, "window").select("dk", "doc_id", "start", "stop", F.when(F.col("dk") == F.col("one.dk"), F.col("next")).otherwise(F.col("one.doc_id")).alias("twin_id"))
    spans = matched.where("window is null").select("dk", "doc_id", "start", "stop", "twin_id").unionByName(alike)
    spans = spans.groupBy("dk", "doc_id", "start", "stop").agg(F.min("twin_id").alias("twin_id"))
    by_doc = Window.partitionBy("dk").orderBy("start", "stop")
    apart = F.coalesce(F.col("start") > F.max("stop").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    spans = spans.withColumn("new", apart.cast("int")).withColumn("part", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("dk", "part").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("twin_id").alias("twin_id"))
    return spans.select("doc_id", "start", "stop", (F.col("stop") - F.col("start")).alias("n_words"), "twin_id")
