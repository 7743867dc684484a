"""Spelling variants: words that differ by one code point, each led to the much more frequent word that it may stand for.

Two words at distance one agree on a half: an edit in one half leaves the other as it is. So each word is listed in a forward dictionary
(sorted by its first half) and in a reversed one (by its last half), ranges of these hold the words that share a half (a block), and
the words of a block are compared. A block of more than ``MOST`` words is divided before any two of its words are compared: what is
still open between the shared beginning and the shared end is halved in the same way, until the block is small or one place is open. There
all words of a block are near words of each other, and no more of them than the alphabet has letters. So no pair that isn't
near is compared in a crowded block, and none is lost.

Replacements (words of m code points) and insertions (words of m and of m + 1) are kept apart. A pair's place is where the words first
differ, and it counts in the one block whose open part has that place, so each pair is found once and counts can be added.

Defined cases: null and empty texts have no words. A null doc_id changes no run. Repeated rows count as often as they come. Ties of n
go to the smallest word in code-point order. Without words the result is empty. Other columns are ignored. Words are
counted in bounded maps of a task before anything is shuffled, so frequent words are no hot keys.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, prepare, release, stored, text_or_empty

LETTERS = "A-Za-zÀ-ÿ"
LOWER = {ord(c): c.lower() for c in UPPER}
#: Words that a block may have to be compared pair by pair.
MOST = 32
#: Distinct words that a task counts before it gives them on.
HELD_WORDS = 200_000

#: Gives what a lower-cased run of a document counts as.
Change = Callable[[int | None, str], str]


def misspelt(doc_id: int | None, run: str) -> str:
    """The rule of the query: one run in 199 (by document and run) lacks a code point."""
    if doc_id is None:
        return run
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    return run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame, *, least_length: int = 6, least_count: int = 5, change: Change | None = None) -> DataFrame:
    """word, n: runs of letters with A-Z lower-cased, as ``change`` turns them, of at least so many code points and occurrences."""
    prepare(docs.sparkSession)
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}")  # no change makes a run longer

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for run, n in Counter(runs.findall(text.as_py())).items():
                    word = run if run.islower() else run.translate(LOWER)
                    if change:
                        word = change(doc_id, word)
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield given()
                    held.clear()
        if held:
            yield given()

    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


#: What a block's words share: kind (r: replaced, i: inserted), m code points of the (shorter) word, a of them in front and b at the end.
BLOCK = ["kind", "m", "a", "b", "shared"]
_SHARED = "concat(substring(word, 1, a), ' ', reverse(right(word, b)))"
#: One place (replaced) or gap (inserted) is open: nothing is left to divide.
_LAST = "m - a - b = if(kind = 'r', 1, 0)"
#: The two blocks of a word when its open part (m - a - b places, or one gap more) is halved.
_HALVES = """CASE WHEN kind = 'r' THEN array(named_struct('a', a + (m - a - b) div 2, 'b', b), named_struct('a', a, 'b', m - a - (m - a - b) div 2))
ELSE array(named_struct('a', a + (m - a - b + 1) div 2, 'b', b), named_struct('a', a, 'b', m - a - (m - a - b + 1) div 2 + 1)) END"""


def _halved(rows: DataFrame) -> DataFrame:
    """rows: word, n, kind, m, a, b, longer; each in the two blocks that halving makes."""
    rows = rows.select("word", "n", "kind", "m", "longer", F.explode(F.expr(_HALVES)).alias("h"))
    rows = rows.select("word", "n", "kind", "m", "longer", F.expr("cast(h.a AS int) AS a"), F.expr("cast(h.b AS int) AS b"))
    return rows.withColumn("shared", F.expr(_SHARED))


def _near_in(block: list[tuple[str, int, bool]], kind: str, m: int, b: int) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words in this block, greatest n of them, the smallest such word). block: (word, n, longer), sorted by word."""
    seen: dict[str, list] = {}

    def met(word: str, other: str, n: int) -> None:
        entry = seen.get(word)
        if entry is None:
            seen[word] = [1, -n, other]
        else:
            entry[0] += 1
            if (-n, other) < (entry[1], entry[2]):
                entry[1:] = -n, other

    if kind == "r":
        pairs = ((u, v) for k, u in enumerate(block) for v in block[:k])
    else:
        longer = [x for x in block if x[2]]
        pairs = ((u, v) for u in block if not u[2] for v in longer)
    for (u, n, _), (v, k, _) in pairs:
        p = 0
        while p < m and u[p] == v[p]:
            p += 1
        if u[p + 1 :] == v[p + 1 :] and p < m - b if kind == "r" else u[p:] == v[p + 1 :] and p <= m - b:
            met(u, v, k)
            met(v, u, n)
    for word, (count, n, other) in seen.items():
        yield word, count, -n, other


NEAR_SCHEMA = "word string, n_near bigint, best_n bigint, best string"


def _scanned(rows: DataFrame) -> DataFrame:
    """Near words within each block; a block's rows are one range of the dictionary."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[str, int, bool]] = []
        at, out = None, []

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "best_n", "best"])

        for batch in batches:
            for *key, word, n, longer in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != at:
                    if len(block) > 1:
                        out += _near_in(block, at[0], at[1], at[3])
                    at, block = key, []
                block.append((word, n, longer))
            if len(out) >= 10_000:
                yield given()
                out = []
        if len(block) > 1:
            out += _near_in(block, at[0], at[1], at[3])
        if out:
            yield given()

    ordered = rows.select(*BLOCK, "word", "n", "longer").repartitionByRange(*BLOCK).sortWithinPartitions(*BLOCK, "word")
    return ordered.mapInArrow(scan, NEAR_SCHEMA)


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: of each word that has near words their number, and the one of greatest n (ties: the smallest). words: word, n
    (stored, each word once)."""
    spark = words.sparkSession
    lengths = "array(named_struct('kind', 'r', 'm', length(word), 'longer', false), named_struct('kind', 'i', 'm', length(word), 'longer', false), named_struct('kind', 'i', 'm', length(word) - 1, 'longer', true))"
    rows = words.select("word", "n", F.explode(F.expr(lengths)).alias("k")).select("word", "n", "k.*", F.lit(0).alias("a"), F.lit(0).alias("b"))
    level = _halved(rows.where("m > 0"))
    found, spent = [], []
    while True:
        level = stored(level, "blocks")
        sizes = level.groupBy(*BLOCK).agg(F.count("*").alias("size"), F.count_if("longer").alias("longer_ones"))
        sizes = sizes.where("if(kind = 'r', size > 1, longer_ones > 0 AND longer_ones < size)").withColumn("scan", F.expr(f"size <= {MOST} OR {_LAST}"))
        sizes = stored(sizes, "sizes")
        crowded = level.join(sizes.where("NOT scan").select(*BLOCK).hint("merge"), BLOCK, "left_semi")
        alike = level.join(sizes.where("scan").select(*BLOCK).hint("merge"), BLOCK, "left_semi")
        found.append(stored(_scanned(alike), "near"))
        more = not sizes.where("NOT scan").isEmpty()
        spent += [level, sizes]
        if not more:
            break
        level = _halved(crowded)
    near = found[0]
    for other in found[1:]:
        near = near.unionByName(other)
    out = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best"))
    out = stored(out.select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best")), "near")
    release(spark, *spent, *found)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following form leads at last. forms: word, form (stored), without cycles. Each round doubles the steps taken."""
    now, spent = forms.select("word", F.col("form").alias("root")), []
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        step = stored(now.join(ahead.hint("merge"), F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        release(forms.sparkSession, *spent)
        spent = [step]
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, *, least_length: int = 6, least_count: int = 5, times: int = 5, change: Change | None = None) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word of docs (see :func:`word_counts`). form: the near word of greatest n, if that is
    ``times`` as often as the word or more. root: the last word when forms are followed, the word itself without a form."""
    if times < 2:
        raise ValueError("a form is more frequent than its word")
    words = stored(word_counts(docs, least_length=least_length, least_count=least_count, change=change), "words")
    near = near_words(words)
    rows = words.join(near.hint("merge"), "word", "left")
    rows = rows.withColumn("good", F.coalesce(F.col("best_n") >= times * F.col("n"), F.lit(False)))
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.expr("if(good, best, null) AS form"), F.expr("if(good, best_n, null) AS form_n")), "forms")
    release(docs.sparkSession, words, near)
    led = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(led.hint("merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
