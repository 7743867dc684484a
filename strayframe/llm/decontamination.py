"""Benchmark decontamination, in DataFrame functions only.

A window is ``n`` consecutive words of a benchmark item, or a shorter item whole. Every window of length L holds a
gram of g words that starts at a multiple of L - g + 1, wherever it lies in a document. So a document is looked up
only at those places, in a broadcast hash set of the items' grams; a hit carries the words around it, which are
compared with the item's word by word to both sides. Only the grams that survive that are windows.

Defined cases: null and empty texts have no words; items without words have no window. Repeated rows each get the
result. A null item_id counts as an item of its own in spans but adds nothing to a list of ids. An empty benchmark
or document table gives zero hits or an empty result. Other columns are ignored, or kept by the filters.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored, text_or_empty

#: Digits, letters of either case and all beyond ASCII. Single characters are looked up in a table; ranges and negations would be a call each, for
#: every character of a text.
_IN_WORDS = string.digits + string.ascii_letters
WORD = rf"[{_IN_WORDS}\x80-\x{{10FFFF}}]+"
BETWEEN = "[" + "".join(rf"\x{c:02X}" for c in range(128) if chr(c) not in _IN_WORDS) + "]+"
#: The hash set is broadcast up to this number of grams (of at most 2 n words); beyond, it is joined by a shuffle.
BROADCAST_GRAMS = 200_000
GRAM = 4


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _around(words: str, at: Column, reach: int, length: int) -> list[Column]:
    """What is left of a place (nearest first), up to ``reach`` words, and what is right of it, up to ``length``."""
    w = F.col(words)
    return [F.reverse(F.slice(w, F.greatest(at - reach, F.lit(0)) + 1, F.least(at, F.lit(reach)))).alias("left"), F.slice(w, at + 1, length).alias("right")]


def _agree(a: str, b: str) -> Column:
    """How many words two lists have in common from their start."""
    odd = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    return F.when(odd == 0, F.size(a)).otherwise(odd - 1).cast("bigint")


def spans(docs: DataFrame, benchmark: DataFrame, *, n: int = 13) -> DataFrame:
    """(doc_id, tie, item_id, start, stop): runs of a document's words that windows of an item cover. tie: a hash of the text."""
    items = benchmark.select("item_id", words_of(text_or_empty()).alias("words")).where(F.size("words") > 0).withColumn("n", F.least(F.size("words"), F.lit(n)))
    lengths = sorted(r[0] for r in items.select("n").distinct().collect())  # at most n values
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).select("doc_id", F.xxhash64("text").alias("tie"), words_of(F.col("text")).alias("words"))
    out = None
    for length in lengths:
        gram = min(GRAM, length)
        reach = length - gram
        gram_key = F.xxhash64(F.slice("words", F.col("p") + 1, gram)).alias("key")
        of_length = items.where(F.col("n") == length).withColumn("p", F.explode(F.sequence(F.lit(0), F.size("words") - gram)))
        grams = of_length.select("item_id", gram_key, *(c.alias(k) for c, k in zip(_around("words", F.col("p"), reach, length), ("i_left", "i_right"), strict=True)))
        grams = stored(grams.distinct(), "grams")
        if grams.count() <= BROADCAST_GRAMS:
            grams = F.broadcast(grams)
        # No filter by size, which would split each text twice. The agreements are a generator's, or they would be a condition of the join, and words were copied for each place.
        places = F.when(F.size("words") >= length, F.sequence(F.lit(0), F.size("words") - gram, F.lit(reach + 1)))
        found = rows.select("doc_id", "tie", "words", F.explode(places).alias("p")).select("doc_id", "tie", "p", gram_key, *_around("words", F.col("p"), reach, length))
        found = found.join(grams, "key").select("doc_id", "tie", "item_id", "p", F.inline(F.array(F.struct(_agree("left", "i_left").alias("l"), _agree("right", "i_right").alias("r")))))
        found = found.where((F.col("r") >= gram) & (F.col("l") + F.col("r") >= length)).select("doc_id", "tie", "item_id", (F.col("p") - F.col("l")).alias("start"), (F.col("p") + F.col("r")).alias("stop"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.limit(0).select("doc_id", "tie", F.lit(None).cast(dict(benchmark.dtypes)["item_id"]).alias("item_id"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("stop"))
    return out.distinct()


def _judged(docs: DataFrame, benchmark: DataFrame, n: int, least_share: tuple[int, int]) -> DataFrame:
    hit = spans(docs, benchmark, n=n).withColumn("at", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)))
    hit = hit.groupBy("doc_id", "tie").agg(F.count_distinct("at").alias("n_hit"), F.count_distinct("item_id").alias("n_items"), F.array_join(F.sort_array(F.collect_set(F.col("item_id").cast("string"))), ",").alias("items"))
    hit = hit.select(F.col("doc_id").alias("h_id"), F.col("tie").alias("h_tie"), "n_hit", "n_items", "items")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).select("doc_id", F.xxhash64("text").alias("tie"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("n_words"))
    zero = F.lit(0).cast("bigint")
    joined = rows.join(hit, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("tie") == F.col("h_tie")), "left")
    n_hit = F.coalesce("n_hit", zero)
    return joined.select(
        "doc_id", "tie", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * least_share[1] >= F.col("n_words") * least_share[0])).alias("contaminated"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, *, n: int = 13, least_share: tuple[int, int] = (1, 20)) -> DataFrame:
    """Per row: doc_id, n_words, n_hit (words inside a window), n_items, items_sha256, contaminated (n_hit is above 0
    and at least ``least_share`` of the words)."""
    return _judged(docs, benchmark, n, least_share).drop("tie")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, n: int = 13, least_share: tuple[int, int] = (1, 20)) -> DataFrame:
    """docs without the rows that are contaminated; all columns stay as they are."""
    gone = _judged(docs, benchmark, n, least_share).where("contaminated").select(F.col("doc_id").alias("gone_id"), F.col("tie").alias("gone_tie")).distinct()
    same = docs["doc_id"].cast("bigint").eqNullSafe(gone["gone_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["gone_tie"])
    return docs.join(gone, same, "left_anti")


def without_spans(docs: DataFrame, benchmark: DataFrame, *, n: int = 13) -> DataFrame:
    """(doc_id, text): each text without the words inside a window; what stands between words stays."""
    hit = spans(docs, benchmark, n=n).withColumn("at", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)))
    hit = hit.groupBy("doc_id", "tie").agg(F.collect_set("at").alias("hits")).select(F.col("doc_id").alias("h_id"), F.col("tie").alias("h_tie"), "hits")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.join(hit, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("tie") == F.col("h_tie")), "left")
    pieces = F.regexp_extract_all("text", F.lit(f"{WORD}|{BETWEEN}"), F.lit(0))
    first = F.when(F.col("text").rlike(f"^{WORD}"), 0).otherwise(1)
    kept = F.filter(pieces, lambda _, i: ((i + first) % 2 == 1) | ~F.array_contains("hits", F.floor((i - first) / 2).cast("bigint")))
    return rows.select("doc_id", F.when(F.col("hits").isNull(), F.col("text")).otherwise(F.array_join(kept, "")).alias("text"))
