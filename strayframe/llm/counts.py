"""Token counts through a digest cache.

A stored count is keyed by the digest of the normalised content and the digest of the tokenizer version (its
file and library). The only normalisation that keeps every count is null -> empty text, so that is the one made;
the tokenizer's own normaliser runs inside the encoder. Counts already stored are joined, distinct misses are
encoded once and appended.

Defined cases: null and empty texts have no tokens and no bytes. Copies share one count, also rows of one doc_id or of
none, which keep a row each. A text that is a third of all rows is encoded once; its rows are joined by a sort-merge
join of two stored or scanned sides, which Spark splits. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, prepare, stored, text_or_empty

CACHE_SCHEMA = "version string, digest binary, n_tokens bigint"
#: Copies' keys up to this number are broadcast (about 60 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 200_000

_models: dict[str, object] = {}


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file, its library and that library's version."""
    from importlib.metadata import version

    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library} {version(library)} ".encode() + f.read()).hexdigest()


def _counter(content: bytes, kind: str, key: str):
    """A function from texts to counts, built once per worker."""
    if key not in _models:
        if kind == "model":
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor()
            processor.LoadFromSerializedProto(content)
            _models[key] = lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            library = Tokenizer.from_str(content.decode())
            library.no_truncation()
            library.no_padding()
            _models[key] = lambda texts: [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    return _models[key]


def token_counts(docs: DataFrame, tokenizer: str, *, limit: int = 4096, cache: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row of docs.

    cache: folder of the stored counts; it is read and appended to. Without it the cache lasts for the call."""
    spark = docs.sparkSession
    prepare(spark)
    version = tokenizer_version(tokenizer)
    with open(tokenizer, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    kind = tokenizer.rpartition(".")[2]
    path = cache or new_path(spark, "counts")

    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(path)  # makes the folder
    known = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    # rows of one digest and one doc_id first, so that no row of a frequent text is summed up in one task
    each = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("same"))
    kept = each.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "same")).alias("k"), F.sum("same").alias("n"))
    missing = stored(kept.join(known, "digest", "left_anti").select("digest", F.col("k.doc_id").alias("keeper"), F.col("k.same").alias("same"), "n"), "missing")
    copies, doubled = missing.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)), F.count_if(F.col("same") > 1)).first()
    if cache is None and copies <= BROADCAST_KEYS:
        again = rows.select("digest", "doc_id").join(F.broadcast(missing.where("n > 1").select(F.col("digest").alias("d"), "keeper")), F.col("digest") == F.col("d")).where("doc_id is distinct from keeper").select("digest", "doc_id").distinct()
        again = again.select(F.col("digest").alias("d"), F.col("doc_id").alias("i"))
        todo = rows.join(F.broadcast(again), (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("i")), "left_anti")
    else:
        keepers = missing.select("digest", "keeper").hint("shuffle_hash")
        todo = rows.join(keepers, (rows["digest"] == keepers["digest"]) & rows["doc_id"].eqNullSafe(keepers["keeper"]), "left_semi")
    todo = todo.select("digest", "text")
    if doubled:  # a text's keeper is more than one row: the texts of those alone are shuffled
        twice = missing.where("same > 1").select("digest")
        twice = F.broadcast(twice) if doubled <= BROADCAST_KEYS else twice.hint("shuffle_hash")
        todo = todo.join(twice, "digest", "left_anti").unionByName(todo.join(twice, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = _counter(content.value, kind, version)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counted(batch.column(1).to_pylist()), pa.int64())], names=["digest", "n_tokens"])

    new = todo.mapInArrow(count, "digest binary, n_tokens bigint")
    new.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(path)
    known = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    known = stored(known, "known")  # a table: a join to an aggregate could not be split
    narrow = rows.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "digest")
    return narrow.join(known.hint("merge"), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
