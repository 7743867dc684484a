"""An append-only dictionary of encoded texts, and the registry of encoders.

Each distinct text is encoded once by an encoder's version; rows find its vector by the text's digest. Texts are reduced to distinct digests
before the dictionary is asked, so a frequent text is no hot key there; only what an anti-join leaves is encoded and appended.

Null texts have no vector. An append that a lost task repeats, or two appends at once, can leave a text twice; reading takes one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path

SCHEMA = "version string, key binary, text string, v array<double>"


@dataclass(frozen=True)
class Encoder:
    """load() is called once in a worker and gives a function from texts to rows of a matrix; version names the model and all that changes its
    vectors; template wraps each text."""

    name: str
    version: str
    load: Callable[[], Callable[[list[str]], np.ndarray]]
    template: str = "{}"
    unit: bool = True


ENCODERS: dict[str, Encoder] = {}
_loaded: dict[tuple[str, str], Callable[[list[str]], np.ndarray]] = {}


def encoder(name: str, version: str, *, template: str = "{}", unit: bool = True) -> Callable[[Callable], Callable]:
    """Registers a loader by name; a later one of the same name takes its place."""

    def add(load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable:
        ENCODERS[name] = Encoder(name, version, load, template, unit)
        return load

    return add


def encoder_of(name: str) -> Encoder:
    if name not in ENCODERS:
        raise ValueError(f"unknown encoder {name!r}; known: {sorted(ENCODERS)}")
    return ENCODERS[name]


@encoder("letters", "1")
def letters() -> Callable[[list[str]], np.ndarray]:
    """How often a text has each of a-z."""
    return lambda texts: np.array([[t.lower().count(chr(97 + k)) for k in range(26)] for t in texts], dtype=np.float64).reshape(len(texts), 26)


@encoder("trigrams", "1", template=" {} ")
def trigrams() -> Callable[[list[str]], np.ndarray]:
    """Counts of hashed character trigrams in 256 places."""
    from zlib import crc32

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 256))
        for row, t in zip(out, texts, strict=True):
            for k in range(len(t) - 2):
                row[crc32(t[k : k + 3].encode()) % 256] += 1
        return out

    return embed


def encoded(texts: DataFrame, by: Encoder) -> DataFrame:
    """version, key, text, v of texts (key, text), in Arrow batches; vectors of length one where the encoder asks for it (zeros stay)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = _loaded.get((by.name, by.version))
        if embed is None:
            embed = _loaded[by.name, by.version] = by.load()
        for batch in batches:
            v = np.asarray(embed([by.template.format(t) for t in batch.column(1).to_pylist()]), dtype=np.float64)
            if by.unit:
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            yield pa.RecordBatch.from_arrays([pa.array([by.version] * len(v), pa.string()), batch.column(0), batch.column(1), pa.array(list(v), pa.list_(pa.float64()))], names=["version", "key", "text", "v"])

    return texts.select("key", "text").mapInArrow(run, SCHEMA)


@dataclass
class TextDictionary:
    """The dictionary at a path (shared by driver and executors), which is made at the first update."""

    path: str
    by: str

    def vectors(self, spark: SparkSession) -> DataFrame:
        """key, v of the encoder's present version."""
        spark.createDataFrame([], SCHEMA).write.mode("append").parquet(self.path)  # makes the folder
        held = spark.read.schema(SCHEMA).parquet(self.path).where(F.col("version") == f"{self.by}:{encoder_of(self.by).version}")
        return held.groupBy("key").agg(F.first("v").alias("v"))

    def update(self, rows: DataFrame, text: str) -> int:
        """Encodes and appends the texts that are not there yet; their number."""
        spark, by = rows.sparkSession, encoder_of(self.by)
        asked = rows.where(F.col(text).isNotNull()).select(F.unhex(F.sha2(F.col(text).cast("string"), 256)).alias("key"), F.col(text).alias("text"))
        missing = asked.groupBy("key").agg(F.first("text").alias("text")).join(self.vectors(spark).select("key"), "key", "left_anti")
        path = shared_path(spark, "missing")
        missing.write.parquet(path)
        new = spark.read.schema(missing.schema).parquet(path)
        n = new.count()
        if n:
            spread = new.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
            encoded(spread, Encoder(by.name, f"{by.name}:{by.version}", by.load, by.template, by.unit)).write.mode("append").parquet(self.path)
        return n

    def joined(self, rows: DataFrame, text: str, name: str = "v") -> DataFrame:
        """rows with their text's vector, null where the dictionary has none. Frequent texts can be split: the vectors are an aggregate, so
        they are stored before the join."""
        spark = rows.sparkSession
        path = shared_path(spark, "vectors")
        held = self.vectors(spark)
        held.write.parquet(path)
        held = spark.read.schema(held.schema).parquet(path).select(F.col("key").alias("_key"), F.col("v").alias(name))
        keyed = rows.withColumn("_key", F.unhex(F.sha2(F.col(text).cast("string"), 256)))
        return keyed.join(held, "_key", "left").drop("_key")
