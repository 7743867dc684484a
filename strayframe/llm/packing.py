"""Token-id output: ids packed into the fewest bits of the vocabulary, in blocks with offsets.

File format: a Parquet table of blocks. A block holds whole documents, in ascending order of doc_id, until
it has ``block_ids`` ids or more. Columns:

    shard, block   place of the block; (shard, block) ascends with doc_id
    first          ids of the shard in front of the block
    n_ids, bits    ids in the block, and bits of each
    doc_ids, ends  documents of the block and the running number of ids after each (the block's offsets)
    payload        ids, ``bits`` bits each, least significant bit first, without gaps

Id ``k`` of a block starts at bit ``k * bits``, so any run of ids is read without what lies before it.

Defined cases: a null text counts as empty and yields the end id alone. Rows with equal doc_id are ordered by a
hash of their text; rows without doc_id come first. A long document makes a long block; no id is dropped. An
empty table gives an empty file set. Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keeps, new_path, prepare, shuffle_partitions, text_or_empty

BLOCK_SCHEMA = "shard int, block int, first bigint, n_ids bigint, bits int, doc_ids array<bigint>, ends array<bigint>, payload binary"
#: Entries of a worker's piece cache; when it is full, pieces met in one batch alone are dropped.
CACHE_PIECES = 900_000
#: A text is cut where every byte-level pre-tokenizer of this family cuts it: in front of a word's one space, around other
#: white space, and between a letter or digit and one of ".,!?". Encoding pieces one by one gives the ids of the whole text.
PIECE = re.compile(r" ?[0-9A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,!?])| ?[^ \n\t\r]+|[ \n\t\r]+(?=[ \n\t\r][^ \n\t\r])|[\n\t\r](?=[^ \n\t\r])|[ \n\t\r]+")
#: Texts with other white space than " \n\t\r", or with a special token's string, are encoded whole.
OTHER_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def min_bits(vocabulary: int) -> int:
    """Bits that hold every id from 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def vocabulary_of(definition: str) -> int:
    """One more than the greatest id of a tokenizer's file."""
    parts = json.loads(definition)
    known = parts["model"].get("vocab", {})
    own = max(known.values(), default=-1) if isinstance(known, dict) else len(known) - 1
    return max([own, *(t["id"] for t in parts.get("added_tokens", []))]) + 1


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each. One that does not fit is an error: cut short it would read back as another id."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit in {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop - 1 of a block, without touching the others."""
    if bits in (8, 16, 32):
        width = bits // 8
        return np.frombuffer(payload, dtype=f"<u{width}", count=stop - start, offset=start * width).astype(np.uint32)
    first = start * bits // 8
    raw = np.frombuffer(payload[first : (stop * bits + 7) // 8] + bytes(8), dtype=np.uint8)
    at = np.arange(start, stop, dtype=np.int64) * bits - first * 8
    words = np.zeros(len(at), dtype=np.uint64)
    for k in range(5):  # a value of up to 32 bits touches five bytes at most
        words |= raw[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((words >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class _Numbers(dict):
    """Numbers pieces as they are met; ``new`` has those that still need their ids."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class PieceEncoder:
    """Encodes texts with a byte-level tokenizer; equal pieces of text are encoded once per worker."""

    held: dict[int, PieceEncoder] = {}

    def __init__(self, definition: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        parts = json.loads(definition)
        step = parts.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in parts.get("added_tokens", [])]
        self.by_piece = parts.get("normalizer") is None and step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space") and all(not (t["lstrip"] or t["rstrip"]) and not re.search(r"[\s.,!?]", t["content"]) for t in parts.get("added_tokens", []))
        self.spaced = np.zeros(self.library.get_vocab_size() + 1, dtype=bool)  # ids that begin with a space
        for token, i in self.library.get_vocab().items():
            self.spaced[i] = token.startswith("Ġ")
        self.line = np.array(self._one("\n"), dtype=np.uint32)
        self.clear()

    @classmethod
    def of(cls, definition: str) -> PieceEncoder:
        key = zlib.crc32(definition.encode())
        if key not in cls.held:
            cls.held[key] = cls(definition)
        return cls.held[key]

    def clear(self) -> None:
        self.number = _Numbers()
        self.ids = np.zeros(1 << 20, dtype=np.uint32)
        self.begin, self.size, self.met = (np.zeros(1 << 18, dtype=np.int32) for _ in range(3))  # met: in another batch
        self.used = 0

    def _forget(self) -> None:
        """Drop the pieces met in one batch alone."""
        n = len(self.number)
        keep = np.flatnonzero(self.met[:n])
        begin, size, ids, pieces = self.begin[keep], self.size[keep], self.ids, list(self.number)
        self.clear()
        self.number.update(zip([pieces[k] for k in keep.tolist()], range(len(keep)), strict=True))
        ends = np.cumsum(size)
        self._room(len(keep), int(size.sum()))
        self._put(np.arange(len(keep)), size, ids[np.repeat(begin - ends + size, size) + np.arange(int(size.sum()))])

    def _one(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _room(self, pieces: int, ids: int) -> None:
        while self.used + ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while pieces > len(self.begin):
            self.begin, self.size, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size, self.met))

    def _put(self, codes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Keep the ids of pieces, one piece's after the other's."""
        self._room(0, len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[codes] = sizes
        self.begin[codes] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)

    def _encode_new(self, pieces: list[str]) -> None:
        """Pieces with a space in front are encoded as one text, and so are those without, a line each: neither
        changes a piece's ids, and the ids tell where a piece begins. What is neither is encoded alone."""
        first = len(self.number) - len(pieces)
        self._room(len(self.number), 0)
        alone = {i for i, p in enumerate(pieces) if p[-1] in " \n\t\r"}
        for spaced in (True, False):
            at = [i for i, p in enumerate(pieces) if (p[0] == " ") == spaced and i not in alone]
            if not at:
                continue
            ids = np.array(self._one(("" if spaced else "\n").join([pieces[i] for i in at])), dtype=np.uint32)
            if spaced:
                begin = np.flatnonzero(self.spaced[ids])
                sure = len(begin) == len(at) and begin[0] == 0
                sizes = np.diff(np.append(begin, len(ids)))
            else:
                cut = np.flatnonzero(ids == self.line[0])
                sure = len(self.line) == 1 and len(cut) == len(at) - 1
                sizes = np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
                ids = ids[ids != self.line[0]]
            if sure:
                self._put(first + np.array(at), sizes, ids)
            else:
                alone |= set(at)
        for i in sorted(alone):
            ids = np.array(self._one(pieces[i]), dtype=np.uint32)
            self._put(np.array([first + i]), np.array([len(ids)]), ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_piece:
            return [np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.number) > CACHE_PIECES:
            self._forget()
        odd = {i for i, x in enumerate(texts) if OTHER_SPACE.search(x) or any(t in x for t in self.special)}
        pieces = [[] if i in odd else PIECE.findall(x) for i, x in enumerate(texts)]
        flat = list(chain.from_iterable(pieces))
        before = len(self.number)
        codes = np.fromiter(map(self.number.__getitem__, flat), dtype=np.int64, count=len(flat))
        if new := self.number.new:
            self.number.new = []
            self._encode_new(new)
        self.met[codes[codes < before]] = 1
        begin, sizes = self.begin[codes], self.size[codes]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(begin - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *map(len, pieces)])]
        whole = iter(self.library.encode_batch_fast([texts[i] for i in sorted(odd)], add_special_tokens=False))
        return [np.array(next(whole).ids, dtype=np.uint32) if i in odd else ids[cuts[i] : cuts[i + 1]] for i in range(len(texts))]


def _forget_pieces() -> None:
    for encoder in PieceEncoder.held.values():
        encoder.clear()


keeps("packing", _forget_pieces)


def write_packed(docs: DataFrame, path: str, tokenizer: str, *, vocabulary: int | None = None, end_id: int = 0, block_ids: int = 1 << 16) -> None:
    """Encode every text, append ``end_id`` and write the packed blocks to ``path``. One shuffle, of the
    texts, into ranges of doc_id; a task holds one block of ids at a time. vocabulary: the ids there are; the tokenizer's
    own if not given."""
    spark = docs.sparkSession
    prepare(spark)
    text = open(tokenizer, encoding="utf-8").read()
    bits = min_bits(max(vocabulary_of(text) if vocabulary is None else vocabulary, end_id + 1))
    definition = spark.sparkContext.broadcast(text)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(definition.value)
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        names: list[int | None] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            row = [[shard], [block], [first], [len(ids)], [bits], [names], [np.cumsum([len(x) for x in held]).tolist()], [pack(ids, bits)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    held.append(np.append(ids, np.uint32(end_id)))
                    names.append(doc_id)
                    size += len(held[-1])
                    if size >= block_ids:
                        yield flush()
                        block, first = block + 1, first + size
                        held, names, size = [], [], 0
        if held:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    rows.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def shard_starts(blocks: DataFrame) -> DataFrame:
    """(shard, base): ids of all shards in front. One row a shard, and shards are as many as write tasks."""
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    prepare(spark)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, first, n_ids, bits, doc_ids, ends, payload = (batch.column(k)[i].as_py() for k in ("shard", "first", "n_ids", "bits", "doc_ids", "ends", "payload"))
                ids = unpack(payload, bits, 0, n_ids).astype("<u4")
                ends = np.array(ends, dtype=np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(ends), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(first + starts), pa.array(ends - starts), pa.array(sums, pa.int64())], names=["shard", "doc_id", "local", "n_tokens", "ids_crc32"])

    found = blocks.select("shard", "first", "n_ids", "bits", "doc_ids", "ends", "payload").mapInArrow(rows, "shard int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(F.broadcast(shard_starts(blocks)), "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(position, id) of ids start to stop - 1 of the whole output. Blocks outside are skipped by their offsets."""
    prepare(spark)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    placed = blocks.join(F.broadcast(shard_starts(blocks)), "shard").withColumn("at", F.col("base") + F.col("first"))
    placed = placed.where((F.col("at") < stop) & (F.col("at") + F.col("n_ids") > start)).select("at", "n_ids", "bits", "payload")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n_ids, bits, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lo, hi = max(start, at), min(stop, at + n_ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), pa.array(unpack(payload, bits, lo - at, hi - at).astype(np.int64))], names=["position", "id"])

    return placed.mapInArrow(rows, "position bigint, id bigint")


def token_output(docs: DataFrame, tokenizer: str, *, vocabulary: int | None = None, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write the packed files and return what they hold, document by document."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_packed(docs, path, tokenizer, vocabulary=vocabulary, end_id=end_id)
    return read_documents(spark, path)
