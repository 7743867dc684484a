"""SentencePiece encoding and decoding of merge-type (BPE) models by a prefix table.

For each prefix of a text the last token of its encoding is unique. An automaton over all pieces finds the pieces that end at a place;
the last token is the one that its own prefix's last token lies beside without merging (pair compatibility). The ids are
recovered from the end of the text backwards. Compatibility is told from the merges that made the two tokens: going back through
those on the border's side of each, no pair that stands at the border in between may be a piece that merges first.

A text is cut where no piece reaches over: in front of a space mark that follows another character, and around characters that are
part of no longer piece, and between a letter and a sign that no piece holds together. Equal parts are encoded once a worker. Characters outside the vocabulary become byte pieces.

Decoding joins the ids' surfaces as bytes. Bytes that are no character become U+FFFD one by one, control ids nothing, the unknown id
" ⁇ ", and the mark that encoding puts in front of a text goes.

Defined cases: null and empty texts have no pieces, so only the end id. Repeated rows and null doc_ids keep a row each. A long
text takes memory and time in proportion. Documents are independent: no shuffle, no hot key. An empty table gives an empty result.
Other columns are ignored. A model of another kind (unigram, other normalisation, no byte pieces) is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_or_empty

MARK = "▁"
#: Fixed values of the model file's format: field numbers of the message, and the kinds of pieces.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND = 1, 2, 3
TRAINER_MODEL, TRAINER_BYTE_FALLBACK = 3, 35
NORMALIZER_CHARSMAP, NORMALIZER_PREFIX, NORMALIZER_REMOVE, NORMALIZER_ESCAPE = 2, 3, 4, 5
MERGE_TYPE = 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Parts held by a worker, and the longest of them.
CACHE_PARTS, CACHE_LENGTH = 400_000, 64
#: Characters of texts in one batch of results; a longer text is a batch of its own.
GROUP_CHARACTERS = 2_000_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, raw[at : at + size]
        at += size


class PieceModel:
    """A merge-type model: encodes and decodes."""

    held: dict[int, PieceModel] = {}

    def __init__(self, content: bytes):
        import struct

        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(content):
            if number == PIECES:
                f = dict(_fields(value))
                pieces.append((f[PIECE_TEXT].decode(), struct.unpack("<f", f.get(PIECE_SCORE, bytes(4)))[0], f.get(PIECE_KIND, NORMAL)))
            elif number == TRAINER:
                trainer = dict(_fields(value))
            elif number == NORMALIZER:
                normalizer = dict(_fields(value))
        usual = normalizer.get(NORMALIZER_PREFIX, 1) and normalizer.get(NORMALIZER_ESCAPE, 1) and not normalizer.get(NORMALIZER_REMOVE, 1) and not normalizer.get(NORMALIZER_CHARSMAP)
        if trainer.get(TRAINER_MODEL) != MERGE_TYPE or not trainer.get(TRAINER_BYTE_FALLBACK) or not usual or any(k not in (NORMAL, UNKNOWN, CONTROL, BYTE) for *_, k in pieces):
            raise ValueError("not a merge-type model with byte pieces, a mark in front and no other normalisation")
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.rank = {p: -score for p, score, kind in pieces if kind == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.surface = [{NORMAL: p.replace(MARK, " "), UNKNOWN: " ⁇ "}.get(kind, "").encode() if kind != BYTE else bytes([int(p[3:5], 16)]) for p, _, kind in pieces]
        self.byte_set = frozenset(self.byte_ids.values())
        self.controls = frozenset(i for i, (*_, kind) in enumerate(pieces) if kind == CONTROL)
        self.marked = frozenset(i for p, i in self.ids.items() if p.startswith(MARK))
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        within = {c for p in self.ids if len(p) > 1 for c in p}
        beside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        if any(MARK in p.lstrip(MARK) for p in self.ids):  # a mark inside a piece: only whole texts are safe
            self.parts = re.compile(r".+", re.S)
        else:
            alone = "".join(re.escape(chr(c)) for c in range(256) if chr(c) not in within)
            letters = [c for c in map(chr, range(256)) if c.isalpha() and c in within]
            after = "".join(re.escape(c) for c in ".,;:!?" if not any(x + c in beside for x in letters))  # signs that no piece holds behind a letter
            word = f"{MARK}*[{''.join(letters)}]+(?=[{after}])|" if after and letters else ""
            self.parts = re.compile(word + (f"[{alone}]|{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+"))
        self._halves: dict[str, tuple[str, str] | None] = {}
        self._regular: dict[str, bool] = {}
        self._fits: dict[tuple[str, str], bool] = {}
        self._cache: dict[str, tuple[int, ...]] = {}

    @classmethod
    def of(cls, content: bytes) -> PieceModel:
        key = hash(content)
        if key not in cls.held:
            cls.held[key] = cls(content)
        return cls.held[key]

    def _merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """A short text's tokens by merging pair after pair, and the last pair merged."""
        parts, last = list(text), None
        while True:
            ranks = [(self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank]
            if not ranks:
                return parts, last
            k = min(ranks)[1]
            last = parts[k], parts[k + 1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that a piece is merged from; None for a character and for a piece that merging never makes."""
        if piece not in self._halves:
            tokens, last = self._merged(piece)
            self._halves[piece] = last if tokens == [piece] else None
        return self._halves[piece]

    def stands(self, piece: str) -> bool:
        """Whether a piece encodes to itself."""
        return len(piece) == 1 or self.halves(piece) is not None

    def regular(self, piece: str) -> bool:
        """Whether the merges that make a piece come in the order of their ranks, halves before wholes."""
        if piece not in self._regular:
            pair = self.halves(piece)
            self._regular[piece] = pair is None or all(self.regular(h) and (len(h) == 1 or (self.halves(h) is not None and self.rank[h] < self.rank[piece])) for h in pair)
        return self._regular[piece]

    def fits(self, a: str, b: str) -> bool:
        """Whether the text a + b encodes to a and b."""
        if not self.stands(b):
            found = False
        elif self.regular(a) and self.regular(b):
            found = self._border_holds(a, b)
        else:
            found = self._merged(a + b)[0] == [a, b]
        if len(self._fits) >= 4 * CACHE_PARTS:
            self._fits.clear()
        self._fits[a, b] = found
        return found

    def _border_holds(self, a: str, b: str) -> bool:
        """Backwards through the merges beside the border. Where equal ranks meet, the pair further left merges first."""
        never = float("inf")
        next_a = next_b = never
        while True:
            rank = self.rank.get(a + b, never)
            if rank < next_a and rank <= next_b and rank != never:
                return False
            pair_a, pair_b = self.halves(a) if len(a) > 1 else None, self.halves(b) if len(b) > 1 else None
            if pair_b and (not pair_a or self.rank[b] >= self.rank[a]):
                next_b, b = self.rank[b], pair_b[0]
            elif pair_a:
                next_a, a = self.rank[a], pair_a[1]
            else:
                return True

    def _tokens(self, part: str) -> list[str]:
        """Pieces, and characters outside the vocabulary, of a text that is encoded as one."""
        last: list[str] = []  # the last token of each prefix
        known = self._fits
        for end, piece in self.automaton.iter(part):  # by end; at one end the longest first
            have = len(last)
            if have > end:
                continue
            if have < end:  # no piece fits there: these characters are outside the vocabulary
                last += part[have:end]
            start = end - len(piece)
            if start < 0:
                found = self.stands(piece)
            else:
                found = known.get((last[start], piece))
                if found is None:
                    found = self.fits(last[start], piece)
            if found:
                last.append(piece)
        last += part[len(last) :]
        out, k = [], len(part)
        while k:
            out.append(last[k - 1])
            k -= len(out[-1])
        return out[::-1]

    def _part_ids(self, part: str) -> tuple[int, ...]:
        out: list[int] = []
        for token in self._tokens(part):
            if token in self.ids:
                out.append(self.ids[token])
            else:
                out += (self.byte_ids[x] for x in token.encode())
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without begin or end."""
        out: list[int] = []
        if not text:
            return out
        known = self._cache
        for part in self.parts.findall((MARK + text).replace(" ", MARK)):
            ids = known.get(part)
            if ids is None:
                ids = self._part_ids(part)
                if len(part) <= CACHE_LENGTH:
                    if len(known) >= CACHE_PARTS:
                        known.clear()
                    known[part] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids."""
        first = next((i for i in ids if i not in self.controls), None)
        try:
            text = b"".join([self.surface[i] for i in ids]).decode() if self.controls.isdisjoint(ids[:-1]) else self._decode_odd(ids)
        except UnicodeDecodeError:
            text = self._decode_odd(ids)
        return text[1:] if first in self.marked else text

    def _decode_odd(self, ids: list[int]) -> str:
        """Runs of byte pieces character by character; a byte that begins none is U+FFFD."""
        out, at = [], 0
        while at < len(ids):
            if ids[at] not in self.byte_set:
                out.append(self.surface[ids[at]].decode())
                at += 1
                continue
            stop = at
            while stop < len(ids) and ids[stop] in self.byte_set:
                stop += 1
            raw, k = b"".join(self.surface[i] for i in ids[at:stop]), 0
            while k < len(raw):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(raw[k : k + size].decode())
                        k += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    k += 1
            at = stop
        return "".join(out)


def _model(docs: DataFrame, model: str):
    with open(model, "rb") as f:
        content = f.read()
    PieceModel(content)  # a model of another kind fails here and not in a task
    return docs.sparkSession.sparkContext.broadcast(content)


def encoded(docs: DataFrame, model: str, *, end_id: int | None = None, decode: bool = False) -> DataFrame:
    """doc_id and ids (array<int>) of each text; end_id is appended where given. decode: also the text that the ids decode to, as column
    decoded."""
    prepare(docs.sparkSession)
    content = _model(docs, model)
    tail = [] if end_id is None else [end_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PieceModel.of(content.value)
        for batch in batches:
            for ids, texts in _groups(batch):
                found = [[*own.encode(t), *tail] for t in texts]
                columns = [ids, pa.array(found, pa.list_(pa.int32()))]
                if decode:
                    columns.append(pa.array([own.decode(x) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>" + (", decoded string" if decode else ""))


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and the text that ids decode to (null ids: the empty text) of rows with doc_id and ids."""
    prepare(rows.sparkSession)
    content = _model(rows, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PieceModel.of(content.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([own.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "ids", "decoded"])

    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """A batch (doc_id, text) in slices of bounded length."""
    ids, texts = batch.column(0), batch.column(1).to_pylist()
    begin = held = 0
    for k, text in enumerate(texts):
        if k > begin and held + len(text) > GROUP_CHARACTERS:
            yield ids.slice(begin, k - begin), texts[begin:k]
            begin, held = k, 0
        held += len(text)
    if begin < len(texts):
        yield ids.slice(begin), texts[begin:]


def piece_digests(rows: DataFrame) -> DataFrame:
    """Number of ids and digests of ids and decoded text."""
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
