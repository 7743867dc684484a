"""Media columns: Matroska files as binary values, written and parsed element by element.

The parser walks variable-length EBML elements (sizes of one to eight bytes, unknown sizes included), clusters, simple
blocks and block groups with all four kinds of lacing, and cues, and gives a packet table: track, timestamp, byte
range, place in its block and key flag.

Defined cases: a null text counts as empty; an empty payload is one frame of spaces. Equal texts give equal files.
Very long texts make files of many clusters. Repeated rows each get the result. A broken file raises ValueError with
the place. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_or_empty

# Element ids of the Matroska specification (fixed values).
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
NO_LACE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3

#: A frame is 192 samples of 8 bits at 8 kHz: 24 ms.
FRAME, RATE, FRAME_MS = 192, 8000, 24
FRAMES_A_BLOCK, BLOCKS_A_CLUSTER = 8, 16
#: The lacings of a file's blocks, in turn.
LACINGS = (XIPH, FIXED, EBML_LACE)


def vint(value: int, width: int = 0) -> bytes:
    """A size as an EBML variable-length integer."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(name: int, content: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + vint(len(content)) + content


def number(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def block(track: int, relative: int, frames: list[bytes], lacing: int) -> bytes:
    """The content of a SimpleBlock."""
    head = vint(track) + struct.pack(">hB", relative, 0x80 | lacing << 1)
    if lacing == NO_LACE:
        return head + frames[0]
    head += bytes([len(frames) - 1])
    if lacing == XIPH:
        for x in frames[:-1]:
            head += b"\xff" * (len(x) // 255) + bytes([len(x) % 255])
    elif lacing == EBML_LACE:
        head += vint(len(frames[0]))
        for a, b in zip(frames[:-2], frames[1:-1], strict=True):
            width = next(w for w in range(1, 9) if abs(len(b) - len(a)) < (1 << 7 * w - 1) - 1)
            head += vint(len(b) - len(a) + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def mux(payload: bytes, lacings: tuple[int, ...] = LACINGS) -> bytes:
    """One audio track of 8-bit samples; len(payload) is a multiple of FRAME. Blocks of several frames take the lacings in turn."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    head = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
    audio = element(SAMPLING, struct.pack(">d", float(RATE))) + number(CHANNELS, 1) + number(BIT_DEPTH, 8)
    track = number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, audio)
    body = [element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", float(len(frames) * FRAME_MS)))), element(TRACKS, element(TRACK_ENTRY, track))]
    place, cues = sum(map(len, body)), []
    for c in range(0, len(frames), FRAMES_A_BLOCK * BLOCKS_A_CLUSTER):
        part = [number(TIMESTAMP, c * FRAME_MS)]
        for b in range(c, min(c + FRAMES_A_BLOCK * BLOCKS_A_CLUSTER, len(frames)), FRAMES_A_BLOCK):
            own = frames[b : b + FRAMES_A_BLOCK]
            part.append(element(SIMPLE_BLOCK, block(1, (b - c) * FRAME_MS, own, lacings[b // FRAMES_A_BLOCK % len(lacings)] if len(own) > 1 else NO_LACE)))
        body.append(element(CLUSTER, b"".join(part)))
        cues.append(element(CUE_POINT, number(CUE_TIME, c * FRAME_MS) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, place))))
        place += len(body[-1])
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


@dataclass
class Media:
    """What a file holds. packets: (track, timestamp in scale units, offset, size, place in its block, key flag). A frame behind the
    first of a block has the block's time and the track's default duration, or its share of the block's duration, for each
    frame before it; without either it has the block's time."""

    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, int, bool]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


def _size(data: bytes, at: int) -> tuple[int, int, int]:
    """(value, unknown's value, place after) of the variable-length integer at a place."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no EBML size at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"the EBML size at byte {at} is cut off")
    return int.from_bytes(data[at : at + width], "big") ^ 1 << 7 * width, (1 << 7 * width) - 1, at + width


def _block(data: bytes, at: int, stop: int, base: int, key: bool | None, media: Media) -> None:
    track, _, at = _size(data, at)
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing, sizes = flags >> 1 & 3, []
    if lacing == NO_LACE:
        sizes = [stop - at]
    else:
        n, at = data[at] + 1, at + 1
        if lacing == XIPH:
            for _ in range(n - 1):
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                sizes.append(size + data[at])
                at += 1
        elif lacing == EBML_LACE and n > 1:
            size, _, at = _size(data, at)
            sizes.append(size)
            for _ in range(n - 2):
                step, most, at = _size(data, at)
                sizes.append(sizes[-1] + step - (most >> 1))
        elif lacing == FIXED:
            if (stop - at) % n:
                raise ValueError(f"frames of the block before byte {stop} are not alike")
            sizes = [(stop - at) // n] * (n - 1)
        sizes.append(stop - at - sum(sizes))
    key = bool(flags & 0x80) if key is None else key
    if min(sizes) < 0:
        raise ValueError(f"the laced sizes before byte {stop} exceed the block")
    step = media.tracks.get(track, {}).get("frame_ns") or 0
    for i, size in enumerate(sizes):
        media.packets.append((track, base + relative + i * step // media.scale, at, size, i, key))
        at += size


def demux(data: bytes) -> Media:
    """Parse a file into its packet table."""
    media, segment = Media(), 0
    open_: list[tuple[int, int, dict]] = []  # (id, end, values) of the elements around
    at = 0
    while at < len(data):
        while open_ and at >= open_[-1][1]:
            _close(open_, media)
        begin, width = at, 9 - data[at].bit_length()
        if width > 4:
            raise ValueError(f"no element id at byte {at}")
        name = int.from_bytes(data[at : at + width], "big")
        size, unknown, at = _size(data, at + width)
        if name == CLUSTER:
            while open_ and open_[-1][0] == CLUSTER:  # of unknown size, ended by the next
                _close(open_, media)
        stop = (open_[-1][1] if open_ else len(data)) if size == unknown else at + size
        if stop > len(data):
            raise ValueError(f"the element at byte {begin} is cut off")
        if name in MASTERS:
            if name == SEGMENT:
                segment = at
            if name == CLUSTER:
                media.clusters.append(begin - segment)
            open_.append((name, stop, {}))
            continue
        if name in (SIMPLE_BLOCK, BLOCK):
            _block(data, at, stop, next((v.get(TIMESTAMP, 0) for k, _, v in reversed(open_) if k == CLUSTER), 0), None if name == SIMPLE_BLOCK else False, media)
        elif open_:
            open_[-1][2][name] = _value(name, data[at:stop])
        at = stop
    while open_:
        _close(open_, media)
    return media


def _value(name: int, content: bytes):
    if name in (SAMPLING, DURATION):
        return struct.unpack(">d" if len(content) == 8 else ">f", content)[0]
    if name in (CODEC_ID, DOC_TYPE):
        return content.rstrip(b"\0").decode()
    return int.from_bytes(content, "big") if len(content) <= 8 else content


def _close(open_: list[tuple[int, int, dict]], media: Media) -> None:
    name, _, values = open_.pop()
    if name == EBML:
        media.doc_type = values.get(DOC_TYPE, "")
    elif name == INFO:
        media.scale, media.duration = values.get(TIMESTAMP_SCALE, media.scale), values.get(DURATION, 0.0)
    elif name == AUDIO:
        open_[-1][2][AUDIO] = values
    elif name == TRACK_ENTRY:
        audio = values.get(AUDIO, {})
        media.tracks[values[TRACK_NUMBER]] = {"type": values.get(TRACK_TYPE), "codec": values.get(CODEC_ID, ""), "frame_ns": values.get(DEFAULT_DURATION), "rate": audio.get(SAMPLING, 8000.0), "channels": audio.get(CHANNELS, 1), "bits": audio.get(BIT_DEPTH)}
    elif name == BLOCK_GROUP and BLOCK_DURATION in values and media.packets:
        track, last = media.packets[-1][0], media.packets[-1][4]
        if not (media.tracks.get(track, {}).get("frame_ns") or 0):
            for i, (_, time, *rest) in enumerate(media.packets[-last - 1 :]):
                media.packets[len(media.packets) - last - 1 + i] = (track, time + i * values[BLOCK_DURATION] // (last + 1), *rest)
    elif name == CUE_POSITIONS:
        media.cues.append((open_[-1][2].get(CUE_TIME, 0), values.get(CUE_TRACK, 0), values.get(CUE_CLUSTER, 0)))


def payload_of(text: str, unit: int = FRAME) -> bytes:
    """The text as UTF-8, with spaces up to a positive multiple of the unit."""
    raw = text.encode()
    return raw + b" " * (-len(raw) % unit if raw else unit)


def read_back(data: bytes, media: Media) -> bytes:
    return b"".join(data[at : at + size] for _, _, at, size, _, _ in media.packets)


def features(data: bytes, media: Media, payload: bytes) -> str:
    """Container and signal features of the stored bytes."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64)
    track = media.tracks.get(1, {})
    clusters = set(media.clusters)
    seekable = sum(place in clusters for _, _, place in media.cues)
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    return f"{media.doc_type};{track.get('codec')};{track.get('rate', 0):g}Hz;{track.get('bits')}bit;packets={len(media.packets)};clusters={len(media.clusters)};cues={seekable};ms={media.duration:g};last={max((p[1] for p in media.packets), default=0)};sum={int(x.sum())};squares={int((x * x).sum())};peak={int(x.max())};crossings={crossings}"


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text stored as a Matroska file."""
    prepare(docs.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array([mux(payload_of(x)) for x in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(store, "doc_id bigint, n_bytes bigint, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """doc_id, track, timestamp, start, size, lace, key: a row for each packet of each file."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                columns = list(zip(*demux(data).packets, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(columns[0]), pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "track", "timestamp", "start", "size", "lace", "key"])

    return media.select("doc_id", "media").mapInArrow(parse, "doc_id bigint, track bigint, timestamp bigint, start bigint, size bigint, lace int, key boolean")


def media_features(media: DataFrame) -> DataFrame:
    """Per file, from its bytes: payload and file digests and features."""
    prepare(media.sparkSession)
    names = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                data = batch.column(2)[i].as_py()
                found = demux(data)
                payload = read_back(data, found)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), features(data, found, payload)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in names.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(parse, names)
