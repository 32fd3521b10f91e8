"""Media columns: text bytes muxed losslessly into ISO media containers, and containers described by their boxes.

mux() writes 8-bit samples behind a movie header; describe() walks the nested boxes of any such container, decodes
the sample tables and never the payload. The payload is read back through those tables.

A container's payload and codec are those of its first track; `tracks` has codec, duration, samples and key sample
ranges of every one.

Defined cases: null and empty texts count as no bytes and become one unit of zero bytes; a container that is null, cut
short, fragmented, not ISO media, or whose tables count or point past the file gets a null description and `error`,
before anything of the claimed size is allocated; equal bytes give equal containers (nothing in them depends on time or
place); other columns are kept by describe_media and ignored by encode_texts; repeated rows are each reported; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import shards, tuned

UNIT = 64
#: Samples in a chunk; the first of each chunk is a key sample.
CHUNK = 64
RATE = 8000
#: Samples of one track at most; a table that counts more is taken for damaged.
MOST_SAMPLES = 1 << 27
CODEC = b"raw "
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex"}
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % UNIT or (0 if raw else UNIT))


def mux(payload: bytes) -> bytes:
    """A container of one 8-bit track; a sample is UNIT bytes, a chunk CHUNK samples."""
    samples = len(payload) // UNIT
    chunks = -(-samples // CHUNK)
    wide = len(payload) >= 1 << 31
    entry = _box(CODEC, b"\0" * 6, struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
    rest = samples % CHUNK
    to_chunk = [(1, CHUNK)] if samples >= CHUNK else []
    if rest:
        to_chunk.append((chunks, rest))

    def moov(base: int) -> bytes:
        offsets = base + np.arange(chunks, dtype=np.int64) * (UNIT * CHUNK)
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, samples, UNIT)),
            _full(b"stss", struct.pack(">I", chunks), (np.arange(chunks) * CHUNK + 1).astype(">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(to_chunk)), *(struct.pack(">III", a, n, 1) for a, n in to_chunk)),
            _full(b"stsz", struct.pack(">II", UNIT, samples)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        span = samples * UNIT
        return _box(
            b"moov",
            _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, span, 0x10000, 0x100), MATRIX, b"\0" * 24, struct.pack(">I", 2)),
            _box(
                b"trak",
                _full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, span, 0, 0, 0x100, 0), MATRIX, struct.pack(">II", 0, 0), flags=7),
                _box(
                    b"mdia",
                    _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, span, 0x55C4, 0)),
                    _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"samples\0"),
                    _box(b"minf", _full(b"smhd", b"\0" * 4), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl),
                ),
            ),
        )

    kind = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp42")
    head = len(kind) + len(moov(0)) + (8 if len(payload) + 8 < 1 << 32 else 16)
    return b"".join((kind, moov(head), _box(b"mdat", payload)))


@dataclass
class Track:
    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    tables: dict[bytes, bytes] = field(default_factory=dict)

    def times(self) -> np.ndarray:
        """Decoding time of each sample, in units of the timescale."""
        runs = _entries(self.tables[b"stts"], 2)
        if len(runs) and int(runs[:, 0].sum()) > MOST_SAMPLES:
            raise ValueError("stts counts more samples than a file holds")
        step = np.repeat(runs[:, 1], runs[:, 0])
        return np.cumsum(step) - step

    def samples(self, file_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offset and size of each sample in the file, and the (0-based) key samples.

        Counts are held against the tables' own sizes and samples against the file before anything is allocated.
        """
        t = self.tables
        fixed, count = struct.unpack(">II", t[b"stsz"][4:12])
        if count > MOST_SAMPLES or fixed and fixed * count > file_size:
            raise ValueError(f"stsz counts {count} samples, more than the file holds")
        size = np.full(count, fixed, np.int64) if fixed else _entries(t[b"stsz"], 1, 8)[:, 0]
        chunks = _entries(t[b"co64"], 1, wide=True)[:, 0] if b"co64" in t else _entries(t[b"stco"], 1)[:, 0]
        runs = _entries(t[b"stsc"], 3)
        until = np.append(runs[1:, 0], len(chunks) + 1)
        lasts = until - runs[:, 0]
        if len(runs) and (runs[0, 0] != 1 or (lasts < 1).any()) or count and not len(runs):
            raise ValueError("stsc does not lead through the chunks")
        if int((runs[:, 1].astype(object) * lasts).sum()) < count or (runs[:, 1] > count).any():
            raise ValueError("stsc and stsz disagree")
        per_chunk = np.repeat(runs[:, 1], lasts)
        chunk = np.repeat(np.arange(len(per_chunk)), np.diff(np.minimum(np.concatenate(([0], np.cumsum(per_chunk))), count)))
        before = np.cumsum(size) - size
        first = np.minimum(np.cumsum(per_chunk) - per_chunk, max(count - 1, 0))
        offset = chunks[chunk] + before - before[first[chunk]]
        if count and (int(offset.min()) < 0 or int((offset + size).max()) > file_size):
            raise ValueError("a sample lies outside the file")
        key = _entries(t[b"stss"], 1)[:, 0] - 1 if b"stss" in t else np.arange(count)
        if len(key) and (int(key.min()) < 0 or int(key.max()) >= count):
            raise ValueError("stss names samples that are not there")
        return offset, size, key


def _entries(table: bytes, columns: int, count_at: int = 4, wide: bool = False) -> np.ndarray:
    """The rows of a sample table, whose count has to agree with its size."""
    (count,) = struct.unpack(">I", table[count_at : count_at + 4])
    if count * columns * (8 if wide else 4) > len(table) - count_at - 4:
        raise ValueError(f"a sample table of {len(table)} bytes counts {count} rows")
    return np.frombuffer(table, ">u8" if wide else ">u4", count * columns, count_at + 4).astype(np.int64).reshape(-1, columns)


def walk(data: bytes, start: int, end: int, depth: int = 0) -> Iterator[tuple[bytes, int, int]]:
    """Kind and body of every box between start and end, containers before what is in them."""
    while end - start >= 8:
        size, kind = struct.unpack(">I4s", data[start : start + 8])
        body = start + 8
        if size == 1:
            size = struct.unpack(">Q", data[body : body + 8])[0]
            body += 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at {start} leaves its container")
        yield kind, body, stop
        if kind in CONTAINERS and depth < 16:
            yield from walk(data, body, stop, depth + 1)
        start = stop


def parse(data: bytes) -> list[Track]:
    tracks: list[Track] = []
    seen = False
    for kind, body, stop in walk(data, 0, len(data)):
        seen |= kind == b"ftyp"
        if kind == b"moof":
            raise ValueError("a fragmented file: its samples are not in the sample tables")
        if kind == b"trak":
            tracks.append(Track())
        elif not tracks:
            continue
        elif kind == b"mdhd":
            wide = data[body] == 1
            tracks[-1].timescale, tracks[-1].duration = struct.unpack(">IQ" if wide else ">II", data[body + (20 if wide else 12) : body + (32 if wide else 20)])
        elif kind == b"hdlr":
            tracks[-1].handler = data[body + 8 : body + 12].decode("latin-1")
        elif kind == b"stsd":
            tracks[-1].codec = data[body + 12 : body + 16].decode("latin-1")
        elif kind in (b"stsz", b"stsc", b"stco", b"co64", b"stss", b"stts"):
            tracks[-1].tables[kind] = data[body:stop]
    if not seen or not tracks:
        raise ValueError("no ISO media container")
    return tracks


def payload_of(data: bytes, track: Track) -> bytes:
    """The samples of a track in order, by the sample tables alone."""
    offset, size, _ = track.samples(len(data))
    joint = np.flatnonzero(offset[1:] != offset[:-1] + size[:-1]) + 1
    first = np.concatenate(([0], joint)) if len(offset) else joint
    last = np.append(joint, len(offset))
    return b"".join(data[offset[a] : offset[b - 1] + size[b - 1]] for a, b in zip(first.tolist(), last.tolist(), strict=True) if b > a)


def features(payload: bytes) -> str:
    """Whole-number features of 8-bit samples: energy about the middle, crossings, a 16-band level histogram."""
    level = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((level[1:] < 0) != (level[:-1] < 0)))
    bands = np.bincount((level + 128) >> 4, minlength=16)
    return f"sum={int(level.sum())};energy={int((level * level).sum())};crossings={crossings};bands={','.join(map(str, bands.tolist()))}"


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (unpadded) and media: the whole text of each row, muxed."""
    tuned(docs.sparkSession)
    source = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, "raw"):
            raw = shard.column("raw")
            media = pa.array((mux(pad(x.as_py())) for x in raw), pa.large_binary())
            yield from pa.table({"doc_id": shard.column("doc_id"), "n_bytes": pc.binary_length(raw).cast(pa.int64()), "media": media.cast(pa.binary())}).to_batches()

    return source.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
DESCRIBED = {
    "codec": pa.string(), "handler": pa.string(), "duration_ms": pa.int64(), "n_samples": pa.int64(), "keyframes": RANGES,
    "tracks": pa.list_(pa.struct([("codec", pa.string()), ("handler", pa.string()), ("duration_ms", pa.int64()), ("n_samples", pa.int64()), ("last_time", pa.int64()), ("keyframes", RANGES)])),
    "media_bytes": pa.int64(), "media_sha256": pa.string(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "feature": pa.string(), "error": pa.string(),
}
_RANGES_DDL = "array<struct<start:bigint,end:bigint>>"
DESCRIBED_DDL = f"codec string, handler string, duration_ms bigint, n_samples bigint, keyframes {_RANGES_DDL}, tracks array<struct<codec:string,handler:string,duration_ms:bigint,n_samples:bigint,last_time:bigint,keyframes:{_RANGES_DDL}>>, media_bytes bigint, media_sha256 string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, feature string, error string"


def _described(track: Track, offset: np.ndarray, size: np.ndarray, key: np.ndarray) -> dict:
    times = track.times() if b"stts" in track.tables else np.zeros(0, np.int64)
    return {
        "codec": track.codec, "handler": track.handler, "duration_ms": track.duration * 1000 // track.timescale if track.timescale else None, "n_samples": len(size),
        "last_time": int(times[-1]) if len(times) else None, "keyframes": [{"start": a, "end": b} for a, b in zip(offset[key].tolist(), (offset[key] + size[key]).tolist(), strict=True)],
    }


def describe_one(data: bytes | None) -> dict:
    if data is None:
        return {"error": "null"}
    out = {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
    try:
        found = [(track, track.samples(len(data))) for track in parse(data)]
        tracks = [_described(track, *own) for track, own in found]
        payload = payload_of(data, found[0][0])
    except (ValueError, KeyError, IndexError, OverflowError, struct.error) as error:
        return out | {"error": f"{type(error).__name__}: {error}"[:200]}
    first = {k: v for k, v in tracks[0].items() if k != "last_time"}
    return out | first | {
        "tracks": tracks, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:]),
        "feature": f"codec={first['codec'].strip()};ms={first['duration_ms'] or 0};keys={len(first['keyframes'])};{features(payload)}",
    }


def describe_media(media: DataFrame, column: str = "media") -> DataFrame:
    """The other columns of `media`, with codec, duration, key sample byte ranges and digests in place of `column`."""
    kept = [c for c in media.columns if c != column]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, column):
            rows = [describe_one(x.as_py()) for x in shard.column(column)]
            yield from pa.table({c: shard.column(c) for c in kept} | {c: pa.array([r.get(c) for r in rows], t) for c, t in DESCRIBED.items()}).to_batches()

    ddl = "".join(f"`{c}` {media.schema[c].dataType.simpleString()}, " for c in kept) + DESCRIBED_DDL
    return media.mapInArrow(work, ddl)
