import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm.media import describe_media, describe_one, encode_texts, features, mux, pad, parse, payload_of, walk


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 4096, 4097, 100_000])
def test_round_trip(size):
    raw = bytes(np.random.default_rng(size).integers(0, 256, size).astype(np.uint8))
    payload = pad(raw)
    assert len(payload) % 64 == 0 and payload[:size] == raw and len(payload) >= 64
    data = mux(payload)
    (track,) = parse(data)
    assert payload_of(data, track) == payload and mux(payload) == data
    told = describe_one(data)
    assert (told["codec"], told["payload_bytes"], told["n_samples"], told["error"] if "error" in told else None) == ("raw ", len(payload), len(payload) // 64, None)
    assert told["duration_ms"] == len(payload) * 1000 // 8000
    for k, span in enumerate(told["keyframes"]):
        assert data[span["start"] : span["end"]] == payload[k * 4096 : k * 4096 + 64]


def box(kind, body):
    return struct.pack(">I4s", len(body) + 8, kind) + body


def test_a_foreign_container_with_chunk_runs_and_varied_sizes():
    """Two chunks, three samples of unlike size, key samples 1 and 3, 64-bit offsets, junk between the chunks."""
    media = b"AAA" + b"BB" + b"junk" + b"CCCC"
    ftyp = box(b"ftyp", b"isom\0\0\0\0")
    start = len(ftyp) + 8

    def full(kind, *values):
        return box(kind, b"\0" * 4 + b"".join(struct.pack(">I", v) for v in values))

    stbl = box(b"stbl", box(b"stsd", b"\0" * 4 + struct.pack(">I", 1) + box(b"avc1", b"\0" * 8)) + full(b"stsz", 0, 3, 3, 2, 4) + full(b"stsc", 2, 1, 2, 1, 2, 1, 1) + box(b"co64", b"\0" * 4 + struct.pack(">IQQ", 2, start, start + 9)) + full(b"stss", 2, 1, 3))
    mdhd = full(b"mdhd", 0, 0, 1000, 5000, 0)
    hdlr = box(b"hdlr", b"\0" * 8 + b"vide" + b"\0" * 13)
    moov = box(b"moov", box(b"trak", box(b"mdia", mdhd + hdlr + box(b"minf", stbl))))
    data = ftyp + box(b"mdat", media) + moov
    (track,) = parse(data)
    assert payload_of(data, track) == b"AAABBCCCC"
    told = describe_one(data)
    assert (told["codec"], told["handler"], told["duration_ms"]) == ("avc1", "vide", 5000)
    assert [data[k["start"] : k["end"]] for k in told["keyframes"]] == [b"AAA", b"CCCC"]


def patched(data, kind, at, number):
    """data with the 32-bit number `at` bytes into the body of its first box of a kind."""
    spot = data.index(kind) + 4 + at
    return data[:spot] + struct.pack(">I", number) + data[spot + 4 :]


def test_hostile_tables_give_an_error_and_no_allocation():
    whole = mux(pad(b"x" * 10_000))
    for kind, at, number in (
        (b"stsz", 8, 0xFFFFFFFF), (b"stsz", 4, 0), (b"stsz", 4, 0xFFFFFFFF), (b"stsc", 4, 0xFFFFFFFF), (b"stsc", 8, 2), (b"stsc", 8, 0), (b"stsc", 12, 0xFFFFFFFF), (b"stsc", 12, 1),
        (b"stco", 4, 0xFFFFFFFF), (b"stco", 8, 0xFFFFFF00), (b"stss", 4, 0xFFFFFFFF), (b"stss", 8, 0), (b"stss", 8, 0xFFFFFFFF), (b"stts", 4, 0xFFFFFFFF), (b"stts", 8, 0xFFFFFFFF),
    ):
        told = describe_one(patched(whole, kind, at, number))
        assert told["error"] and "payload_bytes" not in told, (kind, at)
    assert "fragmented" in describe_one(whole + box(b"moof", b""))["error"]
    for cut in range(0, len(whole), 97):
        assert describe_one(whole[:cut])["error"]


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 600), st.integers(0, 0xFFFFFFFF))
def test_any_damaged_header_is_described_or_an_error(at, number):
    whole = mux(pad(b"y" * 300))
    told = describe_one(whole[:at] + struct.pack(">I", number) + whole[at + 4 :])
    assert told["media_bytes"] and ("error" in told or told["payload_bytes"] <= told["media_bytes"])


def test_every_track_is_described():
    whole = mux(pad(b"a" * 5000))
    moov = whole.index(b"moov") - 4
    size = struct.unpack(">I", whole[moov : moov + 4])[0]
    trak = whole.index(b"trak") - 4
    own = whole[trak : trak + struct.unpack(">I", whole[trak : trak + 4])[0]]
    two = whole[:moov] + struct.pack(">I", size + len(own)) + whole[moov + 4 : moov + size] + own + whole[moov + size :]
    offset = patched(two, b"stco", 8, whole.index(b"mdat") + 4 + len(own))
    told = describe_one(offset)
    assert len(told["tracks"]) == 2 and told["tracks"][0]["n_samples"] == 79 and told["tracks"][0]["last_time"] == 78 * 64


def test_broken_containers_are_described_as_such():
    whole = mux(pad(b"x"))
    for data in (b"", b"text", whole[:40], box(b"ftyp", b"isom"), struct.pack(">I4s", 4, b"ftyp")):
        assert describe_one(data)["error"]
    assert describe_one(None)["error"] == "null"
    assert [k for k, *_ in walk(whole, 0, len(whole))][:3] == [b"ftyp", b"moov", b"mvhd"]


def test_texts(spark):
    rows = [(1, "é" * 100), (2, None), (3, ""), (3, ""), (None, "x" * 70_000), (4, "long é" * 600_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS media", "2 AS codec")
    got = describe_media(encode_texts(docs)).collect()
    for (i, text), r in zip(sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")), sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), strict=True):
        raw = (text or "").encode()
        assert (r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) == (i, len(raw), hashlib.sha256(pad(raw)).hexdigest(), zlib.crc32(pad(raw)[-64:]))
        assert r.media_bytes > r.payload_bytes and r.feature.endswith(features(pad(raw)))
    assert describe_media(encode_texts(docs.where("false"))).collect() == []
