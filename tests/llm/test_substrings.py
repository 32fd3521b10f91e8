import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from larkspur.llm.substrings import SuffixOrder, remove_repeats, repeated_windows


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(90), prose(30)
    unit = prose(40)
    out = [unit[:100] * 3, prose(10) + unit[:130] * 2 + unit[:90] + prose(5), unit[:230] * 2, "", "x" * 199, "x" * 200, "y" * 900, "ab" * 400, None, prose(3000)]
    for _ in range(25):
        out.append(prose(r.randint(0, 40)) + passage[r.randint(0, 120) :] + prose(r.randint(0, 40)))
        out.append(prose(20) + line + prose(30))
    base = prose(200)
    out += [base, base]
    for _ in range(10):
        cut = r.randint(100, 900)
        out.append(base[:cut] + "Z" + base[cut + r.randint(0, 3) :])
    return out


@pytest.mark.parametrize("seed,group", [(1, 20000), (2, 3)])
def test_against_brute_force(spark, seed, group):
    rows = [(i, t) for i, t in enumerate(texts(seed))] + [(3, "y" * 900), (None, "q" * 150 + "w" * 150), (None, "another " * 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS m", "'s' AS found", "2 AS tk")
    got = remove_repeats(docs, group=group).collect()
    want = [(r[0], *x) for r, x in zip(rows, brute([t for _, t in rows], 200), strict=True)]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_suffix_order_sorts_and_verifies():
    r = np.random.default_rng(3)
    data = r.integers(97, 99, 400).astype(np.uint8)
    data[200:260] = data[100:160]
    order = SuffixOrder(data, 40)
    starts = np.arange(0, 361)
    raw = data.tobytes()
    assert [raw[s : s + 40] for s in order.sort(starts)] == sorted(raw[s : s + 40] for s in starts)
    again = repeated_windows(data, starts, np.zeros(len(starts), np.int64), 40)
    count = Counter(raw[s : s + 40] for s in starts)
    assert again.tolist() == [count[raw[s : s + 40]] > 1 for s in starts]


def test_the_order_decides(monkeypatch):
    """Two repeated windows and single ones of one part: only a right order brings the equal ones together."""
    r = np.random.default_rng(5)
    made = [r.integers(97, 123, 40).astype(np.uint8) for _ in range(30)]
    pieces = [made[i] for i in (*range(30), *range(12), 3, 4)]
    data = np.concatenate(pieces)
    starts = np.arange(len(pieces)) * 40
    part = np.zeros(len(pieces), np.int64)
    want = [i in (*range(12), *range(30, 44)) for i in range(44)]
    assert repeated_windows(data, starts, part, 40).tolist() == want
    monkeypatch.setattr(SuffixOrder, "sort", lambda self, suffixes, part=None: suffixes[np.random.default_rng(1).permutation(len(suffixes))])
    assert repeated_windows(data, starts, part, 40).tolist() != want


def test_a_collision_is_settled_by_bytes(monkeypatch):
    """Hashes that tell nothing apart: every comparison ties, every neighbour seems equal."""
    monkeypatch.setattr(SuffixOrder, "_alike", lambda self, a, b, n: np.ones(len(a), bool))
    data = np.frombuffer(b"sameheadAAAA" + b"sameheadBBBB" + b"sameheadAAAA" + b"sameheadCCCC", np.uint8)
    assert repeated_windows(data, np.array([0, 12, 24, 36]), np.zeros(4, np.int64), 12).tolist() == [True, False, True, False]


def test_sorting_stays_inside_parts():
    r = np.random.default_rng(6)
    data = r.integers(97, 99, 600).astype(np.uint8)
    starts, part = r.permutation(500), np.sort(r.integers(0, 40, 500))
    raw = data.tobytes()
    order = SuffixOrder(data, 60)
    got = order.sort(starts, part)
    for p in set(part.tolist()):
        assert [raw[s : s + 60] for s in got[part == p]] == sorted(raw[s : s + 60] for s in starts[part == p])


def test_texts_of_several_shards(spark):
    r = np.random.default_rng(9)
    prose = lambda n: bytes(r.integers(97, 123, n).astype(np.uint8)).decode()
    long = prose(2_500_000)
    passage = long[1_000_000:1_300_000]
    rows = [(1, long), (2, "0" + passage + "1" + prose(300_000)), (3, "2" + passage[:5000] + "3"), (4, "é" * 1000), (5, prose(100))]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: (2_500_000, 300_000, 1), 2: (600_002, 300_000, 1), 3: (5002, 5000, 1), 4: (2000, 2000, 1), 5: (100, 0, 0)}
