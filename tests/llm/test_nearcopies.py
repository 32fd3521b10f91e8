import random
import re
from collections import Counter

import numpy as np
import pytest

from larkspur.llm.nearcopies import near_copies, one_of_each, shingles, signatures


def bag(text, k=5):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def jaccard(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def brute(docs, threshold):
    bags = [bag(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (docs[i][1] or "") == (docs[j][1] or "") or (bags[i] and bags[j] and jaccard(bags[i], bags[j]) >= threshold):
                parent[root(i)] = root(j)
    names = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            names[root(i)] = min(names.get(root(i), d), d)
    return [names.get(root(i)) for i in range(len(docs))]


def corpus(seed, n=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(2, 7)))
    out = []
    for _ in range(n):
        words = [word() for _ in range(r.randint(1, 200))]
        out.append(" ".join(words))
        for _ in range(r.choice([0, 0, 1, 4])):
            own = list(words)
            for _ in range(r.randint(0, 1 + len(own) // 40)):
                own[r.randrange(len(own))] = word()
            out.append(" ".join(own))
    out += ["rep " * 300, "rep " * 310, "rep " * 100, "x y", "X, y!", "", None, None, "  ", out[0], out[1].upper()]
    return list(enumerate(out)) + [(3, out[3]), (None, out[5]), (None, "alone null here")]


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 2)])
def test_against_brute_force(spark, seed, block):
    docs = corpus(seed)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS node", "2 AS key", "3 AS c")
    got = near_copies(frame, block=block).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0)
    assert sorted(((r.doc_id, r.class_id) for r in got), key=key) == sorted(((d, c) for (d, _), c in zip(docs, brute(docs, 0.8), strict=True)), key=key)


def test_texts_of_several_shards_and_extra_columns(spark):
    r = random.Random(11)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randint(2, 7))) for _ in range(400_000)]
    near = list(words)
    for i in range(0, len(near), 100):
        near[i] = "changed"
    far = words[: len(words) // 2]
    docs = [(9, " ".join(words)), (4, " ".join(near)), (2, " ".join(far)), (7, " ".join(words))]
    assert len(docs[0][1]) > 2 << 20
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS name", "2 AS spot", "3 AS guest", "4 AS node", "5 AS goes")
    assert {(x.doc_id, x.class_id) for x in near_copies(frame).collect()} == {(9, 4), (4, 4), (7, 4), (2, 2)}
    assert {tuple(x) for x in one_of_each(frame, ("doc_id", "name", "spot", "goes")).collect()} == {(4, 1, 2, 5), (2, 1, 2, 5)}


def test_large_buckets_send_only_strangers_around(spark):
    """One large group of near copies and some texts that share its words: with small blocks every link is still found."""
    r = random.Random(12)
    base = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(120):
        own = list(base)
        own[r.randrange(300)] = f"x{i}"
        docs.append((i, " ".join(own)))
    for i in range(120, 150):
        own = [w if r.random() > 0.035 else f"y{i}" for w in base]
        docs.append((i, " ".join(own)))
    got = {x.doc_id: x.class_id for x in near_copies(spark.createDataFrame(docs, "doc_id bigint, text string"), block=8).collect()}
    assert got == dict(zip(range(150), brute(docs, 0.8), strict=True))


def test_empty(spark):
    assert near_copies(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(4)
    for weights in ([1, 1, 2], [1, 5, 40], [7]):
        codes = r.integers(0, 1 << 62, 60).astype(np.uint64)
        a, b = r.choice(weights, 60), r.choice(weights, 60)
        a[40:], b[:15] = 0, 0
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        rows, code, weight = [], [], []
        for i, w in enumerate((a, b)):
            rows.append(np.full(int((w > 0).sum()), i)), code.append(codes[w > 0]), weight.append(w[w > 0])
        h = signatures(np.concatenate(rows), np.concatenate(code), np.concatenate(weight), 2, 4000)
        assert abs((h[0] == h[1]).mean() - want) < 0.04


def test_shingles_count_repeats():
    raw = b"a b a b a b a b"
    _, _, count = shingles(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 2)
    assert sorted(count.tolist()) == [3, 4]


def test_no_count_of_the_forest_edges_is_returned(spark):
    base = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*base, f"x{i}"])) for i in range(5)], "doc_id bigint, text string")
    got = near_copies(docs)  # only some links of a class of five are tested, so their number says nothing
    assert got.columns == ["doc_id", "class_id"] and {tuple(r) for r in got.collect()} == {(i, 0) for i in range(5)}
