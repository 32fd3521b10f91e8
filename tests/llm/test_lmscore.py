import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from larkspur.llm import bytesops, lmscore
from larkspur.llm.lmscore import LogFrequencyFilter, Tokens, expected, quantise, risen, rising, score_texts, train


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", lower), None]


def rows(seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "X,", "x,"]
    out = [(i, " ".join(r.choices(words, weights=range(len(words), 0, -1), k=r.randint(0, 60)))) for i in range(120)]
    return [*out, (200, None), (201, ""), (202, "never seen before"), (5, out[5][1]), (None, "a null id x\x0by"), (203, "long " * 300_000), (204, "y" * 1000 + " " + "y" * 1001)]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def brute(data):
    """base_score and score of each row by plain counts."""
    train_rows = [tokens(x) for i, x in data if not held(i)]
    one, two = Counter(t for x in train_rows for t in x), Counter(p for x in train_rows for p in zip([None, *x], x))
    total, mass = sum(one.values()), sum(one.values()) + len(one) + 1
    p1 = lambda w: (one[w] + 1) / mass
    mean = lambda c: float(expected(quantise(np.array([c])))[0])
    p = lambda h, w: min((mean(two[h, w]) + lmscore.MU * p1(w)) / (one[h] + lmscore.MU), 1)
    out = []
    for i, x in data:
        own = tokens(x)
        out.append((i, held(i), len(own), sum(one[t] > 0 for t in own), total, sum(math.log10(p1(t)) for t in own), sum(math.log10(p(h, w)) for h, w in zip([None, *own], own))))
    return out


def key(r):
    return r[0] is None, r[0] or 0, r[2], r[5]


def test_against_brute_force_whatever_the_packs_and_blocks(spark, monkeypatch):
    data = rows()
    want = sorted(brute(data), key=key)
    docs = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "1 AS w", "2 AS n", "3 AS pack", "4 AS block", "'x' AS ids")
    for pack, block in ((lmscore.PACK_BYTES, lmscore.BLOCK_BYTES), (2000, 100_000)):
        monkeypatch.setattr(lmscore, "PACK_BYTES", pack), monkeypatch.setattr(lmscore, "BLOCK_BYTES", block)
        got = sorted((tuple(r) for r in score_texts(docs).collect()), key=key)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert all(abs(g[5] - w[5]) <= 1e-9 * max(1, -w[5]) for g, w in zip(got, want, strict=True))
        off = np.array([abs(g[6] - w[6]) / max(1, -w[6]) for g, w in zip(got, want, strict=True)])
        assert (off < 1e-9).mean() > 0.9 and off.max() < 0.1  # the rest has false positives


def test_a_bigram_that_occurs_once_stays_however_large_the_corpus(spark):
    ids = [i for i in range(4000) if not held(i)]
    rare = (ids[0], "zebra quilt")
    scores = []
    for n in (10, 3000):
        data = [rare, *((i, " ".join(f"t{(i * k) % 97}" for k in range(40))) for i in ids[1:n])]
        got = {r.doc_id: r.score for r in score_texts(spark.createDataFrame([*data, (ids[-1], "quilt zebra")], "doc_id bigint, text string")).collect()}
        scores.append(got[ids[0]])
        assert got[ids[0]] > math.log10(1e-9)
    assert abs(scores[0] - scores[1]) < 4  # only the first word after an end gets rarer


def test_probabilities_of_a_history_add_up_to_one(spark):
    data = rows(2)
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    model = train(docs)
    own = [tokens(x) for i, x in data if not held(i)]
    count = Counter(t for x in own for t in x)
    assert (model.total, model.distinct) == (sum(count.values()), len(count))
    raw = LogFrequencyFilter.of(model.parts.where("block = 0").first().keys)
    mass = model.total + model.distinct + 1
    names = [w for w in count if w is not None]
    low = [w.encode() for w in names]
    for h in names[:12]:
        text = b"".join(h.encode() + b" " + w + b"\n" for w in low)
        seen = Tokens(np.frombuffer(text, np.uint8), np.array([0, len(text)]), model.blocks)
        at = np.arange(1, 2 * len(names), 2)  # the second word of each line
        level = raw.levels((seen.code[seen.pair[at]] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        p = (expected(level) + lmscore.MU * np.array([(count[w] + 1) / mass for w in names])) / (count[h] + lmscore.MU)
        ends = sum(1 for x in own for a, b in zip(x, x[1:]) if a == h and b is None)
        rest = (ends + lmscore.MU * (count[None] + 2) / mass) / (count[h] + lmscore.MU)
        assert abs(p.sum() + rest - 1) < 0.08  # false positives and quantisation


def test_filter_gives_counts_back():
    r = np.random.default_rng(1)
    keys, counts = r.integers(0, 1 << 62, 3000).astype(np.uint64), r.geometric(0.01, 3000)
    level = quantise(counts)
    f = LogFrequencyFilter(int(level.sum()))
    f.add(keys, level)
    got = f.levels(keys)
    assert (got >= level).all() and (got == level).mean() > 0.99
    assert (f.levels(r.integers(0, 1 << 62, 3000).astype(np.uint64)) > 0).mean() < 0.01
    ratio = expected(level) / counts
    assert ratio.min() > 0.9 and ratio.max() < 1.11
    assert (expected(quantise(np.arange(11))) == np.arange(11)).all()


def test_words_are_not_told_apart_by_a_polynomial():
    a = [0]
    while len(a) < 1024:
        a += [1 - x for x in a]
    words = ["".join("ab"[x] for x in a), "".join("ba"[x] for x in a), "a" * 255, "a" * 256, "a" * 257, "a" * 8, "a" * 9, "a", "a\0", "a\0\0\0\0\0\0\0\0"]
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    one, two = bytesops.word_codes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends)
    assert len(set(one.tolist())) == len(set(two.tolist())) == len(words)


def test_two_words_of_one_polynomial_hash_are_two_words(spark):
    a = [0]
    while len(a) < 1024:
        a += [1 - x for x in a]
    ids = [i for i in range(50) if not held(i)]
    other = next(i for i in range(50) if held(i))
    docs = spark.createDataFrame([(ids[0], "".join("ab"[x] for x in a)), (other, "".join("ba"[x] for x in a))], "doc_id bigint, text string")
    assert {r.doc_id: r.n_known for r in score_texts(docs).collect()} == {ids[0]: 2, other: 1}


def test_numbers_come_back():
    r = np.random.default_rng(2)
    for kind in ("<u4", "<u8"):
        for n in (0, 1, 1000):
            x = np.sort(r.integers(0, np.iinfo(kind).max, n, dtype=kind))
            assert (risen(rising(x), kind, n) == x).all()


def test_nothing_to_learn_from(spark):
    out = next(i for i in range(100) if held(i))
    (r,) = score_texts(spark.createDataFrame([(out, "a b")], "doc_id bigint, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert score_texts(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_model_beats_the_base_on_held_out_text(spark):
    docs = spark.createDataFrame([(i, " ".join(f"a{(i + k) % 50}" for k in range(100))) for i in range(150)], "doc_id bigint, text string")
    got = score_texts(docs).where("held_out").collect()
    assert got and all(r.score > r.base_score for r in got)
