import zlib
from collections import defaultdict
from inspect import signature

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm.packing import Slots, best_fit, linear_program, pack, plan, weighted_prices
from larkspur.llm.tokenise import PieceEncoder, vocabulary_path


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


TEXTS = ["", "It's a b\x1cc  d\n\ne", "ΌΣΟΣ ΣΑΣ\u0085x é é", "<|endoftext|> <|startoftext|>x", " \t ", "word " * 5000, "naïve ﬁ İ 123 45!?...", "(It's)a.B,c'd 's't*x*…!é,É.e\u0301,=\u0338a", "a" * 300 + "1b2"]


def test_piece_encoder_equals_the_tokenizer_even_when_its_cache_overflows():
    encoder = PieceEncoder(cache=6)
    for _ in range(2):
        for texts in (TEXTS, TEXTS[::-1]):
            raws = [x.encode() for x in texts]
            ids, bounds = encoder.encode(np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)]))
            assert [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(texts))] == reference_ids(texts)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_holds_every_piece_once_and_never_overfills(histogram):
    plans = plan(histogram, 64, rounds=30)
    used = defaultdict(int)
    for pattern, n in plans:
        assert sum(length * c for length, c in pattern) <= 64
        for length, c in pattern:
            used[length] += c * n
    assert used == histogram
    assert sum(n for _, n in plans) <= 1 + 1.1 * sum(n for _, n in best_fit(dict(histogram), 64))
    slots = Slots(plans)
    seen = defaultdict(list)
    for length, n in histogram.items():
        sequence, offset = slots.place(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            seen[s].append((o, length))
    for parts in seen.values():
        at = 0
        for o, length in sorted(parts):
            assert o == at
            at += length


def test_pack_against_the_tokenizer(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(9, None), (1, TEXTS[1]), (None, "null id"), (10, "It's 45 long ones! " * 80_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "1 AS length", "'x' AS sequence_id", "2 AS salt")
    got = pack(docs).collect()
    wanted = []
    for (i, _), ids in zip(rows, reference_ids([t or "" for _, t in rows]), strict=True):
        own = np.array([*ids, 0], "<u4")
        wanted += [(i, k, a, min(2048, len(own) - a), zlib.crc32(own[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(own), 2048))]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(wanted, key=key)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) == -(-sum(w[3] for w in wanted) // 2048)


def test_pack_of_nothing(spark):
    assert pack(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def sequences(plans):
    return sum(n for _, n in plans)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_never_needs_more_than_best_fit(histogram):
    assert sequences(plan(histogram, 64)) <= sequences(best_fit(dict(histogram), 64))


def test_a_histogram_that_greedy_rounding_lost():
    assert sequences(plan({24: 4, 11: 2, 4: 1, 5: 2, 33: 5}, 64)) == 5


def lognormal(n, mean, spread, seed=1):
    sizes = np.minimum(np.maximum(np.random.default_rng(seed).lognormal(mean, spread, n).astype(int), 1), 2047)
    return np.unique(sizes, return_counts=True)


def test_the_program_is_near_its_bound_and_does_the_packing():
    lengths, demand = lognormal(60_000, 5.8, 0.9)
    prices, bound = weighted_prices(lengths, demand, 2048)
    whole = linear_program(lengths, demand, 2048)
    assert bound * (1 - 1e-9) <= sum(x for _, x in whole) <= 1.002 * bound
    rounded = sum(int(x) for _, x in whole)
    plans = plan(dict(zip(lengths.tolist(), demand.tolist(), strict=True)))
    assert rounded > 0.85 * sequences(plans) and sequences(plans) <= 1.002 * bound + 1
    # a feasible dual: no configuration is worth more than one
    for k in np.random.default_rng(2).integers(0, len(lengths), (300, 12)):
        own = k[np.cumsum(lengths[k]) <= 2048]
        assert prices[own].sum() <= 1 + 1e-9


def test_the_weights_matter():
    """By length alone, fewer sequences seem enough than these lengths can ever be put into."""
    lengths, demand = np.array([700, 1100, 1400]), np.array([1000, 1000, 1000])
    plain = (lengths / 2048 * demand).sum()
    _, bound = weighted_prices(lengths, demand, 2048)
    assert bound > 1.15 * plain
    wide, many = np.unique(np.random.default_rng(1).integers(700, 2047, 20_000), return_counts=True)
    assert weighted_prices(wide, many, 2048)[1] > 1.08 * (wide / 2048 * many).sum()
    tight = np.array([8, 22, 39, 47, 59]), np.array([1, 34, 36, 27, 45])
    assert sum(x for _, x in linear_program(*tight, 64)) < sum(x for _, x in linear_program(*tight, 64, weights=False)) - 30


def test_the_program_covers_every_length_of_a_wide_histogram():
    lengths = np.arange(1, 1101)
    demand = lengths * 7919 % 400 + 1
    covered = np.zeros(len(lengths))
    for pattern, times in linear_program(lengths, demand, 2048, signature(plan).parameters["rounds"].default):
        for k, n in pattern.items():
            covered[k] += times * n / demand[k]
    assert (covered > 1 - 1e-9).all()
