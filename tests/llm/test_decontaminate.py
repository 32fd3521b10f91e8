import hashlib
import random
import re

import numpy as np
import pytest

from larkspur.llm.decontaminate import cut_spans, decontaminate
from larkspur.llm.fmindex import FMIndex


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=8):
    windows = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - k + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(name))
    out = []
    for i, text in docs:
        w = words(text)
        hit, found = set(), set()
        for p in range(len(w)):
            for n in {len(x) for x in windows}:
                names = windows.get(tuple(w[p : p + n])) if p + n <= len(w) else None
                if names:
                    found |= names
                    hit |= set(range(p, p + n))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return out


def fixture(seed):
    r = random.Random(seed)
    vocabulary = ["the", "of", "é", "zwei", "x1", "Ünder", "and", "cat", "dog"]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, prose(r.randint(6, 20))) for i in range(25)] + [(30, "just Three words"), (31, ""), (32, None), (10, "the cat"), (33, "one two three four five six seven eight nine")]
    docs = []
    for i in range(60):
        text = prose(r.randint(0, 150))
        if r.random() < 0.5:
            text += ". " + (r.choice(items)[1] or "").upper().replace(" ", r.choice([" ", ",\n", " - "])) + " " + prose(5)
        docs.append((i, text))
    return [*docs, (100, None), (101, ""), (102, "!!! ..."), (5, docs[5][1]), (None, items[0][1])], items


@pytest.mark.parametrize("seed,block", [(1, 16 << 20), (2, 600)])
def test_against_brute_force(spark, seed, block):
    docs, items = fixture(seed)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS n_words", "2 AS spans", "3 AS items")
    bench = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS item")
    got = decontaminate(frame, bench, block_bytes=block).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(docs, items), key=key)


def test_spans_are_cut_and_nothing_else(spark):
    docs = spark.createDataFrame([(1, "Keep é. One two three four FIVE six, seven eight nine! tail"), (2, "clean text"), (3, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id bigint, text string")
    got = {r.doc_id: r.text for r in cut_spans(docs, decontaminate(docs, bench)).collect()}
    assert got == {1: "Keep é.  nine! tail", 2: "clean text", 3: None}


def test_texts_of_several_shards_and_many_blocks(spark):
    filler = "quite plain words of no item " * 60_000
    items = [(f"i{k}", f"first{k} second third fourth fifth sixth seventh eighth ninth{k} tenth") for k in range(40)] + [("i3", "another text of the same item id with enough words"), (None, "quite plain words of no item quite plain words")]
    docs = [(1, items[0][1] + ". " + filler + items[39][1].upper()), (2, filler), (3, items[40][1])]
    assert len(filler) > 1 << 20
    for block in (4 << 20, 300):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string"), block_bytes=block).collect()}
        assert got == {1: (360_020, 20, ["i0", "i39"]), 2: (360_000, 0, []), 3: (10, 10, ["i3"])}


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert [(r.n_words, r.n_items) for r in decontaminate(docs, bench).collect()] == [(2, 0)]
    assert decontaminate(docs.where("false"), bench).collect() == []


def test_fm_index_counts_and_locates():
    r = np.random.default_rng(2)
    for n, sigma in ((1, 3), (200, 3), (500, 40)):
        text = r.integers(1, sigma, n)
        index = FMIndex(text, sigma)
        for length in (1, 2, 5):
            patterns = np.array([text[i : i + length] for i in range(max(1, n - length))] + [r.integers(1, sigma, length)])[:60] if n >= length else None
            if patterns is None:
                continue
            lo, hi = index.search(patterns, np.full(len(patterns), length))
            for p, a, b in zip(patterns, lo, hi, strict=True):
                want = [i for i in range(n - length + 1) if (text[i : i + length] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want
