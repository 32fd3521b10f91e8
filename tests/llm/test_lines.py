import random

import numpy as np

from larkspur.llm.lines import line_spans, repeated_lines, winnowed


def brute(docs, window=2, long_words=50):
    """docs: (id, text) in order; equal rows are one document."""
    strip = " \t\n\r\x0b\x0c"
    firsts, result = {}, {}
    for doc in docs:
        if doc in result:
            continue
        lines = [(k, x.strip(strip)) for k, x in enumerate((doc[1] or "").split("\n")) if x.strip(strip)]
        names = [x for _, x in lines]
        gone = set()
        for i in range(len(names)):
            for n in ([window] if i + window <= len(names) else []) + ([1] if len(names[i].translate({ord(c): " " for c in strip}).split(" ")) - names[i].translate({ord(c): " " for c in strip}).split(" ").count("") >= long_words else []):
                unit = tuple(names[i : i + n])
                if firsts.setdefault(unit, (doc, i)) != (doc, i):
                    gone.update(range(i, i + n))
        runs = sum(1 for i in gone if i - 1 not in gone)
        kept = [x for i, (_, x) in enumerate(lines) if i not in gone]
        result[doc] = (len(lines), len(gone), runs, kept)
    return [result[d] for d in docs]


def test_against_brute_force(spark):
    r = random.Random(5)
    pool = [f"line {i} " + "w " * r.randint(0, 4) for i in range(30)] + ["long " * 55, "  long " * 1 + "long " * 54]
    docs = [(i, "\n".join(r.choice([*pool, "", "  ", f"own {i} {j}"]) for j in range(r.randint(0, 25)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "\n\n"), (63, "a\na\na\na"), (63, "a\na\na\na"), (64, docs[3][1]), (65, "é x\r\né y\r\n"), (66, "é x\né y")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS fp", "2 AS found", "3 AS line")
    got = {}
    for row in repeated_lines(frame).collect():
        got.setdefault((row.doc_id, row.text), []).append(row)
    for doc, (n, removed, runs, kept) in zip(docs, brute(docs), strict=True):
        for row in got[doc]:
            assert (row.n_lines, row.n_removed, row.n_runs) == (n, removed, runs), doc
            assert [x.strip() for x in (row.kept or "").split("\n") if x.strip()] == [x.strip() for x in kept]
            if not removed:
                assert row.kept == row.text
    assert sum(map(len, got.values())) == len(docs)


def test_empty(spark):
    assert repeated_lines(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def buffers(texts):
    raws = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)])


def test_winnowing_selects_fewer_positions_than_windows_and_misses_none():
    r = random.Random(3)
    texts = ["\n".join(f"line {r.randint(0, 500)}" for _ in range(r.randint(0, 60))) for _ in range(80)]
    for window in (2, 3, 5):
        found = winnowed(*buffers(texts), window, 50)
        windows = sum(max(0, len(t.split("\n")) - window + 1) for t in texts)
        assert len(found["row"]) < (0.72 if window == 2 else 0.55) * windows
        selected = set(zip(found["row"].tolist(), found["line"].tolist()))
        for row, t in enumerate(texts):
            n = len(t.split("\n")) if t else 0
            assert all(any((row, i + k) in selected for k in range(window)) for i in range(n - window + 1))
        assert np.count_nonzero(found["around"]) == windows  # each window is extended to from one position


def test_a_shared_line_without_shared_neighbours_is_no_repeat(spark):
    """What a fingerprint matches is not deleted before the match is extended."""
    docs = [(i, f"own {i}\nshared\nother {i}") for i in range(6)] + [(7, "own 3\nshared\nelse"), (8, "x\nshared\nother 2")]
    got = {r.doc_id: (r.n_removed, r.n_runs, r.kept) for r in repeated_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {i: (0, 0, t) for i, t in docs[:6]} | {7: (2, 1, "else"), 8: (2, 1, "x\n")}


def test_longer_windows_and_texts_of_several_shards(spark):
    r = random.Random(8)
    pool = [f"{i} " + "w" * r.randint(0, 200) for i in range(3000)]
    big = "\n".join(r.choice(pool) for _ in range(25_000))  # above one shard
    docs = [(1, big), (2, "\n".join(f"{k}" for k in range(10))), (3, "a\n" + "\n".join(f"{k}" for k in range(3, 9)) + "\nb"), (4, big[: len(big) // 2]), (5, "long " * 300_000), (6, "long " * 300_000)]
    assert len(big) > 2 << 20
    for window in (2, 4):
        got = {row.doc_id: (row.n_lines, row.n_removed, row.n_runs) for row in repeated_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), window=window).collect()}
        assert got == {d[0]: x[:3] for d, x in zip(docs, brute(docs, window), strict=True)}


def test_line_spans_strip_and_count():
    lines, start, end, row = line_spans(*buffers([" a \n\n\tb", "", "c\r\n"]))
    assert (lines, start.tolist(), end.tolist(), row.tolist()) == ([b"a", b"b", b"c"], [1, 6, 7], [2, 7, 8], [0, 0, 2])
