import random
from collections import defaultdict

import pytest

import corpus_pipeline as cp
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_nearcopies import brute as brute_classes


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(11)
    folder = tmp_path_factory.mktemp("sf")
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(r.randint(2, 7)))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(max(1, n // 12)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(5)]
    shared = prose(36)
    docs, labels = [], []
    for i in range(300):
        kind, text = i % 10, prose(r.randint(60, 200))
        if kind == 9:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if kind == 1:
            text += "\n" + shared
        if kind == 2 and docs:
            words = docs[-2][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words).replace("\n", " ")
        if kind == 3:
            text += "\n" + items[i % 5][1]
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        if r.random() < 0.6:
            labels.append((i, 0 if kind == 9 else 1, 0))
    docs += [(300, None, "en", "s", 0), (301, "", None, None, None), (0, *docs[0][1:]), (None, "a null id stays here\nwith two lines", "en", "s", 7)]
    long = "\n".join(" ".join(word() * 20 for _ in range(12)) for _ in range(1100))
    assert len(long) > 1 << 20  # more than a worker takes at once
    docs.append((302, long, "en", "s", len(long)))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), items


def rows(df):
    return [tuple(x) for x in df.select(*cp.COLUMNS).collect()]


def test_stages_against_brute_force(spark, corpus):
    folder, items = corpus
    docs = cp.table(spark, folder, "documents")
    stages = dict(cp.STAGES)
    good = cp.stored(stages["quality classifier"](spark, docs, folder))
    left = {x[0] for x in rows(good)}
    assert all((i not in left) == (i % 10 == 9) for i in range(300))
    assert set(rows(good)) <= set(rows(docs))

    lines = cp.stored(stages["line dedup"](spark, good, folder))
    assert lines.columns == list(cp.COLUMNS)
    before = sorted({(x[0], x[1]) for x in rows(good)}, key=lambda x: (x[0] is not None, x[0] or 0))
    want = {d[0]: kept for d, (*_, kept) in zip(before, brute_lines(before), strict=True)}
    for i, text, *_, n in rows(lines):
        assert [x for x in (text or "").split("\n") if x.strip()] == want[i]
        assert text is None or n == len(text)

    one = cp.stored(stages["near-dedup"](spark, lines, folder))
    own = [(x[0], x[1]) for x in rows(lines)]
    classes = brute_classes(own, 0.8)
    expected = {(i, t) for (i, t), c in zip(own, classes, strict=True) if i == c}
    got = [(x[0], x[1]) for x in rows(one)]
    assert sorted(got, key=str) == sorted(expected, key=str)

    clean = cp.stored(stages["benchmark decontamination"](spark, one, folder))
    texts = {x[0]: x[1] for x in rows(clean)}
    assert all(t not in (texts[i] or "") for i in texts for _, t in items)
    for i, text in got:
        cut = text
        for _, t in items:
            cut = cut.replace(t, "") if cut else cut
        assert texts[i] == cut

    packed = stages["best-fit packing"](spark, clean, folder).collect()
    assert {x.doc_id for x in packed} == set(texts)
    bins = defaultdict(int)
    for x in packed:
        bins[x.sequence_id] += x.length
    assert max(bins.values()) <= 2048 and len(bins) <= 1 + -(-sum(bins.values()) // 2048)


def test_stages_of_nothing(spark, corpus):
    """Empty tables stay empty, with the columns of documents, through all stages."""
    docs = cp.table(spark, corpus[0], "documents").where("false")
    for name, stage in cp.STAGES[:-1]:
        docs = cp.stored(stage(spark, docs, corpus[0]))
        assert docs.columns == list(cp.COLUMNS) and docs.collect() == [], name
    assert cp.STAGES[-1][1](spark, docs, corpus[0]).collect() == []


def test_ties_and_extra_columns(spark, corpus):
    """Of rows that are equal in everything one stays; clashing column names do not disturb a stage."""
    text = "one line of some plain words here\nand a second line that follows it"
    rows_in = [(7, text, "en", "s", 1), (7, text, "en", "s", 1), (8, text, "en", "s", 1)]
    docs = spark.createDataFrame(rows_in, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "1 AS node", "2 AS tk", "3 AS goes", "4 AS spans", "5 AS score", "6 AS length")
    stages = dict(cp.STAGES)
    assert [tuple(x) for x in stages["near-dedup"](spark, docs, corpus[0]).collect()] == [(7, text, "en", "s", 1)]
    cut = sorted((x.doc_id, x.text) for x in stages["line dedup"](spark, docs, corpus[0]).collect())
    assert cut == [(7, text), (7, text), (8, "")]
    for name in ("quality classifier", "benchmark decontamination"):
        assert stages[name](spark, docs, corpus[0]).columns == list(cp.COLUMNS)
    assert len(stages["best-fit packing"](spark, docs, corpus[0]).collect()) == 3


def test_run_gives_the_last_stage(spark, corpus):
    out = cp.run(spark, corpus[0])
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 100
