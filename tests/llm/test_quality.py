import random
import zlib

import numpy as np

from larkspur.llm.quality import best_bin, cells, class_prior, classify_quality, fit, row_features, train


def corpus(seed, n=600):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(r.randint(2, 8)))
    docs, labels = [], []
    for i in range(n):
        text = "\n".join(" ".join(word() for _ in range(r.randint(3, 15))) for _ in range(r.randint(1, 12)))
        good = r.random() < 0.85
        if not good:
            text = r.choice([lambda t: t.upper() + "!!", lambda t: t.replace(" ", "### "), lambda t: " | ".join(t.split()), lambda t: (t.split()[0] + " ") * 90])(text)
        docs.append((i, text))
        if r.random() < 0.5:
            labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(1)
    docs += [(900, None), (901, ""), (902, "x" * 200_000), (903, "many words here\n" * 150_000), (0, docs[0][1]), (None, "null id")]
    told = [*labels, (labels[0][0], None), (None, 1), (99999, 1)]
    got = classify_quality(spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS score", "'x' AS features"), spark.createDataFrame(told, "doc_id bigint, quality int")).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    truth, seen = dict(labels), [r for r in got if r.held_out]
    judged = [(r.predicted, truth[r.doc_id]) for r in seen if r.doc_id in truth]
    assert sum(p == t for p, t in judged) / len(judged) > 0.95
    assert [t for _, t in judged].count(0) > 5


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = corpus(2, 200)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in labels]
    one, two = ({r.doc_id: r.score for r in classify_quality(frame, spark.createDataFrame(x, "doc_id bigint, quality int")).collect()} for x in (labels, flipped))
    assert one == two


def test_without_labels_or_rows(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [(r.score, r.predicted) for r in classify_quality(frame, none).collect()] == [(0.5, 1)]
    assert classify_quality(frame.where("false"), none).collect() == []


def test_features_do_not_depend_on_the_neighbours():
    raws = [x.encode() for x in ("One two\ntwo two", "", "é!! | x", "A" * 1000)]
    together = row_features(np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)]))
    for i, raw in enumerate(raws):
        assert np.allclose(row_features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0], together[i])


def test_risk_stays_non_negative_with_a_wrong_prior():
    r = np.random.default_rng(1)
    p, u = r.normal(1, 0.3, (200, 26)), np.concatenate((r.normal(1, 0.3, (150, 26)), r.normal(-1, 0.3, (50, 26))))
    for prior in (0.5, 0.75, 0.95):
        model = fit(p, u, prior)
        assert model.score(p).mean() > 0.8 and (prior > 0.8 or model.score(u[150:]).mean() < 0.3)


def test_prior_is_estimated_from_positives_and_unlabelled_rows():
    r = np.random.default_rng(4)
    for prior in (0.3, 0.6, 0.85):
        p, u = r.normal(1, 0.5, (2000, 26)), np.concatenate((r.normal(1, 0.5, (int(4000 * prior), 26)), r.normal(-0.5, 0.5, (4000 - int(4000 * prior), 26))))
        u = u[r.permutation(len(u))]
        assert abs(class_prior(p, u, np.ones(len(u)), 100) - prior) < 0.06
    assert abs(best_bin(np.linspace(0.5, 1, 500), np.concatenate((np.linspace(0.5, 1, 500), np.linspace(0, 0.4, 500))), np.ones(1000)) - 0.5) < 0.05


def test_negative_labels_do_not_set_the_prior(spark):
    """Among the labels half are good, among the documents nine in ten: only positives and unlabelled rows count."""
    docs, labels = corpus(6, 1500)
    bad = [x for x in labels if not x[1]]
    some = [x for x in labels if x[1]][: len(bad)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    prior = train(frame, spark.createDataFrame(bad + some, "doc_id bigint, quality int")).prior
    assert 0.7 < prior < 0.98


def test_cells_count_every_row(spark):
    docs, _ = corpus(7, 300)
    frame = spark.createDataFrame([*docs, (None, None), (1, docs[1][1])], "doc_id bigint, text string")
    raws = [x.encode() for _, x in docs[:20]]
    means, count = cells(frame, row_features(np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)])))
    whole = [(x or "").encode() for _, x in [*docs, (None, None), (1, docs[1][1])]]
    want = row_features(np.frombuffer(b"".join(whole), np.uint8), np.cumsum([0, *map(len, whole)])).mean(0)
    assert count.sum() == 302 and np.allclose((means * count[:, None]).sum(0) / 302, want, atol=1e-5)
