"""Routing over whole query texts: words after the eighth count."""

import math
from collections import Counter

import pytest

from larkspur.operators import routing as RT
from larkspur.plans import adapters as A

LONG = "alpha beta gamma delta epsilon zeta eta theta parse ledger invoices quickly"


@pytest.fixture()
def queries(spark, tmp_path):
    rows = [(1, LONG), (2, " ".join(["filler"] * 8 + ["ledger", "invoices"])), (3, None), (4, "ledger")]
    spark.createDataFrame(rows, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return A.queries_view(spark, str(tmp_path))


def test_the_view_keeps_every_word(queries):
    assert {r.query_id: r.query for r in queries.collect()} == {1: LONG, 2: "filler " * 8 + "ledger invoices", 3: "", 4: "ledger"}


def test_late_words_decide_the_ranking(spark, queries):
    targets = [("a", "parse ledger invoices"), ("b", "alpha beta"), ("c", "unrelated words")]
    contributors = spark.createDataFrame([(i, "skill", t) for i, t in targets], "id string, kind string, routing_text string")
    effective = spark.createDataFrame([("h", i, i) for i, _ in targets], "harness string, id string, name string")
    got = {(r.query_id, r.id): (r.place, r.score) for r in RT.rank(queries, effective, contributors).collect()}

    def score(a, b):
        total = 0.0
        for k, share in ((1, RT.UNIGRAM), (2, RT.BIGRAM)):
            x, y = (Counter(" ".join(t[i : i + k]) for i in range(max(1, len(t) - k + 1))) for t in (a.split(), b.split()))
            norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
            total += share * sum(x[g] * y[g] for g in x) / norm
        return total

    texts = dict(targets)
    assert {k for k in got if k[0] == 1} == {(1, "a"), (1, "b")} and got[1, "a"][0] == 1  # the first eight words alone find b
    assert (2, "a") in got  # and find nothing here
    for (q, i), (_, s) in got.items():
        assert s == pytest.approx(score({1: LONG, 2: "filler " * 8 + "ledger invoices", 4: "ledger"}[q], texts[i]), abs=1e-5)


def test_tasks_keep_only_their_best(spark, queries):
    ids = [f"t{i:03}" for i in range(300)]
    contributors = spark.createDataFrame([(i, "skill", "ledger " + "x " * n) for n, i in enumerate(ids)], "id string, kind string, routing_text string")
    effective = spark.createDataFrame([("h", i, i) for i in ids], "harness string, id string, name string")
    ranked = RT.rank(queries, effective, contributors)
    assert [(r.place, r.id, r.verdict) for r in ranked.where("query_id = 4").orderBy("place").collect()] == [(n + 1, i, "routes") for n, i in enumerate(ids[:5])]
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().executedPlan().toString()  # before rows of a ranking are sorted in one task
