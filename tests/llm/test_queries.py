"""The registered queries over the smallest tables, held against the brute-force versions of the operators' tests."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from larkspur.llm import queries as Q
from larkspur.llm.media import pad
from tests.llm.test_attribution import brute as brute_tokens
from tests.llm.test_decontaminate import brute as brute_windows
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_lmscore import brute as brute_scores
from tests.llm.test_nearcopies import brute as brute_classes
from tests.llm.test_packing import reference_ids
from tests.llm.test_substrings import brute as brute_bytes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").orderBy("doc_id").collect()]


def run(spark, name):
    return Q.QUERIES[name](spark, SF).collect()


def test_op1(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, run(spark, "op1_decontaminate"))) == sorted(brute_windows([d[:2] for d in docs], items))


def test_op2(spark, docs):
    want = [(d[0], *x) for d, x in zip(docs, brute_bytes([d[1] for d in docs], 200), strict=True)]
    assert sorted(map(tuple, run(spark, "op2_substrings"))) == sorted(want)


def test_op4(spark, docs):
    want = {r[0]: r for r in brute_scores([d[:2] for d in docs])}
    off = []
    for r in run(spark, "op4_lm_score"):
        own = want[r.doc_id]
        assert tuple(r)[:5] == own[:5] and abs(r.base_score - own[5]) < 1e-6
        off.append(abs(r.score - own[6]) / max(1, -own[6]))
    assert np.mean(off) < 0.01 and max(off) < 0.05  # false positives of the filter


def test_op5(spark, docs):
    want = {d[0]: x for d, x in zip(docs, brute_lines([d[:2] for d in docs]), strict=True)}
    for r in run(spark, "op5_lines"):
        assert (r.n_lines, r.n_removed, r.n_runs) == want[r.doc_id][:3]


def test_op6(spark, docs):
    want = {i: pad((x or "").encode()) for i, x, *_ in docs}
    for r in run(spark, "op6_media"):
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(want[r.doc_id]), hashlib.sha256(want[r.doc_id]).hexdigest(), zlib.crc32(want[r.doc_id][-64:]))


def test_op7(spark, docs):
    got, bins = defaultdict(dict), defaultdict(list)
    for r in run(spark, "op7_pack"):
        got[r.doc_id][r.piece] = (r.start, r.length, r.ids_crc32)
        bins[r.sequence_id].append((r.offset, r.length))
    total = 0
    for (i, *_), ids in zip(docs, reference_ids([d[1] or "" for d in docs]), strict=True):
        own = np.array([*ids, 0], "<u4")
        total += len(own)
        assert got[i] == {k: (a, min(2048, len(own) - a), zlib.crc32(own[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(own), 2048))}
    for parts in bins.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(bins) <= 1.02 * -(-total // 2048) + 1


def test_op8(spark, docs):
    got = defaultdict(dict)
    for r in run(spark, "op8_token_counts"):
        got[r.doc_id][r.section] = r.n_tokens
    for i, text, lang, source in docs:
        head = (text or "").split("\n")[0]
        parts = [("source", f"source: {source}\n"), ("lang", f"lang: {lang}\n"), ("head", "\n" + head), ("body", (text or "")[len(head) :])]
        assert got[i] == dict(zip([n for n, _ in parts], brute_tokens(parts, "most")[0], strict=True))


def test_op9(spark, docs):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = run(spark, "op9_quality")
    assert len(got) == len(docs)
    judged = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in judged) >= 0.9 * len(judged)


def test_op10(spark, docs):
    want = dict(zip([d[0] for d in docs], brute_classes([d[:2] for d in docs], 0.8), strict=True))
    assert {r.doc_id: r.class_id for r in run(spark, "op10_near_copies")} == want
