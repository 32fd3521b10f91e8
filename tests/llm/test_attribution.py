import numpy as np
import pytest

from larkspur.llm.attribution import allocate, attribute_tokens, document_sections
from larkspur.llm.tokenise import BYTE_BPE, byte_encoding


def brute(parts, rule):
    encoding, _ = byte_encoding(BYTE_BPE)
    whole = "".join(t for _, t in parts)
    tokens = [encoding.decode_single_token_bytes(i) for i in encoding.encode_ordinary(whole)]
    owner = [k for k, (_, t) in enumerate(parts) for _ in t.encode()]
    count, at = [0.0] * len(parts), 0
    for t in tokens:
        held = owner[at : at + len(t)]
        if rule == "first":
            count[held[0]] += 1
        elif rule == "share":
            for k in held:
                count[k] += 1 / len(t)
        else:
            count[max(sorted(set(held)), key=held.count)] += 1
        at += len(t)
    return count, len(tokens)


ROWS = [(1, "Title é\nBody body\n\n  x", "en", "s1"), (2, None, None, None), (3, "", "fr", "s"), (3, "", "fr", "s"), (None, "one line", "de", "z"), (5, "word " * 4000 + "\nend", "en", "s"), (6, "Long é\n" + "many words, " * 150_000, "en", "s")]


@pytest.mark.parametrize("rule", ["most", "first", "share"])
def test_against_brute_force(spark, rule):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string").selectExpr("*", "'c' AS section", "1 AS row", "2 AS whole")
    got = attribute_tokens(document_sections(docs), rule).orderBy("row", "position").collect()
    by_row = {}
    for r in got:
        by_row.setdefault(r.row, []).append(r)
    for (i, text, lang, source), own in zip(ROWS, [by_row[k] for k in sorted(by_row)], strict=True):
        text = text or ""
        head = text.split("\n")[0]
        parts = [("source", f"source: {source or ''}\n"), ("lang", f"lang: {lang or ''}\n"), ("head", "\n" + head), ("body", text[len(head) :])]
        count, total = brute(parts, rule)
        assert [(r.doc_id, r.section) for r in own] == [(i, n) for n, _ in parts]
        assert np.allclose([r.n_tokens for r in own], count) and own[0].doc_tokens == total
        ends = np.cumsum([len(t) for _, t in parts]).tolist()
        assert [r.end_char for r in own] == ends and [r.start_char for r in own] == [0, *ends[:-1]]


def test_crossing_rules():
    token, bounds = np.array([0, 3, 8, 10]), np.array([0, 4, 6, 6, 10])
    assert allocate(token, bounds, "most")[0].tolist() == [1, 1, 0, 1]
    assert allocate(token, bounds, "first")[0].tolist() == [2, 0, 0, 1]
    assert np.allclose(allocate(token, bounds, "share")[0], [1.2, 0.4, 0, 1.4])
    assert allocate(token, bounds, "most")[1].tolist() == [1, 1, 0, 1]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    assert attribute_tokens(document_sections(docs)).collect() == []
