import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from larkspur.functions import structures as S
from larkspur.session import prepare


def one(spark, column, **values):
    df = prepare(spark).createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


def test_printable_and_diff(spark):
    assert one(spark, S.printable("t"), t="a​\tb\x07") == "a\\u200b\tb\\u0007"
    assert one(spark, S.diff_lines("a", "b"), a="x\ny", b="x\nz") == 6 and one(spark, S.diff_lines("a", "b"), a="x", b="x") == 0


def test_json_functions(spark):
    schema = '{"title": "T", "properties": {"b": {"description": "B"}, "a": {"enum": ["secret"]}}, "default": {"title": "no"}}'
    assert one(spark, S.schema_strings("t"), t=schema) == ["a", "b", "B", "T"] and one(spark, S.schema_strings("t"), t="{") == []
    assert one(spark, S.canonical_json("t"), t='{"b": {"z": 1, "é": [2]}, "a": null, "runtime_hash": 5}') == '{"a":null,"b":{"z":1,"é":[2]}}'
    assert [one(spark, S.any_angle_bracket("t"), t=t) for t in ('{"a": ["x", {"b": "<"}]}', '{"<": 1}')] == [True, False]


@pytest.mark.parametrize("text,want", [
    ("[]", "metadata is not an object"), ('{"transport": "tcp"}', "unknown transport"), ('{"transport": "stdio", "command": 1}', "command is not a string"), ('{"transport": "stdio"}', "stdio entry has no command"), ('{"transport": "http", "url": "u", "args": [1]}', "args is not a list of strings"), ('{"transport": "http", "url": "u"}', None),
])
def test_metadata(spark, text, want):
    assert one(spark, S.metadata_problem("t"), t=text) == want


def test_paths_and_names(spark):
    assert one(spark, S.portable_path("p", "/w/proj", "/home/me"), p="/w/proj/a/b") == "./a/b"
    assert one(spark, S.portable_path("p", "/w/proj", "/home/me"), p="/home/me/x") == "~/x"
    assert one(spark, S.folder_name("p"), p="/a.b/c") == "-a-b-c"
    assert [one(spark, S.repository("p"), p=p) for p in ("https://github.com/o/r.git", "github:o/r@v1", "o/r/path", "plain")] == ["o/r", "o/r", "o/r", None]
    assert [one(spark, S.selector_name("p"), p=p) for p in (" My Skill! ", "___", "a.b_c")] == ["my-skill", "skill", "a.b_c"]
    assert [one(spark, S.machine_local(F.col("p")), p=p) for p in ("/x", "C:\\x", "\\\\host", "o/r", "./a")] == [True, True, True, False, True]


def test_tree_hash_orders_by_parts(spark):
    rows = [("s", "a/z", bytearray(b"1")), ("s", "a-b", bytearray(b"2")), ("s", ".git/x", bytearray(b"3"))]
    df = prepare(spark).createDataFrame(rows, "id string, relpath string, content binary")
    want = hashlib.sha256(b"a/z" + b"1" + b"a-b" + b"2").hexdigest()
    assert S.tree_hash(df).first().tree_hash == want


def test_since_and_verify(spark):
    now = dt.datetime(2026, 1, 8, tzinfo=dt.timezone.utc)
    assert S.since("7d", now).day == 1 and S.since("2025-12-31", now).year == 2025
    with pytest.raises(ValueError):
        S.since("soon", now)
    rule = S.verified(*[F.col(c) for c in "abcd"])
    assert [one(spark, rule, a=a, b=b, c=c, d=d) for a, b, c, d in (("1", "1", "", ""), ("1", "2", "3", "3"), ("1", None, "3", "3"), ("1", None, "3", "4"))] == ["ok", "mismatch", "legacy_ok", "mismatch"]


def test_age_labels_and_portability(spark):
    df = prepare(spark).createDataFrame([("n", "a", 1), ("n", "b", 2), ("m", "c", 5), ("m", "d", 5)], "name string, id string, mtime int")
    assert {(r.id, r.label) for r in S.age_labels(df).collect()} == {("a", "older"), ("b", "newest"), ("c", "copy"), ("d", "copy")}
    servers = spark.createDataFrame([("s", "/bin/x", ["a", "./b"])], "name string, command string, args array<string>")
    assert {r.value for r in S.portability_notes(servers).collect()} == {"/bin/x", "./b"}
