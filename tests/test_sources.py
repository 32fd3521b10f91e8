"""Readers over real trees and traces, archives, streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from larkspur.operators import linescan as L
from larkspur.operators import resolution as R
from larkspur.operators import servers as S
from larkspur.sources import archives, configs, harnesses, sinks, traces, trees
from larkspur.streaming import ingest


def put(root, path, text):
    p = root / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    return str(p)


SKILL = "---\nname: {name}\ndescription: {about}\n---\nBody of {name}\n"


@pytest.fixture
def world(tmp_path):
    project, home = tmp_path / "project", tmp_path / "home"
    put(project, ".claude/skills/one/SKILL.md", SKILL.format(name="one", about="Use when converting"))
    put(project, ".claude/skills/one/.env", "A=1")
    put(project, ".claude/skills/one/run.sh", "#!/bin/sh\ncurl https://x\n")
    put(home, ".claude/skills/other/SKILL.md", SKILL.format(name="one", about="Another text"))
    put(home, ".claude/skills/.system/sys/SKILL.md", "---\nname: [broken\n---\nx")
    put(project, ".claude/commands/go.md", "Run !`ls -la`")
    os.symlink(home / ".claude/skills/other", project / ".claude/skills/linked")
    os.symlink(tmp_path / "nowhere", project / ".claude/skills/dead")
    return str(project), str(home)


def test_tree_to_findings(spark, world):
    project, home = world
    found = trees.discover(spark, project, home, [h for h in harnesses.HARNESSES if h["id"] == "claude-code"])
    rows = {r.path.split("/")[-2] + "/" + r.path.split("/")[-1]: r for r in found.collect()}
    assert rows["linked/SKILL.md"].via_symlink and rows["go.md" if "go.md" in rows else "commands/go.md"].ord == 1000
    skills = trees.contributors(found).cache()
    by_name = {(r.name, r.scope, r.system, r.frontmatter_valid) for r in skills.collect()}
    assert by_name == {("one", "project", False, True), ("sys", "user", True, False), ("go", "project", False, True)} | {("one", "project", False, True)}
    assert [r.path.endswith("dead") for r in trees.broken_links(spark, "claude-code", [project + "/.claude/skills"]).collect()] == [True]
    bundled = trees.bundled_files(skills.where("is_skill_md"))
    assert sorted(r.relpath for r in bundled.collect()) == [".env", "run.sh"]
    lines = L.source_lines(trees.scan_texts(skills, bundled))
    assert [r.contributor_names for r in L.injection_egress(lines).collect()] == [["one"]]
    marked = R.mark_shadows(trees.loads(found, skills), harnesses.harness_table(spark))
    assert marked.where("shadowed_by is not null").count() == 1  # the linked copy comes first by path
    assert [r.command for r in L.commands(skills.select("id", "name", F.lit("x").alias("relpath"), "text")).collect()] == ["ls -la"]


def test_content_hash_ignores_provenance_and_line_ends():
    a = "---\nname: x\nsource: a/b\n---\nbody\r\n"
    assert trees.normalised(a) == trees.normalised("---\nsource: c/d\nref: v1\nname: x\n---\nbody\n")
    assert trees.normalised("no front\r\n") == "no front\n"


def test_server_configs_of_each_format(spark, tmp_path):
    specs = [
        (put(tmp_path, "a.json", '// note\n{"mcpServers": {"a": {"command": "npx"}}}'), "mcp-json", "h", "project"), (put(tmp_path, "b.json", '{"servers": {"b": {"url": "http://x"}}}'), "vscode-json", "h", "user"),
        (put(tmp_path, "c.json", '{"mcpServers": {"c": {"command": "c"}}, "projects": {"/p": {"mcpServers": {"d": {"command": "d"}}}}}'), "claude-user-json", "h", "user"), (put(tmp_path, "d.toml", '[mcp_servers.e]\ncommand = "e"\n[mcp_servers.e.env]\nMY_TOKEN = "abc"\n'), "codex-toml", "k", "user"), (put(tmp_path, "e.json", "{"), "mcp-json", "h", "user"),
    ]
    raw = configs.server_configs(spark, specs, "/p")
    got = {(r.name, r.scope, r.in_project, tuple(r.suspect_env)) for r in S.parse_servers(raw).collect()}
    assert got == {("a", "project", True, ()), ("b", "user", False, ()), ("c", "user", False, ()), ("d", "project", False, ()), ("e", "user", False, ("MY_TOKEN",))}
    assert [r.path.endswith("e.json") for r in S.config_errors(raw).collect()] == [True]


def test_plugin_stores(tmp_path):
    home = tmp_path / "h"
    put(home, ".claude/plugins/installed_plugins.json", json.dumps({"plugins": {"p@m": [{"installPath": "/x", "scope": "user", "version": 1}, {"installPath": "/y", "scope": "local", "projectPath": "/elsewhere"}], "@m": [{"installPath": "/z", "scope": "user"}]}}))
    put(home, ".claude/settings.json", '{"enabledPlugins": {"p@m": false}}')
    put(home, ".gemini/extensions/g/gemini-extension.json", '{"name": "g", "version": "1"}')
    put(home, ".gemini/extensions/extension-enablement.json", json.dumps({"g": {"overrides": ["!/*", f"/{str(tmp_path).strip('/')}/*"]}}))
    put(home, ".codex/config.toml", '[plugins."c@m"]\nenabled = true\n')
    for v in ("1.9.0", "1.10.0"):
        put(home, f".codex/plugins/cache/m/c/{v}/plugin.json", "{}")
    got = {(p["harness"], p["name"], p["version"], p["enabled"]) for p in configs.installed_plugins(str(home), str(tmp_path))}
    assert got == {("claude-code", "p", "1", False), ("gemini-cli", "g", "1", True), ("codex", "c", "1.10.0", True)}


def files(spark, rows):
    return spark.createDataFrame([(p, "\n".join(json.dumps(x) if isinstance(x, dict) else x for x in lines)) for p, lines in rows], "path string, text string")


TS = "2026-01-02T03:04:05Z"


def test_claude_traces(spark):
    rows = [("/t/p/s1.jsonl", [
        {"type": "user", "sessionId": "S", "cwd": "/w", "timestamp": TS, "message": {"content": "please convert"}}, "not json", {"type": "user", "timestamp": TS, "isMeta": True, "message": {"content": "meta"}},
        {"type": "assistant", "sessionId": "S", "timestamp": TS, "message": {"content": [{"type": "thinking", "thinking": "hmm"}, {"type": "tool_use", "name": "Skill", "input": {"skill": "conv"}}, {"type": "tool_use", "name": "mcp__srv__do__it", "input": {}}]}},
        {"type": "assistant", "timestamp": "bad", "message": {"content": [{"type": "tool_use", "name": "Skill", "input": {"skill": "lost"}}]}},
        {"type": "user", "timestamp": TS, "message": {"content": [{"type": "text", "text": "<command-name>/deploy</command-name> <command-name>clear</command-name>"}]}},
    ])]
    got = {(r.kind, r.name, r.server, r.query, r.reasoning, r.detection, r.source_line, r.session_id) for r in traces.claude_code(files(spark, rows)).collect()}
    mark = "<command-name>/deploy</command-name> <command-name>clear</command-name>"
    assert got == {("skill", "conv", None, "please convert", "hmm", "explicit", 4, "S"), ("mcp_tool", "do__it", "srv", "please convert", "hmm", "explicit", 4, "S"), ("skill", "deploy", None, mark, None, "command-marker", 6, "s1")}


def test_codex_and_pi_traces(spark):
    codex = [("/r/rollout-1.jsonl", [
        {"type": "session_meta", "payload": {"id": "C", "cwd": "/w", "source": {"subagent": 1}}}, {"type": "event_msg", "timestamp": TS, "payload": {"type": "user_message", "message": "hi"}},
        {"type": "event_msg", "timestamp": TS, "payload": {"type": "mcp_tool_call_end", "invocation": {"server": "s", "tool": "t"}}}, {"type": "response_item", "timestamp": TS, "payload": {"type": "function_call", "arguments": "cat a/one/SKILL.md b/one/SKILL.md c/two/SKILL.md"}},
    ])]
    got = {(r.kind, r.name, r.server, r.query, r.sidechain, r.session_id, r.project) for r in traces.codex(files(spark, codex)).collect()}
    assert got == {("mcp_tool", "t", "s", "hi", True, "C", "/w"), ("skill", "one", None, "hi", True, "C", "/w"), ("skill", "two", None, "hi", True, "C", "/w")}
    pi = [("/p/x.jsonl", [
        {"type": "session", "id": "P", "cwd": "/w"}, {"type": "message", "timestamp": TS, "message": {"role": "user", "content": [{"type": "text", "text": "q"}]}},
        {"type": "message", "timestamp": TS, "message": {"role": "assistant", "content": [{"type": "toolCall", "name": "read", "arguments": {"path": "/k/one/SKILL.md"}}, {"type": "toolCall", "name": "mcp__s__t"}]}},
    ])]
    assert {(r.kind, r.name, r.server, r.query, r.session_id) for r in traces.pi(files(spark, pi)).collect()} == {("skill", "one", None, "q", "P"), ("mcp_tool", "t", "s", "q", "P")}


def test_copilot_traces(spark):
    body = {"sessionId": "V", "creationDate": 1700000000000, "requests": [{"message": {"text": "q"}, "response": [{"kind": "toolInvocationSerialized", "toolId": "mcp_srv_do_it"}, {"kind": "toolInvocationSerialized", "toolId": "skill", "toolSpecificData": "sk"}, {"kind": "text"}]}]}
    one = spark.createDataFrame([("/ws/h1/chatSessions/a.json", json.dumps(body))], "path string, text string")
    ws = spark.createDataFrame([("/ws/h1/workspace.json", '{"folder": "file:///home/me/my%20proj"}')], "path string, text string")
    got = {(r.kind, r.name, r.server, r.project, str(r.ts)) for r in traces.copilot(one, ws).collect()}
    assert got == {("mcp_tool", "do_it", "srv", "/home/me/my proj", "2023-11-14 22:13:20"), ("skill", "sk", None, "/home/me/my proj", "2023-11-14 22:13:20")}


def test_cache_misses(spark):
    now = spark.createDataFrame([("a", 1, 2), ("b", 1, 2), ("c", 1, 3)], "path string, mtime long, size long")
    cache = spark.createDataFrame([("a", 1, 2, 1), ("b", 1, 2, 0), ("c", 1, 2, 1)], "path string, mtime long, size long, adapter_version int")
    assert sorted(r.path for r in traces.stale(now, cache, 1).collect()) == ["b", "c"]


def test_archives(spark, tmp_path):
    data = archives.pack({"b/x": b"1", "a": b"2"})
    assert data == archives.pack({"a": b"2", "b/x": b"1"}) and archives.unpack(data) == [("a", b"2"), ("b/x", b"1")]
    assert [archives.safe_path(p) for p in ("a/b", "/a", "a/../b", "a//b", "x" * 300, "")] == [True, False, False, False, False, False]
    frame = spark.createDataFrame([("good", bytearray(data)), ("bad", bytearray(b"nope"))], "path string, content binary")
    assert sorted((r.archive, r.path) for r in archives.expand(frame).collect() if not r.error) == [("good", "a"), ("good", "b/x")]


def test_lockfile_and_pins(spark):
    texts = spark.createDataFrame([('{"skills": {"a": {"source": "o/r", "computedHash": "sha256:ff"}, "b": {}}}',)], "text string")
    assert sorted((r.name, r.expected) for r in configs.lockfile(texts).collect()) == [("a", "ff"), ("b", None)]
    home, project = (spark.createDataFrame([("p", s)], "path string, loadout string") for s in ("home", "project"))
    assert [r.loadout for r in configs.pins(spark, home, project).collect()] == ["project"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, sinks.merged(rows, rows.where("k = 'a'").withColumn("v", F.lit(9)), ["k"]).collect())) == [("a", 9), ("b", 2)]


def test_streams(spark, tmp_path):
    put(tmp_path, "in/p/s.jsonl", json.dumps({"type": "assistant", "timestamp": TS, "message": {"content": [{"type": "tool_use", "name": "Skill", "input": {"skill": "x"}}]}}))
    stream = ingest.trace_stream(spark, str(tmp_path / "in"))
    ingest.ingest_traces(stream, traces.claude_code, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [r.name for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["x"]
    folder = tmp_path / "ev"
    schema = "client_event_id string, fingerprint string, action string, server_sequence bigint"
    spark.createDataFrame([("1", "f", "acknowledged", 5), ("1", "f", "acknowledged", 5), ("2", "g", "acknowledged", 1)], schema).write.parquet(str(folder))
    query = ingest.fold_acks(ingest.deduplicated(spark.readStream.schema(schema).parquet(str(folder))), str(tmp_path / "st"), str(tmp_path / "ck2"))
    query.processAllAvailable()
    spark.createDataFrame([("3", "f", "reopened", 4), ("4", "g", "reopened", 2)], schema).write.mode("append").parquet(str(folder))
    query.processAllAvailable()
    query.stop()
    last = max(p.name for p in (tmp_path / "st").iterdir() if p.name.startswith("v="))
    assert sorted((r.fingerprint, r.action) for r in spark.read.parquet(str(tmp_path / "st" / last)).collect()) == [("f", "acknowledged"), ("g", "reopened")]
