"""Session traces as invocation rows. files: path, text (one row for each file); adapters are plans over JSON variants.

Lines end at line feeds only. An event without a readable time neither counts as a use nor as the last question.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators.findings import union_all
from larkspur.operators.manifests import kind

COLUMNS = ["harness", "session_id", "project", "ts", "kind", "name", "server", "query", "reasoning", "sidechain", "detection", "source_file", "source_line"]
PATTERNS = {"claude-code": ".claude/projects/*/*.jsonl", "codex": ".codex/sessions/*/*/*/rollout-*.jsonl", "pi": ".pi/agent/sessions/*/*.jsonl", "copilot": "*/chatSessions/*.json"}
# Commands of the client itself, which are no skills.
BUILTIN = """clear help compact config cost doctor exit login logout memory model quit resume status init bug release-notes
terminal-setup vim permissions hooks mcp agents todos add-dir context export rewind usage""".split()
SKILL_FILE = r"([A-Za-z0-9._-]+)/SKILL\.md"


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def stem() -> Column:
    return F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)


def at(path: str, of: str = "e") -> Column:
    return F.expr(f"variant_get({of}, '{path}', 'variant')")


def text_at(path: str, of: str = "e") -> Column:
    return F.when(kind(at(path, of)) == "string", F.expr(f"try_variant_get({of}, '{path}', 'string')"))


def list_at(path: str, of: str = "e") -> Column:
    return F.when(kind(at(path, of)) == "array", F.expr(f"try_variant_get({of}, '{path}', 'array<variant>')"))


def moment(value: Column) -> Column:
    return F.try_to_timestamp(value)


def events(files: DataFrame) -> DataFrame:
    """path, line, e: the JSON objects of each line."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    return lines.select("path", (F.col("line") + 1).alias("line"), F.expr("try_parse_json(raw)").alias("e")).where(kind(F.col("e")) == "object")


def carried(value: Column, *order: str) -> Column:
    return F.last(value, ignorenulls=True).over(Window.partitionBy("path").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def texts_of(blocks: Column) -> Column:
    own = F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "text")
    return F.transform(own, lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")))


def _rows(df: DataFrame, harness: str, **columns: Column) -> DataFrame:
    base = {"harness": F.lit(harness), "source_file": F.col("path"), "source_line": F.col("line"), "server": F.lit(None).cast("string"), "reasoning": F.lit(None).cast("string"), "sidechain": F.lit(False), "detection": F.lit("explicit")}
    both = base | columns
    return df.select(*[both[c].alias(c) if c in both else F.col(c) for c in COLUMNS])


def _tool(name: Column) -> tuple[Column, Column, Column]:
    """Whether mcp__server__tool, its server, its tool."""
    parts = F.split(name, "__")
    return name.startswith("mcp__") & (F.size(parts) >= 3), parts[1], F.array_join(F.slice(parts, 3, 1000), "__")


def claude_code(files: DataFrame) -> DataFrame:
    content = F.when((text_at("$.type") == "user") & (kind(at("$.message.content")) == "string"), F.expr("array(parse_json('{\"type\": \"text\", \"text\": ' || to_json(variant_get(e, '$.message.content', 'variant')) || '}'))")).otherwise(list_at("$.message.content"))
    flag = lambda p: F.coalesce(F.expr(f"try_variant_get(e, '{p}', 'boolean')"), F.lit(False))
    ev = events(files).where(text_at("$.type").isin("user", "assistant")).withColumn("blocks", content).where("blocks is not null")
    ev = ev.select("path", "line", text_at("$.type").alias("type"), "blocks", F.coalesce(text_at("$.sessionId"), stem()).alias("session_id"), text_at("$.cwd").alias("project"), moment(text_at("$.timestamp")).alias("ts"), flag("$.isSidechain").alias("sidechain"), flag("$.isMeta").alias("meta")).where("ts is not null")
    said = texts_of(F.col("blocks"))
    asked = F.when((F.col("type") == "user") & ~F.col("sidechain") & ~F.col("meta"), F.get(said, F.lit(0)))
    ev = ev.withColumn("query", carried(asked, "line"))
    marks = F.flatten(F.transform(said, lambda t: F.regexp_extract_all(t, F.lit(r"<command-name>/?([^<\s]+)</command-name>"), F.lit(1))))
    typed = ev.where("type = 'user'").withColumn("name", F.explode(marks)).where(~F.col("name").isin(BUILTIN))
    slash = _rows(typed, "claude-code", kind=F.lit("skill"), sidechain=F.col("sidechain"), detection=F.lit("command-marker"))
    used = ev.where("type = 'assistant'").select("*", F.posexplode("blocks").alias("pos", "b"))
    thought = F.when((text_at("$.type", "b") == "thinking") & (F.trim(text_at("$.thinking", "b")) != ""), text_at("$.thinking", "b"))
    used = used.withColumn("reasoning", T.one_line(carried(thought, "line", "pos"), 200)).withColumn("tool", text_at("$.name", "b")).where(text_at("$.type", "b") == "tool_use")
    skill = used.withColumn("name", F.expr("try_variant_get(b, '$.input.skill', 'string')")).where("tool = 'Skill' and name <> ''")
    is_tool, server, name = _tool(F.col("tool"))
    return union_all([slash, _rows(skill, "claude-code", kind=F.lit("skill"), sidechain=F.col("sidechain"), reasoning=F.col("reasoning")), _rows(used.where(is_tool), "claude-code", kind=F.lit("mcp_tool"), name=name, server=server, sidechain=F.col("sidechain"), reasoning=F.col("reasoning"))])


def codex(files: DataFrame) -> DataFrame:
    ev = events(files).select("*", text_at("$.type").alias("type"), text_at("$.payload.type").alias("ptype"), moment(text_at("$.timestamp")).alias("ts")).where(F.coalesce(kind(at("$.payload")), F.lit("object")) == "object")
    meta = F.col("type") == "session_meta"
    side = (text_at("$.payload.thread_source") == "subagent") | F.coalesce(at("$.payload.source.subagent").isNotNull(), F.lit(False))
    identity = F.coalesce(F.expr("try_variant_get(e, '$.payload.id', 'string')"), F.expr("try_variant_get(e, '$.payload.session_id', 'string')"))
    ev = ev.select("*", F.coalesce(carried(F.when(meta, identity), "line"), stem()).alias("session_id"), carried(F.when(meta, text_at("$.payload.cwd")), "line").alias("project"), F.coalesce(carried(F.when(meta, F.coalesce(side, F.lit(False))), "line"), F.lit(False)).alias("side"))
    ev = ev.where("ts is not null and type <> 'session_meta'").withColumn("query", carried(F.when((F.col("type") == "event_msg") & (F.col("ptype") == "user_message"), text_at("$.payload.message")), "line"))
    ends = ev.where("type = 'event_msg' and ptype = 'mcp_tool_call_end'").select("*", text_at("$.payload.invocation.server").alias("server"), text_at("$.payload.invocation.tool").alias("name")).where("server is not null and name is not null")
    call = F.when(F.col("ptype") == "function_call", text_at("$.payload.arguments")).when(F.col("ptype") == "custom_tool_call", text_at("$.payload.input"))
    read = ev.where("type = 'response_item'").withColumn("name", F.explode(F.array_distinct(F.regexp_extract_all(call, F.lit(SKILL_FILE), F.lit(1)))))
    return _rows(ends, "codex", kind=F.lit("mcp_tool"), server=F.col("server"), sidechain=F.col("side")).unionByName(_rows(read, "codex", kind=F.lit("skill"), sidechain=F.col("side"), detection=F.lit("skill-read")))


def pi(files: DataFrame) -> DataFrame:
    ev = events(files).select("*", text_at("$.type").alias("type"), text_at("$.message.role").alias("role"), moment(text_at("$.timestamp")).alias("ts"))
    head = F.col("type") == "session"
    ev = ev.select("*", F.coalesce(carried(F.when(head, F.expr("try_variant_get(e, '$.id', 'string')")), "line"), stem()).alias("session_id"), carried(F.when(head, text_at("$.cwd")), "line").alias("project"))
    ev = ev.where("type = 'message' and role in ('user', 'assistant') and ts is not null").withColumn("blocks", list_at("$.message.content")).where("blocks is not null")
    ev = ev.withColumn("query", carried(F.when(F.col("role") == "user", F.get(texts_of(F.col("blocks")), F.lit(0))), "line"))
    used = ev.where("role = 'assistant'").select("*", F.posexplode("blocks").alias("pos", "b"))
    thought = F.when((text_at("$.type", "b") == "thinking") & (F.trim(text_at("$.thinking", "b")) != ""), text_at("$.thinking", "b"))
    used = used.withColumn("reasoning", T.one_line(carried(thought, "line", "pos"), 200)).withColumn("tool", text_at("$.name", "b")).where(text_at("$.type", "b") == "toolCall")
    is_tool, server, name = _tool(F.col("tool"))
    words = F.concat_ws(" ", F.coalesce(text_at("$.arguments.path", "b"), F.lit("")), F.coalesce(text_at("$.arguments.command", "b"), F.lit("")))
    read = used.where("tool in ('read', 'bash')").withColumn("name", F.explode(F.array_distinct(F.regexp_extract_all(words, F.lit(SKILL_FILE), F.lit(1)))))
    return _rows(used.where(is_tool), "pi", kind=F.lit("mcp_tool"), name=name, server=server, reasoning=F.col("reasoning")).unionByName(_rows(read, "pi", kind=F.lit("skill"), detection=F.lit("skill-read"), reasoning=F.col("reasoning")))


def copilot(files: DataFrame, workspaces: DataFrame) -> DataFrame:
    """workspaces: path, text of the workspace.json files two folders above."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]+/[^/]+$", 1)
    place = F.expr("try_variant_get(try_parse_json(text), '$.folder', 'string')")
    known = workspaces.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("ws"), F.when(place.startswith("file://"), F.url_decode(F.replace(F.regexp_replace(place, "^file://[^/]*", ""), F.lit("+"), F.lit("%2B")))).alias("project"))
    whole = files.select("path", folder.alias("ws"), F.expr("try_parse_json(text)").alias("e")).join(known, "ws", "left")
    epoch = lambda p, of: F.expr(f"timestamp_millis(cast(try_variant_get({of}, '{p}', 'double') as bigint))")
    asked = whole.select("path", "project", F.coalesce(F.expr("try_variant_get(e, '$.sessionId', 'string')"), stem()).alias("session_id"), epoch("$.creationDate", "e").alias("made"), F.explode(list_at("$.requests")).alias("r"))
    asked = asked.select("*", F.lit(None).cast("int").alias("line"), text_at("$.message.text", "r").alias("query"), F.coalesce(epoch("$.timestamp", "r"), F.col("made")).alias("ts")).where("ts is not null")
    parts = asked.withColumn("p", F.explode(list_at("$.response", "r"))).where(text_at("$.kind", "p") == "toolInvocationSerialized").withColumn("tool", text_at("$.toolId", "p"))
    cut = F.split("tool", "_", 3)
    tools = parts.where(F.col("tool").startswith("mcp_") & (F.size(cut) == 3)).select("*", cut[1].alias("server"), cut[2].alias("name")).where("server <> '' and name <> ''")
    skills = parts.where("tool = 'skill'").withColumn("name", text_at("$.toolSpecificData", "p")).where("name <> ''")
    return _rows(tools, "copilot", kind=F.lit("mcp_tool"), server=F.col("server")).unionByName(_rows(skills, "copilot", kind=F.lit("skill")))


#: Readers of one client's files; that of copilot also takes the workspaces two folders above.
ADAPTERS = {"claude-code": claude_code, "codex": codex, "pi": pi, "copilot": copilot}
VERSION = 1


def trace_files(home: str, globs: dict[str, str] | None = None) -> dict[str, list[str]]:
    """The files of each client below a home folder, in order."""
    return {harness: sorted(str(p) for p in Path(home).glob(pattern)) for harness, pattern in (PATTERNS if globs is None else globs).items()}


def infer_adapter(path: Column | str) -> Column:
    """Which client wrote a file, by where it lies."""
    c = T.col(path)
    return F.when(F.contains(c, F.lit("/.claude/projects/")), "claude-code").when(F.contains(c, F.lit("/.codex/sessions/")), "codex").when(F.contains(c, F.lit("/.pi/agent/sessions/")), "pi").when(F.contains(c, F.lit("/chatSessions/")), "copilot")


def invocations(spark: SparkSession, home: str, clients: list[str] | None = None) -> DataFrame:
    """Uses in all traces below a home folder."""
    found = {h: files for h, files in trace_files(home).items() if files and (clients is None or h in clients)}
    rows = []
    for harness, files in found.items():
        read = read_files(spark, files)
        if harness == "copilot":
            places = sorted({str(Path(f).parent.parent / "workspace.json") for f in files if (Path(f).parent.parent / "workspace.json").is_file()})
            empty = spark.createDataFrame([], "path string, text string")
            rows.append(copilot(read, read_files(spark, places) if places else empty))
        else:
            rows.append(ADAPTERS[harness](read))
    if rows:
        return union_all(rows)
    return spark.createDataFrame([], "harness string, session_id string, project string, ts timestamp, kind string, name string, server string, query string, reasoning string, sidechain boolean, detection string, source_file string, source_line int")


def stale(files: DataFrame, cache: DataFrame, version: int) -> DataFrame:
    """Files (path, mtime, size) whose cached extract is missing or of another time, size or adapter version."""
    return files.join(cache.where(F.col("adapter_version") == version).select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")


def unrecognised(files: DataFrame) -> DataFrame:
    """harness, n: non-empty files none of whose events were recognised (harness, size, recognized)."""
    return files.groupBy("harness").agg(F.count_if((F.col("recognized") == 0) & (F.col("size") > 0)).alias("n"))
