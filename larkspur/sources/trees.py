"""Skill trees: a walk lists the files (Spark's own listing hides dot folders, and most skills live in some), workers read them."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions.structures import tree_digest
from larkspur.session import prepare

from .harnesses import detected, specs_at

SNIFF, SCAN_CAP = 8192, 1 << 20
PROVENANCE = {"source", "ref", "tree_sha"}
INSTANCE = "harness string, scope string, kind string, ord int, path string, real string, via_symlink boolean, plugin string"

def walk(base: str) -> Iterator[str]:
    """Files below base in order, links followed, each real folder once."""
    seen: set[str] = set()

    def below(folder: str) -> Iterator[str]:
        real = os.path.realpath(folder)
        if real in seen:
            return
        seen.add(real)
        for name in sorted(os.listdir(folder)):
            path = os.path.join(folder, name)
            if os.path.isdir(path):
                yield from below(path)
            elif os.path.isfile(path):
                yield path

    if os.path.isdir(base):
        yield from below(base)


def skill_files(base: str, recursive: bool = True, root_md: bool = False) -> list[str]:
    depth = base.rstrip("/").count("/") + 2
    found = [p for p in walk(base) if p.endswith("/SKILL.md") and (recursive or p.count("/") == depth)]
    if root_md and os.path.isdir(base):
        found += [os.path.join(base, n) for n in sorted(os.listdir(base)) if n.endswith(".md") and n != "SKILL.md" and os.path.isfile(os.path.join(base, n))]
    return found


def command_files(base: str) -> list[str]:
    return [p for p in walk(base) if p.endswith(".md")]


def is_linked(path: str) -> bool:
    """Whether the path or any folder above it is a link."""
    return any(p.is_symlink() for p in [Path(path), *Path(path).parents])


def broken_links(spark: SparkSession, harness: str, bases: list[str]) -> DataFrame:
    rows = [(harness, os.path.join(d, n)) for b in bases if os.path.isdir(b) for d, dirs, names in os.walk(b) for n in sorted([*dirs, *names]) if os.path.islink(os.path.join(d, n)) and not os.path.exists(os.path.join(d, n))]
    return spark.createDataFrame(rows, "harness string, path string")


def discover(spark: SparkSession, project: str, home: str, harnesses: list[dict] | None = None, plugins: list[dict] | None = None, global_only: bool = False) -> DataFrame:
    """Every instance of a skill or command: native roots in order of precedence, commands from 1000, plugin roots last.

    harnesses: those to look for; without them, the ones whose markers exist.
    """
    rows = []
    for h in detected(project, home, global_only) if harnesses is None else harnesses:
        own = [] if global_only else [(s, "project") for s in h["project"]]
        user = [(s, "user") for s in h["user"]]
        roots = user + own if h["order"] == "global-first" else own + user
        for k, (spec, scope) in enumerate(roots):
            rows += [(h["id"], scope, "skill", k, p, None) for p in skill_files(specs_at(spec, project, home), h["recursive"], spec in h["root_md"])]
        for k, (spec, scope) in enumerate([*([] if global_only else [(s, "project") for s in h["commands"]]), *((s, "user") for s in h["user_commands"])]):
            rows += [(h["id"], scope, "command", 1000 + k, p, None) for p in command_files(specs_at(spec, project, home))]
        for k, p in enumerate(x for x in plugins or [] if x["harness"] == h["id"] and x["enabled"]):
            rows += [(h["id"], p["scope"], "skill", len(roots) + k, f, p["name"]) for r in p["skills_roots"] for f in skill_files(r, p["recursive"])]
    full = [(a, b, c, k, p, os.path.realpath(p), is_linked(p), plugin) for a, b, c, k, p, plugin in rows]
    return prepare(spark).createDataFrame(full, INSTANCE)


def split_frontmatter(text: str) -> tuple[dict | None, str]:
    """Front matter (None if it is no mapping, {} if there is none) and body."""
    import yaml

    end = text.find("\n---", 4) if text.startswith("---\n") else -1
    if end < 0:
        return {}, text
    try:
        data = yaml.safe_load(text[4:end])
    except yaml.YAMLError:
        data = None
    return (data if isinstance(data, dict) else None), text[end + 4 :].lstrip("\n")


def normalised(text: str) -> str:
    """What a content hash covers: line ends unified, keys sorted, provenance keys left out."""
    import yaml

    text = text.replace("\r\n", "\n").replace("\r", "\n")
    front, body = split_frontmatter(text)
    if not front:
        return text
    return yaml.safe_dump({k: v for k, v in front.items() if k not in PROVENANCE}, sort_keys=True) + "\n---\n" + body


SKILL = "id string, text string, name string, routing_text string, body string, frontmatter string, frontmatter_valid boolean, content_hash string, source_kind string, source string, source_ref string"


def read_skills(paths: DataFrame) -> DataFrame:
    """Skill rows of paths (id: real path); unreadable ones have a null text."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["id"]:
                try:
                    text = Path(path).read_text(encoding="utf-8", errors="replace")
                except OSError:
                    rows.append((path, *[None] * 10))
                    continue
                front, body = split_frontmatter(text)
                own = front or {}
                name = own["name"].strip() if isinstance(own.get("name"), str) and own["name"].strip() else (Path(path).parent.name if Path(path).name == "SKILL.md" else Path(path).stem)
                tracked = bool(PROVENANCE & own.keys())
                linked = any(p.name == "skills" and p.parent.name == ".agents" for p in [Path(path), *Path(path).parents])
                text_of = lambda v: v if isinstance(v, str) else None
                rows.append((path, text, name, text_of(own.get("description")) or "", body, json.dumps(own, default=str, ensure_ascii=False), front is not None, "sha256:" + hashlib.sha256(normalised(text).encode()).hexdigest(), "gh-skill" if tracked else "linked" if linked else "unmanaged", text_of(own.get("source")) if tracked else None, text_of(own.get("ref")) if tracked else None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SKILL.split(", ")])

    return paths.select("id").distinct().mapInPandas(read, SKILL)


def contributors(instances: DataFrame) -> DataFrame:
    """One row for each real file: what it says, its scope, tokens, plugin and whether it is the system's."""
    paths = instances.groupBy(F.col("real").alias("id")).agg(F.min("kind").alias("kind"), F.max((F.col("scope") == "project").cast("int")).alias("p"), F.max(F.col("path").rlike(r"(^|/)\.system(/|$)")).alias("system"), F.first("plugin", ignorenulls=True).alias("suite"))
    read = read_skills(paths.select("id")).where("text is not null")
    joined = read.join(paths, "id")
    kind = F.when((F.col("source_kind") == "unmanaged") & F.col("suite").isNotNull(), "plugin").otherwise(F.col("source_kind"))
    line = F.concat("name", F.lit(": "), "routing_text")
    return joined.select("*", F.when(F.col("p") == 1, "project").otherwise("user").alias("scope"), kind.alias("provenance"), T.approximate_tokens(line).alias("catalog_tokens"), T.approximate_tokens("body").alias("body_tokens"), F.col("id").endswith("/SKILL.md").alias("is_skill_md"), F.element_at(F.split("id", "/"), -2).alias("folder")).drop("p")


def bundled_files(skills: DataFrame) -> DataFrame:
    """id, relpath, size, content_hash, is_text, oversize, text of every other file of skills (id); walked and read where
    the workers are, a folder each."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own in batch["id"]:
                out = []
                for path in (p for p in walk(os.path.dirname(own)) if p != own):
                    data = Path(path).read_bytes()
                    plain = b"\0" not in data[:SNIFF]
                    out.append((own, os.path.relpath(path, os.path.dirname(own)), len(data), "sha256:" + hashlib.sha256(data).hexdigest(), plain, len(data) > SCAN_CAP, data.decode("utf-8", "replace") if plain and len(data) <= SCAN_CAP else None))
                yield pd.DataFrame(out, columns=["id", "relpath", "size", "content_hash", "is_text", "oversize", "text"])

    return skills.select("id").distinct().mapInPandas(read, "id string, relpath string, size bigint, content_hash string, is_text boolean, oversize boolean, text string")


def tree_hashes(skills: DataFrame) -> DataFrame:
    """id, tree_hash of the folders of skills (id), as lockfiles record them."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tops = [os.path.dirname(own) for own in batch["id"]]
            yield pd.DataFrame({"id": batch["id"], "tree_hash": [tree_digest([(os.path.relpath(p, t), Path(p).read_bytes()) for p in walk(t)]) for t in tops]})

    return skills.select("id").distinct().mapInPandas(read, "id string, tree_hash string")


def unreadable(instances: DataFrame, skills: DataFrame) -> DataFrame:
    """harness, path of files that were found and could not be read."""
    return instances.join(skills.select(F.col("id").alias("real")), "real", "left_anti").select("harness", "path").distinct()


def scan_texts(skills: DataFrame, bundled: DataFrame) -> DataFrame:
    """id, name, relpath, kind, text of all that the line checks read."""
    first = skills.select("id", "name", F.element_at(F.split("id", "/"), -1).alias("relpath"), F.lit("skillmd").alias("kind"), "text")
    rest = bundled.where("is_text and not oversize").join(skills.select("id", "name"), "id").select("id", "name", "relpath", F.lit(None).cast("string").alias("kind"), "text")
    return first.unionByName(rest)


def loads(instances: DataFrame, rows: DataFrame) -> DataFrame:
    own = rows.select("id", "name", "content_hash", "catalog_tokens", "body_tokens", "system")
    return instances.withColumnRenamed("real", "id").join(own, "id").withColumn("plugin", F.col("plugin").isNotNull())
