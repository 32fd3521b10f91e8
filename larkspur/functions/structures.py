"""Functions on JSON texts, paths and bodies that built-in functions cannot say; vectorised over Arrow batches."""

from __future__ import annotations

import datetime as dt
import difflib
import hashlib
import json
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col

#: Schema keys whose values are data, not wording.
DATA_KEYS = {"enum", "const", "default", "examples"}


def vectorised(returns: str) -> Callable:
    """A pandas UDF that is made where it is used, so importing this module needs no session."""

    def wrap(fn: Callable) -> Callable[..., Column]:
        def on(*columns: Column | str) -> Column:
            return F.pandas_udf(fn, returns)(*columns)

        on.__doc__ = fn.__doc__
        return on

    return wrap


def visible(text: str) -> str:
    """Control, format and separator characters (but tabs) as \\uXXXX."""
    return "".join(f"\\u{ord(c):04x}" if c != "\t" and unicodedata.category(c) in {"Cc", "Cf", "Zl", "Zp"} else c for c in text)


@vectorised("string")
def printable(text: pd.Series) -> pd.Series:
    return text.map(visible, na_action="ignore")


@vectorised("int")
def diff_lines(a: pd.Series, b: pd.Series) -> pd.Series:
    """Lines of the unified diff of two bodies."""
    return pd.Series([len(list(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines()))) for x, y in zip(a, b, strict=True)], dtype="int32")


def wording(schema: object) -> list[str]:
    """Property names, titles and descriptions of a JSON schema, keys in order at every level."""
    if isinstance(schema, list):
        return [w for item in schema for w in wording(item)]
    out: list[str] = []
    for key, value in sorted(schema.items()) if isinstance(schema, dict) else ():
        if key in DATA_KEYS:
            continue
        if key in ("title", "description") and isinstance(value, str):
            out.append(value)
        elif key == "properties" and isinstance(value, dict):
            for name, inner in sorted(value.items()):
                out += [name, *wording(inner)]
        else:
            out += wording(value)
    return out


def _json(text: str | None):  # noqa: ANN202
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


@vectorised("array<string>")
def schema_strings(text: pd.Series) -> pd.Series:
    return text.map(lambda t: wording(_json(t)))


@vectorised("string")
def canonical_json(text: pd.Series) -> pd.Series:
    """Keys sorted at every level, compact, without a runtime_hash at the top; null where there is no object."""

    def one(t: str | None) -> str | None:
        data = _json(t)
        if not isinstance(data, dict):
            return None
        return json.dumps({k: v for k, v in data.items() if k != "runtime_hash"}, ensure_ascii=False, separators=(",", ":"), sort_keys=True)

    return text.map(one)


@vectorised("boolean")
def any_angle_bracket(text: pd.Series) -> pd.Series:
    """Whether any string value anywhere in a JSON text holds < or >."""

    def held(node: object) -> bool:
        if isinstance(node, str):
            return "<" in node or ">" in node
        return any(map(held, node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()))

    return text.map(lambda t: held(_json(t)))


def tree_digest(files: list[tuple[str, bytes]]) -> str:
    """sha256 over paths and contents of (path, content), in order of path parts, some folders left out."""
    h = hashlib.sha256()
    for rel, content in sorted(files, key=lambda x: x[0].split("/")):
        if not {".git", "node_modules"} & set(rel.split("/")[:-1]):
            h.update(rel.encode() + content)
    return h.hexdigest()


def tree_hash(files: DataFrame) -> DataFrame:
    """id, tree_hash of files (id, relpath, content): sha256 over paths and contents in order of path parts."""

    def digest(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [(rel, bytes(content)) for rel, content in zip(pdf.relpath, pdf.content, strict=True)]
        return pd.DataFrame({"id": [pdf.id.iloc[0]], "tree_hash": [tree_digest(own)]})

    return files.select("id", "relpath", "content").groupBy("id").applyInPandas(digest, "id string, tree_hash string")


def since(spec: str, now: dt.datetime) -> dt.datetime:
    """A cutoff from Nd or an ISO date; ValueError for anything else."""
    days = re.fullmatch(r"(\d+)d", spec)
    return now - dt.timedelta(days=int(days[1])) if days else dt.datetime.combine(dt.date.fromisoformat(spec), dt.time(), dt.timezone.utc)


def folder_name(path: Column | str) -> Column:
    """A working folder as one client names its trace folders."""
    return F.regexp_replace(col(path), "[/.]", "-")


def portable_path(path: Column | str, project: str, home: str) -> Column:
    c = col(path)
    below = lambda top: c.startswith(top.rstrip("/") + "/")
    rest = lambda top: F.substring(c, len(top.rstrip("/")) + 2, 1 << 30)
    return F.when(below(project), F.concat(F.lit("./"), rest(project))).when(below(home), F.concat(F.lit("~/"), rest(home))).otherwise(c)


def baseline_key(name: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", name, path).cast("binary"), 256)


def repository(source: Column | str) -> Column:
    """owner/repo of a source string, or null."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(col(source)), r"^(https://github\.com/)?(github\.com/)?(github:)?", ""), r"\.git$", ""), "@.*$", "")
    found = F.regexp_extract(bare, r"^([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)(/.*)?$", 1)
    return F.when(found != "", found)


def selector_name(name: Column | str) -> Column:
    """Lower case, other characters one hyphen, never empty."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(name))), r"[^a-z0-9._-]", "-"), r"-+", "-"), r"^[-_.]+|[-_.]+$", "")
    return F.when(clean == "", "skill").otherwise(clean)


def machine_local(value: Column) -> Column:
    """Whether a value is a path of this machine (POSIX or Windows)."""
    return value.rlike(r"^(/|~|\./|\.\./|[A-Za-z]:[\\/]|\\\\)")


def portability_notes(servers: DataFrame) -> DataFrame:
    """name, value of commands and arguments that only resolve here."""
    each = F.explode(F.array_compact(F.concat(F.array(F.nullif("command", F.lit(""))), "args")))
    return servers.select("name", each.alias("value")).where(machine_local(F.col("value")))


def verified(directory_hash: Column, expected_directory: Column, skill_hash: Column, expected: Column) -> Column:
    """ok by directory, legacy_ok by the skill file alone where no directory hash was recorded, else mismatch."""
    return F.when(expected_directory.isNotNull() & (expected_directory != ""), F.when(directory_hash == expected_directory, "ok").otherwise("mismatch")).when(skill_hash == expected, "legacy_ok").otherwise("mismatch")


def metadata_problem(text: Column | str) -> Column:
    """The first thing wrong with a published server entry (JSON text), or null."""

    @F.pandas_udf("string")
    def first(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            m = _json(t)
            if not isinstance(m, dict):
                return "metadata is not an object"
            if m.get("transport") not in ("stdio", "http"):
                return "unknown transport"
            for key in ("command", "url", "server_name"):
                if m.get(key) is not None and not isinstance(m[key], str):
                    return f"{key} is not a string"
            for key in ("args", "env_names"):
                if not (isinstance(m.get(key) or [], list) and all(isinstance(v, str) for v in m.get(key) or [])):
                    return f"{key} is not a list of strings"
            needed = {"stdio": "command", "http": "url"}[m["transport"]]
            return None if m.get(needed) else f"{m['transport']} entry has no {needed}"

        return texts.map(one)

    return first(col(text))


def age_labels(copies: DataFrame) -> DataFrame:
    """name, id, label of copies (name, id, mtime): newest and older, or copy where all times are equal."""
    from pyspark.sql import Window

    w = Window.partitionBy("name")
    tied = F.min("mtime").over(w) == F.max("mtime").over(w)
    first = F.row_number().over(w.orderBy(F.col("mtime").desc(), "id")) == 1
    return copies.select("name", "id", F.when(tied, "copy").when(first, "newest").otherwise("older").alias("label"))
