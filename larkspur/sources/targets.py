"""What a path to lint is, and which folders and files that makes a scan read."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path

#: A published schema of server settings.
SERVER_SCHEMA = re.compile(r"agent-plugins\.org/schemas/[^/]+/mcp\.schema\.json$")
PLUGIN, CLIENT_PLUGIN, MARKETPLACE = "plugin.json", ".claude-plugin/plugin.json", ".claude-plugin/marketplace.json"


class NotLintable(ValueError):
    """The path is none of the things that can be linted."""


@dataclass(frozen=True)
class Target:
    kind: str  # plugin, skill, mcp or marketplace
    path: Path
    flavor: str | None = None
    both_manifests: bool = False


def _plugin(p: Path) -> Target | None:
    if p.is_dir() and (p / PLUGIN).is_file():
        return Target("plugin", p, "agent-plugins", (p / CLIENT_PLUGIN).is_file())
    return Target("plugin", p, "claude-code") if p.is_dir() and (p / CLIENT_PLUGIN).is_file() else None


def _skill(p: Path) -> Target | None:
    return Target("skill", p) if (p.is_file() and p.name == "SKILL.md") or (p.is_dir() and (p / "SKILL.md").is_file()) else None


def _marketplace(p: Path) -> Target | None:
    return Target("marketplace", p) if (p.is_file() and p.name == "marketplace.json") or (p.is_dir() and (p / MARKETPLACE).is_file()) else None


def _servers(p: Path) -> Target | None:
    if not p.is_file():
        return None
    try:
        data = json.loads(p.read_text(encoding="utf-8", errors="replace"))
    except (OSError, ValueError):
        data = None
    beside = (p.parent / PLUGIN).is_file()
    schema = data.get("$schema") if isinstance(data, dict) else None
    if (isinstance(schema, str) and SERVER_SCHEMA.search(schema)) or (beside and p.name == "mcp.json"):
        return Target("mcp", p, "agent-plugins")
    if isinstance(data, dict) and isinstance(data.get("mcpServers"), dict):
        return Target("mcp", p, "harness")
    return Target("mcp", p, "harness") if data is None and p.name in ("mcp.json", ".mcp.json") else None


KINDS = {"plugin": _plugin, "skill": _skill, "marketplace": _marketplace, "mcp": _servers}


def classify(path: str | Path, forced: str | None = None) -> Target:
    """The target at a path: plugins before skills before marketplaces; any other JSON or dot file may hold servers."""
    p = Path(path).expanduser()
    if not p.exists():
        raise NotLintable(f"{path} does not exist")
    if forced is None:
        jsonish = p.is_file() and (p.suffix == ".json" or p.name.startswith("."))
        found = next((t for k in ("plugin", "skill", "marketplace", *(["mcp"] if jsonish else [])) if (t := KINDS[k](p))), None)
    else:
        found = KINDS[forced](p)
    if found is None:
        raise NotLintable(f"{path} is no {forced or 'plugin, skill, marketplace or server settings'}")
    return found


def client_plugin_skills(root: Path, manifest: dict) -> list[Path]:
    """Skill files of a client's plugin: below skills/, below what the manifest declares besides, and at the root."""
    declared = manifest.get("skills")
    extra = [declared] if isinstance(declared, str) else declared if isinstance(declared, list) else []
    out = []
    for base in [root / "skills", *(root / e for e in extra if isinstance(e, str))]:
        if (base / "SKILL.md").is_file():
            out.append(base / "SKILL.md")
        elif base.is_dir():
            out += [c / "SKILL.md" for c in sorted(base.iterdir()) if (c / "SKILL.md").is_file()]
    return [*out, root / "SKILL.md"] if (root / "SKILL.md").is_file() else out


def config_root(start: str | Path, ledger: str) -> Path:
    """The nearest folder at or above `start` that holds the ledger; else the folder of `start`."""
    p = Path(start)
    here = (p if p.is_dir() else p.parent).resolve()
    return next((d for d in [here, *here.parents] if (d / ledger).is_file()), here)


def plugin_listing(root: Path) -> list[tuple[str, str, bool, bool, str]]:
    """root, relpath, is_dir, is_symlink, resolved of everything below a plugin, for the manifest rules."""
    out = []
    for p in sorted(root.rglob("*")):
        if ".git" not in p.relative_to(root).parts:
            out.append((str(root), p.relative_to(root).as_posix(), p.is_dir(), p.is_symlink(), str(p.resolve()) if p.is_symlink() else ""))
    return out
