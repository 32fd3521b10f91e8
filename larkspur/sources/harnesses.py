"""The harnesses that a scan knows: markers, roots of skills and commands, server settings, order of precedence."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def row(name: str, title: str, detect: list[str], project: list[str], user: list[str], **rest: object) -> dict:
    """One harness. Specs that begin with ~/ lie in the home folder, others in the project.

    order: which of two skills of a name wins, none where both load. root_md: roots whose bare *.md files are skills.
    verified: which of paths, precedence and servers are documented; reports mark the others.
    """
    plain = {"root_md": [], "commands": [], "user_commands": [], "servers": [], "user_servers": [], "form": "mcp-json", "user_form": None, "order": "project-first", "recursive": True, "verified": []}
    return {"id": name, "title": title, "detect": detect, "project": project, "user": user} | plain | rest


# Where each harness keeps things.
HARNESSES = [
    row("claude-code", "Claude Code", [".claude", "~/.claude"], [".claude/skills"], ["~/.claude/skills"], commands=[".claude/commands"], user_commands=["~/.claude/commands"], servers=[".mcp.json"], user_servers=["~/.claude.json"], form="mcp-json", user_form="claude-user-json", verified=["paths", "precedence", "servers"]),
    row("pi", "Pi", [".pi", "~/.pi"], [".pi/skills", ".agents/skills"], ["~/.pi/agent/skills", "~/.agents/skills"], order="global-first", root_md=[".pi/skills", "~/.pi/agent/skills"], verified=["paths", "precedence"]),
    row("cursor", "Cursor", [".cursor", "~/.cursor"], [".cursor/skills", ".agents/skills"], ["~/.cursor/skills", "~/.agents/skills"], servers=[".cursor/mcp.json"], user_servers=["~/.cursor/mcp.json"], verified=["paths", "servers"]),
    row("codex", "Codex CLI", [".codex", "~/.codex"], [".codex/skills", ".agents/skills"], ["~/.codex/skills", "~/.agents/skills"], order="none", user_servers=["~/.codex/config.toml"], form="codex-toml", verified=["paths", "precedence", "servers"]),
    row("copilot", "GitHub Copilot CLI", [".github/copilot-instructions.md", "~/.copilot"], [".github/skills", ".agents/skills", ".claude/skills"], ["~/.copilot/skills", "~/.agents/skills"], servers=[".vscode/mcp.json"], form="vscode-json", verified=["paths", "precedence", "servers"]),
    row("gemini-cli", "Gemini CLI", [".gemini", "~/.gemini"], [".gemini/skills", ".agents/skills"], ["~/.gemini/skills", "~/.agents/skills"], recursive=False, servers=[".gemini/settings.json"], user_servers=["~/.gemini/settings.json"], verified=["paths", "precedence", "servers"]),
    row("adal", "AdaL", ["~/.adal"], [".adal/skills"], ["~/.adal/skills"]),
    row("aider-desk", "AiderDesk", ["~/.aider-desk"], [".aider-desk/skills"], ["~/.aider-desk/skills"]),
    row("amp", "Amp", ["~/.config/amp"], [".agents/skills"], ["~/.config/agents/skills"]),
    row("antigravity", "Antigravity", ["~/.gemini/antigravity"], [".agents/skills"], ["~/.gemini/antigravity/skills"]),
    row("antigravity-cli", "Antigravity CLI", ["~/.gemini/antigravity-cli"], [".agents/skills"], ["~/.gemini/antigravity-cli/skills"]),
    row("astrbot", "AstrBot", ["~/.astrbot", "data/skills"], ["data/skills"], ["~/.astrbot/data/skills"]),
    row("augment", "Augment", ["~/.augment"], [".augment/skills"], ["~/.augment/skills"]),
    row("autohand-code", "Autohand Code CLI", ["~/.autohand"], [".autohand/skills"], ["~/.autohand/skills"]),
    row("bob", "IBM Bob", ["~/.bob"], [".bob/skills"], ["~/.bob/skills"]),
    row("cline", "Cline", [".clinerules", "~/.cline"], [".clinerules/skills", ".cline/skills", ".claude/skills", ".agents/skills"], ["~/.cline/skills", "~/.agents/skills"], order="global-first", recursive=False, user_servers=["~/Library/Application Support/Code/User/globalStorage/saoudrizwan.claude-dev/settings/cline_mcp_settings.json"], verified=["paths", "precedence"]),
    row("codearts-agent", "CodeArts Agent", ["~/.codeartsdoer"], [".codeartsdoer/skills"], ["~/.codeartsdoer/skills"]),
    row("codebuddy", "CodeBuddy", ["~/.codebuddy", ".codebuddy"], [".codebuddy/skills"], ["~/.codebuddy/skills"]),
    row("codemaker", "Codemaker", ["~/.codemaker"], [".codemaker/skills"], ["~/.codemaker/skills"]),
    row("codestudio", "Code Studio", ["~/.codestudio"], [".codestudio/skills"], ["~/.codestudio/skills"]),
    row("command-code", "Command Code", ["~/.commandcode"], [".commandcode/skills"], ["~/.commandcode/skills"]),
    row("continue", "Continue", ["~/.continue", ".continue"], [".continue/skills"], ["~/.continue/skills"]),
    row("cortex", "Cortex Code", ["~/.snowflake/cortex"], [".cortex/skills"], ["~/.snowflake/cortex/skills"]),
    row("crush", "Crush", ["~/.config/crush"], [".crush/skills"], ["~/.config/crush/skills"]),
    row("deepagents", "Deep Agents", ["~/.deepagents"], [".agents/skills"], ["~/.deepagents/agent/skills"]),
    row("devin", "Devin for Terminal", ["~/.config/devin"], [".devin/skills"], ["~/.config/devin/skills"]),
    row("dexto", "Dexto", ["~/.dexto"], [".agents/skills"], ["~/.agents/skills"]),
    row("droid", "Droid", ["~/.factory"], [".factory/skills"], ["~/.factory/skills"]),
    row("eve", "Eve", ["agent"], ["agent/skills"], []),
    row("firebender", "Firebender", ["~/.firebender"], [".agents/skills"], ["~/.firebender/skills"]),
    row("forgecode", "ForgeCode", ["~/.forge"], [".forge/skills"], ["~/.forge/skills"]),
    row("goose", "Goose", ["~/.config/goose"], [".goose/skills"], ["~/.config/goose/skills"]),
    row("hermes-agent", "Hermes Agent", ["~/.hermes"], [".hermes/skills"], ["~/.hermes/skills"]),
    row("iflow-cli", "iFlow CLI", ["~/.iflow"], [".iflow/skills"], ["~/.iflow/skills"]),
    row("inference-sh", "inference.sh", ["~/.inferencesh"], [".inferencesh/skills"], ["~/.inferencesh/skills"]),
    row("jazz", "Jazz", ["~/.jazz", ".jazz"], [".jazz/skills"], ["~/.jazz/skills"]),
    row("junie", "Junie", ["~/.junie"], [".junie/skills"], ["~/.junie/skills"]),
    row("kilo", "Kilo Code", ["~/.kilocode"], [".kilocode/skills"], ["~/.kilocode/skills"]),
    row("kimi-code-cli", "Kimi Code CLI", ["~/.kimi-code", "~/.kimi"], [".agents/skills"], ["~/.agents/skills"]),
    row("kiro-cli", "Kiro CLI", ["~/.kiro"], [".kiro/skills"], ["~/.kiro/skills"]),
    row("kode", "Kode", ["~/.kode"], [".kode/skills"], ["~/.kode/skills"]),
    row("lingma", "Lingma", ["~/.lingma"], [".lingma/skills"], ["~/.lingma/skills"]),
    row("loaf", "Loaf", ["~/.loaf"], [".agents/skills"], ["~/.agents/skills"]),
    row("mcpjam", "MCPJam", ["~/.mcpjam"], [".mcpjam/skills"], ["~/.mcpjam/skills"]),
    row("mistral-vibe", "Mistral Vibe", ["~/.vibe"], [".vibe/skills"], ["~/.vibe/skills"]),
    row("moxby", "Moxby", ["~/.moxby"], [".moxby/skills"], ["~/.moxby/skills"]),
    row("mux", "Mux", ["~/.mux"], [".mux/skills"], ["~/.mux/skills"]),
    row("neovate", "Neovate", ["~/.neovate"], [".neovate/skills"], ["~/.neovate/skills"]),
    row("ona", "Ona", ["~/.ona"], [".ona/skills"], ["~/.ona/skills"]),
    row("openclaw", "OpenClaw", ["~/.openclaw", "~/.clawdbot", "~/.moltbot"], ["skills"], ["~/.openclaw/skills"]),
    row("opencode", "OpenCode", [".opencode", "~/.config/opencode"], [".opencode/skills", ".opencode/skill", ".agents/skills", ".claude/skills"], ["~/.config/opencode/skills", "~/.config/opencode/skill", "~/.agents/skills", "~/.claude/skills"], verified=["paths"]),
    row("openhands", "OpenHands", ["~/.openhands"], [".openhands/skills"], ["~/.openhands/skills"]),
    row("pochi", "Pochi", ["~/.pochi"], [".pochi/skills"], ["~/.pochi/skills"]),
    row("promptscript", "PromptScript", [".promptscript", "promptscript.yaml"], [".agents/skills"], []),
    row("qoder", "Qoder", ["~/.qoder"], [".qoder/skills"], ["~/.qoder/skills"]),
    row("qoder-cn", "Qoder CN", ["~/.qoder-cn"], [".qoder/skills"], ["~/.qoder-cn/skills"]),
    row("qwen-code", "Qwen Code", ["~/.qwen"], [".qwen/skills"], ["~/.qwen/skills"]),
    row("reasonix", "Reasonix", ["~/.reasonix"], [".reasonix/skills"], ["~/.reasonix/skills"]),
    row("replit", "Replit", [".replit"], [".agents/skills"], ["~/.config/agents/skills"]),
    row("roo", "Roo Code", ["~/.roo"], [".roo/skills"], ["~/.roo/skills"]),
    row("rovodev", "Rovo Dev", ["~/.rovodev"], [".rovodev/skills"], ["~/.rovodev/skills"]),
    row("tabnine-cli", "Tabnine CLI", ["~/.tabnine"], [".tabnine/agent/skills"], ["~/.tabnine/agent/skills"]),
    row("terramind", "Terramind", ["~/.terramind"], [".terramind/skills"], ["~/.terramind/skills"]),
    row("tinycloud", "Tinycloud", ["~/.tinycloud"], [".tinycloud/skills"], ["~/.tinycloud/skills"]),
    row("trae", "Trae", ["~/.trae"], [".trae/skills"], ["~/.trae/skills"]),
    row("trae-cn", "Trae CN", ["~/.trae-cn"], [".trae/skills"], ["~/.trae-cn/skills"]),
    row("warp", "Warp", ["~/.warp"], [".agents/skills"], ["~/.agents/skills"]),
    row("windsurf", "Windsurf", ["~/.codeium/windsurf"], [".windsurf/skills"], ["~/.codeium/windsurf/skills"]),
    row("zcode", "ZCode", ["~/.zcode"], [".zcode/skills"], ["~/.zcode/skills"]),
    row("zed", "Zed", ["~/.config/zed"], [".agents/skills"], ["~/.agents/skills"]),
    row("zencoder", "Zencoder", ["~/.zencoder"], [".zencoder/skills"], ["~/.zencoder/skills"]),
    row("zenflow", "Zenflow", ["~/.zencoder"], [".zencoder/skills"], ["~/.zencoder/skills"]),
    row("claude-desktop", "Claude Desktop", ["~/Library/Application Support/Claude/claude_desktop_config.json"], [], [], user_servers=["~/Library/Application Support/Claude/claude_desktop_config.json"], verified=["servers"]),
]


def specs_at(spec: str, project: str, home: str) -> str:
    return os.path.join(home, spec[2:]) if spec.startswith("~/") else os.path.join(project, spec)


def detected(project: str, home: str, global_only: bool = False, harnesses: list[dict] | None = None) -> list[dict]:
    """The harnesses of which a marker exists."""
    marks = lambda h: [m for m in h["detect"] if m.startswith("~/") or not global_only]
    return [h for h in harnesses or HARNESSES if any(os.path.exists(specs_at(m, project, home)) for m in marks(h))]


def server_specs(project: str, home: str, harnesses: list[dict], global_only: bool = False) -> list[tuple[str, str, str, str]]:
    """(path, format, harness, scope) of the server settings of some harnesses, project first."""
    out = []
    for h in harnesses:
        out += [] if global_only else [(specs_at(s, project, home), h["form"], h["id"], "project") for s in h["servers"]]
        out += [(specs_at(s, project, home), h["user_form"] or h["form"], h["id"], "user") for s in h["user_servers"]]
    return out


def harness_table(spark: SparkSession, harnesses: list[dict] | None = None) -> DataFrame:
    """id, title, search_order, recursive and what is verified."""
    rows = [(h["id"], h.get("title", h["id"]), h["order"], h["recursive"], *(k in h.get("verified", []) for k in ("paths", "precedence", "servers"))) for h in harnesses or HARNESSES]
    return spark.createDataFrame(rows, "id string, title string, search_order string, recursive boolean, paths_verified boolean, precedence_verified boolean, servers_verified boolean")
