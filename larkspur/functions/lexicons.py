"""Line lexicons as predicates. Every pattern is matched on one line, with Unicode word characters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that decide results.
SUSPECT = "\u200b\ufeff\u2028\u2029\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
URL = r"https?://\S+"
LOCAL_URL = r"https?://(?:localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\])\S*"
BASE64_RUN = r"[A-Za-z0-9+/=]{120,}"
HEX_RUN = r"\b[0-9a-fA-F]{129,}\b"
OVERRIDE = [
    r"\bignore\b.{0,20}\b(previous|prior|earlier|above|all other)\b.{0,20}\b(instructions?|rules|guidance|guidelines|prompts?)\b",
    r"\bdisregard\b.{0,30}\b(instructions?|rules|guidance|guidelines|system prompt)\b",
    r"\bdo not (tell|inform|notify|warn|alert)\b.{0,15}\bthe user\b(?!\s+to\b)",
    r"\bwithout (informing|telling|notifying|alerting)\b.{0,15}\bthe user\b",
    r"\bhide (this|it) from\b",
    r"\bdo not reveal\b",
    r"\byou are no longer (bound|restricted|limited)\b",
    r"\bforget (everything|all previous)\b",
    r"\boverride (the )?(system|safety)\b",
]
FETCH_TOOL = r"\b(curl|wget)\b"
SHELL_TAIL = r"\|\s*(sudo\s+)?(ba|z|da)?sh\b"
FETCH_DIRECTIVE = r"\b(download|fetch|retrieve|curl|wget|get)\b.{0,60}\b(and|then)\s+(run|execute|eval|follow|apply)\b|\bfollow (the|these|its) instructions\b"
EGRESS = [
    r"\bcurl\b", r"\bwget\b", r"\bnc\b", r"\bInvoke-WebRequest\b", r"\bInvoke-RestMethod\b", r"\brequests\.", r"\burllib\.request\b", r"\bhttpx\b",
    r"\baiohttp\b", r"\bsocket\.create_connection\b", r"\bAF_INET\b", r"\bfetch\s*\(", r"\baxios\b", r"\bXMLHttpRequest\b", r"\bNet::HTTP\b", r"\bhttps?\.(request|get)\b",
]
CREDENTIAL_STORES = [
    r"\.ssh\b", r"\bid_rsa\b", r"\bid_ed25519\b", r"\.pem\b", r"\.aws\b", r"\.config/gcloud", r"\.netrc\b", r"\.kube/config", r"\.mozilla/firefox", r"\.config/google-chrome", r"Google/Chrome",
]
ENV_FILE = r"(?<![\w.])\.env\b"
MANDATORY = [
    r"\b(you )?must\b.{0,30}\brun\b",
    r"\bbefore (doing )?anything( else)?\b.{0,30}\brun\b",
    r"\b(always|first),? (begin|start) by running\b",
    r"\balways run\b",
    r"\bfirst,? (run|execute)\b",
    r"\brequired (first )?step\b.{0,30}\b(run|execute)\b",
]
CROSS_TOOL = [
    r"\b(do not|don't|never) use\b(?!\s+this\b).{0,30}\btool\b",
    r"\binstead of (using )?(the )?[\w-]+ tool\b",
    r"\bbefore (using|calling) any other tool\b",
    r"\balways use this tool\b",
    r"\buse this tool (first|instead)\b",
    r"\bignore (all )?other tools\b",
]
SECRET_PREFIXES = ["sk-", "sk_live_", "pk_live_", "ghp_", "github_pat_", "gho_", "xoxb-", "xoxp-", "xapp-", "AKIA", "ASIA", "glpat-", "AIza", "ntn_"]
SECRET_NAME = r"(KEY|TOKEN|SECRET|PASSWORD|CREDENTIALS?)$"
PUBLIC_NAME = r"(SHA\d*|HASH|FINGERPRINT|PUBLIC|PUBKEY)"
BARE_PRINTENV = r"\bprintenv\b(?!\s+\w)"
SCRIPT_EXTENSIONS = [".py", ".sh", ".bash", ".zsh", ".js", ".mjs", ".ts", ".rb", ".pl", ".ps1"]


def found(line: Column, patterns: str | list[str], ignore_case: bool = False) -> Column:
    mode = "(?Usi)" if ignore_case else "(?Us)"
    tests = [line.rlike(mode + p) for p in ([patterns] if isinstance(patterns, str) else patterns)]
    return reduce(lambda a, b: a | b, tests)


def drop(line: Column, pattern: str) -> Column:
    return F.regexp_replace(line, "(?U)" + pattern, "")


def suspect_characters(line: Column) -> Column:
    return line.rlike(f"[{SUSPECT}]")


def encoded_blob(line: Column) -> Column:
    bare = drop(line, URL)
    return found(bare, BASE64_RUN) | found(bare, HEX_RUN)


def override(line: Column) -> Column:
    return found(line, OVERRIDE, True)


def pipe_to_shell(line: Column) -> Column:
    """The first tool is found first and the tail after it next, so a line full of tools takes linear time."""
    return found(F.regexp_extract(line, f"(?Us){FETCH_TOOL}(.*)$", 2), SHELL_TAIL)


def remote_fetch(line: Column) -> Column:
    clean = drop(line, LOCAL_URL)
    return pipe_to_shell(clean) | (found(clean, "https?://") & found(clean, FETCH_DIRECTIVE, True))


def egress(line: Column) -> Column:
    return found(line, EGRESS)


def credential_store(line: Column) -> Column:
    return found(line, CREDENTIAL_STORES)


def env_file(line: Column) -> Column:
    return found(line, ENV_FILE)


def cross_tool(line: Column) -> Column:
    return found(line, CROSS_TOOL, True)


def looks_secret(name: Column, value: Column) -> Column:
    """The order of the rules is part of the meaning."""
    prefixed = reduce(lambda a, b: a | b, [value.startswith(p) for p in SECRET_PREFIXES])
    place = value.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://") | value.startswith("/") | value.startswith("~") | value.startswith("./")
    long_mixed = (F.length(value) >= 32) & ~F.contains(value, F.lit(" ")) & value.rlike("[A-Za-z]") & value.rlike("[0-9]")
    return (
        F.when(value.isNull() | (value == ""), False).when(value.startswith("${") & value.endswith("}"), False).when(prefixed, True)
        .when(name.rlike("(?i)" + PUBLIC_NAME), False).when(place, False).when(name.rlike("(?i)" + SECRET_NAME), True).otherwise(long_mixed)
    )


def reads_env_secret(command: Column) -> Column:
    names = F.regexp_extract_all(command, F.lit(r"(?U)\$\{?(\w+)\}?"), F.lit(1))
    return found(command, BARE_PRINTENV) | F.exists(names, lambda n: ~n.rlike("(?i)" + PUBLIC_NAME) & n.rlike("(?i)" + SECRET_NAME))
