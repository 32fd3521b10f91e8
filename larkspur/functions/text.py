"""Text functions on columns: tokens, shingles, sketches, activation wording, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists that results depend on.
STOPWORDS = """a an and are as at be by for from has have if in into is it its of on or
so such that the their then there these this to was will with you your i we
when where how what which who whom whose why can could should would may
might must do does did done being been am were not no yes here
use uses used using user users skill skills ask asks asked asking""".split()
ACTIVATION_PATTERNS = ["for questions about", "if the user", "if you", "before ", "after ", "during "]
ACTIVATION_TOKENS = ["when", "whenever", "trigger", "triggers", "triggered", "triggering", "invoke", "invokes", "invoked", "invoking"]
GENERIC_VOCAB = """help helps assist assists task tasks various general support supports
work works handle handles manage manages tool tools thing things stuff
item items way ways""".split()
IMPERATIVE_DROP = """a an the and or for in on at to of with from by anywhere everywhere
nowhere here there always never all any this that these those it its
your you""".split()

TOKEN = r"[a-z0-9](?:[a-z0-9'-]*[a-z0-9])?"
SKETCH = 128
SHINGLE = 5


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words_in(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokenize(text: Column | str) -> Column:
    """Lower-case tokens that begin and end alphanumeric."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(TOKEN), F.lit(0))


def without(tokens: Column, words: list[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(words))


def content_tokens(text: Column | str) -> Column:
    return without(tokenize(text), STOPWORDS)


def grams(tokens: Column, k: int) -> Column:
    """Every run of k tokens joined by a space; fewer than k tokens (but some) make one run."""

    def of(t: Column) -> Column:
        n = F.size(t)
        runs = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.array_join(F.slice(t, i + 1, k), " "))
        return F.when(n >= k, runs).when(n > 0, F.array(F.array_join(t, " "))).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(tokens), of)[0]  # a lambda's variable: the tokens are found once, not once a run


def whitespace_words(text: Column | str) -> Column:
    return F.filter(F.split(col(text), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def sketch(text: Column | str) -> Column:
    """The 128 smallest distinct crc32 of 5-word shingles over white-space words."""
    codes = F.transform(grams(whitespace_words(text), SHINGLE), lambda g: F.crc32(g.cast("binary")))
    return F.slice(F.array_sort(F.array_distinct(codes)), 1, SKETCH)


def sketch_estimate(a: Column, b: Column) -> Column:
    """Share of the union's 128 smallest codes that both sketches hold; both empty 1, one empty 0."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(union))


def has_activation(text: Column | str) -> Column:
    low = F.lower(col(text))
    said = F.lit(False)
    for p in ACTIVATION_PATTERNS:
        said = said | F.contains(low, F.lit(p))
    return said | F.arrays_overlap(tokenize(text), words_in(ACTIVATION_TOKENS))


def distinct_vocabulary(text: Column | str) -> Column:
    """How many distinct content tokens lie outside the generic vocabulary."""
    return F.size(F.array_distinct(without(content_tokens(text), GENERIC_VOCAB)))


def flat(text: Column | str) -> Column:
    return F.array_join(whitespace_words(text), " ")


def clipped(text: Column, limit: int) -> Column:
    """Longer than limit: the first limit - 1 characters, right-stripped, and an ellipsis."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, limit - 1), r"(?U)\s+$", ""), F.lit("…")))


def one_line(text: Column | str, limit: int = 100) -> Column:
    return clipped(flat(text), limit)


def split_lines(text: Column | str) -> Column:
    return F.split(F.regexp_replace(col(text), r"\r\n?", "\n"), "\n", -1)


def body_start(lines: Column) -> Column:
    """1-based first line after a closing --- of a front block; 1 without one."""
    strip = F.transform(lines, lambda x: F.trim(x))
    at = F.array_position(F.slice(strip, 2, F.greatest(F.size(lines), F.lit(1))), "---")
    return F.when((strip[0] == "---") & (at > 0), at + 2).otherwise(F.lit(1)).cast("int")


def extract_commands(text: Column | str) -> Column:
    """Embedded shell commands in order, as structs (lineno, command): inline marks and command fences."""
    kind = "array<struct<lineno:int,command:string>>"
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("fenced"), F.array().cast(kind).alias("out"))

    def step(acc: Column, line: Column) -> Column:
        n = (acc["n"] + 1).cast("int")
        bare = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
        inline = F.transform(F.regexp_extract_all(line, F.lit(r"(?U)(?:^|(?<=\s))!`([^`\n]+)`"), F.lit(1)), lambda c: F.struct(n.alias("lineno"), c.alias("command")))
        own = F.array(F.struct(n.alias("lineno"), bare.alias("command")))
        none = F.array().cast(kind)
        fenced = F.when(acc["fenced"], bare != "```").otherwise(bare == "```!")
        found = F.when(acc["fenced"], F.when((bare != "```") & (bare != ""), own).otherwise(none)).otherwise(F.when(bare == "```!", none).otherwise(inline))
        return F.struct(n.alias("n"), fenced.alias("fenced"), F.concat(acc["out"], found).alias("out"))

    return F.aggregate(split_lines(text), start, step, lambda acc: acc["out"])


def imperatives(text: Column | str) -> Column:
    """Structs (kind, phrase): the first two weighty tokens after each always or never."""
    hits = F.regexp_extract_all(col(text), F.lit(r"(?iU)\b((?:always|never)\s+(?:\w+[ \t]){0,3}\w+)"), F.lit(1))

    def one(hit: Column) -> Column:
        rest = without(tokenize(F.regexp_replace(hit, r"(?iU)^(always|never)\s+", "")), IMPERATIVE_DROP)
        kind = F.when(F.lower(F.substring(hit, 1, 1)) == "a", "always").otherwise("never")
        return F.struct(kind.alias("kind"), F.array_join(F.slice(rest, 1, 2), " ").alias("phrase"), F.size(rest).alias("n"))

    return F.filter(F.transform(hits, one), lambda p: p["n"] >= 2)


def slug(text: Column | str) -> Column:
    """Lower case, runs of other characters to one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def shell_quote(text: Column | str) -> Column:
    c = col(text)
    return F.when(c == "", "''").when(c.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$"), c).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def approximate_tokens(text: Column | str) -> Column:
    return F.floor(F.length(col(text)) / 4)


def sha(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def fingerprint(check_id: Column | str, parts: Column, extra: Column | None = None) -> Column:
    """sha256 of check|sorted parts|extra; parts is an array of strings."""
    name = F.lit(check_id) if isinstance(check_id, str) else check_id
    return sha(F.array_join(F.concat(F.array(name), F.array_sort(parts), F.array(F.lit("") if extra is None else extra)), "|"))


def manifest_hash(files: Column) -> Column:
    """Of structs (path, hash): sha256 over 'hash  path' lines in byte order of path."""
    lines = F.transform(F.array_sort(files), lambda f: F.concat(f["hash"], F.lit("  "), f["path"], F.lit("\n")))
    return sha(F.array_join(lines, ""))


def pair_key(a: Column, b: Column) -> Column:
    """The same for both orders, whatever the two texts hold."""
    return F.sha2(F.array_join(F.array_sort(F.array(F.sha2(a.cast("binary"), 256), F.sha2(b.cast("binary"), 256))), "").cast("binary"), 256)
