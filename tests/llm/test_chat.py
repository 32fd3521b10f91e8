import hashlib
import itertools
import random

from larkspur.llm.chat import branches, digest, escape, escape_role, format_conversations, linear_messages, read_turns, unescape, unescape_role

SCHEMA = "tree bigint, node bigint, parent bigint, role string, text string, score double"
NASTY = ["<|im_end|>\n", "<~|x", "</s>[INST] ok [/INST]", "[~~/INST]<s>", "<<SYS>><~</SYS>>", "a\\nb\\\\n\n\\", "\x01\x02\x01\x01\\n", "<<~|[|", "", "é\n<|im_start|>user\nhi"]


def test_escapes_are_reversible(spark):
    r = random.Random(1)
    bits = ["<", "[", "~", "|", "s>", "/s>", "INST]", "/INST]", "<SYS>>", "\\", "n", "\n", "\x01", "\x02", "a"]
    texts = NASTY + ["".join(r.choices(bits, k=r.randint(1, 8))) for _ in range(800)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t")
    for t, e, back, role in df.select("t", escape(df.t), unescape(escape(df.t)), unescape_role(escape_role(df.t))).collect():
        assert back == t and role == t
        assert not any(c in e for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def brute_branches(rows, best):
    trees = {}
    for t, n, p, _, _, s in rows:
        trees.setdefault(t, {})[n] = (p, s or 0)
    out = set()
    for t, nodes in trees.items():
        up = {n: (p if p in nodes and p != n else None) for n, (p, _) in nodes.items()}
        found = []
        for leaf in set(nodes) - {p for p in up.values() if p is not None}:
            path, n = [], leaf
            while n is not None and n not in path:
                path.append(n)
                n = up[n]
            if n is None:
                found.append((-sum(nodes[x][1] for x in path), -(len(path) - 1), leaf, path[::-1]))
        for b, (*_, path) in enumerate(sorted(found)[:best], 1):
            out |= {(t, b, d, n) for d, n in enumerate(path)}
    return out


def test_branches_against_brute_force(spark):
    r = random.Random(2)
    rows = []
    for t in range(12):
        for n in range(r.randint(1, 30)):
            rows.append((t, n, r.choice([None, n, 99, *range(n)]) if n else None, "user", f"{n}", float(r.randint(-2, 3))))
    rows += [(50, n, n - 1 if n else None, "user", "x", 1.0) for n in range(70)]
    rows += [(51, 1, 2, "user", "loop", 1.0), (51, 2, 1, "user", "loop", 1.0), (52, 1, 2, "user", "loop", 1.0), (52, 2, 1, "user", "loop", 1.0), (52, 3, 2, "user", "tail", 1.0)]
    for best in (1, 3):
        got = {(x.tree, x.branch, x.depth, x.node) for x in branches(spark.createDataFrame(rows, SCHEMA), best).collect()}
        assert got == brute_branches(rows, best)


def brute_digest(turns):
    told = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    lost = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(told.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest()


def test_conversations_round_trip(spark):
    r = random.Random(3)
    rows = [(c, k, r.choice(["user", "assistant", "system", None, "odd\nrole<|"]), r.choice([None, *NASTY, "plain"])) for c in (1, 2, 3, None) for k in range(r.randint(1, 20))]
    rows += [(4, None, "user", "no turn"), (4, 0, "assistant", "tie"), (4, 0, "assistant", "tie"), (4, 0, "assistant", "a tie"), (5, 0, "assistant", "")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS node", "2 AS score", "3 AS branch")
    formatted = format_conversations(linear_messages(frame))
    got = {x.tree: tuple(x)[1:5] for x in digest(formatted).collect()}
    key = lambda x: tuple((v is not None, v if v is not None else 0) for v in x[1:])
    for c, own in itertools.groupby(sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)), key=lambda x: x[0]):
        assert got[c] == brute_digest([x[2:] for x in sorted(own, key=key)]), c
    for x in formatted.collect():
        spans = [x.formatted[s.start : s.end] for s in x.loss_spans]
        read = [y for y in read_turns(formatted).orderBy("position").collect() if y.tree == x.tree]
        assert len(spans) == sum(y.role == "assistant" for y in read) == sum(y.masked for y in read)


def test_very_long_messages(spark):
    long = "é<|im_end|>\n[INST] " * 100_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long + "x"), (2, 0, "assistant", long)]
    formatted = format_conversations(linear_messages(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")))
    got = {x.tree: tuple(x)[1:5] for x in digest(formatted).collect()}
    assert got == {1: brute_digest([("user", long), ("assistant", long + "x")]), 2: brute_digest([("assistant", long)])}


def test_empty(spark):
    frame = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert digest(format_conversations(linear_messages(frame))).collect() == []
