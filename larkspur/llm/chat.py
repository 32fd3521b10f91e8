"""Chat formatting of reply trees, by DataFrame functions alone.

Messages form trees by (tree, node, parent). Root-to-leaf paths are enumerated by iterative self-joins on pointers
that double in reach, so a chain of n messages takes log2(n) joins and n log n rows, not n paths of n. A leaf's score
is the sum of its branch's scores; branches are ranked by score, longer ones first among equal, then by leaf, and the
`best` ones of each tree are each formatted as one conversation.

Template: a turn is START role NEWLINE text STOP, turns follow each other. In texts and roles every control string
(of this template or of the usual others) gets a tilde after its first character, or one more, which is undone when
reading; so a text can say anything and no two conversations look alike. In roles, backslashes and line breaks are
escaped as well. The loss mask covers the text of each assistant turn, as spans of code points of the formatted string.

Defined cases: a null text is empty, a null role is the empty role; a message whose parent is missing from its tree,
or is itself, is a root; messages in a cycle have no root and are in no conversation; equal (tree, node) rows are one
message, the least by role, then text; an empty table gives no conversations; other columns are ignored. For linear
conversations, rows of one conversation are ordered by turn, then role, then text, nulls first, and repeated rows are
turns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import stored

START = "<|im_start|>"
STOP = "<|im_end|>\n"
#: Control strings begin with one of two characters and go on with one of these.
REST = r"(\||/?s>|/?INST\]|<SYS>>|</SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(~*)" + REST, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])~(~*)" + REST, "$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # a pair of backslashes is put aside as U+0001 U+0001, which a role may only hold as U+0001 U+0002
    aside = F.replace(F.replace(unescape(role), F.lit("\x01"), F.lit("\x01\x02")), F.lit("\\\\"), F.lit("\x01\x01"))
    return F.replace(F.replace(F.replace(aside, F.lit("\\n"), F.lit("\n")), F.lit("\x01\x01"), F.lit("\\")), F.lit("\x01\x02"), F.lit("\x01"))


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Conversations of turns as one-branch reply trees: tree, node, parent, role, text, score."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    node = F.row_number().over(order).cast("bigint")
    rows = conversations.select(F.col("conv_id").alias("tree"), node.alias("node"), "role", "text")
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def branches(messages: DataFrame, best: int = 1) -> DataFrame:
    """tree, branch (rank from 1), depth (from 0), node of the messages on the best branches of each tree."""
    nodes = messages.where("node is not null").groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max(F.coalesce("score", F.lit(0.0)).cast("double")).alias("score"))
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    linked = nodes.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p")) & (F.col("node") != F.col("parent")), "left")
    now = stored(linked.select("tree", "node", F.col("p").alias("up"), "score", F.when(F.col("p").isNull(), 0).otherwise(1).cast("bigint").alias("reach")))
    parents = now.where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("p")).distinct()
    leaves = now.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti").select("tree", "node")
    # up: the ancestor 2^k above (null beyond the root); reach: steps up to it or to the root; score: of those passed
    active, done = now.where("up is not null"), now.where("up is null")
    jumps = [active.select("tree", "node", "up")]
    most = now.count().bit_length()  # in a cycle pointers never end, and no path is longer than this many doublings
    for _ in range(most):
        higher = active.unionByName(done).select(F.col("tree").alias("t"), F.col("node").alias("p"), F.col("up").alias("up2"), F.col("score").alias("score2"), F.col("reach").alias("reach2"))
        joined = active.join(higher, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("p")), "left")
        now = stored(joined.select("tree", "node", F.col("up2").alias("up"), (F.col("score") + F.coalesce("score2", F.lit(0.0))).alias("score"), (F.col("reach") + F.coalesce("reach2", F.lit(0))).alias("reach")))
        done = done.unionByName(now.where("up is null"))  # only messages whose root is not reached yet go on
        active = now.where("up is not null")
        if not active.take(1):
            break
        jumps.append(active.select("tree", "node", "up"))
    ended = done.select("tree", "node", "score", "reach").join(leaves.withColumnsRenamed({"tree": "t", "node": "p"}), F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p"))).drop("t", "p")
    rank = Window.partitionBy("tree").orderBy(F.col("score").desc(), F.col("reach").desc(), "node")
    on = stored(ended.withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= best).select("tree", "branch", "node", F.col("reach").alias("depth")))
    for k in range(len(jumps) - 1, -1, -1):  # every ancestor is a sum of distinct powers of two above the leaf
        step = jumps[k].select(F.col("tree").alias("t"), F.col("node").alias("p"), "up")
        above = on.join(step, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p"))).select("tree", "branch", F.col("up").alias("node"), (F.col("depth") - F.lit(1 << k)).alias("depth"))
        on = stored(on.unionByName(above)) if k % 4 == 0 else on.unionByName(above)
    return on


def format_conversations(messages: DataFrame, best: int = 1, loss_role: str = "assistant") -> DataFrame:
    """tree, branch, n_turns, formatted, loss_spans (start and end in code points) of each chosen branch."""
    chosen = branches(messages, best)
    own = messages.groupBy(F.col("tree").alias("t"), F.col("node").alias("p")).agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("m"))
    turns = chosen.join(own, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")))
    head = F.concat(F.lit(START), escape_role(F.col("m.role")), F.lit("\n"))
    parts = turns.select("tree", "branch", "depth", head.alias("head"), escape(F.col("m.text")).alias("body"), (F.col("m.role") == loss_role).alias("loss"))
    size = F.length("head") + F.length("body") + len(STOP)
    before = F.sum(size).over(Window.partitionBy("tree", "branch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)) + F.length("head")
    span = F.when(F.col("loss"), F.struct(start.cast("bigint").alias("start"), (start + F.length("body")).cast("bigint").alias("end")))
    placed = parts.select("tree", "branch", "depth", F.concat("head", "body", F.lit(STOP)).alias("turn"), span.alias("span"))
    gathered = placed.groupBy("tree", "branch").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("depth", "turn"))).alias("ts"), F.array_sort(F.collect_list("span")).alias("loss_spans"))
    return gathered.select("tree", "branch", "n_turns", F.array_join("ts.turn", "").alias("formatted"), "loss_spans")


def read_turns(formatted: DataFrame) -> DataFrame:
    """tree, branch, position, role, text, masked (whether the loss mask covers exactly the text) of every turn, read from `formatted` and `loss_spans`."""
    stop = STOP.replace("|", r"\|")
    pieces = formatted.select("tree", "branch", "loss_spans", F.posexplode(F.split("formatted", stop)).alias("position", "piece")).where("piece <> ''")
    body = F.locate("\n", F.col("piece"))
    sized = pieces.select("tree", "branch", "position", "piece", body.alias("body"), (F.length("piece") + len(STOP)).alias("size"))
    before = F.sum("size").over(Window.partitionBy("tree", "branch").orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    sized = sized.select("tree", "branch", "position", "piece", "body", (F.coalesce(before, F.lit(0)) + F.col("body")).cast("bigint").alias("at"))
    spans = formatted.select(F.col("tree").alias("t"), F.col("branch").alias("b"), F.explode("loss_spans").alias("s")).select("t", "b", F.col("s.start").alias("a"), F.col("s.end").alias("e"))
    found = sized.join(spans, F.col("tree").eqNullSafe(F.col("t")) & (F.col("branch") == F.col("b")) & (F.col("at") == F.col("a")), "left")
    text = F.expr("substring(piece, body + 1)")
    role = F.expr(f"substring(piece, {len(START) + 1}, body - {len(START) + 1})")
    masked = F.col("e").isNotNull() & (F.col("e") - F.col("a") == F.length(text))
    return found.select("tree", "branch", "position", unescape_role(role).alias("role"), unescape(text).alias("text"), masked.alias("masked"))


def digest(formatted: DataFrame) -> DataFrame:
    """tree, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, read back from it."""
    read = read_turns(formatted)
    told = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    rows = read.groupBy("tree", "branch").agg(
        F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("position", told.alias("told"), F.when(F.col("masked"), F.col("text")).otherwise("").alias("lost")))).alias("ts")
    )
    joined = rows.select(F.col("tree").alias("t"), F.col("branch").alias("b"), "n_turns", F.sha2(F.array_join("ts.told", "").cast("binary"), 256).alias("turns_sha256"), F.array_join("ts.lost", "").alias("lost"))
    sizes = formatted.select("tree", "branch", F.length("formatted").cast("bigint").alias("formatted_chars"))
    both = sizes.join(joined, F.col("tree").eqNullSafe(F.col("t")) & (F.col("branch") == F.col("b")))
    return both.select("tree", "n_turns", "turns_sha256", F.length("lost").cast("bigint").alias("loss_chars"), F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
