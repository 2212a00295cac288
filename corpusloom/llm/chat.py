"""Chat formatting of reply trees.

Messages point at the message they answer. Iterative self-joins with doubling steps enumerate the
root-to-leaf paths, branches are ranked by their score, and each chosen path becomes one text.

Template: `<s>role<m>text</s>`, one after the other. Control strings inside roles and texts get a
backslash behind their first character and backslashes are doubled, so `unescape` restores them
and no control string survives inside a text. Loss spans are positions (code points, end
exclusive) in the formatted text that cover the texts of the trained role.

Defined cases: null texts and roles are empty, a null conversation is one conversation, repeated
rows are turns of their own, ties fall to role and text, a message whose parent is missing is a
root, an empty table gives no rows, extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrays import let
from ..settings import materialise

# The control strings of the template and of common chat templates.
CONTROL = ("<s>", "</s>", "<m>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
OPEN, MIDDLE, CLOSE = CONTROL[0], CONTROL[2], CONTROL[1]

_QUOTED = "|".join("\\Q" + c[1:] + "\\E" for c in CONTROL)
_CONTROL_RE = f"([<\\[])(?=(?:{_QUOTED}))"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _CONTROL_RE, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(\\|(?=[^\\]))", "$1")


def message_tree(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows ordered by turn as a reply tree: each turn answers the one before it.

    (id, parent, conv_id, role, text, score); the score of a message is 1, so the longest branch
    of a conversation ranks first.
    """
    plain = rows.select(
        F.monotonically_increasing_id().alias("id"),
        F.col(conversation).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    stored = materialise(plain, "messages")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "id")
    links = stored.select("id", F.lag("id").over(order).alias("parent"))
    return stored.join(links, "id").select("id", "parent", "conv_id", "role", "text", F.lit(1.0).alias("score"))


def paths(tree: DataFrame) -> DataFrame:
    """(leaf, id, up, score): the messages between every leaf and its root, `up` steps above the leaf.

    After round i every leaf knows its 2^i nearest ancestors: the known ones are joined with the
    jump table of 2^i steps, which is then joined with itself. A tree of depth n takes log2(n)
    rounds, all of narrow rows; each round is written to the shared folder.
    """
    nodes = tree.select("id", "parent", "score")
    up = nodes.filter("parent is not null").select("id", F.col("parent").alias("ancestor"))
    up = up.join(nodes.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id", "ancestor")
    jumps = materialise(up, "jumps")
    leaves = nodes.join(jumps.select(F.col("ancestor").alias("id")), "id", "left_anti")
    known = materialise(leaves.select(F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up"), "score"), "paths")
    scores = nodes.select(F.col("id").alias("ancestor"), "score")
    step = 1
    while not jumps.isEmpty():
        higher = known.drop("score").join(jumps, "id").join(scores, "ancestor")
        moved = higher.select("leaf", F.col("ancestor").alias("id"), (F.col("up") + step).alias("up"), "score")
        known = materialise(known.unionByName(moved), "paths")
        second = jumps.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("_next"))
        jumps = materialise(jumps.join(second, "ancestor").select("id", F.col("_next").alias("ancestor")), "jumps")
        step *= 2
    return known


def rank_paths(enumerated: DataFrame, branches: int | None = 1) -> DataFrame:
    """(leaf, root, branch): leaves by falling path score inside their tree, ties to the lower leaf.

    `branches` keeps so many paths of a tree; None keeps all.
    """
    summed = enumerated.groupBy("leaf").agg(F.sum("score").alias("total"), F.max_by("id", "up").alias("root"))
    ranked = summed.withColumn("branch", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("total"), "leaf")))
    chosen = ranked if branches is None else ranked.filter(F.col("branch") <= branches)
    return chosen.select("leaf", "root", "branch")


def format_turns(turns: Column, trained: str = "assistant") -> tuple[Column, Column]:
    """The formatted text and its loss spans, from an ordered array of (role, text) structs."""
    parts = F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE)).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == trained).alias("loss"),
        ),
    )
    whole = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    start = F.struct(
        F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans")
    )

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["head"])
        end = begin + F.length(part["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(
            (end + len(CLOSE)).alias("at"), F.when(part["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans")
        )

    return whole, F.aggregate(parts, start, step, lambda s: s["spans"])


def format_trees(tree: DataFrame, branches: int | None = 1, trained: str = "assistant") -> DataFrame:
    """(conv_id, branch, formatted, loss_spans): one row per chosen path of every tree.

    One text per conversation is the result itself; texts are joined to their paths at the end
    only, and moved once.
    """
    enumerated = paths(tree)
    chosen = enumerated.join(rank_paths(enumerated, branches), "leaf")
    turns = chosen.join(tree.select("id", "conv_id", "role", "text"), "id")
    gathered = turns.groupBy("leaf", "branch", "conv_id").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns")
    )
    whole, spans = format_turns(F.col("turns"), trained)
    return gathered.select("conv_id", "branch", whole.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    pieces = F.filter(F.split(formatted, "\\Q" + CLOSE + "\\E", -1), lambda p: p.startswith(OPEN))
    return F.transform(
        pieces,
        lambda p: let(
            F.split(F.substring(p, len(OPEN) + 1, 1 << 30), "\\Q" + MIDDLE + "\\E", 2),
            lambda s: F.struct(unescape(F.get(s, F.lit(0))).alias("role"), unescape(F.get(s, F.lit(1))).alias("text")),
        ),
    )


def under_mask(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    cut = F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return F.array_join(cut, "")
