"""Chat formatting of reply trees.

Messages form trees by (tree, node, parent).  Iterative self-joins with pointer
doubling first sum the scores from every message up to its root, with one row a
message, so branches are ranked before any path is listed.  The same jumps then
list the chosen leaves' paths: after round ``k`` a path holds the leaf's nearest
``2**k`` ancestors.  A chain of ``d`` replies takes about ``2 log2 d`` joins.

Each chosen path becomes one conversation in a template whose marks cannot occur
inside texts: a control string in a text gets a backslash after its first
character, which reading back removes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

# The template's marks.
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
#: What may follow "<" or "[" in a control string, of this template or common others.
_REST = r"\|[a-z_]+\|>|/?s>|/?INST\]|</?SYS>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={_REST})", r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={_REST})", "$1$2")


def root_to_leaf_paths(nodes: DataFrame, best: int | None = 1, rounds: int = 40) -> DataFrame:
    """Paths of each tree's ``best`` branches (None: all): ``tree, leaf, rank, node, depth``.

    ``nodes`` has ``tree, node, parent`` (null: a root) and ``score``; (tree, node)
    is unique.  A branch scores the sum of its nodes' scores, null as 0; ties go
    to the smaller leaf.  ``depth`` counts from the root, 0 first.  Replies to a
    missing parent start a path of their own.  A null tree is one tree; an empty
    table gives an empty result; replies in a cycle raise.
    """
    own = staged(nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")), "nodes")
    there = own.select(F.col("tree").alias("t2"), F.col("node").alias("n2"))
    linked = own.join(there, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("parent") == F.col("n2")), "left")
    # after round k: up is 2**k above node, null beyond the root; total and steps are of the nodes from node to before up
    walk = staged(linked.select("tree", "node", F.col("n2").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("steps")), "walk")
    jumps = []
    for _ in range(rounds):
        open_ones = walk.filter("up IS NOT NULL")
        if open_ones.isEmpty():
            break
        jumps.append(open_ones.select("tree", "node", "up"))
        above = walk.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("up").alias("u2"), F.col("total").alias("more"), F.col("steps").alias("s2"))
        moved = open_ones.join(above, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("up") == F.col("n2")))
        moved = moved.select("tree", "node", F.col("u2").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("steps") + F.col("s2")).alias("steps"))
        walk = staged(walk.filter("up IS NULL").unionByName(moved), "walk")
    else:
        raise ValueError("replies form a cycle")
    if not jumps:
        jumps.append(walk.filter("up IS NOT NULL").select("tree", "node", "up"))
    parents = jumps[0].select(F.col("tree").alias("t2"), F.col("up").alias("n2")).distinct()
    leaves = walk.join(parents, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2")), "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.col("total").desc(), "node")))
    if best is not None:
        ranked = ranked.filter(F.col("rank") <= best)
    path = staged(ranked.select("tree", F.col("node").alias("leaf"), "rank", "node", (F.col("steps") - 1).alias("depth")), "paths")
    for k, jump in enumerate(jumps):
        step = jump.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("up").alias("u2"))
        higher = path.join(step, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2")))
        path = staged(path.unionByName(higher.select("tree", "leaf", "rank", F.col("u2").alias("node"), (F.col("depth") - 2**k).alias("depth"))), "paths")
    return path.withColumn("depth", F.col("depth").cast("int"))


def format_paths(messages: DataFrame, paths: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per chosen path: ``tree, leaf, rank, formatted, loss``.

    ``messages`` has ``tree, node, role, text`` (null role or text: empty).
    ``loss`` lists struct(start, length) of the escaped texts of ``loss_role`` in
    ``formatted``, in code points, in order.
    """
    said = messages.select(
        F.col("tree").alias("t2"), F.col("node").alias("n2"),
        escaped(F.coalesce(F.col("role").cast("string"), F.lit(""))).alias("role"),
        escaped(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    )
    turns = paths.join(said, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2")))
    rows = turns.groupBy("tree", "leaf", "rank").agg(
        F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns")
    )
    piece = lambda t: F.concat(F.lit(TURN), t["role"], F.lit(BODY), t["text"], F.lit(END))
    loss = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(piece(t))).alias("at"),
            F.when(
                t["role"] == loss_role,
                F.concat(
                    s["spans"],
                    F.array(F.struct((s["at"] + len(TURN + BODY) + F.length(t["role"])).alias("start"), F.length(t["text"]).alias("length"))),
                ),
            ).otherwise(s["spans"]).alias("spans"),
        ),
    )["spans"]
    return rows.select("tree", "leaf", "rank", F.array_join(F.transform("turns", piece), "").alias("formatted"), loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """array of struct(role, text), read back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda p: p != "")
    parts = lambda p: F.split(p, r"<\|text\|>|<\|end\|>", -1)
    return F.transform(pieces, lambda p: F.struct(unescaped(parts(p)[0]).alias("role"), unescaped(parts(p)[1]).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def linear_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turn rows as reply trees: ``tree, node, parent, score, role, text``.

    Each row replies to the one before it in its conversation, by turn, then role
    and text, null first; repeated rows are turns of their own, a null
    conversation id is one conversation.  A turn scores the length of its text.
    """
    rows = turns.select(
        F.col(conv_col).alias("tree"), F.col(turn_col).alias("__turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")
    )
    order = Window.partitionBy("tree").orderBy("__turn", "role", "text")
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("score"), "role", "text"
    )


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Format linear conversations (``conv_id, turn, role, text``) as trees of one branch."""
    messages = staged(linear_conversations(turns), "messages")
    return format_paths(messages, root_to_leaf_paths(messages), loss_role).withColumnRenamed("tree", "conv_id")
