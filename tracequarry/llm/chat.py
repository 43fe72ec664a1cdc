"""Chat formatting of reply trees (operator 5).

Messages of a tree point to the message that they reply to. Self-joins that double their reach list every path from a leaf
up to the root, branches are ranked by score, and each chosen path becomes one formatted conversation.

Template: <|start|>ROLE<|sep|>TEXT<|end|> for each turn. Inside roles and texts a backslash follows each of the
characters < [ and backslash, so no control string of this or a similar template can stand in them; reading back drops it.

Nulls: null roles and texts are empty; a null score is 0. A message without a parent in its tree is a root. Replies that form a
cycle have no leaf and so no path. Rows of a conversation that share a turn follow each other by role and text. Empty
table: no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.llm._store import stored

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([<\[\\])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def as_trees(conversations: DataFrame) -> DataFrame:
    """Plain conversations (conv_id, turn, role, text) as reply trees in which every row replies to the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    return conversations.select(F.col("conv_id").alias("tree"), node.alias("node"), "role", "text").withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every message on the way from each leaf to its root; up counts the steps from the leaf.

    messages: tree, node, parent. After k rounds a row reaches 2^k steps up, so a thread of n turns takes log2(n) joins.
    Only ids move; the result has as many rows as the paths have messages.
    """
    key = F.coalesce(F.col("tree").cast("string"), F.lit("\0")).alias("tree_key")
    nodes = stored(messages.select(key, "node", "parent"), "chat-nodes")
    known = nodes.select("tree_key", F.col("node").alias("parent"))
    jump = nodes.where(F.col("parent").isNotNull()).join(known, ["tree_key", "parent"], "left_semi").select("tree_key", "node", F.col("parent").alias("above"))
    leaves = nodes.join(nodes.select("tree_key", F.col("parent").alias("node")), ["tree_key", "node"], "left_anti")
    reach = leaves.select("tree_key", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    step = 1
    jump = stored(jump, "chat-jump-1")
    while not jump.isEmpty() and step < 1 << 40:
        more = reach.join(jump, ["tree_key", "node"]).select("tree_key", "leaf", F.col("above").alias("node"), (F.col("up") + step).alias("up"))
        reach = stored(reach.unionByName(more), f"chat-reach-{step}")
        if more.where(F.col("up") >= step).isEmpty():
            break
        jump = stored(jump.join(jump.select("tree_key", F.col("node").alias("above"), F.col("above").alias("next")), ["tree_key", "above"]).select("tree_key", "node", F.col("next").alias("above")), f"chat-jump-{2 * step}")
        step *= 2
    return reach


def formatted(messages: DataFrame, best: int | None = 1, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each chosen branch: tree, leaf, branch_rank, branch_score, formatted, and loss_spans, the code points
    (start, end) of `formatted` under the loss mask. best: how many branches of a tree are chosen; None takes all.

    messages: tree, node, parent, role, text, score. A branch's score is the mean of its messages'; ties go to the lower leaf.
    """
    key = F.coalesce(F.col("tree").cast("string"), F.lit("\0")).alias("tree_key")
    reach = paths(messages)
    scores = reach.join(messages.select(key, "node", F.coalesce("score", F.lit(0.0)).alias("score")), ["tree_key", "node"])
    branches = scores.groupBy("tree_key", "leaf").agg(F.avg("score").alias("branch_score"), F.max("up").alias("depth"))
    rank = F.row_number().over(Window.partitionBy("tree_key").orderBy(F.desc("branch_score"), "leaf"))
    branches = branches.withColumn("branch_rank", rank)
    if best is not None:
        branches = branches.where(F.col("branch_rank") <= best)
    role, text = escaped(F.col("role")), escaped(F.col("text"))
    turns = messages.select(key, "tree", "node", F.col("role").isin(*loss_roles).alias("loss"), F.concat(F.lit(START), role, F.lit(SEP)).alias("head"), text.alias("body"))
    turns = reach.join(branches, ["tree_key", "leaf"]).join(turns, ["tree_key", "node"]).withColumn("place", F.col("depth") - F.col("up"))
    size = F.length("head") + F.length("body") + len(END)
    before = F.coalesce(F.sum(size).over(Window.partitionBy("tree_key", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("from", before + F.length("head"))
    span = F.when(F.coalesce("loss", F.lit(False)), F.struct(F.col("from").alias("start"), (F.col("from") + F.length("body")).alias("end")))
    turns = turns.select("tree_key", "leaf", "tree", "branch_rank", "branch_score", F.struct("place", F.concat("head", "body", F.lit(END)).alias("turn"), span.alias("span")).alias("at"))
    whole = turns.groupBy("tree_key", "leaf").agg(F.first("tree").alias("tree"), F.first("branch_rank").alias("branch_rank"), F.first("branch_score").alias("branch_score"), F.sort_array(F.collect_list("at")).alias("at"))
    spans = F.filter(F.transform("at", lambda x: x["span"]), lambda s: s.isNotNull())
    return whole.select("tree", "leaf", "branch_rank", "branch_score", F.array_join(F.transform("at", lambda x: x["turn"]), "").alias("formatted"), spans.alias("loss_spans"))


def turns_of(formatted_text: Column) -> Column:
    """Reads the turns (role, text) back out of a formatted conversation."""
    pieces = F.filter(F.split(formatted_text, r"<\|start\|>"), lambda p: p != "")
    half = lambda p, k: F.split(p, r"<\|sep\|>|<\|end\|>", -1)[k]
    return F.transform(pieces, lambda p: F.struct(unescaped(half(p, 0)).alias("role"), unescaped(half(p, 1)).alias("text")))


def loss_texts(formatted_text: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescaped(F.substring(formatted_text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
