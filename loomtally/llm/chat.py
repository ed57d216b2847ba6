"""Chat formatting of reply trees, in DataFrame functions only.

Messages name their parent; a message without one, or whose parent is missing, is a root. Root-to-leaf paths are enumerated by
iterative self-joins that double the distance covered each time, so a tree of depth d needs about log2(d) of them. A branch's score
is the sum of its messages' scores; branches of a tree are ranked by score, then length, then leaf id, and the first `branches` of
them become one conversation each.

A turn is formatted as `<|turn|>ROLE<|text|>TEXT<|end|>` and a newline. In roles and texts every `<`, `[` and backslash is followed
by an added backslash, so no control string that starts with one of the first two (`<|end|>`, `</s>`, `[INST]`, ...) can stand in
them; `unescape` takes the added characters away again.

Defined results: null texts and roles count as empty; a null tree is a tree of its own; messages on a cycle of parents have no root and are in no path; repeated
messages (same tree and id) count once, as the one that is least by parent, role, text and score; messages with a null id are left out, as nothing
can name them; an empty table gives an empty result; other input columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtally.llm.shared import written

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
TRAINED_ROLES = ("assistant",)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", r"$1")


def each_once(messages: DataFrame) -> DataFrame:
    """One row of each tree and id."""
    rest = [c for c in ("parent", "role", "text", "score") if c in messages.columns]
    least = messages.where("id is not null").groupBy("tree", "id").agg(F.min(F.struct(*rest)).alias("m"))
    return least.select("tree", "id", "m.*")


def reply_paths(messages: DataFrame, unique: bool = False) -> DataFrame:
    """messages: tree, id, parent (null at a root). Returns tree, leaf, id, up: every message of every root-to-leaf path with its
    distance from the leaf. The number of rows is the summed length of the paths. unique: whether no tree and id are repeated, so that
    nothing need be looked for."""
    messages = messages if unique else each_once(messages)
    # Inside a struct a null tree is a key like any other, which joins find.
    nodes = messages.select(F.struct("tree").alias("tree"), "id", "parent")
    known = nodes.select(F.col("tree").alias("_t"), F.col("id").alias("_i"))
    # A parent that isn't there makes its children roots.
    nodes = nodes.join(known, (F.col("tree") == F.col("_t")) & (F.col("parent") == F.col("_i")), "left").select("tree", "id", F.col("_i").alias("parent"))
    nodes = written(nodes, "nodes")
    # Jump tables of the distances 1, 2, 4, ... No chain is longer than its tree, so what still jumps beyond that reaches a cycle.
    longest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jump = nodes.where("parent is not null").select("tree", "id", F.col("parent").alias("to"))
    jumps, step = [], 1
    while step <= longest and not jump.isEmpty():
        jumps.append(jump)
        further = jump.select("tree", F.col("id").alias("to"), F.col("to").alias("_far"))
        jump = written(jump.join(further, ["tree", "to"]).select("tree", "id", F.col("_far").alias("to")), "jumps")
        step *= 2
    inner = nodes.where("parent is not null").select("tree", F.col("parent").alias("id")).distinct()
    leaves = nodes.join(inner, ["tree", "id"], "left_anti").join(jump.select("tree", "id"), ["tree", "id"], "left_anti")
    paths = written(leaves.select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up")), "paths")
    for k, table in enumerate(jumps):
        # Each path, known up to a distance below 2 ** k, gets the ancestors at the distances below 2 ** (k + 1).
        ahead = paths.join(table, ["tree", "id"]).select("tree", "leaf", F.col("to").alias("id"), (F.col("up") + (1 << k)).alias("up"))
        paths = written(paths.unionByName(ahead), "paths")
    return paths.withColumn("tree", F.col("tree.tree"))


def ranked_branches(messages: DataFrame, branches: int = 1, unique: bool = False) -> DataFrame:
    """messages: tree, id, parent, role, text, score. Returns the messages of the chosen branches with conversation (its rank in
    the tree), position (from the root, from 0) and leaf."""
    messages = messages if unique else each_once(messages)
    paths = reply_paths(messages, True).withColumn("tree", F.struct("tree"))
    body = messages.select(F.struct("tree").alias("tree"), "id", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    full = paths.join(body, ["tree", "id"])
    scored = full.groupBy("tree", "leaf").agg(F.sum("score").alias("_score"), F.count("*").alias("_n"))
    rank = Window.partitionBy("tree").orderBy(F.col("_score").desc(), F.col("_n").desc(), "leaf")
    chosen = scored.withColumn("conversation", F.row_number().over(rank) - 1).where(F.col("conversation") < branches)
    out = full.join(chosen, ["tree", "leaf"])
    return out.select(F.col("tree.tree").alias("tree"), "leaf", "conversation", (F.col("_n") - 1 - F.col("up")).alias("position"), "role", "text")


def format_conversations(messages: DataFrame, branches: int = 1, trained_roles: tuple[str, ...] = TRAINED_ROLES, unique: bool = False) -> DataFrame:
    """One row per chosen branch: tree, conversation, n_turns, formatted, and loss_spans, the (start, length) code point ranges of
    `formatted` under the loss mask."""
    turns = ranked_branches(messages, branches, unique)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = turns.select("tree", "conversation", "position", role.alias("role"), escape(text).alias("_text"), F.concat(F.lit(TURN), escape(role), F.lit(TEXT)).alias("_head"))
    turns = turns.withColumn("_piece", F.concat("_head", "_text", F.lit(END)))
    along = Window.partitionBy("tree", "conversation").orderBy("position")
    start = F.sum(F.length("_piece")).over(along) - F.length("_piece") + F.length("_head")
    turns = turns.withColumn("_span", F.when(F.col("role").isin(*trained_roles), F.struct(start.cast("long").alias("start"), F.length("_text").cast("long").alias("length"))))
    grouped = turns.groupBy("tree", "conversation").agg(F.array_sort(F.collect_list(F.struct("position", "_piece", "_span"))).alias("_all"))
    return grouped.select(
        "tree",
        "conversation",
        F.size("_all").cast("long").alias("n_turns"),
        F.array_join(F.transform("_all", lambda x: x["_piece"]), "").alias("formatted"),
        F.filter(F.transform("_all", lambda x: x["_span"]), lambda x: x.isNotNull()).alias("loss_spans"),
    )


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """Reads `formatted` back: adds turns, an array of (role, text), and loss, the unescaped texts under the mask, in order."""
    pieces = F.slice(F.split("formatted", r"<\|turn\|>", -1), 2, F.size(F.split("formatted", r"<\|turn\|>", -1)))
    turns = F.transform(
        pieces,
        lambda x: F.struct(
            unescape(F.substring_index(x, TEXT, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(x, END, 1), TEXT, -1)).alias("text"),
        ),
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumn("turns", turns).withColumn("loss", loss)


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Reply trees of (conv_id, turn, role, text) rows: each turn answers the one before it. Ties of turn go by role, then text."""
    along = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "role", "text", F.row_number().over(along).cast("long").alias("id"))
    return numbered.select(
        F.col("conv_id").alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )
