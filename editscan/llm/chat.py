"""Reply trees formatted as conversations.

A node names its parent within its tree. Iterative self-joins double the distance to which
ancestors are known, so a path of depth d takes log2(d) rounds; only leaves carry their path, one
row per member, so rows stay in proportion to the output. Texts join once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running_sums, stage

OPEN, MID, CLOSE = "<turn ", ">\n", "</turn>\n"


def escape(c: Column) -> Column:
    """Reversible, and free of ``<`` and ``>``, so no control string can occur in a text or role."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    parts = F.transform(F.split(c, r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")))
    return F.array_join(parts, "\\")


def root_to_leaf_paths(nodes: DataFrame) -> DataFrame:
    """nodes (tree, node, parent) as members (tree, leaf, node, up): ``up`` steps above the leaf.

    A parent that is null or not in the tree makes a root. Nodes on a cycle, or below one, have
    no root and no path. Ids are to be unique and not null within a tree, as format_reply_trees
    makes them; tree may be null.
    """
    n = stage(nodes.select(F.coalesce(F.concat(F.lit("t"), F.col("tree").cast("string")), F.lit("")).alias("k"), "node", "parent"), "nodes")
    have = n.select("k", F.col("node").alias("parent"))
    jump = n.join(have, ["k", "parent"]).select("k", "node", F.col("parent").alias("up"))
    inner = jump.select("k", F.col("up").alias("node")).distinct()
    members = n.join(inner, ["k", "node"], "left_anti").select("k", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    jump, members, step, size = stage(jump, "jumps"), stage(members, "members"), 1, max(1, n.count())
    while step <= size and not jump.isEmpty():
        more = members.join(jump.select("k", "node", F.col("up").alias("anc")), ["k", "node"]).select("k", "leaf", F.col("anc").alias("node"), (F.col("up") + step).alias("up"))
        members = stage(members.unionByName(more), "members")
        jump = stage(jump.join(jump.select("k", F.col("node").alias("up"), F.col("up").alias("far")), ["k", "up"]).select("k", "node", F.col("far").alias("up")), "jumps")
        step *= 2
    if not jump.isEmpty():
        # What still has an ancestor this far up hangs below a cycle.
        lost = jump.select("k", F.col("node").alias("leaf")).distinct()
        members = members.join(lost, ["k", "leaf"], "left_anti")
    return members


def format_reply_trees(messages: DataFrame, best: int | None = None) -> DataFrame:
    """messages (tree, node, parent, role, text, score) as conversations.

    One row per chosen path: tree, leaf, rank, path_score (mean of the scores, null as 0),
    n_turns, formatted. Paths of a tree rank by score, then by leaf; ``best`` keeps the first
    so many (null: all). Null role or text is empty; empty texts are turns; other columns are
    ignored; an empty table gives no rows. Rows of one node are one turn, the first by parent,
    role, text and score, nulls first; a row without a node id is none.
    """
    one = Window.partitionBy("tree", "node").orderBy("parent", "role", "text", "score")
    messages = messages.where("node is not null").select("tree", "node", "parent", "role", "text", "score").withColumn("_r", F.row_number().over(one)).where("_r = 1").drop("_r")
    tree_key = F.coalesce(F.concat(F.lit("t"), F.col("tree").cast("string")), F.lit(""))
    members = root_to_leaf_paths(messages)
    light = messages.select(tree_key.alias("k"), "node", F.coalesce("score", F.lit(0)).cast("double").alias("score"))
    ranked = members.join(light, ["k", "node"]).groupBy("k", "leaf").agg(F.avg("score").alias("path_score"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("path_score"), "leaf")))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    body = messages.select(tree_key.alias("k"), F.col("tree"), "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = members.join(ranked, ["k", "leaf"]).join(body, ["k", "node"])
    turn = F.struct((-F.col("up")).alias("at"), F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MID), escape(F.col("text")), F.lit(CLOSE)).alias("s"))
    made = turns.groupBy("k", "leaf").agg(F.first("tree").alias("tree"), F.first("rank").alias("rank"), F.first("path_score").alias("path_score"), F.count("*").alias("n_turns"), F.sort_array(F.collect_list(turn)).alias("all"))
    return made.select("tree", "leaf", "rank", "path_score", "n_turns", F.array_join(F.transform("all", lambda x: x["s"]), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """The formatted string's turns as array<struct<role, text, raw, start>>: ``raw`` is the escaped text, ``start`` its first code point."""
    chunks = F.filter(F.split(formatted, CLOSE), lambda x: x != "")
    turn = lambda x: F.struct(F.substring_index(F.substring(x, len(OPEN) + 1, 1 << 30), MID, 1).alias("role"), F.substr(x, F.instr(x, MID) + len(MID)).alias("raw"), F.length(x).alias("n"))
    parsed = F.transform(chunks, turn)
    return F.transform(parsed, lambda x: F.struct(unescape(x["role"]).alias("role"), unescape(x["raw"]).alias("text"), x["raw"].alias("raw"), x["n"].alias("n")))


def loss_mask(turns: Column, role: str = "assistant") -> Column:
    """Spans (start, end) in code points of the escaped texts of a role, in order."""
    ends = running_sums(F.transform(turns, lambda x: x["n"] + len(CLOSE)))
    spans = F.zip_with(turns, ends, lambda x, end: F.when(x["role"] == role, F.struct((end - len(CLOSE) - F.length(x["raw"])).alias("start"), (end - len(CLOSE)).alias("end"))))
    return F.filter(spans, lambda x: x.isNotNull())
