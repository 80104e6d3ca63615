"""Reply trees to chat texts: paths by iterative self-joins, ranking, formatting.

Everything is DataFrame operations.  A tree's paths come from pointer doubling: the
table of each node's ancestor 2**k steps up is joined with itself, so trees of
depth d take log2(d) joins, and only chosen paths are ever spelled out.

The text of a path is::

    <s>                      once, at the start
    <<SYS>>text<</SYS>>      a system turn
    [INST]text[/INST]        a user turn
    [OUT]text</s>            an assistant turn, which the loss covers
    [TURN:role]text[/TURN]   any other turn

Inside texts and role names ``\\``, ``<`` and ``[`` become ``\\b``, ``\\l`` and ``\\o``,
so no control string can appear there, and ``unescape`` gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import stored

# Opening and closing marks of the known roles.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")}
START = "<s>"


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), ("[", "\\o")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in (("[", "\\o"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def reply_paths(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """The best ``per_tree`` root-to-leaf paths of each reply tree.

    ``nodes`` has tree, node, parent (null: a root) and score, and other columns
    that are kept.  A node is named by (tree, node); equal names in all columns
    are one node.  Null trees are a tree of their own.  A parent that does not
    exist makes its child a root, and nodes on a cycle are on no path.  A path
    scores the sum of its nodes' scores (null: 0); ties go to the smaller leaf.
    Returns the columns of ``nodes`` with path_rank (from 1), leaf and depth
    (from 0, the root), a row per node of each chosen path.
    """
    nodes = stored(nodes.distinct().withColumn("_tree", F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit(""))), "chat-nodes")
    known = nodes.select("_tree", "node").distinct()
    link = nodes.select("_tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    link = link.join(known.withColumnRenamed("node", "_known"),
                     (link["parent"] == F.col("_known")) & (link["_tree"] == known["_tree"]), "left").select(
        link["_tree"], link["node"], F.col("_known").alias("up"), "score")
    # Round k: ``up`` is the ancestor 2**k steps up, ``steps`` and ``total`` cover the way to it.
    link = stored(link.withColumn("steps", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long"))
                  .withColumnRenamed("score", "total"), "chat-link")
    is_parent = link.where("up IS NOT NULL").select("_tree", F.col("up").alias("node")).distinct()
    # Nodes that have reached their root are done; only the others are joined again, so
    # a few long conversations do not carry the short ones through their rounds.
    jumps: list[DataFrame] = []
    done = link.where("up IS NULL")
    longest = nodes.count()
    moving = link.where("up IS NOT NULL")
    while moving.limit(1).count() and (1 << len(jumps)) <= 2 * longest:
        jumps.append(moving.select("_tree", "node", "up"))
        above = done.unionByName(moving).select(
            F.col("_tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"),
            F.col("steps").alias("_steps"), F.col("total").alias("_total"))
        moved = stored(
            moving.join(above, (moving["_tree"] == above["_t"]) & (moving["up"] == above["_n"])).select(
                "_tree", "node", F.col("_up").alias("up"),
                (F.col("steps") + F.col("_steps")).alias("steps"),
                (F.col("total") + F.col("_total")).alias("total"),
            ), "chat-link")
        done = done.unionByName(moved.where("up IS NULL"))
        moving = moved.where("up IS NOT NULL")
    leaves = done.join(is_parent, ["_tree", "node"], "left_anti")
    order = Window.partitionBy("_tree").orderBy(F.col("total").desc(), F.col("node"))
    best = leaves.withColumn("path_rank", F.row_number().over(order)).where(F.col("path_rank") <= per_tree)
    path = stored(best.select("_tree", "path_rank", F.col("node").alias("leaf"), "node", F.col("steps").alias("depth")),
                  "chat-path")
    # From the longest jumps down, each node adds the one that many steps above it.
    for k in range(len(jumps) - 1, -1, -1):
        step = jumps[k]
        more = path.join(step, ["_tree", "node"]).select(
            "_tree", "path_rank", "leaf", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        path = stored(path.unionByName(more), "chat-path")
    return path.join(nodes, ["_tree", "node"]).drop("_tree")


def format_turns(turns: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per conversation: the formatted text and the spans under the loss mask.

    ``turns`` has ``keys``, ``order``, role and text.  Turns are put in order of
    ``order``, ties by role and text; null texts and roles are empty.  Returns
    the keys, formatted, and loss_spans, an array of (start, length) in code
    points of ``formatted``, start from 0.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    opening = F.concat(F.lit("[TURN:"), escape(F.replace(F.col("role"), F.lit("]"), F.lit("\\c"))), F.lit("]"))
    closing: Column = F.lit("[/TURN]")
    for name, (left, right) in MARKS.items():
        opening = F.when(F.col("role") == name, F.lit(left)).otherwise(opening)
        closing = F.when(F.col("role") == name, F.lit(right)).otherwise(closing)
    # A role's "]" must not end its mark; it is coded after the escape of "\".
    opening = F.when(
        F.col("role").isin(*MARKS), opening
    ).otherwise(F.concat(F.lit("[TURN:"), F.replace(escape(F.col("role")), F.lit("]"), F.lit("\\c")), F.lit("]")))
    rows = turns.select(*keys, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                        role.alias("role"), text.alias("text"))
    packed = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(
            *[F.col(f"_o{i}") for i in range(len(order))], "role", "text",
            opening.alias("opening"), escape(F.col("text")).alias("body"), closing.alias("closing"),
        ))).alias("turns")
    )
    pieces = F.transform("turns", lambda t: F.concat(t["opening"], t["body"], t["closing"]))
    formatted = F.concat(F.lit(START), F.array_join(pieces, ""))
    walked = F.aggregate(
        "turns",
        F.struct(F.lit(len(START)).cast("long").alias("at"),
                 F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["opening"]) + F.length(t["body"]) + F.length(t["closing"])).cast("long").alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(t["opening"])).cast("long").alias("start"),
                F.length(t["body"]).cast("long").alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return packed.select(*keys, formatted.alias("formatted"), walked["spans"].alias("loss_spans"))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted text."""
    pieces = F.regexp_extract_all(
        formatted, F.lit(r"(<<SYS>>[^<]*<</SYS>>|\[INST\][^\[]*\[/INST\]|\[OUT\][^<]*</s>|\[TURN:[^\]]*\][^\[]*\[/TURN\])"), F.lit(1))

    def turn(piece: Column) -> Column:
        role = unescape(F.replace(F.regexp_extract(piece, r"^\[TURN:([^\]]*)\]", 1), F.lit("\\c"), F.lit("]")))
        left = F.length(F.regexp_extract(piece, r"^(\[TURN:[^\]]*\])", 1))
        right: Column = F.lit(len("[/TURN]"))
        for name, (opens, closes) in MARKS.items():
            here = F.startswith(piece, F.lit(opens))
            role = F.when(here, F.lit(name)).otherwise(role)
            left = F.when(here, F.lit(len(opens))).otherwise(left)
            right = F.when(here, F.lit(len(closes))).otherwise(right)
        body = F.substring(piece, left + 1, F.length(piece) - left - right)
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(
        spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def linear_trees(turns: DataFrame) -> DataFrame:
    """Turns of conversations as reply trees: each turn answers the one before it.

    Rows with the same conversation, turn, role and text stay apart.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.select("conv_id", "turn", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    return placed.select(
        F.col("conv_id").alias("tree"), "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        F.lit(1.0).alias("score"), "turn", "role", "text",
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """Each conversation's best reply path as one formatted text.

    ``turns`` has conv_id, turn, role and text; other columns are ignored.  Rows
    go by turn, ties by role and text (nulls first), and repeated rows are turns
    of their own.  Rows with a null conv_id are one conversation.  A
    conversation of any number of turns is one text, as its reader needs it.
    """
    paths = reply_paths(linear_trees(turns))
    return format_turns(paths.withColumnRenamed("tree", "conv_id"), ["conv_id"], ["depth"])


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations, read back from the output."""
    turns = parse_turns(F.col("formatted"))
    masked = formatted.select("conv_id", "formatted", turns.alias("turns"),
                              loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return masked.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
