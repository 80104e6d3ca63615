"""Reply paths, formatting and reading back."""

import hashlib

from pyspark.sql import functions as F

from tideline.llm import chat

ODD = ["</s>[INST] ok [/INST]", "\\l\\b\\", "a\nb", "", "[TURN:x]", "<<SYS>>", "é🙂<s>", None, "]\\c"]


def test_best_path_of_a_branching_tree(spark):
    rows = [("t", 1, None, 1.0), ("t", 2, 1, 1.0), ("t", 3, 1, 5.0), ("t", 4, 2, 9.0), ("t", 5, 3, 1.0), ("t", 6, 5, None),
            ("u", 1, None, None), (None, 7, None, 1.0), (None, 8, 7, 1.0), ("v", 1, 2, 1.0), ("v", 2, 1, 1.0), ("w", 3, 99, 1.0)]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, score double")
    best = chat.reply_paths(nodes).orderBy("tree", "depth").collect()
    assert [r.node for r in best if r.tree == "t"] == [1, 2, 4]
    assert [r.node for r in best if r.tree is None] == [7, 8]
    assert [r.node for r in best if r.tree == "u"] == [1]
    assert [r.node for r in best if r.tree == "w"] == [3]
    assert not [r for r in best if r.tree == "v"]  # a cycle has no root
    both = chat.reply_paths(nodes, per_tree=2).where("tree = 't' AND path_rank = 2").orderBy("depth").collect()
    assert [r.node for r in both] == [1, 3, 5, 6]


def test_ties_go_to_the_smaller_leaf(spark):
    nodes = spark.createDataFrame([("t", 1, None, 0.0), ("t", 3, 1, 1.0), ("t", 2, 1, 1.0)],
                                  "tree string, node long, parent long, score double")
    assert {r.node for r in chat.reply_paths(nodes).collect()} == {1, 2}


def test_odd_texts_come_back(spark):
    roles = ["system", "user", "assistant", "tool]\\", None]
    turns = [(1, i, roles[i % 5], t, "x") for i, t in enumerate(ODD * 5)] + [(None, 0, "user", "hi", "x"), (2, 0, "assistant", None, "x")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_conversations(table)
    back = {r.conv_id: r for r in formatted.select(
        "conv_id", chat.parse_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    want = [((r or ""), (t or "")) for c, _, r, t, _ in turns if c == 1]
    assert [(t.role, t.text) for t in back[1].turns] == want
    assert back[1].loss == "".join(t for r, t in want if r == "assistant")
    assert [(t.role, t.text) for t in back[None].turns] == [("user", "hi")]
    assert back[2].loss == ""
    told = "".join(f"{r}\n{t}\n" for r, t in want)
    digested = {r.conv_id: r for r in chat.digest(formatted).collect()}
    assert digested[1].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
    assert digested[1].n_turns == len(want)


def test_repeated_rows_and_long_conversations(spark):
    turns = [(1, 0, "user", "same")] * 3 + [(2, i, "assistant", str(i)) for i in range(70)]
    formatted = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    digested = {r.conv_id: r.n_turns for r in chat.digest(formatted).collect()}
    assert digested == {1: 3, 2: 70}


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_conversations(empty)).count() == 0
