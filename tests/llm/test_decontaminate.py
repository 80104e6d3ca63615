"""Benchmark windows against a plain reading of every text."""

import random
import re

from pyspark.sql import functions as F

from tideline.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text, items):
    words = WORD.findall(lower(text))
    hit, met = set(), set()
    for item, item_text in items:
        own = WORD.findall(lower(item_text))
        size = min(10, len(own))
        if not size:
            continue
        grams = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i:i + size]) in grams:
                hit.update(range(i, i + size))
                met.add("" if item is None else str(item))
    return len(words), len(hit), sorted(met)


def texts(seed=3):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "ç", "d1", "e", "été"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice((0, 1, 3, 10, 14))))) for i in range(12)]
    items += [(99, None), (None, "zz yy xx"), (100, "solo!"), (101, items[3][1])]
    docs = []
    for i in range(60):
        body = rng.choices(vocabulary, k=rng.randint(0, 30))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(body))
            body[at:at] = (rng.choice(items)[1] or "").split()
        docs.append((i, rng.choice((" ", ", ", "\n")).join(body)))
    return docs + [(60, None), (61, ""), (62, "Solo ZZ yy xx"), (62, "Solo ZZ yy xx"), (63, "é" * 2_000_000 + " solo")], items


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, items string"),
            spark.createDataFrame(items, "item_id long, text string"))


def check(found, docs, items):
    got = sorted((r.doc_id, r.n_words, r.n_hit, list(r.items)) for r in found.select(
        "doc_id", "n_words", dc.hit_words().alias("n_hit"), "items").collect())
    assert got == sorted((i, *brute(t, items)) for i, t in docs)


def test_windows_match_brute_force(spark):
    docs, items = texts()
    check(dc.benchmark_hits(*frames(spark, docs, items), ["doc_id"]), docs, items)


def test_rounds_give_the_same(spark):
    docs, items = texts(5)
    docs = [*dict(docs).items()]
    check(dc.benchmark_hits(*frames(spark, docs, items), ["doc_id"], broadcast_windows=7), docs, items)


def test_rounds_keep_every_row(spark):
    docs, items = texts(7)
    # Repeated, null-id and wordless rows, and equal ids with different texts.
    docs += [(None, docs[5][1]), (None, docs[6][1]), (None, "..."), (None, None), (5, docs[9][1]), (60, None), (61, ""), (61, ""),
             (70, "x" * 400 + " " + " ".join(["y" * 90] * 9))]
    items.append((102, "x" * 400 + " " + " ".join(["y" * 90] * 9)))
    some = frames(spark, docs, items)
    found = dc.benchmark_hits(*some, ["doc_id"], broadcast_windows=7)
    key = lambda row: (-1 if row[0] is None else row[0], *row[1:])
    got = sorted((key((r.doc_id, r.n_words, r.n_hit, list(r.items))) for r in found.select(
        "doc_id", "n_words", dc.hit_words().alias("n_hit"), "items").collect()))
    assert got == sorted(key((i, *brute(t, items))) for i, t in docs)
    left = [sorted(key((r.doc_id, r.text or "", r.text is None)) for r in dc.remove_spans(*some, broadcast_windows=n).collect())
            for n in (7, dc.BROADCAST_WINDOWS)]
    assert left[0] == left[1]
    kept = [(i, t) for i, t in docs if not brute(t, items)[1] * 2 > brute(t, items)[0]]
    assert [row[0] for row in left[0]] == sorted(key((i,))[0] for i, _ in kept)


def test_spans_go_and_clean_texts_stay(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, f"Keep é this, {item.upper()}. And this as well, all of it.", 0), (2, "clean text\n stays", 17), (3, item, 5), (4, None, 0), (5, "", 0)]
    table = spark.createDataFrame(docs, "doc_id long, text string, n_chars long").withColumn("_row", F.lit(1))
    out = {r.doc_id: r for r in dc.remove_spans(table, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(out) == {1, 2, 4, 5}
    assert out[1].text == "Keep é this, . And this as well, all of it." and out[1].n_chars == len(out[1].text)
    assert out[2].n_chars == 17 and out[4].n_chars == 0
    assert out[2].text == "clean text\n stays" and out[4].text is None and out[5].text == ""
    assert set(out[1].asDict()) == {"doc_id", "text", "n_chars", "_row"}


def test_empty_tables(spark):
    docs, items = texts()
    some, none = frames(spark, docs, items), frames(spark, [], [])
    assert dc.benchmark_hits(none[0], some[1], ["doc_id"]).count() == 0
    assert dc.benchmark_hits(some[0], none[1], ["doc_id"]).where(F.size("items") > 0).count() == 0
