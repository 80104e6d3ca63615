"""Trained operators on labels they never saw, and on odd texts."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import TESTDATA
from tideline.llm import licenses, quality, toxicity
from tideline.llm.common import prepare, stored, table

ODD = [(1, None, "x"), (2, "", "x"), (3, "a", "x"), (3, "a", "x"), (None, "word " * 200_000, "x")]


@pytest.mark.parametrize("operator, label", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(spark, operator, label):
    prepare(spark)
    docs, labels = (table(spark, f"{TESTDATA}/sf0.1", n) for n in ("documents", "labels"))
    scored = operator.score_documents(docs, labels).where("held_out").join(labels, "doc_id")
    rows = scored.select("score", "predicted", label).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == r[label] for r in rows]) > 0.95


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_odd_texts_and_labels(spark, operator):
    prepare(spark)
    docs = spark.createDataFrame(ODD, "doc_id long, text string, score string")
    for rows in ([], [(3, 1, 1)], [(3, None, None), (None, 1, 1)], [(2, 0, 0), (3, 1, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        got = operator.score_documents(docs, labels).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        kept = operator.accepted(docs, labels)
        assert kept.columns == docs.columns and kept.count() <= len(ODD)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert operator.score_documents(empty, labels).count() == 0


def test_context_is_an_arc_of_its_own():
    reader = toxicity.Reader(toxicity.Grammar({"scum": 3.0, "vequ*": 3.0}, dict.fromkeys(toxicity.ARCS, 1.0), -1.0))
    arcs = lambda text: sorted(reader.counts(text))
    assert arcs("some scum here") == ["insult-plain"]
    assert arcs("You are SCUM.") == ["insult-aimed"]
    assert arcs("this is not scum") == ["insult-denied"]
    assert arcs("it was said. and scum") == ["insult-plain"]  # a clause ends the report
    assert arcs("he said it was plain old vequille") == ["insult-reported"]
    assert arcs("i will kill you") == ["threat-aimed"]
    assert arcs("to kill time") == [] and arcs("scummy vequ.") == [] and arcs("") == []


def test_threats_are_inflected_and_need_an_object():
    reader = toxicity.Reader(toxicity.Grammar({"scum": 3.0}, dict.fromkeys(toxicity.ARCS, 1.0), -1.0))
    arcs = lambda text: sorted(reader.counts(text))
    for text in ("he kills you", "I am killing you", "they murdered her", "shoot me and then you", "ich werde dich töten",
                 "te voy a matar", "je vais vous frapper", "we will beat all of you"):
        assert arcs(text) == ["threat-aimed"], text
    for text in ("the chef will beat the eggs for you", "they attack at dawn", "you burn the toast", "kills", "tu es la"):
        assert arcs(text) == [], text
    assert arcs("i would never hurt you") == ["threat-denied"]
    assert arcs("she wrote that he would kill them") == ["threat-reported"]
    assert arcs("nobody said not to hurt them") == ["threat-denied-reported"]


def _plain_arcs(words, lexicon):
    """Arcs of a clause by looking at the words around each hit."""
    kinds = [lexicon.read(w)[0] for w in words]
    out = []
    for i, kind in enumerate(kinds):
        near = lambda j, a: 0 <= j < len(kinds) and kinds[j] & a
        reach = range(1, toxicity.REACH + 1)
        denied = any(near(i - d, toxicity.NEGATION) for d in reach)
        reported = any(k & toxicity.REPORT for k in kinds[:i])
        if kind & toxicity.INSULT:
            name, aimed = "insult", any(near(i - d, toxicity.TARGET) or near(i + d, toxicity.TARGET) for d in reach)
        elif kind & toxicity.THREAT:
            ahead = next((d for d in reach if near(i + d, toxicity.OBJECT | toxicity.BREAK)), None)
            name, aimed = "threat", any(near(i - d, toxicity.CLITIC) for d in reach) or (
                ahead is not None and near(i + ahead, toxicity.OBJECT))
            if not aimed:
                continue
        else:
            continue
        out.append(f"{name}-" + ("denied-reported" if denied and reported else "denied" if denied else "reported"
                                 if reported else "aimed" if aimed else "plain"))
    return out


def test_composed_transducers_against_plain_reading():
    reader = toxicity.Reader(toxicity.Grammar({"scum": 3.0, "vequ*": 2.0}, {}, 0.0))
    rng = np.random.default_rng(1)
    words = ["scum", "vequille", "kill", "killing", "matar", "you", "dich", "te", "her", "not", "said", "the", "for", "x", "y", "z"]
    for _ in range(2000):
        clause = rng.choice(words, size=rng.integers(1, 20)).tolist()
        assert [a for a, _, _, _ in reader.clause(" ".join(clause))] == _plain_arcs(clause, reader.lexicon), clause


def test_a_clause_without_end_is_read_in_one_pass():
    reader = toxicity.Reader(toxicity.Grammar({"scum": 3.0}, dict.fromkeys(toxicity.ARCS, 1.0), -1.0))
    began = time.perf_counter()
    counts = reader.counts("you scum not x y " * 40_000)
    assert sum(counts.values()) == 3.0 * 40_000
    assert time.perf_counter() - began < 5


def test_licence_notices(spark):
    prepare(spark)
    lines = ["Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
             "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "All rights reserved.",
             "The work was under the version that all had."]
    texts = [(i, f"Some words first.\n\n{line}\nAnd more.") for i, line in enumerate(lines)]
    docs = spark.createDataFrame([*texts, (90, None), (91, ""), (0, texts[0][1])], "doc_id long, text string")
    given = docs.withColumn("id", docs.doc_id).withColumn("part", docs.doc_id).withColumn("words", docs.text)
    found = licenses.scan(given).collect()
    got = sorted((r.doc_id, r.paragraph, r.family) for r in found if r.confirmed)
    want = [(0, "cc-by-nc-4.0"), (0, "cc-by-nc-4.0"), (1, "gpl-3.0"), (2, "apache-2.0"), (3, "mit"), (4, "all-rights-reserved")]
    assert got == [(i, 2, family) for i, family in want]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licence_notices_that_are_wrapped_or_inside_a_line(spark):
    prepare(spark)
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation "
           "files (the \"Software\"), to deal\nin the Software without restriction.")
    gpl = (" * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public "
           "License as published by\n * the Free Software Foundation.")
    apache = ("# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance\n"
              "# with the License.")
    long = "We walked along the river for many hours that day and " * 4
    inside = f"{long}released under the MIT License {long}"
    texts = [(1, f"A file.\n\n{mit}\n\nMore."), (2, f"/*\n *\n{gpl}\n */\nint main;"), (3, f"{apache}\n#\nimport os"), (4, f"Story.\n{inside}"),
             (None, f"A file.\n\n{mit}"), (None, f"A file.\n\n{mit}"), (5, long), (6, f"{long}\n\nThe work\nwas under the version\nthat all had.")]
    found = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    got = sorted((r.doc_id or 0, r.paragraph, r.family) for r in found if r.confirmed)
    assert got == [(0, 2, "mit"), (0, 2, "mit"), (1, 2, "mit"), (2, 2, "gpl-3.0"), (3, 0, "apache-2.0"), (4, 1, "mit")]


@pytest.fixture(scope="module")
def licence_model(spark):
    prepare(spark)
    return licenses.train(spark, licenses.paragraphs(table(spark, f"{TESTDATA}/sf0.01", "documents")))


def test_every_wording_is_found_under_its_own_family(spark, licence_model):
    wordings = [(f, line) for f, lines in licenses.TEMPLATES.items() for line in lines.splitlines()]
    texts = [(i, f"Some words.\n\n{line}\n\nMore words.") for i, (_, line) in enumerate(wordings)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {(r.doc_id, r.family) for r in licenses.scan(docs, licence_model).collect() if r.confirmed}
    assert [line for i, (f, line) in enumerate(wordings) if (i, f) not in found] == []


def _plain_lines(text, model):
    """(line, family, probability) of the lines that the weights name, line by line."""
    out = []
    for number, line in enumerate((text or "").split("\n")):
        words = re.findall(r"[^\W_]+(?:[.\-][^\W_]+)*", line.lower())
        grams = set(words) | {" ".join(p) for p in zip(words, words[1:], strict=False)}
        logits = np.array([model.bias[f] for f in licenses.FAMILIES])
        for gram in grams & model.weights.keys():
            logits = logits + model.weights[gram]
        p = np.exp(logits - logits.max())
        p = p / p.sum()
        if words and p[:-1].max() >= model.needed:
            out.append((number, licenses.FAMILIES[int(p[:-1].argmax())], round(float(p[:-1].max()), 6)))
    return out


def test_named_lines_against_a_plain_scorer(spark, licence_model):
    wordings = [line for lines in licenses.TEMPLATES.values() for line in lines.splitlines()]
    rows = [(r.doc_id, r.text) for r in table(spark, f"{TESTDATA}/sf0.001", "documents").collect()]
    cut = [" ".join(w.split()[i::2]) + "\nthe work and all of this" for w in wordings for i in (0, 1)]
    rows += [(10_000 + i, f"x\n{w}, and so on\n{w[:len(w) // 2]}") for i, w in enumerate([*wordings, *cut])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    units = licenses.units_of(docs, licence_model).where("at IS NULL").withColumn("id", F.monotonically_increasing_id())
    units = stored(units, "test-units")
    top = F.slice("p", 1, len(licenses.TEMPLATES))
    named = licenses._probabilities(units, licence_model).where(F.array_max(top) >= licence_model.needed)
    got = sorted((r.doc_id, r["first"], r.f, round(r.top, 6)) for r in named.select(
        "doc_id", "first", licenses._family_of(top).alias("f"), F.array_max(top).alias("top")).collect())
    want = sorted((d, *found) for d, text in rows for found in _plain_lines(text, licence_model))
    assert [g[:3] for g in got] == [w[:3] for w in want] and len(got) > len(wordings)
    assert all(abs(g[3] - w[3]) < 1e-5 for g, w in zip(got, want, strict=True))
