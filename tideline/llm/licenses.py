"""Licence scans with a trained paragraph classifier.

A unit is a line, or a window of words in a paragraph, whose lines are joined: a notice
may be wrapped or stand inside a long line.  It is a set of words and word pairs.  A
multinomial logistic regression over them, with a class for unknown text, names a licence
family; the probability needed is calibrated on held-out examples, and the comparison with
the wordings of notices confirms the family, or corrects it where another family's wording
stands in the unit in full.

Features are words and pairs of the notices that hold a word uncommon in ordinary lines, so
that ``the`` or ``and`` weigh nothing.  Text in which the grams that could stand there cannot
add up to a naming is left out before it is cut into units; that follows from the weights,
so nothing is lost.  Everything is DataFrame operations and Spark ML.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import documents_columns, stored

UNKNOWN = "unknown"

# Wordings of licence notices, one per line, under their family.
TEMPLATES = {
    "apache-2.0": """licensed under the apache license, version 2.0
licensed under the apache license, version 2.0 (the "license"); you may not use this file except in compliance with the license
you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0
this project is released under the apache license 2.0
apache license version 2.0, january 2004
spdx-license-identifier: apache-2.0""",
    "mit": """released under the mit license
this software is licensed under the mit license
permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
the software is provided "as is", without warranty of any kind, express or implied
distributed under the terms of the mit license
spdx-license-identifier: mit""",
    "gpl-3.0": """this work is licensed under the gnu general public license, version 3
this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license
either version 3 of the license, or (at your option) any later version
it under the terms of the gnu general public license as published by the free software foundation
licensed under the gnu gpl v3
spdx-license-identifier: gpl-3.0-or-later
spdx-license-identifier: gpl-3.0-only""",
    "gpl-2.0": """this program is licensed under the gnu general public license, version 2
either version 2 of the license, or (at your option) any later version
licensed under the gnu gpl v2
spdx-license-identifier: gpl-2.0-only""",
    "lgpl": """this library is licensed under the gnu lesser general public license
it under the terms of the gnu lesser general public license as published by the free software foundation
licensed under the gnu lgpl
spdx-license-identifier: lgpl-2.1-or-later""",
    "agpl-3.0": """licensed under the gnu affero general public license, version 3
it under the terms of the gnu affero general public license as published by the free software foundation
licensed under the gnu agpl v3
spdx-license-identifier: agpl-3.0-or-later""",
    "bsd": """redistribution and use in source and binary forms, with or without modification, are permitted
redistributions of source code must retain the above copyright notice
redistributions in binary form must reproduce the above copyright notice
licensed under the bsd 3-clause license
released under the bsd 2-clause license
spdx-license-identifier: bsd-3-clause""",
    "isc": """permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted
licensed under the isc license
spdx-license-identifier: isc""",
    "mpl-2.0": """this source code form is subject to the terms of the mozilla public license, v. 2.0
licensed under the mozilla public license 2.0
mozilla public license version 2.0
spdx-license-identifier: mpl-2.0""",
    "unlicense": """this is free and unencumbered software released into the public domain
released under the unlicense
spdx-license-identifier: unlicense""",
    "cc0-1.0": """released under the creative commons zero 1.0 universal public domain dedication
licensed under cc0 1.0
spdx-license-identifier: cc0-1.0""",
    "cc-by-nc-4.0": """licensed under cc by-nc 4.0
this work is licensed under a creative commons attribution-noncommercial 4.0 international license
cc by-nc 4.0 international
spdx-license-identifier: cc-by-nc-4.0""",
    "cc-by-4.0": """licensed under cc by 4.0
this work is licensed under a creative commons attribution 4.0 international license
cc by 4.0 international
spdx-license-identifier: cc-by-4.0""",
    "cc-by-sa-4.0": """licensed under cc by-sa 4.0
this work is licensed under a creative commons attribution-sharealike 4.0 international license
cc by-sa 4.0 international
spdx-license-identifier: cc-by-sa-4.0""",
    "cc-by-nd-4.0": """licensed under cc by-nd 4.0
this work is licensed under a creative commons attribution-noderivatives 4.0 international license
spdx-license-identifier: cc-by-nd-4.0""",
    "all-rights-reserved": """all rights reserved
copyright, all rights reserved
no part of this work may be reproduced without permission""",
}
FAMILIES = [*TEMPLATES, UNKNOWN]

# Examples: each template whole and with every run of this many words left out, and
# ordinary lines as unknown, at most so many of at most so many bytes, chosen by hash.
DROPPED_WORDS = 1
UNKNOWN_EXAMPLES = 2000
UNKNOWN_BYTES = 4096
# Lines that hold this share of a wording's words are no examples of ordinary ones.
DOUBTFUL = 0.4
# A word is common if more than this share, and number, of the ordinary lines hold it.
COMMON_SHARE = 0.02
COMMON_LINES = 20
ITERATIONS = 60
SHRINK = 1e-4
# Share of a template's words a paragraph must hold, and the other way about.
CONFIRM_TEMPLATE = 0.7
CONFIRM_PARAGRAPH = 0.5
# Windows begin at a word of a template and are this many times as long as it; a
# longer one cannot hold CONFIRM_PARAGRAPH of the template's words.
WINDOW_LENGTHS = (1.0, 1.4, 2.0)
# Paragraphs are cut into stretches that begin every so many words and are twice as long,
# so that each window lies in the stretch in whose first half it begins.
STRETCH = 64


@dataclass
class Model:
    """Weight of each gram per family (unknown last), intercepts, and the probability needed."""

    weights: dict[str, list[float]]
    bias: dict[str, float]
    needed: float


def words_of(text: Column) -> Column:
    """Lower-cased words: runs of letters, digits, dots and hyphens inside."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*)"), F.lit(1))


def grams_of(words: Column) -> Column:
    """Distinct words and word pairs."""
    left = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.zip_with(left, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
                       lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, pairs))


def template_table(spark: SparkSession) -> DataFrame:
    """(family, template, words) of the fixed templates."""
    rows = [(family, i, line) for family, lines in TEMPLATES.items() for i, line in enumerate(lines.splitlines())]
    values = ", ".join("('{}', {}, '{}')".format(f, i, t.replace("'", "\\'")) for f, i, t in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(family, template, line)").select(
        "family", "template", words_of(F.col("line")).alias("words"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph from 0, line) of each non-empty line of each text."""
    lines = documents_columns(docs, ["doc_id", "text"]).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    return lines.where(F.length(F.trim("line")) > 0)


def _pieces(words: str) -> list[str]:
    """The runs of a-z and 0-9 in a gram."""
    return sorted(set(re.findall("[a-z0-9]+", words)))


def could_be_named(text: Column, model: Model) -> Column:
    """Whether any part of a text could reach the needed probability.

    Exact: a gram can only stand in a text that holds all its runs of a-z and 0-9, and
    a unit's lead over unknown is at most the largest intercept lead plus the largest
    leads of all grams that can stand there.
    """
    leads = [(g, max(x - w[-1] for x in w[:-1])) for g, w in model.weights.items()]
    leads = [(g, x) for g, x in leads if x > 0]
    start = max(model.bias[f] - model.bias[UNKNOWN] for f in TEMPLATES)
    goal = math.log(model.needed / (1 - model.needed))
    if start >= goal:
        return F.lit(True)
    if not leads:
        return F.lit(False)
    # Each gram stands under one of its runs, the longest, and needs the others beside it.
    vocabulary = sorted({p for g, _ in leads for p in _pieces(g)})
    under: dict[str, list[tuple[list[str], float]]] = {p: [] for p in vocabulary}
    for gram, lead in leads:
        own = max(_pieces(gram), key=lambda p: (len(p), p))
        under[own].append(([p for p in _pieces(gram) if p != own], lead))
    empty = F.array().cast("array<string>")
    listed = F.array(*[F.array(*[F.struct(
        (F.array(*[F.lit(p) for p in others]) if others else empty).alias("others"), F.lit(lead).alias("lead"))
        for others, lead in under[p]]) if under[p] else F.array().cast("array<struct<others:array<string>,lead:double>>")
        for p in vocabulary])
    words = F.array(*[F.lit(p) for p in vocabulary])
    held = F.array_intersect(F.split(F.lower(text), "[^a-z0-9]+"), words)

    def reaches(known: Column) -> Column:
        def with_piece(total: Column, piece: Column) -> Column:
            return F.aggregate(
                F.element_at(listed, F.array_position(words, piece).cast("int")), total,
                lambda t, g: t + F.when(F.forall(g["others"], lambda p: F.array_contains(known, p)), g["lead"]).otherwise(0.0))

        return F.when(F.size(known) == 0, False).otherwise(F.aggregate(known, F.lit(start), with_piece) >= goal)

    # Bound by a lambda, so that a text is cut into runs once and not once a gram.
    return F.exists(F.array(held), reaches)


def joined_paragraphs(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lines, words) of each run of lines that have words, if something in it could be named.

    ``lines`` has number and words of each line, ``words`` the number of its line and
    the word of all of them.
    """
    near = documents_columns(docs, ["doc_id", "text"]).where(could_be_named(F.col("text"), model))
    marks = F.translate("text", "\x01\x02", "  ")
    numbered = F.transform(F.split(marks, "\n"), lambda line, i: F.when(
        line.rlike(r"[\p{L}\p{N}]"), F.concat(i.cast("string"), F.lit("\x02"), line)).otherwise(F.lit("\x01")))
    parts = near.select(
        "doc_id", F.explode(F.split(F.array_join(numbered, "\n"), "\x01")).alias("part"))
    # Lines lead with their numbers, which no run of letters and digits joins to.
    parts = parts.where(F.contains("part", F.lit("\x02"))).where(could_be_named(F.col("part"), model))
    lines = F.transform(
        F.filter(F.split("part", "\n"), lambda line: F.contains(line, F.lit("\x02"))),
        lambda line: F.struct(F.substring_index(line, "\x02", 1).cast("long").alias("number"),
                              words_of(F.substring_index(line, "\x02", -1)).alias("words")))
    return parts.select("doc_id", lines.alias("lines")).select(
        "doc_id", "lines",
        F.flatten(F.transform("lines", lambda line: F.transform(
            line["words"], lambda w: F.struct(line["number"].alias("number"), w.alias("word"))))).alias("words"))


def _windows(spark: SparkSession, first: Column) -> Column:
    """Windows of ``words`` that agree with a template: at, length, first and last line, words.

    ``first`` is the place of the first word; windows begin in the first half of the words.
    A window can only agree with a template of which the whole stretch has enough words.
    """
    templates = [list(r["words"]) for r in template_table(spark).collect()]
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for t in templates for w in t})])
    every = F.array(*[F.struct(F.array(*[F.lit(w) for w in dict.fromkeys(t)]).alias("wording"), F.lit(len(t)).alias("n")) for t in templates])
    known = F.array_intersect(F.transform("words", lambda w: w["word"]), vocabulary)

    def window(at: Column, length: Column) -> Column:
        part = F.slice("words", at, length)
        return F.struct(
            (first + at).cast("long").alias("at"), length.cast("long").alias("length"), part[0]["number"].alias("first"),
            F.element_at(part, -1)["number"].alias("last"), F.transform(part, lambda w: w["word"]).alias("words"))

    def of(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.least(F.size("words"), F.lit(STRETCH))),
                          lambda i: F.array_contains(t["wording"], F.element_at("words", i)["word"]))
        lengths = F.array(*[F.ceil(t["n"] * F.lit(x)).cast("int") for x in WINDOW_LENGTHS])
        cut = F.flatten(F.transform(starts, lambda i: F.transform(lengths, lambda n: window(i, n))))

        def agrees(w: Column) -> Column:
            same = F.size(F.array_intersect(w["words"], t["wording"]))
            return (same >= F.size(t["wording"]) * CONFIRM_TEMPLATE) & (same >= F.size(F.array_distinct(w["words"])) * CONFIRM_PARAGRAPH)

        return F.filter(cut, agrees)

    def of_words(k: Column) -> Column:
        covered = F.filter(every, lambda t: F.size(F.array_intersect(k, t["wording"])) >= F.size(t["wording"]) * CONFIRM_TEMPLATE)
        return F.flatten(F.transform(covered, of))

    # Bound by a lambda, so that the known words are found once and not once a template.
    return F.when(F.size("words") > 0, F.array_distinct(F.flatten(F.transform(F.array(known), of_words))))


def examples(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """(family, words, held_out): bounded training and calibration examples.

    One unknown example without words is always there, so that nothing is named for
    nothing.
    """
    templates = template_table(spark)
    n = F.size("words")
    cut = templates.select("family", "words", F.explode(F.sequence(F.lit(0), n)).alias("at")).select(
        "family",
        F.when(F.col("at") < n, F.concat(
            F.slice("words", F.lit(1), F.col("at")),
            F.slice("words", F.col("at") + 1 + DROPPED_WORDS, n))).otherwise(F.col("words")).alias("words"))
    wordings = F.array(*[F.array(*[F.lit(w) for w in dict.fromkeys(r["words"])]) for r in templates.collect()])
    # Lines are chosen by hash before they are cut into words.
    chosen = lines.where(F.octet_length("line") <= UNKNOWN_BYTES).select("line").orderBy(F.xxhash64("line"), "line").limit(UNKNOWN_EXAMPLES)
    plain = (
        chosen.select(F.lit(UNKNOWN).alias("family"), words_of(F.col("line")).alias("words"))
        .where(F.size("words") > 0)
        # A line that holds many words of a wording could be a notice, or part of one.
        .where(~F.exists(wordings, lambda t: F.size(F.array_intersect("words", t)) >= F.size(t) * DOUBTFUL))
    )
    fold = F.pmod(F.xxhash64(F.array_join("words", " ")), F.lit(5)) == 0
    rows = cut.where(F.size("words") > 0).unionByName(plain).withColumn("held_out", fold)
    nothing = spark.range(1).select(F.lit(UNKNOWN).alias("family"), F.array().cast("array<string>").alias("words"),
                                    F.lit(False).alias("held_out"))
    return rows.unionByName(nothing)


def train(spark: SparkSession, lines: DataFrame) -> Model:
    """The classifier, trained on bounded examples; its size is bounded by the templates."""
    # Bounded, and read once an iteration: one partition.
    rows = stored(examples(spark, lines), "licence-examples").coalesce(1)
    plain = rows.where(F.col("family") == UNKNOWN)
    n_plain = plain.count()
    notices = rows.where(F.col("family") != UNKNOWN)
    words = notices.select(F.explode("words").alias("word")).distinct()
    held = plain.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count()
    common = held.where(F.col("count") > max(n_plain * COMMON_SHARE, COMMON_LINES)).join(words, "word", "left_semi")
    common = {r["word"] for r in common.collect()}
    grams = notices.where("NOT held_out").select(F.explode(grams_of(F.col("words"))).alias("gram")).distinct().collect()
    vocabulary = sorted(r["gram"] for r in grams if not common.issuperset(r["gram"].split(" ")))
    counted = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
    counted.setBinary(True)
    sizes = {r["family"]: r["count"] for r in rows.where("NOT held_out").groupBy("family").count().collect()}
    total = sum(sizes.values())
    # Classes weigh alike within notices, and unknown text as much as all of them.
    weigh = F.lit(1.0)
    for f in FAMILIES:
        share = total / (2 * max(1, sizes.get(f, 1)) * (1 if f == UNKNOWN else len(TEMPLATES)))
        weigh = F.when(F.col("family") == f, F.lit(share)).otherwise(weigh)
    label = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")).cast("double") - 1
    learned = counted.transform(rows.where("NOT held_out").select(
        grams_of(F.col("words")).alias("grams"), label.alias("label"), weigh.alias("weight")))
    fitted = LogisticRegression(family="multinomial", maxIter=ITERATIONS, regParam=SHRINK, weightCol="weight",
                                standardization=False, tol=1e-7).fit(learned)
    matrix, bias = fitted.coefficientMatrix, fitted.interceptVector
    model = Model({g: [float(matrix[k, i]) for k in range(len(FAMILIES))] for i, g in enumerate(vocabulary)},
                  {f: float(bias[k]) for k, f in enumerate(FAMILIES)}, 0.5)
    held = rows.where("held_out").withColumn("id", F.monotonically_increasing_id())
    held = _probabilities(held.select("id", "family", "words"), model).select(
        "family", F.array_max(F.slice("p", 1, len(TEMPLATES))).alias("top"), _family_of(F.slice("p", 1, len(TEMPLATES))).alias("named"))
    # The least probability at which no more than 1 in 100 held-out names is wrong.
    wrong = held.where("named <> family").agg(F.percentile_approx("top", 0.99)).first()[0] or 0.0
    model.needed = min(0.95, max(0.5, float(wrong)))
    return model


def _family_of(p: Column) -> Column:
    """The likeliest family of an array of probabilities."""
    return F.element_at(F.array(*[F.lit(f) for f in TEMPLATES]), F.array_position(p, F.array_max(p)).cast("int"))


def _weight_table(spark: SparkSession, model: Model) -> DataFrame:
    """(gram, w): the model's weights as a table."""
    rows = json.dumps([{"gram": g, "w": w} for g, w in model.weights.items()])
    return spark.range(1).select(F.explode(F.from_json(
        F.lit(rows), "array<struct<gram:string,w:array<double>>>")).alias("r")).select("r.*")


def _probabilities(units: DataFrame, model: Model) -> DataFrame:
    """``units`` (by id, with words) with p, the probability of each family."""
    weights = stored(_weight_table(units.sparkSession, model), "licence-weights")
    grams = units.select("id", F.explode(grams_of(F.col("words"))).alias("gram"))
    # The table of weights is bounded by the templates.
    summed = grams.join(F.broadcast(weights), "gram").groupBy("id").agg(
        *[F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(FAMILIES))])
    logits = F.array(*[F.coalesce(f"s{k}", F.lit(0.0)) + model.bias[f] for k, f in enumerate(FAMILIES)])
    return units.join(summed, "id", "left").select(*units.columns, softmax(logits).alias("p"))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def telling_words(model: Model) -> list[str]:
    """Words without any of which no unit can be named.

    A family's lead over unknown is its intercept lead plus the leads of the
    unit's grams, each counted once.  Words are taken, those in the best
    grams first, until for every family the leads of all grams without one of
    them cannot reach the lead that the needed probability asks for.
    """
    goal = math.log(model.needed / (1 - model.needed))
    words: set[str] = set()
    for k, family in enumerate(FAMILIES[:-1]):
        leads = [(w[k] - w[-1], gram) for gram, w in model.weights.items() if w[k] > w[-1]]
        for lead, gram in sorted(leads, key=lambda x: (-x[0], x[1])):
            left = sum(x for x, g in leads if not words & set(g.split(" ")))
            if model.bias[family] - model.bias[UNKNOWN] + left < goal:
                break
            if not words & set(gram.split(" ")):
                # The word of the pair that stands for the most.
                words.add(max(gram.split(" "), key=lambda v: (model.weights.get(v, [0.0] * len(FAMILIES))[k], v)))
    return sorted(words)


def units_of(docs: DataFrame, model: Model) -> DataFrame:
    """(part, doc_id, at, length, first, last, words) of the lines and windows that hold a telling word.

    ``part`` numbers the paragraph; lines have null ``at`` and ``length``.
    """
    telling = telling_words(model)
    wanted = F.array(*[F.lit(w) for w in telling]) if telling else F.array().cast("array<string>")
    parts = stored(joined_paragraphs(docs, model).withColumn("part", F.monotonically_increasing_id()), "licence-parts")
    lines = parts.select("part", "doc_id", F.explode("lines").alias("line")).select(
        "part", "doc_id", F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("length"),
        F.col("line.number").alias("first"), F.col("line.number").alias("last"), F.col("line.words").alias("words"))
    stretches = parts.select("part", "doc_id", F.explode(F.transform(
        F.sequence(F.lit(0), F.floor((F.size("words") - 1) / STRETCH).cast("int")),
        lambda j: F.struct((j * STRETCH).alias("from"), F.slice("words", j * STRETCH + 1, 2 * STRETCH).alias("words")))).alias("s")).select(
        "part", "doc_id", F.col("s.from").alias("from"), F.col("s.words").alias("words"))
    stretches = stretches.where(F.arrays_overlap(F.transform("words", lambda w: w["word"]), wanted))
    windows = stretches.select("part", "doc_id", F.explode(_windows(docs.sparkSession, F.col("from"))).alias("w")).select(
        "part", "doc_id", "w.*")
    return lines.unionByName(windows).where(F.arrays_overlap("words", wanted))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Licence notices in ``docs``: doc_id, paragraph, family, probability, template, confirmed.

    ``paragraph`` is the number of the line, from 0, on which a notice begins.  A row per
    line that the classifier gives to a family with at least the calibrated
    probability; all other lines are unknown and have no row.
    ``confirmed`` says that the line agrees with a wording, whose number is ``template``: one
    of that family, or one of another that stands in the line in full where none of the
    family's does; the longest such wording then gives the family.  Besides, a row per notice that a window of
    a paragraph's joined words holds: of windows of a family that overlap, the one that
    agrees best, unless a line or another family's window there agrees better.  Null and empty texts have no
    paragraphs; repeated rows and ids give rows each; other columns are ignored.
    """
    spark = docs.sparkSession
    model = model or train(spark, paragraphs(docs))
    units = stored(units_of(docs, model).withColumn("id", F.monotonically_increasing_id()), "licence-near")
    kept = ["part", "doc_id", "at", "length", "first", "last"]
    top = F.array_max(F.slice("p", 1, len(TEMPLATES)))
    named = _probabilities(units.select("id", *kept, "words"), model).where(top >= model.needed).select(
        "id", *kept, "words", top.alias("probability"), _family_of(F.slice("p", 1, len(TEMPLATES))).alias("named"))
    # Every named unit beside every wording, of which there are some dozens.
    wordings = F.array(*[F.struct(
        F.lit(r["family"]).alias("family"), F.lit(r["template"]).alias("template"),
        F.array(*[F.lit(w) for w in dict.fromkeys(r["words"])]).alias("wording")) for r in template_table(spark).collect()])
    def judge(of: Column) -> Column:
        """The wording that decides: in full and longest, else the family's that agrees best."""
        def weighed(t: Column) -> Column:
            size, same = F.size(t["wording"]), F.size(F.array_intersect("words", t["wording"]))
            return F.struct(
                F.when(same == size, size).otherwise(0).alias("full"), (t["family"] == F.col("named")).alias("own"),
                (same / size + same / of).alias("score"), (-t["template"]).alias("before"), t["family"].alias("family"),
                t["template"].alias("template"), (same / size).alias("of_template"), (same / of).alias("of_paragraph"))

        return F.array_max(F.filter(F.transform(wordings, weighed), lambda w: w["own"] | (w["full"] > 0)))

    best = F.element_at(F.transform(F.array(F.size(F.array_distinct("words"))), judge), 1)
    judged = named.select("id", *kept, "probability", F.explode(F.array(best)).alias("b")).select(
        "id", *kept, F.col("b.family").alias("family"), "probability",
        F.struct("b.family", "b.template", "b.of_template", "b.of_paragraph").alias("best"),
        ((F.col("b.of_template") >= CONFIRM_TEMPLATE) & (F.col("b.of_paragraph") >= CONFIRM_PARAGRAPH)).alias("confirmed"))
    judged = stored(judged, "licence-judged")
    lines = judged.where(F.col("at").isNull())
    score = F.col("best.of_template") + F.col("best.of_paragraph")
    windows = judged.where(F.col("at").isNotNull() & F.col("confirmed"))
    by = Window.partitionBy("part", "family").orderBy("at", "length", "id")
    reach = F.max(F.col("at") + F.col("length")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    windows = windows.withColumn("new", F.when(F.col("at") >= reach, 1).otherwise(0)).withColumn("run", F.sum("new").over(by))
    windows = windows.groupBy("part", "family", "run").agg(
        F.max_by(F.struct(*[F.col(c) for c in judged.columns if c not in ("part", "family")]),
                 F.struct(score, -F.col("at"), -F.col("length"))).alias("w"),
        F.min("first").alias("_from"), F.max("last").alias("_to")).select("part", "family", "w.*", "_from", "_to")
    windows = stored(windows, "licence-windows")
    # A window yields to a confirmed line among its lines that agrees as well or better, and to a
    # window of another family that agrees better and covers most of it; a confirmed line
    # yields to a window of its family over it that agrees better.
    whole = lines.where("confirmed").select(F.col("part").alias("_part"), F.col("first").alias("_line"), score.alias("_score"))
    other = windows.select(F.col("part").alias("_part"), F.col("family").alias("_family"), F.col("at").alias("_at"),
                           F.col("length").alias("_length"), score.alias("_score"))
    shared = F.least(F.col("at") + F.col("length"), F.col("_at") + F.col("_length")) - F.greatest("at", "_at")
    windows = windows.join(
        whole, (F.col("part") == F.col("_part")) & F.col("_line").between(F.col("_from"), F.col("_to"))
        & (F.col("_score") >= score), "left_anti")
    windows = windows.join(
        other, (F.col("part") == F.col("_part")) & (F.col("_family") != F.col("family")) & (shared * 2 > F.least("length", "_length"))
        & ((F.col("_score") > score) | ((F.col("_score") == score) & (F.col("_family") < F.col("family")))), "left_anti")
    windows = windows.select(*lines.columns)
    over = windows.select(F.col("part").alias("_part"), F.col("family").alias("_family"), F.col("first").alias("_from"),
                          F.col("last").alias("_to"), score.alias("_score"))
    lines = lines.join(
        over, F.col("confirmed") & (F.col("part") == F.col("_part")) & (F.col("family") == F.col("_family"))
        & F.col("first").between(F.col("_from"), F.col("_to")) & (F.col("_score") > score), "left_anti")
    return lines.unionByName(windows).select(
        "doc_id", F.col("first").alias("paragraph"), "family",
        F.round("probability", 6).alias("probability"), F.col("best.template").cast("long").alias("template"), "confirmed")
