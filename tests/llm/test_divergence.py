"""Source divergence against a plain reading, over several blocks and tiles, and odd rows."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tideline.llm import divergence

SCHEMA = "lang string, source string, text string, n int, term string, block int"


def plain(rows, least=10, top=10):
    """Rows of the audit, term by term."""
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for a, b, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(w for d in mine for w in set(d[2]))
        kept = sorted(w for w, n in held.items() if n >= least)
        counts = defaultdict(Counter)
        for _, source, words in mine:
            counts[source].update(w for w in words if held[w] >= least)
        whole = sum(counts.values(), Counter())

        def shares(c, kept=kept):
            return {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in counts:
            pairs = [(sum((p[s][w] - p[o][w]) ** 2 // (p[s][w] + p[o][w]) for w in kept), o) for o in counts if o != s]
            terms = [((p[s][w] - q[w]) ** 2 // (p[s][w] + q[w]), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found, last in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:last], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def found(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in divergence.audit(docs, **kw).collect())


@pytest.mark.parametrize("kw", [{}, {"block_terms": 7, "tile_sources": 2}])
def test_against_plain_reading(spark, kw):
    rng = random.Random(5)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(90)]
    rows = []
    for i in range(300):
        source = rng.choice(["a", "a", "a", "b", "c", "d", "e"])
        words = rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(90)], k=rng.randrange(30))
        rows.append((rng.choice(["en", "en", "de"]), source, " ".join(words).title() + " 12 x"))
    assert found(spark, rows, **kw) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, None, "same words same"), ("", "", "same words same"), ("en", "a", None), ("en", "b", ""),
            ("en", "c", "12 !!"), ("xx", "only", "lonely")] + [(None, "s", "same Words ÄÖ x\x00y")] * 9
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []


def test_very_long_text(spark):
    long = "alpha beta " * 150_000 + "gamma"
    rows = [("en", "a", long)] * 2 + [("en", "b", "alpha beta gamma")] * 10
    assert found(spark, rows) == plain(rows)


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total, kept = 10**12 + 7, 7 * 10**13 + 1, 12345
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * kept)
