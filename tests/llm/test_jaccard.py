"""The Jaccard join against all pairs of small tables."""

import random
import re

import pytest

from tideline.llm import jaccard, wordhash
from tideline.llm.components import connected_components

WORD = re.compile("[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    sets = []
    for doc_id, text in rows:
        words = WORD.findall(lower(text))
        sets.append((doc_id, {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(sets):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(find(i))) for i, (d, s) in enumerate(sets)), key=str)


def families(seed, n=150):
    """Families at every distance, a passage that a third of all texts share, copies, odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    passage = [word() for _ in range(60)]
    bases = [[word() for _ in range(rng.choice((4, 12, 40, 90)))] for _ in range(10)]
    rows = []
    for i in range(n):
        if rng.random() < 0.35:
            text = passage + [word() for _ in range(rng.randint(0, 18))]
        else:
            text = list(rng.choice(bases))
            for _ in range(rng.choice((0, 0, 1, 2, 3, 5))):
                text[rng.randrange(len(text))] = word()
        rows.append((i, rng.choice((" ", "\n", "  ")).join(text)))
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "one"), (504, "ONE"), (505, "one two"), (None, rows[0][1]), (7, rows[7][1])]
    return rows


def found(spark, rows):
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, class string, window int")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicate_classes(table).collect()), key=str)


def test_components_match_all_pairs(spark):
    rows = families(1)
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("limits", [dict(REGION_SETS=3), dict(REGION_SETS=3, HOT_WINDOW_SETS=4), dict(KNOWN_WINDOWS=5, REGION_WINDOWS=90)])
def test_every_way_gives_the_same(spark, monkeypatch, limits):
    """Spark rounds for regions of any size, pivots from the count, hardly any known windows."""
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = families(2, 90)
    assert found(spark, rows) == brute(rows)


def test_one_row_of_each_component_stays(spark):
    rows = families(3, 60)
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component string")
    kept = jaccard.representatives(table)
    assert kept.columns == table.columns
    want = brute(rows)
    empty = sum(n == 0 for _, n, _ in want)
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len({c for _, n, c in want if n}) + empty
    assert set(ids) - {500, 501, 502} == {c for _, n, c in want if n}


def test_empty_table(spark):
    assert found(spark, []) == []
    assert jaccard.representatives(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_threshold_is_exact():
    assert jaccard.linked(8, 10) and not jaccard.linked(79, 100)
    for n in range(1, 200):
        assert jaccard.prefix_length(n) >= 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(5, None), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140))


def test_words_do_not_depend_on_their_piece():
    import pyarrow as pa

    texts = ["a b c d e f", "", None, "x" * 5000, "b c d e f g"]
    whole = [s.tolist() for t in wordhash.texts_of(pa.array(texts)) for s in wordhash.shingle_sets(t, wordhash.non_space(), 5)]
    pieces = [s.tolist() for t in wordhash.texts_of(pa.array(texts), 8) for s in wordhash.shingle_sets(t, wordhash.non_space(), 5)]
    assert whole == pieces and len(set(whole[0]) & set(whole[4])) == 1
