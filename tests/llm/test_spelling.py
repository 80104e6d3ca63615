"""Spelling variants against a plain reading, planted chains, long words and odd rows."""

import random
import re
import zlib
from collections import Counter

from tideline.llm import spelling

SCHEMA = "doc_id long, text string, word string, no int, nodes int"


def plain_words(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def plain(rows):
    words = plain_words(rows)
    beside = {w: [v for v in words if near(w, v)] for w in words}
    forms = {}
    for w, found in beside.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            forms[w] = best
    out = []
    for w in words:
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, words[w], len(beside[w]), words[forms[w]] if w in forms else None))
    return sorted(out, key=str)


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in spelling.group_variants(docs).collect()), key=str)


def edited(rng, word):
    at = rng.randrange(len(word) + 1)
    kind = rng.randrange(3)
    if kind == 0:
        return word[:at] + rng.choice("abéÿ×") + word[at:]
    return word[:at] + (rng.choice("abéÿ") if kind == 1 else "") + word[at + 1:]


def test_against_plain_reading(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abcé", k=rng.randrange(6, 10))) for _ in range(60)] + ["aaaaaaaa", "abababab", "ÀÉÿ×÷çñ"]
    words = base * 20 + [edited(rng, w) for w in base * 4] * 3 + [edited(rng, edited(rng, w)) for w in base] * 3
    rng.shuffle(words)
    rows = [(i % 40, " ".join(words[i * 9:i * 9 + 9]).title()) for i in range(len(words) // 9)]
    got = found(spark, rows)
    assert got == plain(rows)
    assert sum(r[4] for r in got) > 100


def test_chain_of_forms(spark):
    # Counts of 2, 20 and 200: each form is the next one's word; ids whose hash deletes nothing.
    names = [("abcdefgh", 2), ("abcdefgx", 20), ("abcdefyx", 200), ("abcdezyx", 2000)]
    rows = []
    for word, n in names:
        doc_id = next(i for i in range(100) if all(zlib.crc32(f"{i}:{w}".encode()) % 31 for w, _ in names))
        rows.append((doc_id, " ".join([word] * n)))
    got = {r[0]: r for r in found(spark, rows)}
    assert got["abcdefgh"][1:] == ("abcdefgx", "abcdezyx", 2, 1, 20)
    assert got["abcdezyx"][1:] == (None, "abcdezyx", 2000, 1, None)


def test_long_words(spark):
    rng = random.Random(4)
    long = "".join(rng.choices("abc", k=20_000))
    other = [long, long[:9000] + "z" + long[9000:], long[:19_999] + "z", "z" + long[1:], long[:70] + long[71:]]
    rows = [(i, f"{w}1{w}") for i, w in enumerate(other)]
    assert found(spark, rows) == plain(rows)


def test_very_long_text(spark):
    rows = [(1, "letters Letterz letters " * 100_000), (None, "letterz")]
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, "unnamed unnamed"), (1, None), (1, ""), (1, "short words only"), (2, "Unnamed unnämed"), (2, "Unnamed unnämed")]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, "tiny")]) == []
