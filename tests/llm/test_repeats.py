"""Removed repeats against a plain reading; interval expansion; hot anchors; odd rows."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tideline.llm import bwt, repeats

SCHEMA = "doc_id long, text string, key int, digest string, found int, copy int"
W = repeats.WINDOW


def plain(rows):
    least = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        if doc_id is not None:
            for i in range(len(data) - W + 1):
                s = data[i:i + W]
                least[s] = min(least.get(s, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for i in range(len(data) - W + 1):
            if doc_id is not None and least[data[i:i + W]] < doc_id:
                gone[i:i + W] = True
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in repeats.remove_repeats(docs, **kw).collect()), key=str)


def corpus(rng, n):
    passages = ["".join(rng.choices("abcdé ", k=rng.randrange(45, 140))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choices("xyzü ", k=rng.randrange(60))) for _ in range(rng.randrange(6))]
        rows.append((rng.randrange(1000), "".join(parts)))
    near = "".join(rng.choices("ghijk ", k=300))
    for _ in range(n // 2):
        at = rng.randrange(300)
        rows.append((rng.randrange(1000), near[:at] + rng.choice("ghA") + near[at + 1:]))
    rows += [(rng.randrange(1000), near)] * 20 + [(rng.randrange(1000), t) for _, t in rows[:10]]
    return rows + [(5, "ab" * 200), (7, "ab" * 500 + "tail"), (8, "\0" * 60), (9, "\0" * 60 + "a")]


@pytest.mark.parametrize("hot", [2000, 0, 15])
def test_against_plain_reading(spark, hot):
    rows = corpus(random.Random(hot), 80)
    got = found(spark, rows, hot_documents=hot)
    assert got == plain(rows)
    assert sum(r[2] for r in got) > 5000


def test_pieces_shards_and_small_transforms(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_BYTES", 4000)
    rng = random.Random(2)
    long = "".join(rng.choices("abcdefgh", k=400_000))
    rows = [(1, long), (2, long[:150_000] + "!" + long[150_000:]), (3, "x" + long[131_000:131_200]), (0, long[262_000:262_300] + "x")]
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    text = "a passage that is certainly longer than fifty bytes of text"
    rows = [(None, text), (3, text), (3, text), (3, text + "!"), (4, None), (5, ""), (6, text[:49]), (2, text[1:]), (9, "é" * 30), (10, "é" * 30 + "è")]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, "short")]) == plain([(1, "short")])


@pytest.mark.parametrize("length", [1, 3, 9, 50])
def test_interval_expansion_gives_equal_windows_equal_classes(length):
    rng = random.Random(length)
    for _ in range(60):
        letters = rng.choice([b"ab", b"abc", bytes(range(200))])
        parts = [bytes(rng.choices(letters, k=rng.randrange(1, 90))) for _ in range(rng.randrange(1, 20))]
        parts += [p[rng.randrange(len(p)):] + bytes(rng.choices(letters, k=rng.randrange(1, 30))) for p in parts]
        text, begins = bwt.joined(np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum([0, *map(len, parts)]))
        classes = bwt.window_classes(text, length)
        want, got = defaultdict(set), defaultdict(set)
        for i, p in enumerate(parts):
            for j in range(len(p) - length + 1):
                want[p[j:j + length]].add((i, j))
                got[int(classes[begins[i] + j])].add((i, j))
        assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))
