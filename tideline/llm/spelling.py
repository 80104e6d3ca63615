"""Spelling variants: words one code point apart, and the commoner form each leads to.

Forward and reversed words form two tries.  Every node has a number: the first
SHALLOW levels are numbered by their code points themselves (a word's are all below
256, so seven fit into a number), deeper nodes by a dictionary of the distinct
prefixes.  A word split at a position is then a pair of integers, (prefix node, suffix
node), and so is a word with the code point at a position skipped.  Two words differ by
one replaced code point if they share a skipped pair, and by an inserted or deleted one
if a skipped pair of the longer is a split pair of the shorter.  Equal numbers are equal
strings, so the joins are exact and no string is compared.

A pair of nodes fixes all but one code point, so no more words share it than the
alphabet has letters (90): there are no hot pairs.  Words of any length take work in
proportion to it: the dictionary knows prefixes beyond LONG_KEY code points by a
running SHA-256.

Defined results: a null text has no words; a null id counts as empty text; every row is
a document of its own; columns other than doc_id and text are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import documents_columns, matches, stored

LEAST_LENGTH = 7
LEAST_COUNT = 2
# A form occurs at least this many times as often as the word.
FORM_RATIO = 10
# One of so many (document, run) hashes loses a code point.
DELETE_ONE_OF = 31

# Levels whose nodes are numbered by their code points: 8 bits each after a leading 1.
SHALLOW = 6
LONG_KEY = 64

FLUSH_ENTRIES = 300_000
_RUN = re.compile(r"[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)


def variant(run: str, seed: int) -> str:
    """The run as it counts: without a code point where its hash says so."""
    h = zlib.crc32(run.encode(), seed)
    if h % DELETE_ONE_OF:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the batches, added up before they are shuffled."""
    total: Counter = Counter()

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                          names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
            if not text.is_valid:
                continue
            seed = zlib.crc32(f"{doc_id}:".encode())
            own: Counter = Counter()
            for runs in matches(_RUN, text.as_py().lower().decode()):
                own.update(runs)
            for run, n in own.items():
                word = variant(run, seed)
                if len(word) >= LEAST_LENGTH:
                    total[word] += n
        if len(total) > FLUSH_ENTRIES:
            yield flushed()
            total = Counter()
    yield flushed()


def words_of(docs: DataFrame) -> DataFrame:
    """(no, word, n) of the words: numbers follow the words' order by code points."""
    rows = documents_columns(docs, ["doc_id", "text"]).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT).orderBy("word").select(
        F.monotonically_increasing_id().alias("no"), "word", "n")


def _deep_keys(code: bytes) -> Iterator[bytes]:
    """Dictionary keys of the nodes below the shallow levels on a word's path."""
    for d in range(SHALLOW + 1, min(len(code), LONG_KEY) + 1):
        yield code[:d]
    digest = hashlib.sha256(code[:LONG_KEY])
    for d in range(LONG_KEY + 1, len(code) + 1):
        digest.update(code[d - 1:d])
        yield b"\0" + digest.copy().digest()  # no word holds a zero byte


_NODES = pa.schema([("side", pa.int8()), ("key", pa.binary()), ("no", pa.int64()), ("depth", pa.int32())])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(side, key, no, depth): the deep nodes on each word's two paths."""
    rows: list[list] = [[], [], [], []]

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(rows, _NODES.types, strict=True)], schema=_NODES)

    for batch in batches:
        for no, word in zip(batch.column("no").to_pylist(), batch.column("word").to_pylist(), strict=True):
            code = word.encode("latin-1")
            for side, path in enumerate((code, code[::-1])):
                for depth, key in enumerate(_deep_keys(path), SHALLOW + 1):
                    for values, value in zip(rows, (side, key, no, depth), strict=True):
                        values.append(value)
                    if len(rows[0]) >= FLUSH_ENTRIES:
                        yield flushed()
                        rows = [[], [], [], []]
    yield flushed()


def node_numbers(words: DataFrame) -> DataFrame:
    """(no, nodes): for each word its deep nodes, as side, depth and number."""
    paths = stored(words.select("no", "word").mapInArrow(_nodes, "side byte, key binary, no long, depth int"), "spelling-paths")
    dictionary = stored(paths.select("side", "key").distinct().withColumn(
        "node", F.monotonically_increasing_id()), "spelling-dictionary")
    return paths.join(dictionary, ["side", "key"]).groupBy("no").agg(
        F.collect_list(F.struct("side", "depth", "node")).alias("nodes"))


def path_numbers(code: bytes, depths: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Numbers of the nodes on a path, from the root: shallow ones above 0, deep ones below."""
    out = np.empty(len(code) + 1, dtype=np.int64)
    number = 1
    out[0] = number
    for d, byte in enumerate(code[:SHALLOW], 1):
        number = number << 8 | byte
        out[d] = number
    out[depths] = -1 - nodes
    return out


# Kinds of pairs: the whole word split, a code point skipped that differs from the next
# one, and one that equals it (skipping either gives the same string).
SPLIT, SKIPPED, SKIPPED_AGAIN = 0, 1, 2
_PAIRS = pa.schema([("f", pa.int64()), ("r", pa.int64()), ("kind", pa.int8()), ("no", pa.int64()), ("n", pa.int64())])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(prefix node, suffix node, kind, no, n): each word split and skipped at every position."""
    for batch in batches:
        lists = batch.column("nodes")
        fields = lists.values if isinstance(lists, pa.ListArray) else lists.flatten()
        side, depth, node = (np.asarray(fields.field(k)) for k in range(3))
        at = np.asarray(lists.offsets)
        parts: list[tuple] = []
        for i, (no, word, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("no", "word", "n")), strict=True)):
            code = word.encode("latin-1")
            own = slice(at[i], at[i + 1])
            ahead = side[own] == 0
            f = path_numbers(code, depth[own][ahead], node[own][ahead])
            r = path_numbers(code[::-1], depth[own][~ahead], node[own][~ahead])[::-1]
            letters = np.frombuffer(code, dtype=np.uint8)
            kinds = np.full(len(code), SKIPPED, dtype=np.int8)
            kinds[:-1][letters[:-1] == letters[1:]] = SKIPPED_AGAIN
            parts.append((np.concatenate([f, f[:-1]]), np.concatenate([r, r[1:]]),
                          np.concatenate([np.full(len(f), SPLIT, dtype=np.int8), kinds]),
                          np.full(2 * len(f) - 1, no), np.full(2 * len(f) - 1, n)))
        if parts:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(v), kind) for v, kind in zip(zip(*parts, strict=True), _PAIRS.types, strict=True)], schema=_PAIRS)


def near_words(words: DataFrame) -> DataFrame:
    """(no, other, other_n): each word with every word one code point away."""
    pairs = stored(words.join(node_numbers(words), "no").select("no", "word", "n", "nodes").mapInArrow(
        _pairs, "f long, r long, kind byte, no long, n long"), "spelling-pairs")
    a = pairs.select("f", "r", *[F.col(c).alias(f"a_{c}") for c in ("kind", "no", "n")])
    b = pairs.where(F.col("kind") != SPLIT).select("f", "r", *[F.col(c).alias(f"b_{c}") for c in ("kind", "no", "n")])
    met = a.join(b, ["f", "r"]).where(F.col("a_no") != F.col("b_no"))
    met = met.where((F.col("a_kind") != SPLIT) | (F.col("b_kind") == SKIPPED))

    def row(x: str, y: str):
        return F.struct(F.col(f"{x}_no").alias("no"), F.col(f"{y}_no").alias("other"), F.col(f"{y}_n").alias("other_n"))

    # Skipped pairs meet both ways by themselves, a split pair meets once.
    return met.select(F.explode(F.when(F.col("a_kind") == SPLIT, F.array(row("a", "b"), row("b", "a")))
                                .otherwise(F.array(row("a", "b")))).alias("near")).select("near.*")


def _roots(parents: DataFrame) -> DataFrame:
    """(no, root): the last form that each word with a form leads to.

    Counts grow tenfold with every form, so a chain has at most as many links as
    the largest count has digits; each round follows twice as many of them.
    """
    roots = parents.select("no", F.col("form_no").alias("root"))
    while True:
        ahead = roots.select(F.col("no").alias("root"), F.col("root").alias("next"))
        further = stored(roots.join(ahead, "root", "left").select("no", F.coalesce("next", "root").alias("root"), "next"), "spelling-roots")
        moved = further.where("next IS NOT NULL").limit(1).count()
        roots = further.select("no", "root")
        if not moved:
            return roots


def group_variants(docs: DataFrame) -> DataFrame:
    """Words of ``docs`` with their forms: word, form, root, n, n_near, form_n.

    ``n_near`` counts the words one inserted, deleted or replaced code point away.  The
    form is the commonest of them (ties: first by code points) if it occurs FORM_RATIO
    times as often; ``root`` is where following forms ends, the word itself if it has none.
    """
    words = stored(words_of(docs), "spelling-words")
    near = near_words(words).groupBy("no").agg(
        F.count("*").alias("n_near"), F.max(F.struct("other_n", (-F.col("other")).alias("minus"))).alias("best"))
    judged = words.join(near, "no", "left").select(
        "no", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("best.other_n") >= FORM_RATIO * F.col("n"), -F.col("best.minus")).alias("form_no"),
        F.when(F.col("best.other_n") >= FORM_RATIO * F.col("n"), F.col("best.other_n")).alias("form_n"))
    judged = stored(judged, "spelling-judged")
    roots = _roots(judged.where("form_no IS NOT NULL"))
    forms = words.select(F.col("no").alias("form_no"), F.col("word").alias("form"))
    ends = roots.join(words.select(F.col("no").alias("root"), F.col("word").alias("root_word")), "root").select("no", "root_word")
    return judged.join(forms, "form_no", "left").join(ends, "no", "left").select(
        "word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
