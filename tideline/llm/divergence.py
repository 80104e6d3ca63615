"""How far each source's use of words is from that of the others of its language.

Counts of every (language, source) group are kept as count-level bitmaps: for each
count that occurs in a group, a bitset of the terms that have it.  For a pair of
groups, AND and popcount of two levels give the number of terms with those two
counts (a joint cell), which is multiplied by the divergence of the two shares.
Terms that one group lacks are the complement of its levels, so zeros are never
stored.  The terms of a language are dealt to blocks by hash; a block numbers its
own terms, and cells add up over blocks, so no task holds a whole language.

Shares are integers: ``p = 1 + floor(SCALE * (count + 2) / (N + 2 * V))`` with N the
group's occurrences of kept terms and V the kept terms of its language, and the
divergence of two shares is ``floor((p - q)^2 / (p + q))``.

Defined results: null texts, languages and sources count as empty ones; a group
without terms takes part with zero counts; a language without kept terms has pairs
of value 0 and no terms; every row is a document of its own; columns other than
lang, source and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import documents_columns, matches, stored

SCALE = 1_000_000_000
# A language keeps the terms that stand in at least so many of its documents.
LEAST_DOCUMENTS = 10
TOP_TERMS = 10

# Terms per block and sources per tile: they bound a task, not the result.
BLOCK_TERMS = 1 << 14
TILE_SOURCES = 64

# Entries that a counting task holds before it hands them on.
FLUSH_ENTRIES = 300_000
# Letters and non-ASCII bytes; bytes.lower() turns A-Z only.
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def _flushed(counts: dict, holders: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for (lang, source), words in counts.items():
        terms = list(words)
        if terms:
            held = holders[lang, source]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(words.values()), pa.int64()),
                pa.array([held[t] for t in terms], pa.int64())], schema=schema)


_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()),
                      ("n", pa.int64()), ("docs", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the batches, added up before they are shuffled."""
    counts: dict[tuple[str, str], Counter] = {}
    holders: dict[tuple[str, str], Counter] = {}
    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for key, text in zip(zip(langs, sources, strict=True), batch.column("text").cast(pa.large_binary()), strict=True):
            here, held = counts.setdefault(key, Counter()), holders.setdefault(key, Counter())
            own: set[bytes] = set()
            for words in matches(_TERM, text.as_py().lower()):
                here.update(words)
                own.update(words)
            held.update(own)
        if sum(map(len, counts.values())) > FLUSH_ENTRIES:
            yield from _flushed(counts, holders, _COUNTED)
            counts, holders = {}, {}
    yield from _flushed(counts, holders, _COUNTED)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of every group: occurrences and documents of each term."""
    texts = _filled(docs).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return texts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _filled(docs: DataFrame) -> DataFrame:
    rows = documents_columns(docs, ["lang", "source", "text"])
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])


def share(count: Column, occurrences: Column, kept: Column) -> Column:
    """The integer share of a count among a group's occurrences, exact at any size."""
    wide = "decimal(38,0)"
    top = (count.cast("decimal(20,0)") + 2) * F.lit(SCALE).cast("decimal(10,0)")
    under = occurrences.cast("decimal(20,0)") + kept.cast("decimal(20,0)") * 2
    return F.call_function("div", top.cast(wide), under.cast(wide)) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _shares(counts: list[int], occurrences: int, kept: int) -> np.ndarray:
    """``share`` of 0 and of each count, as numbers."""
    return np.array([1 + SCALE * (c + 2) // (occurrences + 2 * kept) for c in [0, *counts]], dtype=np.int64)


class Levels:
    """Count-level bitmaps of one group over the terms of a block."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, words: int, occurrences: int, kept: int):
        levels, which = np.unique(counts, return_inverse=True)
        self.bits = np.zeros((len(levels), words), dtype=np.uint64)
        np.bitwise_or.at(self.bits, (which, ids >> 6), np.uint64(1) << (ids & 63).astype(np.uint64))
        self.sizes = np.bincount(which, minlength=len(levels)).astype(np.int64)
        self.shares = _shares(levels.tolist(), occurrences, kept)
        # The words of a level that are not empty: an AND reads no others.
        self.filled = [np.flatnonzero(row) for row in self.bits]


def pair_value(a: Levels, b: Levels, n_terms: int) -> int:
    """The divergence of two groups, added up over the terms of a block."""
    p, q = a.shares[:, None], b.shares[None, :]
    f = (p - q) * (p - q) // (p + q)
    total, seen = 0, np.zeros(len(b.sizes), dtype=np.int64)
    joint = 0
    for i, words in enumerate(a.filled):
        cells = np.bitwise_count(a.bits[i, words] & b.bits[:, words]).sum(axis=1, dtype=np.int64)
        both = int(cells.sum())
        total += int(cells @ f[i + 1, 1:]) + (int(a.sizes[i]) - both) * int(f[i + 1, 0])
        seen += cells
        joint += both
    total += int((b.sizes - seen) @ f[0, 1:])
    neither = n_terms - int(a.sizes.sum()) - int(b.sizes.sum()) + joint
    return total + neither * int(f[0, 0])


_PAIRED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _block(key: tuple, rows: pa.Table, groups: pa.Table) -> pa.Table:
    """Partial values of the pairs of one tile pair over one block of a language's terms."""
    lang, _, low, high = (k.as_py() for k in key)
    coded = rows.column("term").combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    ids = np.asarray(coded.indices, dtype=np.int64)
    counts = np.asarray(rows.column("n"), dtype=np.int64)
    owner = rows.column("source").to_pylist()
    by_source: dict[str, list[int]] = {}
    for i, source in enumerate(owner):
        by_source.setdefault(source, []).append(i)
    words = (len(coded.dictionary) + 63) // 64
    levels: dict[str, Levels] = {}
    tiles: dict[str, int] = {}
    n_terms = 0
    for g in groups.to_pylist():
        mine = np.array(by_source.get(g["source"], []), dtype=np.int64)
        levels[g["source"]] = Levels(ids[mine], counts[mine], words, g["occurrences"], g["kept"])
        tiles[g["source"]] = g["tile"]
        n_terms = g["block_terms"]
    names = sorted(levels)
    out: list[tuple[str, str, int]] = []
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            if {tiles[a], tiles[b]} == {low, high}:
                out.append((a, b, pair_value(levels[a], levels[b], n_terms)))
    return pa.table([pa.array([lang] * len(out), pa.string()), *(
        pa.array([row[k] for row in out], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64())))], schema=_PAIRED)


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS,
          block_terms: int = BLOCK_TERMS, tile_sources: int = TILE_SOURCES) -> DataFrame:
    """Divergence of sources and their most telling terms: lang, source, part, item, value, rank.

    Part ``pair``: every other source of the language by the divergence of the two groups,
    summed over all kept terms.  Part ``term``: the ``top_terms`` terms that a source uses
    more than its language does.  Ranks run from 1 per group and part, by value descending
    and item ascending.
    """
    counts = stored(term_counts(docs), "audit-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("of_lang"))
    kept = stored(kept.where(F.col("docs") >= least_documents).select("lang", "term", "of_lang"), "audit-kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("of_lang").alias("of_all"))
    used = stored(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "audit-used")
    sizes = used.groupBy("lang", "source").agg(F.sum("n").alias("occurrences"))
    groups = (
        _filled(docs).select("lang", "source").distinct()
        .join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", F.coalesce("occurrences", F.lit(0)).alias("occurrences"),
                F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("of_all", F.lit(0)).alias("of_all"))
    )
    tiles = F.ceil(F.count("*").over(Window.partitionBy("lang")) / tile_sources).cast("int")
    groups = groups.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    groups = stored(groups, "audit-groups")
    pairs = _pairs(used, kept, groups, block_terms)
    terms = _terms(used, groups, top_terms)
    return pairs.unionByName(terms)


def _pairs(used: DataFrame, kept: DataFrame, groups: DataFrame, block_terms: int) -> DataFrame:
    blocks = F.greatest(F.ceil(F.col("kept") / block_terms), F.lit(1))
    block = F.pmod(F.xxhash64("term", F.lit("block")), blocks.cast("long")).cast("int").alias("block")
    # A tile meets every tile of its language, itself included; the lower one is named first.
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(
        F.least(F.col("tile"), t).alias("low"), F.greatest(F.col("tile"), t).alias("high")))).alias("meets")
    keys = ["lang", "block", "low", "high"]
    rows = used.join(groups.select("lang", "source", "kept", "tiles", "tile"), ["lang", "source"]).select(
        "lang", "source", "term", "n", block, meets).select("lang", "source", "term", "n", "block", "meets.*")
    langs = groups.select("lang", "kept").distinct()
    sizes = kept.join(langs, "lang").select("lang", block).groupBy("lang", "block").agg(F.count("*").alias("block_terms"))
    members = groups.join(sizes, "lang").select(
        "lang", "block", "source", "occurrences", "kept", "tile", "block_terms", meets).select(
        "lang", "block", "source", "occurrences", "kept", "tile", "block_terms", "meets.*")
    parts = rows.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(
        _block, "lang string, source string, item string, value long")
    values = stored(parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "audit-pairs")
    both = values.unionByName(values.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    # Each group with each other one of its language, which is what is asked for.
    every = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where(
        F.col("source") != F.col("item"))
    found = every.join(both, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)).cast("long"))
    return _ranked(found, "pair")


def _terms(used: DataFrame, groups: DataFrame, top_terms: int) -> DataFrame:
    rows = used.join(groups, ["lang", "source"])
    p = share(F.col("n"), F.col("occurrences"), F.col("kept"))
    q = share(F.col("of_lang"), F.col("of_all"), F.col("kept"))
    rows = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    rows = rows.select("lang", "source", "item", divergence(F.col("p"), F.col("q")).cast("long").alias("value"))
    return _ranked(rows, "term").where(F.col("rank") <= top_terms)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by).alias("rank"))
