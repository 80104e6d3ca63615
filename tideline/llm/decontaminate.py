"""Benchmark decontamination with broadcast sets of normalised test n-grams.

Words are runs of digits, letters and non-ASCII characters after A-Z is
lower-cased.  An item's n-grams are its windows of WINDOW_WORDS words, or the
whole item if it has fewer.  Windows of training texts are looked up by hash, and
every hit is verified word by word.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import wordhash as wh
from tideline.llm.common import documents_columns, stored

WINDOW_WORDS = 10

# Windows in one broadcast (about 250 bytes each).  A larger benchmark is looked
# up in several rounds over the texts, each with windows of its own, whose spans
# are then merged by the id that every row gets.
BROADCAST_WINDOWS = 400_000

# A longer window is told by its SHA-256, so that a broadcast is bounded in bytes too.
SPELLED_BYTES = 256

# Bits of the table that most windows fail at first.
_FILTER_BITS = 22


def _spelled(data: np.ndarray, found: wh.Words, at: int, size: int) -> bytes:
    words = b" ".join(data[found.starts[i]:found.ends[i]].tobytes() for i in range(at, at + size))
    # No word holds the first byte of a digest.
    return words if len(words) <= SPELLED_BYTES else b"\0" + hashlib.sha256(words).digest()


def _item_windows(size: int):
    """(hash, words, spelled, item) of each distinct window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item").to_pylist()
            out: list[tuple[int, int, bytes, str]] = []
            for texts in wh.texts_of(batch.column("text")):
                found = wh.words(texts, wh.alphanumeric())
                data = wh.LOWER[texts.data]
                for i, (a, b) in enumerate(zip(found.ptr[:-1].tolist(), found.ptr[1:].tolist(), strict=True)):
                    width = min(size, b - a)
                    if not width:
                        continue
                    own = wh.Words(found.hashes[a:b], found.starts[a:b], found.ends[a:b], found.ptr[:0])
                    hashes = wh.windows(own, width)[: b - a - width + 1].view(np.int64).tolist()
                    for k, h in enumerate(hashes):
                        out.append((h, width, _spelled(data, own, k, width), ids[texts.first + i]))
            columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["hash", "words", "spelled", "item"])

    return run


def _lookup(windows: list) -> dict:
    """By window length: a bit table, and spelled windows with their ids by hash."""
    sizes: dict[int, dict[int, dict[bytes, int]]] = defaultdict(dict)
    for row in windows:
        sizes[row["words"]].setdefault(row["hash"], {})[bytes(row["spelled"])] = row["window"]
    out = {}
    for size, by_hash in sizes.items():
        table = np.zeros(1 << _FILTER_BITS, dtype=bool)
        keys = np.fromiter(by_hash, dtype=np.int64).view(np.uint64)
        table[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        out[size] = (np.packbits(table), by_hash)
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans that neither touch nor overlap."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _hits(lookup, every: bool):
    """Per text: its id, number of words, spans that are hit, and window ids.

    A span has words start to end and code points first to last, ends exclusive.
    Texts without a hit are left out unless ``every`` says otherwise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {size: (np.unpackbits(bits).view(bool), by_hash) for size, (bits, by_hash) in lookup.value.items()}
        for batch in batches:
            counts, hit_spans, windows = [], [], []
            for texts in wh.texts_of(batch.column("text")):
                found = wh.words(texts, wh.alphanumeric())
                data = wh.LOWER[texts.data]
                spans: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
                met: list[set[int]] = [set() for _ in range(len(texts))]
                for size, (table, by_hash) in tables.items():
                    hashes = wh.windows(found, size)[: max(0, len(found.hashes) - size + 1)]
                    maybe = np.flatnonzero(table[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
                    if not len(maybe):
                        continue
                    owner = np.searchsorted(found.ptr, maybe, side="right") - 1
                    inside = maybe + size <= found.ptr[owner + 1]
                    for at, row in zip(maybe[inside].tolist(), owner[inside].tolist(), strict=True):
                        spelled = by_hash.get(int(hashes[at].view(np.int64)))
                        named = spelled.get(_spelled(data, found, at, size)) if spelled else None
                        if named is not None:
                            spans[row].append((at, at + size))
                            met[row].add(named)
                for i, (a, b) in enumerate(zip(found.ptr[:-1].tolist(), found.ptr[1:].tolist(), strict=True)):
                    counts.append(b - a)
                    merged = _merged(spans[i])
                    begin = int(texts.offsets[i])
                    # Bytes to code points: continuation bytes do not count.
                    hit_spans.append([])
                    if merged:
                        lead = np.cumsum((texts.data[begin:int(texts.offsets[i + 1])] & 0xC0) != 0x80)
                        for s, e in merged:
                            first, last = int(found.starts[s]) - begin, int(found.ends[e - 1]) - begin - 1
                            hit_spans[-1].append({
                                "start": s - a, "end": e - a, "first": int(lead[first]) - 1, "last": int(lead[last])})
                    windows.append(sorted(met[i]))
            span = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "first", "last")]))
            out = pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(counts, pa.int64()), pa.array(hit_spans, span),
                 pa.array(windows, pa.list_(pa.int64()))],
                names=["_id", "n_words", "spans", "windows"],
            )
            yield out if every else out.filter(pa.array([len(w) > 0 for w in windows], pa.bool_()))

    return run


_SPAN = "array<struct<start:bigint,end:bigint,first:bigint,last:bigint>>"


def _union_spans(column: str) -> Column:
    """Spans of several rounds as one sorted list in which none touch or overlap."""
    lists = F.collect_list(column)
    every = F.array_sort(F.flatten(lists))
    empty = F.array().cast(_SPAN)

    def add(acc, s):
        last = F.element_at(acc, -1)
        grown = F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"),
                             last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"))))
        return F.when((F.size(acc) > 0) & (s["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), grown).otherwise(
            F.concat(acc, F.array(s)))

    # The spans of one round are merged already.
    return F.when(F.size(lists) == 1, F.element_at(lists, 1)).otherwise(F.aggregate(every, empty, add))


def _part_of(spans: Column, start: str, end: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s[start].alias("start"), s[end].alias("end")))


def _with_ids(docs: DataFrame, keys: list[str]) -> DataFrame:
    """A stored table of ``docs``: _id, text, and the keys as _k0, _k1, ... whatever their names."""
    rows = documents_columns(docs, [*keys, "text"]).toDF(*[f"_k{i}" for i in range(len(keys))], "text")
    return stored(rows.withColumn("_id", F.monotonically_increasing_id()), "decontamination-rows")


def _named(rows: DataFrame, keys: list[str]) -> list[Column]:
    return [rows[f"_k{i}"].alias(k) for i, k in enumerate(keys)]


def _windows_of(benchmark: DataFrame, size: int) -> DataFrame:
    """A stored table of distinct windows: window (an id), hash, words, spelled, items."""
    windows = (
        documents_columns(benchmark, ["item_id", "text"])
        .select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
        .mapInArrow(_item_windows(size), "hash long, words long, spelled binary, item string")
        .groupBy("hash", "words", "spelled").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    return stored(windows.withColumn("window", F.monotonically_increasing_id()), "decontamination-windows")


def _found(rows: DataFrame, windows: DataFrame, broadcast_windows: int) -> DataFrame:
    """Per row of a table with ids: _id, n_words, word_spans, char_spans and ids of the windows in it.

    Each round broadcasts windows without their items; only the first one returns rows
    without a hit.  Neither texts nor other columns are moved.
    """
    spark = rows.sparkSession
    rounds = max(1, -(-windows.count() // broadcast_windows))
    schema = f"_id long, n_words long, spans {_SPAN}, windows array<long>"
    every = None
    for i in range(rounds):
        part = windows.where(F.pmod(F.xxhash64("spelled"), F.lit(rounds)) == i).select("window", "hash", "words", "spelled")
        lookup = spark.sparkContext.broadcast(_lookup(part.toArrow().to_pylist()))
        found = rows.select("_id", "text").mapInArrow(_hits(lookup, every is None), schema)
        every = found if every is None else every.unionByName(found)
    merged = every.groupBy("_id").agg(
        F.max("n_words").alias("n_words"), _union_spans("spans").alias("spans"),
        F.flatten(F.collect_list("windows")).alias("windows"))
    return merged.select("_id", "n_words", _part_of(F.col("spans"), "start", "end").alias("word_spans"),
                         _part_of(F.col("spans"), "first", "last").alias("char_spans"), "windows")


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, keys: list[str], size: int = WINDOW_WORDS,
                   broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Benchmark passages in each text of ``docs``.

    ``docs`` has ``keys`` and text, ``benchmark`` item_id and text.  Returns per row
    the keys, n_words, word_spans (of words, from 0, end exclusive), char_spans
    (of code points) and items, the sorted ids as text of all items with a window in
    it.  Null texts have no words; items without words have no windows, and a null
    item_id is named by the empty text.  Rows are looked up one by one, whatever their
    keys and however large the benchmark; an empty benchmark hits nothing.
    """
    rows = _with_ids(docs, keys)
    windows = _windows_of(benchmark, size)
    found = stored(_found(rows, windows, broadcast_windows), "decontamination-hits")
    items = (
        found.select("_id", F.explode("windows").alias("window"))
        .join(windows.select("window", "items"), "window")
        .groupBy("_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    )
    return rows.drop("text").join(found.drop("windows"), "_id").join(items, "_id", "left").select(
        *_named(rows, keys), "n_words", "word_spans", "char_spans",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def hit_words(column: str = "word_spans"):
    return F.aggregate(column, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])


def digest(hits: DataFrame) -> DataFrame:
    """Counts per document, and a digest of the items it holds."""
    return hits.select(
        "doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("word_spans") > 0).alias("contaminated"),
    )


def remove_spans(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.5, size: int = WINDOW_WORDS,
                 broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` without benchmark passages, with the same columns.

    A text loses its hit spans, and n_chars follows; a document of whose words more
    than ``max_share`` are hit goes.  Texts without a hit, null texts among them, stay
    as they are, and so do repeated rows.  Spans meet their rows by id in one join,
    which moves texts once at most.
    """
    keys = [c for c in docs.columns if c != "text"]
    rows = _with_ids(docs, keys)
    found = _found(rows, _windows_of(benchmark, size), broadcast_windows)
    cut = found.where(F.size("windows") > 0).select("_id", "n_words", "word_spans", "char_spans")
    hits = rows.join(cut, "_id", "left")
    is_cut = F.col("n_words").isNotNull()
    ends = F.transform("char_spans", lambda s: s["end"])
    starts = F.concat(F.transform("char_spans", lambda s: s["start"]), F.array(F.length("text").cast("long")))
    begins = F.concat(F.array(F.lit(0).cast("long")), ends)
    kept = F.array_join(F.zip_with(begins, starts, lambda a, b: F.substring("text", (a + 1).cast("int"), (b - a).cast("int"))), "")
    out = hits.where(~is_cut | (hit_words() <= F.lit(max_share) * F.col("n_words"))).select(
        *[F.col(f"_k{i}") for i in range(len(keys))], F.when(is_cut, kept).otherwise(F.col("text")).alias("text"), is_cut.alias("_cut"))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("text"))
            continue
        value = F.col(f"_k{keys.index(c)}")
        if c == "n_chars":
            value = F.when(F.col("_cut"), F.length("text").cast(dict(docs.dtypes)[c])).otherwise(value)
        columns.append(value.alias(c))
    return out.select(*columns)


def items_digest(ids: list[str]) -> str:
    """Digest of item ids, as ``digest`` writes it."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
