"""Byte passages that also stand in an earlier document, by suffix order within anchor groups.

A window is WINDOW consecutive bytes of one text.  A byte is removed if a window over
it also starts in a document with a smaller id.  Windows are compared by the classes
that interval expansion on a Burrows-Wheeler transform gives (``bwt``), and dealt to
tasks so that equal windows meet:

- A window's anchor is the least hash of its ANCHOR-byte strings, so equal windows have
  equal anchors, and neighbouring windows mostly share theirs.  A run of windows with
  one anchor is a segment.
- Anchors are counted by texts first, in shards whose number grows with the bytes.
  Windows whose anchor only one text holds need nothing more.
- Segments of the other anchors are shuffled by anchor; a task joins the distinct
  segments of some anchors into texts of bounded size and transforms those.
- An anchor in very many texts would be one task's work.  Its equal segments, then
  its equal windows, are reduced by grouped minimums and joined back instead.

A text that equals one with a smaller id is removed whole; only the first is searched.
Ids are integers.  Copies are told by SHA-256.  Anchors have 48-bit hashes besides their
shard; equal hashes of different anchors only send more segments.  Whether one or several
texts hold an anchor is told by 64-bit hashes of the texts: an anchor that only two texts
with equal hashes hold would be missed, a chance of about 5e-20 per pair of such texts.

Defined results: a null text is empty; rows of one id never remove each other's bytes
and each has its result; a null id neither removes nor loses bytes; texts under WINDOW
bytes keep all; columns other than doc_id and text are not read; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import bwt
from tideline.llm import wordhash as wh
from tideline.llm.common import documents_columns, stored

WINDOW = 50
ANCHOR = 20

# A segment ends after so many windows, however long its anchor repeats.
SEGMENT_WINDOWS = 1024
# Bytes of text read at once; longer texts are read in pieces that overlap by a window.
PIECE_BYTES = 1 << 17
# Text per counting shard, entries held before they are handed on, bytes per transform.
SHARD_BYTES = 32 << 20
FLUSH_ENTRIES = 1 << 20
TRANSFORM_BYTES = 1 << 19
# Texts from which on an anchor is reduced by grouping: fewer make some MB of segments.
HOT_DOCUMENTS = 50_000

_KEY_BITS = np.uint64((1 << 48) - 1)
_HOT = np.uint64(1 << 63)


def segments(data: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor key, first window, past the last window) of each segment of some texts' bytes.

    ``owner`` numbers the text of each byte.
    """
    none = np.zeros(0, dtype=np.int64)
    n = len(data) - WINDOW + 1
    if n <= 0:
        return none.astype(np.uint64), none, none
    up, down = wh._powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.multiply(wh._CODES[data], up[:len(data)], out=total[1:])
    np.cumsum(total, out=total)
    least = wh.mix((total[ANCHOR:] - total[:-ANCHOR]) * down[:len(data) - ANCHOR + 1])
    span = 1
    want = WINDOW - ANCHOR + 1
    while span * 2 <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < want:
        least = np.minimum(least[:span - want], least[want - span:])
    whole = owner[:n] == owner[WINDOW - 1:]
    cut = np.ones(n, dtype=bool)
    cut[1:] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1]) | (owner[1:n] != owner[:n - 1])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], n)
    inside = whole[first]
    first, last = first[inside], last[inside]
    pieces = -(-(last - first) // SEGMENT_WINDOWS)
    if len(pieces) and pieces.max() > 1:
        of = np.repeat(np.arange(len(first)), pieces)
        within = np.arange(len(of)) - (np.cumsum(pieces) - pieces)[of]
        begin = first[of] + within * SEGMENT_WINDOWS
        first, last = begin, np.minimum(last[of], begin + SEGMENT_WINDOWS)
    # A minimum is a small number; mixing spreads it again.
    return wh.mix(least[first]) & _KEY_BITS, first, last


def _read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, position in its text, key, first, last, bytes) of the segments, piece by piece of a batch."""
    for texts in wh.texts_of(batch.column("text"), PIECE_BYTES):
        if len(texts) == 1 and len(texts.data) > 2 * PIECE_BYTES:
            for at in range(0, len(texts.data) - WINDOW + 1, PIECE_BYTES):
                data = texts.data[at:at + PIECE_BYTES + WINDOW - 1]
                key, first, last = segments(data, np.zeros(len(data), dtype=np.int32))
                yield np.full(len(key), texts.first), first + at, key, first, last, data
            continue
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(texts.offsets))
        key, first, last = segments(texts.data, owner)
        own = owner[first] if len(first) else first
        yield own + texts.first, first - texts.offsets[own], key, first, last, texts.data


def _packed(keys: np.ndarray) -> bytes:
    """48-bit keys, six bytes each."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


_ENTRIES = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()),
                      ("digests", pa.binary()), ("counts", pa.binary())])
_ENTRIES_DDL = "shard long, part long, keys binary, docs binary, digests binary, counts binary"


def _anchors(shards: int):
    """Distinct anchors of each document, packed by shard; ``part`` numbers what a task hands on at once."""

    def flushed(number: int, *parts: list[np.ndarray]) -> pa.RecordBatch:
        key, doc, digest = (np.concatenate(p) for p in parts)
        order = np.lexsort((key, digest, doc))
        key, doc, digest = key[order], doc[order], digest[order]
        once = np.ones(len(key), dtype=bool)
        once[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1])
        shard = (wh.mix(key) % np.uint64(shards)).astype(np.int64)
        order = np.flatnonzero(once)
        order = order[np.argsort(shard[order], kind="stable")]
        key, doc, digest, shard = key[order], doc[order], digest[order], shard[order]
        cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard))
        rows = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            heads = np.flatnonzero(np.append(True, (doc[a + 1:b] != doc[a:b - 1]) | (digest[a + 1:b] != digest[a:b - 1])))
            counts = np.diff(np.append(heads, b - a)).astype(np.int32)
            rows.append((int(shard[a]), number, _packed(key[a:b]), doc[a:b][heads].tobytes(), digest[a:b][heads].tobytes(), counts.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_ENTRIES.types)], schema=_ENTRIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: tuple[list, list, list] = ([], [], [])
        held, number = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, digests = (np.asarray(batch.column(c), dtype=np.int64) for c in ("doc_id", "digest"))
            for row, _, key, _, _, _ in _read(batch):
                for part, values in zip(parts, (key, ids[row], digests[row]), strict=True):
                    part.append(values)
                held += len(key)
                if held >= FLUSH_ENTRIES:
                    yield flushed(number, *parts)
                    parts, held, number = ([], [], []), 0, number + 1
        if held:
            yield flushed(number, *parts)

    return run


_HELD = pa.schema([("part", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary())])


def _shared(hot_documents: int):
    """Anchors of a shard that several texts hold, and documents, given back by part."""

    def run(rows: pa.Table) -> pa.Table:
        keys = [_unpacked(v) for v in rows.column("keys").to_pylist()]
        number = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        keys = np.concatenate(keys)
        docs, digests = (np.concatenate([
            np.repeat(np.frombuffer(d, dtype=np.int64), np.frombuffer(c, dtype=np.int32))
            for d, c in zip(rows.column(name).to_pylist(), rows.column("counts").to_pylist(), strict=True)])
            for name in ("docs", "digests"))
        order = np.lexsort((digests, keys))
        sorted_keys, digests = keys[order], digests[order]
        fresh = np.append(True, sorted_keys[1:] != sorted_keys[:-1])
        heads = np.flatnonzero(fresh)
        sizes = np.diff(np.append(heads, len(keys)))
        texts = np.add.reduceat((fresh | np.append(True, digests[1:] != digests[:-1])).astype(np.int64), heads)
        marked = np.where(texts > hot_documents, _HOT, np.uint64(0))
        sorted_keys |= np.repeat(marked, sizes)
        use = order[np.repeat(texts > 1, sizes)]
        keys[order] = sorted_keys
        use.sort()
        cuts = np.searchsorted(number[use], np.arange(len(rows) + 1))
        return pa.table([rows.column("part").combine_chunks()] + [
            pa.array([values[use[a:b]].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())
            for values in (keys, docs)], schema=_HELD)

    return run


_SHARED = pa.schema([("doc_id", pa.int64()), ("keys", pa.binary()), ("hot", pa.bool_())])


def _by_document(rows: pa.Table) -> pa.Table:
    """A part's shared anchors by document."""
    keys = np.concatenate([np.frombuffer(v, dtype=np.uint64) for v in rows.column("keys").to_pylist()])
    docs = np.concatenate([np.frombuffer(v, dtype=np.int64) for v in rows.column("docs").to_pylist()])
    order = np.argsort(docs, kind="stable")
    keys, docs = keys[order], docs[order]
    cuts = np.append(np.flatnonzero(np.append(True, docs[1:] != docs[:-1])), len(docs)) if len(docs) else np.zeros(1, dtype=np.int64)
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    return pa.table([
        pa.array(docs[cuts[:-1]], pa.int64()), pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()),
        pa.array([bool((keys[a:b] & _HOT).any()) for a, b in spans], pa.bool_())], schema=_SHARED)


_SEGMENTS = pa.schema([("key", pa.int64()), ("segment", pa.binary()), ("doc_id", pa.int64()), ("digest", pa.int64()),
                       ("starts", pa.list_(pa.int32()))])
_SEGMENTS_DDL = "key long, segment binary, doc_id long, digest long, starts array<int>"


def _segments(hot: bool):
    """Distinct segments of each text whose anchors are shared, hot ones or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.and_(pc.is_valid(batch.column("keys")), pc.invert(batch.column("copy"))))
            if not batch.num_rows:
                continue
            known = batch.column("keys")
            ids, digests = batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist()
            out: dict[tuple[int, int, bytes], list[int]] = {}
            wanted: dict[int, np.ndarray] = {}
            for row, position, key, first, last, data in _read(batch):
                view = data.tobytes()
                cuts = np.append(np.flatnonzero(np.append(True, row[1:] != row[:-1])), len(row)) if len(row) else np.zeros(1, dtype=np.int64)
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    r = int(row[a])
                    if r not in wanted:
                        shared = np.frombuffer(b"".join(known[r].as_py()), dtype=np.uint64)
                        wanted[r] = shared[(shared & _HOT > 0) == hot] & ~_HOT
                    use = np.flatnonzero(np.isin(key[a:b], wanted[r])) + a
                    for k, p, i, j in zip(key[use].tolist(), position[use].tolist(), first[use].tolist(), last[use].tolist(), strict=True):
                        out.setdefault((r, k, view[i:j + WINDOW - 1]), []).append(p)
            if out:
                rows = [r for r, _, _ in out]
                yield pa.RecordBatch.from_arrays([
                    pa.array([k for _, k, _ in out], pa.int64()), pa.array([s for _, _, s in out], pa.binary()),
                    pa.array([ids[r] for r in rows], pa.int64()), pa.array([digests[r] for r in rows], pa.int64()),
                    pa.array(list(out.values()), pa.list_(pa.int32()))], schema=_SEGMENTS)

    return run


_SPANS = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
_SPANS_DDL = "doc_id long, digest long, begins array<int>, ends array<int>"


def _spans(docs: np.ndarray, digests: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Byte ranges in lists by text."""
    if not len(docs):
        return
    order = np.lexsort((begins, digests, docs))
    docs, digests = docs[order], digests[order]
    cuts = np.append(np.flatnonzero(np.append(True, (docs[1:] != docs[:-1]) | (digests[1:] != digests[:-1]))), len(docs))
    lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(v[order], pa.int32())) for v in (begins, ends)]
    yield pa.RecordBatch.from_arrays([pa.array(docs[cuts[:-1]], pa.int64()), pa.array(digests[cuts[:-1]], pa.int64()), *lists], schema=_SPANS)


def _transformed(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Ranges of the segments' windows that an earlier document holds."""
    coded = table.column("segment").combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    which = np.asarray(coded.indices, dtype=np.int64)
    docs = np.asarray(table.column("doc_id"), dtype=np.int64)
    digests = np.asarray(table.column("digest"), dtype=np.int64)
    distinct = coded.dictionary
    buffers = distinct.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int32)[distinct.offset:distinct.offset + len(distinct) + 1].astype(np.int64)
    text, begins = bwt.joined(np.frombuffer(buffers[2], dtype=np.uint8), offsets)
    classes = bwt.window_classes(text, WINDOW)
    first = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(first, which, docs)
    # The first document of each class of windows, then of each window of each segment.
    windows = np.diff(offsets) - WINDOW + 1
    owner = np.repeat(np.arange(len(distinct)), windows)
    ahead = np.cumsum(windows) - windows
    place = begins[owner] + np.arange(len(owner)) - ahead[owner]
    earliest = np.full(int(classes.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(earliest, classes[place], first[owner])
    by_window = earliest[classes[place]]
    # Every occurrence of a segment against them.
    sizes = windows[which]
    of = np.repeat(np.arange(len(which)), sizes)
    window = np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of]
    gone = by_window[ahead[which][of] + window] < docs[of]
    edge = np.diff(gone.astype(np.int8), prepend=0)
    fresh = np.append(True, of[1:] != of[:-1])
    opens = np.flatnonzero(gone & ((edge == 1) | fresh))
    closes = np.flatnonzero(gone & np.append((edge[1:] == -1) | fresh[1:], True))
    occurrence = of[opens]
    starts = table.column("starts").combine_chunks()
    if isinstance(starts, pa.ChunkedArray):
        starts = starts.combine_chunks()
    at, positions = np.asarray(starts.offsets, dtype=np.int64), np.asarray(starts.values, dtype=np.int64)
    times = at[occurrence + 1] - at[occurrence]
    rep = np.repeat(np.arange(len(occurrence)), times)
    position = positions[at[occurrence][rep] + np.arange(len(rep)) - (np.cumsum(times) - times)[rep]]
    yield from _spans(docs[occurrence][rep], digests[occurrence][rep],
                      position + window[opens][rep], position + window[closes][rep] + WINDOW)


def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, in groups of whole keys of about TRANSFORM_BYTES."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        step = 4096
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            if size >= TRANSFORM_BYTES:
                keys = np.asarray(part.column("key"))
                end = int(np.searchsorted(keys != held[-1].column("key")[-1].as_py(), True))
                if end < len(keys):
                    yield from _transformed(pa.Table.from_batches([*held, part.slice(0, end)]))
                    held, size, part = [], 0, part.slice(end)
            held.append(part)
            size += pc.sum(pc.binary_length(part.column("segment"))).as_py()
    if held:
        yield from _transformed(pa.Table.from_batches(held))


def _whole(rows: DataFrame) -> DataFrame:
    """The bytes under each segment, all of them to go."""
    ends = F.transform("starts", lambda s: (s + F.octet_length("segment")).cast("int"))
    return rows.select("doc_id", "digest", F.col("starts").alias("begins"), ends.alias("ends"))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of segments as segments of their own."""
    for batch in batches:
        rows: list[tuple] = []
        for row in batch.to_pylist():
            segment = row["segment"]
            for k in range(len(segment) - WINDOW + 1):
                rows.append((row["key"], segment[k:k + WINDOW], row["doc_id"], row["digest"], [s + k for s in row["starts"]]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_SEGMENTS.types)], schema=_SEGMENTS)


def _earlier(rows: DataFrame) -> DataFrame:
    """``rows`` with ``first``, the smallest document that holds the same segment."""
    first = rows.groupBy("segment").agg(F.min("doc_id").alias("first"))
    return rows.join(first, "segment").select("key", "segment", "doc_id", "digest", "starts", "first")


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and digest of what is left of each text."""
    for batch in batches:
        out: list[tuple] = []
        for text, digest, copy, lists in zip(batch.column("text").cast(pa.large_binary()), batch.column("digest").to_pylist(),
                                             batch.column("copy").to_pylist(), batch.column("found"), strict=True):
            data = text.as_py() or b""
            found = [(s["begins"], s["ends"]) for s in lists.as_py() or [] if s["digest"] == digest]
            if copy:
                found = [([0], [len(data)])]
            if not found:
                out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                continue
            pairs = np.concatenate([np.array(pair, dtype=np.int64).T for pair in found])
            pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
            reach = np.maximum.accumulate(pairs[:, 1])
            opens = np.flatnonzero(np.append(True, pairs[1:, 0] > reach[:-1]))
            begins, ends = pairs[opens, 0], reach[np.append(opens[1:], len(pairs)) - 1]
            kept = hashlib.sha256()
            at = 0
            for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            out.append((len(data), int((ends - begins).sum()), len(opens), kept.hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, hot_documents: int = HOT_DOCUMENTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each text without its repeats.

    ``n_spans`` counts the removed runs of bytes, ``kept_sha256`` is over the others.
    """
    rows = documents_columns(docs, ["doc_id", "text"]).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    narrow = stored(rows.select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("size")), "repeats-texts")
    size = narrow.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0
    firsts = narrow.where((F.col("size") >= WINDOW) & F.col("doc_id").isNotNull()).groupBy("sha").agg(F.min("doc_id").alias("first"))
    copies = stored(narrow.join(firsts, "sha").where(F.col("doc_id") > F.col("first")).groupBy("doc_id").agg(
        F.collect_set("sha").alias("copies")), "repeats-copies")
    shards = max(1, -(-size // SHARD_BYTES))
    entries = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= WINDOW)).select(
        "doc_id", "text", F.xxhash64("text").alias("digest")).mapInArrow(_anchors(shards), _ENTRIES_DDL)
    by_part = entries.groupBy("shard").applyInArrow(_shared(hot_documents), "part long, keys binary, docs binary")
    shared = stored(by_part.groupBy("part").applyInArrow(_by_document, "doc_id long, keys binary, hot boolean"), "repeats-anchors")
    # Everything from here on is one job over one shuffle of the texts by id, so texts are
    # not filtered before it; tasks pass over those they have nothing to do with.
    known = rows.join(copies, "doc_id", "left").select(
        "doc_id", "text", F.xxhash64("text").alias("digest"),
        F.coalesce(F.array_contains("copies", F.sha2("text", 256)), F.lit(False)).alias("copy"))

    def held(anchors: DataFrame, hot: bool) -> DataFrame:
        keys = anchors.groupBy("doc_id").agg(F.collect_list("keys").alias("keys"))
        return known.join(keys, "doc_id", "left").select("doc_id", "text", "digest", "copy", "keys").mapInArrow(
            _segments(hot), _SEGMENTS_DDL)

    found = held(shared, False).repartition("key").sortWithinPartitions("key").mapInArrow(_transform, _SPANS_DDL)
    if shared.where("hot").limit(1).count():
        hot = _earlier(held(shared.where("hot"), True))
        later = F.col("doc_id") > F.col("first")
        windows = _earlier(hot.where(~later).drop("first").mapInArrow(_windows, _SEGMENTS_DDL))
        for part in (hot, windows):
            found = found.unionByName(_whole(part.where(later)))
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("digest", "begins", "ends")).alias("found"))
    return known.join(spans, "doc_id", "left").select("doc_id", "text", "digest", "copy", "found").mapInArrow(
        _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
