"""Exact Jaccard join of word-window sets through pivots and triangle-inequality windows.

Jaccard distance d = 1 - |x & y| / |x | y| is a metric, and two documents link
when d <= EPS.  The join works on distinct sets (documents with equal sets are one
class) and never lists all pairs of a group:

1. Pivots and regions.  All sets share one order of windows, frequent ones last.
   Two linked sets share a window among the first n - ceil(t * n) + 1 of each.
   Under each such window the sets, by size, elect pivots: the smallest, then the
   next one 1/t times as large, and so on.  A pivot's region takes the sets up to
   1/t**2 times its size, so that a linked pair meets in a region whichever side
   of a border it falls on.  A set whose place of the window leaves too little
   overlap with anything as large as the pivot stays out.
2. Windows.  Only distances to pivots are measured.  Sets within EPS of the
   pivot are linked to it, and so are in one component.  A set farther out can
   only link to members whose distance to the pivot differs from its own by EPS
   at most (triangle inequality): members that near to the border stay with it.
3. Recursion.  What is farther out, with its border, joins again as a region with
   an order and pivots of its own; each round takes at least the pivot out.  Large
   regions do a round as a Spark job, all of them at once; a region of bounded
   size recurses inside a task.

Copies are classes, hot windows have a pivot known before the shuffle, and joins
on a pivot are split by the adaptive skew join, so no group is gathered whole.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import wordhash as wh
from tideline.llm.common import documents_columns, output_schema, stored
from tideline.llm.components import connected_components

SHINGLE_WORDS = 5
LINK_PERCENT = 80  # linked: 100 * intersection >= LINK_PERCENT * union

# Windows found in three sets or more stand later in the order, by how many.  At most so
# many of them are known to every task (20 bytes each), the most frequent first; the
# others count as rare.  This changes how much work there is, never what is found.
KNOWN_WINDOWS = 1_000_000
# A window of at least so many sets gets its pivot from the count, so that its rows
# need not meet in one task.
HOT_WINDOW_SETS = 20_000
# Share of a set's first windows that is counted, as a multiple of what is joined on.
COUNTED_SHARE = 1.4
# Regions up to this many sets and windows (8 bytes each) recurse inside one task.
REGION_SETS = 2000
REGION_WINDOWS = 2_000_000
# Bits of the filter that keeps sets without a partner from being moved: 10 per
# candidate, at most this many (16 MB).
FILTER_BITS = 1 << 27


def prefix_length(n: int, percent: int = LINK_PERCENT) -> int:
    """Windows among which two linked sets surely share one."""
    return n - -(-n * percent // 100) + 1


def linked(both: int, either: int, percent: int = LINK_PERCENT) -> bool:
    return 100 * both >= percent * either


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _classes(texts, size):
    """(signature, sorted distinct windows) of each text; None for an empty set."""
    for values in wh.shingle_sets(texts, wh.non_space(), size):
        yield (wh.set_signature(values), values) if len(values) else None


def _set_rows(size: int):
    """Per document: its number of windows and its class, beside all columns but the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, classes = [], []
            for texts in wh.texts_of(batch.column("text")):
                for found in _classes(texts, size):
                    counts.append(len(found[1]) if found else 0)
                    classes.append(found[0] if found else None)
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(counts, pa.int64()), pa.array(classes, pa.int64())],
                names=[*names, "n_shingles", "class"],
            )

    return run


def _hash_prefixes(size: int, percent: int, share: float):
    """The first windows by hash of each class of this task, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for texts in wh.texts_of(batch.column("text")):
                keys, owners, counts = [], [], []
                for found in _classes(texts, size):
                    if found is None or found[0] in seen:
                        continue
                    seen.add(found[0])
                    k = min(len(found[1]), math.ceil(share * prefix_length(len(found[1]), percent)))
                    keys.append(found[1][:k])
                    owners.append(found[0])
                    counts.append(k)
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_signed(np.concatenate(keys))),
                         pa.array(np.repeat(np.array(owners, dtype=np.int64), counts))],
                        names=["window", "class"],
                    )

    return run


def _ordered_prefixes(size: int, percent: int, hot):
    """The joined-on windows of each class of this task, once; hot ones with their pivot.

    ``place`` holds the set's size (upper half) and the window's place in its order.
    ``hot`` broadcasts the known windows (sorted), their counts, and for hot ones a
    pivot class (else 0).  Rows of a hot window need no meeting, so they are dealt
    out by their class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, counts, pivots = hot.value
        seen: set[int] = set()
        for batch in batches:
            for texts in wh.texts_of(batch.column("text")):
                dealt, owners, places, pivot_of = [], [], [], []
                for found in _classes(texts, size):
                    if found is None or found[0] in seen:
                        continue
                    seen.add(found[0])
                    values = found[1]
                    k = prefix_length(len(values), percent)
                    known = np.zeros(0, dtype=bool)
                    if len(windows):
                        at = np.minimum(np.searchsorted(windows, values), len(windows) - 1)
                        known = windows[at] == values
                    if known.any():
                        often = np.where(known, counts[at], 1)
                        order = np.lexsort((values, often))[:k]
                        first, chosen = values[order], np.where(known[order], pivots[at[order]], 0)
                    else:
                        first, chosen = values[:k], np.zeros(k, dtype=np.int64)
                    place = (len(values) << 32) + np.arange(k, dtype=np.int64)
                    meet = chosen == 0
                    dealt.append(_signed(first)[meet])
                    places.append(place[meet])
                    given = np.unique(chosen[~meet])
                    given = given[given != found[0]]
                    same = np.full(len(given), found[0], dtype=np.int64)
                    dealt.append(same)
                    places.append(same)
                    pivot_of.extend([np.zeros(int(meet.sum()), dtype=np.int64), given])
                    owners.append(np.full(int(meet.sum()) + len(given), found[0], dtype=np.int64))
                if owners:
                    pivot = np.concatenate(pivot_of)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(dealt)), pa.array(np.concatenate(owners)),
                         pa.array(np.concatenate(places)), pa.array(pivot, mask=pivot == 0)],
                        names=["window", "class", "place", "pivot"],
                    )

    return run


class _Election:
    """Pivots of one window, met by sets in order of size."""

    def __init__(self, percent: int):
        self.percent = percent
        self.window: object = None
        self.pivots: list[tuple[int, int]] = []

    def meet(self, window: object, size: int, place: int, owner: int) -> list[int]:
        """Pivots whose region ``owner`` joins."""
        t = self.percent
        if window != self.window:
            self.window, self.pivots = window, []
        if not self.pivots or size * t > self.pivots[-1][0] * 100:
            self.pivots = [*self.pivots[-1:], (size, owner)]
        return [
            pivot for least, pivot in self.pivots
            if pivot != owner and size * t * t <= least * 10_000
            and (100 + t) * (size - place) >= t * (size + least)
        ]


def _elect(percent: int, least_run: int):
    """Regions and pairs from rows sorted by region, window, size and class.

    Windows of at least ``least_run`` sets hold an election, a row at a time, and
    give a MEMBER row per set and pivot and a SEEN row per set.  A window of two
    sets, if that is less, gives a PAIR row.  Only the pivots of the current window
    are kept, and at most two rows from one batch to the next.
    """
    columns = ("region", "window", "place", "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        election = _Election(percent)
        held = [np.zeros(0, dtype=np.int64) for _ in columns]
        open_key = None  # of a window whose election has begun and may go on
        for batch in itertools.chain(batches, [None]):
            out = _Rows()
            if batch is not None:
                direct = np.asarray(batch.column("pivot").is_valid())
                own = batch.column("class").to_numpy(zero_copy_only=False)
                if direct.any():
                    out.add(own[direct], batch.column("pivot").drop_null().to_numpy(zero_copy_only=False), MEMBER)
                new = [batch.column(c).to_numpy(zero_copy_only=False)[~direct] for c in columns]
                held = [np.concatenate([h, n]) for h, n in zip(held, new, strict=True)]
            region, window, place, owner = held
            n = len(window)
            if not n:
                if out:
                    yield out.batch()
                continue
            begins = np.flatnonzero(np.concatenate([[True], (window[1:] != window[:-1]) | (region[1:] != region[:-1])]))
            sizes = np.diff(np.concatenate([begins, [n]]))
            keys = list(zip(region[begins[[0, -1]]].tolist(), window[begins[[0, -1]]].tolist(), strict=True))
            goes_on = np.zeros(len(begins), dtype=bool)
            goes_on[0] = keys[0] == open_key
            elects = goes_on | (sizes >= least_run)
            stop = n
            if batch is not None and not elects[-1]:
                # The last window may have more sets in the next batch.
                stop = int(begins[-1])
            open_key = keys[1] if elects[-1] else None
            complete = begins < stop
            twos = begins[complete & ~elects & (sizes == 2)]
            if len(twos):
                near = (place[twos + 1] >> 32) * percent <= (place[twos] >> 32) * 100
                out.add(owner[twos + 1][near], owner[twos][near], PAIR, place[twos + 1][near] >> 32,
                        place[twos][near] >> 32, region[twos][near])
            rows = np.repeat(elects & complete, sizes)
            out.add(owner[rows], owner[rows], SEEN, of=region[rows])
            met: tuple[list[int], list[int], list[int]] = ([], [], [])
            for r, w, p, c in zip(region[rows].tolist(), window[rows].tolist(), place[rows].tolist(),
                                  owner[rows].tolist(), strict=True):
                for pivot in election.meet((r, w), p >> 32, p & 0xFFFFFFFF, c):
                    for column, value in zip(met, (c, pivot, r), strict=True):
                        column.append(value)
            out.add(np.array(met[0], dtype=np.int64), np.array(met[1], dtype=np.int64), MEMBER, of=np.array(met[2], dtype=np.int64))
            held = [h[stop:] for h in held]
            if out:
                yield out.batch()

    return run


# Kinds of rows that elections give.
MEMBER, PAIR, SEEN = 0, 1, 2
_ELECTED = "class long, pivot long, kind int, size long, pivot_size long, region long"


class _Rows:
    """Rows of an election's output."""

    def __init__(self):
        self.parts: list[list[np.ndarray]] = []

    def __bool__(self) -> bool:
        return bool(self.parts)

    def add(self, own, pivot, kind, size=None, pivot_size=None, of=None) -> None:
        if len(own):
            zero = np.zeros(len(own), dtype=np.int64)
            self.parts.append([own, pivot, np.full(len(own), kind, dtype=np.int32),
                               *(zero if x is None else x for x in (size, pivot_size, of))])

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x)) for x in zip(*self.parts, strict=True)],
            names=["class", "pivot", "kind", "size", "pivot_size", "region"])


def _worth_measuring(elected: DataFrame, percent: int) -> DataFrame:
    """(class, pivot, member) of the pairs whose distance is needed.

    Where a window has two sets only, they are a pair and nobody else is in their
    region, so the pair can be judged alone: two linked sets share a number of their
    first windows (all but n - overlap of them, on the side whose first windows end
    first).  A pair shares its windows of two, which are counted, and at most as many
    others as either set has windows of more.  Pairs below the number are not linked.
    """
    seen = elected.where(F.col("kind") == SEEN).groupBy("class").agg(F.count("*").alias("others"))
    pairs = elected.where(F.col("kind") == PAIR).groupBy("class", "pivot").agg(
        F.count("*").alias("shared"), F.first("size").alias("size"), F.first("pivot_size").alias("pivot_size"))
    n, m = F.col("size"), F.col("pivot_size")
    overlap = F.ceil((n + m) * percent / (100 + percent))

    def first(size):
        return size - F.ceil(size * percent / 100) + 1

    needed = F.least(first(n) - (n - overlap), first(m) - (m - overlap))
    own = F.coalesce(F.col("others"), F.lit(0))
    theirs = F.coalesce(F.col("pivot_others"), F.lit(0))
    # The bounds are whole numbers from ratios; one less leaves room for rounding.
    likely = (
        pairs.join(seen, "class", "left")
        .join(seen.select(F.col("class").alias("pivot"), F.col("others").alias("pivot_others")), "pivot", "left")
        .where(F.col("shared") + F.least(own, theirs) >= needed - 1)
    )
    members = elected.where(F.col("kind") == MEMBER).select("class", "pivot", F.lit(True).alias("member"))
    both = members.unionByName(likely.select("class", "pivot", F.lit(False).alias("member")))
    return both.groupBy("class", "pivot").agg(F.max("member").alias("member"))


def _wanted_sets(size: int, bits):
    """Sets of the classes that the filter lets through, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = bits.value
        seen: set[int] = set()
        for batch in batches:
            for texts in wh.texts_of(batch.column("text")):
                owners, sets = [], []
                for found in _classes(texts, size):
                    if found is None or found[0] in seen or not _marked(marks, found[0]):
                        continue
                    seen.add(found[0])
                    owners.append(found[0])
                    sets.append(found[1].tobytes())
                if owners:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(owners, pa.int64()), pa.array(sets, pa.binary())],
                        names=["class", "windows"],
                    )

    return run


def _marked(marks: np.ndarray, value: int) -> bool:
    n = len(marks) * 8
    spots = ((value & 0xFFFFFFFF) % n, ((value >> 32) & 0xFFFFFFFF) * 1000003 % n)
    return all(marks[s >> 3] >> (s & 7) & 1 for s in spots)


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size of each row's set, and of its intersection and union with the pivot's."""
    for batch in batches:
        sizes, both, either = [], [], []
        pivot_bytes, pivot_set = None, None
        for mine, other in zip(batch.column("windows"), batch.column("pivot_windows"), strict=True):
            raw = other.as_py()
            if raw != pivot_bytes:
                pivot_bytes, pivot_set = raw, np.frombuffer(raw, dtype=np.uint64)
            a = np.frombuffer(mine.as_py(), dtype=np.uint64)
            common = _common(a, pivot_set)
            sizes.append(len(a))
            both.append(common)
            either.append(len(a) + len(pivot_set) - common)
        names = [n for n in batch.schema.names if n not in ("windows", "pivot_windows")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), *(pa.array(x, pa.int64()) for x in (sizes, both, either))],
            names=[*names, "size", "both", "either"],
        )


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a))


class _Region:
    """Some sets side by side, for distances from one of them to all."""

    def __init__(self, sets: list[np.ndarray], members: list[int]):
        self.members = np.array(members)
        self.sizes = np.array([len(sets[i]) for i in members])
        self.first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        every, self.codes, counts = np.unique(
            np.concatenate([sets[i] for i in members]), return_inverse=True, return_counts=True)
        self.often = counts[self.codes]
        self.n_windows = len(every)

    def central(self, among: np.ndarray) -> int:
        """The set whose windows most others share, by its place in the region."""
        shared = np.add.reduceat(self.often, self.first) / self.sizes
        return int(np.argmax(np.where(among, shared, -1.0)))

    def common(self, k: int) -> np.ndarray:
        """Windows that each set has in common with set ``k``."""
        marks = np.zeros(self.n_windows, dtype=np.int64)
        marks[self.codes[self.first[k]:self.first[k] + self.sizes[k]]] = 1
        return np.add.reduceat(marks[self.codes], self.first)

    def partnered(self, percent: int) -> np.ndarray:
        """Which sets meet another in a region of their own order of windows."""
        met: dict[int, list[tuple[int, int, int]]] = {}
        for i, (a, size) in enumerate(zip(self.first.tolist(), self.sizes.tolist(), strict=True)):
            codes, often = self.codes[a:a + size], self.often[a:a + size]
            order = np.lexsort((codes, often))[: prefix_length(size, percent)]
            for place, j in enumerate(order.tolist()):
                if often[j] > 1:
                    met.setdefault(int(codes[j]), []).append((size, i, place))
        out = np.zeros(len(self.sizes), dtype=bool)
        for window, rows in met.items():
            election = _Election(percent)
            for size, i, place in sorted(rows):
                for pivot in election.meet(window, size, place, i):
                    out[[i, pivot]] = True
        return out


def _recurse(percent: int):
    """Links of one region: a pivot at a time, each leaving its far sets and their border."""

    def run(group):
        owners = group.column("class").to_pylist()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in group.column("windows").to_pylist()]
        label = np.arange(len(owners))
        links: list[tuple[int, int]] = []
        region = _Region(sets, list(range(len(owners))))
        alive = region.partnered(percent)
        while alive.sum() > 1 and len(np.unique(label[region.members[alive]])) > 1:
            if alive.sum() <= len(alive) / 2:
                # Fewer sets have an order of their own, by which more of them have no partner.
                region = _Region(sets, region.members[alive].tolist())
                alive = region.partnered(percent)
                continue
            pivot = region.central(alive)
            both = region.common(pivot)
            either = region.sizes + region.sizes[pivot] - both
            inside = alive & (100 * both >= percent * either)
            far = alive & ~inside
            distance = 1 - both / either
            for k in np.flatnonzero(inside).tolist():
                mine, theirs = label[region.members[pivot]], label[region.members[k]]
                if mine != theirs:
                    links.append((owners[region.members[pivot]], owners[region.members[k]]))
                    label[label == theirs] = mine
            if not far.any():
                break
            least = distance[far].min() - (100 - percent) / 100 - 1e-9
            alive = far | (inside & (distance >= least))
            alive[pivot] = False
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()),
                         "b": pa.array([y for _, y in links], pa.int64())})

    return run


def _spelled_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per window of each set."""
    for batch in batches:
        for region, owner, raw in zip(batch.column("region").to_pylist(), batch.column("class").to_pylist(),
                                      batch.column("windows"), strict=True):
            values = np.frombuffer(raw.as_py(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(values), region)), pa.array(np.full(len(values), owner)), pa.array(values)],
                names=["region", "class", "window"])


def _split_regions(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(class, pivot, region) of the regions that large regions split into.

    Windows are counted within a region, those of one set only come first and
    need no row of their own, and the others are ordered by count.
    """
    spelled = members.select("region", "class").join(sets, "class").select("region", "class", "windows").mapInArrow(
        _spelled_windows, "region long, class long, window long")
    spelled = stored(spelled, "jaccard-spelled")
    counts = spelled.groupBy("region", "window").agg(F.count("*").alias("n")).where("n > 1")
    shared = spelled.join(counts, ["region", "window"]).groupBy("region", "class").agg(
        F.sort_array(F.collect_list(F.struct("n", "window"))).alias("shared"))
    sizes = spelled.groupBy("region", "class").agg(F.count("*").alias("size"))
    placed = sizes.join(shared, ["region", "class"])
    alone = F.col("size") - F.size("shared")
    k = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    rows = placed.select(
        "region", "class", "size", alone.alias("alone"),
        F.posexplode(F.slice("shared", F.lit(1), F.greatest(k - alone, F.lit(0)).cast("int"))).alias("at", "w"))
    rows = rows.select("region", F.col("w.window").alias("window"), "class",
                       (F.shiftleft("size", 32) + F.col("alone") + F.col("at")).alias("place"))
    return (
        rows.repartition("region", "window").sortWithinPartitions("region", "window", "place", "class")
        .withColumn("pivot", F.lit(None).cast("long")).mapInArrow(_elect(percent, 2), _ELECTED)
        .where(F.col("kind") == MEMBER).select("class", "pivot", "region").distinct().withColumn("member", F.lit(True))
    )


def _known_windows(docs: DataFrame, size: int, percent: int):
    """The most frequent windows with their counts, broadcast; at most KNOWN_WINDOWS of them."""
    spark = docs.sparkSession
    counted = (
        docs.mapInArrow(_hash_prefixes(size, percent, COUNTED_SHARE), "window long, class long")
        .groupBy("window").agg(F.count("*").alias("n"), F.min("class").alias("pivot"))
        .where("n > 2")
    )
    counted = stored(counted, "jaccard-known")
    step = F.floor(F.log2("n") * 4).cast("int")
    least, total = None, 0
    for row in sorted(counted.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):  # at most 256 steps
        total += row["count"]
        if total > KNOWN_WINDOWS:
            break
        least = row["step"]
    kept = counted.where(F.lit(False)) if least is None else counted.where(step >= least)
    pivot = F.when(F.col("n") >= HOT_WINDOW_SETS, F.col("pivot")).otherwise(0)
    rows = kept.select("window", F.least("n", F.lit(1 << 30)).cast("int").alias("n"), pivot.alias("pivot")).toArrow()
    window = rows.column("window").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(window)
    known = (window[order], *(rows.column(c).to_numpy()[order] for c in ("n", "pivot")))
    return spark.sparkContext.broadcast(known)


def _candidate_filter(pairs: DataFrame):
    """Bits of the classes in ``pairs``, merged from small pieces; bounded by FILTER_BITS."""
    spark = pairs.sparkSession
    n = pairs.agg(F.approx_count_distinct("class") + F.approx_count_distinct("pivot")).first()[0]
    bits = max(1 << 13, min(FILTER_BITS, 1 << max(13, (10 * n).bit_length())))
    spots = pairs.select(F.explode(F.array("class", "pivot")).alias("v"))
    low, high = F.col("v").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("v", 32)
    marked = spots.select(F.explode(F.array(low % bits, (high * 1000003) % bits)).alias("spot"))
    words = (
        marked.groupBy((F.col("spot") / 32).cast("long").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(spot % 32 AS int)))").alias("mask"))
    ).toArrow()
    out = np.zeros(bits // 32, dtype=np.uint32)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().astype(np.uint32)
    return spark.sparkContext.broadcast(out.view(np.uint8))


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` of class and pivot with the sizes of their intersection and union."""
    of_pivot = sets.select(F.col("class").alias("pivot"), F.col("windows").alias("pivot_windows"))
    joined = pairs.join(sets, "class").join(of_pivot, "pivot")
    names = [*pairs.columns]
    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", size long, both long, either long"
    return joined.select(*names, "windows", "pivot_windows").mapInArrow(_distances, schema)


def set_links(docs: DataFrame, keys: list[str], size: int = SHINGLE_WORDS,
              percent: int = LINK_PERCENT) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets and links between classes.

    Returns keys, n_shingles and class per row, and (a, b) links that connect
    the same classes as all pairs at or above the threshold do.
    """
    spark = docs.sparkSession
    docs = documents_columns(docs, [*keys, "text"])
    rows = stored(docs.mapInArrow(_set_rows(size), output_schema(docs, keys, "n_shingles long, class long")), "jaccard-rows")
    text = docs.select("text")
    hot = _known_windows(text, size, percent)

    prefixes = text.mapInArrow(_ordered_prefixes(size, percent, hot), "window long, class long, place long, pivot long")
    # A place sorts by the set's size first.
    elected = stored(
        prefixes.repartition("window").sortWithinPartitions("window", "place", "class")
        .withColumn("region", F.lit(0).cast("long")).mapInArrow(_elect(percent, 3), _ELECTED), "jaccard-elected")
    pairs = stored(_worth_measuring(elected, percent), "jaccard-pairs")
    wanted = pairs.select(F.explode(F.array("class", "pivot")).alias("class")).distinct()
    sets = (
        text.mapInArrow(_wanted_sets(size, _candidate_filter(pairs)), "class long, windows binary")
        .groupBy("class").agg(F.first("windows").alias("windows"))
        .join(wanted, "class", "left_semi")
    )
    sets = stored(sets, "jaccard-sets")

    links = []
    measured = stored(_measured(pairs.withColumn("region", F.lit(0).cast("long")), sets), "jaccard-measured")
    while True:
        inside = 100 * F.col("both") >= percent * F.col("either")
        distance = 1 - F.col("both") / F.col("either")
        links.append(measured.where(inside).select(F.col("class").alias("a"), F.col("pivot").alias("b")))
        regions = measured.where("member").select(F.xxhash64("region", "pivot").alias("region"), "class", "size", "both", "either")
        edge = regions.where(~inside).groupBy("region").agg(
            (F.min(distance) - (100 - percent) / 100 - 1e-9).alias("least"))
        left = stored(
            regions.join(edge, "region").where(~inside | (distance >= F.col("least")))
            .select("region", "class", "size"), "jaccard-left")
        sizes = left.groupBy("region").agg(F.count("*").alias("members"), F.sum("size").alias("total")).where("members > 1")
        small = (F.col("members") <= REGION_SETS) & (F.col("total") <= REGION_WINDOWS)
        sized = left.drop("size").join(sizes, "region")
        # As many tasks as any shuffle has: regions are few bytes and much work.
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        inner = sized.where(small).join(sets, "class").select("region", "class", "windows").repartition(tasks, "region")
        links.append(stored(inner.groupBy("region").applyInArrow(_recurse(percent), "a long, b long"), "jaccard-inner"))
        large = stored(sized.where(~small).select("region", "class"), "jaccard-large")
        if not large.limit(1).count():
            break
        measured = stored(_measured(_split_regions(large, sets, percent), sets), "jaccard-measured")
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return rows, stored(out, "jaccard-links")


def near_duplicate_classes(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = LINK_PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id.

    Documents are linked when 100 * |x & y| >= percent * |x | y| over their sets of
    ``size``-word windows, lower-cased (A-Z), words parted by ASCII white space.  A
    text with fewer words is one window; without words or null it is empty and in
    no link.  component_id is the smallest doc_id reachable by links, the row's own
    included.  Repeated rows and ids keep their rows; a null id keeps its row and
    never names a component unless all ids of it are null.  An empty table gives
    no rows, and other columns are ignored.
    """
    rows, links = set_links(docs, ["doc_id"], size, percent)
    named = _components(rows, links)
    smallest = stored(
        named.groupBy("component").agg(F.min("least").alias("component_id"))
        .join(named, "component").select("class", "component_id"), "jaccard-classes")
    return rows.join(smallest, "class", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def _components(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(class, least, component): each class with its smallest doc_id."""
    components = connected_components(links).withColumnRenamed("node", "class")
    classes = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"))
    return stored(classes.join(components, "class", "left").select(
        "class", "least", F.coalesce("component", "class").alias("component")), "jaccard-components")


def representatives(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = LINK_PERCENT) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, then text hash.

    Repeated rows leave one.  Rows without words are in no component and all stay.
    """
    marked = docs.withColumn("_text_hash", F.xxhash64("text"))
    rows, links = set_links(marked, ["doc_id", "_text_hash"], size, percent)
    named = _components(rows, links).select("class", "component")
    # Null ids come last, so that they stay only where a component has no other.
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_text_hash")
    first = rows.join(named, "class").groupBy("component").agg(F.min(order).alias("first"))
    kept = stored(first.select(F.col("first.doc_id").alias("_id"), F.col("first._text_hash").alias("_hash")).distinct(),
                  "jaccard-kept")
    same = marked["doc_id"].eqNullSafe(kept["_id"]) & (marked["_text_hash"] == kept["_hash"])
    one = marked.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_text_hash"])
    wordless = marked.where(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return one.unionByName(wordless).drop("_text_hash")
