"""Quality scores from supervised subword embeddings.

A text is a bag of hashed features: its words, its pairs of neighbouring words (equal
neighbours share one feature, so stuttering is seen whatever the word) and its
character n-grams.  Each feature has a learned vector; a text is the average of its
vectors, each kind weighing alike, and a softmax layer over it gives the classes.  Vectors and layer are
trained together by mini-batch stochastic gradient descent in numpy, on a bounded
sample of labelled rows.  With two classes the layer folds into one number per
feature, which is what scoring tasks receive.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm import wordhash as wh
from tideline.llm.common import crc_remainder, documents_columns, output_schema, stored

BUCKETS_LOG2 = 16
DIMENSIONS = 4
CHAR_GRAMS = (2, 4)
KINDS = 2 + len(CHAR_GRAMS)
EPOCHS = 8
BATCH = 32
RATE = 3.0
# Bound of the training sample: rows, taken by hash, and bytes of their texts.
TRAIN_ROWS = 2000
TRAIN_BYTES = 8_000_000


@dataclass
class Model:
    """One number per feature and a bias: the folded two-class network."""

    weights: np.ndarray
    bias: float


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)


def _features(texts: wh.Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature, text) index arrays of some texts, one pair per kind of feature."""
    out = []
    found = wh.words(texts, wh.non_space(), lower=False)
    owner = np.repeat(np.arange(len(texts)), np.diff(found.ptr))
    out.append((_bucket(wh.mix(found.hashes + np.uint64(1))), owner))
    if len(owner) > 1:
        together = owner[1:] == owner[:-1]
        pair = found.hashes[1:] ^ (found.hashes[:-1] * np.uint64(3) + np.uint64(7))
        pair[found.hashes[1:] == found.hashes[:-1]] = np.uint64(11)
        out.append((_bucket(wh.mix(pair + np.uint64(2)))[together], owner[1:][together]))
    codes = texts.data.astype(np.uint64) + np.uint64(1)
    by_byte = np.repeat(np.arange(len(texts)), np.diff(texts.offsets))
    for size in CHAR_GRAMS:
        n = len(codes) - size + 1
        if n <= 0:
            continue
        gram = np.full(n, np.uint64(size), dtype=np.uint64)
        for k in range(size):
            gram = gram * np.uint64(257) + codes[k:k + n]
        whole = by_byte[:n] == by_byte[size - 1:]
        out.append((_bucket(gram * np.uint64(0x9E3779B97F4A7C15))[whole], by_byte[:n][whole]))
    return out


def _mean_logits(texts: wh.Texts, model: Model) -> np.ndarray:
    """Logits of the average over each text's features, every kind weighing alike."""
    logits = np.full(len(texts), model.bias)
    for features, owner in _features(texts):
        total = np.bincount(owner, weights=model.weights[features], minlength=len(texts))
        logits += total / np.maximum(np.bincount(owner, minlength=len(texts)), 1) / KINDS
    return logits


def _sparse_row(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their shares."""
    ids, shares = [np.zeros(1, dtype=np.int64)], [np.zeros(1)]
    for piece in wh.texts_of(pa.array([text]), chunk_bytes=1 << 40):
        for features, _ in _features(piece):
            if len(features):
                own, counts = np.unique(features, return_counts=True)
                ids.append(own)
                shares.append(counts / len(features) / KINDS)
    every, back = np.unique(np.concatenate(ids), return_inverse=True)
    return every.astype(np.int32), np.bincount(back, weights=np.concatenate(shares)).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 17) -> Model:
    """The folded network of these texts; without both classes it is a constant."""
    n_buckets = 1 << BUCKETS_LOG2
    labels = np.asarray(labels, dtype=np.int64)
    share = float(labels.mean()) if len(labels) else 0.5
    if len(labels) == 0 or share in (0.0, 1.0):
        return Model(np.zeros(n_buckets), {0.0: -4.0, 1.0: 4.0}.get(share, 0.0))
    rng = np.random.default_rng(seed)
    rows = [_sparse_row(t) for t in texts]
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (n_buckets, DIMENSIONS))
    layer, bias = rng.uniform(-1, 1, (DIMENSIONS, 2)), np.log(np.array([1 - share, share]))
    # Adaptive steps: features seen rarely still move.
    seen_v, seen_l = np.full(n_buckets, 1e-10), np.full(layer.shape, 1e-10)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at:at + BATCH]
            ids = np.concatenate([rows[i][0] for i in part])
            shares = np.concatenate([rows[i][1] for i in part])[:, None]
            sizes = np.array([len(rows[i][0]) for i in part])
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(vectors[ids] * shares, first)
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            p /= len(part)
            step_layer, step_mean = mean.T @ p, p @ layer.T
            step = np.repeat(step_mean, sizes, axis=0) * shares
            by_id = np.argsort(ids, kind="stable")
            sorted_ids = ids[by_id]
            starts = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
            unique, summed = sorted_ids[starts], np.add.reduceat(step[by_id], starts)
            seen_v[unique] += (summed ** 2).mean(axis=1)
            vectors[unique] -= rate * summed / np.sqrt(seen_v[unique])[:, None]
            seen_l += step_layer ** 2
            layer -= 0.1 * rate * step_layer / np.sqrt(seen_l)
            bias -= 0.1 * rate * p.sum(axis=0)
    fold = layer[:, 1] - layer[:, 0]
    return Model(vectors @ fold, float(bias[1] - bias[0]))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, allowed: Column,
                  rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> DataFrame:
    """A bounded sample (place, text, label): labelled texts by hash of their ids.

    At most ``rows`` texts of at most ``size`` bytes together; one that does not fit
    any more is passed over.  Null labels, ids and texts teach nothing, repeated rows
    count once.  The rows are chosen by ids and lengths alone; texts are joined after that.
    """
    chosen = (
        labels.select("doc_id", F.col(label).alias("_label")).where(allowed & F.col("doc_id").isNotNull())
        .where(F.col("_label").isin(0, 1)).groupBy("doc_id").agg(F.max("_label").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # At most ``rows`` ids are broadcast.
    met = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    met = met.withColumn("_size", F.octet_length("text").cast("long"))
    key = ["doc_id", "_label", "_size", "_digest"]
    sizes = met.where(F.col("_size") <= size).select("doc_id", "_label", "_size", F.xxhash64("text").alias("_digest")).distinct()
    fit, used = [], 0
    for row in sizes.orderBy(F.xxhash64("doc_id"), "doc_id", "_size", "_digest").limit(rows).collect():
        if used + row["_size"] <= size:
            used += row["_size"]
            fit.append((len(fit), *row))
    taken = docs.sparkSession.createDataFrame(fit, T.StructType([
        T.StructField("place", T.LongType()), *sizes.schema.fields]))
    texts = met.withColumn("_digest", F.xxhash64("text")).join(F.broadcast(taken), key)
    return texts.groupBy("place").agg(F.first("text").alias("text"), F.first("_label").cast("int").alias("label"))


def fitted(sample: DataFrame, train: Callable[[list[str], np.ndarray], object]) -> object:
    """What ``train`` makes of a sample, which is bounded: fitted in one task, stored, then read.

    The driver holds the model, never the texts.
    """
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        model = train(rows.column("text").to_pylist(), np.asarray(rows.column("label"), dtype=np.int64))
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    rows = sample.withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(run, "model binary")
    found = stored(rows, "fitted").first()
    return pickle.loads(found["model"]) if found else train([], np.zeros(0, dtype=np.int64))


def _scores(column, model: Model) -> np.ndarray:
    logits = [_mean_logits(t, model) for t in wh.texts_of(column, 1 << 19)]
    return 1 / (1 + np.exp(-np.clip(np.concatenate(logits) if logits else np.zeros(0), -30, 30)))


def _accept(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column("text"), model.value) >= 0.5))

    return run


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _scores(batch.column("text"), model.value)
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(score, pa.float64())],
                                             names=[*names, "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str, allowed: Column) -> Model:
    """A model of ``label`` from the rows of ``labels`` that ``allowed`` admits."""
    return fitted(training_rows(docs, labels, label, allowed), train)


def scored(docs: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """The keys and score (0 to 1, higher: class 1 likelier) of each text of ``docs``.

    Whole texts are scored.  A null text scores like an empty one, by the bias alone;
    repeated rows score alike; other columns than keys and text are not read.
    """
    rows = documents_columns(docs, [*keys, "text"])
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)),
                           output_schema(rows, keys, "score double"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality per document: doc_id, held_out, score, predicted.

    Labels of ids whose crc32 as text leaves remainder 1 by 3 are never learned from.
    """
    held_out = crc_remainder("doc_id", 3) == 1
    model = fit(docs, labels, "quality", ~held_out)
    return scored(docs, model, ["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, that ``score_documents`` gives class 1."""
    model = fit(docs, labels, "quality", crc_remainder("doc_id", 3) != 1)
    return docs.mapInArrow(_accept(docs.sparkSession.sparkContext.broadcast(model)), docs.schema)
