"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each document is the set of its hashed unigrams, bigrams and skip-bigrams (one word between). Training follows the
per-coordinate FTRL-proximal update, whose L1 term leaves few weights: they are broadcast, at most ``2 ** BITS`` of
them. Scoring reads every whole text once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.shared import chunks, mix, small, word_hashes

#: Hash space of features; the model never holds more weights.
BITS = 20
#: The model is fitted on at most this many labelled rows, those with the smallest hash of their id.
MAX_TRAIN_ROWS = 16_000
THRESHOLD = 0.3

_LETTERS = np.zeros(256, bool)
_LETTERS[48:58] = _LETTERS[97:123] = _LETTERS[128:] = True


@dataclass(frozen=True)
class Ftrl:
    """Parameters of FTRL-proximal."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.0
    epochs: int = 4


def _bytes(texts: pa.Array) -> list[bytes]:
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def features(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of texts: begin, end, each feature's text (from begin), its slot. Repeats are left in.

    Letters A-Z count as a-z; words are runs of letters, digits and non-ASCII characters.
    """
    for begin, end in chunks(texts):
        hashes, first = word_hashes([t.lower() for t in texts[begin:end]], _LETTERS)
        doc = np.repeat(np.arange(end - begin), np.diff(first))
        slots, docs = [hashes], [doc]
        for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
            same = doc[gap:] == doc[:-gap]
            slots.append(mix(hashes[:-gap] * np.uint64(salt) + hashes[gap:])[same])
            docs.append(doc[gap:][same])
        yield begin, end, np.concatenate(docs), (np.concatenate(slots) >> np.uint64(64 - BITS)).astype(np.int64)


def train(rows: Iterator[tuple[np.ndarray, int]], p: Ftrl) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots and weights that aren't zero, and the bias. rows: the distinct slots and label of each document."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bz = bn = 0.0
    held = list(rows)
    for _ in range(p.epochs):
        for slots, label in held:
            zs, ns = z[slots], n[slots]
            root = np.sqrt(ns)
            w = np.where(np.abs(zs) > p.l1, (np.sign(zs) * p.l1 - zs) / ((p.beta + root) / p.alpha + p.l2), 0.0)
            bias = -bz / ((p.beta + bn**0.5) / p.alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label
            g2 = g * g
            z[slots] = zs + g - (np.sqrt(ns + g2) - root) / p.alpha * w
            n[slots] = ns + g2
            bz += g - ((bn + g2) ** 0.5 - bn**0.5) / p.alpha * bias
            bn += g2
    kept = np.flatnonzero(np.abs(z) > p.l1)
    w = (np.sign(z[kept]) * p.l1 - z[kept]) / ((p.beta + np.sqrt(n[kept])) / p.alpha + p.l2)
    return kept, w, -bz / ((p.beta + bn**0.5) / p.alpha)


def fit(documents: DataFrame, labels: DataFrame, params: Ftrl = Ftrl(), max_train_rows: int = MAX_TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Weights (float32, one per slot) and bias, from labelled rows (doc_id, toxic).

    Rows with a null id or label are left out; of several labels of an id the largest holds. Without any usable row
    all weights are 0 and the bias is that of an even chance. The fit runs in one task over the bounded sample.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_label"))
        .withColumn("_order", F.xxhash64(F.lit(7), F.col("_id"))).orderBy("_order", "_id").limit(max_train_rows)
    )
    # One row for each chosen id, however often it is repeated: what meets in the one task is bounded by rows.
    rows = documents.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "_id").groupBy("_order", "_id", "_label").agg(F.min("text").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = []
            for begin, end, doc, slot in features(_bytes(batch.column("text"))):
                pairs = np.unique((doc << BITS) | slot)
                cuts = np.searchsorted(pairs >> BITS, np.arange(end - begin + 1))
                slots = (pairs & ((1 << BITS) - 1)).astype("<i4")
                out += [slots[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], names=["_order", "_id", "_label", "slots"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((np.frombuffer(s, "<i4"), y) for b in batches for s, y in zip(b.column("slots").to_pylist(), b.column("_label").to_pylist(), strict=True))
        kept, w, bias = train(rows, params)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *kept.tolist()], pa.int64()), pa.array([bias, *w.tolist()], pa.float64())], names=["slot", "weight"])

    sample = rows.mapInArrow(hashed, "_order bigint, _id bigint, _label int, slots binary")
    model = sample.repartition(1).sortWithinPartitions("_order", "_id").mapInArrow(fitted, "slot bigint, weight double").toArrow()
    slots, weights = model.column("slot").to_numpy(), model.column("weight").to_numpy()
    dense = np.zeros(1 << BITS, np.float32)
    dense[slots[slots >= 0]] = weights[slots >= 0]
    return dense, float(weights[slots < 0].sum())


def score(documents: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """documents with all their columns and ``_toxicity`` (0 to 1) appended, in place of one of that name.

    Null and empty texts get the bias's score.
    """
    spark, documents = documents.sparkSession, documents.drop("_toxicity")
    kept = np.flatnonzero(weights)
    shared = spark.sparkContext.broadcast((kept.astype(np.int32), weights[kept]))
    schema = documents.schema
    from pyspark.sql.types import DoubleType, StructType

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS, np.float32)
        dense[shared.value[0]] = shared.value[1]
        for batch in small(batches):
            total = np.full(batch.num_rows, bias)
            for begin, end, doc, slot in features(_bytes(batch.column(batch.schema.get_field_index("text")))):
                hit = np.flatnonzero(dense[slot])
                pairs = np.unique((doc[hit] << BITS) | slot[hit])
                total[begin:end] += np.bincount(pairs >> BITS, dense[pairs & ((1 << BITS) - 1)], end - begin)
            scores = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "_toxicity"])

    return documents.mapInArrow(apply, StructType([*schema.fields]).add("_toxicity", DoubleType()))


def held_out(doc_id) -> F.Column:
    """Whether a row's label may not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, params: Ftrl = Ftrl()) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learned from the labels of rows not held out.

    Every row of documents gives one row, repeated and null ids included (null: held_out false); only text is scored.
    """
    docs = documents.select("doc_id", "text")
    weights, bias = fit(docs, labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id"))), params)
    scored = score(docs, weights, bias)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_toxicity").alias("score"), (F.col("_toxicity") >= threshold).cast("int").alias("predicted"))
