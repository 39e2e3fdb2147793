"""Toxicity: a linear model over the presence of character n-grams, scaled by naive Bayes log-count ratios.

N-grams of 3 to 5 characters (A-Z lower-cased, white space as one class) are hashed into 2^20 buckets.  A grouped
aggregation counts the training documents of each class that hold each bucket; r = log of the ratio of the smoothed
class frequencies scales the feature, the FEATURES buckets with the greatest chi-square statistic are kept, and a
ridge-penalised logistic regression of r * presence is fitted on the driver.  Scoring reads whole texts and keeps one
bit per document and feature.

Fitted on at most labelled.TRAIN_ROWS rows.  Empty and null texts get the score of a document without any feature;
equal texts get equal scores, repeated rows each their own row.  Equal chi-square statistics are ordered by bucket.  A
row without an id is scored and belongs to no fold: it is never learned from, and held_out is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.labelled import TRAIN_ROWS, training_rows
from tessera.llm.linear import fit_logistic, sigmoid
from tessera.llm.staging import small_batches, stage

SIZES, BUCKET_BITS, FEATURES, MIN_DOCS = (3, 4, 5), 20, 2048, 5
_FOLD = K.LOWER.copy()
_FOLD[[9, 10, 11, 12, 13]] = 0x20


def grams(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n the bucket of the n-gram that starts at each character, and the character's document."""
    data = _FOLD[data]
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    doc = np.searchsorted(offs, starts, side="right") - 1
    sums, down = K.prefix(data)
    sums = np.append(sums[starts], sums[-1])
    down = down[starts]
    for n in SIZES:
        m = len(starts) - n + 1
        if m > 0:
            ok = doc[:m] == doc[n - 1 :]
            h = ((sums[n : n + m] - sums[:m]) * down[:m] + K.U(n)) * K.U(0x9FB21C651E98DF25)
            h ^= h >> K.U(29)
            h *= K.U(0xBF58476D1CE4E5B9)
            yield (h >> K.U(64 - BUCKET_BITS)).astype(np.int64)[ok], doc[:m][ok]


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    ratios: np.ndarray | None = None  # log-count ratio of each bucket

    def slots(self) -> np.ndarray:
        out = np.full(1 << BUCKET_BITS, -1, dtype=np.int16)
        out[self.buckets] = np.arange(len(self.buckets))
        return out

    def presence(self, data: np.ndarray, offs: np.ndarray, slots: np.ndarray) -> np.ndarray:
        out = np.zeros((len(offs) - 1, len(self.buckets)), dtype=bool)
        for bucket, doc in grams(data, offs):
            slot = slots[bucket]
            hit = np.flatnonzero(slot >= 0)
            out[doc[hit], slot[hit]] = True
        return out


def _groups(raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for i in range(0, len(offs) - 1, 2048):
        o = offs[i : min(i + 2049, len(offs))]
        yield from K.groups(np.arange(i, i + len(o) - 1), raw, o, 1 << 20)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket the documents of this task that hold it, by class; -1 counts the documents themselves."""
    seen = np.zeros((2, (1 << BUCKET_BITS) + 1), dtype=np.int64)
    for batch in K.released(batches):
        y = batch.column(0).to_numpy(zero_copy_only=False)
        raw, offs = K.column_bytes(batch.column(1))
        for rows, data, o in _groups(raw, offs):
            label = (y[rows] > 0).astype(np.int64)
            np.add.at(seen[:, -1], label, 1)
            held = [d << BUCKET_BITS | b for b, d in grams(data, o)]
            if held:
                key = np.unique(np.concatenate(held))
                np.add.at(seen, (label[key >> BUCKET_BITS], key & ((1 << BUCKET_BITS) - 1)), 1)
    some = np.flatnonzero(seen.sum(axis=0))
    for part in np.array_split(some, max(1, len(some) // 100_000)):
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.where(part == 1 << BUCKET_BITS, -1, part)), "n0": pa.array(seen[0, part]), "n1": pa.array(seen[1, part])})


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, folds: int = 5) -> Model:
    """The model of labels.toxic, from rows with crc32(doc_id as text) mod folds > 0."""
    small_batches(docs.sparkSession)
    train = stage(training_rows(docs, labels, "toxic", F.crc32(F.col("train_id").cast("string")) % folds != 0, rows), "toxic-train")
    counts = stage(train.mapInArrow(_count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "toxic-counts")
    total = counts.where("bucket = -1").first()
    if total is None or not total.n0 or not total.n1:
        rate = ((total.n1 if total else 0) + 0.5) / ((total.n0 + total.n1 if total else 0) + 1.0)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(rate / (1 - rate))))
    a, b, n0, n1 = F.col("n1"), F.col("n0"), float(total.n0), float(total.n1)
    n = n0 + n1
    chi = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / ((a + b) * (n - a - b + 1) * n0 * n1)
    ratio = F.log((a + 1) / (n1 + 2)) - F.log((b + 1) / (n0 + 2))
    top = counts.where((F.col("bucket") >= 0) & (a + b >= MIN_DOCS)).select("bucket", ratio.alias("r"), chi.alias("chi")).orderBy(F.desc("chi"), "bucket").limit(FEATURES).orderBy("bucket").collect()
    shape = Model(np.array([t.bucket for t in top], np.int64), np.zeros(len(top)), 0.0)
    r = np.array([t.r for t in top])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shape.slots()
        for batch in K.released(batches):
            raw, offs = K.column_bytes(batch.column(1))
            for some, data, o in _groups(raw, offs):
                x = np.packbits(shape.presence(data, o, slots), axis=1)
                yield pa.RecordBatch.from_pydict({"y": batch.column(0).take(pa.array(some)).cast(pa.int32()), "x": pa.array([v.tobytes() for v in x], pa.binary())})

    got = train.mapInArrow(project, "y int, x binary").collect()
    y = np.array([g.y > 0 for g in got], dtype=np.float64)
    bits = np.array([np.frombuffer(g.x, np.uint8) for g in got]).reshape(len(got), -1)
    blocks = [np.unpackbits(bits[i : i + 2048], axis=1, count=len(top)).astype(np.float32) for i in range(0, len(got), 2048)]
    w, bias = fit_logistic(blocks, y, r, l2=1e-5, rounds=150)
    return Model(shape.buckets, w * r, bias, r)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row of docs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = model.slots()
        for batch in K.released(batches):
            raw, offs = K.column_bytes(batch.column(1))
            for some, data, o in _groups(raw, offs):
                s = sigmoid(model.presence(data, o, slots) @ model.weights + model.bias)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).take(pa.array(some)), "score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
