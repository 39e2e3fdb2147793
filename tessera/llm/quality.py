"""Quality by hierarchical empirical Bayes: a document's own evidence, shrunk site evidence, and a global prior.

1. A logistic model over surface statistics of the whole text (fitted on a bounded sample of labelled rows) gives each
   document's probability of being good.
2. Grouped aggregation sums these by host and by path (a part of the host).  A host's rate is its mean shrunk toward
   the global mean, a path's rate its mean shrunk toward its host's rate; the weight of the prior is the method-of-
   moments estimate from the spread of the group means, so that sparse sites stay near what lies above them.
3. The posterior log odds are the document's plus what its path's rate says beyond the global one.

Null hosts and paths are a group of their own.  Empty and null texts have all statistics 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.labelled import TRAIN_ROWS, training_rows
from tessera.llm.linear import fit_logistic, sigmoid
from tessera.llm.staging import small_batches, stage

BROADCAST_SITES = 200_000  # of a host, a path and five numbers each
SITE_WEIGHT = 0.5  # of the site's log odds; the site's documents are correlated with the one judged
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#$%&*@^~+=<>\\/_{}[]`", b"|", b"!?", b".,;:'\"()-", b"\n"]
_CLASS = np.full(256, 8, dtype=np.uint8)
for _i, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars)] = _i
_CLASS[list(b" \t\r\x0b\x0c")] = 9


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Surface statistics of each document, one row each."""
    n_docs = len(offs) - 1
    size = np.diff(offs)
    doc = np.repeat(np.arange(n_docs), size)
    count = np.bincount(doc * 10 + _CLASS[data], minlength=10 * n_docs).reshape(n_docs, 10).astype(np.float64)
    w = K.Words(data, offs)
    words = w.counts.astype(np.float64)
    again = np.zeros(len(w.hashes), dtype=bool)
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (w.doc[1:] == w.doc[:-1])
    order = np.lexsort((w.hashes, w.doc))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (w.hashes[order][1:] != w.hashes[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    distinct = np.bincount(w.doc[order][fresh], minlength=n_docs)
    repeats = np.bincount(w.doc[again], minlength=n_docs)
    letters = count[:, 0] + count[:, 1] + count[:, 8]
    per = lambda a, b: a / np.maximum(b, 1)
    expected = np.minimum(1.0, 8.0 / np.sqrt(np.maximum(words, 1)))
    return np.column_stack([
        np.log1p(words), per(count[:, 0], letters), per(count[:, 3], size), per(count[:, 4], words), per(count[:, 5], words), per(count[:, 2], size),
        per(count[:, 6], words), per(repeats, words), per(distinct, words), per(distinct, words) - expected, per(size, words) / 10, per(count[:, 8], size), per(count[:, 7], words),
    ])


N_STATS = 13


def _expand(s: np.ndarray) -> np.ndarray:
    """Saturating copies of the rates, so that a few and very many odd characters both count."""
    return np.column_stack([s, np.sqrt(np.abs(s)), np.minimum(s[:, 1:8], 0.05) * 20])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def probability(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        x = np.clip((_expand(statistics(data, offs)) - self.mean) / self.scale, -8, 8)
        return sigmoid(x @ self.weights + self.bias)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, where: Column | None = None) -> Model:
    """The document classifier of labels.quality from at most `rows` labelled rows (their statistics, 104 bytes each, go to the driver)."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.released(batches):
            raw, offs = K.column_bytes(batch.column(1))
            for some, data, o in K.groups(np.arange(batch.num_rows), raw, offs):
                s = statistics(data, o)
                yield pa.RecordBatch.from_pydict({"y": batch.column(0).take(pa.array(some)).cast(pa.int32()), "s": pa.array([v.tobytes() for v in s], pa.binary())})

    got = training_rows(docs, labels, "quality", where, rows).mapInArrow(run, "y int, s binary").collect()
    y = np.array([g.y > 0 for g in got], dtype=np.float64)
    s = np.array([np.frombuffer(g.s, np.float64) for g in got]).reshape(len(got), N_STATS)
    x = _expand(s)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.clip((x - mean) / scale, -8, 8)
    w, b = fit_logistic([z], y, np.ones(z.shape[1]), l2=1e-4, rounds=600, balanced=False)
    return Model(mean, scale, w, b)


def evidence(docs: DataFrame, model: Model, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path, the document's own probability, and hash (what equal rows share).

    Equal rows are judged alike, each on its own; null and empty texts have the statistics of nothing, null hosts and
    paths are the empty one.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.released(batches):
            raw, offs = K.column_bytes(batch.column(3))
            for some, data, o in K.groups(np.arange(batch.num_rows), raw, offs):
                part = batch.slice(int(some[0]), len(some))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(model.probability(data, o)), part.column(4)], ["doc_id", "host", "path", "own", "hash"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col("text").cast("string").alias("text"), _identity(F.col("doc_id").cast("long"), F.col("text").cast("string"), host, path).alias("hash"))
    return rows.mapInArrow(run, "doc_id long, host string, path string, own double, hash long")


def good_rows(docs: DataFrame, model: Model, host: Column, path: Column, threshold: float = 0.2) -> DataFrame:
    """The rows of docs whose posterior reaches the threshold, with docs' own columns.

    The statistics run twice, once for the sites' sums and once beside the rows, so that texts are not shuffled while
    the sites, counted, can be broadcast.  Beyond that the evidence without texts meets the sites, and the rows that
    it rejects are taken out by a hash of id, text, host and path: texts are shuffled once, and by a key without hot values.
    """
    judged = evidence(docs, model, host, path)
    sites = sites_of(judged)
    if sites.count() > BROADCAST_SITES:
        return _without_bad(docs, stage(judged, "evidence"), sites, host, path, threshold)
    names = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names))).alias("row"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    packed = packed.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.released(batches):
            raw, offs = K.column_bytes(batch.column(3))
            for some, data, o in K.groups(np.arange(batch.num_rows), raw, offs):
                part = batch.slice(int(some[0]), len(some))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(model.probability(data, o))], ["row", "host", "path", "own"])

    judged = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, host string, path string, own double")
    kept = posterior(judged, sites, threshold).where("keep").select("row.*")
    return kept.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)))


def _without_bad(docs: DataFrame, judged: DataFrame, sites: DataFrame, host: Column, path: Column, threshold: float) -> DataFrame:
    bad = posterior(judged, sites, threshold).where("not keep").select("hash").distinct()
    names = docs.columns
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)), _identity(F.col("doc_id").cast("long"), F.col("text").cast("string"), host, path).alias("hash"))
    return rows.join(bad, "hash", "left_anti").select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)))


def _identity(doc_id: Column, text: Column, host: Column, path: Column) -> Column:
    """What equal rows share: they have the same posterior."""
    return F.xxhash64(doc_id, text, F.coalesce(host.cast("string"), F.lit("")), F.coalesce(path.cast("string"), F.lit("")))


def _strength(groups: DataFrame, above: Column) -> float:
    """Method-of-moments weight of the prior: within-group variance over what the means' spread exceeds it by."""
    mean = F.col("s") / F.col("n")
    row = groups.where("n > 1").agg(F.sum(F.col("n") * (mean - above) ** 2).alias("between"), F.sum(F.col("q") - F.col("n") * mean * mean).alias("within"), F.sum(F.col("n") - 1).alias("free"), F.count("*").alias("k"), F.sum("n").alias("n")).first()
    if not row.k or not row.n or not row.free:
        return 10.0
    within = max(row.within / row.free, 1e-9)
    spread = max((row.between - row.k * within) / row.n, within / 1000.0)
    return float(min(max(within / spread, 1.0), 1000.0))


def sites_of(judged: DataFrame) -> DataFrame:
    """host, path, site_docs, prior, host_rate, site_rate of every path, from the evidence of its documents."""
    paths = stage(judged.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("own").alias("s"), F.sum(F.col("own") * F.col("own")).alias("q")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    prior = min(max((total.s or 0.0) / max(total.n or 0, 1), 1e-3), 1 - 1e-3)
    k_host = _strength(hosts, F.lit(prior))
    hosts = hosts.select("host", ((F.col("s") + k_host * prior) / (F.col("n") + k_host)).alias("host_rate"))
    sites = paths.join(hosts, "host")
    k_path = _strength(sites, F.col("host_rate"))
    sites = sites.select("host", "path", F.col("n").alias("site_docs"), F.lit(prior).alias("prior"), "host_rate", ((F.col("s") + k_path * F.col("host_rate")) / (F.col("n") + k_path)).alias("site_rate"))
    return stage(sites, "sites")


def posterior(judged: DataFrame, sites: DataFrame, threshold: float = 0.2, site_weight: float = SITE_WEIGHT) -> DataFrame:
    """evidence() with site_docs, host_rate, site_rate, posterior and keep (posterior >= threshold)."""
    odds = lambda p: F.log(F.greatest(p, F.lit(1e-6)) / F.greatest(1 - p, F.lit(1e-6)))
    z = odds(F.col("own")) + site_weight * (odds(F.col("site_rate")) - odds(F.col("prior")))
    small = F.broadcast(sites) if sites.count() <= BROADCAST_SITES else sites
    out = judged.join(small, ["host", "path"]).withColumn("posterior", 1 / (1 + F.exp(-z)))
    return out.withColumn("keep", F.col("posterior") >= threshold)
