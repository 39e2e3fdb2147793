"""op2 and op8: held-out accuracy, inputs that don't count, and awkward rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, toxicity
from tests.llm.corpus import DOCS, awkward, documents, words

LABELS = "doc_id long, quality int, toxic int"


def area(scores, labels):
    """Area under the receiver's curve."""
    order = np.argsort(scores)
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    pos = labels > 0
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())



def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    score, toxic = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    assert area(score, toxic) > 0.93 and ((score >= 0.5) == (toxic > 0)).mean() > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_toxicity_ignores_held_out_labels_and_other_columns(spark):
    rng = random.Random(1)
    texts = [f"{words(rng, 20)} {'vile slurry' if k % 2 else 'kind gentle'} {words(rng, 10)}" for k in range(400)]
    docs = documents(spark, texts)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    label = lambda flip: spark.createDataFrame([(i, None, ((i % 2 == 0) != (flip and held(i))) * 1) for i in range(1, 401)], LABELS)
    a, b = (toxicity.score(docs, toxicity.fit(docs, label(f))).orderBy("doc_id").collect() for f in (False, True))
    assert a == b and all(r.predicted == (r.doc_id % 2 == 0) for r in a)
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit(None).cast("string"), "y": F.lit(3), "train_id": F.lit(4)})
    assert toxicity.score(other, toxicity.fit(other, label(False))).orderBy("doc_id").collect() == a


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(1, 1, 1), (2, 0, 1)], [(None, 1, 1), (3, None, None)]])
def test_too_few_labels(spark, labels):
    docs = documents(spark, awkward(5))
    known = spark.createDataFrame(labels, LABELS)
    rows = toxicity.score(docs, toxicity.fit(docs, known)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    model = quality.fit(docs, known)
    judged = quality.evidence(docs, model, F.col("source"), F.col("lang"))
    assert quality.posterior(judged, quality.sites_of(judged)).count() == docs.count()


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rest = F.crc32(F.col("train_id").cast("string")) % 5 != 0
    model = quality.fit(docs, labels, where=rest)
    judged = quality.evidence(docs, model, F.col("source"), F.concat_ws("/", "source", "lang"))
    rows = quality.posterior(judged, quality.sites_of(judged)).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    score, good = np.array([r.posterior for r in rows]), np.array([r.quality for r in rows])
    keep = np.array([r.keep for r in rows])
    assert area(score, good) > 0.9
    assert keep[good > 0].mean() > 0.97  # clean documents stay
    assert keep[good == 0].mean() < 0.6


def test_log_count_ratios_against_a_count_of_every_gram(spark):
    """The kept buckets, their chi-square order and their log-count ratios from Python sets of n-grams."""
    rng = random.Random(3)
    texts = [f"{words(rng, 12, 60)} {'Vile\tslurry é' if k % 3 == 0 else 'kind gentle'}" for k in range(240)]
    docs, labels = documents(spark, texts), spark.createDataFrame([(k, None, int(k % 3 == 1)) for k in range(1, 241)], LABELS)
    model, ratios = toxicity.fit(docs, labels), {}
    train = [(t, k % 3 == 1) for k, t in enumerate(texts, 1) if zlib.crc32(str(k).encode()) % 5]
    n1 = sum(y for _, y in train)
    n0, held = len(train) - n1, {}
    for text, y in train:
        plain = "".join(c.lower() if c.isascii() else c for c in text).replace("\t", " ")
        for g in {plain[i : i + n] for n in toxicity.SIZES for i in range(len(plain) - n + 1)}:
            held.setdefault(g, [0, 0])[y] += 1
    bucket = {}
    for g in held:
        raw = np.frombuffer(g.encode(), np.uint8)
        bucket[g] = int(list(toxicity.grams(raw, np.array([0, len(raw)])))[-1][0][0])  # of the longest n-gram in it: itself
    alone = {b for b, c in Counter(bucket.values()).items() if c == 1}
    for g, (b0, a1) in held.items():
        ratios[bucket[g]] = np.log((a1 + 1) / (n1 + 2)) - np.log((b0 + 1) / (n0 + 2))
    kept = {int(b) for b in model.buckets}
    wanted = {bucket[g] for g, (b0, a1) in held.items() if b0 + a1 >= toxicity.MIN_DOCS}
    assert kept & alone == wanted & alone if len(wanted) <= toxicity.FEATURES else kept <= wanted
    assert all(np.isclose(model.ratios[i], ratios[int(b)]) for i, b in enumerate(model.buckets) if int(b) in alone)


def brute_posterior(rows, threshold=0.2):
    """Every formula over plain lists."""
    mean = lambda v: sum(v) / len(v)

    def strength(groups):
        groups = [(v, above) for v, above in groups if len(v) > 1]
        free = sum(len(v) - 1 for v, _ in groups)
        if not free:
            return 10.0
        within = max(sum(sum((x - mean(v)) ** 2 for x in v) for v, _ in groups) / free, 1e-9)
        spread = max((sum(len(v) * (mean(v) - above) ** 2 for v, above in groups) - len(groups) * within) / sum(len(v) for v, _ in groups), within / 1000)
        return min(max(within / spread, 1.0), 1000.0)

    hosts, paths = {}, {}
    for _, h, p, own in rows:
        hosts.setdefault(h, []).append(own)
        paths.setdefault((h, p), []).append(own)
    prior = min(max(mean([r[3] for r in rows]), 1e-3), 1 - 1e-3)
    k = strength([(v, prior) for v in hosts.values()])
    host_rate = {h: (sum(v) + k * prior) / (len(v) + k) for h, v in hosts.items()}
    k = strength([(v, host_rate[h]) for (h, _), v in paths.items()])
    site_rate = {s: (sum(v) + k * host_rate[s[0]]) / (len(v) + k) for s, v in paths.items()}
    odds = lambda x: np.log(max(x, 1e-6) / max(1 - x, 1e-6))
    return {d: 1 / (1 + np.exp(-(odds(own) + quality.SITE_WEIGHT * (odds(site_rate[h, p]) - odds(prior))))) for d, h, p, own in rows}


def test_posterior_against_plain_lists(spark):
    rng = random.Random(5)
    rows = [(k, f"h{k % 5}", f"h{k % 5}/p{rng.randrange(4)}", min(1.0, max(0.0, rng.gauss(0.2 + 0.15 * (k % 5), 0.2)))) for k in range(500)] + [(1000, "alone", "alone/x", 0.9), (1001, "", "", 0.0)]
    judged = spark.createDataFrame(rows, "doc_id long, host string, path string, own double")
    got = {r.doc_id: r.posterior for r in quality.posterior(judged, quality.sites_of(judged)).collect()}
    wanted = brute_posterior(rows)
    assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-9 for k in got)


def test_sparse_sites_stay_near_what_is_above_them(spark):
    rows = [(k, h, p, own) for k, (h, p, own) in enumerate([("a", "a/x", 0.9)] * 200 + [("a", "a/y", 0.1)] + [("b", "b/x", 0.2)] * 200 + [("", "", 0.5)])]
    judged = spark.createDataFrame(rows, "doc_id long, host string, path string, own double")
    sites = {r.path: r for r in quality.sites_of(judged).collect()}
    assert abs(sites["a/x"].site_rate - 0.9) < 0.05 and sites["a/y"].site_rate > 0.3 and sites["b/x"].host_rate < 0.3
    out = {r.path: r for r in quality.posterior(judged, quality.sites_of(judged)).collect()}
    assert out["b/x"].posterior < out["b/x"].own and out["a/x"].posterior > out["a/x"].own


def test_good_rows_with_too_many_sites_to_broadcast(spark, monkeypatch):
    docs = documents(spark, awkward(6) * 2, [*range(len(awkward(6))), *range(len(awkward(6)))]).withColumns({"hash": F.lit(1), "c0": F.lit(2)})
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(len(awkward(6)))], LABELS)
    model = quality.fit(docs, labels)
    few = quality.good_rows(docs, model, F.col("source"), F.lit(None), threshold=0.5)
    monkeypatch.setattr(quality, "BROADCAST_SITES", 0)
    many = quality.good_rows(docs, model, F.col("source"), F.lit(None), threshold=0.5)
    kept = sorted(map(repr, few.collect()))
    assert many.columns == docs.columns and sorted(map(repr, many.collect())) == kept and 0 < len(kept) < docs.count()


def test_good_rows_keep_all_columns(spark):
    docs = documents(spark, [*awkward(6), None]).withColumns({"row": F.lit(1), "own": F.lit("x"), "host": F.lit(None).cast("string"), "c0": F.lit(2)})
    model = quality.fit(docs, spark.createDataFrame([], LABELS))
    kept = quality.good_rows(docs, model, F.col("source"), F.col("lang"), threshold=0.0)
    assert kept.columns == docs.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, docs.collect()))
    empty = spark.createDataFrame([], DOCS)
    assert quality.good_rows(empty, model, F.col("source"), F.col("lang")).count() == 0
    assert toxicity.score(empty, toxicity.Model(np.zeros(0, np.int64), np.zeros(0), 0.0)).count() == 0
