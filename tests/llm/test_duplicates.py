"""op5, op9 and op10 against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import exchange as X
from tessera.llm.anchors import substring_dedup
from tessera.llm.minhash import bands_for, near_duplicates, sketches
from tessera.llm.radix import suffix_dedup
from tests.llm.corpus import DOCS, awkward, collected, documents, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


def key(doc_id):
    return float("inf") if doc_id is None else doc_id


def brute_near(rows, percent):
    sets = []
    for _, text in rows:
        w = split((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                if a != b:
                    top[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i in range(len(rows)):
        least[root(i)].append(rows[i][0])
    out = []
    for i, (d, _) in enumerate(rows):
        c = min(least[root(i)], key=key)
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


def brute_anchor(rows):
    first = {}
    split_rows = [(d, split(t)) for d, t in rows]
    for d, w in split_rows:
        for i in range(len(w) - 12):
            s = tuple(w[i : i + 13])
            first[s] = min(first.get(s, key(d)), key(d))
    out = []
    for d, w in split_rows:
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < key(d):
                gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def brute_suffix(rows, depth=100):
    first = {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, b in raw:
        for i in range(len(b) - depth + 1):
            s = b[i : i + depth]
            first[s] = min(first.get(s, (key(d), i)), (key(d), i))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if first[b[i : i + depth]] < (key(d), i):
                gone[i : i + depth] = b"\x01" * depth
        spans = len(re.findall(b"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    texts = awkward()
    ids = [None if i == 5 else i + 1 for i in range(len(texts))]
    ids[12] = ids[11]  # a repeated id with another text
    return list(zip(ids, texts))


def frame(spark, rows):
    return documents(spark, [t for _, t in rows], [d for d, _ in rows])


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, rows, percent):
    got = near_duplicates(frame(spark, rows), percent=percent).select("doc_id", "n_shingles", "component_id", "kept")
    assert collected(got) == brute_near(rows, percent)


def test_near_duplicates_that_need_the_pivots(spark):
    """Families with hundreds of members whose links do not run through the most frequent text."""
    rng = random.Random(3)
    base = words(rng, 150, 10**6).split()
    rows, n = [], 0
    for family in range(6):
        head = list(base)
        for _ in range(3 * family):
            head[rng.randrange(150)] = f"f{family}x{rng.randrange(10**6)}"
        for _ in range(40):
            w = list(head)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(150)] = f"e{rng.randrange(40)}"
            if rng.random() < 0.2:
                w = w[: rng.randrange(110, 150)]
            n += 1
            rows.append((n, " ".join(w)))
    got = near_duplicates(frame(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept")
    assert collected(got) == brute_near(rows, 85)


def test_sketches_fill_every_coordinate_and_estimate_similarity():
    rng = np.random.default_rng(1)
    sizes = [1, 2, 7, 40, 1000, 1000]
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in sizes]
    sets[5][:800] = sets[4][:800]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    s = sketches(np.concatenate(sets), edges, 1024)
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((s[4] == s[5]).mean() - 800 / 1200) < 0.06


def test_bands_follow_the_threshold():
    assert [bands_for(p) for p in (80, 85, 100)] == [35, 24, 1]
    assert all((1 - (p / 100) ** 5) ** bands_for(p) <= 1e-6 for p in range(50, 100))


def test_substring_dedup(spark, rows):
    got = substring_dedup(frame(spark, rows), texts=True)
    assert collected(got.drop("kept_text")) == brute_anchor(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got.collect())


@pytest.mark.parametrize("hot", [0, 1, 3, 64])
def test_suffix_dedup(spark, rows, hot):
    got = suffix_dedup(frame(spark, rows).repartition(5), texts=False, hot=hot)
    assert collected(got) == brute_suffix(rows)


def test_suffix_dedup_on_repetitive_bytes(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(40)) * rng.randrange(1, 12) for _ in range(30)] + ["a" * 400, "a" * 120, "b" + "a" * 300]
    rows = list(enumerate(texts, 1))
    assert collected(suffix_dedup(frame(spark, rows), texts=False)) == brute_suffix(rows)


def test_carried_columns_come_back_with_their_rows(spark, rows):
    df = frame(spark, rows)
    got = suffix_dedup(df, texts=True, carry=df.columns)
    assert sorted((repr((r.c0, r.c1, r.c3))) for r in got.collect()) == sorted(repr((d, t, f"s{k % 3}")) for k, (d, t) in enumerate(rows))


@pytest.mark.parametrize("operator", [near_duplicates, substring_dedup, suffix_dedup])
def test_empty_tables_and_extra_columns(spark, operator):
    empty = spark.createDataFrame([], DOCS)
    assert operator(empty).count() == 0
    clash = documents(spark, ["a b c d e f", None]).selectExpr("*", "1 as uid", "2 as b", "3 as chunk", "4 as part", "'x' as body", "5 as kept", "6 as component_id")
    assert operator(clash).count() == 2


def test_keys_are_dealt_to_one_partition_each(spark):
    for n, each in ((1, 1), (7, 2), (64, 1)):
        keys = X.spread_keys(n, each)
        rows = [(int(k), p) for row in keys for p, k in enumerate(row)]
        found = spark.createDataFrame(rows, "k long, p int").repartition(n, "k").withColumn("at", F.spark_partition_id()).collect()
        assert len({r.k for r in found}) == n * each and all(r.at == r.p for r in found)


def test_texts_are_not_shuffled_and_chunks_get_their_own_answers(spark):
    held = X.store(documents(spark, [t for t in awkward(9) if t]))
    chunks = held.read()
    answers = X.ask(chunks, lambda chunk, _: iter([(0, len(chunk.data).to_bytes(4, "little"))]), lambda bodies: bodies, (), "sizes", 3)
    joined = X.with_answers(chunks, answers)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1  # that of the answers
    assert all([(a.part, int.from_bytes(a.body, "little")) for a in r.sizes] == [(0, r.n_bytes)] for r in joined.collect())
    held.drop()
