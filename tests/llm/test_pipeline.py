"""The pipeline's stages one after the other against brute force, and the planted cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.staging import stage
from tests.llm.corpus import DOCS, documents, words
from tests.llm.test_duplicates import brute_near, brute_suffix
from tests.llm.test_texts import brute_leaks, split


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    """A corpus with planted junk, copies, repeated passages and benchmark passages."""
    rng = random.Random(11)
    at = tmp_path_factory.mktemp("sf")
    prose = lambda n: " ".join(("The " if i % 12 == 0 else "") + f"word{rng.randrange(10**6)}" + ("." if i % 12 == 11 else "") for i in range(n))
    passage, item = prose(60), words(rng, 40, 10**6)
    rows, labels = [], []
    for k in range(1, 301):
        if k % 10 == 0:
            text, good = " ".join(rng.choice(["$$$", "###", "CLICK HERE!!!", "||", "buy buy buy"]) for _ in range(80)), 0
        else:
            text, good = prose(rng.randrange(40, 120)), 1
        rows.append([k, text, "en", f"s{k % 4}", len(text)])
        labels.append((k, good, 0))
    rows[20][1] = rows[40][1] = rows[60][1] = rows[3][1]  # exact copies
    near = rows[4][1].split()
    near[0] = "changed"
    rows[70][1] = " ".join(near)
    rows[80][1] += f" {passage} {prose(20)}"
    rows[90][1] = f"{prose(20)} {passage}"
    rows[100][1] = f"{prose(10)} {item} {prose(10)}"
    rows += [[1000, None, "en", "s0", 0], [1001, "", None, None, None], [None, prose(50), "en", "s1", 1], [1002, prose(50), "en", "s1", 1], [1002, rows[-1][1], "en", "s1", 2]]
    rows.append(list(rows[303]))  # the whole row again
    spark.createDataFrame([tuple(r) for r in rows], DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(7, item), (8, "no such words at all")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.fixture(scope="module")
def stages(spark, home, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{home}/documents.parquet"), {}
    out["documents"] = docs
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, home).write.parquet(f"{at}/{name}")
        docs = out[name] = spark.read.parquet(f"{at}/{name}")
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "suffix_dedup", "decontamination", "packing"]
    assert all(stages[n].dtypes == stages["documents"].dtypes for n, _ in corpus_pipeline.STAGES[:-1])


def test_quality_drops_junk_and_keeps_clean_documents(stages):
    kept = {r.doc_id for r in stages["quality"].collect()}
    junk = set(range(10, 301, 10))
    assert len(kept & junk) <= 1 and len((set(range(1, 301)) - junk) - kept) <= 2


def test_one_document_of_each_group_stays(stages):
    before, after = texts(stages["quality"]), texts(stages["near_duplicates"])
    wanted = sorted(repr(d) for d, _, c, keep in brute_near(before, 80) if keep)
    assert sorted({repr(d) for d, _ in after}) == sorted(set(wanted))
    ids = [d for d, _ in after]
    assert not {21, 41, 61, 71} & set(ids) and {4, 5} <= set(ids)
    words_left = [t for _, t in after if (t or "").split()]
    assert len(set(words_left)) == len(words_left)


def test_unrelated_texts_without_an_id_or_with_one_id_stay(spark):
    rng = random.Random(12)
    alone = [words(rng, 40, 10**6) for _ in range(9)]
    group = words(rng, 200, 10**6)
    near = [group, group + " more", "other " + group]
    rows = [(None, alone[0]), (None, alone[1]), (None, alone[2]), (7, alone[3]), (7, alone[4]), (7, alone[5]), (3, alone[6]), (None, alone[7]), (None, alone[7]), (3, alone[8])]
    rows += [(None, near[0]), (7, near[1]), (3, near[2])]  # the least id of the group is also that of unrelated texts
    got = corpus_pipeline._near(spark, documents(spark, [t for _, t in rows], [d for d, _ in rows]), "")
    wanted = [r for r in rows if r[1] not in near[:2]]
    wanted.remove((None, alone[7]))
    assert sorted(map(repr, texts(got))) == sorted(map(repr, wanted))


def test_repeated_passages_go(stages):
    before, after = texts(stages["near_duplicates"]), dict(texts(stages["suffix_dedup"]))
    removed = {d: n for d, _, n, _, _ in brute_suffix(before)}
    assert sum(removed.values()) > 300 and (removed[81] > 0 or removed[91] > 0)
    for d, t in before:
        assert len((after[d] or "").encode()) == len((t or "").encode()) - removed[d]
    assert all(r.n_chars == len(r.text or "") for r in stages["suffix_dedup"].collect() if r.text is not None)


def leaks(docs, bench):
    """Ids of the documents in which a whole window of 5 words or more occurs, or that windows cover by 5 %."""
    long = [(i, t) for i, t in bench if len(split(t)) >= 5]
    return {d for d, _, n_hit, *_ in brute_leaks(docs, long) if n_hit} | {d for d, *_, contaminated in brute_leaks(docs, bench) if contaminated}


def test_benchmark_passages_go(spark, home, stages):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{home}/benchmark.parquet").collect()]
    before, after = texts(stages["suffix_dedup"]), texts(stages["decontamination"])
    bad = leaks(before, bench)
    assert 101 in bad and {d for d, _ in after} == {d for d, _ in before} - bad and not leaks(after, bench)


def test_no_passage_stays_whatever_was_cut(spark, tmp_path):
    """A short passage in a long text; passages that an earlier document holds whole, or in part."""
    rng = random.Random(13)
    item, other, phrase = words(rng, 15, 10**6), words(rng, 40, 10**6), words(rng, 3, 10**6)
    part = " ".join(other.split()[:30])
    prose = lambda n: words(rng, n, 10**7)
    before = [
        (1, f"{prose(1000)} {item} {prose(1000)}"), (2, f"{prose(50)} {item} {prose(50)}"), (3, f"{prose(500)} {part} {prose(500)}"), (4, f"{prose(500)} {other} {prose(500)}"), (5, f"{prose(500)} {phrase} {prose(20)}"), (6, phrase),
        (7, prose(60)), (None, f"{prose(500)} {other} {prose(5)}"), (None, prose(70)), (8, None), (9, ""),
    ]
    at = str(tmp_path)
    documents(spark, [t for _, t in before], [d for d, _ in before]).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item), (2, other), (3, phrase)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs = stage(corpus_pipeline._repeats(spark, spark.read.parquet(f"{at}/documents.parquet"), at), "cut")
    cut = dict(texts(docs))
    whole = dict(before)
    assert len(cut[4]) < len(whole[4]) - 100 and 0 < sum(w in cut[4] for w in other.split()) < 13 and not leaks([(4, cut[4])], [(2, other)])
    after = texts(corpus_pipeline._benchmark(spark, docs, at))
    assert sorted(map(repr, (d for d, _ in after))) == sorted(map(repr, [2, 5, 7, None, None, 8, 9]))
    assert item not in " ".join(t or "" for _, t in after) and not leaks(after, [(1, item), (2, other)])


def test_packing_holds_every_document(stages):
    packed = stages["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of")).collect()
    assert {r.doc_id for r in packed} == {d for d, _ in texts(stages["decontamination"])}


def test_run_gives_the_last_stage(spark, home, stages):
    assert sorted(map(repr, corpus_pipeline.run(spark, home).drop("sequence_id", "offset").collect())) == sorted(map(repr, stages["packing"].drop("sequence_id", "offset").collect()))


def test_empty_documents(spark, home, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{home}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_stay(spark, home):
    docs = documents(spark, ["a b c d e f g", "h i j k l m n"]).selectExpr("*", "1 as body", "2 as gone_id", "'x' as component_id", "3 as c0", "4 as row", "5 as kept_text")
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, home)
        assert out.columns == docs.columns, name
        out.collect()
