"""The training-data pipeline: quality, near duplicates, repeated passages, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents.  Stages are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import decontaminate, packing, quality
from tessera.llm.minhash import near_duplicates
from tessera.llm.radix import suffix_dedup
from tessera.llm.staging import stage

BROADCAST_ROWS = 1_000_000  # of (id, hash) pairs, 16 bytes each


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs that aren't in gone(doc_id, body); broadcast only while gone is counted as small."""
    gone = stage(gone.select(F.col("doc_id").alias("gone_id"), F.col("body").alias("gone_body")), "gone")
    right = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(right, docs["doc_id"].cast("long").eqNullSafe(right["gone_id"]) & (F.xxhash64(docs["text"].cast("string")) == right["gone_body"]), "left_anti")


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is not low."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.good_rows(docs, model, F.col("source"), F.concat_ws("/", "source", "lang"))


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (Jaccard of at least 0.8 over 5-word shingles): that with the least id.

    Groups are the components themselves, not their ids: texts without an id, or with one id, needn't resemble each other.
    """
    found = near_duplicates(docs, percent=80).where("n_shingles > 0")
    texts = found.groupBy("label", "doc_id", "body").agg(F.count("*").alias("copies"))
    least = texts.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "body")).alias("m")).select("label", F.col("m.doc_id").alias("d"), F.col("m.body").alias("b"))
    joined = texts.join(least, "label")
    kept = _without(docs, joined.where("not (doc_id <=> d and body = b)"))
    again = stage(joined.where("doc_id <=> d and body = b and copies > 1").select("doc_id", "body"), "again")
    if not again.limit(1).count():
        return kept
    # rows that repeat both id and text: one of each stays
    once = docs.join(again, docs["doc_id"].cast("long").eqNullSafe(again["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == again["body"]), "left_semi")
    once = once.withColumn("tessera_nth", F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64("text")))).where("tessera_nth = 1").drop("tessera_nth")
    return _without(kept, again).unionByName(once)


def _repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte runs that start earlier; documents keep their row and their other columns."""
    names, rest = docs.columns, [c for c in docs.columns if c != "text"]
    out = suffix_dedup(docs, texts=True, carry=rest)
    places = {"text": "kept_text"} | {c: f"c{k}" for k, c in enumerate(rest)}
    back = out.select(*(F.col(places[c]).alias(c) for c in names))
    return back.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else back


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item.

    A document goes if a whole window of an item occurs in it (13 words; all words of an item of 5 to 12), whatever
    its share of the document; windows of fewer words are common phrases, and go by the share of 5 %.  The stage
    before may have cut a passage that an earlier document holds, too, and left pieces that are no window any more:
    the texts that it changed are searched as they were, and documents that still hold 5 words in a row of what was
    found there go, too.  Documents of which the whole passage was cut are clean and stay.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(docs, benchmark)
    gone = found.where(F.col("contaminated") | (F.col("longest") >= decontaminate.GRAM)).select("doc_id", "body")
    left = decontaminate.remains(docs, _as_it_was(docs, spark.read.parquet(f"{sf_dir}/documents.parquet")), benchmark)
    return _without(docs, gone.union(left).distinct())


def _as_it_was(docs: DataFrame, whole: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents whose text isn't among those that docs has for their id; all of them, if those are too many to broadcast."""
    now = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(F.col("text").cast("string")).alias("b"))
    rows = whole.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    then = rows.select("doc_id", F.xxhash64("text").alias("body"))
    kept = then.join(now.select("d").distinct(), F.expr("doc_id <=> d"), "left_semi")
    cut = stage(kept.join(now, F.expr("doc_id <=> d and body = b"), "left_anti").distinct().select(F.col("doc_id").alias("cut_id"), F.col("body").alias("cut_body")), "cut")
    if cut.count() > BROADCAST_ROWS:
        return rows
    return rows.join(F.broadcast(cut), F.expr("doc_id <=> cut_id and xxhash64(text) = cut_body"), "left_semi")


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", _quality), ("near_duplicates", _near), ("suffix_dedup", _repeats), ("decontamination", _benchmark), ("packing", _packing)]
ORACLE_SQL = None  # trained and iterative stages; tests/llm compares each with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
