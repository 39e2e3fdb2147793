"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, decontaminate, licenses, packing, quality, toxicity
from tessera.llm.anchors import substring_dedup
from tessera.llm.main_text import main_text
from tessera.llm.minhash import near_duplicates
from tessera.llm.radix import suffix_dedup
from tessera.llm.staging import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digests of all documents against those of known licences, and their notice lines."""
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole document, learned from the rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", "predicted")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a 13-word window of a benchmark item."""
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("body", "longest")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(_table(spark, sf_dir, "pages"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a Jaccard similarity of 0.85 over 5-word shingles."""
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85).drop("body", "label")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows by cosine of every row whose id is divisible by 50."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of every document: its own evidence, its source's and its source and language's."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    judged = stage(quality.evidence(docs, model, F.col("source"), F.concat_ws("/", "source", "lang")), "evidence")
    return quality.posterior(judged, quality.sites_of(judged)).select("doc_id", "host", "path", "own", "host_rate", "site_rate", "posterior", "keep")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 13-word windows that an earlier document holds, removed from every document."""
    return substring_dedup(_table(spark, sf_dir, "documents"), texts=False)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that start earlier, removed from every document."""
    return suffix_dedup(_table(spark, sf_dir, "documents"), texts=False)


_OPS = (op1_license_scan, op2_toxicity, op3_decontamination, op4_main_text, op5_near_duplicates, op6_packing, op7_nearest, op8_quality, op9_substring_dedup, op10_suffix_dedup)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _OPS}

_OP9 = """
WITH d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
m AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s HAVING count(*) > 1),
p AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS p FROM g JOIN m USING (s) WHERE first < doc_id),
r AS (SELECT doc_id, list(p) AS gone FROM p GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
ORACLES: dict[str, str] = {"op1_license_scan": licenses.oracle(), "op3_decontamination": decontaminate.oracle(), "op9_substring_dedup": _OP9}
