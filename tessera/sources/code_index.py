"""The code index as tables: files, symbols, specifiers, edges, what search reads, and one row of metadata; built anew or incrementally."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import pagerank
from tessera.operators.resolve import Alias, resolve_imports
from tessera.operators.search import postings, symbol_docs, totals
from tessera.parsers import SYMBOL, parse_files
from tessera.sources.files import source_files
from tessera.sources.staging import stage

SCHEMA_VERSION = 2
TABLES = ("files", "symbols", "specifiers", "edges", "docs", "postings", "totals")


class NotIndexed(LookupError):
    """There is no readable index of this version."""


@dataclass
class CodeIndex:
    files: DataFrame  # path, hash, lang, rank
    symbols: DataFrame  # file, ord, name, kind, start_line, end_line, exported, signature, doc, parent, strings
    specifiers: DataFrame  # src, lang, ord, spec
    edges: DataFrame  # src, dst, ord
    docs: DataFrame  # symbols with their rank and the terms of their fields
    postings: DataFrame  # term, kind, file, ord, tf, len, in order of the terms
    totals: DataFrame  # kind, n, length

    @property
    def terms(self) -> tuple[DataFrame, DataFrame]:
        return self.postings, self.totals


@dataclass
class Built:
    index: CodeIndex
    parsed: int
    reused: int
    removed: int
    symbols: int
    elapsed_ms: int


def build_index(files: DataFrame, previous: CodeIndex | None = None, aliases: list[Alias] | None = None, ignore: list[str] | None = None) -> Built:
    """Index files(path, text).  Files whose content hash is in `previous` keep their symbols and are not parsed.

    Specifiers of all files are resolved each time, since a target may have come or gone; ranks too.  `removed` counts
    stored files that were not reused, changed ones included.
    """
    began = time.time()
    current = source_files(files, ignore).select("path", "lang", F.col("text"), F.sha2("text", 256).alias("hash"))
    if previous is None:
        reused = current.select("path", "lang", "hash").limit(0)
        fresh = current
        stored = 0
    else:
        known = stage(previous.files.select("path", "hash"), "known")
        stored = known.count()
        reused = stage(current.select("path", "lang", "hash").join(known, ["path", "hash"], "left_semi"), "reused")
        fresh = current.join(known, ["path", "hash"], "left_anti")
    parsed = stage(parse_files(fresh), "parsed")
    symbols = parsed.select(F.col("path").alias("file"), F.inline("symbols"))
    specifiers = parsed.select(F.col("path").alias("src"), "lang", F.posexplode("specifiers").alias("ord", "spec"))
    if previous is not None:
        kept = reused.select(F.col("path").alias("file"))
        symbols = symbols.unionByName(previous.symbols.join(kept, "file", "left_semi"))
        specifiers = specifiers.unionByName(previous.specifiers.join(reused.select(F.col("path").alias("src")), "src", "left_semi"))
    listed = stage(parsed.select("path", "hash", "lang").unionByName(reused.select("path", "hash", "lang")), "files")
    symbols, specifiers = stage(symbols, "symbols"), stage(specifiers, "specifiers")
    edges = stage(resolve_imports(specifiers, listed, aliases), "imports")
    ranks = pagerank(listed.select(F.col("path").alias("id")), edges.select("src", "dst")).withColumnRenamed("id", "path")
    ranked = listed.join(ranks, "path")
    docs = stage(symbol_docs(symbols, ranked), "docs")
    index = CodeIndex(ranked, symbols, specifiers, edges, docs, postings(docs), totals(docs))
    n_parsed, n_reused = parsed.count(), reused.count()
    return Built(index, n_parsed, n_reused, max(0, stored - n_reused), symbols.count(), int((time.time() - began) * 1000))


def save_index(index: CodeIndex, folder: str) -> None:
    """Write the tables under a new version folder, then point the metadata at it: readers see the old index or the new."""
    spark = index.files.sparkSession
    version = uuid.uuid4().hex
    for name in TABLES:
        getattr(index, name).write.parquet(f"{folder}/{version}/{name}")
    meta = spark.createDataFrame([(SCHEMA_VERSION, int(time.time() * 1000), version)], "schema_version int, built_at long, version string")
    meta.coalesce(1).write.mode("overwrite").json(f"{folder}/meta")


def load_index(spark: SparkSession, folder: str) -> CodeIndex | None:
    """The stored index; None if it is missing, unreadable or of another version."""
    from pyspark.errors import AnalysisException

    try:
        meta = spark.read.schema("schema_version int, built_at long, version string").json(f"{folder}/meta").first()
    except AnalysisException:
        return None
    if meta is None or meta.schema_version != SCHEMA_VERSION or not meta.version:
        return None
    return CodeIndex(*(spark.read.parquet(f"{folder}/{meta.version}/{name}") for name in TABLES))


EMPTY_SYMBOLS = f"file string, {SYMBOL}"
