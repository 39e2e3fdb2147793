"""What a query costs in estimated tokens: whole files after a plain search, against the ranked hits and one body."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import render as R
from tessera.functions import text as T
from tessera.operators import readers, search

OPENED, HITS = 5, 5


@dataclass
class Cost:
    query: str
    naive_chars: int
    indexed_chars: int
    matched: int
    top: str | None

    @property
    def naive_tokens(self) -> int:
        return int(self.naive_chars / T.CHARS_PER_TOKEN + 0.5)

    @property
    def indexed_tokens(self) -> int:
        return int(self.indexed_chars / T.CHARS_PER_TOKEN + 0.5)

    @property
    def ratio(self) -> float:
        return self.naive_chars / self.indexed_chars if self.indexed_chars else float("inf")


def measure(texts: DataFrame, docs: DataFrame, symbols: DataFrame, query: str, features: search.FEATURES | None = None, opened: int = OPENED, index: tuple[DataFrame, DataFrame] | None = None) -> Cost:
    """texts(path, text), symbol_docs() and symbols; the plain search is for the query's longest word, without case."""
    word = max(query.split(), key=len)
    found = texts.where(F.contains(F.lower("text"), F.lit(word.lower())))
    listed = found.agg(F.count("*").alias("n"), F.sum(T.utf16_length(F.col("path")) + 1).alias("chars")).first()
    size = found.orderBy("path").limit(opened).agg(F.sum(F.octet_length("text")).alias("s")).first().s or 0
    hits = search.search(docs, query, HITS, features, index=index)
    rows = hits.select("file", "name", "parent", "start_line", R.hit().alias("line")).collect()
    indexed = len("\n".join(r.line for r in rows).encode("utf-16-le")) // 2
    if rows:
        name = f"{rows[0].parent}.{rows[0].name}" if rows[0].parent else rows[0].name
        body = readers.symbol_body(symbols, texts, rows[0].file, name).first()
        indexed += len((body.body if body else "").encode("utf-16-le")) // 2
    return Cost(query, size + max(0, (listed.chars or 0) - 1), indexed, listed.n, f"{rows[0].file}:{rows[0].start_line}" if rows else None)


def total(costs: list[Cost]) -> Cost:
    return Cost("total", sum(c.naive_chars for c in costs), sum(c.indexed_chars for c in costs), sum(c.matched for c in costs), None)
