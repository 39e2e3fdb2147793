"""Ranked retrieval: BM25 with field boosts over one row per symbol (or document).

A stored index has postings, sorted by term, and totals by kind: a query reads the rows of its own terms, which the
footers of the files let it find, and joins them with the symbols that hold one.  Over a table without an index, nothing
is exploded or shuffled: each row is analysed once, the frequencies of the query's terms are counted inside the row, and
the few numbers that are left of it are staged for the statistics and the scores.  The best rows come from
TakeOrderedAndProject, and what is shown of them is joined last.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources.staging import stage

K1, B = 1.2, 0.75
# fixed values: boosts and the labels of what fired
EXACT_NAME, NAME_TERM, IN_FEATURE, LITERAL, EXPORTED, RANK_SLOPE, RANK_CAP = 3.0, 1.8, 2.2, 1.3, 1.15, 5.0, 0.5
WHY_EXACT, WHY_NAME, WHY_DOC, WHY_LITERAL, WHY_PATH, WHY_TEXT = "tam ad", "ad", "doc", "literal", "yol", "metin"

FEATURES = dict[str, dict[str, list[str]]]


def counted(docs: DataFrame, terms: Column, query: list[str]) -> DataFrame:
    """docs with `len` (terms) and `tf` (how often each term of the query occurs); long arrays are read once."""
    same = lambda q: lambda t: t == q
    rows = docs.withColumn("_m", F.struct(F.size(terms).alias("len"), F.filter(terms, lambda t: t.isin(*query)).alias("hits")))
    tf = F.array(*(F.size(F.filter("_m.hits", same(q))) for q in query))
    return rows.withColumns({"len": F.col("_m.len"), "tf": tf}).drop("_m")


def statistics(docs: DataFrame, query: list[str], tf: str = "tf", length: str = "len") -> DataFrame:
    """One row: n, avg_len and the document frequencies df of the query's terms."""
    df = F.array(*(F.count_if(F.col(tf)[i] > 0) for i in range(len(query))))
    return docs.agg(F.struct(F.count("*").alias("n"), F.avg(length).alias("avg_len"), df.alias("df")).alias("s"))


def bm25(tf: Column, length: Column, stats: Column, n_terms: int) -> Column:
    """The sum over the query's terms of idf times saturated frequency."""
    score = F.lit(0.0)
    norm = K1 * (1 - B + B * length / stats["avg_len"])
    for i in range(n_terms):
        f, df = tf[i], stats["df"][i]
        idf = F.log(1 + (stats["n"] - df + 0.5) / (df + 0.5))
        score = score + F.when(f > 0, idf * f * (K1 + 1) / (f + norm)).otherwise(0.0)
    return score


def bm25_scores(docs: DataFrame, query: list[str], text: str = "text") -> DataFrame:
    """docs without its text, with `score` and `matched` (query terms that occur), both 0 for rows without any.

    Texts are split once: what is staged is one array of counts and a length.
    """
    rows = counted(docs.withColumn("_t", T.terms(F.col(text))), F.col("_t"), query).drop("_t", text)
    rows = stage(rows, "counted")
    scored = rows.withColumn("_s", statistics(rows.select("len", "tf"), query).scalar())
    matched = F.size(F.filter("tf", lambda f: f > 0))
    return scored.withColumn("matched", matched).withColumn("score", bm25(F.col("tf"), F.col("len"), F.col("_s"), len(query))).drop("_s", "tf", "len")


@dataclass
class Intent:
    """What a query asks for once feature aliases are applied."""

    terms: list[str]
    names: list[str]
    features: list[str] = field(default_factory=list)
    globs: list[str] = field(default_factory=list)


def driver_terms(text: str) -> list[str]:
    """tessera.functions.text.terms for one short text, without a job."""
    import regex

    spaced = regex.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", regex.sub("([a-z0-9])([A-Z])", r"\1 \2", text))
    return [t for p in regex.split(r"[^\p{L}\p{N}]+", spaced) if len((t := p.lower()).encode("utf-16-le")) > 2]


def intent(query: str, features: FEATURES | None = None) -> Intent | None:
    """None if the query has no term.  A feature applies if a label of it contains the query, or the query a label."""
    own = driver_terms(query)
    if not own:
        return None
    asked = query.lower().strip()
    out = Intent(own, ["".join(asked.split())])
    for name, feature in (features or {}).items():
        labels = [x.lower() for x in (name, *feature.get("aliases", []))]
        if any(x in asked or asked in x for x in labels):
            out.features.append(name)
            out.globs += feature.get("paths", [])
            out.terms += driver_terms(name)
            out.names.append(name.lower())
    out.terms, out.names = list(dict.fromkeys(out.terms)), list(dict.fromkeys(out.names))
    return out


def symbol_docs(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One row per symbol with the term arrays of its fields; every field is analysed once.

    symbols: file, ord, name, kind, start_line, end_line, exported, signature, doc, parent, strings; files: path, rank.
    """
    ranks = files.select(F.col("path").alias("file"), "rank")
    literal = F.flatten(F.transform(F.coalesce("strings", F.array().cast("array<string>")), T.terms))
    rows = symbols.join(ranks, "file").withColumns({"name_terms": T.terms(F.col("name")), "path_terms": T.terms(F.col("file")), "doc_terms": T.terms(F.col("doc")), "literal_terms": literal})
    return rows.withColumn("terms", F.concat("name_terms", "path_terms", T.terms(F.col("parent")), "doc_terms", "literal_terms"))


POSTINGS = ["term", "kind", "file", "ord", "tf", "len"]


def postings(docs: DataFrame) -> DataFrame:
    """How often each term occurs in each row of symbol_docs(), in order of the terms."""
    rows = docs.select("kind", "file", "ord", F.size("terms").alias("len"), F.explode("terms").alias("term"))
    return rows.groupBy("term", "kind", "file", "ord", "len").agg(F.count("*").cast("int").alias("tf")).select(*POSTINGS).repartitionByRange("term").sortWithinPartitions("term", "kind", "file")


def totals(docs: DataFrame) -> DataFrame:
    """Symbols and terms of each kind."""
    return docs.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("length"))


def _from_postings(docs: DataFrame, index: tuple[DataFrame, DataFrame], terms: list[str], kind: str | None, every: Column) -> tuple[DataFrame, Column]:
    """docs that hold a term (or for which `every` holds) with len and tf, and the statistics."""
    held, whole = index
    if kind is not None:
        held, whole = held.where(F.col("kind") == kind), whole.where(F.col("kind") == kind)
    held = held.where(F.col("term").isin(*terms))
    df = {r.term: r.df for r in held.groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row for each term of the query
    n, length = whole.agg(F.sum("n"), F.sum("length")).first()
    stats = F.struct(F.lit(n or 0).alias("n"), F.lit((length or 0) / n if n else 0.0).alias("avg_len"), F.array(*(F.lit(df.get(t, 0)) for t in terms)).alias("df"))
    tf = F.array(*(F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)) for t in terms))
    counts = held.groupBy("file", "ord").agg(F.max("len").alias("len"), tf.alias("tf"))
    rows = docs.join(counts, ["file", "ord"], "left").where(F.col("tf").isNotNull() | every)
    return rows.withColumns({"len": F.coalesce("len", F.size("terms")), "tf": F.coalesce("tf", F.array_repeat(F.lit(0), len(terms)))}), stats


def search(docs: DataFrame, query: str, limit: int = 10, features: FEATURES | None = None, kind: str | None = None, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The best symbols of symbol_docs() for a query: file, name, kind, lines, signature, doc, parent, score, why.

    index: the stored postings() and totals() of docs.  A kind is applied before the statistics.  A query without a
    term finds nothing, whatever its aliases.  Symbols of a matched feature's files are returned even without a
    matching term, with score 0.
    """
    out = ["file", "name", "kind", "start_line", "end_line", "signature", "doc", "parent", "score", "why"]
    want = intent(query, features)
    if kind is not None:
        docs = docs.where(F.col("kind") == kind)
    if want is None:
        return docs.withColumns({"score": F.lit(0.0), "why": F.array().cast("array<string>")}).select(*out).limit(0)
    asked = F.array(*(F.lit(t) for t in want.terms))
    inside = T.matches_any(F.col("file"), want.globs)
    rows, stats = _from_postings(docs, index, want.terms, kind, inside) if index else (counted(docs, F.col("terms"), want.terms), None)
    hit = lambda c: F.arrays_overlap(F.col(c), asked).alias(c.replace("terms", "hit"))
    rows = rows.select("file", "ord", F.lower("name").alias("lowered"), "exported", "rank", "len", "tf", inside.alias("inside"), *map(hit, ("name_terms", "doc_terms", "literal_terms", "path_terms")))
    if stats is None:
        rows = stage(rows, "counted")
        stats = statistics(rows.select("len", "tf"), want.terms).scalar()
    found = rows.withColumn("_s", stats).withColumn("_candidate", F.exists("tf", lambda f: f > 0) | F.col("inside"))
    exact = F.col("lowered").isin(want.names)
    by_name = ~exact & F.col("name_hit")
    score = bm25(F.col("tf"), F.col("len"), F.col("_s"), len(want.terms))
    for test, factor in ((exact, EXACT_NAME), (by_name, NAME_TERM), (F.col("inside"), IN_FEATURE), (F.col("literal_hit"), LITERAL), (F.col("exported"), EXPORTED)):
        score = score * F.when(test, factor).otherwise(1.0)
    score = score * (1 + F.least(F.col("rank") * RANK_SLOPE, F.lit(RANK_CAP)))
    labels = [(exact, WHY_EXACT), (by_name, WHY_NAME), (F.col("inside"), "feature:" + ",".join(want.features)), (F.col("doc_hit"), WHY_DOC), (F.col("literal_hit"), WHY_LITERAL), (F.col("path_hit"), WHY_PATH)]
    why = F.array_compact(F.array(*(F.when(test, F.lit(label)) for test, label in labels)))
    found = found.withColumns({"score": score, "why": F.when(F.size(why) > 0, why).otherwise(F.array(F.lit(WHY_TEXT)))})
    best = found.orderBy(F.desc("_candidate"), F.desc("score"), F.collate("file", "UNICODE"), "file", "ord").limit(limit).where("_candidate").select("file", "ord", "score", "why")
    shown = docs.select("file", "ord", "name", "kind", "start_line", "end_line", "signature", "doc", "parent").join(F.broadcast(best), ["file", "ord"])  # `limit` rows
    return shown.orderBy(F.desc("score"), F.collate("file", "UNICODE"), "file", "ord").select(*out)
