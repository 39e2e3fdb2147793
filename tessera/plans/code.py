"""Search, graph, reading and map queries: documents as files, parts and suppliers as an import graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import graph, readers, repo_map, search
from tessera.plans.binding import SQL_PATH, Registry, file_path, sql_terms, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

QUERY = "the license of their report and data"
TERMS = search.driver_terms(QUERY)
FEATURES = {"report": {"paths": ["web1/**", "web2/en/*"], "aliases": ["their report", "bericht"]}, "other": {"paths": ["news/**"], "aliases": ["zzz"]}}
WORD, WORD_LIMIT = "the", 500
BUDGET = 200_000


def _counts(where: str = "") -> str:
    return f"""d AS MATERIALIZED (SELECT *, {sql_terms('text')} AS terms FROM documents {where}),
n AS (SELECT count(*) AS n, avg(len(terms)) AS a FROM d),
tf AS (SELECT doc_id, t, count(*) AS f FROM (SELECT doc_id, unnest(terms) AS t FROM d) WHERE t IN ({', '.join(f"'{t}'" for t in TERMS)}) GROUP BY doc_id, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
s AS (SELECT tf.doc_id, count(*) AS matched, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(terms) / a))) AS score
      FROM tf JOIN df USING (t) JOIN d USING (doc_id), n GROUP BY tf.doc_id)"""


def _bm25(docs: DataFrame) -> DataFrame:
    scored = search.bm25_scores(docs, TERMS).select("doc_id", "matched", F.round("score", 6).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(20).where("matched > 0")


_TOP = "SELECT doc_id, matched::INTEGER AS matched, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, doc_id LIMIT 20"


@R.query(f"WITH {_counts()} {_TOP}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(table(spark, sf_dir, "documents").select("doc_id", "text"))


@R.query(f"WITH {_counts("WHERE lang = 'en'")} {_TOP}")
def bm25_kind_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind applies before the statistics."""
    return _bm25(table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "text"))


def _symbols(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A symbol per document: its source is the name, its text the doc; exported where labels say good; rank by length."""
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(True))
    rows = docs.join(good, "doc_id", "left").withColumn("file", file_path())
    none = F.lit(None).cast("string")
    symbols = rows.select("file", F.lit(0).alias("ord"), F.col("source").alias("name"), F.col("lang").alias("kind"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.coalesce("good", F.lit(False)).alias("exported"), F.lit("").alias("signature"), F.col("text").alias("doc"), none.alias("parent"), F.lit(None).cast("array<string>").alias("strings"))
    return symbols, rows.select(F.col("file").alias("path"), (F.col("n_chars") / 1e6).alias("rank"))


@R.query(f"""WITH g AS (SELECT DISTINCT doc_id, true AS good FROM labels WHERE quality = 1),
d AS MATERIALIZED (SELECT d.doc_id, {SQL_PATH} AS file, source AS name, coalesce(good, false) AS exported, n_chars / 1e6 AS rank, {sql_terms('source')} AS name_terms, {sql_terms(SQL_PATH)} AS path_terms, {sql_terms('text')} AS doc_terms FROM documents d LEFT JOIN g USING (doc_id)),
t AS (SELECT *, list_concat(name_terms, path_terms, doc_terms) AS terms, regexp_matches(file, '^(web1/.*|web2/en/[^/]*)$') AS inside FROM d),
q AS (SELECT {TERMS!r}::VARCHAR[] AS q),
n AS (SELECT count(*) AS n, avg(len(terms)) AS a FROM t),
tf AS (SELECT file, x AS term, count(*) AS f FROM (SELECT file, unnest(terms) AS x FROM t) WHERE x IN ({', '.join(f"'{t}'" for t in TERMS)}) GROUP BY file, x),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT tf.file, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(terms) / a))) AS score FROM tf JOIN df USING (term) JOIN t USING (file), n GROUP BY tf.file),
b AS (SELECT t.file, t.name, coalesce(score, 0.0) * CASE WHEN list_has_any(name_terms, q) THEN 1.8 ELSE 1.0 END * CASE WHEN inside THEN 2.2 ELSE 1.0 END * CASE WHEN exported THEN 1.15 ELSE 1.0 END * (1 + least(rank * 5, 0.5)) AS score,
      list_filter([CASE WHEN list_has_any(name_terms, q) THEN 'ad' END, CASE WHEN inside THEN 'feature:report' END, CASE WHEN list_has_any(doc_terms, q) THEN 'doc' END, CASE WHEN list_has_any(path_terms, q) THEN 'yol' END], lambda x: x IS NOT NULL) AS why
      FROM t LEFT JOIN s USING (file), q WHERE s.file IS NOT NULL OR inside)
SELECT file, name, round(score, 6) AS score, array_to_string(why, '|') AS why FROM b ORDER BY score DESC, file LIMIT 50""")
def feature_alias_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, files = _symbols(spark, sf_dir)
    found = search.search(search.symbol_docs(symbols, files), QUERY, 50, FEATURES)
    return found.select("file", "name", F.round("score", 6).alias("score"), F.array_join("why", "|").alias("why"))


_EDGES = "(SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem)"


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "lineitem")
    edges = items.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    parts, suppliers = (items.select(c).distinct().select(F.concat(F.lit(p), c).alias("id")) for p, c in (("p", "l_partkey"), ("s", "l_suppkey")))
    return parts.union(suppliers), edges


def _pagerank_sql() -> str:
    steps = [f"WITH e AS MATERIALIZED {_EDGES}", "v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)", "o AS MATERIALIZED (SELECT src AS id, count(*) AS k FROM e GROUP BY src)", "n AS MATERIALIZED (SELECT count(*) AS n FROM v)", "r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS r FROM v, n)"]
    for i in range(graph.ITERATIONS):
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT v.id, 0.15 / n + 0.85 * (coalesce(g, 0) + loose / n) AS r FROM v LEFT JOIN (SELECT dst AS id, sum(r / k) AS g FROM e JOIN r{i} ON r{i}.id = src JOIN o ON o.id = src GROUP BY dst) USING (id), n, (SELECT coalesce(sum(r), 0) AS loose FROM r{i} ANTI JOIN o USING (id)))")
    return ", ".join(steps) + f" SELECT id, round(r, 10) AS rank FROM r{graph.ITERATIONS}"


@R.query(_pagerank_sql())
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(*_graph(spark, sf_dir)).select("id", F.round("rank", 10).alias("rank"))


@R.query(f"SELECT src AS node, count(DISTINCT dst) AS out_deg FROM {_EDGES} GROUP BY src")
def out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.out_degree(_graph(spark, sf_dir)[1])


def _ranges(docs: DataFrame) -> DataFrame:
    """Symbols of a document: every 10 lines an outer one, every 5 lines an inner one."""
    n = F.size(F.split("text", "\n"))

    def every(k: int, name: str, first: int) -> F.Column:
        count = F.ceil(n / k).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.struct((first + i).alias("ord"), F.concat(F.lit(name), i.cast("string")).alias("name"), (i * k + 1).alias("start_line"), F.least(i * k + k, n).alias("end_line")))

    both = docs.select(F.col("path").alias("file"), F.inline(F.concat(every(10, "outer", 0), every(5, "inner", 1_000_000))))
    return both.withColumns({"kind": F.lit("function"), "parent": F.lit(None).cast("string"), "exported": F.lit(True), "signature": F.col("name"), "doc": F.lit(None).cast("string")})


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(file_path().alias("path"), "text")


_LINES = f"(SELECT {SQL_PATH} AS file, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line, len(string_split(text, chr(10))) AS n FROM documents)"


@R.query(f"""SELECT file, line::INTEGER AS line, substr(regexp_replace(text, '^[\\t\\n\\x0B\\f\\r \\x{{A0}}]+|[\\t\\n\\x0B\\f\\r \\x{{A0}}]+$', '', 'g'), 1, 160) AS text, CASE WHEN (line - 1) // 5 % 2 = 0 AND n <= (line - 1) // 5 * 5 + 5 THEN 'outer' || (line - 1) // 10 ELSE 'inner' || (line - 1) // 5 END AS symbol, 'function' AS kind
FROM {_LINES} WHERE regexp_matches(text, '(^|[^A-Za-z0-9_]){WORD}($|[^A-Za-z0-9_])') ORDER BY file, line LIMIT {WORD_LIMIT}""")
def references_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    return readers.references(_ranges(texts), texts, WORD, WORD_LIMIT)


@R.query(f"""WITH f AS (SELECT min({SQL_PATH}) AS file FROM documents), l AS (SELECT DISTINCT file, n FROM {_LINES})
SELECT 'outer' || i AS name, (i * 10 + 1)::INTEGER AS start_line, least(i * 10 + 10, n)::INTEGER AS end_line FROM f JOIN l USING (file), range(0, 100000) r(i) WHERE i * 10 < n
UNION ALL SELECT 'inner' || i, (i * 5 + 1)::INTEGER, least(i * 5 + 5, n)::INTEGER FROM f JOIN l USING (file), range(0, 100000) r(i) WHERE i * 5 < n""")
def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    first = texts.agg(F.min("path")).first()[0]
    return readers.outline(_ranges(texts), first).select("name", "start_line", "end_line")


@R.query(f"""WITH f AS (SELECT min({SQL_PATH}) AS file FROM documents)
SELECT file, 'outer0' AS name, 1 AS start_line, least(10, count(*))::INTEGER AS end_line, string_agg(text, chr(10) ORDER BY line) FILTER (line <= 10) AS body FROM f JOIN {_LINES} USING (file) GROUP BY file""")
def symbol_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    first = texts.agg(F.min("path")).first()[0]
    return readers.symbol_body(_ranges(texts), texts, first, "outer0").drop("signature")


def _pack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.col("n_chars").cast("double").alias("rank"), "n_chars")
    return docs.select("path", "rank", F.concat("path", F.lit("\n"), F.repeat(F.lit("x"), F.col("n_chars").cast("int"))).alias("block"), F.concat("path", F.lit("\nshort")).alias("short"))


@R.query(f"""WITH RECURSIVE o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY n_chars DESC, lpad(doc_id::VARCHAR, 12, '0')) AS i, lpad(doc_id::VARCHAR, 12, '0') AS path, n_chars + 14 AS b FROM documents),
p AS (SELECT 0::BIGINT AS i, 0::BIGINT AS used, ''::VARCHAR AS path, ''::VARCHAR AS form
      UNION ALL SELECT o.i, CASE WHEN used + b <= {BUDGET} THEN used + b WHEN used + 19 <= {BUDGET} THEN used + 19 ELSE used END, o.path, CASE WHEN used + b <= {BUDGET} THEN 'block' WHEN used + 19 <= {BUDGET} THEN 'short' ELSE 'none' END FROM p JOIN o ON o.i = p.i + 1)
SELECT path, form FROM p WHERE form IN ('block', 'short')""")
def repo_map_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = repo_map.pack_budget(_pack_rows(spark, sf_dir), BUDGET)
    rows = [(p, "short" if t.endswith("\nshort") else "block") for p, t in packed.entries]
    return spark.createDataFrame(rows, "path string, form string")


@R.query("SELECT lang AS kind, count(*) AS n FROM documents GROUP BY lang")
def kind_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.kind_statistics(table(spark, sf_dir, "documents").select(F.col("lang").alias("kind")))


@R.query(f"""WITH f AS (SELECT source || '/' || lang AS dir, {SQL_PATH} AS path, n_chars FROM documents),
g AS (SELECT dir, count(*) AS files, sum(n_chars / 1e6) AS r, min(path) AS p FROM f WHERE dir NOT IN (SELECT min(dir) FROM f) GROUP BY dir ORDER BY round(r, 9) DESC, p LIMIT 10),
k AS (SELECT *, split_part(dir, '/', 2) AS name, row_number() OVER (PARTITION BY split_part(dir, '/', 2) ORDER BY round(r, 9) DESC, p) AS nth FROM g)
SELECT name, dir || '/**' AS glob, files FROM k WHERE nth = 1""")
def dir_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.select(file_path().alias("path"), (F.col("n_chars") / 1e6).alias("rank"))
    covered = docs.agg(F.min(F.concat_ws("/", "source", "lang"))).first()[0]
    none = spark.createDataFrame([], "file string, kind string")
    return readers.suggest_features(files, none, [f"{covered}/**"])


@R.query("SELECT sha256(coalesce(text, '')) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    return hashed.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
