"""Scalar functions and predicates on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import display as D
from tessera.functions import metadata as M
from tessera.functions import text as T
from tessera.plans.binding import SQL_PATH, Registry, events, file_path, sql_terms, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

NOW = 1_706_600_000
GLOBS = ["web*/**", "**/{en,fr}/*[0-4]", "src0/*/1?"]
_SUFFIXES = ["a.ts", "b.tsx", "c.d.ts", "d.py", "e.pyi", "f.mjs", "g.cjs", "h.jsx", "i.d.mts", "j.txt", "k.cts"]
_DURATIONS = ["30m", "2h", "7d", "15 S", "3dk", "4 sa", "5G", "9sn", "10", "x2h", ""]


@R.query(f"SELECT t AS term, count(*) AS n FROM (SELECT unnest({sql_terms('text')}) AS t FROM documents) GROUP BY t")
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "documents").select(F.explode(T.terms(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n"))


@R.query(f"SELECT t AS term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({sql_terms('text')}) AS t FROM documents) GROUP BY t")
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term"))
    return docs.groupBy("term").agg(F.count("*").alias("df"))


@R.query(r"""SELECT doc_id, CASE WHEN length(f) > 120 THEN substr(f, 1, 119) || '…' ELSE f END AS line, md5(f) AS whole
FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g')) AS f FROM documents)""")
def one_line_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", T.one_line(text, 120).alias("line"), F.md5(T.one_line(text, 1 << 30)).alias("whole"))


@R.query(f"""WITH s AS (SELECT page_id, url || '/' || ({_SUFFIXES!r}::VARCHAR[])[(page_id % {len(_SUFFIXES)}) + 1] AS path FROM pages)
SELECT page_id, CASE WHEN regexp_matches(path, '\\.[tj]sx$') THEN 'tsx' WHEN regexp_matches(path, '\\.[mc]?ts$') THEN 'ts' WHEN regexp_matches(path, '\\.[mc]?js$') THEN 'js' WHEN regexp_matches(path, '\\.pyi?$') THEN 'py' END AS lang,
regexp_matches(path, '\\.d\\.[mc]?ts$') AS declaration FROM s""")
def lang_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.get(F.array(*map(F.lit, _SUFFIXES)), F.col("page_id") % len(_SUFFIXES))
    rows = table(spark, sf_dir, "pages").withColumn("path", F.concat_ws("/", "url", suffix))
    return rows.select("page_id", T.language(F.col("path")).alias("lang"), T.is_declaration_file(F.col("path")).alias("declaration"))


@R.query("SELECT event_id, length(props) BETWEEN 3 AND 80 AND regexp_matches(props, '[a-zA-Z]') AND NOT regexp_matches(props, '^[./]+$') AS useful FROM events")
def useful_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.useful_string(F.col("props")).alias("useful"))


@R.query(f"SELECT doc_id, {SQL_PATH} AS path FROM documents WHERE regexp_matches({SQL_PATH}, '^(web[^/]*/.*|(.*/)?(en|fr)/[^/]*[0-4]|src0/[^/]*/1[^/])$')")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", file_path().alias("path")).where(T.matches_any(F.col("path"), GLOBS))


@R.query(f"""SELECT event_id, CASE WHEN d < 60 THEN d || 'sn önce' WHEN d < 3600 THEN d // 60 || 'dk önce' WHEN d < 86400 THEN d // 3600 || 'sa önce' ELSE d // 86400 || 'g önce' END AS age
FROM (SELECT event_id, greatest({NOW} - floor(epoch_us(ts) / 1000000)::BIGINT, 0) AS d FROM events)""")
def relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", D.relative_time(F.col("ts"), F.lit(NOW)).alias("age"))


@R.query(f"""WITH d AS (SELECT event_id, trim(({_DURATIONS!r}::VARCHAR[])[event_id % {len(_DURATIONS)} + 1]) AS t FROM events),
m AS (SELECT event_id, regexp_extract(t, '(?i)^(\\d+)\\s*(s|sn|m|dk|h|sa|d|g)$', 1) AS n, lower(regexp_extract(t, '(?i)^(\\d+)\\s*(s|sn|m|dk|h|sa|d|g)$', 2)) AS u FROM d)
SELECT event_id, CASE WHEN n <> '' THEN n::BIGINT * CASE WHEN u IN ('s', 'sn') THEN 1000 WHEN u IN ('m', 'dk') THEN 60000 WHEN u IN ('h', 'sa') THEN 3600000 ELSE 86400000 END END AS ms FROM m""")
def parse_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.get(F.array(*map(F.lit, _DURATIONS)), (F.col("event_id") % len(_DURATIONS)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", D.duration_ms(said).alias("ms"))


@R.query("SELECT o_orderkey, CASE WHEN k < 1024 THEN k || ' KiB' ELSE format('{:.1f} MiB', floor(k * 10 / 1024.0::DOUBLE + 0.5) / 10) END AS size FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS k FROM orders)")
def format_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", D.size_text(F.floor("o_totalprice")).alias("size"))


@R.query("SELECT o_orderkey, CASE s WHEN 'watch' THEN 'oto' WHEN 'agent' THEN 'ajan' WHEN 'manual' THEN 'elle' WHEN 'pre-restore' THEN 'geri-al' ELSE s END AS label FROM (SELECT o_orderkey, (['watch','agent','manual','pre-restore','other'])[o_orderkey % 5 + 1] AS s FROM orders)")
def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.get(F.array(*map(F.lit, ("watch", "agent", "manual", "pre-restore", "other"))), (F.col("o_orderkey") % 5).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.source_label(source).alias("label"))


@R.query(f"""WITH m AS (SELECT event_id, event_type || chr(10) || CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN '{M.MARKER} {{"v":1,"label":"' || event_type || '","source":"agent","branch":"b' || event_id % 7 || '"}}' ELSE '{M.MARKER} {{broken' END AS message FROM events)
SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'agent' ELSE 'manual' END AS source, split_part(message, chr(10), 1) AS label, CASE WHEN event_id % 3 = 1 THEN 'b' || event_id % 7 ELSE 'unknown' END AS branch FROM m""")
def meta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct(F.lit(1).alias("v"), F.col("event_type").alias("label"), F.lit("agent").alias("source"), F.format_string("b%d", F.col("event_id") % 7).alias("branch"))
    body = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.concat(F.lit(f"{M.MARKER} "), F.to_json(row))).otherwise(f"{M.MARKER} {{broken")
    meta = M.decode(F.concat("event_type", F.lit("\n"), body))
    return table(spark, sf_dir, "events").select("event_id", meta.alias("m")).select("event_id", "m.source", "m.label", "m.branch")
