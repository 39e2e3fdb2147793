"""Queries of the index, its sources and its settings: source files are made from the driver's rows by templates.

What a template holds is known line by line, so the SQL states the rows that scanners, resolution and stores must give.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import display as D
from tessera.functions import metadata as M
from tessera.functions import render
from tessera.operators import cost, graph, readers, repo_map, search
from tessera.operators import timeline as TL
from tessera.operators.resolve import parse_aliases, resolve_imports
from tessera.parsers import parse_files
from tessera.plans.binding import SQL_EVENTS, SQL_PATH, Registry, events, file_path, table
from tessera.plans.code import _graph, _LINES, _pagerank_sql, _ranges, _texts, WORD, WORD_LIMIT
from tessera.sources import files as FS
from tessera.sources.code_index import build_index
from tessera.sources.staging import shared_dir
from tessera.sources.timeline_store import TimelineStore
from tessera.streaming import watch as W

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


# --- scanners and the index

PYTHON = """import os, m§ as x
from .a§ import b

class C§(Base):
    \"""Doc §.\"""

    @router.get("/api/§")
    def get_§(self, a="lit §"):
        return a

def _hidden§(
    a,  # note
):
    pass
"""
SCRIPT = """import { a } from "./a§.js";
/** Says §. */
export function say§(x: number): string {
  return "text §";
}
export const Max§ = 5;
"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, text: Python of even ids, TypeScript of odd ones, each with its id in every name."""
    even, key = F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    path = F.concat(F.when(even, "py/m").otherwise("web/m"), key, F.when(even, ".py").otherwise(".ts"))
    return docs.select("doc_id", path.alias("path"), F.replace(F.when(even, PYTHON).otherwise(SCRIPT), F.lit("§"), key).alias("text"))


@R.query("""SELECT 'py/m' || d || '.py' AS path, s.* FROM (SELECT doc_id::VARCHAR AS d FROM documents WHERE doc_id % 2 = 0), LATERAL (VALUES
  (0, 'C' || d, 'class', 4, 9, true, 'class C' || d || '(Base)', 'Doc ' || d || '.', NULL, 'Doc ' || d || '.|/api/' || d || '|lit ' || d, 'os,m' || d || ',.a' || d),
  (1, 'get_' || d, 'route', 7, 9, true, '@router.get("/api/' || d || '") def get_' || d || '(self, a="lit ' || d || '")', NULL, NULL, '/api/' || d || '|lit ' || d, 'os,m' || d || ',.a' || d),
  (2, '_hidden' || d, 'function', 11, 14, false, 'def _hidden' || d || '( a, )', NULL, NULL, NULL, 'os,m' || d || ',.a' || d)) s(ord, name, kind, start_line, end_line, exported, signature, doc, parent, strings, specifiers)
UNION ALL SELECT 'web/m' || d || '.ts', s.* FROM (SELECT doc_id::VARCHAR AS d FROM documents WHERE doc_id % 2 = 1), LATERAL (VALUES
  (0, 'say' || d, 'function', 3, 5, true, 'export function say' || d || '(x: number): string', 'Says ' || d || '.', NULL, 'text ' || d, './a' || d || '.js'),
  (1, 'Max' || d, 'const', 6, 6, true, 'export const Max' || d || ' = 5;', NULL, NULL, NULL, './a' || d || '.js')) s(ord, name, kind, start_line, end_line, exported, signature, doc, parent, strings, specifiers)""")
def parsed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols and specifiers that the scanners find."""
    files = FS.source_files(_sources(spark, sf_dir).drop("doc_id")).withColumn("hash", F.lit(""))
    rows = parse_files(files).select("path", F.array_join("specifiers", ",").alias("specifiers"), F.inline("symbols"))
    return rows.withColumn("strings", F.when(F.col("strings").isNotNull(), F.array_join("strings", "|")))


@R.query("""WITH c AS (SELECT doc_id, doc_id % 3 <> 0 AS stored, doc_id % 7 = 0 AS altered FROM documents),
n AS (SELECT count(*) FILTER (NOT stored OR altered) AS parsed, count(*) FILTER (stored AND NOT altered) AS reused, count(*) FILTER (stored) AS was, count(*) FILTER (doc_id % 2 = 0) * 3 + count(*) FILTER (doc_id % 2 = 1) * 2 AS symbols FROM c)
SELECT parsed, reused, was - reused AS removed, symbols FROM n""")
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an incremental build parses, keeps, drops and holds, against an older state without every 3rd file and with every 7th altered."""
    now = _sources(spark, sf_dir)
    then = now.where("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\n"))).otherwise(F.col("text")))
    first = build_index(then.drop("doc_id"))
    built = build_index(now.drop("doc_id"), first.index)
    return spark.createDataFrame([(built.parsed, built.reused, built.removed, built.symbols)], "parsed long, reused long, removed long, symbols long")


_CONFIG = """{ // the roots
  "compilerOptions": { "baseUrl": ".", "paths": { "@/*": ["web/*"], /* more */ "@/never/*": ["none/*"], }, },
}"""


def _module(key: F.Column) -> F.Column:
    folder = F.concat(F.when(key % 4 == 3, "py/p").otherwise("web/d"), (key % 10).cast("string"), F.lit("/m"), key.cast("string"))
    return F.concat(folder, F.get(F.array(F.lit(".ts"), F.lit(".tsx"), F.lit("/index.js"), F.lit(".py")), (key % 4).cast("int")))


@R.query("""WITH n AS (SELECT count(*) AS n FROM documents),
f AS (SELECT doc_id AS k, CASE WHEN doc_id % 4 = 3 THEN 'py/p' ELSE 'web/d' END || doc_id % 10 || '/m' || doc_id || (['.ts', '.tsx', '/index.js', '.py'])[doc_id % 4 + 1] AS path FROM documents),
t AS (SELECT k, path AS src, k * 7 % n AS a, (k * 11 + 3) % n AS b, (k * 13 + 5) % n AS c FROM f, n),
r AS (SELECT src, a AS k, 0 AS ord FROM t WHERE t.k % 4 < 2 AND a % 4 < 3
      UNION ALL SELECT src, b, 1 FROM t WHERE t.k % 4 < 2 AND b % 4 < 2
      UNION ALL SELECT src, c, 2 FROM t WHERE t.k % 4 < 3 AND c % 4 < 3
      UNION ALL SELECT src, a, 0 FROM t WHERE t.k % 4 = 3 AND a % 4 = 3
      UNION ALL SELECT src, b, 1 FROM t WHERE t.k % 4 = 3 AND b % 4 = 3
      UNION ALL SELECT src, c, 2 FROM t WHERE t.k % 4 = 3 AND c % 4 = 3 AND c % 10 = t.k % 10)
SELECT src, path AS dst, min(ord)::INTEGER AS ord FROM r JOIN f USING (k) GROUP BY src, path""")
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative, swapped, aliased and package specifiers of every module to three others, and one that is no file."""
    docs = table(spark, sf_dir, "documents")
    n, key = docs.count(), F.col("doc_id")
    a, b, c = key * 7 % n, (key * 11 + 3) % n, (key * 13 + 5) % n
    place = lambda t, sep: F.concat((t % 10).cast("string"), F.lit(f"{sep}m"), t.cast("string"))
    script = F.array(F.concat(F.lit("../d"), place(a, "/")), F.concat(F.lit("../d"), place(b, "/"), F.lit(".js")), F.concat(F.lit("@/d"), place(c, "/./")), F.lit("react"))
    python = F.array(F.concat(F.lit("..p"), place(a, ".")), F.concat(F.lit("py.p"), place(b, "."), F.lit(".name")), F.concat(F.lit(".m"), c.cast("string")), F.lit("os"))
    files = docs.select(_module(key).alias("path"))
    lang = F.when(key % 4 == 3, "py").otherwise("ts")
    said = docs.select(_module(key).alias("src"), lang.alias("lang"), F.posexplode(F.when(key % 4 == 3, python).otherwise(script)).alias("ord", "spec"))
    return resolve_imports(said, files, parse_aliases(_CONFIG))


@R.query(_pagerank_sql())
def pagerank_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rounds as joins, as they run where the graph is too large for the driver."""
    return graph.pagerank(*_graph(spark, sf_dir), driver_bytes=0).select("id", F.round("rank", 10).alias("rank"))


@R.query("SELECT 'lang' AS what, lang AS key, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'top', path, n_chars FROM (SELECT *, " + SQL_PATH + " AS path FROM documents ORDER BY n_chars DESC, path LIMIT 8)")
def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(file_path().alias("path"), "lang", F.col("n_chars").alias("rank"))
    langs = readers.language_statistics(files).select(F.lit("lang").alias("what"), F.col("lang").alias("key"), "n")
    return langs.unionAll(readers.top_files(files).select(F.lit("top"), "path", "rank"))


# --- reading and the map

_KINDS = ["route", "component", "hook", "class", "function", "interface", "method", "type", "enum", "const", "other"]
_WEIGHTS = [6, 5, 5, 4, 3, 2, 2, 1, 1, 1, 1]


@R.query(f"""WITH s AS (SELECT 'f' || l_orderkey || '.ts' AS path, l_linenumber AS ord, max(l_partkey) AS p FROM lineitem GROUP BY ALL),
x AS (SELECT path, ord, p % 50 + 1 AS line, ({_KINDS!r}::VARCHAR[])[p % 11 + 1] AS kind, ({_WEIGHTS!r})[p % 11 + 1] AS w, CASE WHEN p % 4 = 0 THEN 'C' || p % 7 || '.' ELSE '' END || 'n' || p AS q FROM s WHERE p % 3 <> 0),
r AS (SELECT *, '  ' || line || ': ' || kind || ' ' || q AS said, row_number() OVER (PARTITION BY path ORDER BY w DESC, line, ord) AS nth FROM x)
SELECT path, md5(path || chr(10) || string_agg(said, chr(10) ORDER BY line, ord)) AS block, path || chr(10) || string_agg(said, chr(10) ORDER BY line, ord) FILTER (nth <= 2) AS short FROM r GROUP BY path""")
def map_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map's entry of every file with an exported symbol, and its short form with the two that weigh most."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), F.lit(".ts")).alias("file"), F.col("l_linenumber").alias("ord")).agg(F.max("l_partkey").alias("p"))
    p = F.col("p")
    parent = F.when(p % 4 == 0, F.concat(F.lit("C"), (p % 7).cast("string")))
    symbols = rows.select("file", "ord", F.concat(F.lit("n"), p.cast("string")).alias("name"), F.get(F.array(*map(F.lit, _KINDS)), (p % 11).cast("int")).alias("kind"), (p % 50 + 1).alias("start_line"), (p % 3 != 0).alias("exported"), parent.alias("parent"))
    files = symbols.select(F.col("file").alias("path")).distinct().withColumn("rank", F.lit(0.0))
    return repo_map.blocks(files, symbols).select("path", F.md5("block").alias("block"), "short")


@R.query(f"""SELECT file, line::INTEGER AS line, CASE WHEN (line - 1) // 5 = 1 OR ((line - 1) // 5 % 2 = 0 AND n <= (line - 1) // 5 * 5 + 5) THEN 'outer' || (line - 1) // 10 ELSE 'inner' || (line - 1) // 5 END AS symbol
FROM {_LINES} WHERE regexp_matches(text, '(^|[^A-Za-z0-9_]){WORD}($|[^A-Za-z0-9_])') ORDER BY file, line LIMIT {WORD_LIMIT}""")
def references_to_itself(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol of the searched name encloses nothing: what it would enclose falls to the symbol around it."""
    texts = _texts(spark, sf_dir)
    symbols = _ranges(texts).withColumn("name", F.when(F.col("name") == "inner1", WORD).otherwise(F.col("name")))
    return readers.references(symbols, texts, WORD, WORD_LIMIT).select("file", "line", "symbol")


@R.query("SELECT DISTINCT source AS name, '**/' || source || '/**' AS glob, NULL::BIGINT AS files FROM documents WHERE lang = 'en'")
def route_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of route files, but for the usual names of roots."""
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "route").otherwise("function")
    symbols = docs.select(F.concat(F.lit("src/"), "source", F.lit("/x.ts")).alias("file"), kind.alias("kind")).unionAll(docs.select(F.lit("src/app/y.ts"), F.lit("route")))
    return readers.suggest_features(spark.createDataFrame([], "path string, rank double"), symbols, [])


_ASKED = "sym77"


@R.query(f"""WITH t AS (SELECT {SQL_PATH} AS path, lang, doc_id, coalesce(text, '') || chr(10) || 'sym' || doc_id AS text FROM documents),
f AS (SELECT * FROM t WHERE contains(lower(text), '{_ASKED}')),
o AS (SELECT sum(strlen(text)) AS size FROM (SELECT text FROM f ORDER BY path LIMIT 5)),
h AS (SELECT path, length(path || ':1-1 {_ASKED} [' || lang || '] (tam ad)' || chr(10) || '   ') + length(string_split(text, chr(10))[1]) AS chars FROM t WHERE doc_id = 77)
SELECT (SELECT size FROM o)::BIGINT + (SELECT sum(length(path) + 1) - 1 FROM f)::BIGINT AS naive_chars, chars::BIGINT AS indexed_chars, (SELECT count(*) FROM f) AS matched, path || ':1' AS top FROM h""")
def token_cost_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What finding a symbol costs by whole files (five are opened: the feature's own cap) and by the index."""
    docs, name = table(spark, sf_dir, "documents"), F.concat(F.lit("sym"), F.col("doc_id").cast("string"))
    texts = docs.select(file_path().alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), name).alias("text"))
    none = F.lit(None).cast("string")
    symbols = docs.select(file_path().alias("file"), F.lit(0).alias("ord"), name.alias("name"), F.col("lang").alias("kind"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(False).alias("exported"), F.lit("").alias("signature"), none.alias("doc"), none.alias("parent"), F.lit(None).cast("array<string>").alias("strings"))
    found = cost.measure(texts, search.symbol_docs(symbols, texts.select("path", F.lit(0.0).alias("rank"))), symbols, _ASKED)
    return spark.createDataFrame([(found.naive_chars, found.indexed_chars, found.matched, found.top)], "naive_chars long, indexed_chars long, matched long, top string")


@R.query(f"""WITH d AS (SELECT doc_id, {SQL_PATH} AS file, source, lang FROM documents)
SELECT 'hit' AS what, doc_id AS id, file || ':2-5 ' || CASE WHEN doc_id % 2 = 0 THEN 'Outer.' ELSE '' END || source || ' [' || lang || '] (ad+doc)' || chr(10) || '   def x()' || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '   says' ELSE '' END AS line FROM d
UNION ALL SELECT 'outline', doc_id, '2-5 ' || CASE WHEN doc_id % 5 = 0 THEN 'export ' ELSE '' END || lang || ' ' || CASE WHEN doc_id % 2 = 0 THEN 'Outer.' ELSE '' END || source || ' — def x()' FROM d
UNION ALL SELECT 'reference', doc_id, file || ':2' || CASE WHEN doc_id % 2 = 0 THEN ' (Outer)' ELSE '' END || '  def x()' FROM d
UNION ALL SELECT 'summary', event_id, substr(md5(event_id::VARCHAR), 1, 8) || ' ' || strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%S') || '.000Z [watch] ' || tree FROM {SQL_EVENTS}""")
def rendered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, outlines, references and snapshots as the tools print them."""
    key = F.col("doc_id")
    parent = F.when(key % 2 == 0, "Outer")
    rows = table(spark, sf_dir, "documents").select(
        key.alias("id"), file_path().alias("file"), F.lit(2).alias("start_line"), F.lit(5).alias("end_line"), F.lit(2).alias("line"), F.col("source").alias("name"), F.col("lang").alias("kind"), parent.alias("parent"), parent.alias("symbol"),
        F.lit("def x()").alias("signature"), F.lit("def x()").alias("text"), F.when(key % 3 == 0, "says").alias("doc"), (key % 5 == 0).alias("exported"), F.array(F.lit("ad"), F.lit("doc")).alias("why"),
    )
    snapshots = events(spark, sf_dir).select(F.col("event_id").alias("id"), F.substring(F.md5(F.col("event_id").cast("string")), 1, 8).alias("short"), "ts", F.lit("watch").alias("source"), F.col("tree").alias("label"))
    said = [rows.select(F.lit(what).alias("what"), "id", line.alias("line")) for what, line in (("hit", render.hit()), ("outline", render.outline_row()), ("reference", render.reference()))]
    return said[0].unionAll(said[1]).unionAll(said[2]).unionAll(snapshots.select(F.lit("summary"), "id", render.summary()))


# --- sources and settings


@R.query("SELECT doc_id FROM documents WHERE (lang = 'fr' OR source = 'web1') AND NOT (lang = 'fr' AND source = 'web1')")
def ignore_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths under the patterns of two ignore files; the last that applies decides."""
    patterns = [*FS.ignore_patterns("# by language\n\n  fr \nweb1/\n"), *FS.ignore_patterns("!web1/fr\n")]
    return table(spark, sf_dir, "documents").where(FS.ignored(file_path(), patterns)).select("doc_id")


@R.query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'gen/' ELSE 'src/' END || 'p' || page_id || (['.ts', '.d.ts', '.tsx', '.py', '.pyi', '.txt', '.mjs', '.d.cts'])[page_id % 8 + 1] AS path FROM pages)
SELECT path, (['ts', '', 'tsx', 'py', 'py', '', 'js', ''])[page_id % 8 + 1] AS lang FROM p WHERE page_id % 8 NOT IN (1, 5, 7) AND page_id % 9 <> 0""")
def source_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that hold code: known languages, no declaration files, nothing that a glob ignores."""
    key = F.col("page_id")
    suffix = F.get(F.array(*map(F.lit, (".ts", ".d.ts", ".tsx", ".py", ".pyi", ".txt", ".mjs", ".d.cts"))), (key % 8).cast("int"))
    files = table(spark, sf_dir, "pages").select(F.concat(F.when(key % 9 == 0, "gen/").otherwise("src/"), F.lit("p"), key.cast("string"), suffix).alias("path"))
    return FS.source_files(files, ["gen/**"]).select("path", "lang").orderBy("path")


@R.query("SELECT doc_id FROM documents WHERE doc_id % 5 NOT IN (1, 3)")
def watch_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that a watch heeds: not those below ignored folders; paths outside of the root and null ones stay."""
    key = F.col("doc_id").cast("string")
    path = F.get(F.array(F.concat(F.lit("src/"), key), F.concat(F.lit("a/node_modules/"), key), F.concat(F.lit("../node_modules/"), key), F.concat(F.lit("web/dist/x/"), key), F.lit(None)), (F.col("doc_id") % 5).cast("int"))
    return W.watched(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))).select("doc_id")


@R.query("""WITH g AS (SELECT user_id, event_type, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id AS repo, event_type AS path, epoch_us(max(ts) + INTERVAL 12 HOUR) AS settled_us, count(*) AS writes FROM s GROUP BY user_id, event_type, k""")
def settled_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per file and burst of writes, at the time from which the file stayed as it was."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("repo"), F.col("event_type").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    return W.settled(rows, "12 hours").select("repo", "path", F.unix_micros("ts").alias("settled_us"), "writes")


@R.query("""SELECT * FROM (VALUES ('alias @/', 'web'), ('alias @/never/', 'none'), ('config', 'true 250 1'), ('config of a broken file', 'false 500 11'), ('feature billing', 'pay/**,bill/** fatura'), ('feature login', 'auth/** '), ('features of a broken file', ''),
  ('git', 'main abc123'), ('git detached', 'HEAD def456'), ('git of nothing', 'unknown ')) v(what, said)""")
def workspace_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration, features, aliases and the checked-out commit, written to files and read from them; broken files count as missing."""
    from tessera.api import Workspace

    rows = [(f"alias {a.prefix}", ",".join(a.targets)) for a in parse_aliases(_CONFIG)]
    with tempfile.TemporaryDirectory() as home:  # the settings' files are the driver's own
        at = lambda name: os.path.join(home, name)
        shown = lambda c: f"{str(c.allow_agent_restore).lower()} {c.debounce_ms} {len(c.watch_ignore)}"
        FS.save_config(at("config.json"), FS.Config(allow_agent_restore=True, debounce_ms=250, watch_ignore=["x/**"]))
        rows.append(("config", shown(FS.load_config(at("config.json")))))
        features = FS.add_feature(FS.add_feature(FS.add_feature({}, "login", ["auth/**"]), "billing", ["pay/**"], ["fatura"]), "billing", ["pay/**", "bill/**"])
        FS.save_features(at("features.yml"), FS.remove_feature(FS.add_feature(features, "gone", ["x"]), "gone"))
        rows += [(f"feature {n}", f"{','.join(f['paths'])} {','.join(f['aliases'])}") for n, f in FS.load_features(at("features.yml")).items()]
        for name in ("broken.json", "broken.yml"):
            with open(at(name), "w") as f:
                f.write("{ [")
        rows += [("config of a broken file", shown(FS.load_config(at("broken.json")))), ("features of a broken file", ",".join(FS.load_features(at("broken.yml"))))]
        for what, head in (("git of nothing", None), ("git", "ref: refs/heads/main\n"), ("git detached", "def456\n")):
            if head:
                os.makedirs(at(".git/refs/heads"), exist_ok=True)
                for name, text in (("HEAD", head), ("refs/heads/main", "abc123\n")):
                    with open(at(f".git/{name}"), "w") as f:
                        f.write(text)
            branch, commit = Workspace(spark, home).git_state()
            rows.append((what, f"{branch} {commit or ''}"))
    return spark.createDataFrame(rows, "what string, said string")


# --- history


@R.query(f"""SELECT event_id, substr(regexp_replace('tessera(' || source || '): ' || label, '\\s+', ' ', 'g'), 1, 200) || chr(10) || chr(10) || '{M.MARKER} ' || '{{"v":1,"label":"' || replace(label, chr(9), '\\t') || '","source":"' || source || '",' || CASE WHEN event_id % 3 = 0 THEN '"agent":"a",' ELSE '' END || '"branch":"b"}}' || chr(10) AS message
FROM (SELECT event_id, repeat(event_type || chr(9) || ' ', 1 + event_id % 40) AS label, CASE WHEN event_id % 2 = 0 THEN 'watch' ELSE 'manual' END AS source FROM events)""")
def meta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    none = F.lit(None).cast("string")
    label = F.expr("repeat(concat(event_type, '\t '), cast(1 + event_id % 40 as int))")
    meta = F.struct(F.lit(1).alias("v"), label.alias("label"), F.when(key % 2 == 0, "watch").otherwise("manual").alias("source"), F.when(key % 3 == 0, "a").alias("agent"), none.alias("turn"), F.lit("b").alias("branch"), none.alias("head"))
    return table(spark, sf_dir, "events").select("event_id", meta.alias("m")).select("event_id", M.encode(F.col("m")).alias("message"))


@R.query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_custkey + o_orderkey % 1000 END::BIGINT AS kib FROM orders")
def size_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes in a repository's status text, summed."""
    key = F.col("o_orderkey")
    said = F.concat(F.lit("count: 5\nsize: "), F.col("o_custkey").cast("string"), F.lit("\nin-pack: 7\nsize-pack: "), (key % 1000).cast("string"), F.lit("\nsize-garbage: 9\nmy size: 3\n"))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.status_size_kib(F.when(key % 4 == 0, "nothing").otherwise(said)).alias("kib"))


@R.query("""SELECT 'c' || c_custkey AS path, (['M', 'D', 'A'])[c_custkey % 3 + 1] AS status, CASE c_custkey % 3
WHEN 0 THEN '--- a/c' || c_custkey || chr(10) || '+++ b/c' || c_custkey || chr(10) || '@@ -1,3 +1,3 @@' || chr(10) || ' one' || chr(10) || '-' || c_name || chr(10) || '+' || c_mktsegment || chr(10) || ' three' || chr(10)
WHEN 1 THEN '--- a/c' || c_custkey || chr(10) || '+++ /dev/null' || chr(10) || '@@ -1,3 +0,0 @@' || chr(10) || '-one' || chr(10) || '-' || c_name || chr(10) || '-three' || chr(10)
ELSE '--- /dev/null' || chr(10) || '+++ b/c' || c_custkey || chr(10) || '@@ -0,0 +1,3 @@' || chr(10) || '+one' || chr(10) || '+' || c_mktsegment || chr(10) || '+three' || chr(10) END AS patch FROM customer""")
def diff_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line diffs of changed, deleted and added files."""
    key = F.col("c_custkey")
    text = lambda c: F.concat(F.lit("one\n"), F.col(c), F.lit("\nthree\n"))
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), key.cast("string")).alias("path"), (key % 3).alias("k"), text("c_name").alias("was"), text("c_mktsegment").alias("now"))
    side = lambda tree, column, where: rows.where(where).select(F.lit(tree).alias("tree"), "path", F.sha2(column, 256).alias("blob"), F.col(column).alias("text"))
    both = side("a", "was", "k < 2").unionAll(side("b", "now", "k <> 1"))
    return TL.patch(TL.diff(both, "a", "b"), both.select("blob", "text").dropDuplicates(["blob"]))


@R.query(f"""WITH s AS (SELECT repo, max(seq) AS seq FROM {SQL_EVENTS} GROUP BY repo), b AS (SELECT repo, sum(length(props)) // 1024 AS kib FROM {SQL_EVENTS} GROUP BY repo)
SELECT repo, size_kib, latest_seq FROM (SELECT s.repo, kib::BIGINT AS size_kib, s.seq AS latest_seq FROM s JOIN b USING (repo))""")
def snapshot_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    sizes = rows.select("repo", F.length("props").alias("size"))
    return TL.statistics(rows.withColumn("id", F.col("seq")), sizes).select("repo", "size_kib", F.col("latest").alias("latest_seq"))


@R.query(f"SELECT repo, seq FROM {SQL_EVENTS} WHERE seq = (SELECT min(seq) FROM {SQL_EVENTS})")
def snapshot_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one snapshot whose id begins with a prefix."""
    made = TL.create_snapshots(events(spark, sf_dir))
    prefix = made.agg(F.min_by("id", "seq")).first()[0][:20]
    found = TL.resolve(made, prefix)
    return spark.createDataFrame([(found.repo, found.seq)], "repo long, seq long")


@R.query("""WITH n AS (SELECT count(*) AS total, count(*) FILTER (n_regionkey = 1) AS changed, count(*) FILTER (n_regionkey = 2) AS gone FROM nation)
SELECT 'created' AS what, 1 AS seq, 'one' AS label, total AS n FROM n UNION ALL SELECT 'created', 2, 'three', changed FROM n UNION ALL SELECT 'created', 3, 'four', gone FROM n
UNION ALL SELECT 'tip', 3, 'four', 0 FROM n UNION ALL SELECT 'pruned', 2, 'three', total FROM n UNION ALL SELECT 'pruned', 3, 'four', gone FROM n
UNION ALL SELECT 'removed', 1, '', 2 FROM n UNION ALL SELECT 'cleared', 0, '', 0 FROM n""")
def timeline_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as files: created, changed and deleted by region in a stored timeline, which is then pruned and cleared; n counts files."""
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("path"), F.col("n_name").alias("text"), "n_regionkey")
    store = TimelineStore(spark, f"{shared_dir(spark)}/tessera/timeline-{uuid.uuid4().hex}")
    changed = nations.withColumn("text", F.when(F.col("n_regionkey") == 1, F.upper(F.concat("text", F.lit("!")))).otherwise(F.col("text")))
    for k, (label, files) in enumerate((("one", nations), ("two", nations), ("three", changed), ("four", changed.where("n_regionkey <> 2")))):
        store.create(files.select("path", "text"), label, ts=100 * k)
    counted = lambda what: [(what, r.seq, r.label, r.files) for r in TL.change_counts(store.snapshots, store.entries).collect()]
    rows = counted("created")
    tip = store.tip()
    rows.append(("tip", tip.seq, TL.resolve(store.snapshots, tip.id[:12]).label, 0))
    removed, kept = store.prune(150)
    rows += [*counted("pruned"), ("removed", removed, "", kept)]
    store.clear()
    return spark.createDataFrame([*rows, ("cleared", store.snapshots.count(), "", 0)], "what string, seq int, label string, n long")
