"""Timeline queries: events and orders as versions, lineitem as tree entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import bisect as B
from tessera.operators import timeline as TL
from tessera.plans.binding import SQL_ENTRIES, SQL_EVENTS, Registry, customer_versions, events, table, tree_entries

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_KEPT = f"(SELECT *, CASE WHEN event_id % 5 = 0 THEN 'manual' ELSE 'watch' END AS source FROM (SELECT *, lag(tree) OVER w AS was FROM {SQL_EVENTS} WINDOW w AS (PARTITION BY repo ORDER BY seq)) WHERE was IS NULL OR was <> tree)"
CUTOFF = 1_705_500_000
THRESHOLD = 60.0


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = TL.changed_only(events(spark, sf_dir))
    return rows.withColumn("source", F.when(F.col("event_id") % 5 == 0, "manual").otherwise("watch"))


@R.query(f"SELECT repo, event_id, tree FROM {_KEPT}")
def snapshot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).select("repo", "event_id", "tree")


@R.query(f"SELECT event_id, source FROM (SELECT * FROM {_KEPT} WHERE ts >= {CUTOFF} ORDER BY seq DESC LIMIT 200) WHERE source = 'manual'")
def snapshot_log_limit_then_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is applied before the source filter."""
    return TL.log(_versions(spark, sf_dir), 200, CUTOFF * 1000, "manual").select("event_id", "source")


@R.query(f"SELECT repo, seq, lag(seq) OVER (PARTITION BY repo ORDER BY seq) AS parent_seq, lag(tree) OVER (PARTITION BY repo ORDER BY seq) AS parent_tree, row_number() OVER (PARTITION BY repo ORDER BY seq) > 1 AS linked FROM {_KEPT} WHERE ts >= {CUTOFF} OR source = 'manual'")
def prune_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors of pruning, each linked to the survivor before it, by number and by id."""
    rows = events(spark, sf_dir).withColumn("source", F.when(F.col("event_id") % 5 == 0, "manual").otherwise("watch"))
    kept = TL.prune(TL.create_snapshots(rows), CUTOFF, keep_labeled=True)
    named = kept.select("repo", F.col("id").alias("parent"), F.col("seq").alias("of"))
    return kept.join(named, ["repo", "parent"], "left").select("repo", "seq", "parent_seq", "parent_tree", (F.col("of").isNotNull() & (F.col("of") == F.col("parent_seq"))).alias("linked"))


@R.query(f"SELECT repo, count(*) AS snapshots, arg_max(event_id, seq) AS latest, arg_max(ts, seq) AS latest_ts FROM {_KEPT} GROUP BY repo")
def snapshot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TL.statistics(_versions(spark, sf_dir).withColumn("id", F.col("event_id")))


@R.query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts) + INTERVAL 6 HOUR) AS fires_us, count(*) AS n FROM s GROUP BY user_id, k""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = TL.sessions(rows, "user_id", "ts", "6 hours")
    return found.select("user_id", F.unix_micros("first").alias("first_us"), F.unix_micros("fires").alias("fires_us"), "n")


_STEPS = "(SELECT o_orderkey::VARCHAR AS tree, lag(o_orderkey::VARCHAR) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent FROM orders)"
_CHANGES = f"""e AS MATERIALIZED {SQL_ENTRIES}, s AS MATERIALIZED {_STEPS},
n AS (SELECT s.tree AS id, path, blob FROM s JOIN e USING (tree)), o AS (SELECT s.tree AS id, path, blob FROM s JOIN e ON e.tree = s.parent),
c AS (SELECT coalesce(n.id, o.id) AS id, coalesce(n.path, o.path) AS path, CASE WHEN o.blob IS NULL THEN 'A' WHEN n.blob IS NULL THEN 'D' WHEN n.blob <> o.blob THEN 'M' END AS status FROM n FULL JOIN o ON n.id = o.id AND n.path = o.path)"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = TL.with_previous(customer_versions(spark, sf_dir), "repo", ["seq"], ["tree"])
    return linked.select(F.col("tree").alias("id"), "tree", F.col("prev.tree").alias("parent_tree"))


@R.query(f"WITH {_CHANGES} SELECT id, path, status FROM c WHERE status IS NOT NULL")
def tree_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files of every version against its parent."""
    return TL.changed_files(_steps(spark, sf_dir), tree_entries(spark, sf_dir)).select("id", "path", "status")


@R.query(f"WITH {_CHANGES}, k AS (SELECT id, count(*) AS files FROM c WHERE status IS NOT NULL GROUP BY id) SELECT s.tree AS id, coalesce(files, 0) AS files FROM s LEFT JOIN k ON k.id = s.tree")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TL.change_counts(_steps(spark, sf_dir), tree_entries(spark, sf_dir)).select("id", "files")


def _pair(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    row = table(spark, sf_dir, "lineitem").agg(F.min("l_orderkey").alias("a"), F.max("l_orderkey").alias("b")).first()
    return str(row.a), str(row.b)


_PAIR = f"e AS MATERIALIZED {SQL_ENTRIES}, k AS (SELECT min(l_orderkey)::VARCHAR AS a, max(l_orderkey)::VARCHAR AS b FROM lineitem), o AS (SELECT e.* FROM e, k WHERE tree = a), n AS (SELECT e.* FROM e, k WHERE tree = b)"


@R.query(f"WITH {_PAIR}, d AS (SELECT CASE WHEN o.blob IS NULL THEN 'A' WHEN n.blob IS NULL THEN 'D' WHEN n.blob <> o.blob THEN 'M' END AS status FROM n FULL JOIN o USING (path)) SELECT status, count(*) AS files FROM d WHERE status IS NOT NULL GROUP BY status")
def tree_diff_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TL.diff_stat(TL.diff(tree_entries(spark, sf_dir), *_pair(spark, sf_dir)))


@R.query(f"WITH {_PAIR} SELECT path, CASE WHEN n.blob IS NULL THEN 'delete' ELSE 'write' END AS action, n.blob AS blob FROM n FULL JOIN o USING (path) WHERE n.blob IS DISTINCT FROM o.blob")
def restore_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TL.restore_plan(tree_entries(spark, sf_dir), *_pair(spark, sf_dir))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("repo", "seq", "value", (F.col("value") < THRESHOLD).alias("good"))


_CHAIN = f"(SELECT repo, seq, value < {THRESHOLD} AS good, row_number() OVER (PARTITION BY repo ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY repo) AS n FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq DESC) AS back FROM {SQL_EVENTS}) WHERE back <= {B.LIMIT})"


@R.query(f"""WITH RECURSIVE c AS MATERIALIZED {_CHAIN},
e AS (SELECT repo, any_value(n) AS n, bool_or(good) FILTER (i = n - 1) AS newest, bool_or(good) FILTER (i = 0) AS oldest FROM c GROUP BY repo),
b AS (SELECT repo, 0::BIGINT AS lo, (n - 1)::BIGINT AS hi, 2 AS tested FROM e WHERE n >= 2 AND NOT newest AND oldest
      UNION ALL SELECT b.repo, CASE WHEN c.good THEN c.i ELSE lo END, CASE WHEN c.good THEN hi ELSE c.i END, tested + 1 FROM b JOIN c ON c.repo = b.repo AND c.i = (lo + hi) // 2 WHERE hi - lo > 1),
f AS (SELECT * FROM b WHERE hi - lo = 1)
SELECT e.repo, CASE WHEN e.n < 2 OR newest THEN NULL WHEN NOT oldest THEN (SELECT seq FROM c WHERE c.repo = e.repo AND i = 0) ELSE (SELECT seq FROM c WHERE c.repo = e.repo AND i = hi) END AS first_bad,
CASE WHEN e.n < 2 THEN NULL WHEN newest THEN (SELECT seq FROM c WHERE c.repo = e.repo AND i = e.n - 1) WHEN NOT oldest THEN NULL ELSE (SELECT seq FROM c WHERE c.repo = e.repo AND i = lo) END AS last_good,
CASE WHEN e.n < 2 THEN 0 WHEN newest THEN 1 WHEN NOT oldest THEN 2 ELSE tested END AS tested, e.n::INTEGER AS candidates FROM e LEFT JOIN f USING (repo)""")
def bisect_nonmonotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boundary that a binary search meets, per user, on verdicts that go back and forth."""
    return B.bisect_verdicts(_verdicts(spark, sf_dir))


@R.query(f"""WITH c AS {_CHAIN}, m AS (SELECT *, bool_and(good) OVER (PARTITION BY repo ORDER BY seq) AS ok FROM c)
SELECT repo, min(seq) FILTER (NOT ok) AS first_bad FROM m GROUP BY repo""")
def bisect_first_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On verdicts that stay bad once they are, the first bad version (null if there is none, or one version only)."""
    from pyspark.sql import Window

    back = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("seq")))
    chain = _verdicts(spark, sf_dir).withColumn("back", back).where(F.col("back") <= B.LIMIT)
    monotone = chain.withColumn("good", F.every("good").over(Window.partitionBy("repo").orderBy("seq")))
    found = B.bisect_verdicts(monotone)
    alone = monotone.groupBy("repo").agg(F.min(F.when(~F.col("good"), F.col("seq"))).alias("only"))
    return found.join(alone, "repo").select("repo", F.when(F.col("candidates") < 2, F.col("only")).otherwise(F.col("first_bad")).alias("first_bad"))
