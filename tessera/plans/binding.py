"""Views of the driver's tables as the data model of the operators, and the registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_path() -> F.Column:
    """A document as a source file: source/lang/doc_id.txt."""
    return F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))


SQL_PATH = "concat_ws('/', source, lang, doc_id::VARCHAR)"
SQL_TERMS = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(coalesce({c}, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda x: lower(x)), lambda x: length(x) > 1 OR strlen(x) > 3)"


def sql_terms(column: str) -> str:
    return SQL_TERMS.format(c=column)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as versions: repo is the user, the tree the event type, the order that of (ts, event_id)."""
    rows = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return rows.select(F.col("user_id").alias("repo"), (micros * 1000 + F.pmod("event_id", F.lit(1000))).alias("seq"), F.col("event_type").alias("tree"), F.floor(micros / 1_000_000).alias("ts"), "event_id", "value", "props", F.col("ts").cast("timestamp").alias("at"))


SQL_EVENTS = "(SELECT user_id AS repo, epoch_us(ts) * 1000 + event_id % 1000 AS seq, event_type AS tree, floor(epoch_us(ts) / 1000000)::BIGINT AS ts, event_id, value, props, ts AS at FROM events)"


def tree_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as tree entries: the order is the tree, the line number the path, the greatest part key the blob."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("blob"))
    return rows.select(F.col("l_orderkey").cast("string").alias("tree"), F.format_string("f%s", F.col("l_linenumber").cast("string")).alias("path"), F.col("blob").cast("string").alias("blob"))


SQL_ENTRIES = "(SELECT l_orderkey::VARCHAR AS tree, 'f' || l_linenumber::VARCHAR AS path, max(l_partkey)::VARCHAR AS blob FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def customer_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as versions: repo is the customer, the order key both the order in time and the tree."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("repo"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("tree"))
