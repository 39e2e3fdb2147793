"""A watch over change events (repo, path, op, ts): filter, settle, debounce, then one version per burst.

Bursts are session windows in event time; a watermark closes them.  Versions are kept if they differ from the last
one of their repo, by a stateful operator or, with a snapshot table as the sink, inside foreachBatch.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.functions import text as T
from tessera.sources.files import WATCH_IGNORE
from tessera.sources.staging import ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def watched(events: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """Events of paths inside the root (relative, not the root itself) that no glob ignores; null paths are kept."""
    globs = WATCH_IGNORE if ignore is None else ignore
    path = F.col("path")
    inside = ~path.startswith("../") & (path != "")
    # paths outside are heeded, as those that the watch was asked for besides the root
    return events.where(path.isNull() | ~inside | ~T.matches_any(path, globs))


def settled(events: DataFrame, stable: str = "150 milliseconds") -> DataFrame:
    """One event per file and write burst, at the time from which the file stayed as it is."""
    return events.groupBy("repo", "path", F.session_window("ts", stable).alias("w")).agg(F.count("*").alias("writes")).select("repo", "path", F.col("w.end").alias("ts"), "writes")


def debounced(events: DataFrame, quiet: str = "500 milliseconds", watermark: str | None = "10 seconds") -> DataFrame:
    """repo, first, fires, n: bursts that end with a quiet time; there is no longest wait.

    Ticks only move the watermark: the test names ts, else it would be pushed below.
    """
    rows = events.withWatermark("ts", watermark) if watermark else events
    if "op" in events.columns:
        rows = rows.where(~((F.col("op") == "tick") & F.col("ts").isNotNull()))
    return rows.groupBy("repo", F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("n")).select("repo", F.col("w.start").alias("first"), F.col("w.end").alias("fires"), "n", F.lit("watch").alias("source"))


class _Changed(StatefulProcessor):
    """Keeps the last tree of a repo; passes on versions whose tree differs, in order of seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "tree string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        frame = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        for r in frame.itertuples(index=False):
            if r.tree != last:
                kept.append((r.repo, r.seq, r.tree))
                last = r.tree
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(kept, columns=["repo", "seq", "tree"])

    def close(self) -> None:
        pass


def changed_versions(versions: DataFrame) -> DataFrame:
    """A stream of versions(repo, seq, tree) without those equal to the one before; needs the RocksDB state store."""
    ship(versions.sparkSession)
    key = versions.schema["repo"].dataType.simpleString()
    return versions.select("repo", "seq", "tree").groupBy("repo").transformWithStateInPandas(_Changed(), outputStructType=f"repo {key}, seq long, tree string", outputMode="Append", timeMode="None")


def watch(bursts: DataFrame, flush: Callable[[DataFrame, int], bool], checkpoint: str, on_flush: Callable[[int], None] | None = None, on_error: Callable[[Exception], None] | None = None, trigger: dict | None = None, each: Callable[[], None] | None = None) -> StreamingQuery:
    """Run flush(bursts of the batch, batch id) for every batch with a burst; on_flush follows where it wrote a version.

    each() runs at every batch, with or without a burst.  Batches run one after the other, so events that come during a flush make exactly one more.  An error goes to
    on_error (or the log) and the stream goes on.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        try:
            if each:
                each()
            if not batch.isEmpty() and flush(batch, batch_id) and on_flush:
                on_flush(batch_id)
        except Exception as e:  # the stream outlives one failed flush
            if on_error:
                on_error(e)
            else:
                logging.getLogger(__name__).warning("flush %s failed: %s", batch_id, e)

    return bursts.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
