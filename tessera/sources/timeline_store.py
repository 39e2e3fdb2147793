"""The tables behind a timeline: snapshots, tree entries and blobs, appended to.

A blob is a file as it was, byte for byte, with its mode: its name is the digest of the bytes, with a suffix for
executables and for links (whose bytes are their target).  A writer claims the next number before it adds a snapshot,
by a file that must not exist yet, so that of two writers on one tip one fails.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import timeline as TL
from tessera.sources.files import EXECUTABLE, LINK, PLAIN
from tessera.sources.staging import stage

VERSIONS = "repo string, seq long, tree string, ts long, label string, source string, agent string, turn string, branch string, head string"
SNAPSHOTS = f"{VERSIONS}, parent_seq long, parent_tree string, id string, short string, parent string"
ENTRIES = "tree string, path string, blob string"
BLOBS = "blob string, content binary, mode string, size long"
STALE_CLAIM_MS = 600_000  # a writer that claimed a number and wrote no snapshot since is taken for dead


class ConcurrentUpdate(RuntimeError):
    """Another writer moved the tip."""


class TimelineStore:
    def __init__(self, spark: SparkSession, folder: str, repo: str = "repo") -> None:
        self.spark, self.folder, self.repo = spark, folder.rstrip("/"), repo

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def _generation(self) -> str:
        try:
            row = self.spark.read.schema("generation string").json(f"{self.folder}/current").first()
        except AnalysisException:
            row = None
        return row.generation if row else "versions"

    @property
    def snapshots(self) -> DataFrame:
        return self._read(self._generation(), SNAPSHOTS)

    @property
    def entries(self) -> DataFrame:
        return self._read("entries", ENTRIES)

    @property
    def blobs(self) -> DataFrame:
        return self._read("blobs", BLOBS)

    def tip(self):
        """seq, tree and id of the newest snapshot, or None."""
        row = self.snapshots.agg(F.max(F.struct("seq", "tree", "id")).alias("m")).first()
        return row.m if row and row.m else None

    def write_tree(self, files: DataFrame) -> str:
        """Add the blobs and the entries of files(path, content, mode) that are not there yet; returns the tree.

        files(path, text) are plain files in UTF-8.
        """
        content = F.col("content") if "content" in files.columns else F.encode(F.coalesce("text", F.lit("")), "UTF-8")
        mode = F.coalesce("mode", F.lit(PLAIN)) if "mode" in files.columns else F.lit(PLAIN)
        rows = files.select("path", F.coalesce(content, F.lit(b"")).alias("content"), mode.alias("mode"))
        suffix = F.when(F.col("mode") == EXECUTABLE, "-x").when(F.col("mode") == LINK, "-l").otherwise("")
        rows = stage(rows.withColumn("blob", F.concat(F.sha2("content", 256), suffix)), "tree")
        found = TL.tree_hash(rows.select(F.lit(0).alias("k"), "path", "blob"), ["k"]).first()
        tree = found.tree if found else "empty"
        if self.entries.where(F.col("tree") == tree).isEmpty():
            new = rows.select("blob", "content", "mode", F.octet_length("content").cast("long").alias("size")).dropDuplicates(["blob"]).join(self.blobs.select("blob"), "blob", "left_anti")
            stage(new, "blobs").write.mode("append").parquet(f"{self.folder}/blobs")
            rows.select(F.lit(tree).alias("tree"), "path", "blob").write.mode("append").parquet(f"{self.folder}/entries")
        return tree

    def _claim(self, seq: int) -> None:
        """Take the number, or fail if another writer has it."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/claims/{self._generation()}-{seq}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path.getParent())
        if fs.createNewFile(path):
            return
        if fs.exists(path) and time.time() * 1000 - fs.getFileStatus(path).getModificationTime() > STALE_CLAIM_MS and fs.delete(path, False) and fs.createNewFile(path):
            return
        raise ConcurrentUpdate(f"{self.folder}: snapshot {seq} is being written")

    def create(self, files: DataFrame, label: str = "", source: str = "manual", agent: str | None = None, turn: str | None = None, branch: str = "unknown", head: str | None = None, ts: int | None = None):
        """A snapshot of files(path, content, mode) or files(path, text), or None if the tree is the tip's.

        The tip is compared and swapped: ConcurrentUpdate is raised if another writer moves it meanwhile.
        """
        tip = self.tip()
        tree = self.write_tree(files)
        if tip and tip.tree == tree:
            return None
        seq = tip.seq + 1 if tip else 1
        self._claim(seq)
        now = self.tip()
        if (now and now.seq) != (tip and tip.seq):
            raise ConcurrentUpdate(self.folder)
        row = (self.repo, seq, tree, int(time.time()) if ts is None else ts, label, source, agent, turn, branch, head, *((tip.seq, tip.tree, tip.id) if tip else (None, None, None)))
        made = self.spark.createDataFrame([row], f"{VERSIONS}, parent_seq long, parent_tree string, parent string").withColumn("id", TL.snapshot_id()).withColumn("short", F.substring("id", 1, 8))
        one = made.select(*(c.split()[0] for c in SNAPSHOTS.split(", "))).first()
        self.spark.createDataFrame([one], SNAPSHOTS).coalesce(1).write.mode("append").parquet(f"{self.folder}/{self._generation()}")
        return one

    def prune(self, cutoff_s: float, keep_labeled: bool = False) -> tuple[int, int]:
        """(removed, kept); survivors become a new generation, which readers then see as a whole."""
        n, k = self.snapshots.count(), TL.retained(self.snapshots, cutoff_s, keep_labeled).count()
        if k < n:
            self._switch(TL.prune(self.snapshots, cutoff_s, keep_labeled))
        return n - k, k

    def clear(self) -> None:
        self._switch(self.spark.createDataFrame([], SNAPSHOTS))

    def _switch(self, snapshots: DataFrame) -> None:
        name = f"versions-{uuid.uuid4().hex}"
        snapshots.select(*(c.split()[0] for c in SNAPSHOTS.split(", "))).write.parquet(f"{self.folder}/{name}")
        self.spark.createDataFrame([(name,)], "generation string").coalesce(1).write.mode("overwrite").json(f"{self.folder}/current")

    def size_kib(self) -> int:
        return (self.blobs.agg(F.sum("size")).first()[0] or 0) // 1024

    def contents(self, tree: str) -> DataFrame:
        """path, content, mode of a tree."""
        return self.entries.where(F.col("tree") == tree).join(self.blobs.select("blob", "content", "mode"), "blob").select("path", "content", "mode")

    def apply(self, plan: DataFrame, root: str) -> None:
        """Carry out a restore plan in a folder that driver and executors share; what is in the way of a file goes first."""

        def delete(rows: Iterator) -> None:
            for r in rows:
                if os.path.lexists(where := os.path.join(root, r.path)):
                    os.remove(where)

        def write(rows: Iterator) -> None:
            for r in rows:
                put(os.path.join(root, r.path), r.content, r.mode)

        plan = stage(plan, "plan")
        plan.where("action = 'delete'").select("path").foreachPartition(delete)
        plan.where("action = 'write'").join(self.blobs.select("blob", "content", "mode"), "blob").select("path", "content", "mode").foreachPartition(write)


def put(where: str, content: bytes, mode: str) -> None:
    """Write a file or a link; one that a task writes twice is the same file."""
    os.makedirs(os.path.dirname(where) or ".", exist_ok=True)
    if os.path.isdir(where) and not os.path.islink(where):  # folders that deletions have left empty
        for folder, _, _ in os.walk(where, topdown=False):
            os.rmdir(folder)
    new = f"{where}.{uuid.uuid4().hex}.tmp"
    if mode == LINK:
        os.symlink(os.fsdecode(bytes(content)), new)
    else:
        with open(new, "wb") as f:
            f.write(content)
        os.chmod(new, 0o755 if mode == EXECUTABLE else 0o644)
    os.replace(new, where)
