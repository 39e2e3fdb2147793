"""A timeline of content-addressed tree versions: create, list, compare, plan restores, prune, count.

versions:  repo, seq, tree, ts (epoch seconds), label, source, agent, turn, branch, head
snapshots: versions with id, short, parent (an id), parent_seq, parent_tree
entries:   tree, path, blob
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.ordered import with_previous

META = ["label", "source", "agent", "turn", "branch", "head"]
LOG_LIMIT = 30


class SnapshotNotFound(LookupError):
    """No snapshot, or more than one, has the prefix."""


TREE_PARTS = 1024


def tree_hash(files: DataFrame, key: list[str]) -> DataFrame:
    """files(*key, path, blob) to (*key, tree): the digest of the digests of TREE_PARTS parts of the sorted (path, blob) pairs.

    Parts are by a hash of the path, so that a row holds a thousandth of a tree at most and a tree's final row is bounded.
    """
    part = F.pmod(F.crc32("path"), F.lit(TREE_PARTS)).cast("int")
    listed = F.sort_array(F.collect_list(F.struct("path", "blob")))
    parts = files.withColumn("_part", part).groupBy(*key, "_part").agg(F.sha2(F.to_json(listed), 256).alias("digest"))
    return parts.groupBy(*key).agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("_part", "digest")))), 256).alias("tree"))


def snapshot_id(parent_seq: Column | str = "parent_seq") -> Column:
    parent = F.col(parent_seq) if isinstance(parent_seq, str) else parent_seq
    return F.sha2(F.to_json(F.struct("repo", "seq", parent.alias("parent_seq"), "tree", "ts", *META)), 256)


def _linked(versions: DataFrame) -> DataFrame:
    """Give every version its predecessor."""
    rows = with_previous(versions, "repo", ["seq"], ["seq", "tree"])
    rows = rows.withColumns({"parent_seq": F.col("prev.seq"), "parent_tree": F.col("prev.tree")}).drop("prev")
    rows = rows.withColumn("id", snapshot_id()).withColumn("short", F.substring("id", 1, 8))
    rows = with_previous(rows, "repo", ["seq"], ["id"])
    return rows.withColumn("parent", F.col("prev.id")).drop("prev")


def changed_only(versions: DataFrame, key: str = "repo", order: str = "seq", state: str = "tree") -> DataFrame:
    """The versions whose state differs from the one before; the first of a key always stays."""
    rows = with_previous(versions, key, [order], [state])
    return rows.where(F.col("prev").isNull() | ~F.col(f"prev.{state}").eqNullSafe(F.col(state))).drop("prev")


def create_snapshots(versions: DataFrame) -> DataFrame:
    """Snapshots of a version history: unchanged trees make none; missing labels are empty, sources manual, branches unknown."""
    for c in META:
        if c not in versions.columns:
            versions = versions.withColumn(c, F.lit(None).cast("string"))
    filled = versions.withColumns({"label": F.coalesce("label", F.lit("")), "source": F.coalesce("source", F.lit("manual")), "branch": F.coalesce("branch", F.lit("unknown"))})
    return _linked(changed_only(filled))


def log(snapshots: DataFrame, limit: int | None = LOG_LIMIT, since_ms: float | None = None, source: str | None = None, file: str | None = None, entries: DataFrame | None = None) -> DataFrame:
    """Newest first.  The limit applies before the source filter, and after those by time and file."""
    rows = snapshots
    if since_ms is not None:
        rows = rows.where(F.col("ts") >= int(since_ms // 1000))
    if file is not None:
        rows = rows.join(changed_files(snapshots, entries.where(F.col("path") == file)).select("id"), "id", "left_semi")
    rows = rows.orderBy(F.desc("seq"), "repo")
    rows = rows.limit(limit) if limit else rows
    return rows.where(F.col("source") == source).orderBy(F.desc("seq"), "repo") if source else rows


def resolve(snapshots: DataFrame, prefix: str):
    """The one snapshot whose id starts with the prefix."""
    found = snapshots.where(F.col("id").startswith(prefix)).limit(2).collect() if prefix else []
    if len(found) != 1:
        raise SnapshotNotFound(f"{'no' if not found else 'more than one'} snapshot {prefix!r}")
    return found[0]


def _status(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows(*key, path, old, new), each with one of old and new, to one row per changed path.

    One aggregation with map-side combination takes the place of a full outer join.
    """
    both = rows.groupBy(*key, "path").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    status = F.when(F.col("old").isNull(), "A").when(F.col("new").isNull(), "D").otherwise("M")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).withColumn("status", status)


def changed_files(snapshots: DataFrame, entries: DataFrame) -> DataFrame:
    """id, path, old, new, status (A, D, M) of each snapshot against its parent; a first snapshot adds all its files."""
    none = F.lit(None).cast("string")
    new = snapshots.select("id", "tree").join(entries, "tree").select("id", "path", none.alias("old"), F.col("blob").alias("new"))
    old = snapshots.where("parent_tree is not null").select("id", F.col("parent_tree").alias("tree")).join(entries, "tree").select("id", "path", F.col("blob").alias("old"), none.alias("new"))
    return _status(new.unionAll(old), ["id"])


def change_counts(snapshots: DataFrame, entries: DataFrame) -> DataFrame:
    """Every snapshot's number of changed files, by one join."""
    counts = changed_files(snapshots, entries).groupBy("id").agg(F.count("*").alias("files"))
    return snapshots.join(counts, "id", "left").withColumn("files", F.coalesce("files", F.lit(0)))


def diff(entries: DataFrame, from_tree: str, to_tree: str, paths: list[str] | None = None) -> DataFrame:
    """path, old, new, status between two trees.  A path names itself and everything below it; globs work too."""
    rows = entries.where(F.col("tree").isin(from_tree, to_tree))
    if paths:
        below = F.lit(False)
        for p in paths:
            below = below | (F.col("path") == p.rstrip("/")) | F.col("path").startswith(p.rstrip("/") + "/")
        rows = rows.where(below | T.matches_any(F.col("path"), paths))
    side = lambda t: F.when(F.col("tree") == t, F.col("blob"))
    return _status(rows.select("path", side(from_tree).alias("old"), side(to_tree).alias("new")), [])


def renames(changes: DataFrame) -> DataFrame:
    """Deleted and added paths with one content, paired in order of their paths: old_path, new_path, blob."""
    from pyspark.sql import Window

    side = lambda status, blob, name: changes.where(F.col("status") == status).select(F.col(blob).alias("blob"), F.col("path").alias(name)).withColumn("nth", F.row_number().over(Window.partitionBy("blob").orderBy(name)))
    return side("D", "old", "old_path").join(side("A", "new", "new_path"), ["blob", "nth"]).drop("nth")


def diff_stat(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count("*").alias("files"))


def restore_plan(entries: DataFrame, current_tree: str, target_tree: str, files: list[str] | None = None) -> DataFrame:
    """What to do to get from the current tree to the target: path, action (write or delete), blob."""
    changes = diff(entries, current_tree, target_tree, files)
    return changes.select("path", F.when(F.col("new").isNull(), "delete").otherwise("write").alias("action"), F.col("new").alias("blob"))


def retained(snapshots: DataFrame, cutoff_s: float, keep_labeled: bool = False) -> DataFrame:
    """Not older than the cutoff; with keep_labeled, every manual one too."""
    keep = F.col("ts") >= cutoff_s
    return snapshots.where(keep | (F.col("source") == "manual") if keep_labeled else keep)


def prune(snapshots: DataFrame, cutoff_s: float, keep_labeled: bool = False) -> DataFrame:
    """The retained snapshots, linked anew: one whose parent went gets another parent and another id."""
    kept = retained(snapshots, cutoff_s, keep_labeled).drop("id", "short", "parent", "parent_seq", "parent_tree")
    return _linked(kept)


def statistics(snapshots: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """Per repo: snapshots, latest id and its time; with blobs(repo, size) the KiB they take."""
    out = snapshots.groupBy("repo").agg(F.count("*").alias("snapshots"), F.max_by("id", "seq").alias("latest"), F.max_by("ts", "seq").alias("latest_ts"))
    if blobs is not None:
        sizes = blobs.groupBy("repo").agg((F.sum("size") / 1024).cast("long").alias("size_kib"))
        out = out.join(sizes, "repo", "left")
    return out


def sessions(events: DataFrame, key: str, ts: str, quiet: str) -> DataFrame:
    """Bursts of events of a key that are at most `quiet` apart: key, first, fires (the quiet time after the last), n."""
    w = F.session_window(ts, quiet)
    return events.groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("first"), F.col("w.end").alias("fires"), "n")


def patch(changes: DataFrame, blobs: DataFrame, context: int = 3) -> DataFrame:
    """Line diffs of changed paths: path, status, patch.  Only the blobs of changed paths are read.

    blobs: blob, content (bytes) or text.  Of bytes with a zero among them only the fact is told.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    content = F.col("content") if "content" in blobs.columns else F.encode("text", "UTF-8")
    side = lambda name: blobs.select(F.col("blob").alias(name), content.alias(f"{name}_content"))
    rows = changes.join(side("old"), "old", "left").join(side("new"), "new", "left").select("path", "status", "old_content", "new_content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import difflib

        for batch in batches:
            out = []
            for p, s, a, b in zip(*(batch.column(k).to_pylist() for k in range(4))):
                a, b = a or b"", b or b""
                ends = ("/dev/null" if s == "A" else f"a/{p}", "/dev/null" if s == "D" else f"b/{p}")
                if b"\0" in a or b"\0" in b:
                    out.append(f"Binary files {ends[0]} and {ends[1]} differ\n")
                    continue
                lines = (x.decode("utf-8", "replace").splitlines(True) for x in (a, b))
                out.append("".join(line if line.endswith("\n") else line + "\n\\ No newline at end of file\n" for line in difflib.unified_diff(*lines, *ends, n=context)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["path", "status", "patch"])

    return rows.mapInArrow(run, "path string, status string, patch string")
