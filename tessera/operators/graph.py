"""Import graph: distinct edges, degrees and PageRank with a fixed number of iterations."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.staging import ship, stage

DAMPING, ITERATIONS = 0.85, 20
DRIVER_BYTES = 32 << 20  # of the driver's arrays: 16 bytes for an edge, 24 for a node
BLOCK, PACKED, HELD = 1 << 16, 1 << 17, 64  # nodes of an array, edges of a packed row, arrays that a task adds up
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
BROADCAST_BYTES = 64 << 20  # of ranks, 8 bytes for a node; beyond, they meet the edges by shuffle


def simple_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) between known, different nodes."""
    known = edges.where("src <> dst").distinct()
    for end in ("src", "dst"):
        known = known.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return known


def out_degree(edges: DataFrame) -> DataFrame:
    """node, out_deg: distinct targets other than the node itself."""
    return edges.where("src <> dst").groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("out_deg"))


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING, driver_bytes: int = DRIVER_BYTES) -> DataFrame:
    """(id, rank) after exactly `iterations` rounds from 1/n; dangling rank is spread evenly.

    The simplified graph is counted.  While the arrays of its numbered nodes and edges stay within driver_bytes, the
    rounds are sparse array sums on the driver, since a job per round costs more than the round; ids never leave the
    cluster.  Beyond that each round is staged on the cluster.
    """
    nodes = stage(nodes.select("id").where("id is not null").distinct(), "nodes")
    links = stage(simple_edges(nodes, edges), "edges")
    n, m = nodes.count(), links.count()
    if n == 0:
        return nodes.withColumn("rank", F.lit(0.0))
    return _small(nodes, links, n, iterations, damping) if 24 * n + 16 * m <= driver_bytes else _large(nodes, links, n, iterations, damping)


def _numbered(nodes: DataFrame) -> DataFrame:
    """id and its place from 0 to n - 1, in no order: the rows of a partition come after those of the partitions before."""
    placed = stage(nodes.select("id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("k")), "placed")
    counts, start = sorted((r.p, r.n) for r in placed.groupBy("p").agg(F.count("*").alias("n")).collect()), {}
    total = 0
    for p, size in counts:
        start[p], total = total, total + size
    first = F.create_map(*(F.lit(v) for pair in start.items() for v in pair))
    return placed.select("id", (first[F.col("p")] + F.col("k")).alias("at"))


def _small(nodes: DataFrame, links: DataFrame, n: int, iterations: int, damping: float) -> DataFrame:
    places = stage(_numbered(nodes), "places")
    pairs = links.join(places.select(F.col("id").alias("src"), F.col("at").alias("a")), "src").join(places.select(F.col("id").alias("dst"), F.col("at").alias("b")), "dst").select("a", "b").toArrow()
    src, dst = (pairs.column(c).to_numpy() for c in ("a", "b"))
    out = np.bincount(src, minlength=n)
    rank = np.full(n, 1.0 / n)
    for _ in range(iterations):
        share = np.bincount(dst, weights=(rank / np.maximum(out, 1))[src], minlength=n)
        rank = (1 - damping) / n + damping * (share + rank[out == 0].sum() / n)
    ranks = nodes.sparkSession.createDataFrame(pa.table({"at": pa.array(np.arange(n)), "rank": pa.array(rank)}))
    return places.join(F.broadcast(ranks), "at").select("id", "rank")  # 16 bytes a row, bounded by driver_bytes


def _large(nodes: DataFrame, links: DataFrame, n: int, iterations: int, damping: float) -> DataFrame:
    """Rounds over numbered nodes: ranks are arrays of BLOCK nodes, edges are packed once by the block of their source.

    A row of edges holds what its sources give as places in that block, sorted by target, so that a round is a gather
    and a sum by target.  A task adds up what it gives to a block before that is shuffled.
    """
    spark = nodes.sparkSession
    ship(spark)
    if int(re.sub(r"\D", "", spark.conf.get(BATCH_KEY))) > BATCH_BYTES:  # a row is some 2 MB
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    places = stage(_numbered(nodes), "places")
    pairs = links.join(places.select(F.col("id").alias("src"), F.col("at").alias("a")), "src").join(places.select(F.col("id").alias("dst"), F.col("at").alias("b")), "dst")
    pairs = pairs.select(F.floor(F.col("a") / BLOCK).cast("long").alias("block"), (F.col("a") % BLOCK).cast("int").alias("a"), "b")
    dealt = pairs.repartitionByRange("block", F.xxhash64("a", "b")).sortWithinPartitions("block")
    packed = stage(dealt.mapInArrow(lambda rows: _pack(rows, PACKED), "block long, a binary, b binary, first binary"), "packed")
    degrees = packed.mapInArrow(lambda rows: _degrees(rows, BLOCK, HELD), "block long, places binary, amounts binary")
    sizes = spark.range(-(-n // BLOCK)).select(F.col("id").alias("block"), F.least(F.lit(BLOCK), F.lit(n) - F.col("id") * BLOCK).cast("int").alias("size"))
    state = stage(_added(sizes.select("block", "size", F.lit(None).cast("binary").alias("out")), degrees, lambda size, out, total: (total, np.full(size, 1.0 / n))), "ranks")
    for _ in range(iterations):
        loose = state.agg(F.sum("loose")).first()[0]
        gifts = state.select("block", "gift")
        gifts = F.broadcast(gifts) if 8 * n <= BROADCAST_BYTES else gifts
        given = packed.join(gifts, "block").select("a", "b", "first", "gift").mapInArrow(lambda rows: _give(rows, BLOCK, HELD), "block long, places binary, amounts binary")

        def fold(size: int, out: np.ndarray, total: np.ndarray, loose: float = loose) -> tuple[np.ndarray, np.ndarray]:
            return out, (1 - damping) / n + damping * (total + loose / n)

        state = stage(_added(state.select("block", "size", "out"), given, fold), "ranks")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rank in zip(batch.column(0).to_pylist(), batch.column(1)):
                ranks = np.frombuffer(rank.as_buffer(), np.float64)
                yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(ranks)) + block * BLOCK), "rank": pa.array(ranks)})

    ranks = state.select("block", "rank").mapInArrow(unpack, "at long, rank double")
    return places.join(ranks, "at").select("id", "rank")


def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, a, b, first) of at most `most` edges: places of the sources by target, the targets, where each begins."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    block, count = None, 0

    def row() -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(b, kind="stable")
        targets, first = np.unique(b[order], return_index=True)
        return _row(block, a[order].astype(np.int32), targets, first.astype(np.int32), names=("block", "a", "b", "first"))

    for batch in batches:
        blocks, a, b = (batch.column(i).to_numpy() for i in range(3))
        for i, j in _runs(blocks):
            for k in range(i, j, most):
                some = slice(k, min(j, k + most))
                size = some.stop - some.start
                if held and (blocks[i] != block or count + size > most):
                    yield row()
                    held, count = [], 0
                block = int(blocks[i])
                held.append((a[some], b[some]))
                count += size
    if held:
        yield row()


def _runs(blocks: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal numbers begins and ends."""
    if not len(blocks):
        return []
    edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
    return list(zip(edges[:-1], edges[1:]))


def _row(block: int, *arrays: np.ndarray, names: tuple[str, ...] = ("block", "places", "amounts")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], list(names))


def _give(batches: Iterator[pa.RecordBatch], size: int, most: int) -> Iterator[pa.RecordBatch]:
    """What the rows (a, b, first, gift) give to each block of targets."""

    def rows() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for a, b, first, gift in zip(*(batch.column(i) for i in range(4))):
                sums = np.add.reduceat(np.frombuffer(gift.as_buffer(), np.float64)[np.frombuffer(a.as_buffer(), np.int32)], np.frombuffer(first.as_buffer(), np.int32))
                yield np.frombuffer(b.as_buffer(), np.int64), sums

    return _by_block(rows(), size, most)


def _degrees(batches: Iterator[pa.RecordBatch], size: int, most: int) -> Iterator[pa.RecordBatch]:
    """How many edges leave each node."""

    def rows() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for block, a in zip(batch.column(0).to_pylist(), batch.column(1)):
                at, times = np.unique(np.frombuffer(a.as_buffer(), np.int32), return_counts=True)
                yield at + np.int64(block) * size, times.astype(np.float64)

    return _by_block(rows(), size, most)


def _by_block(rows: Iterator[tuple[np.ndarray, np.ndarray]], size: int, most: int) -> Iterator[pa.RecordBatch]:
    """Amounts for sorted nodes, added up by block in `most` arrays at most; those with few nodes go on as they are."""
    held: dict[int, np.ndarray] = {}
    for nodes, amounts in rows:
        blocks = nodes // size
        for i, j in _runs(blocks):
            block, places = int(blocks[i]), (nodes[i:j] % size).astype(np.int32)
            if block not in held and (len(held) >= most or j - i < size // 64):
                yield _row(block, places, amounts[i:j])
                continue
            held.setdefault(block, np.zeros(size))[places] += amounts[i:j]
    for block, total in held.items():
        places = np.flatnonzero(total)
        yield _row(block, places.astype(np.int32), total[places])


def _added(state: DataFrame, given: DataFrame, fold: Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The next state of each block: its row of `state` and all that is given to it stream through one task, one after the other."""
    nothing = F.lit(None).cast("binary")
    both = state.select("block", "size", "out", nothing.alias("places"), nothing.alias("amounts")).unionByName(given.withColumns({"size": F.lit(None).cast("int"), "out": nothing}))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, out, total = None, 0, None, np.zeros(0)

        def row() -> pa.RecordBatch:
            degree, rank = fold(size, out, total[:size])
            loose = float(rank[degree == 0].sum())
            gift = np.where(degree > 0, rank / np.maximum(degree, 1), 0.0)
            values = [pa.array([now], pa.int64()), pa.array([size], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (degree, rank, gift)), pa.array([loose])]
            return pa.RecordBatch.from_arrays(values, ["block", "size", "out", "rank", "gift", "loose"])

        for batch in batches:
            for block, its_size, its_out, places, amounts in zip(*(batch.column(i) for i in range(5))):
                if block.as_py() != now:
                    if now is not None:
                        yield row()
                    now, size, out, total = block.as_py(), 0, None, np.zeros(BLOCK)
                if its_size.is_valid:
                    size = its_size.as_py()
                    out = np.frombuffer(its_out.as_buffer(), np.float64) if its_out.is_valid else None
                else:
                    total[np.frombuffer(places.as_buffer(), np.int32)] += np.frombuffer(amounts.as_buffer(), np.float64)
        if now is not None:
            yield row()

    return both.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block long, size int, out binary, rank binary, gift binary, loose double")
