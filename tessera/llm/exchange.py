"""A distributed yes/no exchange between chunks of text and partitions of a hash space.

Chunks (whole documents, compressed) are written once, bucketed by the task that made them.  A round sends, for every
chunk and hash partition, one packed message with the chunk's distinct keys; the partition answers with one packed
message for that chunk.  Copies inside a chunk collapse before the shuffle, so that a key that a third of all documents
hold sends one entry per chunk and not one per document.  Answers are grouped by chunk and meet it in its bucket, so
that the texts themselves are never shuffled and no row grows with a bucket.

Sizes follow the input.  There are as many buckets as make BUCKET_BYTES each.  The number of messages is that of
chunks times that of partitions, the square of the input over both sizes; so from 128 GB on chunks grow to 64 MB, and
from 32 GB on partitions to 256 MB of text each.  At 100 TB that is five keys in a message; beyond, an exchange costs
what a shuffle of single keys would.  Both kinds of keys are dealt so that every task gets the same number of groups.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.staging import discard, fresh_path, small_batches, stage

CHUNK_BYTES, CHUNKS = (2 << 20, 64 << 20), 1 << 16  # least and most bytes of a chunk; as many chunks before they grow
PART_BYTES, PARTS = (8 << 20, 256 << 20), 1 << 12
BUCKET_BYTES, MAX_BUCKETS = 256 << 20, 100_000  # Spark's own limit of buckets
FILES_PER_TASK = 4
UNKNOWN_BYTES = 1 << 55  # plans that don't know their size claim more than this
CHUNK_SCHEMA = "b long, chunk long, n_bytes long, blob binary, rest binary"
ROW_BITS = 18  # of a row's place in its chunk; a chunk number takes the bits above


@dataclass
class Chunk:
    """Documents in order of their ids: ids, bytes, offsets, and the columns carried along, if any."""

    ids: np.ndarray
    data: np.ndarray
    offs: np.ndarray
    rest: bytes | None = None

    def carried(self) -> pa.Table:
        return pa.ipc.open_stream(K.expand(self.rest)).read_all()

    def pack(self) -> bytes:
        return K.squeeze(np.int64(len(self.ids)).tobytes() + self.ids.tobytes() + self.offs.tobytes() + self.data.tobytes())

    @staticmethod
    def unpack(blob: bytes) -> Chunk:
        raw = K.expand(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        ids = np.frombuffer(raw, np.int64, n, 8)
        offs = np.frombuffer(raw, np.int64, n + 1, 8 + 8 * n)
        return Chunk(ids, np.frombuffer(raw, np.uint8, int(offs[-1]), 16 + 16 * n), offs)


def _gather(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]]) -> Chunk:
    ids = np.concatenate([p[0] for p in parts])
    lens = np.concatenate([np.diff(p[2]) for p in parts])
    data = np.concatenate([p[1] for p in parts])
    starts = np.concatenate([[0], np.cumsum(lens)])[:-1]
    order = np.argsort(ids, kind="stable")
    offs = np.concatenate([[0], np.cumsum(lens[order])]).astype(np.int64)
    out = np.empty(len(data), dtype=np.uint8)
    for k, i in enumerate(order.tolist()):
        out[offs[k] : offs[k + 1]] = data[starts[i] : starts[i] + lens[i]]
    rest = None
    if parts[0][3].num_columns:
        table = pa.Table.from_batches([p[3] for p in parts]).take(pa.array(order))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        rest = K.squeeze(sink.getvalue().to_pybytes())
    return Chunk(ids[order], out, offs, rest)


def scaled(total: int, sizes: tuple[int, int], number: int) -> int:
    """Bytes of each of `number` equal parts of the total, within the sizes."""
    return min(sizes[1], max(sizes[0], total // number))


def _spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash of a bigint column (Murmur3 of 32 bits with seed 42)."""
    with np.errstate(over="ignore"):
        u = np.uint32
        turn = lambda v, r: (v << u(r)) | (v >> u(32 - r))
        h = np.full(len(x), 42, np.uint32)
        for half in (x.astype(np.uint64).astype(np.uint32), (x.astype(np.uint64) >> K.U(32)).astype(np.uint32)):
            h ^= turn(half * u(0xCC9E2D51), 15) * u(0x1B873593)
            h = turn(h, 13) * u(5) + u(0xE6546B64)
        h ^= u(8)
        h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
        h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
        return (h ^ (h >> u(16))).view(np.int32)


def spread_keys(n: int, each: int = 1) -> np.ndarray:
    """`each` rows of n numbers; hash partitioning by n puts the k-th of each row into partition k, so that none is left out or doubled."""
    out = np.full((each, n), -1, np.int64)
    filled, at = np.zeros(n, np.int64), 0
    while (filled < each).any():
        tried = np.arange(at, at + max(4 * n, 1024), dtype=np.int64)
        at += len(tried)
        part = _spark_hash(tried) % n
        order = np.argsort(part, kind="stable")
        p, tried = part[order], tried[order]
        head = np.searchsorted(p, np.arange(n))
        for k in range(each):
            some = np.flatnonzero((filled == k) & (head < len(p)))
            some = some[p[head[some]] == some]
            out[k, some] = tried[head[some]]
            filled[some] += 1
            head[some] += 1
    return out


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int, buckets: np.ndarray) -> Iterator[pa.RecordBatch]:
    task, count = TaskContext.get().partitionId(), 0
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]] = []
    size = rows = 0

    def emit() -> pa.RecordBatch:
        nonlocal count, held, size, rows
        chunk = _gather(held)
        count, held, size, rows = count + 1, [], 0, 0
        return pa.RecordBatch.from_pydict({"b": pa.array([buckets[(task * FILES_PER_TASK + count % FILES_PER_TASK) % len(buckets)]], pa.int64()), "chunk": pa.array([task << 24 | count], pa.int64()), "n_bytes": pa.array([len(chunk.data)], pa.int64()), "blob": pa.array([chunk.pack()], pa.binary()), "rest": pa.array([chunk.rest], pa.binary())})

    for batch in K.released(batches):
        raw, offs = K.column_bytes(batch.column(1))
        more, done = batch.select(batch.schema.names[2:]), 0
        for part in K.groups(K.column_ids(batch.column(0)), raw, offs, 1 << 20):
            if held and (size + len(part[1]) > chunk_bytes or rows > 50_000):
                yield emit()
            held.append((part[0].copy(), part[1].copy(), part[2], more.slice(done, len(part[0]))))
            done += len(part[0])
            size, rows = size + len(part[1]), rows + len(part[0])
    if held:
        yield emit()


@dataclass
class Store:
    """The staged chunks of one table."""

    spark: SparkSession
    path: str
    table: str
    total_bytes: int

    def read(self, carried: bool = False) -> DataFrame:
        return self.spark.table(self.table) if carried else self.spark.table(self.table).drop("rest")

    def parts(self, least: int = PART_BYTES[0]) -> int:
        """Partitions of the hash space, for about `least` bytes of text each or what the input's size asks for."""
        return max(1, -(-self.total_bytes // scaled(self.total_bytes, (least, PART_BYTES[1]), PARTS)))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        discard(self.spark, self.path)


def _bytes_of(df: DataFrame, texts: DataFrame) -> int:
    """The plan's own estimate, which for files is their size; where it has none, the texts are measured."""
    said = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return said if said < UNKNOWN_BYTES else texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> Store:
    """Stage (id, text) of df as chunks, with the columns of `carry`."""
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry or [])))
    # chunks and answers are joined by bucket and chunk, and the bucket alone is partitioning enough
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    path, table = fresh_path(spark, "chunks"), f"tessera_chunks_{uuid.uuid4().hex}"
    size = _bytes_of(df, rows)
    chunk_bytes, buckets = scaled(size, CHUNK_BYTES, CHUNKS), min(MAX_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)))
    keys = spread_keys(buckets)[0]
    made = rows.mapInArrow(lambda batches: _chunks(batches, chunk_bytes, keys), CHUNK_SCHEMA)
    made.write.bucketBy(buckets, "b").option("path", path).option("compression", "none").saveAsTable(table)
    total = spark.table(table).agg(F.sum("n_bytes")).first()[0] or 0
    return Store(spark, path, table, total)


def split_parts(part: np.ndarray, n_parts: int) -> np.ndarray:
    """Bounds of each partition in entries that are sorted by partition."""
    return np.searchsorted(part, np.arange(n_parts + 1))


def ask(
    chunks: DataFrame,
    emit: Callable[[Chunk, dict[str, list[tuple[int, bytes]]]], Iterator[tuple[int, bytes]]],
    answer: Callable[[list[bytes]], list[bytes]],
    asked: tuple[str, ...],
    name: str,
    n_parts: int,
    kinds: int = 1,
) -> DataFrame:
    """One round: emit(chunk, answers so far) gives (partition, message); answer(messages of a partition) gives replies.

    Partitions are numbered below kinds * n_parts.  Returns the staged answers of each chunk: b, chunk, and `name`, an
    array of (part, body).
    """
    keys = spread_keys(n_parts, kinds).ravel()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, chunk_id, chunk, got in rows_of(batches, asked):
            out = list(emit(chunk, got))
            for i in range(0, len(out), 64):
                some = out[i : i + 64]
                part = np.array([p for p, _ in some], np.int64)
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys[part]), "part": pa.array(part), "b": pa.array([b] * len(some), pa.int64()), "chunk": pa.array([chunk_id] * len(some), pa.int64()), "body": pa.array([m for _, m in some], pa.binary())})

    def reply(table: pa.Table) -> pa.Table:
        bodies = answer(table.column("body").to_pylist())
        K.release()
        return pa.table({"b": table.column("b"), "chunk": table.column("chunk"), "part": table.column("part"), "body": pa.array(bodies, pa.binary())})

    sent = chunks.mapInArrow(send, "key long, part long, b long, chunk long, body binary").repartition(n_parts, "key")
    replies = sent.groupBy("key").applyInArrow(reply, "b long, chunk long, part long, body binary")
    return stage(by_chunk(replies, name), name)


def by_chunk(rows: DataFrame, name: str) -> DataFrame:
    """rows(b, chunk, part, body) as one row for each chunk."""
    return rows.groupBy("b", "chunk").agg(F.collect_list(F.struct("part", "body")).alias(name))


def with_answers(chunks: DataFrame, *answers: DataFrame) -> DataFrame:
    for a in answers:
        chunks = chunks.join(a, ["b", "chunk"], "left")
    return chunks


def rows_of(batches: Iterator[pa.RecordBatch], asked: tuple[str, ...]) -> Iterator[tuple[int, int, Chunk, dict[str, list[tuple[int, bytes]]]]]:
    """Each chunk with its answers, by round and in order of the partitions."""
    for batch in K.released(batches):
        names = batch.schema.names
        for i in range(batch.num_rows):
            get = lambda c, i=i: batch.column(names.index(c))[i]
            got = {}
            for a in asked:
                cell = get(a)
                got[a] = sorted(zip(cell.values.field(0).to_pylist(), cell.values.field(1).to_pylist())) if cell.is_valid else []
            chunk = Chunk.unpack(get("blob").as_buffer())
            if "rest" in names:
                chunk.rest = get("rest").as_py()
            yield get("b").as_py(), get("chunk").as_py(), chunk, got


def read_bits(answers: list[tuple[int, bytes]], bounds: np.ndarray) -> np.ndarray:
    """The answers of all partitions as one mask over the chunk's sorted keys."""
    out = np.zeros(int(bounds[-1]), dtype=bool)
    for part, body in answers:
        out[bounds[part] : bounds[part + 1]] = K.unpack_bits(body, int(bounds[part + 1] - bounds[part]))
    return out


class KeySet:
    """A chunk's distinct 64-bit keys, dealt to n partitions; the first holder of each key comes first in `order`."""

    def __init__(self, keys: np.ndarray, n_parts: int) -> None:
        part = ((K.mix(keys, 77) >> K.U(32)) * K.U(n_parts) >> K.U(32)).astype(np.int64)
        self.order = np.lexsort((keys, part)) if n_parts > 1 else np.argsort(keys, kind="stable")
        k, p = keys[self.order], part[self.order]
        head = np.ones(len(k), dtype=bool)
        head[1:] = k[1:] != k[:-1]
        self.heads = np.flatnonzero(head)
        self.group = np.empty(len(k), dtype=np.int64)
        self.group[self.order] = np.cumsum(head) - 1
        self.keys = k[self.heads]
        self.bounds = split_parts(p[self.heads], n_parts)
        self.first = self.order[self.heads]
        tails = np.append(self.heads[1:], len(k)) - 1
        self.final = self.order[tails] if len(k) else self.order

    def filled(self) -> Iterator[tuple[int, int, int]]:
        for p in np.flatnonzero(np.diff(self.bounds)).tolist():
            yield p, int(self.bounds[p]), int(self.bounds[p + 1])


def short_keys(keys: np.ndarray) -> bytes:
    """40 bits of each key: enough to pick candidates inside one partition, whatever the size of the input."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def seen_twice(bodies: list[bytes]) -> list[bytes]:
    """Which of the 40-bit keys of each message occur in more than one message."""
    sizes = [len(x) // 5 for x in bodies]
    keys = np.zeros((sum(sizes), 8), dtype=np.uint8)
    keys[:, :5] = np.frombuffer(b"".join(bodies), dtype=np.uint8).reshape(-1, 5)
    flat = keys.view(np.uint64).ravel()
    order = np.argsort(flat)
    s = flat[order]
    same = np.zeros(len(s) + 1, dtype=bool)
    same[1:-1] = s[1:] == s[:-1]
    hit = np.empty(len(s), dtype=bool)
    hit[order] = same[1:] | same[:-1]
    return [K.pack_bits(x) for x in np.split(hit, np.cumsum(sizes)[:-1])]
