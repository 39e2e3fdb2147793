"""Nearest neighbours by cosine from score-aware (anisotropic) quantisation, four-bit table scans and exact reranking.

Vectors are scaled to unit length and dealt to coarse cells; every row is indexed.  What a cell's centre leaves of a
vector is coded by a product quantiser of sub-vectors with 16 code words each.  Cells are fitted on at most TRAIN_ROWS
rows, code words on CODED_ROWS of them, so that the loss weighs the error's part parallel to the vector eta times the
orthogonal part (the parallel part is what moves the largest inner products): codes by coordinate descent on that loss,
code words by its weighted least-squares solution.  How many cells are probed, and which share of a block is reranked,
are the least that keep RECALL of the true neighbours of up to ASKED of the queries themselves, which are found by brute
force over the whole table: queries need not be like the other rows.  A row that ties with a neighbour counts as before
it.  Every row is reranked, too, whose approximate score is that of the cut or within the margin of the block's k-th
best that RECALL of those neighbours keep: a group that shares a few codes is scored exactly as a whole.

A cell is stored in blocks of about BLOCK rows (large cells are split by a hash of the id, so that a cell that a
third of all rows fall into is many blocks).  A query block goes to each block of its cells by cell and block, so that
a hot cell is many tasks: per sub-vector a table of
16 partial products is looked up for the whole block, the best share of it is scored exactly in double precision on
the original vectors, and the best of all blocks are merged by a grouped aggregation.

Null and zero vectors and those with null or non-finite components take no part; vectors of another length than the
most frequent one neither.  Ties go to the smaller id.  Rows with the query's own id are no candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.staging import small_batches, stage

TRAIN_ROWS, CODED_ROWS, ASKED = 20_000, 6_000, 400  # bounds: rows for cells, for code words, and queries for calibration
THRESHOLD, SUB, CODES = 0.2, 2, 16
QUERY_PART = 16_384  # queries of a task
BLOCK, QUERY_BLOCK, LEAST_RERANK, MAX_CELLS, RECALL = 4096, 128, 64, 1024, 0.985


@dataclass
class Index:
    """Coarse centres and code words: cells x d, and sub-vectors x 16 x SUB; d is padded to a multiple of SUB."""

    dim: int
    centres: np.ndarray
    words: np.ndarray
    eta: float

    def unit(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.words.shape[0] * SUB))
        out[:, : self.dim] = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        return out

    def cells(self, unit: np.ndarray, n: int) -> np.ndarray:
        """The n cells whose centres are nearest to each row, nearest first."""
        d = (self.centres * self.centres).sum(axis=1) - 2.0 * unit @ self.centres.T
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def encode(self, unit: np.ndarray, cells: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes of x - centre by coordinate descent on |e|^2 + (eta - 1) (e . x)^2, from the nearest code words on."""
        n_sub = self.words.shape[0]
        parts, rest = unit.reshape(len(unit), n_sub, SUB), (unit - self.centres[cells]).reshape(len(unit), n_sub, SUB)
        error = rest[:, :, None, :] - self.words[None]
        square = (error**2).sum(axis=3)
        along = (parts[:, :, None, :] * error).sum(axis=3)
        codes = square.argmin(axis=2)
        rows = np.arange(len(unit))
        total = np.take_along_axis(along, codes[:, :, None], axis=2).sum(axis=(1, 2))
        for _ in range(sweeps):
            for s in range(n_sub):
                rest = total - along[rows, s, codes[:, s]]
                codes[:, s] = (square[:, s] + (self.eta - 1) * (rest[:, None] + along[:, s]) ** 2).argmin(axis=1)
                total = rest + along[rows, s, codes[:, s]]
        return codes.astype(np.uint8)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(axis=1) - 2.0 * x @ c.T).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        for j in range(x.shape[1]):
            c[:, j] = np.where(n > 0, np.bincount(near, weights=x[:, j], minlength=k) / np.maximum(n, 1), c[:, j])
    return c


def fit(sample: np.ndarray, n_rows: int, rounds: int = 3) -> Index:
    dim = sample.shape[1]
    n_sub = -(-dim // SUB)
    eta = max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    rng = np.random.default_rng(7)
    index = Index(dim, np.zeros((1, n_sub * SUB)), np.zeros((n_sub, CODES, SUB)), eta)
    unit = index.unit(sample)
    k = int(max(1, min(MAX_CELLS, np.sqrt(n_rows) / 4, len(unit) // 32)))
    index.centres = _kmeans(unit, k, 10, rng)
    some = unit[rng.permutation(len(unit))[:CODED_ROWS]]
    cells = index.cells(some, 1)[:, 0]
    rest = some - index.centres[cells]
    for s in range(n_sub):
        part = rest[:, s * SUB : (s + 1) * SUB]
        index.words[s, : min(CODES, len(part))] = _kmeans(part, min(CODES, len(part)), 10, rng)
    base = np.arange(n_sub) * CODES
    for _ in range(rounds):
        codes = index.encode(some, cells).astype(np.int64) + base
        # normal equations of the code words: diagonal counts plus (eta - 1) times the outer products of the rows
        size = n_sub * CODES * SUB
        v = np.zeros((len(some), size))
        at = (codes[:, :, None] * SUB + np.arange(SUB)).reshape(len(some), -1)
        np.put_along_axis(v, at, some, axis=1)
        norm = (some * rest).sum(axis=1)
        a = (eta - 1) * v.T @ v + np.diag(np.bincount(at.ravel(), minlength=size) + 1e-3)
        b = np.bincount(at.ravel(), weights=rest.ravel(), minlength=size) + (eta - 1) * v.T @ norm + 1e-3 * index.words.ravel()
        index.words = np.linalg.solve(a, b).reshape(n_sub, CODES, SUB)
    return index


def calibrate(index: Index, blocks: DataFrame, qids: np.ndarray, qx: np.ndarray, k: int, recall: float) -> tuple[int, float, float]:
    """Cells to probe, the share of a block to rerank, and the margin below its k-th best: the least that keep `recall` each.

    The k true neighbours of these queries are found by brute force over all blocks, and where each is met is measured:
    its cell's place in the query's order, its rank in its block by approximate score (ties before it), and how far it
    is below the block's k-th best other score.
    """
    n_sub, unit = index.words.shape[0], index.unit(qx)
    table = np.einsum("qsj,scj->sqc", unit.reshape(len(unit), n_sub, SUB), index.words).astype(np.float32)
    place = np.argsort(index.cells(unit, len(index.centres)), axis=1)
    names = ["q", "vec_id", "score", "place", "need", "below"]

    def best(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts).sort_values(["q", "score", "vec_id"], ascending=[True, False, True], kind="stable").groupby("q").head(k)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pd.DataFrame] = []
        floor = np.full(len(qids), -np.inf)  # of what can still be a neighbour, by what this task has seen
        for batch in K.released(batches):
            for i in range(batch.num_rows):
                cell, raw = batch.column(0)[i].as_py(), [batch.column(c)[i].as_buffer() for c in (1, 2, 3)]
                ids, x = np.frombuffer(raw[0], np.int64), np.frombuffer(raw[2], np.float64).reshape(-1, index.dim)
                packed = np.frombuffer(raw[1], np.uint8).reshape(len(ids), -1)
                score = unit @ index.unit(x).T
                score[qids[:, None] == ids] = -np.inf
                some = np.flatnonzero((score.max(axis=1) >= floor) & (score.max(axis=1) > -np.inf))
                if not len(some):
                    continue
                score, m = score[some], min(k, len(ids))
                top = np.argpartition(-score, m - 1, axis=1)[:, :m]
                found = np.take_along_axis(score, top, axis=1)
                approx = _approximate(table[:, some], packed)
                at = np.take_along_axis(approx, top, axis=1)
                need = np.stack([(approx >= at[:, j, None]).sum(axis=1) for j in range(m)], axis=1) / len(ids)
                below = np.maximum(_kth(approx, k + 1)[:, None] - at, 0)
                if m == k:
                    floor[some] = np.maximum(floor[some], found.min(axis=1))
                rows = pd.DataFrame({"q": np.repeat(some, m), "vec_id": ids[top].ravel(), "score": found.ravel(), "place": np.repeat(place[some, cell], m), "need": need.ravel(), "below": below.ravel().astype(np.float64)})
                parts.append(rows[rows["score"] > -np.inf])
                if len(parts) == 64:
                    parts = [best(parts)]
        if parts:
            yield pa.RecordBatch.from_pandas(best(parts)[names], preserve_index=False)

    met = blocks.select("cell", "ids", "codes", "xs").mapInArrow(measure, "q long, vec_id long, score double, place long, need double, below double")
    nearest_of = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "place", "need", "below"))), 1, k)
    got = met.groupBy("q").agg(nearest_of.alias("top")).select(F.inline("top")).select("place", "need", "below").toArrow()  # ASKED * k rows at most
    if not got.num_rows:
        return 1, 1.0, float("inf")
    at = min(got.num_rows - 1, int(np.ceil(recall * got.num_rows)))
    place_at, need_at, below_at = (np.sort(got.column(c).to_numpy())[at] for c in ("place", "need", "below"))
    return int(place_at) + 1, float(need_at), float(below_at)


def _approximate(table: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Approximate scores of a block's rows: for each query the sum of what the codes find in its tables."""
    approx = np.zeros((table.shape[1], len(packed)), dtype=np.float32)
    for s in range(len(table)):
        approx += table[s][:, (packed[:, s // 2] >> (4 * (s % 2))) & 15]
    return approx


def _kth(approx: np.ndarray, k: int) -> np.ndarray:
    """The k-th best of each row, or its least where it has fewer."""
    at = max(0, approx.shape[1] - k)
    return np.partition(approx, at, axis=1)[:, at]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (sizes.d if sizes else 0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest; is_query is an expression over `id`."""
    out_schema = "query_id long, vec_id long, score double"
    spark = vectors.sparkSession
    small_batches(spark)
    rows = stage(usable(vectors, id_col, vector_col), "vectors")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.select("v").orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS).toArrow()
    drawn = _matrix(sample.column("v").combine_chunks())
    index = fit(drawn, n)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.released(batches):
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                x = _matrix(part.column(1))
                unit = index.unit(x)
                cells = index.cells(unit, 1)[:, 0]
                codes = index.encode(unit, cells)
                codes = codes if codes.shape[1] % 2 == 0 else np.pad(codes, ((0, 0), (0, 1)))
                packed = codes[:, 0::2] | codes[:, 1::2] << 4
                yield pa.RecordBatch.from_pydict({"cell": pa.array(cells.astype(np.int32)), "id": part.column(0), "code": pa.array([c.tobytes() for c in packed], pa.binary()), "x": pa.array([v.tobytes() for v in x], pa.binary())})

    indexed = stage(rows.mapInArrow(assign, "cell int, id long, code binary, x binary"), "coded")
    sizes = {r.cell: r.n for r in indexed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # MAX_CELLS rows at most
    n_blocks = F.create_map(*(F.lit(v) for c, m in sorted(sizes.items()) for v in (c, -(-m // BLOCK))))
    dealt = indexed.withColumn("block", F.pmod(F.xxhash64("id"), n_blocks[F.col("cell")].cast("long")))

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        return pd.DataFrame({"cell": rows["cell"].iloc[:1].values, "block": rows["block"].iloc[:1].values, "ids": [rows["id"].to_numpy(np.int64).tobytes()], "codes": [b"".join(rows["code"])], "xs": [b"".join(rows["x"])]})

    blocks = stage(dealt.groupBy("cell", "block").applyInPandas(block, "cell int, block long, ids binary, codes binary, xs binary"), "blocks")

    wanted = rows.where(is_query)
    asked = wanted.orderBy(F.xxhash64("id"), "id").limit(ASKED).toArrow()
    if not asked.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_probe, share, margin = calibrate(index, blocks, asked.column("id").to_numpy(), _matrix(asked.column("v").combine_chunks()), k, recall)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries by cell, QUERY_BLOCK at a time."""
        for batch in K.released(batches):
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                ids, x = part.column(0).to_numpy(), _matrix(part.column(1))
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], x[order]
                cells = index.cells(index.unit(x), n_probe)
                for c in np.unique(cells).tolist():
                    mine = np.flatnonzero((cells == c).any(axis=1))
                    for j in range(0, len(mine), QUERY_BLOCK):
                        q = mine[j : j + QUERY_BLOCK]
                        yield pa.RecordBatch.from_pydict({"cell": pa.array([c], pa.int32()), "qids": pa.array([ids[q].tobytes()], pa.binary()), "qxs": pa.array([x[q].tobytes()], pa.binary())})

    queries = wanted.coalesce(max(1, -(-wanted.count() // QUERY_PART))).mapInArrow(ask, "cell int, qids binary, qxs binary")
    queries = queries.select("*", F.explode(F.transform(F.array_repeat(F.lit(0), F.coalesce(n_blocks[F.col("cell")], F.lit(0))), lambda _, i: i.cast("long"))).alias("block"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.released(batches):
            for i in range(batch.num_rows):
                raw = [batch.column(c)[i].as_buffer() for c in range(5)]
                qids, ids = np.frombuffer(raw[0], np.int64), np.frombuffer(raw[2], np.int64)
                qx, x = (np.frombuffer(b, np.float64).reshape(-1, index.dim) for b in (raw[1], raw[4]))
                packed = np.frombuffer(raw[3], np.uint8).reshape(len(ids), -1)
                got = scan(index, qids, qx, ids, packed, x, k, share, margin)
                yield pa.RecordBatch.from_pydict(dict(zip(("query_id", "vec_id", "score"), map(pa.array, got))))

    met = queries.join(blocks, ["cell", "block"]).select("qids", "qxs", "ids", "codes", "xs").mapInArrow(search, out_schema)
    order = F.struct((-F.col("score")).alias("s"), "vec_id")
    best = F.slice(F.array_sort(F.collect_set(order)), 1, k)
    ranked = met.groupBy("query_id").agg(best.alias("top")).select("query_id", F.posexplode("top").alias("p", "t"))
    return ranked.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.s")).alias("score"))


def scan(index: Index, qids: np.ndarray, qx: np.ndarray, ids: np.ndarray, packed: np.ndarray, x: np.ndarray, k: int, share: float, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of a block for each query.  Equal queries are looked up once.

    The query's product with the cell's centre is the same for the whole block and left out.
    """
    n_sub = index.words.shape[0]
    distinct, back = np.unique(qx, axis=0, return_inverse=True)
    back = back.ravel()
    unit = index.unit(distinct).reshape(len(distinct), n_sub, SUB)
    table = np.einsum("qsj,scj->sqc", unit, index.words).astype(np.float32)
    approx = _approximate(table, packed)
    keep = min(len(ids), max(LEAST_RERANK, int(np.ceil(share * len(ids)))) + 1)
    if keep < len(ids):  # single precision: a hair more than the margin
        cut = np.minimum(_kth(approx, keep), _kth(approx, k + 1) - np.float32(margin + 1e-5))
    norms = np.sqrt((x * x).sum(axis=1))
    by_query: list[tuple[np.ndarray, np.ndarray]] = []
    for j, q in enumerate(distinct):
        some = np.flatnonzero(approx[j] >= cut[j]) if keep < len(ids) else np.arange(len(ids))
        score = (x[some] * q).sum(axis=1) / (norms[some] * np.sqrt((q * q).sum()))
        order = np.lexsort((ids[some], -score))
        by_query.append((ids[some][order], score[order]))
    out: list[list[np.ndarray]] = [[], [], []]
    for qid, j in zip(qids.tolist(), back.tolist()):
        i, s = by_query[j]
        mine = np.flatnonzero(i != qid)[:k]
        for o, v in zip(out, (np.full(len(mine), qid, np.int64), i[mine], s[mine])):
            o.append(v)
    none = np.zeros(0)
    return np.concatenate(out[0] or [none.astype(np.int64)]), np.concatenate(out[1] or [none.astype(np.int64)]), np.concatenate(out[2] or [none])
