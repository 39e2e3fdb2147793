"""Near-duplicate groups from fast similarity sketches, banding and exact verification on whole shingle sets.

Sketch: t coordinates are filled by rounds of hashed placement.  In round i < t every shingle is thrown into a bin
chosen by the i-th hash; in round t + j every shingle is thrown into bin j, so that after 2t rounds no bin of a
non-empty set is left empty.  A bin keeps the least (round, value), and coordinates of two sets agree with the
probability of their Jaccard similarity, with concentration bounds close to those of t independent permutations.

Documents with equal sets form one class first.  Classes that share a band are candidates.  In every bucket the class
with the most bucket mates is the pivot: each class is verified against its best pivot, then against its other
pivots.  Pairs within one component need no check.  What is still apart in a bucket is compared by differences from
the pivot (_through_pivots): a bound leaves only pairs whose differences overlap, and no pair that can be linked is
dropped, so a bucket of n classes costs about n checks whether its members are linked with the pivot or not.

Ties and repeated rows: equal texts are one class.  Null, empty and wordless texts have no shingles and are alone.
Rows without an id count as one document above all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import exchange as X
from tessera.llm import kernels as K
from tessera.llm.components import components
from tessera.llm.staging import keep, scratch, stage

WIDTH, ROWS, MISS = 5, 5, 1e-6
BROADCAST_PIVOTS = 200_000  # of rows of 40 bytes


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document, sorted, one after the other, and where each document's begin."""
    w = K.Words(K.LOWER[data], offs)
    n_docs = len(offs) - 1
    at = np.arange(len(w.hashes))
    full = np.flatnonzero(at + width <= w.last)
    hashes, doc = [w.windows(width)[full]], [w.doc[full]]
    for n in range(1, width):
        some = np.flatnonzero(w.counts == n)
        if len(some):
            hashes.append(K.mix(w.windows(n)[w.first[some]], 100 + n))
            doc.append(some)
    h, d = np.concatenate(hashes), np.concatenate(doc)
    if len(doc) > 1:
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    edges = np.searchsorted(d, np.arange(n_docs + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        h[a:b].sort()
    head = np.ones(len(h), dtype=bool)
    head[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[head], np.searchsorted(d[head], np.arange(n_docs + 1))


def bands_for(percent: int) -> int:
    """Bands of ROWS coordinates with which a pair at the threshold shares none with a probability of MISS at most."""
    return int(np.ceil(np.log(MISS) / np.log1p(-((percent / 100) ** ROWS)))) if percent < 100 else 1


def sketches(h: np.ndarray, edges: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches of many sets: an array of documents by t; rows of empty sets stay at the maximum."""
    n_docs = len(edges) - 1
    empty = K.U(0xFFFFFFFFFFFFFFFF)
    out = np.full(n_docs * t, empty, dtype=np.uint64)
    sizes = np.diff(edges)
    x, doc = h, np.repeat(np.arange(n_docs), sizes)
    open_docs = sizes > 0
    for i in range(2 * t):
        v = K.mix(x, 1000 + i)
        spot = ((v >> K.U(32)) * K.U(t) >> K.U(32)).astype(np.int64) if i < t else np.int64(i - t)
        cell = doc * t + spot
        free = out[cell] == empty
        np.minimum.at(out, cell[free], K.mix(v[free], 5000))
        left = (out.reshape(n_docs, t) == empty).any(axis=1) & open_docs
        if not left.any():
            break
        if left.sum() < open_docs.sum():
            stay = left[doc]
            x, doc, open_docs = x[stay], doc[stay], left
    return out.reshape(n_docs, t)


def _sketch(batches: Iterator[pa.RecordBatch], bands: int) -> Iterator[pa.RecordBatch]:
    for b, chunk_id, chunk, _ in X.rows_of(batches, ()):
        base = 0
        for ids, data, offs in K.groups(chunk.ids, chunk.data, chunk.offs):
            h, edges = shingle_sets(data, offs)
            n = np.diff(edges)
            s = sketches(h, edges, ROWS * bands)
            band = np.zeros((len(ids), bands), dtype=np.uint64)
            for r in range(ROWS):
                band = K.mix(band * K.U(K.WORD_BASE) + s.reshape(len(ids), bands, ROWS)[:, :, r], 9)
            sums = [np.concatenate([[K.U(0)], np.cumsum(K.mix(h, salt))]) for salt in (21, 22)]
            f1, f2 = (x[edges[1:]] - x[edges[:-1]] for x in sums)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(ids) * bands + 1, bands), pa.int32()), pa.array(band.ravel().view(np.int64)))
            uid = (chunk_id << X.ROW_BITS) + base + np.arange(len(ids))
            base += len(ids)
            o = offs.tolist()
            body = [xxhash.xxh64_intdigest(data[i:j], 42) for i, j in zip(o[:-1], o[1:])]
            yield pa.RecordBatch.from_pydict({"uid": pa.array(uid), "b": pa.array(np.full(len(ids), b)), "doc_id": pa.array(ids), "n_shingles": pa.array(n.astype(np.int64)), "f1": pa.array(f1.view(np.int64)), "f2": pa.array(f2.view(np.int64)), "bands": lists, "body": pa.array(np.array(body, dtype=np.uint64).view(np.int64))})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, chunk_id, chunk, got in X.rows_of(batches, ("wanted",)):
        for some in np.array_split([i for i, _ in got["wanted"]], max(1, len(got["wanted"]) // 256)):
            some = some.astype(np.int64)
            if not len(some):
                continue
            texts = [chunk.data[chunk.offs[i] : chunk.offs[i + 1]] for i in some.tolist()]
            h, edges = shingle_sets(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
            e = edges.tolist()
            yield pa.RecordBatch.from_pydict({"uid": pa.array((chunk_id << X.ROW_BITS) + some), "items": pa.array([h[i:j].tobytes() for i, j in zip(e[:-1], e[1:])], pa.binary())})


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in K.released(batches):
        left, right = batch.column("x"), batch.column("y")
        keep = np.zeros(batch.num_rows, dtype=bool)
        for i in range(batch.num_rows):
            a, b = (np.frombuffer(c[i].as_buffer(), dtype=np.uint64) for c in (left, right))
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep[i] = 100 * both >= percent * (len(a) + len(b) - both)
        yield pa.RecordBatch.from_pydict({"a": batch.column("a").filter(pa.array(keep)), "b": batch.column("b").filter(pa.array(keep))})


def _verify(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    x = sets.select(F.col("uid").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("uid").alias("b"), F.col("items").alias("y"))
    return stage(pairs.select("a", "b").join(x, "a").join(y, "b").mapInArrow(lambda it: _linked(it, percent), "a long, b long"), name)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """Per row of df: doc_id, n_shingles, component_id, kept (it is the component's least id), body (xxhash64 of the text), label.

    Ids may be null or repeated, so that unrelated components can have the same component_id; label tells them apart.
    It is the least node of the component, and null for a text without shingles.
    """
    with scratch(df.sparkSession):
        held = X.store(df, id_col, text_col)
        out = keep(_grouped(held.read(), percent))
    held.drop()
    return out


def _grouped(chunks: DataFrame, percent: int) -> DataFrame:
    schema = "uid long, b long, doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, body long"
    n_bands = bands_for(percent)
    drawn = stage(chunks.mapInArrow(lambda it: _sketch(it, n_bands), schema), "sketches")
    set_key = ["n_shingles", "f1", "f2"]
    classes = drawn.where("n_shingles > 0").groupBy(*set_key).agg(F.min(F.struct("doc_id", "uid", "b", "bands")).alias("m"))
    classes = stage(classes.select(*set_key, "m.doc_id", "m.uid", "m.b", "m.bands"), "classes")
    spread = classes.select("uid", "b", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "value")).select("uid", "b", "n", F.xxhash64("band", "value").alias("key"))
    # what is joined to all members of a bucket is staged first: only plain joins of two exchanges can be split where a bucket is hot
    busy = stage(spread.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "busy")
    mates = stage(spread.join(busy, "key"), "mates")
    degree = mates.groupBy("uid").agg(F.sum(F.col("size") - 1).alias("degree"))
    ranked = mates.join(degree, "uid").select("key", "uid", "n", F.struct("degree", (-F.col("uid")).alias("minus")).alias("rank"))
    pivots = stage(ranked.groupBy("key").agg(F.max("rank").alias("p")), "pivots")
    pivoted = stage(ranked.join(pivots, "key").select("key", "uid", "n", (-F.col("p.minus")).alias("pivot"), "p.degree"), "pivoted")
    star = stage(pivoted.where("uid <> pivot").select(F.col("uid").alias("a"), F.col("pivot").alias("b"), "degree").distinct(), "star")
    best = star.groupBy("a").agg(F.max(F.struct("degree", (-F.col("b")).alias("minus"))).alias("p")).select("a", (-F.col("p.minus")).alias("b"))

    rows = mates.select("b", "uid").distinct().select("b", F.shiftright("uid", X.ROW_BITS).alias("chunk"), F.col("uid").bitwiseAND((1 << X.ROW_BITS) - 1).alias("part"), F.lit(b"").alias("body"))
    sets = stage(chunks.join(X.by_chunk(rows, "wanted"), ["b", "chunk"]).mapInArrow(_sets, "uid long, items binary"), "sets", compression="none")
    links = _verify(best, sets, percent, "links")
    labels = components(links)

    apart = _labelled(star, labels).where("la <> lb").join(best.withColumnRenamed("b", "b0"), "a").where("b <> b0").select("a", "b")
    more = _verify(apart, sets, percent, "links")
    if more.limit(1).count():
        links = links.union(more)
        labels = components(links)

    rest = _through_pivots(pivoted, labels, sets, percent)
    more = _verify(rest, sets, percent, "links")
    if more.limit(1).count():
        labels = components(links.union(more))

    owned = classes.select(*set_key, "doc_id", "uid").join(labels.withColumnRenamed("node", "uid"), "uid", "left").select(*set_key, "doc_id", F.coalesce("label", "uid").alias("label"))
    least = owned.groupBy("label").agg(F.min("doc_id").alias("component"))
    owned = owned.join(least, "label").select(*set_key, "component", "label")
    out = drawn.select("doc_id", "body", *set_key).join(owned, set_key, "left").withColumn("component", F.coalesce("component", "doc_id"))
    known = lambda c: F.when(F.col(c) != K.NO_ID, F.col(c))
    out = out.select(known("doc_id").alias("doc_id"), "n_shingles", known("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"), "body", "label")
    return out


def _through_pivots(pivoted: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share a bucket, are still in different components, and can be linked at all.

    Let D(a) be the symmetric difference of a's set and that of the bucket's pivot.  a and b are linked if and only if
    f(a) + f(b) <= 2 * (100 + percent) * |D(a) & D(b)| with f(a) = (100 + percent) * |D(a)| - (100 - percent) * |a|.
    Of a pivot's members let m have the least f.  Where f(a) + f(b) <= 0 both are linked with m; those pairs (a, m)
    are returned.  Otherwise the differences overlap by a known number of elements, so in a common order (elements
    that the pivot lacks first: they are rare) their prefixes meet.  Members that aren't in m's component look up
    their prefixes in those of all members, so that members that merely resemble the pivot never meet each other.
    """
    rows = pivoted.join(labels.withColumnRenamed("node", "uid"), "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    mixed = stage(rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key"), "mixed")
    members = rows.join(mixed, "key", "left_semi").select("pivot", F.col("uid").alias("a"), "label").distinct()
    x = sets.select(F.col("uid").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("uid").alias("pivot"), F.col("items").alias("y"))
    schema = "pivot long, a long, label long, n long, d long, items array<int>"
    diffs = members.join(x, "a").join(y, "pivot").select("pivot", "a", "label", "x", "y").mapInArrow(_differences, schema)
    diffs = stage(diffs.withColumn("f", (100 + percent) * F.col("d") - (100 - percent) * F.col("n")), "differences")
    nearest = stage(diffs.groupBy("pivot").agg(F.min(F.struct("f", "a", "label")).alias("m")), "nearest")
    small = F.broadcast if nearest.count() <= BROADCAST_PIVOTS else (lambda df: df)
    outer = diffs.select("pivot", "label", "f").join(small(nearest), "pivot").where(F.col("label") != F.col("m.label"))
    bounds = stage(nearest.join(outer.groupBy("pivot").agg(F.min("f").alias("least_out")), "pivot"), "bounds")
    seen = diffs.join(small(bounds), "pivot").withColumn("out", F.col("label") != F.col("m.label"))
    sure = seen.where("out and f + m.f <= 0").select("a", F.col("m.a").alias("b"))

    need = lambda f, g: F.greatest(F.ceil((f + g) / (2.0 * (100 + percent))), F.lit(1))
    prefix = lambda other: F.slice("items", 1, F.greatest(F.col("d") - need(F.col("f"), other) + 1, F.lit(0)).cast("int"))
    asks = seen.where("out").select("pivot", "a", F.col("label").alias("la"), F.col("n").alias("na"), F.col("d").alias("da"), F.col("f").alias("fa"), F.posexplode(prefix(F.col("m.f"))).alias("i", "e"))
    holds = seen.select("pivot", F.col("a").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("d").alias("db"), F.col("f").alias("fb"), F.posexplode(prefix(F.col("least_out"))).alias("j", "e"))
    overlap = need(F.col("fa"), F.col("fb"))
    can = (F.col("la") != F.col("lb")) & (F.col("fa") + F.col("fb") > 0) & (F.col("i") <= F.col("da") - overlap) & (F.col("j") <= F.col("db") - overlap)
    can = can & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    met = asks.join(holds, ["pivot", "e"]).where(can).select("a", "b")
    return sure.union(met).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of each set and of its symmetric difference with its pivot's, and 32 bits of the elements of that in order."""
    for batch in K.released(batches):
        left, right = batch.column("x"), batch.column("y")
        n, items = [], []
        for i in range(batch.num_rows):
            a, p = (np.frombuffer(c[i].as_buffer(), dtype=np.uint64) for c in (left, right))
            own, lost = (np.setdiff1d(u, v, assume_unique=True) for u, v in ((a, p), (p, a)))
            n.append(len(a))
            items.append(np.concatenate([own, lost]))
        sizes = [len(v) for v in items]
        flat = (np.concatenate(items) >> K.U(32)).astype(np.uint32).view(np.int32) if items else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column("pivot"), batch.column("a"), batch.column("label"), pa.array(n, pa.int64()), pa.array(sizes, pa.int64()), lists], ["pivot", "a", "label", "n", "d", "items"])


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        named = labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
        pairs = pairs.join(named, side, "left").withColumn(f"l{side}", F.coalesce(f"l{side}", side))
    return pairs
