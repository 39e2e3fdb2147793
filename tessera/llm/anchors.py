"""Removal of word runs that an earlier document also holds, found through difference-cover anchors.

Words are the maximal runs of characters other than space and U+0009..U+000D.  A window is 13 consecutive words of
one document.  {0, 1, 3} is a difference cover modulo 7: for any two word positions some shift below 7 brings both
onto cover positions.  Windows of 7 words are therefore hashed only at cover positions (3 in 7 words), and two equal
13-word windows always share an aligned anchor.

Round 1 asks which anchors occur more than once.  Round 2 extends: the 13-word windows over such an anchor are
compared with each other, and each learns whether a document with a smaller id holds it.  Everything else stays in
its chunk.  Ties: documents with equal ids don't remove each other's words.  Null or empty texts have no words; rows
without an id count as one document above all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import exchange as X
from tessera.llm import kernels as K
from tessera.llm.staging import keep, scratch

PERIOD, COVER, WINDOW = 7, (0, 1, 3), 13
ANCHOR = WINDOW - PERIOD + 1
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
PART_BYTES = 16 << 20


class _Chunk:
    """What every pass needs of a chunk: its words and its anchors."""

    def __init__(self, chunk: X.Chunk, n_parts: int) -> None:
        self.chunk, self.n_parts = chunk, n_parts
        self.words = w = K.Words(chunk.data, chunk.offs)
        at = np.arange(len(w.hashes))
        self.anchor_at = np.flatnonzero(_IN_COVER[(at - w.first[w.doc]) % PERIOD] & (at + ANCHOR <= w.last))
        hashes = w.windows(ANCHOR)
        self.anchors = X.KeySet(hashes[self.anchor_at], n_parts)

    def candidates(self, answers: list[tuple[int, bytes]]) -> tuple[np.ndarray, X.KeySet]:
        """Starts of the 13-word windows over an anchor that occurs elsewhere, and their keys."""
        w, a = self.words, self.anchors
        multi = X.read_bits(answers, a.bounds) | (w.doc[self.anchor_at[a.first]] != w.doc[self.anchor_at[a.final]]) if len(a.keys) else np.zeros(0, bool)
        flag = np.zeros(len(w.hashes) + PERIOD + 1, dtype=np.int64)
        flag[1 + self.anchor_at] = multi[a.group] if len(a.group) else 0
        run = np.cumsum(flag)
        n = len(w.hashes)
        starts = np.flatnonzero((run[PERIOD : PERIOD + n] > run[:n]) & (np.arange(n) + WINDOW <= w.last))
        return starts, X.KeySet(w.windows(WINDOW, 1)[starts], self.n_parts)


def _smaller_elsewhere(bodies: list[bytes]) -> list[bytes]:
    """For each key of each message: does another message hold it with a smaller id?"""
    keys, ids, sizes = [], [], []
    for body in bodies:
        n = int.from_bytes(body[:8], "little")
        sizes.append(n)
        keys.append(np.frombuffer(body, np.uint64, n, 8))
        ids.append(np.frombuffer(K.expand(body[8 + 8 * n :]), np.int64))
    k, i = np.concatenate(keys), np.concatenate(ids)
    order = np.lexsort((i, k))
    k, i = k[order], i[order]
    head = np.ones(len(k), dtype=bool)
    head[1:] = k[1:] != k[:-1]
    least = i[np.flatnonzero(head)][np.cumsum(head) - 1]
    hit = np.empty(len(k), dtype=bool)
    hit[order] = least < i
    return [K.pack_bits(x) for x in np.split(hit, np.cumsum(sizes)[:-1])]


def _cut(batches: Iterator[pa.RecordBatch], n_parts: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for _, _, chunk, got in X.rows_of(batches, ("anchors", "windows")):
        c = _Chunk(chunk, n_parts)
        w = c.words
        starts, keys = c.candidates(got["anchors"])
        edge = np.zeros(len(w.hashes) + 1, dtype=np.int64)
        if len(starts):
            ids = chunk.ids[w.doc[starts]]
            gone = X.read_bits(got["windows"], keys.bounds)[keys.group] | (ids > ids[keys.first][keys.group])
            hit = starts[gone]
            edge += np.bincount(hit, minlength=len(edge)) - np.bincount(hit + WINDOW, minlength=len(edge))
        removed = np.cumsum(edge)[:-1] > 0
        kept = np.flatnonzero(~removed)
        lens = w.ends[kept] - w.starts[kept] + 1
        stop = np.cumsum(lens)
        source = np.repeat(w.starts[kept] - (stop - lens), lens) + np.arange(int(stop[-1]) if len(stop) else 0)
        out = np.append(chunk.data, np.uint8(32))[source]
        if len(stop):
            out[stop - 1] = 32
        stop = np.concatenate([[0], stop])
        span = stop[np.searchsorted(kept, w.first)].tolist()
        raw = out.tobytes()
        kept_texts = [raw[a : max(a, b - 1)] for a, b in zip(span[:-1], span[1:])]
        n_removed = np.diff(np.concatenate([[0], np.cumsum(removed)])[w.first])
        columns = {"doc_id": K.ids_out(chunk.ids), "n_words": pa.array(w.counts.astype(np.int64)), "n_removed": pa.array(n_removed.astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in kept_texts], pa.string())}
        if texts:
            columns["kept_text"] = pa.array(kept_texts, pa.binary()).cast(pa.string())
        for batch in pa.table(columns).to_batches(max_chunksize=4096):
            yield batch


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """Per row of df: doc_id, n_words, n_removed, kept_sha256 and, with texts, kept_text (kept words, one space apart)."""
    if texts:  # they are read when asked for, and so is what they are made from
        return _deduped(X.store(df, id_col, text_col), texts)
    with scratch(df.sparkSession):
        held = X.store(df, id_col, text_col)
        out = keep(_deduped(held, texts))
    held.drop()
    return out


def _deduped(held: X.Store, texts: bool) -> DataFrame:
    n_parts = held.parts(PART_BYTES)
    chunks = held.read()

    def send_anchors(chunk: X.Chunk, _: dict) -> Iterator[tuple[int, bytes]]:
        a = _Chunk(chunk, n_parts).anchors
        for p, i, j in a.filled():
            yield p, X.short_keys(a.keys[i:j])

    def send_windows(chunk: X.Chunk, got: dict) -> Iterator[tuple[int, bytes]]:
        c = _Chunk(chunk, n_parts)
        starts, keys = c.candidates(got["anchors"])
        ids = chunk.ids[c.words.doc[starts[keys.first]]] if len(starts) else np.zeros(0, np.int64)
        for p, i, j in keys.filled():
            yield p, (j - i).to_bytes(8, "little") + keys.keys[i:j].tobytes() + K.squeeze(ids[i:j].tobytes())

    anchors = X.ask(chunks, send_anchors, X.seen_twice, (), "anchors", n_parts)
    windows = X.ask(X.with_answers(chunks, anchors), send_windows, _smaller_elsewhere, ("anchors",), "windows", n_parts)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    return X.with_answers(chunks, anchors, windows).mapInArrow(lambda batches: _cut(batches, n_parts, texts), schema)
