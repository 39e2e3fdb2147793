"""Packing of whole documents into fixed windows by best-fit decreasing.

A document is its token ids and an end id.  Overlong documents are first cut into full windows; what remains of each
is packed, longest first, into the open window with the least sufficient room, found by a segment tree over the
remaining capacities.  Pieces are dealt to groups of GROUP_PIECES by a hash of document and start; a group is packed in one task and numbers its
sequences in a range of its own, so nothing but lengths is shuffled and no task grows with the input.

Null texts are empty documents: one end id.  Repeated ids are packed like any other row.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.staging import small_batches, stage

WINDOW, GROUP_PIECES, CACHE, PIECES = 2048, 8192, 1_000_000, 250_000


class WordIds:
    """Ids of runs without ASCII white space.

    The tokenizer never lets a token span white space (its split drops it, its normaliser only maps it to a space),
    so a text's ids are those of its runs, one after the other.  Known runs are rows of arrays, found by a 64-bit hash
    and copied out for a whole group of texts at once.  New runs of Latin letters, digits and signs are put together
    from the pieces of the tokenizer's own split, which few new runs add to; new pieces are encoded many at a time,
    told apart by the tokens that end a word.  Other runs are encoded whole, told apart by a special token.
    """

    #: fixed value: the tokenizer's split
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: characters that are normalised already, whose lower case is one character, and that are no white space
    PLAIN = "[!-~\u00a1-\u012f\u0131-\u017f]+"
    SPECIAL, BATCH = "<|startoftext|>", 4096

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split, self.plain = regex.compile(self.SPLIT).findall, regex.compile(self.PLAIN).fullmatch
        self.special = self.tokenizer.token_to_id(self.SPECIAL)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        self.keys, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, "<u4"), 0

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a group of texts, one after the other, and where each text's begin."""
        w = K.Words(data, offs)
        runs, at, back = np.unique(w.hashes, return_index=True, return_inverse=True)
        row = self._rows(runs)
        new = np.flatnonzero(row < 0)
        if len(new):
            if len(self.keys) + len(new) > CACHE:
                self.forget()
                new = np.arange(len(runs))
            raw = data.tobytes()
            with _no_collector():
                self._add(runs[new], self.learn([raw[i:j] for i, j in zip(w.starts[at[new]].tolist(), w.ends[at[new]].tolist())]))
            row = self._rows(runs)
        start, size = self.start[row][back].astype(np.int64), self.size[row][back]
        stop = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(start - stop[:-1], size) + np.arange(stop[-1])]
        return ids, stop[w.first]

    def _rows(self, runs: np.ndarray) -> np.ndarray:
        """The row of each run, -1 for new ones."""
        if not len(self.keys):
            return np.full(len(runs), -1)
        row = np.minimum(np.searchsorted(self.keys, runs), len(self.keys) - 1)
        return np.where(self.keys[row] == runs, row, -1)

    def _add(self, runs: np.ndarray, encoded: list[bytes]) -> None:
        ids = np.frombuffer(b"".join(encoded), dtype="<u4")
        size = np.array([len(e) // 4 for e in encoded], dtype=np.int32)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(ids), self.used) + (1 << 16), "<u4")])
        self.pool[self.used : self.used + len(ids)] = ids
        where = np.searchsorted(self.keys, runs)
        self.start = np.insert(self.start, where, (self.used + np.cumsum(size) - size).astype(np.int32))
        self.size, self.keys = np.insert(self.size, where, size), np.insert(self.keys, where, runs)
        self.used += len(ids)

    def learn(self, runs: list[bytes]) -> list[bytes]:
        """The ids of each run, as little-endian 32-bit bytes."""
        parts: list[list[str] | None] = []
        other: list[str] = []
        for run in runs:
            text = run.decode()
            if self.plain(text) and "<|" not in text:
                parts.append(self.split(text.lower()))
            else:
                parts.append(None)
                other.append(text)
        new = {p for pieces in parts if pieces for p in pieces}
        if len(self.known) + len(new) > PIECES:
            self.known.clear()
        new = list(new.difference(self.known))
        for i in range(0, len(new), self.BATCH):
            some = new[i : i + self.BATCH]
            ids = self.ids(" ".join(some))
            self.known.update(zip(some, self.cut(some, ids, np.flatnonzero(self.ends_word[ids]) + 1, 0)))
        rest: list[bytes] = []
        for i in range(0, len(other), self.BATCH):
            some = other[i : i + self.BATCH]
            ids = self.ids("".join(t + self.SPECIAL for t in some))
            rest += self.cut(some, ids, np.flatnonzero(ids == self.special) + 1, 1)
        known, others = self.known.__getitem__, iter(rest)
        return [next(others) if p is None else known(p[0]) if len(p) == 1 else b"".join(map(known, p)) for p in parts]

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def cut(self, texts: list[str], ids: np.ndarray, stops: np.ndarray, drop: int) -> list[bytes]:
        """The ids of each text, which end `drop` ids before each stop; one by one if the stops don't fit the texts."""
        if len(stops) != len(texts):
            return [self.ids(t).tobytes() for t in texts]
        raw, ends = ids.tobytes(), stops.tolist()
        return [raw[4 * i : 4 * (j - drop)] for i, j in zip([0, *ends], ends)]


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The tokenizer with its runs (CACHE at most, some 30 bytes each), kept from task to task of a worker."""
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


@contextmanager
def _no_collector() -> Iterator[None]:
    """Millions of bytes objects without cycles: searching them for cycles would take most of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece, and its row (unique per document row)."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        words.known.clear()  # pieces are kept during a task only: PIECES at most, some 200 bytes each
        for batch in K.released(batches):
            raw, offs = K.column_bytes(batch.column(1))
            ids = K.column_ids(batch.column(0))
            for some, data, o in K.groups(ids, raw, offs):
                got, edges = words.encode(data, o)
                body, e = got.tobytes(), (4 * edges).tolist()
                rows: list[tuple[int, int, int, int, int]] = []
                for doc, i, j in zip(some.tolist(), e[:-1], e[1:]):
                    text = body[i:j] + end
                    n = len(text) // 4
                    rows += [(doc, a, min(window, n - a), zlib.crc32(text[4 * a : 4 * (a + window)]), n) for a in range(0, n, window)]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([K.ids_out(np.array(cols[0], dtype=np.int64)), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        words.known.clear()
        K.release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


class Capacities:
    """A segment tree over 0..window: the open windows of each remaining capacity, and the tightest that fits."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, sequence) with the least room >= need."""
        count, i = self.count, need + self.size
        while not count[i]:
            while i & 1:  # a right child: its sibling is to the left
                i >>= 1
            if i == 0:
                return None
            i += 1
            if i & (i - 1) == 0:  # wrapped to the next level: nothing to the right
                return None
        while i < self.size:
            i <<= 1
            if not count[i]:
                i += 1
        room = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return room, self.open[room].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Sequence and offset of each length; lengths come in decreasing order."""
    tree, fresh, sequence, offset = Capacities(window), 0, [], []
    for n in lengths:
        got = tree.take(n) if n < window else None
        if got is None:
            got, fresh = (window, fresh), fresh + 1
        room, s = got
        sequence.append(s)
        offset.append(window - room)
        if room > n:
            tree.add(room - n, s)
    return sequence, offset


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = stage(pieces(docs, tokenizer, id_col, text_col, window), "pieces")
    n_groups = max(1, -(-cut.count() // GROUP_PIECES))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        sequence, offset = best_fit(rows["length"].astype(int).tolist(), window)
        rows["sequence_id"], rows["offset"] = np.array(sequence, dtype=np.int64) + (int(key[0]) << 32), np.array(offset, dtype=np.int64)
        return rows.drop(columns="g")

    dealt = cut.withColumn("g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n_groups)))
    dealt = dealt.withColumn("doc_id", F.coalesce("doc_id", F.lit(K.NO_ID)))
    out = dealt.groupBy("g").applyInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != K.NO_ID, F.col("doc_id")))
