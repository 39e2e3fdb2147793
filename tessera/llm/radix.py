"""Removal of byte runs of 100 or more that occur earlier, by a depth-limited most-significant-digit radix sort.

The suffixes of all texts are ordered through their first 100 bytes only; groups that are still equal then are
exactly the repeated 100-byte windows.  Digits go from coarse to fine:

1. the window's minimiser, the 36-byte gram with the least hash in it, a function of the window's bytes alone;
   consecutive windows share it, so one entry stands for some thirty suffixes;
2. the byte context of that gram, as a whole: most groups end here, all equal or alone;
3. for the rest, the window's bytes eight at a time, dropping groups of one after each pass.

A gram may occur in a third of all texts, each time in another context.  A gram that more than HOT chunks hold, or
that has more than HOT runs in one chunk, is therefore ordered by the whole window at once: its windows are dealt out
by their own hashes, one entry per chunk and distinct window, so that no group grows with the texts that hold a gram.

A suffix alone in its group at any digit is unique and goes no further.  Within a group the window that starts first
(smaller id, then smaller start) stays.  Rows with equal ids and equal starts don't remove each other.  Null and
empty texts have no bytes; rows without an id count as one document above all others.
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

DEPTH, GRAM, HOT = 100, 36, 64
SPAN = DEPTH - GRAM + 1
TILE = 1 << 17
PART_BYTES = 8 << 20
_LOW = K.U((1 << 18) - 1)


def minimisers(data: np.ndarray, offs: np.ndarray, depth: int = DEPTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimiser: its hash and place, the first and the last window start."""
    n, span = len(data), depth - gram + 1
    valid = np.ones(n, dtype=bool)
    for back in range(1, depth):
        valid[np.maximum(offs[1:] - back, offs[:-1])[offs[1:] > offs[:-1]]] = False
    place = np.zeros(0, np.int64)
    out: list[tuple[np.ndarray, ...]] = []
    for a in range(0, max(0, n - depth + 1), TILE):
        b = min(a + TILE, n - depth + 1)
        sums, down = K.prefix(data[a : b + depth - 1])
        m = b - a + span - 1
        h = K.mix((sums[gram : gram + m] - sums[:m]) * down[:m])
        low = (h & ~_LOW) | np.arange(m, dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        starts = np.flatnonzero(valid[a:b])
        if not len(starts):
            continue
        place = (low[starts] & _LOW).astype(np.int64)
        cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(starts) != 1)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(place)]]) - 1
        out.append((h[place[first]], place[first] + a, starts[first] + a, starts[last] + a))
    if not out:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


class _Chunk:
    def __init__(self, chunk: X.Chunk, n_parts: int) -> None:
        self.chunk, self.n_parts = chunk, n_parts
        self.key, self.place, self.first, self.last = minimisers(chunk.data, chunk.offs)
        self.grams = X.KeySet(self.key, n_parts)

    def choose(self, answers: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Runs whose gram occurs again, and those whose gram is hot."""
        g = self.grams
        again, hot = _read_states(answers, g.bounds)
        again |= g.first != g.final
        none = np.zeros(0, np.int64)
        return (np.flatnonzero((again & ~hot)[g.group]), np.flatnonzero(hot[g.group])) if len(g.keys) else (none, none)

    def owner(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document id and start in the document of a place in the chunk."""
        doc = np.searchsorted(self.chunk.offs, start, side="right") - 1
        return self.chunk.ids[doc], start - self.chunk.offs[doc]

    def contexts(self, runs: np.ndarray) -> tuple[np.ndarray, X.KeySet, np.ndarray, np.ndarray]:
        """The runs by id and start, their contexts' keys, and the id and start of each run in its document."""
        first, stop = self.first[runs], self.last[runs] + DEPTH
        shape = ((self.place[runs] - first) << 20 | (stop - first)).astype(np.uint64)
        whole = K.mix(K.span_hashes(self.chunk.data, first, stop) + K.mix(shape, 5), 3)
        ids, at = self.owner(first)
        order = np.lexsort((at, ids))
        runs, whole, ids, at = runs[order], whole[order], ids[order], at[order]
        keys = _Contexts(whole, self.key[runs], self.n_parts)
        return runs, keys, ids, at

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, X.KeySet, np.ndarray, np.ndarray]:
        """The starts of the runs' windows by id and start, their keys, and their ids and starts in the documents."""
        count = self.last[runs] - self.first[runs] + 1
        start = np.repeat(self.first[runs] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        ids, at = self.owner(start)
        key = K.mix(K.span_hashes(self.chunk.data, start, start + DEPTH), 11)
        order = np.lexsort((at, ids))
        return start[order], X.KeySet(key[order], self.n_parts), ids[order], at[order]


def _read_states(answers: list[tuple[int, bytes]], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = lambda body: len(body) // 2
    return X.read_bits([(p, b[: half(b)]) for p, b in answers], bounds), X.read_bits([(p, b[half(b) :]) for p, b in answers], bounds)


def gram_states(bodies: list[bytes], hot: int) -> list[bytes]:
    """Two masks for each message (4 bytes n, n flags, n short keys): keys of several messages, and hot keys."""
    sizes = [int.from_bytes(b[:4], "little") for b in bodies]
    flags = np.concatenate([K.unpack_bits(b[4 : 4 + -(-n // 8)], n) for b, n in zip(bodies, sizes)])
    keys = np.zeros((sum(sizes), 8), dtype=np.uint8)
    keys[:, :5] = np.frombuffer(b"".join(b[4 + -(-n // 8) :] for b, n in zip(bodies, sizes)), dtype=np.uint8).reshape(-1, 5)
    flat = keys.view(np.uint64).ravel()
    order = np.argsort(flat)
    s = flat[order]
    number = np.cumsum(np.concatenate([[False], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    times = np.bincount(number)
    busy = (times > hot) | (np.bincount(number, weights=flags[order]) > 0)
    again, much = np.empty(len(s), dtype=bool), np.empty(len(s), dtype=bool)
    again[order], much[order] = times[number] > 1, busy[number]
    cuts = np.cumsum(sizes)[:-1]
    return [K.pack_bits(a) + K.pack_bits(m) for a, m in zip(np.split(again, cuts), np.split(much, cuts))]


def earlier_keys(bodies: list[bytes]) -> list[bytes]:
    """For each window key of each message: does another message hold it with an earlier id and start?"""
    keys, ids, at, sizes = [], [], [], []
    for body in bodies:
        n = int.from_bytes(body[:8], "little")
        sizes.append(n)
        keys.append(np.frombuffer(body, np.uint64, n, 8))
        rest = np.frombuffer(K.expand(body[8 + 8 * n :]), np.int64).reshape(2, n)
        ids.append(rest[0])
        at.append(rest[1])
    k, i, a = np.concatenate(keys), np.concatenate(ids), np.concatenate(at)
    order = np.lexsort((a, i, k))
    k, i, a = k[order], i[order], a[order]
    head = np.ones(len(k), dtype=bool)
    head[1:] = k[1:] != k[:-1]
    f = np.flatnonzero(head)[np.cumsum(head) - 1]
    hit = np.empty(len(k), dtype=bool)
    hit[order] = (i > i[f]) | ((i == i[f]) & (a > a[f]))
    return [K.pack_bits(x) for x in np.split(hit, np.cumsum(sizes)[:-1])]


class _Contexts(X.KeySet):
    """Contexts grouped by their own key, but dealt out by their gram's."""

    def __init__(self, whole: np.ndarray, gram: np.ndarray, n_parts: int) -> None:
        part = ((K.mix(gram, 77) >> K.U(32)) * K.U(n_parts) >> K.U(32)).astype(np.int64)
        self.order = np.lexsort((whole, gram, part))
        k, g, p = whole[self.order], gram[self.order], part[self.order]
        head = np.ones(len(k), dtype=bool)
        head[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
        self.heads = np.flatnonzero(head)
        self.group = np.empty(len(k), dtype=np.int64)
        self.group[self.order] = np.cumsum(head) - 1
        self.keys = k[self.heads]
        self.bounds = X.split_parts(p[self.heads], n_parts)
        self.first = self.order[self.heads]


_FIELDS = (("gram", np.uint64), ("id", np.int64), ("at", np.int64), ("shift", np.uint8), ("windows", np.uint8))


def _gather_spans(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    stop = np.cumsum(lens)
    return data[np.repeat(starts - (stop - lens), lens) + np.arange(int(stop[-1]) if len(stop) else 0)]


def _message(fields: list[np.ndarray], text: np.ndarray) -> bytes:
    return K.squeeze(len(fields[0]).to_bytes(8, "little") + b"".join(f.astype(t).tobytes() for f, (_, t) in zip(fields, _FIELDS)) + text.tobytes())


def _parse(body: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    raw = K.expand(body)
    n, at, fields = int.from_bytes(raw[:8], "little"), 8, []
    for _, t in _FIELDS:
        fields.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return fields, np.frombuffer(raw, np.uint8, -1, at)


def _tiles(lens: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive entries that are TILE bytes together (one at least), so that hashing takes bounded memory."""
    ends, i = np.cumsum(lens), 0
    while i < len(lens):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + TILE, side="right")))
        yield i, j
        i = j


def _refine(group: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass: the groups split by the digit, and which rows are still in a group of two or more."""
    order = np.lexsort((digit, group))
    g, d = group[order], digit[order]
    head = np.ones(len(g), dtype=bool)
    head[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    number = np.cumsum(head) - 1
    out, alive = np.empty_like(group), np.empty(len(group), dtype=bool)
    out[order] = number
    alive[order] = np.bincount(number)[number] > 1 if len(number) else False
    return out, alive


def earlier_windows(bodies: list[bytes]) -> list[bytes]:
    """For each context of each message a bit per window: does it start earlier in any context of this partition?"""
    parsed = [_parse(x) for x in bodies]
    counts = [len(p[0][0]) for p in parsed]
    gram, ids, at, shift, windows = (np.concatenate([p[0][k] for p in parsed]) for k in range(len(_FIELDS)))
    text = np.concatenate([*(p[1] for p in parsed), np.zeros(8, np.uint8)])
    del parsed
    shift, windows = shift.astype(np.int64), windows.astype(np.int64)
    lens = windows + DEPTH - 1
    begin = np.cumsum(lens) - lens
    hit_from = np.cumsum(windows) - windows
    hit = np.zeros(int(windows.sum()), dtype=bool)
    # whole contexts: of equal ones only the first goes on
    whole = K.mix((shift << 20 | lens).astype(np.uint64), 5)
    for i, j in _tiles(lens):
        sums, down = K.prefix(text[begin[i] : begin[j - 1] + lens[j - 1]])
        b = begin[i:j] - begin[i]
        whole[i:j] = K.mix((sums[b + lens[i:j]] - sums[b]) * down[b] + whole[i:j], 3)
    order = np.lexsort((at, ids, whole, gram))
    g, w = gram[order], whole[order]
    head = np.ones(len(g), dtype=bool)
    head[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
    lead = order[np.flatnonzero(head)]
    owner = np.empty(len(g), dtype=np.int64)
    owner[order] = lead[np.cumsum(head) - 1]
    later = (ids > ids[owner]) | ((ids == ids[owner]) & (at > at[owner]))
    # contexts that share a gram and differ: their windows, by bytes
    alone = np.ones(len(lead), dtype=bool)
    lg = gram[lead]
    alone[1:] &= lg[1:] != lg[:-1]
    alone[:-1] &= lg[1:] != lg[:-1]
    rest = lead[~alone]
    step, limit = 0, 1 << 19
    cuts = np.concatenate([[0], np.flatnonzero(gram[rest][1:] != gram[rest][:-1]) + 1, [len(rest)]])
    load = np.concatenate([[0], np.cumsum(windows[rest])])
    while step < len(cuts) - 1:
        stop = max(step + 1, int(np.searchsorted(load[cuts], load[cuts[step]] + limit, side="right")) - 1)
        some = rest[cuts[step] : cuts[stop]]
        step = stop
        c = np.repeat(some, windows[some])
        k = np.arange(len(c)) - np.repeat(np.cumsum(windows[some]) - windows[some], windows[some])
        group, _ = _refine(gram[c], (k - shift[c] + 256).astype(np.uint64))
        live = np.arange(len(c))
        for d in range(0, DEPTH, 8):
            src = begin[c[live]] + k[live] + min(d, DEPTH - 8)
            digit = np.zeros(len(live), dtype=np.uint64)
            for t in range(8):
                digit = digit << K.U(8) | text[src + t].astype(np.uint64)
            g2, alive = _refine(group[live], digit)
            group[live] = g2
            live = live[alive]
            if not len(live):
                break
        if len(live):
            i, a, g3 = ids[c[live]], at[c[live]] + k[live], group[live]
            o = np.lexsort((a, i, g3))
            head = np.ones(len(o), dtype=bool)
            head[1:] = g3[o][1:] != g3[o][:-1]
            f = o[np.flatnonzero(head)][np.cumsum(head) - 1]
            gone = (i[o] > i[f]) | ((i[o] == i[f]) & (a[o] > a[f]))
            x = live[o[gone]]
            hit[hit_from[c[x]] + k[x]] = True
    out, pos = [], 0
    # a context equal to an earlier one: all its windows; the first of its kind may itself have earlier windows
    hit |= np.repeat(later, windows)
    for n in counts:
        a = hit_from[pos] if n else 0
        b = hit_from[pos + n - 1] + windows[pos + n - 1] if n else 0
        out.append(K.pack_bits(hit[a:b]))
        pos += n
    return out


def _covered(starts: list[np.ndarray], n: int) -> np.ndarray:
    """The bytes of n that lie in a window from one of the starts on."""
    flag = np.zeros(n, dtype=bool)
    for s in starts:
        flag[s] = True
    before = np.zeros(n + 1, dtype=np.int32)
    np.cumsum(flag, out=before[1:])
    out = before[1:] > 0
    out[DEPTH:] = before[DEPTH + 1 :] > before[1 : n + 1 - DEPTH]
    return out


def _cut(batches: Iterator[pa.RecordBatch], n_parts: int, texts: bool, carry: int = 0) -> Iterator[pa.RecordBatch]:
    for _, _, chunk, got in X.rows_of(batches, ("grams", "contexts")):
        c = _Chunk(chunk, n_parts)
        n = len(chunk.data)
        later_starts = []
        some, hot = c.choose(got["grams"])
        if len(hot):
            start, keys, ids, at = c.windows(hot)
            f = keys.first[keys.group]
            gone = (ids > ids[f]) | ((ids == ids[f]) & (at > at[f])) | X.read_bits([(p - n_parts, b) for p, b in got["contexts"] if p >= n_parts], keys.bounds)[keys.group]
            later_starts.append(start[gone])
        if len(some):
            runs, keys, ids, at = c.contexts(some)
            windows = c.last[runs] - c.first[runs] + 1
            head_windows = windows[keys.first]
            bit_from = np.concatenate([[0], np.cumsum(head_windows)])
            bits = X.read_bits([(p, b) for p, b in got["contexts"] if p < n_parts], bit_from[keys.bounds])
            f = keys.first[keys.group]
            later = (ids > ids[f]) | ((ids == ids[f]) & (at > at[f]))
            r = np.repeat(np.arange(len(runs)), windows)
            k = np.arange(len(r)) - np.repeat(np.cumsum(windows) - windows, windows)
            gone = later[r] | bits[bit_from[keys.group[r]] + k]
            later_starts.append(c.first[runs][r[gone]] + k[gone])
        removed = _covered(later_starts, n)
        begins = removed.copy()
        begins[1:] &= ~removed[:-1]
        starts = chunk.offs[:-1][np.diff(chunk.offs) > 0]
        begins[starts] = removed[starts]
        n_removed, n_spans = K.counts_by(removed, chunk.offs), K.counts_by(begins, chunk.offs)
        lens = np.diff(chunk.offs)
        kept = chunk.data[~removed].tobytes()
        stop = np.concatenate([[0], np.cumsum(lens - n_removed)]).tolist()
        pieces = [kept[a:b] for a, b in zip(stop[:-1], stop[1:])]
        columns = {"doc_id": K.ids_out(chunk.ids), "n_bytes": pa.array(lens.astype(np.int64)), "n_removed": pa.array(n_removed), "n_spans": pa.array(n_spans), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in pieces], pa.string())}
        if texts:
            columns["kept_text"] = pa.array([t.decode("utf-8", "ignore") for t in pieces], pa.string())
        if carry:
            columns |= {f"c{k}": chunk.carried().column(k) for k in range(carry)}
        for batch in pa.table(columns).to_batches(max_chunksize=512):
            yield batch


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True, carry: list[str] | None = None, hot: int = HOT) -> DataFrame:
    """Per row of df: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with texts, kept_text; then the columns of `carry` as c0, c1...

    A removed run may begin or end inside a character; kept_text leaves out what is left of such a character.
    """
    fields = "".join(f", c{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(carry or []))
    if texts or carry:  # they are read when asked for, and so is what they are made from
        return _deduped(X.store(df, id_col, text_col, carry), texts, len(carry or []), fields, hot)
    with scratch(df.sparkSession):
        held = X.store(df, id_col, text_col)
        out = keep(_deduped(held, texts, 0, fields, hot))
    held.drop()
    return out


def _deduped(held: X.Store, texts: bool, n_carried: int, fields: str, hot: int) -> DataFrame:
    n_parts = held.parts(PART_BYTES)
    chunks = held.read()

    def send_grams(chunk: X.Chunk, _: dict) -> Iterator[tuple[int, bytes]]:
        g = _Chunk(chunk, n_parts).grams
        many = np.bincount(g.group, minlength=len(g.keys)) > hot
        for p, i, j in g.filled():
            yield p, (j - i).to_bytes(4, "little") + K.pack_bits(many[i:j]) + X.short_keys(g.keys[i:j])

    def send_contexts(chunk: X.Chunk, got: dict) -> Iterator[tuple[int, bytes]]:
        c = _Chunk(chunk, n_parts)
        some, busy = c.choose(got["grams"])
        if len(busy):
            _, keys, ids, at = c.windows(busy)
            for p, i, j in keys.filled():
                h = keys.first[i:j]
                yield n_parts + p, b"w" + (j - i).to_bytes(8, "little") + keys.keys[i:j].tobytes() + K.squeeze(ids[h].tobytes() + at[h].tobytes())
        runs, keys, ids, at = c.contexts(some)
        for p, i, j in keys.filled():
            h = keys.first[i:j]
            r = runs[h]
            windows = c.last[r] - c.first[r] + 1
            yield p, b"c" + _message([c.key[r], ids[h], at[h], c.place[r] - c.first[r], windows], _gather_spans(chunk.data, c.first[r], windows + DEPTH - 1))

    def compare(bodies: list[bytes]) -> list[bytes]:
        return (earlier_keys if bodies[0][:1] == b"w" else earlier_windows)([b[1:] for b in bodies])

    grams = X.ask(chunks, send_grams, lambda bodies: gram_states(bodies, hot), (), "grams", n_parts)
    contexts = X.ask(X.with_answers(chunks, grams), send_contexts, compare, ("grams",), "contexts", n_parts, kinds=2)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * texts + fields
    whole = X.with_answers(held.read(carried=n_carried > 0), grams, contexts)
    return whole.mapInArrow(lambda batches: _cut(batches, n_parts, texts, n_carried), schema)
