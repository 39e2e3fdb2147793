"""op6: exact round trips through the whole-text tokenizer, and best-fit decreasing against a plain version."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.packing import Capacities, best_fit, pack
from tests.llm.corpus import DOCS, awkward, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_best_fit(lengths, window):
    rooms, out = [], []
    for n in lengths:
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms += [min(fits) - n] if min(fits) > n else []
        else:
            rooms += [window - n] if window > n else []
            out.append(1)
    return len(out)


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(1)
    for window in (1, 7, 64, 100):
        for _ in range(30):
            lengths = sorted((rng.randrange(1, window + 1) for _ in range(rng.randrange(0, 60))), reverse=True)
            sequence, offset = best_fit(lengths, window)
            assert len(set(sequence)) == plain_best_fit(lengths, window)
            used = defaultdict(list)
            for s, o, n in zip(sequence, offset, lengths):
                used[s].append((o, n))
            for parts in used.values():
                at = 0
                for o, n in sorted(parts):
                    assert o == at
                    at += n
                assert at <= window


def test_capacities_find_the_least_sufficient_room():
    rng = random.Random(2)
    tree, held = Capacities(50), []
    for k in range(2000):
        if rng.random() < 0.55:
            held.append(rng.randrange(1, 51))
            tree.add(held[-1], k)
        else:
            need = rng.randrange(1, 51)
            fits = [h for h in held if h >= need]
            got = tree.take(need)
            assert (got[0] if got else None) == (min(fits) if fits else None)
            if got:
                held.remove(got[0])


@pytest.fixture(scope="module")
def texts():
    return [*awkward(3), "<|endoftext|> x<|endoftext|>y", "ΑΣ Σ ὈΔΥΣΣΕΎΣ.", "é ́x ﬁ Å b　c\x00d\x1fe\x85f", "don't WE'LL 123abc 4 5", "​﻿  \n"]


def test_every_id_lies_in_one_piece(spark, texts):
    rows = pack(documents(spark, texts), PATH).collect()
    whole = Tokenizer.from_file(PATH)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(range(1, len(texts) + 1))
    for i, t in enumerate(texts, 1):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at <= 2048


def test_words_of_the_tables_give_the_ids_of_whole_texts(spark, sf):
    """The cached encoding of white-space-free runs equals that of the whole text."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = Tokenizer.from_file(PATH)
    sums = {(r.doc_id, r.start): (r.length, r.ids_crc32) for r in pack(docs, PATH).collect()}
    for d in docs.collect():
        ids = np.array([*whole.encode(d.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for a in range(0, len(ids), 2048):
            assert sums[d.doc_id, a] == (min(2048, len(ids) - a), zlib.crc32(ids[a : a + 2048].tobytes()))


def test_padding_is_small(spark, sf):
    rows = pack(spark.read.parquet(f"{sf}/documents.parquet"), PATH).collect()
    tokens, sequences = sum(r.length for r in rows), len({r.sequence_id for r in rows})
    assert sequences <= -(-tokens // 2048) + 1


def test_empty_and_repeated_rows(spark):
    assert pack(spark.createDataFrame([], DOCS), PATH).count() == 0
    same = documents(spark, ["a b", "a b", None], [7, 7, None]).selectExpr("*", "1 as g", "2 as length", "3 as start")
    got = pack(same, PATH).collect()
    assert sorted((repr(r.doc_id), r.length) for r in got) == [("7", 3), ("7", 3), ("None", 1)] and len({(r.sequence_id, r.offset) for r in got}) == 3
