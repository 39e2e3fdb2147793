"""Small corpora with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None):
    """Rows of documents with the given texts."""
    ids = range(1, len(texts) + 1) if ids is None else ids
    rows = [(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(seed=0):
    """Texts with shared passages, copies, near copies, odd spacing and bytes."""
    rng = random.Random(seed)
    passage = words(rng, 40)
    base = words(rng, 120, 100_000)
    out = [None, "", "   ", "one", "one", "a b c d", "A b C d", "é" * 150, "é" * 150, "\U0001F600" * 60, passage, passage, f"x {passage} y", f"{passage}\t\n{passage}", base, base + " tail", base.upper()]
    for k in range(12):
        parts = base.split()
        for _ in range(k // 2):
            parts[rng.randrange(len(parts))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(parts))
    for _ in range(25):
        out.append(" ".join([words(rng, rng.randrange(0, 60)), passage if rng.random() < 0.3 else "", words(rng, rng.randrange(0, 30))]))
    out += ["ab" * 300, "ab" * 299 + "c", "x" * 99, "x" * 100, "x" * 250, "long " * 30_000]
    return out


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
