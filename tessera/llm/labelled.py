"""The bounded sample of labelled rows that the classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 20_000


def training_rows(docs: DataFrame, labels: DataFrame, label: str, where: Column | None = None, rows: int = TRAIN_ROWS, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """(y, *columns) of at most `rows` labelled documents, those with the least hash of their id.

    An id with several labels takes the greatest; null labels and null ids take no part.  The sampled ids (16 bytes
    each, `rows` of them at most) are broadcast: their size is bounded by the parameter.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("train_id"), F.col(label).cast("int").alias("y")).where("train_id is not null and y is not null")
    if where is not None:
        known = known.where(where)
    some = known.groupBy("train_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("train_id"), "train_id").limit(rows)
    keep = docs.select(F.col("doc_id").cast("long").alias("train_id"), *(F.col(c).cast("string").alias(c) for c in columns))
    return keep.join(F.broadcast(some), "train_id").select("y", *columns)
