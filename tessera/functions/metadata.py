"""Snapshot metadata in messages: one readable line, a marker, and JSON; unreadable messages give a fallback."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

META = "v int, label string, source string, agent string, turn string, branch string, head string"
MARKER = "tessera-meta:"
SUBJECT_LIMIT = 200


def encode(meta: Column) -> Column:
    label = F.when(F.coalesce(meta["label"], F.lit("")) == "", "snapshot").otherwise(meta["label"])
    subject = F.regexp_replace(F.concat(F.lit("tessera("), meta["source"], F.lit("): "), label), r"\s+", " ")
    return F.concat(F.substring(subject, 1, SUBJECT_LIMIT), F.lit(f"\n\n{MARKER} "), F.to_json(meta), F.lit("\n"))


def decode(message: Column, marker: str = MARKER) -> Column:
    """The metadata after the first marker, or else the first line as the label of a manual snapshot."""
    at = F.instr(message, marker)
    json = F.trim(F.when(at > 0, F.substr(message, at + len(marker))))
    parsed = F.from_json(json, META)
    fallback = F.struct(
        F.lit(1).alias("v"), F.get(F.split(message, "\n", 2), F.lit(0)).alias("label"), F.lit("manual").alias("source"), F.lit(None).cast("string").alias("agent"),
        F.lit(None).cast("string").alias("turn"), F.lit("unknown").alias("branch"), F.lit(None).cast("string").alias("head"),
    )
    readable = json.isNotNull() & F.get_json_object(json, "$").startswith("{")
    return F.when(readable, parsed).otherwise(fallback)
