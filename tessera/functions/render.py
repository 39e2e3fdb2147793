"""Result rows as the lines of text that the tools print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import display as D
from tessera.functions import text as T


def _place() -> Column:
    return F.concat("file", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))


def summary(prefix: str = "") -> Column:
    """A snapshot in one line: short id, time, source, label."""
    c = lambda name: F.col(f"{prefix}{name}")
    at = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(c("ts")), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.concat(c("short"), F.lit(" "), at, F.lit(" ["), c("source"), F.lit("] "), c("label"))


def hit() -> Column:
    doc = F.when(F.coalesce("doc", F.lit("")) != "", F.concat(F.lit("\n   "), "doc")).otherwise("")
    return F.concat(_place(), F.lit(" "), T.qualified(F.col("parent"), F.col("name")), F.lit(" ["), "kind", F.lit("] ("), F.array_join("why", "+"), F.lit(")\n   "), "signature", doc)


def outline_row() -> Column:
    lines = F.concat(F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    return F.concat(lines, F.when(F.col("exported"), F.lit(" export ")).otherwise(F.lit(" ")), "kind", F.lit(" "), T.qualified(F.col("parent"), F.col("name")), F.lit(" — "), "signature")


def reference() -> Column:
    inside = F.when(F.col("symbol").isNotNull(), F.concat(F.lit(" ("), "symbol", F.lit(")"))).otherwise("")
    return F.concat("file", F.lit(":"), F.col("line").cast("string"), inside, F.lit("  "), "text")


def log_row(now: Column) -> Column:
    agent = F.when(F.col("agent").isNotNull(), F.concat(F.lit(" <"), "agent", F.lit(">"))).otherwise("")
    source = F.rpad(F.concat(F.lit("["), D.source_label(F.col("source")), F.lit("]")), 9, " ")
    return F.concat("short", F.lit(" "), F.lpad(D.relative_time(F.col("ts"), now), 9, " "), F.lit(" "), source, F.lit(" "), F.lpad(F.col("files").cast("string"), 3, " "), F.lit(" dosya  "), "label", agent)


def lines(rows: DataFrame, line: Column) -> str:
    """The rows, in their order, one after the other; for results that a limit bounds."""
    return "\n".join(r.line for r in rows.select(line.alias("line")).collect())


def change() -> Column:
    return F.concat("status", F.lit(" "), "path")


def bisected(found) -> str:
    """What a bisect found, with the first files of the first bad snapshot."""
    if found.first_bad is None:
        return found.reason or "nothing found"
    bad = found.first_bad
    said = [f"first bad: {bad.short} [{bad.source}] {bad.label}".rstrip(), *(f"    {r.status} {r.path}" for r in found.changed)]
    if found.last_good is not None:
        said.append(f"last good: {found.last_good.short}; restore {found.last_good.short} goes back to it")
    elif found.reason:
        said.append(found.reason)
    return "\n".join([*said, f"{found.tested} of {found.candidates} snapshots tested"])


def status(state: dict) -> str:
    kib = state["size_kib"]
    size = f"{kib} KiB" if kib < 1024 else f"{kib / 1024:.1f} MiB"
    watched = f"watched by process {state['watching']}" if state["watching"] else "not watched"
    return f"{state['snapshots']} snapshots, {size}, {watched}"
