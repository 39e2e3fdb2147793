"""Durations, sizes and labels as people read them.  The texts are fixed values of the surface they must equal."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: unit names and their milliseconds
UNITS = {"s": 1000, "sn": 1000, "m": 60_000, "dk": 60_000, "h": 3_600_000, "sa": 3_600_000, "d": 86_400_000, "g": 86_400_000}
# fixed values: labels of the sources of a snapshot
SOURCES = {"watch": "oto", "agent": "ajan", "manual": "elle", "pre-restore": "geri-al"}

_DURATION = r"(?i)^(\d+)\s*(s|sn|m|dk|h|sa|d|g)$"


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def duration_ms(text: Column) -> Column:
    """Milliseconds of '30m', '2h' or '7d'; null if the text is no duration."""
    clean = F.trim(text)
    unit = F.lower(F.regexp_extract(clean, _DURATION, 2))
    return F.when(clean.rlike(_DURATION), F.regexp_extract(clean, _DURATION, 1).cast("long") * _lookup(UNITS, unit))


def parse_duration(text: str) -> int:
    """The same for one text on the driver; raises ValueError."""
    found = re.match(_DURATION, text.strip())
    if not found:
        raise ValueError(f"not a duration: {text!r}; for example 30m, 2h, 7d")
    return int(found[1]) * UNITS[found[2].lower()]


def relative_time(at: Column, now: Column) -> Column:
    """How long before now (both in epoch seconds), in the largest whole unit, days at most."""
    s = F.greatest(now - at, F.lit(0)).cast("long")
    m, h = F.floor(s / 60), F.floor(s / 3600)
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} önce"))
    return F.when(s < 60, say(s, "sn")).when(m < 60, say(m, "dk")).when(h < 24, say(h, "sa")).otherwise(say(F.floor(h / 24), "g"))


def size_text(kib: Column) -> Column:
    return F.when(kib < 1024, F.concat(kib.cast("string"), F.lit(" KiB"))).otherwise(F.concat(F.format_string("%.1f", kib / F.lit(1024.0)), F.lit(" MiB")))


def source_label(source: Column) -> Column:
    return F.coalesce(_lookup(SOURCES, source), source)


def status_size_kib(text: Column) -> Column:
    """The sum of the `size` and `size-pack` lines of a repository's status text, in KiB."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^(?:size|size-pack): (\d+)$"), F.lit(1))
    return F.aggregate(F.transform(found, lambda n: n.cast("long")), F.lit(0).cast("long"), lambda total, n: total + n)
