"""The first failing version by binary search: over verdicts that are a column, or by probing one version at a time."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT, CHANGED = 200, 20

TOO_FEW, ALL_GOOD, ALL_BAD = "at least two snapshots are needed", "the newest snapshot passes", "the oldest snapshot of the chain fails"


@dataclass
class Found:
    first_bad: Any = None
    last_good: Any = None
    tested: int = 0
    candidates: int = 0
    reason: str | None = None
    steps: list[tuple[Any, bool]] = field(default_factory=list)
    changed: list[Any] = field(default_factory=list)  # files of the first bad version against its parent, CHANGED at most


def bisect(chain: Sequence[Any], probe: Callable[[Any], bool], on_step: Callable[[Any, bool, int, int], None] | None = None) -> Found:
    """Probe newest, oldest, then the middle of what is between a good and a bad version; chain runs oldest to newest."""
    out = Found(candidates=len(chain))

    def good(i: int) -> bool:
        verdict = bool(probe(chain[i]))
        out.tested += 1
        out.steps.append((chain[i], verdict))
        if on_step:
            on_step(chain[i], verdict, out.tested, len(chain))
        return verdict

    low, high = 0, len(chain) - 1
    if len(chain) < 2:
        out.reason = TOO_FEW
    elif good(high):
        out.last_good, out.reason = chain[high], ALL_GOOD
    elif not good(low):
        out.first_bad, out.reason = chain[low], ALL_BAD
    else:
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if good(middle) else (low, middle)
        out.first_bad, out.last_good = chain[high], chain[low]
    return out


def command_probe(command: Sequence[str], folder: str, timeout_s: float | None = 300) -> bool:
    """Whether the command ends with 0 in the folder; an empty, missing or killed command is a failure."""
    if not command:
        return False
    try:
        return subprocess.run(list(command), cwd=folder, timeout=timeout_s, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, check=False).returncode == 0
    except (OSError, subprocess.TimeoutExpired):
        return False


def bisect_verdicts(versions: DataFrame, key: str = "repo", order: str = "seq", good: str = "good", limit: int = LIMIT) -> DataFrame:
    """The same search for every key at once, on versions(key, order, good): first_bad, last_good, tested, candidates.

    Verdicts need not be monotone: the answer is the boundary that the search meets.  A key's newest `limit` versions
    are its chain, so the array that is folded is bounded whatever a key's history is.
    """
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    chains = versions.withColumn("_n", nth).where(F.col("_n") <= limit).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col(good).alias("good")))).alias("c"))
    n = F.size("c")
    start = F.struct(F.lit(0).alias("low"), (n - 1).alias("high"), F.lit(2).alias("tested"))

    def step(s: F.Column, _: F.Column) -> F.Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        passes = F.get(F.col("c"), middle)["good"]
        on = F.struct(F.when(passes, middle).otherwise(s["low"]).alias("low"), F.when(passes, s["high"]).otherwise(middle).alias("high"), (s["tested"] + 1).alias("tested"))
        return F.when(s["high"] - s["low"] > 1, on).otherwise(s)

    rounds = F.sequence(F.lit(1), F.lit(max(1, limit.bit_length())))
    met = F.aggregate(rounds, start, step)
    place = lambda i: F.get(F.col("c"), i)["at"]
    first, last = F.get(F.col("c"), F.lit(0)), F.get(F.col("c"), n - 1)
    none = F.lit(None).cast(versions.schema[order].dataType)
    few, fine, broken = n < 2, last["good"], ~first["good"]
    rows = chains.withColumn("m", met)
    return rows.select(
        key, F.when(few | fine, none).when(broken, first["at"]).otherwise(place(F.col("m.high"))).alias("first_bad"), F.when(few, none).when(fine, last["at"]).when(broken, none).otherwise(place(F.col("m.low"))).alias("last_good"),
        F.when(few, 0).when(fine, 1).when(broken, 2).otherwise(F.col("m.tested")).cast("int").alias("tested"), n.alias("candidates"),
    )
