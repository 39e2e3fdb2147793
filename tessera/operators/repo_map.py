"""A ranked map of a repository inside a token budget: a greedy fold that skips what doesn't fit and goes on.

Blocks are built in parallel, one row per file.  The fold needs only lengths, and a file can matter only if its block
or its short form still fits, so the driver takes the lengths of the next BATCH such files in order, folds over them,
and asks again with what is left of the budget.  The texts of the chosen forms, which fit the budget, come last; nothing
grows with the number of files or the length of their blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources.staging import stage

BATCH = 4096
# fixed values: weights of the kinds; exported symbols count twice
WEIGHTS = {"route": 6, "component": 5, "hook": 5, "class": 4, "function": 3, "interface": 2, "method": 2, "type": 1, "enum": 1, "const": 1}


def weight(kind: F.Column, exported: F.Column) -> F.Column:
    table = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, kind), F.lit(1)) * F.when(exported, 2).otherwise(1)


def blocks(files: DataFrame, symbols: DataFrame, private: bool = False) -> DataFrame:
    """path, rank, block, short of every file with a chosen symbol."""
    chosen = symbols if private else symbols.where("exported")
    said = F.concat(F.lit("  "), F.col("start_line").cast("string"), F.lit(": "), F.col("kind"), F.lit(" "), T.qualified(F.col("parent"), F.col("name")))
    entry = F.struct("start_line", "ord", (-weight(F.col("kind"), F.col("exported"))).alias("w"), said.alias("said"))
    by_file = chosen.groupBy(F.col("file").alias("path")).agg(F.sort_array(F.collect_list(entry)).alias("all"))
    best = F.slice(F.array_sort(F.transform("all", lambda e: F.struct(e["w"].alias("w"), e["start_line"].alias("start_line"), e["ord"].alias("ord"), e["said"].alias("said")))), 1, 2)
    top = F.array_sort(F.transform(best, lambda e: F.struct(e["start_line"].alias("start_line"), e["ord"].alias("ord"), e["w"].alias("w"), e["said"].alias("said"))))
    text = lambda entries: F.concat(F.col("path"), F.lit("\n"), F.array_join(F.transform(entries, lambda e: e["said"]), "\n"))
    return files.select("path", "rank").join(by_file, "path").select("path", "rank", text(F.col("all")).alias("block"), text(top).alias("short"))


@dataclass
class Packed:
    entries: list[tuple[str, str]]  # path, text
    used: int
    truncated: int

    def render(self, footer: str = "\n… {n} files did not fit the budget") -> str:
        return "\n".join(t for _, t in self.entries) + (footer.format(n=self.truncated) if self.truncated else "")


def pack_budget(rows: DataFrame, budget: int, batch: int = BATCH) -> Packed:
    """rows(path, rank, block, short), by falling rank, then path; lengths count a line end each."""
    size = lambda c: (T.utf16_length(F.col(c)) + 1).alias(f"{c}_len")
    sized = stage(rows.select("path", "rank", "block", "short", size("block"), size("short")).withColumn("row", F.monotonically_increasing_id()), "blocks")
    key = F.collate("path", "UNICODE")
    last, used, full = None, 0, 0
    chosen: list[tuple[int, bool]] = []  # row, whether it is the whole block
    while True:
        fits = sized.where(F.least("block_len", "short_len") <= budget - used).select("row", "path", "rank", "block_len", "short_len")
        if last is not None:
            path = F.lit(last.path)
            behind = (F.col("path") > path) | ((F.col("path") == path) & (F.col("row") > last.row))
            behind = (key > F.collate(path, "UNICODE")) | ((key == F.collate(path, "UNICODE")) & behind)
            fits = fits.where((F.col("rank") < last.rank) | ((F.col("rank") == last.rank) & behind))
        # staged first: what every task has of the best rows would else be merged on the driver
        top = stage(fits.orderBy(F.desc("rank"), key, F.col("path"), F.col("row")).limit(batch).withColumn("nth", F.monotonically_increasing_id()), "next")
        got = sorted(top.collect(), key=lambda r: r.nth)
        for r in got:
            for n, whole in ((r.block_len, True), (r.short_len, False)):
                if used + n <= budget:
                    chosen.append((r.row, whole))
                    used += n
                    full += whole
                    break
        if len(got) < batch:
            break
        last = got[-1]
    texts = _texts(sized, chosen)
    return Packed([texts[row] for row, _ in chosen], used, sized.count() - full)


def _texts(sized: DataFrame, chosen: list[tuple[int, bool]]) -> dict[int, tuple[str, str]]:
    """Path and text of the chosen rows, which together are within the budget; no other text leaves the cluster."""
    if not chosen:
        return {}
    wanted = sized.sparkSession.createDataFrame(chosen, "chosen long, whole boolean")
    text = F.when(F.col("whole"), F.col("block")).otherwise(F.col("short"))
    found = sized.join(F.broadcast(wanted), F.col("row") == F.col("chosen")).select("row", "path", text.alias("text"))
    return {r.row: (r.path, r.text.rstrip()) for r in found.collect()}


def repo_map(files: DataFrame, symbols: DataFrame, budget_tokens: int = 2000, private: bool = False) -> Packed:
    return pack_budget(blocks(files, symbols, private), int(budget_tokens * T.CHARS_PER_TOKEN))
