"""Reading code by symbol: bodies, outlines, and references resolved to their innermost enclosing symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

REFERENCE_LIMIT, SNIPPET = 100, 160


def lines_of(text: str = "text") -> F.Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def symbol_body(symbols: DataFrame, texts: DataFrame, file: str, name: str, body: bool = True) -> DataFrame:
    """The first symbol of that name (Class.method names both) in a file: name, lines, signature and, if asked, body.

    Only the file's row is read; without the body no text is.
    """
    parts = name.split(".")
    mine = symbols.where(F.col("file") == file)
    mine = mine.where((F.col("parent") == parts[0]) & (F.col("name") == parts[1])) if len(parts) > 1 else mine.where(F.col("name") == name)
    found = mine.orderBy("ord").limit(1).select("file", T.qualified(F.col("parent"), F.col("name")).alias("name"), "start_line", "end_line", "signature")
    if not body:
        return found
    text = texts.where(F.col("path") == file).select(F.col("path").alias("file"), "text")
    cut = F.slice(lines_of(), F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)))
    return found.join(text, "file").withColumn("body", F.array_join(cut, "\n")).drop("text")


def outline(symbols: DataFrame, file: str) -> DataFrame:
    """A file's symbols in line order."""
    return symbols.where(F.col("file") == file).orderBy("start_line", "ord").select("name", "kind", "start_line", "end_line", "exported", "signature", "doc", "parent")


def enclosing(lines: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """lines(file, hits: array of (line, text)) with the innermost symbol around each hit; one row per hit.

    A file's symbols are one array, joined once per file; the innermost range is chosen inside the row, so no row is
    made for a pair of a line and a range.  Symbols of the searched name don't enclose.
    """
    ranges = symbols.where(F.col("name") != name).groupBy("file").agg(F.collect_list(F.struct("start_line", (-F.col("end_line")).alias("rev_end"), (-F.col("ord")).alias("rev_ord"), T.qualified(F.col("parent"), F.col("name")).alias("symbol"), "kind")).alias("ranges"))
    hits = lines.join(ranges, "file", "left").select("file", "ranges", F.explode("hits").alias("hit"))
    around = F.filter("ranges", lambda r: (r["start_line"] <= F.col("hit.line")) & (-r["rev_end"] >= F.col("hit.line")))
    inner = F.array_max(around)
    return hits.select("file", F.col("hit.line").alias("line"), F.col("hit.text").alias("text"), inner.alias("inner"))


def references(symbols: DataFrame, texts: DataFrame, name: str, limit: int = REFERENCE_LIMIT) -> DataFrame:
    """Lines that hold the name as a word, in order of path and line: file, line, text, enclosing symbol and its kind.

    A plain substring test comes before the pattern.  Only files with a row in texts are searched.
    """
    pattern = T.word_pattern(name)
    some = texts.where(F.col("text").contains(name)) if name else texts.limit(0)
    numbered = F.transform(lines_of(), lambda s, i: F.struct((i + 1).alias("line"), s.alias("text")))
    hits = F.filter(numbered, lambda h: h["text"].contains(name) & h["text"].rlike(pattern))
    found = some.select(F.col("path").alias("file"), hits.alias("hits")).where(F.size("hits") > 0)
    rows = enclosing(found, symbols, name).orderBy("file", "line").limit(limit)
    return rows.select("file", "line", F.substring(F.trim(F.regexp_replace("text", f"^{T.SPACE}+|{T.SPACE}+$", "")), 1, SNIPPET).alias("text"), F.col("inner.symbol").alias("symbol"), F.col("inner.kind").alias("kind"))


def kind_statistics(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def language_statistics(files: DataFrame) -> DataFrame:
    return files.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")


def top_files(files: DataFrame, limit: int = 8) -> DataFrame:
    return files.orderBy(F.desc("rank"), "path").limit(limit).select("path", "rank")


def suggest_features(files: DataFrame, symbols: DataFrame, covered: list[str], limit: int = 10) -> DataFrame:
    """Feature names with a glob: the folders of most rank that no feature covers, then folders of route files.

    files: path, rank.  covered: the globs of all features; a folder is covered if a glob names it itself.
    """
    import re

    named = [re.sub(r"/$", "", re.sub(r"/?\*+.*$", "", g)) for g in covered]
    folders = files.withColumn("dir", T.directory(F.col("path"))).where("dir <> ''").groupBy("dir").agg(F.count("*").alias("files"), F.sum("rank").alias("rank"), F.min("path").alias("first"))
    folders = folders.where(~F.col("dir").isin(named)) if named else folders
    best = folders.orderBy(F.desc("rank"), "first").limit(limit).select(F.element_at(F.split("dir", "/"), -1).alias("name"), F.concat("dir", F.lit("/**")).alias("glob"), "files", F.lit(0).alias("part"), F.struct((-F.col("rank")).alias("k"), F.col("first").alias("p")).alias("key"))
    holder = F.get(F.split("file", "/"), F.size(F.split("file", "/")) - 2)
    routes = symbols.where("kind = 'route'").select("file", holder.alias("name")).where(F.col("name").isNotNull() & ~F.col("name").isin("", "src", "app", "api"))
    routes = routes.groupBy("name").agg(F.min("file").alias("p")).select("name", F.concat(F.lit("**/"), F.col("name"), F.lit("/**")).alias("glob"), F.lit(None).cast("long").alias("files"), F.lit(1).alias("part"), F.struct(F.lit(0.0).alias("k"), "p").alias("key"))
    once = best.unionByName(routes).withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("part", "key"))).where("nth = 1")
    return once.orderBy("part", "key").select("name", "glob", "files")
