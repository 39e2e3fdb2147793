"""Import resolution: candidate paths are generated in order, joined with the known files, and the first one wins.

Candidates are an array expression per specifier, so resolution is one equi-join on path; a file that a third of all
specifiers name is a hot key only of that join, which adaptive execution splits.
"""

from __future__ import annotations

import json
import posixpath
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: suffixes tried in order, and the sources that a script suffix stands for
SUFFIXES = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs"]
SWAPS = {".js": [".ts", ".tsx"], ".jsx": [".tsx"], ".mjs": [".mts"], ".cjs": [".cts"]}


_COMMENT_OR_STRING = re.compile(r'"(?:\\.|[^"\\])*"|/\*.*?\*/|//[^\n]*', re.S)


@dataclass(frozen=True)
class Alias:
    prefix: str
    targets: tuple[str, ...]


def parse_aliases(text: str, folder: str = "") -> list[Alias]:
    """compilerOptions.paths of a tsconfig with comments and trailing commas, longest prefix first; [] if unreadable."""
    text = _COMMENT_OR_STRING.sub(lambda m: m[0] if m[0][0] == '"' else "", text)
    text = re.sub(r",(\s*[}\]])", r"\1", text)
    try:
        options = json.loads(text).get("compilerOptions") or {}
        base = posixpath.join(folder, options.get("baseUrl") or ".")
        found = [(k, v) for k, v in (options.get("paths") or {}).items() if isinstance(v, list)]
    except (ValueError, AttributeError):
        return []
    bare = lambda s: s[:-1] if s.endswith("*") else s
    # a trailing slash is gone from normalised targets; joining puts it back
    aliases = [Alias(bare(k), tuple(posixpath.normpath(posixpath.join(base, bare(t))) for t in v)) for k, v in found]
    return sorted(aliases, key=lambda a: -len(a.prefix))


def normal_path(path: Column) -> Column:
    """A relative path without '.', empty and resolvable '..' parts; '.' if nothing is left."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        climbs = (part == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        return F.when(climbs, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    joined = F.array_join(F.aggregate(parts, empty, step), "/")
    return F.when(joined == "", ".").otherwise(joined)


def parent_folder(path: Column, up: int | Column = 1) -> Column:
    """The folder `up` levels above a path; '.' at the top."""
    parts = F.split(path, "/")
    kept = F.slice(parts, 1, F.greatest(F.size(parts) - up, F.lit(0)))
    return F.when(F.size(kept) == 0, ".").otherwise(F.array_join(kept, "/"))


def _with_suffixes(base: Column) -> Column:
    extension = F.regexp_extract(base, r"(\.[^./]*)$", 1)
    stem = F.regexp_replace(base, r"\.[^./]*$", "")
    swaps = F.lit(None).cast("array<string>")
    for suffix, others in SWAPS.items():
        swaps = F.when(extension == suffix, F.array(*(F.concat(stem, F.lit(s)) for s in others))).otherwise(swaps)
    tail = [F.concat(base, F.lit(s)) for s in (*SUFFIXES, *(f"/index{s}" for s in SUFFIXES))]
    return F.concat(F.array(base), F.coalesce(swaps, F.array().cast("array<string>")), F.array(*tail))


def script_candidates(source: Column, spec: Column, aliases: list[Alias]) -> Column:
    relative = _with_suffixes(normal_path(F.concat_ws("/", parent_folder(source), spec)))
    none = F.array().cast("array<string>")
    aliased = none
    for a in aliases:
        if a.prefix:
            rest = F.substr(spec, F.lit(len(a.prefix) + 1))
            tried = [F.when(spec.startswith(a.prefix), _with_suffixes(normal_path(F.concat(F.lit(f"{t}/"), rest)))).otherwise(none) for t in a.targets]
            aliased = F.concat(aliased, *tried) if tried else aliased
    return F.when(spec.startswith("."), relative).otherwise(aliased)


def python_candidates(source: Column, spec: Column) -> Column:
    dots = F.length(F.regexp_extract(spec, r"^\.*", 0))
    parts = F.filter(F.split(F.regexp_replace(spec, r"^\.+", ""), r"\."), lambda p: p != "")
    base = F.when(dots > 0, parent_folder(source, dots)).otherwise(".")
    place = lambda p: normal_path(F.concat_ws("/", base, F.array_join(p, "/")))
    whole, above = place(parts), place(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    named = F.array(F.concat(whole, F.lit(".py")), F.concat(whole, F.lit("/__init__.py")))
    return F.when(F.size(parts) > 1, F.concat(named, F.array(F.concat(above, F.lit(".py"))))).otherwise(named)


def resolve_imports(specifiers: DataFrame, files: DataFrame, aliases: list[Alias] | None = None) -> DataFrame:
    """specifiers(src, lang, ord, spec) and files(path) to distinct (src, dst, ord), ord being the first that names dst."""
    tried = F.when(F.col("lang") == "py", python_candidates(F.col("src"), F.col("spec"))).otherwise(script_candidates(F.col("src"), F.col("spec"), aliases or []))
    candidates = specifiers.select("src", "ord", F.posexplode(tried).alias("nth", "path"))
    known = candidates.join(files.select("path").distinct(), "path", "left_semi")
    first = known.groupBy("src", "ord").agg(F.min(F.struct("nth", "path")).alias("m")).select("src", "ord", F.col("m.path").alias("dst"))
    return first.groupBy("src", "dst").agg(F.min("ord").alias("ord"))
