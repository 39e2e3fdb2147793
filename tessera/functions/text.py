"""Terms, one-line forms and predicates over code text.

Lengths follow UTF-16 units where a limit is stated in them: a code point beyond U+FFFF counts twice.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: white space as the pattern class \s of ECMAScript
SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
SIGNATURE_LIMIT, DOC_LIMIT, MAX_STRINGS = 200, 160, 10
CHARS_PER_TOKEN = 3.6

_WORD = "A-Za-z0-9_"


def terms(text: Column) -> Column:
    """Lower-case terms of camelCase, snake_case and path-like text; those of one UTF-16 unit are dropped."""
    # fixed values: the patterns at which terms part
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    parts = F.transform(F.split(spaced, r"[^\p{L}\p{N}]+", -1), F.lower)
    return F.filter(parts, lambda t: (F.length(t) > 1) | (F.octet_length(t) > 3))


def utf16_length(text: Column) -> Column:
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def one_line(text: Column, limit: int = SIGNATURE_LIMIT) -> Column:
    """White space collapsed and trimmed; longer texts end with an ellipsis at the limit."""
    flat = F.trim(F.regexp_replace(text, f"{SPACE}+", " "))
    return F.when(utf16_length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def useful_string(text: Column) -> Column:
    """Whether a literal is worth indexing: 3 to 80 units, a Latin letter, more than dots and slashes."""
    return utf16_length(text).between(3, 80) & text.rlike("[a-zA-Z]") & ~text.rlike("^[./]+$")


def language(path: Column) -> Column:
    """The language that a path's suffix names, or null."""
    return F.when(path.rlike(r"\.[tj]sx$"), "tsx").when(path.rlike(r"\.[mc]?ts$"), "ts").when(path.rlike(r"\.[mc]?js$"), "js").when(path.rlike(r"\.pyi?$"), "py")


def is_declaration_file(path: Column) -> Column:
    return path.rlike(r"\.d\.[mc]?ts$")


def directory(path: Column) -> Column:
    """The feature-shaped folder of a path: its first two parts, or the first of a shorter path."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.get(parts, F.lit(0)))


def qualified(parent: Column, name: Column) -> Column:
    return F.concat_ws(".", F.when(parent != "", parent), name)


def token_estimate(chars: Column) -> Column:
    return F.round(chars / CHARS_PER_TOKEN).cast("long")


def word_pattern(name: str) -> str:
    """A Java pattern for the name between ASCII word boundaries."""

    def edge(char: str, behind: bool) -> str:
        word = bool(re.fullmatch(f"[{_WORD}]", char))
        look = ("(?<" if behind else "(?") + ("!" if word else "=")
        return f"{look}[{_WORD}])"

    quoted = "".join(c if re.fullmatch(f"[{_WORD}]", c) else f"\\x{{{ord(c):X}}}" for c in name)
    return edge(name[0], True) + quoted + edge(name[-1], False) if name else "(?!)"


@functools.lru_cache(maxsize=1024)
def glob_pattern(glob: str) -> str:
    """A regular expression (for Java and Python alike) of a path glob; dot files match like others.

    ** as a whole part crosses parts, * and ? stay inside one, [...] is a class, {a,b} alternatives, {1..3} a range;
    a leading ! negates the whole.
    """
    if glob.startswith("!") and not glob.startswith("!("):
        return f"^(?!{glob_pattern(glob[1:])[1:]}).*$"
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            j = i
            while j < len(glob) and glob[j] == "*":
                j += 1
            whole = j - i > 1 and (i == 0 or glob[i - 1] == "/") and (j == len(glob) or glob[j] == "/")
            if whole and j < len(glob):
                out.append("(?:[^/]+/)*")
                j += 1
            elif whole and out and out[-1] == "/":
                out[-1] = "(?:/.*)?"
            else:
                out.append(".*" if whole else "[^/]*")
            i = j
            continue
        if c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in glob[i + 2 :]:
            j = glob.index("]", i + 2)
            inner = glob[i + 1 : j].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out.append(f"[^{inner[1:]}]" if inner[0] in "!^" else f"[{inner}]")
            i = j
        elif c == "{" and "}" in glob[i:]:
            if m := re.match(r"\{(\d+)\.\.(\d+)\}", glob[i:]):
                a, b = int(m[1]), int(m[2])
                out.append("(?:" + "|".join(map(str, range(min(a, b), max(a, b) + 1))) + ")")
                i += len(m[0])
                continue
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(c if c == "/" else re.escape(c))
        i += 1
    return "^(?:" + "".join(out) + ")$"


def any_glob(globs: list[str]) -> str:
    """One pattern that matches what any of the globs matches; of none, nothing."""
    return "|".join(glob_pattern(g) for g in globs) if globs else "(?!)"


def matches_any(path: Column, globs: list[str]) -> Column:
    return path.rlike(any_glob(globs)) if globs else F.lit(False)
