"""Scalar functions against their expectations."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import display as D
from tessera.functions import metadata as M
from tessera.functions import text as T
from tessera.operators.search import driver_terms


def values(spark, column, items):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


TERMS = {"hashPassword": ["hash", "password"], "get_user_by_id": ["get", "user", "by", "id"], "src/auth/login.ts": ["src", "auth", "login", "ts"], "HTTPServer": ["http", "server"], "a b": [], "": [], "x\U00020000y \U00020000": ["x\U00020000y", "\U00020000"], "giriş_YAP": ["giriş", "yap"]}


def test_terms(spark):
    assert values(spark, T.terms, list(TERMS)) == list(TERMS.values())
    assert [driver_terms(t) for t in TERMS] == list(TERMS.values())
    assert values(spark, T.terms, [None]) == [[]]


def test_one_line_and_useful(spark):
    assert values(spark, lambda c: T.one_line(c, 5), [" a \n b ", "abcdef", "abcde", None]) == ["a b", "abcd…", "abcde", None]
    assert values(spark, T.useful_string, ["abc", "ab", "...", "a" * 81, "12a", "\U0001F600a"]) == [True, False, False, False, True, True]


def test_languages(spark):
    assert values(spark, T.language, ["a.ts", "a.mts", "a.tsx", "b.jsx", "c.mjs", "d.pyi", "d.py", "e.TS", "f.json"]) == ["ts", "ts", "tsx", "tsx", "js", "py", "py", None, None]
    assert values(spark, T.is_declaration_file, ["a.d.ts", "a.d.mts", "a.ts", "d.ts"]) == [True, True, False, False]


def test_directories(spark):
    assert values(spark, T.directory, ["src/auth/login.ts", "src/x.ts", "x.ts", "a/b/c/d"]) == ["src/auth", "src", "x.ts", "a/b"]


GLOBS = [
    ("src/**", "src/a/b.ts", True), ("src/**", "src", True), ("src/**", "srcs/a", False), ("**/*.ts", "a.ts", True), ("**/*.ts", "x/y/a.ts", True), ("*.ts", "x/a.ts", False),
    ("**/node_modules/**", "node_modules/x", True), ("**/node_modules/**", "a/node_modules/b/c", True), ("**/dist/**", "adist/x", False), ("src/{a,b}/*", "src/b/x", True), ("src/{a,b}/*", "src/c/x", False),
    ("f?.py", "f1.py", True), ("f[0-3].py", "f4.py", False), ("f[!0-3].py", "f4.py", True), ("*", ".hidden", True), ("v{1..3}", "v2", True), ("v{1..3}", "v4", False), ("!src/**", "other", True), ("!src/**", "src/x", False), ("a+b", "a+b", True),
]


@pytest.mark.parametrize("glob,path,expected", GLOBS)
def test_globs(glob, path, expected):
    assert bool(re.search(T.glob_pattern(glob), path)) is expected


def test_globs_in_spark(spark):
    for glob, path, expected in GLOBS:
        assert values(spark, lambda c, g=glob: T.matches_any(c, [g]), [path]) == [expected]
    assert values(spark, lambda c: T.matches_any(c, []), ["a"]) == [False]


def test_word_pattern(spark):
    hit = lambda name, items: values(spark, lambda c: c.rlike(T.word_pattern(name)), items)
    assert hit("foo", ["foo()", "xfoo", "foo_", "éfoo", "a.foo.b", ""]) == [True, False, False, True, True, False]
    assert hit("$x", ["a$x", "$x", "a $x"]) == [True, False, False]
    assert hit("a.b", ["a.b", "aXb"]) == [True, False]


def test_durations_and_sizes(spark):
    assert values(spark, D.duration_ms, ["30m", "2 H", "7d", "3dk", "4sa", "5g", "9sn", "1s", "x", "", None]) == [1_800_000, 7_200_000, 604_800_000, 180_000, 14_400_000, 432_000_000, 9000, 1000, None, None, None]
    assert D.parse_duration(" 2h ") == 7_200_000
    with pytest.raises(ValueError, match="not a duration"):
        D.parse_duration("soon")
    assert values(spark, lambda c: D.size_text(c.cast("long")), ["0", "1023", "1024", "1300"]) == ["0 KiB", "1023 KiB", "1.0 MiB", "1.3 MiB"]
    assert values(spark, lambda c: D.relative_time(c.cast("long"), F.lit(100_000)), ["100005", "99941", "99940", "96400", "0"]) == ["0sn önce", "59sn önce", "1dk önce", "1sa önce", "1g önce"]
    assert values(spark, D.source_label, ["watch", "manual", "else"]) == ["oto", "elle", "else"]


def test_metadata_round_trip_and_fallback(spark):
    meta = F.from_json(F.lit('{"v":1,"label":"a  b","source":"agent","turn":"t","branch":"main"}'), M.META)
    row = spark.range(1).select(M.encode(meta).alias("m")).select("m", M.decode(F.col("m")).alias("d")).first()
    assert row.m.startswith("tessera(agent): a b\n") and (row.d.label, row.d.source, row.d.turn, row.d.branch, row.d.head) == ("a  b", "agent", "t", "main", None)
    bad = values(spark, lambda c: F.to_json(M.decode(c)), ["just text\nmore", f"x\n{M.MARKER} {{oops", f"{M.MARKER} a {M.MARKER} {{}}"])
    assert all('"source":"manual"' in b and '"branch":"unknown"' in b for b in bad) and '"label":"just text"' in bad[0]


def test_qualified_names_and_estimates(spark):
    assert values(spark, lambda c: T.qualified(c, F.lit("m")), ["C", "", None]) == ["C.m", "m", "m"]
    assert values(spark, lambda c: T.token_estimate(c.cast("long")), ["36", "5"]) == [10, 1]
    assert values(spark, T.utf16_length, ["a\U0001F600", ""]) == [3, 0]
