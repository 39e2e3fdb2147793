"""Index, resolution, ranking, search, reading and the map on a small project."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, readers, repo_map, search
from tessera.operators.resolve import Alias, normal_path, parse_aliases, resolve_imports
from tessera.sources.code_index import build_index, load_index, save_index

PROJECT = {
    "src/auth/login.ts": "import { hashPassword } from '../util/crypto.js';\nimport { createSession } from './session';\n\n/** Authenticates a user with a password. */\nexport async function login(name: string) {\n  return hashPassword(name) && createSession();\n}\nexport const LOGIN_PATH = '/api/login';\n",
    "src/auth/session.ts": "export function createSession() { return 'session-token'; }\n",
    "src/components/LoginForm.tsx": "import { login } from '@/auth/login';\nexport function LoginForm() {\n  return <button onClick={login}>Giris yap</button>;\n}\n",
    "src/util/crypto.ts": "export function hashPassword(value: string) {\n  return value;\n}\n",
    "src/billing/invoice.ts": "export function createInvoice() {\n  return 1;\n}\n\nexport function renderInvoicePdf() {\n  return 2;\n}\n",
    "src/reports/analytics.ts": "export function trackEvent(name: string) {\n  return name;\n}\n",
    "types.d.ts": "export interface Skipped { a: string }\n",
    "README.md": "hashPassword\n",
}


def files(spark, project):
    return spark.createDataFrame(list(project.items()), "path string, text string")


@pytest.fixture(scope="module")
def built(spark):
    return build_index(files(spark, PROJECT), aliases=[Alias("@/", ("src",))])


@pytest.fixture(scope="module")
def index(built):
    return built.index


def test_index_counts_and_edges(built, index):
    assert (built.parsed, built.reused, built.removed, built.symbols) == (6, 0, 0, 8)
    edges = {(r.src, r.dst) for r in index.edges.collect()}
    assert edges == {("src/auth/login.ts", "src/util/crypto.ts"), ("src/auth/login.ts", "src/auth/session.ts"), ("src/components/LoginForm.tsx", "src/auth/login.ts")}
    assert abs(sum(r.rank for r in index.files.collect()) - 1) < 1e-9


def test_incremental_builds(spark, index, tmp_path):
    save_index(index, str(tmp_path / "i"))
    stored = load_index(spark, str(tmp_path / "i"))
    changed = PROJECT | {"src/auth/session.ts": "export function openSession() {}\n", "src/late.py": "import os\n"}
    del changed["src/reports/analytics.ts"]
    again = build_index(files(spark, changed), stored, [Alias("@/", ("src",))])
    assert (again.parsed, again.reused, again.removed) == (2, 4, 2)  # the changed file and the deleted one
    names = {r.name for r in again.index.symbols.collect()}
    assert "openSession" in names and "createSession" not in names and "trackEvent" not in names
    late = build_index(files(spark, {"a.ts": "import './b'", "c.py": "x=1"}))
    assert late.index.edges.count() == 0
    now = build_index(files(spark, {"a.ts": "import './b'", "c.py": "x=1", "b.ts": ""}), late.index)
    assert (now.reused, [(r.src, r.dst) for r in now.index.edges.collect()]) == (2, [("a.ts", "b.ts")])


def test_versions_of_stored_indexes(spark, index, tmp_path):
    assert load_index(spark, str(tmp_path / "none")) is None
    save_index(index, str(tmp_path / "i"))
    spark.createDataFrame([(99, 0, "x")], "schema_version int, built_at long, version string").write.mode("overwrite").json(str(tmp_path / "i/meta"))
    assert load_index(spark, str(tmp_path / "i")) is None


def test_empty_project(spark):
    empty = build_index(files(spark, {"README.md": "x"}))
    assert empty.symbols == 0 and empty.index.files.count() == 0
    assert search.search(empty.index.docs, "login").count() == 0


def find(index, query, **options):
    """By the stored postings; a scan must find the same."""
    found = search.search(index.docs, query, index=index.terms, **options).collect()
    assert found == search.search(index.docs, query, **options).collect()
    return found


def test_search(index):
    hits = find(index, "login")
    assert (hits[0].name, hits[0].file) == ("login", "src/auth/login.ts") and "tam ad" in hits[0].why
    assert not any("billing" in h.file for h in hits[:3])
    assert find(index, "authenticates")[0].name == "login"
    assert find(index, "Giris yap")[0].name == "LoginForm" and "literal" in find(index, "Giris yap")[0].why
    assert all(h.file == "src/billing/invoice.ts" for h in find(index, "billing"))
    assert find(index, "x") == [] and find(index, "nothing-like-it") == []
    assert [h.name for h in find(index, "form", kind="component")] == ["LoginForm"]


def test_aliases(index):
    features = {"login": {"paths": ["src/auth/**"], "aliases": ["giriş"]}}
    assert find(index, "giriş") == []
    hits = find(index, "giriş", features=features)
    assert (hits[0].name, hits[0].file) == ("login", "src/auth/login.ts") and "feature:login" in hits[0].why
    zero = find(index, "unrelated", features={"billing stuff": {"paths": ["src/util/**"], "aliases": ["unrelated"]}})
    assert ("hashPassword", 0.0) in [(h.name, h.score) for h in zero]
    assert find(index, "u", features={"u": {"paths": ["**"], "aliases": []}}) == []


def test_kind_applies_before_the_statistics(index):
    docs = index.docs
    alone = search.search(docs.where("kind = 'function'"), "login form").collect()
    assert search.search(docs, "login form", kind="function").collect() == alone and find(index, "login form", kind="function") == alone
    assert find(index, "login form", kind="no such kind") == []


def test_a_query_reads_only_its_own_terms(spark, index, tmp_path):
    save_index(index, str(tmp_path / "i"))
    stored = load_index(spark, str(tmp_path / "i"))
    plan = search.search(stored.docs, "login", index=stored.terms)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualTo(term,login)" in plan or "PushedFilters: [In(term, [login])" in plan or "EqualTo(term,login)" in plan


GRAPHS = [
    (["a", "b", "c", "hub", "leaf"], [("a", "hub"), ("b", "hub"), ("c", "hub")], {"hub": 0.470198, "a": 0.132450, "leaf": 0.132450}),
    (["a", "b", "c"], [("a", "b"), ("b", "c"), ("c", "a")], {"a": 0.333333, "b": 0.333333}),
    (["a", "b"], [], {"a": 0.5}),
    (["a", "b"], [("a", "a"), ("a", "b"), ("a", "b"), ("a", "gone")], {"a": 0.350877, "b": 0.649123}),
]


@pytest.mark.parametrize("limit", [1_000_000, 0])
@pytest.mark.parametrize("case", range(4))
def test_pagerank(spark, case, limit):
    if limit == 0 and case not in (0, 3):
        pytest.skip("the joined rounds are slow; two graphs will do")
    nodes, edges, expected = GRAPHS[case]
    got = graph.pagerank(spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "src string, dst string"), driver_bytes=limit)
    ranks = {r.id: r.rank for r in got.collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and all(abs(ranks[n] - r) < 1e-6 for n, r in expected.items())


@pytest.mark.parametrize("shuffled", [False, True])
def test_pagerank_in_rounds_over_blocks(spark, monkeypatch, shuffled):
    """Many blocks and packed rows, a node that a third of all edges enter, and no join of strings in a round."""
    for name, value in (("BLOCK", 128), ("PACKED", 100), ("HELD", 2), ("ITERATIONS", 4)):
        monkeypatch.setattr(graph, name, value)
    monkeypatch.setattr(graph, "BROADCAST_BYTES", 0 if shuffled else 1 << 20)
    nodes, edges = [f"n{i}" for i in range(500)], [(f"n{i % 400}", f"n{0 if i % 3 else i * i % 500}") for i in range(3000)]
    nodes, edges = spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "src string, dst string")
    joins = []
    staged = graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, name: staged(joins.append((name, "src" in df._jdf.queryExecution().optimizedPlan().toString())) or df, name))
    got = {r.id: r.rank for r in graph.pagerank(nodes, edges, 4, driver_bytes=0).collect()}
    assert [name for name, _ in joins].count("ranks") == 5 and not any(strings for name, strings in joins if name == "ranks")
    want = {r.id: r.rank for r in graph.pagerank(nodes, edges, 4).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-14 for k in want)


def test_pagerank_of_nothing(spark):
    none = spark.createDataFrame([], "id string")
    assert graph.pagerank(none, spark.createDataFrame([], "src string, dst string")).count() == 0


def test_resolution(spark):
    known = ["src/a.ts", "src/a/index.ts", "src/b.js", "src/b.ts", "lib/x.tsx", "pkg/__init__.py", "pkg/models.py", "pkg/sub/m.py", "top.py", "c.d.tsx", "components/B.ts"]
    specs = [
        ("src/m.ts", "ts", 0, "./a"), ("src/m.ts", "ts", 1, "./b.js"), ("src/m.ts", "ts", 2, "../lib/x.jsx"), ("src/m.ts", "ts", 3, "react"), ("src/m.ts", "ts", 4, "./a/"), ("src/m.ts", "ts", 5, "@/a"), ("src/m.ts", "ts", 6, "@/components/B"),
        ("src/n.ts", "ts", 0, "./b"), ("src/n.ts", "ts", 1, "./none"), ("pkg/sub/m.py", "py", 0, "..models"), ("pkg/sub/m.py", "py", 1, "pkg"), ("pkg/sub/m.py", "py", 2, "pkg.models.User"), ("pkg/sub/m.py", "py", 3, "top"), ("pkg/sub/m.py", "py", 4, "os.path"), ("pkg/x.py", "py", 0, ".models"),
    ]
    aliases = parse_aliases('{ // c\n "compilerOptions": { "baseUrl": ".", "paths": { "@/*": ["src/*"], "@/components/*": ["components/*"], }, /* x */ } }')
    assert [a.prefix for a in aliases] == ["@/components/", "@/"] and parse_aliases("{bad") == [] and parse_aliases("[]") == []
    got = resolve_imports(spark.createDataFrame(specs, "src string, lang string, ord int, spec string"), spark.createDataFrame([(k,) for k in known], "path string"), aliases)
    found = {(r.src, r.dst) for r in got.collect()}
    assert found == {
        ("src/m.ts", "src/a.ts"), ("src/m.ts", "src/b.js"), ("src/m.ts", "lib/x.tsx"), ("src/m.ts", "components/B.ts"), ("src/n.ts", "src/b.ts"),
        ("pkg/sub/m.py", "pkg/models.py"), ("pkg/sub/m.py", "pkg/__init__.py"), ("pkg/sub/m.py", "top.py"), ("pkg/x.py", "pkg/models.py"),
    }


def test_normal_paths(spark):
    paths = {"a/../b": "b", "./a//b/.": "a/b", "../a": "../a", "a/../../b": "../b", ".": ".", "a/..": "."}
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", normal_path(F.col("p")).alias("n"))
    assert {r.p: r.n for r in df.collect()} == paths


def test_reading(spark, index):
    texts = files(spark, PROJECT)
    body = readers.symbol_body(index.symbols, texts, "src/billing/invoice.ts", "createInvoice").first()
    assert "return 1" in body.body and "renderInvoicePdf" not in body.body
    assert readers.symbol_body(index.symbols, texts, "src/billing/invoice.ts", "none").first() is None
    assert [r.name for r in readers.outline(index.symbols, "src/billing/invoice.ts").collect()] == ["createInvoice", "renderInvoicePdf"]
    refs = readers.references(index.symbols, texts.join(index.files.select("path"), "path"), "hashPassword").collect()
    assert [(r.file, r.line, r.symbol) for r in refs] == [("src/auth/login.ts", 1, None), ("src/auth/login.ts", 6, "login"), ("src/util/crypto.ts", 1, None)]
    assert len(readers.references(index.symbols, texts, "hashPassword", 1).collect()) == 1
    assert readers.references(index.symbols, texts, "").count() == 0


def test_methods_by_class(spark):
    built = build_index(files(spark, {"a.ts": "class A { run() { return 1 } }\nclass B {\n  run() { return 2 } }\n"}))
    one = readers.symbol_body(built.index.symbols, files(spark, {"a.ts": "x\ny\nz"}), "a.ts", "B.run").first()
    assert (one.name, one.start_line, one.body) == ("B.run", 3, "z")


def test_map(index):
    whole = repo_map.repo_map(index.files, index.symbols)
    assert whole.truncated == 0 and whole.render().startswith("src/")
    tight = repo_map.repo_map(index.files, index.symbols, 20)
    assert tight.truncated > 0 and len(tight.render()) < len(whole.render())


def test_map_goes_on_after_a_miss(spark):
    rows = [("a", 3.0, "a" * 50, "a" * 40), ("b", 2.0, "b" * 200, "b" * 30), ("c", 1.0, "c" * 10, "c"), ("d", 0.5, "d" * 18, "d" * 17)]
    df = spark.createDataFrame(rows, "path string, rank double, block string, short string")
    for batch in (1, 2, 100):
        got = repo_map.pack_budget(df, 95, batch)
        assert [t[:1] + str(len(t)) for _, t in got.entries] == ["a50", "b30", "c10"] and got.truncated == 2


def test_packing_brings_only_chosen_texts_to_the_driver(spark):
    """200 blocks of 100,000 characters, of which none fits; their short forms do."""
    rows = spark.range(200).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("path"), F.lit(1.0).alias("rank"), F.repeat(F.lit("x"), F.lit(100_000)).alias("block"), F.lit("s").alias("short"))
    sent, collect = [], type(rows).collect

    def counted(df):
        out = collect(df)
        sent.append(sum(len(str(v)) for r in out for v in r))
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(rows), "collect", counted)
        got = repo_map.pack_budget(rows, 50_000, 64)
    assert len(got.entries) == 200 and got.used == 400 and got.truncated == 200 and sum(sent) < 50_000


def test_equal_paths_over_two_batches_are_all_packed(spark):
    df = spark.createDataFrame([("a", 1.0, "a" * n, "a") for n in (3, 4, 5)], "path string, rank double, block string, short string")
    assert sorted(len(t) for _, t in repo_map.pack_budget(df, 100, 1).entries) == [3, 4, 5]


def test_suggestions(index):
    got = readers.suggest_features(index.files, index.symbols, ["src/auth/**", "src/util/crypto.ts"]).collect()
    assert "auth" not in [r.name for r in got] and "util" in [r.name for r in got] and got[0].glob.endswith("/**")
