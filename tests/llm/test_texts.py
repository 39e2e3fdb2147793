"""op1, op3 and op4 against brute force and hand-made texts."""

import hashlib
import pathlib
import random
import re
import subprocess
import sys
import textwrap
import time

import pytest

from tessera.llm import decontaminate as module
from tessera.llm import licenses
from tessera.llm.decontaminate import decontaminate, remains
from tessera.llm.main_text import MIN_PAGES, MIN_TOKENS, main_text, parse
from tests.llm.corpus import DOCS, awkward, collected, documents, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- licences


def test_equivalent_spellings_have_one_digest(spark):
    mit = licenses._MIT
    texts = [mit, f"Copyright (c) 2024 Somebody\n\n{mit.upper()}", mit.replace("sublicense", "sub-license").replace(",", " ,\n"), "// Licensed under the MIT Licence.", f"{mit} and more", None, "", "x " * 50_000]
    got = {r.doc_id: r for r in licenses.license_scan(documents(spark, texts)).collect()}
    assert [got[i].license_id for i in range(1, 9)] == ["MIT", "MIT", "MIT", "MIT", None, None, None, None]
    assert got[1].digest == got[2].digest == got[3].digest and got[6].digest == got[7].digest == hashlib.sha256(b"").hexdigest()


UNLICENSE = '''This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>'''


def test_whole_texts_in_any_wrapping(spark):
    isc = licenses._ISC.replace("above copyright", "above\ncopyright") + "\n\n" + licenses._ISC_TAIL
    texts = [UNLICENSE, textwrap.fill(UNLICENSE, 50), isc, f"ISC License\n\nCopyright (c) 2004-2010 by Somebody\nCopyright 1999 Other\n© Third\nAll rights reserved.\n{isc}", f"Copyright The Foo Authors.\n{licenses._MIT}"]
    expected = ["Unlicense", "Unlicense", "ISC", "ISC", "MIT"]
    debian = pathlib.Path("/usr/share/common-licenses")
    for name, known in [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0-only"), ("GPL-3", "GPL-3.0-only"), ("LGPL-2.1", "LGPL-2.1-only"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")]:
        if (debian / name).exists():
            whole = (debian / name).read_text()
            wrapped = ["\n\n".join(p if re.search(r"(?i)copyright (\(c\)|\[)", p) else textwrap.fill(p, width, break_long_words=False) for p in whole.split("\n\n")) for width in (40, 61)]
            texts += [whole, *wrapped]
            expected += [known] * 3
    got = {r.doc_id: r.license_id for r in licenses.license_scan(documents(spark, texts)).collect()}
    assert [got[i] for i in range(1, len(texts) + 1)] == expected


def test_notice_lines(spark):
    text = "Some prose.\nReleased under the MIT License.\nLICENSED UNDER CC BY-NC 4.0\nlicense unknown to us\nReleased under the MIT License."
    row = licenses.license_scan(documents(spark, [text])).first()
    assert (row.n_notices, row.notices, row.license_id) == (3, "CC-BY-NC-4.0,MIT", None)


def test_licences_of_no_rows_repeated_rows_and_clashing_columns(spark):
    assert licenses.license_scan(spark.createDataFrame([], DOCS)).count() == 0
    docs = documents(spark, [licenses._MIT, licenses._MIT, None, None], [1, 1, 2, None])
    plain = collected(licenses.license_scan(docs))
    assert [r[2] for r in plain if r[0] == 1] == ["MIT", "MIT"] and len(plain) == 4
    clash = docs.selectExpr("*", "1 as digest", "2 as license_id", "3 as found", "4 as notices")
    assert collected(licenses.license_scan(clash)) == plain


def test_digests_against_python(spark):
    """An independent normalisation: characters that aren't letters or digits part words, and copyright statements go."""
    rng = random.Random(10)
    texts = [" ".join(rng.choice(["Licence", "sub-license,", "The", "(software)", "provided", "AS-IS", "“quoted”", "favour", "x9"]) for _ in range(30)) for _ in range(40)]
    texts += [f"Copyright (c) 2020 Foo Bar\n{t}" for t in texts[:5]] + [f"{t}\n(c) 1999 Foo\nAll rights reserved." for t in texts[:5]]

    def canonical(t):
        lines = [x for x in t.lower().split("\n") if not re.match(r"(copyright )?\(c\) \d{4} |all rights reserved", x)]
        t = " ".join(re.findall("[a-z0-9]+", "\n".join(lines)))
        for a, b in (("licence", "license"), ("sub license", "sublicense"), ("favour", "favor")):
            t = t.replace(a, b)
        return hashlib.sha256(t.encode()).hexdigest()

    got = {r.doc_id: r.digest for r in licenses.license_scan(documents(spark, texts)).collect()}
    assert [got[k] for k in range(1, len(texts) + 1)] == [canonical(t) for t in texts]


# --- decontamination


def split(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w]


def brute_leaks(docs, items):
    windows = {}
    for item, text in items:
        w = split(text)
        if w:
            n = min(13, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for d, text in docs:
        w, hit, named = split(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    named |= found
        named = sorted(str(x) for x in named if x is not None)
        out.append((d, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_decontamination(spark):
    rng = random.Random(4)
    bench = [(k, words(rng, rng.randrange(1, 60))) for k in range(12)] + [(20, "short item here"), (21, "short"), (22, None), (23, ""), (24, "!!"), (25, "same same same same same same same same same same same same same same same"), (26, "short item here"), (3, words(rng, 20))]
    docs = list(enumerate(awkward(2), 1))
    for k in range(40):
        body = words(rng, rng.randrange(0, 120), 60).split()
        w = split(rng.choice(bench)[1])
        a = rng.randrange(len(w) + 1)
        body[len(body) // 2 : len(body) // 2] = w[a : a + rng.randrange(1, 40)]
        docs.append((1000 + k, " ".join(body).upper() if k % 3 else ", ".join(body)))
    docs += [(None, bench[0][1]), (5000, "x same " + "same " * 40), (5000, "short item here"), (5001, "Short—item, here; SHORT")]
    got = decontaminate(documents(spark, [t for _, t in docs], [d for d, _ in docs]), items(spark, bench)).drop("body", "longest")
    assert collected(got) == brute_leaks(docs, bench)


def test_decontamination_in_pieces(spark, monkeypatch):
    """Texts longer than a piece: passages, words and characters across the cuts, words longer than a piece, equal rows."""
    rng = random.Random(31)
    long, short, word, odd = words(rng, 30, 10**6), words(rng, 4, 10**6), "solo", f"{words(rng, 8, 10**6)} {'é' * 300} ÀÉ日本 {words(rng, 6, 10**6)}"
    bench = [(1, long), (2, short), (3, word), (4, odd), (5, "日本 é"), (6, "Z9 z9 Z9")]
    texts = [None, "", long, odd, "x" * 900, f"{'x' * 900} solo {'y' * 900}", "-" * 900, f"{'. ' * 400}{short.upper()}{' .' * 400}\n", "z9 " * 300, "日本 é\n" * 60]
    for _ in range(40):
        texts.append(rng.choice([" ", "  \n", ", É "]).join(rng.choice([words(rng, rng.randrange(1, 40)), long, short, word, odd, "😀" * rng.randrange(40), "a" * 200]) for _ in range(rng.randrange(1, 8))))
    ids = [None if k % 7 == 0 else k // 2 for k in range(len(texts))]
    texts, ids = texts + texts[-5:], ids + ids[-5:]
    docs, before = documents(spark, texts, ids), documents(spark, [f"{t or ''} {long}" if k % 3 else t for k, t in enumerate(texts)], ids)
    whole = collected(remains(docs, before, items(spark, bench)))
    for piece, edge in [(40, 8), (150, 30)]:
        monkeypatch.setattr(module, "PIECE_BYTES", piece)
        monkeypatch.setattr(module, "EDGE_BYTES", edge)
        assert collected(decontaminate(docs, items(spark, bench)).drop("body", "longest")) == brute_leaks(list(zip(ids, texts)), bench)
        assert collected(remains(docs, before, items(spark, bench))) == whole


def test_decontamination_of_a_text_larger_than_a_task_can_split(tmp_path):
    """In 700 MB of heap the words of this text at once are too much."""
    run = f"""
import random, sys
sys.path.insert(0, {str(pathlib.Path(__file__).parents[2])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.driver.memory", "700m").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
from tessera.llm.decontaminate import decontaminate, remains
item = " ".join(f"w{{k}}" for k in range(20))
spark.range(1).selectExpr("id as doc_id", "concat(repeat('ab c def ', 1000000), '{{}}', repeat(' gh i jk', 1000000)) as text".format(item)).write.parquet({str(tmp_path / "docs")!r})
print([tuple(r) for r in decontaminate(spark.read.parquet({str(tmp_path / "docs")!r}), spark.createDataFrame([(1, item)], "item_id long, text string")).select("n_words", "n_hit", "n_items").collect()])
"""
    got = subprocess.run([sys.executable, "-c", run], capture_output=True, text=True, timeout=600)
    assert got.stdout.strip().splitlines()[-1:] == ["[(6000020, 20, 1)]"], got.stderr[-2000:]


def test_decontamination_of_nothing(spark):
    docs = documents(spark, ["a b", None])
    assert [r.n_hit for r in decontaminate(docs, items(spark, [])).collect()] == [0, 0]
    assert decontaminate(spark.createDataFrame([], DOCS), items(spark, [(1, "a b")])).count() == 0
    clash = docs.selectExpr("*", "1 as body", "2 as w", "3 as window", "4 as grams", "5 as start", "6 as item")
    assert sorted(r.n_hit for r in decontaminate(clash, items(spark, [(1, "a b")])).collect()) == [0, 2]


# --- main text

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
<article><header><h1>Title &amp; more</h1></header><p>First   <b>bold</b><i>ly</i>
 line&nbsp;end.<p>Second<br>part &lt;tag&gt; &#233;&#x4e2d;<div class="ad">Buy</div><aside>Side</aside><form><input><button>Go</button>Form</form>
<ul><li>one<li>two</ul><section id="comments"><p>Reader says</section></article>
<div class="sidebar">Links</div><footer>&copy; Foot</footer></body></html>"""


def text_of(html):
    return " ".join(parse(html)[1])


def test_declared_pages():
    assert text_of(PAGE) == "Title & more First boldly line end. Second part <tag> é中 one two"


@pytest.mark.parametrize(
    "html,expected",
    [
        ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a b"), ("<div>a <span class=ad>x</span> b</div>", "a b"), ("<main>in</main>out", "in"), ("<div role=main>in <nav>no</nav></div>out", "in"),
        ("<article>a<article class='comment'>c</article></article>", "a"), ("<article>1 < 2 &amp;amp; 3", "1 < 2 &amp; 3"), ("<article>a<script>if (a</b) {}</script>b</article>", "a b"), ("<article>x<", "x<"), ("<article>x<p clas", "x"),
        ("<article><p hidden>h</p><p style='display: none'>n</p>ok</article>", "ok"), ("<ARTICLE><P>Up</P></ARTICLE>", "Up"), ("<article>a</p></div>b</article>", "a b"), ("<article>e&#0;&notit;</article>", "e�¬it;"),
        ("<article><p>Hello <a href=/it's>x</a> world</p><p>rest of it</p></article>", "Hello x world rest of it"), ("<article><p class=\"a\"'>Hello</p> all</article>", "Hello all"), ("<article><p title=a>b>c</p></article>", "b>c"),
        ("<article><p title='>'>b</p><p =x>c</p><!-->d<!--->e</ x>f</>g</article>", "b c defg"), ("<article><p title=\"never closed>a</p></article>", ""),
        ('<article><span class="search-term">foo</span> <div class="share-price">9 €</div><p class="notice-board skip-intro">n</p></article>', "foo 9 € n"),
        ('<article>a<div class="share-buttons x">s</div><div id="cookie_notice">c</div><p class="related-posts">r</p><p class="comment-list">l</p>b</article>', "a b"),
        ('<article><ul><li class="ad">buy<li>one</ul><dl><dt class=ad>x<dd>y</dl><table><tr class=ad><td>q<tr><td class=ad>r<td>s</table></article>', "one y s"), ('<article><ul><li class=ad><ul><li>in</ul><li>out</ul></article>', "out"),
    ],
)
def test_single_pages(html, expected):
    assert text_of(html) == expected


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_repeated_runs_of_a_host_are_boilerplate(spark):
    rng = random.Random(6)
    frame = [words(rng, 12, 10**6), words(rng, 9, 10**6)]
    short = "three words only"
    rows, expected = [], {}
    for k in range(6):
        host = "one.example" if k < 4 else f"other{k}.example"
        own = [words(rng, 30, 10**6), words(rng, 5, 10**6)]
        rows.append((k, f"https://u@{host.upper()}:80/{k}", f"<div>{frame[0]}</div><p>{own[0]}</p><p>{short}</p><p>{own[1]}</p><div>{frame[1]}</div>"))
        expected[k] = f"{own[0]} {short} {own[1]}" if k < 4 else f"{frame[0]} {own[0]} {short} {own[1]} {frame[1]}"
    rows.append((9, None, None))
    expected[9] = ""
    rows += [(20 + k, "https://one.example/a", f"<article>{frame[0]} tail</article>") for k in range(MIN_PAGES)]
    expected |= {20 + k: f"{frame[0]} tail" for k in range(MIN_PAGES)}
    got = main_text(pages(spark, rows)).collect()
    assert {r.page_id: r.text for r in got} == expected and all(r.n_chars == len(r.text) for r in got)


def test_copies_of_a_page_count_once_and_declared_pages_count(spark):
    rng = random.Random(8)
    copied, menu, own = words(rng, 40, 10**6), words(rng, 10, 10**6), words(rng, 30, 10**6)
    rows = [(k, f"https://one.example/{k}", f"<p>{copied}</p>") for k in range(4)]
    rows += [(10 + k, "https://two.example/", f"<div>{menu}</div><article>text {k}</article>") for k in range(MIN_PAGES)]
    rows.append((20, "https://two.example/", f"<div>{menu}</div><p>{own}</p>"))
    expected = {k: copied for k in range(4)} | {10 + k: f"text {k}" for k in range(MIN_PAGES)} | {20: own}
    assert {r.page_id: r.text for r in main_text(pages(spark, rows)).collect()} == expected


def test_nested_pages_take_linear_time():
    for html in ("<div>" * 20_000 + "</b><p>x</i>" * 2_000, "<b><ul>" + "<div>" * 20_000 + "<li>a</li></b>" * 20_000, "<p " + "a='" * 50_000, "<" * 50_000, "<a =" * 20_000):
        began = time.perf_counter()
        parse(html)
        assert time.perf_counter() - began < 3


def brute_unique(rows):
    """By all runs of MIN_TOKENS tokens of every host."""
    seen = {}
    streams = {k: (url.split("/")[2], text.split()) for k, url, text in rows}
    runs = lambda w: [tuple(w[i : i + MIN_TOKENS]) for i in range(len(w) - MIN_TOKENS + 1)]
    for host, w in streams.values():
        for r in runs(w):
            seen.setdefault((host, r), set()).add(tuple(w))
    out = {}
    for k, (host, w) in streams.items():
        gone = {i + j for i, r in enumerate(runs(w)) if len(seen[host, r]) >= MIN_PAGES for j in range(MIN_TOKENS)}
        out[k] = " ".join(x for i, x in enumerate(w) if i not in gone) if len(gone) < len(w) else " ".join(w)
    return out


def test_suffix_array_against_all_runs(spark):
    rng = random.Random(9)
    passages = [words(rng, n, 10**6) for n in (7, 8, 9, 20, 40)]
    rows = []
    for k in range(120):
        parts = [words(rng, rng.randrange(0, 25), 30) for _ in range(3)] + [w if rng.random() < 0.7 else " ".join(w.split()[rng.randrange(4) :]) for w in rng.sample(passages, 2)]
        rng.shuffle(parts)
        rows.append((k, f"https://h{min(k % 7, 2)}.example/{k}", " ".join(" ".join(parts).split())))
    rows += [(200 + k, "https://h0.example/", rows[0][2]) for k in range(5)]
    got = main_text(pages(spark, [(k, u, f"<p>{t}</p>") for k, u, t in rows]).repartition(5)).collect()
    assert {r.page_id: r.text for r in got} == brute_unique(rows)


def test_no_pages_and_long_pages(spark):
    assert main_text(pages(spark, [])).count() == 0
    clash = pages(spark, [(1, "u", "<p>" + "word " * 100_000), (1, "u", "<p>x")]).selectExpr("*", "1 as row", "2 as prefix", "3 as host", "4 as text")
    assert sorted(r.n_chars for r in main_text(clash).collect()) == [1, 499_999]
