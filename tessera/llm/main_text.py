"""Main text of web pages: structure where pages declare it, a suffix array of the host where they don't.

Parsing reads a page once by the rules of HTML for tags and attributes: character references are decoded, scripts,
styles, comments and markup go, and blocks inside menus, headers, footers, sidebars, notices, adverts, forms and reader
comments are boilerplate.  Those are known by element, role, hidden attribute, or a class or id of which every word
names boilerplate (`cookie-notice`, but not `search-term`).  If the page has a main element or an article, its blocks
are the main text and nothing else is removed from it: a passage that several articles of a host quote is text, so
repetition must not decide there.

For pages without such an element a suffix array of the host decides on the remaining blocks.  The token streams of
its pages (of pages that declare a text, what lies outside of it) are one long text.  Every task orders the suffixes of
its pages by two digits of MIN_TOKENS / 2 tokens each; the ordered runs are merged by range partitions, and neighbours
that agree in both digits share a substring of MIN_TOKENS tokens or more.  If it occurs on MIN_PAGES distinct pages or
more it is boilerplate: the tokens that such substrings cover go, unique runs stay.  Digits are 64-bit hashes, so the
order is that of the hashes.  Of one substring a task passes MIN_PAGES pages on at most, which is all that counting up
to MIN_PAGES needs, and the merge reads its range as a stream: a substring on all pages of a hot host costs a few rows
per task.  Pages of equal content count once, and a page of which nothing would be left stays whole.

Null pages and urls are empty; rows that repeat a page or an id give equal results.  Unclosed elements end with what
contains them; a tag cut off at the end of a page is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.staging import small_batches, stage

MIN_TOKENS, MIN_PAGES = 8, 3
DIGIT = MIN_TOKENS // 2
BROADCAST_REPEATS = 1_000_000  # of rows of 16 bytes

_MARKUP = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|[^<]+|"""
    r"""<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?>[\s/]++|=?[^\s/>=]++(?>\s*+=\s*+(?>"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|(?!["'])[^\s>]++)?+)?+|=)*+)(?P<close>>|\Z)|<""",
    re.S,
)
_ATTR = re.compile(r"""(=?[^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)?""")
_RAW = {"script", "style", "noscript", "template", "iframe", "object", "textarea", "select", "svg", "math", "head", "title", "audio", "video", "canvas", "noembed", "noframes", "xmp"}
_OPAQUE = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "noscript"}
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in _OPAQUE}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_BOILER = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
_MAIN = {"article", "main"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
# a class or id names boilerplate if every word of it is in one of these, and one at least in the first
_NAMES = set(
    "nav navbar navigation menu topbar masthead footer sidebar aside ad ads adv advert adverts advertisement advertisements advertising banner sponsor sponsored sponsors promo promotion promotions cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations breadcrumb breadcrumbs pagination pager comment comments commentlist disqus replies respond toolbar skip search".split()
)
_PLACES = set("area articles bar block bottom box btn button buttons container content footer form global header icons inline inner item items left link links list main message page panel post posts primary right row secondary section site slot stories thread top unit widget wrap wrapper".split())
_NOT_ARTICLE = _NAMES & set("ad ads advert advertisement sponsor sponsored promo related recommended comment comments replies".split()) | {"reply", "teaser", "teasers"}
_DECLARES_MAIN = {("role", "main"), ("itemprop", "articlebody")}
_CLOSES_P = {"p", "div", "ul", "ol", "dl", "table", "section", "article", "main", "nav", "header", "footer", "aside", "form", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "fieldset", "hr"}
_CLOSES = {"li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4}  # the scope whose open element a start tag ends
_NO_SCOPES = (-1,) * 5  # places on the stack of the open p, li, dt or dd, tr, and cell that a start tag may end


def _attributes(text: str) -> dict[str, str]:
    if not text.strip():
        return {}
    return {k.lower(): unescape(v[1:-1] if v[:1] in "\"'" else v) for k, v in reversed(_ATTR.findall(text))}


def _named(got: dict[str, str], core: set[str], around: set[str]) -> bool:
    """Whether a class or the id is made of words of both sets, one of core among them."""
    for name in f"{got.get('class', '')} {got.get('id', '')}".lower().split():
        parts = [w for w in re.split(r"[-_]+", name) if w]
        if any(w in core for w in parts) and all(w in core or w in around or w.isdigit() for w in parts):
            return True
    return False


def _is_boiler(tag: str, got: dict[str, str], in_main: bool) -> bool:
    if tag in _BOILER or (tag == "header" and not in_main):
        return True
    if not got:
        return False
    if got.get("role", "").lower() in _ROLES or "hidden" in got or got.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", got.get("style", "")):
        return True
    if tag in ("body", "html", "main"):
        return False
    if tag == "article":  # a comment or a teaser may be an article of its own
        return _named(got, _NOT_ARTICLE, _PLACES)
    return _named(got, _NAMES, _PLACES)


def _scopes(tag: str, scopes: tuple[int, ...], at: int) -> tuple[int, ...]:
    """The scopes inside the element at this place of the stack; inline elements leave them as they are."""
    p, li, item, row, cell = scopes
    if tag == "p":
        return (at, li, item, row, cell)
    if tag == "li":
        return (-1, at, -1, row, cell)
    if tag in ("dt", "dd"):
        return (-1, -1, at, row, cell)
    if tag == "tr":
        return (-1, -1, -1, at, -1)
    if tag in ("td", "th"):
        return (-1, -1, -1, row, at)
    if tag in ("div", "address"):
        return (-1, li, item, row, cell)
    return _NO_SCOPES if tag == "table" else (-1, -1, -1, row, cell)


class _Page:
    """The blocks of a page: its declared text, what is undecided, and what lies outside of a declared text."""

    def __init__(self) -> None:
        self.main: list[str] = []
        self.plain: list[str] = []
        self.outside: list[str] = []
        self.declared = False
        self._buffer: list[str] = []
        self._stack: list[tuple[str, bool, bool, bool, tuple[int, ...]]] = []  # element, boilerplate, main, raw, scopes before
        self._open: dict[str, int] = {}
        self._boiler = self._inside = self._raw = 0
        self._at = _NO_SCOPES

    def text(self, said: str) -> None:
        self._buffer.append(said)

    def flush(self) -> None:
        if not self._buffer:
            return
        text = " ".join(unescape("".join(self._buffer)).split())
        self._buffer.clear()
        if not text or self._raw:
            return
        if self._boiler:
            self.outside.append(text)
        elif self._inside:
            self.main.append(text)
        else:
            self.plain.append(text)
            self.outside.append(text)

    def _pop(self) -> None:
        tag, boiler, main, raw, self._at = self._stack.pop()
        self._open[tag] -= 1
        self._boiler, self._inside, self._raw = self._boiler - boiler, self._inside - main, self._raw - raw

    def _pop_to(self, place: int) -> None:
        while len(self._stack) > place:
            self._pop()

    def end(self, tag: str) -> None:
        if not self._open.get(tag):
            return
        inline = tag in _INLINE
        if inline and self._boiler:
            self.flush()
        while self._stack[-1][0] != tag:
            if inline and self._stack[-1][0] not in _INLINE:
                return
            self._pop()
        self._pop()

    def start(self, tag: str, attrs: str) -> None:
        if tag in _CLOSES_P and self._at[0] >= 0:
            self._pop_to(self._at[0])
        if tag in _CLOSES and self._at[_CLOSES[tag]] >= 0:
            self._pop_to(self._at[_CLOSES[tag]])
        if tag == "body":
            while self._stack and self._stack[-1][0] != "html":
                self._pop()
        got = _attributes(attrs)
        raw, main = tag in _RAW, tag in _MAIN or any(got.get(k, "").lower() == v for k, v in _DECLARES_MAIN)
        boiler = raw or _is_boiler(tag, got, self._inside > 0)
        if boiler and tag in _INLINE:
            self.flush()
        self.declared |= main and not boiler and not self._boiler
        self._stack.append((tag, boiler, main, raw, self._at))
        self._open[tag] = self._open.get(tag, 0) + 1
        self._boiler, self._inside, self._raw = self._boiler + boiler, self._inside + main, self._raw + raw
        if tag not in _INLINE:
            self._at = _scopes(tag, self._at, len(self._stack) - 1)
        if attrs.endswith("/") and tag in ("svg", "math", "path"):
            self._pop()


def read(html: str) -> _Page:
    page, at = _Page(), 0
    while at < len(html):
        t = _MARKUP.match(html, at)
        at, tag = t.end(), t["tag"]
        if tag is None:
            if (text := t[0])[0] != "<" or text == "<":
                page.text(text)
            continue
        if not t["close"]:  # cut off
            break
        tag = tag.lower()
        if tag not in _INLINE:
            page.flush()
        if t["end"]:
            page.end(tag)
        elif tag not in _VOID:
            page.start(tag, t["attrs"])
            if tag in _OPAQUE:  # nothing in it is markup but its own end
                stop = _ENDS[tag].search(html, at)
                at = stop.end() if stop else len(html)
                page.end(tag)
        elif tag == "hr" and page._at[0] >= 0:
            page._pop_to(page._at[0])
    page.flush()
    return page


def parse(html: str) -> tuple[bool, list[str], list[str]]:
    """Whether the page declares its main text, the blocks of that, or else all undecided blocks, and the blocks outside."""
    page = read(html)
    return page.declared, page.main if page.declared else page.plain, page.outside if page.declared else []


def _host(url: str | None) -> str:
    found = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found.group(1).lower() if found else ""


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.released(batches):
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            urls = part.column(1).to_pylist()
            got = [parse(h or "") for h in part.column(2).to_pylist()]
            columns = {"page_id": part.column(0), "url": part.column(1), "host": pa.array([_host(u) for u in urls], pa.string()), "declared": pa.array([d for d, _, _ in got]), "text": pa.array([" ".join(b) for _, b, _ in got], pa.string()), "outside": pa.array([" ".join(o) for _, _, o in got], pa.string())}
            yield pa.RecordBatch.from_pydict(columns)


# --- the suffix array of a host


def _digits(host: str, tokens: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Both digits of the suffixes that have MIN_TOKENS tokens or more; those of other hosts have other digits."""
    for w in tokens:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w.encode())
    h = K.mix(np.fromiter((known[w] for w in tokens), np.uint64, len(tokens)), xxhash.xxh32_intdigest(host.encode()))
    n = len(h) - MIN_TOKENS + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    folded = np.zeros(n + DIGIT, np.uint64)
    for t in range(DIGIT):
        folded = folded * K.U(K.WORD_BASE) + h[t : t + n + DIGIT]
    folded = K.mix(folded, 3).view(np.int64)
    return folded[:n], folded[DIGIT:]


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Which rows of sorted columns differ from the row before."""
    out = np.ones(len(columns[0]), dtype=bool)
    if len(out) > 1:
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _ordered_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes of each batch of pages in order, with the page's content; of equal ones those of MIN_PAGES contents."""
    for batch in K.released(batches):
        known: dict[str, int] = {}
        first, second, page = [], [], []
        for host, text, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
            a, b = _digits(host, text.split(" "), known)
            first.append(a)
            second.append(b)
            page.append(np.full(len(a), content, np.int64))
        a, b, c = (np.concatenate(x) for x in (first, second, page))
        order = np.lexsort((c, b, a))
        a, b, c = a[order], b[order], c[order]
        new = _heads(a, b, c)
        a, b, c = a[new], b[new], c[new]
        group = np.flatnonzero(_heads(a, b))
        rank = np.arange(len(a)) - np.repeat(group, np.diff(np.append(group, len(a))))
        keep = rank < MIN_PAGES
        yield pa.RecordBatch.from_pydict({"first": pa.array(a[keep]), "second": pa.array(b[keep]), "content": pa.array(c[keep])})


def _long_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range of suffixes the digits that MIN_PAGES neighbours of distinct contents or more share."""
    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        rows = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
        if not len(rows[0]):
            continue
        new = _heads(*rows)
        rows = [r[new] for r in rows]
        group = np.flatnonzero(_heads(*rows[:2]))
        size = np.diff(np.append(group, len(rows[0])))
        done = group[:-1][size[:-1] >= MIN_PAGES]  # the last may go on in the next batch
        held = [r[group[-1] :][:MIN_PAGES] for r in rows]
        yield pa.RecordBatch.from_pydict({"first": pa.array(rows[0][done]), "second": pa.array(rows[1][done])})
    last = slice(0, int(len(held[0]) >= MIN_PAGES))
    yield pa.RecordBatch.from_pydict({"first": pa.array(held[0][last]), "second": pa.array(held[1][last])})


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct digits of each page."""
    for batch in K.released(batches):
        known: dict[str, int] = {}
        for row, host, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            a, b = _digits(host, text.split(" "), known)
            if len(a):
                both = np.unique(np.stack([a, b]), axis=1)
                yield pa.RecordBatch.from_pydict({"row": pa.array(np.full(both.shape[1], row, np.int64)), "first": pa.array(both[0]), "second": pa.array(both[1])})


def _uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.released(batches):
        known: dict[str, int] = {}
        out = []
        for host, text, keys in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
            tokens, hit = text.split(" "), {(k["first"], k["second"]) for k in keys or ()}
            keep = np.ones(len(tokens), dtype=bool)
            if hit:
                for i, key in enumerate(zip(*(d.tolist() for d in _digits(host, tokens, known)))):
                    if key in hit:
                        keep[i : i + MIN_TOKENS] = False
            out.append(" ".join(w for w, k in zip(tokens, keep.tolist()) if k) if keep.any() else text)
        yield pa.RecordBatch.from_pydict({"row": batch.column(0), "unique": pa.array(out, pa.string())})


def repeated_runs(streams: DataFrame) -> DataFrame:
    """(first, second): digits of the suffixes of streams(host, text, content) that MIN_PAGES contents of one host share."""
    runs = streams.select("host", "text", "content").mapInArrow(_ordered_run, "first long, second long, content long")
    merged = runs.repartitionByRange(F.col("first"), F.col("second")).sortWithinPartitions("first", "second", "content")
    return merged.mapInArrow(_long_repeats, "first long, second long")


def main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (empty if none), n_chars (its code points)."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = rows.mapInArrow(_parsed, "page_id long, url string, host string, declared boolean, text string, outside string")
    parsed = stage(parsed.withColumn("row", F.monotonically_increasing_id()), "parsed")
    decided = parsed.where("declared or text = ''").select("page_id", "url", "text")
    undecided = parsed.where("not declared and text <> ''")
    if undecided.limit(1).count():
        hosts = stage(undecided.select("host").distinct(), "hosts")
        beside = parsed.where("declared and outside <> ''").join(hosts, "host", "left_semi").select("host", F.col("outside").alias("text"), F.xxhash64("text", "outside").alias("content"))
        repeated = stage(repeated_runs(undecided.select("host", "text", F.xxhash64("text").alias("content")).unionByName(beside)), "repeated")
        known = F.broadcast(repeated) if repeated.count() <= BROADCAST_REPEATS else repeated
        held = undecided.select("row", "host", "text").mapInArrow(_suffixes, "row long, first long, second long").join(known, ["first", "second"])
        by_row = held.groupBy("row").agg(F.collect_list(F.struct("first", "second")).alias("repeated"))
        unique = undecided.select("row", "host", "text").join(by_row, "row", "left").mapInArrow(_uncovered, "row long, unique string")
        rest = undecided.select("row", "page_id", "url").join(unique, "row").select("page_id", "url", F.col("unique").alias("text"))
        decided = decided.unionByName(rest)
    return decided.withColumn("n_chars", F.char_length("text").cast("long"))
