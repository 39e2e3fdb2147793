"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are runs of a-z, 0-9 and non-ASCII characters after A-Z are lower-cased.  Of every 13 consecutive words the
5-word gram with the least hash (the leftmost of equals) is kept, in documents and in benchmark items alike, so that
two equal 13-word windows always keep the same gram at the same place: every shared window shows as a shared
fingerprint.  The hit is then extended: the windows around a document's word that hold a shared fingerprint are looked
up whole, so that a gram that very many items and documents hold never makes pairs of them.

Items of fewer than 13 words are one window each; in documents that hold the item's rarest word every place of the
item is looked up.  Equal windows of several items are one window until
the last step.  The fingerprints of the benchmark are broadcast only while they are few (counted); beyond that they
are joined by shuffle.  Null texts have no words; equal rows give equal results; null item ids name no item.

Words are arrays of the heap, some twenty times as large as their text.  Texts of more than PIECE_BYTES are therefore searched in
pieces that share their edges, so that no row's words grow with its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.staging import keep, scratch, stage

WINDOW, GRAM = 13, 5
SPAN = WINDOW - GRAM + 1
BROADCAST_ROWS, BROADCAST_KEYS = 200_000, 1_000_000
PIECE_BYTES, EDGE_BYTES = 1 << 20, 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
INNER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # of a word, before it is lower-cased
_MASK = (1 << 31) - 1


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), lambda w: w != "")


def _pieces(rows: DataFrame) -> DataFrame:
    """(doc_id, body, part, text, after) of rows(doc_id, text): texts of up to PIECE_BYTES whole; longer ones in pieces, which are staged.

    The words that start in a piece's own PIECE_BYTES are whole in it, and so are the `after` words that follow: WINDOW - 1
    at least, or all that are left.  Thus each run of up to WINDOW words lies in the piece in which it starts.
    """
    whole = rows.select("doc_id", F.xxhash64("text").alias("body"), F.lit(0).alias("part"), "text", F.lit(0).alias("after"))
    long = rows.where(F.octet_length("text") > PIECE_BYTES)
    if not long.limit(1).count():
        return whole
    n = F.octet_length("text").cast("long")

    def clean(raw: Column, start: Column, end: Column) -> Column:
        """The bytes from start to end without words that began before start (the byte before it tells) or go on at end."""
        text = F.substring(raw, F.greatest(start, F.lit(1)).cast("int"), (end - F.greatest(start - 1, F.lit(0))).cast("int")).cast("string")
        text = F.when(start > 0, F.regexp_replace(text, f"^{INNER}+", "")).otherwise(text)
        return F.when(end < n, F.regexp_replace(text, rf"(?<!{INNER}){INNER}+\z", "")).otherwise(text)

    def cuts(raw: Column, first: Column) -> Column:
        stop = F.least(n, first + PIECE_BYTES)
        ends = [F.least(n, stop + k * EDGE_BYTES) for k in (1, 16, 256)]
        end = F.coalesce(*(F.when((e == n) | (F.size(words(clean(raw, stop, e))) >= WINDOW - 1), e) for e in ends), n)
        after = lambda e: F.when(stop < n, F.size(words(clean(raw, stop, e)))).otherwise(F.lit(0))
        return F.transform(F.array(end), lambda e: F.struct((first / PIECE_BYTES).cast("int").alias("part"), clean(raw, first, e).alias("text"), after(e).alias("after")))

    # the bytes are bound by a lambda: as a column, each use would copy them, and so would each piece's row
    starts = F.sequence(F.lit(0).cast("long"), n - 1, F.lit(PIECE_BYTES).cast("long"))
    found = F.flatten(F.flatten(F.transform(F.array(F.col("text").cast("binary")), lambda raw: F.transform(starts, lambda first: cuts(raw, first)))))
    cut = stage(long.select("doc_id", F.xxhash64("text").alias("body"), F.inline(found)), "pieces")
    return whole.where(F.coalesce(F.octet_length("text") <= PIECE_BYTES, F.lit(True))).unionAll(cut)


def _in_whole(spans: DataFrame, drawn: DataFrame) -> DataFrame:
    """The spans of pieces, with the starts that they have in the whole text; only texts of several pieces have parts above 0."""
    sizes = drawn.select(F.col("doc_id").alias("d"), F.col("body").alias("b"), F.col("part").alias("p"), "n_words").distinct()
    several = sizes.where("p > 0").select(F.col("d").alias("sd"), F.col("b").alias("sb")).distinct()
    sizes = sizes.join(_small(several), sizes.d.eqNullSafe(several.sd) & (sizes.b == several.sb), "left_semi")
    bases = stage(sizes.select("d", "b", "p", F.coalesce(F.sum("n_words").over(Window.partitionBy("d", "b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")), "bases")
    moved = spans.join(_small(bases), spans.doc_id.eqNullSafe(bases.d) & (spans.body == bases.b) & (spans.part == bases.p), "left")
    return moved.select("doc_id", "body", (F.col("start") + F.coalesce("base", F.lit(0))).cast("int").alias("start"), "n", "window").distinct()


def _pair_min(step: int) -> Column:
    return F.transform("m", lambda x, i: F.least(x, F.get(F.col("m"), i + step)))


def _with_winnow(df: DataFrame) -> DataFrame:
    """Add `grams` (hash of the gram from each word on) and `kept`: packed (hash, place) of each window's gram."""
    at = lambda c, i, k: F.get(F.col(c), i + k)
    df = df.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))
    df = df.withColumn("grams", F.transform("wh", lambda x, i: F.xxhash64(x, *(at("wh", i, k) for k in range(1, GRAM)))))
    df = df.withColumn("m", F.transform(F.slice("grams", 1, F.greatest(F.size("grams") - GRAM + 1, F.lit(0))), lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 32), 31).bitwiseOR(i.cast("long"))))
    df = df.withColumn("p", F.col("m"))
    width = 1
    while 2 * width <= SPAN:
        df = df.withColumn("m", _pair_min(width))
        width *= 2
    if width < SPAN:
        df = df.withColumn("m", _pair_min(SPAN - width))
    n = F.greatest(F.size("w") - WINDOW + 1, F.lit(0))
    return df.withColumn("kept", F.array_distinct(F.slice("m", 1, n))).drop("m", "p", "wh")


def _fingerprints() -> Column:
    return F.transform("kept", lambda v: F.struct(F.get(F.col("grams"), v.bitwiseAND(_MASK).cast("int")).alias("gram"), v.bitwiseAND(_MASK).cast("int").alias("place")))


def _small(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Broadcast up to BROADCAST_ROWS rows, or elements of the array `weight`; more are joined by shuffle."""
    n = df.agg(F.sum(F.size(weight) + 1)).first()[0] or 0 if weight else df.count()
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _keys(df: DataFrame) -> DataFrame:
    """Broadcast up to BROADCAST_KEYS rows of 16 bytes; beyond, Spark filters large inputs by a Bloom filter of the keys before it shuffles them."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _search(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, body, n_words, ...) of every row, the spans (doc_id, body, start, n, window), and the items' (item, w, window)."""
    items = stage(benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text").cast("string")).alias("w")).where("size(w) > 0"), "items")
    cut = F.when(F.size("w") >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1))), lambda i: F.slice("w", i, WINDOW))).otherwise(F.array("w"))
    owned = stage(items.select("item", F.explode(F.array_distinct(cut)).alias("w")).withColumn("window", F.xxhash64(F.array_join("w", " "))), "windows")
    windows = stage(owned.groupBy("window", "w").agg(F.count("*").alias("owners")).select("window", "w"), "distinct")
    long, short = windows.where(F.size("w") == WINDOW), windows.where(F.size("w") < WINDOW)
    grams = stage(_with_winnow(long).select(F.explode(_fingerprints()).alias("f")).select("f.gram").distinct(), "grams")

    rows = _pieces(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    keyed = rows.select("doc_id", "body", "part", "after", words(F.col("text")).alias("w"))
    drawn = _with_winnow(keyed)
    n_short = short.count()
    extra = {"terms": F.array_distinct("w")} if n_short else {}
    drawn = stage(drawn.select("doc_id", "body", "part", (F.size("w") - F.col("after")).cast("long").alias("n_words"), _fingerprints().alias("fingerprints"), *(c.alias(k) for k, c in extra.items())), "winnowed")

    marked = drawn.select("doc_id", "body", "part", F.explode("fingerprints").alias("f")).select("doc_id", "body", "part", "f.gram", "f.place").join(_small(grams), "gram", "left_semi")
    marked = stage(marked.groupBy("doc_id", "body", "part").agg(F.collect_set("place").alias("places")), "marked")
    around = F.transform("places", lambda p: F.sequence(F.greatest(p - SPAN + 1, F.lit(0)), F.least(p, F.size("w") - WINDOW)))
    tried = _texts_of(rows, marked).select("doc_id", "body", "part", "w", F.explode(F.array_distinct(F.flatten(around))).alias("start"))
    tried = tried.select("doc_id", "body", "part", "start", F.slice("w", F.col("start") + 1, WINDOW).alias("is")).withColumn("window", F.xxhash64(F.array_join("is", " ")))
    spans = tried.join(_small(long), "window").where(F.col("is") == F.col("w")).select("doc_id", "body", "part", "start", F.lit(WINDOW).alias("n"), "window")
    if n_short:
        spans = spans.unionAll(_short_spans(rows, drawn, stage(short, "short")))
    spans = stage(spans, "spans")
    if not drawn.where("part > 0").limit(1).count():
        return drawn, spans.drop("part"), owned
    return _whole_rows(drawn), stage(_in_whole(spans, drawn), "spans"), owned


def _whole_rows(drawn: DataFrame) -> DataFrame:
    """One row of each text, that of its first piece, with the words of all of its pieces; equal rows count their words once."""
    sizes = drawn.select("doc_id", "body", "part", "n_words").distinct().where("part > 0").groupBy("doc_id", "body").agg(F.sum("n_words").alias("more"))
    return _same(drawn.where("part = 0"), stage(sizes, "sizes"), ["more"]).withColumn("n_words", F.col("n_words") + F.coalesce("more", F.lit(0)))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, body (xxhash64 of the text), n_words, n_hit, n_items, items_sha256, contaminated, longest (words of the longest window hit)."""
    with scratch(docs.sparkSession):
        return keep(_judged(docs, benchmark))


def _judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    drawn, spans, owned = _search(docs, benchmark)
    held = spans.groupBy("doc_id", "body").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))))
    named = _named(spans, owned)
    longest = F.array_max(F.transform("spans", lambda s: s["n"]))
    counts = held.select("doc_id", "body", covered.cast("long").alias("n_hit"), longest.alias("longest"))
    result = _same(counts, named, ["n_items", "items_sha256"])
    out = _same(drawn.select("doc_id", "body", "n_words"), result, ["n_hit", "n_items", "items_sha256", "longest"])
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "body", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"), F.coalesce("longest", F.lit(0)).alias("longest"))


def _named(spans: DataFrame, owned: DataFrame) -> DataFrame:
    """Per text with a hit: n_items and items_sha256, the items whose windows it holds.

    Windows of the same items are one set, and texts with the same sets are one case that is named once: a passage
    that many items and very many texts hold never makes pairs of them.
    """
    sets = stage(owned.where("item is not null").groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("owners", F.xxhash64(F.array_join(F.transform("items", lambda i: F.concat(F.length(i), F.lit(":"), i)), ","))), "owners")
    texts = spans.select("doc_id", "body", "window").distinct().join(_small(sets.select("window", "owners")), "window")
    texts = stage(texts.groupBy("doc_id", "body").agg(F.array_sort(F.collect_set("owners")).alias("sets")).withColumn("case", F.xxhash64("sets")), "cases")
    members = texts.select("case", "sets").dropDuplicates(["case"]).select("case", F.explode("sets").alias("owners"))
    items = members.join(_small(sets.select("owners", "items").dropDuplicates(["owners"]), "items"), "owners").groupBy("case").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    names = stage(items.select("case", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "names")
    return texts.select("doc_id", "body", "case").join(_small(names), "case").drop("case")


def _grams(w: Column) -> Column:
    """Hashes of all runs of GRAM words."""
    starts = F.when(F.size(w) >= GRAM, F.sequence(F.lit(1), F.greatest(F.size(w) - GRAM + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(w, i, GRAM), " ")))


def remains(docs: DataFrame, before: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, body) of the texts of docs that still hold GRAM words in a row of a window that the text of this id held in `before`.

    For texts that were cut since: a passage may have lost so much that no window of it is left whole.  Ids may be
    null or repeated; what is known of an id is a set of grams of the benchmark, so that it never grows with its rows.
    """
    with scratch(docs.sparkSession):
        return keep(_remains(docs, before, benchmark))


def _remains(docs: DataFrame, before: DataFrame, benchmark: DataFrame) -> DataFrame:
    _, spans, owned = _search(before, benchmark)
    grams = owned.select("window", "w").dropDuplicates(["window"]).select("window", F.explode(_grams(F.col("w"))).alias("gram"))
    known = spans.select(F.col("doc_id").alias("d"), "window").distinct().join(_small(grams), "window").groupBy("d").agg(F.collect_set("gram").alias("grams"))
    known = stage(known, "known")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = known.select(F.col("d").alias("known_id"))
    some = _pieces(rows.join(_keys(ids), rows.doc_id.eqNullSafe(ids.known_id), "left_semi"))  # texts of other ids are not shuffled
    both = some.join(_small(known, "grams"), some.doc_id.eqNullSafe(known.d)).select("doc_id", "body", "text", "grams")
    # the words are bound by a lambda: as a column, Catalyst would push them into the filter and split the text once for every gram
    held = F.exists(F.array(words(F.col("text"))), lambda w: F.arrays_overlap("grams", _grams(w)))
    return both.where(held).select("doc_id", "body").distinct()


def _texts_of(rows: DataFrame, found: DataFrame) -> DataFrame:
    """found(doc_id, body, part, ...) with the words w of those pieces of rows; rows that are equal in id and text count once."""
    r = found.withColumnsRenamed({"doc_id": "d", "body": "b", "part": "p"})
    texts, keys = rows.drop("after"), r.select(F.col("d").alias("kd"), F.col("b").alias("kb"), F.col("p").alias("kp"))
    texts = texts.join(_keys(keys), texts.doc_id.eqNullSafe(keys.kd) & (texts.body == keys.kb) & (texts.part == keys.kp), "left_semi")  # other texts are not shuffled
    both = texts.join(_small(r, r.columns[-1]), texts.doc_id.eqNullSafe(r.d) & (texts.body == r.b) & (texts.part == r.p)).drop("d", "b", "p")
    return both.dropDuplicates(["doc_id", "body", "part"]).withColumn("w", words(F.col("text"))).drop("text")


def _short_spans(rows: DataFrame, drawn: DataFrame, short: DataFrame) -> DataFrame:
    """Spans of items of fewer than WINDOW words: in the texts that hold the item's rarest word, every place of it."""
    needed = short.select("window", F.explode(F.array_distinct("w")).alias("term"))
    have = drawn.select("doc_id", "body", "part", F.explode("terms").alias("term")).join(_small(needed.select("term").distinct()), "term", "left_semi").distinct()
    have = stage(have, "terms")
    times = have.groupBy("term").agg(F.count("*").alias("times"))
    rarest = needed.join(times, "term", "left").groupBy("window").agg(F.min_by("term", F.struct(F.coalesce("times", F.lit(0)), "term")).alias("term"))
    asked = have.join(_small(stage(rarest.join(short, "window").select("term", "window", F.col("w").alias("is")), "rarest")), "term")
    asked = stage(asked.groupBy("doc_id", "body", "part").agg(F.collect_list(F.struct("window", "is")).alias("claims")), "claims")
    places = lambda c: F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (F.get(F.col("w"), i) == F.get(c["is"], F.lit(0))) & (F.slice(F.col("w"), i + 1, F.size(c["is"])) == c["is"]))
    true = F.flatten(F.transform("claims", lambda c: F.transform(places(c), lambda i: F.struct(i.alias("start"), F.size(c["is"]).alias("n"), c["window"].alias("window")))))
    return _texts_of(rows, asked).select("doc_id", "body", "part", F.inline(true))


def _same(left: DataFrame, right: DataFrame, take: list[str]) -> DataFrame:
    r = right.select(F.col("doc_id").alias("d"), F.col("body").alias("b"), *take)
    return left.join(r, left.doc_id.eqNullSafe(r.d) & (left.body == r.b), "left").drop("d", "b")


def oracle() -> str:
    """The same in DuckDB's SQL, by all windows instead of fingerprints."""
    split = lambda c: f"list_filter(regexp_split_to_array(translate(coalesce({c}, ''), '{UPPER}', '{LOWER}'), '{GAP}'), lambda x: x <> '')"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, {split('text')} AS w FROM documents),
i AS (SELECT item_id, {split('text')} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[k:k + least(len(w), {WINDOW}) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hit AS MATERIALIZED (SELECT DISTINCT doc_id, k, dw.n, item_id FROM dw JOIN iw ON dw.s = iw.s AND dw.n = iw.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
