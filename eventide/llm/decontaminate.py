"""Benchmark decontamination over a positional inverted index, in DataFrame functions only.

The index stores a document's words in rows of ``CHUNK`` words (each with the first words of the
next, so that a window never crosses a row) and, for the terms that the benchmark uses, their
postings (term, document, position), sorted by term within each shard of documents. An item is
cut into windows of ``n`` consecutive words, equal windows of all items being one. Of each window
the ``LISTS`` terms that are rarest in the index are looked up; a position less the term's offset
is where the window would start, and lists are intersected by counting the terms that agree on a
start. What is left is compared word by word with the stored words, so matches are exact; rows of words
without a candidate are told by a bitmap of bounded size and stay where they are.
``proximity_matches`` asks instead for a window's rarest terms within a span, in any order.

Postings stay in the shard of their document: a term that a third of all words repeat is spread
like the documents. Windows travel to the shards, ``BLOCK`` asked terms at a time, so what is
broadcast has a fixed bound. The asked terms' bare postings are dealt by document, so that
candidates (many windows ask for one term) are counted where they are made, never shuffled.

Terms are compared by a 64-bit hash until the words themselves are. Null and empty texts have no
words; such a document has a row of zeros and such an item no window. An item of fewer than ``n``
words is one window. Rows are told apart by a number given when the index is written: repeated
rows and null or repeated doc_ids have a result each. Items are named by item_id: rows that
share one count once, and items without one mark words but are not listed. Texts of any length
are read in rows of ``CHUNK`` words. Empty tables give empty results or zeros; extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, settled, stored

#: Words of a document that one row holds.
CHUNK = 256
#: Terms of a window whose postings are intersected.
LISTS = 3
#: Asked terms (of some 24 bytes) that are sent to the postings at once; as many bytes are
#: broadcast for their windows' words again, eightfold.
BLOCK = 300_000
#: Bits (as a power of two) that mark the rows of words which candidates lie in: 32 MB at most.
MARK_BITS = 28
#: Distinct benchmark terms up to which the index keeps their postings only.
BROADCAST_TERMS = 2_000_000


def terms_of(text: Column) -> Column:
    """The words of a text: runs of digits, letters a-z and characters beyond ASCII, A-Z lowered."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


@dataclass(frozen=True)
class Index:
    """``texts``: uid, doc_id, n_words, at (the row's first position), words. ``postings``: term, uid, pos."""

    texts: DataFrame
    postings: DataFrame
    n: int


def build_index(docs: DataFrame, n: int = 10, terms: DataFrame | None = None, text: str = "text") -> Index:
    """Write the index for windows of up to ``n`` words. ``terms`` (one column of strings): the only
    ones that will be asked for; None keeps the postings of every word."""
    cut = settled(docs.select("doc_id", F.col(text).alias("_t")), _w=terms_of(F.col("_t")))
    named = cut.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), "_w")
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("_w") - 1, F.lit(0)), F.lit(CHUNK))).alias("at")
    rows = named.select("uid", "doc_id", F.size("_w").cast("bigint").alias("n_words"), at, "_w")
    texts = stored(rows.select("uid", "doc_id", "n_words", "at", F.slice("_w", F.col("at") + 1, CHUNK + n - 1).alias("words")), "texts")
    flat = texts.select("uid", "at", F.posexplode(F.slice("words", 1, CHUNK)).alias("i", "word"))
    postings = flat.select(F.xxhash64("word").alias("term"), "uid", (F.col("at") + F.col("i")).alias("pos"))
    if terms is not None:
        asked = stored(terms.select(F.xxhash64(F.col(terms.columns[0])).alias("term")).distinct(), "terms")
        if asked.count() <= BROADCAST_TERMS:
            postings = postings.join(F.broadcast(asked), "term", "left_semi")
    return Index(texts, stored(postings.sortWithinPartitions("term", "uid", "pos"), "postings"), n)


@dataclass(frozen=True)
class Windows:
    """``words``: wid, words (each window once). ``members``: wid, item_id."""

    words: DataFrame
    members: DataFrame


def cut_windows(items: DataFrame, n: int = 10, text: str = "text") -> Windows:
    """The windows of ``n`` consecutive words of the items."""
    w = settled(items.select("item_id", F.col(text).alias("_t")), _w=terms_of(F.col("_t"))).where(F.size("_w") > 0)
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.size("_w") - n, F.lit(0)))).alias("at")
    each = stored(w.select("item_id", start, "_w").select("item_id", F.slice("_w", F.col("at") + 1, n).alias("words")).distinct(), "windows")
    words = stored(each.select("words").distinct().select(F.monotonically_increasing_id().alias("wid"), "words"), "distinct-windows")
    return Windows(words, stored(each.where("item_id is not null").join(words, "words").select("wid", "item_id"), "members"))


def rarest(index: Index, windows: Windows, lists: int = LISTS, apart: bool = False) -> DataFrame:
    """wid, need (how many), rank, offset and term of each window's rarest terms in the index;
    windows with a term that it doesn't hold are left out. ``apart``: equal terms count once."""
    counts = index.postings.groupBy("term").agg(F.count("*").alias("n"))
    asked = windows.words.select("wid", F.posexplode("words").alias("offset", "word")).withColumn("term", F.xxhash64("word"))
    if apart:
        asked = asked.groupBy("wid", "term").agg(F.min("offset").alias("offset"))
    known = asked.join(counts, "term", "left").groupBy("wid").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))).alias("t"))
    few = known.where(F.get("t", F.lit(0))["n"] > 0).select("wid", F.least(F.size("t"), F.lit(lists)).alias("need"), F.posexplode(F.slice("t", 1, lists)).alias("rank", "t"))
    return stored(few.select("wid", "need", "rank", "t.offset", "t.term"), "asked")


def _blocks(asked: DataFrame) -> list[DataFrame]:
    """``asked`` in parts of ``BLOCK`` rows at most on average, windows whole."""
    n = -(-asked.count() // BLOCK) or 1
    return [asked.where(F.pmod(F.xxhash64("wid"), F.lit(n)) == k) for k in range(n)] if n > 1 else [asked]


def _lists(index: Index, block: DataFrame) -> DataFrame:
    """The postings of the terms that a block asks for, each beside every window that asks. Bare
    postings are dealt by document first: their windows, which are many more rows, then meet in place."""
    bare = index.postings.join(F.broadcast(block.select("term").distinct()), "term", "left_semi").repartition("uid")
    return bare.join(F.broadcast(block), "term")


def _marked(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of ``texts`` that (uid, at) of ``asked`` may name: a bitmap of their hashes, of
    ``MARK_BITS`` bits at most whatever there is to mark, goes to the texts, so that few others are shuffled."""
    bits = min(MARK_BITS, max(15, (64 * asked.count()).bit_length()))
    h = F.pmod(F.xxhash64("uid", "at"), F.lit(1 << bits))
    marks = asked.groupBy(F.bitmap_bucket_number(h).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("_bitmap"))
    at = texts.withColumns({"_bucket": F.bitmap_bucket_number(h), "_bit": F.bitmap_bit_position(h)}).join(F.broadcast(marks), "_bucket")
    byte = F.expr("cast(conv(hex(substring(_bitmap, cast(_bit div 8 + 1 as int), 1)), 16, 10) as int)")
    return at.where(F.floor(byte / F.pow(F.lit(2), F.col("_bit") % 8)) % 2 == 1).select(*texts.columns)


def phrase_matches(index: Index, windows: Windows, lists: int = LISTS) -> DataFrame:
    """wid, uid, start and size (words) of every occurrence of a window in the documents."""
    found = []
    for block in _blocks(rarest(index, windows, lists)):
        at = _lists(index, block).select("wid", "need", "uid", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
        agree = at.groupBy("wid", "uid", "start").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n = need").select("wid", "uid", "start")
        words = windows.words.join(F.broadcast(block.select("wid").distinct()), "wid", "left_semi")
        found.append(agree.join(F.broadcast(words), "wid"))
    asked = reduce(DataFrame.unionByName, found).withColumnRenamed("words", "window").withColumn("at", F.expr(f"start div {CHUNK} * {CHUNK}").cast("int"))
    asked = stored(asked, "candidates")
    text = _marked(index.texts.select("uid", "at", "words"), asked).hint("merge")
    same = F.slice("words", F.col("start") - F.col("at") + 1, F.size("window")) == F.col("window")
    return stored(asked.join(text, ["uid", "at"]).where(same).select("wid", "uid", F.col("start").cast("bigint"), F.size("window").cast("bigint").alias("size")), "matches")


def proximity_matches(index: Index, windows: Windows, span: int = 30, lists: int = LISTS) -> DataFrame:
    """wid, uid, first and last: wherever a window's rarest ``lists`` distinct terms stand within
    ``span`` words in any order, ended by a term and begun as late as can be."""
    found = []
    for block in _blocks(rarest(index, windows, lists, apart=True)):
        at = _lists(index, block).select("wid", "need", "rank", "uid", "pos")
        order = Window.partitionBy("wid", "uid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        last = [F.last(F.when(F.col("rank") == r, F.col("pos")), ignorenulls=True).over(order) for r in range(lists)]
        seen = F.array_compact(F.array(*last))
        near = at.select("wid", "need", "uid", F.col("pos").alias("last"), seen.alias("seen")).where("size(seen) = need").withColumn("first", F.array_min("seen"))
        found.append(near.where(F.col("last") - F.col("first") < span).select("wid", "uid", F.col("first").cast("bigint"), F.col("last").cast("bigint")))
    return reduce(DataFrame.unionByName, found)


def hit_spans(matches: DataFrame) -> DataFrame:
    """uid, first and end (exclusive) of the runs of words that matches cover; runs don't touch."""
    longest = matches.groupBy("uid", "start").agg((F.col("start") + F.max("size")).alias("end"))
    order = Window.partitionBy("uid").orderBy("start")
    past = longest.withColumn("_past", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    runs = past.withColumn("_run", F.sum(F.when(F.col("start") <= F.col("_past"), 0).otherwise(1)).over(order))
    return runs.groupBy("uid", "_run").agg(F.min("start").alias("first"), F.max("end").alias("end")).drop("_run")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item_text: str = "text") -> DataFrame:
    """For every document: doc_id, n_words, n_hit (words inside an occurrence of a window), spans
    (first, end) of hit words, items (sorted as strings) and contaminated."""
    windows = cut_windows(benchmark, n, item_text)
    index = build_index(docs, n, windows.words.select(F.explode("words")), text)
    matches = phrase_matches(index, windows)
    hits = hit_spans(matches).groupBy("uid").agg(F.sum(F.col("end") - F.col("first")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("first", "end"))).alias("spans"))
    named = matches.select("uid", "wid").distinct().join(windows.members, "wid").select("uid", F.col("item_id").cast("string").alias("item")).distinct()
    items = named.groupBy("uid").agg(F.sort_array(F.collect_list("item")).alias("items"))
    rows = index.texts.where("at = 0").select("uid", "doc_id", "n_words")
    out = rows.join(hits.join(items, "uid", "left").hint("merge"), "uid", "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("spans", F.array().cast("array<struct<first:bigint,end:bigint>>")).alias("spans"), F.coalesce("items", none).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))
