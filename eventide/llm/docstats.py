"""Text statistics as Spark columns, for the quality rules and the quality classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, settled, words

SYMBOLS = "#*$%&|<>"


def n_of(text: Column, chars: str) -> Column:
    """How many characters of a text are among ``chars`` (ASCII)."""
    class_ = "".join(c if c.isalnum() else f"\\{c}" for c in chars)
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{class_}]", ""))).cast("bigint")


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, _t (the text, null as empty), _w (its words), _l (its lines that have a word)."""
    t = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_t"))
    return settled(t, _w=words(F.col("_t")), _l=F.filter(F.split("_t", "\n"), lambda x: F.length(F.trim(x, F.lit(SPACE))) > 0))


def repeat_words(df: DataFrame, n: int = 3) -> DataFrame:
    """Adds n_repeat_words: the words in ``n``-word windows that the text holds twice or more.

    Windows are bare hashes first; a text with as many distinct ones as windows repeats nothing.
    In other texts windows are sorted by hash and position, and equal neighbours mark a repeat. The
    marked starts, in order, each cover the words up to the next start, ``n`` at most: n log n
    steps a text. Each step is a column of its own, so that none is worked out twice."""
    windows = F.greatest(F.size("_w") - n + 1, F.lit(0))
    df = settled(df, _h=F.transform(F.slice("_w", F.lit(1), windows), lambda x, i: F.xxhash64(x, *[F.get("_w", i + k) for k in range(1, n)])))
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = settled(df, _s=F.when(repeats, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))
    same = lambda x, i: F.coalesce(F.get("_s", i)["h"] == x["h"], F.lit(False))
    marked = F.filter("_s", lambda x, i: same(x, i - 1) | same(x, i + 1))
    df = settled(df, _m=F.sort_array(F.transform(marked, lambda x: x["i"])))
    cover = F.transform("_m", lambda p, k: F.least(F.lit(n), F.coalesce(F.get("_m", k + 1) - p, F.lit(n))).cast("bigint"))
    return settled(df, n_repeat_words=F.aggregate(cover, F.lit(0).cast("bigint"), lambda a, x: a + x)).drop("_h", "_s", "_m")
