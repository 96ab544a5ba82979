"""Status samples of a search response, wherever in its envelopes their list stands.

A response is an array of statuses, or an object that holds the array under one of ``LISTS``, or
one that holds such a response under data or Data, as deep as may be, or a lone status. Objects
are opened level by level as VARIANT columns: a level's rows are the responses that are still an
envelope. Of several places the first counts, in the order data, Data, the object itself; one
that holds a list, even an empty one, isn't searched further.

A response that isn't JSON, or is null, holds nothing. An array's elements that don't look like a
status (no text and no id) are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ENVELOPE_LISTS, ENVELOPE_TOTALS, STATUS_KEYS
from ..functions import text as X
from ..functions.settle import settled
from .shared import stored

_INNER = ("data", "Data")


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _list(v: Column) -> Column:
    return _get(v, "$", "array<variant>")


def _status(v: Column) -> Column:
    keys = F.map_keys(_get(v, "$", "map<string,variant>"))
    return F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, STATUS_KEYS))), F.lit(False))


def _first(found: list[Column], f: Callable[[Column], Column] = lambda v: v) -> Column:
    """The first value of ``f`` over some columns that isn't null."""
    return F.get(F.filter(F.transform(F.array(*found), f), lambda x: x.isNotNull()), F.lit(0))


def whole(v: Column) -> Column:
    """A number, or a text that is one, as bigint; a flag or anything else is null."""
    kind = F.schema_of_variant(v)
    number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), F.try_variant_get(v, "$", "double"))
    exact = F.when(kind.isin("BIGINT"), F.try_variant_get(v, "$", "bigint"))
    text = F.trim(F.when(kind == "STRING", F.try_variant_get(v, "$", "string")))
    return F.coalesce(exact, F.floor(F.abs(number)) * F.signum(number), F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))).cast("bigint")


def opened(df: DataFrame, key: str, payload: str = "payload", deepest: int = 64) -> DataFrame:
    """key, path, items and total of every object and array that ends a search, in all envelopes.

    ``path`` orders the places: 0 for data, 1 for Data, 2 for the end. ``total``: the number a level
    names, with ``level`` (the path without its end)."""
    at = df.select(F.col(key).alias("key"), F.lit("").alias("level"), F.try_parse_json(payload).alias("v"))
    ends = []
    for depth in range(deepest):
        own = _first([F.col("v"), *[_get("v", f"$.{k}") for k in ENVELOPE_LISTS]], _list)
        total = _first([_get("v", f"$.{k}") for k in ENVELOPE_TOTALS], whole)
        here = settled(at, list=own, total=total)
        items = F.coalesce(F.filter("list", _status), F.when(_status("v"), F.array("v")).otherwise(F.array().cast("array<variant>")))
        ends.append(here.select("key", "level", "total", F.transform(items, lambda x: F.to_json(x)).alias("items"), F.col("list").isNotNull().alias("listed")))
        inner = F.explode(F.array(*[F.struct(F.lit(str(k)).alias("k"), _get("v", f"$.{name}").alias("v")) for k, name in enumerate(_INNER)])).alias("x")
        at = here.select("key", "level", inner).where("x.v is not null").select("key", F.concat("level", "x.k").alias("level"), "x.v")
        at = stored(at.select("key", "level", F.to_json("v").alias("v")), f"level-{depth}").withColumn("v", F.parse_json("v"))
        if at.isEmpty():
            return reduce(DataFrame.unionByName, ends)
    raise ValueError(f"a response has more than {deepest} envelopes one in another")


def statuses(df: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """key, pos, total, status_id, mid, text (the long one if there is one), url, author, created_at,
    reposts, comments, likes and flags of every status of every response."""
    places = opened(df, key, payload)
    # What stands below an object with a list isn't searched, for lists; totals are looked for everywhere.
    listed = places.where("listed").select(F.col("key").alias("_key"), F.col("level").alias("_level"))
    under = (F.col("key") == F.col("_key")) & (F.length("level") > F.length("_level")) & F.col("level").startswith(F.col("_level"))
    free = places.where("size(items) > 0").join(listed, under, "left_anti")
    best = free.groupBy("key").agg(F.min_by("items", F.concat("level", F.lit("2"))).alias("items"))
    named = places.where("total is not null").groupBy("key").agg(F.min_by("total", "level").alias("total"))
    each = best.join(named, "key", "left").select("key", "total", F.posexplode("items").alias("pos", "_item")).withColumn("_v", F.parse_json("_item"))
    first = lambda *names: F.coalesce(*[F.try_variant_get("_v", f"$.{n}", "string") for n in names])
    count = lambda *names: _first([_get("_v", f"$.{n}") for n in names], whole)
    long = F.try_variant_get("_v", "$.long_text.long_text_content", "string")
    text = F.coalesce(F.when(F.trim(long) != "", long), first("text", "text_raw", "content"))
    created = first("created_at", "createdAt")
    parsed = F.coalesce(F.try_to_timestamp(F.regexp_replace(created, r"^[A-Za-z]{3}\s+", ""), F.lit("MMM dd HH:mm:ss Z yyyy")), created.try_cast("timestamp"))
    ids = first("idstr", "id", "mid")
    missing = {"missing_id": F.coalesce(ids, F.lit("")) == "", "missing_text": F.coalesce(text, F.lit("")) == "", "missing_created_at": F.coalesce(created, F.lit("")) == ""}
    return each.select(
        F.col("key").alias(key), "pos", "total", ids.alias("status_id"), first("mid").alias("mid"), X.clean_body(text).alias("text"), first("url", "scheme").alias("url"),
        F.coalesce(F.try_variant_get("_v", "$.user.screen_name", "string"), F.try_variant_get("_v", "$.user.name", "string")).alias("author"), parsed.alias("created_at"),
        count("reposts_count", "repost_count").alias("reposts"), count("comments_count", "comment_count").alias("comments"), count("attitudes_count", "like_count", "likes_count").alias("likes"),
        F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in missing.items()])).alias("flags"),
    )
