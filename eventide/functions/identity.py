"""Keys under which the same thing is known again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_words


def item_hash(source: Column, external: Column, url: Column, title: Column, published: Column, fetched: Column) -> Column:
    """SHA-256 of the first that is there: id, link, title and publication day, title and fetch."""
    known = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    return F.sha2(F.coalesce(
        F.concat(source, F.lit("|external|"), known(external)),
        F.concat(source, F.lit("|url|"), known(url)),
        F.concat(source, F.lit("|title_date|"), known(title), F.lit("|"), F.date_format(published, "yyyy-MM-dd")),
        F.concat(source, F.lit("|title_fetched|"), F.coalesce(known(title), F.lit("")), F.lit("|"), F.coalesce(fetched.cast("string"), F.lit(""))),
    ), 256)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def canonical_id(url: Column) -> Column:
    """Id of a question page of the Q&A platform; look-alike hosts have none."""
    number = F.regexp_extract(url, r"^https?://[^/?#]+/question/(\d+)(?:/|$|\?|#)", 1)
    return F.when(host(url).rlike(r"(^|\.)zhihu\.com$") & (number != ""), F.concat(F.lit("zhihu:question:"), number))


def url_key(url: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.trim(url)), "/+$", ""), F.lit(""))


def without_tracking(url: Column) -> Column:
    """The link without query parameters that begin with utm_."""
    query = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    kept = F.array_join(F.filter(query, lambda q: (q != "") & ~F.startswith(F.lower(q), F.lit("utm_"))), "&")
    return F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def safe_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://[^/\s]+"), F.lit(False))


def event_fingerprint(entities: Column, actions: Column, keywords: Column, day: Column, ids: Column, title: Column, signal_id: Column) -> Column:
    """SHA-256 of the parts that aren't empty; else of the title, else of the signal's id."""
    part = lambda a: F.nullif(F.array_join(a, ","), F.lit(""))
    parts = F.concat_ws("|", part(F.array_sort(entities)), part(F.array_sort(actions)), part(F.slice(keywords, 1, 5)), F.nullif(day, F.lit("")), part(F.array_sort(ids)))
    return F.sha2(F.coalesce(F.nullif(parts, F.lit("")), F.nullif(normalize_words(title), F.lit("")), signal_id), 256)


def event_id(fingerprint: Column, day: Column) -> Column:
    """``day`` is a yyyymmdd text; the caller gives one where the event has no time."""
    return F.concat(F.lit("evt_"), day, F.lit("_"), F.substring(fingerprint, 1, 12))


def agenda_id(day: Column, title: Column) -> Column:
    return F.concat(F.lit("official-"), F.substring(F.sha2(F.concat(day, F.lit(":"), normalize_words(title)), 256), 1, 24))


def signal_id(source_id: Column, item_id: Column) -> Column:
    return F.concat(F.lit("source:"), F.substring(F.sha2(F.concat(source_id, F.lit(":"), item_id), 256), 1, 24))


def event_signal_id(run_id: Column, source_signal: Column) -> Column:
    return F.concat(F.lit("event-sig-"), F.substring(F.sha2(F.concat(run_id, F.lit(":"), source_signal), 256), 1, 16))


def observation_id(run_id: Column, source_id: Column, observed: Column) -> Column:
    return F.concat_ws(":", run_id, source_id, F.date_format(observed, "yyyy-MM-dd'T'HH:mm:ss"))


def canonical_json(c: Column) -> Column:
    """JSON with the keys of all objects in order, without white space, escapes and decimals in one form
    (1.50 as 1.5, 2.0 as 2); null for what isn't JSON or repeats a key. Numbers with an exponent are
    doubles and stay apart from the same number without one."""
    return F.to_json(F.try_parse_json(c))
