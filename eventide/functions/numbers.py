"""Scores, buckets and times as column expressions. A missing value stays missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import RELATIVE_TIMES


def _bound(c: Column) -> Column:
    """Within 0 and 1, for values that the caller knows not to be null."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def clip(c: Column) -> Column:
    """Within 0 and 1; null stays null (least and greatest alone would skip it)."""
    return F.when(c.isNotNull(), _bound(c))


def log_score(c: Column, cap: float) -> Column:
    return F.when(c >= 0, F.least(F.lit(1.0), F.log1p(c) / F.log1p(F.lit(float(cap)))))


def rank_score(c: Column) -> Column:
    return F.when(c > 0, _bound(1 - (c - 1) / 20))


def native_score(c: Column, half: float = 1e7) -> Column:
    return F.when(c >= 0, c / (c + half))


def weighted_available(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean over the parts that are known, clipped; null if none is."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c * w, F.lit(0.0)) for c, w in parts])
    weight = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts])
    return F.when(weight > 0, _bound(total / weight))


def saturating(c: Column) -> Column:
    return F.when(c > 0, c / (c + 1)).otherwise(0.0)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-80.0), F.least(F.lit(80.0), c))))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays of the same length, within -1 and 1."""
    s = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(s.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s)))


def rank_bucket(c: Column) -> Column:
    return F.when(c.isNull(), "unknown").when(c <= 3, "top3").when(c <= 10, "top10").when(c <= 20, "top20").otherwise("tail")


def score_bucket(c: Column) -> Column:
    return F.when(c.isNull(), "unknown").when(c >= 0.85, "top3").when(c >= 0.70, "top10").when(c >= 0.50, "top20").otherwise("tail")


def strength(c: Column) -> Column:
    return F.when(c.isNull(), "unknown").when(c >= 0.70, "strong").when(c >= 0.45, "medium").otherwise("weak")


def topic_score(rank: Column, present: Column, seen: Column) -> Column:
    """Presence of a topic: a half, more for repeated presence, and for its place if known."""
    place = F.when(rank.isNull(), 0.0).when(rank <= 3, 0.20).when(rank <= 10, 0.15).when(rank <= 20, 0.10).otherwise(0.05)
    return F.when(present, F.least(F.lit(1.0), 0.5 + F.least(F.lit(0.3), 0.1 * F.greatest(seen, F.lit(1))) + place))


def hours_between(a: Column, b: Column) -> Column:
    """Absolute distance of two timestamps in hours."""
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) / 3.6e9


def freshness_score(hours: Column) -> Column:
    return F.when(hours.isNull(), None).when(hours <= 6, 1.0).when(hours <= 24, 0.8).when(hours <= 72, 0.5).when(hours <= 168, 0.25).otherwise(0.1)


def freshness_bucket(hours: Column) -> Column:
    return F.when(hours.isNull(), "unknown").when(hours <= 24, "24h").when(hours <= 72, "72h").when(hours <= 168, "7d").otherwise("stale")


def rss_decay(seen: Column, hours: Column, scale: float = 0.20, half_life: float = 2.0) -> Column:
    """Reference value of a topic known from a feed alone, halved every ``half_life`` hours."""
    return scale * (0.6 + 0.4 * F.least(seen, F.lit(5)) / 5) * F.pow(F.lit(2.0), -F.greatest(hours, F.lit(0.0)) / half_life)


def direction(delta: Column, threshold: float) -> Column:
    return F.when(delta.isNull(), "unknown").when(delta >= threshold, "rising").when(delta <= -threshold, "cooling").otherwise("stable")


def parse_display_heat(c: Column) -> Column:
    """Numbers such as ``123.4 万热度`` in units."""
    number = F.regexp_extract(c, r"(\d+(?:\.\d+)?)\s*[万亿]?\s*热度", 1)
    unit = F.regexp_extract(c, r"\d\s*([万亿])\s*热度", 1)
    return F.when(number != "", number.cast("double") * F.when(unit == "万", 1e4).when(unit == "亿", 1e8).otherwise(1.0))


def parse_time(c: Column) -> Column:
    """ISO 8601, then RFC 2822 without its day name, then seconds since 1970; UTC if no zone."""
    rfc = F.replace(F.regexp_replace(c, r"^[A-Za-z]{3},\s*", ""), F.lit("GMT"), F.lit("+0000"))
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")), F.timestamp_seconds(F.when(c.rlike(r"^\d{9,10}(\.\d+)?$"), c.try_cast("double"))))


def parse_publication(c: Column) -> Column:
    """Seconds or milliseconds since 1970, else local time of UTC+8."""
    n = F.when(c.rlike(r"^\d+$"), c.try_cast("double"))
    epoch = F.timestamp_seconds(F.when(n > 1e11, n / 1000).otherwise(n))
    zoned = c.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    return F.coalesce(epoch, F.when(zoned, F.try_to_timestamp(c)).otherwise(F.to_utc_timestamp(F.try_to_timestamp(c), "GMT+8")))


def publication_exclusion(published: Column, start: Column, end: Column) -> Column:
    """Why an item is outside the window (start, end]; null if it is inside."""
    return F.when(published.isNull(), "unknown").when(published > end, "in_future").when(published <= start, "expired")


def slot(ts: Column, minutes: int) -> Column:
    """Number of the sampling slot that a time falls in."""
    return F.floor(F.unix_seconds(ts) / (60 * minutes))


def occurrence_problem(c: Column) -> Column:
    """Why a stated time of occurrence is dropped: null if it is complete with a zone (or wasn't
    stated), ``llm_occurrence_timezone_missing`` for a date or time without one, else
    ``llm_invalid_occurrence_time``."""
    full = c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$") & F.try_to_timestamp(F.regexp_replace(c, r"T(\d\d:\d\d)([Z+-])", "T$1:00$2")).isNotNull()
    weekly = iso_week_day(c).isNotNull()
    bare = weekly | c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?)?$") & F.try_to_timestamp(F.substring(c, 1, 10)).isNotNull()
    return F.when(c.isNull() | full, None).when(bare, "llm_occurrence_timezone_missing").otherwise("llm_invalid_occurrence_time")


def report_date(c: Column) -> Column:
    """The day of a report in UTC+8."""
    return F.to_date(F.from_utc_timestamp(c, "Asia/Shanghai"))


def iso_week_day(c: Column) -> Column:
    """The date of a week date such as 2026-W36-2 or 2026W362; null if there is no such day."""
    part = lambda g: F.regexp_extract(c, r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?$", g)
    year, week, day = part(1).try_cast("int"), part(2).try_cast("int"), F.coalesce(F.nullif(part(3), F.lit("")).try_cast("int"), F.lit(1))
    fourth = F.make_date(F.when(year > 0, year), F.lit(1), F.lit(4))  # always in week 1
    monday = F.date_sub(fourth, F.weekday(fourth))
    at = F.date_add(monday, (week - 1) * 7 + day - 1)
    return F.when((week >= 1) & (F.weekofyear(at) == week), at)


def reference_date(title: Column, body: Column, fetched: Column, words: tuple[str, ...] = RELATIVE_TIMES) -> Column:
    """The local date (UTC+8) that relative words such as "yesterday" count from; null if the text
    has none or wasn't fetched at a known time."""
    text = F.concat(F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")))
    return F.when(text.rlike("|".join(words)), F.date_format(F.from_utc_timestamp(fetched, "Asia/Shanghai"), "yyyy-MM-dd"))
