"""A report over saved rounds: a pure function of observations and a window."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TrendConfig
from ..functions import numbers as N
from ..operators import classify, observe, trend


def window_report(observations: DataFrame, start: datetime, end: datetime, cfg: TrendConfig = TrendConfig(), categories: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """event_id, platform, place, presence, rounds, duration and trend for (start, end].

    ``categories``: event_id and category; places are then given within a category of a platform (null
    for events without one). A microblog event that its last observation doesn't show has an
    ``estimated_heat``, which ranks it instead of its last score."""
    s, e = F.lit(start), F.lit(end)
    inside = trend.in_window(observe.dedup_observations(observations), s, e).where("not out_of_window").drop("out_of_window")
    latest = inside.groupBy("event_id", "platform").agg(*[F.max_by(c, F.struct("observed_at", "observation_id")).alias(c) for c in ("present", "rank", "score")])
    out = latest.join(trend.analyze(inside, e, cfg), ["event_id", "platform"], "left").join(observe.distinct_rounds(inside, e, 24 * 7), ["event_id", "platform"], "left")
    current = out.withColumn("current", F.coalesce("present", F.lit(False)))
    out = current.withColumn("estimated_heat", trend.estimated_heat(e)).drop("current")
    if categories is not None:
        out = out.join(categories.select("event_id", "category"), "event_id", "left")
    ranks = trend.platform_ranking(out.withColumn("_score", F.col("score")).withColumn("score", F.coalesce("estimated_heat", "score")))
    return ranks.withColumn("score", F.col("_score")).drop("_score")


def rebuilt_window(items: DataFrame, support: DataFrame, observations: DataFrame, start: datetime, end: datetime, cfg: TrendConfig = TrendConfig()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Classifications and analyses of a window, from saved rounds and current associations alone; events
    are ranked within their class.

    ``items``: event_id, item_id, platform, signal_role, source_type, observed_at, published_at, rank,
    audit_only, contributes, one row a round in which the item stood; its last one in (start, end] counts. Official
    news must be published in the window. An event needs more than search results. ``support``: event_id,
    support_status. Returns the events' classes and the report of ``window_report`` over those events."""
    s, e = F.lit(start), F.lit(end)
    inside = (F.col("observed_at") > s) & (F.col("observed_at") <= e) & ~F.coalesce("audit_only", F.lit(False)) & F.coalesce("contributes", F.lit(True))
    official = F.col("source_type") == "official_news"
    fresh = ~official | F.coalesce((F.col("published_at") > s) & (F.col("published_at") <= e), F.lit(False))
    last = items.where(inside & fresh).groupBy("event_id", "item_id", "platform", "signal_role", "source_type").agg(F.max_by("rank", "observed_at").alias("rank"), F.max("observed_at").alias("observed_at"))
    search = F.col("signal_role") == "search_enrichment"
    on = lambda p, c: F.bool_or((F.col("platform") == p) & ~official & c)
    found = last.groupBy("event_id").agg(
        on("zhihu", ~search).alias("zhihu_topn"), on("weibo", ~search).alias("weibo_topn"), on("zhihu", search).alias("zhihu_search"), on("weibo", search).alias("weibo_search"),
        F.bool_or(official).alias("official_source"), F.bool_or(~search).alias("_found"), N.rank_bucket(F.min(F.when(~search, F.col("rank")))).alias("rank_bucket"), F.max("observed_at").alias("_at"), F.count("*").alias("items"),
    ).where("_found")
    known = found.join(support.select("event_id", "support_status"), "event_id", "left").withColumn("support_status", F.coalesce("support_status", F.lit("not_checked")))
    unknown = {"relation_confidence": F.lit(None).cast("double"), "presence": F.lit(1), "rank_delta": F.lit("unknown"), "search_hit": F.lit("unknown"), "health": F.lit("unknown"), "flags": F.array().cast("array<string>")}
    rows = known.withColumns(unknown | {"freshness": N.freshness_bucket(N.hours_between(e, F.col("_at")))}).drop("_found", "_at")
    classes = classify.classify(rows)
    named = classes.select("event_id", "category")
    return classes, window_report(observations.join(found.select("event_id"), "event_id", "left_semi"), start, end, cfg, named)


def rounds_in_window(rounds: DataFrame, windows: DataFrame) -> DataFrame:
    """Interval join of rounds with report windows (start, end]: both are dealt to days, so that
    only rounds and windows of one day meet."""
    day = lambda c: F.floor(F.unix_seconds(c) / 86400)
    w = windows.withColumn("_day", F.explode(F.sequence(day(F.col("start_at")), day(F.col("end_at")))))
    return rounds.withColumn("_day", day(F.col("observed_at"))).join(w, "_day").where("observed_at > start_at and observed_at <= end_at").drop("_day")
