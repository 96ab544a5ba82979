"""Trend over irregular observation rounds, with explicit unknowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SCORE_INVALID_FLAGS, TrendConfig
from ..functions import numbers as N
from .ranking import ranked

_SERIES = ["event_id", "platform"]


def in_window(obs: DataFrame, start: Column, end: Column) -> DataFrame:
    """Adds out_of_window; rows outside (start, end] are flagged, not lost."""
    return obs.withColumn("out_of_window", ~((F.col("observed_at") > start) & (F.col("observed_at") <= end)))


def seen(obs: DataFrame) -> DataFrame:
    """First, last and latest-score statistics over rows with presence."""
    return obs.where("present").groupBy(*_SERIES).agg(F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"), F.max_by("score", F.struct("observed_at", "observation_id")).alias("last_score"), F.count("*").alias("observations"))


def continuous_segment(obs: DataFrame, cfg: TrendConfig = TrendConfig()) -> DataFrame:  # noqa: B008
    """event_id, platform, rows, minutes: the run of unbroken presence that ends at the last
    observation. Absence, a failed or incomplete round, a gap that is too long and a change of
    scope break it. Islands come from a running count of breaks from the end."""
    w = Window.partitionBy(*_SERIES).orderBy("observed_at", "observation_id")
    good = F.coalesce("present", F.lit(False)) & (F.col("collection_status") == "succeeded") & F.coalesce("list_complete", F.lit(False))
    gap = (F.unix_micros("observed_at") - F.unix_micros(F.lag("observed_at").over(w))) / 6e7
    joined = good & F.coalesce(F.lag(good).over(w), F.lit(False)) & (gap <= cfg.max_gap_minutes) & F.lag("topn_scope").over(w).eqNullSafe(F.col("topn_scope"))
    marked = obs.withColumns({"_good": good, "_break": F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)})
    back = Window.partitionBy(*_SERIES).orderBy(F.desc("observed_at"), F.desc("observation_id")).rowsBetween(Window.unboundedPreceding, -1)
    last = marked.withColumn("_island", F.coalesce(F.sum("_break").over(back), F.lit(0))).where("_island = 0 and _good")
    span = (F.unix_micros(F.max("observed_at")) - F.unix_micros(F.min("observed_at"))) / 6e7
    return last.groupBy(*_SERIES).agg(F.count("*").alias("rows"), F.least(F.lit(cfg.cap_minutes), span).alias("minutes"))


#: What a comparison reads of an observation, beside the series and its time. Those after
#: ``activity`` may lack in a table, which then has nothing to say against a comparison.
_READ = ("present", "collection_status", "list_complete", "topn_scope", "rank", "score", "native_heat", "config_version", "sampling_signature", "activity", "component_signature", "score_basis", "score_status", "flags", "main_source")


def latest_pair(obs: DataFrame, cfg: TrendConfig = TrendConfig()) -> DataFrame:  # noqa: B008
    """event_id, platform, delta, basis, trend, reason: the last two observations of the main source
    compared, both with presence, whole lists, one scope and no long gap between.

    Q&A: if either has native heat, the share of it gained, and both must have it and scores that
    compare; else ranks gained, else score gained. Microblog: score gained, if activity is known on
    both sides and changed. Scores compare if versions, sampling, components and basis agree, no
    flag forbids it and both are known. ``reason`` says why a trend is unknown."""
    plain = {"component_signature": F.lit("-"), "score_basis": F.lit(None).cast("string"), "score_status": F.lit("ok"), "flags": F.array().cast("array<string>"), "main_source": F.lit(True)}
    main = obs.withColumns({n: c for n, c in plain.items() if n not in obs.columns}).where("main_source")
    w = Window.partitionBy(*_SERIES).orderBy("observed_at", "observation_id")
    back = Window.partitionBy(*_SERIES).orderBy(F.desc("observed_at"), F.desc("observation_id"))
    o = main.withColumn("_p", F.lag(F.struct("observed_at", *_READ)).over(w)).withColumn("_n", F.row_number().over(back)).where("_n = 1")
    c, p = F.col, lambda n: F.col(f"_p.{n}")
    yes = lambda x: F.coalesce(x, F.lit(False))
    both = lambda f: yes(f(c)) & yes(f(p))
    agree = lambda n: yes(c(n) == p(n))
    gap = (F.unix_micros("observed_at") - F.unix_micros(p("observed_at"))) / 6e7
    known = lambda q: q("score").isNotNull() & (q("score_status") != "unknown")
    flags = [F.coalesce(q("flags"), F.array().cast("array<string>")) for q in (c, p)]  # null flags forbid nothing
    invalid = yes(F.exists(F.concat(*flags), lambda f: f.isin(*SCORE_INVALID_FLAGS)))
    comparable = agree("config_version") & agree("sampling_signature") & agree("component_signature") & c("score_basis").eqNullSafe(p("score_basis")) & ~invalid & both(known)
    qa = c("platform") == "zhihu"
    heats = c("native_heat").isNotNull().cast("int") + p("native_heat").isNotNull().cast("int")
    active = both(lambda q: q("activity").isNotNull() & (F.coalesce(q("score_basis"), F.lit("")) != "rss_presence_only"))
    reason = (
        F.when(F.col("_p").isNull(), "insufficient_history").when(~both(lambda q: q("present")), "insufficient_trend_metrics")
        .when(~both(lambda q: (q("collection_status") == "succeeded") & q("list_complete")), "incomplete_list")
        .when(gap > cfg.max_gap_minutes, "observation_gap").when(~agree("topn_scope"), "incomparable_scope")
        .when(qa & (heats > 0), F.when((heats == 1) | ~comparable, "incomparable_scores"))
        .when(qa & both(lambda q: q("rank").isNotNull()), None)
        .when(~qa & ~active, "insufficient_trend_metrics").when(~comparable, "incomparable_scores")
        .when(~qa & (c("activity") == p("activity")), "incomparable_scores")
    )
    basis = F.when(F.col("_reason").isNotNull(), None).when(qa & (heats > 0), "native_heat").when(qa & both(lambda q: q("rank").isNotNull()), "rank").otherwise("score")
    ratio = F.when(p("native_heat") > 0, (c("native_heat") - p("native_heat")) / p("native_heat")).when(c("native_heat") > 0, 1.0).otherwise(0.0)
    delta = F.when(F.col("basis") == "native_heat", ratio).when(F.col("basis") == "rank", p("rank") - c("rank")).when(F.col("basis") == "score", c("score") - p("score"))
    limit = F.when(F.col("basis") == "native_heat", cfg.native_ratio_threshold).when(F.col("basis") == "rank", cfg.rank_threshold).otherwise(cfg.score_threshold)
    o = o.withColumn("_reason", reason).withColumn("basis", basis).withColumn("_delta", delta)
    trend = F.when(F.col("_delta").isNull(), "unknown").when(F.col("_delta") >= limit, "rising").when(F.col("_delta") <= -limit, "cooling").otherwise("stable")
    return o.select(*_SERIES, F.col("_delta").cast("double").alias("delta"), "basis", trend.alias("trend"), F.col("_reason").alias("reason"))


def analyze(obs: DataFrame, end: Column, cfg: TrendConfig = TrendConfig()) -> DataFrame:  # noqa: B008
    """Seen statistics, duration and trend of every series. A duration needs two rows and a last
    observation that isn't stale."""
    s = seen(obs).join(continuous_segment(obs, cfg), _SERIES, "left").join(latest_pair(obs, cfg), _SERIES, "left")
    stale = (F.unix_micros(end) - F.unix_micros("last_seen_at")) / 6e7 > cfg.max_gap_minutes
    return s.withColumns({"stale": stale, "duration_minutes": F.when(~stale & (F.col("rows") > 1), F.col("minutes")), "trend": F.when(stale, "unknown").otherwise(F.coalesce("trend", F.lit("unknown")))}).drop("rows", "minutes")


def event_heat(trends: DataFrame, platforms: tuple[str, ...] = ("zhihu", "weibo")) -> DataFrame:
    """One row an event with both platforms side by side, and a status over them."""
    known = lambda p: F.max(F.when((F.col("platform") == p) & (F.col("trend") != "unknown"), 1)).alias(f"{p}_known")
    cols = [a for p in platforms for a in (F.max(F.when(F.col("platform") == p, F.col("trend"))).alias(f"{p}_trend"), F.max(F.when(F.col("platform") == p, F.col("last_score"))).alias(f"{p}_score"), known(p))]
    out = trends.groupBy("event_id").agg(*cols)
    n = sum((F.coalesce(f"{p}_known", F.lit(0)) for p in platforms[1:]), F.coalesce(f"{platforms[0]}_known", F.lit(0)))
    return out.withColumn("status", F.when(n == len(platforms), "ok").when(n > 0, "partial").otherwise("unknown")).drop(*[f"{p}_known" for p in platforms])


def platform_ranking(rows: DataFrame) -> DataFrame:
    """Adds place within the platform, and within its category if the rows have one: present events
    first, then smaller ranks (the Q&A platform's; none last), higher scores (none last), longer
    presence, and the id. Scores of two platforms never meet."""
    by = ["platform", *(["category"] if "category" in rows.columns else [])]
    rank = F.when(F.col("platform") == "zhihu", F.col("rank"))
    duration = F.coalesce("duration_minutes", F.lit(0.0)) if "duration_minutes" in rows.columns else F.lit(0.0)
    keys = {"_gone": F.when(F.col("present"), 0).otherwise(1), "_rank": rank, "_long": duration}
    order = [F.asc("_gone"), F.asc_nulls_last("_rank"), F.desc_nulls_last("score"), F.desc("_long"), F.asc("event_id")]
    return ranked(rows.withColumns(keys), by, order).drop(*keys)


def decayed_heat(latest: DataFrame, end: Column, hours: float = 24.0, half_life: float = 2.0, scale: float = 0.2) -> DataFrame:
    """event_id, platform, estimated_heat at ``end`` for microblog events that were seen in the last
    ``hours`` but have no current samples: seen rounds give the height, the time since the last the
    decay. ``latest``: event_id, platform, last_seen_at, rounds, current (samples of this round)."""
    return latest.withColumn("estimated_heat", estimated_heat(end, hours, half_life, scale)).where("estimated_heat is not null").select("event_id", "platform", "estimated_heat")


def estimated_heat(end: Column, hours: float = 24.0, half_life: float = 2.0, scale: float = 0.2) -> Column:
    """``decayed_heat`` of a row; null for rows that have none."""
    age = (F.unix_micros(end) - F.unix_micros("last_seen_at")) / 3.6e9
    open_ = (F.col("platform") == "weibo") & ~F.coalesce("current", F.lit(False)) & (age < hours) & (age >= 0)
    return F.when(open_, N.rss_decay(F.col("rounds"), age, half_life=half_life, scale=scale))
