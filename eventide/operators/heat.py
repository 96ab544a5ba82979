"""Heat within one platform. Scales of different platforms are never mixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import HeatConfig
from ..functions import numbers as N

DELTA = {"rising": 1.0, "stable": 0.6, "falling": 0.3}


def _qa(cfg: HeatConfig) -> tuple[Column, Column]:
    c = F.col
    delta = F.when(c("seen") > 1, F.coalesce(F.create_map(*[x for k, v in DELTA.items() for x in (F.lit(k), F.lit(v))])[c("rank_delta")], F.lit(None).cast("double")))
    rank = F.when(~F.coalesce("search_only", F.lit(False)), N.rank_score(c("rank")))
    activity = F.when(c("votes").isNotNull() | c("comments").isNotNull(), N.log_score(F.coalesce("votes", F.lit(0)) + F.coalesce("comments", F.lit(0)), cfg.engagement_cap))
    own = N.weighted_available([(rank, 0.50), (F.least(F.lit(1.0), c("seen") / 3), 0.20), (delta, 0.15), (activity, 0.15)])
    native = F.coalesce(c("provider") == "native", F.lit(False))
    score = F.when(c("native_heat").isNotNull(), N.native_score(c("native_heat"), cfg.native_half)).when(native, rank).otherwise(own)
    status = F.when(score.isNull(), "unknown").when(c("native_heat").isNotNull(), "ok").when(native, "partial").otherwise("ok")
    return score, status


def _microblog(cfg: HeatConfig) -> tuple[Column, Column, Column]:
    c = F.col
    known = F.coalesce("has_samples", F.lit(False))
    topic = N.topic_score(c("rank"), c("topic_present"), c("seen"))
    content = N.weighted_available([(N.log_score(c("search_total"), cfg.total_cap), 0.5), (N.log_score(c("matched"), cfg.matched_cap), 0.3), (N.freshness_score(c("sample_age_hours")), 0.2)])
    any_ = c("reposts").isNotNull() | c("status_comments").isNotNull() | c("likes").isNotNull()
    interaction = F.when(any_, N.log_score(F.coalesce("reposts", F.lit(0)) + F.coalesce("status_comments", F.lit(0)) + F.coalesce("likes", F.lit(0)), cfg.engagement_cap))
    full = N.weighted_available([(topic, 0.40), (content, 0.35), (interaction, 0.25)])
    floor = F.when(F.coalesce("seed", F.lit(False)) & known, F.greatest(full, F.lit(cfg.seed_floor))).otherwise(full)
    feed = F.coalesce("seed", F.lit(False)) & ~known
    score = F.when(F.coalesce("low_relevance", F.lit(False)), None).when(feed, N.rss_decay(c("seen"), F.coalesce("age_hours", F.lit(0.0)), cfg.rss_scale, cfg.rss_half_life_hours)).otherwise(floor)
    status = F.when(score.isNull(), "unknown").when(feed, "partial").when(F.coalesce("seed", F.lit(False)) & known, "ok").otherwise("partial")
    return score, status, F.when(feed, "rss_presence_only").otherwise("samples")


def signal_scores(signals: DataFrame, cfg: HeatConfig = HeatConfig()) -> DataFrame:  # noqa: B008
    """Adds score, score_status and basis to heat signals of both platforms (a narrow step)."""
    qa, qa_status = _qa(cfg)
    mb, mb_status, mb_basis = _microblog(cfg)
    is_qa = F.col("platform") == "zhihu"
    return signals.withColumns({"score": F.when(is_qa, qa).otherwise(mb), "score_status": F.when(is_qa, qa_status).otherwise(mb_status), "basis": F.when(is_qa, F.when(F.col("native_heat").isNotNull(), "native_heat").otherwise("rank")).otherwise(mb_basis)})


def aggregate(scores: DataFrame, cfg: HeatConfig = HeatConfig()) -> DataFrame:  # noqa: B008
    """event_id, platform, score, status, members: one pass of partial aggregates.

    The best member, and a bonus for others; only members with samples count if there is one;
    native heat takes the member of most native heat without a bonus; no bonus from feeds alone."""
    samples = F.col("basis") == "samples"
    bonus = lambda n: cfg.bonus * F.least(F.lit(cfg.bonus_members), F.greatest(n - 1, F.lit(0)))
    a = scores.groupBy("event_id", "platform").agg(
        F.max("score").alias("best"), F.count("score").alias("n"),
        F.max(F.when(samples, F.col("score"))).alias("best_s"), F.count(F.when(samples, F.col("score"))).alias("n_s"),
        F.max(F.when(F.col("basis") == "native_heat", F.struct("native_heat", "score"))).alias("native"),
        F.bool_or(F.col("score_status") == "ok").alias("ok"), F.bool_and(F.col("basis") == "rss_presence_only").alias("feeds"),
    )
    score = F.when(F.col("best").isNull(), None).when(F.col("native").isNotNull(), F.col("native.score")).when(F.col("n_s") > 0, F.least(F.lit(1.0), F.col("best_s") + bonus(F.col("n_s")))).when(F.col("feeds"), F.col("best")).otherwise(F.least(F.lit(1.0), F.col("best") + bonus(F.col("n"))))
    return a.select("event_id", "platform", score.alias("score"), F.when(score.isNull(), "unknown").when(F.col("ok"), "ok").otherwise("partial").alias("status"), F.col("n").alias("members")).withColumns({"bucket": N.score_bucket(F.col("score")), "strength": N.strength(F.col("score"))})


#: The names under which a saved item may carry a metric, the first that is there.
METRIC_ALIASES = {
    "rank": ("rank", "platform_rank"),
    "list_position": ("list_position",),
    "native_heat": ("hot_value",),
    "votes": ("vote_count", "vote_up_count"),
    "comments": ("comment_count", "comments_count"),
    "matched": ("matched_status_count",),
    "search_total": ("weibo_search_total_number_proxy", "total_number_proxy"),
    "reposts": ("top_status_repost_count", "reposts_count"),
    "status_comments": ("top_status_comment_count", "comments_count"),
    "likes": ("top_status_like_count", "attitudes_count"),
}


def from_raw_metrics(items: DataFrame, raw: str = "raw_metrics") -> DataFrame:
    """Items with the metrics of their JSON ``raw``, whatever each is called there; the item's own
    ``rank``, if it has one, comes first."""
    first = lambda names: F.coalesce(*[F.get_json_object(raw, f"$.{n}").try_cast("double") for n in names])
    cols = {metric: first(names) for metric, names in METRIC_ALIASES.items()}
    if "rank" in items.columns:
        cols["rank"] = F.coalesce(F.col("rank").cast("double"), cols["rank"])
    return items.withColumns(cols).drop(raw)


def answer_metrics(answers: DataFrame) -> DataFrame:
    """Sums over distinct answers: the largest of each metric per link, then the sum."""
    one = answers.groupBy("event_id", "url").agg(F.max("votes").alias("votes"), F.max("comments").alias("comments"))
    return one.groupBy("event_id").agg(F.sum("votes").alias("votes"), F.sum("comments").alias("comments"), F.count("*").alias("answers"))


def fold_samples(topics: DataFrame, samples: DataFrame) -> DataFrame:
    """Topics with the largest metrics and latest time of their accepted samples."""
    s = samples.where("accepted").groupBy("topic_id").agg(F.max("reposts").alias("reposts"), F.max("comments").alias("status_comments"), F.max("likes").alias("likes"), F.count("*").alias("matched"), F.max("created_at").alias("latest_status_at"))
    return topics.join(s, "topic_id", "left")
