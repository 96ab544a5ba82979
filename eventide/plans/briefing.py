"""A briefing: citations that may be shown, cards, sections in order, and risk notes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PLATFORM_LABELS
from ..functions import identity as I
from ..functions import numbers as N
from ..operators.ranking import ranked


def citations(members: DataFrame, items: DataFrame, start: Column, end: Column) -> DataFrame:
    """event_id, item_id, role, is_prior, at and the item's columns: what an event may cite.

    ``members``: event_id, item_id, observed_at (null: the item's fetched_at), prior (an earlier
    report that was accepted as support). ``items``: item_id, url, title, source_name,
    source_type, platform, published_at, fetched_at, audit_only, contributes. A discussion is
    cited if observed in (start, end], official news if published there; a prior report only if
    published before ``start``. Rows without any time are left out; members are taken once."""
    m = members.groupBy("event_id", "item_id").agg(F.max("observed_at").alias("observed_at"), F.bool_or(F.coalesce("prior", F.lit(False))).alias("prior"))
    j = m.join(items, "item_id").withColumn("at", F.coalesce("observed_at", "fetched_at"))
    official = F.col("source_type") == "official_news"
    prior = F.col("prior") & F.coalesce(F.col("published_at") <= start, F.lit(False))
    open_ = ~F.coalesce("audit_only", F.lit(False)) & F.coalesce("contributes", F.lit(True))
    fresh = F.when(official, prior | N.publication_exclusion(F.col("published_at"), start, end).isNull()).otherwise((F.col("at") > start) & (F.col("at") <= end))
    ok = j.where(F.col("at").isNotNull() & (open_ | prior) & fresh)
    return ok.withColumns({"role": F.when(official, "official_support").otherwise("supporting"), "is_prior": prior, "missing_url": F.coalesce(F.trim("url"), F.lit("")) == ""}).drop("observed_at", "prior")


def cards(events: DataFrame, cited: DataFrame, window_label: str) -> DataFrame:
    """One row an event of ``events`` (event_id, title, category, zhihu_topn, weibo_topn,
    official_source): counts over its citations, platforms, summary; ``excluded`` is why an event
    isn't shown. Citations are counted before they meet the events."""
    official = F.col("role") == "official_support"
    c = cited.groupBy("event_id").agg(
        F.count("*").alias("n_citations"), F.count_distinct(F.when(official, F.col("source_name"))).alias("official_sources"),
        F.max(F.when(official, F.col("published_at"))).alias("official_latest"), F.bool_or(official & ~F.col("is_prior")).alias("official_new"), F.bool_or("is_prior").alias("has_prior"),
    )
    quotes = cited.select("event_id", "title").distinct().withColumn("title_is_source_quote", F.lit(True))
    j = events.dropDuplicates(["event_id"]).join(c, "event_id", "left").join(quotes, ["event_id", "title"], "left")
    zero = {k: F.coalesce(k, F.lit(v)) for k, v in {"n_citations": 0, "official_sources": 0, "official_new": False, "has_prior": False, "title_is_source_quote": False}.items()}
    j = j.withColumns(zero)
    shown = {"zhihu": F.col("zhihu_topn"), "weibo": F.col("weibo_topn"), "official": F.col("official_new")}
    names = F.array_compact(F.array(*[F.when(shown[p], F.lit(label)) for p, label in PLATFORM_LABELS.items()]))
    lead = F.concat(F.lit(window_label + "见于"), F.when(F.size(names) > 0, F.array_join(names, "、")).otherwise("待确认来源"), F.lit("。"))
    prior = F.when(F.col("has_prior"), "官媒依据含此前报道，不代表官媒本期新发布报道。").otherwise("")
    alone = F.when(~F.coalesce("official_source", F.lit(False)), "话题信息来自平台讨论，暂无已接纳的官媒依据。").otherwise("")
    return j.withColumns({"platforms": names, "summary": F.concat(lead, prior, alone), "excluded": F.when(F.col("n_citations") == 0, "missing_current_citation")})


def sections(cards_: DataFrame, ranking: DataFrame) -> DataFrame:
    """section, event_id, place. Shared and category sections go by title, platforms by what their
    own ``ranking`` (event_id, platform, present, rank, score) says, official news by sources and
    latest report; scores of two platforms never meet."""
    shown = cards_.where("excluded is null")
    z, w = F.coalesce("zhihu_topn", F.lit(False)), F.coalesce("weibo_topn", F.lit(False))
    names = F.array_compact(F.array(F.when(z & w, "shared"), F.when(z, "zhihu"), F.when(w, "weibo"), F.when(F.col("official_new") & F.col("category").startswith("F_"), "official"), F.element_at(F.split("category", "_"), 1)))
    s = shown.select("event_id", "title", "official_sources", "official_latest", F.explode(names).alias("section"))
    r = ranking.select("event_id", F.col("platform").alias("section"), "present", F.when(F.col("platform") == "zhihu", F.col("rank")).alias("rank"), "score")
    j = s.join(r, ["event_id", "section"], "left")
    state = F.when(F.col("present"), 0).when(F.col("present").isNull(), 1).otherwise(2)
    own = F.struct(state.alias("a"), F.coalesce(F.col("rank"), F.lit(9999)).cast("double").alias("b"), (-F.coalesce("score", F.lit(0.0))).alias("c"), F.lit("").alias("t"))
    news = F.struct((-F.col("official_sources")).cast("int").alias("a"), (-F.coalesce(F.unix_micros("official_latest"), F.lit(0))).cast("double").alias("b"), F.lit(0.0).alias("c"), F.lit("").alias("t"))
    title = F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.coalesce("title", F.lit("")).alias("t"))
    key = F.when(F.col("section").isin("zhihu", "weibo"), own).when(F.col("section") == "official", news).otherwise(title)
    return ranked(j.withColumn("_key", key), ["section"], [F.asc("_key"), F.asc("event_id")]).select("section", "event_id", "place")


def publication_errors(cards_: DataFrame, cited: DataFrame, health: DataFrame, run_id: str, start: Column, end: Column, created: Column) -> DataFrame:
    """event_id (null: the briefing's), error: everything that keeps a briefing from publication, once each.

    ``cards_``: event_id, section, run_id, window_start, window_end, has_analysis, official_source, zhihu_topn,
    weibo_topn; ``cited``: event_id, url, source_type, fetched_at, published_at, is_prior_report, prior_allowed;
    ``health``: status of each source."""
    of = lambda df, error, who="event_id": df.select(F.col(who).alias("event_id") if who else F.lit(None).cast(cards_.schema["event_id"].dataType).alias("event_id"), F.lit(error).alias("error"))
    one = cards_.dropDuplicates(["event_id"])
    official = F.col("source_type") == "official_news"
    with_cards = cited.join(one.select("event_id", (F.col("zhihu_topn") | F.col("weibo_topn")).alias("_topn")), "event_id", "left")
    inside = lambda c: (F.col(c) > start) & (F.col(c) <= end)
    prior = F.coalesce(F.col("is_prior_report") & F.col("_topn") & F.col("prior_allowed"), F.lit(False))
    supported = cited.where(official).select("event_id").distinct()
    parts = [
        of(cards_.groupBy("event_id", "section").count().where("count > 1"), "duplicate_in_section"),
        of(cards_.where(~(F.col("run_id").eqNullSafe(F.lit(run_id)) & F.col("window_start").eqNullSafe(start) & F.col("window_end").eqNullSafe(end))), "classification_window_mismatch"),
        of(cards_.where(~F.coalesce("has_analysis", F.lit(False))), "missing_platform_analysis"),
        of(cards_.where("official_source").join(supported, "event_id", "left_anti"), "official_class_without_official_citation"),
        of(cited.where(~I.safe_url(F.col("url"))), "invalid_url"),
        of(cited.where(~official & ~F.coalesce(inside("fetched_at"), F.lit(False))), "citation_out_of_window"),
        of(cited.where(F.col("fetched_at") > created), "citation_not_yet_collected"),
        of(with_cards.where(official & ~F.coalesce(inside("published_at"), F.lit(False)) & ~prior), "official_publication_out_of_window"),
        of(cards_.agg(F.count("*").alias("n")).where("n = 0"), "no_event_with_citations", None),
        of(health.agg(F.count_if(F.col("status").isin("succeeded", "partial")).alias("n")).where("n = 0"), "no_usable_source", None),
        of(cards_.sparkSession.range(1).where(~F.coalesce(start < end, F.lit(False))), "invalid_window", None),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def risks(cards_: DataFrame, health: DataFrame, pending: DataFrame) -> DataFrame:
    """One row: what a reader should know: excluded events, pending reviews, sources in doubt."""
    a = cards_.agg(F.count_if(F.col("excluded").isNotNull()).alias("excluded"), F.count_if(F.col("excluded").isNull() & F.col("category").startswith("F_")).alias("official_news"), F.count_if(F.col("excluded").isNull() & ~F.col("category").startswith("F_")).alias("community_events"))
    b = health.agg(F.count_if(F.col("health") != "ok").alias("sources_in_doubt"))
    return a.join(b).join(pending.agg(F.count_if(F.col("status") == "pending").alias("pending_reviews")))  # one row each
