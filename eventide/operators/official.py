"""Corroborating official evidence for events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..config import COMPARABLE_ENTITY_SUFFIXES, SupportConfig
from ..functions import identity as I
from ..functions import numbers as N
from ..functions import text as X
from ..functions.settle import settled
from .ranking import ranked
from .retrieve import bm25_top_k, capped


def query_text(title: Column, entities: Column, keywords: Column) -> Column:
    """First entity and first three keywords; else the title."""
    parts = F.array_distinct(F.concat(F.slice(entities, 1, 1), F.slice(keywords, 1, 3)))
    return F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(title)


def compared(events: DataFrame, pool: DataFrame, end: Column, cfg: SupportConfig = SupportConfig(), recall: int = 20, per_source: int | None = None) -> DataFrame:  # noqa: B008
    """Each event with its candidates, the ``recall`` best of BM25 (at most ``per_source`` of a source,
    if the pool has source_id): event_id, item_id, query, outcome and score.

    A pair drops on conflicting facts or entities (conflict), disjoint entities (other_entities) or weak
    agreement of the texts (weak_text). The others are supported if the source is in use, has link,
    title and time, and is fresh; else weak_supported."""
    e = events.withColumn("q", query_text(F.col("title"), F.col("entities"), F.col("keywords")))
    if per_source is None:
        cand = bm25_top_k(e, pool, "event_id", "item_id", "q", "text", recall)
    else:
        each = bm25_top_k(e, pool, "event_id", "item_id", "q", "text", per_source, per="source_id")
        cand = capped(each, "source_id", per_source, recall, "event_id", F.desc(F.round("score", 9)), F.asc("item_id"))
    b = pool.select("item_id", *[F.col(c).alias(f"b_{c}") for c in ("title", "text", "entities", "status", "url", "published_at")])
    p = cand.select("event_id", "item_id").join(e, "event_id").join(b, "item_id")
    p = settled(p, _fa=X.facts(F.col("title")), _fb=X.facts(F.col("b_title")), _text=X.normalize_space(F.col("b_text")), _ta=X.normalize_space(F.col("title")), _tb=X.normalize_space(F.col("b_title")))
    p = settled(p, _clash=F.size(X.conflicts(F.col("_fa"), F.col("_fb"))) > 0, _ga=X.ngrams(F.col("_ta"), 2, 3), _gb=X.ngrams(F.col("_tb"), 2, 3))
    clash = F.col("_clash") | X.entity_conflict(F.col("entities"), F.col("b_entities"), COMPARABLE_ENTITY_SUFFIXES, F.col("title"), F.col("b_title"))
    apart = (F.size("entities") > 0) & (F.size("b_entities") > 0) & ~F.arrays_overlap("entities", "b_entities")
    text = F.col("_text")
    hits = F.size(F.filter("keywords", lambda k: F.contains(text, k)))
    keyword = X.term_overlap(F.col("keywords"), text)
    ngram = X.containment(F.col("_ga"), F.col("_gb"))
    strong = X.title_containment(F.col("title"), F.col("b_title")) | ((keyword >= cfg.keyword_min) & (hits >= cfg.keyword_count)) | (ngram >= cfg.ngram_min)
    fresh = N.hours_between(end, F.col("b_published_at")) <= cfg.fresh_days * 24
    good = (F.col("b_status") == "use") & I.safe_url(F.col("b_url")) & (F.col("b_title") != "") & fresh
    yes = lambda c: F.coalesce(c, F.lit(False))
    outcome = F.when(yes(clash), "conflict").when(yes(apart), "other_entities").when(~yes(strong), "weak_text").when(yes(good), "supported").otherwise("weak_supported")
    total = F.when(F.col("outcome") == "supported", 1.0).otherwise(0.5) + keyword + ngram + X.jaccard(F.col("entities"), F.col("b_entities"))
    return p.withColumn("outcome", outcome).select("event_id", "item_id", F.col("q").alias("query"), "outcome", total.alias("score"))


#: Outcomes of a pair, the first two of which count.
OUTCOMES = ("supported", "weak_supported", "conflict", "other_entities", "weak_text")


def audited_support(events: DataFrame, pool: DataFrame, end: Column, cfg: SupportConfig = SupportConfig(), recall: int = 20, per_source: int | None = None, seen: Observation | None = None) -> DataFrame:  # noqa: B008
    """event_id, support_status, n_supported, best_item, query, candidates and the number of candidates
    of each of ``OUTCOMES``, of every event. ``seen`` gets the sums of all counts, and events, by the
    pass that makes the result."""
    pairs = compared(events, pool, end, cfg, recall, per_source)
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    best = F.max_by("item_id", F.when(F.col("outcome").isin(*OUTCOMES[:2]), F.struct(F.col("outcome") == "supported", "score", "item_id")))
    got = pairs.groupBy("event_id").agg(F.count("*").alias("candidates"), *counts, best.alias("best_item"))
    asked = events.select("event_id", query_text(F.col("title"), F.col("entities"), F.col("keywords")).alias("query"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("candidates", *OUTCOMES)}
    out = asked.join(got, "event_id", "left").withColumns(zero)
    status = F.when(F.col("supported") > 0, "supported").when(F.col("weak_supported") > 0, "weak_supported").otherwise("not_found")
    out = out.select("event_id", status.alias("support_status"), F.col("supported").alias("n_supported"), "best_item", "query", "candidates", *OUTCOMES)
    return out if seen is None else out.observe(seen, F.count("*").alias("events"), *[F.sum(c).alias(c) for c in zero])


def support(events: DataFrame, pool: DataFrame, end: Column, cfg: SupportConfig = SupportConfig(), recall: int = 20) -> DataFrame:  # noqa: B008
    """event_id, support_status, n_supported, best_item of every event (see ``compared``)."""
    return audited_support(events, pool, end, cfg, recall).select("event_id", "support_status", "n_supported", "best_item")


def best_freshness(refs: DataFrame, end: Column) -> DataFrame:
    """event_id, freshness: the bucket of an event's freshest reference."""
    return refs.groupBy("event_id").agg(N.freshness_bucket(F.min(N.hours_between(end, F.col("published_at")))).alias("freshness"))


def reference_order(refs: DataFrame) -> DataFrame:
    """Adds place: an event's references, supporting ones first, then by reranker (none last) and score."""
    return ranked(refs, ["event_id"], [F.desc("supported"), F.desc_nulls_last("rerank"), F.desc("score"), F.asc("item_id")])


def coverage(refs: DataFrame) -> DataFrame:
    """event_id, sources, stories, level: how many independent sources and stories support it."""
    out = refs.groupBy("event_id").agg(F.count_distinct("source_name").alias("sources"), F.count_distinct(X.normalize_words(F.col("title"))).alias("stories"))
    return out.withColumn("level", F.when(F.col("sources") <= 1, "single_source").when(F.col("stories") <= 1, "multi_source_duplicate").otherwise("multi_source_independent"))


def agenda(items: DataFrame, start: Column, end: Column) -> DataFrame:
    """Official events by exact day and title: event_id, title, sources, items, first and last."""
    ok = items.where(I.safe_url(F.col("url")) & (F.trim("title") != "") & N.publication_exclusion(F.col("published_at"), start, end).isNull())
    keyed = ok.withColumn("event_id", I.agenda_id(F.date_format("published_at", "yyyy-MM-dd"), F.col("title")))
    return keyed.groupBy("event_id").agg(F.min("title").alias("title"), F.count_distinct("source_name").alias("sources"), F.count("*").alias("items"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"))


def sections_order(events: DataFrame) -> DataFrame:
    """Adds place: by sources, latest report and id, over all events."""
    return ranked(events, [], [F.desc("sources"), F.desc("last_at"), F.asc("event_id")])
