"""Classes A to F by coverage, their confidence and the sort key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C


def category(zhihu: Column, weibo: Column, match: Column, supported: Column, official: Column) -> Column:
    """A both lists and evidence; B a list, search on the other side and evidence; C both sides
    without; D one list and evidence; E one list; F an official source alone."""
    a, b, c, d, e, f, unknown = C.CATEGORIES
    any_, both, searched = zhihu | weibo, zhihu & weibo, match.isin("search_supported", "weak_search_supported")
    return F.when(both & supported, a).when(searched & supported & any_, b).when((both | searched) & ~supported, c).when(any_ & supported, d).when(any_, e).when(official, f).otherwise(unknown)


def _rank(c: str, table: dict[str, int]) -> Column:
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.col(c)], F.lit(max(table.values()))).cast("int")


def confidence(category_: Column, support: Column, hit: Column, presence: Column, flags: Column) -> Column:
    """How sure a class is: an unavailable source makes any class uncertain."""
    a, b, c, d, e, f, _ = C.CATEGORIES
    matched = hit.isin("same_id_or_title", "entity_action_match", "keyword_overlap")
    return (
        F.when(F.array_contains(flags, "source_unavailable"), "low").when(category_ == a, "high")
        .when(category_ == b, F.when(hit == "same_id_or_title", "high").otherwise("medium")).when(category_.isin(c, d), "medium")
        .when(category_ == e, F.when((presence >= 2) | matched, "medium").otherwise("low")).when(category_ == f, F.when(support == "supported", "medium").otherwise("low")).otherwise("unknown")
    )


def match_type(zhihu: Column, weibo: Column, zhihu_search: Column, weibo_search: Column, relation: Column, official: Column) -> Column:
    """How the platforms meet; ``relation`` is the least confidence of the search relations."""
    crossed = (weibo & zhihu_search) | (zhihu & weibo_search)
    weak = F.coalesce(relation < 0.70, F.lit(False))
    return F.when(zhihu & weibo, "natural_topn_overlap").when(crossed, F.when(weak, "weak_search_supported").otherwise("search_supported")).when(zhihu | weibo, "single_platform_only").when(official, "official_only").otherwise("none")


SORT_KEY = ("k_category", "k_support", "k_match", "k_bucket", "k_presence", "k_delta", "k_hit", "k_freshness", "k_health", "k_noise")


def classify(rows: DataFrame) -> DataFrame:
    """Adds match_type, category, confidence_level and the ten sort columns. Input: zhihu_topn,
    weibo_topn, zhihu_search, weibo_search, official_source (booleans), support_status,
    relation_confidence, rank_bucket, presence, rank_delta, search_hit, freshness, health, flags."""
    b = lambda n: F.coalesce(F.col(n), F.lit(False))
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    supported = F.coalesce(F.col("support_status").isin("supported", "weak_supported"), F.lit(False))
    out = rows.withColumn("match_type", match_type(b("zhihu_topn"), b("weibo_topn"), b("zhihu_search"), b("weibo_search"), F.col("relation_confidence"), b("official_source")))
    out = out.withColumn("category", category(b("zhihu_topn"), b("weibo_topn"), F.col("match_type"), supported, b("official_source")))
    out = out.withColumn("confidence_level", confidence(F.col("category"), F.col("support_status"), F.col("search_hit"), F.coalesce("presence", F.lit(1)), flags))
    return out.withColumns({
        "k_category": _rank("category", C.CATEGORY_RANK), "k_support": _rank("support_status", C.SUPPORT_RANK), "k_match": _rank("match_type", C.MATCH_RANK), "k_bucket": _rank("rank_bucket", C.BUCKET_RANK),
        "k_presence": -F.coalesce("presence", F.lit(0)).cast("int"), "k_delta": _rank("rank_delta", C.DELTA_RANK), "k_hit": _rank("search_hit", C.HIT_RANK), "k_freshness": _rank("freshness", C.FRESHNESS_RANK),
        "k_health": _rank("health", C.HEALTH_RANK), "k_noise": F.size(F.coalesce("flags", F.array().cast("array<string>"))),
    })


def evidence(rows: DataFrame) -> DataFrame:
    """Adds ``evidence``, the summary of what a class rests on: lead, platform_evidence,
    official_evidence, limitations, and whether its wording must be careful. ``rows`` has title,
    category, four platform booleans, support_status, coverage, n_references, limitations and
    missing_fields."""
    fields = ("weibo_topn", "zhihu_topn", "weibo_search", "zhihu_search")
    named = ("weibo_topn", "zhihu_topn", "weibo_cli", "zhihu_search")
    platforms = F.array_compact(F.array(*[F.when(F.col(f), F.lit(n)) for f, n in zip(fields, named, strict=True)]))
    lead = F.concat(F.coalesce("title", F.lit("")), F.lit(" classified as "), F.col("category"), F.when(F.size(platforms) > 0, " from current 24h evidence").otherwise(""))
    official = F.when(F.col("support_status") != "not_checked", F.array(F.concat(F.col("support_status"), F.lit("; coverage="), F.coalesce("coverage", F.lit("none")), F.lit("; references="), F.coalesce(F.col("n_references"), F.lit(0)).cast("string")))).otherwise(F.array().cast("array<string>"))
    both = F.array_distinct(F.concat("limitations", "missing_fields"))
    return rows.withColumn("evidence", F.struct(lead.alias("lead"), platforms.alias("platform_evidence"), official.alias("official_evidence"), both.alias("limitations"), (F.col("support_status") == "not_found").alias("conservative_language_required")))
