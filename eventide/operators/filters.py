"""Admission of signals, events and evidence, and the summaries that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import numbers as N
from ..functions import text as X
from .ranking import ranked


def accepted_signals(signals: DataFrame, start: Column, end: Column) -> DataFrame:
    """Signals that count in (start, end]: not audit-only, contributing, of an accepted relation;
    official ones by their publication time."""
    when = F.when(F.col("platform") == "official", F.col("published_at")).otherwise(F.col("observed_at"))
    related = F.coalesce(F.col("relation_decision"), F.lit("accepted")) == "accepted"
    return signals.where(~F.col("audit_only") & F.col("contributes") & related & N.publication_exclusion(when, start, end).isNull())


def current_attention(events: DataFrame, items: DataFrame, end: Column, hours: int = 24) -> DataFrame:
    """Events with an accepted discovery item in the trailing hours: a semi-join."""
    fresh = (items["observed_at"] > end - F.make_dt_interval(hours=F.lit(hours))) & (items["observed_at"] <= end)
    return events.join(items.where(fresh & (F.col("signal_role") == "topic_discovery")).select("event_id"), "event_id", "left_semi")


def polluted(created: Column, observed: Column, hours: float = 72) -> Column:
    """A sample that is older than the round by more than the hours."""
    return F.coalesce((F.unix_micros(observed) - F.unix_micros(created)) / 3.6e9 > hours, F.lit(False))


def candidate_events(events: DataFrame, start: Column, end: Column, owned: DataFrame | None = None, hours: int = 72) -> DataFrame:
    """Active events that a round may match: seen recently, or already the owner of an item."""
    near = (F.col("first_seen_at") <= end) & (F.col("last_seen_at") >= end - F.make_dt_interval(hours=F.lit(hours)))
    live = events.where((F.col("status") == "active") & ~F.col("event_id").startswith("official-"))
    if owned is None:
        return live.where(near)
    mark = owned.select("event_id", F.lit(True).alias("_own")).distinct()
    return live.join(mark, "event_id", "left").where(near | F.coalesce("_own", F.lit(False))).drop("_own")


def evidence_pool(items: DataFrame) -> DataFrame:
    """Items that may support an event."""
    return items.where((F.col("source_type") == "official") & F.col("source_status").isin("use", "fallback") & F.col("signal_role").isin("official_evidence", "official_agenda"))


def prior_reports(refs: DataFrame, attention: Column, end: Column, days: int = 7) -> DataFrame:
    """Earlier official reports that a later event may cite: after the earlier of attention and a
    week before the end, not before the event's day (UTC+8), of a specific identity."""
    floor = F.least(attention, end - F.make_dt_interval(days=F.lit(days)))
    day = lambda c: F.to_date(F.from_utc_timestamp(c, "Asia/Shanghai"))
    return refs.where((F.col("published_at") > floor) & (F.col("published_at") <= end) & (day(F.col("published_at")) >= day(F.col("event_time"))) & F.col("specific_identity"))


def recent_main_signals(signals: DataFrame, end: Column, hours: int = 24) -> DataFrame:
    """Materials of the duplicate scan: positive, succeeded, main source, last ``hours``."""
    inside = (F.col("observed_at") > end - F.make_dt_interval(hours=F.lit(hours))) & (F.col("observed_at") <= end)
    return signals.where(inside & F.col("present") & (F.col("collection_status") == "succeeded") & F.col("main_source"))


def run_filter(log: DataFrame, run_id: str, column: str = "input_json") -> DataFrame:
    """Rows whose JSON input names a run."""
    return log.where(F.get_json_object(column, "$.run_id") == run_id)


def observed_time(signals: DataFrame, observations: DataFrame) -> DataFrame:
    """Signals with the latest observation of their source and platform that shares a reference:
    the references are exploded to an equi-join."""
    s = signals.select("signal_id", "source_id", "platform", F.explode("refs").alias("ref"))
    o = observations.select("source_id", "platform", "observed_at", F.explode("refs").alias("ref"))
    t = s.join(o, ["source_id", "platform", "ref"]).groupBy("signal_id").agg(F.max("observed_at").alias("observed_at"))
    return signals.select("signal_id").join(t, "signal_id", "left")


def latest_per_address(deliveries: DataFrame) -> DataFrame:
    """The last delivery of each address, whatever its case."""
    return deliveries.groupBy(F.lower("email").alias("email")).agg(F.max("delivery_id").alias("delivery_id"))


def agenda_rank(refs: DataFrame, end: Column) -> DataFrame:
    """event_id, items, sources, best_status, freshness: the best of an agenda event's items."""
    order = F.when(F.col("status") == "use", 0).when(F.col("status") == "fallback", 1).otherwise(2)
    hours = N.hours_between(end, F.col("published_at"))
    a = refs.groupBy("event_id").agg(F.count("*").alias("items"), F.count_distinct("source_name").alias("sources"), F.min(order).alias("_s"), F.min(hours).alias("_h"))
    return a.select("event_id", "items", "sources", F.element_at(F.array(*map(F.lit, ("use", "fallback", "unavailable"))), F.col("_s") + 1).alias("best_status"), N.freshness_bucket(F.col("_h")).alias("freshness"))


def provenance(rounds: DataFrame) -> DataFrame:
    """run_id, first_at, last_at, rounds, platforms, complete over a collection's rounds."""
    return rounds.groupBy("run_id").agg(F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"), F.count_distinct("round_id").alias("rounds"), F.count_distinct("platform").alias("platforms"), F.bool_and("list_complete").alias("complete"))


def roles_by_source(items: DataFrame) -> DataFrame:
    """source_id with its distinct roles and flags, sorted."""
    return items.groupBy("source_id").agg(F.array_sort(F.collect_set("signal_role")).alias("roles"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("quality_flags")))).alias("flags"))


def reattach(children: DataFrame, decided: DataFrame) -> DataFrame:
    """child_id, event_id: children of a question whose parent was decided, if nobody or the same
    event owns them."""
    j = children.join(decided.select("canonical_id", "event_id"), "canonical_id")
    return j.where(F.col("owner_event_id").isNull() | (F.col("owner_event_id") == F.col("event_id"))).select("child_id", "event_id")


def candidate_context(events: DataFrame, contexts: DataFrame) -> DataFrame:
    """Events with their distinct topic contexts, those with an excerpt first, 1,200 characters."""
    c = contexts.groupBy("event_id").agg(F.array_sort(F.collect_set(F.struct((~F.col("has_excerpt")).alias("o"), F.col("text").alias("t")))).alias("c"))
    text = F.substring(F.array_join(F.array_distinct(F.transform("c", lambda x: x["t"])), "\n"), 1, 1200)
    return events.join(c, "event_id", "left").withColumn("context", F.coalesce(text, F.lit(""))).drop("c")


def representatives(docs: Column, n: int = 3) -> Column:
    """The first and the last ``n - 1`` of an ordered list, once each."""
    last = F.slice(docs, F.greatest(F.lit(2), F.size(docs) - (n - 2)), F.lit(n - 1))
    return F.array_distinct(F.concat(F.slice(docs, 1, 1), F.when(F.size(docs) > 1, last).otherwise(F.slice(docs, 1, 0))))


def literal_prefix(c: Column, prefix: str) -> Column:
    """Whether a text begins with a prefix, whose wildcards count as themselves."""
    return F.coalesce(F.startswith(c, F.lit(prefix)), F.lit(False))


def discovery_first(signals: DataFrame) -> DataFrame:
    """Adds place: discovered topics in their own order (``seq``), then what enriches them."""
    return ranked(signals.withColumn("_late", (F.col("signal_role") == "search_enrichment").cast("int")), [], [F.asc("_late"), F.asc("seq")]).drop("_late")


def merge_maps(left: Column, right: Column) -> Column:
    """Both maps in one; where they share a key the right one wins."""
    rest = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.coalesce(F.map_concat(rest, right), left, right)


def known_entries(m: Column) -> Column:
    """A map without its null values."""
    return F.map_filter(m, lambda _, v: v.isNotNull())


def validated_rounds(rounds: DataFrame) -> DataFrame:
    """run_id, source_id, items, invalid, verdict: what a round would have brought, without writing it. An
    item needs a title and a link or an id; a source without items, or of a failed fetch, doesn't pass."""
    bad = F.filter("items", lambda i: (F.trim(F.coalesce(i["title"], F.lit(""))) == "") | ((F.trim(F.coalesce(i["url"], F.lit(""))) == "") & (F.trim(F.coalesce(i["external_id"], F.lit(""))) == "")))
    items, invalid = F.size(F.coalesce("items", F.array())), F.greatest(F.size(bad), F.lit(0))
    verdict = F.when(F.coalesce("status", F.lit("failed")) != "succeeded", "failed").when(items == 0, "empty").when(invalid > 0, "invalid_items").otherwise("passed")
    return rounds.select("run_id", "source_id", items.alias("items"), invalid.alias("invalid"), verdict.alias("verdict"))


def card_summary(sources: Column) -> Column:
    """The text of the best source: Q&A, microblog, official, else the fallback."""
    keyed = F.transform(F.filter(sources, lambda s: F.trim(s["text"]) != ""), lambda s, i: F.struct(F.when(s["platform"] == "zhihu", 0).when(s["platform"] == "weibo", 1).when(s["platform"] == "official", 2).otherwise(3).alias("o"), i.alias("i"), s["text"].alias("t")))
    return F.array_min(keyed)["t"]


def statuses(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Status samples of a search response, wherever its list stands: text (the long one if there
    is one), counts and time."""
    status = "struct<idstr:string,mid:string,text:string,long_text:struct<long_text_content:string>,created_at:string,reposts_count:bigint,comments_count:bigint,attitudes_count:bigint,user:struct<screen_name:string>>"
    shapes = [F.from_json(payload, f"struct<{k}:array<{status}>>")[k] for k in ("statuses", "items", "data", "results")] + [F.from_json(payload, f"struct<data:struct<statuses:array<{status}>>>")["data"]["statuses"]]
    rest = [c for c in df.columns if c != payload]
    s = df.select(*rest, F.explode(F.coalesce(*shapes)).alias("s"))
    return s.select(*rest, F.coalesce("s.idstr", "s.mid").alias("status_id"), X.clean_body(F.coalesce("s.long_text.long_text_content", "s.text")).alias("text"), F.try_to_timestamp(F.regexp_replace("s.created_at", r"^[A-Za-z]{3}\s+", ""), F.lit("MMM dd HH:mm:ss Z yyyy")).alias("created_at"), F.col("s.reposts_count").alias("reposts"), F.col("s.comments_count").alias("comments"), F.col("s.attitudes_count").alias("likes"))


def site_search(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Records of a news site's search: a JSON envelope of code 0, or an array called docArr in a
    page's script; rows without a title or a safe link are left out."""
    record = "struct<title:string,url:string,content:string,pubtime:string,displayTime:bigint>"
    envelope = F.from_json(payload, f"struct<code:string,data:struct<records:array<{record}>>>")
    script = F.from_json(F.regexp_extract(payload, r"(?s)var\s+docArr\s*=\s*(\[.*?\]);", 1), f"array<{record}>")
    rest = [c for c in df.columns if c != payload]
    r = df.select(*rest, F.explode(F.coalesce(F.when(envelope["code"] == "0", envelope["data"]["records"]), script)).alias("r"))
    when = N.parse_publication(F.coalesce("r.pubtime", F.col("r.displayTime").cast("string")))
    return r.select(*rest, X.clean_title(F.col("r.title")).alias("title"), F.col("r.url").alias("url"), X.clean_body(F.col("r.content")).alias("summary"), when.alias("published_at")).where((F.col("title") != "") & I.safe_url(F.col("url")))


def trend_label(trend: Column, minutes: Column, stale: Column) -> Column:
    """A trend in words."""
    span = F.when(minutes >= 60, F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h"))).otherwise(F.concat(F.floor(minutes).cast("string"), F.lit(" min")))
    return F.when(stale, "no recent observation").when(trend == "unknown", "not comparable").otherwise(F.concat_ws(", ", trend, F.when(minutes.isNotNull(), F.concat(F.lit("seen for "), span))))


#: Flags of a trend that can't be told, the first that applies, and what they mean.
UNKNOWN_TREND = {
    "source_unavailable": "最近一次来源采集失败，无法比较",
    "stale_observation": "最近观测已过期，缺少近期可比数据",
    "incomplete_list": "榜单数据不完整，无法连续比较",
    "missing_sampling_config": "未配置采样间隔，无法确认观测是否连续",
    "no_window_observations": "本期没有可用的榜单采集记录",
    "observation_gap": "相邻采集间隔过长，无法连续比较",
    "incomparable_scope": "前后采集的榜单范围不一致",
    "sampling_changed": "前后采样口径不一致",
    "score_config_changed": "前后热度计算口径不一致",
    "incomparable_scores": "前后两轮热度数据不满足可比条件",
}


def unknown_trend_reason(flags: Column, seen: Column, present: Column, platform: Column) -> Column:
    """Why a trend isn't known, in words: by flag, then by how often the event was seen."""
    gone = F.coalesce(~present, F.lit(False))
    few = F.when(platform == "weibo", "缺少两轮可比的CLI互动指标").otherwise("缺少两轮可比的榜位或热度指标")
    by_flag = F.coalesce(*[F.when(F.array_contains(flags, f), F.lit(text)) for f, text in UNKNOWN_TREND.items()])
    once = F.when(gone, "仅有1次在榜观测，最近一轮已离榜，缺少连续可比热度").otherwise("仅有1次在榜观测，需要两次连续可比数据")
    rest = F.when(seen == 1, once).when(gone, "最近一轮已离榜，缺少连续两轮在榜热度").when(F.array_contains(flags, "insufficient_trend_metrics"), few)
    return F.when(flags.isNull(), "本期未保存趋势观测数据").otherwise(F.coalesce(by_flag, rest, F.when(F.array_contains(flags, "insufficient_history"), "有效历史不足，需要两次连续可比数据"), F.lit("缺少连续可比的榜单观测数据")))
