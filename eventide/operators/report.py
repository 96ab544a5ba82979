"""Briefings: cards, sections, citations, quality review; collection and usage summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import HARMLESS_FLAGS
from ..functions import identity as I
from .ranking import ranked


def sections(cards: DataFrame) -> DataFrame:
    """section, event_id, place: each card in its category's section and in one for each platform
    that shows it."""
    names = F.array_compact(F.array(F.concat(F.lit("category_"), "category"), F.when(F.col("zhihu_present"), "zhihu"), F.when(F.col("weibo_present"), "weibo")))
    s = cards.select("event_id", "title", F.explode(names).alias("section"))
    return ranked(s, ["section"], [F.asc("title"), F.asc("event_id")]).select("section", "event_id", "place")


def review(cards: DataFrame, citations: DataFrame, start: Column, end: Column) -> DataFrame:
    """event_id, error: everything that keeps a briefing from publication."""
    err = lambda df, name: df.select("event_id", F.lit(name).alias("error"))
    dup = cards.groupBy("event_id", "section").count().where("count > 1")
    bad_url = citations.where(~I.safe_url(F.col("url")))
    outside = citations.where(~((F.col("observed_at") > start) & (F.col("observed_at") <= end)))
    cited = citations.groupBy("event_id").agg(F.bool_or(F.col("kind") == "official").alias("official"))
    lacking = cards.join(cited, "event_id", "left").where(F.substring("category", 1, 1).isin("A", "B", "D", "F") & ~F.coalesce("official", F.lit(False)))
    out = err(dup, "duplicate_in_section").unionByName(err(bad_url, "invalid_url")).unionByName(err(outside, "citation_out_of_window")).unionByName(err(lacking, "official_class_without_official_citation"))
    return out.distinct()


def counters(citations: DataFrame) -> DataFrame:
    return citations.agg(F.count_distinct("event_id").alias("events"), F.count_distinct(F.struct("event_id", "url")).alias("citations"))


def source_health(rounds: DataFrame, at: Column, stale_hours: float = 6) -> DataFrame:
    """source_id, health: ok, degraded (flags that matter), stale or unavailable."""
    last = rounds.groupBy("source_id").agg(F.max_by(F.struct("status", "observed_at", "flags"), F.struct("observed_at", "round_id")).alias("r"))
    serious = F.size(F.array_except("r.flags", F.array(*[F.lit(f) for f in HARMLESS_FLAGS]))) > 0
    old = (F.unix_micros(at) - F.unix_micros("r.observed_at")) / 3.6e9 > stale_hours
    return last.select("source_id", F.when(F.col("r.status") != "succeeded", "unavailable").when(old, "stale").when(serious, "degraded").otherwise("ok").alias("health"))


def collection_status(rounds: DataFrame) -> DataFrame:
    """run_id, status over its sources: succeeded, partial, skipped or failed."""
    n = {s: F.count_if(F.col("status") == s).alias(s) for s in ("succeeded", "failed", "skipped")}
    a = rounds.groupBy("run_id").agg(F.count("*").alias("sources"), *n.values())
    status = F.when(F.col("succeeded") == F.col("sources"), "succeeded").when(F.col("succeeded") > 0, "partial").when(F.col("skipped") > 0, "skipped").otherwise("failed")
    return a.withColumn("run_status", status)


def completeness(df: DataFrame, fields: list[str], by: list[str]) -> DataFrame:
    """by, field, ratio, n: share of values that are there; weighted by n they can be merged."""
    filled = [F.avg((F.col(f).isNotNull() & (F.trim(F.col(f).cast("string")) != "")).cast("double")).alias(f) for f in fields]
    a = df.groupBy(*by).agg(F.count("*").alias("n"), *filled)
    return a.select(*by, "n", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("ratio")) for f in fields])).alias("x")).select(*by, "x.field", "x.ratio", "n")


def usage(log: DataFrame) -> DataFrame:
    """source, unit: requests, successes, rate, mean duration, cost (unknown if any is)."""
    a = log.groupBy("source", "unit").agg(F.count("*").alias("requests"), F.count_if("succeeded").alias("succeeded"), F.avg("duration_ms").alias("mean_ms"), F.when(F.count("cost") == F.count("*"), F.sum("cost")).alias("cost"))
    return a.withColumn("success_rate", F.col("succeeded") / F.col("requests"))


def ledger(log: DataFrame) -> DataFrame:
    """task (null: all), requests, charged, unknown."""
    return log.rollup("task").agg(F.count("*").alias("requests"), F.coalesce(F.sum("charged"), F.lit(0)).alias("charged"), F.count_if(F.col("charged").isNull()).alias("unknown"))


def budget(log: DataFrame, limit: int, reserve: int) -> DataFrame:
    """One row: requests, charged, left, and whether another request that may cost ``reserve`` fits."""
    a = log.agg(F.count("*").alias("requests"), F.coalesce(F.sum("charged"), F.lit(0)).alias("charged"))
    return a.withColumns({"left": F.lit(limit) - F.col("charged"), "fits": F.col("charged") + reserve <= limit})


def latest_by(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The latest row of each key; ties by the later columns of ``order``."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def revisions(new: DataFrame, stored: DataFrame, volatile: tuple[str, ...] = ()) -> DataFrame:
    """Reports whose content isn't stored yet, with a fingerprint of all but volatile columns."""
    stable = [c for c in sorted(new.columns) if c not in volatile]
    return new.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*stable)), 256)).join(stored.select("fingerprint"), "fingerprint", "left_anti")


def page(df: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(200, limit)))


def trial_audit(runs: DataFrame, deliveries: DataFrame, since: Column, until: Column) -> DataFrame:
    """subject, status, n, attention: runs and deliveries that started in [since, until] by status,
    and runs that still run an hour after they began (``stale``). Attention: anything that
    failed, waits, is partial or stale, or wasn't sent."""
    inside = (F.col("started_at") >= since) & (F.col("started_at") <= until)
    r = runs.where(inside).groupBy("status").agg(F.count("*").alias("n")).select(F.lit("run").alias("subject"), "status", "n", F.col("status").isin("failed", "partial", "queued", "running").alias("attention"))
    d = deliveries.where(inside).groupBy("status").agg(F.count("*").alias("n")).select(F.lit("delivery").alias("subject"), "status", "n", (F.col("status") != "sent").alias("attention"))
    old = runs.where((F.col("status") == "running") & (F.col("started_at") < until - F.expr("interval 1 hour"))).groupBy("status").agg(F.count("*").alias("n")).select(F.lit("stale").alias("subject"), "status", "n", F.lit(True).alias("attention"))
    return r.unionByName(d).unionByName(old)
