"""Rounds of observation: presence of tracked events, with unknown kept apart from absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_observations(obs: DataFrame, version: str = "ingested_at") -> DataFrame:
    """The last version of each (event, platform, observation): an idempotent upsert."""
    w = Window.partitionBy("event_id", "platform", "observation_id").orderBy(F.desc(version), F.desc("observed_at"))
    return obs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def conflicting_times(obs: DataFrame) -> DataFrame:
    """Observation ids that were used with more than one time: an error."""
    return obs.groupBy("observation_id").agg(F.count_distinct("observed_at").alias("times")).where("times > 1").select("observation_id", "times")


def presence(hit: Column, succeeded: Column, complete: Column, same_scope: Column) -> Column:
    """True if seen in a round that succeeded; false only if a complete round of the same scope
    did not have it; else unknown (null)."""
    return F.when(hit & succeeded, True).when(~hit & succeeded & complete & same_scope, False)


def presence_matrix(tracked: DataFrame, rounds: DataFrame, hits: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """tracked events x rounds of their platform with presence. ``tracked``: event_id, platform;
    ``rounds``: round_id, platform, observed_at, succeeded, complete, scope; ``hits``: event_id,
    round_id. Events and rounds meet on the platform; a row an event and round is the result, so bound the
    rounds by a report's window (``start``, ``end``]. Scopes compare with the round before, in the window or not."""
    previous = F.lag("scope").over(Window.partitionBy("platform").orderBy("observed_at", "round_id"))
    r = rounds.withColumn("same_scope", F.coalesce(previous == F.col("scope"), F.lit(True)))
    r = r.where((F.col("observed_at") > start) & (F.col("observed_at") <= end)) if start is not None and end is not None else r
    h = hits.select("event_id", "round_id", F.lit(True).alias("hit")).distinct()
    m = tracked.join(r, "platform").join(h, ["event_id", "round_id"], "left")
    return m.withColumn("present", presence(F.coalesce("hit", F.lit(False)), F.col("succeeded"), F.col("complete"), F.col("same_scope"))).drop("hit")


def integrity(obs: DataFrame) -> DataFrame:
    """Observations that contradict themselves: a rank without presence, or absence from a round
    that could not show it."""
    ranked = F.col("rank").isNotNull() & ((F.col("platform") != "zhihu") | ~F.coalesce("present", F.lit(False)))
    absent = (F.col("present") == F.lit(False)) & ~(F.coalesce(F.col("collection_status") == "succeeded", F.lit(False)) & F.coalesce("list_complete", F.lit(False)) & F.col("topn_scope").isNotNull())
    return obs.where(F.coalesce(ranked, F.lit(False)) | F.coalesce(absent, F.lit(False)))


def distinct_rounds(obs: DataFrame, end: Column, hours: int = 24) -> DataFrame:
    """event_id, platform, rounds: distinct rounds with presence in (end - hours, end]."""
    inside = (F.col("observed_at") > end - F.make_dt_interval(hours=F.lit(hours))) & (F.col("observed_at") <= end)
    return obs.where(inside & F.col("present")).groupBy("event_id", "platform").agg(F.count_distinct(F.coalesce("run_id", "observation_id")).alias("rounds"))


def last_before(points: DataFrame, history: DataFrame, by: list[str], ts: str = "observed_at") -> DataFrame:
    """As-of join, backward and exclusive: each point with the latest earlier row of ``history``
    as ``last_<column>``. One sort by key and time over both, no pairing; a point doesn't see
    history at its own time."""
    values = [c for c in history.columns if c not in by]
    p = points.withColumns({"_at": F.col(ts), "_kind": F.lit(0), "_h": F.lit(None).cast(history.select(F.struct(*values).alias("s")).schema["s"].dataType)})
    h = history.select(*by, F.col(ts).alias("_at"), F.lit(1).alias("_kind"), F.struct(*values).alias("_h"))
    w = Window.partitionBy(*by).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = p.unionByName(h, allowMissingColumns=True).withColumn("_last", F.last("_h", ignorenulls=True).over(w))
    return both.where("_kind = 0").select(*points.columns, *[F.col(f"_last.{v}").alias(f"last_{v}") for v in values])


def trailing_rounds(obs: DataFrame, hours: int = 24) -> DataFrame:
    """Adds prior_rounds: distinct other rounds of the same event in the trailing hours."""
    w = Window.partitionBy("event_id", "platform").orderBy(F.unix_seconds("observed_at")).rangeBetween(-hours * 3600, 0)
    return obs.withColumn("prior_rounds", (F.size(F.collect_set("run_id").over(w)) - 1).cast("bigint"))


def attach_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """child_id, parent_id where exactly one discovery parent matches on platform and either id
    or link. A key's parents meet its children as their smallest and largest, so no pairs are made: a
    child has one parent if both are the same over all its keys."""
    ends = lambda low, high: (F.min(low).alias("parent_id"), F.max(high).alias("_last"))
    p = parents.select("platform", "parent_id", F.explode(F.array_compact(F.array("ref", "url"))).alias("k")).groupBy("platform", "k").agg(*ends("parent_id", "parent_id"))
    c = children.select("platform", "child_id", F.explode(F.array_distinct(F.array_compact(F.array("ref", "url")))).alias("k"))
    return c.join(p, ["platform", "k"]).groupBy("child_id").agg(*ends("parent_id", "_last")).where(F.col("parent_id") == F.col("_last")).drop("_last")
