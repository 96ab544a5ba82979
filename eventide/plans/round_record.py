"""Recording a round: what its items say of every tracked event, as observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import observe


def record_round(tracked: DataFrame, rounds: DataFrame, items: DataFrame, owners: DataFrame, overrides: DataFrame, scores: DataFrame) -> DataFrame:
    """An observation for each tracked event and round of its platform.

    ``items``: round_id, content_hash, rank, native_heat; ``owners``: content_hash, event_id;
    ``overrides``: the same, and stronger; ``scores``: event_id, platform, round_id, score. Items
    find their event by hash; the best rank and highest heat of an event's items count, and only
    while it is present. Presence has three values."""
    o = owners.select("content_hash", F.col("event_id").alias("_own")).dropDuplicates(["content_hash"])
    v = overrides.select("content_hash", F.col("event_id").alias("_over")).dropDuplicates(["content_hash"])
    hits = items.join(o, "content_hash", "left").join(v, "content_hash", "left").withColumn("event_id", F.coalesce("_over", "_own")).where("event_id is not null")
    best = hits.groupBy("event_id", "round_id").agg(F.min("rank").alias("_rank"), F.max("native_heat").alias("_heat"))
    m = observe.presence_matrix(tracked, rounds, best.select("event_id", "round_id"))
    out = m.join(best, ["event_id", "round_id"], "left").join(scores, ["event_id", "platform", "round_id"], "left")
    seen = F.coalesce("present", F.lit(False))
    return out.withColumns({"rank": F.when(seen & (F.col("platform") == "zhihu"), F.col("_rank")), "native_heat": F.when(seen, F.col("_heat")), "score": F.when(seen, F.col("score"))}).drop("_rank", "_heat")
