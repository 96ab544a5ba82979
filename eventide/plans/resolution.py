"""Resolution of a round: retrieve, compare, decide, guard; later signals see what earlier ones made."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..operators import guardrails, match, retrieve
from ..sources.shared import stored

_FIELDS = ("title", "text", "entities", "actions", "keywords", "time")
_NO_SCORES = "signal_id string, event_id string, embedding double, rerank double"


def compared(signals: DataFrame, events: DataFrame, cfg: MatchConfig, scores: DataFrame | None = None) -> DataFrame:
    """Features, confidence and guarded decision of candidate pairs (signal_id, event_id): the best
    of BM25 and all hard identities. ``scores``: signal_id, event_id, embedding, rerank of models
    that the caller ran; a pair that isn't there has no score."""
    sparse = retrieve.bm25_top_k(signals, events, "signal_id", "event_id", "text", "text", cfg.retrieval_limit)
    hard = match.hard_identities(signals, events)
    pairs = sparse.select("signal_id", "event_id", F.col("score").alias("bm25")).join(hard, ["signal_id", "event_id"], "full_outer")
    if scores is None:
        pairs = pairs.withColumns({c: F.lit(None).cast("double") for c in ("embedding", "rerank")})
    else:
        pairs = pairs.join(scores.select("signal_id", "event_id", "embedding", "rerank"), ["signal_id", "event_id"], "left")
    a = signals.select("signal_id", *[F.col(c).alias(f"a_{c}") for c in _FIELDS], F.col("weak").alias("a_weak"))
    b = events.select("event_id", *[F.col(c).alias(f"b_{c}") for c in _FIELDS])
    known = {c: F.coalesce(c, F.lit(False)) for c in ("id_match", "url_match")} | {"bm25": F.coalesce("bm25", F.lit(0.0)), "cluster_conflict": F.lit(False)}
    return match.pair_features(pairs.join(a, "signal_id").join(b, "event_id").withColumns(known), cfg)


def _decide(features: DataFrame, signals: DataFrame, cfg: MatchConfig) -> DataFrame:
    best = match.resolve(features, signals, cfg)
    checked = features.withColumns({"confidence": match.confidence(cfg)}).withColumn("decision", match.decision(cfg)).withColumn("pair", F.struct("signal_id", "event_id"))
    status = guardrails.roll_up(guardrails.merge_rules(cfg).check(checked, "pair"), "pair").select("pair.*", "status")
    out = best.join(status, ["signal_id", "event_id"], "left").withColumn("status", F.coalesce("status", F.lit("pass")))
    return out.withColumn("decision", guardrails.finalize(F.col("decision"), F.col("status")))


def resolve_round(signals: DataFrame, events: DataFrame, cfg: MatchConfig = MatchConfig(), scores: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """signal_id, event_id, decision, confidence, status for every signal, each by itself.

    ``signals``: signal_id, title, text, entities, actions, keywords, time, weak and the identity
    arrays; ``events``: event_id and the same."""
    return _decide(compared(signals, events, cfg, scores), signals, cfg)


def resolve_in_order(signals: DataFrame, events: DataFrame, cfg: MatchConfig = MatchConfig(), scores: DataFrame | None = None, rounds: int = 50) -> DataFrame:  # noqa: B008
    """As ``resolve_round``, with ``target``, as if signals came one after the other by ``seq``: a
    signal may join the event that an earlier one founded (named ``new:<signal_id>``), by its text,
    or any event that an earlier one joined, by a hard identity. Signals under review join nothing.

    Pairs with events and with earlier signals are compared once and written. All signals are
    decided by themselves first. A pass then decides those again that have a candidate whose
    founder's outcome changed in the pass before, and carries the others on: passes are as many as the
    longest chain of candidates, and the result is that of going one by one. Scores of pairs of signals have
    the earlier one's ``new:`` name. Candidates are the best of BM25 among the whole round."""
    old = stored(compared(signals, events, cfg, scores).withColumn("event_id", F.col("event_id").cast("string")), "pairs")
    others = signals.drop("event_ids").withColumn("event_id", F.concat(F.lit("new:"), F.col("signal_id").cast("string")))
    order = signals.select(F.col("signal_id").alias("_s"), F.col("seq").alias("_seq"))
    first = signals.select(F.concat(F.lit("new:"), F.col("signal_id").cast("string")).alias("_e"), F.col("seq").alias("_first"))
    inner = compared(signals, others, cfg, scores)
    inner = inner.join(order, inner["signal_id"] == order["_s"]).join(first, inner["event_id"] == first["_e"]).where("_first < _seq").drop("_s", "_e", "_seq", "_first")
    inner = stored(inner.withColumnRenamed("event_id", "founder"), "pairs")
    name = F.concat(F.lit("new:"), F.col("signal_id").cast("string"))
    target = F.when((F.col("decision") == "merge") & ~F.col("review_required"), F.col("event_id")).when((F.col("decision") == "create") & ~F.col("review_required"), name)
    decided = lambda features, of: _decide(features, of, cfg).withColumn("target", target)
    last = stored(decided(old, signals), "resolved")
    again = stored(inner.select("signal_id").distinct(), "unsettled")
    for _ in range(rounds):
        if again.isEmpty():
            return last
        mine = lambda df: df.join(again, "signal_id", "left_semi")  # noqa: E731, B023
        at = last.select(name.alias("founder"), F.col("target").alias("event_id"), F.col("decision").alias("_made"))
        joined = mine(inner).join(at, "founder").where("event_id is not null and (_made = 'create' or hard)").drop("founder", "_made")
        both = mine(old).unionByName(joined).withColumn("_c", match.confidence(cfg))
        w = Window.partitionBy("signal_id", "event_id").orderBy(F.desc("_c"), F.desc(F.coalesce("rerank", F.lit(-1.0))))
        features = both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_c")
        new = stored(decided(features, mine(signals)), "decided")
        before = last.select("signal_id", F.col("target").alias("_t"), F.col("decision").alias("_d"))
        moved = new.join(before, "signal_id").where("not (target <=> _t and decision <=> _d)").select(name.alias("founder"))
        last = stored(last.join(again, "signal_id", "left_anti").unionByName(new), "resolved")
        again = stored(inner.join(moved, "founder", "left_semi").select("signal_id").distinct(), "unsettled")
    raise RuntimeError(f"the round did not settle in {rounds} passes")
