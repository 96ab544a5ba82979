"""Entity resolution: which signals describe the same event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import COMPARABLE_ENTITY_SUFFIXES, MatchConfig
from ..functions import numbers as N
from ..functions import text as X
from ..functions.settle import settled
from .filters import representatives
from .retrieve import bm25_top_k

#: Kinds of identity; any one makes a signal and an event the same.
IDENTITIES = ("signal_ids", "source_ids", "platform_ids", "canonical_ids", "urls")


#: Rows of one key that meet each other in one task at most.
CHUNK = 1_000

#: Identities that a row takes along into a join at most.
CARRIED = 32


def _chunks(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """Keys with more than ``CHUNK`` rows, and into how many chunks each is cut."""
    return rows.groupBy(*key).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(name)).where(F.col(name) > 1)


def pairs_between(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """The equi-join of two tables on ``key``, where a frequent key's rows are dealt to chunks and
    every two chunks meet in a task of their own: no task sees more than two chunks."""
    n, m = F.coalesce("_cl", F.lit(1)), F.coalesce("_cr", F.lit(1))
    sized = lambda df: df.join(_chunks(left, key, "_cl"), key, "left").join(_chunks(right, key, "_cr"), key, "left")
    mine = lambda df, k: F.pmod(F.xxhash64(*df.columns), k).cast("int")
    to = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    x = sized(left).withColumn("_i", mine(left, n)).withColumn("_j", to(m)).drop("_cl", "_cr")
    y = sized(right).withColumn("_j", mine(right, m)).withColumn("_i", to(n)).drop("_cl", "_cr")
    return x.join(y, [*key, "_i", "_j"]).drop("_i", "_j")


def pairs_within(rows: DataFrame, id_col: str, key: str) -> DataFrame:
    """Distinct pairs a < b of ids that share a key. ``rows``: id and key, one row each; a frequent
    key is cut into chunks as in ``pairs_between``."""
    one = rows.select(F.col(id_col).alias("id"), key).distinct()
    n = F.coalesce("_c", F.lit(1))
    sized = one.join(_chunks(one, [key], "_c"), key, "left").withColumn("_mine", F.pmod(F.xxhash64("id"), n).cast("int"))
    a = sized.withColumn("_i", F.col("_mine")).withColumn("_j", F.explode(F.sequence(F.col("_mine"), n - 1))).select(key, "_i", "_j", F.col("id").alias("x"))
    b = sized.withColumn("_j", F.col("_mine")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_mine")))).select(key, "_i", "_j", F.col("id").alias("y"))
    met = a.join(b, [key, "_i", "_j"]).where((F.col("_i") < F.col("_j")) | (F.col("x") < F.col("y")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def hard_identities(signals: DataFrame, events: DataFrame) -> DataFrame:
    """signal_id, event_id, id_match, url_match: equality of any identity, as one equi-join on
    (kind, key) of exploded keys rather than a join with or.

    A pair is made at the smallest key that both have, which their rows carry, so pairs aren't
    shuffled to be told apart. Only pairs with a row of more than ``CARRIED`` keys are."""

    def keys(df: DataFrame, id_col: str, n: str, every: str) -> DataFrame:
        of = lambda kind: F.transform(F.coalesce(kind, X.empty()), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))
        flat = df.select(id_col, F.explode(F.flatten(F.array(*[of(k) for k in IDENTITIES]))).alias("p")).where("p.key <> ''")
        own = Window.partitionBy(id_col)
        counted = flat.repartition(id_col).distinct().withColumn(n, F.count("*").over(own))
        carried = F.collect_list(F.when(F.col(n).between(2, CARRIED), F.col("p"))).over(own)
        return counted.withColumn(every, carried).select(id_col, "p.kind", "p.key", n, every)

    s, e = keys(signals, "signal_id", "_ns", "_s"), keys(events, "event_id", "_ne", "_e")
    url, few_s, few_e, both = F.col("kind") == "urls", F.col("_ns") <= CARRIED, F.col("_ne") <= CARRIED, F.array_intersect("_s", "_e")
    lone = (F.col("_ns") == 1) | (F.col("_ne") == 1)
    met = pairs_between(s.where(few_s), e.where(few_e), ["kind", "key"]).where(lone | (F.array_min(both) == F.struct("kind", "key")))
    match = lambda own, f: F.when(lone, own).otherwise(F.exists(both, f))
    once = met.select("signal_id", "event_id", match(~url, lambda p: p["kind"] != "urls").alias("id_match"), match(url, lambda p: p["kind"] == "urls").alias("url_match"))
    bare = lambda df: df.drop("_ns", "_s", "_ne", "_e")
    hit = pairs_between(bare(s.where(~few_s)), bare(e), ["kind", "key"]).unionByName(pairs_between(bare(s.where(few_s)), bare(e.where(~few_e)), ["kind", "key"]))
    return once.unionByName(hit.groupBy("signal_id", "event_id").agg(F.bool_or(~url).alias("id_match"), F.bool_or(url).alias("url_match")))


def embedding_gate(score: Column, anchored: Column) -> Column:
    return F.when(score.isNull(), "missing").when(score < 0.60, "separate").when((score < 0.70) & ~anchored, "review").otherwise("pass")


def pair_features(pairs: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:  # noqa: B008
    """Features of candidate pairs. Columns a_* are the signal's, b_* the event's: title, text,
    entities, actions, keywords, time; bm25, embedding, rerank (null: none), id_match, url_match."""
    hours = N.hours_between(F.col("a_time"), F.col("b_time"))
    known = F.coalesce(hours <= cfg.window_hours, F.lit(False))
    # What several features read is worked out once a pair.
    shared = {f"_{s}": X.normalize_space(F.col(f"{s}_title")) for s in "ab"} | {f"_f{s}": X.facts(F.col(f"{s}_title")) for s in "ab"} | {"_text": X.normalize_space(F.col("b_text"))}
    pairs = settled(pairs, **shared)
    pairs = settled(pairs, **{f"_g{s}": X.ngrams(F.col(f"_{s}"), 2, 4) for s in "ab"})
    ta, tb = F.col("_a"), F.col("_b")
    p = pairs.withColumns({
        "hard": F.coalesce("id_match", F.lit(False)) | F.coalesce("url_match", F.lit(False)),
        "containment": X.title_containment(F.col("a_title"), F.col("b_title")) | ((ta == tb) & (ta != "")),
        "ngram": X.jaccard(F.col("_ga"), F.col("_gb")),
        "keyword": X.term_overlap(F.col("a_keywords"), F.col("_text")),
        "entity": X.jaccard(F.col("a_entities"), F.col("b_entities")),
        "action": X.jaccard(F.col("a_actions"), F.col("b_actions")),
        "bm25_part": N.saturating(F.col("bm25")),
        "in_window": known,
        "time_conflict": F.coalesce(hours > cfg.window_hours, F.lit(False)),
        "entity_conflict": X.entity_conflict(F.col("a_entities"), F.col("b_entities"), COMPARABLE_ENTITY_SUFFIXES, F.col("a_title"), F.col("b_title")),
        "fact_conflicts": X.conflicts(F.col("_fa"), F.col("_fb")),
    })
    p = p.withColumn("anchored", F.col("containment") | ((F.col("entity") > 0) & (F.col("action") > 0)))
    gate = embedding_gate(F.col("embedding"), F.col("anchored"))
    p = p.withColumn("gate", F.when(F.lit(cfg.use_embedding) | F.col("rerank").isNotNull(), gate).otherwise("pass"))
    conflict = F.col("entity_conflict") | F.col("time_conflict") | (F.size("fact_conflicts") > 0)
    support = (
        (F.coalesce("rerank", F.lit(0.0)) >= 0.95) & (F.col("gate") == "pass") & ~conflict
        & (F.col("containment") | ((F.length(ta) >= 8) & (F.length(tb) >= 8) & ((F.col("ngram") >= 0.30) | ((F.col("ngram") >= 0.15) & (F.col("keyword") >= 0.25) & (F.col("bm25_part") >= 0.60)))))
    )
    matched = F.array_compact(F.array(
        F.when(F.col("id_match"), "id_match"), F.when(F.col("url_match"), "url_match"), F.when(F.col("containment"), "title_containment"),
        F.when(F.col("keyword") >= cfg.keyword_high, "keyword_overlap"), F.when((F.col("ngram") >= cfg.ngram_high) | (F.col("bm25_part") >= cfg.bm25_min), "bm25_ngram"),
        F.when((F.col("entity") > 0) & ~F.col("time_conflict"), "entity_time_rule"), F.when(F.col("embedding") >= cfg.embedding_candidate, "embedding_rerank"), F.when(F.col("rerank").isNotNull(), "cross_encoder"),
    ))
    return p.withColumns({"any_conflict": conflict, "semantic_support": support, "matched_by": matched}).drop(*shared, "_ga", "_gb")


def confidence(cfg: MatchConfig = MatchConfig()) -> Column:  # noqa: B008
    """Confidence of a pair, over the columns of ``pair_features``."""
    c, e = F.col, F.coalesce("embedding", F.lit(0.0))
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    base = 0.35 * flag(c("containment")) + 0.20 * c("keyword") + 0.20 * F.greatest("ngram", "bm25_part") + 0.15 * c("entity") + 0.10 * c("action") + 0.10 * flag(c("in_window")) + 0.15 * e
    ranked = (
        F.when(c("rerank").isNull(), base).when(c("anchored") & (c("rerank") >= cfg.rerank_auto), F.greatest(base, c("rerank"))).when(c("rerank") >= cfg.rerank_auto, F.greatest(base, F.lit(0.60)))
        .when((c("rerank") < 0.20) & ~c("containment"), F.least(base, F.lit(0.59))).otherwise(base)
    )
    alone = (c("embedding") >= cfg.embedding_candidate) & ~c("containment") & (c("entity") == 0) & (c("action") == 0) & (c("keyword") < cfg.keyword_high)
    plain = ranked - flag(F.coalesce("a_weak", F.lit(False))) * 0.10
    rest = F.when(c("semantic_support"), N.clip(c("rerank"))).when(c("gate").isin("review", "missing"), F.least(N.clip(ranked), F.lit(0.60))).otherwise(N.clip(F.when(alone, F.least(plain, F.lit(0.60))).otherwise(plain)))
    return F.round(F.when(c("any_conflict"), 0.0).when(c("hard"), 0.98).when(c("gate") == "separate", 0.0).otherwise(rest), 4)


def decision(cfg: MatchConfig = MatchConfig()) -> Column:  # noqa: B008
    """merge, candidate_review, create or reject, over ``pair_features`` and confidence."""
    c = F.col
    weak = F.coalesce("a_weak", F.lit(False))
    held = weak & ~(c("semantic_support") | (c("entity") > 0) | c("a_time").isNotNull())
    return (
        F.when(c("entity_conflict") | c("time_conflict") | (F.size("fact_conflicts") > 0), "reject")
        .when(F.coalesce("cluster_conflict", F.lit(False)) & ~c("hard"), "candidate_review")
        .when(c("hard"), "merge")
        .when((c("rerank") < cfg.rerank_reject) & ~c("containment"), "create")
        .when(c("gate") == "separate", "create")
        .when(c("gate").isin("review", "missing"), "candidate_review")
        .when(c("containment") & weak & ~c("semantic_support"), "candidate_review")
        .when(c("confidence") >= cfg.auto_merge, F.when(held, "candidate_review").otherwise("merge"))
        .when(c("confidence") >= cfg.review, "candidate_review")
        .otherwise("create")
    )


def resolve(features: DataFrame, signals: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:  # noqa: B008
    """One row a signal: its best candidate, decision and confidence. A merge whose second best
    is as good is reviewed; a signal without candidates founds an event."""
    scored = features.withColumn("confidence", confidence(cfg)).withColumn("decision", decision(cfg))
    w = Window.partitionBy("signal_id").orderBy(F.desc("confidence"), F.desc(F.coalesce("rerank", F.lit(-1.0))), "event_id")
    best = scored.withColumns({"place": F.row_number().over(w), "second": F.lead("confidence").over(w)}).where("place = 1")
    unclear = (F.col("decision") == "merge") & ~F.col("hard") & (F.col("second") >= cfg.auto_merge) & (F.col("confidence") - F.col("second") < cfg.margin)
    best = best.withColumn("decision", F.when(unclear, "candidate_review").otherwise(F.col("decision"))).select("signal_id", "event_id", "decision", "confidence", "matched_by")
    out = signals.select("signal_id", F.coalesce("weak", F.lit(False)).alias("_weak")).join(best, "signal_id", "left")
    alone = F.col("decision").isNull()
    return out.select(
        "signal_id", "event_id", F.coalesce("decision", F.lit("create")).alias("decision"),
        F.when(alone, F.when(F.col("_weak"), 0.55).otherwise(0.75)).otherwise(F.col("confidence")).alias("confidence"),
        F.coalesce("matched_by", X.empty()).alias("matched_by"), (F.col("decision").eqNullSafe("candidate_review") | (alone & F.col("_weak"))).alias("review_required"),
    )


def judged_policy(judgments: DataFrame) -> DataFrame:
    """signal_id, decision from judged pairs: one same and nothing plausible merges."""
    n = judgments.groupBy("signal_id").agg(F.count_if(F.col("verdict") == "same").alias("same"), F.count_if(F.col("verdict") == "plausible").alias("plausible"))
    return n.select("signal_id", F.when((F.col("same") == 1) & (F.col("plausible") == 0), "merge").when((F.col("same") > 0) | (F.col("plausible") > 0), "candidate_review").otherwise("create").alias("decision"))


def merge_events(events: DataFrame, merged_into: DataFrame, documents: int = 3) -> DataFrame:
    """Events folded into their targets: first and last seen, the union of their ids, and, if they
    have ``documents`` (an ordered list), at most three of them: the first and the latest."""
    to = events.join(merged_into, "event_id", "left").withColumn("_from", F.col("event_id")).withColumn("event_id", F.coalesce("target_id", "event_id")).drop("target_id")
    ids = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    out = to.groupBy("event_id").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), ids("source_ids"), ids("urls"))
    if "documents" not in events.columns:
        return out
    # Each event keeps its first and its latest before events meet: those are among the target's.
    kept = representatives(F.array_distinct("documents"), documents)
    flat = to.select("event_id", F.col("first_seen_at").alias("_at"), "_from", F.posexplode(kept).alias("_k", "document"))
    folded = flat.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("_at", "_from", "_k", "document"))).alias("_d"))
    return out.join(folded.select("event_id", representatives(F.array_distinct(F.transform("_d", lambda d: d["document"])), documents).alias("documents")), "event_id", "left")


def unordered_pairs(rows: DataFrame, id_col: str, key: str, judged: DataFrame | None = None) -> DataFrame:
    """a < b for rows that share a key (an array column), each pair once, without judged ones."""
    out = pairs_within(rows.select(F.col(id_col), F.explode(key).alias("k")), id_col, "k")
    return out.join(judged.select("a", "b"), ["a", "b"], "left_anti") if judged is not None else out


def duplicate_candidates(events: DataFrame, id_col: str, text: str, k: int = 20, judged: DataFrame | None = None, after: tuple | None = None) -> DataFrame:
    """a < b, score: pairs of events to be judged as duplicates: each event with its ``k`` nearest by
    BM25, both ways, without judged pairs and from the cursor ``after`` (a pair) on, so that a scan can
    stop and go on. A set of at most ``k`` events with common terms is scanned whole."""
    q = events.select(F.col(id_col).alias("q"), F.col(text).alias("text"))
    near = bm25_top_k(q, q.select(F.col("q").alias("d"), "text"), "q", "d", "text", "text", k + 1).where("q <> d")
    out = near.groupBy(F.least("q", "d").alias("a"), F.greatest("q", "d").alias("b")).agg(F.max("score").alias("score"))
    if judged is not None:
        out = out.join(judged.select("a", "b"), ["a", "b"], "left_anti")
    if after is not None:
        out = out.where((F.col("a") > F.lit(after[0])) | ((F.col("a") == F.lit(after[0])) & (F.col("b") > F.lit(after[1]))))
    return out
