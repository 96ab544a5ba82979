"""Judged pairs replayed from a table: quotes aligned with both texts, verdicts grouped, signals decided.

``judgments``: signal_id, candidate_id, place (of the candidate), decision (same_event,
different_event or insufficient_evidence), uncertainty_kind, evidence and clues (arrays of source_id and
quote), conflicts and missing_information (arrays of texts). ``documents``: source_id, title and text of
signals and candidates. Null arrays are empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PAIR = ["signal_id", "candidate_id"]
_QUOTES = "array<struct<source_id:string,quote:string>>"


def aligned_quotes(judgments: DataFrame, documents: DataFrame) -> DataFrame:
    """signal_id, candidate_id, kind (evidence or clue), n, source_id, quote, field (title or text),
    start and stop (characters from 0; null if the quote doesn't stand there)."""
    of = lambda c, kind: F.transform(F.coalesce(F.col(c).cast(_QUOTES), F.array().cast(_QUOTES)), lambda q, n: F.struct(F.lit(kind).alias("kind"), n.alias("n"), q["source_id"].alias("source_id"), q["quote"].alias("quote")))
    each = judgments.select(*_PAIR, F.explode(F.concat(of("evidence", "evidence"), of("clues", "clue"))).alias("q")).select(*_PAIR, "q.*")
    docs = documents.select(F.col("source_id").alias("_id"), F.coalesce("title", F.lit("")).alias("_title"), F.coalesce("text", F.lit("")).alias("_text"))
    mine = F.col("source_id").isin(F.col("signal_id"), F.col("candidate_id")) & (F.length(F.trim("quote")) > 0)
    at = each.join(docs, F.col("source_id") == F.col("_id"), "left").withColumn("_mine", F.coalesce(mine, F.lit(False)))
    where = lambda c: F.when(F.col("_mine"), F.nullif(F.position(F.col("quote"), F.col(c)), F.lit(0)))
    field = F.when(where("_title").isNotNull(), "title").when(where("_text").isNotNull(), "text")
    start = (F.coalesce(where("_title"), where("_text")) - 1).cast("int")
    return at.select(*_PAIR, "kind", "n", "source_id", "quote", field.alias("field"), start.alias("start"), (start + F.length("quote")).alias("stop"))


def checked(judgments: DataFrame, documents: DataFrame) -> DataFrame:
    """The judgments with ``problem`` (the first rule that one breaks, or null) and ``group``.

    Quotes must stand in the text they name, of the pair. A same event needs evidence from both sides and
    no conflict; uncertainty needs a kind: a possible same event clues from both sides and what is
    missing, a bare context no clues. Groups: same, plausible, context_only, legacy (uncertainty of
    another kind), different; null for a judgment with a problem."""
    quotes = aligned_quotes(judgments, documents)
    side = lambda kind, c: F.coalesce(F.bool_or((F.col("kind") == kind) & (F.col("source_id") == F.col(c))), F.lit(False))
    seen = quotes.groupBy(*_PAIR).agg(
        F.count_if(F.col("field").isNull()).alias("_lost"), F.count_if(F.col("kind") == "clue").alias("_clues"),
        (side("evidence", "signal_id") & side("evidence", "candidate_id")).alias("_both"), (side("clue", "signal_id") & side("clue", "candidate_id")).alias("_both_clues"),
    )
    j = judgments.join(seen, _PAIR, "left").withColumn("_again", F.count("*").over(Window.partitionBy(*_PAIR)) > 1)
    has = lambda c: F.exists(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.length(F.trim(x)) > 0)
    no, unsure, kind = F.lit(False), F.col("decision") == "insufficient_evidence", F.col("uncertainty_kind")
    same, possible = F.col("decision") == "same_event", unsure & (kind == "possible_same_event")
    problem = (
        F.when(F.col("_again") | (F.col("signal_id") == F.col("candidate_id")), "candidate_set_mismatch")
        .when(F.coalesce("_lost", F.lit(0)) > 0, "quote_not_found")
        .when(same & ~F.coalesce("_both", no), "evidence_missing_side").when(same & has("conflicts"), "same_event_has_conflicts")
        .when(unsure & kind.isNull(), "uncertainty_kind_missing")
        .when(possible & ~F.coalesce("_both_clues", no), "clues_missing_side").when(possible & ~has("missing_information"), "uncertainty_missing_critical_detail")
        .when(unsure & (kind != "possible_same_event") & (F.coalesce("_clues", F.lit(0)) > 0), "context_only_has_clues")
    )
    group = F.when(same, "same").when(possible, "plausible").when(unsure & (kind == "insufficient_context"), "context_only").when(unsure, "legacy").otherwise("different")
    out = j.withColumn("problem", problem).withColumn("group", F.when(F.col("problem").isNull(), group))
    return out.select(*judgments.columns, "problem", "group")


def decided(signals: DataFrame, checked_: DataFrame) -> DataFrame:
    """signal_id, action, event_id, confidence, category, problem and the candidates of each group.

    A judgment with a problem leaves its signal to technical review. Else one same event and nothing
    uncertain merges; same or uncertain ones go to review with the first of them; the others found an
    event. Context alone is kept and joins nothing."""
    ids = lambda g: F.transform(F.array_sort(F.collect_list(F.when(F.col("group") == g, F.struct("place", "candidate_id")))), lambda x: x["candidate_id"])
    n = lambda *gs: F.count_if(F.col("group").isin(*gs))
    first = lambda *gs: F.min_by("candidate_id", F.when(F.col("group").isin(*gs), F.struct("place", "candidate_id")))
    rows = checked_.groupBy("signal_id").agg(
        F.min_by("problem", F.when(F.col("problem").isNotNull(), F.struct("place", "candidate_id"))).alias("problem"), n("same").alias("_same"), n("plausible", "legacy").alias("_unsure"), n("legacy").alias("_legacy"),
        F.coalesce(first("same"), F.min_by("candidate_id", F.when(F.col("group").isin("plausible", "legacy"), F.struct(F.col("group") == "legacy", "place", "candidate_id")))).alias("_to"),
        *[ids(g).alias(g) for g in ("same", "plausible", "context_only", "legacy")],
    )
    out = signals.select("signal_id").join(rows, "signal_id", "left")
    broken, same, unsure = F.col("problem").isNotNull(), F.coalesce("_same", F.lit(0)), F.coalesce("_unsure", F.lit(0))
    merge, review = (same == 1) & (unsure == 0), (same > 0) | (unsure > 0)
    pick = lambda technical, merged, reviewed, founded: F.when(broken, technical).when(merge, merged).when(review, reviewed).otherwise(founded)
    category = F.when(broken, "technical_error").when(same > 1, "competing_matches").when(F.col("_legacy") > 0, "legacy_uncertainty").when(unsure > 0, "plausible_uncertainty").when(same == 1, "automatic_merge").otherwise("independent_topic")
    none = F.array().cast("array<string>")
    groups = [F.coalesce(g, none).alias(g) for g in ("same", "plausible", "context_only", "legacy")]
    return out.select("signal_id", pick(F.lit("candidate_review"), F.lit("merge"), F.lit("candidate_review"), F.lit("create")).alias("action"), F.when(~broken & review, F.col("_to")).alias("event_id"), pick(F.lit(0.0), F.lit(1.0), F.lit(0.6), F.lit(0.75)).alias("confidence"), category.alias("category"), "problem", *groups)
