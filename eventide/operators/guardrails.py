"""Guardrails: named rules, their long form, and what follows from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FACT_TERMS, PUBLIC_HEAT_TERMS, MatchConfig

SEVERITY = {"pass": 0, "warn": 1, "block": 2}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    violated: Callable[[], Column]


class Registry:
    """Rules by id; a rule's predicate is a column over the checked table."""

    def __init__(self, rules: tuple[Rule, ...] = ()):
        self.rules: dict[str, Rule] = {}
        for r in rules:
            self.register(r)

    def register(self, rule: Rule) -> None:
        if rule.rule_id in self.rules:
            raise ValueError(f"rule {rule.rule_id} is there already")
        self.rules[rule.rule_id] = rule

    def check(self, df: DataFrame, subject: str) -> DataFrame:
        """subject, rule_id, status: one row a subject and rule, without a shuffle."""
        results = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.when(F.coalesce(r.violated(), F.lit(False)), r.severity).otherwise("pass").alias("status")) for r in self.rules.values()])
        return df.select(F.col(subject), F.explode(results).alias("r")).select(subject, "r.rule_id", "r.status")


def roll_up(checks: DataFrame, subject: str) -> DataFrame:
    """The most severe status of each subject."""
    n = F.max(F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))])[F.col("status")])
    return checks.groupBy(subject).agg(n.alias("_n")).select(subject, F.when(F.col("_n") == 2, "block").when(F.col("_n") == 1, "warn").otherwise("pass").alias("status"))


def merge_rules(cfg: MatchConfig = MatchConfig()) -> Registry:  # noqa: B008
    c = F.col
    merge = c("decision") == "merge"
    alone = (F.coalesce("embedding", F.lit(0.0)) >= cfg.embedding_candidate) & ~c("hard") & ~c("containment") & (c("entity") == 0)
    return Registry((
        Rule("low_confidence", "warn", lambda: merge & (c("confidence") < cfg.auto_merge)),
        Rule("entity_conflict", "block", lambda: merge & c("entity_conflict")),
        Rule("time_conflict", "block", lambda: merge & c("time_conflict")),
        Rule("embedding_conflict", "block", lambda: merge & (F.coalesce("embedding", F.lit(0.0)) >= cfg.embedding_auto) & (c("entity_conflict") | c("time_conflict"))),
        Rule("embedding_only", "warn", lambda: merge & alone),
        Rule("weak_signal_only", "warn", lambda: merge & F.coalesce("a_weak", F.lit(False)) & ~c("hard") & (c("entity") == 0)),
    ))


def finalize(decision: Column, status: Column) -> Column:
    """A block rejects; a warned merge is reviewed."""
    return F.when(status == "block", "reject").when((status == "warn") & (decision == "merge"), "candidate_review").otherwise(decision)


def card_rules() -> Registry:
    """Rules for briefing cards: category, text, n_citations, n_urls, n_community_sources, audit_only."""
    c = F.col
    says = lambda terms: F.coalesce(c("text").rlike("|".join(terms)), F.lit(False))
    return Registry((
        Rule("card_without_citation", "block", lambda: c("n_citations") == 0),
        Rule("card_without_url", "block", lambda: c("n_urls") == 0),
        Rule("community_claims_fact", "warn", lambda: F.substring("category", 1, 1).isin("C", "E") & says(FACT_TERMS)),
        Rule("official_only_claims_public_heat", "block", lambda: c("category").startswith("F_") & says(PUBLIC_HEAT_TERMS)),
        Rule("audit_only_support", "block", lambda: c("audit_only")),
        Rule("single_source_claims_fact", "block", lambda: (c("n_community_sources") == 1) & c("category").startswith("E_") & says(FACT_TERMS)),
    ))


def transitions(moves: DataFrame, allowed: DataFrame) -> DataFrame:
    """Moves (old, new) that a state machine's table doesn't allow."""
    return moves.join(allowed, ["old", "new"], "left_anti")


def untraceable(signals: DataFrame, sources: DataFrame) -> DataFrame:
    """Signals with an id that no citable source has."""
    ids = signals.select("signal_id", F.explode("source_signal_ids").alias("source_signal_id"))
    good = sources.where("not audit_only and item_id is not null").select("source_signal_id")
    return ids.join(good, "source_signal_id", "left_anti").select("signal_id").distinct()
