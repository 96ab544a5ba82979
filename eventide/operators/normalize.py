"""Raw items to normalised items, source signals and event signals: narrow steps only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import NOISE_FLAGS, Dictionaries
from ..functions import identity as I
from ..functions import numbers as N
from ..functions import text as X
from ..functions.settle import let

GOOD = ("topic_discovery", "search_enrichment", "official_evidence")


def quality_flags(columns: dict[str, Column], published_raw: Column | None = None, published: Column | None = None) -> Column:
    """missing_<name> for each value that is null or blank; invalid_published_at."""
    flags = [F.when(c.isNull() | (F.trim(c.cast("string")) == ""), f"missing_{n}") for n, c in columns.items()]
    if published_raw is not None:
        flags.append(F.when((F.trim(published_raw) != "") & published.isNull(), "invalid_published_at"))
    return F.array_distinct(F.array_compact(F.array(*flags)))


def match_text(title: Column, summary: Column, topics: Column, body: Column, published: Column) -> Column:
    """One line of all that identifies an item."""
    parts = F.concat_ws(" ", title, summary, F.array_join(topics, " "), F.substring(body, 1, 500), F.date_format(published, "yyyy-MM-dd"))
    return F.trim(F.regexp_replace(parts, r"(?U)\s+", " "))


def normalize_items(raw: DataFrame) -> DataFrame:
    """Columns source_id, title, url, summary, content, topics, external_id, published_raw and
    fetched_at of raw items, cleaned, flagged and hashed."""
    c = raw.withColumns({
        "title": X.clean_title(F.coalesce("title", F.lit(""))),
        "summary": X.clean_body(F.coalesce("summary", F.lit(""))),
        "content_text": X.clean_body(F.coalesce("content", F.lit(""))),
        "url": F.trim(F.coalesce("url", F.lit(""))),
        "published_at": N.parse_time(F.col("published_raw")),
        "topics": F.array_distinct(F.filter(F.coalesce("topics", X.empty()), lambda t: F.trim(t) != "")),
    })
    flags = quality_flags({n: F.col(n) for n in ("title", "url", "summary", "content_text")} | {"published_at": F.col("published_raw"), "fetched_at": F.col("fetched_at")}, F.col("published_raw"), F.col("published_at"))
    return c.withColumns({
        "quality_flags": flags,
        "content_hash": I.item_hash(F.col("source_id"), F.col("external_id"), F.col("url"), F.col("title"), F.col("published_at"), F.col("fetched_at")),
        "canonical_id": I.canonical_id(F.col("url")),
        "event_text_for_match": match_text(F.col("title"), F.col("summary"), F.col("topics"), F.col("content_text"), F.col("published_at")),
        "event_text_for_embedding": X.strip_question(F.concat_ws(" ", "title", "summary")),
    })


#: Keys under which an item, its normalised form or its payload may name topics, in order.
TOPIC_KEYS = ("topic", "topics", "topic_words", "hashtags", "query", "keyword", "keywords")


def topics_of(*containers: Column) -> Column:
    """The topics that JSON containers name under ``TOPIC_KEYS``, single or in a list, without hash
    signs and blanks at their ends, once each."""
    def named(json: Column, key: str) -> Column:
        value = F.get_json_object(json, f"$.{key}")
        listed = F.from_json(F.when(value.startswith("["), value), "array<string>")
        return F.coalesce(listed, F.when(F.coalesce(value, F.lit("")) != "", F.array(value)), X.empty())

    every = F.concat(*[named(json, key) for json in containers for key in TOPIC_KEYS])
    return F.array_distinct(F.filter(F.transform(every, lambda t: F.trim(t, F.lit("# "))), lambda t: F.coalesce(t, F.lit("")) != ""))


def match_documents(events: DataFrame) -> DataFrame:
    """event_id, title, summary, entities, action_terms, keywords, event_time, urls, canonical_ids: what
    of an event takes part in matching.

    ``events`` has event_id, title, summary, primary_entity, entities, action_terms, keywords, event_time,
    urls, canonical_ids and ``features``, a struct of entities, action_terms and event_time, or null. A
    nested feature that is there counts even if it is empty; only if it is missing do the event's own
    columns, and last its primary entity, stand in."""
    none = X.empty()
    nested = lambda n: F.col(f"features.{n}")
    legacy = F.coalesce("entities", none)
    entities = F.when(nested("entities").isNotNull(), nested("entities")).when(F.size(legacy) > 0, legacy).when(F.coalesce("primary_entity", F.lit("")) != "", F.array("primary_entity")).otherwise(none)
    urls = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("urls", none))))
    canonical = F.array_compact(F.transform(urls, I.canonical_id))
    return events.select(
        "event_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"), entities.alias("entities"), F.coalesce(nested("action_terms"), "action_terms", none).alias("action_terms"),
        F.coalesce("keywords", none).alias("keywords"), F.coalesce(nested("event_time"), "event_time").alias("event_time"), urls.alias("urls"), F.array_sort(F.array_union(canonical, F.coalesce("canonical_ids", none))).alias("canonical_ids"),
    )


def split_valid(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all checks, and the others with the names of those they fail."""
    errors = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in checks.items()]))
    marked = df.withColumn("errors", errors)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def source_signals(items: DataFrame) -> DataFrame:
    """item to signal: its id, and whether it may support an event."""
    audit = F.coalesce(F.col("relation_decision") == "audit_only", F.lit(False)) | F.array_contains("quality_flags", "audit_only")
    return items.withColumns({
        "source_signal_id": I.signal_id(F.col("source_id"), F.col("item_id")),
        "audit_only": audit,
        "contributes": ~audit & (F.coalesce(F.col("relation_decision"), F.lit("accepted")) == "accepted"),
    })


def signal_confidence(title: Column, entities: Column, actions: Column, has_time: Column, used: Column, doubted: Column, generic: Column) -> Column:
    """Additive confidence of an extracted signal, within 0 and 1."""
    one = lambda c, w: F.when(c, w).otherwise(0.0)
    n = F.length(X.normalize_space(title))
    score = 0.35 + one(n >= 8, 0.20) + one(F.size(entities) > 0, 0.15) + one(F.size(actions) > 0, 0.15) + one(has_time, 0.10) + one(used, 0.10) - one(doubted, 0.15) - one((n < 6) | generic, 0.10)
    return F.round(N.clip(score), 4)


def extract_signals(signals: DataFrame, run_id: str, words: Dictionaries = Dictionaries()) -> DataFrame:  # noqa: B008
    """Event signals of source signals that may contribute and have a title: entities, actions,
    keywords, type, weakness and confidence."""
    text = F.concat_ws(" ", "title", "summary")
    s = signals.where("not audit_only and contributes").where(F.trim("title") != "")
    s = s.withColumns({
        "entities": F.slice(X.entities(text, words.markers), 1, 8),
        "action_terms": F.slice(X.actions(text, words.actions), 1, 6),
        "keywords": X.keywords(text, words.generic, words.actions),
        "event_type": X.event_type(text, words.event_types),
    })
    constraints = F.size("entities") + F.size("action_terms") + (F.size("keywords") >= 3).cast("int") + F.col("published_at").isNotNull().cast("int")
    n = F.length(X.normalize_space(F.col("title")))
    weak = (
        F.when((F.col("signal_role") == "topic_discovery") & (F.size("entities") == 0) & (F.size("action_terms") == 0), "discovery_without_entity_or_action")
        .when(F.col("title").rlike(r"^#[^#\s]+#?$") | (((n < 6) | (F.size("keywords") < 3)) & (constraints < 2)), "too_few_constraints")
        .when((F.coalesce("channel", F.lit("")) == "video_hot_list") & (constraints < 2), "video_topic")
    )
    generic = F.col("title").rlike("|".join(words.generic)) if words.generic else F.lit(False)
    doubted = F.exists("quality_flags", lambda f: f.isin("low_related", "audit_only"))
    return s.withColumns({
        "event_signal_id": I.event_signal_id(F.lit(run_id), F.col("source_signal_id")),
        "weak_signal_reason": weak,
        "is_weak_signal": weak.isNotNull(),
        "confidence": signal_confidence(F.col("title"), F.col("entities"), F.col("action_terms"), F.col("published_at").isNotNull(), F.col("source_status") == "use", doubted, generic),
    })


def combined_text(title: Column, *others: Column) -> Column:
    """All texts of an item that aren't empty, in one line."""
    return F.array_join(F.filter(F.array(title, *others), lambda x: F.coalesce(x, F.lit("")) != ""), " ")


def question_id(url: Column) -> Column:
    """The question a link leads to, from its path or its query."""
    path = F.regexp_extract(F.regexp_extract(url, r"^([^?#]*)", 1), r"/question/(\d+)", 1)
    query = F.regexp_extract(url, r"[?&](?:question_id|question)=([^&#]+)", 1)
    return F.coalesce(F.nullif(path, F.lit("")), F.nullif(query, F.lit("")))


def search_relevance(parent_title: Column, parent_text: Column, title: Column, text: Column, flags: Column, parent_url: Column, url: Column, noise: tuple[str, ...] = NOISE_FLAGS, high: float = 0.45) -> Column:
    """Whether a search result belongs to the topic that was searched: (decision, confidence,
    audit_only). ``*_text``: the ``combined_text`` of each side.

    A noise flag rejects. The same question, a title that stands in the other side's text, or
    enough of the parent's terms accept. Everything else stays for the audit and supports nothing."""
    a, b, whole_a, whole_b = (X.normalize_space(c) for c in (parent_title, title, parent_text, text))
    noisy = F.exists(flags, lambda f: f.isin(*noise) | F.endswith(f, F.lit("_conflict")))
    same = F.coalesce(question_id(parent_url) == question_id(url), F.lit(False))
    inside = F.coalesce(((F.length(a) >= 4) & F.contains(whole_b, a)) | ((F.length(b) >= 4) & F.contains(whole_a, b)), F.lit(False))
    terms = lambda c: F.array_distinct(F.concat(X.ngrams(c, 2, 4), F.filter(F.split(c, r"(?U)[\s\W_]+"), lambda w: F.length(w) >= 2)))
    o = F.coalesce(X.containment(terms(a), terms(whole_b)), F.lit(0.0))
    confidence = F.when(noisy, 0.0).when(same, 0.95).when(inside, 0.88).when(o >= high, F.least(F.lit(0.8), 0.45 + o)).when(o >= 0.25, F.least(F.lit(0.55), 0.2 + o)).otherwise(0.1)
    decision = F.when(noisy, "rejected").when(same | inside | (o >= high), "accepted").otherwise("audit_only")
    return F.struct(decision.alias("decision"), F.round(confidence, 4).alias("confidence"), (decision != "accepted").alias("audit_only"))


def body_relevance(topic: Column, body: Column, rerank: Column) -> Column:
    """Conflicts, then length, then the reranker's bands decide about a sample's text."""
    clean = X.strip_emoji(X.clean_body(body))
    clash = let(lambda v: F.size(X.conflicts(v["a"], v["b"])) > 0, a=X.facts(topic), b=X.facts(clean))
    return F.when(clash, "rejected").when(F.length(clean) < 8, "rejected").when(rerank.isNull(), "audit_only").when(rerank >= 0.80, "accepted").when(rerank < 0.10, "rejected").otherwise("audit_only")


def hot_list_topic(title: Column, platforms: Column, roles: Column, statuses: Column, generic: tuple[str, ...]) -> Column:
    """Whether a hot-list topic may found an event although its signal is weak."""
    key = X.normalize_words(title)
    return (F.length(key) >= 1) & ~key.isin(*generic) & F.arrays_overlap(platforms, F.array(F.lit("zhihu"), F.lit("weibo"))) & F.array_contains(roles, "topic_discovery") & F.arrays_overlap(statuses, F.array(F.lit("use"), F.lit("fallback")))


def excerpts(bodies: Column, limit: int = 3) -> Column:
    """The first distinct accepted texts (text, url, accepted) with a link and 12 word characters."""
    good = F.filter(bodies, lambda b: b["accepted"] & I.safe_url(b["url"]) & (F.length(F.regexp_replace(b["text"], r"(?U)\W+", "")) >= 12))
    keyed = F.transform(good, lambda b: F.struct(F.regexp_replace(b["text"], r"(?U)\W+", "").alias("k"), F.substring(X.strip_emoji(b["text"]), 1, 360).alias("text"), b["url"].alias("url")))
    first = F.filter(keyed, lambda b, i: F.array_position(F.transform(keyed, lambda x: x["k"]), b["k"]) == i + 1)
    return F.slice(F.transform(first, lambda b: F.struct(b["text"], b["url"])), 1, limit)
