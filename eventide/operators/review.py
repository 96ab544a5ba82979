"""Human review: the queue, exclusive claims, reuse and recovery."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TECHNICAL_ERRORS, TECHNICAL_REVIEWS
from ..functions import identity as I
from ..sources.shared import stored
from .match import pairs_within


def topic_identity(question: Column, hashtag: Column, url: Column, signal_id: Column, run_id: Column) -> Column:
    """What a review is about: question, topic title, official link, else the run's signal."""
    return F.coalesce(question, F.concat(F.lit("topic:"), F.nullif(F.trim(hashtag), F.lit(""))), F.concat(F.lit("url:"), I.url_key(I.without_tracking(url))), F.concat(F.lit("signal:"), run_id, F.lit(":"), signal_id))


def relation_key(identity: Column, candidate: Column, conflicts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.array_join(F.array_sort(identity), ","), F.coalesce(candidate, F.lit("")), F.array_join(F.array_sort(conflicts), ",")), 256)


def consolidate(tasks: DataFrame, hours: float = 24) -> DataFrame:
    """Pending tasks of one relation within ``hours`` of the group's first, as one: relation_key,
    n, first_at, last_at, evidence. Each group starts at the first task that the one before no
    longer reaches.

    A pause of over ``hours`` starts a group anyway, so tasks are cut there first; each stretch is
    read in order as a stream of sorted batches that carries one time, whatever its length."""
    w = Window.partitionBy("relation_key").orderBy("observed_at", "task_id")
    pause = F.coalesce((F.unix_micros("observed_at") - F.unix_micros(F.lag("observed_at").over(w))) / 3.6e9 > hours, F.lit(True))
    cut = tasks.select("relation_key", "observed_at", "task_id", "evidence").withColumn("_pause", pause).withColumn("_stretch", F.sum(F.col("_pause").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    span = int(hours * 3_600_000_000)
    times = cut.select("relation_key", "_stretch", F.unix_micros("observed_at").alias("_us")).distinct().repartition("relation_key", "_stretch").sortWithinPartitions("relation_key", "_stretch", "_us")

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first = None, 0
        for batch in batches:
            keys, at, out = list(zip(*[c.to_pylist() for c in batch.columns[:2]], strict=True)), batch.column(2).to_pylist(), []
            for key, t in zip(keys, at, strict=True):
                if key != now or t - first > span:
                    now, first = key, t
                out.append(first)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=["relation_key", "_stretch", "_us", "_start"])

    kind = tasks.schema["relation_key"].dataType.simpleString()
    groups = times.mapInArrow(starts, f"relation_key {kind}, _stretch bigint, _us bigint, _start bigint").drop("_stretch")
    flat = tasks.select("relation_key", "observed_at", "evidence", F.unix_micros("observed_at").alias("_us")).join(groups, ["relation_key", "_us"])
    n = flat.groupBy("relation_key", "_start").agg(F.count("*").alias("n"), F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"))
    kinds = flat.select("relation_key", "_start", F.explode("evidence").alias("e")).distinct().groupBy("relation_key", "_start").agg(F.array_sort(F.collect_list("e")).alias("evidence"))
    return n.join(kinds, ["relation_key", "_start"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(tasks.schema["evidence"].dataType))).drop("_start")


def exclusive_pairs(claims: DataFrame, task: str, key: str) -> DataFrame:
    """Pairs of tasks (a < b) that claim the same thing; frequent claims are cut into chunks."""
    return pairs_within(claims.select(F.col(task).alias("_task"), F.col(key).alias("_claim")), "_task", "_claim")


def exclusive_groups(claims: DataFrame, task: str, key: str) -> DataFrame:
    """key, n, first: claims of several tasks, with the smallest task; no pairs are made."""
    return claims.groupBy(key).agg(F.count_distinct(task).alias("n"), F.min(task).alias("first")).where("n > 1")


def owned_elsewhere(claims: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Claims on things that another event owns."""
    return claims.join(owners, key).where("event_id <> owner_event_id")


def batch_allowed(selected: DataFrame, claims: DataFrame, owners: DataFrame, task: str, key: str) -> bool:
    """All or nothing: no two tasks share a claim, none is owned by another event."""
    mine = claims.join(selected, task, "left_semi")
    return exclusive_groups(mine, task, key).isEmpty() and owned_elsewhere(mine, owners, key).isEmpty()


def reuse_decisions(tasks: DataFrame, decided: DataFrame, hours: float = 24) -> DataFrame:
    """Tasks with the latest earlier decision on their relation; a weak identity reuses it only
    within ``hours``."""
    j = tasks.join(decided.select("relation_key", F.col("decided_at"), F.col("decision")), "relation_key", "left")
    ok = (F.col("decided_at") <= F.col("observed_at")) & (~F.col("weak") | ((F.unix_micros("observed_at") - F.unix_micros("decided_at")) / 3.6e9 <= hours))
    return j.groupBy(*tasks.columns).agg(F.max_by(F.when(ok, F.col("decision")), F.when(ok, F.col("decided_at"))).alias("decision"))


def recovered(failures: DataFrame, successes: DataFrame) -> DataFrame:
    """Technical failures that a later success of the same subject retires."""
    last = successes.groupBy("subject").agg(F.max("at").alias("success_at"))
    return failures.join(last, "subject").where(F.col("success_at") >= F.col("at"))


def run_scope(runs: DataFrame, root: str, limit: int = 50) -> DataFrame:
    """A run and all runs that descend from it (parent_run_id, run_id). Each round doubles the
    generations that are known: a run's ancestor is the ancestor of its ancestor, and what is found
    is written, so that plans stay small and rounds grow with the log of the depth."""
    up = stored(runs.select("run_id", "parent_run_id", (F.col("run_id") == root).alias("in_scope")), "runs")
    for _ in range(limit):
        above = up.select(F.col("run_id").alias("_id"), F.col("parent_run_id").alias("_up"), F.col("in_scope").alias("_in"))
        now = stored(up.join(above, (F.col("parent_run_id") == F.col("_id")) & ~F.col("in_scope"), "left").select("run_id", F.when(F.col("_id").isNotNull(), F.col("_up")).alias("parent_run_id"), (F.col("in_scope") | F.coalesce("_in", F.lit(False))).alias("in_scope")), "runs")
        if now.where("not in_scope and parent_run_id is not null").isEmpty():
            return now.where("in_scope").select("run_id").distinct()
        up = now
    raise RuntimeError(f"runs nest deeper than 2 to the power {limit}, or in a circle")


def build_queue(candidates: DataFrame, pending: DataFrame, decided: DataFrame, hours: float = 24) -> DataFrame:
    """What new candidates for review become: relation_key, task_id, action, n, evidence, decision.

    ``candidates``: relation_key, task_id, observed_at, weak, evidence (an array); ``pending``: tasks that
    wait (relation_key, task_id, observed_at, evidence); ``decided``: relation_key, decided_at, decision.
    Candidates of one relation within ``hours`` are one. A decision that may be used again settles them
    (``reuse``); else they add their evidence to a pending task of the relation whose time is within
    ``hours`` (``update``, the latest one), or are a new task (``create``)."""
    one = candidates.groupBy("relation_key").agg(F.count("*").alias("n"), F.min("task_id").alias("task_id"), F.max("observed_at").alias("observed_at"), F.bool_or("weak").alias("weak"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence")))).alias("evidence"))
    known = reuse_decisions(one.drop("evidence", "n"), decided, hours).select("relation_key", "decision")
    waiting = pending.select("relation_key", F.col("task_id").alias("_old"), F.col("observed_at").alias("_at"), F.col("evidence").alias("_had"))
    near = F.abs(F.unix_micros("observed_at") - F.unix_micros("_at")) / 3.6e9 <= hours
    last = one.select("relation_key", "observed_at").join(waiting, "relation_key").where(near).groupBy("relation_key").agg(F.max_by(F.struct("_old", "_had"), F.struct("_at", "_old")).alias("_w"))
    j = one.join(known, "relation_key", "left").join(last, "relation_key", "left")
    action = F.when(F.col("decision").isNotNull(), "reuse").when(F.col("_w").isNotNull(), "update").otherwise("create")
    both = F.array_sort(F.array_union("evidence", F.coalesce("_w._had", F.array().cast(candidates.schema["evidence"].dataType))))
    return j.select("relation_key", F.coalesce("_w._old", "task_id").alias("task_id"), action.alias("action"), "n", both.alias("evidence"), "decision")


def queue(tasks: DataFrame, scope: DataFrame) -> DataFrame:
    """Pending tasks with a run in scope: a semi-join on the exploded run ids, counted by type."""
    hit = tasks.select("task_id", F.explode("run_ids").alias("run_id")).join(scope, "run_id", "left_semi").select("task_id").distinct()
    return tasks.join(hit, "task_id", "left_semi").groupBy("review_type").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "pending").alias("pending"))


def latest_decision(history: DataFrame) -> DataFrame:
    w = Window.partitionBy("task_id").orderBy(F.desc("decided_at"), F.desc("decision_id"))
    return history.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def technical_only(category: Column, flags: Column, semantic: Column | None = None, candidate: Column | None = None, past: Column | None = None) -> Column:
    """A review that only a technical fault made: its category says so, or, of a review without one, its
    ``semantic`` flags do and it has no ``candidate``; no flag is a conflict, and no category of its
    ``past`` says otherwise."""
    none = F.array().cast("array<string>")
    old = F.lit(False) if semantic is None else category.isNull() & (candidate.isNull() if candidate is not None else F.lit(True)) & F.arrays_overlap(F.coalesce(semantic, none), F.array(*map(F.lit, TECHNICAL_ERRORS)))
    before = F.lit(False) if past is None else F.exists(F.coalesce(past, none), lambda c: c.isNotNull() & ~c.isin(*TECHNICAL_REVIEWS))
    return (F.coalesce(category.isin(*TECHNICAL_REVIEWS), F.lit(False)) | F.coalesce(old, F.lit(False))) & ~F.exists(F.coalesce(flags, none), lambda f: F.contains(f, F.lit("conflict"))) & ~before


#: What else reviews and accepted results may say; null where a table doesn't.
_REVIEW_MORE = {"attempt": "bigint", "created_at": "timestamp", "candidate_event_id": "string", "semantic_flags": "array<string>", "past_categories": "array<string>", "platforms": "array<string>"}
_ACCEPTED_MORE = {"attempt": "bigint", "accepted_at": "timestamp", "by_human": "boolean"}


def recover(reviews: DataFrame, accepted: DataFrame, hours: float = 24, owners: DataFrame | None = None) -> DataFrame:
    """review_id, event_id, basis, success_at: pending technical reviews that a later accepted
    result of the same topic retires.

    ``reviews``: review_id, status, category, flags, item_ids, identity (arrays), first_failed_at,
    last_failed_at, and perhaps attempt, created_at, candidate_event_id, semantic_flags, past_categories
    and platforms; ``accepted``: event_id, event_signal_id, action, review_required, blocked,
    flags, item_ids, identity, observed_at, and perhaps attempt, accepted_at and by_human. Topics are the
    same if all items of the review are among the accepted ones, or if both have exactly the same
    identities and none is a mere signal. A topic of the microblog platform is recovered within
    ``hours`` only. A result of the very time of the failure counts if its attempt is the later one or,
    where one isn't known, if a person made it or it was accepted over a second after the review began.
    ``owners`` (item, event_id, one row an item): a review recovers only if all its items are there
    and belong to nobody or to the result's event. Reviews and results of one topic (one set of items
    or one whole identity) are read in the order of time, so a review sees the first result after it
    without pairs; a result joins each set of several items that it holds, found by its rarest item."""
    none = F.array().cast("array<string>")
    full = lambda df, more: df.withColumns({n: F.lit(None).cast(t) for n, t in more.items() if n not in df.columns})
    old = full(reviews, _REVIEW_MORE)
    old = old.where((F.col("status") == "pending") & technical_only(F.col("category"), F.col("flags"), F.col("semantic_flags"), F.col("candidate_event_id"), F.col("past_categories")))
    old = old.select("review_id", F.array_distinct("item_ids").alias("items"), F.array_sort(F.array_distinct(F.coalesce("identity", none))).alias("ident"), "first_failed_at", "last_failed_at", F.col("attempt").alias("old_attempt"), "created_at", F.coalesce("platforms", none).alias("platforms"))
    good = F.col("action").isin("create", "merge") & ~F.col("review_required") & ~F.col("blocked") & ~F.exists(F.coalesce("flags", none), lambda f: F.contains(f, F.lit("conflict")))
    told = ["observed_at", "attempt", "accepted_at", "by_human"]
    new = full(accepted, _ACCEPTED_MORE).where(good & F.col("observed_at").isNotNull()).select("event_id", "event_signal_id", F.array_distinct("item_ids").alias("items"), F.array_sort(F.array_distinct(F.coalesce("identity", none))).alias("ident"), *told)
    new = new.withColumn("by_human", F.coalesce("by_human", F.lit(False)))
    weak = F.exists("ident", lambda k: F.startswith(k, F.lit("weibo:"))) | F.array_contains("platforms", "weibo")
    old = old.where(F.col("review_id").isNotNull() & F.col("last_failed_at").isNotNull()).withColumn("_weak", F.coalesce(weak, F.lit(True)))
    old = old.where(~F.col("_weak") | F.col("first_failed_at").isNotNull()).withColumn("_since", F.when(F.col("_weak"), F.col("first_failed_at")))
    if owners is None:
        old = old.withColumn("_own", F.lit(None).cast(new.schema["event_id"].dataType))
    else:
        held = old.select("review_id", F.explode("items").alias("item")).join(owners.select("item", F.col("event_id").alias("_owner"), F.lit(True).alias("_there")), "item", "left")
        of = held.groupBy("review_id").agg(F.bool_and(F.coalesce("_there", F.lit(False))).alias("_all"), F.min("_owner").alias("_own"), F.max("_owner").alias("_last"))
        old = old.join(of, "review_id", "left").where(F.coalesce("_all", F.lit(True)) & (F.col("_own").isNull() | (F.col("_own") == F.col("_last"))))
    asks = lambda df, items, ident: df.select(F.lit(True).alias("_asks"), items.alias("_items"), ident.alias("_ident"), "_own", F.col("last_failed_at").alias("_t"), F.col("old_attempt").alias("attempt"), (F.col("created_at") + F.expr("interval 1 second")).alias("_at"), F.lit(None).cast("boolean").alias("by_human"), "review_id", "_since")
    tells = lambda df, items, ident: df.select(F.lit(False).alias("_asks"), items.alias("_items"), ident.alias("_ident"), F.col("event_id").alias("_own"), F.col("observed_at").alias("_t"), "attempt", F.col("accepted_at").alias("_at"), "by_human")
    strong = (F.size("ident") > 0) & ~F.exists("ident", lambda k: F.startswith(k, F.lit("signal:")))
    no_items, each, several = F.lit(None).cast(old.schema["items"].dataType), F.explode("items").alias("item"), old.where("size(items) > 1").select(F.array_sort("items").alias("_items"))
    rows = asks(old.where(strong), no_items, F.col("ident")).unionByName(asks(old.where((F.size("items") > 0) & ~F.exists("items", F.isnull)), F.array_sort("items"), F.lit(None).cast("array<string>")))
    told = [tells(new.where(strong), no_items, F.col("ident")), tells(new.select("*", each).where("item is not null"), F.array("item"), F.lit(None).cast("array<string>"))]
    if not several.isEmpty():
        in_sets = several.distinct().select("_items", F.explode("_items").alias("item"))
        often = new.select(each).groupBy("item").agg(F.count("*").alias("_n"))
        rarest = in_sets.join(often, "item").groupBy("_items").agg(F.count("*").alias("_known"), F.min_by("item", F.struct("_n", "item")).alias("item")).where(F.col("_known") == F.size("_items"))
        holds = new.select("*", each).join(rarest, "item").where(F.size(F.array_except("_items", "items")) == 0)
        told.append(tells(holds, F.col("_items"), F.lit(None).cast("array<string>")))
    for part in told:
        rows = rows.unionByName(part, allowMissingColumns=True)
    # A result counts for reviews that nobody owns and for those of its own event.
    rows = rows.repartition("_items", "_ident").withColumn("event_id", F.when(~F.col("_asks"), F.col("_own")))
    if owners is not None:
        nobody = F.lit(None).cast(rows.schema["_own"].dataType)
        rows = rows.withColumn("_own", F.explode(F.when(F.col("_asks") | F.col("event_id").isNull(), F.array("_own")).otherwise(F.array(nobody, F.col("_own")))))
    else:
        rows = rows.withColumn("_own", F.lit(None))
    topic, first, so_far = ["_items", "_ident", "_own"], F.desc("_asks"), (Window.unboundedPreceding, Window.currentRow)
    hit = F.when(~F.col("_asks"), F.struct(F.col("_t").alias("observed_at"), "event_id"))
    later = F.min(hit).over(Window.partitionBy(*topic).orderBy(F.desc("_t"), first).rowsBetween(*so_far))
    # Of the very time: results of a later attempt; those of an unknown one that a person made or that waited.
    known, now = F.col("attempt").isNotNull(), Window.partitionBy(*topic, "_t")
    next_ = F.min(F.when(known, hit)).over(now.orderBy(F.desc_nulls_last("attempt"), first).rowsBetween(*so_far))
    order = F.when(F.col("by_human"), 2).when(F.col("_asks") & F.col("_at").isNull(), 1).otherwise(0)
    waited = F.when(F.col("by_human") | F.col("_at").isNotNull(), hit)
    waits = now.orderBy(F.desc(order), F.desc_nulls_last("_at"), first).rowsBetween(*so_far)
    tie = F.when(known, F.least("_next", "_waited_unknown")).otherwise(F.col("_waited"))
    rows = rows.withColumn("_later", later).withColumn("_next", next_).withColumns({"_waited": F.min(waited).over(waits), "_waited_unknown": F.min(F.when(~known, waited)).over(waits)})
    found = rows.where("_asks").select("review_id", "_since", F.coalesce(tie, F.col("_later")).alias("_x"), F.when(F.col("_items").isNotNull(), "items").otherwise("topic").alias("basis")).where("_x is not null")
    late = (F.unix_micros("_x.observed_at") - F.unix_micros("_since")) / 3.6e9
    ok = found.where(F.col("_since").isNull() | (late <= hours))  # a later result would be later still
    return ok.groupBy("review_id").agg(F.min(F.struct("_x.observed_at", "_x.event_id", "basis")).alias("x")).select("review_id", "x.event_id", "x.basis", F.col("x.observed_at").alias("success_at"))


def merge_evidence(rows: DataFrame, key: str, order: str, ids: dict[str, str | None], objects: tuple[str, ...] = ()) -> DataFrame:
    """Evidence of one key folded in the order of its rows: key, a list for each of ``ids`` and of
    ``objects``, and rows (how many).

    ``ids``: array columns of ids, each perhaps with a column of one id more, whose values follow the
    row's list; once each, in the order they come. ``objects``: array columns of JSON texts; objects that
    agree but for the order of keys are one, shown in its canonical form. Nulls, and texts that aren't
    JSON, are left out. Values meet one by one, so that a key's rows are never gathered."""
    named = []
    for name, single in ids.items():
        own = F.coalesce(F.col(name).cast("array<string>"), F.array().cast("array<string>"))
        named.append((name, F.concat(own, F.array(F.col(single).cast("string"))) if single else own))
    for name in objects:
        named.append((name, F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), I.canonical_json)))
    lists = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("values")) for n, v in named])).alias("x")
    flat = rows.select(key, F.col(order).alias("_at"), lists).select(key, "_at", "x.name", F.posexplode("x.values").alias("_pos", "value")).where("value is not null")
    first = flat.groupBy(key, "name", "value").agg(F.min(F.struct("_at", "_pos")).alias("at"))
    inside = lambda n: F.transform(F.array_sort(F.filter(F.collect_list(F.when(F.col("name") == n, F.struct("at", "value"))), lambda v: v.isNotNull())), lambda v: v["value"]).alias(n)
    merged = first.groupBy(key).agg(*[inside(n) for n, _ in named])
    total = rows.groupBy(key).agg(F.count("*").alias("rows"))
    none = {n: F.coalesce(n, F.array().cast("array<string>")) for n, _ in named}
    return total.join(merged, key, "left").withColumns(none).select(key, *[n for n, _ in named], "rows")
