"""More queries of the event engine: its rules over columns, each with the same in DuckDB's SQL.

What a row states is built from its key, so that every branch of a rule is met on whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import config as C
from .functions import identity as I
from .functions import numbers as N
from .functions import text as X
from .functions.settle import settled
from .operators import filters, guardrails, heat, match, normalize, observe, official, review, trend
from .plans import window_report
from .queries import _BM25, END, OBS, START, _t, _utc, observations, query
from .streaming import rounds


def _pick(k, *values):
    return F.element_at(F.array(*map(F.lit, values)), (1 + k % len(values)).cast("int"))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_PARTS = ("2026年9月1日", "2026-09-01", "2026/9/2", "2026年13月1日", "")
_OBJECTS = ("江城市东门大桥", "东门大桥", "江城市西门大桥", "")
_MODELS = ("K-9", "k9", "xK9", "K8", "某K9B型")
_ACTS = ("发布召回通知", "亮相", "取消", "新增", "")


@query(f"""WITH t AS (SELECT o_orderkey AS id, o_orderkey AS a, o_orderkey // 5 + o_custkey AS b FROM orders),
p AS (SELECT id, {_list(_PARTS)}[1 + a % 5] AS da, {_list(_PARTS)}[1 + b % 5] AS db, {_list(_OBJECTS)}[1 + a % 4] AS oa, {_list(_OBJECTS)}[1 + b % 4] AS ob, {_list(_MODELS)}[1 + a % 5] AS ma, {_list(_MODELS)}[1 + b % 5] AS mb,
             {_list(_ACTS)}[1 + a % 5] AS aa, {_list(_ACTS)}[1 + b % 5] AS ab FROM t),
f AS (SELECT id, [CASE d WHEN '2026年9月1日' THEN '1' WHEN '2026-09-01' THEN '1' WHEN '2026/9/2' THEN '2' END for d in [da, db]] AS d, [CASE WHEN o LIKE '%东%' THEN 'e' WHEN o LIKE '%西%' THEN 'w' END for o in [oa, ob]] AS o,
             [CASE m WHEN 'K-9' THEN 'k9' WHEN 'k9' THEN 'k9' WHEN 'xK9' THEN 'xk9' WHEN 'K8' THEN 'k8' ELSE 'k9b' END for m in [ma, mb]] AS m, [CASE x WHEN '发布召回通知' THEN 'recall' WHEN '亮相' THEN 'release' WHEN '取消' THEN 'cancel' WHEN '新增' THEN 'add' END for x in [aa, ab]] AS x FROM p)
SELECT id, coalesce(d[1] <> d[2], false) AS date_conflict, coalesce(o[1] <> o[2], false) AS object_conflict, coalesce(m[1] <> m[2], false) AS model_conflict, coalesce(x[1] <> x[2], false) AS action_conflict FROM f""")
def title_conflicts(spark, d):
    k, b = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 5) + F.col("o_custkey")
    title = lambda n: F.concat_ws("，", _pick(n, *_OBJECTS), _pick(n, *_PARTS), F.concat(F.lit("型号 "), _pick(n, *_MODELS), F.lit(" ")), _pick(n, *_ACTS))
    c = settled(_t(spark, d, "orders").select(k.alias("id"), title(k).alias("a"), title(b).alias("b")), fa=X.facts(F.col("a")), fb=X.facts(F.col("b")))
    c = c.withColumn("c", X.conflicts(F.col("fa"), F.col("fb")))
    return c.select("id", *[F.array_contains("c", f"{n}_conflict").alias(f"{name}_conflict") for n, name in (("explicit_date", "date"), ("named_object", "object"), ("model", "model"), ("action", "action"))])


_TERMS = "list_distinct(list_concat(list_filter(regexp_split_to_array({0}, '[\\s\\W_]+'), lambda w: length(w) >= 2), " + ", ".join(f"CASE WHEN length({{0}}) >= {n} THEN [substr({{0}}, i, {n}) for i in range(1, length({{0}}) - {n - 2})] ELSE [] END" for n in (2, 3, 4)) + "))"


@query(rf"""WITH r AS (SELECT o_orderkey AS id, o_orderpriority || ' ' || (o_orderkey % 9) AS pt, 'about ' || o_orderstatus || ' ' || o_orderkey % 100 AS ps, ['1-URGENT', '2-HIGH x', 'Not Spec', 'z', 'medium 3'][1 + o_custkey % 5] || ' ' || (o_custkey % 9) AS et,
    CASE WHEN o_custkey % 3 = 0 THEN 'it says ' || o_orderpriority || '  ' || (o_orderkey % 9) ELSE 'about ' || (o_custkey % 100) END AS es, o_custkey % 11 = 0 OR o_custkey % 13 = 0 AS noisy, o_orderkey % 7 = o_custkey % 29 AS same FROM orders),
n AS (SELECT *, lower(regexp_replace(pt, '\s+', '', 'g')) AS a, lower(regexp_replace(et, '\s+', '', 'g')) AS b, lower(regexp_replace(pt || ' ' || ps, '\s+', '', 'g')) AS wa, lower(regexp_replace(et || ' ' || es, '\s+', '', 'g')) AS wb FROM r),
o AS (SELECT *, (length(a) >= 4 AND contains(wb, a)) OR (length(b) >= 4 AND contains(wa, b)) AS inside, {_TERMS.format('a')} AS ta, {_TERMS.format('wb')} AS tb FROM n),
v AS (SELECT *, len(list_intersect(ta, tb)) / len(ta)::DOUBLE AS o FROM o)
SELECT id, CASE WHEN noisy THEN 'rejected' WHEN same OR inside OR o >= 0.45 THEN 'accepted' ELSE 'audit_only' END AS decision,
 round(CASE WHEN noisy THEN 0 WHEN same THEN 0.95 WHEN inside THEN 0.88 WHEN o >= 0.45 THEN least(0.8, 0.45 + o) WHEN o >= 0.25 THEN least(0.55, 0.2 + o) ELSE 0.1 END, 4)::DOUBLE AS confidence FROM v""")
def search_relevance(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda x: x.cast("string")
    rows = _t(spark, d, "orders").select(
        k.alias("id"), F.concat_ws(" ", "o_orderpriority", text(k % 9)).alias("pt"), F.concat_ws(" ", F.lit("about"), "o_orderstatus", text(k % 100)).alias("ps"), F.concat_ws(" ", _pick(c, "1-URGENT", "2-HIGH x", "Not Spec", "z", "medium 3"), text(c % 9)).alias("et"),
        F.when(c % 3 == 0, F.concat(F.lit("it says "), F.col("o_orderpriority"), F.lit("  "), text(k % 9))).otherwise(F.concat(F.lit("about "), text(c % 100))).alias("es"), F.array(F.when(c % 11 == 0, "marketing_spam").when(c % 13 == 0, "place_conflict").otherwise("x")).alias("flags"),
        F.concat(F.lit("https://www.zhihu.com/question/"), text(k % 7)).alias("pu"), F.concat(F.lit("https://www.zhihu.com/search?question_id="), text(c % 29)).alias("eu"),
    )
    r = normalize.search_relevance(F.col("pt"), normalize.combined_text(F.col("pt"), F.col("ps")), F.col("et"), normalize.combined_text(F.col("et"), F.col("es")), F.col("flags"), F.col("pu"), F.col("eu"))
    return rows.select("id", r.alias("r")).select("id", "r.decision", "r.confidence")


@query(f"""WITH {OBS} SELECT observation_id FROM obs WHERE (rank IS NOT NULL AND (platform <> 'zhihu' OR NOT coalesce(present, false))) OR (present = false AND NOT (collection_status = 'succeeded' AND list_complete))""")
def presence_integrity(spark, d):
    return observe.integrity(observations(spark, d)).select("observation_id")


@query("""WITH p AS (SELECT o_orderkey AS id, ['merge', 'candidate_review', 'create'][1 + o_orderkey % 3] AS decision, (o_orderkey % 100) / 100.0::DOUBLE AS confidence, o_custkey % 17 = 0 AS ec, o_custkey % 19 = 0 AS tc, CASE WHEN o_custkey % 4 > 0 THEN (o_custkey % 50) / 50.0::DOUBLE END AS e,
    o_custkey % 5 = 0 AS hard, o_custkey % 7 = 0 AS cont, (o_custkey % 3) / 2.0::DOUBLE AS ent, o_orderkey % 6 = 0 AS weak FROM orders),
s AS (SELECT *, CASE WHEN decision <> 'merge' THEN 0 WHEN ec OR tc THEN 2 WHEN confidence < 0.85 OR (coalesce(e, 0) >= 0.78 AND NOT hard AND NOT cont AND ent = 0) OR (weak AND NOT hard AND ent = 0) THEN 1 ELSE 0 END AS n FROM p)
SELECT id, ['pass', 'warn', 'block'][1 + n] AS status, CASE WHEN n = 2 THEN 'reject' WHEN n = 1 AND decision = 'merge' THEN 'candidate_review' ELSE decision END AS decision FROM s""")
def guarded_merges(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    p = _t(spark, d, "orders").select(k.alias("id"), _pick(k, "merge", "candidate_review", "create").alias("decision"), ((k % 100) / 100).alias("confidence"), (c % 17 == 0).alias("entity_conflict"), (c % 19 == 0).alias("time_conflict"), F.when(c % 4 > 0, (c % 50) / 50).alias("embedding"), (c % 5 == 0).alias("hard"), (c % 7 == 0).alias("containment"), ((c % 3) / 2).alias("entity"), (k % 6 == 0).alias("a_weak"))
    s = guardrails.roll_up(guardrails.merge_rules().check(p, "id"), "id")
    return p.join(s, "id").select("id", "status", guardrails.finalize(F.col("decision"), F.col("status")).alias("decision"))


@query("""SELECT event_id, coalesce(date_diff('microsecond', ts, TIMESTAMP '2024-01-20') / 3.6e9 > 72, false) AS polluted FROM events""")
def polluted_samples(spark, d):
    return _t(spark, d, "events").select("event_id", filters.polluted(_utc("ts"), F.lit(END)).alias("polluted"))


@query("""SELECT o_orderkey AS id, o_orderkey % 4 > 0 AND o_custkey % 3 > 0 AND o_custkey % 5 > 0 AND o_orderkey % 7 < 5 AS founds FROM orders""")
def hot_list_topics(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    title = F.when(k % 4 == 0, _pick(c, "热搜", " # ")).otherwise(F.concat(F.lit("话题"), k.cast("string")))
    got = normalize.hot_list_topic(title, F.array(F.when(c % 3 == 0, "official").otherwise("weibo")), F.array(F.when(c % 5 == 0, "search_enrichment").otherwise("topic_discovery")), F.array(F.when(k % 7 < 3, "use").when(k % 7 < 5, "fallback").otherwise("unavailable")), C.GENERIC_TOPICS)
    return _t(spark, d, "orders").select(k.alias("id"), got.alias("founds"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE CAST(epoch(o_orderdate) AS BIGINT) - CASE WHEN o_orderkey % 5 = 1 THEN 28800 ELSE 0 END END AS published,
    CASE o_orderkey % 3 WHEN 0 THEN CAST(epoch(o_orderdate) AS BIGINT) - 28800 ELSE CAST(epoch(o_orderdate) AS BIGINT) END AS shown FROM orders""")
def parsed_times(spark, d):
    k, t = F.col("o_orderkey"), _utc("o_orderdate")
    iso = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(k % 5 == 0, F.concat(iso, F.lit("Z"))).when(k % 5 == 1, F.concat(iso, F.lit("+08:00"))).when(k % 5 == 2, F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(k % 5 == 3, iso).otherwise("not a time")
    shown = F.when(k % 3 == 0, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(k % 3 == 1, (F.unix_seconds(t) * 1000).cast("string")).otherwise(F.unix_seconds(t).cast("string"))
    return _t(spark, d, "orders").select(k.alias("id"), F.unix_seconds(N.parse_time(raw)).alias("published"), F.unix_seconds(N.parse_publication(shown)).alias("shown"))


_SAY = ("某公司", "一学院", "警方", "本市", "")


@query(f"""WITH t AS (SELECT o_orderkey AS id, {_list(_SAY)}[1 + o_orderkey % 5] || {_list(C.ACTIONS)}[1 + o_custkey % {len(C.ACTIONS)}] || {_list(C.ACTIONS)}[1 + o_orderkey % 7] || '了' AS t FROM orders)
SELECT id, array_to_string(list_filter({_list(C.ACTIONS)}, lambda a: contains(t, a)), ',') AS actions, CASE {' '.join(f"WHEN regexp_matches(t, '{'|'.join(words)}') THEN '{name}'" for name, words in C.EVENT_TYPES)} ELSE 'unknown' END AS event_type FROM t""")
def actions_and_types(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = _t(spark, d, "orders").select(k.alias("id"), F.concat(_pick(k, *_SAY), _pick(c, *C.ACTIONS), _pick(k, *C.ACTIONS[:7]), F.lit("了")).alias("t"))
    return t.select("id", F.array_join(X.actions(F.col("t")), ",").alias("actions"), X.event_type(F.col("t")).alias("event_type"))


@query(f"""WITH {OBS} SELECT o.observation_id, (SELECT count(DISTINCT p.run_id) FROM obs p WHERE p.event_id = o.event_id AND p.platform = o.platform AND epoch(p.observed_at)::BIGINT BETWEEN epoch(o.observed_at)::BIGINT - 86400 AND epoch(o.observed_at)::BIGINT) - 1 AS prior_rounds FROM obs o""".replace("epoch(p.observed_at)::BIGINT", "CAST(floor(epoch(p.observed_at)) AS BIGINT)").replace("epoch(o.observed_at)::BIGINT", "CAST(floor(epoch(o.observed_at)) AS BIGINT)"))
def trailing_rounds(spark, d):
    return observe.trailing_rounds(observations(spark, d)).select("observation_id", "prior_rounds")


@query("""WITH p AS (SELECT c_mktsegment AS platform, c_custkey AS parent_id, 'r' || (c_custkey % 400) AS ref, 'u' || (c_custkey % 700) AS url FROM customer),
c AS (SELECT c_mktsegment AS platform, o_orderkey AS child_id, CASE WHEN o_orderkey % 3 > 0 THEN 'r' || (o_orderkey % 500) END AS ref, CASE WHEN o_orderkey % 4 = 0 THEN 'u' || (o_orderkey % 900) END AS url FROM orders JOIN customer ON o_custkey = c_custkey),
j AS (SELECT child_id, parent_id FROM c JOIN p ON c.platform = p.platform AND (c.ref IN (p.ref, p.url) OR c.url IN (p.ref, p.url)))
SELECT child_id, min(parent_id) AS parent_id FROM j GROUP BY child_id HAVING count(DISTINCT parent_id) = 1""")
def attached_parents(spark, d):
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    named = lambda x, p: F.concat(F.lit(p), x.cast("string"))
    parents = _t(spark, d, "customer").select(F.col("c_mktsegment").alias("platform"), c.alias("parent_id"), named(c % 400, "r").alias("ref"), named(c % 700, "u").alias("url"))
    children = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == c).select(F.col("c_mktsegment").alias("platform"), k.alias("child_id"), F.when(k % 3 > 0, named(k % 500, "r")).alias("ref"), F.when(k % 4 == 0, named(k % 900, "u")).alias("url"))
    return observe.attach_parents(children, parents)


@query("""SELECT o_orderkey AS task, o_custkey AS event_id, c_custkey % 50 AS owner_event_id FROM orders JOIN customer ON o_orderkey % 1500 = c_custkey WHERE o_custkey <> c_custkey % 50""")
def claims_of_others(spark, d):
    claims = _t(spark, d, "orders").select(F.col("o_orderkey").alias("task"), F.col("o_custkey").alias("event_id"), (F.col("o_orderkey") % 1500).alias("key"))
    owners = _t(spark, d, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 50).alias("owner_event_id"))
    return review.owned_elsewhere(claims, owners, "key").select("task", "event_id", "owner_event_id")


@query("""SELECT o_orderkey AS id, CAST((o_orderdate + INTERVAL (o_orderkey % 24) HOUR + INTERVAL 8 HOUR) AS DATE)::VARCHAR AS day, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE)::VARCHAR END AS week_day FROM orders""")
def report_days(spark, d):
    k, t = F.col("o_orderkey"), _utc("o_orderdate")
    at = F.timestamp_seconds(F.unix_seconds(t) + 3600 * (k % 24))
    thursday = F.date_add(F.date_sub(F.to_date(t), F.weekday(t)), 3)
    stated = F.concat(F.year(thursday).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(t).cast("string"), 2, "0"), F.lit("-"), (F.weekday(t) + 1).cast("string"))
    stated = F.when(k % 4 == 3, F.concat(F.year(thursday).cast("string"), F.lit("-W54-1"))).when(k % 4 == 2, F.replace(stated, F.lit("-"), F.lit(""))).otherwise(stated)
    return _t(spark, d, "orders").select(k.alias("id"), N.report_date(at).cast("string").alias("day"), N.iso_week_day(stated).cast("string").alias("week_day"))


@query("""SELECT o_orderkey AS id, array_to_string(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 't' || (o_orderkey % 9) END, CASE WHEN o_orderkey % 3 = 0 THEN 'a' END, CASE WHEN o_orderkey % 3 = 0 THEN 'b' || (o_orderkey % 5) END, CASE WHEN o_custkey % 2 = 0 THEN 'q' || (o_custkey % 4) END], lambda x: x IS NOT NULL), ',') AS topics,
    CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 50)::DOUBLE WHEN 1 THEN (o_custkey % 50)::DOUBLE END AS votes, CASE WHEN o_orderkey % 4 = 0 THEN (o_custkey % 30)::DOUBLE END AS rank FROM orders""")
def named_topics_and_metrics(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    n = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    item = F.to_json(F.struct(F.when(k % 2 == 0, n("# t", k % 9)).alias("topic"), F.when(k % 3 == 0, F.array(F.lit("#a#"), n("b", k % 5), F.lit(" "))).alias("hashtags")))
    payload = F.to_json(F.struct(F.when(c % 2 == 0, n("q", c % 4)).alias("query"), F.lit("").alias("keywords")))
    raw = F.to_json(F.struct(F.when(k % 3 == 0, k % 50).alias("vote_count"), F.when(k % 3 < 2, c % 50).alias("vote_up_count"), F.when(k % 4 == 0, c % 30).alias("platform_rank")))
    rows = _t(spark, d, "orders").select(k.alias("id"), F.array_join(normalize.topics_of(item, payload), ",").alias("topics"), raw.alias("raw_metrics"))
    return heat.from_raw_metrics(rows).select("id", "topics", "votes", "rank")


@query("""WITH e AS (SELECT o_orderkey AS k, o_orderkey % 3 AS shape, o_orderkey % 4 AS own, o_orderkey % 5 > 0 AS prim FROM orders)
SELECT k AS event_id, CASE shape WHEN 0 THEN 'n' WHEN 1 THEN '' ELSE CASE WHEN own > 0 THEN 'o' WHEN prim THEN 'p' ELSE '' END END AS entities, CASE WHEN k % 2 = 0 THEN 'zhihu:question:' || (k % 90) || ',' ELSE '' END || 'zz' AS canonical_ids FROM e""")
def match_documents(spark, d):
    k = F.col("o_orderkey")
    some = lambda cond, x: F.when(cond, F.array(F.lit(x))).otherwise(X.empty())
    features = F.when(k % 3 < 2, F.struct(some(k % 3 == 0, "n").alias("entities"), F.lit(None).cast("array<string>").alias("action_terms"), F.lit(None).cast("timestamp").alias("event_time")))
    url = F.when(k % 2 == 0, F.concat(F.lit("https://www.zhihu.com/question/"), (k % 90).cast("string"))).otherwise("https://zhihu.com.evil.test/question/1")
    e = _t(spark, d, "orders").select(k.alias("event_id"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("summary"), F.when(k % 5 > 0, "p").alias("primary_entity"), some(k % 4 > 0, "o").alias("entities"), X.empty().alias("action_terms"), X.empty().alias("keywords"), F.lit(None).cast("timestamp").alias("event_time"), F.array(url).alias("urls"), F.array(F.lit("zz")).alias("canonical_ids"), features.alias("features"))
    m = normalize.match_documents(e)
    return m.select("event_id", F.array_join("entities", ",").alias("entities"), F.array_join("canonical_ids", ",").alias("canonical_ids"))


@query("""WITH c AS (SELECT o_custkey AS rk, count(*) AS n, min(o_orderkey) AS task_id, max(o_orderdate) AS last_at, bool_or(o_orderkey % 2 = 0) AS weak FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
dc AS (SELECT o_custkey AS rk, max_by('d' || (o_orderkey % 3), o_orderdate) AS decision, c.rk AS k FROM orders o JOIN c ON o.o_custkey = c.rk WHERE o_orderstatus = 'F' AND o_orderdate <= last_at AND (NOT weak OR date_diff('hour', o_orderdate, last_at) <= 2400) GROUP BY 1, 3),
w AS (SELECT o_custkey AS rk, max_by(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS old FROM orders JOIN c ON o_custkey = c.rk WHERE o_orderstatus = 'P' AND abs(date_diff('hour', o_orderdate, last_at)) <= 2400 GROUP BY 1)
SELECT c.rk AS relation_key, coalesce(old, task_id) AS task_id, CASE WHEN decision IS NOT NULL THEN 'reuse' WHEN old IS NOT NULL THEN 'update' ELSE 'create' END AS action, n FROM c LEFT JOIN dc USING (rk) LEFT JOIN w USING (rk)""")
def review_queue(spark, d):
    o = _t(spark, d, "orders").withColumns({"at": _utc("o_orderdate"), "k": F.col("o_orderkey")})
    ev = F.array((F.col("k") % 5).cast("string"))
    candidates = o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("relation_key"), F.col("k").alias("task_id"), F.col("at").alias("observed_at"), (F.col("k") % 2 == 0).alias("weak"), ev.alias("evidence"))
    pending = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("relation_key"), F.col("k").alias("task_id"), F.col("at").alias("observed_at"), ev.alias("evidence"))
    decided = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("relation_key"), F.col("at").alias("decided_at"), F.concat(F.lit("d"), (F.col("k") % 3).cast("string")).alias("decision"))
    return review.build_queue(candidates, pending, decided, 2400).select("relation_key", "task_id", "action", "n")


@query("""WITH RECURSIVE r AS (SELECT 7::BIGINT AS id UNION ALL SELECT c_custkey FROM customer JOIN r ON c_custkey // 3 = r.id AND c_custkey <> r.id) SELECT id AS run_id FROM r""")
def run_scopes(spark, d):
    c = F.col("c_custkey")
    return review.run_scope(_t(spark, d, "customer").select(c.alias("run_id"), F.nullif(F.floor(c / 3), F.lit(0)).alias("parent_run_id")), 7)


@query(f"""WITH {_BM25.replace('FROM documents)', 'FROM (SELECT item_id AS doc_id, text FROM benchmark))')},
r AS (SELECT item_id AS q, doc_id AS d, round(score, 9) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS n FROM sc),
p AS (SELECT least(q, d) AS a, greatest(q, d) AS b, max(score) AS score FROM r WHERE n <= 6 AND q <> d GROUP BY ALL)
SELECT a, b, round(score, 6) AS score FROM p WHERE NOT (a % 4 = 0 AND b % 2 = 0)""")
def duplicate_candidates(spark, d):
    b = _t(spark, d, "benchmark")
    judged = match.duplicate_candidates(b, "item_id", "text", 5).where("a % 4 = 0 and b % 2 = 0")
    return match.duplicate_candidates(b, "item_id", "text", 5, judged).select("a", "b", F.round("score", 6).alias("score"))


@query(f"""WITH {OBS}, l AS (SELECT event_id, platform, max(observed_at) AS t, count(*) AS n FROM obs WHERE present GROUP BY ALL), h AS (SELECT *, date_diff('microsecond', t, TIMESTAMP '2024-01-31') / 3.6e9 AS age FROM l)
SELECT event_id, platform, round(0.2 * (0.6 + 0.4 * least(n, 5) / 5) * pow(2, -age / 2.0::DOUBLE), 6) AS heat FROM h WHERE platform = 'weibo' AND event_id % 5 > 0 AND age < 24 AND age >= 0""")
def decayed_heat(spark, d):
    from datetime import datetime

    latest = observations(spark, d).where("present").groupBy("event_id", "platform").agg(F.max("observed_at").alias("last_seen_at"), F.count("*").alias("rounds")).withColumn("current", F.col("event_id") % 5 == 0)
    return trend.decayed_heat(latest, F.lit(datetime(2024, 1, 31))).select("event_id", "platform", F.round("estimated_heat", 6).alias("heat"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'r' ELSE 'l' END AS shared, 3 - (o_orderkey % 3 = 0)::INT AS known, starts_with('a_b' || (o_orderkey % 2), 'a_b1') AS prefixed FROM orders""")
def merged_maps(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    left = F.create_map(F.lit("x"), F.lit("l"), F.lit("y"), F.when(k % 3 > 0, "v"))
    right = F.create_map(F.when(c % 2 == 0, "x").otherwise("z"), F.lit("r"), F.lit("w"), F.lit("v"))
    m = filters.merge_maps(left, right)
    known = F.size(filters.known_entries(m)).cast("bigint") - F.when(c % 2 == 0, 0).otherwise(1)
    return _t(spark, d, "orders").select(k.alias("id"), F.try_element_at(m, F.lit("x")).alias("shared"), known.cast("int").alias("known"), filters.literal_prefix(F.concat(F.lit("a_b"), (k % 2).cast("string")), "a_b1").alias("prefixed"))


@query("""SELECT event_id AS id, row_number() OVER (ORDER BY CASE WHEN event_type = 'view' THEN 1 ELSE 0 END, ts, event_id) AS place FROM events""")
def discovery_first(spark, d):
    e = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "search_enrichment").otherwise("topic_discovery").alias("signal_role"), F.struct(_utc("ts").alias("t"), F.col("event_id").alias("i")).alias("seq"))
    return filters.discovery_first(e).select("id", "place")


@query("""SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderkey % 5 = 0 THEN 'empty' WHEN o_orderkey % 7 = 0 THEN 'invalid_items' ELSE 'passed' END AS verdict FROM orders""")
def validated_rounds(spark, d):
    k = F.col("o_orderkey")
    item = lambda title, url: F.struct(title.alias("title"), url.alias("url"), F.lit(None).cast("string").alias("external_id"))
    good, bad = item(F.lit("t"), F.lit("https://x.org")), item(F.when(k % 2 == 0, "t"), F.lit(" "))
    items = F.when(k % 5 == 0, F.slice(F.array(good), 1, 0)).when(k % 7 == 0, F.array(good, bad)).otherwise(F.array(good))
    r = _t(spark, d, "orders").select(k.alias("run_id"), F.lit("s").alias("source_id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("succeeded").alias("status"), items.alias("items"))
    return filters.validated_rounds(r).select("run_id", "verdict")


@query(f"""WITH i AS (SELECT user_id AS event_id, event_id % 40 AS item_id, CASE WHEN event_type IN ('view', 'click') THEN 'zhihu' ELSE 'weibo' END AS platform, event_id % 3 = 0 AS search, event_id % 40 % 9 = 0 AS official, 1 + event_id % 30 AS rank, ts, event_id % 4 > 0 AS fresh FROM events WHERE ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20' AND event_id % 13 > 0),
a AS (SELECT event_id, bool_or(platform = 'zhihu' AND NOT official AND NOT search) AS z, bool_or(platform = 'weibo' AND NOT official AND NOT search) AS w, bool_or(platform = 'zhihu' AND NOT official AND search) AS zs, bool_or(platform = 'weibo' AND NOT official AND search) AS ws, bool_or(official) AS o, bool_or(NOT search) AS f
      FROM i WHERE NOT official OR fresh GROUP BY event_id),
s AS (SELECT *, event_id % 3 = 0 AS sup FROM a WHERE f),
m AS (SELECT *, CASE WHEN z AND w THEN 'natural_topn_overlap' WHEN (w AND zs) OR (z AND ws) THEN 'search_supported' WHEN z OR w THEN 'single_platform_only' WHEN o THEN 'official_only' ELSE 'none' END AS mt FROM s)
SELECT event_id, mt AS match_type, CASE WHEN z AND w AND sup THEN 'A_cross_platform_with_official' WHEN mt = 'search_supported' AND sup THEN 'B_single_platform_with_search_and_official' WHEN ((z AND w) OR mt = 'search_supported') AND NOT sup THEN 'C_cross_platform_without_official'
 WHEN (z OR w) AND sup THEN 'D_single_platform_with_official' WHEN z OR w THEN 'E_single_platform_only' WHEN o THEN 'F_official_only' ELSE 'unknown' END AS category FROM m""")
def window_classes(spark, d):
    e, i = _t(spark, d, "events"), F.col("event_id")
    items = e.select(F.col("user_id").alias("event_id"), (i % 40).alias("item_id"), F.when(F.col("event_type").isin("view", "click"), "zhihu").otherwise("weibo").alias("platform"), F.when(i % 3 == 0, "search_enrichment").otherwise("topic_discovery").alias("signal_role"), F.when(i % 40 % 9 == 0, "official_news").otherwise("community").alias("source_type"), _utc("ts").alias("observed_at"), F.when(i % 4 > 0, F.lit(END)).otherwise(F.lit(START)).alias("published_at"), (1 + i % 30).alias("rank"), (i % 13 == 0).alias("audit_only"), F.lit(True).alias("contributes"))
    support = e.select(F.col("user_id").alias("event_id")).distinct().withColumn("support_status", F.when(F.col("event_id") % 3 == 0, "supported").otherwise("not_found"))
    classes, _ = window_report.rebuilt_window(items, support, observations(spark, d).withColumn("ingested_at", F.col("observed_at")), START, END)
    return classes.select("event_id", "match_type", "category")


@query("""SELECT o_custkey AS event_id, count(DISTINCT o_orderpriority) AS sources, row_number() OVER (ORDER BY count(DISTINCT o_orderpriority) DESC, max(o_orderdate) DESC, o_custkey) AS place FROM orders GROUP BY o_custkey""")
def agenda_order(spark, d):
    e = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("event_id")).agg(F.count_distinct("o_orderpriority").alias("sources"), F.max(_utc("o_orderdate")).alias("last_at"))
    return official.sections_order(e).select("event_id", "sources", "place")


@query(f"""WITH {OBS} SELECT CAST(floor(epoch(observed_at) / 21600) AS BIGINT) AS slot, event_id, platform, count(DISTINCT run_id) AS rounds, round(max(score), 6) AS score FROM obs GROUP BY ALL""")
def slot_counts(spark, d):
    s = rounds.slot_counts(observations(spark, d), "6 hours")
    return s.select(F.floor(F.unix_seconds("start") / 21600).alias("slot"), "event_id", "platform", "rounds", F.round("score", 6).alias("score"))


@query(f"""WITH {OBS}, w AS (SELECT *, unnest(range(0, 4)) AS j FROM obs WHERE present), x AS (SELECT event_id, platform, CAST(floor((epoch_us(observed_at) - 1) / 21600000000) AS BIGINT) - j AS slot FROM w)
SELECT slot, event_id, platform, count(*) AS n FROM x GROUP BY ALL""".replace("(epoch_us(observed_at) - 1) / 21600000000", "(epoch_us(observed_at) - 1) // 21600000000"))
def rolling_presence(spark, d):
    r = rounds.rolling_presence(observations(spark, d), "24 hours", "6 hours")
    return r.select(F.floor(F.unix_seconds("start") / 21600).alias("slot"), "event_id", "platform", "n")


@query("""SELECT l_partkey || ':' || l_suppkey AS k, count(DISTINCT l_orderkey) AS n, min(l_orderkey) AS first FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1""")
def exclusive_groups(spark, d):
    return review.exclusive_groups(_t(spark, d, "lineitem").select("l_orderkey", F.concat_ws(":", "l_partkey", "l_suppkey").alias("k")), "l_orderkey", "k")


@query("""SELECT o_orderkey AS id, ['https://x.org/a?b=1', 'https://x.org/a?b=1', 'https://x.org/a', 'https://x.org/a'][1 + o_orderkey % 4] AS url FROM orders""")
def untracked_links(spark, d):
    k = F.col("o_orderkey")
    u = _pick(k, "https://x.org/a?utm_source=z&b=1", "https://x.org/a?b=1&UTM_medium=q", "https://x.org/a?utm_source=z#part", "https://x.org/a#part")
    return _t(spark, d, "orders").select(k.alias("id"), I.without_tracking(u).alias("url"))
