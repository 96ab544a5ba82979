"""Further queries of the event engine: joins by similarity, scans, envelopes, stores and audits."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from .functions import text as X
from .operators import judge, official, review, similarity
from .plans import duplicate_scan
from .queries import END, OBS, SQL, START, _t, _title, _utc, observations, query
from .sources import envelopes, versions
from .sources.shared import new_path, stored

#: Words and CJK pairs as ``lexical_tokens`` cuts them, for texts without CJK characters.
_TOKENS = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9]+|[一-鿿]+)'))"


def _similar(table: str, id_col: str, threshold: float) -> str:
    """All pairs of rows by the tokens they share, whatever their order: p (x, y, overlap, similarity)."""
    return f"""t AS (SELECT {id_col} AS id, {_TOKENS} AS w FROM {table}),
        k AS (SELECT id, list_sort(w) AS w, min(id) OVER (PARTITION BY list_sort(w)) AS class FROM t),
        s AS (SELECT id, w FROM k WHERE id = class AND len(w) > 0), u AS (SELECT id, len(w) AS n, unnest(w) AS token FROM s),
        o AS (SELECT x.id AS a, y.id AS b, any_value(x.n) AS an, any_value(y.n) AS bn, count(*) AS overlap FROM u x JOIN u y ON x.token = y.token AND x.id < y.id GROUP BY ALL),
        p AS (SELECT a, b, overlap, overlap / (an + bn - overlap) AS similarity FROM o WHERE overlap / (an + bn - overlap) >= {threshold})"""


@query(f"WITH {_similar('benchmark', 'item_id', 0.1)} SELECT a, b, overlap, round(similarity, 6) AS similarity FROM p")
def similar_benchmark_items(spark, d):
    _, pairs = similarity.similarity_join(_t(spark, d, "benchmark"), "item_id", X.lexical_tokens(F.col("text")), 0.1)
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {_similar('documents', 'doc_id', 0.8)}, e AS (SELECT a AS class, similarity FROM p UNION ALL SELECT b, similarity FROM p),
        g AS (SELECT class, count(*) AS links, max(similarity) AS closest FROM e GROUP BY class)
        SELECT k.id AS doc_id, CASE WHEN len(w) > 0 THEN k.class END AS class_id, coalesce(links, 0) AS links, round(closest, 6) AS closest FROM k LEFT JOIN g ON g.class = k.class AND len(w) > 0""")
def similar_documents(spark, d):
    members, pairs = similarity.similarity_join(_t(spark, d, "documents"), "doc_id", X.lexical_tokens(F.col("text")), 0.8)
    return similarity.linked(members, pairs).select(F.col("id").alias("doc_id"), F.col("class").alias("class_id"), "links", F.round("closest", 6).alias("closest"))


@query(f"""WITH {_similar('(SELECT item_id::VARCHAR AS item_id, text FROM benchmark)', 'item_id', 0.1)},
        c AS (SELECT a, b, similarity FROM p UNION ALL SELECT class, id, 1.0 FROM k WHERE id <> class AND len(w) > 0),
        n AS (SELECT *, row_number() OVER (ORDER BY a, b) AS place FROM c)
        SELECT a, b, CASE WHEN similarity >= 0.2 THEN 'same' ELSE 'different' END AS verdict, (place - 1) // 40 + 1 AS slice FROM n""")
def duplicate_scan_slices(spark, d):
    """A scan that is stopped after each slice of 40 pairs and opened again."""
    path, judge = new_path(spark, "scan"), lambda p: p.withColumn("verdict", F.when(F.col("similarity") >= 0.2, "same").otherwise("different"))
    scan = duplicate_scan.DuplicateScan.start(_t(spark, d, "benchmark"), path, "rule-1", 0.1, "item_id")
    while not scan.done:
        scan.record(judge(scan.ahead(40)), 40)
        scan = duplicate_scan.DuplicateScan.open(spark, path, "rule-1", scan.slice)
    places = spark.read.parquet(f"{path}/pairs").select("a", "b", F.expr("(place - 1) div 40 + 1").alias("slice"))
    return scan.verdicts().join(places, ["a", "b"])


#: Responses in eight shapes, with the same statuses: arrays, known lists, envelopes to four levels, a lone status.
_STATUS = """'{{"id":' || {i} || ',"text":"t' || {i} || '","reposts_count":"' || {i} % 7 || '","user":{{"name":"u' || {i} % 5 || '"}},"createdAt":"2024-01-05T00:00:00Z"}}'"""
_TWO = f"""'[' || {_STATUS.format(i='event_id')} || ',{{"junk":1}},5,' || {_STATUS.format(i='(event_id + 1)')} || ']'"""
_SHAPES = (
    _TWO, f"""'{{"statuses":' || {_TWO} || ',"total":9}}'""", f"""'{{"data":{{"Results":' || {_TWO} || '}},"count":true,"Data":{{"Total":"12"}}}}'""",
    f"""'{{"data":{{"x":1}},"Data":{{"data":{{"Data":{{"data":{{"items":' || {_TWO} || '}}}}}}}}}}'""", f"""'{{"data":' || {_STATUS.format(i='event_id')} || ',"id":1}}'""",
    f"""'{{"id":' || event_id || ',"data":{{"list":[]}}}}'""", f"""'{{"list":[],"data":' || {_TWO} || '}}'""", "'not json {'",
)


def _payload() -> str:
    return "CASE event_id % 8 " + " ".join(f"WHEN {k} THEN {s}" for k, s in enumerate(_SHAPES)) + " END"


@query(f"""WITH RECURSIVE p AS (SELECT event_id, {_payload()} AS payload FROM events),
    n AS (SELECT event_id, '' AS level, CASE WHEN json_valid(payload) THEN payload::JSON END AS v FROM p
          UNION ALL SELECT event_id, level || k, json_extract(v, CASE k WHEN '0' THEN '$.data' ELSE '$.Data' END) FROM n, (SELECT unnest(['0', '1']) AS k)
          WHERE json_type(v) = 'OBJECT' AND json_extract(v, CASE k WHEN '0' THEN '$.data' ELSE '$.Data' END) IS NOT NULL),
    m AS (SELECT *, CASE WHEN json_type(v) = 'ARRAY' THEN v ELSE coalesce({", ".join(f"CASE WHEN json_type(v->'$.{k}') = 'ARRAY' THEN v->'$.{k}' END" for k in ("statuses", "items", "Items", "list", "List", "results", "Results"))}) END AS l,
          coalesce({", ".join(f"CASE WHEN json_type(v->'$.{k}') IN ('UBIGINT', 'BIGINT') OR (json_type(v->'$.{k}') = 'VARCHAR' AND regexp_full_match(v->>'$.{k}', '[0-9]+')) THEN CAST(v->>'$.{k}' AS BIGINT) END" for k in ("total_number", "total", "Total", "count", "Count"))}) AS total FROM n),
    looks AS (SELECT *, list_filter(CASE WHEN l IS NULL THEN [v] ELSE CAST(l AS JSON[]) END, lambda x: json_type(x) = 'OBJECT' AND len(list_intersect(json_keys(x), ['text', 'text_raw', 'id', 'idstr', 'mid'])) > 0) AS items FROM m),
    free AS (SELECT * FROM looks a WHERE len(items) > 0 AND NOT EXISTS (SELECT 1 FROM m b WHERE b.event_id = a.event_id AND b.l IS NOT NULL AND len(b.level) < len(a.level) AND starts_with(a.level, b.level))),
    best AS (SELECT event_id, arg_min(items, level || '2') AS items FROM free GROUP BY event_id),
    tot AS (SELECT event_id, arg_min(total, level) AS total FROM m WHERE total IS NOT NULL GROUP BY event_id),
    e AS (SELECT event_id, unnest(items) AS x, generate_subscripts(items, 1) - 1 AS pos FROM best)
    SELECT event_id, CAST(pos AS INT) AS pos, total, x->>'$.id' AS status_id, x->>'$.text' AS text, CAST(x->>'$.reposts_count' AS BIGINT) AS reposts, x->>'$.user.name' AS author,
           CASE WHEN x->>'$.text' IS NULL THEN 'missing_text,missing_created_at' ELSE '' END AS flags FROM e LEFT JOIN tot USING (event_id)""")
def nested_envelopes(spark, d):
    rows = _t(spark, d, "events").select("event_id", F.expr(_payload()).alias("payload"))
    out = envelopes.statuses(rows, "event_id")
    return out.select("event_id", "pos", "total", "status_id", "text", "reposts", "author", F.array_join("flags", ",").alias("flags"))


@query("""WITH e AS (SELECT *, event_id % 4 AS k FROM events),
    i AS (SELECT user_id, id, min(event_id * 10 + pos) AS seen FROM (SELECT user_id, event_id, unnest([CAST(event_id % 9 AS VARCHAR), 'r' || event_id % 5]) AS id, unnest([0, 1]) AS pos FROM e) GROUP BY ALL),
    c AS (SELECT user_id, '{"a":{"x":' || event_id % 3 || ',"y":[1,2.5]},"b":"' || event_type || '"}' AS json, min(event_id) AS seen FROM e WHERE k <> 3 GROUP BY ALL)
    SELECT user_id, any_value(ids) AS ids, any_value(objects) AS objects, count(*) AS rows
    FROM e LEFT JOIN (SELECT user_id, string_agg(id, ',' ORDER BY seen) AS ids FROM i GROUP BY ALL) USING (user_id)
           LEFT JOIN (SELECT user_id, string_agg(json, ';' ORDER BY seen) AS objects FROM c GROUP BY ALL) USING (user_id) GROUP BY user_id""")
def merged_evidence(spark, d):
    """Citations whose keys stand in another order, at both levels, are one; broken ones are none."""
    x, t, k = (F.expr("event_id % 3").cast("string"), F.col("event_type"), F.col("event_id") % 4)
    plain = F.concat(F.lit('{"a": {"x": '), x, F.lit(', "y": [1, 2.50]}, "b": "'), t, F.lit('"}'))
    turned = F.concat(F.lit('{"b":"'), t, F.lit('","a":{"y":[1.0,2.5],"x":'), x, F.lit("}}"))
    rows = _t(spark, d, "events").select("user_id", "event_id", F.array((F.col("event_id") % 9).cast("string")).alias("item_ids"), F.concat(F.lit("r"), (F.col("event_id") % 5).cast("string")).alias("run_id"), F.when(k == 0, F.array(plain)).when(k == 1, F.array(turned, plain)).when(k == 2, F.array(turned, F.lit(None).cast("string"))).otherwise(F.array(F.lit("{broken"))).alias("citations"))
    out = review.merge_evidence(rows, "user_id", "event_id", {"item_ids": "run_id"}, ("citations",))
    return out.select("user_id", F.array_join("item_ids", ",").alias("ids"), F.nullif(F.array_join("citations", ";"), F.lit("")).alias("objects"), "rows")


@query(f"""WITH {OBS} SELECT event_id, platform, run_id, arg_max(observation_id, observed_at) AS observation_id, round(arg_max(score, observed_at), 6) AS score, 3 AS versions
    FROM (SELECT * FROM obs WHERE score IS NOT NULL) GROUP BY event_id, platform, run_id""")
def score_upserts(spark, d):
    """Scores by event, platform and round, in three uneven batches and a replay of the second."""
    o = observations(spark, d).where("score is not null")
    table = versions.Upserts(spark, new_path(spark, "scores"), "event_id bigint, platform string, run_id bigint, observed_at timestamp, observation_id bigint, score double", ["event_id", "platform", "run_id"], "observed_at", buckets=16)
    for part in ("observation_id % 10 < 8", "observation_id % 10 = 8", "observation_id % 10 = 9"):
        table.upsert(o.where(part))
    table.upsert(o.where("observation_id % 10 = 8"))
    return table.read().select("event_id", "platform", "run_id", "observation_id", F.round("score", 6).alias("score"), F.lit(table.version()).alias("versions"))


@query("""WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, * FROM events)
    SELECT day, count(*) AS lines, sum(value)::DECIMAL(18, 2)::DOUBLE AS total, min(day) OVER () > '2024-01-10' AS pruned, (SELECT count(*) FROM events) AS before FROM e WHERE day >= '2024-01-15' GROUP BY day""")
def pruned_log(spark, d):
    """Log lines of the days that a pruning left, beside those that a reader from before still has."""
    log = versions.DayLog(spark, new_path(spark, "log"), "ts timestamp, event_type string, value double")
    e = _t(spark, d, "events").select(_utc("ts").alias("ts"), "event_type", "value", "event_id")
    log.append(e.where("event_id % 2 = 0"))
    log.append(e.where("event_id % 2 = 1"))
    before = log.read()
    log.prune("2024-01-15")
    now = log.read().groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("lines"), F.round(F.sum("value"), 2).alias("total"))
    return now.crossJoin(before.agg(F.count("*").alias("before"))).select("day", "lines", "total", (F.col("day") > "2024-01-10").alias("pruned"), "before")


@query(f"""WITH {_similar('benchmark', 'item_id', 0.1)}, t2 AS (SELECT item_id, length(text) AS n FROM benchmark)
    SELECT a, b, (x.n + y.n)::DOUBLE AS score, a % 2 = 0 AS known FROM p JOIN t2 x ON x.item_id = a JOIN t2 y ON y.item_id = b""")
def cached_scores(spark, d):
    """Pairs of similar items scored in two runs: the second scores only those the first hadn't."""
    items = _t(spark, d, "benchmark")
    _, pairs = similarity.similarity_join(items, "item_id", X.lexical_tokens(F.col("text")), 0.1)
    side = lambda c: items.select(F.col("item_id").alias(c), F.col("text").alias(f"text_{c}"))
    both = stored(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b"), "pairs")
    run = lambda name: lambda missing: missing.select("_name", (F.length("text_a") + F.length("text_b") + F.lit(name)).cast("double").alias("score"))
    cache = versions.ScoreCache(spark, new_path(spark, "cache"), "length-1", buckets=8)
    cache.scored(both.where("a % 2 = 0"), "text_a", "text_b", run(0)).count()
    out = cache.scored(both, "text_a", "text_b", run(1000))  # what the second run scores is told by its number
    fresh = F.col("score") - F.length("text_a") - F.length("text_b") >= 1000
    return out.select("a", "b", F.when(fresh, F.col("score") - 1000).otherwise(F.col("score")).alias("score"), (~fresh).alias("known"))


_FIRST = r"trim(regexp_replace(regexp_extract(coalesce(text, ''), '^\s*([^.!?。！？\n]*)', 1), '\s+', ' ', 'g'))"
_GRAMS = "list_distinct(list_concat(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)), list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3))))"
_BARE_TITLE = r"lower(regexp_replace(b_title, '\s+', '', 'g'))"
_SUPPORT = rf"""e AS (SELECT item_id AS event_id, {_FIRST} AS title FROM benchmark),
    ek AS (SELECT *, list_filter(w, lambda x, i: x <> '' AND list_position(w, x) = i)[1:8] AS kw FROM (
        SELECT *, list_transform(regexp_split_to_array(title, '[\s,，。.!！？?;；:：、/\\|()\[\]{{}}<>《》「」『』“”"''`~]+'), lambda x: trim(x, ' #，。！？!?;；:：、/|()[]{{}}<>《》「」『』“”"''`~')) AS w FROM e)),
    eq AS (SELECT *, CASE WHEN len(kw) > 0 THEN array_to_string(kw[1:3], ' ') ELSE title END AS query FROM ek),
    dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9]+|[一-鿿]+)') AS w FROM documents),
    tf AS (SELECT doc_id, term, any_value(len) AS len, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM dw) GROUP BY doc_id, term),
    f AS (SELECT term, count(*) AS df FROM tf GROUP BY term), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM dw),
    q AS (SELECT event_id, unnest(list_distinct(regexp_extract_all(lower(query), '([a-z0-9]+|[一-鿿]+)'))) AS term FROM eq),
    sc AS (SELECT event_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))) AS score FROM q JOIN tf USING (term) JOIN f USING (term) CROSS JOIN s GROUP BY ALL),
    c AS (SELECT event_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(score, 9) DESC, doc_id) AS n FROM sc) WHERE n <= 20),
    p AS (SELECT c.event_id, c.doc_id, eq.kw, lower(regexp_replace(eq.title, '\s+', '', 'g')) AS ta, eq.title, {_FIRST} AS b_title, lower(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) AS b_text,
        c.doc_id % 5 > 0 AND {_FIRST} <> '' AND c.doc_id % 3 > 0 AS good FROM c JOIN eq USING (event_id) JOIN documents USING (doc_id)),
    pb AS (SELECT *, {_BARE_TITLE} AS tb FROM p),
    g AS (SELECT *, len(list_filter(kw, lambda k: contains(b_text, k))) AS hits, {_GRAMS.format('ta')} AS ga, {_GRAMS.format('tb')} AS gb,
        lower(regexp_replace(title, '[^\p{{L}}\p{{N}}\p{{M}}_]+', '', 'g')) AS na, lower(regexp_replace(b_title, '[^\p{{L}}\p{{N}}\p{{M}}_]+', '', 'g')) AS nb FROM pb),
    h AS (SELECT *, CASE WHEN len(kw) > 0 THEN hits / len(kw) ELSE 0 END AS keyword, CASE WHEN len(ga) > 0 THEN len(list_intersect(ga, gb)) / len(ga) ELSE 0 END AS ngram FROM g),
    o AS (SELECT *, CASE WHEN NOT ((length(na) >= 6 AND length(nb) >= 6 AND (contains(na, nb) OR contains(nb, na))) OR (keyword >= 0.5 AND hits >= 2) OR ngram >= 0.45) THEN 'weak_text' WHEN good THEN 'supported' ELSE 'weak_supported' END AS outcome FROM h),
    z AS (SELECT *, CASE WHEN outcome <> 'weak_text' THEN struct_pack(s := outcome = 'supported', t := round(CASE WHEN outcome = 'supported' THEN 1.0 ELSE 0.5 END + keyword + ngram, 12), d := doc_id) END AS k FROM o),
    r AS (SELECT event_id, count(*) AS candidates, count(*) FILTER (outcome = 'supported') AS supported, count(*) FILTER (outcome = 'weak_supported') AS weak_supported, count(*) FILTER (outcome = 'weak_text') AS weak_text, max(k).d AS best_item FROM z GROUP BY event_id)"""


#: The query of that name has a pool of articles that are all too old to be more than weak support.
SQL["official_support"] = f"""WITH {_SUPPORT.replace("c.doc_id % 5 > 0 AND", "false AND")} SELECT event_id, CASE WHEN weak_supported > 0 THEN 'weak_supported' ELSE 'not_found' END AS support_status, 0 AS n_supported, best_item FROM eq LEFT JOIN r USING (event_id)"""


def _support_tables(spark, d):
    i = F.col("doc_id")
    e = _t(spark, d, "benchmark").select(F.col("item_id").alias("event_id"), _title().alias("title"), X.empty().alias("entities")).withColumn("keywords", X.keywords(F.col("title")))
    pool = _t(spark, d, "documents").select(i.alias("item_id"), _title().alias("title"), "text", X.empty().alias("entities"), F.when(i % 5 == 0, "fallback").otherwise("use").alias("status"), F.lit("https://x.org").alias("url"), F.when(i % 3 == 0, F.lit(START)).otherwise(F.lit(END)).alias("published_at"))
    return e, pool


@query(f"""WITH {_SUPPORT} SELECT event_id, CASE WHEN supported > 0 THEN 'supported' WHEN weak_supported > 0 THEN 'weak_supported' ELSE 'not_found' END AS support_status, best_item, query,
    coalesce(candidates, 0) AS candidates, coalesce(supported, 0) AS supported, coalesce(weak_supported, 0) AS weak_supported, 0 AS conflict, 0 AS other_entities, coalesce(weak_text, 0) AS weak_text,
    (SELECT sum(candidates)::BIGINT FROM r) AS all_candidates FROM eq LEFT JOIN r USING (event_id)""")
def official_support_audit(spark, d):
    """Support of every event with the counts of its query, candidates and drops, and their sum as the
    same pass observed it."""
    seen = Observation("support")
    out = stored(official.audited_support(*_support_tables(spark, d), F.lit(END), seen=seen), "support")
    return out.select("event_id", "support_status", "best_item", "query", "candidates", *official.OUTCOMES, F.lit(seen.get["candidates"]).alias("all_candidates"))


_JUDGED = """b AS (SELECT item_id AS i, text FROM benchmark), x AS (SELECT unnest([0, 1, 2]) AS k),
    j AS (SELECT i, k, 's' || i AS signal_id, 'd' || doc_id AS candidate_id, b.text AS st, d.text AS dt, (i * 3 + k) % 11 AS m FROM b, x JOIN documents d ON d.doc_id = (i * 7 + k * 13) % 100),
    v AS (SELECT *, CASE WHEN m IN (0, 1, 2) THEN 'same_event' WHEN m IN (3, 4, 5, 6) THEN 'insufficient_evidence' ELSE 'different_event' END AS decision,
          CASE m WHEN 3 THEN 'possible_same_event' WHEN 4 THEN 'insufficient_context' WHEN 5 THEN 'other' END AS kind,
          CASE WHEN i % 6 = 5 AND k = 1 THEN 'no such words here' ELSE substr(dt, 3, 12) END AS dq, substr(st, 5, 20) AS sq FROM j)"""


@query(f"""WITH {_JUDGED}, c AS (SELECT *, CASE WHEN (length(trim(sq)) = 0 OR strpos(st, sq) = 0 OR length(trim(dq)) = 0 OR strpos(dt, dq) = 0) THEN 'quote_not_found' WHEN m = 1 AND i % 4 = 1 THEN 'same_event_has_conflicts' WHEN m = 6 THEN 'uncertainty_kind_missing'
        WHEN m = 3 AND i % 5 = 4 THEN 'uncertainty_missing_critical_detail' END AS problem FROM v),
    g AS (SELECT *, CASE WHEN problem IS NOT NULL THEN NULL WHEN decision = 'same_event' THEN 'same' WHEN m = 3 THEN 'plausible' WHEN m = 4 THEN 'context_only' WHEN m = 5 THEN 'legacy' ELSE 'different' END AS grp FROM c),
    a AS (SELECT signal_id, arg_min(problem, k) FILTER (problem IS NOT NULL) AS problem, count(*) FILTER (grp = 'same') AS same, count(*) FILTER (grp IN ('plausible', 'legacy')) AS unsure, count(*) FILTER (grp = 'legacy') AS legacy,
          coalesce(arg_min(candidate_id, k) FILTER (grp = 'same'), arg_min(candidate_id, k) FILTER (grp = 'plausible'), arg_min(candidate_id, k) FILTER (grp = 'legacy')) AS pick, string_agg(candidate_id, ',' ORDER BY k) FILTER (grp = 'context_only') AS context_only FROM g GROUP BY signal_id)
    SELECT signal_id, CASE WHEN problem IS NOT NULL THEN 'candidate_review' WHEN same = 1 AND unsure = 0 THEN 'merge' WHEN same + unsure > 0 THEN 'candidate_review' ELSE 'create' END AS action,
           CASE WHEN problem IS NULL AND same + unsure > 0 THEN pick END AS event_id, CASE WHEN problem IS NOT NULL THEN 0.0 WHEN same = 1 AND unsure = 0 THEN 1.0 WHEN same + unsure > 0 THEN 0.6 ELSE 0.75 END::DOUBLE AS confidence,
           CASE WHEN problem IS NOT NULL THEN 'technical_error' WHEN same > 1 THEN 'competing_matches' WHEN legacy > 0 THEN 'legacy_uncertainty' WHEN unsure > 0 THEN 'plausible_uncertainty' WHEN same = 1 THEN 'automatic_merge' ELSE 'independent_topic' END AS category,
           problem, coalesce(context_only, '') AS context_only FROM a""")
def judged_signals(spark, d):
    """Judgments of each benchmark item against three documents, with quotes from both texts, replayed."""
    b = _t(spark, d, "benchmark").select(F.col("item_id").alias("i"), F.col("text").alias("st"))
    k = b.withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    docs = _t(spark, d, "documents").select("doc_id", F.col("text").alias("dt"))
    j = k.join(docs, F.col("doc_id") == (F.col("i") * 7 + F.col("k") * 13) % 100).withColumn("m", (F.col("i") * 3 + F.col("k")) % 11)
    m, text = F.col("m"), lambda c: F.array(F.lit(c))
    s, c = F.concat(F.lit("s"), F.col("i")), F.concat(F.lit("d"), F.col("doc_id"))
    dq = F.when((F.col("i") % 6 == 5) & (F.col("k") == 1), "no such words here").otherwise(F.substring("dt", 3, 12))
    quotes = F.array(F.struct(s.alias("source_id"), F.substring("st", 5, 20).alias("quote")), F.struct(c.alias("source_id"), dq.alias("quote")))
    rows = j.select(
        s.alias("signal_id"), c.alias("candidate_id"), F.col("k").alias("place"), F.when(m < 3, "same_event").when(m < 7, "insufficient_evidence").otherwise("different_event").alias("decision"),
        F.when(m == 3, "possible_same_event").when(m == 4, "insufficient_context").when(m == 5, "other").alias("uncertainty_kind"), quotes.alias("evidence"), F.when(m == 3, quotes).alias("clues"),
        F.when((m == 1) & (F.col("i") % 4 == 1), text("date")).alias("conflicts"), F.when((m == 3) & (F.col("i") % 5 != 4), text("when")).alias("missing_information"),
    )
    documents = b.select(s.alias("source_id"), F.lit(None).cast("string").alias("title"), F.col("st").alias("text")).unionByName(docs.select(c.alias("source_id"), F.lit(None).cast("string").alias("title"), F.col("dt").alias("text")))
    out = judge.decided(rows.select("signal_id").distinct(), judge.checked(rows, documents))
    return out.select("signal_id", "action", "event_id", "confidence", "category", "problem", F.array_join("context_only", ",").alias("context_only"))
