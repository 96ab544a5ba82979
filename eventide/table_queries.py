"""Queries of single operators over whole tables, each with the same in DuckDB's SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from .functions import numbers as N
from .functions import text as X
from .operators import evaluate, filters, guardrails, heat, normalize, official, report, review
from .plans import briefing
from .queries import END, START, _t, _title, _utc, query
from .sources import readers
from .sources.shared import new_path

_DAY = "strftime(ts, '%Y-%m-%d')"


def _events(spark, d):
    return _t(spark, d, "events").withColumn("ts", _utc("ts"))


@query(f"""SELECT event_id, concat_ws(':', 'run' || {_DAY}, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS observation_id, 'top' || (10 + event_id % 3 * 10) || ':skip=2' AS topn_scope,
    sha256('{{"requested_limit":' || (10 + event_id % 3 * 10) || ',"skip":2,"source_id":"' || event_type || '"}}') AS sampling_signature FROM events""")
def round_metadata(spark, d):
    rounds = _events(spark, d).select("event_id", F.concat(F.lit("run"), F.date_format("ts", "yyyy-MM-dd")).alias("run_id"), F.col("event_type").alias("source_id"), F.col("ts").alias("observed_at"), (10 + F.col("event_id") % 3 * 10).alias("requested_limit"))
    return readers.observation_metadata(rounds, 2).select("event_id", "observation_id", "topn_scope", "sampling_signature")


@query("""WITH i AS (SELECT *, unnest([1, 2]) AS rank FROM events)
    SELECT event_id, CAST(rank AS INT) AS rank, event_type || CASE rank WHEN 1 THEN ' & more' ELSE ' "2"' END AS title, 'https://x.org/' || event_id || '/' || rank AS url, CASE rank WHEN 1 THEN strftime(ts, '%Y-%m-%d') ELSE '' END AS published_raw,
    CASE rank WHEN 1 THEN 'heat ' || (event_id * 37 + 1000) || ' of 999' ELSE 'none' END AS summary, CASE rank WHEN 1 THEN event_id * 37 + 1000 END AS hot_value FROM i""")
def feed_items(spark, d):
    """Feeds of two items each, with a bare ampersand, references and a CDATA section."""
    xml = F.format_string("<rss><channel><title>no item</title><item><title>%1$s & more</title><link>https://x.org/%2$d/1</link><pubDate>%3$s</pubDate><description><![CDATA[<b>heat %4$d</b> of 999]]></description></item>\n<item id='2'><title>%1$s &quot;2&quot;</title><link>https://x.org/%2$d/2</link><description>none</description></item></channel></rss>", "event_type", "event_id", F.date_format("ts", "yyyy-MM-dd"), F.col("event_id") * 37 + 1000)
    return readers.feed(_events(spark, d).select("event_id", xml.alias("xml"))).select("event_id", "rank", "title", "url", "published_raw", "summary", "hot_value")


@query("""WITH e AS (SELECT *, unnest([1, 2]) AS rank FROM events)
    SELECT event_id, CAST(rank AS INT) AS rank, CASE rank WHEN 1 THEN event_type ELSE 'second' END AS title, CASE rank WHEN 1 THEN 'https://www.zhihu.com/question/' || CASE WHEN event_id % 5 = 0 THEN 'x' ELSE '' END || event_id ELSE 'https://own/' || event_id END AS url,
    CASE rank WHEN 1 THEN (event_id % 1000 + 0.5) * 10000 ELSE 300 END::DOUBLE AS native_heat, CASE rank WHEN 1 THEN event_id % 5 <> 0 AND event_id % 7 <> 0 ELSE true END AS valid FROM e""")
def hot_list_entries(spark, d):
    """Hot lists in four envelopes; entries with a bad id or an unknown kind are marked."""
    i = F.col("event_id")
    one = F.format_string('{"target":{"id":"%s","type":"%s","title":"%s"},"detail_text":"%s 万热度"}', F.concat(F.when(i % 5 == 0, "x").otherwise(""), i.cast("string")), F.when(i % 7 == 0, "ad").otherwise("question"), "event_type", F.concat((i % 1000).cast("string"), F.lit(".5")))
    two = F.format_string('{"title":"second","url":"https://own/%d","target":{"id":"9","type":"article"},"detail_text":"300热度"}', "event_id")
    items = F.concat(F.lit("["), one, F.lit(","), two, F.lit("]"))
    k = i % 4
    payload = F.when(k == 0, items).when(k == 1, F.concat(F.lit('{"data":'), items, F.lit("}"))).when(k == 2, F.concat(F.lit('{"Data":{"Items":'), items, F.lit("}}"))).otherwise(F.concat(F.lit('{"data":{"list":'), items, F.lit("}}")))
    return readers.hot_list(_t(spark, d, "events").select("event_id", payload.alias("payload"))).select("event_id", "rank", "title", "url", "native_heat", "valid")


@query("""WITH r AS (SELECT event_id, unnest([event_type, 'b', '']) AS title, unnest(['https://n/' || event_id, 'javascript:x', 'https://n/2']) AS url, ts FROM events WHERE event_id % 3 < 2)
    SELECT event_id, title, url, epoch_us(date_trunc('second', ts)) AS published_us FROM r WHERE title <> '' AND url LIKE 'https://%'""")
def site_search_records(spark, d):
    """Records of a news site's search, as an envelope or in a page's script; one shape has an error code."""
    ms = F.unix_seconds("ts") * 1000
    rows = F.format_string('[{"title":"%s","url":"https://n/%d","displayTime":%d},{"title":"b","url":"javascript:x"},{"title":" ","url":"https://n/2"}]', "event_type", "event_id", ms)
    payload = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"code":"0","data":{"records":'), rows, F.lit("}}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("<script> var  docArr = "), rows, F.lit("; run(docArr)</script>"))).otherwise(F.concat(F.lit('{"code":"7","data":{"records":'), rows, F.lit("}}")))
    return filters.site_search(_events(spark, d).select("event_id", payload.alias("payload"))).select("event_id", "title", "url", F.unix_micros("published_at").alias("published_us"))


@query("""WITH s AS (SELECT user_id AS topic_id, max(event_id % 100) AS reposts, max(CASE WHEN event_id % 6 <> 0 THEN event_id % 50 END) AS status_comments, count(*) AS matched, max(epoch_us(ts)) AS latest_us FROM events WHERE event_id % 4 <> 0 GROUP BY 1)
    SELECT c_custkey AS topic_id, reposts, status_comments, matched, latest_us FROM customer LEFT JOIN s ON topic_id = c_custkey""")
def folded_samples(spark, d):
    i = F.col("event_id")
    samples = _events(spark, d).select(F.col("user_id").alias("topic_id"), (i % 100).alias("reposts"), F.when(i % 6 != 0, i % 50).alias("comments"), F.lit(None).cast("bigint").alias("likes"), (i % 4 != 0).alias("accepted"), F.col("ts").alias("created_at"))
    out = heat.fold_samples(_t(spark, d, "customer").select(F.col("c_custkey").alias("topic_id")), samples)
    return out.select("topic_id", "reposts", "status_comments", "matched", F.unix_micros("latest_status_at").alias("latest_us"))


@query("""WITH e AS (SELECT *, event_id % 6 AS k FROM events)
    SELECT 'evidence' AS kind, event_id FROM e WHERE k IN (0, 1) AND event_id % 5 < 2
    UNION ALL SELECT 'main', event_id FROM e WHERE ts > TIMESTAMP '2024-01-19' AND ts <= TIMESTAMP '2024-01-20' AND k <> 2 AND event_id % 5 <> 3
    UNION ALL SELECT 'run', event_id FROM e WHERE k = 4
    UNION ALL SELECT 'prior', event_id FROM e WHERE ts > least(TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-13') AND ts <= TIMESTAMP '2024-01-20' AND CAST(ts + INTERVAL 8 HOUR AS DATE) >= CAST(TIMESTAMP '2024-01-14' + INTERVAL 8 HOUR AS DATE) AND k <> 5
    UNION ALL SELECT 'untraceable', event_id FROM e WHERE k = 3 OR event_id % 5 = 4""")
def filtered_materials(spark, d):
    """What five filters of materials keep of all events."""
    e, i = _events(spark, d).withColumn("k", F.col("event_id") % 6), F.col("event_id")
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "event_id")
    pool = e.withColumns({"source_type": F.when(F.col("k") < 3, "official").otherwise("community"), "source_status": F.when(F.col("k") == 0, "use").when(F.col("k") == 1, "fallback").otherwise("unavailable"), "signal_role": F.when(i % 5 == 0, "official_evidence").when(i % 5 == 1, "official_agenda").otherwise("topic_discovery")})
    main = e.withColumns({"observed_at": F.col("ts"), "present": F.col("k") != 2, "collection_status": F.when(i % 5 == 3, "failed").otherwise("succeeded"), "main_source": F.lit(True)})
    run = e.withColumn("input_json", F.format_string('{"a":1,"run_id":"r%d"}', "k"))
    prior = e.withColumns({"published_at": F.col("ts"), "event_time": F.lit(datetime(2024, 1, 14)), "specific_identity": F.col("k") != 5})
    ids = e.select(i.cast("string").alias("source_signal_id"), (F.col("k") == 3).alias("audit_only"), F.when(i % 5 != 4, i).alias("item_id"))
    lost = guardrails.untraceable(e.select(i.alias("signal_id"), F.array(i.cast("string")).alias("source_signal_ids")), ids).withColumnRenamed("signal_id", "event_id")
    parts = [(filters.evidence_pool(pool), "evidence"), (filters.recent_main_signals(main, F.lit(END)), "main"), (filters.run_filter(run, "r4"), "run"), (filters.prior_reports(prior, F.lit(datetime(2024, 1, 15)), F.lit(END)), "prior"), (lost, "untraceable")]
    out = named(*parts[0])
    for p in parts[1:]:
        out = out.unionByName(named(*p))
    return out


_REFS = "r AS (SELECT user_id AS event_id, event_id AS item_id, event_type AS source_name, 'Story ' || event_id % 4 AS title, ts AS published_at, event_id % 3 = 0 AS supported, CASE WHEN event_id % 4 <> 1 THEN (event_id % 10) / 10.0 END AS rerank, value AS score, CASE event_id % 7 WHEN 0 THEN 'use' WHEN 1 THEN 'fallback' ELSE 'unavailable' END AS status FROM events)"
_BUCKET = "CASE WHEN h <= 24 THEN '24h' WHEN h <= 72 THEN '72h' WHEN h <= 168 THEN '7d' ELSE 'stale' END"


def _refs(spark, d):
    i = F.col("event_id")
    return _events(spark, d).select(F.col("user_id").alias("event_id"), i.alias("item_id"), F.col("event_type").alias("source_name"), F.concat(F.lit("Story "), (i % 4).cast("string")).alias("title"), F.col("ts").alias("published_at"), (i % 3 == 0).alias("supported"), F.when(i % 4 != 1, (i % 10) / 10.0).alias("rerank"), F.col("value").alias("score"), F.when(i % 7 == 0, "use").when(i % 7 == 1, "fallback").otherwise("unavailable").alias("status"))


@query(f"WITH {_REFS} SELECT event_id, item_id, row_number() OVER (PARTITION BY event_id ORDER BY supported DESC, rerank DESC NULLS LAST, score DESC, item_id) AS place FROM r")
def reference_places(spark, d):
    return official.reference_order(_refs(spark, d)).select("event_id", "item_id", "place")


@query(f"""WITH {_REFS}, a AS (SELECT event_id, count(DISTINCT source_name) AS sources, count(DISTINCT title) AS stories, count(*) AS items, min(date_diff('microsecond', published_at, TIMESTAMP '2024-01-31') / 3.6e9) AS h, min(CASE status WHEN 'use' THEN 0 WHEN 'fallback' THEN 1 ELSE 2 END) AS s FROM r GROUP BY event_id)
    SELECT event_id, sources, stories, items, CASE WHEN sources <= 1 THEN 'single_source' WHEN stories <= 1 THEN 'multi_source_duplicate' ELSE 'multi_source_independent' END AS level, ['use', 'fallback', 'unavailable'][s + 1] AS best_status, {_BUCKET} AS freshness FROM a""")
def reference_coverage(spark, d):
    refs, end = _refs(spark, d), F.lit(datetime(2024, 1, 31))
    rank = official.best_freshness(refs, end).join(filters.agenda_rank(refs, end).select("event_id", "items", "best_status"), "event_id")
    return official.coverage(refs).join(rank, "event_id").select("event_id", "sources", "stories", "items", "level", "best_status", "freshness")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events),
    o AS (SELECT user_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, string_agg(DISTINCT flag, ',' ORDER BY flag) FILTER (flag <> '') AS flags FROM (SELECT user_id, event_type AS role, unnest(['f' || event_id % 3, CASE WHEN event_id % 5 = 0 THEN 'x' ELSE '' END]) AS flag FROM events) GROUP BY user_id)
    SELECT user_id, CASE WHEN event_id % 9 = 0 THEN 'unavailable' WHEN date_diff('microsecond', ts, TIMESTAMP '2024-01-31') / 3.6e9 > 12 THEN 'stale' WHEN event_id % 2 = 0 THEN 'degraded' ELSE 'ok' END AS health, roles, coalesce(flags, '') AS flags
    FROM l JOIN o USING (user_id) WHERE n = 1""")
def source_state(spark, d):
    """Health of each source by its last round, and the roles and flags that it ever had."""
    e, i = _events(spark, d), F.col("event_id")
    rounds = e.select(F.col("user_id").alias("source_id"), i.alias("round_id"), F.col("ts").alias("observed_at"), F.when(i % 9 == 0, "failed").otherwise("succeeded").alias("status"), F.when(i % 2 == 0, F.array(F.lit("parse_error"))).otherwise(F.array().cast("array<string>")).alias("flags"))
    items = e.select(F.col("user_id").alias("source_id"), F.col("event_type").alias("signal_role"), F.array_compact(F.array(F.concat(F.lit("f"), (i % 3).cast("string")), F.when(i % 5 == 0, "x"))).alias("quality_flags"))
    j = report.source_health(rounds, F.lit(datetime(2024, 1, 31)), 12).join(filters.roles_by_source(items), "source_id")
    return j.select(F.col("source_id").alias("user_id"), "health", F.array_join("roles", ",").alias("roles"), F.array_join("flags", ",").alias("flags"))


@query("""SELECT count(DISTINCT user_id) AS events, count(DISTINCT (user_id, event_type)) AS citations, count(*) AS requests, coalesce(sum(event_id % 17) FILTER (event_id % 3 <> 0), 0)::BIGINT AS charged, (1000000 - coalesce(sum(event_id % 17) FILTER (event_id % 3 <> 0), 0))::BIGINT AS "left",
    coalesce(sum(event_id % 17) FILTER (event_id % 3 <> 0), 0) + 500 <= 1000000 AS fits FROM events""")
def counted_and_charged(spark, d):
    e, i = _t(spark, d, "events"), F.col("event_id")
    counted = report.counters(e.select(F.col("user_id").alias("event_id"), F.col("event_type").alias("url")))
    return counted.join(report.budget(e.select(F.when(i % 3 != 0, i % 17).alias("charged")), 1_000_000, 500))  # one row each


@query(r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, trim(regexp_replace(regexp_extract(coalesce(text, ''), '^\s*([^.!?。！？\n]*)', 1), '\s+', ' ', 'g')) AS title FROM documents),
    w AS (SELECT *, lower(regexp_replace(title, '[^\p{L}\p{N}\p{M}_]+', '', 'g')) AS words, lower(regexp_replace(title, '\s+', '', 'g')) AS bare FROM t),
    g AS (SELECT *, list_distinct(list_concat(list_transform(range(1, length(bare)), lambda i: substr(bare, i, 2)), list_transform(range(1, length(bare) - 1), lambda i: substr(bare, i, 3)))) AS grams FROM w),
    p AS (SELECT a.doc_id, a.words, a.bare, len(a.grams) AS n_grams, len(list_intersect(a.grams, b.grams)) AS shared, len(b.grams) AS other, a.words AS wa, b.words AS wb FROM g a JOIN g b ON b.doc_id = a.doc_id - a.doc_id % 2)
    SELECT doc_id, sha256(words) AS words, sha256(bare) AS bare, n_grams, round(CASE WHEN n_grams > 0 AND other > 0 THEN shared / (n_grams + other - shared) ELSE 0 END, 6)::DOUBLE AS jaccard,
           round(CASE WHEN n_grams > 0 THEN shared / n_grams ELSE 0 END, 6)::DOUBLE AS containment, length(wa) >= 6 AND length(wb) >= 6 AND (contains(wa, wb) OR contains(wb, wa)) AS same_title FROM p""")
def title_features(spark, d):
    """Normalised titles and their character n-grams, beside those of the document before."""
    t = _t(spark, d, "documents").select("doc_id", _title().alias("title"))
    f = t.select("doc_id", "title", X.normalize_words(F.col("title")).alias("words"), X.normalize_space(F.col("title")).alias("bare")).withColumn("grams", X.ngrams(F.col("bare"), 2, 3))
    b = f.select(F.col("doc_id").alias("_id"), F.col("grams").alias("other"), F.col("title").alias("title_b"))
    j = f.join(b, F.col("_id") == F.col("doc_id") - F.col("doc_id") % 2)
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return j.select("doc_id", sha("words").alias("words"), sha("bare").alias("bare"), F.size("grams").cast("bigint").alias("n_grams"), F.round(X.jaccard(F.col("grams"), F.col("other")), 6).alias("jaccard"), F.round(X.containment(F.col("grams"), F.col("other")), 6).alias("containment"), X.title_containment(F.col("title"), F.col("title_b")).alias("same_title"))


@query("""WITH e AS (SELECT *, event_id % 8 AS k FROM events)
    SELECT DISTINCT user_id AS event_id, error FROM (
        SELECT user_id, 'invalid_url' AS error FROM e WHERE k = 0 UNION ALL SELECT user_id, 'citation_out_of_window' FROM e WHERE k NOT IN (1, 2) AND NOT (ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20')
        UNION ALL SELECT user_id, 'citation_not_yet_collected' FROM e WHERE ts > TIMESTAMP '2024-01-25'
        UNION ALL SELECT user_id, 'official_publication_out_of_window' FROM e WHERE k IN (1, 2) AND NOT (ts - INTERVAL 1 DAY > TIMESTAMP '2024-01-10' AND ts - INTERVAL 1 DAY <= TIMESTAMP '2024-01-20') AND NOT (k = 2 AND user_id % 3 = 0)
        UNION ALL SELECT user_id, 'official_class_without_official_citation' FROM e GROUP BY user_id HAVING user_id % 4 = 0 AND count(*) FILTER (k IN (1, 2)) = 0
        UNION ALL SELECT user_id, 'missing_platform_analysis' FROM e WHERE user_id % 5 = 0 UNION ALL SELECT user_id, 'classification_window_mismatch' FROM e WHERE user_id % 7 = 0
        UNION ALL SELECT user_id, 'duplicate_in_section' FROM e WHERE user_id % 11 = 0)""")
def publication_problems(spark, d):
    e, i, u = _events(spark, d), F.col("event_id"), F.col("user_id")
    one = e.select(u.alias("event_id")).distinct()
    k = F.col("event_id")
    cards = one.select("event_id", F.lit("category_A").alias("section"), F.when(k % 7 == 0, "old").otherwise("run").alias("run_id"), F.lit(START).alias("window_start"), F.lit(END).alias("window_end"), (k % 5 != 0).alias("has_analysis"), (k % 4 == 0).alias("official_source"), (k % 3 == 0).alias("zhihu_topn"), F.lit(False).alias("weibo_topn"))
    cards = cards.unionByName(cards.where(k % 11 == 0))
    cited = e.select(u.alias("event_id"), F.when(i % 8 == 0, "ftp:x").otherwise("https://x.org").alias("url"), F.when((i % 8).isin(1, 2), "official_news").otherwise("community").alias("source_type"), F.col("ts").alias("fetched_at"), (F.col("ts") - F.expr("interval 1 day")).alias("published_at"), F.lit(True).alias("is_prior_report"), (i % 8 == 2).alias("prior_allowed"))
    health = e.select(F.lit("succeeded").alias("status")).distinct()
    return briefing.publication_errors(cards, cited, health, "run", F.lit(START), F.lit(END), F.lit(datetime(2024, 1, 25)))


@query("""WITH c AS (SELECT event_id, unnest(['g' || user_id, 'h' || event_id % 400]) AS grp, CASE WHEN user_id % 3 = 0 AND event_id % 2 = 0 THEN 'test' ELSE 'train' END AS split FROM events),
    m AS (SELECT event_id, CASE WHEN value < 20 THEN 'missing_value,too_early' END AS e FROM events)
    SELECT 'leak' AS kind, grp AS name, count(DISTINCT split) AS n FROM c GROUP BY grp HAVING count(DISTINCT split) > 1
    UNION ALL SELECT 'move', event_type || '>' || (event_id % 4), count(*) FROM events WHERE NOT (event_type = 'view' OR (event_type = 'click' AND event_id % 4 < 2)) GROUP BY 2
    UNION ALL SELECT 'invalid', CASE WHEN value < 20 THEN 'small' ELSE '' END || CASE WHEN value < 20 AND user_id % 2 = 0 THEN ',' ELSE '' END || CASE WHEN user_id % 2 = 0 THEN 'even' ELSE '' END, count(*) FROM events WHERE value < 20 OR user_id % 2 = 0 GROUP BY 2""")
def leaks_moves_and_errors(spark, d):
    """Groups in two splits, moves that a state machine forbids, and rows by the checks they fail."""
    e, i, u = _t(spark, d, "events"), F.col("event_id"), F.col("user_id")
    cases = e.select(F.array(F.concat(F.lit("g"), u.cast("string")), F.concat(F.lit("h"), (i % 400).cast("string"))).alias("groups"), F.when((u % 3 == 0) & (i % 2 == 0), "test").otherwise("train").alias("split"))
    leaks = evaluate.split_leaks(cases).select(F.lit("leak").alias("kind"), F.col("group").alias("name"), F.col("splits").alias("n"))
    moves = e.select(F.col("event_type").alias("old"), (i % 4).cast("string").alias("new"))
    allowed = moves.where("old = 'view' or (old = 'click' and new in ('0', '1'))").distinct()
    bad = guardrails.transitions(moves, allowed).groupBy(F.concat_ws(">", "old", "new").alias("name")).agg(F.count("*").alias("n")).select(F.lit("move").alias("kind"), "name", "n")
    _, invalid = normalize.split_valid(e, {"small": F.col("value") >= 20, "even": u % 2 != 0})
    errors = invalid.groupBy(F.array_join("errors", ",").alias("name")).agg(F.count("*").alias("n")).select(F.lit("invalid").alias("kind"), "name", "n")
    return leaks.unionByName(bad).unionByName(errors)


@query("""WITH r AS (SELECT *, user_id % 50 AS report, event_type || '/' || floor(value / 100)::BIGINT AS body FROM events),
    a AS (SELECT DISTINCT report, body FROM r WHERE event_id % 2 = 0), b AS (SELECT report, body, min(event_id) AS first_id FROM r WHERE event_id % 2 = 1 GROUP BY ALL)
    SELECT report, body, first_id FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.report = b.report AND a.body = b.body)""")
def new_revisions(spark, d):
    """Reports of the second half whose content the first half hasn't stored; volatile columns don't count."""
    r = _t(spark, d, "events").select((F.col("user_id") % 50).alias("report"), F.concat_ws("/", "event_type", F.floor(F.col("value") / 100).cast("bigint").cast("string")).alias("body"), F.col("event_id").alias("first_id"))
    part = lambda k: r.where(F.col("first_id") % 2 == k).groupBy("report", "body").agg(F.min("first_id").alias("first_id"))
    old = report.revisions(part(0), spark.createDataFrame([], "fingerprint string"), ("first_id",))
    return report.revisions(part(1), old, ("first_id",)).select("report", "body", "first_id")


@query("""SELECT event_id, floor(epoch(date_trunc('second', ts)) / 1800)::BIGINT AS slot, round(greatest(0, least(1, value / 50 - 0.5)), 6) AS clipped, round(1 / (1 + exp(-(value - 20) / 10)), 6) AS sigmoid,
    CASE WHEN event_id % 3 = 0 THEN strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') END AS reference FROM events""")
def row_numbers(spark, d):
    e, v = _events(spark, d), F.col("value")
    return e.select("event_id", N.slot(F.col("ts"), 30).alias("slot"), F.round(N.clip(v / 50 - 0.5), 6).alias("clipped"), F.round(N.sigmoid((v - 20) / 10), 6).alias("sigmoid"), N.reference_date(F.concat(F.when(F.col("event_id") % 3 == 0, "昨天 ").otherwise(""), "event_type"), F.lit(None), F.col("ts")).alias("reference"))


@query("""WITH o AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS before, event_type FROM events),
    s AS (SELECT *, CASE WHEN before IS NULL OR date_diff('microsecond', before, ts) > 21600000000 THEN 1 ELSE 0 END AS opens FROM o),
    n AS (SELECT *, sum(opens) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS k FROM s)
    SELECT event_id::VARCHAR AS signal_id, 'new:' || first_value(event_id) OVER (PARTITION BY event_type, user_id, k ORDER BY ts, event_id) AS event_id, CASE opens WHEN 1 THEN 'create' ELSE 'merge' END AS decision, (1 - opens)::DOUBLE AS score FROM n""")
def streamed_identities(spark, d):
    """Signals that have an identity and no text, resolved as a stream: one event a session of six hours."""
    from .streaming import resolve

    rows = _events(spark, d).select(F.col("event_id").cast("string").alias("signal_id"), F.col("event_type").alias("block"), F.col("ts").alias("time"), X.empty().alias("tokens"), F.array(F.col("user_id").cast("string")).alias("ids"))
    return resolve.resolve_table(rows, keep="6 hours")


@query("""WITH k AS (SELECT event_id, ['rank_bucket', 'strength', 'freshness', 'direction', 'unheard'][1 + event_id % 5] AS kind, event_id % 30 + 1 AS rank, value / 100 AS score, event_id % 400 AS hours, (event_id % 3 - 1) / 10.0 AS change, event_id % 7 = 0 AS wrong FROM events),
    c AS (SELECT kind, CASE kind WHEN 'unheard' THEN false ELSE NOT wrong END AS ok FROM k)
    SELECT kind, count(*) AS n, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, round(count(*) FILTER (ok) / count(*)::DOUBLE, 6) AS rate FROM c GROUP BY kind""")
def evaluated_kinds(spark, d):
    """A case an event, of five kinds, one of which nobody evaluates; one expectation in seven is wrong."""
    i, v = F.col("event_id"), F.col("value")
    kind = F.element_at(F.array(*map(F.lit, ("rank_bucket", "strength", "freshness", "direction", "unheard"))), (1 + i % 5).cast("int"))
    text = lambda c: c.cast("string")
    rank, hours, score = i % 30 + 1, i % 400, v / 100
    given = F.create_map(F.lit("rank"), text(rank), F.lit("score"), text(score), F.lit("hours"), text(hours), F.lit("now"), text((i % 3) / 10.0), F.lit("before"), F.lit("0.1"))
    right = {
        "rank_bucket": F.create_map(F.lit("bucket"), F.when(rank <= 3, "top3").when(rank <= 10, "top10").when(rank <= 20, "top20").otherwise("tail")),
        "strength": F.create_map(F.lit("strength"), F.when(score >= 0.7, "strong").when(score >= 0.45, "medium").otherwise("weak")),
        "freshness": F.create_map(F.lit("bucket"), F.when(hours <= 24, "24h").when(hours <= 72, "72h").when(hours <= 168, "7d").otherwise("stale")),
        "direction": F.create_map(F.lit("trend"), F.when(i % 3 == 2, "rising").when(i % 3 == 0, "cooling").otherwise("stable")),
    }
    want = F.create_map(F.lit("any"), F.lit("thing"))
    for name, m in right.items():
        want = F.when(kind == name, m).otherwise(want)
    expected = F.when(i % 7 == 0, F.transform_values(want, lambda k, x: F.concat(x, F.lit("!")))).otherwise(want)
    return evaluate.evaluated(_t(spark, d, "events").select(i.alias("case_id"), kind.alias("kind"), given.alias("input"), expected.alias("expected")))


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '(?i)(authorization|cookie|token|secret|password|api[_-]?key)("?[\s\x0B]*[:=][\s\x0B]*"?)[^\s\x0B",;]+', '\1\2***', 'g'), '(?i)bearer[\s\x0B]+[A-Za-z0-9._-]+', 'Bearer ***', 'g')) AS redacted,
    sha256(regexp_replace(text, '[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]|\[[^\[\]\s\x0B]{1,8}\]', '', 'g')) AS without_emoji FROM documents""")
def redacted_texts(spark, d):
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return _t(spark, d, "documents").select("doc_id", sha(X.redact(F.col("text"))).alias("redacted"), sha(X.strip_emoji(F.col("text"))).alias("without_emoji"))


@query(r"""WITH t AS (SELECT doc_id, lang, text, trim(regexp_replace(regexp_extract(coalesce(text, ''), '^\s*([^.!?。！？\n]*)', 1), '\s+', ' ', 'g')) AS title FROM documents),
    w AS (SELECT *, list_concat(list_distinct([]::VARCHAR[]), regexp_extract_all(title, '#([^#\s]+)#?', 1), regexp_extract_all(title, '[《「『“"'']([^》」』”"'']{2,30})[》」』”"'']', 1), regexp_split_to_array(title, '[\s,，。.!！？?;；:：、/\\|()\[\]{}<>《》「」『』“”"''`~]+')) AS raw FROM t),
    k AS (SELECT *, list_transform(raw, lambda x: trim(x, ' #，。！？!?;；:：、/\|()[]{}<>《》「」『』“”"''`~')) AS terms FROM w),
    f AS (SELECT *, list_filter(terms, lambda x, i: x <> '' AND list_position(terms, x) = i)[1:8] AS kw FROM k)
    SELECT doc_id, array_to_string(kw, '|') AS keywords, round(CASE WHEN len(kw) > 0 THEN len(list_filter(kw, lambda x: contains(text, x))) / len(kw) ELSE 0 END, 6)::DOUBLE AS overlap,
           CASE WHEN lang = 'en' THEN 'missing_url' ELSE '' END || CASE WHEN lang = 'en' AND title = '' THEN ',' ELSE '' END || CASE WHEN title = '' THEN 'missing_title' ELSE '' END AS flags FROM f""")
def title_keywords(spark, d):
    """Keywords of every document's title, how many of them its text has, and what the row lacks."""
    t = _t(spark, d, "documents").select("doc_id", "lang", "text", _title().alias("title"))
    t = t.withColumn("kw", X.keywords(F.col("title")))
    flags = normalize.quality_flags({"url": F.when(F.col("lang") != "en", "u"), "title": F.col("title")})
    return t.select("doc_id", F.array_join("kw", "|").alias("keywords"), F.round(X.term_overlap(F.col("kw"), F.col("text")), 6).alias("overlap"), F.array_join(flags, ",").alias("flags"))


@query("""WITH e AS (SELECT *, user_id AS u, 'c' || event_id % 40 AS ctx, event_id % 3 = 0 AS ex FROM events),
    c AS (SELECT u, ctx, max(ex) AS ex FROM e GROUP BY ALL),
    j AS (SELECT u, substr(string_agg(ctx, chr(10) ORDER BY CASE WHEN ex THEN 0 ELSE 1 END, ctx), 1, 1200) AS context FROM c GROUP BY u),
    o AS (SELECT user_id, list(event_id ORDER BY ts, event_id) AS ids FROM events GROUP BY 1)
    SELECT c_custkey AS event_id, coalesce(context, '') AS context, coalesce(array_to_string(list_filter(CASE WHEN len(ids) > 2 THEN [ids[1], ids[-2], ids[-1]] ELSE ids END, lambda x: x IS NOT NULL), ','), '') AS documents
    FROM customer LEFT JOIN j ON u = c_custkey LEFT JOIN o ON user_id = c_custkey""")
def event_contexts(spark, d):
    """What a candidate event brings to matching: its contexts, excerpts first, and its first and latest documents."""
    e, i = _events(spark, d), F.col("event_id")
    customers = _t(spark, d, "customer").select(F.col("c_custkey").alias("event_id"))
    contexts = e.select(F.col("user_id").alias("event_id"), F.concat(F.lit("c"), (i % 40).cast("string")).alias("text"), (i % 3 == 0).alias("has_excerpt"))
    one = contexts.groupBy("event_id", "text").agg(F.max("has_excerpt").alias("has_excerpt"))
    documents = e.groupBy(F.col("user_id").alias("event_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"].cast("string")).alias("ids"))
    out = filters.candidate_context(customers, one).join(documents, "event_id", "left")
    return out.select("event_id", "context", F.coalesce(F.array_join(filters.representatives(F.col("ids")), ","), F.lit("")).alias("documents"))


@query("""WITH p AS (SELECT user_id AS cid, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1)
    SELECT e.event_id AS child_id, p.event_id FROM events e JOIN p ON p.cid = e.user_id WHERE e.event_type = 'click' AND (e.event_id % 4 <> 0 OR e.event_id % 8 = 0)""")
def reattached_children(spark, d):
    """Children of decided questions that nobody else owns."""
    e, i = _t(spark, d, "events"), F.col("event_id")
    decided = e.where("event_type = 'view'").groupBy(F.col("user_id").alias("canonical_id")).agg(F.max("event_id").alias("event_id"))
    own = decided.withColumnRenamed("event_id", "own")
    children = e.where("event_type = 'click'").join(own, F.col("user_id") == F.col("canonical_id"), "left").select(i.alias("child_id"), F.col("user_id").alias("canonical_id"), F.when(i % 8 == 0, F.col("own")).when(i % 4 == 0, F.lit(-1).cast("bigint")).alias("owner_event_id"))
    return filters.reattach(children, decided)


@query("""WITH r AS (SELECT user_id % 60 AS run_id, max(event_id) AS report_id FROM events GROUP BY 1)
    SELECT run_id, report_id, (SELECT count(*) FROM events e WHERE e.user_id % 60 = r.run_id) AS revisions FROM r ORDER BY run_id DESC LIMIT 20 OFFSET 5""")
def report_page(spark, d):
    """One page of the latest revision of every run (the limit is the page)."""
    e = _t(spark, d, "events").select((F.col("user_id") % 60).alias("run_id"), F.col("event_id").alias("report_id"))
    last = report.latest_by(e, ["run_id"], "report_id").join(e.groupBy("run_id").agg(F.count("*").alias("revisions")), "run_id")
    return report.page(last, 20, 5, F.desc("run_id"))


@query("""WITH t AS (SELECT event_id AS task_id, ['run' || user_id % 90, 'run' || event_id % 70] AS runs, event_type AS review_type, event_id % 3 = 0 AS pending FROM events), s AS (SELECT 'run' || c_custkey AS run FROM customer WHERE c_custkey % 9 = 0)
    SELECT review_type, count(*) AS n, count(*) FILTER (pending) AS pending FROM t WHERE len(list_intersect(runs, (SELECT list(run) FROM s))) > 0 GROUP BY review_type""")
def scoped_reviews(spark, d):
    i, run = F.col("event_id"), lambda c: F.concat(F.lit("run"), c.cast("string"))
    tasks = _t(spark, d, "events").select(i.alias("task_id"), F.array(run(F.col("user_id") % 90), run(i % 70)).alias("run_ids"), F.col("event_type").alias("review_type"), F.when(i % 3 == 0, "pending").otherwise("done").alias("status"))
    return review.queue(tasks, _t(spark, d, "customer").where("c_custkey % 9 = 0").select(run(F.col("c_custkey")).alias("run_id")))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS observations FROM events GROUP BY event_type""")
def streamed_observations(spark, d):
    """Observations that each come twice, in two files of a stream: replays are dropped."""
    from .streaming import rounds

    base = new_path(spark, "observations")
    rows = _events(spark, d).select("event_id", F.col("event_id").alias("observation_id"), F.col("ts").alias("observed_at"), "event_type")
    for k in range(2):
        rows.write.parquet(f"{base}/in/part={k}")
    source = spark.readStream.schema(rows.schema).parquet(f"{base}/in/*")
    rounds.distinct_observations(source, "90 days").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(rows.schema).parquet(f"{base}/out")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("observations"))
