"""Queries of the event engine over the driver's tables, each with the same in DuckDB's SQL.

The tables stand in for the engine's own: an ``events`` row is an observation of event
``user_id`` on one of two platforms, with attributes that its id decides.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import identity as I
from .functions import numbers as N
from .functions import text as X
from .operators import classify, evaluate, filters, guardrails, heat, match, normalize, observe, official, report, retrieve, review, trend
from .plans import briefing, resolution, round_record, window_report
from .sources import readers, writers
from .sources.shared import new_path

END = datetime(2024, 1, 20)
START = datetime(2024, 1, 10)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _utc(c: str):
    return F.col(c).cast("timestamp")


OBS = """obs AS (
    SELECT user_id AS event_id, CASE WHEN event_type IN ('view', 'click') THEN 'zhihu' ELSE 'weibo' END AS platform,
           event_id AS observation_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS run_id, ts AS observed_at,
           CASE WHEN event_id % 17 = 0 THEN 'failed' ELSE 'succeeded' END AS collection_status, event_id % 11 <> 0 AS list_complete,
           CASE WHEN event_id % 23 = 0 THEN 'top20' ELSE 'top30' END AS topn_scope,
           CASE WHEN event_id % 13 = 0 THEN false WHEN event_id % 19 = 0 THEN NULL ELSE true END AS present,
           CASE WHEN event_type IN ('view', 'click') AND event_id % 13 <> 0 AND event_id % 19 <> 0 THEN CAST(1 + event_id % 30 AS BIGINT) END AS rank,
           value / (value + 100) AS score, CASE WHEN event_id % 2 = 0 AND event_type IN ('view', 'click') THEN value * 1000 END AS native_heat,
           CAST(floor(value) AS BIGINT) AS activity, CASE WHEN event_id % 29 = 0 THEN 'c2' ELSE 'c1' END AS component_signature,
           CASE WHEN event_id % 37 = 0 THEN 'rss_presence_only' ELSE 'samples' END AS score_basis, CASE WHEN event_id % 41 = 0 THEN 'unknown' ELSE 'ok' END AS score_status,
           CASE WHEN event_id % 43 = 0 THEN 'sampling_changed' WHEN event_id % 7 <> 0 THEN 'x' END AS flag
    FROM events)"""


def observations(spark: SparkSession, d: str) -> DataFrame:
    i, qa = F.col("event_id"), F.col("event_type").isin("view", "click")
    return _t(spark, d, "events").select(
        F.col("user_id").alias("event_id"), F.when(qa, "zhihu").otherwise("weibo").alias("platform"), i.alias("observation_id"), F.floor(F.unix_seconds(_utc("ts")) / 3600).alias("run_id"), _utc("ts").alias("observed_at"),
        F.when(i % 17 == 0, "failed").otherwise("succeeded").alias("collection_status"), (i % 11 != 0).alias("list_complete"), F.when(i % 23 == 0, "top20").otherwise("top30").alias("topn_scope"),
        F.when(i % 13 == 0, False).when(i % 19 != 0, True).alias("present"), F.when(qa & (i % 13 != 0) & (i % 19 != 0), 1 + i % 30).alias("rank"), (F.col("value") / (F.col("value") + 100)).alias("score"),
        F.when(qa & (i % 2 == 0), F.col("value") * 1000).alias("native_heat"), F.floor("value").alias("activity"), F.lit("v1").alias("config_version"), F.lit("s").alias("sampling_signature"),
        F.when(i % 29 == 0, "c2").otherwise("c1").alias("component_signature"), F.when(i % 37 == 0, "rss_presence_only").otherwise("samples").alias("score_basis"), F.when(i % 41 == 0, "unknown").otherwise("ok").alias("score_status"), F.when((i % 43 == 0) | (i % 7 != 0), F.array(F.when(i % 43 == 0, "sampling_changed").otherwise("x"))).alias("flags"),
    )


HEAT = """h AS (
    SELECT user_id AS event_id, event_id AS item_id, CASE WHEN event_type IN ('view', 'click') THEN 'zhihu' ELSE 'weibo' END AS platform,
           1 + event_id % 30 AS rank, CASE WHEN event_id % 5 = 0 THEN value * 100000 END AS native_heat, 1 + event_id % 4 AS seen,
           ['rising', 'stable', 'falling', 'unknown'][1 + event_id % 4] AS rank_delta, floor(value) AS votes,
           CASE WHEN event_id % 7 <> 0 THEN event_id % 50 END AS comments, event_id % 6 = 0 AS native, event_id % 9 = 0 AS search_only,
           event_id % 8 <> 0 AS topic_present, floor(value * 10) AS search_total, event_id % 20 AS matched, event_id % 200 AS sample_age_hours,
           CASE WHEN event_id % 10 <> 0 THEN event_id % 1000 END AS reposts, event_id % 2 = 0 AS seed, event_id % 3 <> 0 AS has_samples,
           event_id % 31 = 0 AS low_relevance, event_id % 12 AS age_hours FROM events),
p AS (
    SELECT *, CASE WHEN NOT search_only THEN greatest(0, least(1, 1 - (rank - 1) / 20.0::DOUBLE)) END AS s_rank, least(1, seen / 3.0::DOUBLE) AS s_seen,
           CASE WHEN seen > 1 THEN CASE rank_delta WHEN 'rising' THEN 1.0 WHEN 'stable' THEN 0.6 WHEN 'falling' THEN 0.3 END END::DOUBLE AS s_delta,
           least(1, ln(1 + votes + coalesce(comments, 0)) / ln(10001::DOUBLE)) AS s_act,
           CASE WHEN topic_present THEN least(1, 0.5 + least(0.3, 0.1 * seen) + CASE WHEN rank <= 3 THEN 0.2 WHEN rank <= 10 THEN 0.15 WHEN rank <= 20 THEN 0.1 ELSE 0.05 END) END::DOUBLE AS s_topic,
           least(1, (0.5 * least(1, ln(1 + search_total) / ln(100001::DOUBLE)) + 0.3 * least(1, ln(1 + matched) / ln(51::DOUBLE))
             + 0.2 * CASE WHEN sample_age_hours <= 6 THEN 1 WHEN sample_age_hours <= 24 THEN 0.8 WHEN sample_age_hours <= 72 THEN 0.5 WHEN sample_age_hours <= 168 THEN 0.25 ELSE 0.1 END)) AS s_content,
           CASE WHEN reposts IS NOT NULL THEN least(1, ln(1 + reposts) / ln(10001::DOUBLE)) END AS s_inter FROM h),
w AS (
    SELECT *, (0.5 * coalesce(s_rank, 0) + 0.2 * s_seen + 0.15 * coalesce(s_delta, 0) + 0.15 * s_act)
              / (CASE WHEN s_rank IS NULL THEN 0 ELSE 0.5 END + 0.2 + CASE WHEN s_delta IS NULL THEN 0 ELSE 0.15 END + 0.15) AS own,
           (0.4 * coalesce(s_topic, 0) + 0.35 * s_content + 0.25 * coalesce(s_inter, 0))
              / (CASE WHEN s_topic IS NULL THEN 0 ELSE 0.4 END + 0.35 + CASE WHEN s_inter IS NULL THEN 0 ELSE 0.25 END) AS full_ FROM p),
scored AS (
    SELECT event_id, item_id, platform, native_heat,
           CASE WHEN platform = 'zhihu' THEN CASE WHEN native_heat IS NOT NULL THEN native_heat / (native_heat + 1e7) WHEN native THEN s_rank ELSE own END
                WHEN low_relevance THEN NULL WHEN seed AND NOT has_samples THEN 0.2 * (0.6 + 0.4 * least(seen, 5) / 5) * pow(2, -age_hours / 2.0::DOUBLE)
                WHEN seed AND has_samples THEN greatest(full_, 0.3) ELSE full_ END AS score,
           CASE WHEN platform = 'zhihu' THEN CASE WHEN native_heat IS NOT NULL THEN 'native_heat' ELSE 'rank' END
                WHEN seed AND NOT has_samples THEN 'rss_presence_only' ELSE 'samples' END AS basis,
           CASE WHEN platform = 'zhihu' THEN CASE WHEN native_heat IS NOT NULL THEN 'ok' WHEN native THEN CASE WHEN s_rank IS NULL THEN 'unknown' ELSE 'partial' END ELSE 'ok' END
                WHEN low_relevance THEN 'unknown' WHEN seed AND has_samples THEN 'ok' ELSE 'partial' END AS score_status FROM w)"""


def heat_signals(spark: SparkSession, d: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    return _t(spark, d, "events").select(
        F.col("user_id").alias("event_id"), i.alias("item_id"), F.when(F.col("event_type").isin("view", "click"), "zhihu").otherwise("weibo").alias("platform"), (1 + i % 30).alias("rank"), F.when(i % 5 == 0, v * 100000).alias("native_heat"),
        (1 + i % 4).alias("seen"), F.element_at(F.array(*map(F.lit, ("rising", "stable", "falling", "unknown"))), (1 + i % 4).cast("int")).alias("rank_delta"), F.floor(v).alias("votes"), F.when(i % 7 != 0, i % 50).alias("comments"),
        F.when(i % 6 == 0, "native").alias("provider"), (i % 9 == 0).alias("search_only"), (i % 8 != 0).alias("topic_present"), F.floor(v * 10).alias("search_total"), (i % 20).alias("matched"), (i % 200).alias("sample_age_hours"),
        F.when(i % 10 != 0, i % 1000).alias("reposts"), F.lit(None).cast("bigint").alias("status_comments"), F.lit(None).cast("bigint").alias("likes"), (i % 2 == 0).alias("seed"), (i % 3 != 0).alias("has_samples"), (i % 31 == 0).alias("low_relevance"), (i % 12).alias("age_hours"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(c: str):
    return F.round(c, 6).alias(c)


@query(f"WITH {HEAT} SELECT item_id, platform, round(score, 6) AS score, basis, score_status FROM scored")
def heat_signal_scores(spark, d):
    return heat.signal_scores(heat_signals(spark, d)).select("item_id", "platform", _r("score"), "basis", "score_status")


@query(f"""WITH {HEAT}, a AS (
    SELECT event_id, platform, max(score) AS best, count(score) AS n, max(score) FILTER (basis = 'samples') AS best_s, count(score) FILTER (basis = 'samples') AS n_s,
           max(native_heat) FILTER (basis = 'native_heat') AS native, bool_or(score_status = 'ok') AS ok, bool_and(basis = 'rss_presence_only') AS feeds
    FROM scored GROUP BY ALL),
b AS (SELECT *, CASE WHEN best IS NULL THEN NULL WHEN native IS NOT NULL THEN native / (native + 1e7) WHEN n_s > 0 THEN least(1, best_s + 0.05 * least(3, n_s - 1)) WHEN feeds THEN best ELSE least(1, best + 0.05 * least(3, n - 1)) END AS score FROM a)
SELECT event_id, platform, round(score, 6) AS score, CASE WHEN score IS NULL THEN 'unknown' WHEN ok THEN 'ok' ELSE 'partial' END AS status, n AS members,
       CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 0.7 THEN 'strong' WHEN score >= 0.45 THEN 'medium' ELSE 'weak' END AS strength FROM b""")
def heat_aggregate(spark, d):
    return heat.aggregate(heat.signal_scores(heat_signals(spark, d))).select("event_id", "platform", _r("score"), "status", "members", "strength")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'unknown' WHEN o_orderkey % 50 <= 3 THEN 'top3' WHEN o_orderkey % 50 <= 10 THEN 'top10' WHEN o_orderkey % 50 <= 20 THEN 'top20' ELSE 'tail' END AS bucket,
    round(CASE WHEN o_orderkey % 50 > 0 THEN greatest(0, least(1, 1 - (o_orderkey % 50 - 1) / 20.0::DOUBLE)) END, 6) AS score, round(ln(1 + o_totalprice) / ln(1000001::DOUBLE), 6) AS log_score FROM orders""")
def rank_bucket_strength(spark, d):
    r = F.nullif(F.col("o_orderkey") % 50, F.lit(0))
    return _t(spark, d, "orders").select("o_orderkey", N.rank_bucket(r).alias("bucket"), F.round(N.rank_score(r), 6).alias("score"), F.round(N.log_score(F.col("o_totalprice"), 1e6), 6).alias("log_score"))


@query("""WITH a AS (SELECT event_id, date_diff('microsecond', ts, TIMESTAMP '2024-01-31') / 3.6e9 AS h FROM events)
SELECT event_id, CASE WHEN h <= 6 THEN 1.0 WHEN h <= 24 THEN 0.8 WHEN h <= 72 THEN 0.5 WHEN h <= 168 THEN 0.25 ELSE 0.1 END::DOUBLE AS freshness,
       CASE WHEN h <= 24 THEN '24h' WHEN h <= 72 THEN '72h' WHEN h <= 168 THEN '7d' ELSE 'stale' END AS bucket, round(0.2 * (0.6 + 0.4 * least(1 + event_id % 7, 5) / 5) * pow(2, -h / 100), 6) AS decay FROM a""")
def freshness_decay(spark, d):
    h = N.hours_between(F.lit(datetime(2024, 1, 31)), _utc("ts"))
    return _t(spark, d, "events").select("event_id", N.freshness_score(h).alias("freshness"), N.freshness_bucket(h).alias("bucket"), F.round(N.rss_decay(1 + F.col("event_id") % 7, h, half_life=100.0), 6).alias("decay"))


@query(f"""WITH {OBS} SELECT event_id, platform, count(DISTINCT run_id) AS rounds FROM obs
WHERE present AND observed_at > TIMESTAMP '2024-01-19' AND observed_at <= TIMESTAMP '2024-01-20' GROUP BY ALL""")
def presence_distinct_rounds(spark, d):
    return observe.distinct_rounds(observations(spark, d), F.lit(END))


def _pair(obs: str) -> str:
    """The rule of the latest pair, over a table of observations: obs, ..., tr."""
    return f"""{obs}, l AS (
    SELECT *, lag(observed_at) OVER w AS p_at, lag(present) OVER w AS p_present, lag(collection_status) OVER w AS p_status, lag(list_complete) OVER w AS p_complete, lag(topn_scope) OVER w AS p_scope,
           lag(rank) OVER w AS p_rank, lag(score) OVER w AS p_score, lag(native_heat) OVER w AS p_heat, lag(activity) OVER w AS p_act, lag(component_signature) OVER w AS p_comp,
           lag(score_basis) OVER w AS p_basis, lag(score_status) OVER w AS p_known, lag(flag) OVER w AS p_flag,
           row_number() OVER (PARTITION BY event_id, platform ORDER BY observed_at DESC, observation_id DESC) AS n
    FROM obs WINDOW w AS (PARTITION BY event_id, platform ORDER BY observed_at, observation_id)),
u AS (
    SELECT *, component_signature = p_comp AND score_basis = p_basis AND coalesce(flag, '') <> 'sampling_changed' AND coalesce(p_flag, '') <> 'sampling_changed' AND score_status <> 'unknown' AND p_known <> 'unknown'
              AND score IS NOT NULL AND p_score IS NOT NULL AS comp,
           activity IS NOT NULL AND p_act IS NOT NULL AND score_basis <> 'rss_presence_only' AND p_basis <> 'rss_presence_only' AS active FROM l WHERE n = 1),
v AS (
    SELECT *, CASE WHEN p_at IS NULL THEN 'insufficient_history' WHEN NOT (coalesce(present, false) AND coalesce(p_present, false)) THEN 'insufficient_trend_metrics'
         WHEN NOT (collection_status = 'succeeded' AND p_status = 'succeeded' AND list_complete AND p_complete) THEN 'incomplete_list'
         WHEN date_diff('microsecond', p_at, observed_at) / 6e7 > 1440 THEN 'observation_gap' WHEN topn_scope <> p_scope THEN 'incomparable_scope'
         WHEN platform = 'zhihu' AND (native_heat IS NOT NULL OR p_heat IS NOT NULL) THEN CASE WHEN native_heat IS NULL OR p_heat IS NULL OR NOT comp THEN 'incomparable_scores' END
         WHEN platform = 'zhihu' AND rank IS NOT NULL AND p_rank IS NOT NULL THEN NULL
         WHEN platform = 'weibo' AND NOT active THEN 'insufficient_trend_metrics' WHEN NOT comp THEN 'incomparable_scores'
         WHEN platform = 'weibo' AND activity = p_act THEN 'incomparable_scores' END AS reason FROM u),
vb AS (
    SELECT *, CASE WHEN reason IS NOT NULL THEN NULL WHEN platform = 'zhihu' AND native_heat IS NOT NULL THEN 'native_heat' WHEN platform = 'zhihu' AND rank IS NOT NULL AND p_rank IS NOT NULL THEN 'rank' ELSE 'score' END AS basis FROM v),
x AS (
    SELECT *, CASE basis WHEN 'native_heat' THEN CASE WHEN p_heat > 0 THEN (native_heat - p_heat) / p_heat WHEN native_heat > 0 THEN 1 ELSE 0 END WHEN 'rank' THEN p_rank - rank WHEN 'score' THEN score - p_score END AS delta,
           CASE basis WHEN 'rank' THEN 1 ELSE 0.05 END AS lim FROM vb),
tr AS (SELECT event_id, platform, round(delta, 6)::DOUBLE AS delta, basis, CASE WHEN delta IS NULL THEN 'unknown' WHEN delta >= lim THEN 'rising' WHEN delta <= -lim THEN 'cooling' ELSE 'stable' END AS trend, reason FROM x)"""


def _wide():
    from .config import TrendConfig

    return TrendConfig(expected_interval_minutes=720)


@query(f"WITH {_pair(OBS)} SELECT * FROM tr")
def trend_latest_pair(spark, d):
    return trend.latest_pair(observations(spark, d), _wide()).withColumn("delta", F.round("delta", 6))


@query(f"""WITH {OBS}, g AS (
    SELECT *, coalesce(present, false) AND collection_status = 'succeeded' AND list_complete AS good FROM obs),
j AS (
    SELECT *, CASE WHEN good AND coalesce(lag(good) OVER w, false) AND date_diff('microsecond', lag(observed_at) OVER w, observed_at) / 6e7 <= 1440 AND lag(topn_scope) OVER w = topn_scope THEN 0 ELSE 1 END AS brk
    FROM g WINDOW w AS (PARTITION BY event_id, platform ORDER BY observed_at, observation_id)),
i AS (
    SELECT *, coalesce(sum(brk) OVER (PARTITION BY event_id, platform ORDER BY observed_at DESC, observation_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM j)
SELECT event_id, platform, count(*) AS rows, round(least(1440, date_diff('microsecond', min(observed_at), max(observed_at)) / 6e7), 6)::DOUBLE AS minutes
FROM i WHERE island = 0 AND good GROUP BY ALL""")
def continuous_segment(spark, d):
    return trend.continuous_segment(observations(spark, d), _wide()).withColumn("minutes", F.round("minutes", 6))


@query(f"""WITH {OBS}, m AS (SELECT * FROM obs WHERE collection_status = 'succeeded' AND list_complete)
SELECT o.observation_id, m.observation_id AS last_observation_id, m.rank AS last_rank
FROM (SELECT *, row_number() OVER (PARTITION BY event_id, platform, observed_at ORDER BY observation_id DESC) AS k FROM m) m
RIGHT JOIN (SELECT o.event_id, o.platform, o.observation_id, (SELECT max(m.observed_at) FROM m WHERE m.event_id = o.event_id AND m.platform = o.platform AND m.observed_at < o.observed_at) AS at FROM obs o) o
ON m.event_id = o.event_id AND m.platform = o.platform AND m.observed_at = o.at AND m.k = 1""")
def last_prior_observation(spark, d):
    o = observations(spark, d)
    main = o.where("collection_status = 'succeeded' and list_complete").select("event_id", "platform", "observed_at", "observation_id", "rank")
    main = report.latest_by(main, ["event_id", "platform", "observed_at"], "observation_id")
    points = o.select("event_id", "platform", "observed_at", "observation_id")
    return observe.last_before(points, main, ["event_id", "platform"]).select("observation_id", "last_observation_id", "last_rank")


@query(f"""WITH {OBS}, e AS (SELECT DISTINCT event_id, platform FROM obs),
r AS (SELECT DISTINCT CAST(floor(epoch(observed_at) / 86400) AS BIGINT) AS round_id FROM obs),
x AS (SELECT round_id, p.platform, round_id % 5 <> 0 AS succeeded, round_id % 7 <> 0 AS complete, CASE WHEN round_id % 11 = 0 THEN 'b' ELSE 'a' END AS scope FROM r CROSS JOIN (SELECT unnest(['zhihu', 'weibo']) AS platform) p),
y AS (SELECT *, coalesce(lag(scope) OVER (PARTITION BY platform ORDER BY round_id) = scope, true) AS same FROM x),
h AS (SELECT DISTINCT event_id, platform, CAST(floor(epoch(observed_at) / 86400) AS BIGINT) AS round_id FROM obs)
SELECT e.event_id, e.platform, y.round_id, CASE WHEN h.event_id IS NOT NULL AND succeeded THEN true WHEN h.event_id IS NULL AND succeeded AND complete AND same THEN false END AS present
FROM e JOIN y ON e.platform = y.platform LEFT JOIN h ON h.event_id = e.event_id AND h.platform = e.platform AND h.round_id = y.round_id""")
def round_presence_matrix(spark, d):
    o = observations(spark, d).withColumn("day", F.floor(F.unix_seconds("observed_at") / 86400))
    name = F.concat_ws(":", "platform", "day")
    n = F.col("day")
    platforms = F.explode(F.array(F.lit("zhihu"), F.lit("weibo"))).alias("platform")
    rounds = o.select("day").distinct().select("day", platforms).select("day", "platform", name.alias("round_id"), F.timestamp_seconds(n * 86400).alias("observed_at"), (n % 5 != 0).alias("succeeded"), (n % 7 != 0).alias("complete"), F.when(n % 11 == 0, "b").otherwise("a").alias("scope"))
    m = observe.presence_matrix(o.select("event_id", "platform").distinct(), rounds, o.select("event_id", name.alias("round_id")))
    return m.select("event_id", "platform", F.col("day").alias("round_id"), "present")


@query(f"""WITH {OBS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, platform ORDER BY observed_at DESC, observation_id DESC) AS n FROM obs) WHERE n = 1)
SELECT event_id, platform, category, row_number() OVER (PARTITION BY platform, category ORDER BY CASE WHEN present THEN 0 ELSE 1 END, CASE WHEN platform = 'zhihu' THEN rank END NULLS LAST, score DESC NULLS LAST, duration_minutes DESC, event_id) AS place
FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'A_x' WHEN 1 THEN 'C_x' ELSE 'E_x' END AS category, CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 90 END AS duration_minutes FROM l)""")
def platform_rank_order(spark, d):
    last = report.latest_by(observations(spark, d), ["event_id", "platform"], "observed_at", "observation_id")
    k = F.col("event_id")
    last = last.withColumns({"category": F.when(k % 3 == 0, "A_x").when(k % 3 == 1, "C_x").otherwise("E_x"), "duration_minutes": F.when(k % 4 != 0, (k % 90).cast("double"))})
    return trend.platform_ranking(last).select("event_id", "platform", "category", "place")


@query(r"""WITH d AS (SELECT doc_id, lang, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS title FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256(lang || '|external|' || doc_id) WHEN doc_id % 3 = 1 THEN sha256(lang || '|url|https://x.org/' || doc_id) ELSE sha256(lang || '|title_date|' || title || '|2024-01-01') END AS content_hash FROM d""")
def content_hash_cascade(spark, d):
    i = F.col("doc_id")
    title = F.trim(F.regexp_replace("text", r"\s+", " "))
    return _t(spark, d, "documents").select("doc_id", I.item_hash(F.col("lang"), F.when(i % 3 == 0, i), F.when(i % 3 == 1, F.concat(F.lit("https://x.org/"), i.cast("string"))), title, F.lit(datetime(2024, 1, 1)), F.lit(None)).alias("content_hash"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^https?://(?:[^/@?#]*@)?([^/:?#]+)', 1)) AS host, nullif(regexp_replace(lower(trim(url)), '/+$', ''), '') AS url_key, coalesce(regexp_matches(url, '^https?://[^/\s]+'), false) AS safe FROM pages""")
def url_parts(spark, d):
    u = F.col("url")
    return _t(spark, d, "pages").select("page_id", I.host(u).alias("host"), I.url_key(u).alias("url_key"), I.safe_url(u).alias("safe"))


#: References as SQL replaces them; the ampersand's comes last, with or without its semicolon.
_REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&apos;": "''", "&nbsp;": "\u00a0", "&hellip;": "…", "&ldquo;": "“", "&rdquo;": "”", "&mdash;": "—", "&ndash;": "–", "&copy;": "©", "&middot;": "·"}
_UNESCAPED = "html"
for _name, _char in _REFERENCES.items():
    _UNESCAPED = f"replace({_UNESCAPED}, '{_name}', '{_char}')"
_UNESCAPED = f"regexp_replace({_UNESCAPED}, '&amp;?', '&', 'g')"


@query(f"""SELECT page_id, sha256(replace(regexp_replace({_UNESCAPED}, '<[^>]+>', ' ', 'g'), chr(160), ' ')) AS digest FROM pages""")
def html_strip(spark, d):
    return _t(spark, d, "pages").select("page_id", F.sha2(F.encode(X.strip_html(F.col("html")), "UTF-8"), 256).alias("digest"))


@query()
def article_extraction(spark, d):
    a = readers.articles(_t(spark, d, "pages"))
    return a.select("page_id", "title", "body", "published_raw", "problem", readers.extract_summary(F.col("title"), F.col("body")).alias("summary"))


_TOK = "regexp_extract_all(lower(coalesce({0}, '')), '([a-z0-9]+|[一-鿿]+)')"


@query(f"""SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY term""")
def lexical_tokens_df(spark, d):
    return retrieve.postings(_t(spark, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


_BM25 = f"""q AS (SELECT item_id, unnest(list_distinct({_TOK.format('text')})) AS term FROM benchmark),
d AS (SELECT doc_id, {_TOK.format('text')} AS w FROM documents),
t AS (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM d), tf AS (SELECT doc_id, term, any_value(len) AS len, count(*) AS tf FROM t GROUP BY doc_id, term),
f AS (SELECT term, count(*) AS df FROM tf GROUP BY term), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
sc AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))) AS score
       FROM q JOIN tf USING (term) JOIN f USING (term) CROSS JOIN s GROUP BY item_id, doc_id)"""


@query(f"WITH {_BM25} SELECT item_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS n FROM sc) WHERE n <= 10")
def bm25_topk(spark, d):
    return retrieve.bm25_top_k(_t(spark, d, "benchmark"), _t(spark, d, "documents"), "item_id", "doc_id", "text", "text", 10).select("item_id", "doc_id", _r("score"))


@query(f"""WITH {_BM25}, r AS (SELECT s.item_id, s.doc_id, source, score, row_number() OVER (PARTITION BY s.item_id, source ORDER BY round(score, 9) DESC, s.doc_id) AS n FROM sc s JOIN documents USING (doc_id))
SELECT item_id, doc_id, source, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM r WHERE n <= 2) WHERE rank <= 8""")
def capped_retrieval(spark, d):
    s = retrieve.bm25_top_k(_t(spark, d, "benchmark"), _t(spark, d, "documents"), "item_id", "doc_id", "text", "text", 2, per="source")
    return retrieve.capped(s, "source", 2, 8, "item_id", F.desc(F.round("score", 9)), F.asc("doc_id")).select("item_id", "doc_id", "source", "rank")


_DENSE = """e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
dn AS (SELECT a.vec_id AS query_id, b.vec_id, greatest(-1, least(1, list_dot_product(a.v, b.v))) AS score FROM e a, e b WHERE a.vec_id % 20 = 0)"""


def _dense(spark, d):
    e = _t(spark, d, "embeddings")
    return retrieve.dense_top_k(e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), e, "query_id", "vec_id", "embedding", 10)


@query(f"WITH {_DENSE} SELECT query_id, vec_id, CAST(n AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM dn) WHERE n <= 10")
def dense_topk(spark, d):
    return _dense(spark, d).select("query_id", "vec_id", "rank", _r("score"))


@query(f"""WITH {_DENSE}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM dn),
b AS (SELECT query_id, vec_id, n FROM a WHERE n <= 10), c AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY abs(vec_id - query_id), vec_id) AS n FROM dn WHERE abs(vec_id - query_id) <= 5)
SELECT query_id, vec_id, round(sum(1.0::DOUBLE / (60 + n)), 6) AS score FROM (SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY ALL""")
def rank_fusion(spark, d):
    ids = _t(spark, d, "embeddings").select("vec_id")
    near = ids.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.col("vec_id") - 5, F.col("vec_id") + 5)).alias("vec_id")).join(ids, "vec_id")
    near = retrieve.top_k(near, ["query_id"], 11, F.abs(F.col("vec_id") - F.col("query_id")), F.asc("vec_id"))
    return retrieve.reciprocal_ranks(_dense(spark, d), near, by=["query_id", "vec_id"]).select("query_id", "vec_id", _r("score"))


@query("""SELECT lang, source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id DESC) AS n FROM documents) WHERE n = 1""")
def latest_wins(spark, d):
    return report.latest_by(_t(spark, d, "documents").select("lang", "source", "doc_id", "n_chars"), ["lang", "source"], "n_chars", "doc_id")


_CASES = """c AS (SELECT doc_id, lang, quality = 1 AS label, n_chars > 600 AS predicted FROM labels JOIN documents USING (doc_id)),
k AS (SELECT lang, count(*) FILTER (label AND predicted) AS tp, count(*) FILTER (NOT label AND predicted) AS fp, count(*) FILTER (label AND NOT predicted) AS fn, count(*) FILTER (NOT label AND NOT predicted) AS tn FROM c GROUP BY lang)"""


def _cases(spark, d):
    return _t(spark, d, "labels").join(_t(spark, d, "documents"), "doc_id").select("doc_id", "lang", (F.col("quality") == 1).alias("label"), (F.col("n_chars") > 600).alias("predicted"))


@query(f"""WITH {_CASES} SELECT *, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1, round((tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE, 6) AS accuracy FROM k""")
def confusion_matrix(spark, d):
    return evaluate.confusion(_cases(spark, d), F.col("label"), F.col("predicted"), ["lang"])


@query(f"""WITH {_CASES} SELECT lang, predicted, count(*) AS n, count(*) FILTER (label = predicted) AS passed FROM c GROUP BY GROUPING SETS ((lang), (predicted), ())""")
def evaluation_summary(spark, d):
    return evaluate.summary(_cases(spark, d).withColumn("passed", F.col("label") == F.col("predicted")), ["lang", "predicted"])


@query("""SELECT event_type AS source, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS unit, count(*) AS requests, count(*) FILTER (event_id % 9 <> 0) AS succeeded, round(avg(value), 6) AS mean_ms,
    CASE WHEN count(CASE WHEN event_type <> 'error' THEN event_id % 5 END) = count(*) THEN CAST(sum(event_id % 5) AS BIGINT) END AS cost, round(count(*) FILTER (event_id % 9 <> 0) / count(*)::DOUBLE, 6) AS success_rate FROM events GROUP BY ALL""")
def source_usage(spark, d):
    e = _t(spark, d, "events")
    log = e.select(F.col("event_type").alias("source"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("unit"), (F.col("event_id") % 9 != 0).alias("succeeded"), F.col("value").alias("duration_ms"), F.when(F.col("event_type") != "error", F.col("event_id") % 5).alias("cost"))
    return report.usage(log).withColumns({"mean_ms": F.round("mean_ms", 6), "success_rate": F.round("success_rate", 6)})


@query("""SELECT event_type AS task, count(*) AS requests, CAST(coalesce(sum(CASE WHEN event_id % 3 <> 0 THEN event_id % 7 END), 0) AS BIGINT) AS charged, count(*) FILTER (event_id % 3 = 0) AS unknown FROM events GROUP BY ROLLUP (event_type)""")
def token_ledger(spark, d):
    return report.ledger(_t(spark, d, "events").select(F.col("event_type").alias("task"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 7).alias("charged")))


@query("""SELECT role, 'text' AS field, round(avg((text IS NOT NULL AND trim(text) <> '')::INT), 6) AS ratio, count(*) AS n FROM conversations GROUP BY role
UNION ALL SELECT role, 'turn', round(avg((turn IS NOT NULL)::INT), 6), count(*) FROM conversations GROUP BY role""")
def field_completeness(spark, d):
    return report.completeness(_t(spark, d, "conversations"), ["text", "turn"], ["role"]).select("role", "field", _r("ratio"), "n")


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS has_open FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def scope_filters(spark, d):
    c, o = _t(spark, d, "customer"), _t(spark, d, "orders")
    rest = writers.new_rows(c, o.where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).select("c_custkey")
    open_ = o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_o", F.lit(True))
    return rest.join(open_, "c_custkey", "left").select("c_custkey", F.coalesce("_o", F.lit(False)).alias("has_open"))


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS o, l_partkey || ':' || l_suppkey AS k FROM lineitem) SELECT DISTINCT x.o AS a, y.o AS b FROM c x JOIN c y ON x.k = y.k AND x.o < y.o""")
def review_exclusive_pairs(spark, d):
    return review.exclusive_pairs(_t(spark, d, "lineitem").select("l_orderkey", F.concat_ws(":", "l_partkey", "l_suppkey").alias("k")), "l_orderkey", "k")


@query("""WITH r AS (SELECT c_custkey AS id, c_custkey % 2 = 0 AS z, c_custkey % 3 = 0 AS w, c_custkey % 5 < 2 AS zs, c_custkey % 7 < 3 AS ws, c_custkey % 4 = 0 AS o, ['supported', 'weak_supported', 'not_found', 'not_checked'][1 + c_custkey % 4] AS s, CASE WHEN c_custkey % 11 < 9 THEN (c_custkey % 11) / 10.0::DOUBLE END AS rc FROM customer),
m AS (SELECT *, s IN ('supported', 'weak_supported') AS sup, CASE WHEN z AND w THEN 'natural_topn_overlap' WHEN (w AND zs) OR (z AND ws) THEN CASE WHEN rc < 0.7 THEN 'weak_search_supported' ELSE 'search_supported' END WHEN z OR w THEN 'single_platform_only' WHEN o THEN 'official_only' ELSE 'none' END AS match_type FROM r)
SELECT id, match_type, CASE WHEN z AND w AND sup THEN 'A_cross_platform_with_official' WHEN match_type LIKE '%search_supported' AND sup AND (z OR w) THEN 'B_single_platform_with_search_and_official' WHEN ((z AND w) OR match_type LIKE '%search_supported') AND NOT sup THEN 'C_cross_platform_without_official'
 WHEN (z OR w) AND sup THEN 'D_single_platform_with_official' WHEN z OR w THEN 'E_single_platform_only' WHEN o THEN 'F_official_only' ELSE 'unknown' END AS category FROM m""")
def classify_events(spark, d):
    k = F.col("c_custkey")
    s = F.element_at(F.array(*map(F.lit, ("supported", "weak_supported", "not_found", "not_checked"))), (1 + k % 4).cast("int"))
    rows = _t(spark, d, "customer").select(
        k.alias("id"), (k % 2 == 0).alias("zhihu_topn"), (k % 3 == 0).alias("weibo_topn"), (k % 5 < 2).alias("zhihu_search"), (k % 7 < 3).alias("weibo_search"), (k % 4 == 0).alias("official_source"), s.alias("support_status"), F.when(k % 11 < 9, (k % 11) / 10).alias("relation_confidence"),
        F.lit("top3").alias("rank_bucket"), F.lit(1).alias("presence"), F.lit("rising").alias("rank_delta"), F.lit("none").alias("search_hit"), F.lit("24h").alias("freshness"), F.lit("use").alias("health"), F.array().cast("array<string>").alias("flags"),
    )
    return classify.classify(rows).select("id", "match_type", "category")


@query("""WITH c AS (SELECT o_orderkey AS id, o_orderkey % 3 AS n_c, o_orderkey % 4 AS n_u, ['A_x', 'C_x', 'E_x', 'F_x'][1 + o_orderkey % 4] AS category, CASE WHEN o_orderkey % 5 = 0 THEN '已坐实' WHEN o_orderkey % 7 = 0 THEN '全网热议' ELSE 'x' END AS text, o_orderkey % 2 AS n_s, o_orderkey % 13 = 0 AS audit FROM orders),
f AS (SELECT *, text = '已坐实' AS fact FROM c),
l AS (SELECT id, unnest([CASE WHEN n_c = 0 THEN 2 ELSE 0 END, CASE WHEN n_u = 0 THEN 2 ELSE 0 END, CASE WHEN category IN ('C_x', 'E_x') AND fact THEN 1 ELSE 0 END, CASE WHEN category = 'F_x' AND text = '全网热议' THEN 2 ELSE 0 END, CASE WHEN audit THEN 2 ELSE 0 END, CASE WHEN n_s = 1 AND category = 'E_x' AND fact THEN 2 ELSE 0 END]) AS s FROM f)
SELECT id, ['pass', 'warn', 'block'][1 + max(s)] AS status FROM l GROUP BY id""")
def guardrail_roll_up(spark, d):
    k = F.col("o_orderkey")
    cards = _t(spark, d, "orders").select(k.alias("id"), (k % 3).alias("n_citations"), (k % 4).alias("n_urls"), F.element_at(F.array(*map(F.lit, ("A_x", "C_x", "E_x", "F_x"))), (1 + k % 4).cast("int")).alias("category"), F.when(k % 5 == 0, "已坐实").when(k % 7 == 0, "全网热议").otherwise("x").alias("text"), (k % 2).alias("n_community_sources"), (k % 13 == 0).alias("audit_only"))
    return guardrails.roll_up(guardrails.card_rules().check(cards, "id"), "id")


@query("""WITH r AS (SELECT user_id % 40 AS run_id, CASE WHEN event_id % 3 = 0 AND user_id % 40 > 4 THEN 'succeeded' WHEN event_id % 3 = 1 THEN 'failed' ELSE 'skipped' END AS s FROM events)
SELECT run_id, count(*) AS sources, count(*) FILTER (s = 'succeeded') AS succeeded, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'skipped') AS skipped,
 CASE WHEN count(*) FILTER (s = 'succeeded') = count(*) THEN 'succeeded' WHEN count(*) FILTER (s = 'succeeded') > 0 THEN 'partial' WHEN count(*) FILTER (s = 'skipped') > 0 THEN 'skipped' ELSE 'failed' END AS run_status FROM r GROUP BY run_id""")
def collection_status(spark, d):
    i, u = F.col("event_id"), F.col("user_id") % 40
    return report.collection_status(_t(spark, d, "events").select(u.alias("run_id"), F.when((i % 3 == 0) & (u > 4), "succeeded").when(i % 3 == 1, "failed").otherwise("skipped").alias("status")))


@query("""WITH t AS (SELECT user_id AS k, ts, event_id FROM events WHERE event_type = 'error'),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, event_id) AS n FROM t)
SELECT k AS relation_key, count(*) AS tasks FROM r GROUP BY k""")
def review_tasks_by_relation(spark, d):
    e = _t(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("relation_key"), _utc("ts").alias("observed_at"), F.col("event_id").alias("task_id"), F.array(F.col("event_type")).alias("evidence"))
    return review.consolidate(e).groupBy("relation_key").agg(F.sum("n").alias("tasks"))


@query("""WITH a AS (SELECT l_partkey % 500 AS event_id, l_suppkey AS url, CAST(max(l_quantity) AS BIGINT) AS v, max(l_linenumber) AS c FROM lineitem GROUP BY ALL) SELECT event_id, CAST(sum(v) AS BIGINT) AS votes, CAST(sum(c) AS BIGINT) AS comments, count(*) AS answers FROM a GROUP BY event_id""")
def answer_metrics(spark, d):
    return heat.answer_metrics(_t(spark, d, "lineitem").select((F.col("l_partkey") % 500).alias("event_id"), F.col("l_suppkey").alias("url"), F.col("l_quantity").cast("bigint").alias("votes"), F.col("l_linenumber").alias("comments")))


@query("""WITH w AS (SELECT i AS window_id, TIMESTAMP '2024-01-01' + INTERVAL (i * 37) HOUR AS s, TIMESTAMP '2024-01-01' + INTERVAL (i * 37 + 24) HOUR AS e FROM range(18) t(i))
SELECT window_id, count(*) AS n, count(DISTINCT user_id) AS users FROM events JOIN w ON ts > s AND ts <= e GROUP BY window_id""")
def rounds_in_windows(spark, d):
    w = spark.range(18).select(F.col("id").alias("window_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 37 * 3600).alias("start_at"), F.timestamp_seconds(F.lit(1704067200) + (F.col("id") * 37 + 24) * 3600).alias("end_at"))
    return window_report.rounds_in_window(_t(spark, d, "events").select("user_id", _utc("ts").alias("observed_at")), w).groupBy("window_id").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query(f"""WITH {_pair(OBS)}
SELECT event_id, max(CASE WHEN platform = 'zhihu' THEN trend END) AS zhihu_trend, max(CASE WHEN platform = 'weibo' THEN trend END) AS weibo_trend,
 CASE count(*) FILTER (trend <> 'unknown') WHEN 2 THEN 'ok' WHEN 1 THEN 'partial' ELSE 'unknown' END AS status FROM tr GROUP BY event_id""")
def event_heat_status(spark, d):
    t = trend.latest_pair(observations(spark, d), _wide()).withColumn("last_score", F.lit(None).cast("double"))
    return trend.event_heat(t).select("event_id", "zhihu_trend", "weibo_trend", "status")


@query("""WITH k AS (SELECT c_custkey AS id, 'n' || c_nationkey AS key FROM customer), s AS (SELECT s_suppkey AS id, 'n' || s_nationkey AS key FROM supplier)
SELECT CAST(k.id AS VARCHAR) AS signal_id, CAST(s.id AS VARCHAR) AS event_id, false AS id_match, true AS url_match FROM k JOIN s USING (key)""")
def hard_identity_matches(spark, d):
    none = {c: X.empty() for c in match.IDENTITIES}
    a = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("signal_id"), "c_nationkey").withColumns(none | {"urls": F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))})
    b = _t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("event_id"), "s_nationkey").withColumns(none | {"urls": F.array(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))})
    return match.hard_identities(a, b)


@query("""SELECT sha256(CAST(ts::DATE AS VARCHAR) || ':' || lower(event_type || user_id % 30))[1:24] AS digest, count(*) AS items, count(DISTINCT user_id) AS sources FROM events WHERE ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1""")
def official_agenda(spark, d):
    items = _t(spark, d, "events").select(F.concat("event_type", (F.col("user_id") % 30).cast("string")).alias("title"), F.lit("https://x.org/a").alias("url"), _utc("ts").alias("published_at"), F.col("user_id").alias("source_name"))
    return official.agenda(items, F.lit(START), F.lit(END)).select(F.substring("event_id", 10, 24).alias("digest"), "items", "sources")


@query("""SELECT CAST(s_nationkey AS BIGINT) AS event_id, array_to_string(list_sort(list(DISTINCT CAST(s_suppkey AS VARCHAR))), ',') AS source_ids FROM supplier GROUP BY ALL""")
def merged_events(spark, d):
    e = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("event_id"), F.lit(START).alias("first_seen_at"), F.lit(END).alias("last_seen_at"), F.array(F.col("s_suppkey").cast("string")).alias("source_ids"), X.empty().alias("urls"), F.col("s_nationkey").cast("bigint").alias("target_id"))
    return match.merge_events(e.drop("target_id"), e.select("event_id", "target_id")).select("event_id", F.array_join("source_ids", ",").alias("source_ids"))


def _title():
    """A text's first sentence."""
    return F.trim(F.regexp_replace(F.regexp_extract(F.coalesce("text", F.lit("")), r"^\s*([^.!?。！？\n]*)", 1), r"\s+", " "))


@query()
def resolved_round(spark, d):
    w = X.keywords(_title())
    side = lambda name, key, text, i: _t(spark, d, name).select(F.concat(F.lit(i), F.col(key).cast("string")).alias(i), F.col(key).alias("seq"), _title().alias("title"), F.col(text).alias("text"), w.alias("keywords"), *[X.empty().alias(c) for c in ("entities", "actions", *match.IDENTITIES)], F.lit(None).cast("timestamp").alias("time"), F.lit(False).alias("weak"))
    out = resolution.resolve_in_order(side("benchmark", "item_id", "text", "signal_id"), side("documents", "doc_id", "text", "event_id"))
    return out.select("signal_id", "event_id", "decision", "confidence", "status", "target")


@query()
def extracted_signals(spark, d):
    docs = _t(spark, d, "documents")
    raw = docs.select(F.col("source").alias("source_id"), _title().alias("title"), F.lit(None).cast("string").alias("url"), F.lit("").alias("summary"), F.col("text").alias("content"), X.empty().alias("topics"), F.col("doc_id").cast("string").alias("external_id"), F.lit("2024-01-01T00:00:00Z").alias("published_raw"), F.lit(START).alias("fetched_at"))
    items = normalize.normalize_items(raw).withColumns({"item_id": F.col("external_id"), "relation_decision": F.lit(None).cast("string"), "signal_role": F.lit("topic_discovery"), "source_status": F.lit("use"), "channel": F.lit(None).cast("string")})
    return normalize.extract_signals(normalize.source_signals(items), "run").select("item_id", "event_signal_id", "keywords", "event_type", "is_weak_signal", "confidence")


@query(f"""WITH {_pair(OBS.replace("FROM events)", "FROM events WHERE ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20')"))},
st AS (SELECT event_id, platform, max(observed_at) FILTER (present) AS last_seen FROM obs GROUP BY ALL),
g AS (SELECT *, coalesce(present, false) AND collection_status = 'succeeded' AND list_complete AS good FROM obs),
gj AS (SELECT *, CASE WHEN good AND coalesce(lag(good) OVER w, false) AND date_diff('microsecond', lag(observed_at) OVER w, observed_at) / 6e7 <= 1440 AND lag(topn_scope) OVER w = topn_scope THEN 0 ELSE 1 END AS brk FROM g WINDOW w AS (PARTITION BY event_id, platform ORDER BY observed_at, observation_id)),
gi AS (SELECT *, coalesce(sum(brk) OVER (PARTITION BY event_id, platform ORDER BY observed_at DESC, observation_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM gj),
seg AS (SELECT event_id, platform, count(*) AS n, least(1440, date_diff('microsecond', min(observed_at), max(observed_at)) / 6e7) AS minutes FROM gi WHERE island = 0 AND good GROUP BY ALL),
la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, platform ORDER BY observed_at DESC, observation_id DESC) AS n FROM obs) WHERE n = 1),
j AS (SELECT la.event_id, la.platform, la.present, la.rank, la.score, st.last_seen, date_diff('microsecond', st.last_seen, TIMESTAMP '2024-01-20') / 6e7 > 1440 AS stale, tr.trend, seg.n, seg.minutes
      FROM la JOIN st USING (event_id, platform) LEFT JOIN tr USING (event_id, platform) LEFT JOIN seg USING (event_id, platform)),
rr AS (SELECT event_id, platform, count(DISTINCT run_id) AS recent FROM obs WHERE present AND observed_at > TIMESTAMP '2024-01-13' GROUP BY ALL),
es AS (SELECT *, date_diff('microsecond', last_seen, TIMESTAMP '2024-01-20') / 3.6e9 AS age, CASE event_id % 3 WHEN 0 THEN 'A_x' WHEN 1 THEN 'C_x' END AS category FROM j LEFT JOIN rr USING (event_id, platform)),
ed AS (SELECT *, CASE WHEN platform = 'weibo' AND NOT coalesce(present, false) AND age < 24 AND age >= 0 THEN 0.2 * (0.6 + 0.4 * least(recent, 5) / 5) * pow(2, -age / 2.0::DOUBLE) END AS estimated FROM es)
SELECT event_id, platform, category, round(estimated, 6) AS estimated_heat, row_number() OVER (PARTITION BY platform, category ORDER BY CASE WHEN present THEN 0 ELSE 1 END, CASE WHEN platform = 'zhihu' THEN rank END NULLS LAST, coalesce(estimated, score) DESC NULLS LAST, coalesce(CASE WHEN NOT stale AND n > 1 THEN minutes END, 0) DESC, event_id) AS place, present, recent AS rounds,
       CASE WHEN last_seen IS NULL THEN NULL WHEN stale THEN 'unknown' ELSE coalesce(trend, 'unknown') END AS trend, round(CASE WHEN NOT stale AND n > 1 THEN minutes END, 6)::DOUBLE AS duration_minutes FROM ed""")
def window_report_ranking(spark, d):
    o, k = observations(spark, d).withColumn("ingested_at", F.col("observed_at")), F.col("event_id")
    named = o.select("event_id").distinct().where("event_id % 3 < 2").withColumn("category", F.when(k % 3 == 0, "A_x").otherwise("C_x"))
    return window_report.window_report(o, START, END, _wide(), named).select("event_id", "platform", "category", F.round("estimated_heat", 6).alias("estimated_heat"), "place", "present", "rounds", "trend", F.round("duration_minutes", 6).alias("duration_minutes"))


@query()
def official_support(spark, d):
    e = _t(spark, d, "benchmark").select(F.col("item_id").alias("event_id"), _title().alias("title"), X.empty().alias("entities"), X.keywords(_title()).alias("keywords"))
    pool = _t(spark, d, "documents").select(F.col("doc_id").alias("item_id"), _title().alias("title"), "text", X.empty().alias("entities"), F.lit("use").alias("status"), F.lit("https://x.org").alias("url"), F.lit(START).alias("published_at"))
    return official.support(e, pool, F.lit(END))


@query(f"""WITH {OBS}, l AS (SELECT event_id, platform, observed_at, observation_id, score - lag(score) OVER (PARTITION BY event_id, platform ORDER BY observed_at, observation_id) AS dl FROM obs)
SELECT event_id, platform, epoch_us(observed_at) AS observed_us, CASE WHEN dl IS NULL THEN 'unknown' WHEN dl >= 0.05 THEN 'rising' WHEN dl <= -0.05 THEN 'cooling' ELSE 'stable' END AS trend FROM l""")
def streamed_trend(spark, d):
    """The stream of observations, drained once, with state by series."""
    from .streaming import rounds

    base = new_path(spark, "stream")
    observations(spark, d).select("event_id", "platform", "observed_at", "observation_id", "score").write.parquet(f"{base}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
    rounds.running_trend(source).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("event_id bigint, platform string, observed_at timestamp, trend string").parquet(f"{base}/out")
    return out.select("event_id", "platform", F.unix_micros("observed_at").alias("observed_us"), "trend")


@query(f"""WITH {OBS}, g AS (SELECT event_id, platform, observed_at, CASE WHEN date_diff('microsecond', lag(observed_at) OVER w, observed_at) < 7200000000 THEN 0 ELSE 1 END AS brk FROM obs WHERE present WINDOW w AS (PARTITION BY event_id, platform ORDER BY observed_at)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY event_id, platform ORDER BY observed_at ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT event_id, platform, count(*) AS n FROM s GROUP BY event_id, platform, k""")
def presence_sessions(spark, d):
    from .streaming import rounds

    return rounds.presence_sessions(observations(spark, d)).select("event_id", "platform", "n")


@query(f"""WITH {OBS} SELECT observation_id FROM obs WHERE run_id % 7 <> 0 AND observation_id % 5 <> 0 AND observed_at > TIMESTAMP '2024-01-10' AND observed_at <= TIMESTAMP '2024-01-20'""")
def accepted_signals(spark, d):
    o = observations(spark, d).withColumns({"audit_only": F.col("run_id") % 7 == 0, "contributes": F.lit(True), "relation_decision": F.when(F.col("observation_id") % 5 == 0, "rejected"), "published_at": F.lit(None).cast("timestamp")})
    return filters.accepted_signals(o, F.lit(START), F.lit(END)).select("observation_id")


@query(f"""WITH {OBS} SELECT DISTINCT event_id FROM obs e WHERE EXISTS (SELECT 1 FROM obs i WHERE i.event_id = e.event_id AND i.platform = 'zhihu' AND i.observed_at > TIMESTAMP '2024-01-19' AND i.observed_at <= TIMESTAMP '2024-01-20')""")
def current_attention(spark, d):
    o = observations(spark, d)
    return filters.current_attention(o.select("event_id").distinct(), o.withColumn("signal_role", F.when(F.col("platform") == "zhihu", "topic_discovery")), F.lit(END))


@query(f"""WITH {OBS}, e AS (SELECT event_id, min(observed_at) FILTER (observation_id % 40 = 0) AS f, max(observed_at) FILTER (observation_id % 40 = 0) AS l FROM obs GROUP BY event_id)
SELECT 'evt_' || event_id AS event_id FROM e WHERE f <= TIMESTAMP '2024-01-20' AND l >= TIMESTAMP '2024-01-17' AND event_id % 6 <> 0""")
def candidate_events(spark, d):
    e = observations(spark, d).withColumn("observed_at", F.when(F.col("observation_id") % 40 == 0, F.col("observed_at"))).groupBy("event_id").agg(F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"))
    e = e.select(F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("event_id"), F.when(F.col("event_id") % 6 == 0, "merged").otherwise("active").alias("status"), "first_seen_at", "last_seen_at")
    return filters.candidate_events(e, F.lit(START), F.lit(END)).select("event_id")


@query("""WITH s AS (SELECT DISTINCT o_orderkey AS signal_id, o_custkey AS ref FROM orders), o AS (SELECT o_custkey AS ref, max(o_orderdate) AS t FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT signal_id, CAST(epoch(t) AS BIGINT) AS seconds FROM s LEFT JOIN o USING (ref)""")
def signal_observed_time(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("signal_id"), F.lit("s").alias("source_id"), F.lit("p").alias("platform"), F.array(F.col("o_custkey").cast("string")).alias("refs"), _utc("o_orderdate").alias("observed_at"), "o_orderstatus")
    return filters.observed_time(o.drop("observed_at", "o_orderstatus"), o.where("o_orderstatus = 'F'")).select("signal_id", F.unix_seconds("observed_at").alias("seconds"))


@query(f"""WITH {OBS} SELECT run_id, count(DISTINCT observation_id) AS rounds, count(DISTINCT platform) AS platforms, bool_and(list_complete) AS complete FROM obs GROUP BY run_id""")
def collection_provenance(spark, d):
    return filters.provenance(observations(spark, d).withColumn("round_id", F.col("observation_id"))).select("run_id", "rounds", "platforms", "complete")


@query("""SELECT lower(c_mktsegment) AS email, max(c_custkey) AS delivery_id FROM customer GROUP BY 1""")
def latest_deliveries(spark, d):
    return filters.latest_per_address(_t(spark, d, "customer").select(F.col("c_mktsegment").alias("email"), F.col("c_custkey").alias("delivery_id")))


@query(f"""WITH {_BM25}, p AS (SELECT item_id, doc_id FROM benchmark JOIN documents ON source = 'src' || (item_id % 20)),
n AS (SELECT item_id, count(*) AS c FROM p GROUP BY item_id),
r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS k FROM p JOIN sc USING (item_id, doc_id))
SELECT p.item_id, p.doc_id, CASE WHEN c <= 20 THEN 'all_within_limit' ELSE 'retrieved' END AS method FROM p JOIN n USING (item_id) LEFT JOIN r USING (item_id, doc_id) WHERE c <= 20 OR k <= 20""")
def candidate_selection(spark, d):
    b, docs = _t(spark, d, "benchmark"), _t(spark, d, "documents")
    pool = b.select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source")).join(docs.select("doc_id", "source"), "source")
    ranked = retrieve.bm25_top_k(b, docs, "item_id", "doc_id", "text", "text", 20, only=pool)
    return retrieve.select_candidates(pool, ranked, "item_id", "doc_id")


WINDOW = (datetime(1996, 1, 1), datetime(1997, 1, 1))
_CITED = """m AS (SELECT o_custkey AS event_id, o_orderkey AS item_id, o_orderdate AS t_at, o_orderkey % 10 = 0 AND o_orderdate <= TIMESTAMP '1996-01-01' AS prior,
        CASE WHEN o_orderkey % 6 <> 0 THEN 'https://x.org/' || o_orderkey END AS url, 'T' || (o_orderkey % 3) AS title, o_orderpriority AS source_name, o_orderstatus = 'F' AS official FROM orders),
ci AS (SELECT event_id, item_id, t_at, url, title, source_name, official, prior FROM m
       WHERE (NOT (item_id % 13 = 0) AND item_id % 17 <> 0 OR prior) AND CASE WHEN official THEN prior OR (t_at > TIMESTAMP '1996-01-01' AND t_at <= TIMESTAMP '1997-01-01') ELSE t_at > TIMESTAMP '1996-01-01' AND t_at <= TIMESTAMP '1997-01-01' END)"""


def _cited(spark, d):
    o = _t(spark, d, "orders")
    k, t = F.col("o_orderkey"), _utc("o_orderdate")
    members = o.select(F.col("o_custkey").alias("event_id"), k.alias("item_id"), t.alias("observed_at"), (k % 10 == 0).alias("prior"))
    items = o.select(
        k.alias("item_id"), F.when(k % 6 != 0, F.concat(F.lit("https://x.org/"), k.cast("string"))).alias("url"), F.concat(F.lit("T"), (k % 3).cast("string")).alias("title"), F.col("o_orderpriority").alias("source_name"),
        F.when(F.col("o_orderstatus") == "F", "official_news").otherwise("community").alias("source_type"), F.lit("x").alias("platform"), t.alias("published_at"), t.alias("fetched_at"), (k % 13 == 0).alias("audit_only"), (k % 17 != 0).alias("contributes"),
    )
    return briefing.citations(members, items, F.lit(WINDOW[0]), F.lit(WINDOW[1]))


@query(f"""WITH {_CITED} SELECT event_id, item_id, CASE WHEN official THEN 'official_support' ELSE 'supporting' END AS role, prior AS is_prior, url IS NULL AS missing_url FROM ci""")
def briefing_citations(spark, d):
    return _cited(spark, d).select("event_id", "item_id", "role", "is_prior", "missing_url")


_CARDS = f"""{_CITED}, e AS (SELECT c_custkey AS event_id, 'T' || (c_custkey % 4) AS title, ['A_x', 'C_x', 'E_x', 'F_x'][1 + c_custkey % 4] AS category, c_custkey % 2 = 0 AS z, c_custkey % 3 = 0 AS w, c_custkey % 4 = 3 AS o FROM customer),
a AS (SELECT event_id, count(*) AS n, count(DISTINCT source_name) FILTER (official) AS sources, max(t_at) FILTER (official) AS latest, bool_or(official AND NOT prior) AS fresh, bool_or(prior) AS any_prior, list(DISTINCT title) AS titles FROM ci GROUP BY event_id),
k AS (SELECT e.*, coalesce(n, 0) AS n, coalesce(sources, 0) AS sources, latest, coalesce(fresh, false) AS fresh, coalesce(any_prior, false) AS any_prior, coalesce(list_contains(titles, title), false) AS quoted FROM e LEFT JOIN a USING (event_id)),
cards AS (SELECT *, CASE WHEN n = 0 THEN 'missing_current_citation' END AS excluded, '本期见于' || coalesce(nullif(array_to_string(list_filter([CASE WHEN z THEN '知乎' END, CASE WHEN w THEN '微博' END, CASE WHEN fresh THEN '官媒' END], lambda x: x IS NOT NULL), '、'), ''), '待确认来源') || '。'
    || CASE WHEN any_prior THEN '官媒依据含此前报道，不代表官媒本期新发布报道。' ELSE '' END || CASE WHEN o THEN '' ELSE '话题信息来自平台讨论，暂无已接纳的官媒依据。' END AS summary FROM k)"""


def _briefing_cards(spark, d):
    k = F.col("c_custkey")
    events = _t(spark, d, "customer").select(k.alias("event_id"), F.concat(F.lit("T"), (k % 4).cast("string")).alias("title"), F.element_at(F.array(*map(F.lit, ("A_x", "C_x", "E_x", "F_x"))), (1 + k % 4).cast("int")).alias("category"), (k % 2 == 0).alias("zhihu_topn"), (k % 3 == 0).alias("weibo_topn"), (k % 4 == 3).alias("official_source"))
    return briefing.cards(events, _cited(spark, d), "本期")


@query(f"WITH {_CARDS} SELECT event_id, n AS n_citations, sources AS official_sources, quoted AS title_is_source_quote, excluded, summary FROM cards")
def briefing_cards(spark, d):
    return _briefing_cards(spark, d).select("event_id", "n_citations", "official_sources", "title_is_source_quote", "excluded", "summary")


@query(f"""WITH {_CARDS}, s AS (SELECT *, unnest(list_filter([CASE WHEN z AND w THEN 'shared' END, CASE WHEN z THEN 'zhihu' END, CASE WHEN w THEN 'weibo' END, CASE WHEN fresh AND category = 'F_x' THEN 'official' END, category[1]], lambda x: x IS NOT NULL)) AS section FROM cards WHERE excluded IS NULL),
r AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 7 <> 0 END AS present, CASE WHEN section = 'zhihu' THEN event_id % 30 END AS rank, (event_id % 100) / 100.0::DOUBLE AS score FROM s)
SELECT section, event_id, row_number() OVER (PARTITION BY section ORDER BY CASE WHEN section IN ('zhihu', 'weibo') THEN CASE WHEN present THEN 0 WHEN present IS NULL THEN 1 ELSE 2 END WHEN section = 'official' THEN -sources ELSE 0 END,
    CASE WHEN section = 'zhihu' THEN rank WHEN section = 'official' THEN -epoch_us(latest) ELSE 0 END, CASE WHEN section IN ('zhihu', 'weibo') THEN -score ELSE 0 END, CASE WHEN section IN ('zhihu', 'weibo', 'official') THEN '' ELSE title END, event_id) AS place FROM r""")
def briefing_sections(spark, d):
    k = F.col("c_custkey")
    ranking = _t(spark, d, "customer").select(k.alias("event_id"), F.explode(F.array(F.lit("zhihu"), F.lit("weibo"))).alias("platform"), F.when(k % 5 != 0, k % 7 != 0).alias("present"), (k % 30).alias("rank"), ((k % 100) / 100).alias("score"))
    return briefing.sections(_briefing_cards(spark, d), ranking)


@query(f"""WITH {_CARDS} SELECT count(*) FILTER (excluded IS NOT NULL) AS excluded, count(*) FILTER (excluded IS NULL AND category = 'F_x') AS official_news, count(*) FILTER (excluded IS NULL AND category <> 'F_x') AS community_events,
(SELECT count(*) FROM supplier WHERE s_suppkey % 4 = 0) AS sources_in_doubt, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pending_reviews FROM cards""")
def briefing_risks(spark, d):
    health = _t(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 4 == 0, "stale").otherwise("ok").alias("health"))
    tasks = _t(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "P", "pending").otherwise("resolved").alias("status"))
    return briefing.risks(_briefing_cards(spark, d), health, tasks)


@query(f"""WITH {OBS}, e AS (SELECT DISTINCT event_id, platform FROM obs),
r AS (SELECT DISTINCT CAST(floor(epoch(observed_at) / 86400) AS BIGINT) AS day FROM obs),
x AS (SELECT day, p.platform, day % 5 <> 0 AS succeeded, day % 7 <> 0 AS complete FROM r CROSS JOIN (SELECT unnest(['zhihu', 'weibo']) AS platform) p),
h AS (SELECT CASE WHEN event_id % 10 = 0 THEN event_id + 1 ELSE event_id END AS event_id, platform, CAST(floor(epoch(observed_at) / 86400) AS BIGINT) AS day, min(1 + observation_id % 30) AS rank, round(max(score) * 1000, 6) AS heat FROM obs GROUP BY ALL),
y AS (SELECT e.event_id, e.platform, x.day, h.rank, h.heat, CASE WHEN h.event_id IS NOT NULL AND succeeded THEN true WHEN h.event_id IS NULL AND succeeded AND complete THEN false END AS present
      FROM e JOIN x USING (platform) LEFT JOIN h ON h.event_id = e.event_id AND h.platform = e.platform AND h.day = x.day)
SELECT event_id, platform, day, present, CASE WHEN present AND platform = 'zhihu' THEN rank END AS rank, CASE WHEN present THEN heat END AS native_heat, CASE WHEN present THEN (event_id % 10) / 10.0::DOUBLE END AS score FROM y""")
def recorded_round(spark, d):
    o = observations(spark, d).withColumn("day", F.floor(F.unix_seconds("observed_at") / 86400))
    rid, n, key = F.concat_ws(":", "platform", "day"), F.col("day"), F.concat(F.lit("h"), F.col("event_id").cast("string"))
    platforms = F.explode(F.array(F.lit("zhihu"), F.lit("weibo"))).alias("platform")
    rounds = o.select("day").distinct().select("day", platforms).select("day", "platform", rid.alias("round_id"), F.timestamp_seconds(n * 86400).alias("observed_at"), (n % 5 != 0).alias("succeeded"), (n % 7 != 0).alias("complete"), F.lit("a").alias("scope"))
    items = o.select(rid.alias("round_id"), key.alias("content_hash"), (1 + F.col("observation_id") % 30).alias("rank"), F.round(F.col("score") * 1000, 6).alias("native_heat"))
    ids = o.select("event_id").distinct()
    tracked = o.select("event_id", "platform").distinct()
    scores = tracked.join(rounds.select("platform", "round_id"), "platform").withColumn("score", F.col("event_id") % 10 / 10)
    out = round_record.record_round(tracked, rounds, items, ids.select(key.alias("content_hash"), "event_id"), ids.select(key.alias("content_hash"), F.when(F.col("event_id") % 10 == 0, F.col("event_id") + 1).otherwise(F.col("event_id")).alias("event_id")), scores)
    return out.select("event_id", "platform", "day", "present", "rank", "native_heat", "score")


@query("""WITH r AS (SELECT o_orderkey AS review_id, o_custkey AS item, o_orderdate AS failed, CASE o_orderkey % 4 WHEN 0 THEN 'signal:' WHEN 1 THEN 'weibo:' ELSE 'url:' END || (o_custkey % 300) AS ident
    FROM orders WHERE o_orderkey % 3 <> 1 AND o_orderstatus <> 'P' AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 5 <> 0) AND o_custkey % 13 <> 0 AND o_custkey % 10 <> 0),
a AS (SELECT o_orderkey AS event_id, o_custkey AS item, o_orderdate AS t_at, CASE o_orderkey % 4 WHEN 0 THEN 'signal:' WHEN 1 THEN 'weibo:' ELSE 'url:' END || (o_custkey % 300) AS ident FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 5 <> 0),
h AS (SELECT review_id, event_id, t_at, failed, r.ident, 'items' AS basis FROM r JOIN a ON a.item = r.item OR a.item + 1 = r.item
      UNION ALL SELECT review_id, event_id, t_at, failed, r.ident, 'topic' FROM r JOIN a ON a.ident = r.ident WHERE r.ident NOT LIKE 'signal:%'),
k AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY t_at, event_id, basis) AS n FROM h WHERE (t_at > failed OR (t_at = failed AND CASE WHEN review_id % 2 = 0 THEN event_id > review_id ELSE event_id % 4 >= 2 END))
      AND (ident NOT LIKE 'weibo:%' OR date_diff('microsecond', failed, t_at) / 3.6e9 <= 24 * 90))
SELECT review_id, event_id, basis FROM k WHERE n = 1""")
def recovered_reviews(spark, d):
    """Two thirds of the orders are reviews, by category or by their flags alone, one third accepted results;
    items of some customers have another owner or are unknown."""
    o = _t(spark, d, "orders")
    k, t = F.col("o_orderkey"), _utc("o_orderdate")
    ident = F.array(F.concat(F.when(k % 4 == 0, "signal:").when(k % 4 == 1, "weibo:").otherwise("url:"), (F.col("o_custkey") % 300).cast("string"))).alias("identity")
    category = F.when(k % 3 == 2, None).when(k % 7 == 0, "candidate").otherwise("technical_error")
    reviews = o.where(k % 3 != 1).select(k.alias("review_id"), F.when(F.col("o_orderstatus") == "P", "resolved").otherwise("pending").alias("status"), category.alias("category"), F.array(F.when(k % 11 == 0, "time_conflict").otherwise("x")).alias("flags"), F.array("o_custkey").alias("item_ids"), ident, t.alias("first_failed_at"), t.alias("last_failed_at"), F.when(k % 2 == 0, k).alias("attempt"), t.alias("created_at"), F.when(k % 5 == 0, "e").alias("candidate_event_id"), F.array(F.lit("llm_timeout")).alias("semantic_flags"), F.array(F.when(k % 7 == 0, "candidate")).alias("past_categories"))
    accepted = o.where(k % 3 == 1).select(k.alias("event_id"), k.alias("event_signal_id"), F.lit("merge").alias("action"), (k % 5 == 0).alias("review_required"), F.lit(False).alias("blocked"), X.empty().alias("flags"), F.array(F.col("o_custkey"), F.col("o_custkey") + 1).alias("item_ids"), ident, t.alias("observed_at"), k.alias("attempt"), (t + F.make_dt_interval(secs=k % 4)).alias("accepted_at"))
    owners = _t(spark, d, "customer").where("c_custkey % 13 <> 0").select(F.col("c_custkey").alias("item"), F.when(F.col("c_custkey") % 10 == 0, F.lit(-1).cast("bigint")).alias("event_id"))
    return review.recover(reviews, accepted, 24 * 90, owners).select("review_id", "event_id", "basis")


_RUNS = "b AS (SELECT doc_id, doc_id % 4 <> 0 AS was FROM labels), r AS (SELECT doc_id, unnest(['rules', 'hybrid', 'hybrid_rerank']) AS profile FROM labels), j AS (SELECT profile, was, (doc_id + len(profile)) % 5 <> 0 AS now FROM r JOIN b USING (doc_id))"


@query(f"WITH {_RUNS} SELECT profile, count(*) AS cases, count(*) FILTER (now) AS passed, count(*) FILTER (now AND NOT was) AS fixed, count(*) FILTER (was AND NOT now) AS regressed FROM j GROUP BY profile")
def profile_ablation(spark, d):
    case = F.col("doc_id").alias("case_id")
    base = _t(spark, d, "labels").select(case, (F.col("doc_id") % 4 != 0).alias("passed"))
    runs = _t(spark, d, "labels").select(case, F.explode(F.array(*map(F.lit, ("rules", "hybrid", "hybrid_rerank")))).alias("profile")).withColumn("passed", (F.col("case_id") + F.length("profile")) % 5 != 0)
    return evaluate.ablation(base, runs)


@query("""WITH c AS (SELECT doc_id, lang AS kind, quality = CASE WHEN doc_id % 9 = 0 THEN quality + 1 ELSE 1 - toxic END AS ok FROM labels JOIN documents USING (doc_id))
SELECT kind, count(*) AS n, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, round(count(*) FILTER (ok) / count(*)::DOUBLE, 6) AS rate FROM c GROUP BY kind""")
def evaluation_suite(spark, d):
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "lang"), "doc_id").withColumn("case_id", F.col("doc_id"))
    made = lambda c: F.create_map(F.lit("answer"), c.cast("string"))
    return evaluate.suite(rows.select("case_id", F.col("lang").alias("kind"), made(F.col("quality")).alias("expected")), rows.select("case_id", made(F.when(F.col("doc_id") % 9 == 0, F.col("quality") + 1).otherwise(1 - F.col("toxic"))).alias("actual")))


@query("""WITH r AS (SELECT o_orderdate AS t, CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'O' THEN 'succeeded' ELSE 'failed' END AS status FROM orders), s AS (SELECT l_shipdate AS t, CASE WHEN l_returnflag = 'N' THEN 'sent' ELSE 'pending' END AS status FROM lineitem)
SELECT 'run' AS subject, status, count(*) AS n, status <> 'succeeded' AS attention FROM r WHERE t BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-01-01' GROUP BY status
UNION ALL SELECT 'delivery', status, count(*), status <> 'sent' FROM s WHERE t BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-01-01' GROUP BY status
UNION ALL SELECT 'stale', status, count(*), true FROM r WHERE status = 'running' AND t < TIMESTAMP '1996-12-31 23:00:00' GROUP BY status""")
def trial_audit(spark, d):
    runs = _t(spark, d, "orders").select(_utc("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "O", "succeeded").otherwise("failed").alias("status"))
    sent = _t(spark, d, "lineitem").select(_utc("l_shipdate").alias("started_at"), F.when(F.col("l_returnflag") == "N", "sent").otherwise("pending").alias("status"))
    return report.trial_audit(runs, sent, F.lit(WINDOW[0]), F.lit(WINDOW[1]))


@query("""WITH c AS (SELECT c_custkey AS id, c_name AS title, ['A_x', 'C_x', 'E_x', 'F_x'][1 + c_custkey % 4] AS category, list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'weibo_topn' END, CASE WHEN c_custkey % 3 = 0 THEN 'zhihu_topn' END, CASE WHEN c_custkey % 5 = 0 THEN 'weibo_cli' END, CASE WHEN c_custkey % 7 = 0 THEN 'zhihu_search' END], lambda x: x IS NOT NULL) AS p,
    ['supported', 'weak_supported', 'not_found', 'not_checked'][1 + c_custkey % 4] AS s, c_custkey % 6 AS n FROM customer)
SELECT id, title || ' classified as ' || category || CASE WHEN len(p) > 0 THEN ' from current 24h evidence' ELSE '' END AS lead, array_to_string(p, ',') AS platform_evidence, CASE WHEN s = 'not_checked' THEN '' ELSE s || '; coverage=single_source; references=' || n END AS official_evidence, s = 'not_found' AS careful FROM c""")
def classification_evidence(spark, d):
    k = F.col("c_custkey")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (1 + k % 4).cast("int"))
    rows = _t(spark, d, "customer").select(k.alias("id"), F.col("c_name").alias("title"), pick("A_x", "C_x", "E_x", "F_x").alias("category"), (k % 2 == 0).alias("weibo_topn"), (k % 3 == 0).alias("zhihu_topn"), (k % 5 == 0).alias("weibo_search"), (k % 7 == 0).alias("zhihu_search"), pick("supported", "weak_supported", "not_found", "not_checked").alias("support_status"), F.lit("single_source").alias("coverage"), (k % 6).alias("n_references"), X.empty().alias("limitations"), X.empty().alias("missing_fields"))
    return classify.evidence(rows).select("id", "evidence.lead", F.array_join("evidence.platform_evidence", ",").alias("platform_evidence"), F.array_join("evidence.official_evidence", ",").alias("official_evidence"), F.col("evidence.conservative_language_required").alias("careful"))


@query("""WITH t AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS s FROM orders)
SELECT id, CASE id % 5 WHEN 1 THEN 'llm_occurrence_timezone_missing' WHEN 2 THEN 'llm_occurrence_timezone_missing' WHEN 4 THEN 'llm_invalid_occurrence_time' END AS problem FROM t""")
def occurrence_times(spark, d):
    k, s = F.col("o_orderkey"), F.date_format(_utc("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss")
    stated = F.when(k % 5 == 0, F.concat(s, F.lit("Z"))).when(k % 5 == 1, s).when(k % 5 == 2, F.substring(s, 1, 10)).when(k % 5 == 3, F.concat(s, F.lit("+08:00"))).otherwise(F.concat(F.lit("about "), s))
    return _t(spark, d, "orders").select(k.alias("id"), N.occurrence_problem(stated).alias("problem"))


@query("""WITH h AS (SELECT o_orderkey AS id, o_orderkey % 10 AS v FROM orders) SELECT id, CASE WHEN id % 13 = 0 THEN '本期未保存趋势观测数据' WHEN v = 0 THEN '最近一次来源采集失败，无法比较' WHEN v = 1 THEN '相邻采集间隔过长，无法连续比较' WHEN id % 3 = 1 AND v % 2 = 0 THEN '仅有1次在榜观测，最近一轮已离榜，缺少连续可比热度'
  WHEN id % 3 = 1 THEN '仅有1次在榜观测，需要两次连续可比数据' WHEN v % 2 = 0 THEN '最近一轮已离榜，缺少连续两轮在榜热度' WHEN v = 3 THEN CASE WHEN id % 4 = 1 THEN '缺少两轮可比的CLI互动指标' ELSE '缺少两轮可比的榜位或热度指标' END WHEN v = 5 THEN '有效历史不足，需要两次连续可比数据' ELSE '缺少连续可比的榜单观测数据' END AS reason FROM h""")
def unknown_trend_reasons(spark, d):
    k = F.col("o_orderkey")
    v = k % 10
    flag = F.when(v == 0, F.array(F.lit("observation_gap"), F.lit("source_unavailable"))).when(v == 1, F.array(F.lit("observation_gap"))).when(v == 3, F.array(F.lit("insufficient_trend_metrics"))).when(v == 5, F.array(F.lit("insufficient_history"))).otherwise(X.empty())
    return _t(spark, d, "orders").select(k.alias("id"), filters.unknown_trend_reason(F.when(k % 13 != 0, flag), k % 3, v % 2 != 0, F.when(k % 4 == 1, "weibo").otherwise("zhihu")).alias("reason"))


@query("""SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderstatus = 'F')""")
def resumed_work(spark, d):
    o = _t(spark, d, "orders")
    return writers.pending(o.select("o_orderkey"), o.where("o_orderkey % 3 = 0").select("o_orderkey", F.col("o_orderstatus").alias("version")), ["o_orderkey"], "F")
