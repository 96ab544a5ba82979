"""The event engine's operators on small tables."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventide import config as C
from eventide.functions import identity as I
from eventide.functions import numbers as N
from eventide.functions import text as X
from eventide.operators import classify, evaluate, filters, guardrails, heat, match, normalize, observe, official, report, retrieve, review, trend
from eventide.plans import briefing, resolution, round_record, window_report
from eventide.sources import readers, writers

T0 = datetime(2026, 9, 14)
ARRAY = "array<string>"


def one(spark, column, **values):
    """A column's value on a one-row table; strings, lists and numbers by name."""
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.array(*map(F.lit, v)).cast(ARRAY) if isinstance(v, list) else F.lit(v))
    return df.select(column.alias("x")).first()["x"]


# functions


@pytest.mark.parametrize("text,tokens", [("Model 3 发布", ["model", "3", "发布"]), ("召回通知书", ["召回", "回通", "通知", "知书"]), ("好 a", ["好", "a"]), ("", []), (None, [])])
def test_tokens(spark, text, tokens):
    assert one(spark, X.lexical_tokens(F.col("t")), t=text) == tokens


def test_ngrams_and_overlaps(spark):
    assert one(spark, X.ngrams(F.col("t"), 2, 3), t="abc") == ["ab", "bc", "abc"]
    assert one(spark, X.ngrams(F.col("t"), 2, 4), t="a") == []
    assert one(spark, X.jaccard(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == pytest.approx(1 / 3)
    assert one(spark, X.containment(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == 0.5
    assert one(spark, X.term_overlap(F.col("a"), F.col("b")), a=["召回", "无"], b="品牌召回") == 0.5
    assert one(spark, X.title_containment(F.col("a"), F.col("b")), a="某品牌公司发布召回通知引发关注", b="某品牌公司发布召回通知")
    assert not one(spark, X.title_containment(F.col("a"), F.col("b")), a="召回", b="召回")


@pytest.mark.parametrize("a,b,conflict", [("K9 汽车召回", "K8 汽车召回", "model_conflict"), ("2024款汽车", "2025款汽车", "model_year_conflict"), ("学校取消考试", "学校新增考试", "action_conflict"), ("第3集播出", "第4集播出", "episode_conflict"), ("暴雨预警", "台风预警", "hazard_conflict")])
def test_conflicts(spark, a, b, conflict):
    assert conflict in one(spark, X.conflicts(X.facts(F.col("a")), X.facts(F.col("b"))), a=a, b=b)
    assert one(spark, X.conflicts(X.facts(F.col("a")), X.facts(F.col("b"))), a=a, b=a) == []


def test_extraction_functions(spark):
    assert one(spark, X.actions(F.col("t")), t="某公司召回并道歉") == ["道歉", "召回"]
    assert one(spark, X.event_type(F.col("t")), t="工厂火灾 立案") == "public_safety"
    assert one(spark, X.entity_conflict(F.col("a"), F.col("b"), C.COMPARABLE_ENTITY_SUFFIXES), a=["甲公司"], b=["乙公司"])
    assert not one(spark, X.entity_conflict(F.col("a"), F.col("b"), C.COMPARABLE_ENTITY_SUFFIXES), a=["甲公司"], b=["乙医院"])
    assert "某品牌公司" in one(spark, X.entities(F.col("t")), t="某品牌公司发布召回")
    assert one(spark, X.phrases(F.col("t")), t="#热点# 《新规定》来了") == ["热点", "新规定"]
    assert one(spark, X.redact(F.col("t")), t="token=abc Bearer xyz") == "token=*** Bearer ***"
    assert one(spark, X.quotes_verified(F.col("q"), F.col("a"), F.col("b")), q=["b c"], a="a", b="b c")


def test_identity(spark):
    assert one(spark, I.canonical_id(F.col("u")), u="https://www.zhihu.com/question/12/answer/3") == "zhihu:question:12"
    assert one(spark, I.canonical_id(F.col("u")), u="https://zhihu.com.evil.org/question/12") is None
    assert one(spark, I.url_key(F.col("u")), u=" HTTPS://A.org/x/ ") == "https://a.org/x"
    assert one(spark, I.without_tracking(F.col("u")), u="https://a.org/x?utm_source=1&id=2#z") == "https://a.org/x?id=2"
    assert one(spark, I.event_id(F.lit("abcdefghijklmnop"), F.lit("20260914"))) == "evt_20260914_abcdefghijkl"


@pytest.mark.parametrize("raw,want", [("2026-09-14T08:00:00+08:00", T0), ("2026-09-14", T0), ("Mon, 14 Sep 2026 00:00:00 GMT", T0), ("1789344000", T0), ("yesterday", None)])
def test_times(spark, raw, want):
    got = one(spark, F.unix_seconds(N.parse_time(F.col("t"))), t=raw)
    assert got == (None if want is None else int((want - datetime(1970, 1, 1)).total_seconds()))


def test_numbers(spark):
    assert one(spark, N.weighted_available([(F.lit(0.8), 0.5), (F.lit(None).cast("double"), 0.5)])) == pytest.approx(0.8)
    assert one(spark, N.weighted_available([(F.lit(None).cast("double"), 0.5)])) is None
    assert one(spark, N.rss_decay(F.lit(1), F.lit(0.0))) == pytest.approx(0.136)
    assert one(spark, N.rss_decay(F.lit(5), F.lit(2.0))) == pytest.approx(0.1)
    assert one(spark, N.parse_display_heat(F.lit("123.5 万热度"))) == pytest.approx(1_235_000)
    assert one(spark, N.rank_score(F.lit(1))) == 1 and one(spark, N.rank_score(F.lit(0))) is None
    assert one(spark, N.log_score(F.lit(-1), 10.0)) is None
    assert one(spark, N.publication_exclusion(F.lit(T0), F.lit(T0), F.lit(T0 + timedelta(hours=1)))) == "expired"
    assert one(spark, N.publication_exclusion(F.lit(T0), F.lit(T0 - timedelta(hours=1)), F.lit(T0))) is None
    assert one(spark, N.sigmoid(F.lit(0.0))) == 0.5


# matching

SIGNAL = "signal_id string, title string, text string, entities array<string>, actions array<string>, keywords array<string>, time timestamp, weak boolean, signal_ids array<string>, source_ids array<string>, platform_ids array<string>, canonical_ids array<string>, urls array<string>"
EVENT = SIGNAL.replace("signal_id string", "event_id string")


def row(i, title, entities=(), actions=(), keywords=(), time=None, weak=False, urls=(), sources=()):
    return (i, title, title, list(entities), list(actions), list(keywords), time, weak, [], list(sources), [], [], list(urls))


@pytest.mark.parametrize("signal,event,decision,by", [
    (row("s", "无关的标题甲乙丙", urls=["https://a/1"]), row("e", "另外一个标题", urls=["https://a/1"]), "merge", "url_match"),
    (row("s", "标题一二三四五六", sources=["x"]), row("e", "七八九十", sources=["x"]), "merge", "id_match"),
    (row("s", "某品牌公司发布召回通知引发消费者关注", ["某品牌公司"], ["召回"], ["召回", "通知"], T0), row("e", "某品牌公司发布召回通知", ["某品牌公司"], ["召回"], ["召回"], T0), "merge", "title_containment"),
    (row("s", "甲公司发布召回通知", ["甲公司"], ["召回"], ["召回"]), row("e", "乙公司发布召回通知", ["乙公司"], ["召回"], ["召回"]), "reject", None),
    (row("s", "某品牌公司发布召回通知", ["某品牌公司"], ["召回"], ["召回"], T0), row("e", "某品牌公司发布召回通知", ["某品牌公司"], ["召回"], ["召回"], datetime(2026, 1, 1)), "reject", None),
    (row("s", "某品牌公司召回", weak=True), row("e", "某品牌公司召回", weak=True), "candidate_review", "title_containment"),
    (row("s", "完全不同的事情发生了"), row("e", "xyz"), "create", None),
])
def test_resolution(spark, signal, event, decision, by):
    got = resolution.resolve_round(spark.createDataFrame([signal], SIGNAL), spark.createDataFrame([event], EVENT)).first()
    assert got["decision"] == decision
    assert by is None or by in got["matched_by"]


def test_ambiguous_merges_are_reviewed(spark):
    a = row("s", "某品牌公司发布召回通知书", ["某品牌公司"], ["召回"], ["召回", "通知"], T0)
    b = [row(e, "某品牌公司发布召回通知书", ["某品牌公司"], ["召回"], ["召回", "通知"], T0) for e in ("e1", "e2")]
    got = resolution.resolve_round(spark.createDataFrame([a], SIGNAL), spark.createDataFrame(b, EVENT)).first()
    assert got["decision"] == "candidate_review" and got["event_id"] == "e1"


def test_bm25(spark):
    docs = [(1, "a b c a"), (2, "a"), (3, "d e")]
    got = {r["id"]: r["score"] for r in retrieve.bm25(spark.createDataFrame([(9, "a c zz")], "q int, t string"), spark.createDataFrame(docs, "id int, t string"), "q", "id", "t", "t").collect()}
    avg = 7 / 3

    def part(n, df, tf, length):
        return math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg))

    assert got == {1: pytest.approx(part(3, 2, 2, 4) + part(3, 1, 1, 4)), 2: pytest.approx(part(3, 2, 1, 1))}


def test_hybrid_retrieval(spark):
    s = spark.createDataFrame([(1, k, 10.0 - k) for k in range(1, 6)], "q int, d int, score double")
    dense = spark.createDataFrame([(1, k, float(k), 1) for k in range(4, 9)], "q int, d int, score double, rank int")
    hard = spark.createDataFrame([(1, 99)], "q int, d int")
    got = [r["d"] for r in retrieve.hybrid(s, dense, hard, "q", "d", 3).orderBy("place").collect()]
    assert got[0] == 99 and len(got) == 4 and set(got[1:]) <= {1, 2, 3, 6, 7, 8}


def test_pairs_and_judgments(spark):
    df = spark.createDataFrame([(1, ["x"]), (2, ["x", "y"]), (3, ["y"])], "i int, k array<string>")
    judged = spark.createDataFrame([(1, 2)], "a int, b int")
    assert [tuple(r) for r in match.unordered_pairs(df, "i", "k", judged).collect()] == [(2, 3)]
    j = spark.createDataFrame([("a", "same"), ("b", "same"), ("b", "plausible"), ("c", "different")], "signal_id string, verdict string")
    assert dict(match.judged_policy(j).collect()) == {"a": "merge", "b": "candidate_review", "c": "create"}


# heat and trend


def heat_row(**values):
    base = dict(event_id=1, platform="weibo", rank=None, native_heat=None, seen=1, rank_delta="unknown", votes=None, comments=None, provider=None, search_only=False, topic_present=None, search_total=None, matched=None, sample_age_hours=None, reposts=None, status_comments=None, likes=None, seed=False, has_samples=False, low_relevance=False, age_hours=None)
    return tuple((base | values).values())


HEAT = "event_id int, platform string, rank int, native_heat double, seen int, rank_delta string, votes int, comments int, provider string, search_only boolean, topic_present boolean, search_total int, matched int, sample_age_hours double, reposts int, status_comments int, likes int, seed boolean, has_samples boolean, low_relevance boolean, age_hours double"


def test_heat(spark):
    rows = [heat_row(event_id=1, seed=True, age_hours=0.0), heat_row(event_id=2, platform="zhihu", native_heat=1e7), heat_row(event_id=3, platform="zhihu", provider="native", rank=1), heat_row(event_id=4, low_relevance=True), heat_row(event_id=5, platform="zhihu", search_only=True, rank=1, provider="native"), heat_row(event_id=6, seed=True, has_samples=True)]
    got = {r["event_id"]: r for r in heat.signal_scores(spark.createDataFrame(rows, HEAT)).collect()}
    assert got[1]["score"] == pytest.approx(0.136) and got[1]["score_status"] == "partial"
    assert got[2]["score"] == 0.5 and got[2]["score_status"] == "ok"
    assert got[3]["score"] == 1.0 and got[3]["score_status"] == "partial"
    assert got[4]["score"] is None and got[5]["score"] is None


def test_heat_aggregate(spark):
    rows = [(1, "weibo", 0.5, "samples", "ok", None), (1, "weibo", 0.4, "samples", "ok", None), (1, "weibo", 0.9, "rss_presence_only", "partial", None), (2, "zhihu", 0.5, "native_heat", "ok", 1e7), (2, "zhihu", 0.9, "rank", "ok", None), (3, "weibo", None, "samples", "unknown", None)]
    got = {r["event_id"]: r for r in heat.aggregate(spark.createDataFrame(rows, "event_id int, platform string, score double, basis string, score_status string, native_heat double")).collect()}
    assert got[1]["score"] == pytest.approx(0.55) and got[2]["score"] == 0.5 and got[3]["score"] is None and got[3]["status"] == "unknown"


OBS = "event_id int, platform string, observation_id string, run_id string, observed_at timestamp, collection_status string, list_complete boolean, topn_scope string, present boolean, rank int, score double, native_heat double, config_version string, sampling_signature string, activity int, ingested_at timestamp"


def obs(hour, rank=None, present=True, score=0.5, platform="zhihu", status="succeeded", scope="top30", activity=None, signature="s", oid=None):
    t = T0 + timedelta(hours=hour)
    return (1, platform, oid or f"o{hour}", f"r{hour}", t, status, True, scope, present, rank, score, None, "v", signature, activity, t)


def analyzed(spark, rows, end=15):
    return trend.analyze(observe.dedup_observations(spark.createDataFrame(rows, OBS)), F.lit(T0 + timedelta(hours=end))).first()


@pytest.mark.parametrize("old,new,want", [(10, 5, "rising"), (5, 10, "cooling"), (5, 5, "stable")])
def test_rank_trend(spark, old, new, want):
    got = analyzed(spark, [obs(12, old), obs(14, new), obs(14, new)])
    assert got["trend"] == want and got["duration_minutes"] == 120


@pytest.mark.parametrize("rows,minutes,want", [
    ([obs(8, 5), obs(10, 5), obs(12, None, False), obs(14, 5)], None, "unknown"),
    ([obs(10, 5), obs(12, 5), obs(14, 5, status="failed")], None, "unknown"),
    ([obs(8, 5), obs(10, 4)], None, "unknown"),
    ([obs(10, 5), obs(14, 4)], None, "unknown"),
    ([obs(12, 5), obs(14, 4, scope="top20")], None, "unknown"),
    ([obs(12, None, score=0.3, platform="weibo", activity=1), obs(14, None, score=0.6, platform="weibo", activity=2)], 120, "rising"),
    ([obs(12, None, score=0.4, platform="weibo"), obs(14, None, score=0.6, platform="weibo")], 120, "unknown"),
    ([obs(12, None, score=0.3, platform="weibo", activity=1), obs(14, None, score=0.6, platform="weibo", activity=2, signature="x")], 120, "unknown"),
    ([obs(12, None, score=0.40, platform="weibo", activity=1), obs(14, None, score=0.42, platform="weibo", activity=2)], 120, "stable"),
])
def test_trend_cases(spark, rows, minutes, want):
    got = analyzed(spark, rows)
    assert got["trend"] == want and got["duration_minutes"] == minutes


def test_presence_is_three_valued(spark):
    rounds = [(1, "zhihu", T0, True, True, "a"), (2, "zhihu", T0 + timedelta(hours=1), True, True, "a"), (3, "zhihu", T0 + timedelta(hours=2), True, True, "b"), (4, "zhihu", T0 + timedelta(hours=3), False, True, "b")]
    m = observe.presence_matrix(spark.createDataFrame([(7, "zhihu")], "event_id int, platform string"), spark.createDataFrame(rounds, "round_id int, platform string, observed_at timestamp, succeeded boolean, complete boolean, scope string"), spark.createDataFrame([(7, 1), (7, 4)], "event_id int, round_id int"))
    assert {r["round_id"]: r["present"] for r in m.collect()} == {1: True, 2: False, 3: None, 4: None}


def test_asof_is_exclusive(spark):
    p = spark.createDataFrame([(1, T0), (1, T0 + timedelta(hours=2))], "k int, observed_at timestamp")
    h = spark.createDataFrame([(1, T0, 10), (1, T0 + timedelta(hours=1), 11)], "k int, observed_at timestamp, v int")
    assert [r["last_v"] for r in observe.last_before(p, h, ["k"]).orderBy("observed_at").collect()] == [None, 11]


def test_trailing_rounds_and_integrity(spark):
    df = spark.createDataFrame([obs(0), obs(10), obs(30)], OBS)
    assert [r["prior_rounds"] for r in observe.trailing_rounds(df).orderBy("observed_at").collect()] == [0, 1, 1]
    bad = spark.createDataFrame([obs(0, 3, None), obs(1, None, False, scope=None), obs(2, 4)], OBS)
    assert {r["observation_id"] for r in observe.integrity(bad).collect()} == {"o0", "o1"}


def test_window_report_is_idempotent(spark):
    rows = [obs(12, 10), obs(14, 5)]
    a, b = (sorted(map(str, window_report.window_report(spark.createDataFrame(r, OBS), T0, T0 + timedelta(hours=15)).collect())) for r in (rows, rows * 2 + [obs(-3, 1)]))
    assert a == b


# classes, guardrails, reports


@pytest.mark.parametrize("zhihu,weibo,zs,ws,official,support,want", [
    (True, True, False, False, True, "supported", "A"), (True, False, False, True, False, "weak_supported", "B"), (True, True, False, False, False, "not_found", "C"), (True, False, False, True, False, "not_found", "C"),
    (True, False, False, False, False, "supported", "D"), (False, True, False, False, False, "not_checked", "E"), (False, False, False, False, True, "not_checked", "F"), (False, False, True, False, False, "not_checked", "u"),
])
def test_classes(spark, zhihu, weibo, zs, ws, official, support, want):
    schema = "zhihu_topn boolean, weibo_topn boolean, zhihu_search boolean, weibo_search boolean, official_source boolean, support_status string, relation_confidence double, rank_bucket string, presence int, rank_delta string, search_hit string, freshness string, health string, flags array<string>"
    got = classify.classify(spark.createDataFrame([(zhihu, weibo, zs, ws, official, support, None, "top3", 1, "rising", "none", "24h", "use", [])], schema)).first()
    assert got["category"][0] == want
    assert [got[k] for k in classify.SORT_KEY][-1] == 0 and got["k_category"] == "ABCDEFu".index(want)


def test_guardrails(spark):
    cards = spark.createDataFrame([(1, 0, 1, "E_x", "x", 1, False), (2, 1, 1, "F_x", "全网热议", 0, False), (3, 1, 1, "C_x", "已坐实", 2, False), (4, 1, 1, "A_x", "x", 2, False)], "id int, n_citations int, n_urls int, category string, text string, n_community_sources int, audit_only boolean")
    assert dict(guardrails.roll_up(guardrails.card_rules().check(cards, "id"), "id").collect()) == {1: "block", 2: "block", 3: "warn", 4: "pass"}
    assert one(spark, guardrails.finalize(F.lit("merge"), F.lit("warn"))) == "candidate_review"
    with pytest.raises(ValueError):
        guardrails.card_rules().register(guardrails.Rule("card_without_url", "warn", lambda: F.lit(True)))


def test_official(spark):
    events = spark.createDataFrame([(1, "某品牌公司发布召回通知", ["某品牌公司"], ["召回", "通知"]), (2, "别的事情", [], ["别的"])], "event_id int, title string, entities array<string>, keywords array<string>")
    pool_schema = "item_id int, title string, text string, entities array<string>, status string, url string, published_at timestamp"
    item = (5, "某品牌公司发布召回通知", "某品牌公司发布召回通知 全文", ["某品牌公司"], "use", "https://gov/1", T0)
    for change, want in (({}, "supported"), ({4: "fallback"}, "weak_supported"), ({5: ""}, "weak_supported"), ({6: T0 - timedelta(days=20)}, "weak_supported"), ({3: ["乙公司"]}, "not_found")):
        pool = spark.createDataFrame([tuple(change.get(k, v) for k, v in enumerate(item))], pool_schema)
        got = {r["event_id"]: r["support_status"] for r in official.support(events, pool, F.lit(T0)).collect()}
        assert got == {1: want, 2: "not_found"}


def test_agenda_and_coverage(spark):
    items = spark.createDataFrame([("A, 会议", "https://x/1", T0, "s1"), ("a会议", "https://x/2", T0, "s2"), ("a会议", "ftp://x", T0, "s3"), ("a会议", "https://x/3", T0 - timedelta(days=9), "s4")], "title string, url string, published_at timestamp, source_name string")
    got = official.agenda(items, F.lit(T0 - timedelta(days=1)), F.lit(T0)).collect()
    assert len(got) == 1 and got[0]["sources"] == 2 and got[0]["event_id"].startswith("official-")
    refs = spark.createDataFrame([(1, "s1", "t"), (1, "s2", "t"), (2, "s1", "t"), (3, "s1", "t"), (3, "s2", "u")], "event_id int, source_name string, title string")
    assert {r["event_id"]: r["level"] for r in official.coverage(refs).collect()} == {1: "multi_source_duplicate", 2: "single_source", 3: "multi_source_independent"}


def test_reports(spark):
    cards = spark.createDataFrame([(1, "b", "A_x", "s", True, False), (1, "b", "A_x", "s", True, False), (2, "a", "E_x", "s", False, True)], "event_id int, title string, category string, section string, zhihu_present boolean, weibo_present boolean")
    cites = spark.createDataFrame([(2, "notaurl", T0, "community"), (2, "https://x", T0 + timedelta(days=9), "community")], "event_id int, url string, observed_at timestamp, kind string")
    errors = {(r["event_id"], r["error"]) for r in report.review(cards, cites, F.lit(T0 - timedelta(days=1)), F.lit(T0)).collect()}
    assert errors == {(1, "duplicate_in_section"), (1, "official_class_without_official_citation"), (2, "invalid_url"), (2, "citation_out_of_window")}
    s = report.sections(cards.dropDuplicates()).collect()
    assert {(r["section"], r["event_id"]) for r in s} == {("category_A_x", 1), ("zhihu", 1), ("category_E_x", 2), ("weibo", 2)}
    new = spark.createDataFrame([(1, "x", "now")], "id int, body string, created string")
    first = report.revisions(new, spark.createDataFrame([], "fingerprint string"), ("created",))
    assert first.count() == 1 and report.revisions(new.withColumn("created", F.lit("later")), first, ("created",)).count() == 0
    rounds = spark.createDataFrame([("a", 1, "succeeded", T0, []), ("b", 1, "succeeded", T0 - timedelta(hours=9), []), ("c", 1, "failed", T0, []), ("d", 1, "succeeded", T0, ["rate_limited"]), ("e", 1, "succeeded", T0, ["missing_author"])], "source_id string, round_id int, status string, observed_at timestamp, flags array<string>")
    assert dict(report.source_health(rounds, F.lit(T0)).collect()) == {"a": "ok", "b": "stale", "c": "unavailable", "d": "degraded", "e": "ok"}


def test_review_queue(spark):
    t = lambda h: T0 + timedelta(hours=h)
    tasks = spark.createDataFrame([("k", t(0), 1, ["a"]), ("k", t(20), 2, ["b"]), ("k", t(30), 3, ["c"]), ("k", t(50), 4, []), ("z", t(0), 5, [])], "relation_key string, observed_at timestamp, task_id int, evidence array<string>")
    got = {(r["relation_key"], r["first_at"]): (r["n"], r["evidence"]) for r in review.consolidate(tasks).collect()}
    assert got == {("k", t(0)): (2, ["a", "b"]), ("k", t(30)): (2, ["c"]), ("z", t(0)): (1, [])}
    claims = spark.createDataFrame([(1, "x", 10), (2, "x", 11), (3, "y", 12)], "task int, key string, event_id int")
    owners = spark.createDataFrame([("y", 99)], "key string, owner_event_id int")
    sel = lambda *ids: spark.createDataFrame([(i,) for i in ids], "task int")
    assert not review.batch_allowed(sel(1, 2), claims, owners, "task", "key")
    assert not review.batch_allowed(sel(3), claims, owners, "task", "key") and review.batch_allowed(sel(1), claims, owners, "task", "key")
    runs = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "x")], "run_id string, parent_run_id string")
    assert {r[0] for r in review.run_scope(runs, "a").collect()} == {"a", "b", "c"}


def test_evaluation(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, False)], "label boolean, predicted boolean")
    got = evaluate.confusion(rows, F.col("label"), F.col("predicted")).first()
    assert (got["tp"], got["fn"], got["tn"], got["precision"], got["recall"], got["f1"]) == (1, 1, 1, 1.0, 0.5, 0.666667)
    none = evaluate.confusion(rows.where("not label and not predicted"), F.col("label"), F.col("predicted")).first()
    assert none["precision"] is None and none["accuracy"] == 1.0
    e = spark.createDataFrame([("a", {"x": "1"}), ("b", {"x": "1", "y": "2"})], "case_id string, expected map<string,string>")
    a = spark.createDataFrame([("a", {"x": "1", "z": "9"}), ("b", {"x": "1"})], "case_id string, actual map<string,string>")
    assert {r["case_id"]: (r["passed"], r["failures"]) for r in evaluate.compare(e, a).collect()} == {"a": (True, []), "b": (False, ["y"])}
    leaks = spark.createDataFrame([(["g", "h"], "dev"), (["g"], "test")], "groups array<string>, split string")
    assert [r["group"] for r in evaluate.split_leaks(leaks).collect()] == ["g"]


# sources and sinks


def test_hot_list(spark):
    payloads = ['{"data":[{"target":{"id":"12","type":"question","title":"T"},"detail_text":"2 万热度"},{"target":{"id":"x","type":"ad","title":"U"}}]}', '{"Data":{"Items":[{"title":"V","url":"https://v"}]}}']
    got = readers.hot_list(spark.createDataFrame([(p,) for p in payloads], "payload string")).orderBy("title").collect()
    assert [(r["rank"], r["title"], r["native_heat"], r["valid"]) for r in got] == [(1, "T", 20000.0, True), (2, "U", None, False), (1, "V", None, False)]


def test_feed(spark):
    xml = "<rss><channel><title>c</title><item><title><![CDATA[A & B]]></title><link>https://a</link><pubDate>Mon, 14 Sep 2026 00:00:00 GMT</pubDate><description>hot 12345 &lt;b&gt; 99 R&D</description></item><item><title>C</title></item></channel></rss>"
    got = readers.feed(spark.createDataFrame([(xml,)], "xml string")).collect()
    assert [(r["rank"], r["title"], r["url"], r["hot_value"]) for r in got] == [(1, "A & B", "https://a", 12345), (2, "C", "", None)]


def test_statuses_and_site_search(spark):
    p = '{"data":{"statuses":[{"idstr":"1","text":"short","long_text":{"long_text_content":"the long text"},"created_at":"Mon Sep 14 00:00:00 +0000 2026","reposts_count":3}]}}'
    got = filters.statuses(spark.createDataFrame([(p,)], "payload string")).first()
    assert (got["status_id"], got["text"], got["created_at"], got["reposts"], got["likes"]) == ("1", "the long text", T0, 3, None)
    pages = ['{"code":"0","data":{"records":[{"title":"<em>A</em>","url":"https://a","displayTime":1789344000000}]}}', '{"code":"1"}', '<script>var docArr = [{"title":"B","url":"https://b","pubtime":"2026-09-14 08:00:00"},{"title":"","url":"https://c"}];</script>']
    got = filters.site_search(spark.createDataFrame([(x,) for x in pages], "payload string")).orderBy("title").collect()
    assert [(r["title"], r["published_at"]) for r in got] == [("A", T0), ("B", T0)]


def test_card_texts(spark):
    s = F.array(F.struct(F.lit("official").alias("platform"), F.lit("o").alias("text")), F.struct(F.lit("weibo").alias("platform"), F.lit("w").alias("text")), F.struct(F.lit("zhihu").alias("platform"), F.lit(" ").alias("text")))
    assert one(spark, filters.card_summary(s)) == "w"
    assert one(spark, filters.representatives(F.col("a")), a=["1", "2", "3", "4"]) == ["1", "3", "4"]
    assert one(spark, filters.representatives(F.col("a")), a=["1"]) == ["1"]
    assert one(spark, filters.trend_label(F.lit("rising"), F.lit(120.0), F.lit(False))) == "rising, seen for 2 h"


def test_articles(spark):
    html = "<html><head><title>x</title><meta property='og:title' content='The title'></head><body><nav>menu menu menu menu menu</nav><article><p>" + "long paragraph " * 8 + "</p><p>short</p></article><script>var a = 'not text not text';</script></body></html>"
    got = readers.articles(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")).orderBy("page_id").collect()
    assert got[0]["title"] == "The title" and got[0]["body"].startswith("long paragraph") and "menu" not in got[0]["body"] and "not text" not in got[0]["body"]
    assert got[1]["title"] is None and got[1]["body"] is None


def test_summary_keeps_order_and_budget(spark):
    body = "无关的一句话在这里。品牌召回通知发布于2026年。另一个无关的句子啊。品牌召回的范围真的很大哦。"
    got = one(spark, readers.extract_summary(F.col("t"), F.col("b"), 2, 600), t="品牌召回", b=body)
    assert got == "品牌召回通知发布于2026年。\n品牌召回的范围真的很大哦。"


def test_replay_and_normalisation(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"run_id":"r","source_id":"s","status":"succeeded","observed_at":"2026-09-14T00:00:00Z","requested_limit":30,"list_complete":true,"items":[{"source_id":"s","title":"<b>Some&nbsp;title</b>","published_raw":"bad","content":"see https://x.org/1 now","external_id":"7"}]}\n')
    rounds = readers.observation_metadata(readers.replay(spark, str(tmp_path)))
    assert rounds.first()["topn_scope"] == "top30:skip=0" and rounds.first()["observation_id"] == "r:s:2026-09-14T00:00:00"
    item = normalize.normalize_items(readers.round_items(rounds).withColumn("topics", F.array().cast(ARRAY))).first()
    assert item["title"] == "Some title" and item["content_text"] == "see now"
    assert item["quality_flags"] == ["missing_url", "missing_summary", "missing_fetched_at", "invalid_published_at"]


def test_writers(spark, tmp_path):
    a = spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], "k int, v int, s string")
    b = spark.createDataFrame([(2, 2, "z"), (3, 1, "w"), (1, 0, "old")], "k int, v int, s string")
    assert {r["k"]: r["s"] for r in writers.upsert(a, b, ["k"], "v").collect()} == {1: "x", 2: "z", 3: "w"}
    assert {r["k"] for r in writers.new_rows(b, a, ["k"]).collect()} == {3}
    writers.append_log(spark.createDataFrame([(T0, "m")], "ts timestamp, m string"), str(tmp_path / "log"))
    assert (tmp_path / "log" / "day=2026-09-14").exists()


def test_streams_equal_batches(spark, tmp_path):
    from eventide.streaming import rounds

    rows = [obs(h, platform="weibo", score=s, oid=f"o{h}") for h, s in ((1, 0.1), (2, 0.3), (3, 0.3), (9, 0.1))]
    spark.createDataFrame(rows, OBS).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(OBS).parquet(str(tmp_path / "in"))

    def drain(df, mode):
        df.writeStream.format("memory").queryName("drained").outputMode(mode).trigger(once=True).start().awaitTermination()
        return spark.table("drained").collect()

    assert [r["trend"] for r in sorted(drain(rounds.running_trend(stream()), "append"), key=lambda r: r["observed_at"])] == ["unknown", "rising", "stable", "cooling"]
    assert sorted(r["n"] for r in drain(rounds.presence_sessions(stream()), "complete")) == sorted(r["n"] for r in rounds.presence_sessions(spark.createDataFrame(rows, OBS)).collect()) == [1, 3]
    assert len(drain(rounds.distinct_observations(stream()), "append")) == 4
    windows = drain(rounds.rolling_presence(stream(), "2 hours", "1 hour"), "complete")
    assert {(r["end"] - T0).total_seconds() / 3600: r["n"] for r in windows}[3] == 2  # (1, 3] holds 2 and 3


# briefings, recording, recovery, evaluation of profiles

CITED = "event_id string, item_id int, observed_at timestamp, prior boolean"
ITEM = "item_id int, url string, title string, source_name string, source_type string, platform string, published_at timestamp, fetched_at timestamp, audit_only boolean, contributes boolean"
CARD_EVENT = "event_id string, title string, category string, zhihu_topn boolean, weibo_topn boolean, official_source boolean"


def _cited(spark):
    day, week = timedelta(hours=2), timedelta(days=7)
    members = [("e1", 1, T0 - day, False), ("e1", 1, T0 - day, False), ("e1", 2, None, False), ("e1", 3, None, True), ("e2", 4, T0 - week, False), ("e3", 5, T0 - day, False), ("e1", 6, None, False)]
    items = [
        (1, "https://x.org/1", "t1", "a", "community", "zhihu", None, T0, None, None), (2, None, "n", "b", "official_news", "official", T0 - day, T0, False, True),
        (3, "https://x.org/3", "n", "c", "official_news", "official", T0 - week, T0, True, False), (4, "https://x.org/4", "n", "d", "community", "weibo", None, T0, False, True),
        (5, "https://x.org/5", "n", "e", "community", "weibo", None, T0, True, True), (6, " ", "n", "c", "official_news", "official", T0 - week, T0, False, True),
    ]
    return briefing.citations(spark.createDataFrame(members, CITED), spark.createDataFrame(items, ITEM), F.lit(T0 - timedelta(days=1)), F.lit(T0))


def test_citations(spark):
    got = {(r["event_id"], r["item_id"]): (r["role"], r["is_prior"], r["missing_url"]) for r in _cited(spark).collect()}
    assert got == {("e1", 1): ("supporting", False, False), ("e1", 2): ("official_support", False, True), ("e1", 3): ("official_support", True, False)}


def test_cards_and_sections(spark):
    events = spark.createDataFrame([("e1", "t1", "A_x", True, True, True), ("e2", "t2", "E_x", False, True, False), ("e1", "t1", "A_x", True, True, True), ("e4", None, "F_x", None, None, None)], CARD_EVENT)
    cards = briefing.cards(events, _cited(spark), "本期").cache()
    got = {r["event_id"]: r for r in cards.collect()}
    assert len(got) == cards.count() == 3
    assert (got["e1"]["n_citations"], got["e1"]["official_sources"], got["e1"]["title_is_source_quote"], got["e1"]["excluded"]) == (3, 2, True, None)
    assert got["e1"]["summary"] == "本期见于知乎、微博、官媒。官媒依据含此前报道，不代表官媒本期新发布报道。"
    assert got["e2"]["excluded"] == got["e4"]["excluded"] == "missing_current_citation"
    ranking = spark.createDataFrame([], "event_id string, platform string, present boolean, rank int, score double")
    assert sorted((r["section"], r["event_id"], r["place"]) for r in briefing.sections(cards, ranking).collect()) == [("A", "e1", 1), ("shared", "e1", 1), ("weibo", "e1", 1), ("zhihu", "e1", 1)]
    risk = briefing.risks(cards, spark.createDataFrame([("ok",), ("stale",)], "health string"), spark.createDataFrame([("pending",)], "status string")).first()
    assert risk.asDict() == {"excluded": 2, "official_news": 0, "community_events": 1, "sources_in_doubt": 1, "pending_reviews": 1}


def test_platform_sections_follow_their_own_ranking(spark):
    flags = {"official_sources": F.lit(0), "official_latest": F.lit(None).cast("timestamp"), "official_new": F.lit(False), "excluded": F.lit(None).cast("string")}
    cards = spark.createDataFrame([(k, "t", "E_x", True, False, False) for k in ("a", "b", "c", "d")], CARD_EVENT).withColumns(flags)
    ranking = spark.createDataFrame([("a", "zhihu", False, 1, 1.0), ("b", "zhihu", True, 9, 0.1), ("c", "zhihu", True, 2, 0.1)], "event_id string, platform string, present boolean, rank int, score double")
    assert [r["event_id"] for r in briefing.sections(cards, ranking).where("section = 'zhihu'").orderBy("place").collect()] == ["c", "b", "d", "a"]


def test_record_round(spark):
    tracked = spark.createDataFrame([("e1", "zhihu"), ("e2", "zhihu"), ("e3", "weibo")], "event_id string, platform string")
    rounds = spark.createDataFrame([("r1", "zhihu", T0, True, True, "s"), ("r2", "zhihu", T0 + timedelta(hours=1), False, True, "s"), ("w1", "weibo", T0, True, False, "s")], "round_id string, platform string, observed_at timestamp, succeeded boolean, complete boolean, scope string")
    items = spark.createDataFrame([("r1", "h1", 5, 9.0), ("r1", "h1", 3, None), ("r1", "hx", 1, 1.0), ("r2", "h1", 2, 9.0)], "round_id string, content_hash string, rank int, native_heat double")
    pairs = lambda *rows: spark.createDataFrame(list(rows), "content_hash string, event_id string")
    scores = spark.createDataFrame([("e1", "zhihu", "r1", 0.5), ("e2", "zhihu", "r1", 0.6)], "event_id string, platform string, round_id string, score double")
    run = lambda over: {(r["event_id"], r["round_id"]): (r["present"], r["rank"], r["native_heat"], r["score"]) for r in round_record.record_round(tracked, rounds, items, pairs(("h1", "e1")), over, scores).collect()}
    got = run(spark.createDataFrame([], "content_hash string, event_id string"))
    assert got == {("e1", "r1"): (True, 3, 9.0, 0.5), ("e2", "r1"): (False, None, None, None), ("e1", "r2"): (None, None, None, None), ("e2", "r2"): (None, None, None, None), ("e3", "w1"): (None, None, None, None)}
    assert run(pairs(("h1", "e2")))[("e2", "r1")] == (True, 3, 9.0, 0.6)


def test_recovery_of_technical_reviews(spark):
    h = lambda n: T0 + timedelta(hours=n)
    old = "review_id int, status string, category string, flags array<string>, item_ids array<int>, identity array<string>, first_failed_at timestamp, last_failed_at timestamp"
    new = "event_id string, event_signal_id string, action string, review_required boolean, blocked boolean, flags array<string>, item_ids array<int>, identity array<string>, observed_at timestamp"
    t = "technical_error"
    reviews = spark.createDataFrame([
        (1, "pending", t, [], [1, 2], ["url:a"], h(0), h(1)), (2, "pending", t, [], [9], ["url:k"], h(0), h(1)), (3, "pending", t, ["time_conflict"], [1], ["url:k"], h(0), h(1)),
        (4, "pending", "candidate", None, [1], ["url:k"], h(0), h(1)), (5, "done", t, None, [1], None, h(0), h(1)), (6, "pending", t, None, [8], ["signal:x"], h(0), h(1)),
        (7, "pending", t, None, [1], ["weibo:z"], h(-48), h(1)), (8, "pending", t, None, [1], ["url:b"], h(0), h(5)), (9, "pending", t, None, [], None, h(0), h(1)),
    ], old)
    accepted = spark.createDataFrame([("e1", "s1", "merge", False, False, None, [1, 2, 2], ["url:k"], h(3)), ("e0", "s0", "merge", True, False, [], [9], ["url:k"], h(2)), ("e2", "s2", "create", False, False, [], [7], ["signal:x"], h(3))], new)
    assert {(r["review_id"], r["event_id"], r["basis"]) for r in review.recover(reviews, accepted).collect()} == {(1, "e1", "items"), (2, "e1", "topic")}


def test_consolidation_equals_a_plain_loop(spark):
    import random

    rnd = random.Random(5)
    rows = [(f"k{rnd.randrange(4)}", T0 + timedelta(minutes=rnd.randrange(20_000)), i, [f"x{i % 3}"]) for i in range(600)] + [("k0", T0, 1000 + i, None) for i in range(50)] + [(None, T0, 2000, [])]
    got = sorted((r["relation_key"] or "", r["first_at"], r["last_at"], r["n"], tuple(r["evidence"])) for r in review.consolidate(spark.createDataFrame(rows, "relation_key string, observed_at timestamp, task_id int, evidence array<string>")).collect())
    want, key, group = [], object(), None
    for k, t, _, e in sorted(((k, t, i, e) for k, t, i, e in rows if k), key=lambda r: r[:3]):
        if k != key or t - group[1] > timedelta(hours=24):
            key, group = k, [k, t, t, 0, set()]
            want.append(group)
        group[2], group[3] = t, group[3] + 1
        group[4] |= set(e or [])
    assert got == sorted((*g[:4], tuple(sorted(g[4]))) for g in want)


def test_profiles_and_suites(spark):
    base = spark.createDataFrame([(1, True), (2, False), (3, True)], "case_id int, passed boolean")
    runs = spark.createDataFrame([("rules", 1, False), ("rules", 2, True), ("rules", 3, True), ("rules", 4, True), ("hybrid", 1, True)], "profile string, case_id int, passed boolean")
    assert {tuple(r) for r in evaluate.ablation(base, runs).collect()} == {("rules", 3, 2, 1, 1), ("hybrid", 1, 1, 0, 0)}
    cases = "case_id int, kind string, expected map<string,string>"
    a, b = spark.createDataFrame([(1, "m", {"x": "1"}), (2, "m", {"x": "2"}), (3, "n", {"y": "1"})], cases), spark.createDataFrame([(1, "m", {"x": "1"}), (2, "m", {"x": "3"})], cases)
    assert {tuple(r) for r in evaluate.changed_labels(a, b).collect()} == {(2, "relabelled"), (3, "missing")}
    found = spark.createDataFrame([(1, {"x": "1", "z": "0"}), (2, {"x": "9"})], "case_id int, actual map<string,string>")
    assert {tuple(r) for r in evaluate.suite(a, found).collect()} == {("m", 2, 1, 1, 0.5), ("n", 1, 0, 1, 0.0)}
    assert C.profile("hybrid").use_embedding and not C.profile("hybrid").use_reranker and C.profile("hybrid_rerank").use_reranker
    with pytest.raises(ValueError):
        C.profile("x")


@pytest.mark.parametrize("stated,problem", [("2026-09-14T08:00:00Z", None), ("2026-09-14T08:00+08:00", None), (None, None), ("2026-09-14", "llm_occurrence_timezone_missing"), ("2026-09-14T08:00", "llm_occurrence_timezone_missing"), ("2026-13-40", "llm_invalid_occurrence_time"), ("昨天", "llm_invalid_occurrence_time"), ("", "llm_invalid_occurrence_time")])
def test_occurrence_times(spark, stated, problem):
    assert spark.createDataFrame([(stated,)], "t string").select(N.occurrence_problem(F.col("t"))).first()[0] == problem


def test_relative_words_aliases_and_reasons(spark):
    at = F.lit(datetime(2026, 9, 14, 20))
    assert one(spark, N.reference_date(F.col("t"), F.lit(None).cast("string"), at), t="昨天发生") == "2026-09-15"
    assert one(spark, N.reference_date(F.col("t"), F.lit(""), at), t="九月发生") is None
    assert one(spark, X.remap_ids(F.col("a"), F.create_map(F.lit("document:0"), F.lit("s7"))), a=["document:0", "other"]) == ["s7", "other"]
    why = lambda flags, seen, present, p: one(spark, filters.unknown_trend_reason(F.col("f"), F.lit(seen), F.lit(present), F.lit(p)), f=flags)
    assert why(["observation_gap", "stale_observation"], 1, True, "zhihu").startswith("最近观测已过期")
    assert why([], 1, True, "zhihu").startswith("仅有1次在榜观测，需要") and why([], 2, False, "weibo").startswith("最近一轮已离榜")
    assert why(["insufficient_trend_metrics"], 2, True, "weibo") == "缺少两轮可比的CLI互动指标"


def test_backup_resume_and_report_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, version string")
    target = writers.backup({"t": df}, str(tmp_path), "1")
    assert spark.read.parquet(f"{target}/t").count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        writers.backup({"t": df}, str(tmp_path), "1")
    assert [r["id"] for r in writers.pending(df.select("id"), df, ["id"], "a").collect()] == [2]
    writers.evaluation_report(df, str(tmp_path / "r"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "r/md")).collect()] == ["| id | version |", "|-|-|", "| 1 | a |", "| 2 | b |"]
    assert spark.read.json(str(tmp_path / "r/json")).count() == 2


def test_candidates_fit_or_are_retrieved(spark):
    pool = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3), ("b", 3)], "q string, d int")
    ranked = spark.createDataFrame([("b", 3, 1), ("b", 1, 2), ("b", 2, 3)], "q string, d int, rank int")
    assert {tuple(r) for r in retrieve.select_candidates(pool, ranked, "q", "d", 2).collect()} == {("a", 1, "all_within_limit"), ("a", 2, "all_within_limit"), ("b", 3, "retrieved"), ("b", 1, "retrieved")}


def test_entry_without_the_corpus_operators(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.reload(importlib.import_module("__spark_entry__"))
    assert "heat_aggregate" in entry.queries() and not any(n.startswith("op") and n[2:3].isdigit() for n in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.undo()
    importlib.reload(entry)
