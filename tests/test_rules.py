"""Rules of the event engine on cases of their own, and operators against brute force."""

import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventide.config import MatchConfig, TrendConfig
from eventide.functions import numbers as N
from eventide.functions import text as X
from eventide.operators import evaluate, filters, guardrails, match, normalize, observe, official, ranking, report, retrieve, review, trend
from eventide.plans import briefing, resolution
from eventide.sources import readers, shared

T0 = datetime(2026, 9, 14)
ARRAY = "array<string>"


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.array(*map(F.lit, v)).cast(ARRAY) if isinstance(v, list) else F.lit(v))
    return df.select(column.alias("x")).first()["x"]


# facts


@pytest.mark.parametrize(
    "a,b,want",
    [
        ("2026年9月1日召开会议", "2026-09-01召开会议", []),
        ("2026年9月1日召开会议", "2026-09-02召开会议", ["explicit_date_conflict"]),
        ("2026年13月1日召开会议", "2026-09-02召开会议", []),
        ("江城市东门大桥封闭", "东门大桥封闭", []),
        ("江城市东门大桥封闭", "江城市西门大桥封闭", ["named_object_conflict"]),
        ("江城全市停水", "海城市停水", ["location_conflict"]),
        ("K-9 型汽车", "k9 型汽车", []),
        ("XK9 型汽车", "K9 型汽车", ["model_conflict"]),
        ("发布召回通知", "汽车召回", []),
        ("酷暑来袭", "高温来袭", []),
    ],
)
def test_facts(spark, a, b, want):
    assert one(spark, X.conflicts(X.facts(F.col("a")), X.facts(F.col("b"))), a=a, b=b) == want
    assert one(spark, X.conflicts(X.facts(F.col("b")), X.facts(F.col("a"))), a=a, b=b) == want


def test_anchors_and_grounded_entities(spark):
    assert one(spark, X.anchors(X.facts(F.col("a")), X.facts(F.col("b"))), a="江城市东门大桥与K-9", b="K9 东门大桥") == ["model:k9"]
    conflict = lambda a, b, ta, tb: one(spark, X.entity_conflict(F.col("a"), F.col("b"), ("公司",), F.col("ta"), F.col("tb")), a=a, b=b, ta=ta, tb=tb)
    assert conflict(["甲公司"], ["乙公司"], "甲公司道歉", "乙公司道歉")
    assert not conflict(["甲公司"], ["乙公司"], "甲公司道歉", "有人道歉")
    assert conflict(["Acme"], ["Beta"], "Acme recalls cars", "beta recalls cars")
    assert not conflict(["Acme"], ["Beta"], "Acme recalls cars", "Cars of Beta")


@pytest.mark.parametrize("raw,clean", [("a&hellip;b &#20013;&ldquo;x&rdquo;", "a…b 中“x”"), ("&lt;b&gt;t&lt;/b&gt;", " t "), ("a&nbsp;b&amp;lt;", "a b&lt;"), (None, None), ("x &amp y", "x & y")])
def test_html(spark, raw, clean):
    assert one(spark, X.strip_html(F.col("t").cast("string")), t=raw) == clean


def test_ngrams_of_a_long_text(spark):
    """Once, each pair of characters worked the whole text out again: 40,000 characters took minutes."""
    df = spark.createDataFrame([(f"{'ab c' * 10_000}😀d",)], "t string")
    began = time.monotonic()
    assert sorted(df.select(X.ngrams(X.normalize_words(F.col("t")), 2, 2)).first()[0]) == ["ab", "bc", "ca", "cd"]
    assert time.monotonic() - began < 60
    for t, want in (("a😀b", ["a😀", "😀b", "a😀b"]), ("a", []), ("", []), (None, [])):
        assert one(spark, X.ngrams(F.col("t").cast("string"), 2, 3), t=t) == want


def test_parents_of_a_frequent_key(spark):
    """100,000 children and as many parents of one key: no pairs are made."""
    n = 100_000
    parents = spark.range(n).selectExpr("'p' as platform", "id as parent_id", "'r' as ref", "concat('u', id) as url")
    children = spark.range(n).selectExpr("'p' as platform", "id as child_id", "if(id % 2 = 0, 'r', null) as ref", "if(id % 4 = 0, null, concat('u', id)) as url")
    got = observe.attach_parents(children, parents)
    assert got.columns == ["child_id", "parent_id"] and got.where("child_id <> parent_id or child_id % 2 = 0").isEmpty() and got.count() == n // 2
    parents = spark.createDataFrame([("p", 1, "a", "b"), ("p", 2, "c", None), ("q", 3, "a", "a"), ("p", 1, "d", None), ("p", None, "e", None)], "platform string, parent_id int, ref string, url string")
    children = spark.createDataFrame([("p", 1, "a", "b"), ("p", 2, "a", "c"), ("p", 3, None, None), ("q", 4, "a", None), ("p", 5, "b", "d"), ("p", 6, "e", None), ("p", 7, "a", "e")], "platform string, child_id int, ref string, url string")
    assert {tuple(r) for r in observe.attach_parents(children, parents).collect()} == {(1, 1), (4, 3), (5, 1), (7, 1)}


def test_hard_identities_make_a_pair_once(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(match, "CHUNK", 6)
    monkeypatch.setattr(match, "CARRIED", 4)

    def side(n, most):
        return [(i, [[f"k{rng.randint(0, 12)}" for _ in range(rng.choice([0, 1, 1, 2, most]) if rng.random() < 0.5 else 0)] + [""] * rng.randint(0, 1) for _ in match.IDENTITIES]) for i in range(n)]

    left, right = [*side(60, 3), (3, [["k1"], None, [None], [], ["k2", "k2"]])], side(50, 4)
    made = lambda rows, name: spark.createDataFrame([(i, *v) for i, v in rows], f"{name} int, " + ", ".join(f"{k} array<string>" for k in match.IDENTITIES)).repartition(4)
    of = lambda rows: {(i, k, x) for i, v in rows for k, xs in zip(match.IDENTITIES, v, strict=True) for x in xs or () if x}
    want = defaultdict(set)
    for (a, k, x), (b, j, y) in itertools.product(of(left), of(right)):
        if (k, x) == (j, y):
            want[a, b].add(k)
    got = match.hard_identities(made(left, "signal_id"), made(right, "event_id"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((a, b, bool(k - {"urls"}), "urls" in k) for (a, b), k in want.items())
    assert {len(k) for k in want.values()} > {1, 2}
    sizes = [Counter(i for i, *_ in of(rows)).values() for rows in (left, right)]
    assert all(min(n) <= 4 < max(n) for n in sizes)


def test_recovery_equals_all_pairs(spark):
    rng = random.Random(8)
    at = lambda n: None if n is None else T0 + timedelta(hours=n)
    some = lambda *v: rng.choice([*v, None])
    reviews = [(i, rng.sample(range(6), rng.choice([0, 1, 1, 2, 3])), rng.sample(["url:a", "url:b", "weibo:c", "signal:d"], rng.choice([0, 1, 1, 2])), some(0, -30), rng.randint(0, 5), some(1, 2), some(1, 3)) for i in range(150)]
    reviews += [(150, [None, 1], ["url:a"], 0, 1, None, None), (151, None, ["url:b"], 0, 1, 1, 1), (152, [1], ["url:a"], 0, None, 1, 1)]
    results = [(f"e{rng.randint(0, 3)}", f"s{i}", rng.sample(range(6), rng.choice([0, 1, 2, 4])), rng.sample(["url:a", "url:b", "weibo:c", "signal:d"], rng.choice([0, 1, 1, 2])), rng.randint(0, 6), some(1, 2, 3), some(1, 2, 4), some(True, False)) for i in range(40)]
    owned = [(i, rng.choice(["e0", "e1", None])) for i in range(5)]
    old = spark.createDataFrame([(i, "pending", "technical_error", None, items, ident, at(a), at(b), n, at(c)) for i, items, ident, a, b, n, c in reviews], "review_id int, status string, category string, flags array<string>, item_ids array<int>, identity array<string>, first_failed_at timestamp, last_failed_at timestamp, attempt bigint, created_at timestamp")
    new = spark.createDataFrame([(e, s, "merge", False, False, None, items, ident, at(t), n, at(a), h) for e, s, items, ident, t, n, a, h in results], "event_id string, event_signal_id string, action string, review_required boolean, blocked boolean, flags array<string>, item_ids array<int>, identity array<string>, observed_at timestamp, attempt bigint, accepted_at timestamp, by_human boolean")

    def want(owners):
        out = {}
        for i, items, ident, since, failed, n, made in reviews:
            for e, _, got, named, t, m, accepted, human in results:
                bases = [b for b, ok in (("items", items and set(items) <= set(got)), ("topic", ident and set(ident) == set(named) and "signal:d" not in ident)) if ok]
                tie = m > n if m is not None and n is not None else bool(human) or (accepted is not None and made is not None and accepted > made)
                ok = bases and failed is not None and (t > failed or (t == failed and tie)) and ("weibo:c" not in ident or (since is not None and t - since <= 24))
                if ok and owners is not None:
                    ok = all(x in owners and owners[x] in (None, e) for x in items or ())
                if ok:
                    out[i] = min(out.get(i, (99,)), (t, e, bases[0]))
        return {i: (e, b, at(t)) for i, (t, e, b) in out.items()}

    for owners in (None, dict(owned)):
        table = owners and spark.createDataFrame(owned, "item int, event_id string")
        got = {r["review_id"]: (r["event_id"], r["basis"], r["success_at"]) for r in review.recover(old, new, 24, table).collect()}
        assert got == want(owners) and len(got) > 20 and {b for _, b, _ in got.values()} == {"items", "topic"}


def test_recovery_of_a_frequent_topic(spark):
    """60,000 reviews and as many results of one topic and of one item: no pairs are made."""
    n = 60_000
    t = "timestamp_seconds(id * 10 + {})"
    old = spark.range(n).selectExpr("id as review_id", "'pending' as status", "'technical_error' as category", "array('x') as flags", "array(1L) as item_ids", "array('url:a') as identity", f"{t.format(0)} as first_failed_at", f"{t.format(5)} as last_failed_at")
    new = spark.range(n).selectExpr("id as event_id", "id as event_signal_id", "'merge' as action", "false as review_required", "false as blocked", "array('x') as flags", "array(1L, id + 2) as item_ids", "array('url:a') as identity", f"{t.format(5)} as observed_at")
    got = review.recover(old, new)
    assert got.count() == n - 1 and got.where("event_id <> review_id + 1 or basis <> 'items'").isEmpty()


def test_links_quotes_and_edges(spark):
    assert one(spark, X.clean_body(F.col("t")), t="see www.x.org/a and HTTPS://y.org now") == "see and now"
    assert one(spark, X.phrases(F.col("t")), t="it's 'quoted words' here") == ["s ", "quoted words"] or "quoted words" in one(spark, X.phrases(F.col("t")), t="say 'quoted words' here")
    assert one(spark, X.strip_question(F.col("t")), t="好、、看 www.x.org") == "好、看"
    assert one(spark, X.term_edges(F.col("t")), t="《“词-语”》, ") == "词-语"


@pytest.mark.parametrize("stated,day", [("2026-W36-2", "2026-09-01"), ("2026W362", "2026-09-01"), ("2026-W36", "2026-08-31"), ("2020-W53-5", "2021-01-01"), ("2021-W53-1", None), ("2026-W00-1", None), ("2026-36-2", None)])
def test_week_dates(spark, stated, day):
    assert one(spark, N.iso_week_day(F.col("t")).cast("string"), t=stated) == day
    assert one(spark, N.occurrence_problem(F.col("t")), t=stated) == ("llm_occurrence_timezone_missing" if day else "llm_invalid_occurrence_time")


# relevance of search results


@pytest.mark.parametrize(
    "title,text,flags,pu,eu,want",
    [
        ("某品牌汽车召回", "某品牌汽车召回", [], None, None, ("accepted", 0.88, False)),
        ("毫不相干的话", "毫不相干的话", [], None, None, ("audit_only", 0.1, True)),
        ("毫不相干的话", "正文提到 某品牌 汽车召回 一事", [], None, None, ("accepted", 0.88, False)),
        ("毫不相干的话", "x", ["place_conflict"], None, None, ("rejected", 0.0, True)),
        ("毫不相干的话", "x", ["marketing_spam"], None, None, ("rejected", 0.0, True)),
        ("毫不相干的话", "x", [], "https://www.zhihu.com/question/12", "https://zhihu.com/search?question=12", ("accepted", 0.95, False)),
    ],
)
def test_search_relevance(spark, title, text, flags, pu, eu, want):
    r = normalize.search_relevance(F.col("p"), F.col("p"), F.col("t"), normalize.combined_text(F.col("t"), F.col("x")), F.col("f"), F.col("pu").cast("string"), F.col("eu").cast("string"))
    assert tuple(one(spark, r, p="某品牌汽车召回", t=title, x=text, f=flags, pu=pu, eu=eu)) == want


def plain_keywords(title, generic, actions):
    breaks = " \t\n\u3000,，。.!！？?;；:：、/\\|()[]{}<>《》「」『』“”\"'`~"
    phrases = list(dict.fromkeys(re.findall(r"#([^#\s]+)#?", title) + re.findall(r"[《「『“\"']([^》」』”\"']{2,30})[》」』”\"']", title)))
    tokens = "".join(" " if c in breaks else c for c in title).split(" ")
    out = phrases + tokens
    for run in re.findall("[\u4e00-\u9fff]{2,}", title):
        out += ([run] if len(run) <= 8 else []) + [run[i : i + n] for n in (2, 3, 4) for i in range(len(run) - n + 1)]
    out = [t.strip(" #，。！？!?;；:：、/\\|()[]{}<>《》「」『』“”\"'`~") for t in out]
    return list(dict.fromkeys(t for t in out if t and t not in actions and not any(g in t for g in generic)))[:8]


def test_keywords(spark):
    rng = random.Random(12)
    pieces = ["江城", "大桥", "召回", "最新", "网友热议", "突然停电一小时又恢复", "Acme", "X9", "#话题#", "《新书》", "“引语”", "，", "！", " ", " ", "a", "v2.0", "~"]
    titles = ["".join(rng.choices(pieces, k=rng.randint(0, 9))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in titles], "t string").repartition(1)
    for generic, actions in ((("最新", "网友"), ("召回",)), ((), ())):
        got = {r["t"]: r["k"] for r in df.select("t", X.keywords(F.col("t"), generic, actions).alias("k")).collect()}
        assert got == {t: plain_keywords(t, generic, actions) for t in titles}


# pairs of rounds


def pair(spark, platform, old, new, gap=30):
    base = {"event_id": 1, "platform": platform, "present": True, "collection_status": "succeeded", "list_complete": True, "topn_scope": "top30", "rank": None, "score": 0.5, "native_heat": None, "config_version": "v", "sampling_signature": "s", "activity": 5, "component_signature": "c", "score_basis": "b", "score_status": "ok", "flags": [], "main_source": True}
    schema = "event_id int, platform string, present boolean, collection_status string, list_complete boolean, topn_scope string, rank int, score double, native_heat double, config_version string, sampling_signature string, activity int, component_signature string, score_basis string, score_status string, flags array<string>, main_source boolean, observed_at timestamp, observation_id string"
    rows = [base | old | {"observed_at": T0, "observation_id": "a"}, base | new | {"observed_at": T0 + timedelta(minutes=gap), "observation_id": "b"}]
    r = trend.latest_pair(spark.createDataFrame([tuple(x[c.split()[0]] for c in schema.split(", ")) for x in rows], schema)).first()
    return r["trend"], r["basis"], r["reason"]


@pytest.mark.parametrize(
    "platform,old,new,want",
    [
        ("zhihu", {"native_heat": 100.0, "rank": 3}, {"native_heat": 120.0, "rank": 9}, ("rising", "native_heat", None)),
        ("zhihu", {"native_heat": None, "rank": 3}, {"native_heat": 120.0, "rank": 1}, ("unknown", None, "incomparable_scores")),
        ("zhihu", {"native_heat": 100.0}, {"native_heat": 90.0, "component_signature": "d"}, ("unknown", None, "incomparable_scores")),
        ("zhihu", {"rank": 3}, {"rank": 5}, ("cooling", "rank", None)),
        ("zhihu", {"score": 0.5}, {"score": 0.6}, ("rising", "score", None)),
        ("zhihu", {"score": 0.5}, {"score": 0.6, "score_status": "unknown"}, ("unknown", None, "incomparable_scores")),
        ("weibo", {"score": 0.5}, {"score": 0.6, "activity": 9}, ("rising", "score", None)),
        ("weibo", {"score": 0.5}, {"score": 0.6}, ("unknown", None, "incomparable_scores")),
        ("weibo", {"score": 0.5}, {"score": 0.6, "activity": 9, "flags": ["sampling_changed"]}, ("unknown", None, "incomparable_scores")),
        ("weibo", {"score": 0.5, "flags": ["sampling_changed"]}, {"score": 0.6, "activity": 9, "flags": None}, ("unknown", None, "incomparable_scores")),
        ("weibo", {"score": 0.5, "flags": None}, {"score": 0.6, "activity": 9, "flags": None}, ("rising", "score", None)),
        ("weibo", {"score": 0.5}, {"score": 0.6, "activity": None}, ("unknown", None, "insufficient_trend_metrics")),
        ("weibo", {"score": 0.5, "score_basis": "rss_presence_only"}, {"activity": 9}, ("unknown", None, "insufficient_trend_metrics")),
        ("weibo", {"present": False}, {"activity": 9}, ("unknown", None, "insufficient_trend_metrics")),
        ("weibo", {"list_complete": False}, {"activity": 9}, ("unknown", None, "incomplete_list")),
        ("weibo", {"topn_scope": "top20"}, {"activity": 9}, ("unknown", None, "incomparable_scope")),
        ("weibo", {"main_source": False}, {"activity": 9}, ("unknown", None, "insufficient_history")),
    ],
)
def test_latest_pair(spark, platform, old, new, want):
    assert pair(spark, platform, old, new) == want
    assert pair(spark, platform, old, new, gap=121)[0] == "unknown"


def test_platform_ranking_within_a_category(spark):
    rows = [(1, "zhihu", "A", True, None, 0.9, None), (2, "zhihu", "A", True, 7, None, 1.0), (3, "zhihu", "A", None, 1, 0.9, 9.0), (4, "zhihu", "A", True, 7, None, 5.0), (5, "zhihu", "B", False, 1, 0.1, 0.0), (6, "weibo", "A", True, 9, 0.2, 0.0), (7, "weibo", "A", True, 1, 0.1, 0.0), (8, "weibo", "A", True, None, None, 0.0)]
    got = {r["event_id"]: r["place"] for r in trend.platform_ranking(spark.createDataFrame(rows, "event_id int, platform string, category string, present boolean, rank int, score double, duration_minutes double")).collect()}
    assert got == {4: 1, 2: 2, 1: 3, 3: 4, 5: 1, 6: 1, 7: 2, 8: 3}


# articles

BODY = "怀化国际陆港前三季度累计发运班列1051列，共计52524标箱，同比增长16%。怀化国际陆港开通多条国际物流运输线路，促进当地企业与东盟国家的经贸往来。港口工作人员介绍，目前班列运行组织保持稳定，将继续根据企业需求优化运输服务。"
TITLE = "怀化国际陆港前三季度发运班列1051列"


def page(container="left_zw", title=TITLE, body=BODY):
    return f'<html><meta property="og:title" content="{title}"><meta property="article:published_time" content="2026-10-21T10:00:00+08:00"><nav>首页导航无关内容</nav><div class="{container}"><p>{body}</p><p>{body}</p><p>责任编辑：某某，推荐阅读其他新闻内容</p><script>广告跟踪代码</script></div><footer>版权声明</footer></html>'


def test_articles_by_container(spark):
    html = [page(c) for c in ("left_zw", "rm_txt_con cf", "main-aticle", "other")] + [page(title="另一篇文章"), page(body="短" * 20), "<article><h1>怀化国际陆港</h1>" + BODY + "</article>" + page(body="另" * 50 + "。" * 40), ""]
    d = spark.createDataFrame([(k, h, TITLE) for k, h in enumerate(html)], "page_id int, html string, want string")
    got = {r["page_id"]: r for r in readers.articles(d, expected="want").collect()}
    assert all(got[k]["body"] == BODY and got[k]["problem"] is None and got[k]["published_raw"].startswith("2026-10-21") for k in range(3))
    assert [got[k]["problem"] for k in range(3, 8)] == ["article_body_missing", "article_title_mismatch", "article_body_too_short", None, "article_title_mismatch"]
    assert got[6]["body"] == "怀化国际陆港 " + BODY  # the longest container, which has no paragraphs
    summary = one(spark, readers.extract_summary(F.col("t"), F.col("b")), t=TITLE, b=BODY)
    assert "1051列" in summary and all(x in BODY for x in summary.split("\n"))


def plain_article(html):
    """The rule of articles read from a tree of tags, for pages whose tags are all closed."""
    tree, at = ["", "", []], []
    node = tree
    for m in re.finditer(r"<(/?)([a-z0-9]+)([^>]*)>|([^<]+)", html):
        end, tag, attrs, text = m.groups()
        if text:
            node[2] += [] if any(x[0] in ("nav", "script") for x in [*at, node]) else [text]
        elif end:
            node = at.pop()
        else:
            new = [tag, attrs, []]
            node[2].append(new)
            if tag not in ("br", "meta"):
                at.append(node)
                node = new
    said = lambda n: " ".join(n if isinstance(n, str) else " ".join(map(said, n[2])) for n in [n]).strip()
    line = lambda n: " ".join(said(n).split())
    below = lambda n: [x for c in n[2] if not isinstance(c, str) for x in [c, *below(c)]]
    every = below(tree)
    heads = [t for k in ("h1", "title") for t in (line(n) for n in every if n[0] == k) if t]
    best = []
    for n in every:
        if n[0] == "article" or re.search(r'"(detail|left_zw x)"', n[1]):
            own = [line(p) for p in [n, *below(n)] if p[0] == "p"] or [line(n)]
            own = [x for x in dict.fromkeys(own) if len(x) >= 15 and not x.startswith("广告")]
            best = own if sum(map(len, own)) > sum(map(len, best)) else best
    body = "\n".join(best)
    return (heads[0] if heads else None), ("article_title_mismatch" if not heads else "article_body_missing" if not best else "article_body_too_short" if len(body) < 80 else None), body


def test_articles_against_a_tree(spark):
    rng = random.Random(6)

    def grow(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            tag, attrs = rng.choice([("p", ""), ("p", ' class="detail"'), ("div", ' id="detail"'), ("div", ' class="left_zw x"'), ("div", ""), ("article", ""), ("nav", ""), ("h1", ""), ("script", "")])
            text = rng.choice(["", " ", "short", "广告 of some length and more", "a line of words that is long enough\n for it", f"line {rng.random()} with some more words in it"])
            inside = text if depth == 0 or tag == "script" else text + grow(depth - 1) + rng.choice(["", " tail of text that goes on<br>and on"])
            out.append(f"<{tag}{attrs}>{inside}</{tag}>")
        return "".join(out)

    html = [f"<html><title>{rng.choice(['', 'A title'])}</title><body>{grow(rng.randint(0, 3))}</body></html>" for _ in range(250)]
    got = readers.articles(spark.createDataFrame([*enumerate(html)], "page_id int, html string").repartition(4)).collect()
    want = {k: plain_article(h) for k, h in enumerate(html)}
    assert {r["page_id"]: (r["title"], r["problem"], r["body"]) for r in got} == {k: (t, p, None if p else b) for k, (t, p, b) in want.items()}
    assert len({p for _, p, _ in want.values()}) == 4 and sum(p is None for _, p, _ in want.values()) > 40


# retrieval and pairs


def test_one_pass_retrieval_equals_the_join(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, f"s{i % 3}", " ".join(rng.choices(vocabulary, k=rng.randint(0, 25)))) for i in range(200)] + [(200 + i, "s0", "w1 w2 w3") for i in range(40)] + [(500, None, None)], "id int, source string, text string").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", " ".join(rng.choices(vocabulary, k=4))) for i in range(12)] + [("none", "unknown"), ("null", None)], "q string, text string")
    only = docs.where("id % 3 > 0").select("id").crossJoin(queries.where("q < 'q5'").select("q"))
    read = lambda df: sorted((r["q"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect())
    cases = [{}, {"per": "source"}, {"only": only}]
    fast = [read(retrieve.bm25_top_k(queries, docs, "q", "id", "text", "text", 5, **c)) for c in cases]
    monkeypatch.setattr(retrieve, "_CELLS", 60)
    assert [read(retrieve.bm25_top_k(queries, docs, "q", "id", "text", "text", 5, **c)) for c in cases] == fast
    monkeypatch.setattr(retrieve, "BLOCK_QUERIES", 3)
    assert [read(retrieve.bm25_top_k(queries, docs, "q", "id", "text", "text", 5, **c)) for c in cases[:2]] == fast[:2]
    scored = retrieve.bm25(queries, docs, "q", "id", "text", "text")
    joined = retrieve.top_k(scored, ["q"], 5, F.desc(F.round("score", 9)), F.asc("id"))
    assert read(joined) == fast[0]  # the join on terms
    monkeypatch.setattr(retrieve, "BLOCK_QUERIES", 10_000)
    monkeypatch.setattr(retrieve, "BROADCAST_TERMS", 3)  # a query with more terms is a block by itself
    assert [read(retrieve.bm25_top_k(queries, docs, "q", "id", "text", "text", 5, **c)) for c in cases] == fast
    assert fast[0] and retrieve.bm25_top_k(queries.limit(0), docs, "q", "id", "text", "text", 5).count() == 0
    assert retrieve.bm25_top_k(queries, docs.limit(0), "q", "id", "text", "text", 5).count() == 0


def test_dense_search_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    rows = [(i, unit([rng.gauss(0, 1) for _ in range(6)])) for i in range(120)] + [(500, None)]
    e = spark.createDataFrame(rows, "id int, v array<double>").repartition(3)
    q = e.where("id % 4 = 0 and id < 200").withColumnRenamed("id", "q")
    want = {}
    for i, v in rows[:-1:4]:
        s = sorted((-max(-1, min(1, sum(x * y for x, y in zip(v, w, strict=True)))), j) for j, w in rows[:-1])
        want[i] = [j for _, j in s[:7]]

    def found():
        got = defaultdict(dict)
        for r in retrieve.dense_top_k(q, e, "q", "id", "v", 7).collect():
            got[r["q"]][r["rank"]] = r["id"]
        return {k: [v[n] for n in sorted(v)] for k, v in got.items()}

    assert found() == want
    monkeypatch.setattr(retrieve, "BLOCK_QUERIES", 7)
    assert found() == want


def test_pairs_of_frequent_keys(spark, monkeypatch):
    monkeypatch.setattr(match, "CHUNK", 4)
    rows = [(i, "hot") for i in range(30)] + [(i, f"k{i % 4}") for i in range(8)] + [(3, "hot"), (5, None)]
    d = spark.createDataFrame(rows, "id int, k string").repartition(3)
    groups = defaultdict(set)
    for i, k in rows:
        groups[k].add(i)
    want = {p for k, g in groups.items() if k for p in itertools.combinations(sorted(g), 2)}
    got = [tuple(r) for r in match.pairs_within(d, "id", "k").collect()]
    assert set(got) == want and len(got) == len(want)
    left, right = d.withColumnRenamed("id", "x"), d.withColumnRenamed("id", "y")
    both = Counter((r["x"], r["y"]) for r in match.pairs_between(left, right, ["k"]).collect())
    assert both == Counter((a, b) for a, k in rows for b, m in rows if k == m and k)
    assert {r["k"]: r["n"] for r in review.exclusive_groups(d.where("k is not null"), "id", "k").collect()} == {k: len(g) for k, g in groups.items() if k and len(g) > 1}


def test_duplicate_scan_goes_on_from_its_cursor(spark):
    d = spark.createDataFrame([(i, f"common words {'a b c' if i % 2 else 'x y'}") for i in range(6)] + [(9, "other")], "id int, text string")
    every = [(r["a"], r["b"]) for r in match.duplicate_candidates(d, "id", "text").orderBy("a", "b").collect()]
    assert every == list(itertools.combinations(range(6), 2))
    judged = spark.createDataFrame([(0, 1), (4, 5)], "a int, b int")
    rest = {(r["a"], r["b"]) for r in match.duplicate_candidates(d, "id", "text", judged=judged, after=(2, 4)).collect()}
    assert rest == {(2, 5), (3, 4), (3, 5)}


def test_places(spark):
    rng = random.Random(2)
    rows = [(None if i % 5 == 0 else "hot" if i % 3 else f"g{i % 7}", rng.randint(0, 40), i) for i in range(3000)]
    got = {r["i"]: r["place"] for r in ranking.ranked(spark.createDataFrame(rows, "g string, v int, i int").repartition(6), ["g"], [F.desc("v"), F.asc("i")]).collect()}
    groups = defaultdict(list)
    for g, v, i in rows:
        groups[g].append((-v, i))
    assert got == {i: n for g in groups.values() for n, (_, i) in enumerate(sorted(g), 1)}
    assert ranking.ranked(spark.createDataFrame([], "g string, v int"), ["g"], [F.asc("v")]).count() == 0


# resolution


def brute_order(spark, signals, events, cfg):
    """Signals one after the other, each against the events there are then."""
    pool, out = [dict(e) for e in events], {}
    schema = "title string, text string, entities array<string>, actions array<string>, keywords array<string>, time timestamp, weak boolean, signal_ids array<string>, source_ids array<string>, platform_ids array<string>, canonical_ids array<string>, urls array<string>"
    names = [c.split()[0] for c in schema.split(", ")]
    for s in signals:
        a = spark.createDataFrame([(s["id"], *[s[n] for n in names])], f"signal_id string, {schema}")
        rows = [(e["id"], *[e[n] for n in names]) for e in pool]
        r = resolution.resolve_round(a, spark.createDataFrame(rows, f"event_id string, {schema}"), cfg).first()
        out[s["id"]] = target = r["event_id"] if r["decision"] == "merge" and not r["review_required"] else f"new:{s['id']}" if r["decision"] == "create" and not r["review_required"] else None
        if target and r["decision"] == "create":
            pool.append({**s, "id": target})
        elif target:
            e = next(e for e in pool if e["id"] == target)
            e["urls"] = e["urls"] + s["urls"]
    return out


def test_resolution_in_order(spark):
    row = lambda i, title, urls=(): {"id": i, "title": title, "text": title, "entities": [], "actions": [], "keywords": title.split(), "time": T0, "weak": False, "signal_ids": [], "source_ids": [], "platform_ids": [], "canonical_ids": [], "urls": list(urls)}
    events = [row("e1", "harbour bridge closed after storm", ["u1"]), row("e2", "new museum opens downtown")]
    signals = [row("s1", "train strike stops northern lines", ["u5"]), row("s2", "harbour bridge closed after storm", ["u2"]), row("s3", "train strike stops northern lines today", ["u6"]), row("s4", "an odd headline", ["u6"]), row("s5", "completely unrelated words", ["u2"]), row("s6", "whatever else there is", ["u5"]), row("s7", "third thing nobody knows")]
    cfg = MatchConfig(auto_merge=0.5, review=0.45)
    names = ["title", "text", "entities", "actions", "keywords", "time", "weak", "signal_ids", "source_ids", "platform_ids", "canonical_ids", "urls"]
    schema = "title string, text string, entities array<string>, actions array<string>, keywords array<string>, time timestamp, weak boolean, signal_ids array<string>, source_ids array<string>, platform_ids array<string>, canonical_ids array<string>, urls array<string>"
    a = spark.createDataFrame([(s["id"], k, *[s[n] for n in names]) for k, s in enumerate(signals)], f"signal_id string, seq int, {schema}")
    b = spark.createDataFrame([(e["id"], *[e[n] for n in names]) for e in events], f"event_id string, {schema}")
    got = {r["signal_id"]: r["target"] for r in resolution.resolve_in_order(a, b, cfg).collect()}
    assert got == brute_order(spark, signals, events, cfg)
    assert got["s3"] == got["s4"] == got["s6"] == "new:s1" and got["s5"] == got["s2"] == "e1"


def test_scores_are_the_callers(spark):
    row = (["a"], "t", [], [], [], [], [], [])
    schema = "title string, text string, entities array<string>, actions array<string>, keywords array<string>, time timestamp, weak boolean, signal_ids array<string>, source_ids array<string>, platform_ids array<string>, canonical_ids array<string>, urls array<string>"
    of = lambda name, title: spark.createDataFrame([(name, title, title, [], [], [], T0, False, [], [], [], [], [])], f"{'signal_id' if name == 's' else 'event_id'} string, {schema}")
    scores = spark.createDataFrame([("s", "e", 0.2, 0.05)], "signal_id string, event_id string, embedding double, rerank double")
    s, e = of("s", "city water supply fails"), of("e", "city water supply fails again")
    assert len(row) == 8
    without = resolution.compared(s, e, MatchConfig()).first()
    scored = resolution.compared(s, e, MatchConfig(use_embedding=True, use_reranker=True), scores).first()
    assert without["embedding"] is None and without["gate"] == "pass" and scored["rerank"] == 0.05 and scored["gate"] == "separate"


# review


def test_run_scope_of_deep_and_wide_runs(spark):
    deep = [(i, i - 1 if i else None) for i in range(40)] + [(100 + i, 20) for i in range(5)] + [(200, 105), (300, None), (301, 300)]
    got = {r["run_id"] for r in review.run_scope(spark.createDataFrame(deep, "run_id int, parent_run_id int"), 10).collect()}
    assert got == set(range(10, 40)) | set(range(100, 105))
    with pytest.raises(RuntimeError):
        review.run_scope(spark.createDataFrame([(1, 2), (2, 1), (5, None)], "run_id int, parent_run_id int"), 5, limit=4)


def test_review_queue_is_built(spark):
    at = lambda h: T0 + timedelta(hours=h)
    candidates = spark.createDataFrame([("a", 1, at(0), False, ["x"]), ("a", 2, at(1), False, ["y"]), ("b", 3, at(0), True, ["x"]), ("c", 4, at(0), False, ["z"]), ("d", 5, at(0), True, [])], "relation_key string, task_id int, observed_at timestamp, weak boolean, evidence array<string>")
    pending = spark.createDataFrame([("a", 90, at(-2), ["w"]), ("a", 91, at(-30), ["v"]), ("c", 92, at(-40), ["v"])], "relation_key string, task_id int, observed_at timestamp, evidence array<string>")
    decided = spark.createDataFrame([("b", at(-30), "merge"), ("d", at(-3), "reject")], "relation_key string, decided_at timestamp, decision string")
    got = {r["relation_key"]: (r["task_id"], r["action"], r["n"], r["evidence"], r["decision"]) for r in review.build_queue(candidates, pending, decided).collect()}
    assert got == {"a": (90, "update", 2, ["w", "x", "y"], None), "b": (3, "create", 1, ["x"], None), "c": (4, "create", 1, ["z"], None), "d": (5, "reuse", 1, [], "reject")}


def test_maps_documents_and_merges(spark):
    m = filters.merge_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3)))
    assert one(spark, m) == {"a": 1, "b": 3}
    assert one(spark, filters.known_entries(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(None).cast("int")))) == {"a": 1}
    events = spark.createDataFrame([("x", T0, T0 + timedelta(1), ["1"], ["u"], ["d1", "d2", "d3", "d4"]), ("y", T0 - timedelta(1), T0, ["2"], [], ["d0", "d2"])], "event_id string, first_seen_at timestamp, last_seen_at timestamp, source_ids array<string>, urls array<string>, documents array<string>")
    into = spark.createDataFrame([("y", "x")], "event_id string, target_id string")
    r = match.merge_events(events, into).first()
    assert (r["event_id"], r["first_seen_at"], r["source_ids"], r["documents"]) == ("x", T0 - timedelta(1), ["1", "2"], ["d0", "d3", "d4"])


def test_collection_never_stops(spark, tmp_path):
    (tmp_path / "hot.json").write_text('{"payload": "[{\\"title\\": \\"a\\", \\"target\\": {\\"id\\": \\"1\\", \\"type\\": \\"question\\"}}, {\\"title\\": \\"b\\"}]"}\n')
    (tmp_path / "empty.json").write_text('{"payload": "[]"}\n')
    plan = [{"source_id": "h", "kind": "hot_list", "path": str(tmp_path / "hot.json"), "limit": 1}, {"source_id": "x", "kind": "nobody", "path": "."}, {"source_id": "gone", "kind": "hot_list", "path": str(tmp_path / "none.json")}, {"source_id": "e", "kind": "hot_list", "path": str(tmp_path / "empty.json")}]
    items, outcomes = readers.collect(spark, plan, T0)
    assert [(r["source_id"], r["rank"], r["title"]) for r in items.collect()] == [("h", 1, "a")]
    assert {r["source_id"]: (r["status"], r["items"]) for r in outcomes.collect()} == {"h": ("succeeded", 1), "x": ("failed", 0), "gone": ("failed", 0), "e": ("skipped", 0)}
    assert readers.collect(spark, plan[1:3], T0)[0].count() == 0


def test_publication_errors(spark):
    end = T0 + timedelta(1)
    card = "event_id string, section string, run_id string, window_start timestamp, window_end timestamp, has_analysis boolean, official_source boolean, zhihu_topn boolean, weibo_topn boolean"
    cite = "event_id string, url string, source_type string, fetched_at timestamp, published_at timestamp, is_prior_report boolean, prior_allowed boolean"
    good = ("e", "s", "r", T0, end, True, True, True, False)
    cards = [good, ("f", "s", "r", T0, end, True, False, True, False), ("f", "s", "r", T0, end, True, False, True, False), ("g", "s", "old", T0, end, None, True, False, False)]
    inside, before = T0 + timedelta(hours=3), T0 - timedelta(hours=3)
    cites = [("e", "https://x.org", "official_news", before, before, True, True), ("f", "ftp://x", "community", before, None, None, None), ("f", "https://x.org", "official_news", inside, before, True, False), ("f", "https://x.org", "community", end + timedelta(1), None, None, None)]
    run = lambda a, b, status: {tuple(r) for r in briefing.publication_errors(spark.createDataFrame(a, card), spark.createDataFrame(b, cite), spark.createDataFrame([(status,)], "status string"), "r", F.lit(T0), F.lit(end), F.lit(end)).collect()}
    assert run([good], cites[:1], "partial") == set()
    assert run(cards, cites, "failed") == {("f", "duplicate_in_section"), ("g", "classification_window_mismatch"), ("g", "missing_platform_analysis"), ("g", "official_class_without_official_citation"), ("f", "invalid_url"), ("f", "citation_out_of_window"), ("f", "citation_not_yet_collected"), ("f", "official_publication_out_of_window"), (None, "no_usable_source")}
    assert run([], [], "succeeded") == {(None, "no_event_with_citations")}


def test_small_reports(spark):
    log = spark.createDataFrame([(5,), (None,), (7,)], "charged int")
    assert tuple(report.budget(log, 20, 8).first()) == (3, 12, 8, True) and not report.budget(log, 20, 9).first()["fits"]
    refs = spark.createDataFrame([(1, T0 - timedelta(hours=100)), (1, T0 - timedelta(hours=30)), (2, None)], "event_id int, published_at timestamp")
    assert dict(official.best_freshness(refs, F.lit(T0)).collect())[1] == "72h"
    order = spark.createDataFrame([(1, 1, True, None, 9.0), (1, 2, True, 0.9, 1.0), (1, 3, False, 0.99, 9.0), (1, 4, True, 0.9, 2.0)], "event_id int, item_id int, supported boolean, rerank double, score double")
    assert {r["item_id"]: r["place"] for r in official.reference_order(order).collect()} == {4: 1, 2: 2, 1: 3, 3: 4}
    cases = spark.createDataFrame([(True, ["a", "b", "a"], 1.0, 1.5), (False, ["b"], 2.0, None)], "passed boolean, matched_by array<string>, e double, a double")
    assert {tuple(r) for r in evaluate.by_method(cases).collect()} == {("a", 1, 1), ("b", 2, 1)}
    assert tuple(evaluate.mean_absolute_error(cases, "e", "a").first()) == (0.5, 1)


def test_shared_folder_must_be_set_on_a_cluster(spark):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())
    assert shared.shared_dir(spark).startswith(("file:", "/"))


def test_guard_of_the_entry_point(monkeypatch):
    """A module that the corpus operators need may not go missing without a word."""
    import builtins
    import importlib
    import sys

    import __spark_entry__

    real = builtins.__import__

    def broken(name, *args, **kwargs):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("No module named 'zstandard'", name="zstandard")
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", broken)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    with pytest.raises(ModuleNotFoundError):
        importlib.import_module("__spark_entry__")
    monkeypatch.undo()
    sys.modules["__spark_entry__"] = __spark_entry__
    assert guardrails.SEVERITY["block"] == 2 and TrendConfig().max_gap_minutes == 120
