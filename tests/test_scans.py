"""Joins by similarity and the scan for duplicates against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from eventide.operators import evaluate, judge, match, similarity
from eventide.plans.duplicate_scan import VERDICT, DuplicateScan, all_verdicts
from eventide.sources.shared import new_path


def token_rows(seed, n, vocabulary=40, most=25):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            base = list(rng.choice(rows)[1] or [])
            for _ in range(rng.randint(0, 3)):
                base = base + [rng.choice(words)] if rng.random() < 0.5 else base[1:]
            rows.append((i, base))
        else:
            rows.append((i, rng.choices(words, weights, k=rng.randint(0, most))))
    return [*rows, (n, None), (n + 1, rows[5][1])]


def brute(rows, t):
    first, members = {}, {}
    for i, w in sorted(rows, key=lambda r: r[0]):
        key = frozenset(w or ())
        members[i] = first.setdefault(key, i) if key else None
    pairs = {}
    for (x, a), (y, b) in itertools.combinations(first.items(), 2):
        if x and y and len(x & y) / len(x | y) >= t:
            pairs[min(a, b), max(a, b)] = (len(x & y), len(x & y) / len(x | y))
    return members, pairs


@pytest.mark.parametrize("t,chunk", [(0.8, 1000), (0.5, 7), (0.3, 1000), (1.0, 1000)])
def test_similarity_join(spark, monkeypatch, t, chunk):
    monkeypatch.setattr(match, "CHUNK", chunk)  # frequent prefix tokens are cut
    monkeypatch.setattr(similarity, "ORDERED", 20)  # most tokens have no place of their own
    rows = token_rows(3, 160)
    members, pairs = similarity.similarity_join(spark.createDataFrame(rows, "id int, w array<string>").repartition(4), "id", F.col("w"), t)
    want_members, want = brute(rows, t)
    assert {r["id"]: r["class"] for r in members.collect()} == want_members
    got = pairs.collect()
    assert {(r["a"], r["b"]): (r["overlap"], r["similarity"]) for r in got} == want and len(got) == len(want)
    assert want or t == 1.0
    links = {r["id"]: (r["class"], r["links"]) for r in similarity.linked(members, pairs).collect()}
    assert links == {i: (c, sum(c in p for p in want)) for i, c in want_members.items()}


def test_similar_sets_are_compared_in_cells(spark, monkeypatch):
    monkeypatch.setattr(similarity, "MEMBERS", 3)  # most cells are cut into parts
    rows = [(f"r{i:03}", w) for i, w in token_rows(6, 150)]
    _, pairs = similarity.similarity_join(spark.createDataFrame(rows, "id string, w array<string>").repartition(4), "id", F.col("w"), 0.5)
    got = pairs.collect()
    assert {(r["a"], r["b"]): (r["overlap"], r["similarity"]) for r in got} == brute(rows, 0.5)[1] and len(got) > 100


def test_similarity_of_copies_and_bad_thresholds(spark):
    hot = spark.range(3000).selectExpr("id", "if(id % 3 = 0, array('a', 'b', 'c', 'd', 'e'), array(concat('x', id), 'a', 'b')) as w")
    members, pairs = similarity.similarity_join(hot, "id", F.col("w"), 0.8)
    assert members.where("class = 0").count() == 1000 and pairs.count() == 0
    with pytest.raises(ValueError):
        similarity.similar_sets(hot, 0.0)
    none, no_pairs = similarity.similarity_join(hot.limit(0), "id", F.col("w"), 0.8)
    assert none.count() == no_pairs.count() == 0


def test_duplicate_scan_goes_on_where_it_was(spark):
    rows = [(f"e{i:03}", " ".join(w or [])) for i, w in token_rows(9, 60)]
    events = spark.createDataFrame(rows, "event_id string, text string")
    path, seen = new_path(spark, "scan"), []

    def judge(pairs):
        got = [(r["a"], r["b"], "same" if r["similarity"] > 0.7 else "different") for r in pairs.collect()]
        seen.extend(got)
        return spark.createDataFrame(got, VERDICT)

    scan = DuplicateScan.start(events, path, "p1", 0.5)
    members, pairs = brute([(i, t.split()) for i, t in rows], 0.5)
    every = sorted([*pairs, *((c, i) for i, c in members.items() if c is not None and c != i)])
    assert scan.pairs == len(every) > 20
    scan.record(judge(scan.ahead(7)), 7)
    ahead = [(r["a"], r["b"]) for r in scan.ahead(7).orderBy("place").collect()]
    assert ahead == every[7:14]
    scan = DuplicateScan.open(spark, path, "p1", 1)  # another session, or one that died before it recorded
    assert [(r["a"], r["b"]) for r in scan.ahead(7).orderBy("place").collect()] == ahead
    scan.record(judge(scan.ahead(7).where(F.col("a") > ahead[0][0])), 7)  # a failure leaves pairs without a verdict
    done = all_verdicts(scan, judge, 11)
    left = len(every) - done.count()
    assert left == sum(p[0] == ahead[0][0] for p in ahead) > 0
    again = all_verdicts(DuplicateScan.open(spark, path, "p1", scan.slice).restart(), judge, 25)
    assert sorted((r["a"], r["b"]) for r in again.collect()) == every
    assert sorted(x[:2] for x in seen) == every  # nothing was judged twice
    with pytest.raises(ValueError, match="stale"):
        DuplicateScan.open(spark, path, "p2", 1)


# judged pairs


def judged(spark, *rows):
    names = ("signal_id", "candidate_id", "place", "decision", "uncertainty_kind", "evidence", "clues", "conflicts", "missing_information")
    blank = {n: None for n in names} | {"evidence": []}
    full = [tuple((blank | {"place": k} | r)[n] for n in names) for k, r in enumerate(rows)]
    quotes = "array<struct<source_id:string,quote:string>>"
    return spark.createDataFrame(full, f"signal_id string, candidate_id string, place int, decision string, uncertainty_kind string, evidence {quotes}, clues {quotes}, conflicts array<string>, missing_information array<string>")


def test_judged_pairs(spark):
    docs = spark.createDataFrame([("s", "The bridge closed", "It closed on Monday"), ("c1", None, "the bridge closed"), ("c2", "other", "text é quote"), ("c3", "x", None), ("t", "t", "t")], "source_id string, title string, text string")
    s, c1, c2 = ("s", "bridge"), ("c1", "bridge"), ("c2", "é quote")
    base = {"signal_id": "s", "decision": "same_event"}
    unsure = {"signal_id": "s", "decision": "insufficient_evidence"}
    cases = [
        (base | {"candidate_id": "c1", "evidence": [s, c1]}, None, "same"),
        (base | {"candidate_id": "c1", "evidence": [s]}, "evidence_missing_side", None),
        (base | {"candidate_id": "c1", "evidence": [s, ("c1", "Bridge")]}, "quote_not_found", None),
        (base | {"candidate_id": "c1", "evidence": [s, c1, ("c1", " ")]}, "quote_not_found", None),
        (base | {"candidate_id": "c1", "evidence": [s, c2, c1]}, "quote_not_found", None),  # of a text outside the pair
        (base | {"candidate_id": "c1", "evidence": [s, c1], "conflicts": ["date"]}, "same_event_has_conflicts", None),
        (base | {"candidate_id": "s", "evidence": [s]}, "candidate_set_mismatch", None),
        (unsure | {"candidate_id": "c2"}, "uncertainty_kind_missing", None),
        (unsure | {"candidate_id": "c2", "uncertainty_kind": "possible_same_event", "clues": [s, c2], "missing_information": [" ", "when"]}, None, "plausible"),
        (unsure | {"candidate_id": "c2", "uncertainty_kind": "possible_same_event", "clues": [s, c2], "missing_information": [" "]}, "uncertainty_missing_critical_detail", None),
        (unsure | {"candidate_id": "c2", "uncertainty_kind": "possible_same_event", "clues": [s], "missing_information": ["when"]}, "clues_missing_side", None),
        (unsure | {"candidate_id": "c2", "uncertainty_kind": "insufficient_context"}, None, "context_only"),
        (unsure | {"candidate_id": "c2", "uncertainty_kind": "insufficient_context", "clues": [s]}, "context_only_has_clues", None),
        (unsure | {"candidate_id": "c3", "uncertainty_kind": "old"}, None, "legacy"),
        (base | {"candidate_id": "c3", "decision": "different_event"}, None, "different"),
    ]
    for row, problem, group in cases:
        r = judge.checked(judged(spark, row), docs).first()
        assert (r["problem"], r["group"]) == (problem, group), row
    spans = {(r["source_id"], r["field"], r["start"], r["stop"]) for r in judge.aligned_quotes(judged(spark, base | {"candidate_id": "c2", "evidence": [s, c2, ("s", "Monday"), ("c2", "no")]}), docs).collect()}
    assert spans == {("s", "title", 4, 10), ("c2", "text", 5, 12), ("s", "text", 13, 19), ("c2", None, None, None)}
    signals = docs.select(F.col("source_id").alias("signal_id")).where("signal_id in ('s', 't')")

    def action(*rows):
        out = {r["signal_id"]: r for r in judge.decided(signals, judge.checked(judged(spark, *rows), docs)).collect()}
        assert (out["t"]["action"], out["t"]["category"]) == ("create", "independent_topic")
        return tuple(out["s"])[1:6]

    assert action(cases[0][0], cases[14][0]) == ("merge", "c1", 1.0, "automatic_merge", None)
    assert action(cases[13][0], cases[0][0]) == ("candidate_review", "c1", 0.6, "legacy_uncertainty", None)
    assert action(cases[13][0], cases[8][0]) == ("candidate_review", "c2", 0.6, "legacy_uncertainty", None)
    assert action(cases[11][0]) == ("create", None, 0.75, "independent_topic", None)
    assert action(cases[0][0], cases[7][0]) == ("candidate_review", None, 0.0, "technical_error", "uncertainty_kind_missing")
    assert action(cases[0][0], cases[0][0])[3] == "technical_error"  # one candidate judged twice


def test_evaluators_by_kind(spark):
    rows = [(1, "rank_bucket", {"rank": "2"}, {"bucket": "top3"}), (2, "rank_bucket", {"rank": None}, {"bucket": "tail"}), (3, "direction", {"now": "0.5", "before": "0.1"}, {"trend": "rising"}), (4, "new", {"x": "1"}, {"y": "1"}), (5, "none", {}, {"y": "1"})]
    cases = spark.createDataFrame(rows, "case_id int, kind string, input map<string,string>, expected map<string,string>")
    own = evaluate.EVALUATORS | {"new": lambda c: c.select("case_id", F.create_map(F.lit("y"), F.col("input")["x"]).alias("actual"))}
    got = {r["kind"]: (r["n"], r["passed"]) for r in evaluate.evaluated(cases, own).collect()}
    assert got == {"rank_bucket": (2, 1), "direction": (1, 1), "new": (1, 1), "none": (1, 0)}
    with pytest.raises(ValueError, match="already"):
        evaluate.evaluator("direction")(lambda c: c)
