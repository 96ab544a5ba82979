"""Envelopes, evidence, saved responses and stores against brute force and failures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from eventide.functions import identity as I
from eventide.operators import review
from eventide.sources import envelopes, saved, versions
from eventide.sources.shared import new_path

LISTS = ("statuses", "items", "Items", "list", "List", "results", "Results")


def hunt(v):
    """The rule of the envelope, one object at a time."""
    ok = lambda x: isinstance(x, dict) and any(k in x for k in ("text", "text_raw", "id", "idstr", "mid"))
    if isinstance(v, list):
        return [x for x in v if ok(x)]
    if not isinstance(v, dict):
        return []
    held = next((v[k] for k in LISTS if isinstance(v.get(k), list)), None)
    if held is not None:
        return [x for x in held if ok(x)]
    return hunt(v.get("data")) or hunt(v.get("Data")) or ([v] if ok(v) else [])


def hunt_total(v):
    if isinstance(v, dict):
        for k in ("total_number", "total", "Total", "count", "Count"):
            x = v.get(k)
            if isinstance(x, bool) or x is None or isinstance(x, (list, dict)):
                continue
            if isinstance(x, (int, float)):
                return int(x)
            if x.strip().isdigit():
                return int(x.strip())
        for k in ("data", "Data"):
            if (n := hunt_total(v.get(k))) is not None:
                return n
    return None


def test_envelopes_of_any_depth(spark):
    rng = random.Random(11)
    n = iter(range(10**6))

    def grow(depth):
        pick = rng.random()
        if depth == 0 or pick < 0.25:
            return rng.choice([{"id": next(n), "text": "x"}, [{"mid": str(next(n))}, {"no": 1}, 7, {"text": f"t{next(n)}"}], [], None, "text", 3])
        out = {}
        for k in ("data", "Data"):
            if rng.random() < 0.7:
                out[k] = grow(depth - 1)
        if pick < 0.4:
            out[rng.choice(LISTS)] = rng.choice([[{"idstr": str(next(n))}], [], {"id": 5}, None])
        if rng.random() < 0.3:
            out[rng.choice(["total_number", "total", "Total", "count", "Count"])] = rng.choice([5, "12", " 7 ", True, None, 2.9, "x", [1]])
        if rng.random() < 0.3:
            out["id"] = next(n)
        return out

    values = [grow(rng.randint(0, 6)) for _ in range(150)] + [json.loads('{"data":' * 30 + '[{"text":"deep"}]' + "}" * 30)]
    rows = [(k, json.dumps(v)) for k, v in enumerate(values)] + [(900, "{broken"), (901, None), (902, "")]
    got = {}
    for r in envelopes.statuses(spark.createDataFrame(rows, "k int, payload string"), "k").orderBy("k", "pos").collect():
        got.setdefault(r["k"], []).append((r["status_id"], r["text"], r["total"]))
    name = lambda x: next((str(x[k]) for k in ("idstr", "id", "mid") if x.get(k) is not None), None)
    want = {k: [(name(x), x.get("text"), hunt_total(v)) for x in found] for k, v in enumerate(values) if (found := hunt(v))}
    assert got == want and len(want) > 60


def test_envelopes_without_end_are_an_error(spark):
    df = spark.createDataFrame([(1, '{"data":' * 12 + "1" + "}" * 12)], "k int, payload string")
    with pytest.raises(ValueError, match="more than 5"):
        envelopes.opened(df, "k", deepest=5)


@pytest.mark.parametrize(
    "text,want",
    [('{"b":1,"a":{"d":[1.50,2.0],"c":null}}', '{"a":{"c":null,"d":[1.5,2]},"b":1}'), ('[{"b":2,"a":"\\u00e9"}]', '[{"a":"é","b":2}]'), ("{", None), (None, None), ('{"a":1,"a":2}', None), ('"x"', '"x"')],
)
def test_canonical_json(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(I.canonical_json(F.col("t")).alias("x")).first()["x"] == want


def test_merged_evidence(spark):
    rows = [(1, 2, ["b", "a"], "r2", ['{"x":1,"y":2}', "bad{"]), (1, 1, ["a", None], "r1", ['{"y":2,"x":1}', '{"z":[]}']), (1, 3, None, None, None), (2, 1, [], "r1", []), (3, 1, None, None, None)]
    df = spark.createDataFrame(rows, "k int, at int, ids array<string>, run string, cites array<string>")
    got = {r["k"]: (r["ids"], r["cites"], r["rows"]) for r in review.merge_evidence(df, "k", "at", {"ids": "run"}, ("cites",)).collect()}
    assert got == {1: (["a", "r1", "b", "r2"], ['{"x":1,"y":2}', '{"z":[]}'], 3), 2: (["r1"], [], 1), 3: ([], [], 1)}


# versions


ROW = "event_id bigint, platform string, observation_id string, observed bigint, score double"


def upserts(spark, path=None):
    return versions.Upserts(spark, path or new_path(spark, "upserts"), ROW, ["event_id", "platform", "observation_id"], "observed", buckets=8)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upserts_touch_their_buckets_only(spark):
    table, rng, want = upserts(spark), random.Random(4), {}
    assert table.version() == 0 and table.read().count() == 0
    for n in range(4):
        batch = [(rng.randint(0, 40) if n else k, rng.choice(["a", "b", None]), f"o{rng.randint(0, 1)}", rng.choice([n, n, None]), rng.random()) for k in range(60 if not n else 3)]
        table.upsert(spark.createDataFrame(batch, ROW))
        for r in batch:
            old = want.get(r[:3])
            rank = lambda x: -1 if x is None else x
            if old is None or rank(r[3]) > rank(old[3]) or (rank(r[3]) == rank(old[3]) and old not in batch):
                want[r[:3]] = r
        assert {t[:3] for t in rows_of(table.read())} == set(want)
    got = {t[:3]: t for t in rows_of(table.read())}
    assert all(got[k][3] == v[3] for k, v in want.items()) and len(got) == table.read().count()
    last = table.version()
    assert last >= 3 and len({w[0] for w in table.parts(2).values()}) == 2  # some buckets are as the first version left them


def test_a_replay_changes_nothing_and_a_failed_write_neither(spark, monkeypatch):
    table = upserts(spark)
    batch = spark.createDataFrame([(k, "a", "o", 1, 0.5) for k in range(20)], ROW)
    assert table.upsert(batch) == 1 and table.upsert(batch) == 1
    old = table.read(1)
    table.upsert(spark.createDataFrame([(3, "a", "o", 2, 0.9), (99, None, None, None, None)], ROW))
    assert table.version() == 2 and table.read().count() == 21 and old.count() == 20 and {r["score"] for r in old.collect()} == {0.5}
    before = rows_of(table.read())

    def lost(*_):
        raise RuntimeError("lost before the manifest")

    monkeypatch.setattr(versions.Versions, "_commit", lost)
    with pytest.raises(RuntimeError):
        table.upsert(spark.createDataFrame([(4, "a", "o", 9, 1.0)], ROW))
    monkeypatch.undo()
    again = upserts(spark, table.path)
    assert again.version() == 2 and rows_of(again.read()) == before
    assert again.upsert(spark.createDataFrame([(4, "a", "o", 9, 1.0)], ROW)) == 3
    with pytest.raises(ValueError, match="no version 7"):
        again.parts(7)


def test_pruned_days_stay_for_open_readers(spark):
    log = versions.DayLog(spark, new_path(spark, "log"), "ts timestamp, line string")
    days = lambda *xs: spark.createDataFrame([(x, f"l{x}") for x in xs], "ts string, line string").withColumn("ts", F.col("ts").cast("timestamp"))
    log.append(days("2024-01-01", "2024-01-02"))
    log.append(days("2024-01-02", "2024-01-03", None))
    reader = log.read()
    assert log.prune("2024-01-03") == ["2024-01-01", "2024-01-02"] and log.prune("2024-01-03") == []
    assert log.read().count() == 2 and reader.count() == 5 and log.read(2).count() == 5
    log.append(days("2024-01-04"))
    assert log.vacuum(keep=2) == ["v1/part=2024-01-01", "v1/part=2024-01-02", "v2/part=2024-01-02"]
    assert log.read().count() == 3 and log.read(3).count() == 2
    assert log.prune("2025-01-01") == ["2024-01-03", "2024-01-04"] and log.read().count() == 1


def test_a_second_run_scores_new_pairs_only(spark):
    asked = []

    def score(missing):
        got = missing.collect()
        asked.append(sorted((r["a"] or "") + "|" + r["b"] for r in got))
        return missing.sparkSession.createDataFrame([(r["_name"], float(len(r["b"]))) for r in got if r["b"] != "none"], "_name string, score double")

    path = new_path(spark, "cache")
    pairs = lambda *xs: spark.createDataFrame(list(xs), "i int, a string, b string")
    cache = versions.ScoreCache(spark, path, "model-1")
    first = cache.scored(pairs((1, "x", "yy"), (2, "x", "yy"), (3, None, "z"), (4, "q", "none")), "a", "b", score)
    assert {r["i"]: r["score"] for r in first.collect()} == {1: 2.0, 2: 2.0, 3: 1.0, 4: None}
    second = versions.ScoreCache(spark, path, "model-1").scored(pairs((5, "x", "yy"), (6, "yy", "x"), (7, "q", "none")), "a", "b", score)
    assert {r["i"]: r["score"] for r in second.collect()} == {5: 2.0, 6: 1.0, 7: None}
    versions.ScoreCache(spark, path, "model-2").scored(pairs((8, "x", "yy")), "a", "b", score)
    assert asked == [["q|none", "x|yy", "|z"], ["q|none", "yy|x"], ["x|yy"]]


# saved responses


def save(folder, name, value):
    part = folder / f".{name}"
    part.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))
    part.rename(folder / name)  # there whole or not at all


def response(query, *items, rank=1):
    named = lambda k, url: {"Title": f"<b>T{k}</b>", "Url": url, "ContentID": k or None, "ContentText": "c", "CommentCount": 3 if k else None}
    return {"query": query, "fetched_at": "2026-01-01T00:00:00Z", "candidate_title": query, "candidate_url": None, "candidate_rank": rank, "result": {"Items": [named(*i) for i in items]}}


def test_saved_responses_as_batch_and_as_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    assert saved.responses(spark, str(folder)).count() == 0
    save(folder, "b.json", response("q1", ("1", "u1"), ("2", "u2"), rank=2))
    save(folder, "a.json", response("q1", ("3", "u2"), ("4", "u3")))
    save(folder, "bad.json", "{")
    save(folder, "list.json", "[1]")
    save(folder, "note.txt", "no response")
    out = new_path(spark, "hits")

    def run():
        hits = saved.search_items(saved.responses(spark, f"file://{folder}", stream=True, batch=1))
        q = hits.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return spark.read.parquet(out)

    assert run().count() == 4
    save(folder, "c.json", response("q2", ("", "u1"), ("5", "")))
    stream = run()
    batch = saved.search_items(saved.responses(spark, str(folder), batch=2))
    assert rows_of(batch) == rows_of(stream.select(*batch.columns)) and batch.count() == 6
    errors = {r["file"]: r["error"] for r in saved.responses(spark, str(folder)).where("error is not null").collect()}
    assert set(errors) == {"bad.json", "list.json"} and errors["list.json"].startswith("ValueError")
    hits = {(r["query"], r["url"]): (r["file"], r["search_rank"], r["flags"]) for r in saved.distinct_hits(batch).collect()}
    assert hits[("q1", "u2")][:2] == ("a.json", 1) and len(hits) == 5  # the candidate of the better rank
    assert {k for k, v in hits.items() if "missing_url" in v[2]} == {("q2", "")} and "missing_comment_count" in hits[("q2", "u1")][2]


def test_a_stream_drops_repeated_hits(spark, tmp_path):
    save(tmp_path, "a.json", response("q", ("1", "u1"), ("2", "u1"), ("3", "u2")))
    for delay in (None, "1 hour"):
        name = f"hits_{delay is None}"
        hits = saved.distinct_hits(saved.search_items(saved.responses(spark, str(tmp_path), stream=True)), delay)
        q = hits.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        assert sorted(r["url"] for r in spark.table(name).collect()) == ["u1", "u2"]


def test_search_targets(spark):
    rows = [("b", "B", "u1", 2), (" b ", "B2", "u1", 1), ("c", None, None, None), ("", "x", None, 0), ("d", "D", "u", 9), ("asked", "again", None, 4)]
    df = spark.createDataFrame(rows, "query string, candidate_title string, candidate_url string, candidate_rank bigint")
    got = [tuple(r) for r in saved.search_targets(df, ["asked", "asked"], 4).collect()]
    assert got == [("asked", "asked", None, 0), ("c", "c", None, 0), ("b", "B2", "u1", 1), ("d", "D", "u", 9)]
    assert saved.search_targets(df.limit(0), []).count() == 0
