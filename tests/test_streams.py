"""Streams against loops over the same rows."""

import random
from datetime import datetime, timedelta


from eventide.sources.shared import new_path
from eventide.streaming import resolve

T0 = datetime(2026, 9, 14)
SIGNAL = "signal_id string, block string, time timestamp, tokens array<string>, ids array<string>"


def signals(seed, n):
    rng, at, rows = random.Random(seed), T0, []
    for i in range(n):
        at += timedelta(minutes=rng.choice([0, 1, 10, 300]))
        if rows and rng.random() < 0.6:
            tokens = [t for t in rng.choice(rows)[3] or [] if rng.random() < 0.8] + rng.choices("abcdefgh", k=rng.randint(0, 2))
        else:
            tokens = rng.sample("abcdefghijklmnopqrstuv", rng.randint(0, 6))
        rows.append((f"s{i:03}", rng.choice(["x", "y", None]), at, tokens or None, rng.choice([None, [], [f"id{rng.randint(0, 12)}"]])))
    return rows


def loop(rows, keep, merge, review):
    """One signal after the other, every event looked at."""
    events, out = [], {}
    for sid, block, at, tokens, ids in rows:
        tokens, ids = set(tokens or ()), set(ids or ())
        live = [e for e in events if e["block"] == block and at - e["seen"] <= keep]
        own = sorted((e["id"], k) for k, e in enumerate(live) if e["ids"] & ids)
        near = sorted((-len(tokens & e["tokens"]) / len(tokens | e["tokens"]), e["id"], k) for k, e in enumerate(live) if tokens & e["tokens"])
        score = -near[0][0] if near else 0.0
        if own or score >= merge:
            e = live[own[0][1] if own else near[0][2]]
            e["ids"] |= ids
            e["seen"] = at
            out[sid] = (e["id"], "merge", 1.0 if own else score)
        elif score >= review:
            out[sid] = (live[near[0][2]]["id"], "candidate_review", score)
        else:
            events.append({"id": f"new:{sid}", "block": block, "tokens": tokens, "ids": ids, "seen": at})
            out[sid] = (f"new:{sid}", "create", score)
    return out


def run(spark, rows, sizes):
    base = new_path(spark, "signals")
    at = 0
    for k, n in enumerate(sizes):
        spark.createDataFrame(rows[at : at + n], SIGNAL).coalesce(1).write.parquet(f"{base}/in/batch={k}")
        at += n
    source = spark.readStream.schema(SIGNAL).option("maxFilesPerTrigger", 1).parquet(*[f"{base}/in/*"])
    out = resolve.resolve_stream(source, keep="6 hours", delay="10 minutes", merge=0.5, review=0.3)
    q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(600)
    return {r["signal_id"]: (r["event_id"], r["decision"], r["score"]) for r in spark.read.schema(resolve.RESOLVED).parquet(f"{base}/out").collect()}


def test_resolution_of_a_stream_is_that_of_a_loop(spark):
    rows = signals(5, 90)
    want = loop(rows, timedelta(hours=6), 0.5, 0.3)
    assert {d for _, d, _ in want.values()} == {"merge", "candidate_review", "create"}
    assert run(spark, rows, [40, 25, 25]) == want


def test_a_table_is_resolved_slice_by_slice(spark, monkeypatch):
    """What a batch of a key holds stays small: dead events go while it is read."""
    monkeypatch.setattr(resolve, "STEP", 4)
    rows = signals(11, 120)
    table = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SIGNAL).repartition(3)
    out = resolve.resolve_table(table, rows=50, keep="6 hours", delay="10 minutes", merge=0.5, review=0.3).collect()
    assert len(out) == len(rows) and {r["signal_id"]: (r["event_id"], r["decision"], r["score"]) for r in out} == loop(rows, timedelta(hours=6), 0.5, 0.3)
    live = resolve.Events({}, 100, 0.5, 0.3)
    for k in range(1000):
        live.put(str(k), frozenset({f"t{k}"}), frozenset({f"i{k}"}), k)
    live.forget(999)
    assert len(live.held) == len(live.tokens) == len(live.owners) == 101


def test_events_of_a_key_forget_in_time():
    live = resolve.Events({}, 100, 0.5, 0.3)
    a = frozenset("abcd")
    assert live.put("1", a, frozenset(), 0) == ("new:1", "create", 0.0)
    assert live.put("2", a, frozenset({"i"}), 100) == ("new:1", "merge", 1.0)
    assert live.put("3", a, frozenset(), 201)[1] == "create"  # the first event was seen too long ago
    assert live.put("4", frozenset("z"), frozenset({"i"}), 150)[:2] == ("new:1", "merge")
    assert live.put("5", frozenset("abxy"), frozenset(), 210) == ("new:1", "candidate_review", 2 / 6)
