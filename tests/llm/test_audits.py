"""Operators 11 to 13 against brute force, and the rows and names that they must bear."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventide.llm import decontaminate, filter_audit, turn_repair

DOC = "doc_id bigint, text string, lang string, source string, uid bigint, _t string, words string"
SPACE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def occurrences(w, s):
    return [i for i in range(len(w) - len(s) + 1) if w[i : i + len(s)] == s]


def brute_hits(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = terms(t)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t, *_ in docs:
        w, hit, found = terms(t), set(), set()
        for s, ids in windows.items():
            for at in occurrences(w, [*s]):
                hit |= set(range(at, at + len(s)))
                found |= ids
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), ",".join(names), bool(hit)))
    return Counter(out)


def leaky():
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "of", "Ünder", "cat", "x9", "dog", "sun", "moon", "tree", "river", "ñandú", "stone"])
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 40)))) for i in range(12)]
    items += [(3, items[5][1]), (None, " ".join(word() for _ in range(15))), (40, "zebra Quagga"), (41, None), (42, " .,- "), (43, "the " * 12), (44, "never seen words of any kind in these texts at all")]
    docs = []
    for k in range(30):
        body = [word() for _ in range(rng.randint(0, 700))]
        if k % 3 == 0:
            body[len(body) // 2 : len(body) // 2] = items[k % 14][1].upper().split() if items[k % 14][1] else []
        docs.append((k, ", ".join(body), "en", "s", 5, "_", "w"))
    long = " ".join(word() for _ in range(9000)) + " zebra-QUAGGA " + "the " * 300
    docs += [(7, docs[0][1], None, None, None, None, None), docs[3], docs[3], (None, items[13][1], None, None, 1, None, None), (90, None, *[None] * 5), (91, "", *[None] * 5), (92, long, *[None] * 5)]
    return docs, items


@pytest.mark.parametrize("chunk,block", [(256, 300_000), (16, 40)])
def test_contamination(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(decontaminate, "CHUNK", chunk)
    monkeypatch.setattr(decontaminate, "BLOCK", block)  # windows in several blocks
    docs, items = leaky()
    table, bench = spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(table, bench).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in got) == brute_hits(docs, items)
    assert sum(r["contaminated"] for r in got) > 5
    assert all(sum(s["end"] - s["first"] for s in r["spans"]) == r["n_hit"] for r in got)


def test_all_terms_may_be_indexed(spark, monkeypatch):
    docs, items = leaky()
    table, bench = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id bigint, text string")
    windows = decontaminate.cut_windows(bench)
    index = decontaminate.build_index(table)
    assert index.postings.count() == sum(len(terms(d[1])) for d in docs)
    monkeypatch.setattr(decontaminate, "BROADCAST_TERMS", 1)  # too many terms to send: every posting is kept
    same = decontaminate.build_index(table, terms=windows.words.select(F.explode("words")))
    assert same.postings.count() == index.postings.count()
    want = sum(len(occurrences(terms(d[1]), [*w["words"]])) for d in docs for w in windows.words.collect())
    assert decontaminate.phrase_matches(index, windows).count() == want > 100


def test_proximity(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(120)), *[None] * 5) for i in range(12)]
    items = [(0, "w1 w2 w3 w1"), (1, "w4 w5"), (2, "w6"), (3, "w7 nowhere")]
    index = decontaminate.build_index(spark.createDataFrame(docs, DOC))
    windows = decontaminate.cut_windows(spark.createDataFrame(items, "item_id bigint, text string"))
    docs_of = {r["uid"]: r["doc_id"] for r in index.texts.where("at = 0").collect()}
    names = {r["wid"]: " ".join(r["words"]) for r in windows.words.collect()}
    got = {(names[r["wid"]], docs_of[r["uid"]], r["first"], r["last"]) for r in decontaminate.proximity_matches(index, windows, span=8).collect()}
    want = set()
    for _, t in items:
        asked = set(t.split())
        for i, text, *_ in docs:
            w = text.split()
            for end in range(len(w)):
                if w[end] in asked and asked <= set(w[: end + 1]):
                    first = min(max(k for k in range(end + 1) if w[k] == x) for x in asked)
                    if end - first < 8:
                        want.add((t, i, first, end))
    assert got == want and len(want) > 20


def test_contamination_of_empty_tables(spark):
    none, bench = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert decontaminate.contamination(none, bench).count() == 0
    one = spark.createDataFrame([(1, "a b c", *[None] * 5)], DOC)
    r = decontaminate.contamination(one, bench.limit(0)).first()
    assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (3, 0, [], False)


# 12


def brute_audit(docs, labels):
    good = {i for i, q, t in labels if q == 1}
    toxic = {i for i, q, t in labels if t == 1}
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = []
    for i, t, lang, *_ in docs:
        t = t or ""
        w = [x for x in "".join(" " if c in SPACE else c for c in t).split(" ") if x]
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i}
        rows.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone, left = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                n = sum(r[1][f] for r in own)
                out[part, "".join(order), k] = [len(left), len(gone), n - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    for (part, order, k), v in out.items():
        v.append(sum(x[1] for (p, o, j), x in out.items() if p == part and o[j - 1] == order[k - 1] and len(x) >= 6))
    return {k: tuple(v) for k, v in out.items()}


def audited():
    rng = random.Random(4)
    texts = [None, "", "A" * 50, "# one", " ".join(f"word{i}" for i in range(120)), " ".join(f"word{i % 30}" for i in range(120)), "Q " * 200, "é$ " * 90]
    docs = [(rng.randint(0, 60), rng.choice(texts) if k % 2 else " ".join(rng.choice("abcDE#fghij") * rng.randint(1, 3) for _ in range(rng.randint(1, 160))), rng.choice(["en", "de", None, ""]), "s", 1, "t", "w") for k in range(120)]
    docs += [(None, texts[4], "en", *[None] * 4)] * 3 + [(5, texts[4], "en", *[None] * 4)] * 2 + [(99, texts[5], None, *[None] * 4)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 1), (5, 0, 0), (5, 1, 0)]
    return docs, labels


LABEL = "doc_id bigint, quality int, toxic int"


def test_audit(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 2)
    docs, labels = audited()
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in filter_audit.audit(spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(labels, LABEL)).collect()}
    assert got == brute_audit(docs, labels)
    assert len(got) == 3 * 600


def test_audit_of_hot_copies_and_nothing(spark):
    none = spark.createDataFrame([], LABEL)
    hot = spark.range(5000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same text', concat('text ', id)) as text", "'en' as lang")
    r = filter_audit.audit(hot, none).where("filter_order = 'EABCD' and step = 1").first()
    assert (r["removed"], r["kept"]) == (1666, 3334)
    assert filter_audit.audit(hot.limit(0), none).count() == 0


def test_first_failures():
    table = filter_audit.first_failures()
    for mask, (k, order) in itertools.product(range(32), enumerate(filter_audit.ORDERS)):
        places = [p for p, f in enumerate(order) if mask >> "ABCDE".index(f) & 1]
        assert table[mask, k] == min(places, default=5)


# 13


def brute_repair(turns):
    """By a search over strings of edits, cheapest first and then least: (cost, audit, repaired)."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    faults, seen = [], set()
    for role, text in turns:
        bare = text.strip(SPACE)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ".")
        seen.add((role, text))
    new = {"s": "user", "u": "assistant", "a": "user", "": "user"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, state, out = heapq.heappop(heap)
        if k == len(turns) and state in ("", "a"):
            return faults, cost, audit, "\n".join(out)
        if (k, state) in done:
            continue
        done.add((k, state))
        heapq.heappush(heap, (cost + 2, audit + "I", k, new[state][0], (*out, f"{new[state]}:")))
        if k == len(turns):
            continue
        role, text = turns[k]
        heapq.heappush(heap, (cost + 3, audit + "D", k + 1, state, out))
        if faults[k] not in "bd":
            extra = faults[k] == "t"
            if role[:1] in after[state] and role[:1]:
                heapq.heappush(heap, (cost + extra, audit + "K", k + 1, role[:1], (*out, f"{role}:{text}")))
            heapq.heappush(heap, (cost + 2 + extra, audit + "R", k + 1, new[state][0], (*out, f"{new[state]}:{text}")))


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3][:64].encode(), sha(r[3])))


def brute_rows(rows):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out = {}
    for conv in {r[0] for r in rows}:
        own = ordered(r for r in rows if r[0] == conv)
        faults, cost, audit, text = brute_repair([(r, x) for _, _, r, x in own])
        turns = [t for _, t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(own)]
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha(text))
    return out


def chats(seed, n, most=9):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "sys"]
    text = lambda: rng.choice([None, "", " \t", "Yes.", "No", "Why?", "Because!\n", f"line {rng.random()}.", "Yes."])
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, most)):
            role = ("user", "assistant")[t % 2] if rng.random() < 0.6 else rng.choice(roles)
            rows.append((c if c else None, None if rng.random() < 0.05 else t * rng.choice([1, 1, 2]), role, text()))
    return rows


MESSAGE = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("part", [256, 3])
def test_repair(spark, monkeypatch, part):
    monkeypatch.setattr(turn_repair, "PART", part)  # conversations in several parts
    rows = chats(1, 150) + [(500, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(100)] + [(501, 2**40, "user", "a.")] * 3
    got = turn_repair.repair(spark.createDataFrame(rows, MESSAGE).repartition(5)).collect()
    want = brute_rows(rows)
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_repaired_turns(spark):
    rows = chats(2, 60)
    df = spark.createDataFrame(rows, MESSAGE)
    turns = {}
    for r in turn_repair.repaired_turns(df).orderBy("place").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
        assert r["place"] == len(turns[r["conv_id"]]) - 1
    for r in turn_repair.repair(df).collect():
        mine = turns.get(r["conv_id"], [])
        assert sha("\n".join(f"{a}:{b}" for a, b in mine)) == r["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(a[0] for a, _ in mine))


def test_damage(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"Turn {t}. Is it so? Yes!") for c in range(60) for t in range(4)] + [(None, None, None, None), (77, None, "user", "x."), (78, 1, None, None)]
    rows += [r for r in [(c, 0, "assistant", "lone.") for c in range(1000, 1400)] if zlib.crc32(f"{r[0]}:0".encode()) % 20 == 0]
    left = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if kind == 0:
            continue
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        left += [(c, t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    want = brute_rows(left)
    got = {r["conv_id"]: tuple(r)[1:] for r in turn_repair.repair_damaged(spark.createDataFrame(rows, MESSAGE)).collect()}
    assert set(got) == {r[0] for r in rows} and len(want) < len(got)
    assert got == {c: want.get(c, (0, 0, 0, 0, 0, 0, "", sha(""))) for c in got}


def test_repair_of_extra_columns_and_nothing(spark):
    rows = [(1, 0, "user", "Hi.", "x", 1), (1, 1, "assistant", "Yes.", "y", 2)]
    df = spark.createDataFrame(rows, f"{MESSAGE}, conv string, place int")
    assert turn_repair.repair(df).first()["audit"] == "KK"
    assert turn_repair.repair_damaged(df.limit(0)).count() == 0


def test_repair_of_a_long_conversation(spark):
    n = 30_000
    df = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat(id, '.') as text")
    r = turn_repair.repair(df).first()
    assert (r["cost"], r["audit"]) == (0, "K" * n)
    assert r["repaired_sha256"] == sha("\n".join(f"{('user', 'assistant')[i % 2]}:{i}." for i in range(n)))
