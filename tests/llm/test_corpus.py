"""The corpus operators against brute force on small fixtures."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from eventide.llm import bpe, common, exact_dedup, graph, line_dedup, mixing, quality_classifier, quality_rules, quotation, sharding, simhash, substring_dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, shard string"
SPACE = " \t\n\x0b\x0c\r"


def fixture_docs():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(40))
    texts = [None, "", " \t\n", "one", "Same line\nsame LINE \nother", "The\x0bend\x0c of\r\nit", "word " * 300, "a b " * 120, "x" * 5000]
    for k in range(40):
        body = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 90)))
        if k % 3 == 0:
            body += "\n" + shared + "\n" + rng.choice(vocabulary)
        if k % 4 == 0:
            body += "\n  Common Footer \n\ncommon footer"
        texts.append(body)
    texts += [texts[12], texts[12] + " ", " " + texts[13], texts[12], texts[15] + " tail"]
    return [(i * 3 % 101, t, "en", None if i % 7 == 0 else f"s{i % 3}", None, "k", "z") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_docs(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, repeated rows."""
    rows = fixture_docs()[8:16]
    rows += [rows[4], (rows[4][0], "quite another text", *rows[4][2:]), (None, rows[5][1], *rows[5][2:]), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return [w for w in "".join(" " if c in SPACE else c for c in text or "").split(" ") if w]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# 1


def brute_substrings(rows, window):
    first = {}
    for i, t in sorted((r[0], r[1]) for r in rows):
        w = words(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for r in rows:
        w = words(r[1])
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < r[0] for j in range(window)}
        out[r[0]] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("window,mmer", [(13, 3), (5, 2)])
def test_substrings(docs, window, mmer):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(docs, window=window, mmer=mmer).collect()}
    want = brute_substrings(fixture_docs(), window)
    assert got == want
    assert any(n for _, n, _ in want.values())


def test_substrings_of_odd_rows(odd, empty):
    got = substring_dedup.remove_repeats(odd, window=5, mmer=2).collect()
    assert len(got) == odd.count()
    other = [r for r in got if r["kept"] == "quite another text"]
    assert len(other) == 1 and other[0]["n_removed"] == 0
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_substrings_of_equal_rows_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FLUSH_BYTES", 20_000)  # the same row is sent many times
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(1, text)] + [(None, text)] * 10_000 + [(None, text + " tail")] * 2 + [(7, "x " + text), (7, "quite another text of the same id")]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert {tuple(r) for r in got} == {(1, 400, 0, 1), (None, 400, 400, 10_000), (None, 401, 400, 2), (7, 401, 400, 1), (7, 7, 0, 1)}


@pytest.mark.parametrize("few,flush", [(1, 24_000_000), (2, 4_000)])
def test_places_of_frequent_strings_go_round_the_judge(spark, docs, odd, monkeypatch, few, flush):
    monkeypatch.setattr(substring_dedup, "FEW", few)
    monkeypatch.setattr(substring_dedup, "FLUSH_BYTES", flush)
    monkeypatch.setattr(substring_dedup, "GATHER", 50)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(docs, window=5, mmer=2).collect()}
    assert got == brute_substrings(fixture_docs(), 5)
    assert substring_dedup.remove_repeats(odd, window=5, mmer=2).count() == odd.count()


def test_a_passage_in_very_many_documents(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FLUSH_BYTES", 200_000)  # many blobs
    passage = " ".join(f"p{i}" for i in range(30))
    df = spark.range(100_000).selectExpr("id as doc_id", f"concat('own', id, ' {passage} end', id) as text").repartition(8)
    got = substring_dedup.remove_repeats(df).groupBy("n_words", "n_removed").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).collect()
    assert {tuple(r) for r in got} == {(32, 0, 1, 0), (32, 30, 99_999, 1)}


@pytest.mark.parametrize("n", [100, 200])
def test_a_copy_gives_one_range(spark, n):
    left, right = (" ".join(f"{side}{i}" for i in range(60)) for side in "lr")
    rows = [(i, f"{left} {right}") for i in range(n)] + [(n + i, f"{left} own{i} {right}") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = defaultdict(list)
    for x in substring_dedup.repeated_spans(substring_dedup._named(df, "text")).collect():
        got[x["doc"]].append((x["start"], x["stop"]))
    assert {i: got[i] for i in range(1, n)} == {i: [(0, 120)] for i in range(1, n)} and 0 not in got
    for i in range(n, 2 * n):  # strings that hold the own word stand once: the judge gives their ranges
        assert {k for x in got[i] for k in range(*x)} == {*range(121)} - {60}


def test_frequent_strings_of_mixed_documents(spark):
    r = random.Random(5)
    passages = [" ".join(r.choice("abcdefgh") + str(r.randrange(9)) for _ in range(n)) for n in (5, 14, 20, 33, 70)] + ["a " * 40, "a b " * 30]
    rows = [(i, " ".join(r.choice(passages) if r.random() < 0.7 else f"own{i}" for _ in range(r.randrange(12)))) for i in range(1_000)]
    r.shuffle(rows)
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept"]) for x in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)).collect()}
    assert got == brute_substrings(rows, 13)


def test_places_of_frequent_strings_come_back(monkeypatch):
    place = lambda docs: np.array([(d, 0, 3 * d) for d in docs], substring_dedup._OCC).tobytes()
    found = lambda: {b"x y": [1, place(range(70, 0, -1))], b"y z": [2, place(range(80))], b"few": [3, place([1, 2])]}
    all_places = found()
    ref, blob = substring_dedup._aside(all_places)
    shas, of, occ = substring_dedup._open_aside(blob)
    for k, (packed, docs) in enumerate([(b"x y", range(1, 71)), (b"y z", range(80))]):
        assert shas[k] == substring_dedup._signed(packed) and occ[of == k].tobytes() == place(docs)
        assert np.frombuffer(all_places[packed][1], substring_dedup._OCC).tolist() == [(docs[0], ref, substring_dedup._MANY)]
    assert all_places[b"few"] == found()[b"few"] and substring_dedup._aside({b"few": found()[b"few"]}) is None
    monkeypatch.setattr(substring_dedup, "_signed", lambda data: 7)  # of strings that share a hash one goes aside
    same = found()
    substring_dedup._aside(same)
    assert len(same[b"x y"][1]) == substring_dedup._OCC.itemsize and same[b"y z"] == found()[b"y z"]


def test_frequent_minimisers_are_split(spark, docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_WINDOWS", 1)
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", 0.01)
    named = substring_dedup._named(docs, "text")
    assert len(substring_dedup._frequent(named, 100, 50, 13, 3)) > 10
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == brute_substrings(fixture_docs(), 13)


def test_hash_collisions_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring_dedup._Bytes, "hash", lambda self, a, b: np.zeros(len(a), np.uint64))
    occ = lambda d: np.array([(d, 0, 0)], substring_dedup._OCC).tobytes()
    (batch,) = substring_dedup._judge({b"a b c": [occ(1)], b"a b c d": [occ(2)], b"x y z": [occ(3)]}, 3)
    out = batch.to_pydict()
    assert out["doc"] == [2] and out["start"] == [0] and out["stop"] == [3]


def test_long_documents_are_segmented(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SEGMENT", 7)
    found = {}
    w = [str(i).encode() for i in range(40)]
    rows = [(1, 0, at, w[at : at + 7 + 4]) for at in range(0, 40 - 5 + 1, 7)]
    substring_dedup._pack(rows, 5, 2, found)
    starts = sorted(int(a) + k for p, (_, raw) in found.items() for a in np.frombuffer(raw, substring_dedup._OCC)["at"] for k in range(len(p.split()) - 4))
    assert starts == list(range(36))


# 2


def brute_fingerprint(text, n=4):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    shingles = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, distance):
    ids = sorted(prints)
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= distance:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("distance,blocks", [(4, None), (12, None), (4, 5)])
def test_simhash(docs, distance, blocks):
    prints = {r[0]: brute_fingerprint(r[1]) for r in fixture_docs()}
    want = brute_components(prints, distance)
    got = by_id(simhash.near_groups(docs, distance=distance, blocks=blocks))
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_simhash_on_the_table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in d.collect()}
    got = by_id(simhash.near_groups(d))
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(prints, 4)


def test_dense_groups_are_chunked(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 8)
    rng = random.Random(1)
    prints = {i: (0xABCDEF0123456789 ^ sum(1 << b for b in rng.sample(range(64), 5))) for i in range(120)}
    signed = {i: f - (1 << 64) if f >> 63 else f for i, f in prints.items()}
    edges = simhash.links(spark.createDataFrame([(f,) for f in set(signed.values())], "fp bigint"), 4, 7)
    labels = {r["u"]: r["v"] for r in graph.components(edges).collect()}
    groups = defaultdict(set)
    for i, f in signed.items():
        groups[labels.get(f, f)].add(i)
    want = defaultdict(set)
    for i, top in brute_components(prints, 4).items():
        want[top].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_simhash_of_odd_rows(odd, empty):
    got = simhash.near_groups(odd).collect()
    assert len(got) == odd.count()
    assert {r["fingerprint"] for r in got if r["doc_id"] is None} >= {"0" * 16}
    assert simhash.near_groups(empty).count() == 0
    assert simhash.keep_one(odd).columns == odd.columns


LOST = [(1, "alpha beta"), (None, "alphabeta"), (None, "a unique text nobody else has"), (None, "another unique"), (5, "alphabetax"), (6, "alpha betax"), (5, "unique five"), (7, "same"), (7, "same"), (7, "sa me"), (None, "null twice"), (None, "null twice"), (None, None), (8, " ")]


def test_no_row_is_lost_for_its_id(spark):
    """Null and repeated ids: one row of each group stays, whatever shares its id."""
    d = spark.createDataFrame([(*r, k) for k, r in enumerate(LOST)], "doc_id bigint, text string, _raw int").repartition(3)
    texts = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in exact_dedup.drop_copies(d).collect())
    assert texts == sorted([(False, 1, "alpha beta"), (True, 0, "a unique text nobody else has"), (True, 0, "another unique"), (False, 6, "alpha betax"), (False, 5, "unique five"), (False, 7, "sa me"), (True, 0, "null twice"), (False, 8, " ")])
    prints = defaultdict(list)
    for i, t in LOST:
        prints[brute_fingerprint(t)].append((i is None, i or 0, hashlib.md5((t or "").encode()).digest(), t))
    named = dict(enumerate(sorted(prints)))
    tops = defaultdict(list)
    for k, top in brute_components(named, 4).items():
        tops[top] += prints[named[k]]
    want = Counter((None if void else i, t) for void, i, _, t in map(min, tops.values()))
    assert Counter((r["doc_id"], r["text"]) for r in simhash.keep_one(d).collect()) == want


def test_hot_rows_are_counted(spark):
    d = spark.createDataFrame([(1, "hot row")] * 25_003 + [(2, "b"), (None, None), (None, None)], "doc_id bigint, text string").repartition(4)
    got = Counter((*r["_own"], r["_k"]) for r in common.numbered(d).collect())
    assert got == Counter([(1, "hot row", k) for k in range(25_003)] + [(2, "b", 0), (None, None, 0), (None, None, 1)])
    assert exact_dedup.drop_copies(d).count() == 3
    assert sorted(r["text"] for r in simhash.keep_one(d.where("text is not null")).collect()) == ["b", "hot row"]


def test_components_of_long_paths(spark):
    n = 200
    order = random.Random(2).sample(range(n), n)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(500, 501)], "u bigint, v bigint")
    got = {r["u"]: r["v"] for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, n)}, 501: 500}


# 3


def test_classifier_on_held_out_rows(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.classify(d, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_classifier_without_labels(odd, empty, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in quality_classifier.classify(odd, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, None) for i in range(200)] + [(None, 0, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    assert all(r["score"] > 0.9 for r in quality_classifier.classify(odd, one).collect())
    assert quality_classifier.classify(empty, one).count() == 0
    assert quality_classifier.keep(odd, one).columns == odd.columns


def test_scores_against_plain_python(spark, odd):
    """The compiled column against rules that plain Python reads."""
    d, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.train(d, labels)
    assert model.rules
    for df in (d, odd):
        for r in df.select("doc_id", "text").join(quality_classifier.classify(df, labels), "doc_id").collect() if df is d else []:
            x = quality_classifier.statistics(r["text"])
            z = model.intercept + sum(w for rule, w in zip(model.rules, model.weights, strict=True) if all((x[f] <= t) == below for f, below, t in rule))
            assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9
    got = quality_classifier.features(odd.select("text")).select(model.score().alias("score")).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)


def test_classifier_with_odd_labels(spark, docs):
    """Repeated and null labels, a labelled id that stands in many rows."""
    rows = [(r[0], int(len(r[1] or "") > 200), 0) for r in fixture_docs()]
    labels = spark.createDataFrame(rows + rows[:5] + [(None, 1, 0), (3, None, None), (10**9, 1, 1)], "doc_id bigint, quality int, toxic int")
    many = docs.unionByName(docs.where("doc_id = 36").crossJoin(spark.range(300)).drop("id"))
    got = quality_classifier.classify(many, labels).collect()
    assert len(got) == many.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 36}) == 1


def test_tree_paths():
    tree = "header\n  If (feature 0 <= 1.5)\n   If (feature 2 <= 0.1)\n    Predict: 1.0\n   Else (feature 2 > 0.1)\n    Predict: 0.0\n  Else (feature 0 > 1.5)\n   Predict: 0.0\n"
    assert quality_classifier.paths(tree) == {((0, True, 1.5),), ((0, False, 1.5),), ((0, True, 1.5), (2, True, 0.1)), ((0, True, 1.5), (2, False, 0.1))}


# 4


def brute_chats(rows):
    import re

    def parse(text):
        out = []
        for line in (text or "").split("\n"):
            m = re.match(r"[ \t]*((?:>[ \t]*)+)", line)
            body = line[m.end() :] if m else line
            out.append((m[1].count(">") if m else 0, body, " ".join(words(body)).translate({c: c + 32 for c in range(65, 91)})))
        return out

    def passages(lines):
        """Runs of lines of one kind, broken by blank lines: (level, lines); attributions are no kind."""
        out, last = [], None
        for k, (level, _, normal) in enumerate(lines):
            if not level and k + 1 < len(lines) and lines[k + 1][0] and normal.endswith(":"):
                level = None
            if level is not None and normal:
                if level != last:
                    out.append((level, []))
                out[-1][1].append(normal)
            last = level if normal else None
        return out

    parsed = {(c, t): parse(x) for c, t, _, x in rows}
    own = {n: [x for k, x in enumerate(p) if x[0] == 0 and not (k + 1 < len(p) and p[k + 1][0] and x[2].endswith(":"))] for n, p in parsed.items()}
    first_here, first = {}, {}
    for (c, t), lines in sorted(parsed.items()):
        for level, body in passages(lines):
            for unit in {"\n".join(body), *body} if level == 0 else ():
                first_here.setdefault((c, unit), t)
                first.setdefault(unit, (c, t))
    parent = {}
    for n in sorted(parsed):
        votes = Counter()

        def known(unit, n=n):
            if first_here.get((n[0], unit), n[1]) < n[1]:
                return (n[0], first_here[n[0], unit])
            return first[unit] if unit in first and first[unit] < n else None

        for level, body in passages(parsed[n]):
            if level:
                if of := known("\n".join(body)):
                    votes[level, of] += len(body)
                else:
                    for x in body:
                        if of := known(x):
                            votes[level, of] += 1
        previous = max((m for m in parsed if m[0] == n[0] and m < n), default=None)
        parent[n] = max(votes, key=lambda v: (-v[0], votes[v], v[1][0] == n[0], v[1]))[1] if votes else previous
    out = {}
    for n in parsed:
        depth, top = 0, n
        while parent[top]:
            depth, top = depth + 1, parent[top]
        out[n] = (parent[n], top, depth, "\n".join(x[1] for x in own[n]).strip(SPACE))
    return out


CHATS = [
    (1, 0, "user", "Hello there\nHow does  it work?\nThanks"),
    (1, 1, "assistant", "It depends."),
    (1, 2, "user", "On Monday someone wrote:\n> how DOES it work?\n> Thanks\nI ask again"),
    (1, 3, "assistant", "> > how does it work?\n> I ask again\n>\nSee below"),
    (2, 0, "user", "> It depends.\nOn what?"),
    (2, 1, "user", None),
    (2, 2, "user", ">> nothing known\n\n> unknown too"),
    (3, 5, "system", "Thanks"),
    (3, 7, "user", "> Thanks\n> \n>> It depends.\nok"),
    (4, 1, "user", "> only a quote"),
    (5, 1, "user", "Thanks\nfor the\nlong answer\n\nBye"),
    (5, 2, "assistant", "for the"),
    (5, 3, "user", "> Thanks\n> for  the\n> long ANSWER\nindeed"),
    (5, 4, "user", "> for the\n> unknown line\n> Bye\n>> Thanks\n ok"),
]


def test_quotation(spark):
    want = brute_chats(CHATS)
    df = spark.createDataFrame([(*r, "x", "y") for r in CHATS], "conv_id bigint, turn bigint, role string, text string, place string, h string")
    out = quotation.format_chats(df)
    got = {(r["conv_id"], r["turn"]): ((r["parent_conv"], r["parent_turn"]) if r["parent_conv"] is not None else None, (r["thread_conv"], r["thread_turn"]), r["depth"], r["own_text"]) for r in out.collect()}
    assert got == want
    assert got[1, 3][0] == (1, 2) and got[2, 0][0] == (1, 1) and got[1, 2][3] == "I ask again"
    assert got[5, 3][0] == (5, 1)  # the whole passage, not its first line's oldest original
    threads = quotation.conversations(quotation.parts(out)).collect()
    assert sum(len(t["messages"]) for t in threads) == len(CHATS)
    whole = {(t["thread_conv"], t["thread_turn"]): [m["text"] for m in t["messages"]] for t in threads}
    for top, texts in whole.items():
        members = sorted((want[n][2], n) for n in want if want[n][1] == top)
        assert texts == [want[n][3] for _, n in members]


def test_quote_marks_without_end(spark):
    rows = [(1, 0, "user", "long line"), (1, 1, "user", ">" * 1_000_000 + " long line\n" + "> " * 50_000 + "x\nok"), (2, 0, "user", "a\n" * 100_000 + "end")]
    got = {(r["conv_id"], r["turn"]): r for r in quotation.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got[1, 1]["quote_levels"] == 1_000_000 and got[1, 1]["own_text"] == "ok" and got[1, 1]["parent_turn"] == 0
    assert len(got[2, 0]["own_text"]) == 200_003


def test_conversations_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(quotation, "PART", 3)
    rows = [(1, t, "user", f"line {t}") for t in range(8)] + [(1, 2, "user", "line 2 again")] * 5 + [(None, 1, None, "alone"), (2, None, "user", None)]
    out = quotation.parts(quotation.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")))
    got = quotation.conversations(out).collect()
    assert max(len(r["messages"]) for r in got) == 3 and sum(len(r["messages"]) for r in got) == len(rows)
    long = sorted((r["part"], [m["text"] for m in r["messages"]]) for r in got if r["part"] is not None)
    assert [x for _, m in long for x in m] == ["line 0", "line 1", "line 2", *["line 2 again"] * 5, *[f"line {t}" for t in range(3, 8)]]


def test_quotation_of_odd_rows(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    rows = [(None, 1, "user", "> a"), (5, None, None, "b"), (5, 0, "user", "b"), (5, 0, "user", "c"), (5, 1, "user", "> c")]
    got = quotation.format_chats(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and all(r["depth"] == 0 for r in got if r["turn"] != 1 or r["conv_id"] is None)
    assert quotation.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_long_threads(spark):
    rows = [(1, t, "user", f"line {t}") for t in range(70)]
    got = quotation.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert sorted((r["turn"], r["depth"], r["place"]) for r in got.collect()) == [(t, t, t) for t in range(70)]


# 5


def brute_copies(doc_id, text, mean, k=0):
    draws = max(1, math.ceil(mean / 16))
    n = 0
    name = f"{'null' if doc_id is None else doc_id}:{hashlib.md5((text or '').encode()).hexdigest()}:{k}"
    for j in range(draws):
        u = (int(hashlib.md5(f"{mixing.SEED}:{name}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        p = c = math.exp(-mean / draws)
        k = 0
        while c <= min(u, 1 - 1e-14) and k < 128:
            k += 1
            p *= mean / draws / k
            c += p
            n += 1
    return n


@pytest.mark.parametrize("aim", [None, 3000])
def test_mixing(docs, aim):
    rows = fixture_docs()
    n = Counter(r[3] for r in rows)
    total = sum(math.sqrt(x) for x in n.values())
    want = {r[0]: brute_copies(r[0], r[1], (aim or len(rows)) * math.sqrt(n[r[3]]) / total / n[r[3]]) for r in rows}
    got = mixing.mix(docs, rows=aim).collect()
    assert Counter(r["doc_id"] for r in got) == {i: c for i, c in want.items() if c}
    assert len({(r["doc_id"], r["copy"]) for r in got}) == len(got)


def test_mixing_to_weights(spark, odd, empty):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "rare").otherwise("often").alias("source"))
    w = spark.createDataFrame([("rare", 3.0), ("often", 1.0)], "source string, weight double")
    got = dict(mixing.mix(d, weights=w).groupBy("source").count().collect())
    assert abs(got["rare"] - 15_000) < 600 and abs(got["often"] - 5_000) < 350
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(odd.withColumn("copy", F.lit("c"))).select("text").columns == ["text"]
    for bad in ([("rare", 1.0), ("rare", 2.0)], [("rare", -1.0)], [("rare", float("nan"))], [("rare", None)]):
        with pytest.raises(ValueError):
            mixing.mix(d, weights=spark.createDataFrame(bad, "source string, weight double"))


def test_mixing_of_rows_without_ids(spark):
    """Null ids and equal rows draw each for itself and have keys of their own."""
    rows = [(None, "same", "s")] * 300 + [(None, f"t{i}", "s") for i in range(300)] + [(5, f"u{i}", "s") for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)).collect()
    assert len({r["shuffle_key"] for r in got}) == len(got)
    want = Counter({("same"): sum(brute_copies(None, "same", 1.0, k) for k in range(300))} | {f"t{i}": brute_copies(None, f"t{i}", 1.0) for i in range(300)} | {f"u{i}": brute_copies(5, f"u{i}", 1.0) for i in range(300)})
    assert Counter(r["text"] for r in got) == +want


# 6


@pytest.mark.parametrize("n", [0, 1, 39, 1000])
def test_sharding(spark, n):
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("shard"), F.lit(None).cast("string").alias("text"))
    got = sharding.assign(d).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(n))
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r["slot"])
    sizes = [len(shards.get(k, [])) for k in range(40)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign(d).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in got}
    if n == 1000:
        place = {r["doc_id"]: r["slot"] * 40 + r["shard"] for r in got}
        assert abs(np.corrcoef(range(n), [place[i] for i in range(n)])[0, 1]) < 0.15


def test_one_order_for_a_seed(spark, odd, monkeypatch):
    """Neither the session's partitions nor those of the input move a row; whole records move."""
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    d = spark.createDataFrame([(i, f"text {i}", f"s{i % 3}") for i in range(2000)] + [(3, "equal rows", "s")] * 500, "doc_id bigint, text string, source string")
    orders = []
    for n, parts in ((4, 3), (7, 11)):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        orders.append(sorted((r["shard"], r["slot"], r["doc_id"], r["text"], r["source"]) for r in sharding.assign(d.repartition(parts)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert orders[0] == orders[1]
    assert Counter(x[2:] for x in orders[0]) == Counter(tuple(r) for r in d.collect())
    sizes = Counter(x[0] for x in orders[0])
    assert max(sizes.values()) - min(sizes.values()) <= 1
    monkeypatch.setattr(sharding, "FANOUT", 7)  # 50 buckets in 8 groups
    got = sharding.assign(d).collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == Counter(tuple(r) for r in d.collect())
    assert sorted(r["slot"] * 40 + r["shard"] for r in got) == list(range(2500))
    clash = odd.withColumns({c: F.lit(1) for c in ("_k", "_own", "_hash", "offset", "n", "row", "bucket")})
    assert set(clash.columns) - {"shard", "bucket"} < set(sharding.assign(clash).columns)
    assert set(clash.columns) <= set(mixing.mix(clash).columns)
    rows = sharding.assign(odd).collect()
    assert Counter(r["text"] for r in rows) == Counter(r["text"] for r in odd.collect())


def test_equal_rows_spread_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 100)
    d = spark.createDataFrame([(1, "hot")] * 5000 + [(2, "b")], "doc_id bigint, text string")
    (rows, _), = sharding.shuffled(d, F.lit(1))
    held = [r["count"] for r in rows.groupBy("bucket").count().collect()]
    assert sum(held) == 5001 and max(held) < 200


def test_the_query_of_sharding(spark):
    from eventide.llm import queries

    got = {r["doc_id"]: r for r in queries.op6_sharding(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        raw = (r["text"] or "").encode()
        g = got[r["doc_id"]]
        assert (g["size"], g["text_crc32"], g["law"], g["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    place = sorted(g["slot"] * 40 + g["shard"] for g in got.values())
    assert place == list(range(len(rows)))


def test_shards_are_written(odd, tmp_path, spark):
    sharding.write_shards(odd.drop("shard"), str(tmp_path / "out"), shards=3, file_rows=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(r["text"] for r in back.collect()) == Counter(r["text"] for r in odd.collect())
    assert back.groupBy("shard", "part").count().agg(F.max("count")).first()[0] <= 2


# 7


def test_bpe_against_the_library(docs, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    for df in (docs, odd):
        for r in bpe.decode(bpe.encode(df, path), path).collect():
            e = t.encode(r["text"] or "", add_special_tokens=False)
            assert np.frombuffer(r["token_bytes"], "<u4").tolist() == e.ids
            assert r["decoded"] == t.decode(e.ids, skip_special_tokens=False)
    assert bpe.digest(empty, path).count() == 0


def test_bpe_of_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    b, t = bpe.Bpe(path), Tokenizer.from_file(path)
    texts = ["it's Σας ΟΔΟΣ's", "<|endoftext|> a<|startoftext|>b 's", "日本語 123 ½²³", "é İstanbul ß", "\x1c\x1d a\x85b", "🤷🏽‍♀️🎉!!!", "a" * 3000, "ab" * 900, "naïve\r\n\x00\x01�", "_a_b__"]
    for x, got in zip(texts, b.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_bpe_of_more_pieces_than_the_cache(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    ids = lambda text: np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 400))) for _ in range(100)]
    for pieces, learn, held in ((40, 7, 50), (1000, 25_000, 400_000), (40, 25_000, 90)):
        monkeypatch.setattr(bpe, "CACHE_PIECES", pieces)
        monkeypatch.setattr(bpe, "LEARN_PIECES", learn)
        monkeypatch.setattr(bpe, "HELD_PIECES", held)
        b = bpe.Bpe(path)
        assert b.encode(texts) == [ids(x) for x in texts]
        assert b.encode(texts[50:] + texts[:10]) == [ids(x) for x in texts[50:] + texts[:10]]
    monkeypatch.undo()
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: letters[k % 26] + letters[k // 26 % 26] + letters[k // 676 % 26] + letters[k // 17576 % 26] + letters[k // 456976]
    long = " ".join(map(word, range(600_000)))
    assert bpe.Bpe(path).encode(["ab cd", long, "ef"]) == [ids("ab cd"), ids(long), ids("ef")]


def test_bpe_caches_are_bounded(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(bpe, "CACHE_PIECES", 40)
    b = bpe.Bpe(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}q{k}" for i in range(30)) for k in range(5)]
    whole = bpe.Bpe(public_tokenizers.path("word_bpe_49k.json"))
    assert [b.encode([x])[0] for x in texts] == whole.encode(texts)


# 8


def strip_all(t):
    return "".join(c for c in t or "" if c not in SPACE)


def test_exact_dedup(docs):
    rows = fixture_docs()
    groups = defaultdict(list)
    for r in rows:
        groups[strip_all(r[1])].append(r)
    got = by_id(exact_dedup.exact_groups(docs))
    for norm, members in groups.items():
        keep = min(members, key=lambda r: (-len(r[1] or ""), r[0]))[0]
        for r in members:
            g = got[r[0]]
            assert (g["keep_id"], g["group_size"], g["kept"], g["text_sha256"]) == (keep, len(members), r[0] == keep, sha(norm))


def test_index_grows_by_batches(spark, docs):
    a, b = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    index = exact_dedup.ExtendibleIndex(spark, bucket_rows=3)
    for part in (a, b):
        index.insert(part, exact_dedup.signatures(part).select("key"))
    assert index.directory.depth >= 3
    whole = sorted(map(tuple, exact_dedup.exact_groups(docs).collect()))
    look = lambda x: sorted(map(tuple, x.lookup(exact_dedup.signatures(docs)).drop("raw", "best_n").collect()))
    assert look(index) == whole
    assert look(exact_dedup.ExtendibleIndex.open(spark, index.path, 2)) == whole
    assert index.entries().groupBy("bucket").count().agg(F.max("count")).first()[0] <= 3


def test_inserts_touch_changed_buckets_only(spark):
    d = spark.createDataFrame([(i, f"text number {i}") for i in range(400)], "doc_id bigint, text string")
    index = exact_dedup.ExtendibleIndex(spark, bucket_rows=10)
    index.insert(d, exact_dedup.signatures(d).select("key"))
    one = spark.createDataFrame([(900, "text number 7"), (3, "text number 7 7")], "doc_id bigint, text string")
    index.insert(one, exact_dedup.signatures(one).select("key"))
    live = Counter(index.directory.buckets.values())
    assert live[2] <= 4 and live[1] >= 30
    assert spark.read.parquet(f"{index.path}/v2").count() <= 40
    both = d.unionByName(one)
    got = sorted(map(tuple, index.lookup(exact_dedup.signatures(both)).drop("raw", "best_n").collect()))
    assert got == sorted(map(tuple, exact_dedup.exact_groups(both).collect()))


def test_exact_dedup_of_odd_rows(odd, empty):
    assert exact_dedup.exact_groups(odd).count() == odd.count()
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_copies(odd).columns == odd.columns


def test_directory_splits():
    d = exact_dedup.Directory()
    d.split(np.array([10, 1, 0, 0, 0, 2, 0, 0]), 4)
    assert (3, 0) in d.buckets and d.depth == 3
    slots = dict(d.slots())
    assert sorted(slots) == list(range(8)) and slots[4] == slots[7] == slots[5]


# 9


def brute_stats(t):
    w = words(t)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(grams)
    repeated = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w))


def test_quality_rules(docs, odd, empty):
    got = quality_rules.judge(docs).collect()
    texts = {r[0]: r[1] for r in fixture_docs()}
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_stats(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])
    assert any(r["kept"] for r in got)
    assert quality_rules.judge(odd).count() == odd.count() and quality_rules.judge(empty).count() == 0
    assert quality_rules.keep(odd).columns == odd.columns


def brute_verdict(t):
    w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
    n_words, chars, symbols, dup, _, failed = brute_stats(t)
    of = lambda good: sum(c in good for c in t or "")
    bad = [len(set(w)) * 50 < n_words, symbols * 5 > n_words, of("ABCDEFGHIJKLMNOPQRSTUVWXYZ") * 5 > chars * 2, of("!") * 5 > n_words, dup * 2 > len(lines), chars < n_words * 2 or chars > n_words * 20, of("0123456789") * 2 > chars]
    return not failed and not any(bad)


def test_quality_verdicts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: brute_verdict(r["text"]) for r in rows.collect()}
    assert {r["doc_id"]: r["kept"] for r in quality_rules.judge(rows).collect()} == want and len(set(want.values())) == 2
    assert {r["doc_id"] for r in quality_rules.keep(rows).collect()} == {i for i, k in want.items() if k}


def test_quality_rules_of_rows_without_ids(spark):
    """A short row without an id doesn't take others with it."""
    good = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(None, good), (None, "short"), (4, good + " more"), (4, "short too"), (4, good + " more")]
    kept = quality_rules.keep(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter(tuple(r) for r in kept) == Counter([(None, good), (4, good + " more"), (4, good + " more")])


def test_costs_of_rules_are_measured(docs):
    slow = quality_rules.Rule("slow", lambda: F.length(F.sha2(F.repeat("_t", 50), 512)) < 0)
    fast = quality_rules.Rule("fast", lambda: F.col("n_words") > 60)
    got = quality_rules.measure(quality_rules.base(docs), (slow, fast))
    n = quality_rules.base(docs).agg(F.avg((F.col("n_words") > 60).cast("int"))).first()[0]
    assert got["slow"][0] > 3 * got["fast"][0] and abs(got["fast"][1] - n) < 1e-9 and got["slow"][1] == 0
    assert [r.name for r in quality_rules.ranked(got, (slow, fast))] == ["fast", "slow"]


def test_cascade_order_moves_cost_only(docs):
    measured = {r.name: (1.0 + k, 0.1 * (k % 3)) for k, r in enumerate(quality_rules.RULES)}
    order = quality_rules.ranked(measured)
    gains = [measured[r.name][1] / measured[r.name][0] for r in order]
    assert gains == sorted(gains, reverse=True)
    b = quality_rules.base(docs)
    verdicts = [sorted(map(tuple, b.select("doc_id", quality_rules.cascade(o).isNull()).collect())) for o in (order, order[::-1])]
    assert verdicts[0] == verdicts[1]


# 10


def brute_lines(rows, threshold):
    key = lambda x: x.strip(SPACE).translate({c: c + 32 for c in range(65, 91)})
    n = Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")})
    out = {}
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not key(x) or n[key(x)] < threshold]
        out[r[0]] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("threshold", [3, 10])
def test_lines(docs, threshold):
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.dedup_lines(docs, threshold=threshold).collect()}
    assert got == brute_lines(fixture_docs(), threshold)
    assert any(x[1] for x in got.values())


def test_lines_are_reversible(spark, docs):
    a, b = docs.where("doc_id % 2 = 0").cache(), docs.where("doc_id % 2 = 1").cache()
    rows = fixture_docs()
    index = line_dedup.LineIndex(spark, shards=5, threshold=4).insert(a)
    before = sorted(map(tuple, index.counts().collect()))
    index.insert(b)
    both = {r["doc_id"]: r["kept"] for r in line_dedup.drop_lines(docs, index).collect()}
    assert both == {i: x[2] for i, x in brute_lines(rows, 4).items()}
    index.delete(b)
    assert sorted(map(tuple, index.counts().collect())) == before
    alone = {r["doc_id"]: r["kept"] for r in line_dedup.drop_lines(a, index).collect()}
    assert alone == {i: x[2] for i, x in brute_lines([r for r in rows if r[0] % 2 == 0], 4).items()}


def test_shards_follow_the_keys(spark, docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    index = line_dedup.LineIndex(spark, shards=1, threshold=2).insert(docs.where("doc_id % 3 = 0"))
    few = index.shards
    index.insert(docs.where("doc_id % 3 <> 0"))
    assert index.shards > few >= 1
    rows = fixture_docs()
    got = {r["doc_id"]: r["kept"] for r in line_dedup.drop_lines(docs, index).collect()}
    assert got == {i: x[2] for i, x in brute_lines(rows, 2).items()}


def test_lines_of_odd_rows(odd, empty):
    assert line_dedup.dedup_lines(odd, threshold=2).count() == odd.count()
    assert line_dedup.dedup_lines(empty).count() == 0


def test_cuckoo_filter():
    h = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 3000)
    f = line_dedup.CuckooFilter.build(h)
    assert f.contains(h).all() and (f.cells != 0).sum() == len(h)
    f.remove(h[:1000])
    assert f.contains(h[1000:]).all() and f.contains(h[:1000]).mean() < 0.02
    assert line_dedup.CuckooFilter.of(f.tobytes()).contains(h[1000:]).all()


# pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert seen[-1].columns == columns
    quality, exact, near, mixed, tokens = [x.collect() for x in seen[1:]]
    assert len({strip_all(r["text"]) for r in quality}) == len(exact)
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in exact}
    assert {r["doc_id"] for r in near} == set(brute_components(prints, 4).values())
    n = Counter(r["source"] for r in near)
    total = sum(math.sqrt(x) for x in n.values())
    want = {r["doc_id"]: brute_copies(r["doc_id"], r["text"], len(near) * math.sqrt(n[r["source"]]) / total / n[r["source"]]) for r in near}
    assert Counter(r["doc_id"] for r in mixed) == {i: c for i, c in want.items() if c}
    assert Counter(r["doc_id"] for r in tokens) == Counter(r["doc_id"] for r in mixed)


def test_rows_of_one_source_stay_whole(spark):
    d = spark.createDataFrame([Row(doc_id=i, text="same text of all", source="hot") for i in range(300)])
    assert exact_dedup.exact_groups(d).where("kept").count() == 1
    assert simhash.near_groups(d).select("component_id").distinct().count() == 1
