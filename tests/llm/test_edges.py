"""Clashing names, columns of map type, indexes that open again: cases beside the operators' own tests."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import common, exact_dedup, line_dedup, mixing, quotation, sharding, simhash


def mapped(spark):
    """Repeated rows, equal texts and copies, with maps at the top and inside a struct."""
    rows = spark.range(60).selectExpr("id % 20 as doc_id", "concat('some words of text number ', id % 15, ' and ', id % 5) as text", "concat('s', id % 2) as source", "map('a', id % 20, 'b', 1L) as m", "named_struct('inner', map(id % 20, 'x')) as st")
    return rows.repartition(3)


def test_map_columns_travel(spark):
    df = mapped(spark)
    ids = lambda out: sorted(r["doc_id"] for r in out.collect())
    assert ids(simhash.keep_one(df)) == ids(simhash.keep_one(df.drop("m", "st")))
    kept = exact_dedup.drop_copies(df)
    assert ids(kept) == ids(exact_dedup.drop_copies(df.drop("m", "st")))
    assert all(r["m"] == {"a": r["doc_id"], "b": 1} and r["st"]["inner"] == {r["doc_id"]: "x"} for r in kept.collect())
    assert ids(mixing.mix(df, rows=200)) == ids(mixing.mix(df.drop("m", "st"), rows=200))
    shards = sharding.assign(df, shards=7)
    assert shards.count() == 60 and {r["m"]["a"] - r["doc_id"] for r in shards.collect()} == {0}


def test_maps_in_another_order_are_equal_rows(spark):
    df = spark.createDataFrame([(1, "t", {"a": 1, "b": 2}), (1, "t", {"b": 2, "a": 1}), (1, "t", {"a": 1})], "doc_id bigint, text string, m map<string,int>")
    assert sorted(r["_k"] for r in common.numbered(df).collect()) == [0, 0, 1]


def test_copies_of_one_row_are_made_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 10)
    df = spark.createDataFrame([(1, "a", "one"), (2, "a", "two"), (2, "b", "three")], "doc_id bigint, source string, text string")
    out = mixing.mix(df, rows=900).collect()
    whole = {}
    for r in out:
        whole.setdefault((r["doc_id"], r["text"]), []).append((r["copy"], r["copies"]))
    assert len(whole) == 3
    for got in whole.values():
        assert sorted(k for k, _ in got) == list(range(got[0][1])) and got[0][1] > 200
    monkeypatch.undo()
    assert sorted(map(str, mixing.mix(df, rows=900).collect())) == sorted(map(str, out))


def test_quotation_of_clashing_names(spark):
    names = ("_lines", "_own", "_c", "_t", "_prev", "_n", "h", "p", "u", "pos", "level", "of", "me", "up", "parent", "first", "copy", "row", "grp", "task", "seq", "part", "x", "messages", "weight", "whole", "settled", "_me", "_up", "_depth", "_done", "done")
    rows = [(1, 0, "user", "Hello there.\nSecond line"), (1, 1, "assistant", "> Hello there.\nYes."), (1, 2, "user", "plain"), (2, 0, "user", "> Hello there.\nMe too"), (None, 1, "user", "lone")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = sorted(map(str, quotation.parts(quotation.format_chats(df)).collect()))
    wide = quotation.parts(quotation.format_chats(df.withColumns({n: F.lit(7) for n in names})))
    assert sorted(map(str, wide.drop(*[n for n in names if n != "part"]).collect())) == want
    assert quotation.conversations(wide).count() == quotation.conversations(quotation.parts(quotation.format_chats(df))).count()


def lines(spark, ids):
    return spark.createDataFrame([(i, f"Shared line\n  {'odd' if i % 2 else 'even'} one\nown {i}") for i in ids], "doc_id bigint, text string")


def test_a_line_index_opens_again(spark):
    first = line_dedup.LineIndex(spark, shards=3, threshold=3, min_chars=2).insert(lines(spark, range(4)))
    again = line_dedup.LineIndex.open(spark, first.path, 1)
    assert (again.shards, again.threshold, again.min_chars, again.version) == (3, 3, 2, 1)
    again.insert(lines(spark, range(10, 14)))
    dropped = lambda index, docs: sorted((r["doc_id"], r["n_dropped"]) for r in line_dedup.drop_lines(docs, index).collect())
    whole = line_dedup.LineIndex(spark, threshold=3, min_chars=2).insert(lines(spark, [*range(4), *range(10, 14)]))
    docs = lines(spark, range(16))
    assert dropped(again, docs) == dropped(whole, docs) == [(i, 2) for i in range(16)]
    line_dedup.LineIndex.open(spark, first.path, 2).delete(lines(spark, range(10, 14)))
    assert dropped(line_dedup.LineIndex.open(spark, first.path, 3), docs) == dropped(line_dedup.LineIndex.open(spark, first.path, 1), docs) == [(i, 1) for i in range(16)]


def test_what_was_not_inserted_is_not_deleted(spark):
    index = line_dedup.LineIndex(spark, threshold=2).insert(lines(spark, range(4)))
    before = sorted(map(str, index.counts().collect()))
    for batch in (lines(spark, [77]), lines(spark, range(6))):
        with pytest.raises(ValueError, match="deleted"):
            index.delete(batch)
        assert index.version == 1 and sorted(map(str, index.counts().collect())) == before
    index.delete(lines(spark, [3]))
    assert index.version == 2
    with pytest.raises(ValueError):
        line_dedup.LineIndex(spark).delete(lines(spark, [1]))


def test_one_row_repeated_very_often(spark):
    df = spark.range(20_000).selectExpr("if(id % 2 = 0, 1L, id) as doc_id", "if(id % 2 = 0, 'the same row\nof two lines', concat('own ', id, '\nshared end')) as text").repartition(4)
    got = {(r["n_lines"], r["n_dropped"]): r["n"] for r in line_dedup.dedup_lines(df).groupBy("n_lines", "n_dropped").agg(F.count("*").alias("n")).collect()}
    assert got == {(2, 2): 10_000, (2, 1): 10_000}


def test_a_filter_forgets_in_bulk():
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**63), 2**63 - 1, 20_000)
    h[5000:5010] = h[:10]  # equal hashes take a cell each
    f = line_dedup.CuckooFilter.build(h)
    f.remove(h[:10_000])
    assert f.contains(h[10_000:]).all() and f.contains(h[10:5000]).mean() < 0.01
    f.remove(h[10_000:])
    assert not f.cells.any()


def test_a_failed_insert_can_be_repeated(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(50)], "doc_id bigint, text string")
    keys = exact_dedup.signatures(docs, "text").select("key")
    index = exact_dedup.ExtendibleIndex(spark, bucket_rows=4)
    real = exact_dedup._own

    def broken(batches):
        raise RuntimeError("lost")
        yield

    monkeypatch.setattr(exact_dedup, "_own", broken)
    with pytest.raises(Exception, match="lost"):
        index.insert(docs, keys)
    assert (index.rows, index.version, index.directory.buckets) == (0, 0, {(0, 0): 0})
    monkeypatch.setattr(exact_dedup, "_own", real)
    index.insert(docs, keys)
    assert index.rows == 50 and index.entries().count() == 7
