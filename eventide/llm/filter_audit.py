"""Filter interaction audit: what each filter removes at each place of every order of filters.

A document's failures are five bits. For each of the 32 masks and 120 orders a table made once
holds the place of the first filter that fails. Documents pass through ``mapInArrow`` as (part,
mask, labels, how many): ``np.bincount`` counts them by part, mask and label, indexes the table
and counts again by part, order and place of removal. Partial arrays of the tasks are summed by
Spark, and everything else (kept, redundant, shapley) follows from the sums.

Whether a text stands under a smaller doc_id too is told without joining back: rows are counted
by (SHA-256 of the text, part, labels) together with their smallest doc_id, which combines
copies in the tasks that read them, and meet in the few rows of a text. A text that a third of all
documents share is one such row a task.

Null text counts as empty, a null part as the empty string. A document without a doc_id is no
smaller than any and has no smaller one beside it: it never fails E and makes none fail. Rows
that repeat a doc_id and text are counted each; labels of a doc_id that has several rows are
its largest. Texts are equal if their SHA-256 is. Texts of any length are read by Spark's own
functions; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, words
from .docstats import n_of

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CELLS = len(ORDERS) * STEPS
#: Parts whose arrays a task holds at most (some 15 kB each) before it hands them on.
HELD_PARTS = 512
_COUNTS = ("removed", "good", "toxic")


def first_failures() -> np.ndarray:
    """By mask and order, the place (0 to 4) of the first filter that fails, or 5 for none."""
    table = np.full((1 << STEPS, len(ORDERS)), STEPS, np.int64)
    for k, order in enumerate(ORDERS):
        for place in reversed(range(STEPS)):
            fails = (np.arange(1 << STEPS) >> FILTERS.index(order[place])) & 1
            table[fails == 1, k] = place
    return table


def text_mask(text: Column, w: Column) -> Column:
    """Failures of the four filters that look at the text alone, as bits; ``w`` are its words."""
    n = F.size(w)
    a, b = n < 100, 100 * F.size(F.array_distinct(w)) < 80 * n
    c = 100 * n_of(text, _CAPITALS) > 10 * F.length(text)
    d = text.rlike(r"[#$%&*|]")
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate((a, b, c, d))), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "lang") -> DataFrame:
    """part, mask (five bits), good, toxic and n: the documents by part, failures and labels."""
    t = settled(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("_t")), _w=words(F.col("_t")))
    rows = t.select("doc_id", "part", F.sha2(F.encode("_t", "UTF-8"), 256).alias("_raw"), text_mask(F.col("_t"), F.col("_w")).alias("mask"))
    rows = rows.groupBy("doc_id", "part", "_raw", "mask").agg(F.count("*").alias("n"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    zero = F.lit(0)
    joined = rows.where("doc_id is not null").join(known.hint("merge"), F.col("doc_id") == F.col("_id"), "left").select(*rows.columns, F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"))
    both = joined.unionByName(rows.where("doc_id is null").withColumns({"good": zero, "toxic": zero}))
    # The n of the smallest doc_id of a group: doc_id and n as one struct, whose least is that of the
    # smallest doc_id; one doc_id has one row in a group.
    at = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    groups = both.groupBy("_raw", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), at)
    least = groups.withColumn("_least", F.min("first.doc_id").over(Window.partitionBy("_raw")))
    fine = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("_least"), F.col("first.n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.lit(0).alias("e"), fine.alias("n")), F.struct(F.lit(1 << 4).alias("e"), (F.col("n") - fine).alias("n")))).alias("x")
    return least.select("part", "mask", "good", "toxic", split).where("x.n > 0").select("part", (F.col("mask") + F.col("x.e")).alias("mask"), "good", "toxic", F.col("x.n").alias("n"))


def removals(failed: DataFrame) -> DataFrame:
    """part, total, by_mask (32), and removed, good and toxic (600 each, order by order and step
    by step): one row a task and part, to be summed."""
    array = "array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = first_failures()
        cell = np.arange(len(ORDERS)) * (STEPS + 1) + place  # by mask: each order's cell of removal
        held: dict[str, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            names, masks = [*held], np.stack([*held.values()])  # (part, label, mask)
            k, many = len(names) * len(_COUNTS), len(ORDERS) * (STEPS + 1)
            index = (np.arange(k)[:, None, None] * many + cell).ravel()
            out = np.bincount(index, np.repeat(masks.reshape(k, -1), len(ORDERS), axis=1).ravel(), k * many)
            out = out.astype(np.int64).reshape(len(names), len(_COUNTS), len(ORDERS), STEPS + 1)[..., :STEPS].reshape(len(names), len(_COUNTS), _CELLS)
            lists = [pa.array([*out[:, i]], pa.list_(pa.int64())) for i in range(len(_COUNTS))]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([*masks[:, 0].astype(np.int64)], pa.list_(pa.int64())), *lists], names=["part", "by_mask", *_COUNTS])

        for batch in batches:
            coded = batch.column("part").dictionary_encode()
            names, of = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            mask, n = batch.column("mask").to_numpy(), batch.column("n").to_numpy()
            size = len(names) << STEPS
            weights = [n, n * batch.column("good").to_numpy(), n * batch.column("toxic").to_numpy()]
            sums = np.stack([np.bincount((of << STEPS) + mask, w, size).reshape(len(names), -1) for w in weights], 1)
            for k, name in enumerate(names):
                held[name] = held[name] + sums[k] if name in held else sums[k]
                if len(held) >= HELD_PARTS:
                    yield flush()
        if held:
            yield flush()

    return failed.mapInArrow(run, f"part string, by_mask {array}, " + ", ".join(f"{c} {array}" for c in _COUNTS))


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "lang") -> DataFrame:
    """One row a part, filter_order and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley (see the module and the names in ``FILTERS``)."""
    partial = removals(failures(docs, labels, text, part))
    cells = partial.select("part", F.posexplode(F.arrays_zip(*_COUNTS)).alias("cell", "x")).groupBy("part", "cell").agg(*[F.sum(f"x.{c}").alias(c) for c in _COUNTS])
    masks = partial.select("part", F.posexplode("by_mask").alias("mask", "n"))
    fails = [F.sum(F.when(F.expr(f"mask & {1 << k} != 0"), F.col("n")).otherwise(0)) for k in range(STEPS)]
    alone = [F.sum(F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0)) for k in range(STEPS)]
    whole = masks.groupBy("part").agg(F.sum("n").alias("total"), F.array(*fails).alias("fails"), F.array(*alone).alias("alone"))
    order = F.element_at(F.array(*map(F.lit, ORDERS)), (F.floor(F.col("cell") / STEPS) + 1).cast("int"))
    at = cells.select("part", order.alias("filter_order"), (F.col("cell") % STEPS + 1).cast("int").alias("step"), *_COUNTS)
    at = at.withColumn("_k", F.instr(F.lit(FILTERS), F.expr("substring(filter_order, step, 1)")))
    gone = F.sum("removed").over(Window.partitionBy("part", "filter_order").orderBy("step"))
    out = at.withColumns({"_gone": gone, "shapley": F.sum("removed").over(Window.partitionBy("part", "_k"))}).join(whole, "part")
    mine = lambda c: F.element_at(c, F.col("_k"))
    return out.select("part", "filter_order", "step", (F.col("total") - F.col("_gone")).alias("kept"), "removed", (mine("fails") - F.col("removed")).alias("redundant"), mine("alone").alias("unique_fails"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")
