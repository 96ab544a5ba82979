"""Mixing sources to target weights by Poisson replication.

A source with n rows and target weight w (of weights that sum to 1) gets a mean repetition
rate of ``rows * w / n``, where ``rows`` is the size aimed at. Each document's copies are a
Poisson draw with that mean, by inverting the distribution at a uniform number that a seeded
hash of its name gives: the draw needs no coordination and a lost task repeats it exactly.
Copies are then dealt to tasks, and ordered there, by another seeded hash: a global shuffle.

A row's name is its doc_id (or the word null), the MD5 of its text and its number among equal
rows. So rows without a doc_id, rows that repeat one and rows that repeat whole draw each for
itself and are dealt like any others. A missing source (null) is a source of its own. Weights
must be finite, not negative and one a source, or an error is raised. An empty table gives an
empty result. Extra columns travel with their row; columns named like those added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import COPIES, numbered, shuffle_partitions, stored

SEED, TEMPERATURE = 20240501, 0.5
#: A mean above this is drawn as the sum of several draws, so that exp(-mean) stays exact.
MEAN_A_DRAW = 16
#: Sources whose table of means may be broadcast; more are joined by shuffling ids.
BROADCAST_SOURCES = 100_000
_TERMS = 128
_TOP = 1 - 1e-14


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 hash."""
    hashed = F.md5(F.encode(F.concat_ws(":", *[p.cast("string") for p in parts]), "UTF-8"))
    return (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("bigint") + 0.5) / float(1 << 52)


def _check(weights: DataFrame) -> None:
    bad = F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < 0) | (F.col("weight") == float("inf"))
    wrong = weights.groupBy("_s").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).where("n > 1 or bad > 0").first()
    if wrong is not None:
        raise ValueError(f"source {wrong['_s']!r} has {wrong['n']} weights, {wrong['bad']} of them null, negative or not finite")


def means(docs: DataFrame, source: str = "source", weights: DataFrame | None = None, temperature: float = TEMPERATURE, rows: int | None = None) -> DataFrame:
    """source and mean (copies a document) for every source.

    ``weights``: a table (source, weight), of any scale; sources that it lacks get none. Without
    it a source's weight is its share of the rows to the power ``temperature``."""
    n = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        _check(w)
        n = n.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0.0, ["weight"])
    n = stored(n, "sources")
    total = n.agg(F.sum("weight").alias("w"), F.sum("n").alias("n")).first()
    aim = float(rows if rows is not None else total["n"] or 0)
    return n.select("source", (F.lit(aim) * (F.col("weight") / (total["w"] or 1.0)) / F.col("n")).alias("mean"))


def _inverse(means_: DataFrame) -> DataFrame:
    """Adds draws (how many) and cdf (of one draw)."""
    draws = F.greatest(F.lit(1), F.ceil(F.col("mean") / MEAN_A_DRAW).cast("int"))
    one = F.col("mean") / F.col("draws")
    first = F.struct(F.exp(-one).alias("p"), F.array(F.exp(-one)).alias("c"))
    step = lambda acc, k: F.struct((acc["p"] * one / k).alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * one / k)).alias("c"))
    return means_.withColumn("draws", draws).withColumn("cdf", F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), first, step, lambda acc: acc["c"]))


def mix(docs: DataFrame, source: str = "source", text: str = "text", seed: int = SEED, **targets) -> DataFrame:
    """Every document as often as drawn, in a global shuffle, with ``copies`` (drawn in all),
    ``copy`` (from 0) and ``shuffle_key``; tasks hold ascending keys."""
    table = stored(_inverse(means(docs, source, **targets)), "means").withColumnRenamed("source", "_source")
    seen = table.agg(F.count("*").alias("n"), F.max("mean").alias("most")).first()
    few = seen["n"] <= BROADCAST_SOURCES
    own = [c for c in docs.columns if c not in ("copies", "copy", "shuffle_key")]
    body = F.coalesce(F.col("_own")[text], F.lit("")) if text in own else F.lit("")
    name = F.concat_ws(":", F.coalesce(F.col("_own.doc_id").cast("string"), F.lit("null")), F.md5(body.cast("binary")), F.col("_k").cast("string"))
    named = numbered(docs.select(*own)).select("_own", F.col("_own")[source].alias("_of"), name.alias("_name"))
    named = named.join(F.broadcast(table) if few else table, F.col("_of").eqNullSafe(F.col("_source")))
    draw = lambda j: F.size(F.filter("cdf", lambda c: c <= F.least(uniform(F.lit(seed), F.col("_name"), j), F.lit(_TOP)))).cast("bigint")
    copies = F.aggregate(F.sequence(F.lit(0), F.col("draws") - 1), F.lit(0).cast("bigint"), lambda acc, j: acc + draw(j))
    zero, drawn = F.lit(0).cast("bigint"), named.withColumn("copies", copies).where("copies > 0")
    if (seen["most"] or 0) * 2 > COPIES:  # one row may be drawn without end: its copies are made in pieces
        pieces = drawn.withColumn("_at", F.explode(F.sequence(zero, F.col("copies") - 1, F.lit(COPIES).cast("bigint"))))
        drawn = pieces.repartition(shuffle_partitions(docs.sparkSession), "_name", "_at")
        drawn = drawn.withColumn("copy", F.explode(F.sequence("_at", F.least(F.col("_at") + (COPIES - 1), F.col("copies") - 1))))
    else:
        drawn = drawn.withColumn("copy", F.explode(F.sequence(zero, F.col("copies") - 1)))
    key = F.md5(F.concat_ws(":", F.lit(str(seed + 1)), "_name", F.col("copy").cast("string")).cast("binary"))
    keyed = drawn.select("_own.*", "copies", "copy", key.alias("shuffle_key"))
    return keyed.repartition(shuffle_partitions(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")
