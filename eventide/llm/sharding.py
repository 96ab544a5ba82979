"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass 1 scatters the whole rows over buckets that fit in memory, by a seeded hash. Pass 2 puts
each bucket in a fixed order, shuffles it by Fisher-Yates (Spark's ``shuffle``) and writes it to
the shared folder. The buckets one after the other are a random order of all rows; row g of
that order goes to shard g modulo the number of shards, as its slot g div that number. So
shards hold a random draw each and their row counts differ by one at most (law ``rows``).

Buckets are sized by the table alone, and tasks are counted by buckets, so a seed gives one
order whatever the session's number of shuffle partitions. A table of more than ``FANOUT``
buckets is first scattered into groups of that many, which are written and then shuffled one
by one: no task or shuffle sees more buckets than that, at any size.

Rows scatter by the hash of all columns and their number among equal rows, so a row that
repeats without end is spread like any other. Null texts have size 16; null and repeated ids
are columns like others. An empty table gives an empty result. Extra columns travel with their
row; columns named like those added are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, numbered, stored

SEED, SHARDS = 7, 40
#: Rows and bytes that a bucket aims at; a bucket is one array in one task.
BUCKET_ROWS, BUCKET_BYTES = 25_000, 8_000_000
#: Buckets that are shuffled at once at most, and tasks that each has its own bucket.
FANOUT, OWN_TASKS = 1 << 16, 256
BUCKETS_A_TASK = 16
#: Rows of a written file.
FILE_ROWS = 100_000
_ADDED = ("bucket", "place", "shard", "slot", "law")


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 16."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 16


def _bucketed(rows: DataFrame, buckets: int, first: int, seed: int) -> DataFrame:
    """Pass 2 over rows that carry their bucket (from ``first`` on): each is put in the order of a
    hash, shuffled, and written with places."""
    tasks = max(min(buckets, OWN_TASKS), -(-buckets // BUCKETS_A_TASK))
    row = F.struct(F.xxhash64(F.lit(seed + 1), "_hash", "_k").alias("h"), F.col("_own").alias("r"))
    one = rows.select("bucket", row.alias("row")).repartition(tasks, "bucket").groupBy("bucket").agg(F.collect_list("row").alias("rows"))
    by_hash = lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0)
    mixed = one.select("bucket", F.array_sort("rows", by_hash).alias("rows")).sortWithinPartitions("bucket").select("bucket", F.shuffle("rows", seed + first).alias("rows"))
    return stored(mixed.select("bucket", F.posexplode("rows").alias("place", "row")).select(F.col("row.r").alias("_own"), "bucket", F.col("place").cast("bigint").alias("place")), "buckets")


def shuffled(docs: DataFrame, row_bytes: Column, seed: int = SEED) -> list[tuple[DataFrame, int]]:
    """The rows (``_own``) with ``bucket`` and ``place`` (from 0), written to the shared folder, as the
    groups of buckets that follow each other, each with the number of rows in the groups before it."""
    total = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(row_bytes), F.lit(0)).alias("b")).first()
    buckets = max(1, -(-total["n"] // BUCKET_ROWS), -(-total["b"] // BUCKET_BYTES))
    own = [c for c in docs.columns if c not in _ADDED]
    rows = numbered(docs.select(*own)).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "_hash", "_k"), F.lit(buckets)))
    groups = -(-buckets // FANOUT)
    if groups == 1:
        return [(_bucketed(rows, buckets, 0, seed), 0)]
    path = new_path(docs.sparkSession, "groups")
    rows.withColumn("group_", F.floor(F.col("bucket") / FANOUT).cast("int")).write.partitionBy("group_").parquet(path)
    read = docs.sparkSession.read.parquet(path)
    sizes = {r["group_"]: r["count"] for r in read.groupBy("group_").count().collect()}  # one row a group
    out, before = [], 0
    for g in range(groups):
        if sizes.get(g):
            part = read.where(F.col("group_") == g).drop("group_")
            out.append((_bucketed(part, min(FANOUT, buckets - g * FANOUT), g * FANOUT, seed), before))
            before += sizes[g]
    return out


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, text: str = "text", row_bytes: Column | None = None) -> DataFrame:
    """The rows with ``law``, ``shard`` and ``slot``. ``row_bytes``: a row's size for the buckets, that
    of its text and 64 if none is given."""
    if row_bytes is None:
        row_bytes = size_of(F.col(text)) + 48 if text in docs.columns else F.lit(64)
    parts = []
    for rows, start in shuffled(docs, row_bytes, seed):
        counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))  # FANOUT rows at most
        before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("bucket", (F.coalesce(F.sum("n").over(before), F.lit(0)) + start).alias("offset"))
        at = F.col("offset") + F.col("place")
        parts.append(rows.join(F.broadcast(offsets), "bucket").select("_own.*", F.lit("rows").alias("law"), (at % shards).cast("int").alias("shard"), F.expr(f"(offset + place) div {int(shards)}").alias("slot")))
    return reduce(DataFrame.unionByName, parts)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, text: str = "text", file_rows: int = FILE_ROWS) -> None:
    """Write the rows as Parquet in folders ``shard=k/part=p``: p counts pieces of ``file_rows`` slots,
    each one file in slot order, so that a shard is written by as many tasks as it has pieces."""
    out = assign(docs, shards, seed, text).withColumn("part", F.floor(F.col("slot") / file_rows).cast("int"))
    out.repartition("shard", "part").sortWithinPartitions("shard", "part", "slot").write.partitionBy("shard", "part").parquet(path)
