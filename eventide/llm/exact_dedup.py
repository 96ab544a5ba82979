"""Exact dedup with an extendible-hash index on shared files.

Two texts are equal if they are identical after deleting white space. A text's key is its
64-bit hash. The directory maps key prefixes to buckets: it starts with one bucket, splits a
bucket that holds more than ``bucket_rows`` keys and doubles when the bucket's depth is its
own. Copies are combined in the task that reads them (so a hot text sends one row a batch),
entries travel to the owner of their bucket, and the owner walks its key range in order,
chains entries whose keys are equal and compares their bytes.

A bucket lives in the version of the files that last changed it. An insert reads, sends and
writes the buckets that its keys fall into (and what those split into), and leaves the others
where they are. Each version also has its directory beside it, so ``ExtendibleIndex.open``
finds the index again.

Every row gets the id of the row that stays in its group: most code points in the original
text, then smallest doc_id (null ids last), then smallest MD5 of the original text. Null texts
count as empty; all-white-space and empty texts form one group. Rows that repeat a doc_id are
judged each by its own text; rows that agree in doc_id and text are alike, so all of them are
``kept`` or none, while ``drop_copies`` keeps one row of each group, whatever its ids. An empty
table gives an empty result. Extra columns are ignored by the index.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, new_path, one_each, shuffle_partitions, slices, stored, text_key

_DROP = SPACE.encode()
#: Buckets a task owns on average. The directory grows with the number of owners, not with the rows.
BUCKETS_A_TASK = 16
#: Slots whose table is broadcast (16 bytes each); more are joined by shuffling.
BROADCAST_SLOTS = 1 << 20
_ENTRY = "key bigint, sha string, norm binary, n bigint, best_len bigint, best_id bigint, best_raw binary, best_n bigint"
_NAMES = ("key", "sha", "norm", "n", "best_len", "best_id", "best_raw", "best_n")
_NO_ID = 2**63 - 1

Bucket = tuple[int, int]  # depth, and the prefix of that many bits


def number(bucket: Bucket) -> int:
    """A bucket's name in the files: its prefix behind a leading one."""
    return 1 << bucket[0] | bucket[1]


def _line(bucket: Bucket) -> Iterator[Bucket]:
    """The bucket and those it was split from."""
    depth, prefix = bucket
    return ((depth - k, prefix >> k) for k in range(depth + 1))


class Directory:
    """Key prefix -> bucket; ``buckets`` has the version of each bucket's file (0: still empty)."""

    def __init__(self, buckets: dict[Bucket, int] | None = None):
        self.buckets = buckets or {(0, 0): 0}
        self.depth = max(d for d, _ in self.buckets)

    def split(self, counts: np.ndarray, capacity: int) -> None:
        """Split overfull buckets. ``counts``: keys by prefix, for all prefixes of one length."""
        finest = len(counts).bit_length() - 1
        before = np.concatenate([[0], np.cumsum(counts)])
        todo = list(self.buckets)
        while todo:
            depth, prefix = todo.pop()
            if depth >= finest:
                continue
            shift = finest - depth
            if before[(prefix + 1) << shift] - before[prefix << shift] > capacity:
                self.depth = max(self.depth, depth + 1)  # doubles if the bucket was at full depth
                halves = [(depth + 1, prefix * 2), (depth + 1, prefix * 2 + 1)]
                version = self.buckets.pop((depth, prefix))
                self.buckets.update(dict.fromkeys(halves, version))
                todo += halves

    def slots(self) -> list[tuple[int, int]]:
        """(slot, bucket number) for each of the 2 ** depth prefixes."""
        out = []
        for depth, prefix in sorted(self.buckets, key=lambda b: b[1] << (self.depth - b[0])):
            shift = self.depth - depth
            out += [(slot, number((depth, prefix))) for slot in range(prefix << shift, (prefix + 1) << shift)]
        return out


def _prefix(key: str, bits: int) -> Column:
    return F.lit(0).cast("bigint") if bits == 0 else F.shiftrightunsigned(F.col(key), 64 - bits)


def _signature(text: str | None) -> tuple[bytes, int, str]:
    norm = (text or "").encode("utf-8").translate(None, _DROP)
    key = xxhash.xxh64_intdigest(norm)
    return norm, key - (1 << 64) if key >> 63 else key, hashlib.sha256(norm).hexdigest()


def _raw(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"), text_key(F.col(text)).alias("raw"))


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, raw, key and SHA-256 of each row's normalised text; no text travels on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys, shas = [], []
                for t in part.column("text").to_pylist():
                    _, k, s = _signature(t)
                    keys.append(k)
                    shas.append(s)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("raw"), pa.array(keys, pa.int64()), pa.array(shas)], names=["doc_id", "raw", "key", "sha"])

    return _raw(docs, text).mapInArrow(run, "doc_id bigint, raw binary, key bigint, sha string")


def _combined(docs: DataFrame, text: str) -> DataFrame:
    """One row per distinct text of each batch: the map-side half of the aggregation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list] = {}
            for part in slices(batch):
                for i, t, raw in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "raw")), strict=True):
                    norm, key, sha = _signature(t)
                    rank = (-len(t or ""), _NO_ID if i is None else i, raw)
                    if (e := found.get(norm)) is None:
                        found[norm] = [key, sha, 1, rank, 1]
                    else:
                        _join(e, 1, rank, 1)
            yield _rows(found)

    return _raw(docs, text).mapInArrow(run, _ENTRY)


def _join(entry: list, n: int, rank: tuple, best_n: int) -> None:
    entry[2] += n
    if rank < entry[3]:
        entry[3], entry[4] = rank, best_n
    elif rank == entry[3]:
        entry[4] += best_n


def _rows(found: dict[bytes, list]) -> pa.RecordBatch:
    e = list(found.values())
    cols = ([x[0] for x in e], [x[1] for x in e], list(found), [x[2] for x in e], [-x[3][0] for x in e], [x[3][1] for x in e], [x[3][2] for x in e], [x[4] for x in e])
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=list(_NAMES))


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The owner of a key range: rows come in key order; those of one key are chained."""
    at: int | None = None
    chain: dict[bytes, list] = {}  # looked up by the bytes themselves
    shas: dict[str, bytes] = {}
    done: dict[bytes, list] = {}
    held = 0
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in _NAMES]
        for key, sha, norm, n, best_len, best_id, best_raw, best_n in zip(*cols, strict=True):
            if key != at:
                done.update(chain)
                chain, shas, at = {}, {}, key
                if held > 4_000_000:
                    yield _rows(done)
                    done, held = {}, 0
            rank = (-best_len, best_id, best_raw)
            if (e := chain.get(norm)) is None:
                if shas.setdefault(sha, norm) != norm:
                    raise ValueError(f"two different texts share the key {key} and the SHA-256 {sha}")
                chain[norm] = [key, sha, n, rank, best_n]
                held += len(norm) + 200
            else:
                _join(e, n, rank, best_n)
    done.update(chain)
    if done:
        yield _rows(done)


class ExtendibleIndex:
    """The index at ``path`` in a shared folder; each insert writes a version beside the older ones."""

    def __init__(self, spark: SparkSession, path: str | None = None, bucket_rows: int | None = None):
        self.spark, self.path, self.bucket_rows = spark, path or new_path(spark, "exact-index"), bucket_rows
        self.version, self.rows, self.directory = 0, 0, Directory()

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int, bucket_rows: int | None = None) -> ExtendibleIndex:
        """The index as its ``version`` left it."""
        out = cls(spark, path, bucket_rows)
        slots = spark.read.schema("depth int, prefix bigint, version int, rows bigint").parquet(f"{path}/directory-{version}").collect()
        out.version, out.rows, out.directory = version, slots[0]["rows"], Directory({(r["depth"], r["prefix"]): r["version"] for r in slots})
        return out

    def entries(self, only: set[Bucket] | None = None) -> DataFrame:
        """The entries with their bucket's number, of all buckets or of some."""
        live: dict[int, list[int]] = {}
        for b, version in self.directory.buckets.items():
            if version and (only is None or b in only):
                live.setdefault(version, []).append(number(b))
        out = self.spark.createDataFrame([], f"bucket bigint, {_ENTRY}")
        for version, numbers in sorted(live.items()):
            read = self.spark.read.schema(f"bucket bigint, {_ENTRY}").parquet(f"{self.path}/v{version}")
            wanted = self.spark.createDataFrame([(x,) for x in numbers], "bucket bigint")  # of a directory that the driver holds
            part = read.where(F.col("bucket").between(min(numbers), max(numbers)))
            out = out.unionByName(part.join(F.broadcast(wanted) if len(numbers) <= BROADCAST_SLOTS else wanted, "bucket", "left_semi"))
        return out

    def _slots(self, directory: Directory) -> DataFrame:
        slots = directory.slots()
        df = self.spark.createDataFrame(slots, "slot bigint, bucket bigint")
        return F.broadcast(df) if len(slots) <= BROADCAST_SLOTS else df

    def insert(self, docs: DataFrame, keys: DataFrame, text: str = "text") -> ExtendibleIndex:
        """Merge a batch. ``keys``: its column ``key``, for counting (see ``signatures``). The index
        changes once the new version's files are there: an insert that failed can be repeated."""
        spark, owners, d = self.spark, shuffle_partitions(self.spark), Directory(dict(self.directory.buckets))
        touched = keys.withColumn("slot", _prefix("key", d.depth)).join(self._slots(d), "slot").select("bucket").distinct()
        numbers = {r["bucket"] for r in touched.toLocalIterator()}  # of a directory that the driver holds
        changed = {b for b in d.buckets if number(b) in numbers}
        old = self.entries(changed).drop("bucket") if any(d.buckets[b] for b in changed) else None
        mine = keys.select("key") if old is None else keys.select("key").unionByName(old.select("key"))
        rows, version = self.rows + keys.count(), self.version + 1
        capacity = self.bucket_rows or max(16, rows // (BUCKETS_A_TASK * owners))
        finest = max(d.depth, math.ceil(math.log2(max(2, rows / capacity))) + 2)
        counts = np.zeros(1 << finest, np.int64)
        for r in mine.select(_prefix("key", finest).alias("p"), "key").distinct().groupBy("p").count().toLocalIterator():
            counts[r["p"]] = r["count"]
        d.split(counts, capacity)
        new = _combined(docs, text) if old is None else _combined(docs, text).unionByName(old)
        slots, depth = self._slots(d), d.depth
        routed = new.withColumn("slot", _prefix("key", depth)).join(slots, "slot")
        owned = routed.repartition(owners, "bucket").sortWithinPartitions("bucket", "key").select(*_NAMES).mapInArrow(_own, _ENTRY)
        owned.withColumn("slot", _prefix("key", depth)).join(slots, "slot").select("bucket", *_NAMES).write.mode("overwrite").parquet(f"{self.path}/v{version}")
        for bucket in d.buckets:
            if not changed.isdisjoint(_line(bucket)):
                d.buckets[bucket] = version
        spark.createDataFrame([(*b, v, rows) for b, v in d.buckets.items()], "depth int, prefix bigint, version int, rows bigint").write.mode("overwrite").parquet(f"{self.path}/directory-{version}")
        self.directory, self.rows, self.version = d, rows, version
        return self

    def lookup(self, signed: DataFrame) -> DataFrame:
        """Per row of ``signed``: doc_id, keep_id, group_size, kept, text_sha256, and raw and
        best_n (rows that agree in id and text with the one that stays)."""
        found = self.entries().select("key", "sha", F.col("n").alias("group_size"), "best_id", "best_raw", "best_n")
        keep_id = F.when(F.col("best_id") != _NO_ID, F.col("best_id"))
        kept = F.col("doc_id").eqNullSafe(keep_id) & (F.col("raw") == F.col("best_raw"))
        return signed.join(found, ["key", "sha"]).select("doc_id", keep_id.alias("keep_id"), "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"), "raw", "best_n")


def _groups(docs: DataFrame, text: str, bucket_rows: int | None = None) -> DataFrame:
    signed = stored(signatures(docs, text), "signatures")
    return ExtendibleIndex(docs.sparkSession, bucket_rows=bucket_rows).insert(docs, signed.select("key"), text).lookup(signed)


def exact_groups(docs: DataFrame, text: str = "text", bucket_rows: int | None = None) -> DataFrame:
    """Build the index over ``docs`` and look every row up in it."""
    return _groups(docs, text, bucket_rows).drop("raw", "best_n")


def drop_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each group, with its own columns. Only rows that go, or that repeat, are sent to
    be joined."""
    verdict = _groups(docs, text).where("not kept or best_n > 1").select("doc_id", "raw", F.col("kept").alias("stays"))
    return one_each(docs, verdict, text)
