"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

A line's key is the line without white space at its ends, A-Z lower-cased, and is kept as the
first 16 bytes of its SHA-256. The reference table counts, for every key, the documents that
hold it. Keys that reach ``threshold`` documents are in their shard's cuckoo filter, which,
unlike a Bloom filter, can also forget. ``insert`` and ``delete`` fold a batch of documents
into the counts and add or remove just the fingerprints of keys that crossed the threshold,
so deleting a batch restores the state before it.

To drop lines, (document, key hash) pairs travel to the shard's task, preceded by the shard's
filter; what passes the filter is looked up in the shard's exact keys. A shard with many pairs
is dealt to several tasks, each with a copy of the filter. Pairs that hit go back to their
documents. The number of shards follows that of the frequent keys: it doubles, and the filters
are built anew from the exact counts, before a shard holds more than about ``SHARD_KEYS`` of
them (24 bytes each), which bounds what one task holds and what a copy costs at any size.

Each row is one document. Null text counts as one empty line. Keys shorter than ``min_chars``
never drop. Rows that repeat a doc_id count and are judged each by its own text; a null doc_id
is a document like any other. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, new_path, shuffle_partitions, slices, stored

THRESHOLD, MIN_CHARS = 10, 1
#: Frequent keys of a shard, on average at most.
SHARD_KEYS = 50_000
_LAST = 2**63 - 1
_LOWER = {c: c + 32 for c in range(65, 91)}
_SLOTS = 4


class CuckooFilter:
    """Approximate set of 64-bit hashes: four 16-bit fingerprints a bucket, two buckets a hash."""

    def __init__(self, buckets: int = 16, cells: np.ndarray | None = None):
        self.cells = np.zeros((buckets, _SLOTS), np.uint16) if cells is None else cells

    @classmethod
    def of(cls, raw: bytes | None) -> CuckooFilter:
        return cls() if raw is None else cls(cells=np.frombuffer(raw, np.uint16).reshape(-1, _SLOTS).copy())

    def tobytes(self) -> bytes:
        return self.cells.tobytes()

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = h.astype(np.int64).view(np.uint64)
        mask = np.uint64(len(self.cells) - 1)
        print_ = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = h & mask
        return print_, first, first ^ (self._jump(print_) & mask)

    @staticmethod
    def _jump(print_: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (print_.astype(np.uint64) * np.uint64(0x5BD1E9955BD1E995)) >> np.uint64(20)

    def contains(self, h: np.ndarray) -> np.ndarray:
        p, a, b = self._places(h)
        return (self.cells[a] == p[:, None]).any(1) | (self.cells[b] == p[:, None]).any(1)

    def add(self, h: np.ndarray) -> bool:
        """False if a hash found no place; the filter must then be rebuilt larger.

        All hashes look for a free cell at once, in their first and then in their second bucket; those
        that find none each push out a print at random, and what was pushed out looks further."""
        rng = np.random.default_rng(len(h))
        prints, first, second = self._places(h)
        left = self._fill(prints, first)
        prints, at = prints[left], second[left]
        left = self._fill(prints, at)
        prints, at, mask = prints[left], at[left], np.uint64(len(self.cells) - 1)
        for _ in range(500):
            if not len(prints):
                return True
            turn = np.zeros(len(at), bool)
            turn[np.unique(at, return_index=True)[1]] = True  # one push a bucket; the others wait
            k = rng.integers(_SLOTS, size=int(turn.sum()))
            pushed = self.cells[at[turn], k]
            self.cells[at[turn], k] = prints[turn]
            prints = np.concatenate([pushed, prints[~turn]])
            at = np.concatenate([at[turn] ^ (self._jump(pushed) & mask), at[~turn]])
            left = self._fill(prints, at)
            prints, at = prints[left], at[left]
        return not len(prints)

    def _fill(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put prints into free cells of their buckets; tells which are left."""
        order = np.argsort(at, kind="stable")
        begin = np.flatnonzero(np.diff(at[order], prepend=at[order[:1]] + np.uint64(1)) != 0) if len(at) else order
        nth = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))  # among those of one bucket
        cells = self.cells[at[order]]
        free = cells == 0
        fits = nth < free.sum(axis=1)
        cell = (np.cumsum(free, axis=1) == (nth + 1)[:, None]).argmax(axis=1)
        rows = order[fits]
        self.cells[at[rows], cell[fits]] = prints[rows]
        left = np.ones(len(at), bool)
        left[rows] = False
        return left

    def remove(self, h: np.ndarray) -> None:
        """Forget hashes that were added before."""
        prints, at, other = self._places(h)
        for _ in range(2):
            missed = []
            while len(prints):
                match = self.cells[at] == prints[:, None]
                there = match.any(1)
                missed.append((prints[~there], other[~there]))
                prints, at, other, cell = prints[there], at[there], other[there], match[there].argmax(1)
                first = np.unique(at.astype(np.int64) * _SLOTS + cell, return_index=True)[1]  # equal prints take a cell each
                self.cells[at[first], cell[first]] = 0
                again = np.ones(len(at), bool)
                again[first] = False
                prints, at, other = prints[again], at[again], other[again]
            if not missed:
                return
            prints, at = (np.concatenate(x) for x in zip(*missed, strict=True))
            other = at

    @classmethod
    def build(cls, h: np.ndarray) -> CuckooFilter:
        n = 16
        while n * _SLOTS * 0.85 < len(h):
            n *= 2
        while not (out := cls(n)).add(h):
            n *= 2
        return out


def line_key(line: str) -> str:
    return line.strip(SPACE).translate(_LOWER)


def _digest(key: str) -> bytes:
    return hashlib.sha256(key.encode("utf-8")).digest()[:16]


def line_keys(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """The distinct keys of a text's lines."""
    line = F.split(F.coalesce(text, F.lit("")), "\n")
    keys = F.transform(line, lambda x: F.trim(ascii_lower(x), F.lit(SPACE)))
    return F.array_distinct(F.filter(keys, lambda k: F.length(k) >= min_chars))


def _pairs(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """doc, sum (64-bit hash of the text), digest and h of every distinct line key of every row."""
    key = F.explode(line_keys(F.col(text), min_chars)).alias("key")
    out = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("sum"), key)
    out = out.select("doc", "sum", F.substring(F.unhex(F.sha2("key", 256)), 1, 16).alias("digest"))
    return out.withColumn("h", F.xxhash64("digest"))


class LineIndex:
    """Counts and filters at ``path`` in a shared folder; each batch writes a new version, last of all
    its state (shards, threshold and least characters), from which ``open`` goes on."""

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int | None = None, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS):
        self.spark, self.path = spark, path or new_path(spark, "line-index")
        self.shards, self.threshold, self.min_chars, self.version = shards or 16, threshold, min_chars, 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int) -> LineIndex:
        """The index as its ``version`` left it, in this session or another one."""
        r = spark.read.schema("shards int, threshold int, min_chars int").parquet(f"{path}/state-{version}").first()
        out = cls(spark, path, r["shards"], r["threshold"], r["min_chars"])
        out.version = version
        return out

    def counts(self) -> DataFrame:
        return self.spark.read.schema("digest binary, h bigint, n bigint, before bigint").parquet(f"{self.path}/counts-{self.version}").select("digest", "h", "n")

    def filters(self) -> DataFrame:
        return self.spark.read.schema("shard int, filter binary").parquet(f"{self.path}/filters-{self.version}")

    def insert(self, docs: DataFrame, text: str = "text") -> LineIndex:
        return self._fold(docs, text, 1)

    def delete(self, docs: DataFrame, text: str = "text") -> LineIndex:
        """Take a batch out again. Lines that fewer documents hold than are deleted can't have been
        inserted: the index then stays as it was and an error is raised."""
        return self._fold(docs, text, -1)

    def _shard(self) -> Column:
        return F.pmod("h", F.lit(self.shards)).cast("int")

    def _frequent(self, counts: DataFrame) -> DataFrame:
        return counts.where(F.col("n") >= self.threshold)

    def _fold(self, docs: DataFrame, text: str, sign: int) -> LineIndex:
        delta = _pairs(docs, text, self.min_chars).groupBy("digest", "h").agg((F.count("*") * sign).alias("n"))
        old = self.version
        if old:
            delta = delta.withColumn("before", F.lit(0).cast("bigint")).unionByName(self.counts().withColumn("before", F.col("n")))
            delta = delta.groupBy("digest", "h").agg(F.sum("n").alias("n"), F.sum("before").alias("before")).where("n <> 0 or before <> 0")
        else:
            delta = delta.withColumn("before", F.lit(0).cast("bigint"))
        crossed = F.col("n") >= self.threshold, F.col("before") >= self.threshold
        full = f"{self.path}/changes-{old + 1}" if old else f"{self.path}/counts-1"
        delta.write.mode("overwrite").parquet(full)
        changes = self.spark.read.schema("digest binary, h bigint, n bigint, before bigint").parquet(full)
        if sign < 0 and (lost := changes.where("n < 0").first()) is not None:
            raise ValueError(f"a line with SHA-256 {lost['digest'].hex()}... stands in {lost['before']} documents, {lost['before'] - lost['n']} are to be deleted")
        if old:
            changes.where("n > 0").write.mode("overwrite").parquet(f"{self.path}/counts-{old + 1}")
        frequent = self._frequent(changes).count()
        shards = self.shards
        while shards * SHARD_KEYS < frequent:
            shards *= 2
        grown, shard = shards > self.shards, F.pmod("h", F.lit(shards)).cast("int")
        state = self.spark.read.schema("shard int, filter binary").parquet(f"{self.path}/filters-{old}") if old and not grown else self.spark.createDataFrame([], "shard int, filter binary")
        moved = changes.where(crossed[0] != crossed[1]).groupBy(shard.alias("shard")).agg(F.collect_list(F.when(crossed[0], F.col("h"))).alias("add"), F.collect_list(F.when(crossed[1], F.col("h"))).alias("drop"))
        all_ = self._frequent(changes).groupBy(shard.alias("shard")).agg(F.collect_list("h").alias("all"))
        todo = state.join(moved, "shard", "full_outer").join(all_, "shard", "full_outer").withColumn("anew", F.lit(grown))
        todo.select("shard", "filter", "add", "drop", "all", "anew").mapInArrow(_update, "shard int, filter binary").write.mode("overwrite").parquet(f"{self.path}/filters-{old + 1}")
        self.spark.createDataFrame([(shards, self.threshold, self.min_chars)], "shards int, threshold int, min_chars int").write.mode("overwrite").parquet(f"{self.path}/state-{old + 1}")
        self.version, self.shards = old + 1, shards
        return self

    def hits(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """doc, sum, digest: the keys at or over the threshold that each document holds."""
        spark, tasks = self.spark, shuffle_partitions(self.spark)
        load = self.counts().groupBy(self._shard().alias("shard")).agg(F.sum("n").alias("load"))
        total = load.agg(F.coalesce(F.sum("load"), F.lit(0))).first()[0]
        aim = max(1, total // (4 * tasks))
        salts = stored(load.select("shard", F.ceil(F.col("load") / aim).cast("int").alias("salts")), "salts")  # one row a shard
        blank = {"doc": F.lit(0).cast("bigint"), "sum": F.lit(0).cast("bigint"), "h": F.lit(0).cast("bigint")}
        exact = self._frequent(self.counts()).groupBy(self._shard().alias("shard")).agg(F.collect_list("h").alias("hs"), F.collect_list("digest").alias("digests"))
        head = self.filters().join(exact, "shard").join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts").withColumns({"kind": F.lit(0)} | blank)
        pairs = _pairs(docs, text, self.min_chars).drop("digest").withColumn("shard", self._shard()).join(F.broadcast(salts), "shard")
        pairs = pairs.withColumns({"salt": F.pmod(F.monotonically_increasing_id(), F.col("salts")).cast("int"), "kind": F.lit(1)}).drop("salts")
        both = head.unionByName(pairs, allowMissingColumns=True).select("shard", "salt", "kind", "doc", "sum", "h", "filter", "hs", "digests")
        return both.repartition(tasks, "shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(_probe, "doc bigint, sum bigint, digest binary")


def _update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            add, drop, every = (np.array(r[c] or [], np.int64) for c in ("add", "drop", "all"))
            f = CuckooFilter.of(r["filter"])
            if not r["anew"]:
                f.remove(drop)
            room = f.cells.size * 0.85 >= len(every) and not r["anew"]
            out.append((f if room and f.add(add) else CuckooFilter.build(every)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(out, pa.binary())], names=["shard", "filter"])


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (shard, salt); the first of each may carry the shard's filter and keys."""
    at, seen = (None, None), None
    for batch in batches:
        shard, salt, kind, doc, total, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "salt", "kind", "doc", "sum", "h"))
        stops = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0)) + 1
        for a, b in zip([0, *stops.tolist()], [*stops.tolist(), len(h)], strict=True):
            if a == b:
                continue
            if (shard[a], salt[a]) != at:
                at, seen = (shard[a], salt[a]), None
            if kind[a] == 0:
                r = batch.slice(a, 1)
                hs, digests = np.array(r.column("hs")[0].as_py(), np.int64), r.column("digests")[0].as_py()
                order = np.argsort(hs, kind="stable")
                seen = CuckooFilter.of(r.column("filter")[0].as_py()), hs[order], [digests[i] for i in order.tolist()]
                a += 1
            if seen is None or a == b:
                continue
            maybe = a + np.flatnonzero(seen[0].contains(h[a:b]))
            low, high = np.searchsorted(seen[1], h[maybe], "left"), np.searchsorted(seen[1], h[maybe], "right")
            rows = np.repeat(maybe, high - low)
            found = [seen[2][k] for x, y in zip(low.tolist(), high.tolist(), strict=True) for k in range(x, y)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[rows], pa.int64()), pa.array(total[rows], pa.int64()), pa.array(found, pa.binary())], names=["doc", "sum", "digest"])


def drop_lines(docs: DataFrame, index: LineIndex, text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (the other lines joined by line feeds) of each row."""
    hits = index.hits(docs, text).groupBy("doc", "sum").agg(F.collect_set("digest").alias("hits"))
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text).withColumns({"doc": F.coalesce("doc_id", F.lit(_LAST)), "sum": F.xxhash64(F.coalesce(text, F.lit("")))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                n, gone, kept = [], [], []
                for t, hit in zip(part.column(text).to_pylist(), part.column("hits").to_pylist(), strict=True):
                    lines = (t or "").split("\n")
                    stay = lines
                    if hit:
                        hit = set(hit)
                        stay = [x for x in lines if not (k := line_key(x)) or _digest(k) not in hit]
                    n.append(len(lines))
                    gone.append(len(lines) - len(stay))
                    kept.append("\n".join(stay))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    return named.join(hits, ["doc", "sum"], "left").select("doc_id", text, "hits").mapInArrow(run, "doc_id bigint, n_lines bigint, n_dropped bigint, kept string")


def dedup_lines(docs: DataFrame, text: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """Index ``docs`` and drop their own frequent lines."""
    return drop_lines(docs, LineIndex(docs.sparkSession, threshold=threshold, min_chars=min_chars).insert(docs, text), text)
