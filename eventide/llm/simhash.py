"""SimHash near-dedup by pigeonhole blocks.

A fingerprint has 64 bits, each the majority of that bit over the hashes of a text's word
shingles. Two fingerprints within ``distance`` bits agree on at least ``blocks - distance`` of
``blocks`` blocks, so each distinct fingerprint is dealt out once for every choice of that
many blocks, and only fingerprints of one deal are compared. A deal of more than ``GROUP``
fingerprints is cut into chunks and every pair of chunks becomes one bounded list; a list
gives a spanning forest of its links instead of all pairs, which keeps every component whole.

Copies share a fingerprint and are never compared: nodes are fingerprints. Null or blank texts
have fingerprint zero and are linked like any other. Rows with a null doc_id take part; a
component is named by its smallest doc_id, or null if none of its rows has one. Repeated rows
change nothing, and rows that repeat a doc_id are linked each by its own text; ``keep_one``
keeps one row of each component (smallest doc_id, nulls last, then smallest MD5 of the text).
An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_each, slices, stored, text_key
from .graph import components

#: Fingerprints that are compared with each other in one list, at most about twice this.
GROUP = 2048


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The fingerprint as a signed 64-bit integer."""
    ws = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space alone
    if not ws:
        return 0
    flat, hashed = b" ".join(ws), xxhash.xxh64_intdigest
    n = max(1, len(ws) - shingle + 1)
    sizes = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    ends = ends[-n:].tolist()
    h = np.fromiter([hashed(flat[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id, raw (the ``text_key``) and fp of each row; a narrow step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fps = pa.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("raw"), fps], names=["doc_id", "raw", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col(text)).alias("raw"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, raw binary, fp bigint")


def block_count(n: int, distance: int) -> int:
    """Blocks for which a chance meeting in a deal is rare: n fingerprints over the values of
    ``blocks - distance`` blocks give less than one neighbour in 16. Any count is exact; three
    blocks in common at least, so that small and large inputs are dealt alike."""
    return next((b for b in range(distance + 3, 17) if n <= 2.0 ** (64 * (b - distance) / b) / 16), 16)


def masks(blocks: int, distance: int) -> list[int]:
    """For each choice of ``blocks - distance`` blocks, its bits (signed)."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    out = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def forest(fps: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges that connect what is linked within the list, each to a fingerprint already reached.
    ``fps`` are unsigned."""
    left = np.sort(fps)
    us, vs = [], []
    while len(left) > 1:
        queue = [left[0]]
        left = left[1:]
        while queue and len(left):
            f = queue.pop()
            near = np.bitwise_count(left ^ f) <= distance
            if near.any():
                us.append(left[near])
                vs.append(np.full(len(us[-1]), f))
                queue += list(left[near])
                left = left[~near]
    return us, vs


def links(nodes: DataFrame, distance: int, blocks: int) -> DataFrame:
    """Edges (u, v) between fingerprints within ``distance`` bits that connect the same components
    as all such pairs. ``nodes``: fp (distinct)."""
    deal = F.explode(F.array(*[F.struct(F.lit(i).alias("deal"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks(blocks, distance))]))
    dealt = nodes.select("fp", deal.alias("d")).select("fp", "d.deal", "d.part")
    sizes = dealt.groupBy("deal", "part").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / GROUP)
    mine = F.pmod(F.xxhash64("fp", "deal"), chunks)
    lists = (
        dealt.join(sizes.hint("merge"), ["deal", "part"])  # deals are many times what their source's size suggests
        .withColumn("chunks", chunks).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
        .where("chunks = 1 or other <> mine")
        .groupBy("deal", "part", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
        .agg(F.collect_list("fp").alias("fps"))
        .select("fps")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("fps")
            offsets = np.asarray(col.offsets) - col.offsets[0].as_py()
            fps = col.flatten().to_numpy(zero_copy_only=False).view(np.uint64)  # the bits of a negative number are counted after its sign is dropped
            size = np.diff(offsets)
            pairs = offsets[:-1][size == 2]  # most lists are of two
            near = np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= distance
            us, vs = [fps[pairs][near]], [fps[pairs + 1][near]]
            for k in np.flatnonzero(size > 2).tolist():
                u, v = forest(fps[offsets[k] : offsets[k + 1]], distance)
                us += u
                vs += v
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64), pa.int64()) for x in (us, vs)], names=["u", "v"])

    return lists.mapInArrow(run, "u bigint, v bigint")


def _grouped(docs: DataFrame, text: str, shingle: int, distance: int, blocks: int | None) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, raw, fp), and per fp its component's first row (void, doc_id, raw)."""
    printed = stored(fingerprints(docs, text, shingle), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "raw")
    nodes = stored(printed.groupBy("fp").agg(F.min(first).alias("first")), "nodes")
    least = components(links(nodes.select("fp"), distance, blocks or block_count(nodes.count(), distance)))
    named = stored(nodes.join(least, nodes["fp"] == least["u"], "left").select("fp", "first", F.coalesce("v", "fp").alias("group")), "named")
    best = named.groupBy("group").agg(F.min("first").alias("best"))
    return printed, named.join(best, "group").select("fp", "best")


def near_groups(docs: DataFrame, text: str = "text", shingle: int = 4, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that is
    reachable over links of at most ``distance`` differing bits."""
    printed, best = _grouped(docs, text, shingle, distance, blocks)
    return printed.join(best, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", shingle: int = 4, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """One row of each component, with its own columns."""
    printed, best = _grouped(docs, text, shingle, distance, blocks)
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("raw") == F.col("best.raw"))
    return one_each(docs, printed.join(best, "fp").select("doc_id", "raw", stays.alias("stays")), text)
