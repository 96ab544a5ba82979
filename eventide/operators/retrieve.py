"""Retrieval: BM25 over an inverted index, dense top-k, and rank fusion."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Bm25Config
from ..functions import text as X
from ..sources.shared import stored

#: Distinct query terms that are sent to the documents at once.
BROADCAST_TERMS = 100_000
#: Queries that are sent to the documents at once.
BLOCK_QUERIES = 10_000
#: Scores that a task works out at once, and best rows that it keeps before it hands them on.
_CELLS, _KEPT = 2_000_000, 500_000


def postings(docs: DataFrame, id_col: str, text: str, by: list[str] | None = None) -> DataFrame:
    """by, id, term, tf, len: one row a term of a document."""
    t = docs.select(*(by or []), F.col(id_col).alias("id"), X.lexical_tokens(F.col(text)).alias("w")).withColumn("len", F.size("w"))
    return t.select(*(by or []), "id", "len", F.explode("w").alias("term")).groupBy(*(by or []), "id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def bm25(queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str, query_text: str, doc_text: str, by: list[str] | None = None, cfg: Bm25Config = Bm25Config()) -> DataFrame:  # noqa: B008
    """Scores of all documents that share a term with a query: by, query_id, doc_id, score.

    Candidates meet on terms, never by a cross join. Document counts, lengths and document
    frequencies are taken over the corpus of each value of ``by``. Terms that no query has are
    dropped before anything is counted per term."""
    by = by or []
    terms = queries.select(*by, F.col(query_id).alias("q"), F.explode(F.array_distinct(X.lexical_tokens(F.col(query_text)))).alias("term"))
    tokens = docs.select(*by, F.col(doc_id).alias("id"), X.lexical_tokens(F.col(doc_text)).alias("w")).select("*", F.size("w").alias("len"))
    size = tokens.groupBy(*by).agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    wanted = terms.select(*by, "term").distinct()
    few = wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    post = tokens.select(*by, "id", "len", F.explode("w").alias("term")).join(F.broadcast(wanted) if few else wanted, [*by, "term"], "left_semi")
    post = post.groupBy(*by, "id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    df = post.groupBy(*by, "term").agg(F.count("*").alias("df"))
    joined = post.join(df, [*by, "term"]).join(terms, [*by, "term"])
    joined = joined.join(size, by) if by else joined.join(F.broadcast(size))  # one row
    average = F.when(F.col("avg") > 0, F.col("avg")).otherwise(1.0)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (cfg.k1 + 1) / (F.col("tf") + cfg.k1 * (1 - cfg.b + cfg.b * F.col("len") / average))
    return joined.groupBy(*by, F.col("q").alias(query_id), F.col("id").alias(doc_id)).agg(F.sum(part).alias("score"))


class _Best:
    """The k best (score, id) of every query, and of every group if there are groups: higher scores
    first, then smaller ids. Scores that agree in nine digits tie."""

    def __init__(self, k: int):
        self.k, self.rows, self.least = k, {}, {}

    def add(self, scores: np.ndarray, ids: list, groups: list | None, floor: float) -> None:
        """``scores``: documents x queries; those not over ``floor`` don't count."""
        scores = np.round(scores, 9)
        parts: dict = {}
        for i, g in enumerate(groups if groups is not None else ()):
            parts.setdefault(g, []).append(i)
        for g, at in parts.items() if groups is not None else [(None, None)]:
            part, names = (scores, ids) if at is None else (scores[at], [ids[i] for i in at])
            least = self.least.setdefault(g, np.full(scores.shape[1], floor))
            good = (part >= least) & (part > floor)
            for q in np.flatnonzero(good.any(axis=0)).tolist():
                rows = self.rows.setdefault((q, g), [])
                hit = np.flatnonzero(good[:, q]).tolist()
                rows += zip((-part[hit, q]).tolist(), (names[i] for i in hit), strict=True)
                rows.sort()
                del rows[self.k :]
                if len(rows) == self.k:
                    least[q] = -rows[-1][0]

    def rows_held(self) -> int:
        return len(self.rows) * self.k

    def batch(self, id_type: pa.DataType, group_type: pa.DataType) -> pa.RecordBatch:
        flat = [(q, g, i, -s) for (q, g), rows in self.rows.items() for s, i in rows]
        self.rows, self.least = {}, {}
        cols = list(zip(*flat, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], group_type), pa.array(cols[2], id_type), pa.array(cols[3], pa.float64())], names=["_q", "_g", "_id", "score"])


def _named(best: DataFrame, ids: list, queries: DataFrame, query_id: str, doc_id: str, per: str | None) -> DataFrame:
    """The best rows of the tasks with the queries' own ids (of a block) instead of their numbers."""
    kind = queries.schema[query_id].dataType.simpleString()
    names = best.sparkSession.createDataFrame(list(enumerate(ids)), f"_q int, _name {kind}")
    return best.join(F.broadcast(names), "_q").select(F.col("_name").alias(query_id), F.col("_id").alias(doc_id), *([F.col("_g").alias(per)] if per else []), "score")


def _block(queries: DataFrame, *cols: Column) -> list | None:
    """The rows of a stated query set if it is one block, else null."""
    rows = queries.select(*cols).limit(BLOCK_QUERIES + 1).collect()
    return rows if len(rows) <= BLOCK_QUERIES else None


def bm25_top_k(queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str, query_text: str, doc_text: str, k: int, per: str | None = None, only: DataFrame | None = None, cfg: Bm25Config = Bm25Config()) -> DataFrame:  # noqa: B008
    """The k best documents of every query by BM25: query_id, doc_id, score, rank (and ``per``: the k
    best of each of its values). Scores tie in nine digits; then the smaller doc_id is first.
    ``only``: pairs (query_id, doc_id) that may be found; counts are still over all documents.

    Queries travel to the documents, which are read once: what each holds of the queries' terms is
    written beside it, and counts and scores are taken from that. A task sums the scores of some
    documents for all queries at once and keeps the best, so that no posting is shuffled and a
    frequent term is no hot key. A query set of more than ``BLOCK_QUERIES`` queries
    or ``BROADCAST_TERMS`` terms is cut into blocks that follow each other: the documents' tokens
    are then written once, and each block's results when it is done, so one block is held at a time."""
    asked = queries.select(F.col(query_id).alias("_id"), F.array_distinct(X.lexical_tokens(F.col(query_text))).alias("w"))
    tokens = lambda: docs.select(F.col(doc_id).alias("_id"), (F.col(per) if per else F.lit(None).cast("string")).alias("_g"), X.lexical_tokens(F.col(doc_text)).alias("w"))
    find = lambda rows, read: _bm25_block(rows, read, queries, docs, query_id, doc_id, k, per, only, cfg)
    rows = _fitting(asked)
    if rows is not None:
        return find(rows, tokens())
    asked, read = stored(asked, "queries"), stored(tokens(), "tokens")
    return reduce(DataFrame.unionByName, [stored(find(rows, read), "bm25") for rows in _query_blocks(asked)])


def _fitting(asked: DataFrame) -> list | None:
    """The queries (id, terms) if they are one block, else null."""
    rows = _block(asked, F.col("_id"), F.col("w"))
    return rows if rows is not None and (len(rows) <= 1 or len({t for _, w in rows for t in w}) <= BROADCAST_TERMS) else None


def _query_blocks(asked: DataFrame, depth: int = 0) -> Iterator[list]:
    """The queries in blocks that fit, halved by a hash of their ids as often as needed. A single
    query is a block, however many terms it has."""
    for half in (0, 1):
        part = asked.where(F.pmod(F.xxhash64(F.lit(depth), "_id"), F.lit(2)) == half)
        rows = _fitting(part)
        if rows is None and depth == 40:
            raise ValueError("more queries than a block holds have one id")
        if rows is None:
            yield from _query_blocks(part, depth + 1)
        elif rows:
            yield rows


def _bm25_block(rows: list, read: DataFrame, queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str, k: int, per: str | None, only: DataFrame | None, cfg: Bm25Config) -> DataFrame:
    """``bm25_top_k`` for one block of queries (id, terms). ``read``: _id, _g and w of the documents."""
    order = [query_id, per] if per else [query_id]
    terms = sorted({t for _, w in rows for t in w})
    spark, number = docs.sparkSession, {t: i for i, t in enumerate(terms)}
    owners = [(number[t], q) for q, (_, w) in enumerate(rows) for t in w]
    owners.sort()
    who = np.array([q for _, q in owners], np.int64)
    begin = np.searchsorted([t for t, _ in owners], np.arange(len(terms) + 1))
    wanted = pa.array(terms, pa.string())

    def counted(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, term and count of each posting of a wanted term, and the documents' lengths."""
        tokens = pa.ListArray.from_arrays(pa.array(np.asarray(tokens.offsets) - tokens.offsets[0].as_py(), pa.int32()), tokens.flatten())
        size = np.diff(np.asarray(tokens.offsets))
        term = pc.fill_null(pc.index_in(tokens.flatten(), value_set=wanted), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(size)), size)[term >= 0]
        pair, tf = np.unique(doc * max(1, len(terms)) + term[term >= 0], return_counts=True)
        return pair // max(1, len(terms)), pair % max(1, len(terms)), tf, size

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, term, tf, size = counted(batch.column("w"))
            offsets = pa.array(np.searchsorted(doc, np.arange(len(size) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_g"), pa.array(size, pa.int32()), *lists], names=["_id", "_g", "size", "terms", "tfs"])

    def posted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lists = batch.column("terms")
        doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        return doc, lists.flatten().to_numpy(zero_copy_only=False), batch.column("tfs").flatten().to_numpy(zero_copy_only=False), batch.column("size").to_numpy(zero_copy_only=False)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            _, term, _, size = posted(batch)
            df += np.bincount(term, minlength=len(terms))
            n, total = n + len(size), total + int(size.sum())
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([hit, [-1, -2]]), pa.int64()), pa.array(np.concatenate([df[hit], [n, total]]), pa.int64())], names=["term", "n"])

    kinds_ = f"_id {docs.schema[doc_id].dataType.simpleString()}, _g {docs.schema[per].dataType.simpleString() if per else 'string'}"
    read = stored(read.mapInArrow(post, f"{kinds_}, size int, terms array<int>, tfs array<int>"), "postings")
    seen = {r["term"]: r["n"] for r in read.mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, total = seen.get(-1, 0), seen.get(-2, 0)
    average = total / n if total else 1.0
    df = np.array([seen.get(t, 0) for t in range(len(terms))], float)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    groups = docs.schema[per].dataType.simpleString() if per else "string"
    id_kind = docs.schema[doc_id].dataType.simpleString()
    if only is not None:
        ids = spark.createDataFrame([(r[0], q) for q, r in enumerate(rows)], f"_name {queries.schema[query_id].dataType.simpleString()}, _q int")
        allowed = only.select(F.col(query_id).alias("_name"), F.col(doc_id).alias("_id")).join(F.broadcast(ids), "_name").groupBy("_id").agg(F.collect_set("_q").alias("_only"))  # as many as queries at most
        read = read.join(allowed, "_id")

    masked, grouped = only is not None, per is not None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, step = _Best(k), max(1, _CELLS // max(1, len(rows)))
        kinds = None
        for whole in batches:
            kinds = whole.schema.field("_id").type, whole.schema.field("_g").type
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                doc, term, tf, size = posted(batch)
                part = idf[term] * tf * (cfg.k1 + 1) / (tf + cfg.k1 * (1 - cfg.b + cfg.b * size[doc] / average))
                many = begin[term + 1] - begin[term]  # queries of each posting's term
                to = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[term], many)
                cells = np.bincount(np.repeat(doc, many) * len(rows) + who[to], np.repeat(part, many), batch.num_rows * len(rows)).reshape(batch.num_rows, len(rows))
                if masked:
                    for i, qs in enumerate(batch.column("_only").to_pylist()):
                        keep = cells[i, qs]
                        cells[i] = 0
                        cells[i, qs] = keep
                best.add(cells, batch.column("_id").to_pylist(), batch.column("_g").to_pylist() if grouped else None, 0.0)
                if best.rows_held() > _KEPT and grouped:
                    yield best.batch(*kinds)
        if kinds:
            yield best.batch(*kinds)

    found = read.mapInArrow(score, f"_q int, _g {groups}, _id {id_kind}, score double")
    return top_k(_named(found, [r[0] for r in rows], queries, query_id, doc_id, per), order, k, F.desc(F.round("score", 9)), F.asc(doc_id))


def top_k(scored: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """Rows ranked from 1 within ``by``; Spark limits each task's groups before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def dense_top_k(queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str, vector: str, k: int) -> DataFrame:
    """query_id, doc_id, score, rank by the dot product of unit vectors, against every row.

    A block of queries travels to the documents, which are read once a block; a task multiplies
    matrices and keeps the k best of each query. Blocks after the first are found by a hash of the
    id; their results are written one after the other, so only one block is held at once."""
    blocks = -(-queries.count() // BLOCK_QUERIES) or 1
    one = lambda part: _dense_block(part.select(query_id, vector).collect(), queries, docs, query_id, doc_id, vector, k)
    if blocks == 1:
        return one(queries)
    blocks *= 2  # of half the size on average, so that chance doesn't overfill one
    mine = F.pmod(F.xxhash64(query_id), F.lit(blocks))
    return reduce(DataFrame.unionByName, [stored(one(queries.where(mine == b)), "dense") for b in range(blocks)])


def _dense_block(rows: list, queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str, vector: str, k: int) -> DataFrame:
    wanted = np.array([r[1] for r in rows], float).T if rows else np.zeros((0, 0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, step, kind = _Best(k), max(1, _CELLS // max(1, len(rows))), None
        for whole in batches:
            kind = whole.schema.field("_id").type
            for at in range(0, whole.num_rows if rows else 0, step):
                batch = whole.slice(at, step)
                ids = batch.column("_id").to_pylist()
                vectors = batch.column("_v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
                best.add(np.clip(vectors @ wanted, -1.0, 1.0), ids, None, -2.0)
        if kind is not None:
            yield best.batch(kind, pa.string())

    read = docs.where(F.col(vector).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(vector).alias("_v"))
    found = read.mapInArrow(score, f"_q int, _g string, _id {docs.schema[doc_id].dataType.simpleString()}, score double")
    return top_k(_named(found, [r[0] for r in rows], queries, query_id, doc_id, None), [query_id], k, F.desc("score"), F.asc(doc_id))


def reciprocal_ranks(*ranked: DataFrame, by: list[str], k: int = 60) -> DataFrame:
    """Fuse ranked lists: by, score = sum of 1 / (k + rank)."""
    out = ranked[0].select(*by, "rank")
    for r in ranked[1:]:
        out = out.unionByName(r.select(*by, "rank"))
    return out.groupBy(*by).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def hybrid(sparse: DataFrame, dense: DataFrame, hard: DataFrame, query_id: str, doc_id: str, limit: int) -> DataFrame:
    """query_id, doc_id, place: exact identities first, then the fused order. Sparse hits need a
    score over 0; identities may exceed the limit."""
    by = [query_id, doc_id]
    s = top_k(sparse.where("score > 0"), [query_id], limit, F.desc("score"), F.asc(doc_id))
    d = top_k(dense.drop("rank"), [query_id], limit, F.desc("score"), F.asc(doc_id))
    fused = top_k(reciprocal_ranks(s, d, by=by), [query_id], limit, F.desc("score"), F.asc(doc_id))
    both = fused.select(*by, "score", F.lit(1).alias("tier")).unionByName(hard.select(*by).distinct().select(*by, F.lit(0.0).alias("score"), F.lit(0).alias("tier")))
    one = both.groupBy(*by).agg(F.min("tier").alias("tier"), F.max("score").alias("score"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy(query_id).orderBy("tier", F.desc("score"), doc_id)))


def capped(ranked: DataFrame, per: str, cap: int, limit: int, query_id: str, *order: Column) -> DataFrame:
    """At most ``cap`` rows of each ``per`` and ``limit`` in all, for each query."""
    first = top_k(ranked.drop("rank"), [query_id, per], cap, *order).drop("rank")
    return top_k(first, [query_id], limit, *order)


def select_candidates(pool: DataFrame, ranked: DataFrame, query_id: str, doc_id: str, limit: int = 20) -> DataFrame:
    """query_id, doc_id, method: a query's whole pool if it fits the limit, else what retrieval
    ranked within the limit (rank from 1). Pools are counted before they meet their sizes."""
    size = pool.groupBy(query_id).agg(F.count_distinct(doc_id).alias("_n"))
    best = ranked.where(F.col("rank") <= limit).select(query_id, doc_id, F.lit(True).alias("_hit"))
    j = pool.select(query_id, doc_id).distinct().join(size, query_id).join(best, [query_id, doc_id], "left")
    method = F.when(F.col("_n") <= limit, "all_within_limit").otherwise("retrieved")
    return j.where((F.col("_n") <= limit) | F.col("_hit")).select(query_id, doc_id, method.alias("method"))
