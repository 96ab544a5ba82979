"""Saved search responses as a data source: a folder of JSON files, in batches or as a stream.

``spark.read.format("saved_responses")`` and ``readStream`` give one row a file: file, query,
fetched_at, candidate_title, candidate_url, candidate_rank, payload (the response's own JSON) and
error. A file that can't be read or isn't an object is a row with an error, never a failure of the
round. Files are dealt to partitions ``batch`` at a time. A stream's offset is the time and name
of the last file it has seen, so files must be put there whole and not changed afterwards. The path
may be of any store that pyarrow opens (a folder, hdfs, s3); executors read the files themselves.

``search_targets`` says what to search for, ``search_items`` what a response held; both are
DataFrame functions and read a batch and a stream alike.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import identity as I
from ..functions import text as X

RESPONSE = "file string, query string, fetched_at string, candidate_title string, candidate_url string, candidate_rank bigint, payload string, error string"
_TEXTS = ("query", "fetched_at", "candidate_title", "candidate_url")


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(path: str) -> list[tuple[int, str]]:
    """(time, name) of the JSON files of a folder, in order."""
    from pyarrow import fs

    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((f.mtime_ns or 0, f.base_name) for f in found if f.is_file and f.base_name.endswith(".json"))


def _rows(path: str, files: list[str]) -> Iterator[tuple]:
    store, root = _store(path)
    for name in files:
        try:
            with store.open_input_stream(f"{root}/{name}") as f:
                r = json.loads(f.read().decode("utf-8"))
            if not isinstance(r, dict):
                raise ValueError("not an object")
            rank = r.get("candidate_rank")
            texts = [r[k] if isinstance(r.get(k), str) else None for k in _TEXTS]
            yield (name, *texts, rank if isinstance(rank, int) else None, json.dumps(r.get("result"), ensure_ascii=False), None)
        except (OSError, ValueError) as e:
            yield (name, *[None] * 6, f"{type(e).__name__}: {e}"[:200])


class _Reader(DataSourceReader):
    def __init__(self, path: str, batch: int):
        self.path, self.batch = path, batch

    def partitions(self) -> list[InputPartition]:
        names = [n for _, n in _listed(self.path)]
        return [_Files(names[k : k + self.batch]) for k in range(0, len(names), self.batch)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        return _rows(self.path, partition.files)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, batch: int):
        self.path, self.batch = path, batch

    def initialOffset(self) -> dict:
        return {"time": -1, "file": ""}

    def latestOffset(self) -> dict:
        time, name = max(_listed(self.path), default=(-1, ""))
        return {"time": time, "file": name}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = ((o["time"], o["file"]) for o in (start, end))
        names = [n for t, n in _listed(self.path) if low < (t, n) <= high]
        return [_Files(names[k : k + self.batch]) for k in range(0, len(names), self.batch)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        return _rows(self.path, partition.files)


class SavedResponses(DataSource):
    """Options: path, and batch (files a partition, 100)."""

    @classmethod
    def name(cls) -> str:
        return "saved_responses"

    def schema(self) -> str:
        return RESPONSE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("batch", 100)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], int(self.options.get("batch", 100)))


def responses(spark: SparkSession, path: str, stream: bool = False, batch: int = 100) -> DataFrame:
    """The saved responses of a folder, as a batch or as a stream."""
    spark.dataSource.register(SavedResponses)
    return (spark.readStream if stream else spark.read).format("saved_responses").option("path", path).option("batch", batch).load()


_ITEM = "struct<Title:string,Url:string,ContentID:string,ContentType:string,ContentText:string,AuthorName:string,CommentCount:bigint,VoteUpCount:bigint,EditTime:bigint,RankingScore:double>"


def search_items(found: DataFrame) -> DataFrame:
    """The items of responses, in their order: query, candidate, search_rank (from 1), identity (the
    content's id, else its link), title, url, author, summary, counts and flags of what is missing."""
    items = F.from_json("payload", f"struct<Items:array<{_ITEM}>>")["Items"]
    e = found.where("error is null").select("file", "query", "fetched_at", "candidate_title", "candidate_url", "candidate_rank", F.posexplode(items).alias("pos", "e"))
    wanted = {"title": "Title", "url": "Url", "comment_count": "CommentCount", "vote_up_count": "VoteUpCount", "edit_time": "EditTime", "ranking_score": "RankingScore"}
    empty = lambda c: c.isNull() | (c.cast("string") == "")
    flags = F.array_compact(F.array(*[F.when(empty(F.col(f"e.{f}")), F.lit(f"missing_{n}")) for n, f in wanted.items()]))
    identity = F.coalesce(F.nullif("e.ContentID", F.lit("")), I.url_key(F.col("e.Url")), F.col("query"))
    return e.select(
        "file", "query", "fetched_at", "candidate_title", "candidate_url", "candidate_rank", (F.col("pos") + 1).alias("search_rank"), identity.alias("identity"), F.sha2(identity, 256).alias("content_hash"),
        X.clean_title(F.col("e.Title")).alias("title"), F.col("e.Url").alias("url"), F.col("e.AuthorName").alias("author"), X.clean_body(F.col("e.ContentText")).alias("summary"),
        F.col("e.CommentCount").alias("comments"), F.col("e.VoteUpCount").alias("votes"), F.col("e.RankingScore").alias("ranking_score"), flags.alias("flags"),
    )


def distinct_hits(items: DataFrame, stream_delay: str | None = None) -> DataFrame:
    """One row a (query, url). In a batch it is the first by the candidate's rank, place and file; a
    stream keeps what comes first, and forgets pairs ``stream_delay`` after their ``fetched_at``."""
    key: list[str] = ["query", "url"]
    if items.isStreaming:
        if stream_delay is None:
            return items.dropDuplicates(key)
        timed = items.withColumn("at", F.col("fetched_at").try_cast("timestamp")).withWatermark("at", stream_delay)
        return timed.dropDuplicatesWithinWatermark(key).drop("at")
    order: Column = F.struct(F.coalesce("candidate_rank", F.lit(0)).alias("r"), "search_rank", "file")
    own = [c for c in items.columns if c not in key]
    return items.groupBy(*key).agg(F.min_by(F.struct(*own), order).alias("x")).select(*key, "x.*").select(*items.columns)


def search_targets(candidates: DataFrame, queries: list[str], most: int = 5) -> DataFrame:
    """What to search for, at most ``most`` targets: stated queries first, then candidates (query,
    candidate_title, candidate_url, candidate_rank) by rank, once a (query, url); blank queries are none."""
    spark = candidates.sparkSession
    cols = "query string, candidate_title string, candidate_url string, candidate_rank bigint"
    own = spark.createDataFrame([(q, q, None, 0) for q in queries], cols).withColumn("_o", F.monotonically_increasing_id() - (1 << 40))
    theirs = candidates.select(F.trim("query").alias("query"), F.coalesce("candidate_title", "query").alias("candidate_title"), "candidate_url", F.coalesce("candidate_rank", F.lit(0)).cast("bigint").alias("candidate_rank")).withColumn("_o", F.col("candidate_rank"))
    both = own.unionByName(theirs).where("query <> ''")
    one = both.groupBy("query", "candidate_url").agg(F.min_by(F.struct("candidate_title", "candidate_rank", "_o"), F.struct("_o", "candidate_title")).alias("x"))
    return one.select("query", "x.candidate_title", "candidate_url", "x.candidate_rank", "x._o").orderBy("_o", "query", "candidate_url").limit(most).drop("_o")
