"""Tables in versions: parts of a table are files of their own, and a manifest says which count.

A write puts new files beside the old ones and then, as its last step, one manifest file: the
parts of the table and the version that wrote each. Readers follow one manifest, so a write that
fails leaves the table as it was, and a reader goes on with the version it began with, whatever is
written or pruned meanwhile. Old files go only by ``vacuum``, which keeps those that the last
``keep`` manifests name. One writer at a time is taken for granted.

``Upserts``: one row a key; parts are buckets of a hash of the key, and an upsert rewrites the
buckets that it touches. ``DayLog``: appended rows; parts are days. ``ScoreCache``: upserts named by
what was scored and how, so that only new pairs are scored again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored

_MANIFEST = "part string, written bigint, at timestamp, version bigint"


class Versions:
    """The manifests of a table at ``path``, and its files under ``data/v<version>/part=<part>``."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T._parse_datatype_string(schema)

    def manifests(self) -> DataFrame:
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _MANIFEST)

    def version(self) -> int:
        """The latest version; 0 before the first write."""
        return self.manifests().agg(F.max("version")).first()[0] or 0

    def parts(self, version: int | None = None) -> dict[str, list[int]]:
        """Each part's files, by the versions that wrote them. Parts are few: buckets, or days. A
        version without parts names the part null."""
        rows = self.manifests().where(F.col("version") == (self.version() if version is None else version)).collect()
        if version and not rows:
            raise ValueError(f"{self.path} has no version {version}")
        out: dict[str, list[int]] = {}
        for r in rows:
            if r["part"] is not None:
                out.setdefault(r["part"], []).append(r["written"])
        return out

    def read(self, version: int | None = None, only: set[str] | None = None) -> DataFrame:
        """The rows of a version (the latest), of all parts or of some."""
        at = [f"{self.path}/data/v{v}/part={p}" for p, written in self.parts(version).items() if only is None or p in only for v in written]
        return self.spark.read.schema(self.schema).parquet(*at) if at else self.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame, part: Column, version: int) -> set[str]:
        """Files of a version, part by part; returns the parts that have rows."""
        out = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema], part.cast("string").alias("part"))
        folder = f"{self.path}/data/v{version}"
        out.repartition("part").write.mode("overwrite").partitionBy("part").parquet(folder)
        return {r["part"] for r in self.spark.read.schema(out.schema).parquet(folder).select("part").distinct().collect()}

    def _commit(self, parts: dict[str, list[int]], version: int) -> int:
        """The version counts from here on. One small file, so it is there whole or not at all."""
        rows = [(p, w) for p, written in parts.items() for w in written] or [(None, None)]
        named = self.spark.createDataFrame(rows, "part string, written bigint").withColumn("at", F.current_timestamp())
        named.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        return version

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove files that none of the last ``keep`` manifests names, and older manifests. A reader of
        an older version fails from then on. Returns the folders that went."""
        if keep < 1:
            raise ValueError("the latest version always stays")
        last = self.version()
        live = {(w, p) for v in range(max(1, last - keep + 1), last + 1) for p, written in self.parts(v).items() for w in written}
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(f"{self.path}/data")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = []
        for folder in fs.listStatus(root):
            v = int(folder.getPath().getName()[1:])
            for f in fs.listStatus(folder.getPath()):
                name = f.getPath().getName()
                if name.startswith("part=") and (v, name[5:]) not in live:
                    fs.delete(f.getPath(), True)
                    gone.append(f"v{v}/{name}")
        for v in range(1, max(1, last - keep + 1)):
            fs.delete(hadoop.Path(f"{self.path}/manifest/version={v}"), True)
        return sorted(gone)


class Upserts(Versions):
    """One row a key: the one of the highest ``order``, of equal ones the one that came last."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], order: str, buckets: int = 64):
        super().__init__(spark, path, schema)
        self.key, self.order, self.buckets = key, order, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("string")

    def upsert(self, incoming: DataFrame) -> int:
        """Merge rows into the buckets they touch. A replay changes nothing and makes no version."""
        names = [f.name for f in self.schema]
        new = stored(incoming.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]), "incoming")
        touched = {r["b"] for r in new.select(self.bucket().alias("b")).distinct().collect()}  # buckets at most
        last = self.version()
        parts = self.parts(last) if last else {}
        old = self.read(last, touched) if last else new.limit(0)
        both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        w = Window.partitionBy(*self.key).orderBy(F.desc_nulls_last(self.order), F.desc("_new"), F.xxhash64(*names))
        merged = stored(both.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*names), "merged")
        # exceptAll would do, but a bucket differs only if a row does: each key has one row on either side.
        moved = merged.unionByName(old).groupBy(*names).agg(F.count("*").alias("_n")).where("_n < 2").select(self.bucket().alias("b")).distinct()
        changed = {r["b"] for r in moved.collect()}  # buckets at most
        if not changed:
            return last
        wrote = self._write(merged.where(self.bucket().isin(*changed)), self.bucket(), last + 1)
        return self._commit({p: w for p, w in parts.items() if p not in changed} | {p: [last + 1] for p in wrote}, last + 1)


class DayLog(Versions):
    """Rows that are appended, by the day of ``ts``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, ts: str = "ts"):
        super().__init__(spark, path, schema)
        self.ts = ts

    def append(self, rows: DataFrame) -> int:
        last = self.version()
        parts = self.parts(last) if last else {}
        for p in self._write(rows, F.coalesce(F.date_format(self.ts, "yyyy-MM-dd"), F.lit("unknown")), last + 1):
            parts.setdefault(p, []).append(last + 1)
        return self._commit(parts, last + 1)

    def prune(self, before: str) -> list[str]:
        """A version without the days before ``before`` (yyyy-MM-dd); readers of older versions keep them
        until ``vacuum``. Rows without a time stay. Returns the days that went."""
        last = self.version()
        parts = self.parts(last) if last else {}
        gone = sorted(p for p in parts if p != "unknown" and p < before)
        if gone:
            self._commit({p: w for p, w in parts.items() if p not in gone}, last + 1)
        return gone


class ScoreCache:
    """Scores of pairs of texts, kept by what was scored: the SHA-256 of both texts, in order, and the
    policy (model, version, prompt). A changed text or policy is a new entry."""

    def __init__(self, spark: SparkSession, path: str, policy: str, buckets: int = 64):
        self.policy = policy
        self.table = Upserts(spark, path, "name string, policy string, score double", ["name"], "score", buckets)

    def named(self, pairs: DataFrame, a: str, b: str) -> DataFrame:
        text = lambda c: F.sha2(F.coalesce(F.col(c), F.lit("")).cast("binary"), 256)
        return pairs.withColumn("_name", F.sha2(F.concat_ws(":", F.lit(self.policy), text(a), text(b)).cast("binary"), 256))

    def scored(self, pairs: DataFrame, a: str, b: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The pairs with ``score``. ``score`` gets the distinct texts (_name, a, b) that have none yet and
        returns _name and score; what it can't score it leaves out, and is asked again the next time."""
        named = stored(self.named(pairs, a, b), "named")
        mine = F.pmod(F.xxhash64("_name"), F.lit(self.table.buckets)).cast("string")
        touched = {r["b"] for r in named.select(mine.alias("b")).distinct().collect()}  # buckets at most
        known = self.table.read(only=touched).select(F.col("name").alias("_name"), "score")
        missing = named.join(known, "_name", "left_anti").groupBy("_name").agg(F.first(a).alias(a), F.first(b).alias(b))
        if not missing.isEmpty():
            new = stored(score(missing).select("_name", F.col("score").cast("double").alias("score")).where("score is not null"), "scores")
            self.table.upsert(new.select(F.col("_name").alias("name"), F.lit(self.policy).alias("policy"), "score"))
            known = self.table.read(only=touched).select(F.col("name").alias("_name"), "score")
        return named.join(known, "_name", "left").drop("_name")
