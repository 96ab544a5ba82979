"""Writers: idempotent appends, upserts as new versions, day-partitioned logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def new_rows(incoming: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Insert if absent: the incoming rows whose key isn't stored, once each."""
    return incoming.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], version: str) -> DataFrame:
    """The table after an upsert: the latest version of each key (incoming wins a tie)."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def append_log(df: DataFrame, path: str, ts: str = "ts") -> None:
    """JSON lines under a folder a day."""
    df.withColumn("day", F.date_format(ts, "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(path)


def export(df: DataFrame, path: str, kind: str = "json") -> None:
    df.write.mode("overwrite").format(kind).save(path)


def backup(tables: dict[str, DataFrame], folder: str, stamp: str) -> str:
    """Each table as Parquet under a new folder, which must not exist; read back and counted
    before its name is returned, so that the caller clears nothing that isn't saved."""
    target = f"{folder.rstrip('/')}/before-fresh-{stamp}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{target}/{name}")
        saved, had = df.sparkSession.read.parquet(f"{target}/{name}").count(), df.count()
        if saved != had:
            raise RuntimeError(f"{name}: {saved} of {had} rows were saved; nothing was cleared")
    return target


def pending(work: DataFrame, done: DataFrame, key: list[str], version: str) -> DataFrame:
    """What is left after an interruption: rows whose key wasn't finished under the same version."""
    return work.join(done.where(F.col("version") == version).select(*key).distinct(), key, "left_anti")


def evaluation_report(summary: DataFrame, path: str) -> None:
    """Results by kind as JSON and as lines of a Markdown table."""
    summary.write.mode("overwrite").json(f"{path}/json")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in summary.columns]), F.lit(" |"))
    head = summary.sparkSession.createDataFrame([(0, "| " + " | ".join(summary.columns) + " |"), (1, "|" + "-|" * len(summary.columns))], "k int, value string")
    head.unionByName(summary.select(F.lit(2).alias("k"), row.alias("value"))).orderBy("k", "value").select("value").write.mode("overwrite").text(f"{path}/md")
