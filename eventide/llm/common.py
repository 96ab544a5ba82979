"""Helpers shared by the corpus operators: shared storage, words, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.settle import let, settled
from ..sources.shared import new_path, shared_dir, stored

__all__ = ["CHUNK_CHARS", "COPIES", "SPACE", "WORD", "ascii_lower", "let", "new_path", "numbered", "one_each", "settled", "row_key", "shared_dir", "shuffle_partitions", "slices", "stored", "table", "text_key", "words"]

#: The white space every contract speaks of: space, tab, line feed, vertical tab, form feed, return.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Texts handed to numpy at once, in characters; bounds what a Python worker holds.
CHUNK_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII, which most lines are, has nothing else to lower."""
    letters = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(letters)


def words(c: Column) -> Column:
    """The maximal runs of other characters than ``SPACE``; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``CHUNK_CHARS`` of text (one row at least)."""
    sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + (n or 0) > CHUNK_CHARS:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < len(sizes):
        yield batch.slice(start)


def text_key(text: Column) -> Column:
    """MD5 of a text (null counts as empty): with the doc_id it names a row where ids repeat or lack."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _mapped(kind: T.DataType) -> bool:
    """Whether a type holds a map somewhere."""
    inner = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else []
    return isinstance(kind, T.MapType) or any(map(_mapped, inner))


def row_key(docs: DataFrame, packed: str = "_own") -> Column:
    """What rows packed as ``packed`` are hashed and compared by: the row itself, in which the JSON of
    a column stands for one that holds maps (a map of a row in the order of its keys)."""
    held = {f.name: f.dataType for f in docs.schema if _mapped(f.dataType)}
    if not held:
        return F.col(packed)
    own = lambda c: F.col(packed).getField(c)
    sort = lambda c, kind: F.sort_array(F.map_entries(c)) if isinstance(kind, T.MapType) and not _mapped(kind.valueType) else c
    return F.struct(*[F.to_json(F.struct(sort(own(c), held[c]).alias("c"))).alias(c) if c in held else own(c).alias(c) for c in docs.columns])


def one_each(docs: DataFrame, verdict: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay by ``verdict`` (doc_id, raw, stays, for every row or for those
    that go or repeat; raw is the ``text_key``). Of rows that agree in doc_id and text one stays,
    whatever their other columns hold. Rows that go are named by id and text, never by id alone."""
    marks = stored(verdict.groupBy("doc_id", "raw").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1").select(F.col("doc_id").alias("_id"), F.col("raw").alias("_mark"), "stays"), "marks")
    named = docs.select(F.struct(*docs.columns).alias("_own"), F.col("doc_id").cast("bigint").alias("_doc"), text_key(F.col(text)).alias("_raw"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_raw") == F.col("_mark"))
    # Marks grow with the documents, so they are never broadcast, and small inputs show it.
    single = named.join(marks.hint("merge"), same, "left_anti").select("_own.*")
    repeated = marks.where("stays")
    if repeated.isEmpty():
        return single
    # Combined in the tasks that read them: a row that repeats without end sends one a task.
    first = named.join(repeated.hint("merge"), same, "left_semi").groupBy("_doc", "_raw").agg(F.min_by("_own", F.xxhash64(row_key(docs))).alias("_own"))
    return single.unionByName(first.select("_own.*"))


#: Copies of one row that one task makes at once.
COPIES = 10_000


def numbered(docs: DataFrame) -> DataFrame:
    """The rows as ``_own`` with ``_k``, a number that tells equal rows apart (0, 1, ...; 0 for most).

    Rows whose hash repeats are counted, which combines them in the tasks that read them, and
    made again from their count in pieces: a row that makes up a third of the table is dealt like
    any other rows. ``_hash`` is that of the row."""
    zero = F.lit(0).cast("bigint")
    rows = docs.select(F.struct(*docs.columns).alias("_own")).withColumn("_hash", F.xxhash64(row_key(docs)))
    repeated = stored(rows.groupBy("_hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("_hash").alias("_again")), "repeated")
    if repeated.isEmpty():
        return rows.select("_own", zero.alias("_k"), "_hash")
    again = F.col("_hash") == F.col("_again")
    single = rows.join(repeated, again, "left_anti").select("_own", zero.alias("_k"), "_hash")
    counted = rows.join(repeated, again, "left_semi").groupBy(row_key(docs).alias("_key"), "_hash").agg(F.first("_own").alias("_own"), F.count("*").alias("_n"))
    pieces = counted.withColumn("_at", F.explode(F.sequence(zero, F.col("_n") - 1, F.lit(COPIES).cast("bigint"))))
    dealt = pieces.repartition(shuffle_partitions(docs.sparkSession), "_hash", "_at")
    last = F.least(F.col("_at") + (COPIES - 1), F.col("_n") - 1)
    return single.unionByName(dealt.select("_own", F.explode(F.sequence("_at", last)).alias("_k"), "_hash"))
