"""The scan for duplicate events: every pair over a threshold is judged once, slice by slice.

The pairs are found exactly (``similarity``), written in the order (a, b), and read from a cursor
that is kept on disk. A slice's verdicts are written before the cursor moves, so a scan that stops
anywhere goes on where it was, and judges nothing twice: pairs that already have a verdict under
the scan's policy are passed over, also after a restart from the beginning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.ranking import ranked
from ..operators.similarity import similarity_join

_STATE = "cursor bigint, slice int, pairs bigint, policy string"
_PAIRS = "a string, b string, similarity double, place bigint"
VERDICT = "a string, b string, verdict string"


class DuplicateScan:
    """A scan at ``path`` in a shared folder: ``pairs``, ``state-k`` and ``verdicts/policy=p/slice=k``."""

    def __init__(self, spark: SparkSession, path: str, policy: str):
        self.spark, self.path, self.policy = spark, path.rstrip("/"), policy
        self.cursor = self.slice = self.pairs = 0

    @classmethod
    def start(cls, events: DataFrame, path: str, policy: str, threshold: float, id_col: str = "event_id", text: str = "text") -> DuplicateScan:
        """Find the pairs of events and write them. Events of equal tokens pair with the first of them."""
        out = cls(events.sparkSession, path, policy)
        members, pairs = similarity_join(events.select(F.col(id_col).cast("string").alias("id"), text), "id", X.lexical_tokens(F.col(text)), threshold)
        copies = members.where("class <> id").select(F.col("class").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
        ranked(pairs.select("a", "b", "similarity").unionByName(copies), [], [F.asc("a"), F.asc("b")]).write.parquet(f"{out.path}/pairs")
        out.pairs = out._table("pairs", _PAIRS).count()
        return out._move(0, 0)

    @classmethod
    def open(cls, spark: SparkSession, path: str, policy: str, slice_: int) -> DuplicateScan:
        """The scan after ``slice_`` slices. Under another policy its verdicts don't count: an error."""
        out = cls(spark, path, policy)
        r = out._table(f"state-{slice_}", _STATE).first()
        if r["policy"] != policy:
            raise ValueError(f"the scan at {path} is stale: its policy is {r['policy']}, not {policy}")
        out.cursor, out.slice, out.pairs = r["cursor"], r["slice"], r["pairs"]
        return out

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _move(self, cursor: int, slice_: int) -> DuplicateScan:
        self.spark.createDataFrame([(cursor, slice_, self.pairs, self.policy)], _STATE).write.mode("overwrite").parquet(f"{self.path}/state-{slice_}")
        self.cursor, self.slice = cursor, slice_
        return self

    @property
    def done(self) -> bool:
        return self.cursor >= self.pairs

    def verdicts(self) -> DataFrame:
        """All verdicts under the scan's policy."""
        if not self.slice:
            return self.spark.createDataFrame([], VERDICT)
        at = [f"{self.path}/verdicts/policy={self.policy}/slice={k}" for k in range(1, self.slice + 1)]
        return self.spark.read.schema(VERDICT).parquet(*at)

    def ahead(self, n: int) -> DataFrame:
        """The next ``n`` pairs from the cursor on, without those that have a verdict."""
        now = self._table("pairs", _PAIRS).where((F.col("place") > self.cursor) & (F.col("place") <= self.cursor + n))
        return now.join(self.verdicts().select("a", "b"), ["a", "b"], "left_anti")

    def record(self, verdicts: DataFrame, n: int) -> DuplicateScan:
        """Keep the verdicts of the ``n`` pairs ahead, then move the cursor behind them. Pairs without a
        verdict stay unjudged: a restart comes back to them."""
        verdicts.select(*[F.col(c).cast("string") for c in ("a", "b", "verdict")]).write.mode("overwrite").parquet(f"{self.path}/verdicts/policy={self.policy}/slice={self.slice + 1}")
        return self._move(min(self.cursor + n, self.pairs), self.slice + 1)

    def restart(self) -> DuplicateScan:
        """From the beginning again, for pairs that a failure left without a verdict."""
        return self._move(0, self.slice)


def all_verdicts(scan: DuplicateScan, judge, n: int) -> DataFrame:
    """Run a scan to its end, ``n`` pairs a slice. ``judge`` turns pairs (a, b, similarity) into verdicts."""
    while not scan.done:
        scan.record(judge(scan.ahead(n)), n)
    return scan.verdicts()
