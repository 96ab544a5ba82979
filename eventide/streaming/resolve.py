"""Resolution of signals as they come, against the events of that moment.

A signal meets the live events of its blocking key: those that were last seen at most ``keep`` before
it. One that shares a hard identity merges, with the event of the smallest id if several do; else the
most similar event decides (Jaccard of the token sets, then the smallest id): merge, review, or, below
``review``, a new event named after the signal. A merge keeps the event alive and adds the
signal's identities to it; its tokens stay those of the founder. A signal under review joins nothing.

``transformWithState`` keeps the events of a key that can still be met, and a timer a key drops them
when none can any more.
Signals of a key are taken in the order (time, signal_id) within a batch, and batches in their own
order, so the result is that of a loop over signals, however they are cut into batches, as long as
they arrive in order; a signal older than the key's last one is decided at that one's time. A null
key is a key, null tokens and identities are empty; a signal without a time is left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import new_path

RESOLVED = "signal_id string, event_id string, decision string, score double"
_INPUT = pa.schema([("signal_id", pa.string()), ("tokens", pa.list_(pa.string())), ("ids", pa.list_(pa.string())), ("at", pa.int64())])
#: Signals of a key that are Python's objects at once.
STEP = 10_000
_EVENT = "event_id string, tokens array<string>, ids array<string>, seen bigint"


class Events:
    """The live events of one key: id -> (tokens, ids, last seen in microseconds)."""

    def __init__(self, held: dict[str, tuple[frozenset, frozenset, int]], keep: int, merge: float, review: float):
        self.held, self.keep, self.merge, self.review = held, keep, merge, review
        self._index_all()

    def _index_all(self) -> None:
        self.tokens: dict[str, set[str]] = {}  # token -> events
        self.owners: dict[str, set[str]] = {}  # identity -> events
        for e in self.held:
            self._index(e)

    def forget(self, at: int) -> None:
        """Drop the events that no signal of ``at`` or later can meet."""
        self.held = {e: x for e, x in self.held.items() if at - x[2] <= self.keep}
        self._index_all()

    def _index(self, event: str) -> None:
        tokens, ids, _ = self.held[event]
        for table, values in ((self.tokens, tokens), (self.owners, ids)):
            for v in values:
                table.setdefault(v, set()).add(event)

    def _live(self, events: Iterable[str], at: int) -> list[str]:
        return [e for e in events if at - self.held[e][2] <= self.keep]

    def put(self, signal: str, tokens: frozenset, ids: frozenset, at: int) -> tuple[str | None, str, float]:
        """Decide one signal: its event, the decision and the score."""
        own = self._live({e for i in ids for e in self.owners.get(i, ())}, at)
        if own:
            return self._join(min(own), ids, at, 1.0)
        near = self._live({e for t in tokens for e in self.tokens.get(t, ())}, at)
        score, event = max(((len(tokens & self.held[e][0]) / len(tokens | self.held[e][0]), e) for e in near), key=lambda x: (x[0], [-ord(c) for c in x[1]]), default=(0.0, None))
        if score >= self.merge:
            return self._join(event, ids, at, score)
        if score >= self.review:
            return event, "candidate_review", score
        event = f"new:{signal}"
        self.held[event] = (tokens, ids, at)
        self._index(event)
        return event, "create", score

    def _join(self, event: str, ids: frozenset, at: int, score: float) -> tuple[str, str, float]:
        tokens, old, seen = self.held[event]
        self.held[event] = (tokens, old | ids, max(seen, at))
        for i in ids:
            self.owners.setdefault(i, set()).add(event)
        return event, "merge", score


class _Resolver(StatefulProcessor):
    def __init__(self, keep_us: int, merge: float, review: float):
        self.keep, self.merge, self.review = keep_us, merge, review

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", _EVENT)  # read and written whole, once a batch and key
        self.last = handle.getValueState("last", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pa.concat_tables([pa.Table.from_pandas(r, _INPUT, preserve_index=False) for r in rows]).combine_chunks()
        order = pc.sort_indices(batch, [("at", "ascending"), ("signal_id", "ascending")])
        held = {e: (frozenset(tokens), frozenset(ids), seen) for e, tokens, ids, seen in self.events.get()}
        live, known = Events(held, self.keep, self.merge, self.review), len(held)
        now = self.last.get()[0] if self.last.exists() else None
        for k in range(0, len(order), STEP):
            part, out = batch.take(order.slice(k, STEP)), []
            for signal, tokens, ids, at in zip(*(part.column(c).to_pylist() for c in _INPUT.names), strict=True):
                now = at if now is None else max(now, at)
                out.append((signal, *live.put(signal, frozenset(tokens), frozenset(ids), now)))
            if len(live.held) > 2 * known + STEP:  # most of them may be gone
                live.forget(now)
                known = len(live.held)
            yield pd.DataFrame(out, columns=["signal_id", "event_id", "decision", "score"])
        self._keep([(e, sorted(tokens), sorted(ids), seen) for e, (tokens, ids, seen) in live.held.items() if now - seen <= self.keep])
        self.last.update((now,))

    def _keep(self, events: list[tuple]) -> None:
        if not events:
            self.events.clear()
            return
        self.events.put(events)
        self.handle.registerTimer((max(e[3] for e in events) + self.keep) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = expiredTimerInfo.getExpiryTimeInMs() * 1000
        self._keep([tuple(e) for e in self.events.get() if e[3] + self.keep >= past])
        return iter(())

    def close(self) -> None:
        pass


def resolve_stream(signals: DataFrame, keep: str = "72 hours", delay: str = "1 hour", merge: float = 0.6, review: float = 0.4) -> DataFrame:
    """signal_id, event_id, decision and score of a stream of signals: signal_id, block, time, tokens and
    ids (arrays). ``delay``: the watermark, after which state that is too old goes."""
    spark = signals.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keep_us = int(pd.Timedelta(keep) / pd.Timedelta(microseconds=1))
    list_ = lambda c: F.array_compact(F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>"))).alias(c)
    rows = signals.where("time is not null").select(F.col("signal_id").cast("string").alias("signal_id"), F.coalesce(F.col("block").cast("string"), F.lit("\0null")).alias("block"), "time", F.unix_micros("time").alias("at"), list_("tokens"), list_("ids"))
    return rows.withWatermark("time", delay).groupBy("block").transformWithStateInPandas(_Resolver(keep_us, merge, review), RESOLVED, "Append", "EventTime")



def resolve_table(signals: DataFrame, rows: int = 2_000_000, **how) -> DataFrame:
    """``resolve_stream`` of a whole table in the order of time: slices of about ``rows`` signals are
    appended to the stream's input and resolved one after the other, so what a task holds of a key
    is bounded by a slice, not by the table. Signals of one time stay together."""
    spark = signals.sparkSession
    base, at = new_path(spark, "signals"), F.unix_micros("time")
    n = -(-signals.where("time is not null").count() // rows)
    shares = [k / n for k in range(1, n)]
    cuts = sorted(set(signals.agg(F.percentile_approx(at, shares, 10_000)).first()[0])) if shares else []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        inside = (F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high)
        signals.where(inside).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(signals.schema).parquet(f"{base}/in")
        q = resolve_stream(source, **how).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(RESOLVED).parquet(f"{base}/out")
