"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Base statistics are counted for every document and fail it if it is short or repeats itself.
The rules that follow are predicates that reject. Each rule's cost (nanoseconds a document)
and selectivity (share it rejects) are measured on a bounded sample, and the rules are tried in
the order of rejections per cost: a document that an early rule rejects costs nothing more.
The order moves the cost only; the verdict is that of all rules together.

Costs come from one job. Every sampled document is repeated ``REPEATS`` times, and the machine's
clock is read between one rule and the next, so that neither a job's start nor the reading of
the texts is counted; the clock's own cost is measured in the same way and taken off.

Null texts have no words and fail. Repeated rows are judged alike and ids, null or repeated,
don't matter: the verdict travels with its row. An empty table gives an empty result, and rules
in the order they are written. ``judge`` ignores extra columns; ``keep`` returns the rows as
they were.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, stored
from .docstats import SYMBOLS, n_of, repeat_words, with_words

#: Documents of the sample that costs and selectivities are measured on, on average.
SAMPLE = 1_000
#: Times that a sampled document is judged for the clock, and for warming up before that.
REPEATS, WARM_UP = 4, 2


@dataclass(frozen=True)
class Rule:
    """``rejects`` reads the columns of ``with_words`` and ``base``; it is never null."""

    name: str
    rejects: Callable[[], Column]


def _c(name: str) -> Column:
    return F.col(name)


RULES: tuple[Rule, ...] = (
    Rule("few_distinct_words", lambda: F.size(F.array_distinct("_w")) * 50 < _c("n_words")),
    Rule("symbols", lambda: _c("n_symbols") * 5 > _c("n_words")),
    Rule("capitals", lambda: n_of(_c("_t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ") * 5 > _c("word_chars") * 2),
    Rule("exclamations", lambda: n_of(_c("_t"), "!") * 5 > _c("n_words")),
    Rule("repeated_lines", lambda: _c("n_dup_lines") * 2 > F.size("_l")),
    Rule("word_length", lambda: (_c("word_chars") < _c("n_words") * 2) | (_c("word_chars") > _c("n_words") * 20)),
    Rule("digits", lambda: n_of(_c("_t"), "0123456789") * 2 > _c("word_chars")),
)


def base(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the base statistics and base_failed, beside the columns of ``with_words``."""
    return _counted(with_words(docs, text))


def _counted(w: DataFrame) -> DataFrame:
    counted = settled(
        repeat_words(w),
        n_words=F.size("_w").cast("bigint"),
        word_chars=F.length(F.array_join("_w", "")).cast("bigint"),
        n_symbols=n_of(_c("_t"), SYMBOLS),
        n_dup_lines=(F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint"),
    )
    return counted.withColumn("base_failed", (_c("n_words") < 50) | (100 * _c("n_repeat_words") > 50 * _c("n_words")))


def measure(sample: DataFrame, rules: Sequence[Rule] = RULES) -> dict[str, tuple[float, float]]:
    """Cost (nanoseconds a document) and rejected share of each rule over a stored sample of
    ``base``, in one job.

    The k-th element of ``_at`` is the clock after the k-th rule, negative if the rule rejects:
    the clock is read in the branches of the rule's own condition, so never before it, and the
    elements of an array are worked out in their order. The first two have no rule."""
    clock = lambda: F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("bigint")
    after = lambda c: F.when(c, -clock()).otherwise(clock())
    rows = sample.withColumn("_repeat", F.explode(F.sequence(F.lit(1), F.lit(REPEATS + WARM_UP))))
    timed = rows.select("_repeat", F.array(after(_c("n_words") < 0), after(_c("n_words") < 0), *[after(r.rejects()) for r in rules]).alias("_at")).where(_c("_repeat") > WARM_UP)
    at = lambda k: F.get("_at", F.lit(k))
    took = lambda k: F.avg(F.abs(at(k)) - F.abs(at(k - 1)))
    seen = timed.agg(took(1).alias("plain"), *[took(k + 2).alias(f"cost{k}") for k in range(len(rules))], *[F.avg((at(k + 2) < 0).cast("int")).alias(f"share{k}") for k in range(len(rules))]).first()
    return {r.name: (max(1.0, (seen[f"cost{k}"] or 0.0) - (seen["plain"] or 0.0)), seen[f"share{k}"] or 0.0) for k, r in enumerate(rules)}


def ranked(measured: dict[str, tuple[float, float]], rules: Sequence[Rule] = RULES) -> list[Rule]:
    """Most rejections per cost first; equal ones as written."""
    return sorted(rules, key=lambda r: -measured[r.name][1] / measured[r.name][0])


def cascade(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects, or null; later rules aren't evaluated."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for r in rules:
        out = out.when(r.rejects(), F.lit(r.name))
    return out


def _judged(docs: DataFrame, text: str, rules: Sequence[Rule], sample: int) -> DataFrame:
    """The rows as ``_own``, with the base statistics, base_failed and kept; one narrow pass."""
    n = docs.count()
    part = docs.select(F.lit(0).alias("doc_id"), F.col(text).alias("text")).sample(min(1.0, sample / max(1, n)), seed=1)
    order = ranked(measure(stored(base(part).where("not base_failed"), "sample"), rules), rules)
    own = docs.select(F.struct(*docs.columns).alias("doc_id"), F.col(text).alias("text"))  # the row itself in the place of its id
    return settled(base(own), kept=F.when(_c("base_failed"), False).otherwise(cascade(order).isNull()))


def judge(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept, for every row."""
    out = _judged(docs.select("doc_id", text), text, rules, sample)
    return out.select("doc_id.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample: int = SAMPLE) -> DataFrame:
    """The documents that pass, with their own columns."""
    return _judged(docs, text, rules, sample).where("kept").select("doc_id.*")
