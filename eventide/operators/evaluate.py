"""Evaluation of labelled cases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N


def confusion(rows: DataFrame, label: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn and precision, recall, f1, accuracy (null on a zero denominator)."""
    n = rows.where(label.isNotNull() & predicted.isNotNull())
    a = n.groupBy(*(by or [])).agg(F.count_if(label & predicted).alias("tp"), F.count_if(~label & predicted).alias("fp"), F.count_if(label & ~predicted).alias("fn"), F.count_if(~label & ~predicted).alias("tn"))
    div = lambda x, y: F.round(F.try_divide(x.cast("double"), y.cast("double")), 6)
    c = F.col
    return a.withColumns({"precision": div(c("tp"), c("tp") + c("fp")), "recall": div(c("tp"), c("tp") + c("fn")), "f1": div(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")), "accuracy": div(c("tp") + c("tn"), c("tp") + c("fp") + c("fn") + c("tn"))})


def compare(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """case_id, passed, failures: expected values (a map) are part of the actual ones."""
    e = expected.select("case_id", F.explode("expected").alias("key", "want"))
    j = e.join(actual, "case_id", "left").select("case_id", "key", "want", F.col("actual")[F.col("key")].alias("got"))
    bad = F.when(~F.col("want").eqNullSafe(F.col("got")), F.col("key"))
    return j.groupBy("case_id").agg(F.array_sort(F.collect_list(bad)).alias("failures")).withColumn("passed", F.size("failures") == 0)


def summary(cases: DataFrame, by: list[str]) -> DataFrame:
    """Passes by each column of ``by`` alone, in one pass of grouping sets."""
    sets = cases.groupingSets([[F.col(b)] for b in by] + [[]], *[F.col(b) for b in by])
    return sets.agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))


def by_method(cases: DataFrame) -> DataFrame:
    """method, n, passed over the methods that matched a case; a case counts for each of its methods."""
    return cases.select("passed", F.explode(F.array_distinct("matched_by")).alias("method")).groupBy("method").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))


def split_leaks(cases: DataFrame) -> DataFrame:
    """Groups with cases in more than one split."""
    g = cases.select(F.explode("groups").alias("group"), "split")
    return g.groupBy("group").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def regressions(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Cases that passed with the baseline and don't now, and the other way round."""
    j = baseline.select("case_id", F.col("passed").alias("was")).join(current.select("case_id", "passed"), "case_id")
    return j.where("was <> passed").select("case_id", F.when(F.col("passed"), "fixed").otherwise("regressed").alias("change"))


def mean_absolute_error(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.agg(F.avg(F.abs(F.col(a) - F.col(b))).alias("mae"), F.count(F.col(a) - F.col(b)).alias("n"))


def changed_labels(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Cases of the baseline that are gone or whose expected values changed: no comparison holds
    while there are any."""
    j = baseline.select("case_id", F.to_json("expected").alias("was")).join(current.select("case_id", F.to_json("expected").alias("now")), "case_id", "left")
    return j.where(~F.col("was").eqNullSafe(F.col("now"))).select("case_id", F.when(F.col("now").isNull(), "missing").otherwise("relabelled").alias("problem"))


def ablation(baseline: DataFrame, runs: DataFrame) -> DataFrame:
    """profile, cases, passed, fixed, regressed: every profile's run (case_id, profile, passed)
    over the baseline's cases. One join on the case; counts combine before they are shuffled."""
    j = runs.select("profile", "case_id", "passed").join(baseline.select("case_id", F.col("passed").alias("was")), "case_id")
    c = F.col
    return j.groupBy("profile").agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.count_if(c("passed") & ~c("was")).alias("fixed"), F.count_if(~c("passed") & c("was")).alias("regressed"))


def suite(cases: DataFrame, actual: DataFrame) -> DataFrame:
    """kind, n, passed, failed, rate over all cases (case_id, kind, expected) and what was found
    (case_id, actual). A case without a result fails."""
    done = compare(cases.select("case_id", "expected"), actual)
    return cases.join(done, "case_id", "left").groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.coalesce("passed", F.lit(False))).alias("passed")).withColumns({"failed": F.col("n") - F.col("passed"), "rate": F.round(F.col("passed") / F.col("n"), 6)})


#: What finds the actual values of a kind of case: a function of its cases (case_id, input: a map of
#: texts) that returns case_id and actual (such a map).
EVALUATORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def evaluator(kind: str) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Register a function for a kind; a kind has one."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        if kind in EVALUATORS:
            raise ValueError(f"kind {kind} has an evaluator already")
        EVALUATORS[kind] = f
        return f

    return add


def evaluated(cases: DataFrame, evaluators: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """kind, n, passed, failed, rate of cases (case_id, kind, input, expected: maps of texts), each run by
    the evaluator of its kind. Kinds are few; a kind without an evaluator passes no case."""
    known = EVALUATORS if evaluators is None else evaluators
    kinds = [r["kind"] for r in cases.select("kind").distinct().collect()]
    found = cases.sparkSession.createDataFrame([], f"case_id {cases.schema['case_id'].dataType.simpleString()}, actual map<string,string>")
    for kind in kinds:
        if kind in known:
            mine = known[kind](cases.where(F.col("kind") == kind).select("case_id", "input"))
            found = found.unionByName(mine.select("case_id", F.col("actual").cast("map<string,string>").alias("actual")))
    return suite(cases, found)


def _number(name: str) -> Column:
    return F.col("input")[name].try_cast("double")


@evaluator("rank_bucket")
def _rank_bucket(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", F.create_map(F.lit("bucket"), N.rank_bucket(_number("rank"))).alias("actual"))


@evaluator("strength")
def _strength(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", F.create_map(F.lit("strength"), N.strength(_number("score"))).alias("actual"))


@evaluator("freshness")
def _freshness(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", F.create_map(F.lit("bucket"), N.freshness_bucket(_number("hours")), F.lit("score"), N.freshness_score(_number("hours")).cast("string")).alias("actual"))


@evaluator("direction")
def _direction(cases: DataFrame) -> DataFrame:
    limit = F.coalesce(_number("limit"), F.lit(0.05))
    change = _number("now") - _number("before")
    label = F.when(change.isNull(), "unknown").when(change >= limit, "rising").when(change <= -limit, "cooling").otherwise("stable")
    return cases.select("case_id", F.create_map(F.lit("trend"), label).alias("actual"))
