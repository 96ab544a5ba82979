"""Quality classifier: a sparse rule ensemble.

Statistics of a text are counted with numpy. A small forest is fitted to them; every path from
a root to a node is a conjunctive rule over thresholds. Lasso logistic regression weighs the
rules and sets most weights to zero, and the rules that remain are compiled to one Spark
column expression over the statistics, so scoring is a narrow step without a model object.

The forest and the weights are fitted on about ``MAX_TRAIN`` labelled rows, taken by a hash of
their id. Labels, language, source and id are never inputs of a score. Null and empty texts
have all statistics at zero and get a score like any other. Rows with a null or repeated id
are scored each by its text; of rows that repeat a labelled id one is fitted on. Labels of ids that aren't there, null labels and repeated labels
(the larger counts) do no harm. With no labels, or labels of one kind, the score of every
text is the share of label 1 (or a half). Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions, slices, stored

#: Labelled rows that are fitted on at most, on average.
MAX_TRAIN = 20_000
TREES, DEPTH, PENALTY = 16, 3, 0.001
#: The lasso stops after this many steps, or when a step changes little: each is a job over the sample.
STEPS, TOLERANCE = 25, 1e-4
THRESHOLD = 0.3

Condition = tuple[int, bool, float]  # feature, whether at most (else over) the threshold
Rule = tuple[Condition, ...]


#: Bytes that are counted together; each class is a share of the words.
_CLASSES = (b"|", b"#", b"*$%&", b"!", b".", b",", b"?", b"<>{}[]", b":;/@_=\\", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789")
_CLASS = np.zeros((256, len(_CLASSES)))
for _k, _c in enumerate(_CLASSES):
    _CLASS[list(_c), _k] = 1


def statistics(text: str | None) -> list[float]:
    """Statistics of one whole text, from its UTF-8 bytes, words and lines."""
    raw = (text or "").encode("utf-8")
    ws = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, k = max(1, len(ws)), max(1, len(lines))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS / n
    return [
        math.log1p(len(ws)),
        len(raw) / n,
        *counts.tolist(),
        len(lines) / n,
        (len(lines) - len(set(lines))) / k,
        len(set(ws)) / n,
        sum(len(w) <= 3 for w in ws) / n,
        sum(map(eq, ws, ws[1:])) / n,
    ]


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``x``, an array of statistics in place of the text; a narrow step."""
    keep = [c for c in docs.columns if c not in ("x", text)]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                x = pa.array([statistics(t) for t in part.column(text).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), x], names=schema.names)

    return docs.select(*keep, text).mapInArrow(run, schema)


def paths(tree: str) -> set[Rule]:
    """Rules of a printed tree: the conditions on the way to each node but the root."""
    out, way = set(), []
    for line in tree.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            depth = len(m[1])
            way = [c for c in way if c[0] < depth] + [(depth, (int(m[2]), m[3] == "<=", float(m[4])))]
            out.add(tuple(sorted({c for _, c in way})))
    return out


def holds(rule: Rule, x: str = "x") -> Column:
    out = F.lit(True)
    for feature, below, threshold in rule:
        value = F.get(x, F.lit(feature))
        out = out & ((value <= threshold) if below else (value > threshold))
    return out


class RuleEnsemble:
    """Rules, their weights, and the intercept."""

    def __init__(self, rules: list[Rule], weights: list[float], intercept: float):
        self.rules, self.weights, self.intercept = rules, weights, intercept

    def score(self, x: str = "x") -> Column:
        """The compiled expression: logistic of the weights of the rules that hold."""
        z = F.lit(self.intercept)
        for r, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(holds(r, x), w).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))


def constant(share: float | None) -> RuleEnsemble:
    p = min(1 - 1e-6, max(1e-6, 0.5 if share is None else share))
    return RuleEnsemble([], [], math.log(p / (1 - p)))


def fit(labelled: DataFrame, seed: int = 11) -> RuleEnsemble:
    """Fit to rows of ``x`` and ``label`` (0 or 1); the rows are a bounded sample."""
    data = labelled.select("x", F.col("label").cast("double").alias("label"))
    share = data.agg(F.avg("label")).first()[0]
    if share is None or share in (0.0, 1.0):
        return constant(share)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, minInstancesPerNode=3, featureSubsetStrategy="onethird", featuresCol="v", labelCol="label", subsamplingRate=0.8)
    model = forest.fit(data.withColumn("v", array_to_vector("x")))
    rules = sorted(set().union(*[paths(t.toDebugString) for t in model.trees]))
    if not rules:
        return constant(share)
    fired = data.select("label", array_to_vector(F.array(*[F.when(holds(r), 1.0).otherwise(0.0) for r in rules])).alias("v"))
    lasso = LogisticRegression(featuresCol="v", labelCol="label", elasticNetParam=1.0, regParam=PENALTY, maxIter=STEPS, tol=TOLERANCE, standardization=True)
    fitted = lasso.fit(fired)
    chosen = [(r, float(w)) for r, w in zip(rules, fitted.coefficients.toArray(), strict=True) if w]
    return RuleEnsemble([r for r, _ in chosen], [w for _, w in chosen], float(fitted.intercept))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", bound: int = MAX_TRAIN) -> RuleEnsemble:
    """Fit on labelled rows that aren't held out."""
    usable = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    usable = usable.groupBy("_id").agg(F.max("label").alias("label"))
    n = usable.count()
    sample = usable.where(F.pmod(F.xxhash64(F.lit("train"), "_id"), F.lit(max(1, n))) < bound)  # about ``bound`` rows of two numbers
    chosen = docs.select("doc_id", text).join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    stats = features(chosen.select("doc_id", "label", text), text).groupBy("doc_id", "label").agg(F.min("x").alias("x"))  # once an id, however often it stands there
    tasks = min(4, shuffle_partitions(docs.sparkSession))
    return fit(stored(stats.repartition(tasks, "doc_id").sortWithinPartitions("doc_id", "x"), "train"))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = train(docs, labels, text, label)
    scored = features(docs.select("doc_id", text), text).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with their own columns, in one narrow pass."""
    model = train(docs, labels, text, label)
    packed = docs.select(F.struct(*docs.columns).alias("_own"), F.col(text).alias("_text"))
    return features(packed, "_text").where(model.score() >= threshold).select("_own.*")
