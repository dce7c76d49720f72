"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees propose rules: every path from a root is a conjunction of conditions on
statistics. A logistic regression with an absolute-value penalty keeps few of
them, and those become one Spark column expression.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.llm.language import held_out
from fieldtally.llm.tables import map_texts, table
from fieldtally.session import settle

# Bound of the labelled rows that the fit reads.
TRAINING_ROWS = 20_000
TREES, DEPTH, PENALTY = 24, 3, 0.002
THRESHOLD = 0.7

STATISTICS = [
    "log_chars", "log_words", "word_length", "digits", "upper", "letters", "symbols", "pipes", "marks", "stops",
    "distinct_words", "top_word", "same_next", "distinct_lines", "line_length", "odd_ends", "packed",
]


def _kinds() -> np.ndarray:
    """Kind of every character below 128; the others count as letters."""
    kind = np.full(128, 0, np.uint8)
    for k, chars in enumerate(("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "#$%&*<>{}[]=+~^\\/_@", "|", "!?", ".,;:"), 1):
        for c in chars:
            kind[ord(c)] = k
    return kind


def statistics(text: str | None) -> list[float]:
    """The statistics of a text, shares between 0 and 1 unless named log or length; an empty text has zeros."""
    kind = _KIND
    if not text:
        return [0.0] * len(STATISTICS)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(chars)
    counts = np.bincount(kind[chars[chars < 128]], minlength=8)
    wide = int((chars >= 128).sum())
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(words))
    seen: dict[str, int] = {}
    same = odd = 0
    last = None
    for w in words:
        seen[w] = seen.get(w, 0) + 1
        same += w == last
        odd += not (w[-1].isalpha() or w[-1] in ".,")
        last = w
    raw = text.encode("utf-8", "surrogatepass")
    return [
        math.log1p(n),
        math.log1p(len(words)),
        sum(map(len, words)) / m,
        counts[1] / n,
        counts[2] / n,
        (counts[2] + counts[3] + wide) / n,
        counts[4] / n,
        counts[5] / n,
        counts[6] / n,
        counts[7] / n,
        len(seen) / m,
        max(seen.values(), default=0) / m,
        same / m,
        len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))),
        odd / m,
        min(1.0, len(zlib.compress(raw, 1)) / len(raw)),
    ]


_KIND = _kinds()


def with_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None, prefix: str = "stat_") -> DataFrame:
    """Columns ``keep`` (all) with one double per statistic of the whole text."""

    def begin():
        def work(texts: list, _) -> dict:
            rows = np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(STATISTICS))
            return {f"{prefix}{name}": rows[:, i].tolist() for i, name in enumerate(STATISTICS)}

        return work

    added = T.StructType([T.StructField(f"{prefix}{s}", T.DoubleType()) for s in STATISTICS])
    return map_texts(docs, text, begin, added, docs.columns if keep is None else keep)


# A rule: ((statistic, above, border), ...), met when every condition is.
Rule = tuple[tuple[str, bool, float], ...]


@dataclass
class RuleEnsemble:
    bias: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self, prefix: str = "stat_") -> Column:
        """Chance of a good text as a column expression over the statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(compiled(rule, prefix), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def compiled(rule: Rule, prefix: str = "stat_") -> Column:
    """A rule as a condition on the columns of the statistics."""
    met = F.lit(True)
    for name, above, border in rule:
        value = F.col(f"{prefix}{name}")
        met = met & ((value > border) if above else (value <= border))
    return met


def paths(tree) -> list[Rule]:
    """The conjunctions from the root of a fitted tree to each of its nodes, with one border per statistic and side."""
    found = []

    def walk(node, conditions: dict) -> None:
        if conditions:
            found.append(tuple(sorted((s, above, b) for (s, above), b in conditions.items())))
        if node.numDescendants() == 0:
            return
        split = node.split()
        name, border = STATISTICS[split.featureIndex()], float(split.threshold())
        for child, above in ((node.leftChild(), False), (node.rightChild(), True)):
            key = (name, above)
            nearer = max if above else min
            walk(child, conditions | {key: nearer(border, conditions.get(key, border))})

    walk(tree._call_java("rootNode"), {})
    return found


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", limit: int = TRAINING_ROWS) -> RuleEnsemble:
    """Fit on the texts of ``docs`` (key, text) for at most ``limit`` keys of ``labels`` (key, label 0 or 1).

    The keys are the first by a hash. Null keys and labels are left out; a key
    labelled more than once counts by its mean, from one half up as good. With
    labels of one kind only the ensemble gives nearly that kind to all; without
    labels it gives one half.
    """
    known = labels.where(f"label IS NOT NULL AND {key} IS NOT NULL").groupBy(key).agg(F.avg("label").alias("__mean"))
    some = settle(known.orderBy(F.xxhash64(key), key).limit(limit), "quality-keys")
    # At most ``limit`` keys: small enough for every task.
    texts = docs.join(F.broadcast(some), key).select("text", (F.col("__mean") >= 0.5).cast("double").alias("label"))
    data = settle(with_statistics(texts, keep=["label"]), "quality-sample")
    good, n = data.agg(F.sum("label"), F.count("*")).first()
    if not n:
        return RuleEnsemble()
    bias = math.log((good + 0.5) / (n - good + 0.5))
    if good in (0, n):
        return RuleEnsemble(bias)
    features = data.select("label", array_to_vector(F.array(*[f"stat_{s}" for s in STATISTICS])).alias("features"), *data.columns[1:])
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", minInstancesPerNode=max(1, min(20, n // 50)), seed=11
    ).fit(features)
    rules = sorted({rule for tree in forest.trees for rule in paths(tree)})
    if not rules:
        return RuleEnsemble(bias)
    met = F.array(*[compiled(r).cast("double") for r in rules])
    sheet = settle(data.select("label", met.alias("met")), "quality-rules").select("label", array_to_vector("met").alias("features"))
    fit = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False).fit(sheet)
    weights = fit.coefficients.toArray()
    return RuleEnsemble(float(fit.intercept), [(r, float(w)) for r, w in zip(rules, weights, strict=True) if w])


def score(docs: DataFrame, model: RuleEnsemble, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all) with score: the chance that the text is good.

    A null text scores as an empty one. Repeated texts score alike; there are
    no ties. A column called score is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "score"]
    scored = with_statistics(docs, text, keep, "__stat_")
    return scored.select(*[F.col(f"`{c}`") for c in keep], model.score("__stat_").alias("score"))


def usable_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) that may be learned from."""
    return labels.where(~held_out("doc_id", 4, 2)).select("doc_id", F.col("quality").alias("label"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document, learned from three quarters of the labels."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = train(docs, usable_labels(table(spark, folder, "labels")))
    scored = score(docs.withColumn("held_out", held_out("doc_id", 4, 2)), model, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: RuleEnsemble, text: str = "text") -> DataFrame:
    """``docs`` without those whose score is under the threshold."""
    scored = with_statistics(docs, text, docs.columns, "__stat_").where(model.score("__stat_") >= THRESHOLD)
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns])
