"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of every text are computed once. Shallow trees are grown on the
labelled training rows, every path from a root becomes a rule (a conjunction
of comparisons of statistics), and a logistic regression with an L1
penalty gives most rules weight zero. What is left is compiled into one
Spark column expression, which scores all rows without Python.

Trees and weights are fitted by Spark on all labelled training rows.

Defined cases: NULL and empty texts have zero in all statistics and are
scored like others; labels that are NULL or without a document are not
learned from; several labels of a document all count; with one class or no
label at all the score is the smoothed share of label 1; repeated rows are
separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.llm.tables import kept
from custodia.llm.words import batch_words, blank_separated

TREES = 16
DEPTH = 3
PENALTY = 0.0005
SEED = 17


def _bytes(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_CLASSES = {
    "digits": _bytes(b"0123456789"), "upper": _bytes(bytes(range(65, 91))),
    "letters": _bytes(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))),
    "points": _bytes(b".,;:!?"), "symbols": _bytes(b"#$%&*+<=>@\\^_`{|}~[]/"), "pipes": _bytes(b"|"),
    "lines": _bytes(b"\n"), "other_bytes": _bytes(bytes(range(128, 256))),
}
STATISTICS = ("log_words", "word_length", "digit_share", "upper_share", "letter_share", "point_rate",
              "symbol_rate", "pipe_rate", "line_rate", "other_share", "distinct_share", "repeat_share",
              "top_share", "longest_word", "end_point_share")


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = _bytes(b".!?,")
    for batch in batches:
        rows = []
        for i, j, words in batch_words(batch.column(1), blank_separated()):
            h, data, bounds, first = words.hashes(), words.data, words.bounds, words.first
            sums = {}
            for name, is_in in _CLASSES.items():
                total = np.concatenate([[0], np.cumsum(is_in[data], dtype=np.int64)])
                sums[name] = total[bounds[1:]] - total[bounds[:-1]]
            length = words.end - words.start
            same = np.concatenate([[0], np.cumsum(h[1:] == h[:-1]), [0]])
            closed = np.concatenate([[0], np.cumsum(ends[data[words.end - 1]], dtype=np.int64)])
            for r in range(j - i):
                a, b = int(first[r]), int(first[r + 1])
                n, size = b - a, int(bounds[r + 1] - bounds[r])
                if not n:
                    rows.append((0.0,) * len(STATISTICS))
                    continue
                counts = np.unique(h[a:b], return_counts=True)[1]
                rows.append((
                    float(np.log(n)), float(length[a:b].mean()), sums["digits"][r] / size, sums["upper"][r] / size,
                    sums["letters"][r] / size, sums["points"][r] / n, sums["symbols"][r] / n, sums["pipes"][r] / n,
                    sums["lines"][r] / n, sums["other_bytes"][r] / size, len(counts) / n,
                    float(same[b - 1] - same[a]) / n, float(counts.max()) / n, float(np.log(length[a:b].max())),
                    (closed[b] - closed[a]) / n))
        columns = np.array(rows, np.float64).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(np.ascontiguousarray(columns[:, k])) for k in range(len(STATISTICS))]],
            names=["doc_id", *STATISTICS])


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_statistics, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


Rule = tuple[tuple[int, str, float], ...]
_NODE = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)$")


def rules_of(tree_text: str) -> set[Rule]:
    """The path conditions of all nodes below the root of a tree's text."""
    path: list[tuple[int, tuple[int, str, float]]] = []
    found: set[Rule] = set()
    for line in tree_text.splitlines():
        if m := _NODE.match(line):
            depth = len(m[1])
            path = [x for x in path if x[0] < depth] + [(depth, (int(m[3]), m[4], float(m[5])))]
            tight: dict[tuple[int, str], float] = {}
            for _, (f, op, v) in path:
                old = tight.get((f, op), v)
                tight[f, op] = min(old, v) if op == "<=" else max(old, v)
            found.add(tuple(sorted((f, op, v) for (f, op), v in tight.items())))
    return found


def _condition(rule: Rule) -> Column:
    out = F.lit(True)
    for f, op, v in rule:
        x = F.col(STATISTICS[f])
        out = out & (x <= v if op == "<=" else x > v)
    return out


class RuleEnsemble:
    """Rules with weights and an intercept."""

    def __init__(self, weights: dict[Rule, float], intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self) -> Column:
        """The probability of label 1, as an expression on the statistics."""
        total = F.lit(float(self.intercept))
        for rule in sorted(self.weights):
            total = total + F.when(_condition(rule), float(self.weights[rule])).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleEnsemble:
    """Fit on rows with the statistics and ``label`` (0 or 1)."""
    rows = kept(labelled.select(array_to_vector(F.array(*STATISTICS)).alias("features"), *STATISTICS,
                                F.col("label").cast("double").alias("label")))
    seen = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (seen.get(1.0, 0) + 1) / (sum(seen.values()) + 2)
    if len(seen) < 2:
        return RuleEnsemble({}, float(np.log(share / (1 - share))))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird",
                                    subsamplingRate=0.7, seed=SEED, maxBins=64).fit(rows)
    rules = sorted(set().union(*(rules_of(t.toDebugString) for t in forest.trees)))
    if not rules:
        return RuleEnsemble({}, float(np.log(share / (1 - share))))
    held = rows.select("label", array_to_vector(F.array(*[_condition(r).cast("double") for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=True).fit(held)
    weights = {r: float(w) for r, w in zip(rules, lasso.coefficients.toArray()) if w}
    return RuleEnsemble(weights, float(lasso.intercept))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted; learned from
    labels of documents that are not held out."""
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(1))
    statistics = kept(text_statistics(docs))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")) \
        .filter("label IN (0, 1)")
    model = fit(statistics.filter(part != 1).join(known, "doc_id"))
    return statistics.select("doc_id", (part == 1).alias("held_out"), model.score().alias("score")) \
        .withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
