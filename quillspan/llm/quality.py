"""Quality scores by a sparse rule ensemble (operator 5).

Trees are grown on statistics of labelled texts; every path from a root to a node is a rule,
a conjunction of comparisons. A lasso logistic regression over the rules leaves few with a
weight, and these are compiled into one Spark column over the statistics.

Only statistics of the text go into a score: no label, language, source or id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import fold, ship, stage

#: Most labelled rows that the ensemble is fitted on (those with the smallest hash of the id).
SAMPLE_ROWS = 20_000
STATS = (
    "n_words",
    "word_bytes",
    "upper_share",
    "symbol_share",
    "mark_share",
    "digit_share",
    "bar_share",
    "space_share",
    "distinct_share",
    "top_word_share",
    "repeated_line_share",
    "line_words",
    "stop_share",
    "title_share",
)


def text_stats(text: bytes) -> tuple[float, ...]:
    """The statistics in the order of STATS; all 0 for a text without a word."""
    from collections import Counter

    import numpy as np

    words = text.split()
    if not words:
        return (0.0,) * len(STATS)
    n, size = len(words), len(text)
    at = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digit = int(at[65:91].sum()), int(at[97:123].sum()), int(at[48:58].sum())
    space = int(at[32] + at[9:14].sum())
    marks = int(at[[33, 63]].sum())  # ! ?
    bar = int(at[124])
    plain = int(at[[39, 40, 41, 44, 45, 46, 58, 59]].sum())  # ' ( ) , - . : ;
    symbols = int(at[33:127].sum()) - upper - lower - digit - plain - marks
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    stops = int(at[[44, 46]].sum())
    titled = sum(times for w, times in counts.items() if w[:1].isupper())
    return (
        float(n),
        (size - space) / n,
        upper / max(1, upper + lower),
        symbols / size,
        marks / n,
        digit / size,
        bar / n,
        space / size,
        len(counts) / n,
        counts.most_common(1)[0][1] / n,
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        stops / n,
        titled / n,
    )


def with_stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, one double per statistic) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            got = np.array([text_stats(t) for t in batch.column(1).to_pylist()], float).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[:, k]) for k in range(len(STATS)))], names=["id", *STATS])

    ship(rows.sparkSession)
    return rows.mapInArrow(run, "id long, " + ", ".join(f"{s} double" for s in STATS))


@dataclass(frozen=True)
class Rule:
    """All tests hold: (statistic, whether at most, threshold)."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        cond = F.lit(True)
        for stat, at_most, x in self.tests:
            cond = cond & ((F.col(stat) <= x) if at_most else (F.col(stat) > x))
        return cond


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Probability of label 1 as one expression over the statistics."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            z = z + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def tree_rules(trees: list) -> list[Rule]:
    """One rule per path from a root to a node below it; comparisons of one statistic are merged."""
    found: dict[Rule, None] = {}

    def walk(node, tests: tuple) -> None:
        if tests:
            least: dict[tuple[str, bool], float] = {}
            for stat, at_most, x in tests:
                old = least.get((stat, at_most))
                least[stat, at_most] = x if old is None else (min if at_most else max)(x, old)
            found[Rule(tuple(sorted((s, a, x) for (s, a), x in least.items())))] = None
        if node.subtreeDepth() == 0:
            return
        split = node.split()
        stat, x = STATS[split.featureIndex()], round(float(split.threshold()), 6)
        walk(node.leftChild(), (*tests, (stat, True, x)))
        walk(node.rightChild(), (*tests, (stat, False, x)))

    for tree in trees:
        walk(tree._java_obj.rootNode(), ())
    return list(found)


def rule_hits(stats: DataFrame, rules: list[Rule], label: str) -> DataFrame:
    """(y, hits): the label and a vector with a 1 for each rule that holds; comparisons in numpy, so that hundreds of rules need no generated code."""
    from pyspark.ml.functions import array_to_vector

    place = {s: k for k, s in enumerate(STATS)}
    tests = [[(place[s], at_most, x) for s, at_most, x in r.tests] for r in rules]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(k + 1).to_numpy() for k in range(len(STATS))]
            hits = np.zeros((batch.num_rows, len(tests)))
            for k, rule in enumerate(tests):
                hits[:, k] = np.logical_and.reduce([columns[c] <= x if at_most else columns[c] > x for c, at_most, x in rule])
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(tests))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(hits.reshape(-1)))], names=["y", "hits"])

    return stats.select(F.col(label).cast("double").alias("y"), *STATS).mapInArrow(run, "y double, hits array<double>").select("y", array_to_vector("hits").alias("hits"))


def fit_rules(stats: DataFrame, label: str = "label", trees: int = 24, depth: int = 3, penalty: float = 0.0015, seed: int = 5) -> RuleEnsemble:
    """Fit the ensemble on rows with the statistics and a 0/1 label.

    Without rows, or with one label only, the ensemble is a constant, the share of label 1
    with one imagined row of each. The rows are few; equal rows in the same order and
    partitions give the same trees.
    """
    import math

    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    n, ones = stats.agg(F.count(F.lit(1)), F.coalesce(F.sum(label), F.lit(0))).first()
    if not 0 < ones < n:
        return RuleEnsemble(math.log((ones + 1) / (n - ones + 1)), ())
    data = VectorAssembler(inputCols=list(STATS), outputCol="stats").transform(stats).select("stats", F.col(label).cast("double").alias("y"))
    forest = RandomForestClassifier(labelCol="y", featuresCol="stats", numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="0.5", subsamplingRate=0.7, seed=seed).fit(data)
    rules = tree_rules(forest.trees)
    lasso = LogisticRegression(labelCol="y", featuresCol="hits", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60)
    model = lasso.fit(rule_hits(stats, rules, label))
    kept = tuple((r, float(w)) for r, w in zip(rules, model.coefficients) if w)
    return RuleEnsemble(float(model.intercept), kept)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held_out: int = 2, sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """Fit on labelled documents outside the held-out fold, on at most ``sample_rows`` of them.

    Labels that are null or of no document are left out; of repeated labels the more
    frequent one counts, 1 on a tie. The result does not depend on how the tables are
    partitioned.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label")).where("id is not null and label is not null")
    known = known.where(fold("id", folds) != held_out).groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    sample = stage(known.orderBy(F.xxhash64("id"), "id").limit(sample_rows), "sample")
    some = docs.join(F.broadcast(sample.select(F.col("id").alias(id_col))), id_col, "left_semi")  # sample_rows ids at most
    stats = with_stats(some, id_col, text_col).join(F.broadcast(sample), "id")
    # the sample in one partition and one order, however the documents lie: bagging draws by partition and row
    return fit_rules(stage(stats.repartition(1).sortWithinPartitions("id", *STATS), "labelled"))


def score(docs: DataFrame, ensemble: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """One row per document: id, held_out, score, predicted (1 from ``threshold``).

    A null text counts as empty and has all statistics 0; a null id is in no fold; repeated
    rows each give a row; an empty table gives none; other columns are neither read nor
    returned. No shuffle.
    """
    scored = with_stats(docs, id_col, text_col).select("id", F.coalesce(fold("id", folds) == held_out, F.lit(False)).alias("held_out"), ensemble.score().alias("score"))
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, ensemble: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold. No shuffle: the rows travel with their statistics."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, " + ", ".join(f"{s} double" for s in STATS)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            got = np.array([text_stats(t) for t in batch.column(1).to_pylist()], float).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[:, k]) for k in range(len(STATS)))], names=["row", *STATS])

    ship(rows.sparkSession)
    return rows.mapInArrow(run, schema).where(ensemble.score() >= threshold).select("row.*")
