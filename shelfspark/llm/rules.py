"""Quality classifier as a sparse ensemble of rules.

Shallow trees are grown over statistics of the texts. Every path in them, whole or cut short, is a
rule: a conjunction of comparisons. A logistic regression with an L1 penalty weighs the rules and
leaves most of them at zero. What remains is compiled into one column expression, so that scoring is
a projection without Python, and each rule and weight can be read.

Only the fit uses a sample: at most ``SAMPLE`` labelled rows, those with the smallest hash of their
id, so it is the same at every run. Statistics, trees and weights are computed by Spark jobs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.session import checkpointed

SAMPLE = 20_000
TREES, DEPTH, PENALTY, SEED = 40, 3, 0.001, 11
THRESHOLD = 0.7
# Score where no labels of both kinds exist and no labels at all.
NO_LABELS = 0.75

Rule = frozenset[tuple[str, str, float]]


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text; null counts as empty. All are numbers for every text."""
    plain = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(plain), F.lit(1)).cast("double")
    kept = lambda drop: F.length(F.regexp_replace(plain, drop, "")) / size
    words = F.split(plain, r"\s+")
    lines = F.split(plain, "\n")
    share = lambda a: F.size(F.array_distinct(a)) / F.size(a)
    return {
        "log_chars": F.log1p(size),
        "upper_share": kept(r"\P{Lu}+"),
        "mark_share": kept(r"[\p{L}\p{N}\s.,]+"),
        "digit_share": kept(r"[^0-9]+"),
        "stop_share": kept(r"[^.]+"),
        "comma_share": kept(r"[^,]+"),
        "word_length": size / F.size(words),
        "distinct_words": share(words),
        "distinct_lines": share(lines),
        "line_length": size / F.size(lines),
    }


def with_statistics(docs: DataFrame, key: str, text: str, *others: Column) -> DataFrame:
    stats = F.struct(*[c.cast("double").alias(n) for n, c in statistics(F.col(text)).items()])
    return docs.select(F.col(key).alias("doc_id"), *others, stats.alias("stats"))


def held_out(key: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def condition(rule: Rule) -> Column:
    out = F.lit(True)
    for name, sign, limit in sorted(rule):
        value = F.col(f"stats.{name}")
        out = out & (value <= limit if sign == "<=" else value > limit)
    return out


def tree_rules(description: str, names: list[str]) -> set[Rule]:
    """All paths from the root of a printed tree, whole and cut short."""
    rules, path = set(), []
    for line in description.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not found:
            continue
        depth = len(found[1])
        path = [step for step in path if step[0] < depth] + [(depth, (names[int(found[2])], found[3], float(found[4])))]
        tight: dict[tuple[str, str], float] = {}
        for _, (name, sign, limit) in path:
            keep = min if sign == "<=" else max
            tight[name, sign] = keep(limit, tight.get((name, sign), limit))
        rules.add(frozenset((name, sign, limit) for (name, sign), limit in tight.items()))
    return rules


@dataclass
class RuleModel:
    """Score = logistic(bias + weights of the rules that hold)."""

    bias: float
    weights: list[tuple[Rule, float]]
    constant: float | None = None

    def score(self) -> Column:
        """Column expression over ``stats``."""
        if self.constant is not None:
            return F.lit(float(self.constant))
        total = F.lit(self.bias)
        for rule, weight in self.weights:
            total = total + F.when(condition(rule), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> RuleModel:
    """Learn from labelled rows of ``docs`` that are not held out.

    Labels other than 0 and 1 are left out, of several labels of an id the smallest counts, and rows
    with a null id take no part. Of repeated documents each counts. Texts are read whole; null and empty ones
    are learnt from like others. Without both kinds of labels, or without documents, the model is a
    constant: the share of label 1, or ``NO_LABELS``.
    """
    known = labels.select(F.col(key).alias("doc_id"), F.col("quality").alias("quality"))
    known = known.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    # At most ``sample`` rows, hence a bounded broadcast.
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(known), "doc_id")
    rows = with_statistics(picked, "doc_id", "text", F.col("label"))
    rows = checkpointed(rows.repartition(2, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("stats")))
    found = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(found) < 2:
        return RuleModel(0.0, [], constant=next(iter(found), NO_LABELS))

    names = list(statistics(F.lit("")))
    vector = lambda columns: array_to_vector(F.array(*columns)).alias("features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="0.5", minInstancesPerNode=3)
    trees = forest.fit(rows.select("label", vector([F.col(f"stats.{n}") for n in names])))
    rules = sorted(set().union(*[tree_rules(t.toDebugString, names) for t in trees.trees]), key=sorted)
    if not rules:
        return RuleModel(0.0, [], constant=found[1.0] / sum(found.values()))
    held = checkpointed(rows.select("label", vector([condition(r).cast("double") for r in rules])))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False).fit(held)
    weights = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w]
    return RuleModel(float(lasso.intercept), weights)


def score_documents(docs: DataFrame, model: RuleModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. Other columns are not read.

    A null text counts as empty; an empty one has a score as well. Texts are read whole, repeated rows get equal
    scores, and a null id is not held out. An empty table gives no rows.
    """
    rows = with_statistics(docs, key, text)
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: RuleModel, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that the model does not reject, with their columns as they are.

    Null and empty texts have statistics like any other and are judged by them; repeated rows are judged alike.
    Texts are read whole, however long. An empty table stays empty.
    """
    stats = F.struct(*[c.cast("double").alias(n) for n, c in statistics(F.col(text)).items()])
    # A row generator: the filter cannot be pushed below it, which would compute each statistic once per condition.
    rows = docs.select(F.struct("*").alias("row"), F.explode(F.array(stats)).alias("stats"))
    return rows.filter(model.score() >= THRESHOLD).select("row.*")
