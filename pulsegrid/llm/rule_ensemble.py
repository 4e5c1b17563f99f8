"""A sparse ensemble of rules that scores the quality of a text.

Statistics of the text are column expressions. Boosted trees are grown on a sample of labelled
documents; every path from a root is a rule (a conjunction of thresholds). A lasso logistic
regression over the rules keeps few of them, and these are compiled into one column expression,
so that scoring needs the statistics and nothing else.

Labels, language, source and ids are never inputs. Nulls count as empty texts, whose statistics are
all 0; they are scored by the same rules. Rows whose label is null, or whose id is null, teach nothing.
A document that occurs twice with a label teaches twice. Without labels, or with one kind only,
the score is the smoothed share of label 1 (0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_rules import BLANK, SPLIT, SYMBOLS, count_of
from .shared import cut, once

#: Rows of labels that are learnt from at most; those with the smallest hashes of their ids.
SAMPLE = 20_000


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` as a struct ``own``, and the statistics of each text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), text.alias("text")).select(
        "own", F.array_remove(F.split("text", SPLIT), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(BLANK)) != "").alias("lines")
    ).select("own", "words", "lines", F.array_join("words", "").alias("dense"))
    words, chars, lines = F.size("words"), F.char_length("dense"), F.size("lines")
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return once(
        rows, ["own"],
        words.cast("double").alias("n_words"),
        share(chars, words).alias("word_length"),
        share(words, lines).alias("line_words"),
        share(F.size(F.array_distinct("words")), words).alias("distinct_words"),
        share(F.size(F.array_distinct("lines")), lines).alias("distinct_lines"),
        share(count_of(F.col("dense"), SYMBOLS.replace("|", "")), chars).alias("symbols"),
        share(count_of(F.col("dense"), "|"), chars).alias("bars"),
        share(count_of(F.col("dense"), "!?"), chars).alias("shouts"),
        share(count_of(F.col("dense"), ".,;:"), chars).alias("stops"),
        share(count_of(F.col("dense"), letters), chars).alias("capitals"),
        share(count_of(F.col("dense"), "0123456789"), chars).alias("digits"),
        share(count_of(F.col("dense"), "()[]{}=_/\\@"), chars).alias("code_marks"),
    )


FEATURES = ["n_words", "word_length", "line_words", "distinct_words", "distinct_lines", "symbols", "bars", "shouts", "stops", "capitals", "digits", "code_marks"]


@dataclass(frozen=True)
class Rule:
    """A conjunction: for each feature, the value lies in (low, high]."""

    bounds: tuple[tuple[str, float | None, float | None], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            out = out & (F.col(name) > low) if low is not None else out
            out = out & (F.col(name) <= high) if high is not None else out
        return out

    def __str__(self) -> str:
        return " and ".join(" and ".join(x for x in (f"{n} > {lo:.6g}" if lo is not None else "", f"{n} <= {hi:.6g}" if hi is not None else "") if x) for n, lo, hi in self.bounds)


def paths(model) -> list[Rule]:
    """A rule for every node but the roots of a fitted ensemble."""
    found: dict[Rule, None] = {}

    def walk(node, bounds: dict[str, tuple[float | None, float | None]]) -> None:
        if bounds:
            found[Rule(tuple(sorted((n, *b) for n, b in bounds.items())))] = None
        if node.subtreeDepth() == 0:
            return
        name, at = FEATURES[node.split().featureIndex()], node.split().threshold()
        low, high = bounds.get(name, (None, None))
        walk(node.leftChild(), bounds | {name: (low, at if high is None else min(high, at))})
        walk(node.rightChild(), bounds | {name: (at if low is None else max(low, at), high)})

    for tree in model.trees:
        walk(tree._call_java("rootNode"), {})
    return list(found)


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    weights: tuple[tuple[Rule, float], ...] = ()

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, trees: int = 12, depth: int = 3, lasso: float = 0.002) -> Ensemble:
    """Learns from ``labels(doc_id, quality)`` of rows whose crc32(doc_id as text) mod 5 is not 0."""
    taught = (
        labels.where("doc_id is not null and quality is not null")
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
        .select("doc_id", F.col("quality").cast("double").alias("label"), F.xxhash64("doc_id").alias("h"))
        .orderBy("h", "doc_id", "label")
        .limit(sample)
        .select("doc_id", "label")
    )
    # at most ``sample`` rows of two numbers are broadcast; documents that repeat a labelled id add to the joined rows.
    # These are few numbers each, and shuffled, so that the scan and the statistics keep all their tasks; sorted after
    # that, as rows arrive in any order and trees of another order would be other trees
    joined = docs.select("doc_id", "text").join(F.broadcast(taught), "doc_id")
    rows = cut(statistics(joined).select("own.label", *FEATURES, array_to_vector(F.array(*FEATURES)).alias("features")).repartition(4).sortWithinPartitions("label", *FEATURES))
    kinds = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        import math

        good, all_ = kinds.get(1.0, 0), sum(kinds.values())
        return Ensemble(math.log((good + 1) / (all_ - good + 1)))
    grown = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, minInstancesPerNode=5, seed=7, maxMemoryInMB=64).fit(rows)
    rules = paths(grown)
    if not rules:
        import math

        return Ensemble(math.log((kinds.get(1.0, 0) + 1) / (kinds.get(0.0, 0) + 1)))
    held = cut(rows.select("label", array_to_vector(F.array(*(r.column().cast("double") for r in rules))).alias("features")))
    lr = LogisticRegression(elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=60).fit(held)
    return Ensemble(float(lr.intercept), tuple((r, float(w)) for r, w in zip(rules, lr.coefficients, strict=True) if w))


def scored(docs: DataFrame, ensemble: Ensemble) -> DataFrame:
    """``own`` (the columns of ``docs``) and ``score`` for every row."""
    return statistics(docs).select("own", ensemble.score().alias("score"))


def keep(docs: DataFrame, ensemble: Ensemble, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with their columns."""
    return scored(docs, ensemble).where(F.col("score") >= threshold).select(*(F.col(f"own.`{c}`").alias(c) for c in docs.columns))
