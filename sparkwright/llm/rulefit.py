"""Quality classifier: a sparse ensemble of rules over text statistics.

A forest of shallow trees is grown on statistics of labelled texts. Every path
from a root to a node is a conjunctive rule; a lasso logistic regression over
all rules keeps few of them with a weight. The kept rules are compiled into one
Spark column, so scoring a corpus is a projection without Python and without
a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import save_intermediate
from .common import crc_of_id, let, words_of

MAX_SAMPLE = 20_000     # labelled rows that the trees and the lasso see at most (about; picked by a hash of the id)
TREES, DEPTH, BINS = 24, 3, 64
LASSO = 0.001
KEEP_FROM = 0.3         # predicted 1 from this score on (fixed by the query's contract)
HELD_OUT = 5

SYMBOLS = "[#*$%&|<>]"


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def statistics(text: Column) -> Column:
    """Statistics of a whole text as one struct of doubles; a null or empty text has zeros."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def measured(w: Column, line: Column, chars: Column) -> Column:
        n = F.size(w)
        values = {
            "words": n,
            "word_chars": _share(chars, n),
            "longest_word": F.aggregate(w, F.lit(0), lambda a, x: F.greatest(a, F.length(x))),
            "distinct_words": _share(F.size(F.array_distinct(w)), n),
            "same_as_before": _share(F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))), n),
            "symbols": _share(F.regexp_count(t, F.lit(SYMBOLS)), chars),
            "digits": _share(F.regexp_count(t, F.lit("[0-9]")), chars),
            "capitals": _share(F.regexp_count(t, F.lit("[A-Z]")), chars),
            "stops": _share(_count(t, "."), n),
            "commas": _share(_count(t, ","), n),
            "exclamations": _share(_count(t, "!") + _count(t, "?"), n),
            "single_chars": _share(F.size(F.filter(w, lambda x: F.length(x) == 1)), n),
            "line_words": _share(n, F.size(line)),
            "repeated_lines": _share(F.size(line) - F.size(F.array_distinct(line)), F.size(line)),
        }
        return F.struct(*[v.cast("double").alias(k) for k, v in values.items()])

    # Inside a lambda nothing is shared unless bound: words, lines and their characters are counted once.
    return let(words_of(text), lambda w: let(lines, lambda line: let(F.length(F.array_join(w, "")), lambda c: measured(w, line, c))))


NAMES = ("words", "word_chars", "longest_word", "distinct_words", "same_as_before", "symbols", "digits", "capitals",
         "stops", "commas", "exclamations", "single_chars", "line_words", "repeated_lines")


@dataclass(frozen=True, order=True)
class Rule:
    """Holds where every statistic is inside its bounds: ``above < value <= upto``."""

    bounds: tuple[tuple[str, float, float], ...]

    def holds(self, s: Column) -> Column:
        test = F.lit(True)
        for name, above, upto in self.bounds:
            if above > -math.inf:
                test = test & (s[name] > above)
            if upto < math.inf:
                test = test & (s[name] <= upto)
        return test

    def __str__(self) -> str:
        return " and ".join(f"{a:g} < {n} <= {b:g}" for n, a, b in self.bounds)


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules; ``score`` is the probability of label 1."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...] = ()

    def score(self, s: Column) -> Column:
        margin = F.lit(self.intercept)
        for rule, weight in self.rules:
            margin = margin + F.when(rule.holds(s), F.lit(weight)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def tree_rules(forest, names: tuple[str, ...] = NAMES) -> list[Rule]:
    """Every path from a root to a node of a fitted forest, once each, in a fixed order."""
    found = set()

    def walk(node, bounds: dict) -> None:
        if bounds:
            found.add(Rule(tuple(sorted((n, a, b) for n, (a, b) in bounds.items()))))
        if node.subtreeDepth() == 0:
            return
        split = node.split()
        name, at = names[split.featureIndex()], split.threshold()
        above, upto = bounds.get(name, (-math.inf, math.inf))
        walk(node.leftChild(), {**bounds, name: (above, min(upto, at))})
        walk(node.rightChild(), {**bounds, name: (max(above, at), upto)})

    for tree in forest.trees:
        walk(tree._java_obj.rootNode(), {})
    return sorted(found)


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
           most: int = MAX_SAMPLE) -> DataFrame:
    """(label, statistics) of about ``most`` labelled documents that are not
    held out, or of all if they are fewer. Ids labelled both ways or null say nothing."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(
        F.min(label).cast("double").alias("label"), F.max(label).cast("double").alias("other"))
    marks = marks.where((F.col("label") == F.col("other")) & (F.pmod(crc_of_id("id"), F.lit(HELD_OUT)) != 0)).select("id", "label")
    n = marks.count()
    if n > most:
        marks = marks.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < math.ceil(1e6 * most / n))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(marks, "id").select("label", statistics(F.col("text")).alias("s")).select("label", "s.*")


def fit(labelled: DataFrame, seed: int = 5) -> Ensemble:
    """Rules and weights from rows of (label, statistics). With one label only,
    or none, the score is the same for all: the labels' smoothed share."""
    labelled = save_intermediate(labelled, "rulefit")
    n = {r.label: r.n for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = n.get(1.0, 0), n.get(0.0, 0)
    if not ones or not zeros:
        return Ensemble(math.log((ones + 1) / (zeros + 1)))
    points = labelled.select("label", array_to_vector(F.array(*NAMES)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=BINS, featureSubsetStrategy="onethird", seed=seed).fit(points)
    rules = tree_rules(forest)
    if not rules:
        return Ensemble(math.log(ones / zeros))
    row = F.struct(*[F.col(c) for c in NAMES])
    held = labelled.select("label", row.alias("s")).select(
        "label", array_to_vector(F.array(*[r.holds(F.col("s")).cast("double") for r in rules])).alias("features"))
    held = save_intermediate(held, "rules")
    lasso = LogisticRegression(regParam=LASSO, elasticNetParam=1.0, standardization=False, maxIter=200).fit(held)
    weights = lasso.coefficients.toArray()
    return Ensemble(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(rules, weights) if w))


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted of every row of ``docs``.

    The ensemble is fitted on at most about ``MAX_SAMPLE`` labelled rows that are not
    held out (CRC-32 of the id as text, mod 5, is not 0); scoring reads every
    whole text, row by row. Null and empty texts have zero statistics and a
    score like any other; a null id stays null and counts as held out (CRC-32
    of the empty text is 0); repeated rows get equal scores; without usable
    labels all scores are equal; an empty table gives no rows; other columns
    are not read.
    """
    model = fit(sample(docs, labels, label, id_col, text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), let(statistics(F.col(text_col)), model.score).alias("score"))
    return rows.select("doc_id", (F.pmod(crc_of_id(), F.lit(HELD_OUT)) == 0).alias("held_out"), "score",
                       (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))
