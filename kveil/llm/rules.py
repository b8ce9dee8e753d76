"""A quality classifier as a sparse ensemble of rules, scored by plain column expressions.

Shallow trees are grown over statistics of the text; every path from a root to a node below it becomes one
rule, a conjunction of bounds on statistics. A lasso logistic regression on the rules' truth
values then keeps a few dozen of them. The model is those rules with their weights, compiled into one Spark
expression, so scoring is a projection without Python and without a shuffle.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kveil.llm.common import col, let, table, words_of
from kveil.session import cut_lineage

TRAIN_ROWS = 20_000  # labelled rows that a fit draws, by a hash of their id
TREES = 16
DEPTH = 3
LASSO = 0.0005
SEED = 13
S = "__r_"  # columns of statistics


def stat(name: str) -> Column:
    return F.col(S + name)


def characters(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")


def repeats(words: Column) -> Column:
    """Words equal to the one before."""
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: a == b)
    return F.size(F.filter(pairs, lambda same: F.coalesce(same, F.lit(False)))).cast("double")


def statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with one double per statistic of the whole text, ``__r_<name>``; all are 0 for a text without words."""
    text = F.coalesce(col(text_col), F.lit(""))
    words, chars, n = F.col(S + "words"), F.greatest(F.length(text), F.lit(1)), F.greatest(F.size(S + "words"), F.lit(1))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_copies = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))) / F.greatest(F.size(x), F.lit(1)))
    longest = F.coalesce(F.array_max(F.transform(words, lambda w: F.length(w))), F.lit(0))
    # ASCII without lower case and spaces: short, so that counting in it is cheap
    rare = F.col(S + "rare")
    out = df.withColumns({S + "words": words_of(col(text_col)), S + "rare": F.regexp_replace(text, r"[^\x21-\x5A|]+", "")})
    out = out.withColumns(
        {
            S + "words_log": F.log1p(F.size(words).cast("double")),
            S + "word_length": F.length(F.array_join(words, "")) / n,
            S + "longest": F.log1p(longest.cast("double")),
            S + "symbols": characters(rare, "[#*$%&|<>]+") / chars,
            S + "bangs": characters(rare, "[!?]+") / n,
            S + "upper": characters(rare, "[A-Z]+") / chars,
            S + "digits": characters(rare, "[0-9]+") / chars,
            S + "marks": characters(rare, "[.,;:]+") / n,
            S + "distinct": F.size(F.array_distinct(words)) / n,
            S + "repeats": repeats(words) / n,
            S + "line_copies": line_copies,
            S + "lines": F.size(F.split(text, "\n")) / n,
        }
    )
    return out.drop(S + "words", S + "rare")


STATISTICS = "words_log word_length longest symbols bangs upper digits marks distinct repeats line_copies lines".split()

# A rule: per statistic the half-open interval (low, high] it must lie in.
Rule = tuple[tuple[str, float, float], ...]


def rule_column(rule: Rule) -> Column:
    tests = []
    for name, low, high in rule:
        if low > -math.inf:
            tests.append(stat(name) > low)
        if high < math.inf:
            tests.append(stat(name) <= high)
    return reduce(lambda a, b: a & b, tests)


def tree_rules(tree: str, names: list[str]) -> list[Rule]:
    """The paths of a tree, given as Spark ML prints it: one rule per node below the root."""
    rules, path = [], []
    for line in tree.splitlines():
        found = re.match(r"( +)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if not found:
            continue
        del path[len(found[1]) - 2 :]
        path.append((names[int(found[2])], found[3], float(found[4])))
        bounds: dict[str, tuple[float, float]] = {}
        for name, side, at in path:
            low, high = bounds.get(name, (-math.inf, math.inf))
            bounds[name] = (low, min(high, at)) if side == "<=" else (max(low, at), high)
        rules.append(tuple((name, *bounds[name]) for name in sorted(bounds)))
    return rules


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules and an intercept, on the logistic scale."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...] = ()

    def score(self) -> Column:
        """Probability of label 1 as an expression over the statistics."""
        terms = [F.when(rule_column(rule), weight).otherwise(0.0) for rule, weight in self.rules]
        return 1.0 / (1.0 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.intercept))))

    def told(self) -> list[str]:
        """The rules in words, the weightiest first."""

        def one(rule: Rule) -> str:
            return " and ".join(f"{low:.4g} < {name} <= {high:.4g}" for name, low, high in rule)

        return [f"{w:+.3f} if {one(r)}" for r, w in sorted(self.rules, key=lambda x: -abs(x[1]))]


def constant(good: int, rows: int) -> RuleModel:
    share = (good + 0.5) / (rows + 1)
    return RuleModel(math.log(share / (1 - share)))


def fit_rules(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = SEED) -> RuleModel:
    """A model from ``rows``: the statistics and ``label``, 0 or 1. Equal rows count once.

    Without rows of both labels the model is the share of label 1 alone, a half without any rows.
    """
    vector = array_to_vector(F.array(*(stat(n) for n in STATISTICS)))
    rows = rows.select("label", *(S + n for n in STATISTICS)).distinct()
    order = [F.xxhash64(*(S + n for n in STATISTICS)), "label"]  # trees draw rows by their place
    rows = cut_lineage(rows.repartitionByRange(4, *order).sortWithinPartitions(*order))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good")).first()
    if not seen.n or seen.good in (0, seen.n):
        return constant(seen.good or 0, seen.n)
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, maxBins=64, seed=seed, featureSubsetStrategy="onethird", subsamplingRate=0.7
    )
    grown = forest.fit(rows.select(F.col("label").cast("double").alias("label"), vector.alias("features")))
    found = {r for t in grown.trees for r in tree_rules(t.toDebugString, STATISTICS)}
    rules = sorted(found)
    if not rules:
        return constant(seen.good, seen.n)
    truth = array_to_vector(F.array(*(rule_column(r).cast("double") for r in rules)))
    lasso_fit = LogisticRegression(regParam=lasso, elasticNetParam=1.0, maxIter=40, tol=1e-3, standardization=False)
    fitted = lasso_fit.fit(rows.select(F.col("label").cast("double").alias("label"), truth.alias("features")))
    weights = zip(rules, fitted.coefficients.toArray().tolist())
    return RuleModel(fitted.intercept, tuple((r, w) for r, w in weights if w != 0.0))


def labelled(docs: DataFrame, labels: DataFrame, train: Column, most: int = TRAIN_ROWS) -> DataFrame:
    """(statistics, label) of about ``most`` rows of ``docs`` (doc_id, text) at most that have a label and meet ``train``.

    Labels are drawn by a hash of their id, so the draw is the same whatever the partitions. Of several labels
    of an id the least counts; null labels and others than 0 and 1 do not.
    """
    known = labels.filter(train & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"))
    share = min(1.0, most / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30)))
    return statistics(docs.join(F.broadcast(drawn), "doc_id").select("text", "label")).drop("text")


def classify(docs: DataFrame, model: RuleModel, text_col: str = "text", least: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``least`` on), judged row by row.

    A null or empty text is scored by its statistics, all 0. Columns of these two names are replaced, the others stay;
    an empty table gives an empty one.
    """
    # in a struct the columns keep clear of the names used here
    held = docs.select(F.struct(*(col(c) for c in docs.columns)).alias("row"), col(text_col).alias("text"))
    scored = statistics(held).withColumn(S + "score", model.score())
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("score", "predicted")]
    return scored.select(*own, stat("score").alias("score"), (stat("score") >= least).cast("int").alias("predicted"))


def op13_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = fit_rules(labelled(docs, labels, ~held))
    scored = classify(docs, model)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")
