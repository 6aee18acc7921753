"""A quality classifier as a sparse ensemble of rules over text statistics.

A random forest is grown on labelled rows; every path from a root to a node is a rule, a conjunction of thresholds.
Logistic regression with a lasso penalty weighs the rules, most of them with nothing, and what is left is compiled
into one column expression, so that scoring is a projection over the documents. Trees and weights are fitted by
Spark's own learners, on a sample of at most MAX_LABELLED rows chosen by a hash of their ids.

Defined results: null and empty texts have all statistics zero and get a score like any text; labelled rows without a document, without
a label or with a null id teach nothing; with one class or none among the labels the score is the (smoothed) share of
ones; rows with the same id are scored each for itself; an empty table gives no rows; other columns are carried
whatever their names.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import WORD, materialize, whole_text

#: Labelled rows that are fitted to, at most: it bounds what is broadcast (an id and a label each) and the learners' work.
MAX_LABELLED = 20_000
TREES, DEPTH, LASSO, SEED = 12, 3, 0.001, 7
THRESHOLD = 0.3
#: Of this many parts of the ids by checksum, part 0 is held out.
FOLDS = 5

STATISTICS = ("log_chars", "log_words", "word_length", "upper", "digits", "symbols", "exclaims", "bars", "stops", "lines", "distinct_words", "repeated_neighbours")


def statistics(text: Column) -> Column:
    """An array of doubles in the order of STATISTICS; shares are by character or by word."""
    size = F.char_length(text)
    chars = F.greatest(size, F.lit(1)).cast("double")

    def share(characters: str) -> Column:
        return F.regexp_count(text, F.lit(f"[{characters}]")) / chars

    def by_word(words: Column) -> Column:
        n = F.size(words)
        many = F.greatest(n, F.lit(1)).cast("double")
        later = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
        same = F.size(F.filter(later, lambda i: F.get(words, i) == F.get(words, i - 1)))
        return F.array(
            F.ln(chars + 1) * (size > 0).cast("double"), F.ln(many + 1) * (n > 0).cast("double"), size / many,
            share("A-Z"), share("0-9"), share(r"#$%&*@\^~=<>{}\[\]\\_+/"), share("!"), share("|"), share(".,;:?"), share("\n"),
            F.size(F.array_distinct(words)) / many, same / many,
        )

    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    return F.transform(F.array(words), by_word)[0]


def in_held_out(ident: Column) -> Column:
    return F.crc32(F.coalesce(ident.cast("string"), F.lit(""))) % FOLDS == 0


@dataclass(frozen=True)
class Condition:
    statistic: int
    above: bool
    threshold: float

    def column(self, stats: Column) -> Column:
        value = F.get(stats, self.statistic)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def tree_rules(description: str) -> list[Rule]:
    """The rules of a forest, from its printed trees: one for every node but the roots."""
    found: dict[Rule, None] = {}
    path: list[Condition] = []
    for line in description.splitlines():
        step = re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if line.strip().startswith("Tree "):
            path, base = [], None
        elif step:
            indent = len(step[1])
            base = indent if base is None else base
            path = [*path[: indent - base], Condition(int(step[3]), step[4] == ">", float(step[5]))]
            found[tuple(path)] = None
    return list(found)


@dataclass(frozen=True)
class RuleModel:
    """intercept plus the weights of the rules that hold, through the logistic function."""

    intercept: float
    weights: tuple[tuple[float, Rule], ...] = ()

    def score(self, text: Column) -> Column:
        def value(stats: Column) -> Column:
            total = F.lit(self.intercept)
            for weight, rule in self.weights:
                total = total + F.when(_holds(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
            return 1 / (1 + F.exp(-total))

        return F.transform(F.array(statistics(text)), value)[0]  # bound, so that statistics are made once


def _holds(rule: Rule, stats: Column) -> Column:
    out = rule[0].column(stats)
    for condition in rule[1:]:
        out = out & condition.column(stats)
    return out


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> RuleModel:
    """Learns from the labelled rows that aren't held out."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~in_held_out(F.col(id_col))).select(F.col(id_col).alias("of"), F.col(label_col).cast("double").alias("label"))
    count = known.count()
    if count > max_labelled:
        known = known.orderBy(F.xxhash64("of")).limit(max_labelled)
    text = whole_text(docs, text_col)
    rows = docs.select(docs[id_col].alias("id"), text.alias("text")).join(F.broadcast(known), F.col("id") == F.col("of"))  # max_labelled rows
    taught = materialize(rows.select("label", statistics(F.col("text")).alias("stats")), "taught")
    ones, total = taught.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).first()
    if ones in (0, total):
        share = (ones + 1) / (total + 2)
        return RuleModel(math.log(share / (1 - share)))
    data = taught.select("label", "stats", array_to_vector("stats").alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.7, minInstancesPerNode=3).fit(data)
    rules = tree_rules(forest.toDebugString)
    if not rules:
        return RuleModel(math.log(ones / (total - ones)))
    hits = data.select("label", array_to_vector(F.array(*[_holds(r, F.col("stats")).cast("double") for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=100).fit(hits)
    weights = tuple((float(w), r) for w, r in zip(lasso.coefficients.toArray(), rules, strict=True) if w)
    return RuleModel(float(lasso.intercept), weights)


def scored(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = docs.select(docs[id_col].alias("doc_id"), in_held_out(docs[id_col]).alias("held_out"), model.score(whole_text(docs, text_col)).alias("score"))
    return rows.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't reject."""
    return docs.filter(model.score(whole_text(docs, text_col)) >= THRESHOLD)
