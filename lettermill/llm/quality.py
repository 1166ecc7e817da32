"""Text quality by a sparse ensemble of rules.

Shallow trees are grown on statistics of whole texts; every path from a root becomes one rule,
a conjunction of thresholds. A lasso logistic regression gives most rules weight zero; the rest
are compiled into one column expression, so scoring is a single pass without Python.

A model is fitted on at most about ``max_rows`` labelled rows, chosen by a hash of their id; that
bound is the only thing that doesn't grow. Everything else reads whole texts of all rows.

Defined results: a null text is empty, and statistics of an empty text are 0; a label other than 0
or 1 and a label without its document teach nothing; a document labelled twice counts twice; without
labels of both kinds the score is the share of good ones (0.5 without labels); a null id counts as
the empty text when folds are dealt; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.tables import written

MAX_ROWS, TREES, DEPTH, PENALTY, THRESHOLD = 20_000, 24, 3, 0.003, 0.7


def statistics(text: Column) -> dict[str, Column]:
    """Numbers about one text, none of them tied to a language. ``text`` must be a plain column."""
    def length(without: str) -> Column:
        return F.length(F.regexp_replace(text, without, "")).cast("double")

    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    words, lines = F.col("_words"), F.col("_lines")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    n_lines = F.greatest(F.size(lines), F.lit(1)).cast("double")
    # One fold: an array that a lambda names once more may be built once more for every word.
    repeated = F.aggregate(words, F.struct(F.lit("").alias("last"), F.lit(0).alias("n")), lambda found, w: F.struct(
        w.alias("last"), (found["n"] + (w == found["last"]).cast("int")).alias("n")), lambda found: found["n"])
    return {
        "log_words": F.log1p(F.size(words).cast("double")),
        "word_length": F.length(text) / n_words,
        "upper_share": length(r"[^\p{Lu}]+") / chars,
        "digit_share": length(r"[^0-9]+") / chars,
        "mark_share": length(r"[\p{L}\p{N}\s]+") / chars,
        "symbol_share": length(r"[\p{L}\p{N}\s.,;:!?'\"()-]+") / chars,
        "loud_share": length(r"[^!]+") / chars,
        "pipe_share": length(r"[^|]+") / chars,
        "repeat_share": repeated / n_words,
        "distinct_share": F.size(F.array_distinct(words)) / n_words,
        "line_words": F.size(words) / n_lines,
        "same_lines": (F.size(lines) - F.size(F.array_distinct(lines))) / n_lines,
    }


def with_statistics(df: DataFrame, text: str) -> DataFrame:
    """``df`` with its text columns replaced by one number per statistic."""
    plain = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    split = plain.withColumn("_words", F.filter(F.split(F.lower("_text"), r"\s+"), lambda w: w != "")).withColumn(
        "_lines", F.filter(F.split("_text", "\n"), lambda line: line != ""))
    return split.select(*(c for c in df.columns if c != text), *(c.alias(f"s_{n}") for n, c in statistics(F.col("_text")).items()))


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, at most?, threshold) that hold together, and their weight."""
    conditions: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        found = F.lit(True)
        for name, below, threshold in self.conditions:
            found = found & (F.col(f"s_{name}") <= threshold if below else F.col(f"s_{name}") > threshold)
        return found


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule in self.rules:
            total = total + F.when(rule.column(), F.lit(rule.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def tree_rules(node, names: list[str], path: tuple = ()) -> list[tuple]:
    """The condition lists of all nodes under a tree's root."""
    found = [path] if path else []
    if node.subtreeDepth() > 0:
        split = node.split()
        name, threshold = names[split.featureIndex()], float(split.threshold())
        found += tree_rules(node.leftChild(), names, (*path, (name, True, threshold)))
        found += tree_rules(node.rightChild(), names, (*path, (name, False, threshold)))
    return found


def fit(rows: DataFrame, label: str = "label", trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Model:
    """Fit rules and weights on ``rows`` with statistics and a 0/1 ``label``; a bounded table."""
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    if len(counts) < 2:
        return Model(_logit(sum(counts) / len(counts)) if counts else 0.0, ())
    names = [c[2:] for c in rows.columns if c.startswith("s_")]
    table = VectorAssembler(inputCols=[f"s_{n}" for n in names], outputCol="features").transform(rows)
    forest = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, maxBins=64, seed=7,
                                    featureSubsetStrategy="onethird").fit(table.select("features", label))
    paths = sorted({path for tree in forest.trees for path in tree_rules(tree._call_java("rootNode"), names)})
    rules = [Rule(p) for p in paths]
    if not rules:
        share = counts.get(1, 0) / sum(counts.values())
        return Model(_logit(share), ())
    held = rows.select(label, F.array(*(r.column().cast("double") for r in rules)).alias("held"))
    lasso = LogisticRegression(labelCol=label, elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(
        held.select(label, array_to_vector("held").alias("features")))
    weighted = [Rule(r.conditions, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w]
    return Model(float(lasso.intercept), tuple(weighted))


def _logit(share: float) -> float:
    share = min(max(share, 1e-4), 1 - 1e-4)
    return math.log(share / (1 - share))


def fold(key: Column, folds: int = 4) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(folds))


def train_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality",
                  max_rows: int = MAX_ROWS, held_out_fold: int = 2) -> Model:
    """Learn from labelled documents outside the held-out fold, at most about ``max_rows`` of them."""
    usable = labels.filter(F.col(quality).isin(0, 1) & F.col(key).isNotNull() & (fold(F.col(key)) != held_out_fold)).select(
        F.col(key).alias("id"), F.col(quality).cast("double").alias("label"))
    n = usable.count()
    if n > max_rows:
        place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
        usable = usable.filter(place < max_rows / n)
    # At most about max_rows narrow rows are broadcast.
    chosen = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(usable), "id")
    # The scan keeps its tasks; the few numbers that are left are dealt out by id, so that a rerun trains alike.
    table = with_statistics(chosen, "text").repartition(8, "id").sortWithinPartitions("id", "label")
    return fit(written(table))


def score_quality(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` for every row, in one pass."""
    scored = with_statistics(docs.select(F.col(key).alias(key), F.col(text).alias("text")), "text").select(
        key, (fold(F.col(key)) == 2).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, columns as they are, whose text is predicted to be good; all rows if the model has no rules."""
    if not model.rules:
        return docs
    kept = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    # A filter on a plain column would be pushed below the statistics, which every rule would then work out anew;
    # it can't pass the generator.
    scored = with_statistics(kept, "text").select("row", F.explode(F.array(model.score())).alias("score"))
    return scored.filter(F.col("score") >= threshold).select("row.*")
