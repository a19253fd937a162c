"""Text classification and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shared import cut
from tidemark.functions.stats import spearman
from tidemark.operators.regression import Fitted, balanced, fit, fit_packed, predict_packed
from tidemark.operators.text import STOP_WORDS, terms, vocabulary, weigh
from tidemark.operators.tfidf import Packed, pack_groups

#: Characters of a chunk and of the texts whose terms a part has: each evaluation sends a chunk's distinct terms, fewer a character where chunks are large.
CHARS, PART_CHARS = 1 << 22, 1 << 23


def build_labelled(docs: DataFrame, top: DataFrame, split_year: int = 2021, other: str = "Other") -> DataFrame:
    """H1: documents with a real label: the label or `other`, and the split: train before split_year, test from it on."""
    known = F.broadcast(top.select("label", F.lit(True).alias("__top")))  # top-k rows
    out = docs.where(F.col("label").isNotNull() & ~F.col("generic")).join(known, "label", "left")
    return out.select("id", "cleaned", F.col("label").alias("raw_label"), F.when(F.col("__top"), F.col("label")).otherwise(other).alias("label"), "year", F.when(F.col("year") < split_year, "train").otherwise("test").alias("split"))


def class_distribution(labelled: DataFrame) -> DataFrame:
    """H2."""
    return labelled.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


def unseen_classes(labelled: DataFrame) -> DataFrame:
    """H3: labels of the test split that train lacks."""
    return labelled.where("split = 'test'").select("label").distinct().join(labelled.where("split = 'train'").select("label"), "label", "left_anti")


def tfidf_train_only(train: DataFrame, other: DataFrame, min_df: int = 3, max_df: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """H4: weights of train and of other documents, with the vocabulary and idf of train alone."""
    a, b = (terms(d.withColumn("grp", F.lit(0)).select("grp", "id", "cleaned")) for d in (train, other))
    a = cut(a, "terms")  # read twice, counted once
    sizes = train.agg(F.count_distinct("id").alias("n_docs")).withColumn("grp", F.lit(0))
    vocab = vocabulary(a, sizes, min_df, max_df)
    return weigh(a, vocab).drop("grp"), weigh(b, vocab).drop("grp")


def fit_classifier(weights: DataFrame, train: DataFrame, tolerance: float = 1e-4, max_steps: int = 200) -> Fitted:
    """H5: multinomial logistic regression on H4's weights of train, with balanced label weights and C = 1; see regression.fit().

    Columns used of train: id, label. No term of the weights is left out.
    """
    return fit(weights, balanced(train.select("id", "label")), 1.0, tolerance, max_steps)


def classify(train: DataFrame, other: DataFrame, min_df: int = 3, max_df: float = 0.5) -> DataFrame:
    """other (id, cleaned and more) with predicted: H4's weights of both, packed in chunks, and H5's model of train (id, cleaned, label)."""
    both = train.select("id", "cleaned", F.lit(True).alias("known")).unionByName(other.select("id", "cleaned", F.lit(False).alias("known")))
    weights = pack_groups(both.withColumn("grp", F.lit(0)), max(1, min_df), max_df, 0, "cleaned", STOP_WORDS, CHARS, PART_CHARS, "known")
    model = fit_packed(Packed(weights.matrix.where("chunk % 2 = 0"), weights.vocabulary), balanced(train.select("id", "label")), 1.0, 1e-4)
    found = predict_packed(Packed(weights.matrix.where("chunk % 2 = 1"), weights.vocabulary), model)
    return other.join(found.dropDuplicates(["id"]), "id", "left")


def _cells(predicted: DataFrame, by: list[str]) -> DataFrame:
    """tp, support and guesses per label of truth or prediction."""
    truth = predicted.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col("label") == F.col("predicted")).alias("tp"))
    guess = predicted.groupBy(*by, F.col("predicted").alias("label")).agg(F.count(F.lit(1)).alias("guesses"))
    return truth.join(guess, [*by, "label"], "full").fillna(0, ["support", "tp", "guesses"])


def per_class_report(predicted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """H7: precision, recall, f1 and support per label; 0 / 0 is 0."""
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    out = _cells(predicted, by or []).withColumns({"precision": ratio(F.col("tp"), F.col("guesses")), "recall": ratio(F.col("tp"), F.col("support")), "f1": ratio(2.0 * F.col("tp"), F.col("support") + F.col("guesses"))})
    return out.select(*(by or []), "label", "precision", "recall", "f1", "support")


def scores(predicted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """H6, H8: n, accuracy and macro-F1 over the labels of truth or prediction, in all or per group (such as the year)."""
    by = by or []
    report = per_class_report(predicted, by)
    return report.groupBy(*by).agg(F.sum("support").alias("n"), (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"))


def confusion(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """H9: counts over the full grid of labels (label), zeros kept."""
    grid = labels.select("label").distinct().crossJoin(labels.select(F.col("label").alias("predicted")).distinct())  # the label set squared
    counts = predicted.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["label", "predicted"], "left").fillna(0, ["n"])


def confused_pairs(cells: DataFrame, edges: DataFrame, known: DataFrame, n: int | None = 15, other: str = "Other") -> DataFrame:
    """Unordered pairs of labels with the errors in both directions and their network weight: 0 without an edge, NULL for labels unknown to the network."""
    wrong = cells.where((F.col("label") != F.col("predicted")) & (F.col("label") != other) & (F.col("predicted") != other))
    pairs = wrong.groupBy(F.least("label", "predicted").alias("src"), F.greatest("label", "predicted").alias("dst")).agg(F.sum("n").alias("errors"))
    k = known.select("label").distinct()
    out = pairs.join(edges, ["src", "dst"], "left").join(k.select(F.col("label").alias("src"), F.lit(True).alias("__s")), "src", "left").join(k.select(F.col("label").alias("dst"), F.lit(True).alias("__d")), "dst", "left")
    out = out.select("src", "dst", "errors", F.when(F.col("__s") & F.col("__d"), F.coalesce("weight", F.lit(0))).alias("weight"))
    return out if n is None else out.orderBy(F.desc("errors"), "src", "dst").limit(n)


def confusion_vs_network(pairs: DataFrame) -> DataFrame:
    """Spearman correlation of errors and network weight over pairs with errors."""
    return spearman(pairs.where("errors > 0"), "errors", "weight")
