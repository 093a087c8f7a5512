"""Binary classification metrics as distributed aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONFUSION = ("true_negatives", "false_positives", "false_negatives", "true_positives")
RATES = ("accuracy", "precision", "recall", "f1")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator), F.lit(0.0))


def confusion_counts(label: Column, prediction: Column) -> list[Column]:
    """The four confusion counts."""

    def count(actual: int, predicted: int) -> Column:
        return F.count_if((label == actual) & (prediction == predicted))

    return [
        count(0, 0).alias("true_negatives"),
        count(0, 1).alias("false_positives"),
        count(1, 0).alias("false_negatives"),
        count(1, 1).alias("true_positives"),
    ]


def rate_columns() -> list[Column]:
    """Accuracy, precision, recall and F1 from the four counts."""
    tn, fp, fn, tp = (F.col(c) for c in CONFUSION)
    return [
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def tied_scores(frame: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score (and ``by`` group)."""
    return frame.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum((F.col(label) == 1).cast("bigint")).alias("pos"),
        F.sum((F.col(label) == 0).cast("bigint")).alias("neg"),
    )


def _exact(a: Column, b: Column) -> Column:
    """The product of two counts as a whole number of up to 38 digits."""
    return a.cast("decimal(18,0)") * b.cast("decimal(19,0)")


def auc_of_ties(tied: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve, ties counted half, per ``by`` group.

    The distinct scores are dealt to sorted ranges, as many as the session shuffles to; every
    range is ranked on its own, and only the totals of ranges are accumulated in one place.
    ``by`` must name few groups, such as the weights of a grid.
    """
    keys = list(by) or ["_all"]
    if not by:
        tied = tied.withColumn("_all", F.lit(1))
    ranged = tied.repartitionByRange(*by, "score").withColumn("part", F.spark_partition_id())
    up_to_here = (Window.unboundedPreceding, -1)
    within = Window.partitionBy(*keys, "part").orderBy("score").rowsBetween(*up_to_here)
    below = F.coalesce(F.sum("neg").over(within), F.lit(0))
    parts = (
        # Twice the wins, in whole numbers: sums don't depend on their order.
        ranged.withColumn("wins", _exact(F.col("pos"), 2 * below + F.col("neg")))
        .groupBy(*keys, "part")
        .agg(F.sum("wins").alias("wins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    across = Window.partitionBy(*keys).orderBy("part").rowsBetween(*up_to_here)
    lower = F.coalesce(F.sum("neg").over(across), F.lit(0))
    pairs = 2 * F.sum("pos").cast("double") * F.sum("neg").cast("double")
    total = (
        parts.withColumn("wins", F.col("wins") + _exact(F.col("pos"), 2 * lower))
        .groupBy(*keys)
        .agg(F.try_divide(F.sum("wins").cast("double"), pairs).alias("roc_auc"))
    )
    return total if by else total.drop("_all")


def roc_auc(frame: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return auc_of_ties(tied_scores(frame, label, score, by), by)


def calculate_metrics(
    frame: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    probability: str | None = None,
    model_name: str | None = None,
) -> DataFrame:
    """One row: confusion counts, rates, sample count and, with a probability, the AUC."""
    counted = frame.agg(
        F.count("*").alias("samples"), *confusion_counts(F.col(label), F.col(prediction))
    ).select("samples", *CONFUSION, *rate_columns())
    if probability is not None:
        area = roc_auc(frame, label, probability).scalar()
        counted = counted.withColumn("roc_auc", area)
    if model_name is not None:
        counted = counted.select(F.lit(model_name).alias("model_name"), "*")
    return counted
