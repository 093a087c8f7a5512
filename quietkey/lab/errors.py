"""Error analysis of prediction frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def model_errors(frame: DataFrame, prediction: str, kind: str) -> DataFrame:
    """Rows of one error kind: ``false_positive`` or ``false_negative``."""
    wanted = {"false_positive": (0, 1), "false_negative": (1, 0)}
    if kind not in wanted:
        raise ValueError("kind must be 'false_positive' or 'false_negative'.")
    label, predicted = wanted[kind]
    return frame.where((F.col("label") == label) & (F.col(prediction) == predicted))


def error_split(frame: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Add ``cell``: TP, FP, TN or FN."""
    right = F.col("label") == F.col(prediction)
    positive = F.col(prediction) == 1
    return frame.withColumn(
        "cell",
        F.concat(
            F.when(right, F.lit("T")).otherwise(F.lit("F")),
            F.when(positive, F.lit("P")).otherwise(F.lit("N")),
        ),
    )


def text_fixed_secrets(frame: DataFrame) -> DataFrame:
    """Secrets the numeric model missed and the text model found."""
    return frame.where(
        (F.col("label") == 1)
        & (F.col("numerical_prediction") == 0)
        & (F.col("text_prediction") == 1)
    )


def numeric_fixed_safe(frame: DataFrame) -> DataFrame:
    """Safe samples only the text model flagged."""
    return frame.where(
        (F.col("label") == 0)
        & (F.col("text_prediction") == 1)
        & (F.col("numerical_prediction") == 0)
    )


def value_counts(frame: DataFrame, column: str = "sample_type") -> DataFrame:
    """Frequencies, most frequent first, names break ties."""
    return frame.groupBy(column).count().orderBy(F.desc("count"), column)


def agreement_summary(
    frame: DataFrame, first: str = "numerical", second: str = "text"
) -> DataFrame:
    """How often both, one or none of two models are right."""
    a = F.col(f"{first}_prediction") == F.col("label")
    b = F.col(f"{second}_prediction") == F.col("label")
    return frame.agg(
        F.count_if(a & b).alias("both_correct"),
        F.count_if(~a & ~b).alias("both_wrong"),
        F.count_if(a & ~b).alias(f"{first}_only_correct"),
        F.count_if(~a & b).alias(f"{second}_only_correct"),
    )


def outcome(first_right: Column, second_right: Column, first: str, second: str) -> Column:
    return (
        F.when(first_right & second_right, F.lit("both_correct"))
        .when(first_right, F.lit(f"{first}_only_correct"))
        .when(second_right, F.lit(f"{second}_only_correct"))
        .otherwise(F.lit("both_wrong"))
    )


def complementarity(context: DataFrame, text: DataFrame, key: str = "sample_id") -> DataFrame:
    """Align two prediction frames and label every sample with its outcome.

    Frames must cover the same samples with the same labels; a full outer join makes
    any difference an error instead of a lost row.
    """
    left = context.withColumn("_left", F.lit(True))
    right = text.select(
        key,
        F.col("label").alias("_label"),
        "text_prediction",
        "text_probability",
    )
    joined = left.join(right, key, "full_outer")
    unequal = F.col("_left").isNull() | F.col("_label").isNull()
    checked = (
        F.when(unequal, F.raise_error(F.lit("Prediction frames must cover the same samples.")))
        .when(
            F.col("label") != F.col("_label"),
            F.raise_error(F.lit("Prediction frames must contain identical labels.")),
        )
        .otherwise(F.col("label"))
        .cast("int")
    )
    context_right = F.col("context_prediction") == F.col("label")
    text_right = F.col("text_prediction") == F.col("label")
    return (
        joined.withColumn("label", checked)
        .withColumns(
            {
                "context_correct": context_right,
                "text_correct": text_right,
                "outcome": outcome(context_right, text_right, "context", "text"),
            }
        )
        .drop("_left", "_label")
    )


def worst_errors(frame: DataFrame, prediction: str, probability: str, kind: str, top: int = 20) -> DataFrame:
    """The errors the model was surest about."""
    order = F.desc(probability) if kind == "false_positive" else F.asc(probability)
    return model_errors(frame, prediction, kind).orderBy(order, "sample_id").limit(top)


def ranked_coefficients(spark, names: Sequence[str], values: Sequence[float]) -> DataFrame:
    """Named coefficients by absolute size; the list is as short as the feature list."""
    rows = [(n, float(v), abs(float(v))) for n, v in zip(names, values, strict=True)]
    schema = "feature string, coefficient double, absolute_coefficient double"
    return spark.createDataFrame(rows, schema).orderBy(F.desc("absolute_coefficient"))
