"""Exploratory profile of labelled candidate tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietkey.functions.features import CONTEXT_FLAGS, NUMERIC_FEATURES, context_flags
from quietkey.lab.metrics import ratio

BASE_COLUMNS = (
    "sample_id", "variable_name", "value", "label", "sample_type", "framework", "source",
    *NUMERIC_FEATURES,
)
V3_COLUMNS = (
    "sample_id", "variable_name", "value", "label", "sample_type", "source",
    "has_sensitive_name", *CONTEXT_FLAGS,
)
# Flags whose presence in both classes is checked.
OVERLAP_FLAGS = (
    "looks_like_uuid", "looks_like_fixed_hash", "is_hex_only", "looks_like_jwt",
    "looks_like_passphrase", "has_public_frontend_prefix",
)


def _identity(*columns: str) -> list[Column]:
    """128 bits of a hash of the columns; nulls count as values."""
    marked = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(half), *marked).alias(f"h{half}") for half in (1, 2)]


def validate_dataset(
    frame: DataFrame, required: Sequence[str] = BASE_COLUMNS, strict_labels: bool = False
) -> DataFrame:
    """One row of structural checks. ``strict_labels`` wants both labels present.

    Every row becomes up to three narrow rows (kind, hash), which combine before the one
    shuffle; what else is counted rides on the first kind.
    """
    columns = frame.columns
    missing = sorted(set(required) - set(columns))
    label = F.col("label") if "label" in columns else F.lit(0)
    measures = {
        "nulls": sum((F.col(c).isNull().cast("bigint") for c in columns), F.lit(0).cast("bigint")),
        "bad": (label.isNull() | ~label.isin(0, 1)).cast("int"),
        "zero": label.eqNullSafe(F.lit(0)).cast("int"),
        "one": label.eqNullSafe(F.lit(1)).cast("int"),
    }
    kinds = {"rows": columns}
    if "sample_id" in columns:
        kinds["sample_ids"] = ["sample_id"]
    if {"variable_name", "value"} <= set(columns):
        kinds["candidates"] = ["variable_name", "value"]

    def narrow(kind: str, of: Sequence[str]) -> Column:
        counted = [
            (c if kind == "rows" else F.lit(0).cast("bigint" if n == "nulls" else "int")).alias(n)
            for n, c in measures.items()
        ]
        return F.struct(F.lit(kind).alias("kind"), *_identity(*of), *counted)

    rows = frame.select(F.inline(F.array(*(narrow(k, of) for k, of in kinds.items()))))
    met = rows.groupBy("kind", "h1", "h2").agg(
        F.count("*").alias("n"), F.sum("nulls").alias("nulls"), *(F.max(c).alias(c) for c in ("bad", "zero", "one"))
    )

    def repeated(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n") - 1)), F.lit(0)).cast("bigint")

    def present(flag: str) -> Column:
        return F.coalesce(F.max(flag), F.lit(0)) == 1

    if "label" in columns:
        valid = ~present("bad")
        if strict_labels:
            valid = valid & present("zero") & present("one")
    else:
        valid = F.lit(not strict_labels)
    return met.agg(
        F.array(*[F.lit(c) for c in missing]).cast("array<string>").alias("missing_columns"),
        valid.alias("valid_labels"),
        F.coalesce(F.sum("nulls"), F.lit(0)).cast("bigint").alias("missing_values"),
        repeated("sample_ids").alias("duplicate_sample_ids"),
        repeated("rows").alias("duplicate_rows"),
        repeated("candidates").alias("duplicate_candidates"),
    )


def summarize(frame: DataFrame) -> DataFrame:
    secrets = F.count_if(F.col("label") == 1)
    return frame.agg(
        F.count("*").alias("total_samples"),
        secrets.alias("secret_samples"),
        F.count_if(F.col("label") == 0).alias("safe_samples"),
        ratio(secrets, F.count("*")).alias("secret_ratio"),
    )


def feature_summary(frame: DataFrame) -> DataFrame:
    """Mean of every numeric feature per label."""
    means = [F.round(F.avg(c), 4).alias(c) for c in NUMERIC_FEATURES]
    return frame.groupBy("label").agg(*means)


def sample_type_distribution(frame: DataFrame) -> DataFrame:
    return frame.groupBy("label", "sample_type").count().orderBy("label", "sample_type")


def hard_example_counts(frame: DataFrame) -> DataFrame:
    label, named = F.col("label"), F.col("has_sensitive_name")
    return frame.agg(
        F.count_if((label == 1) & (named == 0)).alias("positive_without_sensitive_name"),
        F.count_if((label == 0) & (named == 1)).alias("negative_with_sensitive_name"),
    )


def sensitive_name_rates(frame: DataFrame) -> DataFrame:
    """One row: sizes and secret rates with and without a sensitive name."""
    label, named = F.col("label"), F.col("has_sensitive_name")

    def rate(flag: int) -> Column:
        return F.round(F.coalesce(F.avg(F.when(named == flag, label)), F.lit(0.0)), 4)

    return frame.agg(
        F.count_if(named == 1).alias("sensitive_name_samples"),
        rate(1).alias("sensitive_name_secret_rate"),
        F.count_if(named == 0).alias("non_sensitive_name_samples"),
        rate(0).alias("non_sensitive_name_secret_rate"),
    )


def sensitive_name_table(frame: DataFrame) -> DataFrame:
    """The same as two rows, which are there even when one side is empty."""
    label, named = F.col("label"), F.col("has_sensitive_name")
    sides = [
        F.struct(
            F.lit(flag).alias("has_sensitive_name"),
            F.count_if(named == flag).alias("samples"),
            F.count_if((named == flag) & (label == 1)).alias("secret_samples"),
        )
        for flag in (0, 1)
    ]
    table = frame.agg(F.array(*sides).alias("sides")).select(F.inline("sides"))
    return table.select(
        "*",
        (F.col("samples") - F.col("secret_samples")).alias("safe_samples"),
        ratio(F.col("secret_samples"), F.col("samples")).alias("secret_rate"),
    )


def _per_flag(frame: DataFrame, flags: Sequence[str], **measures) -> DataFrame:
    """One aggregate over the table, then one row per flag."""
    rows = [
        F.struct(F.lit(f).alias("feature"), *[m(f).alias(k) for k, m in measures.items()])
        for f in flags
    ]
    return frame.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def context_activation_by_label(frame: DataFrame) -> DataFrame:
    label = F.col("label")
    rows = [
        F.struct(
            F.lit(flag).alias("feature"),
            F.lit(side).alias("label"),
            F.count_if((label == side) & (F.col(flag) == 1)).alias("activated"),
            F.count_if(label == side).alias("total"),
        )
        for flag in CONTEXT_FLAGS
        for side in (0, 1)
    ]
    table = frame.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    return table.withColumn("activation_rate", ratio(F.col("activated"), F.col("total")))


def context_secret_rates(frame: DataFrame) -> DataFrame:
    table = _per_flag(
        frame,
        CONTEXT_FLAGS,
        activated=lambda f: F.count_if(F.col(f) == 1),
        secret_count=lambda f: F.count_if((F.col(f) == 1) & (F.col("label") == 1)),
    )
    return table.select(
        "*",
        (F.col("activated") - F.col("secret_count")).alias("safe_count"),
        ratio(F.col("secret_count"), F.col("activated")).alias("secret_rate_when_active"),
    )


def context_overlap(frame: DataFrame) -> DataFrame:
    table = _per_flag(
        frame,
        OVERLAP_FLAGS,
        safe_activations=lambda f: F.count_if((F.col(f) == 1) & (F.col("label") == 0)),
        secret_activations=lambda f: F.count_if((F.col(f) == 1) & (F.col("label") == 1)),
    )
    both = (F.col("safe_activations") > 0) & (F.col("secret_activations") > 0)
    return table.withColumn("appears_in_both_classes", both)


def feature_activation(frame: DataFrame, dataset: str) -> DataFrame:
    """Activation of every flag, recomputed from names and values."""
    flags = frame.select(*context_flags(F.col("variable_name"), F.col("value")))
    table = _per_flag(
        flags,
        CONTEXT_FLAGS,
        activated=lambda f: F.count_if(F.col(f) == 1),
        total=lambda f: F.count("*"),
    )
    return table.select(
        F.lit(dataset).alias("dataset"),
        "*",
        ratio(F.col("activated"), F.col("total")).alias("activation_rate"),
    )


def compare_activation(training: DataFrame, development: DataFrame) -> DataFrame:
    return feature_activation(training, "training_v2").unionByName(
        feature_activation(development, "challenge_v1_dev")
    )


def hash_metadata_by_label(frame: DataFrame) -> DataFrame:
    """Sum, count and rate of the hash-metadata flag per label."""
    flag = F.col("looks_like_safe_hash_metadata")
    return frame.groupBy("label").agg(
        F.sum(flag).alias("activated"),
        F.count("*").alias("total"),
        ratio(F.sum(flag), F.count("*")).alias("rate"),
    )
