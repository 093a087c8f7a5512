"""Reproducible stratified split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hash digits that name a bucket; 16 to their power buckets per label are accumulated in one place.
BUCKET_DIGITS = 3


def stratified_split(
    frame: DataFrame, test_size: float = 0.20, seed: int = 42, key: str = "sample_id"
) -> DataFrame:
    """Add ``is_test``: the same share of every label, the first by MD5 of key and seed.

    Labels are few, so ranking inside a label would be one task. Rows are ranked inside
    hash buckets instead, and only the bucket sizes are accumulated per label.
    """
    if not 0.0 < test_size < 1.0:
        raise ValueError(f"The held-out share lies outside 0 to 1: {test_size}")
    seeded = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f"|{seed}"))
    drawn = frame.withColumn("_hash", F.md5(seeded)).withColumn(
        "_bucket", F.left("_hash", F.lit(BUCKET_DIGITS))
    )
    sizes = drawn.groupBy("label", "_bucket").agg(F.count("*").alias("_rows"))
    label = Window.partitionBy("label")
    before = label.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "label",
        "_bucket",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.ceil(F.sum("_rows").over(label) * test_size).alias("_wanted"),
    )
    rank = F.row_number().over(Window.partitionBy("label", "_bucket").orderBy("_hash", key))
    # At most 16**BUCKET_DIGITS rows per label.
    return (
        drawn.withColumn("_rank", rank)
        .join(F.broadcast(offsets), ["label", "_bucket"])
        .withColumn("is_test", F.col("_before") + F.col("_rank") <= F.col("_wanted"))
        .select(*frame.columns, "is_test")
    )
