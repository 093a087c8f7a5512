"""Global positions in a sorted table, and durable narrow results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL_BITS = 33


def name_checkpoints(spark: SparkSession) -> None:
    """Use the folder that the session names in ``spark.checkpoint.dir``.

    Without one, a folder in the warehouse, which all workers share as well.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")


def durable(frame: DataFrame) -> DataFrame:
    """``frame`` checkpointed to the shared folder; what is written stays there, so never raw values."""
    name_checkpoints(frame.sparkSession)
    return frame.checkpoint()


def positioned(frame: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """``frame`` with each row's place (from 1) in ``order``, which must be total.

    Rows are dealt to sorted ranges and numbered within them; only one number per range is
    accumulated in one place. The ranges are stored first, so that a task that runs again
    can't deal them anew.
    """
    # Ranges are found by a pass of their own, which reads stored rows instead of making them.
    ranged = durable(frame).repartitionByRange(*order).sortWithinPartitions(*order)
    stored = durable(ranged.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", _LOCAL_BITS)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND((1 << _LOCAL_BITS) - 1) + 1
    # One row per range.
    numbered = stored.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, place).drop("_id", "_part", "_before")
