"""Change set between two snapshots of a file index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietkey.operators.limits import REGULAR_MODES

_KEYS = ["project_id", "path"]


def _digest(entries: DataFrame) -> Column:
    """Content identity: the stored blob id, or a hash of the content without one."""
    if "blob_id" in entries.columns:
        return F.col("blob_id")
    return F.sha2("content", 256)


def write_index(entries: DataFrame, name: str, buckets: int, path: str | None = None) -> None:
    """Store a snapshot as table ``name``, bucketed and sorted by project and path.

    The content identity is stored with it, so later comparisons hash nothing. Two snapshots
    with equally many buckets meet without a shuffle: each task reads one bucket of both.
    """
    identified = entries if "blob_id" in entries.columns else entries.withColumn("blob_id", _digest(entries))
    writer = identified.write.bucketBy(buckets, *_KEYS).sortBy(*_KEYS)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def change_set(new: DataFrame, old: DataFrame) -> DataFrame:
    """Entries of ``new`` that were added, or modified in content or permission.

    Both tables are ``(project_id, path, mode, stage, length, content[, blob_id])``.
    Deletions and changes between file and link are no candidates. Of ``old`` only keys,
    identity and mode are read. One join in which the content of ``new`` stays in its row: on
    tables of ``write_index`` it needs no exchange; other tables are shuffled once.
    """
    before = old.select(
        *_KEYS,
        F.lit(True).alias("_existed"),
        _digest(old).alias("_old_digest"),
        F.col("mode").alias("_old_mode"),
    )
    mode = F.col("mode")
    regular = mode.isin(*REGULAR_MODES) == F.col("_old_mode").isin(*REGULAR_MODES)
    differs = ~(_digest(new).eqNullSafe(F.col("_old_digest"))) | ~(mode.eqNullSafe(F.col("_old_mode")))
    changed = F.col("_existed").isNull() | (differs & F.coalesce(regular, F.lit(True)))
    # An unmerged entry stops the scan, changed or not.
    unmerged = F.raise_error(F.lit("Unmerged index entries cannot be scanned safely."))
    return (
        new.join(before, _KEYS, "left")
        .where(F.when(F.coalesce(F.col("stage"), F.lit(-1)) != 0, unmerged.cast("boolean")).otherwise(changed))
        .drop("_existed", "_old_digest", "_old_mode")
    )
