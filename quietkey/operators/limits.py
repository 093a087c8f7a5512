"""Fail-closed content checks: what cannot be read safely becomes a finding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quietkey.operators.detectors import LIMITATION, finding_item

# Size and sampling limits, regular file modes.
MAX_FILE_BYTES = 2 * 1024 * 1024
BINARY_SAMPLE_BYTES = 8192
REGULAR_MODES = ("100644", "100755")

# Reason texts.
NEGATIVE_SIZE = "File size could not be validated safely."
OVERSIZED = f"File exceeds the safe source scan limit of {MAX_FILE_BYTES} bytes."
BINARY = "Binary content was detected in a supported text file."
SOURCE_REASONS = {
    "symlink": "Symbolic links are not followed during working-tree security scans.",
    "metadata": "File metadata could not be read safely.",
    "content": "File content could not be read safely.",
}
ARTIFACT_REASONS = {
    "symlink": "Symbolic links are not followed during artifact security scans.",
    "metadata": "File metadata could not be read safely during artifact analysis.",
    "content": "File content could not be read safely during artifact analysis.",
}


def size_limitation(length: Column) -> Column:
    """Reason why a size is unsafe, else null."""
    return F.when(length < 0, F.lit(NEGATIVE_SIZE)).when(
        length > MAX_FILE_BYTES, F.lit(OVERSIZED)
    )


def is_probably_binary(content: Column) -> Column:
    """A NUL byte among the first bytes."""
    sample = F.substr(content, F.lit(1), F.lit(BINARY_SAMPLE_BYTES))
    return F.contains(sample, F.lit(b"\x00"))


def content_limitation(content: Column) -> Column:
    size = F.octet_length(content)
    return F.coalesce(
        size_limitation(size), F.when(is_probably_binary(content), F.lit(BINARY))
    )


def read_limitation(reasons: dict[str, str]) -> Column:
    """Reason over ``is_symlink, length, readable, content``, in checking order.

    An oversized file needs no content: its declared length decides.
    """
    return (
        F.when(F.col("is_symlink"), F.lit(reasons["symlink"]))
        .when(F.col("length").isNull(), F.lit(reasons["metadata"]))
        .when(size_limitation(F.col("length")).isNotNull(), size_limitation(F.col("length")))
        .when(~F.col("readable") | F.col("content").isNull(), F.lit(reasons["content"]))
        .otherwise(content_limitation(F.col("content")))
    )


def mode_limitation(mode: Column) -> Column:
    """Reason for a change-set entry that is not a regular file, else null."""
    text = F.concat(
        F.lit("Staged Git entry is not a regular file (mode "), mode, F.lit(").")
    )
    return F.when(~mode.isin(*REGULAR_MODES), text)


def limitation_item(reason: Column, phase: int = 0) -> Column:
    """The coverage finding for a reason."""
    return finding_item(LIMITATION, masked=F.lit("-"), reasons=F.array(reason), phase=phase)
