"""Gate benchmark: expected against actual gate of labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietkey.lab.metrics import ratio

_NODE_WIDTHS = (8, 6, 4, 2, 0)


def case_results(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per case with the predicted gate and whether the expected type showed up.

    ``cases`` is ``(project_id, family, track, expected_gate, expected_type)`` and
    ``findings`` any scan output. A case without findings passes.
    """
    found = findings.groupBy("project_id").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_set("type")).alias("types")
    )
    joined = cases.join(found, "project_id", "left")
    gate = F.when(F.col("n").isNull(), F.lit("passed")).otherwise(F.lit("failed"))
    types = F.coalesce("types", F.array().cast("array<string>"))
    expected = F.col("expected_type")
    return joined.select(
        "project_id",
        "family",
        "track",
        "expected_gate",
        gate.alias("predicted_gate"),
        "expected_type",
        F.when(expected.isNotNull(), F.array_contains(types, expected)).alias(
            "expected_type_found"
        ),
        F.coalesce("n", F.lit(0)).alias("findings_count"),
        types.alias("finding_types"),
        (gate == F.col("expected_gate")).alias("correct_gate"),
    )


def _cells() -> list[Column]:
    classified = F.col("track") != "coverage"
    expected, predicted = F.col("expected_gate"), F.col("predicted_gate")

    def count(want: str, got: str) -> Column:
        return F.count_if(classified & (expected == want) & (predicted == got))

    return [
        F.count_if(classified).alias("cases"),
        count("failed", "failed").alias("true_positive"),
        count("passed", "passed").alias("true_negative"),
        count("passed", "failed").alias("false_positive"),
        count("failed", "passed").alias("false_negative"),
    ]


def gate_metrics(results: DataFrame) -> DataFrame:
    """One row: secret detection without coverage cases, gate accuracy over all."""
    tp, tn = F.col("true_positive"), F.col("true_negative")
    fp, fn = F.col("false_positive"), F.col("false_negative")
    counted = results.agg(
        *_cells(),
        F.count("*").alias("gate_cases"),
        F.count_if("correct_gate").alias("gate_correct"),
    )
    return counted.select(
        "*",
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(fp, fp + tn).alias("false_positive_rate"),
        ratio(fn, fn + tp).alias("false_negative_rate"),
        (F.col("gate_cases") - F.col("gate_correct")).alias("gate_incorrect"),
        ratio(F.col("gate_correct"), F.col("gate_cases")).alias("gate_accuracy"),
    )


def family_metrics(results: DataFrame) -> DataFrame:
    """Per family: gate accuracy, recall of the expected type, wrong verdicts."""
    typed = F.count("expected_type")
    return results.groupBy("family").agg(
        F.count("*").alias("total"),
        ratio(F.count_if("correct_gate"), F.count("*")).alias("gate_accuracy"),
        F.when(typed > 0, ratio(F.count_if("expected_type_found"), typed)).alias(
            "expected_type_recall"
        ),
        *_cells()[3:],
    )


def merkle_digest(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Order-free SHA-256 per key of the hex hashes in a column, as ``digest``.

    Equal hashes are counted first. Then hashes are combined level by level along their
    prefix: a node has at most 256 children above the first level, and there those hashes
    that share 32 bits. No group grows with the data, however hot the key.
    """
    copies = rows.groupBy(*keys, F.col(column).alias("node")).agg(F.count("*").alias("copies"))
    level = copies.select(*keys, "node", F.concat_ws(":", "node", "copies").alias("digest"))
    for width in _NODE_WIDTHS:
        node = F.substr(F.col("node"), F.lit(1), F.lit(width)).alias("node")
        joined = F.array_join(F.array_sort(F.collect_list("digest")), "")
        level = level.groupBy(*keys, node).agg(F.sha2(joined, 256).alias("digest"))
    return level.select(*keys, "digest")


def corpus_digest(cases: DataFrame, files: DataFrame) -> DataFrame:
    """SHA-256 identity per family of all cases with their file paths and contents."""
    content = F.sha2(F.coalesce("content", F.lit(b"")), 256)
    hashed = files.select("project_id", F.sha2(F.concat_ws("\n", "path", content), 256).alias("h"))
    per_case = merkle_digest(hashed, ["project_id"], "h")
    text = F.concat_ws(
        "\n",
        "project_id",
        "family",
        "track",
        "expected_gate",
        F.coalesce("expected_type", F.lit("")),
        F.coalesce("digest", F.lit("")),
    )
    cased = cases.join(per_case, "project_id", "left").select("family", F.sha2(text, 256).alias("h"))
    return merkle_digest(cased, ["family"], "h")
