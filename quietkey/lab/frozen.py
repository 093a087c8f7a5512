"""Frozen dataset identities, the holdout bundle and locked benchmark reports."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quietkey.functions.features import NUMERIC_FEATURES
from quietkey.lab.advisory import fit_advisory
from quietkey.lab.fusion import (
    LOCKED_V1,
    LOCKED_V2,
    MINIMUM_DEVELOPMENT_RECALL,
    evaluate_fusion,
    fusion_decisions,
)
from quietkey.lab.metrics import calculate_metrics
from quietkey.lab.models import baseline_predictions
from quietkey.operators.ordering import durable
from quietkey.plans.gatebench import merkle_digest
from quietkey.lab.profile import BASE_COLUMNS
from quietkey.lab.separation import compare_separation, separation_keys, strictly_separate

# Fixed value: text of the locked selection policy.
SELECTION_POLICY = (
    "Require recall >= 0.98, then maximize precision, then F1, then minimize false positives."
)
# Source names of the frozen datasets.
TRAINING_SOURCE, DEVELOPMENT_SOURCE = "synthetic_v3", "candidate_v2_dev_v1"
HOLDOUT_SOURCE, FINAL_SOURCE = "candidate_v2_holdout_v1", "final_challenge_v2"

#: Bytes that are hashed at once, and children of a node of a hash tree.
BLOCK_BYTES, TREE_FAN = 1 << 20, 1024

_TEXT = ("sample_id", "variable_name", "value", "sample_type", "framework", "source")
_DOUBLE = ("entropy", "digit_ratio", "uppercase_ratio", "special_ratio")


@dataclass(frozen=True)
class Identity:
    """What a frozen dataset must look like."""

    sha256: str
    samples: int
    source: str
    labels: dict[int, int]


def _type_of(column: str) -> str:
    return "string" if column in _TEXT else "double" if column in _DOUBLE else "int"


def candidate_schema(columns: tuple[str, ...] = BASE_COLUMNS) -> str:
    return ", ".join(f"`{c}` {_type_of(c)}" for c in columns)


def read_candidates(spark: SparkSession, path: str, columns=BASE_COLUMNS) -> DataFrame:
    """Labelled candidate CSV with a header and doubled quotes."""
    reader = spark.read.schema(candidate_schema(tuple(columns)))
    return reader.csv(path, header=True, escape='"', multiLine=True, enforceSchema=False)


def write_candidates(frame: DataFrame, path: str) -> None:
    frame.write.mode("errorifexists").csv(path, header=True, escape='"')


def _input(path: str) -> pa.NativeFile:
    """A file of any file system that Arrow knows, opened for reading at any place."""
    local = re.sub(r"\Afile:/+", "/", path)
    if local.startswith("/"):
        return fs.LocalFileSystem().open_input_file(local)
    system, inside = fs.FileSystem.from_uri(path)
    return system.open_input_file(inside)


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """``(file, length)`` of a file, or of the files of a directory; their content is not read."""
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    if listed.isEmpty():
        raise FileNotFoundError(f"No dataset at {path}")
    return listed


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        digests = []
        for file in rows["file"]:
            state = hashlib.sha256()
            with _input(file) as source:
                while chunk := source.read(BLOCK_BYTES):
                    state.update(chunk)
            digests.append(state.hexdigest())
        yield pd.DataFrame({"h": digests})


def file_sha256(spark: SparkSession, path: str) -> str:
    """SHA-256 of a dataset file, or of a tree over the part hashes of a directory.

    Files are read in blocks, whatever their size; SHA-256 takes each one in a single task.
    """
    parts = _listed(spark, path).select("file").repartition("file").mapInPandas(_streamed, "h string")
    first = [r["h"] for r in parts.take(2)]
    return first[0] if len(first) == 1 else merkle_digest(parts, [], "h").first()["digest"]


def _block_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for row in rows.itertuples(index=False):
            with _input(row.file) as source:
                source.seek(row.first * BLOCK_BYTES)
                found = [hashlib.sha256(source.read(BLOCK_BYTES)).hexdigest() for _ in range(row.blocks)]
            yield pd.DataFrame({"file": row.file, "i": range(row.first, row.first + row.blocks), "h": found})


def tree_sha256(spark: SparkSession, path: str, range_blocks: int = 64) -> DataFrame:
    """``(file, length, digest)``: a hash tree over the blocks of each file, for files of any size.

    A task hashes ``range_blocks`` blocks of ``BLOCK_BYTES`` at a time; the digest doesn't depend
    on that number. A node is the SHA-256 of its children's hex digests, ``TREE_FAN`` of them
    in order; a file of one block has the SHA-256 of its bytes.
    """
    files = _listed(spark, path).withColumn(
        "n", F.greatest(F.ceil(F.col("length") / BLOCK_BYTES), F.lit(1)).cast("bigint")
    )
    firsts = F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(range_blocks).cast("bigint"))
    ranges = files.select("file", "n", F.explode(firsts).alias("first")).select(
        "file", "first", F.least(F.lit(range_blocks), F.col("n") - F.col("first")).cast("int").alias("blocks")
    )
    nodes = ranges.repartition("file", "first").mapInPandas(_block_hashes, "file string, i bigint, h string")
    most = files.agg(F.max("n")).first()[0]
    while most > 1:
        children = F.sort_array(F.collect_list(F.struct("i", "h")))
        joined = F.array_join(F.transform(children, lambda c: c["h"]), "")
        parent = F.floor(F.col("i") / TREE_FAN).alias("i")
        # A file that is one node already keeps it.
        nodes = nodes.groupBy("file", parent).agg(
            F.when(F.count("*") > 1, F.sha2(joined, 256)).otherwise(F.min("h")).alias("h")
        )
        most = -(-most // TREE_FAN)
    return files.join(nodes.select("file", F.col("h").alias("digest")), "file").select("file", "length", "digest")


def table_digest(frame: DataFrame) -> DataFrame:
    """Order-free content identity of a table: row count and a SHA-256 tree over its rows.

    A row is hashed as its values in the order of column names, each with its length, so
    that values can't run into each other; an empty table has the hash of no bytes.
    """
    texts = [F.col(c).cast("string") for c in sorted(frame.columns)]
    marked = [F.coalesce(F.concat(F.length(t), F.lit(":"), t), F.lit("-")) for t in texts]
    rows = frame.select(F.sha2(F.concat_ws(",", *marked), 256).alias("h"))
    digest = F.coalesce(merkle_digest(rows, [], "h").scalar(), F.sha2(F.lit(""), 256))
    return rows.agg(F.count("*").alias("samples")).withColumn("digest", digest)


def dataset_identity(frame: DataFrame) -> DataFrame:
    """One row: samples, sources and label counts, for comparison with an identity."""
    return frame.agg(
        F.count("*").alias("samples"),
        F.sort_array(F.collect_set(F.coalesce("source", F.lit("")))).alias("sources"),
        F.count_if(F.col("label") == 0).alias("safe_samples"),
        F.count_if(F.col("label") == 1).alias("secret_samples"),
    )


@dataclass(frozen=True)
class Observed:
    """A dataset whose identity is counted by whatever pass reads it first."""

    name: str
    frame: DataFrame
    seen: Observation

    def verify(self, expected: Identity) -> dict:
        """What was counted; any difference from the identity stops the experiment.

        Call it after an action that has read all of ``frame``.
        """
        got = self.seen.get
        if got["samples"] != expected.samples:
            raise ValueError(f"Unexpected sample count for {self.name}: {got['samples']}.")
        sources = (got["first_source"], got["last_source"])
        if sources != (expected.source, expected.source):
            raise ValueError(f"Unexpected dataset source for {self.name}: {sources}.")
        counts = {0: got["safe_samples"], 1: got["secret_samples"]}
        if got["other_labels"] or {k: v for k, v in counts.items() if v} != expected.labels:
            raise ValueError(f"Unexpected label distribution for {self.name}: {counts}.")
        return got


def observed(name: str, frame: DataFrame) -> Observed:
    """Attach the counts of an identity to ``frame``; they cost no pass of their own."""
    seen = Observation(f"identity of {name}")
    source = F.coalesce("source", F.lit(""))
    other = ~F.coalesce(F.col("label").isin(0, 1), F.lit(False))
    watched = frame.observe(
        seen,
        F.count(F.lit(1)).alias("samples"),
        F.min(source).alias("first_source"),
        F.max(source).alias("last_source"),
        F.coalesce(F.sum((F.col("label") == 0).cast("bigint")), F.lit(0)).alias("safe_samples"),
        F.coalesce(F.sum((F.col("label") == 1).cast("bigint")), F.lit(0)).alias("secret_samples"),
        F.coalesce(F.sum(other.cast("bigint")), F.lit(0)).alias("other_labels"),
    )
    return Observed(name, watched, seen)


def _read_frozen(spark: SparkSession, path: str, expected: Identity, columns) -> DataFrame:
    if file_sha256(spark, path) != expected.sha256:
        raise ValueError(f"Dataset SHA-256 mismatch for {path}.")
    return read_candidates(spark, path, columns)


def validate_frozen(
    spark: SparkSession, path: str, expected: Identity, columns=BASE_COLUMNS
) -> DataFrame:
    """Load a frozen dataset; any difference from its identity stops the experiment."""
    frame = _read_frozen(spark, path, expected, columns)
    held = observed(path, frame)
    held.frame.write.format("noop").mode("overwrite").save()
    held.verify(expected)
    return frame


def require_separation(first: DataFrame, second: DataFrame, what: str) -> None:
    if not strictly_separate(compare_separation(first, second)).first()["strictly_separate"]:
        raise ValueError(f"Holdout failed strict separation from {what}.")


def bundle_checks(sets: dict[str, Observed]) -> DataFrame:
    """``(other, kind, shared)``: what the holdout shares with each other set, by kind of key.

    One job reads every set once, which also counts what their identities are checked with.
    """
    names = list(sets)
    keys = None
    for i, name in enumerate(names):
        one = separation_keys(sets[name].frame, 1 << i)
        keys = one if keys is None else keys.unionByName(one)
    met = keys.groupBy("what", "first", "second").agg(F.bit_or("side").alias("sides"))
    holdout = 1 << names.index("holdout")
    others = [(n, 1 << i) for i, n in enumerate(names) if n != "holdout"]
    counts = [
        F.count_if((F.col("sides").bitwiseAND(holdout | bit)) == (holdout | bit)).alias(n) for n, bit in others
    ]
    return met.groupBy("what").agg(*counts)


def load_holdout_bundle(
    spark: SparkSession, sets: dict[str, tuple[str, Identity]], columns=BASE_COLUMNS
) -> dict[str, DataFrame]:
    """Training, development and holdout, verified and strictly separate.

    ``columns`` holds for all sets, or names those of each set. Rows of every set are read once.
    """
    of = columns if isinstance(columns, dict) else dict.fromkeys(sets, columns)
    frames = {n: _read_frozen(spark, path, identity, of[n]) for n, (path, identity) in sets.items()}
    held = {n: observed(n, f) for n, f in frames.items()}
    shared = bundle_checks(held).collect()
    for name, (_, identity) in sets.items():
        held[name].verify(identity)
    for other in ("training", "development"):
        if any(r[other] for r in shared):
            raise ValueError(f"Holdout failed strict separation from {other}.")
    return frames


def validate_final(frame: DataFrame, samples: int = 600, source: str = FINAL_SOURCE) -> None:
    """Check the locked final evaluation set before it is scored."""
    missing = sorted({*BASE_COLUMNS, *NUMERIC_FEATURES} - set(frame.columns))
    if missing:
        raise ValueError(f"Final dataset is missing columns: {missing}")
    seen = dataset_identity(frame).first()
    half = samples // 2
    if (seen["samples"], seen["safe_samples"], seen["secret_samples"]) != (samples, half, half):
        raise ValueError("Unexpected final dataset size or label counts.")
    if seen["sources"] != [source]:
        raise ValueError(f"Unexpected final dataset source values: {seen['sources']}")
    if frame.groupBy("sample_id").count().where("count > 1").limit(1).count():
        raise ValueError("Final dataset contains duplicate sample IDs.")


def _struct(values: dict) -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in values.items()])


def holdout_report(training: DataFrame, holdout: DataFrame) -> DataFrame:
    """One row: locked configuration, policy and metrics on the holdout."""
    advisory = fit_advisory(training)
    scored = advisory.text.predict(advisory.context.predict(holdout, "context"), "text")
    decisions = fusion_decisions(scored, LOCKED_V2["text_weight"], LOCKED_V2["threshold"])
    columns = ("label", "fusion_prediction", "fusion_probability")
    metrics = calculate_metrics(durable(decisions.select(*columns)), *columns, "Locked Late Fusion v2")
    locked = {
        "text_weight": LOCKED_V2["text_weight"],
        "context_weight": LOCKED_V2["other_weight"],
        "threshold": LOCKED_V2["threshold"],
        "minimum_development_recall": MINIMUM_DEVELOPMENT_RECALL,
        "selection_policy": SELECTION_POLICY,
    }
    policy = {
        "holdout_used_for_training": False,
        "holdout_used_for_tuning": False,
        "parameters_locked_before_holdout": True,
        "final_challenge_v2_used": False,
        "do_not_retune_from_holdout": True,
    }
    return metrics.withColumns(
        {"locked_configuration": _struct(locked), "evaluation_policy": _struct(policy)}
    )


def final_report(training: DataFrame, final: DataFrame, sha256: str) -> DataFrame:
    """One row: the locked first fusion on the final challenge."""
    predictions = baseline_predictions(training, final)
    metrics = evaluate_fusion(predictions, LOCKED_V1, "text_probability", "numerical_probability")
    policy = {
        "used_for_training": False,
        "used_for_tuning": False,
        "weights_locked_before_test": True,
        "threshold_locked_before_test": True,
        "do_not_retune_on_result": True,
    }
    return metrics.withColumns(
        {
            "status": F.lit("FINAL_EVALUATION"),
            "evaluation_dataset_sha256": F.lit(sha256),
            "policy": _struct(policy),
            "generated_at_utc": F.current_timestamp(),
        }
    )


def save_report(report: DataFrame, path: str) -> None:
    """Write a report once; an existing one is never replaced."""
    report.coalesce(1).write.mode("errorifexists").json(path)
