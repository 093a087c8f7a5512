"""What the operators share: reading tables, the shared folder, words and bounded batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract: blank and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"

#: Folds ASCII punctuation to blanks, so that words compare without it.
_PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    A session without one uses a folder in the warehouse, which all workers share as well.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        context.setCheckpointDir(named)
    return named


def stored(frame: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``frame`` as a new Parquet table in the shared folder, read again, and the table's place.

    Its rows survive a lost executor and costly Python before it runs once.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path), path


def written(frame: DataFrame, name: str) -> DataFrame:
    """``stored`` for tables that nobody removes; whoever owns the shared folder clears it."""
    return stored(frame, name)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of ``stored`` that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` with its lineage cut in the shared folder, for loops over narrow rows."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint()


def free_name(frame: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``frame`` has it (case aside)."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def fold_remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def text_window(text: Column, chars: int, seed: int) -> Column:
    """``text`` if it has up to ``chars`` characters, else so many from a place drawn by its hash."""
    room = F.greatest(F.length(text) - chars, F.lit(0)) + 1
    return F.substr(text, (F.pmod(F.xxhash64(F.lit(seed), text), room) + 1).cast("int"), F.lit(chars))


def plain_words(text: str) -> list[bytes]:
    """Lower-case words without ASCII punctuation, as UTF-8."""
    return text.lower().encode("utf-8", "replace").translate(_PLAIN).split()


def blocks(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` that hold up to ``chars`` characters, or one text."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > chars:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


#: Sums of tasks meet in so many groups first, so that no group holds those of all tasks.
SUM_GROUPS = 512


def task_sums(parts: DataFrame) -> dict[int, np.ndarray]:
    """``parts(part int, sums array<double>)``, one row per part and task, added up by part.

    Two levels of grouping; the driver takes one array per part, whatever the input's size.
    """

    def added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "sums": [np.sum(np.stack(rows["sums"].to_numpy()), axis=0)]})

    schema = "part int, sums array<double>"
    first = parts.groupBy("part", (F.spark_partition_id() % SUM_GROUPS).alias("near")).applyInPandas(added, schema)
    return {r["part"]: np.array(r["sums"]) for r in first.groupBy("part").applyInPandas(added, schema).collect()}


def bounded_sample(rows: DataFrame, limit: int, seed: int, *key: str) -> DataFrame:
    """All of ``rows`` if they are up to ``limit``, else about ``limit`` of them by a hash of ``key``.

    Only for fitting classifiers; the same rows are drawn in every run.
    """
    count = rows.count()
    if count <= limit:
        return rows
    share = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rows.where(share < limit / count)
