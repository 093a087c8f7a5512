"""SimHash near-duplicates: fingerprints within a few bits of each other, linked through.

Distinct fingerprints meet in cells: the 64 bits are six blocks, two fingerprints within three
bits agree on three of them, so 20 equi-keys find every pair. Cells that are large are dealt
again by six blocks of the bits that are left. Inside a cell, Hamming distances to reference
fingerprints (pivots) are tabled once. The cell is swept in the order of one of them, as far as
it grows by the limit; of the pairs met, those whose rows differ by more than the limit in
another column are discarded, column by column, and the few others are verified. A cell gives a star per
group instead of all its pairs; groups that share fingerprints are joined by label spreading.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quietkey.llm.common import cut, free_name, table, text_or_empty, written

SHINGLE, SEED, LIMIT = 3, 42, 3
BLOCKS = 6
#: A cell with more fingerprints is dealt again by the bits that its key doesn't hold.
DENSE = 512
#: Fixed reference fingerprints: pseudo-random words, the same in every task.
PIVOTS = np.array([xxhash.xxh64_intdigest(bytes([i]), SEED) for i in range(16)], np.uint64)
#: Pairs compared at once, in a task.
PAIRS = 1 << 17


def fingerprint(text: str) -> int:
    """64 bits; a bit is 1 if it is set in over half of the hashes of all word shingles."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(SHINGLE)), strict=False) if len(words) >= SHINGLE else [words]
    ones, total, held = np.zeros(64, np.int64), 0, []
    for run in runs:
        held.append(xxhash.xxh64_intdigest(b" ".join(run), SEED))
        if len(held) == PAIRS:
            ones += _bit_counts(held)
            total += len(held)
            held = []
    if held:
        ones += _bit_counts(held)
        total += len(held)
    return int(np.packbits(2 * ones > total).view(">u8")[0])


def _bit_counts(hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, 64)
    return bits.sum(axis=0, dtype=np.int64)


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def _cells(bits: int, held: int = 0) -> list[int]:
    """Masks of three out of six blocks of the ``bits`` that aren't ``held``, as signed numbers."""
    free = [i for i in range(bits) if not held >> i & 1]
    edges = [round(k * len(free) / BLOCKS) for k in range(BLOCKS + 1)]
    blocks = [sum(1 << i for i in free[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(x) for x in combinations(blocks, BLOCKS - LIMIT)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


MASKS = _cells(64)


def _keys(value: Column, masks: list[int]) -> Column:
    return F.posexplode(F.array(*(value.bitwiseAND(F.lit(m)) for m in masks)))


def near_links(prints: DataFrame) -> DataFrame:
    """Links ``(a, b)`` among the distinct values of ``prints.fp`` that connect every pair within
    three bits; a and b of a link lie in one group of a cell, not always within three bits."""
    cells = prints.select("fp", _keys(F.col("fp"), MASKS).alias("mask", "key"))
    dense = cells.groupBy("mask", "key").count().where(F.col("count") > DENSE).drop("count")
    sparse = cells.join(dense, ["mask", "key"], "left_anti").withColumn("sub", F.lit(0))
    rest = {m: _cells(64, m % (1 << 64)) for m in MASKS}
    finer = F.element_at(F.array(*(F.array(*map(F.lit, rest[m])) for m in MASKS)), F.col("mask") + 1)
    split = (
        cells.join(dense, ["mask", "key"], "left_semi")
        .select("mask", "key", "fp", F.posexplode(finer).alias("part", "bits"))
        .select("mask", F.xxhash64("key", "part", F.col("fp").bitwiseAND(F.col("bits"))).alias("key"), "fp", (F.col("part") + 1).alias("sub"))
    )
    dealt = sparse.select("mask", "sub", "key", "fp").union(split.select("mask", "sub", "key", "fp"))
    dealt = dealt.repartition("mask", "sub", "key").sortWithinPartitions("mask", "sub", "key", "fp")
    return dealt.mapInPandas(_stars, "a long, b long").distinct()


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reads sorted cells; a cell may go on in the next batch."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        names = ["mask", "sub", "key"]
        same = (batch[names].to_numpy() == batch[names].iloc[-1].to_numpy()).all(axis=1)
        whole = len(batch) - int(np.argmin(same[::-1])) if not same.all() else 0
        held.append(batch.iloc[:whole] if whole else batch)
        if whole:
            yield _star_rows(pd.concat(held))
            held = [batch.iloc[whole:]]
    if held:
        yield _star_rows(pd.concat(held))


def _star_rows(rows: pd.DataFrame) -> pd.DataFrame:
    keys = rows[["mask", "sub", "key"]].to_numpy()
    prints = rows["fp"].to_numpy().view(np.uint64)
    ends = np.flatnonzero(np.r_[(keys[1:] != keys[:-1]).any(axis=1), True]) + 1
    starts = np.r_[0, ends[:-1]]
    cell, last = (np.repeat(x, ends - starts) for x in (starts, ends))
    # A cell lies in the order of the distance to the first pivot.
    prints = prints[np.lexsort((np.bitwise_count(prints ^ PIVOTS[0]), cell))]
    distances = [np.bitwise_count(prints ^ p).astype(np.int8) for p in PIVOTS]
    label, i, step = np.arange(len(prints)), np.arange(len(prints)), 1
    while True:
        i = i[i + step < last[i]]
        # The sweep of a fingerprint ends where the first distance has grown by more than the limit.
        i = i[distances[0][i + step] - distances[0][i] <= LIMIT]
        if not len(i):
            break
        for at in range(0, len(i), PAIRS):
            x = i[at : at + PAIRS]
            x = x[label[x] != label[x + step]]  # pairs that are linked already need no check
            for d in distances[1:]:
                x = x[np.abs(d[x] - d[x + step]) <= LIMIT]
            x = x[np.bitwise_count(prints[x] ^ prints[x + step]) <= LIMIT]
            if len(x):
                _merge(label, x, x + step)
        step += 1
    out = np.flatnonzero(label != np.arange(len(label)))
    values = prints.view(np.int64)
    return pd.DataFrame({"a": values[out], "b": values[label[out]]})


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of all pairs; every label becomes its group's smallest place."""
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            return
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label[:] = label[label]


def components(links: DataFrame) -> DataFrame:
    """``(fp, root)`` for every fingerprint that occurs in ``links``; root is the group's smallest.

    Each round takes the smallest label among neighbours, then the label's own label, and
    cuts the lineage in the shared folder; chains of any length end after few rounds.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = cut(edges.groupBy(F.col("a").alias("fp")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = edges.join(labels, edges.b == labels.fp).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels.fp == near.a).select("fp", F.least("root", "near").alias("low"), F.col("root").alias("old"))
        lower = cut(lower)
        jump = lower.select(F.col("fp").alias("at"), F.col("low").alias("next"))
        moved = cut(lower.join(jump, lower.low == jump["at"]).select("fp", F.least("low", "next").alias("root"), "old"))
        changed = not moved.where(F.col("root") != F.col("old")).isEmpty()
        labels = moved.select("fp", "root")
        if not changed:
            return labels


def link_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row ``(row, doc_id, fp, component_id, first_row)`` per row of ``docs``.

    ``row`` numbers the rows of this result. ``component_id`` is the smallest id reachable over
    links of three bits or fewer, null if no linked row has an id; ``first_row`` is the row that
    stands for the group (smallest id, then smallest row). Texts without words, null ones
    included, have fingerprint zero and are linked like any other; repeated rows are copies;
    an empty table gives an empty result; other columns are not read. Copies are never paired:
    distinct fingerprints are linked, then documents take their fingerprint's group.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
        _fingerprints(text_or_empty(text)).alias("fp"),
    )
    return _grouped(written(rows, "fingerprints"))


def _grouped(rows: DataFrame) -> DataFrame:
    # A null id sorts last: (missing, id, row).
    order = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    prints = written(rows.groupBy("fp").agg(F.min(order).alias("first")), "prints")
    groups = components(near_links(prints))
    rooted = prints.join(groups, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("best"))
    named = rooted.join(firsts, "root").select("fp", F.col("best.id").alias("component_id"), F.col("best.row").alias("first_row"))
    return rows.join(named, "fp").select("row", "doc_id", "fp", "component_id", "first_row")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest id.

    Rows are numbered in a written copy, so that rows with equal or null ids stay apart.
    """
    row, fp = free_name(docs, "row"), free_name(docs, "fp")
    held = written(docs.withColumns({row: F.monotonically_increasing_id(), fp: _fingerprints(text_or_empty(text))}), "documents")
    grouped = _grouped(held.select(F.col(row).alias("row"), F.col(doc_id).alias("doc_id"), F.col(fp).alias("fp")))
    kept = grouped.where(F.col("row") == F.col("first_row")).select(F.col("row").alias(row))
    return held.join(kept, row, "left_semi").drop(row, fp)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
