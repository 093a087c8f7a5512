"""Mixing sources to target weights: whole blocks of documents, dealt to output shards.

Every source is cut into disjoint blocks by a hash of its rows. The words that a source gives
are its blocks, taken up to three times in whole rounds, and a last round that ends within a
block. A splitting tree deals the block quotas: each node halves its shards and draws, without
replacement, how many of its blocks go left (a multivariate hypergeometric draw), so every
shard gets an exact count per source. A source's taken blocks stand in one permuted list, of
which the shards take consecutive stretches; shards order their rows by a local hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietkey.llm.common import count_words, free_name, table, text_or_empty, written

#: Weights of the sources in code point order, repeating; null comes last.
WEIGHTS = (1.0, 2.0, 3.0)
MOST_TIMES = 3
SEED = 7
#: Documents per block, about; the last block of a source is taken document by document.
BLOCK_ROWS = 64
#: Rows per shard, about, where the number of shards isn't given.
SHARD_ROWS = 100_000
#: Sources pass through the driver as numbers; more sources are refused.
MAX_SOURCES = 100_000
#: Groups of blocks that one search for the last block looks at, level by level.
FAN = 1024
#: Shards that a node of the tree is split into before its parts are dealt to other tasks.
SPLIT = 64
#: A source's permuted list is met in so many stretches at most, of so many blocks at least.
STRETCHES, STRETCH = 1 << 14, 64
#: Beyond so many blocks the library's draw is not defined.
LIBRARY_BLOCKS = 10**9


class Source(NamedTuple):
    source: str | None
    words: int
    rows: int
    target: float


def water_fill(words: list[int], weights: list[float], most: float = MOST_TIMES) -> list[float]:
    """Targets that share all words by weight; none above ``most`` times its source's words."""
    targets, left = [0.0] * len(words), float(sum(words))
    open_ = [i for i, w in enumerate(words) if w > 0]
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > most * words[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / total
            return targets
        for i in full:
            targets[i] = float(most * words[i])
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def draw_left(rng: np.random.Generator, good: int, bad: int, size: int) -> int:
    """How many of ``size`` blocks, drawn without replacement, come from ``good``."""
    if good + bad < LIBRARY_BLOCKS:
        return int(rng.hypergeometric(good, bad, size)) if good and size else 0
    low, high = max(0, size - bad), min(size, good)
    mode = min(max((size + 1) * (good + 1) // (good + bad + 2), low), high)

    def log_mass(k: int) -> float:
        """Up to a constant."""
        return -sum(math.lgamma(x + 1) for x in (k, good - k, size - k, bad - size + k))

    # A log-concave mass lies below a plateau with exponential tails, as high as at its mode.
    all_ = sum(math.lgamma(x + 1) for x in (good, bad, size, good + bad - size)) - math.lgamma(good + bad + 1)
    top = log_mass(mode)
    peak = math.exp(min(all_ + top, 0.0))
    edge = 1 + peak / 2
    while True:
        flat, v, accept, sign = rng.random(4)
        far = v * edge / peak if flat <= edge / (1 + edge) else (edge - math.log(1 - v)) / peak
        k = mode + round(far) * (1 if sign < 0.5 else -1)
        if low <= k <= high and math.log(1 - accept) + min(0.0, edge - peak * far) <= log_mass(k) - top:
            return k


def halved(low: int, high: int, held: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of each source at a node over shards ``low`` to ``high``, dealt to its halves.

    The left half gets its share of all blocks, rounded down; one source is drawn after the other.
    """
    rng = np.random.default_rng([seed, low, high])
    total = int(held.sum())
    size, left = total * ((low + high) // 2 - low) // (high - low), np.zeros_like(held)
    for i, n in enumerate(held.tolist()):
        total -= n
        left[i] = draw_left(rng, n, total, size)
        size -= int(left[i])
    return left, held - left


def split_node(low: int, high: int, held: np.ndarray, parts: int, seed: int = SEED) -> Iterator[tuple[int, int, np.ndarray]]:
    """The nodes below a node, once there are about ``parts`` of them or each has one shard."""
    work = [(low, high, held, parts)]
    while work:
        low, high, held, parts = work.pop()
        if high - low == 1 or parts <= 1:
            yield low, high, held
            continue
        left, right = halved(low, high, held, seed)
        middle = (low + high) // 2
        work += [(middle, high, right, parts // 2), (low, middle, left, parts // 2)]


def splitting_tree(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """``quotas[s]`` blocks of each source dealt to ``shards``: counts[shard, source].

    Shards get equally many blocks, one more or less; sums over shards are the quotas exactly.
    """
    out = np.zeros((shards, len(quotas)), np.int64)
    for low, _, held in split_node(0, shards, np.asarray(quotas, np.int64), shards * 2, seed):
        out[low] = held
    return out


def shard_stretches(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``(at, shard, first, behind)``: the blocks of source ``at``'s list that a shard takes.

    ``quotas(at, n)`` is bounded by ``MAX_SOURCES``. The tree is split some levels per task;
    nodes without blocks of a source have no row for it.
    """

    def split(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        low, high = (int(x) for x in key)
        rows = rows.sort_values("at")
        out, before = [], rows["first"].to_numpy().copy()
        for a, b, held in split_node(low, high, rows["n"].to_numpy(), SPLIT, seed):
            some = held > 0
            out.append(pd.DataFrame({"low": a, "high": b, "at": rows["at"][some], "first": before[some], "n": held[some]}))
            before += held
        return pd.concat(out)

    schema = "low long, high long, at int, first long, n long"
    nodes = quotas.select(F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("high"), "at", F.lit(0).cast("long").alias("first"), "n")
    for _ in range(math.ceil(math.log(max(shards, 2), SPLIT // 2))):
        nodes = nodes.groupBy("low", "high").applyInPandas(split, schema)
    return nodes.select("at", F.col("low").cast("int").alias("shard"), "first", (F.col("first") + F.col("n")).alias("behind"))


def source_targets(sized: DataFrame) -> list[Source]:
    """Sources of ``sized(source, size)`` in code point order, null last, with their targets."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    rows = sums.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r.source is None, [ord(c) for c in r.source or ""]))
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))]
    targets = water_fill([r.words for r in rows], weights)
    return [Source(r.source, r.words, r.rows, t) for r, t in zip(rows, targets, strict=True)]


def _unit(seed: int, *columns: Column) -> Column:
    """A hash as a number from 0 up to 1."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) / F.lit(float(1 << 52))


def last_blocks(blocked: DataFrame, need: dict[int, float], n_blocks: list[int]) -> dict[int, tuple[int, float]]:
    """Per source the block in which the words ``need`` end, and the words needed of it.

    ``blocked(at, block, size)``. Blocks are searched as digits of base ``FAN``, so a level sorts
    at most ``FAN`` sums per source, whatever the number of its blocks.
    """
    spark = blocked.sparkSession
    levels = max(1, math.ceil(math.log(max([*n_blocks, 2]), FAN)))
    found = {at: (0, words) for at, words in need.items()}
    for level in reversed(range(levels)):
        if not found:
            break
        state = F.broadcast(spark.createDataFrame([(at, of, words) for at, (of, words) in found.items()], "at int, of long, need double"))
        wide, narrow = FAN ** (level + 1), FAN**level
        sums = blocked.join(state, "at").where(F.floor(F.col("block") / wide) == F.col("of"))
        sums = sums.groupBy("at", "need", F.floor(F.col("block") / narrow).alias("digit")).agg(F.sum("size").alias("words"))
        before = F.sum("words").over(Window.partitionBy("at").orderBy("digit")) - F.col("words")
        ends = sums.withColumn("before", before).where((F.col("before") <= F.col("need")) & (F.col("need") < F.col("before") + F.col("words")))
        found = {r["at"]: (r["digit"], r["need"] - r["before"]) for r in ends.collect()}
    return found


def plan_mix(rows: DataFrame, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """``rows`` (row key ``mark``, ``source``, ``size``) with ``source_size, target, copies, shards``.

    ``copies`` is how often the mix takes a row, ``shards`` the shard of each copy. ``rows`` must
    be a stored table: it is read several times.
    """
    spark = rows.sparkSession
    sources = source_targets(rows)
    shards = shards or max(1, math.ceil(sum(s.rows for s in sources) / SHARD_ROWS))
    blocks = [max(1, math.ceil(s.rows / BLOCK_ROWS)) for s in sources]
    rounds = [min(int(s.target // s.words), MOST_TIMES) if s.words else 0 for s in sources]
    need = {i: s.target - r * s.words for i, (s, r) in enumerate(zip(sources, rounds, strict=True)) if s.words and r < MOST_TIMES and s.target > r * s.words}

    def blocked(known: list[tuple], extra: str) -> DataFrame:
        of = spark.createDataFrame(known, f"at int, name string, n_blocks long{extra}")
        joined = rows.join(F.broadcast(of), F.col("source").eqNullSafe(F.col("name"))).drop("name")
        joined = joined.withColumn("place", _unit(seed, F.col("mark")))
        return joined.withColumn("block", F.least(F.floor(F.col("place") * F.col("n_blocks")), F.col("n_blocks") - 1))

    plain = [(i, s.source, b) for i, (s, b) in enumerate(zip(sources, blocks, strict=True))]
    last = last_blocks(blocked(plain, ""), need, blocks)
    facts, quotas = [], []
    for (at, name, n), s, r in zip(plain, sources, rounds, strict=True):
        cut, within = last.get(at, (n, 0.0) if at in need else (-1, 0.0))
        quota = r * n + min(cut + 1, n)
        step = _step(quota, [seed, at])
        facts.append((at, name, n, s.words, s.target, r, cut, within, quota, step, max(STRETCH, -(-quota // STRETCHES))))
        quotas.append((at, quota))
    dealt = blocked(facts, ", source_size long, target double, rounds int, cut long, need double, quota long, step long, stretch long")
    # Block copies number n_blocks * round + block; a step coprime to the quota permutes them.
    copied = dealt.groupBy("at", "block").agg(*(F.first(c).alias(c) for c in ("n_blocks", "rounds", "cut", "quota", "step", "stretch")))
    turns = F.col("rounds") + (F.col("block") <= F.col("cut")).cast("int")
    copied = copied.where(turns > 0).withColumn("turn", F.explode(F.sequence(F.lit(0), turns - 1)))
    position = (F.col("turn") * F.col("n_blocks") + F.col("block")) * F.col("step") % F.col("quota")
    copied = copied.select("at", "block", "turn", position.alias("position"), F.floor(position / F.col("stretch")).alias("near"))
    widths = spark.createDataFrame([(f[0], f[-1]) for f in facts], "at int, stretch long")
    taken_by = shard_stretches(spark.createDataFrame(quotas, "at int, n long").where("n > 0"), shards, seed).join(F.broadcast(widths), "at")
    near = F.sequence(F.floor(F.col("first") / F.col("stretch")), F.floor((F.col("behind") - 1) / F.col("stretch")))
    taken_by = taken_by.select("at", "shard", "first", "behind", F.explode(near).alias("near"))
    within = (F.col("position") >= F.col("first")) & (F.col("position") < F.col("behind"))
    homes = copied.join(taken_by, ["at", "near"], "left").where(within | F.col("shard").isNull())
    lost = F.raise_error(F.lit("a taken block lies in no shard")).cast("int")
    homes = homes.groupBy("at", "block").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("shard", lost).alias("shard")))).alias("homes"))
    # In the last block a document is taken if most of it lies within the need.
    kept = [*rows.columns, "at", "block", "source_size", "target", "rounds"]
    in_last = F.col("block") == F.col("cut")
    cut_at = F.sum("size").over(Window.partitionBy("at").orderBy("place", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    open_ = dealt.where(in_last).withColumn("more", (cut_at - F.col("size") / 2 <= F.col("need")).cast("int"))
    shut = dealt.where(~in_last).withColumn("more", (F.col("block") < F.col("cut")).cast("int"))
    taken = open_.select(*kept, "more").unionByName(shut.select(*kept, "more")).join(homes, ["at", "block"], "left")
    copies = F.col("rounds") + F.col("more")
    held = F.coalesce(F.transform("homes", lambda h: h["shard"]), F.array().cast("array<int>"))
    return taken.select(*rows.columns, "source_size", "target", copies.alias("copies"), F.slice(held, F.lit(1), copies).alias("shards"))


def _step(quota: int, seed: list[int]) -> int:
    """A random number coprime to ``quota`` whose products with positions are 64-bit."""
    if quota <= 2:
        return 1
    rng, most = np.random.default_rng(seed), min(quota, (1 << 62) // quota)
    while math.gcd(step := int(rng.integers(1, max(most, 2))), quota) != 1:
        pass
    return step


def _hash(doc_id: Column, text: Column, source: Column) -> Column:
    return F.xxhash64(doc_id, F.xxhash64(text), source)


def mix_plan(docs: DataFrame, shards: int | None = None, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, shards)`` per row of ``docs``.

    A null text has size 0; a null source is a source of its own, the last; rows without words
    are placed but add nothing. A source without words has target 0. Repeated rows share their
    hash and so their block, and are cut apart only in a last block. An empty table gives an
    empty result; other columns are not read. Every rerun gives the same rows. More than
    ``MAX_SOURCES`` distinct sources are refused with a ValueError.
    """
    body = text_or_empty(text)
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _hash(F.col(doc_id), body, F.col(source)).alias("mark"), count_words(body).alias("size"))
    return plan_mix(written(sized, "sizes"), shards).drop("mark")


def mix(docs: DataFrame, shards: int | None = None, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with ``shard`` and ``place``.

    ``place`` orders a shard. Columns with these names are replaced. More than ``MAX_SOURCES``
    distinct sources are refused with a ValueError.
    """
    docs = docs.drop("shard", "place")
    key, size, mark, homes, turn = (free_name(docs, f"mix_{n}") for n in ("key", "size", "mark", "homes", "turn"))
    body = text_or_empty(text)
    hashes = {key: F.monotonically_increasing_id(), size: count_words(body), mark: _hash(F.col(doc_id), body, F.col(source))}
    held = written(docs.withColumns(hashes), "documents")
    planned = plan_mix(held.select(F.col(key).alias("row"), F.col(mark).alias("mark"), F.col(source).alias("source"), F.col(size).alias("size")), shards)
    drawn = planned.where(F.col("copies") > 0).select(F.col("row").alias(key), F.col("shards").alias(homes))
    out = held.join(drawn, key).select(*docs.columns, mark, F.posexplode(homes).alias(turn, "shard"))
    return out.withColumn("place", F.xxhash64(F.lit(SEED), "shard", mark, turn)).drop(mark, turn)


def write_mix(mixed: DataFrame, path: str) -> None:
    """One folder per shard, its rows in their shuffled order."""
    mixed.repartition("shard").sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(path)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mix_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "shards")
