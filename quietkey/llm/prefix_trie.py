"""A trie of conversation prefixes by fingerprints that compose, without rebuilding a text.

A sequence of turns has the fingerprint sum(h_i * B^i) mod p in several lanes. Fingerprints form
a monoid with the length: F(st) = F(s) + B^|s| F(t). So the prefix of a conversation that is put
together from the head of a base and its own turns follows from stored prefix sums of both,
by shifting and adding; only references to stored turns (their SHA-256) travel with it. Equal
fingerprints of equal length make a node; its members must name the same last turn and the same
parent, else the fingerprints are drawn anew from another seed.

Conversations of any length are numbered by sorted ranges: each task scans its own range, and
the ranges' totals are composed in order. Sums over subtrees use that every node belongs to its
smallest member: the nodes of one member are a chain, chains hang on chains, and totals of
chains double their reach in every round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietkey.llm.common import table, written

#: The prime of all lanes; two lanes make one key column of 62 bits.
PRIME, LANES = (1 << 31) - 1, 4
#: Conversations of one base, and the turns that a base lends at most, plus one.
FAMILY, LENT = 100, 6
#: A node's ending ids are listed in runs of numbers this long, hashed one after the other.
LISTED = 512
#: Seeds that are tried before fingerprints count as broken.
SEEDS = (11, 12, 13, 14)
NODE = ["depth", "key1", "key2"]


class Lanes:
    """The fingerprints of one seed: a multiplier per lane, and turns as numbers."""

    def __init__(self, seed: int = SEEDS[0], prime: int = PRIME):
        self.prime, self.seed = prime, seed
        self.base = np.random.default_rng(seed).integers(2, prime - 1, LANES)

    def powers(self, exponents: np.ndarray) -> np.ndarray:
        """``base ** exponents``, a row per exponent and a column per lane."""
        out = np.ones((len(exponents), LANES), np.int64)
        square, rest = self.base.astype(np.int64), np.array(exponents, np.int64)
        while rest.any():
            odd = rest % 2 == 1
            out[odd] = out[odd] * square % self.prime
            square, rest = square * square % self.prime, rest // 2
        return out

    def turns(self, digests: pd.Series) -> np.ndarray:
        """The lanes of turns from the hex of their SHA-256."""
        words = np.frombuffer(bytes.fromhex("".join(digests)), ">u8").astype(np.uint64).reshape(len(digests), LANES)
        words = (words ^ np.uint64(self.seed)) * np.uint64(0xBF58476D1CE4E5B9)
        return ((words ^ (words >> np.uint64(29))) % np.uint64(self.prime)).astype(np.int64)

    def shifted(self, sums: np.ndarray, by: np.ndarray) -> np.ndarray:
        return sums * self.powers(by) % self.prime

    def back(self, sums: list[Column], by: Column) -> list[Column]:
        """``sums`` moved up to ``LENT`` places to the front."""
        out = []
        for value, base in zip(sums, self.base.tolist(), strict=True):
            inverse = pow(base, -1, self.prime)
            steps = F.array(*(F.lit(pow(inverse, k, self.prime)).cast("long") for k in range(LENT + 1)))
            out.append(value * F.element_at(steps, by.cast("int") + 1) % self.prime)
        return out

    def parents(self, nodes: DataFrame) -> DataFrame:
        """``nodes`` with the fingerprint of their parents: the last turn is taken off."""

        @F.pandas_udf("up1 long, up2 long")
        def taken_off(depth: pd.Series, key1: pd.Series, key2: pd.Series, digest: pd.Series) -> pd.DataFrame:
            held = np.column_stack([key1 // (1 << 31), key1 % (1 << 31), key2 // (1 << 31), key2 % (1 << 31)])
            rest = (held - self.shifted(self.turns(digest), depth.to_numpy())) % self.prime
            return pd.DataFrame({"up1": rest[:, 0] * (1 << 31) + rest[:, 1], "up2": rest[:, 2] * (1 << 31) + rest[:, 3]})

        return nodes.withColumn("up", taken_off(*NODE, "digest")).select("*", "up.up1", "up.up2").drop("up")


def running(frame: DataFrame, order: list[Column], values: list[str], lanes: Lanes | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """``frame`` with ``place`` (from 1) and running totals ``run0..`` within each ``conv_id``.

    Columns are not null, but for those to ``drop`` once rows are in order.
    Totals are sums of ``values``, or, with ``lanes``, the fingerprint of the turns whose digest
    ``values`` names. Rows are sorted by ranges, so a conversation may span any number of tasks: a
    task holds one batch, and the driver composes two rows per range. Stored once.
    """
    width = LANES if lanes else len(values)
    names = [f"run{i}" for i in range(width)]

    def shift(sums: np.ndarray, by: np.ndarray) -> np.ndarray:
        return lanes.shifted(sums, by) if lanes else sums

    def folded(sums: np.ndarray) -> np.ndarray:
        return sums % lanes.prime if lanes else sums

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, place, held = None, 0, np.zeros(width, np.int64)
        for rows in batches:
            if rows.empty:
                continue
            keys = rows["conv_id"].to_numpy()
            starts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1]
            sizes = np.diff(np.r_[starts, len(keys)])
            places = np.arange(len(keys)) - np.repeat(starts, sizes) + 1
            if keys[0] == last:
                places[: sizes[0]] += place
            own = shift(lanes.turns(rows[values[0]]), places) if lanes else rows[values].to_numpy(np.int64)
            sums = np.cumsum(own, axis=0)
            sums -= np.repeat((sums - own)[starts], sizes, axis=0)
            if keys[0] == last:
                sums[: sizes[0]] += held
            sums = folded(sums)
            last, place, held = keys[-1], int(places[-1]), sums[-1].copy()
            yield rows.assign(part=TaskContext.get().partitionId(), place=places, **{n: sums[:, i] for i, n in enumerate(names)})

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields if f.name not in drop] + ["place long", *(f"{n} long" for n in names)]
    ranged = frame.repartitionByRange("conv_id", *order, F.rand(1)).sortWithinPartitions("conv_id", *order).drop(*drop)
    stored = written(ranged.mapInPandas(scan, ", ".join([*fields, "part int"])), "ranges")
    ends = stored.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "place", *names)).alias("last"))
    # What the conversation that is open at a range's start has had before it.
    before: dict[int, tuple[int, int, np.ndarray]] = {}
    open_, place, sums = None, 0, np.zeros(width, np.int64)
    for end in sorted(ends.collect()):
        last, own = end["last"], np.array([end["last"][n] for n in names], np.int64)
        if end["first"] == open_:
            before[end["part"]] = (open_, place, sums)
        if last["conv_id"] == open_:
            sums, place = folded(sums + shift(own[None], np.array([place]))[0]), place + last["place"]
        else:
            open_, place, sums = last["conv_id"], last["place"], own

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for part in set(rows["part"]).intersection(before):
                conv_id, place, sums = before[part]
                late = ((rows["part"] == part) & (rows["conv_id"] == conv_id)).to_numpy()
                moved = shift(rows.loc[late, names].to_numpy(np.int64), np.full(late.sum(), place))
                rows.loc[late, names] = folded(sums + moved)
                rows.loc[late, "place"] += place
            yield rows.drop(columns="part")

    return stored.mapInPandas(compose, ", ".join(fields)) if before else stored.drop("part")


def own_turns(conversations: DataFrame, lanes: Lanes, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, digest, chars, place, run0..)``: every turn, its reference and its prefix's fingerprint."""
    said, by = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text, role))
    digest = F.sha2(F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said), 256)
    turns = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), F.length(said).cast("long").alias("chars")
    )
    return running(turns, [F.col("turn").asc_nulls_first(), F.col("digest")], ["digest"], lanes, ("turn",))


def rebuilt(turns: DataFrame, lanes: Lanes) -> DataFrame:
    """``(conv_id, depth, key1, key2, digest, chars, is_end)`` per prefix of a rebuilt conversation.

    Heads are the base's own prefixes; behind them a conversation's prefix is the head's
    fingerprint plus its own, less what its first turns gave, moved to its new place.
    """
    runs = [f"run{i}" for i in range(LANES)]
    skipped = F.crc32(F.col("conv_id").cast("string").cast("binary")) % LENT
    convs = turns.withColumn("skipped", skipped).groupBy("conv_id", "skipped").agg(
        F.max("place").alias("n"), *(F.coalesce(F.max(F.when(F.col("place") == F.col("skipped"), F.col(r))), F.lit(0)).alias(f"own{i}") for i, r in enumerate(runs))
    )
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = turns.where((F.col("conv_id") == family) & (F.col("place") < LENT)).groupBy(F.col("conv_id").alias("family"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("place", "digest", "chars", *runs))).alias("head"))
    nothing = F.struct(F.lit(0).cast("long").alias("place"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("chars"), *(F.lit(0).cast("long").alias(r) for r in runs))
    plan = convs.withColumn("family", family).join(heads, "family", "left")
    plan = plan.withColumn("head", F.concat(F.array(nothing), F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("skipped").cast("int"))))
    plan = plan.withColumn("lent", F.size("head") - 1).withColumn("total", F.col("lent") + F.greatest(F.col("n") - F.col("skipped"), F.lit(0)))
    lent = plan.select("conv_id", "total", F.explode("head").alias("at")).select("conv_id", "total", F.col("at.place").alias("depth"), *(F.col(f"at.{r}") for r in runs), "at.digest", "at.chars")
    joint = plan.select("conv_id", "skipped", "lent", "total", *(f"own{i}" for i in range(LANES)), F.element_at("head", -1).alias("joint"))
    own = turns.withColumn("skipped_", skipped).where("place > skipped_").join(joint, "conv_id")
    less = [(F.col(r) + lanes.prime - F.col(f"own{i}")) % lanes.prime for i, r in enumerate(runs)]
    moved = lanes.back(less, F.col("skipped") - F.col("lent"))
    sums = [((F.col(f"joint.{r}") + m) % lanes.prime).alias(r) for r, m in zip(runs, moved, strict=True)]
    behind = own.select("conv_id", "total", (F.col("lent") + F.col("place") - F.col("skipped")).alias("depth"), *sums, "digest", "chars")
    keys = [(F.col(f"run{i}") * (1 << 31) + F.col(f"run{i + 1}")).alias(k) for i, k in ((0, "key1"), (2, "key2"))]
    return lent.unionByName(behind).select("conv_id", "depth", *keys, "digest", "chars", (F.col("depth") == F.col("total")).alias("is_end"))


def listed_ends(prefixes: DataFrame) -> DataFrame:
    """The node key and ``ends_sha256``: its ending ids in order, comma-joined and hashed in pieces.

    Ids are distinct, so a piece is bounded; SHA-256 reads a node's pieces one after the other, a
    batch at a time.
    """
    piece = prefixes.where("is_end").groupBy(*NODE, F.expr(f"conv_id div {LISTED}").alias("piece"))
    pieces = piece.agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, hashlib.sha256()
        for rows in batches:
            out = []
            for *key, ids in rows[[*NODE, "ids"]].itertuples(index=False):
                if key == node:
                    state.update(b",")
                else:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
        if node:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=[*NODE, "ends_sha256"])

    ordered = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece")
    return ordered.mapInPandas(hashed, "depth long, key1 long, key2 long, ends_sha256 string")


def verified_nodes(conversations: DataFrame, tries: Iterable[Lanes], **columns: str) -> tuple[DataFrame, DataFrame, Lanes]:
    """Prefixes, nodes and the lanes with which every node's members name one last turn.

    Taking the last turn off leads from a node to its parent, so if no node mixes two turns, all
    members of a node are equal turn by turn.
    """
    for lanes in tries:
        prefixes = written(rebuilt(own_turns(conversations, lanes, **columns), lanes), "prefixes")
        nodes = written(prefixes.groupBy(*NODE, "digest", "chars").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")), "nodes")
        if nodes.groupBy(*NODE).count().where("count > 1").isEmpty():
            return prefixes, nodes, lanes
    raise RuntimeError("fingerprints collide under every seed")


def chain_totals(chains: DataFrame) -> DataFrame:
    """``(conv_id, saved, leaves)`` with all chains below, from ``chains`` with ``hangs_on``.

    After k rounds a chain holds the sums of those less than 2^k below it and points 2^k up.
    """
    state = written(chains.select("conv_id", "saved", "leaves", F.col("hangs_on").alias("up")), "chains")
    while not state.where("up IS NOT NULL").isEmpty():
        gained = state.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        above = state.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        state = state.join(gained, "conv_id", "left").join(above, "up", "left")
        sums = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("saved", "leaves")]
        state = written(state.select("conv_id", *sums, F.col("next").alias("up")), "chains")
    return state.drop("up")


def prefix_trie(conversations: DataFrame, tries: Iterable[Lanes] | None = None, **columns: str) -> DataFrame:
    """The nodes of the trie of rebuilt conversations.

    A conversation is rebuilt from the head of its base and its own further turns. Returns
    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256`` per node. Turns go by number, null first; those
    with one number by the SHA-256 of role and text, so repeated rows are turns of their own. A
    null role or text is empty. Rows with a null id belong to no conversation and are left out.
    An empty table has no node. Other columns are not read; ``columns`` names the four that are.
    """
    prefixes, nodes, lanes = verified_nodes(conversations, tries or map(Lanes, SEEDS), **columns)
    below = lanes.parents(nodes.where("depth > 0"))
    up = [(F.col("depth") - 1).alias("depth"), F.col("up1").alias("key1"), F.col("up2").alias("key2")]
    children = below.groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    of_parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key1").alias("up1"), F.col("key2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    parents = below.select(*NODE, "up1", "up2").join(of_parent, ["depth", "up1", "up2"]).select(*NODE, "parent_conv_id")
    known = nodes.join(children, NODE, "left").join(parents, NODE, "left").join(listed_ends(prefixes), NODE, "left")
    n_children = F.coalesce("n_children", F.lit(0))
    known = written(known.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "conv_id").alias("parent_conv_id"), "n_convs", n_children.alias("n_children"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), (n_children == 0).cast("long").alias("leaves"),
    ), "known")
    top = F.min(F.struct("depth", "parent_conv_id"))
    chains = known.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"), top.alias("top"))
    chains = written(chains.select("conv_id", "saved", "leaves", F.when(F.col("top.depth") > 0, F.col("top.parent_conv_id")).alias("hangs_on"), (F.col("top.depth") - 1).alias("at")), "tops")
    hung = chains.select("conv_id", "hangs_on", "at").where("hangs_on IS NOT NULL").join(chain_totals(chains), "conv_id")
    hung = hung.groupBy(F.col("hangs_on").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("saved").alias("hung_saved"), F.sum("leaves").alias("hung_leaves"))
    summed = known.join(hung, ["conv_id", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(f"hung_{c}", F.lit(0)) for c in ("saved", "leaves")})
    below_each = running(summed.drop("hung_saved", "hung_leaves"), [F.col("depth").desc()], ["saved", "leaves"])
    parent = F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id")
    return below_each.select("conv_id", "depth", parent, "n_convs", "n_children", F.col("run1").alias("n_leaves"), F.col("run0").alias("saved_tokens"), "ends_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
