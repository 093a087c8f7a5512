"""Toxicity: a convolutional text classifier, trained on all labelled texts and applied to whole texts.

A word's vector is the sum of a hashed embedding of the word and one of its first letters.
Filters of several widths run over all words, their maxima over the text feed a logistic
output. A pass over the labelled texts trains one copy of the model per shard of them, and the
copies are averaged: a word's vector by how much each shard had to learn about it. On rows kept
apart from training, thresholds are found for groups of texts alike in their letters, which are
the languages of the fit's texts: spherical k-means on hashed character trigrams names the groups,
no list of words does. A threshold is mapped to the score that callers cut at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quietkey.llm.common import blocks, cut, fold_remainder, plain_words, table, task_sums, text_or_empty

#: Embeddings (half for words, half for first letters), their size, widths and filters of each.
BUCKETS, SIZE, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 8
LETTERS = 4
#: Labelled rows and words of a shard, on which one copy of the model is trained.
SHARD_ROWS, SHARD_WORDS = 24_000, 1 << 23
#: Pieces that the copies' embeddings are averaged in, and labels that meet texts by broadcast.
PIECES, BROADCAST_ROWS = 64, 1 << 20
HELD_OUT, CUT = 2, 0.3
RATE, PASSES, BATCH, DECAY = 0.02, 6, 64, 1e-4
#: Every so many training rows one is kept for thresholds; a group needs so many toxic ones.
CALIBRATE, LEAST_TOXIC = 5, 12
SEED, CHARS = 3, 1 << 19

#: Groups of texts with a threshold of their own, hashed trigrams that tell them, rounds to find them,
#: texts that the first centers are drawn from, change of a center that ends the rounds.
GROUPS, GRAMS, ROUNDS, FIRST, STILL = 6, 1 << 10, 10, 500, 1e-3


class ToxicModel(NamedTuple):
    embed: np.ndarray
    filters: dict[int, np.ndarray]  # width: (width * SIZE, FILTERS)
    biases: dict[int, np.ndarray]
    out: np.ndarray
    bias: float
    thresholds: dict[str, float]
    slope: float
    centers: np.ndarray | None = None  # of the groups


class _Prefixes(dict):
    """(word bucket, bucket of its first letters) in one number, for up to ``limit`` words."""

    limit = 1 << 18

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        head = word.decode("utf-8", "replace")[:LETTERS].encode()
        half = BUCKETS // 2
        self[word] = found = zlib.crc32(word) % half << 32 | half + zlib.crc32(head) % half
        return found


def _ids(text: str, known: _Prefixes) -> np.ndarray:
    words = plain_words(text)
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _gram_counts(texts: list[str]) -> np.ndarray:
    """Hashed character trigrams of every text."""
    points = np.frombuffer("\n\n".join(t.lower() for t in texts).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.array([len(t.lower()) for t in texts])
    size = max(len(points) - 2, 0)
    owner = np.repeat(np.arange(len(texts)), lengths + 2)[:size]
    ends = np.cumsum(lengths + 2) - 2
    inside = np.arange(3, size + 3) <= np.repeat(ends, lengths + 2)[:size]
    code = (points[:-2] * np.uint32(31) + points[1:-1]) * np.uint32(31) + points[2:] if size else np.zeros(0, np.uint32)
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - 10)
    return np.bincount(owner[inside] * GRAMS + code[inside], minlength=len(texts) * GRAMS).reshape(len(texts), GRAMS)


def _unit(counts: np.ndarray) -> np.ndarray:
    """Shares of trigrams as rows of length one; texts without any stay zero."""
    found = np.sqrt(counts).astype(np.float32)
    norm = np.linalg.norm(found, axis=1, keepdims=True)
    return found / np.where(norm == 0, 1, norm)


def _first_centers(profiles: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Up to ``GROUPS`` profiles, drawn far from each other."""
    filled = profiles[profiles.any(axis=1)]
    if not len(filled):
        return np.zeros((1, GRAMS), np.float32)
    chosen = [int(rng.integers(len(filled)))]
    while len(chosen) < min(GROUPS, len(filled)):
        far = np.maximum(1 - (filled @ filled[chosen].T).max(axis=1), 0) ** 2
        if far.sum() < 1e-6:
            break
        chosen.append(int(rng.choice(len(filled), p=far / far.sum())))
    return filled[chosen]


def _packed(numbers: np.ndarray) -> bytes:
    return zlib.compress(numbers.tobytes(), 1)


def _unpacked(column: pd.Series, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(zlib.decompress(x), kind) for x in column]


def _stacked(counts: pd.Series) -> np.ndarray:
    """Profiles of stored trigram counts."""
    return _unit(np.stack(_unpacked(counts, np.uint32))) if len(counts) else np.zeros((0, GRAMS), np.float32)


def _centers(taught: DataFrame) -> np.ndarray:
    """Centers of up to ``GROUPS`` groups of all rows; a few rows only say where the rounds begin."""
    first = taught.orderBy("h", "label_id").limit(FIRST).select("grams").toArrow()
    centers = _first_centers(_stacked(first["grams"].to_pylist()), np.random.default_rng(SEED + 1))
    for _ in range(ROUNDS):
        now = centers

        def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros(now.shape)
            for rows in batches:
                profiles = _stacked(rows["grams"])
                near = (profiles @ now.T).argmax(axis=1)
                np.add.at(sums, near, profiles)
            yield pd.DataFrame({"part": np.arange(len(now), dtype=np.int32), "sums": list(sums)})

        sums = task_sums(taught.select("grams").mapInPandas(added, "part int, sums array<double>"))
        found = np.stack([sums[k] if sums[k].any() else now[k] for k in range(len(now))])
        norm = np.linalg.norm(found, axis=1, keepdims=True)
        centers = (found / np.where(norm == 0, 1, norm)).astype(np.float32)
        if np.abs(centers - now).max() < STILL:
            break
    return centers


def _groups(texts: list[str], centers: np.ndarray) -> list[str]:
    return [str(g) for g in (_unit(_gram_counts(texts)) @ centers.T).argmax(axis=1)]


class _Pass(NamedTuple):
    """What a forward pass leaves for the backward one."""

    ids: np.ndarray
    pooled: np.ndarray
    best: np.ndarray  # place of each maximum, -1 if there is none
    logits: np.ndarray


def _forward(m: ToxicModel, docs: list[np.ndarray]) -> _Pass:
    """Every text is padded with zero vectors, so that even one word meets the widest filter."""
    pad = max(WIDTHS) - 1
    lengths = np.array([len(d) for d in docs])
    starts = np.cumsum(lengths + pad) - lengths - pad
    ids = np.full(int(lengths.sum() + pad * len(docs)), -1, np.int64)
    inside = np.arange(int(lengths.sum())) + np.repeat(np.arange(len(docs)) * pad, lengths)
    ids[inside] = np.concatenate(docs) if docs else []
    x = np.zeros((len(ids) + pad, SIZE), np.float32)
    x[inside] = m.embed[ids[inside] >> 32] + m.embed[ids[inside] & 0xFFFFFFFF]
    pooled = np.zeros((len(docs), len(WIDTHS) * FILTERS), np.float32)
    best = np.full(pooled.shape, -1, np.int64)
    full = np.flatnonzero(lengths)
    for k, w in enumerate(WIDTHS):
        if not len(full):
            break
        kernel = m.filters[w].reshape(w, SIZE, FILTERS)
        y = x[: len(ids)] @ kernel[0]
        for o in range(1, w):
            y += x[o : len(ids) + o] @ kernel[o]
        y += m.biases[w]
        part = slice(k * FILTERS, (k + 1) * FILTERS)
        # Only places at which a word starts count.
        y = y[inside]
        at = np.cumsum(lengths) - lengths
        top = np.maximum.reduceat(y, at[full], axis=0)
        pooled[full, part] = np.maximum(top, 0)
        if m.slope == 0:  # training
            for d, t in zip(full, top, strict=True):
                row = y[at[d] : at[d] + lengths[d]].argmax(axis=0)
                best[d, part] = np.where(t > 0, starts[d] + row, -1)
    return _Pass(ids, pooled, best, pooled @ m.out + m.bias)


class _State(NamedTuple):
    """A model in training and the sums of its squared gradients."""

    model: ToxicModel
    squares: dict


def _new_state() -> _State:
    rng = np.random.default_rng(SEED)
    embed = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
    filters = {w: rng.normal(0, 0.3, (w * SIZE, FILTERS)).astype(np.float32) for w in WIDTHS}
    biases = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
    out = np.abs(rng.normal(0, 0.2, len(WIDTHS) * FILTERS)).astype(np.float32)
    squares = {"embed": np.zeros(BUCKETS, np.float32), "out": np.zeros_like(out), "bias": 0.0}
    squares |= {("f", w): np.zeros_like(filters[w]) for w in WIDTHS} | {("b", w): np.zeros(FILTERS, np.float32) for w in WIDTHS}
    return _State(ToxicModel(embed, filters, biases, out, -2.0, {}, 0.0), squares)


def _dense(state: _State) -> np.ndarray:
    """All numbers of a state but those of its embeddings, in one row."""
    m, q = state
    own = [m.out, [m.bias], q["out"], [q["bias"]]]
    for w in WIDTHS:
        own += [m.filters[w], m.biases[w], q["f", w], q["b", w]]
    return np.concatenate([np.ravel(x) for x in own]).astype(np.float64)


def _with_dense(state: _State, row: np.ndarray) -> _State:
    """``state`` with the numbers of ``_dense``."""
    places = iter(np.split(row, np.cumsum(
        [len(state.model.out), 1] * 2 + [n for w in WIDTHS for n in (w * SIZE * FILTERS, FILTERS) * 2]
    )[:-1]))
    take = lambda *shape: next(places).astype(np.float32).reshape(shape)
    out, bias = take(-1), float(next(places)[0])
    squares = {"embed": state.squares["embed"], "out": take(-1), "bias": float(next(places)[0])}
    filters, biases = {}, {}
    for w in WIDTHS:
        filters[w], biases[w] = take(w * SIZE, FILTERS), take(FILTERS)
        squares["f", w], squares["b", w] = take(w * SIZE, FILTERS), take(FILTERS)
    return _State(state.model._replace(filters=filters, biases=biases, out=out, bias=bias), squares)


_PIECE = "piece int, weight double, sums binary"


def _pass(rows: pd.DataFrame, shard: int, turn: int, state: _State, heavy: float) -> pd.DataFrame:
    """What a shard's rows change in a copy of the model, as pieces that can be averaged."""
    rows = rows.sort_values(["h", "label_id"], kind="stable")
    docs, toxic = _unpacked(rows["ids"], np.int64), rows["toxic"].to_numpy() == 1
    weight = np.where(toxic, heavy, 1.0)
    squares = {k: np.copy(v) for k, v in state.squares.items()}
    m = state.model._replace(embed=state.model.embed.copy())
    order = np.random.default_rng([SEED, turn, shard]).permutation(len(docs))
    for i in range(0, len(order), BATCH):
        pick = order[i : i + BATCH]
        m = _step(m, [docs[j] for j in pick], toxic[pick], weight[pick], squares)
    learned = (squares["embed"] - state.squares["embed"])[:, None]
    sums = np.hstack([learned, learned * learned, learned * (m.embed - state.model.embed)]).astype(np.float32)
    pieces = [x.tobytes() for x in np.split(sums, PIECES)]
    dense = (_dense(_State(m, squares)) * len(docs)).tobytes()
    return pd.DataFrame({"piece": range(-1, PIECES), "weight": float(len(docs)), "sums": [dense, *pieces]})


def _averaged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The average of all shards: dense numbers by rows, embeddings by what each shard learned."""
    rows = rows.sort_values("shard")
    kind = np.float64 if key[0] < 0 else np.float32
    total = np.sum([np.frombuffer(x, kind).astype(np.float64) for x in rows["sums"]], axis=0)
    if key[0] < 0:
        mean = total / rows["weight"].sum()
    else:
        total = total.reshape(-1, SIZE + 2)
        mean = total[:, 1:] / np.where(total[:, :1] > 0, total[:, :1], 1)
    return pd.DataFrame({"piece": [key[0]], "sums": [mean.astype(kind).tobytes()]})


def _train(rows: DataFrame, heavy: float) -> ToxicModel:
    """A model of ``rows(shard, h, label_id, toxic, ids)``; every pass reads all of them."""
    state, context = _new_state(), rows.sparkSession.sparkContext
    for turn in range(PASSES):
        now = context.broadcast(state)

        def copy(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            return _pass(part, key[0], turn, now.value, heavy).assign(shard=key[0])

        copies = rows.groupBy("shard").applyInPandas(copy, f"{_PIECE}, shard int")
        mean = copies.groupBy("piece").applyInPandas(_averaged, "piece int, sums binary").toArrow().sort_by("piece")
        now.destroy()
        dense, *pieces = mean["sums"].to_pylist()
        change = np.frombuffer(b"".join(pieces), np.float32).reshape(BUCKETS, SIZE + 1)
        squares = state.squares | {"embed": state.squares["embed"] + change[:, 0]}
        state = _with_dense(_State(state.model._replace(embed=state.model.embed + change[:, 1:]), squares), np.frombuffer(dense, np.float64))
    return state.model


def _step(m: ToxicModel, docs: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, squares: dict) -> ToxicModel:
    """One Adagrad step; embeddings change only at the places of maxima."""
    p = _forward(m, docs)
    slope = (weight * (1 / (1 + np.exp(-np.clip(p.logits, -30, 30))) - toxic) / len(docs)).astype(np.float32)

    def down(key, value, gradient):
        squares[key] += gradient * gradient
        return value - RATE * gradient / (np.sqrt(squares[key]) + 1e-6)

    back = slope[:, None] * m.out
    pad = max(WIDTHS) - 1
    ids = np.append(p.ids, np.full(pad, -1))
    rows, grads, filters, biases = [], [], {}, {}
    for k, w in enumerate(WIDTHS):
        part = slice(k * FILTERS, (k + 1) * FILTERS)
        doc, f = np.nonzero(p.best[:, part] >= 0)
        at, g = p.best[:, part][doc, f], back[:, part][doc, f]
        kernel = m.filters[w].reshape(w, SIZE, FILTERS)
        change = np.zeros_like(kernel)
        for o in range(w):
            word = ids[at + o]
            real = word >= 0
            a, b = word[real] >> 32, word[real] & 0xFFFFFFFF
            x = m.embed[a] + m.embed[b]
            np.add.at(change[o].T, f[real], g[real, None] * x)
            e = g[real, None] * kernel[o].T[f[real]]
            rows += [a, b]
            grads += [e, e]
        filters[w] = down(("f", w), m.filters[w], change.reshape(w * SIZE, FILTERS) + DECAY * m.filters[w])
        biases[w] = down(("b", w), m.biases[w], np.bincount(f, g, FILTERS).astype(np.float32))
    if rows and sum(map(len, rows)):
        at, inverse = np.unique(np.concatenate(rows), return_inverse=True)
        g = np.zeros((len(at), SIZE), np.float32)
        np.add.at(g, inverse, np.concatenate(grads))
        squares["embed"][at] += (g * g).mean(axis=1)
        m.embed[at] -= RATE * g / (np.sqrt(squares["embed"][at])[:, None] + 1e-6)
    out = down("out", m.out, p.pooled.T @ slope + DECAY * m.out)
    bias = float(down("bias", m.bias, float(slope.sum())))
    return m._replace(filters=filters, biases=biases, out=out, bias=bias)


def _thresholds(logits: DataFrame) -> dict[str, float]:
    """Per group of ``logits(near, logit, toxic)``, and for all rows (''), the middle of the gap at
    which the F1 of the cut is highest.

    Equal logits are one place. Places are dealt to sorted ranges, and only the totals of ranges
    are added up in one place.
    """
    both = logits.select(F.explode(F.array(F.lit(""), "near")).alias("near"), "logit", "toxic")
    tied = both.groupBy("near", "logit").agg(F.sum("toxic").alias("hits"), F.count("*").alias("rows"))
    ranged = cut(tied.repartitionByRange("near", F.desc("logit")).withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy("near").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("near", "part").agg(F.sum("hits").alias("h"), F.sum("rows").alias("r"))
    before = parts.select(
        "near", "part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("h", "r")],
        *[F.sum(c).over(Window.partitionBy("near")).alias(f"{c}_all") for c in ("h", "r")],
    )
    within = Window.partitionBy("near", "part").orderBy(F.desc("logit")).rowsBetween(Window.unboundedPreceding, 0)
    hits, rows = F.col("h0") + F.sum("hits").over(within), F.col("r0") + F.sum("rows").over(within)
    places = ranged.join(F.broadcast(before), ["near", "part"])
    marked = places.select("near", "logit", "h_all", "r_all", (2 * hits / (rows + F.col("h_all"))).alias("f1"))
    best = marked.groupBy("near", "h_all", "r_all").agg(F.max(F.struct("f1", (-F.col("logit")).alias("low"))).alias("best"))
    best = best.select("near", "h_all", "r_all", (-F.col("best.low")).alias("at"))
    lower = ranged.join(F.broadcast(best), "near").where(F.col("logit") < F.col("at"))
    below = lower.groupBy("near").agg(F.max("logit").alias("below"))
    cuts = {}
    for r in best.join(below, "near", "left").collect():
        enough = r["h_all"] >= LEAST_TOXIC and r["h_all"] < r["r_all"]
        if r["h_all"] and (enough or not r["near"]):
            cuts[r["near"]] = (r["at"] + (r["at"] - 1 if r["below"] is None else r["below"])) / 2
    return {"": 0.0} | cuts


def _logits(m: ToxicModel, centers: np.ndarray):
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            near = (_stacked(rows["grams"]) @ centers.T).argmax(axis=1)
            docs = _unpacked(rows["ids"], np.int64)
            logits = np.concatenate([_forward(m, docs[i : i + BATCH]).logits for i in range(0, len(docs), BATCH)] or [np.zeros(0)])
            yield pd.DataFrame({"near": near.astype(str), "logit": logits.astype(np.float64), "toxic": rows["toxic"]})

    return found


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = _Prefixes()
    for rows in batches:
        texts = rows["text"].tolist()
        for a, b in blocks(texts, CHARS):
            ids = [_ids(t, known) for t in texts[a:b]]
            yield rows.iloc[a:b].drop(columns="text").assign(
                words=[len(x) for x in ids], ids=list(map(_packed, ids)), grams=list(map(_packed, _gram_counts(texts[a:b]).astype(np.uint32)))
            )


_TAUGHT = "label_id string, toxic int, h long, words long, ids binary, grams binary"


def fit_toxicity(docs: DataFrame, marks: DataFrame) -> ToxicModel | None:
    """A model of ``docs(id, text)`` and ``marks(label_id, toxic)``, all of them training rows.

    None without a toxic or a clean one. One whole text per mark is learned from; words and
    profiles are made once and kept on local disks. Labels that are few meet the documents by
    broadcast, so that texts aren't shuffled. The driver takes the model's numbers, whatever the input.
    """
    few = marks.count() <= BROADCAST_ROWS
    rows = docs.join(F.broadcast(marks) if few else marks, F.col("id") == F.col("label_id"))
    one = rows.groupBy("label_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    hashed = one.select(F.col("label_id").cast("string").alias("label_id"), "toxic", F.xxhash64(F.lit(SEED), "text").alias("h"), "text")
    taught = hashed.mapInPandas(_read, _TAUGHT).persist(StorageLevel.DISK_ONLY)
    apart = F.pmod("h", F.lit(CALIBRATE)) == CALIBRATE - 1
    try:
        kept = F.when(~apart, F.col("toxic"))
        n = taught.agg(F.count(kept).alias("rows"), F.sum(kept).alias("toxic"), F.sum(F.when(~apart, F.col("words"))).alias("words"), F.sum("toxic").alias("all"), F.count("*").alias("of")).first()
        if not n["all"] or n["all"] == n["of"] or not n["rows"]:
            return None
        shards = max(-(-n["rows"] // SHARD_ROWS), -(-n["words"] // SHARD_WORDS), 1)
        heavy = min(8.0, max(1.0, (n["rows"] - n["toxic"]) / max(n["toxic"], 1)))
        dealt = taught.where(~apart).select(F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int").alias("shard"), "h", "label_id", "toxic", "ids")
        dealt = dealt.repartition(shards, "shard").persist(StorageLevel.DISK_ONLY)
        try:
            m = _train(dealt, heavy)._replace(slope=1.0)
        finally:
            dealt.unpersist()
        centers = _centers(taught)
        logits = taught.where(apart).select("grams", "ids", "toxic").mapInPandas(_logits(m, centers), "near string, logit double, toxic int")
        return m._replace(centers=centers, thresholds=_thresholds(logits))
    finally:
        taught.unpersist()


def _scored(texts: list[str], m: ToxicModel | None, known: _Prefixes) -> np.ndarray:
    """Scores: the threshold of the text's group lies at ``CUT``."""
    out = np.zeros(len(texts))
    if m is None:
        return out
    for a, b in blocks(texts, CHARS):
        docs = [_ids(t, known) for t in texts[a:b]]
        cuts = np.array([m.thresholds.get(g, m.thresholds[""]) for g in _groups(texts[a:b], m.centers)])
        margin = m.slope * (_forward(m, docs).logits - cuts) + np.log(CUT / (1 - CUT))
        out[a:b] = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
    return out


def toxicity_score(text: Column, model: ToxicModel | None) -> Column:
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Prefixes()
        for texts in batches:
            yield pd.Series(_scored(texts.tolist(), model, known))

    return scored(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``.

    Learns from documents with a text and a label of 0 or 1 whose id remainder isn't 2; ids,
    labels and other columns are never features. A null text counts as empty; a null id has no
    label. Without labels of both kinds every score is 0. Repeated rows get equal results; an
    empty table gives an empty one; columns named like the results are replaced. ``predicted``
    follows the written score.
    """
    remainder = fold_remainder(F.col(doc_id))
    taught = F.col(toxic).isin(0, 1) & F.col(doc_id).isNotNull() & (remainder != HELD_OUT)
    marks = labels.where(taught).groupBy(F.col(doc_id).alias("label_id")).agg(F.max(toxic).cast("int").alias("toxic"))
    known = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    model = fit_toxicity(known, marks)
    scored = docs.withColumns({"held_out": remainder == HELD_OUT, "score": toxicity_score(text_or_empty(text), model)})
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
