"""Benchmark decontamination by latent semantic retrieval.

Fitting reads all documents once. Passages of fixed length are sets of hashed words T; every
task adds up document frequencies and its part of TᵀT·Ω for a Gaussian test matrix Ω. That is
a randomised SVD of the TF-IDF matrix by Nyström's method: with S = diag(idf), (S TᵀT S)(S⁻¹Ω)
gives its leading right singular vectors and values, so idf may come from the same pass.
Searching reads all documents once more. A passage's latent vector is the sum of its word
vectors, so running sums give the vectors of all windows about as long as an item. Windows
whose cosine with an item is high are candidates; a longest common subsequence over words
confirms them, and a looser paraphrase must hold the item's answer as well.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietkey.llm.common import blocks, free_name, plain_words, table, task_sums, text_or_empty

#: Hashed terms and latent dimensions.
TERMS, RANK, SEED = 1 << 11, 64, 11
#: Words of a passage, and passages of a block of T.
PASSAGE, ROWS = 128, 256
#: Least cosine of a candidate; windows move by this part of their length; items whose lengths
#: lie within such a factor share windows.
COSINE, STEP, RATIO = 0.5, 4, 1.35
#: Windows start at every so many words at most.
GRID = 4
#: Least part of an item's words in a common subsequence: alone, or with so much of its answer.
COPIED, PARAPHRASED, ANSWERED = 0.8, 0.6, 0.8
#: Items with fewer words must be there whole.
SHORT = 8
#: Items searched in one pass; more take further passes.
ITEM_BLOCK = 4096
#: Sums of a fit are split into so many parts by term.
PARTS = 16
#: Characters and windows held at once in a task.
CHARS, WINDOWS = 1 << 19, 1 << 13


class LatentSpace(NamedTuple):
    """``vectors[t]`` is a term's weight times its row of the whitened latent space."""

    vectors: np.ndarray
    values: np.ndarray
    passages: int


class Item(NamedTuple):
    words: np.ndarray
    answer: np.ndarray
    masks: dict[int, int]


def _hashes(text: str) -> np.ndarray:
    words = plain_words(text)
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def fit_latent(docs: DataFrame, text: str = "text", terms: int = TERMS, rank: int = RANK) -> LatentSpace:
    """The latent space of all passages of ``docs``; an empty table gives a space of zeros.

    A task sends ``terms × (rank + 1)`` numbers, summed by term block; the driver takes one
    such matrix, whatever the input's size.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        omega = _omega(terms, rank)
        gram, seen, passages = np.zeros((terms, rank)), np.zeros(terms), 0
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in blocks(texts, CHARS):
                found = [_hashes(t) % terms for t in texts[a:b]]
                passages += _add_passages(found, omega, gram, seen)
        both = np.column_stack([gram, seen]).reshape(PARTS, -1)
        yield pd.DataFrame({"part": [*range(PARTS), PARTS], "sums": [*both, np.array([float(passages)])]})

    got = task_sums(docs.select(text_or_empty(text).alias("text")).mapInPandas(sums, "part int, sums array<double>"))
    if not got:
        return LatentSpace(np.zeros((terms, rank), np.float32), np.zeros(rank), 0)
    total = np.concatenate([got[p] for p in range(PARTS)]).reshape(terms, rank + 1)
    return _space(total[:, :rank], total[:, rank], int(got[PARTS][0]))


def _omega(terms: int, rank: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((terms, rank)).astype(np.float32)


def _add_passages(docs: list[np.ndarray], omega: np.ndarray, gram: np.ndarray, seen: np.ndarray) -> int:
    """Adds the passages of ``docs`` to TᵀTΩ and to document frequencies; returns how many.

    A term counts once per passage: repeated words would else rule the leading directions.
    """
    terms = np.concatenate(docs)
    lengths = np.array([len(d) for d in docs])
    place = np.arange(len(terms)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    passage = np.cumsum(place % PASSAGE == 0) - 1
    count = int(passage[-1]) + 1 if len(terms) else 0
    ends = np.searchsorted(passage, np.arange(0, count + ROWS, ROWS))
    for a, b in zip(ends, ends[1:], strict=False):
        block = np.zeros((ROWS, len(seen)), np.float32)
        block[passage[a:b] % ROWS, terms[a:b]] = 1
        gram += block.T @ (block @ omega)
        seen += block.sum(axis=0)
    return count


def _space(gram: np.ndarray, seen: np.ndarray, passages: int) -> LatentSpace:
    terms, rank = gram.shape
    idf = np.log((1 + passages) / (1 + seen)) + 1
    core = _omega(terms, rank).astype(np.float64).T @ gram
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(), 1e-12) * 1e-10
    root = (idf[:, None] * gram) @ (vectors[:, good] / np.sqrt(values[good]))
    u, s, _ = np.linalg.svd(root, full_matrices=False)
    kept = s > max(s.max(initial=0), 1e-12) * 1e-6
    white = idf[:, None] * u[:, kept] / s[kept]
    # Scaled to about one per word; only angles count.
    scale = np.sqrt((white**2).sum(axis=1).mean()) if kept.any() else 1.0
    return LatentSpace((white / (scale or 1.0)).astype(np.float32), s[kept], passages)


def _item(text: str) -> Item:
    """The answer of an item is its last line if it has several, else its last sentence."""
    lines = [x for x in text.split("\n") if plain_words(x)]
    sentences = [x for x in re.split(r"(?<=[.!?])\s+", lines[-1] if lines else "") if plain_words(x)]
    last = lines[-1] if len(lines) > 1 else sentences[-1] if sentences else ""
    words = _hashes(text)
    return Item(words, _hashes(last), _masks(words))


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    for i, w in enumerate(words.tolist()):
        out[w] |= 1 << i
    return dict(out)


def common_length(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of a longest common subsequence, a bit per word of the item."""
    full = (1 << size) - 1
    row = full
    for w in words:
        if hit := masks.get(w):
            use = row & hit
            row = (row + use | row - use) & full
    return size - row.bit_count()


class Search:
    """Looks for the items of one block in documents."""

    def __init__(self, space: LatentSpace, items: list[str]):
        self.vectors = np.vstack([space.vectors, np.zeros((1, space.vectors.shape[1]), np.float32)])
        self.items = [_item(t) for t in items]
        sizes: dict[int, list[int]] = defaultdict(list)
        for i, item in enumerate(self.items):
            if len(item.words):
                sizes[round(np.log(len(item.words)) / np.log(RATIO))].append(i)
        shortest = min((len(x.words) for x in self.items if len(x.words)), default=1)
        self.grid = min(GRID, max(1, shortest // STEP))
        #: (window length in steps of the grid, items, their unit vectors)
        self.bins = []
        for members in sizes.values():
            length = float(np.median([len(self.items[i].words) for i in members]))
            vectors = np.stack([space.vectors[self.items[i].words % (len(self.vectors) - 1)].sum(axis=0) for i in members])
            self.bins.append((max(1, round(length / self.grid)), np.array(members), _unit(vectors)))

    def documents(self, texts: list[str]) -> list[list[tuple[int, int, bool]]]:
        """For each text its leaks: (item, words in common, whether the answer is there)."""
        out: list[list[tuple[int, int, bool]]] = []
        for a, b in blocks(texts, CHARS):
            words = [_hashes(t) for t in texts[a:b]]
            best: list[dict[int, tuple[int, bool]]] = [{} for _ in words]
            if self.items and sum(map(len, words)):
                for doc, item, start, length in self._candidates(words):
                    self._confirm(best[doc], item, words[doc], start, length)
            out += [[(i, *v) for i, v in sorted(x.items())] for x in best]
        return out

    def _candidates(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, first word, words) of windows that are near an item.

        Documents are padded to whole steps of the grid; a window's vector is a difference of
        running sums.
        """
        lengths = np.array([len(d) for d in docs])
        steps = -(-lengths // self.grid)
        ends = np.cumsum(steps)
        empty = len(self.vectors) - 1
        terms = np.full(int(ends[-1]) * self.grid, empty)
        place = np.arange(int(lengths.sum())) + np.repeat((ends - steps) * self.grid - (np.cumsum(lengths) - lengths), lengths)
        terms[place] = np.concatenate(docs) % empty
        vectors = self.vectors[terms[:: self.grid]]
        for k in range(1, self.grid):
            vectors += self.vectors[terms[k :: self.grid]]
        sums = np.zeros((len(vectors) + 1, vectors.shape[1]), np.float32)
        np.cumsum(vectors, axis=0, out=sums[1:])
        for size, members, units in self.bins:
            step = max(1, size // STEP)
            # The last window of a document ends with it.
            spans = np.maximum(steps - size, 0)
            count = np.where(steps > 0, -(-spans // step) + 1, 0)
            doc = np.repeat(np.arange(len(docs)), count)
            turn = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = np.minimum(turn * step, spans[doc])
            at = start + (ends - steps)[doc]
            to = np.minimum(at + size, ends[doc])
            for i in range(0, len(at), WINDOWS):
                window = sums[to[i : i + WINDOWS]] - sums[at[i : i + WINDOWS]]
                norms = np.sqrt(np.einsum("ij,ij->i", window, window))
                near = window @ units.T >= COSINE * np.maximum(norms, 1e-12)[:, None]
                for w, m in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
                    yield int(doc[i + w]), int(members[m]), int(start[i + w]) * self.grid, size * self.grid

    def _confirm(self, best: dict, item: int, words: np.ndarray, start: int, length: int) -> None:
        masks, size = self.items[item].masks, len(self.items[item].words)
        margin = max(length, size) // STEP + GRID
        window = words[max(0, start - margin) : start + max(length, size) + margin].tolist()
        least = size if size < SHORT else PARAPHRASED * size
        if sum(w in masks for w in window) < least:
            return
        common = common_length(masks, size, window)
        if common < least or item in best and best[item][0] >= common:
            return
        answer = self.items[item].answer
        answered = len(answer) > 0 and common_length(_masks(answer), len(answer), window) >= ANSWERED * len(answer)
        if size < SHORT or common >= COPIED * size or answered:
            best[item] = (common, answered)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


_FOUND = "array<struct<item:int,common:int,answered:boolean>>"


def _found(space: LatentSpace, items: list[str], text: Column) -> Column:
    @F.pandas_udf(_FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        looking = Search(space, items)
        for texts in batches:
            leaks = looking.documents(texts.tolist())
            yield pd.Series([[{"item": i, "common": c, "answered": a} for i, c, a in x] for x in leaks])

    return search(text)


def _item_blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list]:
    """The benchmark's items, up to about ``ITEM_BLOCK`` at a time."""
    items = benchmark.select(F.col(item_id).alias("id"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    parts = -(-items.count() // ITEM_BLOCK)
    for part in range(parts):
        yield items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).collect()


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, common, item_words, answered)``: every item found in every document.

    Null or empty texts and items match nothing; a null id is carried on; repeated rows each
    give their own result; empty tables give an empty one; other columns are not read. Items
    are the stated query set, compared in blocks with windows of all documents.
    """
    spark = docs.sparkSession
    space = fit_latent(docs, text)
    kind = dict(benchmark.dtypes)[item_id]
    out = None
    for items in _item_blocks(benchmark, item_id, item_text):
        found = docs.select(F.col(doc_id).alias("doc_id"), F.explode(_found(space, [r["text"] for r in items], text_or_empty(text))).alias("leak"))
        names = spark.createDataFrame([(i, r["id"], len(plain_words(r["text"]))) for i, r in enumerate(items)], f"item int, item_id {kind}, item_words int")
        found = found.select("doc_id", "leak.*").join(F.broadcast(names), "item")
        out = found if out is None else out.union(found)
    if out is None:
        return docs.select(F.col(doc_id).alias("doc_id"), *(F.lit(None).cast(t).alias(n) for n, t in (("item_id", kind), ("common", "int"), ("item_words", "int"), ("answered", "boolean")))).limit(0)
    return out.select("doc_id", "item_id", "common", "item_words", "answered")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents in which no item is found, with their own columns."""
    space, out = fit_latent(docs, text), docs
    for items in _item_blocks(benchmark, item_id, item_text):
        name = free_name(out, "leaks")
        out = out.withColumn(name, _found(space, [r["text"] for r in items], text_or_empty(text))).where(F.size(name) == 0).drop(name)
    return out


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(docs, table(spark, sf_dir, "benchmark"))
