"""Logistic regression on the n-grams of many texts: rows stay on the executors' disks, in blocks."""

from __future__ import annotations

import operator
import pickle
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, Broadcast, StorageLevel
from pyspark.sql import DataFrame

from quietkey.lab.terms import Chains, Trie, chains

#: Weights whose slopes are added up together.
_SLICE = 1 << 18
#: Steps that the next one learns from, and the values that must not have fallen for the last one.
_KEPT, _WATCHED = 6, 20
#: Passes whose shuffled slopes may lie on the disks at once.
_SWEPT = 4


def margins(block: Chains, sums: np.ndarray) -> np.ndarray:
    """What the terms of each text add to its margin; ``sums``: the ``chain_sums`` of weights by IDF."""
    texts = len(block.squares)
    total = np.bincount(block.text, np.repeat(sums[block.term], block.times), texts)
    total += np.bincount(block.of, block.share * np.repeat(sums[block.other], block.others), texts)
    return total * _inverse(block)


def _add(slopes: np.ndarray, term: np.ndarray, times: np.ndarray, values: np.ndarray) -> None:
    if len(term):
        slopes[term] += np.add.reduceat(values, np.cumsum(times) - times)


def _inverse(block: Chains) -> np.ndarray:
    """One by the length of each text's vector; 0 where it holds no term."""
    held = block.squares > 0
    return held / np.sqrt(np.where(held, block.squares, 1.0))


def packed(frame: DataFrame, trie: Trie, idf: np.ndarray) -> DataFrame:
    """``(_text, _label)`` of ``(text, numbers, _label)``: a row for each block of texts."""
    # In the function itself, workers would keep its pickle as well.
    shared = frame.sparkSession.sparkContext.broadcast((trie, trie.chain_sums(idf * idf)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, squared = shared.value
        for batch in batches:
            first = 0
            labels = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            numbers = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(labels), -1) if len(labels) else None
            for block in chains(batch.column(0).to_pylist(), known, squared):
                last = first + len(block.squares)
                rows = pickle.dumps((tuple(block), np.array(numbers[first:last], float)), protocol=5)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (rows, labels[first:last].tobytes())], ["_text", "_label"])
                first = last

    return frame.select("text", "numbers", "_label").mapInArrow(pack, "_text binary, _label binary")


def _slopes(rows: Iterable[tuple[bytes, bytes]], weights: Broadcast, own: np.ndarray, intercept: float) -> Iterator[tuple[int, np.ndarray]]:
    """Slices of the slopes of some rows' loss; at -1 rows, positives, loss, slopes of intercept and numbers, inverse squares."""
    sums = weights.value
    slopes, total = np.zeros(len(sums)), np.zeros(5 + len(own))
    for text, label in rows:
        block, numbers = pickle.loads(text)
        block, labels = Chains(*block), np.frombuffer(label, np.uint8)
        margin = margins(block, sums) + numbers @ own + intercept
        error = 0.5 * (1.0 + np.tanh(0.5 * margin)) - labels
        inverse = _inverse(block)
        _add(slopes, block.term, block.times, (error * inverse)[block.text])
        _add(slopes, block.other, block.others, block.share * (error * inverse)[block.of])
        loss = np.logaddexp(0.0, margin) - labels * margin
        total += [len(labels), labels.sum(), loss.sum(), error.sum(), *(error @ numbers), inverse @ inverse]
    yield -1, total
    for i in range(0, len(slopes), _SLICE):
        yield i, slopes[i : i + _SLICE]


def minimise(value: Callable, at: np.ndarray, curvature: np.ndarray, tolerance: float, steps: int) -> np.ndarray:
    """Where a convex function is least, by limited-memory BFGS.

    ``value`` gives value and slopes, ``curvature`` is near the diagonal of the second derivatives. Ends
    where values or the expected gain of a step are within ``tolerance``.
    """
    pairs: deque = deque(maxlen=_KEPT)
    now, slope = value(at)
    seen = [now]
    for _ in range(steps):
        if slope @ (slope / curvature) <= 1e-2 * tolerance * abs(now):
            break
        step, parts = slope.copy(), []
        for moved, bent, inverse in reversed(pairs):
            parts.append(inverse * (moved @ step))
            step -= parts[-1] * bent
        step /= curvature
        if pairs:
            _, bent, inverse = pairs[-1]
            step /= inverse * (bent @ (bent / curvature))
        for (moved, bent, inverse), part in zip(pairs, reversed(parts), strict=True):
            step += (part - inverse * (bent @ step)) * moved
        descent = -(slope @ step)
        size = 1.0
        while True:
            there = at - size * step
            then, new = value(there)
            if then <= now + 1e-4 * size * descent:
                break
            del there, new
            size *= min(max(-0.5 * descent * size / (then - now - descent * size), 0.1), 0.5)
            if size < 1e-10:
                return at
        # In place: what moved, and how the slopes have bent.
        step *= -size
        np.subtract(new, slope, out=slope)
        if (along := step @ slope) > 0:
            # They only lead the way, so half the digits do.
            pairs.append((step.astype(np.float32), slope.astype(np.float32), 1.0 / along))
        at, now, slope = there, then, new
        del step, there, new
        seen = [*seen[:1], *seen[1:][-_WATCHED:], now]
        if max(seen[-_WATCHED:]) - now <= tolerance * abs(seen[0]):
            break
    return at


class Weights(NamedTuple):
    """Weights of the terms and of further numbers."""

    terms: np.ndarray
    own: np.ndarray
    intercept: float


class LexicalRegression:
    """Summed losses of ``packed`` rows and half the squared weights, made least.

    A pass holds a block and one slope for each term per task, however many rows there are, and
    has as many tasks as the session runs at once.
    """

    def __init__(self, trie: Trie, idf: np.ndarray, samples: int, numbers: int, tolerance: float, steps: int) -> None:
        self._trie, self._idf, self._samples, self._numbers = trie, idf, samples, numbers
        self._tolerance, self._steps = tolerance, steps

    def getFeaturesCol(self) -> str:  # noqa: N802
        return "_text"

    def getLabelCol(self) -> str:  # noqa: N802
        return "_label"

    def fit(self, held: DataFrame) -> Weights:
        terms, penalty = len(self._idf), 1.0 / self._samples
        # As a frame they would be pickled anew for each pass, which costs more than the pass.
        blocks = held.select("_text", "_label").rdd.map(tuple).persist(StorageLevel.DISK_ONLY)
        try:
            return self._fitted(blocks, terms, penalty)
        finally:
            blocks.unpersist()

    def _fitted(self, blocks: RDD, terms: int, penalty: float) -> Weights:
        context = blocks.context
        rows, passes, total = blocks.coalesce(max(context.defaultParallelism, 1)), 0, None

        def value(at: np.ndarray) -> tuple[float, np.ndarray]:
            nonlocal passes, total
            weights = context.broadcast(self._trie.chain_sums(self._idf * at[:terms]))
            # An array of few weights would bring all the others along.
            given = partial(_slopes, weights=weights, own=at[terms:-1].copy(), intercept=float(at[-1]))
            summed = dict(rows.mapPartitions(given).reduceByKey(operator.add, rows.getNumPartitions()).collect())
            weights.destroy()
            passes += 1
            if passes % _SWEPT == 0:
                # Shuffled slopes stay until the driver collects its garbage.
                context._jvm.System.gc()
            total, slopes = summed.pop(-1), np.zeros(len(at))
            while summed:
                i, some = summed.popitem()
                slopes[i : i + len(some)] = some
            slopes[:terms] = self._trie.spread(slopes[:terms])
            slopes[:terms] *= self._idf
            slopes[terms:-1], slopes[-1] = total[4:-1], total[3]
            slopes[:-1] += at[:-1]
            slopes *= penalty
            return penalty * (total[2] + 0.5 * (at[:-1] @ at[:-1])), slopes

        zero = np.zeros(terms + self._numbers + 1)
        known = [value(zero)]
        count, ones = total[:2]
        if ones in (0, count):
            return Weights(zero[:terms], zero[terms:-1], np.inf if ones else -np.inf)
        spread = ones / count * (1.0 - ones / count)
        curvature = np.full(len(zero), spread + penalty, np.float32)
        documents = (self._samples + 1.0) / np.exp(self._idf - 1.0) - 1.0
        curvature[:terms] = penalty * (1.0 + spread * documents * self._idf**2 * total[-1] / count)
        del documents
        at = minimise(lambda x: known.pop() if known else value(x), zero, curvature, self._tolerance, self._steps)
        return Weights(at[:terms], at[terms:-1], float(at[-1]))
