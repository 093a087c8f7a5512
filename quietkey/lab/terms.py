"""Character n-grams of many texts at once: counted per batch, found in a vocabulary by a trie."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: n-gram sizes of the lexical models.
NGRAM_SIZES = (3, 4, 5)
#: Characters that are taken apart at once; a longer text is a block of its own.
BLOCK = 1 << 19
_POINT = 21  # bits of a code point
_LETTER, _ROW = 9, 17  # bits of a letter and of a text's number while n-grams are counted
#: Different n-grams of one size that a task adds up, and those that it gives out at once.
_PENDING, _GIVEN = 3 << 20, 1 << 17
#: Characters after which counts are given out, so that they fit 32 bits.
_COUNTED = 1 << 30


def fold_text(text: Column) -> Column:
    """Lower-case text with runs of space collapsed."""
    return F.regexp_replace(F.lower(text), r"(?U)\s\s+", " ")


def _blocks(texts: Sequence[str]) -> Iterator[tuple[int, Sequence[str]]]:
    """Consecutive texts of up to ``BLOCK`` characters, and the number of the first one."""
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BLOCK:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, texts[first:]


def _points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, the text of each, and how many follow in it, itself included."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths)
    return points, owner, np.cumsum(lengths)[owner] - np.arange(len(points))


def _block_counts(texts: Sequence[str]) -> Iterator[pa.RecordBatch]:
    points, owner, left = _points(texts)
    letters, code = np.unique(points, return_inverse=True)
    base = len(letters)
    for n in NGRAM_SIZES:
        at = np.flatnonzero(left >= n)
        if not len(at):
            continue
        key = code[at]
        for k in range(1, n):
            if base ** (k + 1) >= 1 << 62:
                # Numbers of the beginnings take the place of their letters.
                key = np.unique(key, return_inverse=True)[1]
            key = key * base + code[at + k]
        order = np.argsort(key, kind="stable")
        key, row = key[order], owner[at][order]
        new = np.append(True, key[1:] != key[:-1])
        first = np.flatnonzero(new)
        # Equal n-grams stand in the order of their texts.
        documents = np.add.reduceat((new | np.append(True, row[1:] != row[:-1])).astype(np.int64), first)
        windows = points[at[order[first]][:, None] + np.arange(n)]
        yield _counts(_spelled(windows), documents, np.diff(np.append(first, len(key))))


def _spelled(windows: np.ndarray) -> pa.Array:
    """A string of each row of code points."""
    many, n = windows.shape
    if windows.max(initial=0) < 128:
        ends = pa.py_buffer(np.arange(0, many * n + 1, n, dtype=np.int32))
        return pa.StringArray.from_buffers(many, ends, pa.py_buffer(windows.astype(np.uint8).tobytes()))
    spelled = windows.astype(np.uint32).tobytes().decode("utf-32-le")
    return pa.array([spelled[i : i + n] for i in range(0, len(spelled), n)], pa.string())


def _counts(terms: pa.Array, documents: np.ndarray, occurrences: np.ndarray) -> pa.RecordBatch:
    numbers = [pa.array(x.astype(np.int64)) for x in (documents, occurrences)]
    return pa.RecordBatch.from_arrays([terms, *numbers], ["term", "documents", "occurrences"])


class _Counter:
    """Counts of a task's n-grams, added up over its blocks and given out where they grow too many.

    An n-gram is a number of ``_LETTER`` bits for each of its letters.
    """

    def __init__(self) -> None:
        self._restart()

    def _restart(self) -> None:
        self._code = np.full(0x110000, -1, np.int32)
        self._letters = np.zeros(0, np.int64)
        self._parts = {n: [] for n in NGRAM_SIZES}
        self._size = dict.fromkeys(NGRAM_SIZES, 0)
        self._read = 0

    def add(self, texts: Sequence[str]) -> Iterator[pa.RecordBatch]:
        for first in range(0, len(texts), 1 << _ROW):
            yield from self._add(texts[first : first + (1 << _ROW)])

    def _add(self, texts: Sequence[str]) -> Iterator[pa.RecordBatch]:
        points, owner, left = _points(texts)
        seen = np.zeros(len(self._code), bool)
        seen[points] = True
        if seen.sum() > 1 << _LETTER:
            yield from _block_counts(texts)
            return
        if np.count_nonzero(seen & (self._code < 0)) + len(self._letters) > 1 << _LETTER or self._read + len(points) > _COUNTED:
            yield from self.rest()
        new = np.flatnonzero(seen & (self._code < 0))
        self._code[new] = np.arange(len(self._letters), len(self._letters) + len(new))
        self._letters = np.append(self._letters, new)
        self._read += len(points)
        code = self._code[points].astype(np.int64)
        at, key, size = np.arange(len(points)), np.zeros(len(points), np.int64), 0
        for n in NGRAM_SIZES:
            inside = left[at] >= n
            at, key = at[inside], key[inside]
            if not len(at):
                break
            while size < n:
                key = key << _LETTER | code[at + size]
                size += 1
            pair = np.sort(key << _ROW | owner[at])
            term = pair >> _ROW
            start = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
            documents = np.add.reduceat(np.append(True, pair[1:] != pair[:-1]), start, dtype=np.int32)
            self._parts[n].append((term[start], documents, np.diff(np.append(start, len(term))).astype(np.int32)))
            self._size[n] += len(start)
            if self._size[n] > _PENDING:
                self._merge(n)
                if self._size[n] > _PENDING // 2:
                    yield from self._out(n)

    def _merge(self, n: int) -> None:
        if len(self._parts[n]) > 1:
            term, *sums = (np.concatenate(x) for x in zip(*self._parts[n], strict=True))
            self._parts[n] = []
            order = np.argsort(term)
            term = term[order]
            start = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
            self._parts[n] = [(term[start], *(np.add.reduceat(x[order], start) for x in sums))]
            self._size[n] = len(start)

    def _out(self, n: int) -> Iterator[pa.RecordBatch]:
        self._merge(n)
        for term, documents, occurrences in self._parts[n]:
            for i in range(0, len(term), _GIVEN):
                some = slice(i, i + _GIVEN)
                codes = term[some, None] >> np.arange(n - 1, -1, -1) * _LETTER & ((1 << _LETTER) - 1)
                yield _counts(_spelled(self._letters[codes]), documents[some], occurrences[some])
        self._parts[n], self._size[n] = [], 0

    def rest(self) -> Iterator[pa.RecordBatch]:
        for n in NGRAM_SIZES:
            yield from self._out(n)
        self._restart()


def count_terms(texts: DataFrame) -> DataFrame:
    """``(term, documents, occurrences)`` of all n-grams of the column ``text``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for batch in batches:
            for _, block in _blocks(batch.column(0).to_pylist()):
                yield from counter.add(block)
        yield from counter.rest()

    counts = texts.select("text").mapInArrow(counted, "term string, documents long, occurrences long")
    return counts.groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("occurrences").alias("occurrences"))


class Trie(NamedTuple):
    """Per depth the sorted (node above, letter) pairs and the place of the term that ends there, or -1.

    ``above`` has the longest other term that each term begins with, or -1.
    """

    keys: tuple[np.ndarray, ...]
    places: tuple[np.ndarray, ...]
    above: np.ndarray

    def _lengthened(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Terms and the terms that they begin with, shorter ones first."""
        for places in self.places:
            ends = places[places >= 0]
            longer = ends[self.above[ends] >= 0]
            yield longer, self.above[longer]

    def chain_sums(self, values: np.ndarray) -> np.ndarray:
        """The values of each term and of all terms that it begins with, added up."""
        total = np.array(values, float)
        for longer, above in self._lengthened():
            total[longer] += total[above]
        return total

    def spread(self, values: np.ndarray) -> np.ndarray:
        """The values of each term and of all terms that begin with it: the transpose of ``chain_sums``."""
        total = np.array(values, float)
        for longer, above in reversed([*self._lengthened()]):
            np.add.at(total, above, total[longer])
        return total


class Terms:
    """A vocabulary of n-grams; a term's place is its number."""

    def __init__(self, vocabulary: Sequence[str] | pa.Array) -> None:
        self._spelled = vocabulary if isinstance(vocabulary, pa.Array) else pa.array(vocabulary, pa.string())

    @property
    def vocabulary(self) -> tuple[str, ...]:
        return tuple(self._spelled.to_pylist())

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Terms) and self._spelled.equals(other._spelled)

    __hash__ = None

    @cached_property
    def trie(self) -> Trie:
        size = pc.utf8_length(self._spelled).to_numpy(zero_copy_only=False)
        letters = np.zeros((len(size), max(NGRAM_SIZES)), np.uint32)
        for n in NGRAM_SIZES:
            for some in np.array_split(of := np.flatnonzero(size == n), -(-len(of) // _GIVEN) or 1):
                spelled = "".join(self._spelled.take(pa.array(some)).to_pylist()).encode("utf-32-le")
                letters[some] = np.pad(np.frombuffer(spelled, np.uint32).reshape(-1, n), ((0, 0), (0, letters.shape[1] - n)))
        node, keys, places = np.zeros(len(size), np.int64), [], []
        term, above = np.full(1, -1, np.int32), np.full(len(size), -1, np.int32)
        for depth in range(max(NGRAM_SIZES)):
            deep = np.flatnonzero(size > depth)
            level, node[deep] = np.unique(node[deep] << _POINT | letters[deep, depth], return_inverse=True)
            place = np.full(len(level), -1, np.int32)
            ends = np.flatnonzero(size == depth + 1)
            # The last term on the way to each node, that which ends in it included.
            held = term[level >> _POINT]
            above[ends] = held[node[ends]]
            place[node[ends]] = ends
            term = np.where(place >= 0, place, held)
            keys.append(level)
            places.append(place)
        return Trie(tuple(keys), tuple(places), above)

    def save(self, path: str) -> None:
        named = pa.table({"place": np.arange(len(self._spelled)), "term": self._spelled})
        SparkSession.active().createDataFrame(named).coalesce(1).write.parquet(path)

    @staticmethod
    def load(path: str) -> Terms:
        named = SparkSession.active().read.parquet(path).toArrow().sort_by("place")
        return Terms(named["term"].combine_chunks())


class Chains(NamedTuple):
    """Terms of some texts. A term also stands for those that it begins with.

    What a text holds of the sums of ``Trie.chain_sums`` is one for each ``text`` that names it, and
    ``share`` for each ``of``: 1 + ln(count) of all its terms then. Both are ordered by term, so
    that sums are met in the order in which they lie in memory.
    """

    #: Different terms, how many texts follow for each, and their numbers.
    term: np.ndarray
    times: np.ndarray
    text: np.ndarray
    other: np.ndarray
    others: np.ndarray
    of: np.ndarray
    share: np.ndarray
    #: Sum of (1 + ln(count)) squared times a value of each term, for each text.
    squares: np.ndarray


def _by_term(code: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, texts of each and their numbers, of sorted numbers term * ``texts`` + text."""
    term, text = np.divmod(code, texts)
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
    times = np.diff(np.append(first, len(term)))
    return term[first].astype(np.int32), times.astype(np.int32), text.astype(np.uint16 if texts <= 1 << 16 else np.int32)


def chains(texts: Sequence[str], trie: Trie, squared: np.ndarray) -> Iterator[Chains]:
    """The terms of each block of texts; ``squared``: the ``chain_sums`` of what squares are weighed with.

    Every place of a text is found by the longest term that begins there, without counting, unless
    some term there stands in the text again: those terms are counted one by one.
    """
    many = max(len(trie.above), 1)
    for _, block in _blocks(texts):
        points, owner, left = _points(block)
        # Neighbours in this order meet neighbours in the trie.
        near, code = np.append(points, np.zeros(max(NGRAM_SIZES), np.int64)) & 0xFFF, np.zeros(len(points), np.int64)
        for k in range(max(NGRAM_SIZES)):
            code = code << 12 | near[k : k + len(points)]
        at, node = np.argsort(code), np.zeros(len(points), np.int64)
        first, last = np.full(len(points), -1, np.int32), np.full(len(points), -1, np.int32)
        for depth, (keys, places) in enumerate(zip(trie.keys, trie.places, strict=True)):
            if not len(keys):
                break
            inside = left[at] > depth
            at = at[inside]
            key = node[inside] << _POINT | points[at + depth]
            found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[found] == key
            at, node = at[hit], found[hit]
            place = places[node]
            here = at[ended := place >= 0]
            last[here] = place[ended]
            first[here] = np.where(first[here] < 0, place[ended], first[here])
        at = np.flatnonzero(last >= 0)
        # A term that stands again begins with the same first term there.
        code = owner[at] * many + first[at]
        order, same, again = np.argsort(code), np.zeros(len(at) + 1, bool), np.zeros(len(at), bool)
        same[1:-1] = np.diff(code[order]) == 0
        again[order] = same[1:] | same[:-1]
        size = len(block)
        row, term = owner[at[~again]], last[at[~again]].astype(np.int64)
        more, of, codes = last[at[again]], owner[at[again]], []
        while len(more):
            codes.append(more.astype(np.int64) * size + of)
            of, more = of[on := trie.above[more] >= 0], trie.above[more][on]
        code, count = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]), return_counts=True)
        other, text = np.divmod(code, size)
        share = 1.0 + np.log(count)
        above = trie.above[other].astype(np.int64)
        own = squared[other] - np.where(above >= 0, squared[above], 0.0)
        squares = np.bincount(row, squared[term], size) + np.bincount(text, share * share * own, size)
        # A longer term brings the sums of those that it begins with.
        longer = np.flatnonzero(above >= 0)
        np.subtract.at(share, np.searchsorted(code, above[longer] * size + text[longer]), 1.0 + np.log(count[longer]))
        held = share != 0.0
        yield Chains(*_by_term(np.sort(term * size + row), size), *_by_term(code[held], size), share[held], squares)


def held_terms(texts: Sequence[str], trie: Trie) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and count of every n-gram of the vocabulary, ordered by text and term."""
    parts = [np.zeros((3, 0), np.int64)]
    for first, block in _blocks(texts):
        points, owner, left = _points(block)
        at, node, codes = np.arange(len(points)), np.zeros(len(points), np.int64), []
        terms = max(sum((p >= 0).sum() for p in trie.places), 1)
        for depth, (keys, places) in enumerate(zip(trie.keys, trie.places, strict=True)):
            if not len(keys):
                break
            inside = left[at] > depth
            at = at[inside]
            key = node[inside] << _POINT | points[at + depth]
            found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[found] == key
            at, node = at[hit], found[hit]
            place = places[node]
            ended = place >= 0
            codes.append(owner[at[ended]] * terms + place[ended])
        code, count = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]), return_counts=True)
        parts.append(np.stack([code // terms + first, code % terms, count]))
    row, term, count = np.concatenate(parts, axis=1)
    return row, term, count
