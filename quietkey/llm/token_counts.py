"""Token counts of a byte-level BPE, by merging whole arrays of pre-tokens at once.

The distinct pre-tokens of a batch lie end to end in one symbol array. In every round each
pre-token finds its lowest-rank pair and all of them are merged together; when no pre-token
has a known pair, the symbols that are left are counted. The vocabulary file is a parameter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietkey.llm.common import table, text_or_empty

#: Fixed value: how the public byte-level vocabulary splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 512
#: Chunks counted at once, and remembered by a task.
BATCH, REMEMBERED = 1 << 15, 1 << 18
_WIDE_SPACE = re.compile(r"\s\s")
_NONE = np.iinfo(np.int32).max


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else the next from U+0100."""
    plain = [b for b in range(256) if chr(b).isprintable() and chr(b) not in " \xa0\xad"]
    other = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class MergeTable:
    """Ranks of symbol pairs, as sorted keys, and what each pair becomes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.first = np.zeros(256, np.int32)
        for symbol, byte in _byte_symbols().items():
            self.first[byte] = vocab[symbol]
        grid = np.arange(256)
        self.bytes = self.pair_ranks(self.first[np.repeat(grid, 256)], self.first[np.tile(grid, 256)]).reshape(256, 256)
        self.special = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE)

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that each non-empty pre-token is left with."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        data = np.frombuffer(b"".join(tokens), np.uint8)
        symbols = self.first[data]
        owner = np.repeat(np.arange(len(tokens), dtype=np.int32), lengths)
        # ranks[i] belongs to the pair (i, i + 1); pairs across pre-tokens have none.
        ranks = np.full(len(symbols), _NONE, np.int32)
        ranks[:-1] = np.where(owner[:-1] == owner[1:], self.bytes[data[:-1], data[1:]], _NONE)
        done = np.zeros(len(tokens), np.int64)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[:-1] != owner[1:]])
            lowest = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            over = lowest == _NONE
            done[owner[starts[over]]] = sizes[over]
            where = np.flatnonzero((ranks == np.repeat(lowest, sizes)) & (ranks != _NONE))
            if len(where) > 1:
                # Of overlapping hits (a a a) every second counts, from the left.
                new_run = np.r_[True, np.diff(where) != 1]
                place = np.arange(len(where)) - np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
                where = where[place % 2 == 0]
            symbols[where] = self.merged[ranks[where]]
            stays = ~np.repeat(over, sizes)
            stays[where + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[where] = True
            changed[where[where > 0] - 1] = True
            before = where - 1  # a pair may start at a symbol that was just merged away
            changed[(where - 2)[(before >= 0) & ~stays[before]]] = True
            symbols, owner, ranks, changed = symbols[stays], owner[stays], ranks[stays], changed[stays]
            at = np.flatnonzero(changed)
            if len(at):
                ranks[at] = _NONE
                at = at[at < len(symbols) - 1]
                at = at[owner[at] == owner[at + 1]]
                ranks[at] = self.pair_ranks(symbols[at], symbols[at + 1])
        return done


@lru_cache(maxsize=4)
def _loaded(path: str) -> MergeTable:
    return MergeTable(path)


class TokenCounter:
    """Counts tokens of texts; keeps the counts of chunks it has met, up to a bound.

    Where white space stands alone, every blank starts a pre-token, so a text can be cut there
    and the chunks repeat; other texts are cut into pre-tokens.
    """

    def __init__(self, path: str):
        self.table = _loaded(path)
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, self.table.special))) if self.table.special else None
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.tokens: dict[str, int] = {}

    def _pieces(self, text: str) -> Iterator[str | None]:
        """Stretches of ordinary text; None for each special token."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[at : m.start()]
            yield None
            at = m.end()
        yield text[at:]

    def _chunks(self, piece: str) -> Iterator[list[str]]:
        """``piece``, cut where pre-tokens are cut, in lists of bounded size."""
        if _WIDE_SPACE.search(piece):
            found = (m[0] for m in self.split.finditer(piece))
            while tokens := list(islice(found, BATCH)):
                yield tokens
            return
        start = 0
        while start < len(piece):
            end = piece.find(" ", start + 8 * BATCH)
            first, *rest = piece[start : end if end > 0 else len(piece)].split(" ")
            yield ([first] if first else []) + [" " + x for x in rest]
            start = end if end > 0 else len(piece)

    def _counts(self, chunks: list[str]) -> list[int]:
        known = self.known
        if new := set(chunks).difference(known):
            if len(known) + len(new) > REMEMBERED:
                self.older, self.known = known, {}
                known, new = self.known, set(chunks)
            met = new.intersection(self.older)
            known.update((c, self.older[c]) for c in met)
            new = list(new - met)
            split = list(map(self.split.findall, new))
            tokens = self.tokens
            fresh = list({t for x in split for t in x}.difference(tokens))
            if fresh:
                if len(tokens) > REMEMBERED:
                    tokens.clear()
                    fresh = list({t for x in split for t in x})
                tokens.update(zip(fresh, self.table.count([t.encode("utf-8") for t in fresh]).tolist(), strict=True))
            known.update((c, sum(tokens[t] for t in x)) for c, x in zip(new, split, strict=True))
        return list(map(known.__getitem__, chunks))

    def count(self, text: str) -> int:
        return self.count_each([text])[0]

    def count_each(self, texts: list[str]) -> list[int]:
        """Tokens of every text; pre-tokens of several texts share an array."""
        totals = [0] * len(texts)
        held: list[str] = []
        ends: list[tuple[int, int]] = []  # of the stretch of a text in held

        def flush() -> None:
            at, counts = 0, self._counts(held)
            for text, end in ends:
                totals[text] += sum(counts[at:end])
                at = end
            held.clear()
            ends.clear()

        for i, text in enumerate(texts):
            for piece in self._pieces(text):
                if piece is None:
                    totals[i] += 1
                    continue
                for chunks in self._chunks(piece):
                    held += chunks
                    ends.append((i, len(held)))
                    if len(held) >= BATCH:
                        flush()
        if held:
            flush()
        return totals


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def token_count(text: Column, path: str) -> Column:
    """Tokens of ``text`` as the vocabulary file's library counts them, special strings included."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = TokenCounter(path)
        for texts in batches:
            yield pd.Series(counter.count_each(list(texts)), dtype="int64")

    return counted(text)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = TOKEN_LIMIT, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    ``path`` is the vocabulary file, present on every worker. A null or empty text has no bytes
    and no tokens. Texts of any length are read in bounded pieces. Rows are counted one by
    one: repeated rows and ties don't matter, an empty table gives an empty result, other
    columns stay, columns named like the results are replaced. No shuffle.
    """
    body = text_or_empty(text)
    counts = {"n_bytes": F.octet_length(body).cast("long"), "n_tokens": token_count(body, path or default_vocabulary())}
    return docs.withColumns(counts).withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")
