"""SentencePiece BPE, encoded from a table of prefixes and decoded back.

In a BPE every prefix of a text has one last token: the token that ends there and may stand
behind the last token of the prefix before it. An automaton over the vocabulary names the
tokens that end at each place, a pair test (would the merges of both, run together, leave them
apart?) picks the one that fits, and the ids are read off the table from the end. The pair test
replays the merges by score, the leftmost of equals first, so it holds for any score order.
The vocabulary file is a parameter.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietkey.llm.common import free_name, table, text_or_empty

VOCABULARY = "piece_bpe_32k.model"
#: How the format writes a blank.
BLANK = "▁"
#: Chunks and pairs that a worker remembers, and the longest chunk that it does.
REMEMBERED, LONGEST = 1 << 17, 256
#: A text is read in stretches of about so many characters.
STRETCH = 1 << 18


class PieceTable:
    """A vocabulary with byte fallback, its automaton and its pair test."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("  ﬁ  x ") != f"{BLANK * 3}ﬁ{BLANK * 2}x{BLANK}":
            raise ValueError("only models with a leading blank and no other normalisation are read")
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.end = model.eos_id()
        control = [model.is_control(i) or model.is_unknown(i) for i in range(size)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        if len(self.bytes) != 256 or any(model.is_unused(i) for i in range(size)):
            raise ValueError("only models with all byte pieces and no unused ones are read")
        plain = {p: i for i, p in enumerate(self.pieces) if not (control[i] or model.is_byte(i))}
        self.scores = {p: model.get_score(i) for p, i in plain.items()}
        self.lengths = [len(p) for p in self.pieces]
        #: Bytes that an id stands for; control pieces have none, the unknown one has its mark.
        self.token_bytes = [b"" if control[i] else p.replace(BLANK, " ").encode("utf-8") for i, p in enumerate(self.pieces)]
        self.token_bytes[model.unk_id()] = model.decode([model.unk_id()]).encode("utf-8")
        self.control = {i for i in range(size) if model.is_control(i)}
        self.blank_first = {i for p, i in plain.items() if p.startswith(BLANK)}
        for byte, i in self.bytes.items():
            self.token_bytes[i] = bytes([byte])
        self.automaton = ahocorasick.Automaton()
        for piece, i in plain.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.singles = {p for p in plain if len(p) == 1}
        self.tests: dict[int, bool] = {}
        inner = any(BLANK in p.lstrip(BLANK) for p in plain)
        self.chunk = re.compile(".+" if inner else _chunk_pattern(plain), re.DOTALL)
        self.edge = None if inner else re.compile(f"(?<=[^{BLANK}])(?={BLANK})")

    def _apart(self, left: str, right: str) -> bool:
        """Whether the merges of both texts end in just these two, none across their edge."""
        symbols, edge = [*left, *right], len(left)
        scores = self.scores
        while True:
            best, at = -np.inf, -1
            for i in range(len(symbols) - 1):
                score = scores.get(symbols[i] + symbols[i + 1])
                if score is not None and score > best:
                    best, at = score, i
            if at < 0:
                return edge == min(len(left), 1) and len(symbols) == edge + 1
            if at + 1 == edge:
                return False
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            edge -= at + 1 < edge

    def compatible(self, left: int, right: int) -> bool:
        """Whether token ``right`` may follow token ``left``; -1 is the start of a stretch."""
        if len(self.tests) > 4 * REMEMBERED:
            self.tests.clear()
        fits = self.tests[left * len(self.pieces) + right] = self._apart(self.pieces[left] if left >= 0 else "", self.pieces[right])
        return fits

    def _known(self, text: str) -> list[int]:
        """Ids of a stretch whose characters are all pieces."""
        last, lengths, tests, size = [-1] * (len(text) + 1), self.lengths, self.tests, len(self.pieces)
        for end, token in self.automaton.iter(text):
            if last[end + 1] < 0:
                left = last[end + 1 - lengths[token]]
                fits = tests.get(left * size + token)
                if self.compatible(left, token) if fits is None else fits:
                    last[end + 1] = token
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= lengths[last[at]]
        return ids[::-1]

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a chunk of marked text; characters without a piece give their bytes."""
        ids: list[int] = []
        singles, start = self.singles, 0
        if singles.issuperset(chunk):
            return self._known(chunk)
        for i, c in enumerate(chunk):
            if c not in singles:
                ids += self._known(chunk[start:i])
                ids += [self.bytes[b] for b in c.encode("utf-8")]
                start = i + 1
        return ids + self._known(chunk[start:])


def _chunk_pattern(vocabulary: Iterable[str]) -> str:
    """Cuts marked text where no merge can cross: at blanks, and between characters that no chain
    of neighbours within pieces connects, such as letters and punctuation."""
    leader: dict[str, str] = {}

    def lead(c: str) -> str:
        while leader.setdefault(c, c) != c:
            c = leader[c]
        return c

    for piece in vocabulary:
        text = piece.lstrip(BLANK)
        for x, y in zip(text, text[1:], strict=False):
            leader[lead(x)] = lead(y)
    groups: dict[str, set[str]] = {}
    for c in leader:
        groups.setdefault(lead(c), set()).add(c)
    ascii_ = set(map(chr, range(128))) - {BLANK}
    alone = sorted(ascii_.difference(leader))
    *others, _ = sorted((sorted(g) for g in groups.values() if g & ascii_), key=len)
    sets = ["".join(map(re.escape, g)) for g in others]
    rest = f"[^{BLANK}{''.join(map(re.escape, alone))}{''.join(sets)}]+"
    runs = "|".join([rest, *(f"[{g}]+" for g in sets)])
    single = f"|[{''.join(map(re.escape, alone))}]" if alone else ""
    return f"{BLANK}*(?:{runs})|{BLANK}+{single}"


@lru_cache(maxsize=4)
def piece_table(path: str) -> PieceTable:
    return PieceTable(path)


class PieceCoder:
    """Encodes and decodes; keeps the ids of chunks it has met, up to a bound."""

    def __init__(self, path: str):
        self.table = piece_table(path)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _learn(self, chunk: str) -> tuple[int, ...]:
        ids = self.older.get(chunk) or tuple(self.table.chunk_ids(chunk))
        if len(chunk) <= LONGEST:
            self.known[chunk] = ids
        return ids

    def of_chunks(self, chunks: Iterable[str]) -> list[tuple[int, ...]]:
        """The ids of every chunk; those not met for a while are forgotten."""
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        known, learn = self.known.get, self._learn
        return [known(c) or learn(c) for c in chunks]

    def _stretches(self, marked: str) -> Iterator[str]:
        start = 0
        while start < len(marked):
            cut = self.table.edge.search(marked, start + STRETCH) if self.table.edge and len(marked) - start > STRETCH else None
            end = cut.start() if cut else len(marked)
            yield marked[start:end]
            start = end

    def encode(self, text: str) -> array:
        """Ids of ``text`` with the end id; an empty text has that one only."""
        marked, ids = BLANK + text.replace(" ", BLANK) if text else "", array("i")
        for stretch in self._stretches(marked):
            ids.extend(chain.from_iterable(self.of_chunks(self.table.chunk.findall(stretch))))
        ids.append(self.table.end)
        return ids

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ``ids``: pieces and bytes in a row, without the blank of a first piece.

        Control ids part runs of bytes; bytes that are no UTF-8 give U+FFFD each.
        """
        token_bytes, control, runs = self.table.token_bytes, self.table.control, [[]]
        if control.isdisjoint(ids[:-1]):
            runs = [ids[:-1] if ids and ids[-1] in control else ids]
        else:
            for i in ids:
                runs.append([]) if i in control else runs[-1].append(i)
        first = next((run[0] for run in runs if run), None)
        text = "".join(_valid(b"".join(map(token_bytes.__getitem__, run))) for run in runs)
        return text[1:] if first in self.table.blank_first else text


def _valid(data: bytes) -> str:
    """``data`` as text, U+FFFD for every byte that is part of no character."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            try:
                out.append(data[at:].decode("utf-8"))
                break
            except UnicodeDecodeError as bad:
                out.append(data[at : at + bad.start].decode("utf-8") + "�")
                at += bad.start + 1
        return "".join(out)


@lru_cache(maxsize=4)
def coder(path: str) -> PieceCoder:
    """One coder per worker and vocabulary, so that tasks share what it remembers."""
    return PieceCoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _encoded(texts: Iterable[pa.Scalar], path: str) -> Iterator[array]:
    return (coder(path).encode(t.as_py() or "") for t in texts)


def _lists(rows: Iterable[array]) -> pa.ListArray:
    """One Arrow array of all ids, a list per row."""
    ids, ends = array("i"), array("i", [0])
    for row in rows:
        ids.extend(row)
        ends.append(len(ids))
    return pa.ListArray.from_arrays(np.asarray(ends, np.int32), np.asarray(ids, np.int32))


def encode_pieces(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``: every whole text encoded, one end id behind it.

    ``path`` is the vocabulary file, present on every worker. A null or empty text has the end id
    only. Characters without a piece give their UTF-8 bytes. Rows are encoded one by one: repeats
    and ties don't matter, an empty table gives an empty result, other columns stay, a column
    ``ids`` is replaced. No shuffle.
    """
    path = path or default_vocabulary()

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return _lists(_encoded(texts, path))

    return docs.withColumn("ids", ids(text_or_empty(text)))


def decode_pieces(encoded: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ids; null ids count as none."""
    path = path or default_vocabulary()

    @F.arrow_udf("string")
    def decoded(rows: pa.Array) -> pa.Array:
        return pa.array((coder(path).decode(x.as_py()) for x in rows), pa.string())

    return encoded.withColumn("decoded", decoded(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def code_pieces(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``encode_pieces`` and ``decode_pieces`` in one pass: ``docs`` with ``ids`` and ``decoded``."""
    path = path or default_vocabulary()

    @F.arrow_udf("struct<ids array<int>, decoded string>")
    def coded(texts: pa.Array) -> pa.Array:
        decoded = []

        def both() -> Iterator[array]:
            for row in _encoded(texts, path):
                decoded.append(coder(path).decode(row))
                yield row

        return pa.StructArray.from_arrays([_lists(both()), pa.array(decoded, pa.string())], ["ids", "decoded"])

    pair = free_name(docs, "coded")
    return docs.withColumn(pair, coded(text_or_empty(text))).withColumns({n: F.col(f"{pair}.{n}") for n in ("ids", "decoded")}).drop(pair)


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = code_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
