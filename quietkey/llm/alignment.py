"""Cross-tokenizer alignment: where two tokenizers of one text end together, and what they link.

Both id lists have cumulative byte ends; a dictionary per list leads from an end to its index.
The sorted common keys of both dictionaries slice the lists into groups, and within a slice
the tokens whose byte ranges overlap are linked. Texts are cut at single blanks between words,
where both tokenizers always end, so a stretch that repeats is aligned once.

How many documents hold a pair is counted over the whole table. Documents lie in blocks of
bounded size: a block's pairs are counted before anything is shuffled, and the counts come
back to the block, not to every document. The vocabulary files are parameters.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietkey.llm import pieces, token_counts
from quietkey.llm.common import table, text_or_empty, written

#: Characters of a block of documents, about; a longer text is a block of its own.
BLOCK_CHARS = 1 << 20
#: Stretches, links in them, and words with their ids that a worker remembers.
REMEMBERED, LINKS_REMEMBERED, WORDS_REMEMBERED = 1 << 17, 1 << 22, 3 << 15
#: Texts are cut into stretches in parts of about so many characters.
PART = 1 << 18
#: A pair of ids in one number: the first id times this, plus the second.
SECOND = 1 << 31
_CUT = re.compile(r"(?<=\S) (?=\S)")
_WIDE = re.compile(r"\s\s")
#: Behind a letter neither tokenizer joins a mark of ASCII to it.
_MARK = regex.compile(r"(?<=\p{L})(?=[!-/:-@\[-`{-~])")


def common_cuts(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[list[int], list[int]]:
    """Where the groups of two token lists of equal bytes end, as indexes behind their last tokens."""
    index_a = dict(zip(np.cumsum(lengths_a).tolist(), range(1, len(lengths_a) + 1), strict=True))
    index_b = dict(zip(np.cumsum(lengths_b).tolist(), range(1, len(lengths_b) + 1), strict=True))
    common = list(filter(index_b.__contains__, index_a))  # ends ascend, and so do the keys
    return list(map(index_a.__getitem__, common)), list(map(index_b.__getitem__, common))


def slice_links(lengths_a: np.ndarray, lengths_b: np.ndarray, cuts_a: list[int], cuts_b: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slice, index in a and index in b of every two tokens whose byte ranges overlap.

    Within a slice each end of either list closes one overlap, so the ends expand into the links.
    """
    ends_a, ends_b = np.cumsum(lengths_a), np.cumsum(lengths_b)
    # The last end of a slice is common to both lists and counts once.
    inner = np.ones(len(ends_b), bool)
    inner[np.array(cuts_b, np.int64) - 1] = False
    ends = np.sort(np.concatenate([ends_a, ends_b[inner]]))
    return np.searchsorted(ends_a[np.array(cuts_a, np.int64) - 1], ends), np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


def cut_text(text: str) -> Iterator[list[str]]:
    """``text`` in stretches that begin with a blank, in lists of bounded size."""
    start = 0
    while start < len(text):
        cut = _CUT.search(text, start + PART) if len(text) - start > PART else None
        end = cut.start() if cut else len(text)
        part = text[start:end]
        if part[0] == " " and not _WIDE.search(part) and not part[-1].isspace():
            yield [f" {x}" for x in part[1:].split(" ")]
        else:
            first, *rest = _CUT.split(part)
            yield [first, *(f" {x}" for x in rest)]
        start = end


class Numbers(dict):
    """Numbers of texts; a text that is asked for the first time gets the next one."""

    def __missing__(self, text: str) -> int:
        number = self[text] = len(self)
        return number


class Aligner:
    """Aligns stretches with two vocabularies and remembers what it has aligned, up to a bound."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        known = Tokenizer.from_file(path_a)
        symbol = known.id_to_token
        merges = token_counts.MergeTable(path_a)
        byte = {symbol(i): b for b, i in enumerate(merges.first.tolist())}
        special = {t.content for t in known.get_added_tokens_decoder().values()}
        ids = range(known.get_vocab_size())
        self.bytes_a = [b"" if symbol(i) in special else bytes(byte[c] for c in symbol(i)) for i in ids]
        ranks = {of: i for i, of in enumerate(self.bytes_a) if of}
        if len(ranks) != 256 + len(merges.merged) or (np.diff(merges.merged) <= 0).any():
            raise ValueError("only byte-level vocabularies whose ids follow their merges are read")
        # The same vocabulary, read by the faster of its two libraries; special strings are plain text.
        self.encode_a = tiktoken.Encoding("a", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.coder = pieces.coder(path_b)
        self.bytes_b = self.coder.table.token_bytes
        self.marks_apart = not any(_MARK.search(p) for p in self.coder.table.scores)
        self.ids: dict[str, tuple[bytes, bytes, bool]] = {}
        self.older: dict[str, tuple[bytes, bytes, bool]] = {}
        self.names = list(map(str, range(max(len(self.bytes_a), len(self.bytes_b)))))
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.known = Numbers()
        self.groups: list[str] = []
        #: Of each stretch: tokens of a and b, groups, links, whether both lists give it back, its first link.
        self.facts = array("q")
        self.links = array("q")
        self.forget()

    def forget(self) -> None:
        """Starts anew; what was known until now can be recalled until the next time."""
        self.old_known, self.old_groups = self.known, self.groups
        self.old_facts, self.old_links = np.array(self.facts, np.int64).reshape(-1, 6), np.array(self.links, np.int64)
        self.known, self.groups, self.facts, self.links = Numbers(), [], array("q"), array("q")

    def _keep(self, stretches: list[str], groups: list[str], facts: np.ndarray, links: np.ndarray) -> None:
        """Notes the alignment of ``stretches``; the last column of ``facts`` is filled in here."""
        ends = np.cumsum(facts[:, 3])
        facts[:, 5] = len(self.links) + ends - facts[:, 3]
        self.known.update(zip(stretches, range(len(self.groups), len(self.groups) + len(stretches)), strict=True))
        self.groups += groups
        self.facts.frombytes(facts.tobytes())
        self.links.frombytes(links.tobytes())

    def _recall(self, stretches: list[str]) -> None:
        at = np.fromiter(map(self.old_known.__getitem__, stretches), np.int64, len(stretches))
        facts = self.old_facts[at]
        self._keep(stretches, list(map(self.old_groups.__getitem__, at.tolist())), facts, self.old_links[_ranges(facts[:, 5], facts[:, 3])])

    def _read(self, words: set[str]) -> None:
        """Notes the ids of words and marks by both vocabularies, and whether they give the word back."""
        if len(self.ids) > WORDS_REMEMBERED:
            self.older, self.ids = self.ids, {}
        known, words = self.ids, words.difference(self.ids)
        known.update((x, self.older[x]) for x in words.intersection(self.older))
        new = list(words.difference(self.older))
        # The library adds a blank to what it reads; the rest is read as it stands.
        begun = [x for x in new if x[0] == " " and len(x) > 1]
        of_b = dict(zip(begun, self.pieces.encode([x[1:] for x in begun], num_threads=1), strict=True)) if begun else {}
        bytes_a, bytes_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        for x in new:
            a, b, text = self.encode_a(x), of_b.get(x) or self._marked(x), x.encode("utf-8")
            whole = b"".join(map(bytes_a, a)) == text == b"".join(map(bytes_b, b))
            known[x] = (array("i", a).tobytes(), array("i", b).tobytes(), whole)

    def _marked(self, text: str) -> list[int]:
        chunks = self.coder.table.chunk.findall(text.replace(" ", pieces.BLANK))
        return list(chain.from_iterable(self.coder.of_chunks(chunks)))

    def _learn(self, stretches: list[str]) -> None:
        """Aligns ``stretches``, put together from their words and marks, in one go."""
        apart = self.marks_apart
        parts = [_MARK.split(x) if apart and not x[1:].isalnum() else [x] for x in stretches]
        words, sizes = list(chain.from_iterable(parts)), np.fromiter(map(len, parts), np.int64, len(parts))
        self._read(set(words))
        read, starts = list(map(self.ids.__getitem__, words)), np.cumsum(sizes) - sizes
        whole = np.logical_and.reduceat(np.fromiter((r[2] for r in read), bool, len(read)), starts)
        if not whole.all():  # ids of other stretches are left out
            read = [r if w else (b"", b"", False) for r, w in zip(read, np.repeat(whole, sizes).tolist(), strict=True)]
        held_a, held_b = [r[0] for r in read], [r[1] for r in read]
        ids_a, ids_b = (np.frombuffer(b"".join(x), np.int32).astype(np.int64) for x in (held_a, held_b))
        n_a, n_b = (np.add.reduceat(np.fromiter(map(len, x), np.int64, len(x)), starts) // 4 for x in (held_a, held_b))
        sizes_a, sizes_b = self.sizes_a[ids_a], self.sizes_b[ids_b]
        cuts_a, cuts_b = common_cuts(sizes_a, sizes_b)
        part, i, j = slice_links(sizes_a, sizes_b, cuts_a, cuts_b)
        names_a, names_b = list(map(self.names.__getitem__, ids_a.tolist())), list(map(self.names.__getitem__, ids_b.tolist()))
        sides = zip([0, *cuts_a], cuts_a, [0, *cuts_b], cuts_b, strict=False)
        join = ",".join
        texts = [
            f"{names_a[p] if q - p == 1 else join(names_a[p:q])}|{names_b[r] if s - r == 1 else join(names_b[r:s])}"
            for p, q, r, s in sides
        ]
        # A stretch ends where its tokens do, so its slices and links are counted from those ends.
        ends = np.searchsorted(np.array(cuts_a, np.int64), np.cumsum(n_a), side="right")
        stops = np.searchsorted(part, ends)
        n_groups, n_links = np.diff(ends, prepend=0), np.diff(stops, prepend=0)
        groups = [";".join(texts[e - n : e]) for e, n in zip(ends.tolist(), n_groups.tolist(), strict=True)]
        facts = np.column_stack([n_a, n_b, n_groups, n_links, whole, np.zeros(len(whole))]).astype(np.int64)
        self._keep(stretches, groups, facts, ids_a[i] * SECOND + ids_b[j])

    def _fold(self, waiting: list[tuple[int, list[str]]], out: dict[str, list]) -> None:
        """Adds to ``out`` what the stretches ``waiting`` give to their texts."""
        if len(self.known) > REMEMBERED or len(self.links) > LINKS_REMEMBERED:
            self.forget()
        begun = len(self.known)
        numbered = [np.fromiter(map(self.known.__getitem__, x), np.int64, len(x)) for _, x in waiting]
        # New stretches have got the next numbers; those that are recalled come first, however.
        met = list(islice(self.known, begun, None))
        recalled = np.fromiter(map(self.old_known.__contains__, met), bool, len(met))
        order = np.argsort(~recalled, kind="stable")
        place = np.arange(begun + len(met))
        place[begun + order] = place[begun:].copy()
        met = list(map(met.__getitem__, order.tolist()))
        if old := met[: recalled.sum()]:
            self._recall(old)
        if new := met[len(old) :]:
            self._learn(new)
        facts = np.array(self.facts, np.int64).reshape(-1, 6)
        links = np.array(self.links, np.int64)
        owners, numbers = [], []
        for (i, _), found in zip(waiting, numbered, strict=True):
            held = place[found]
            out["whole"][i] &= bool(facts[held, 4].all())
            if out["whole"][i]:
                out["totals"][i] += facts[held, :4].sum(axis=0)
                out["groups"][i].append(";".join(map(self.groups.__getitem__, held.tolist())))
                owners.append(np.full(len(held), i))
                numbers.append(held)
        if not owners:
            return
        # Each stretch of a text gives its links once, times how often it stands there.
        cells, times = np.unique(np.concatenate(owners) * len(self.groups) + np.concatenate(numbers), return_counts=True)
        text, stretch = cells // len(self.groups), cells % len(self.groups)
        counts = facts[stretch, 3]
        out["links"].append(_summed(np.repeat(text, counts), links[_ranges(facts[stretch, 5], counts)], np.repeat(times, counts)))

    def block(self, texts: list[str]) -> dict[str, list | np.ndarray]:
        """The alignment of every text; ``text``, ``pair`` and ``times`` are its links, sorted."""
        out = {"whole": [True] * len(texts), "totals": np.zeros((len(texts), 4), np.int64), "groups": [[] for _ in texts], "links": []}
        waiting, chars = [], 0
        for i, text in enumerate(texts):
            for part in cut_text(f" {text}") if text else ():
                waiting.append((i, part))
                chars += min(len(text), PART)
                if chars > BLOCK_CHARS:
                    self._fold(waiting, out)
                    waiting, chars = [], 0
        if waiting:
            self._fold(waiting, out)
        whole = np.array(out["whole"], bool)
        out["totals"][~whole] = 0
        none = np.empty(0, np.int64)
        text, pair, times = (np.concatenate([none, *x]) for x in (zip(*out["links"], strict=True) if out["links"] else ((), (), ())))
        held = whole[text]
        text, pair, times = _summed(text[held], pair[held], times[held])
        groups = [";".join(x) if w else "" for x, w in zip(out["groups"], out["whole"], strict=True)]
        return {"totals": out["totals"], "groups": groups, "text": text, "pair": pair, "times": times}


def _ranges(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places ``first, first + 1, ...`` of every range, one after the other."""
    return np.repeat(firsts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _summed(text: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``times`` added up by text and pair, in that order."""
    names, local = np.unique(pair, return_inverse=True)
    size = max(len(names), 1)
    cells, inverse = np.unique(text * size + local, return_inverse=True)
    sums = np.zeros(len(cells), np.int64)
    np.add.at(sums, inverse, times)
    return cells // size, names[cells % size] if len(names) else cells, sums


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner per worker and pair of vocabularies."""
    return Aligner(path_a, path_b)


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > BLOCK_CHARS:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


RESULT = "block long, n_a long, n_b long, n_groups long, n_links long, groups string, link_a array<int>, link_b array<int>, link_times array<int>"


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, its ``block`` and the alignment of its whole text.

    ``path_a`` is a byte-level vocabulary, which reads a blank and the text, ``path_b`` one of
    pieces, which adds that blank itself. ``groups`` lists the slices as ``a1,a2|b1;a3|b2``;
    ``link_a``, ``link_b`` and ``link_times`` are the distinct linked id pairs and how often they
    are linked. A null or empty text, or one whose bytes a vocabulary doesn't give back, has
    no tokens, groups or links. A null id stays null, repeated rows are rows of their own, other
    columns are not read, an empty table gives an empty result. No shuffle.
    """
    path_a, path_b = path_a or token_counts.default_vocabulary(), path_b or pieces.default_vocabulary()
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("body"))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        gc.disable()  # what is remembered has no cycles, and looking for them costs a tenth of the time
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for start, end in _blocks(texts):
                got = work.block(texts[start:end])
                ends = np.r_[0, np.cumsum(np.bincount(got["text"], minlength=end - start))].astype(np.int32)
                lists = (got["pair"] // SECOND, got["pair"] % SECOND, got["times"])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, end - start), pa.array(np.full(end - start, number)), *(pa.array(x) for x in got["totals"].T), pa.array(got["groups"], pa.string())]
                    + [pa.ListArray.from_arrays(ends, x.astype(np.int32)) for x in lists],
                    ["doc_id", "block", "n_a", "n_b", "n_groups", "n_links", "groups", "link_a", "link_b", "link_times"],
                )
                number += 1

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(aligned, f"doc_id {kind}, {RESULT}")


def block_pairs(aligned: DataFrame) -> DataFrame:
    """``(block, link_a, link_b, n_docs)``: documents of a block that hold a pair linked."""
    links = aligned.select("block", F.explode(F.arrays_zip("link_a", "link_b")).alias("link"))
    return links.groupBy("block", "link.link_a", "link.link_b").agg(F.count(F.lit(1)).alias("n_docs"))


def count_pairs(pairs: DataFrame) -> DataFrame:
    """``(link_a, link_b, n_docs, best)`` over all blocks; ``best``: no other pair of ``link_a`` has more."""
    counts = pairs.groupBy("link_a", "link_b").agg(F.sum("n_docs").alias("n_docs"))
    most = counts.groupBy("link_a").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "link_a").select("link_a", "link_b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame) -> DataFrame:
    """``aligned`` without its links, with ``n_best`` and ``count_sum`` of them.

    ``aligned`` is a stored table, read twice. A pair's count is the number of rows that hold it;
    the counts reach each block once, whatever the number of its documents.
    """
    pairs = written(block_pairs(aligned), "pairs")
    counts = count_pairs(pairs)
    known = pairs.select("block", "link_a", "link_b").join(counts, ["link_a", "link_b"])
    kept = [f for f in aligned.schema.fields if f.name not in ("link_a", "link_b", "link_times")]
    names = [f.name for f in kept]

    def scored(docs: pa.Table, counts: pa.Table) -> pa.Table:
        def pair(of: pa.Table | list) -> np.ndarray:
            return of[0].astype(np.int64) * SECOND + of[1]

        known = pair([counts.column(n).to_numpy() for n in ("link_a", "link_b")])
        order = np.argsort(known)
        links = [docs.column(n).combine_chunks() for n in ("link_a", "link_b", "link_times")]
        flat = [x.flatten().to_numpy(zero_copy_only=False) for x in links]
        lengths = np.diff(links[0].offsets.to_numpy())
        at = order[np.searchsorted(known, pair(flat[:2]), sorter=order)] if len(known) else np.empty(0, np.int64)
        ends = np.r_[0, np.cumsum(lengths)]
        sums = []
        for weight in (counts.column("best").to_numpy(zero_copy_only=False), counts.column("n_docs").to_numpy()):
            total = np.r_[0, np.cumsum(flat[2] * weight[at].astype(np.int64))]
            sums.append(pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64()))
        out = docs.select(names)
        return out.append_column("n_best", sums[0]).append_column("count_sum", sums[1])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return aligned.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(scored, f"{schema}, n_best long, count_sum long")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align_documents(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    stored = written(aligned.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    return score_links(stored).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
