"""The prefix trie, pieces and the alignment against brute force and the libraries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quietkey.llm import alignment, pieces, prefix_trie, toxicity

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# the trie


def plain_trie(rows):
    """Nodes of rows (conv_id, turn, role, text) by rebuilding every conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    for c, turns in own.items():
        turns.sort(key=lambda t: (t[0], sha(f"{len(t[1].encode())}:{t[1]}{t[2]}")))
        own[c] = [t[1:] for t in turns]
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
        ends[full[c]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children[path]
        leaves[path] = sum(leaves[x] for x in below) if below else 1
        saved[path] = sum(saved[x] for x in below) + (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(",".join(map(str, ends[p]))))
        for p, m in members.items()
    )


def trie_rows(frame):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted(tuple(r[n] for n in names) for r in frame.collect())


SCHEMA = "conv_id long, turn long, role string, text string"


def test_trie_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(prefix_trie.op11_prefix_trie(spark, SF)) == plain_trie(rows)


def random_turns(seed, n):
    rng = random.Random(seed)
    rows = [(rng.choice([0, 100, 200, 9007199254740993, 9007199254740900, *range(1, 30), 150, 199, 305, 7000]), rng.choice([None, 0, 1, 2, 3, 3, 4, 9]), rng.choice(["a", "b", None, ""]), rng.choice(["x", "yy", None, "", "日本", "😀"])) for _ in range(n)]
    rows += [(100, i, "user", "same") for i in range(9)] + [(k, i, "user", "same") for k in (101, 102, 103) for i in range(k - 92)]
    return rows + rows[:5] + [(None, 1, "a", "x")]


@pytest.mark.parametrize("seed,n", [(1, 40), (2, 200), (3, 600)])
def test_trie_of_awkward_turns(spark, seed, n):
    from pyspark.sql import functions as F

    rows = random_turns(seed, n)
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("digest", "place", "run0", "depth", "key1", "part", "up", "family", "head")})
    assert trie_rows(prefix_trie.prefix_trie(frame)) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "x")], SCHEMA)).collect() == []


def test_trie_of_a_long_conversation_and_nested_copies(spark):
    # One conversation spans all ranges; others are ever longer copies of one another.
    rows = [(7, i, "user", f"turn {i}") for i in range(3000)] + [(300 + k, i, "user", f"say {i}") for k in range(40) for i in range(k)]
    rows += [(7, 5000, "user", "again")] * 500
    assert trie_rows(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain_trie(rows)


def test_collisions_are_seen_and_another_seed_is_drawn(spark):
    rows = random_turns(4, 300)
    frame = spark.createDataFrame(rows, SCHEMA)
    used = []

    def tries():
        for lanes in (prefix_trie.Lanes(1, 5), prefix_trie.Lanes(2)):
            used.append(lanes.prime)
            yield lanes

    assert trie_rows(prefix_trie.prefix_trie(frame, tries())) == plain_trie(rows)
    assert used == [5, prefix_trie.PRIME]
    with pytest.raises(RuntimeError):
        prefix_trie.prefix_trie(frame, [prefix_trie.Lanes(1, 5)])


def test_fingerprints_compose():
    lanes = prefix_trie.Lanes()
    import pandas as pd

    digests = pd.Series([sha(str(i)) for i in range(50)])
    terms = lanes.shifted(lanes.turns(digests), np.arange(1, 51))
    whole = terms.sum(axis=0) % lanes.prime
    for cut in (0, 1, 17, 50):
        right = lanes.shifted(lanes.turns(digests), np.r_[np.arange(1, cut + 1), np.arange(1, 51 - cut)])[cut:].sum(axis=0) % lanes.prime
        joined = (terms[:cut].sum(axis=0) + lanes.shifted(right[None], np.array([cut]))[0]) % lanes.prime
        assert (joined == whole).all()


# pieces


PARTS = [" ", "  ", "    ", "\n", "\t", "a", "the", " th", "er", "re", "tion", "▁", "é", "日本", "😀", "́", "1", "23", ".", ",", "ß", "п", "ри", "\x00", "﻿", "<s>", "</s>", "<unk>", "<0x41>", "​", "\r", "'", "==", "(", "　", "\xa0", "<|endoftext|>", "'s", " '"]
MIXED = st.lists(st.sampled_from(PARTS) | st.text(max_size=3), max_size=25).map("".join)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@given(MIXED)
@settings(max_examples=1500, deadline=None)
def test_pieces_equal_the_library(library, text):
    ids = pieces.coder(PIECES).encode(text).tolist()
    assert ids == library.encode(text, add_eos=True)
    assert pieces.coder(PIECES).decode(ids) == library.decode(ids)


@given(st.lists(st.integers(0, 31_999) | st.integers(0, 300), max_size=12))
@settings(max_examples=1500, deadline=None)
def test_any_ids_decode_as_in_the_library(library, ids):
    assert pieces.coder(PIECES).decode(ids) == library.decode(ids)


def test_tokens_of_every_prefix_are_unique():
    """The table's claim: one token may end each prefix, and it is the last of its encoding."""
    table = pieces.piece_table(PIECES)
    for word in ("▁international", "▁▁▁▁▁▁▁", "▁bananas", "▁Übergrößenträger", "ababababa"):
        for end in range(1, len(word) + 1):
            ids = table.chunk_ids(word[:end])
            fits = [i for i, p in enumerate(table.pieces) if word[:end].endswith(p) and p in table.scores and table.compatible(table.chunk_ids(word[: end - len(p)])[-1] if end > len(p) else -1, i)]
            assert fits == ids[-1:]


def test_op12_equals_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in pieces.op12_pieces(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        ids = library.encode(text, add_eos=True)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_long_texts_in_stretches(library, monkeypatch):
    monkeypatch.setattr(pieces, "STRETCH", 50)
    rng = random.Random(8)
    for _ in range(60):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(400)))
        assert pieces.PieceCoder(PIECES).encode(text).tolist() == library.encode(text, add_eos=True)
    text = "no" * 30_000 + "   " * 5000
    assert pieces.PieceCoder(PIECES).encode(text).tolist() == library.encode(text, add_eos=True)


# alignment


@pytest.fixture(scope="module")
def tokenizers(library):
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    return a, library


def byte_of_symbols():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def plain_alignment(tokenizers, text):
    """Ids, groups as text and links of one text, over byte positions one by one."""
    a, b = tokenizers
    if not text:
        return None
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    symbols = byte_of_symbols()
    bytes_a = [bytes(symbols[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    of_a = [i for i, x in enumerate(bytes_a) for _ in x]
    of_b = [i for i, x in enumerate(bytes_b) for _ in x]
    links = sorted(set(zip(of_a, of_b, strict=True)))
    groups, at = [], 0
    for p in range(len(of_a)):
        last = p + 1 == len(of_a)
        if last or (of_a[p] != of_a[p + 1] and of_b[p] != of_b[p + 1]):
            group_a, group_b = (sorted(set(of[at : p + 1])) for of in (of_a, of_b))
            groups.append(",".join(str(ids_a[i]) for i in group_a) + "|" + ",".join(str(ids_b[i]) for i in group_b))
            at = p + 1
    return ids_a, ids_b, groups, [(ids_a[i], ids_b[j]) for i, j in links]


def plain_counts(tokenizers, texts):
    """The contract's row of every text."""
    found = [plain_alignment(tokenizers, t) for t in texts]
    counts = Counter(pair for x in found if x for pair in set(x[3]))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [
        (len(x[0]), len(x[1]), len(x[2]), len(x[3]), sum(counts[p] == best[p[0]] for p in x[3]), sum(counts[p] for p in x[3]), sha(";".join(x[2]))) if x else (0, 0, 0, 0, 0, 0, "")
        for x in found
    ]


ALIGNED = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


@given(st.lists(MIXED, min_size=1, max_size=6))
@settings(max_examples=400, deadline=None)
def test_blocks_of_texts_align_as_byte_by_byte(tokenizers, texts):
    got = alignment.aligner(BYTES, PIECES).block(texts)
    for i, text in enumerate(texts):
        want = plain_alignment(tokenizers, text)
        held = got["text"] == i
        links = {(int(p) // alignment.SECOND, int(p) % alignment.SECOND): int(n) for p, n in zip(got["pair"][held], got["times"][held], strict=True)}
        assert got["totals"][i].tolist() == ([len(x) for x in want] if want else [0] * 4)
        assert got["groups"][i] == (";".join(want[2]) if want else "")
        assert links == (Counter(want[3]) if want else {})


def test_op13_equals_brute_force(spark, tokenizers):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in docs], plain_counts(tokenizers, [r.text for r in docs]), strict=True))
    got = {r.doc_id: tuple(r[n] for n in ALIGNED) for r in alignment.op13_alignment(spark, SF).collect()}
    assert got == want


def test_counts_over_many_blocks(spark, tokenizers, monkeypatch):
    from pyspark.sql import functions as F

    from quietkey.llm.common import written

    rng = random.Random(5)
    texts = [rng.choice([None, "", "one ▁ two", "the same text"])] + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(60)] + ["the same text"] * 30 + ["word " * 3000 + "end"]
    frame = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    frame = frame.withColumns({c: F.lit("x") for c in ("block", "body", "n_a", "groups", "link_a", "best", "n_docs")})
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 60)
    stored = written(alignment.align_documents(frame).withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")), "aligned")
    got = Counter(tuple(r[n] for n in ALIGNED) for r in alignment.score_links(stored).collect())
    assert got == Counter(plain_counts(tokenizers, texts))


def test_alignment_of_nothing(spark):
    from quietkey.llm.common import written

    stored = written(alignment.align_documents(spark.createDataFrame([], "doc_id long, text string")), "aligned")
    assert alignment.score_links(stored).collect() == []




def test_toxicity_learns_from_every_label_and_whole_texts(spark, monkeypatch):
    seen, train = [], toxicity._train
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 4_000)
    monkeypatch.setattr(toxicity, "_train", lambda rows, heavy: seen.append(rows.toPandas()) or train(rows, heavy))
    texts = [(i, f"{'vile' if i % 3 == 0 else 'mild'} text {i * 7919 % 1009} of row{i}") for i in range(13_000)]
    texts.append((13_000, "calm " * 60_000))
    docs = spark.createDataFrame(texts, "id long, text string").repartition(4)
    marks = docs.select(F.col("id").alias("label_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    model = toxicity.fit_toxicity(docs, marks)
    apart = docs.where(F.pmod(F.xxhash64(F.lit(toxicity.SEED), "text"), F.lit(toxicity.CALIBRATE)) == toxicity.CALIBRATE - 1).count()
    assert len(seen[0]) == 13_001 - apart and seen[0]["shard"].nunique() == 3
    assert max(map(len, toxicity._unpacked(seen[0]["ids"], np.int64))) == 60_000
    scores = toxicity._scored(["vile text 5 of other", "mild text 5 of other"], model, toxicity._Prefixes())
    assert scores[0] >= toxicity.CUT > scores[1]


def test_toxicity_thresholds_are_those_of_all_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(str(i % 2), float(rng.integers(40)) / 8 + i % 3, int(i % 3 == 2)) for i in range(400)] + [("2", 1.0, 1)]
    cuts = toxicity._thresholds(spark.createDataFrame(rows, "near string, logit double, toxic int").repartition(5))
    assert set(cuts) == {"", "0", "1"}
    for near, cut in cuts.items():
        own = [(x, t) for g, x, t in rows if near in ("", g)]
        places = sorted({x for x, _ in own}, reverse=True)
        total = sum(t for _, t in own)
        f1 = [2 * sum(t for x, t in own if x >= p) / (sum(x >= p for x, _ in own) + total) for p in places]
        best = max(i for i, f in enumerate(f1) if f == max(f1))
        assert cut == (places[best] + places[best + 1]) / 2


def test_stretches_are_met_once_and_plain_ones_are_not_split(tokenizers, monkeypatch):
    class Counted:
        seen = []

        def split(self, text):
            self.seen.append(text)
            return kept.split(text)

        search = alignment._MARK.search

    kept = alignment._MARK
    monkeypatch.setattr(alignment, "_MARK", Counted())
    work = alignment.Aligner(BYTES, PIECES)
    assert work.marks_apart
    texts = ["one two, one two", "two three", "one, two"]
    first = work.block(texts)
    assert sorted(Counted.seen) == [" one,", " two,"]
    work.forget()
    again = work.block(["four", *texts])
    assert sorted(Counted.seen) == [" one,", " two,"]
    assert again["groups"][1:] == first["groups"] and (again["totals"][1:] == first["totals"]).all()
    assert again["groups"][1:] == [";".join(plain_alignment(tokenizers, t)[2]) for t in texts]
