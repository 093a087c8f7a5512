"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are hashed 1- to 3-grams, weighted by relative frequency times idf; idf comes from all
training documents. Weights are learned by follow-the-regularised-leader (FTRL-proximal) with
L1 and L2 penalties on a bounded sample, then a temperature is fitted on rows kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietkey.llm.common import blocks, bounded_sample, fold_remainder, table, task_sums, text_or_empty, text_window

#: Hashed features, a power of two; lengths of n-grams.
FEATURES, ORDERS = 1 << 16, (1, 2, 3)
#: Labelled rows that a fit may use, characters of a window of each, and how many languages.
TRAIN_ROWS, TRAIN_CHARS, MAX_LANGUAGES = 8_000, 20_000, 256
HELD_OUT = 2
#: FTRL: learning rate, its offset, L1 and L2; passes; feature values are multiplied by SCALE.
ALPHA, BETA, L1, L2, PASSES, SCALE = 0.5, 1.0, 0.02, 0.1, 3, 8.0
#: Every so many training rows one is kept for the temperature.
CALIBRATE = 5
SEED, CHARS = 5, 1 << 19
UNDETERMINED = "und"

#: ASCII other than letters becomes a blank.
_FOLD = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


class LanguageModel(NamedTuple):
    languages: list[str]
    table: np.ndarray  # idf times weight, by feature and language
    bias: np.ndarray
    temperature: float


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, end to end, and how many each text has."""
    low = [t.lower() for t in texts]
    points = np.frombuffer(" ".join(low).encode("utf-32-le", "replace"), np.uint32)
    points = np.where(points < 128, _FOLD[np.minimum(points, 127)], points)
    lengths = np.array([len(t) for t in low])
    starts = np.cumsum(lengths + 1) - lengths - 1
    owner_end = np.repeat(starts + lengths, lengths + 1)[: len(points)]
    place = np.arange(len(points))
    parts, owners = [], []
    owner = np.repeat(np.arange(len(texts)), lengths + 1)[: len(points)]
    for n in ORDERS:
        code = np.full(max(len(points) - n + 1, 0), n * 2654435761 % (1 << 32), np.uint32)
        for k in range(n):
            code = (code ^ points[k : len(points) - n + 1 + k]) * np.uint32(2246822519)
            code ^= code >> np.uint32(15)
        inside = place[: len(code)] + n <= owner_end[: len(code)]
        parts.append((code[inside] >> np.uint32(3)) & np.uint32(FEATURES - 1))
        owners.append(owner[: len(code)][inside])
    return np.concatenate(parts), np.concatenate(owners)


def _each(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, counts) of every text."""
    for a, b in blocks(texts, CHARS):
        codes, owner = _codes(texts[a:b])
        # One number per (text, feature), so that one sort serves the block.
        found, counts = np.unique(owner.astype(np.int64) * FEATURES + codes, return_counts=True)
        ends = np.searchsorted(found, np.arange(b - a + 1) * FEATURES)
        for i in range(b - a):
            yield found[ends[i] : ends[i + 1]] % FEATURES, counts[ends[i] : ends[i + 1]]


def _idf(rows: DataFrame) -> np.ndarray:
    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, texts_seen = np.zeros(FEATURES), 0
        for batch in batches:
            for found, _ in _each(batch["text"].tolist()):
                seen[found] += 1
                texts_seen += 1
        yield pd.DataFrame({"part": [0, 1], "sums": [seen, np.array([float(texts_seen)])]})

    got = task_sums(rows.select("text").mapInPandas(frequencies, "part int, sums array<double>"))
    return np.log((1 + got[1][0]) / (1 + got[0])) + 1 if got else np.ones(FEATURES)


class Ftrl:
    """FTRL-proximal for a softmax; weights stay exactly zero while L1 outweighs them."""

    def __init__(self, classes: int):
        self.z = np.zeros((FEATURES + 1, classes))
        self.n = np.zeros((FEATURES + 1, classes))

    def weights(self, rows: np.ndarray) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, rows: np.ndarray, values: np.ndarray, label: int) -> None:
        """The last row of the table is the bias."""
        rows, values = np.append(rows, FEATURES), np.append(values, 1.0)
        w = self.weights(rows)
        slope = _softmax(values @ w)
        slope[label] -= 1
        g = values[:, None] * slope
        squared = self.n[rows] + g * g
        sigma = (np.sqrt(squared) - np.sqrt(self.n[rows])) / ALPHA
        self.z[rows] += g - sigma * w
        self.n[rows] = squared


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _fit_rows(rows: pd.DataFrame, idf: np.ndarray, languages: list[str]) -> tuple[np.ndarray, np.ndarray, float]:
    rows = rows.sort_values(["h", "text", "lang"], kind="stable")
    label = [languages.index(x) for x in rows["lang"]]
    apart = np.arange(len(rows)) % CALIBRATE == CALIBRATE - 1
    data = [(f, SCALE * c / max(c.sum(), 1) * idf[f]) for f, c in _each(rows["text"].tolist())]
    model = Ftrl(len(languages))
    for turn in range(PASSES):
        for i in np.random.default_rng(SEED + turn).permutation(len(data)):
            if not apart[i]:
                model.learn(*data[i], label[i])
    w = model.weights(np.arange(FEATURES + 1))
    logits = np.array([v @ w[f] + w[-1] for i, (f, v) in enumerate(data) if apart[i]]).reshape(-1, len(languages))
    return w[:-1] * idf[:, None], w[-1], _temperature(logits, np.array(label)[apart])


def _temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """The least negative log likelihood over a grid of temperatures; 1 without rows."""
    if not len(label):
        return 1.0
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(label)), label], 1e-300)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _drawn(rows: DataFrame, limit: int, chars: int) -> DataFrame:
    """At most ``limit`` of ``rows(id, text, lang)``, a window of up to ``chars`` characters of each, with a hash ``h``.

    Rows are drawn one by one, also those that share a text; a row that is there several times
    with its id counts once if rows are drawn at all.
    """
    sample = bounded_sample(rows, limit, SEED, "id", "text", "lang")
    if sample is not rows:
        sample = sample.withColumn("draw", F.xxhash64(F.lit(SEED + 1), "id", "text", "lang"))
        sample = sample.dropDuplicates(["draw"]).orderBy("draw").limit(limit)
    return sample.select(text_window(F.col("text"), chars, SEED).alias("text"), "lang", F.xxhash64("text").alias("h"))


def fit_languages(rows: DataFrame, limit: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> LanguageModel | None:
    """A model of ``rows(id, text, lang)``, all of them training rows; None if there are none.

    idf covers all rows. Weights and temperature come from up to ``limit`` rows, chosen by a
    hash of id, text and label, and a window of up to ``chars`` characters of each, drawn by hash, in one task whose input
    these parameters bound. More than ``MAX_LANGUAGES`` languages are refused.
    """
    languages = [r["lang"] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not languages:
        return None
    languages.sort()
    idf = _idf(rows)
    sample = _drawn(rows, limit, chars)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            w, bias, t = _fit_rows(pd.concat(held), idf, languages)
            yield pd.DataFrame({"w": [w.astype(np.float32).tobytes()], "bias": [bias], "t": [t]})

    got = sample.repartition(1).mapInPandas(fit, "w binary, bias array<double>, t double").first()
    weights = np.frombuffer(bytes(got["w"]), np.float32).reshape(FEATURES, len(languages))
    return LanguageModel(languages, weights, np.array(got["bias"]), got["t"])


def predict(text: Column, model: LanguageModel | None) -> Column:
    """Struct of ``lang`` and ``score``; ``und`` and 0 for null texts and texts without a letter."""

    @F.pandas_udf("lang string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield _predicted([t or "" for t in texts], model)

    return predicted(text)


def _predicted(texts: list[str], model: LanguageModel | None) -> pd.DataFrame:
    langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if model is None:
        return pd.DataFrame({"lang": langs, "score": scores})
    for a, b in blocks(texts, CHARS):
        codes, owner = _codes(texts[a:b])
        total = np.maximum(np.bincount(owner, minlength=b - a), 1)
        logits = np.stack([np.bincount(owner, model.table[codes, k], b - a) for k in range(len(model.languages))], axis=1)
        chance = _softmax((SCALE * logits / total[:, None] + model.bias) / model.temperature)
        for i in range(a, b):
            if any(map(str.isalpha, texts[i])):
                best = int(chance[i - a].argmax())
                langs[i], scores[i] = model.languages[best], float(chance[i - a, best])
    return pd.DataFrame({"lang": langs, "score": scores})


def identify_languages(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``.

    Learns from rows with a text, a label and an id remainder other than 2; ids, labels and
    other columns are never features. A null id counts as the empty text. Without a training
    row every text is ``und``. Repeated rows get equal results; an empty table gives an empty
    one; columns named like the results are replaced.
    """
    learn = docs.where((fold_remainder(F.col(doc_id)) != HELD_OUT) & F.col(text).isNotNull() & F.col(lang).isNotNull())
    model = fit_languages(learn.select(F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")))
    named = docs.withColumns({"held_out": fold_remainder(F.col(doc_id)) == HELD_OUT, "lang_pred": predict(text_or_empty(text), model)})
    return named.withColumn("score", F.col("lang_pred.score")).withColumn("lang_pred", F.col("lang_pred.lang"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify_languages(docs).select("doc_id", "held_out", "lang_pred", "score")
