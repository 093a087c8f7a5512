"""Logistic regressions on numeric, contextual, lexical and combined features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    IDF,
    ElementwiseProduct,
    HashingTF,
    Normalizer,
)
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from quietkey.functions.assignments import candidate_text
from quietkey.functions.features import CONTEXT_FEATURES, NUMERIC_FEATURES, context_features
from quietkey.lab.errors import error_split
from quietkey.lab.lexical import LexicalRegression, margins, packed
from quietkey.lab.metrics import calculate_metrics
from quietkey.lab.split import stratified_split
from quietkey.lab.terms import NGRAM_SIZES, Terms, Trie, chains, count_terms, fold_text, held_terms
from quietkey.operators.ordering import durable

# Fixed value: document floor of the lexical models.
MIN_DOCUMENTS = 2
#: Largest vocabulary that is kept by name; beyond it use ``hash_buckets``.
MAX_VOCABULARY = 1 << 22
# The few inputs of a tabular model converge at once; lexical ones stop where metrics do.
_MAX_ITER, _TABULAR_TOLERANCE, _LEXICAL_TOLERANCE = 2000, 1e-7, 1e-5
#: Smallest training partition: every partition sends one gradient per iteration.
ROWS_PER_PARTITION = 20_000
#: Megabytes of rows that meet one gradient of a lexical fit: each block adds up a whole vocabulary.
BLOCK_MB = 64.0


def validate_columns(frame: DataFrame, required: Sequence[str]) -> None:
    missing = sorted(set(required) - set(frame.columns))
    if missing:
        raise ValueError(f"No columns {missing} to learn from")


def binary_label() -> Column:
    """The label as a double; anything but 0 and 1 stops the job."""
    label = F.col("label")
    bad = F.raise_error(F.lit("Only the binary labels 0 and 1 are supported.")).cast("double")
    return F.when(label.isin(0, 1), label.cast("double")).otherwise(bad)


def char_ngrams(text: Column) -> Column:
    """Overlapping character n-grams of lower-case text with runs of space collapsed."""
    return F.concat(
        *[
            F.regexp_extract_all(fold_text(text), F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1))
            for n in NGRAM_SIZES
        ]
    )


def _unit_terms(texts: Sequence[str], trie: Trie, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of every known n-gram: sublinear counts by IDF, of unit length per row."""
    row, term, count = held_terms(texts, trie)
    value = (1.0 + np.log(count)) * idf[term]
    norm = np.sqrt(np.bincount(row, value * value, len(texts)))
    return row, term, value / norm[row]


def _term_pairs(text: Column, trie: Trie, idf: np.ndarray) -> Column:
    @F.arrow_udf(ArrayType(StructType().add("term", "integer").add("weight", "double")))
    def pairs(texts: pa.Array) -> pa.Array:
        row, term, weight = _unit_terms(texts.to_pylist(), trie, idf)
        offsets = np.append(0, np.cumsum(np.bincount(row, minlength=len(texts)))).astype(np.int32)
        held = pa.StructArray.from_arrays([pa.array(term.astype(np.int32)), pa.array(weight)], ["term", "weight"])
        return pa.ListArray.from_arrays(pa.array(offsets), held)

    # A filter on the pairs would be pushed below the shuffle and compute them once more.
    return pairs.asNondeterministic()(text)


def _joined(vector: Column, numbers: Column) -> Column:
    """A sparse vector with more numbers behind it.

    The assembler of the engine names every place of its vectors in the schema, which each task
    of each iteration then carries.
    """

    @F.pandas_udf(VectorUDT())
    def joined(vectors: pd.DataFrame, more: pd.Series) -> pd.DataFrame:
        size = int(vectors["size"].iloc[0]) if len(vectors) else 0
        places = [np.append(i, np.arange(size, size + len(m), dtype=np.int32)) for i, m in zip(vectors["indices"], more, strict=True)]
        values = [np.append(v, m) for v, m in zip(vectors["values"], more, strict=True)]
        sizes = vectors["size"] + np.array([len(m) for m in more], np.int32)
        return pd.DataFrame({"type": vectors["type"], "size": sizes.astype(np.int32), "indices": places, "values": values})

    return joined.asNondeterministic()(vector, numbers)


@F.pandas_udf(VectorUDT())
def sublinear(counts: pd.DataFrame) -> pd.DataFrame:
    """Replace every term count by 1 + ln(count)."""
    rows = counts["values"].tolist()
    if rows:
        logs = 1.0 + np.log(np.concatenate([np.asarray(r, float) for r in rows]))
        counts["values"] = np.split(logs, np.cumsum([len(r) for r in rows])[:-1])
    return counts


def _regression(features: str, samples: int, tolerance: float) -> LogisticRegression:
    # Penalty strength one on summed losses is 1/n on Spark's averaged loss.
    return LogisticRegression(
        featuresCol=features,
        labelCol="_label",
        probabilityCol="_probability",
        rawPredictionCol="_raw",
        predictionCol="_prediction",
        regParam=1.0 / samples,
        standardization=False,
        maxIter=_MAX_ITER,
        tol=tolerance,
        maxBlockSizeInMB=BLOCK_MB,
    )


def _fit(stages: list, frame: DataFrame, samples: int) -> PipelineModel:
    """Fit stage by stage and keep the fitted stages; the last one iterates."""
    fitted = []
    for stage in stages:
        if stage is stages[-1]:
            parts = -(-samples // ROWS_PER_PARTITION)
            narrow = frame.select(stage.getFeaturesCol(), stage.getLabelCol())
            spread = narrow.rdd.getNumPartitions() <= parts
            held = narrow if spread else narrow.repartition(max(parts, 1))
            if isinstance(stage, LexicalRegression):
                # It stores its rows itself.
                fitted.append(stage.fit(held))
                break
            # Moments and blocks of the regression read the same vectors, which are made once.
            held.persist(StorageLevel.DISK_ONLY)
            try:
                fitted.append(stage.fit(held))
            finally:
                held.unpersist()
            break
        model = stage.fit(frame) if hasattr(stage, "fit") else stage
        frame = model.transform(frame)
        fitted.append(model)
    return PipelineModel(fitted)


def moments(frame: DataFrame, columns: Sequence[str]) -> tuple[int, list[float], list[float]]:
    """Rows of a table, and mean and population deviation of each column."""
    means = [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]
    deviations = [F.stddev_pop(c).alias(f"d{i}") for i, c in enumerate(columns)]
    row = frame.agg(F.count("*").alias("n"), *means, *deviations).first()
    numbers = lambda k: [row[f"{k}{i}"] or 0.0 for i in range(len(columns))]
    return row["n"], numbers("m"), numbers("d")


def _scaled(columns: Sequence[str], means: Sequence[float], deviations: Sequence[float]) -> list[Column]:
    """Columns less their mean by their deviation; 0 where a column never changes."""
    return [
        (F.col(c).cast("double") - F.lit(m)) / F.lit(d) if d else F.lit(0.0)
        for c, m, d in zip(columns, means, deviations, strict=True)
    ]


def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


@dataclass(frozen=True)
class TabularModel:
    """Scaled features and a weight for each: plain numbers, scored as one expression.

    ``derived`` features are recomputed from the text.
    """

    features: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float
    derived: bool

    def margin(self) -> Column:
        scaled = _scaled(self.features, self.means, self.deviations)
        total = F.lit(self.intercept)
        for weight, value in zip(self.coefficients, scaled, strict=True):
            total = total + F.lit(weight) * value
        return total

    def predict(self, frame: DataFrame, prefix: str) -> DataFrame:
        ready = _with_context(frame) if self.derived else frame
        probability = f"{prefix}_probability"
        return ready.select(*frame.columns, sigmoid(self.margin()).alias(probability)).select(
            *frame.columns,
            (F.col(probability) > 0.5).cast("int").alias(f"{prefix}_prediction"),
            probability,
        )


@dataclass(frozen=True)
class LexicalModel:
    """Character TF-IDF, optionally joined by scaled numerics, and a weight for each input.

    ``counts`` names the terms, ``idf`` and ``weights`` follow their places.
    """

    counts: object
    idf: np.ndarray
    weights: np.ndarray
    intercept: float
    numeric: TabularModel | None = None

    def predict(self, frame: DataFrame, prefix: str) -> DataFrame:
        idf, weights = self.idf, self.weights
        if isinstance(self.counts, Terms):
            trie, counted = self.counts.trie, frame.withColumn("_counts", _lexical_text())
            known = (trie, trie.chain_sums(idf * weights), trie.chain_sums(idf * idf))
            # In the function itself, workers would keep its pickle as well.
            shared = frame.sparkSession.sparkContext.broadcast(known)

            @F.pandas_udf("double")
            def named(texts: pd.Series) -> pd.Series:
                trie, sums, squared = shared.value
                found = [margins(block, sums) for block in chains(texts.tolist(), trie, squared)]
                return pd.Series(np.concatenate([np.zeros(0), *found]))

            return self._scored(frame, counted, named.asNondeterministic()("_counts"), prefix)

        @F.pandas_udf("double")
        def margin(counts: pd.DataFrame) -> pd.Series:
            lengths = np.array([len(x) for x in counts["indices"]], np.int64)
            row = np.repeat(np.arange(len(lengths)), lengths)
            if not len(row):
                return pd.Series(np.zeros(len(lengths)))
            term = np.concatenate(counts["indices"].tolist()).astype(np.int64)
            value = (1.0 + np.log(np.concatenate(counts["values"].tolist()))) * idf[term]
            norm = np.sqrt(np.bincount(row, value * value, len(lengths)))
            return pd.Series(np.bincount(row, value * weights[term], len(lengths)) / np.where(norm == 0, 1.0, norm))

        return self._scored(frame, self.counts.transform(_with_ngrams(frame)), margin("_counts"), prefix)

    def _scored(self, frame: DataFrame, counted: DataFrame, margin: Column, prefix: str) -> DataFrame:
        total = F.lit(self.intercept) + margin
        if self.numeric:
            total = total + self.numeric.margin()
        probability = f"{prefix}_probability"
        return counted.select(*frame.columns, sigmoid(total).alias(probability)).select(
            *frame.columns,
            (F.col(probability) > 0.5).cast("int").alias(f"{prefix}_prediction"),
            probability,
        )


def _with_context(frame: DataFrame) -> DataFrame:
    kept = [c for c in frame.columns if c not in CONTEXT_FEATURES]
    name = F.coalesce(F.col("variable_name"), F.lit(""))
    value = F.coalesce(F.col("value"), F.lit(""))
    return frame.select(*kept, *context_features(name, value))


def _fit_tabular(frame: DataFrame, features: tuple[str, ...], derived: bool) -> TabularModel:
    ready = (_with_context(frame) if derived else frame).withColumn("_label", binary_label())
    # Moments and the fit read the same numbers, which are derived once.
    held = ready.select(*features, "_label").persist()
    samples, means, deviations = moments(held, features)
    vector = array_to_vector(F.array(*_scaled(features, means, deviations)))
    stage = _regression("_features", samples, _TABULAR_TOLERANCE)
    fitted = _fit([stage], held.select(vector.alias("_features"), "_label"), samples).stages[0]
    held.unpersist()
    weights = tuple(float(x) for x in fitted.coefficients)
    return TabularModel(features, tuple(means), tuple(deviations), weights, float(fitted.intercept), derived)


def fit_numeric(frame: DataFrame) -> TabularModel:
    """Eight stored features."""
    validate_columns(frame, [*NUMERIC_FEATURES, "label"])
    return _fit_tabular(frame, NUMERIC_FEATURES, derived=False)


def fit_context(frame: DataFrame) -> TabularModel:
    """Eighteen features, always recomputed from name and value."""
    validate_columns(frame, ["variable_name", "value", "label"])
    return _fit_tabular(frame, CONTEXT_FEATURES, derived=True)


def _lexical_text() -> Column:
    return fold_text(candidate_text(F.col("variable_name"), F.col("value")))


def _with_ngrams(frame: DataFrame) -> DataFrame:
    text = candidate_text(F.col("variable_name"), F.col("value"))
    return frame.withColumn("_ngrams", char_ngrams(text))


def _term_weights(counts, frame: DataFrame) -> DataFrame:
    counted = counts.transform(_with_ngrams(frame))
    return counted.withColumn("_weights", sublinear("_counts"))


def _unit_weights(weighted: DataFrame) -> list:
    """Stages from term counts to weights: smooth IDF plus one, then unit length."""
    idf = IDF(inputCol="_counts", outputCol="_idf").fit(weighted)
    return [
        ElementwiseProduct(
            scalingVec=Vectors.dense(np.asarray(idf.idf) + 1.0),
            inputCol="_weights",
            outputCol="_scaled",
        ),
        Normalizer(p=2.0, inputCol="_scaled", outputCol="_text"),
    ]


def _vocabulary(frame: DataFrame, samples: int) -> tuple[Terms, np.ndarray]:
    """Terms of at least ``MIN_DOCUMENTS`` rows, the most frequent first, and their IDF."""
    counted = count_terms(frame.select(_lexical_text().alias("text"))).where(F.col("documents") >= MIN_DOCUMENTS).persist()
    try:
        if counted.count() >= MAX_VOCABULARY:
            raise ValueError("The vocabulary is too large to keep by name; set hash_buckets.")
        found = counted.toArrow().sort_by([("occurrences", "descending"), ("term", "ascending")])
    finally:
        counted.unpersist()
    terms, documents = Terms(found["term"].combine_chunks()), found["documents"].to_numpy()
    del found
    pa.default_memory_pool().release_unused()
    return terms, np.log((samples + 1.0) / (documents + 1.0)) + 1.0


def text_weights(frame: DataFrame) -> DataFrame:
    """``frame`` with ``weights``: an array (term, weight) of the lexical models' inputs."""
    terms, idf = _vocabulary(frame, frame.count())
    return frame.select("*", _term_pairs(_lexical_text(), terms.trie, idf).alias("weights"))


def scaled_features(frame: DataFrame, features: Sequence[str] = NUMERIC_FEATURES) -> DataFrame:
    """``frame`` with ``scaled``: the tabular models' inputs, by mean and population deviation."""
    _, means, deviations = moments(frame, features)
    return frame.select(*frame.columns, F.array(*_scaled(features, means, deviations)).alias("scaled"))


def _fit_lexical(
    frame: DataFrame, numerics: tuple[str, ...], hash_buckets: int | None
) -> LexicalModel:
    labelled = frame.withColumn("_label", binary_label())
    samples, means, deviations = moments(labelled, numerics)
    numbers = F.array(*_scaled(numerics, means, deviations)).cast("array<double>")
    if hash_buckets is None:
        counts, idf = _vocabulary(labelled, samples)
        rows = labelled.select(_lexical_text().alias("text"), numbers.alias("numbers"), "_label")
        stage = LexicalRegression(counts.trie, idf, samples, len(numerics), _LEXICAL_TOLERANCE, _MAX_ITER)
        weights, own, intercept = _fit([stage], packed(rows, counts.trie, idf), samples).stages[0]
    else:
        counts = HashingTF(inputCol="_ngrams", outputCol="_counts", numFeatures=hash_buckets)
        weighted = _term_weights(counts, labelled)
        stages = _unit_weights(weighted)
        idf = np.asarray(stages[0].getScalingVec().toArray())
        features = PipelineModel(stages).transform(weighted)
        if numerics:
            features = features.withColumn("_text", _joined(F.col("_text"), numbers))
        stage = _regression("_text", samples, _LEXICAL_TOLERANCE)
        fitted = _fit([stage], features, samples).stages[0]
        weights, own = np.split(np.asarray(fitted.coefficients.toArray()), [len(idf)])
        intercept = float(fitted.intercept)
    numeric = None
    if numerics:
        numeric = TabularModel(numerics, tuple(means), tuple(deviations), tuple(map(float, own)), 0.0, False)
    return LexicalModel(counts, idf, weights, intercept, numeric)


def fit_text(frame: DataFrame, hash_buckets: int | None = None) -> LexicalModel:
    validate_columns(frame, ["variable_name", "value", "label"])
    return _fit_lexical(frame, (), hash_buckets)


def fit_hybrid(frame: DataFrame, hash_buckets: int | None = None) -> LexicalModel:
    validate_columns(frame, ["variable_name", "value", "label", *NUMERIC_FEATURES])
    return _fit_lexical(frame, NUMERIC_FEATURES, hash_buckets)


def evaluate(model, frame: DataFrame, prefix: str, model_name: str | None = None) -> DataFrame:
    """Metrics of a fitted model on another dataset."""
    columns = ("label", f"{prefix}_prediction", f"{prefix}_probability")
    # Counts and ranks read the predictions; stored narrowly, a row is scored once.
    predicted = durable(model.predict(frame, prefix).select(*columns))
    return calculate_metrics(predicted, *columns, model_name)


def split_evaluation(
    frame: DataFrame, fit, prefix: str, test_size: float = 0.20, seed: int = 42
) -> DataFrame:
    """Predictions on the held-out share of a stratified split by a model of the rest.

    ``cell`` is TP, FP, TN or FN, so the four error frames are filters of the result.
    """
    parts = stratified_split(frame, test_size, seed)
    model = fit(parts.where(~F.col("is_test")).drop("is_test"))
    tested = model.predict(parts.where("is_test").drop("is_test"), prefix)
    return error_split(tested, f"{prefix}_prediction")


def baseline_predictions(training: DataFrame, frame: DataFrame) -> DataFrame:
    """Numeric and text predictions side by side, with their correctness."""
    both = fit_text(training).predict(fit_numeric(training).predict(frame, "numerical"), "text")
    label = F.col("label")
    return both.withColumns(
        {
            "numerical_correct": F.col("numerical_prediction") == label,
            "text_correct": F.col("text_prediction") == label,
        }
    )


def candidate_probabilities(training: DataFrame, frame: DataFrame) -> DataFrame:
    """Context and text predictions for late fusion."""
    scored = fit_context(training).predict(frame, "context")
    return fit_text(training).predict(scored, "text")
