"""Leakage check between two labelled datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED = ("variable_name", "value", "sample_type", "source")


def separation_keys(frame: DataFrame, side: int) -> DataFrame:
    """Rows ``(what, first, second, side)``: the pair, value, type and source of every sample."""
    missing = sorted(set(REQUIRED) - set(frame.columns))
    if missing:
        raise ValueError("Missing required columns: " + ", ".join(missing))
    name, value, kind, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in REQUIRED)

    def key(what: str, first: Column, second: Column | None = None) -> Column:
        return F.struct(
            F.lit(what).alias("what"),
            first.alias("first"),
            (F.lit("") if second is None else second).alias("second"),
        )

    keys = F.array(
        key("pair", name, value), key("value", value), key("type", kind), key("source", source)
    )
    return frame.select(F.explode(keys).alias("k")).select("k.*", F.lit(side).alias("side"))


def _seen(training: DataFrame, development: DataFrame) -> DataFrame:
    """How often every key occurs in either set.

    One aggregation on the key. It combines before the shuffle, so a value or source that
    fills the table arrives as a few rows.
    """
    keys = separation_keys(training, 1).unionByName(separation_keys(development, 2))
    return keys.groupBy("what", "first", "second").agg(
        F.count_if(F.col("side") == 1).alias("in_training"),
        F.count_if(F.col("side") == 2).alias("in_development"),
    )


def compare_separation(training: DataFrame, development: DataFrame, named: bool = False) -> DataFrame:
    """One row: sizes, and how many pairs, values, sample types and sources both sets have.

    ``named`` adds sorted lists: the names of the types and sources that both sets have, and of
    each set's sources. :func:`separation_names` gives them as rows where they are very many.
    """
    what = F.col("what")
    left, right = F.col("in_training") > 0, F.col("in_development") > 0
    both = left & right

    def names(kind: str, present: Column) -> Column:
        return F.sort_array(F.collect_set(F.when((what == kind) & present, F.col("first"))))

    lists = {
        "shared_type_names": names("type", both), "shared_source_names": names("source", both),
        "training_sources": names("source", left), "development_sources": names("source", right),
    }
    return _seen(training, development).agg(
        F.sum(F.when(what == "source", F.col("in_training"))).alias("training_samples"),
        F.sum(F.when(what == "source", F.col("in_development"))).alias("development_samples"),
        F.count_if((what == "pair") & both).alias("shared_candidate_pairs"),
        F.count_if((what == "value") & both).alias("shared_exact_values"),
        F.count_if((what == "type") & both).alias("shared_sample_types"),
        F.count_if((what == "source") & both).alias("shared_sources"),
        *(c.alias(n) for n, c in lists.items() if named),
    ).fillna(0, ["training_samples", "development_samples"])


def separation_names(training: DataFrame, development: DataFrame) -> DataFrame:
    """``(what, name, in_training, in_development)``: the sample types and sources of both sets."""
    named = _seen(training, development).where(F.col("what").isin("type", "source"))
    return named.select("what", F.col("first").alias("name"), "in_training", "in_development")


def strictly_separate(report: DataFrame) -> DataFrame:
    """Add the verdict: no overlap of any of the four kinds."""
    return report.withColumn(
        "strictly_separate",
        (F.col("shared_candidate_pairs") == 0)
        & (F.col("shared_exact_values") == 0)
        & (F.col("shared_sample_types") == 0)
        & (F.col("shared_sources") == 0),
    )
