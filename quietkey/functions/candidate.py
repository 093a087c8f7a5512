"""Suspicion score of a (name, value) pair and client-side exposure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quietkey.functions.text import DIGIT, WS, shannon_entropy

# Words that make a variable name sensitive.
SENSITIVE_KEYWORDS = (
    "password", "passwd", "pwd", "secret", "token", "api_key", "apikey",
    "client_secret", "access_key", "credential", "credentials",
)

# Prefixes that ship an environment variable to the browser.
CLIENT_PREFIXES = {"VITE_": "Vite", "NEXT_PUBLIC_": "Next.js"}

# Signal weights, thresholds and reason texts.
NAME_WEIGHT, LENGTH_WEIGHT, ENTROPY_WEIGHT, VARIETY_WEIGHT = 40, 20, 25, 15
MIN_LONG_LENGTH, MIN_HIGH_ENTROPY, SUSPICIOUS_SCORE = 16, 3.5, 50
NAME_REASON = "Sensitive variable name"
LENGTH_REASON = "Long secret-like value"
ENTROPY_REASON = "High entropy"
VARIETY_REASON = "Character variety"
CLIENT_REASON = "Client-exposed environment variable"
CLIENT_NAME_REASON = "Sensitive credential name"


def has_sensitive_name(name: Column) -> Column:
    folded = F.replace(F.lower(name), F.lit("-"), F.lit("_"))
    return folded.rlike("|".join(SENSITIVE_KEYWORDS))


def has_character_variety(value: Column) -> Column:
    """At least two of: a lower-case letter, an upper-case letter, a digit."""
    kinds = (r"\p{IsLowercase}", r"\p{IsUppercase}", f"[{DIGIT}]")
    present = [value.rlike(kind).cast("int") for kind in kinds]
    return (present[0] + present[1] + present[2]) >= 2


def is_compact_value(value: Column) -> Column:
    return ~value.rlike(f"[{WS}]")


def candidate_signals(name: Column, value: Column) -> Column:
    """Struct of the measurements behind the score, each computed once.

    Plans keep it as a column of its own before :func:`score_signals`, so that the
    entropy of a value is not evaluated again for every use.
    """
    return F.struct(
        name.alias("variable_name"),
        F.length(value).alias("length"),
        has_sensitive_name(name).alias("sensitive"),
        is_compact_value(value).alias("compact"),
        has_character_variety(value).alias("varied"),
        shannon_entropy(value).alias("entropy"),
    )


def score_signals(s: Column) -> Column:
    """Struct with length, entropy, score, verdict and ordered reasons."""
    judged = (
        (s["sensitive"], NAME_WEIGHT, NAME_REASON),
        (
            (s["length"] >= MIN_LONG_LENGTH) & (s["compact"] | s["sensitive"]),
            LENGTH_WEIGHT,
            LENGTH_REASON,
        ),
        (s["compact"] & (s["entropy"] >= MIN_HIGH_ENTROPY), ENTROPY_WEIGHT, ENTROPY_REASON),
        (s["compact"] & s["varied"], VARIETY_WEIGHT, VARIETY_REASON),
    )
    points = sum((F.when(f, F.lit(w)).otherwise(F.lit(0)) for f, w, _ in judged), F.lit(0))
    score = F.least(points, F.lit(100))
    reasons = F.array_compact(F.array(*[F.when(f, F.lit(text)) for f, _, text in judged]))
    return F.struct(
        s["variable_name"].alias("variable_name"),
        s["length"].alias("length"),
        F.round(s["entropy"], 3).alias("entropy"),
        score.alias("score"),
        (score >= SUSPICIOUS_SCORE).alias("is_suspicious"),
        reasons.alias("reasons"),
    )


def analyze_candidate(name: Column, value: Column) -> Column:
    """Score of one name and value in a single expression."""
    return score_signals(candidate_signals(name, value))


def client_framework(name: Column) -> Column:
    """Framework whose public prefix the name carries, else null."""
    upper = F.upper(name)
    found = F.lit(None).cast("string")
    for prefix, framework in CLIENT_PREFIXES.items():
        found = F.when(F.startswith(upper, F.lit(prefix)), F.lit(framework)).otherwise(found)
    return found


def without_client_prefix(name: Column) -> Column:
    upper = F.upper(name)
    rest = name
    for prefix in CLIENT_PREFIXES:
        rest = F.when(
            F.startswith(upper, F.lit(prefix)), F.substr(name, F.lit(len(prefix) + 1))
        ).otherwise(rest)
    return rest


def score_exposure(framework: Column, s: Column) -> Column:
    """Exposure struct from a framework and the signals of the prefix-free name."""
    analysis = score_signals(s)
    exposed = framework.isNotNull()
    risky = exposed & (s["sensitive"] | analysis["is_suspicious"])
    none = F.array().cast("array<string>")
    reasons = F.array_distinct(
        F.concat(
            F.array(F.lit(CLIENT_REASON)),
            F.when(s["sensitive"], F.array(F.lit(CLIENT_NAME_REASON))).otherwise(none),
            analysis["reasons"],
        )
    )
    return F.struct(
        exposed.alias("is_client_exposed"),
        risky.alias("is_risky"),
        framework.alias("framework"),
        F.when(risky, F.lit("CRITICAL")).alias("severity"),
        F.when(exposed, analysis["score"]).otherwise(F.lit(0)).alias("candidate_score"),
        F.when(exposed, reasons).otherwise(none).alias("reasons"),
    )


def analyze_client_exposure(name: Column, value: Column) -> Column:
    """Struct describing a browser-visible variable; risky means secret-like too."""
    signals = candidate_signals(without_client_prefix(name), value)
    return score_exposure(client_framework(name), signals)
