"""Numeric and structural features of a candidate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quietkey.functions.candidate import (
    CLIENT_PREFIXES,
    has_character_variety,
    has_sensitive_name,
    is_compact_value,
)
from quietkey.functions.text import DIGIT, WS, shannon_entropy, strip

NUMERIC_FEATURES = (
    "length", "entropy", "digit_ratio", "uppercase_ratio", "special_ratio",
    "has_sensitive_name", "is_compact", "has_character_variety",
)
CONTEXT_FLAGS = (
    "looks_like_uuid", "looks_like_fixed_hash", "is_hex_only", "looks_like_reference",
    "looks_like_placeholder", "has_public_frontend_prefix", "has_identifier_name",
    "looks_like_jwt", "looks_like_passphrase",
)
HASH_METADATA_FLAG = "looks_like_safe_hash_metadata"
CONTEXT_FEATURES = (*NUMERIC_FEATURES, *CONTEXT_FLAGS, HASH_METADATA_FLAG)

# Name tokens of identifiers.
IDENTIFIER_TOKENS = (
    "id", "identifier", "uuid", "ref", "reference", "request", "trace", "build",
    "commit", "checksum", "digest",
)
# Fragments of placeholder values.
PLACEHOLDER_HINTS = (
    "example", "placeholder", "replace", "redacted", "not-configured", "not_configured",
    "fake", "demo", "sample", "your-", "your_", "insert_", "insert-", "do-not-use",
    "do_not_use",
)
# Prefixes of values that only point at a secret.
REFERENCE_PREFIXES = ("${", "$env:", "process.env.", "env.", "vault://", "os.getenv(")
# Name tokens of revision and artifact metadata.
HASH_METADATA_TOKENS = (
    "commit", "revision", "checksum", "digest", "sha", "fingerprint", "etag",
    "repository", "source",
)


def _share(kept: Column, value: Column) -> Column:
    return F.when(value == "", F.lit(0.0)).otherwise(kept.cast("double") / F.length(value))


def _left(value: Column, others: str) -> Column:
    """Number of characters left after deleting every character of a class, run by run."""
    return F.length(F.regexp_replace(value, f"{others}++", ""))


def _ratio(value: Column, others: str) -> Column:
    """Share of characters left after deleting every character outside a class."""
    return _share(_left(value, others), value)


def digit_ratio(value: Column) -> Column:
    # Text of ASCII alone, the usual case, has ten digits and needs no class of all scripts.
    plain = F.length(value) - F.length(F.translate(value, "0123456789", ""))
    ascii_only = F.octet_length(value) == F.length(value)
    return _share(F.when(ascii_only, plain).otherwise(_left(value, f"[^{DIGIT}]")), value)


def uppercase_ratio(value: Column) -> Column:
    return _ratio(value, r"\P{IsUppercase}")


def special_ratio(value: Column) -> Column:
    """Share of characters that are neither letters nor numbers."""
    return _ratio(value, r"[\p{L}\p{N}]")


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def looks_like_uuid(value: Column) -> Column:
    h = "[0-9a-fA-F]"
    return _flag(strip(value).rlike(rf"\A{h}{{8}}-{h}{{4}}-{h}{{4}}-{h}{{4}}-{h}{{12}}\z"))


def looks_like_fixed_hash(value: Column) -> Column:
    return _flag(strip(value).rlike(r"\A(?:[0-9a-fA-F]{40}|[0-9a-fA-F]{64})\z"))


def is_hex_only(value: Column) -> Column:
    return _flag(strip(value).rlike(r"\A[0-9a-fA-F]{16,}+\z"))


def looks_like_reference(value: Column) -> Column:
    v = strip(value)
    low = F.lower(v)
    hit = (F.length(v) > 2) & F.startswith(v, F.lit("%")) & F.endswith(v, F.lit("%"))
    for prefix in REFERENCE_PREFIXES:
        hit = hit | F.startswith(low, F.lit(prefix))
    return _flag(hit)


def looks_like_placeholder(value: Column) -> Column:
    return _flag(F.lower(value).rlike("|".join(PLACEHOLDER_HINTS)))


def has_public_frontend_prefix(name: Column) -> Column:
    return _flag(F.upper(strip(name)).rlike(r"\A(?:" + "|".join(CLIENT_PREFIXES) + ")"))


def name_tokens(name: Column) -> Column:
    """Set of lower-case alphanumeric tokens of a variable name."""
    parts = F.split(F.lower(name), "[^a-z0-9]+")
    return F.array_distinct(F.array_remove(parts, ""))


def _shares_token(name: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(name_tokens(name), F.array(*[F.lit(w) for w in words]))


def has_identifier_name(name: Column) -> Column:
    return _flag(_shares_token(name, IDENTIFIER_TOKENS))


def looks_like_jwt(value: Column) -> Column:
    return _flag(strip(value).rlike(r"\A[A-Za-z0-9_-]{6,}+(?:\.[A-Za-z0-9_-]{6,}+){2}\z"))


def looks_like_passphrase(value: Column) -> Column:
    """Four to eight alphabetic words of three letters or more."""
    v = strip(value)
    gap = rf"[{WS}.-]++"
    words = rf"\A(?:{gap})?\p{{L}}{{3,}}+(?:{gap}\p{{L}}{{3,}}+){{3,7}}(?:{gap})?\z"
    return _flag(~F.contains(v, F.lit("://")) & v.rlike(words))


def looks_like_safe_hash_metadata(name: Column, value: Column) -> Column:
    return _flag(
        (looks_like_fixed_hash(value) == 1)
        & ~has_sensitive_name(name)
        & _shares_token(name, HASH_METADATA_TOKENS)
    )


def numeric_features(name: Column, value: Column) -> list[Column]:
    """The eight model inputs that describe the raw value, as aliased columns."""
    return [
        F.length(value).alias("length"),
        F.round(shannon_entropy(value), 6).alias("entropy"),
        F.round(digit_ratio(value), 6).alias("digit_ratio"),
        F.round(uppercase_ratio(value), 6).alias("uppercase_ratio"),
        F.round(special_ratio(value), 6).alias("special_ratio"),
        _flag(has_sensitive_name(name)).alias("has_sensitive_name"),
        _flag(is_compact_value(value)).alias("is_compact"),
        _flag(has_character_variety(value)).alias("has_character_variety"),
    ]


def context_flags(name: Column, value: Column) -> list[Column]:
    """The nine structural flags, as aliased columns."""
    return [
        looks_like_uuid(value).alias("looks_like_uuid"),
        looks_like_fixed_hash(value).alias("looks_like_fixed_hash"),
        is_hex_only(value).alias("is_hex_only"),
        looks_like_reference(value).alias("looks_like_reference"),
        looks_like_placeholder(value).alias("looks_like_placeholder"),
        has_public_frontend_prefix(name).alias("has_public_frontend_prefix"),
        has_identifier_name(name).alias("has_identifier_name"),
        looks_like_jwt(value).alias("looks_like_jwt"),
        looks_like_passphrase(value).alias("looks_like_passphrase"),
    ]


def context_features(name: Column, value: Column) -> list[Column]:
    """All eighteen inputs of the contextual model."""
    return [
        *numeric_features(name, value),
        *context_flags(name, value),
        looks_like_safe_hash_metadata(name, value).alias(HASH_METADATA_FLAG),
    ]
