"""Line detectors: known formats, client exposure and the scored generic layer.

``detect_lines`` turns a table of lines into a table of raw findings in one narrow
stage: a cheap line filter, regex extraction, then a single generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietkey.functions.assignments import (
    CODE_LITERAL,
    PROPERTY_LITERAL,
    code_target,
    dotenv_name,
    dotenv_value,
    final_name,
    property_name,
    unquote,
)
from quietkey.functions.candidate import (
    candidate_signals,
    client_framework,
    score_exposure,
    score_signals,
    without_client_prefix,
)
from quietkey.functions.text import WS

# Finding types and severities.
PASSWORD, API_KEY = "Hardcoded Password", "API Key"
BEARER, DATABASE = "Bearer Token", "Database Credential"
CLIENT, GENERIC = "Client-Side Secret Exposure", "Unknown Secret Candidate"
ARTIFACT, LIMITATION = "Artifact Secret Exposure", "Scan Coverage Limitation"
SEVERITY = {
    PASSWORD: "HIGH", API_KEY: "HIGH", BEARER: "HIGH", DATABASE: "CRITICAL",
    CLIENT: "CRITICAL", GENERIC: "MEDIUM", ARTIFACT: "CRITICAL", LIMITATION: "MEDIUM",
}

# The credential names the known-format detectors react to.
PASSWORD_WORDS = "password|passwd|pwd"
API_KEY_WORDS = "api[_-]?key|secret[_-]?key|client[_-]?secret|access[_-]?token|auth[_-]?token"

# Word boundaries spelled out: letters, numbers and underscore are word characters.
_START, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_TO_VALUE = f"[{WS}]*+[:=][{WS}]*+[\"']?"


def _raw_value(length: int) -> str:
    return f"([^\"'{WS}#]{{{length},}}+)"


# A hyphen is itself a boundary, so only underscore-joined segments precede the word.
RAW_PASSWORD = (
    rf"(?iu){_START}(?:[A-Za-z0-9]++_)*+(?:{PASSWORD_WORDS}){_END}{_TO_VALUE}{_raw_value(6)}"
)
RAW_API_KEY = rf"(?iu){_START}(?:{API_KEY_WORDS}){_END}{_TO_VALUE}{_raw_value(8)}"
BEARER_TOKEN = rf"(?iu){_START}Bearer[{WS}]++([A-Za-z0-9._\-]{{12,}}+)"
DATABASE_URL = (
    rf"(?iu){_START}(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?)://[^:{WS}]++:([^@{WS}]++)@"
)

def named_like(words: str, name: Column) -> Column:
    """Whole name is the credential word behind optional ``segment_`` prefixes."""
    shape = r"(?i)\A(?![_-])(?!.*[_-]{2})(?:[A-Za-z0-9_-]*[_-])?"
    return name.rlike(rf"{shape}(?:{words})\z")


def literal_matches(words: str, min_length: int, name: Column, value: Column) -> Column:
    """A parsed literal is a known secret: name family plus a plain value."""
    return named_like(words, name) & value.rlike(rf"\A[^{WS}#]{{{min_length},}}+\z")


def finding_item(
    kind: str,
    raw: Column | None = None,
    *,
    masked: Column | None = None,
    score: Column | None = None,
    framework: Column | None = None,
    reasons: Column | None = None,
    name: Column | None = None,
    phase: int = 0,
) -> Column:
    """One finding struct; ``raw_value`` and ``variable_name`` stay internal.

    ``phase`` orders a report: sources, inventory limitations, then artifacts.
    """
    null = F.lit(None)
    pick = lambda c: null if c is None else c
    return F.struct(
        F.lit(kind).alias("type"),
        F.lit(SEVERITY[kind]).alias("severity"),
        pick(raw).cast("string").alias("raw_value"),
        pick(masked).cast("string").alias("masked_value"),
        pick(score).cast("int").alias("candidate_score"),
        pick(framework).cast("string").alias("framework"),
        (F.array() if reasons is None else reasons).cast("array<string>").alias("reasons"),
        pick(name).cast("string").alias("variable_name"),
        F.lit(phase).alias("phase"),
    )


def known_values(
    line: Column, is_code: Column, name: Column, value: Column
) -> dict[str, Column]:
    """Known-format secrets of a line: one string array per detector, in detector order.

    Code files are judged by their parsed literal, all other formats by raw text.
    """
    none = F.array().cast("array<string>")

    def assigned(words: str, length: int, pattern: str) -> Column:
        literal = F.when(literal_matches(words, length, name, value), F.array(value))
        raw = F.when(
            line.rlike(f"(?iu){words}"), F.regexp_extract_all(line, F.lit(pattern), F.lit(1))
        )
        return F.coalesce(F.when(is_code, literal).otherwise(raw), none)

    def inline(hint: Column, pattern: str) -> Column:
        found = F.array_distinct(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)))
        return F.when(hint, found).otherwise(none)

    return {
        PASSWORD: assigned(PASSWORD_WORDS, 6, RAW_PASSWORD),
        API_KEY: assigned(API_KEY_WORDS, 8, RAW_API_KEY),
        BEARER: inline(F.contains(F.lower(line), F.lit("bearer")), BEARER_TOKEN),
        DATABASE: inline(F.contains(line, F.lit("://")), DATABASE_URL),
    }


def known_items(values: dict[str, Column]) -> Column:
    """Findings for the arrays of :func:`known_values`."""

    def items(kind: str) -> Column:
        return F.transform(values[kind], lambda v: finding_item(kind, v))

    return F.concat(*[items(kind) for kind in values])


def worth_scanning(line: Column) -> Column:
    """Every detector needs an assignment sign, a colon or the bearer keyword."""
    return (
        F.contains(line, F.lit("="))
        | F.contains(line, F.lit(":"))
        | F.contains(F.lower(line), F.lit("bearer"))
    )


def detect_lines(lines: DataFrame, keep: list[str], extra: Column | None = None) -> DataFrame:
    """Raw findings of a line table.

    ``lines`` holds ``line_text``, ``is_code``, ``is_dotenv`` and the ``keep`` columns;
    ``extra`` is an optional array of finding items that replaces the detectors where
    it is not null. The result has ``keep`` plus ``ordinal`` and the finding fields.
    """
    line = F.col("line_text")
    carried = [F.col(c) for c in keep]
    if extra is not None:
        lines = lines.withColumn("extra", extra)
        carried.append(F.col("extra"))
    base = [*carried, "line_text", "is_code", "is_dotenv"]
    # Each step reads the columns of the step before, so nothing is evaluated twice,
    # and the only row filter after the first step is the generator itself.
    parsed = lines.select(
        *base,
        code_target(line).alias("target"),
        property_name(line).alias("prop"),
        F.when(F.col("is_dotenv"), dotenv_name(line)).otherwise("").alias("env_name"),
    )
    target, prop = F.col("target"), F.col("prop")
    assigned = parsed.select(
        *base,
        F.when(target != "", final_name(target)).when(prop != "", prop).alias("name"),
        F.when(target != "", unquote(F.regexp_extract(line, CODE_LITERAL, 2)))
        .when(prop != "", unquote(F.regexp_extract(line, PROPERTY_LITERAL, 3)))
        .alias("value"),
        "env_name",
        client_framework(F.col("env_name")).alias("env_framework"),
    ).withColumn(
        "env_value", F.when(F.col("env_framework").isNotNull(), dotenv_value(line))
    )
    name, value, env_value = F.col("name"), F.col("value"), F.col("env_value")
    values = known_values(line, F.col("is_code"), name, value)
    matched = assigned.select(
        *carried,
        "name",
        "value",
        "env_value",
        "env_framework",
        F.when(
            env_value.isNotNull(),
            candidate_signals(without_client_prefix(F.col("env_name")), env_value),
        ).alias("env_signals"),
        *[found.alias(kind) for kind, found in values.items()],
    )
    known = {kind: F.col(f"`{kind}`") for kind in values}
    is_known = F.lit(False)
    for found in known.values():
        is_known = is_known | (F.size(found) > 0)
    env_signals = F.col("env_signals")
    exposed = matched.withColumn(
        "exposure",
        F.when(env_signals.isNotNull(), score_exposure(F.col("env_framework"), env_signals)),
    )
    exposure = F.col("exposure")
    risky = F.coalesce(exposure["is_risky"], F.lit(False))
    measured = exposed.withColumn(
        "signals",
        F.when(~risky & ~is_known & name.isNotNull(), candidate_signals(name, value)),
    )
    signals = F.col("signals")
    scored = measured.withColumn("analysis", F.when(signals.isNotNull(), score_signals(signals)))
    analysis = F.col("analysis")
    findings = (
        F.when(
            risky,
            F.array(
                finding_item(
                    CLIENT,
                    env_value,
                    score=exposure["candidate_score"],
                    framework=exposure["framework"],
                    reasons=exposure["reasons"],
                )
            ),
        )
        .when(is_known, known_items(known))
        .when(
            analysis["is_suspicious"],
            F.array(
                finding_item(
                    GENERIC,
                    value,
                    score=analysis["score"],
                    reasons=analysis["reasons"],
                    name=analysis["variable_name"],
                )
            ),
        )
    )
    if extra is not None:
        findings = F.coalesce(F.col("extra"), findings)
    return scored.select(*[F.col(c) for c in keep], F.posexplode(findings)).select(
        *keep, F.col("pos").alias("ordinal"), "col.*"
    )
