"""Assignment extraction from one source line.

The expressions follow the reference grammar but are written for the Java engine:
possessive and unrolled, so that a minified two-megabyte line can neither backtrack
nor recurse.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quietkey.functions.text import WS, strip

_S = f"[{WS}]*+"
_DECLARATION = f"(?:(?:export[{WS}]++)?(?:const|let|var)[{WS}]++)?"
_TARGET = r"([A-Za-z_$][A-Za-z0-9_$]*+(?:\.[A-Za-z_$][A-Za-z0-9_$]*+)*+)"
_ANNOTATION = f"{_S}(?::[^=]++)?"
_QUOTED = r"""("[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+')"""
_COMMENT = r"(?:(?:#|//).*+)?"

#: target in group 1, quoted literal in group 2
CODE_LITERAL = (
    rf"(?d)\A{_S}{_DECLARATION}{_TARGET}{_ANNOTATION}=(?!=){_S}"
    rf"(?:[rRuUbB]{{1,2}})?{_QUOTED}{_S}(?:;{_S})?{_COMMENT}\z"
)
#: quote in group 1, name in group 2, quoted literal in group 3
PROPERTY_LITERAL = (
    rf"(?d)\A{_S}([\"']?)([A-Za-z_][A-Za-z0-9_-]*+)\1{_S}:{_S}{_QUOTED}{_S}(?:,{_S})?{_COMMENT}\z"
)
#: any assignment with a non-empty right-hand side; target in group 1
CODE_EXPRESSION = rf"(?d)\A{_S}{_DECLARATION}{_TARGET}{_ANNOTATION}=(?!=)."
#: name in group 1, raw value in group 2
DOTENV = rf"(?d)\A{_S}([A-Za-z_][A-Za-z0-9_]*+){_S}=(.*+)\z"


def unquote(literal: Column) -> Column:
    return F.substr(literal, F.lit(2), F.length(literal) - 2)


def final_name(target: Column) -> Column:
    """``self.password`` is about ``password``."""
    return F.substring_index(target, ".", -1)


def code_target(line: Column) -> Column:
    """Target of a code literal assignment, '' without one (targets are never empty)."""
    worth = F.contains(line, F.lit("=")) & line.rlike("[\"']")
    return F.when(worth, F.regexp_extract(line, CODE_LITERAL, 1)).otherwise(F.lit(""))


def property_name(line: Column) -> Column:
    worth = F.contains(line, F.lit(":")) & line.rlike("[\"']")
    return F.when(worth, F.regexp_extract(line, PROPERTY_LITERAL, 2)).otherwise(F.lit(""))


def extract_assignment(line: Column) -> Column:
    """First of code literal and property literal: struct, or null without either."""
    target, prop = code_target(line), property_name(line)
    return F.when(
        target != "",
        F.struct(
            final_name(target).alias("variable_name"),
            unquote(F.regexp_extract(line, CODE_LITERAL, 2)).alias("value"),
        ),
    ).when(
        prop != "",
        F.struct(
            prop.alias("variable_name"),
            unquote(F.regexp_extract(line, PROPERTY_LITERAL, 3)).alias("value"),
        ),
    )


def classify_assignment(line: Column) -> Column:
    """Literal, expression or nothing, as struct(kind, variable_name, value)."""
    literal = extract_assignment(line)
    target = F.regexp_extract(line, CODE_EXPRESSION, 1)
    return F.when(
        literal.isNotNull(),
        F.struct(
            F.lit("literal").alias("kind"),
            literal["variable_name"].alias("variable_name"),
            literal["value"].alias("value"),
        ),
    ).when(
        target != "",
        F.struct(
            F.lit("expression").alias("kind"),
            final_name(target).alias("variable_name"),
            F.lit(None).cast("string").alias("value"),
        ),
    )


def dotenv_name(line: Column) -> Column:
    return F.regexp_extract(line, DOTENV, 1)


def dotenv_value(line: Column) -> Column:
    value = strip(F.regexp_extract(line, DOTENV, 2))
    first, last = F.left(value, F.lit(1)), F.right(value, F.lit(1))
    quoted = (F.length(value) >= 2) & (first == last) & first.isin('"', "'")
    return F.when(quoted, unquote(value)).otherwise(value)


def extract_dotenv(line: Column) -> Column:
    """Name and value of a dotenv line; blank lines and comments give null."""
    name = dotenv_name(line)
    return F.when(
        name != "",
        F.struct(name.alias("variable_name"), dotenv_value(line).alias("value")),
    )


def candidate_text(name: Column, value: Column) -> Column:
    """The text form every lexical model sees."""
    return F.concat(F.coalesce(name, F.lit("")), F.lit(" = "), F.coalesce(value, F.lit("")))
