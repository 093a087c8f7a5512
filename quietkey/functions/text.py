"""Text primitives: whitespace, decoding, line splitting, masking, entropy.

Every helper takes and returns Spark Columns, so it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Python calls whitespace (``str.isspace``), once as
# the body of a regex character class and once as plain characters.
WS = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: the line boundaries of ``str.splitlines``.
LINE_BREAK = r"\r\n|[\n-\r\x1C-\x1E\x85\u2028\u2029]"

# Characters that are digits without being decimals (superscripts,
# circled and full-stop digits), next to the Unicode decimals.
DIGIT = (
    r"\p{Nd}\u00b2\u00b3\u00b9\u1369-\u1371\u19da\u2070\u2074-\u2079\u2080-\u2089"
    r"\u2460-\u2468\u2474-\u247c\u2488-\u2490\u24ea\u24f5-\u24fd\u24ff\u2776-\u277e"
    r"\u2780-\u2788\u278a-\u2792\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}"
    r"\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}"
)

# A marker that stands in for a genuine U+FFFD while undecodable bytes are dropped.
_REPLACEMENT, _KEEP = "\ufffd", "\U0010ffff"


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.btrim(text, F.lit(WHITESPACE))


def decode_utf8(content: Column) -> Column:
    """Bytes to text; undecodable bytes are dropped, real U+FFFD characters stay."""
    raw = content.cast("string")
    bad, keep = F.lit(_REPLACEMENT), F.lit(_KEEP)
    repaired = F.make_valid_utf8(F.replace(raw, bad, keep))
    repaired = F.replace(F.replace(repaired, bad, F.lit("")), keep, bad)
    return F.when(F.is_valid_utf8(raw), raw).otherwise(repaired)


def drop_bom(text: Column) -> Column:
    """Remove one leading byte-order mark."""
    marked = F.startswith(text, F.lit("\ufeff"))
    return F.when(marked, F.substr(text, F.lit(2))).otherwise(text)


def split_lines(text: Column) -> Column:
    """Array of lines; a final line break does not open another line."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(
        F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
    ).otherwise(parts)


def mask_secret(value: Column) -> Column:
    """Keep at most the first and last four characters of a value."""
    v = strip(value)
    return F.when(F.length(v) <= 8, F.repeat(F.lit("*"), F.length(v))).otherwise(
        F.concat(F.substr(v, F.lit(1), F.lit(4)), F.lit("*" * 8), F.right(v, F.lit(4)))
    )


def shannon_entropy(value: Column) -> Column:
    """Bits per character; the empty string has none.

    Sorting the characters and matching runs keeps the cost linear-logarithmic in the
    length, whatever the alphabet. Characters that stand alone need no run; one lambda call
    per repeated character remains, which doesn't measure the text again.
    """
    ordered = F.array_join(F.sort_array(F.split(value, "")), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1++"), F.lit(0))
    size = F.length(value).cast("double")
    most = F.log2(size)

    def bits(repeated: Column) -> Column:
        # A text of one character gives exactly nothing.
        return F.when(repeated == size * most, F.lit(0.0)).otherwise(most - repeated / size)

    repeated = F.aggregate(
        F.transform(runs, F.length), F.lit(0.0), lambda total, n: total + n * F.log2(n), bits
    )
    return F.when(value == "", F.lit(0.0)).otherwise(repeated)
