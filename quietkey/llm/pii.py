"""PII surrogates: every detected entity gets a keyed replacement of its own kind.

A replacement comes from a keyed permutation of all entities of the same shape, so different
entities never share one and an entity gets the same one in every document, without a table
of entities. Permutations are conjugated one-step cycles: none maps an entity to itself.
Cards keep a valid check digit, addresses their octet range, names their script, gender (by
title) and case. A document whose surrogate would equal another of its entities moves that
entity further along the cycle until a free one comes, and counts it. If the entities of a
document leave none free, all of them take the first step: surrogates stay distinct, but some
are those of other entities of it. A moved entity has another surrogate there than elsewhere,
which can be that of another entity in another document.
"""

from __future__ import annotations

import hmac
import ipaddress
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietkey.llm.common import free_name, table, written

#: Where a session names its key; the queries use the key for trials if it has none.
KEY_SETTING, TRIAL_KEY = "spark.quietkey.surrogate.key", b"for trials on synthetic tables only"
#: Documents with a remarkable surrogate that go to every executor (some 20 MB); more are joined by shuffle.
BROADCAST_ROWS = 500_000
KINDS = ("email", "phone", "ip", "card", "ssn", "iban", "name")

_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Where a number, and two places later an account, may start.
_STARTS = re.compile(r"[+(0-9]")
_NUMBER = re.compile(
    rf"(?<![\w.])(?P<ip>{_OCTET}(?:\.{_OCTET}){{3}})(?![\w]|\.\d)"
    r"|(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<![\w+])(?P<phone>(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}))(?!\w)"
    # National numbers: a trunk zero, or ten digits in blanks that belong to no row of numbers.
    r"|(?<![\w+.,:/-])(?<!\d )(?P<national>0[1-9](?P<gap>[ .-])\d{2}(?:(?P=gap)\d{2}){3}|0[1-9]\d{1,4}[ /-]\d{2,8}(?: \d{2,8}){0,3}|[2-9]\d{2} \d{3} \d{4})(?![\w:/%]|[ .,-]\d)"
    r"|(?<!\w)(?P<card>\d(?:[ -]?\d){12,18})(?!\w)",
    re.A,
)
_IP6 = re.compile(rf"(?<![\w:.])(?:[0-9A-Fa-f]{{0,4}}:){{2,7}}(?:{_OCTET}(?:\.{_OCTET}){{3}}|[0-9A-Fa-f]{{0,4}})(?![\w:]|\.\d)", re.A)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
#: Titles and the gender of the name after them.
_TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Señor": "m", "Sr": "m", "Monsieur": "m", "Господин": "m", "Κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Señora": "f", "Sra": "f", "Madame": "f", "Mme": "f", "Госпожа": "f", "Κυρία": "f",
    "Dr": "n", "Prof": "n",
}
_NAME = re.compile(rf"(?<!\w)({'|'.join(_TITLES)})(\.?[  ])([^\W\d_a-zа-яα-ω][^\W\d_]+(?:[ -][^\W\d_a-zа-яα-ω][^\W\d_]+){{0,2}})")

_WORD = re.compile(r"[^\W\d_]+")

_DIGITS, _LATIN = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Consonants, vowels and endings by gender of generated names, by script.
_SCRIPTS = {
    "latin": ("bcdfghjklmnprstvw", "aeiou", {"m": "n", "f": "a", "n": "r"}),
    "cyrillic": ("бвгдзклмнпрстфх", "аеиоу", {"m": "н", "f": "а", "n": "р"}),
    "greek": ("βγδζκλμνπρστφχ", "αειου", {"m": "ς", "f": "α", "n": "ν"}),
}
_RANGES = {"cyrillic": (0x400, 0x52F), "greek": (0x370, 0x3FF)}


class Entity(NamedTuple):
    kind: str
    start: int
    end: int
    text: str
    gender: str = ""


class Permutation:
    """A keyed permutation of 0..size-1 by a four-round Feistel network with cycle walking."""

    def __init__(self, key: bytes, label: str, size: int):
        self.key, self.label, self.size = key, label.encode(), size
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1

    def _round(self, i: int, value: int) -> int:
        width = (self.half + 7) // 8
        seed = self.label + bytes([i]) + value.to_bytes(width, "big")
        out = hmac.digest(self.key, seed, "sha256")
        while len(out) < width:
            out += hmac.digest(self.key, seed + out[-32:], "sha256")
        return int.from_bytes(out[:width], "big") & self.mask

    def _walk(self, value: int, rounds: range) -> int:
        forward = rounds.step > 0
        while True:
            left, right = value >> self.half, value & self.mask
            for i in rounds:
                if forward:
                    left, right = right, left ^ self._round(i, right)
                else:
                    left, right = right ^ self._round(i, left), left
            value = left << self.half | right
            if value < self.size:
                return value

    def moved(self, value: int, steps: int = 1) -> int:
        """Another value, by a cycle through all of them; a bijection without fixed points."""
        if self.size < 2:
            return value
        at = (self._walk(value, range(4)) + steps) % self.size
        return self._walk(at, range(3, -1, -1))


def _mixed(values: list[int], sizes: list[int]) -> int:
    out = 0
    for v, n in zip(values, sizes, strict=True):
        out = out * n + v
    return out


def _unmixed(number: int, sizes: list[int]) -> list[int]:
    out = []
    for n in reversed(sizes):
        number, v = divmod(number, n)
        out.append(v)
    return out[::-1]


def _shape_moved(text: str, fixed: int, key: bytes, label: str, steps: int) -> str:
    """Permutes letters and digits from place ``fixed`` on among texts of the same shape; case stays."""
    low = text.lower()
    places = [i for i in range(fixed, len(low)) if low[i] in _DIGITS or low[i] in _LATIN]
    sets = [_DIGITS if low[i] in _DIGITS else _LATIN for i in places]
    sizes = [len(s) for s in sets]
    shape = low[:fixed] + "".join("9" if c in _DIGITS else "a" if c in _LATIN else c for c in low[fixed:])
    size = 1
    for n in sizes:
        size *= n
    number = Permutation(key, f"{label}:{shape}", size).moved(_mixed([s.index(low[i]) for i, s in zip(places, sets, strict=True)], sizes), steps)
    out = list(text)
    for i, s, v in zip(places, sets, _unmixed(number, sizes), strict=True):
        out[i] = s[v].upper() if text[i].isupper() else s[v]
    return "".join(out)


def _luhn(digits: str) -> int:
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _refilled(text: str, digits: str) -> str:
    each = iter(digits)
    return "".join(next(each) if c in _DIGITS else c for c in text)


def _digits_moved(text: str, fixed: int, key: bytes, label: str, steps: int) -> str:
    """Permutes the digits after the first ``fixed``, however they are grouped."""
    digits = "".join(c for c in text if c in _DIGITS)
    free = digits[fixed:]
    moved = Permutation(key, f"{label}:{digits[:fixed]}:{len(free)}", 10 ** len(free)).moved(int(free or 0), steps)
    return _refilled(text, digits[:fixed] + (str(moved).zfill(len(free)) if free else ""))


def _card_moved(text: str, key: bytes, steps: int) -> str:
    """Keeps the first digit; the last one stays or becomes a check digit."""
    digits = "".join(c for c in text if c in _DIGITS)
    if _luhn(digits[:-1]) != int(digits[-1]):
        # One more digit of freedom: the same shape, but never a valid number.
        n = 10 ** (len(digits) - 2) * 9
        off = (int(digits[-1]) - _luhn(digits[:-1])) % 10 - 1
        at = Permutation(key, f"card-:{digits[0]}:{len(digits)}", n).moved(int(digits[1:-1]) * 9 + off, steps)
        body, off = divmod(at, 9)
        front = digits[0] + str(body).zfill(len(digits) - 2)
        return _refilled(text, front + str((_luhn(front) + off + 1) % 10))
    free = len(digits) - 2
    front = digits[0] + str(Permutation(key, f"card:{digits[0]}:{free}", 10**free).moved(int(digits[1:-1]), steps)).zfill(free)
    return _refilled(text, front + str(_luhn(front)))


def _script(word: str) -> str:
    code = ord(word[0])
    return next((s for s, (a, b) in _RANGES.items() if a <= code <= b), "latin")


def _name_moved(word: str, gender: str, key: bytes, steps: int) -> str:
    """A spoken-looking word for ``word``: its letters as a number, permuted and spelt in syllables.

    Lengths are taken together in steps of four letters; each step has its own syllable count,
    so two names never meet.
    """
    script, low = _script(word), word.lower()
    consonants, vowels, endings = _SCRIPTS[script]
    width = -(-len(low) // 4) * 4
    codes = [ord(c) + 1 for c in low]
    wide = max(codes) >= 1 << 11  # beyond the code points of the scripts served
    base = 1 << 21 if wide else 1 << 11
    number = _mixed(codes + [0] * (width - len(low)), [base] * width)
    size = base**width
    number = Permutation(key, f"name:{script}:{gender}:{width}" + ":wide" * wide, size).moved(number, steps)
    syllables = len(consonants) * len(vowels)
    count = 1
    while syllables**count < size:
        count += 1
    spelt = "".join(consonants[v // len(vowels)] + vowels[v % len(vowels)] for v in _unmixed(number, [syllables] * count))
    # A wide name has an even number of letters, others an odd one: the two never meet.
    spelt += vowels[0] * wide + endings[gender or "n"]
    return spelt.upper() if word.isupper() and len(word) > 1 else spelt.capitalize()


def _surrogate(e: Entity, key: bytes, steps: int = 1) -> str:
    if e.kind == "email":
        # The last label of the domain stays; so does the shape.
        head, dot, tail = e.text.rpartition(".")
        return _shape_moved(head, 0, key, "email:" + tail.lower(), steps) + dot + tail
    if e.kind == "phone":
        country = re.match(r"\+(\d{1,3}?)(?=[ .(-]|\d{7})", e.text)
        # National numbers keep their first digit, so a trunk zero stays one.
        return _digits_moved(e.text, len(country[1]) if country else int(e.text[0] != "+"), key, "phone+" if country else "phone", steps)
    if e.kind == "ip" and ":" in e.text:
        first, rest = divmod(int(ipaddress.IPv6Address(e.text)), 1 << 112)
        return str(ipaddress.IPv6Address(first << 112 | Permutation(key, f"ip6:{first}", 1 << 112).moved(rest, steps)))
    if e.kind == "ip":
        parts = [int(x) for x in e.text.split(".")]
        moved = Permutation(key, "ip", 256**4).moved(_mixed(parts, [256] * 4), steps)
        return ".".join(map(str, _unmixed(moved, [256] * 4)))
    if e.kind == "card":
        return _card_moved(e.text, key, steps)
    if e.kind == "ssn":
        return _digits_moved(e.text, 0, key, "ssn", steps)
    if e.kind == "iban":
        return _shape_moved(e.text, 2, key, "iban", steps)
    return _WORD.sub(lambda m: _name_moved(m[0], e.gender, key, steps), e.text)


def _is_ip6(text: str) -> bool:
    """An IPv6 address, and no slice, scope or time: a short form has two groups and five digits at least."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    groups = [g for g in text.split(":") if g]
    return any(c in _DIGITS for c in text) and len(groups) > 1 and len("".join(groups)) > 4


def find_entities(text: str) -> list[Entity]:
    """Entities by place; where two overlap, the first and then the longer one counts."""
    found = []
    if "@" in text:
        found += [Entity("email", m.start(), m.end(), m[0]) for m in _EMAIL.finditer(text)]
    done = bank = 0
    for hit in _STARTS.finditer(text):
        at = hit.start()
        if at >= max(bank, 2) and text[at - 1].isupper() and (m := _IBAN.match(text, at - 2)):
            if sum(c in _DIGITS for c in m[0]) >= 8 and 15 <= len(m[0].replace(" ", "")) <= 34:
                found.append(Entity("iban", m.start(), bank := m.end(), m[0]))
        if at >= done and (m := _NUMBER.match(text, at)):
            if m["national"]:
                if 9 <= sum(c in _DIGITS for c in m[0]) <= 12:
                    found.append(Entity("phone", at, done := m.end(), m[0]))
                continue
            found.append(Entity(m.lastgroup, at, done := m.end(), m[0]))
    if text.count(":") > 1:
        found += [Entity("ip", m.start(), m.end(), m[0]) for m in _IP6.finditer(text) if _is_ip6(m[0])]
    if any(title in text for title in _TITLES):
        found += [Entity("name", m.start(3), m.end(3), m[3], _TITLES[m[1]]) for m in _NAME.finditer(text)]
    found.sort(key=lambda e: (e.start, -e.end))
    out: list[Entity] = []
    for e in found:
        if not out or e.start >= out[-1].end:
            out.append(e)
    return out


def _units(found: list[Entity]) -> list[Entity]:
    """What is replaced as one: names word by word, anything else whole."""
    return [
        Entity("name", e.start + m.start(), e.start + m.end(), m[0], e.gender) if e.kind == "name" else e
        for e in found
        for m in (_WORD.finditer(e.text) if e.kind == "name" else (None,))
    ]


def _with_mentions(text: str, found: list[Entity]) -> list[Entity]:
    """``found`` with all other mentions of the words of its names, in a row.

    A title without gender takes that of the name's other titles, and a word without any title
    that of the first name which has it.
    """
    gender: dict[str, str] = {}
    for e in sorted((e for e in found if e.kind == "name"), key=lambda e: e.gender == "n"):
        for word in _WORD.findall(e.text):
            gender.setdefault(word.lower(), e.gender)
    if not gender:
        return found
    named = [e._replace(gender=gender[_WORD.findall(e.text)[-1].lower()]) if e.kind == "name" and e.gender == "n" else e for e in found]
    words = {w for e in found if e.kind == "name" for w in _WORD.findall(e.text)}
    words |= {w.upper() for w in words}
    out, at = [], 0
    for m in _WORD.finditer(text):
        if m[0] in words:
            while at < len(named) and named[at].end <= m.start():
                at += 1
            if at == len(named) or m.end() <= named[at].start:
                out.append(Entity("name", m.start(), m.end(), m[0], gender[m[0].lower()]))
    return sorted([*named, *out], key=lambda e: e.start)


def _identity(e: Entity) -> tuple[str, str]:
    """What the surrogate depends on: case and grouping don't count, the gender of a name does."""
    if e.kind == "name":
        return e.kind, f"{e.gender or 'n'}:{e.text.lower()}"
    if e.kind == "ip" and ":" in e.text:
        return e.kind, str(ipaddress.IPv6Address(e.text))
    return e.kind, re.sub(r"[\s()./-]", "", e.text).lower() if e.kind in ("phone", "card", "iban", "ssn") else e.text.lower()


def replace_entities(text: str, key: bytes) -> tuple[str, list[Entity], list[tuple[str, str, str]]]:
    """(text with surrogates, entities by place, (kind, entity, surrogate) of each entity once).

    A surrogate depends on its entity alone and never equals it; two entities have two
    surrogates, within a text and across texts.
    """
    found = find_entities(text)
    if not found:
        return text, found, []
    found = _with_mentions(text, found)
    parts, at, given = [], 0, {}
    for e in _units(found):
        me = _identity(e)
        new = _surrogate(e, key)
        given.setdefault(me, _identity(e._replace(text=new))[1])
        parts += [text[at : e.start], new]
        at = e.end
    return "".join(parts) + text[at:], found, [(*me, new) for me, new in given.items()]


_OUT = f"text string, {', '.join(f'n_{k} long' for k in KINDS)}, given array<struct<kind:string,entity:string,surrogate:string>>"


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names in ``spark.quietkey.surrogate.key``, else the one for trials."""
    named = spark.conf.get(KEY_SETTING, None)
    return named.encode() if named else TRIAL_KEY


def replace_pii(docs: DataFrame, key: bytes, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with one struct ``out``: the new text, mentions by kind, surrogates ``given``.

    A name is found after a title; its words are then replaced wherever they stand in the text. A
    null text stays null and an empty one empty, both without entities. Equal texts get equal
    results and rows are changed one by one: repeated rows and ties don't matter, an empty
    table gives an empty result, other columns stay; a column named like ``out`` is replaced.
    ``given`` has kind, entity and surrogate of each entity once. ``key`` decides all
    replacements; whoever has it can undo them. No shuffle.
    """

    @F.pandas_udf(_OUT)
    def replaced(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["text", *(f"n_{k}" for k in KINDS), "given"]
        for texts in batches:
            rows = []
            for t in texts:
                new, found, given = replace_entities(t, key) if t is not None else (None, [], [])
                kinds = [e.kind for e in found]
                rows.append((new, *(kinds.count(k) for k in KINDS), [dict(zip(("kind", "entity", "surrogate"), g, strict=True)) for g in given]))
            yield pd.DataFrame(rows, columns=names)

    return docs.withColumn(out, replaced(F.col(text).cast("string")))


def without_pii(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in their texts and the same columns; ``n_chars`` follows the text."""
    out = free_name(docs, "pii")
    changed = replace_pii(docs, key, text, out).withColumn(text, F.col(f"{out}.text"))
    if "n_chars" in docs.columns and text == "text":
        changed = changed.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(text).cast(docs.schema["n_chars"].dataType)))
    return changed.select(*docs.columns)


def colliding_surrogates(given: DataFrame) -> DataFrame:
    """``(kind, surrogate, entities)``: surrogates of ``given(kind, entity, surrogate)`` that stand for several entities."""
    each = given.groupBy("kind", "surrogate", "entity").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("entities")).where(F.col("entities") > 1)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changed documents; ``n_colliding`` of a document's surrogates stand for other entities
    too, ``n_original`` are themselves entities somewhere in the table."""
    replaced = replace_pii(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw")), session_key(spark), text="raw")
    stored = written(replaced.select("doc_id", "pii.*").withColumn("row", F.monotonically_increasing_id()), "surrogates")
    given = stored.select("row", F.inline("given"))
    shared = colliding_surrogates(given).select("kind", "surrogate", F.lit(1).alias("n_colliding"), F.lit(0).alias("n_original"))
    original = given.select("kind", F.col("entity").alias("surrogate")).distinct().select("*", F.lit(0).alias("n_colliding"), F.lit(1).alias("n_original"))
    counts = [F.sum(c).alias(c) for c in ("n_colliding", "n_original")]
    met = given.join(shared.unionByName(original), ["kind", "surrogate"]).groupBy("row").agg(*counts)
    # Next to no document has one; texts are shuffled only if many do.
    few = met.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    counted = stored.join(F.broadcast(met) if few else met, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_colliding", "n_original")})
    return counted.drop("row", "given")
