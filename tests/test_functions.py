"""Scalar functions against plain Python on Unicode and long input."""

import math
import random
import re
from collections import Counter
from fnmatch import fnmatchcase

import pytest
from pyspark.sql import functions as F

from quietkey.functions.assignments import classify_assignment, extract_assignment, extract_dotenv
from quietkey.functions.candidate import (
    analyze_candidate,
    analyze_client_exposure,
    has_character_variety,
    is_compact_value,
)
from quietkey.functions.features import context_features, digit_ratio, special_ratio, uppercase_ratio
from quietkey.functions.text import decode_utf8, drop_bom, mask_secret, shannon_entropy, split_lines, strip
from quietkey.operators.ignore import compile_glob, glob_matches, ignore_rules, mark_ignored
from quietkey.operators.paths import is_supported_file, relative_path, suffix

VALUES = [
    "", "a", "aab", "K7mP2xQ9vL4sN8zA1c", "\xa0x y\u2003", "ünïcødé\u00b2",
    "a\U0001f600b\U0001f600", "  pad  ", "x" * 9, "\x1cq\x1f", "\u2460\u0663Z", "1234567890123456",
]


def entropy(v):
    return -sum(c / len(v) * math.log2(c / len(v)) for c in Counter(v).values()) if v else 0.0


def variety(v):
    return sum((any(map(str.islower, v)), any(map(str.isupper, v)), any(map(str.isdigit, v)))) >= 2


def mask(v):
    v = v.strip()
    return "*" * len(v) if len(v) <= 8 else v[:4] + "*" * 8 + v[-4:]


def share(v, test):
    return sum(map(test, v)) / len(v) if v else 0.0


def test_values_match_python(spark):
    v = F.col("v")
    rows = spark.createDataFrame([(x,) for x in VALUES], "v string").select(
        "v", shannon_entropy(v).alias("e"), mask_secret(v).alias("m"), strip(v).alias("s"),
        is_compact_value(v).alias("c"), has_character_variety(v).alias("hv"),
        digit_ratio(v).alias("d"), uppercase_ratio(v).alias("u"), special_ratio(v).alias("sp"),
    ).collect()
    for r in rows:
        assert r.e == pytest.approx(entropy(r.v), abs=1e-12)
        assert (r.m, r.s) == (mask(r.v), r.v.strip())
        assert r.c == (not any(map(str.isspace, r.v)))
        assert r.hv == variety(r.v)
        assert r.d == pytest.approx(share(r.v, str.isdigit))
        assert r.u == pytest.approx(share(r.v, str.isupper))
        assert r.sp == pytest.approx(share(r.v, lambda c: not c.isalnum()))


def test_lines_and_decoding_match_python(spark):
    texts = ["", "\n", "a\n", "a", "a\r\nb\x0bc\x1cd\x85e\u2028f\r", "\n\na", "a\n\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split_lines(F.col("t")).alias("l"))
    assert all(r.l == r.t.splitlines() for r in rows.collect())
    raw = [b"abc\xff\xfedef", b"\xef\xbb\xbfhi", b"\xef\xbf\xbd\xff", b"ok \xc3\xa9", b"\xe2\x82x\xf0\x9f\x98\x80\xed\xa0\x80z"]
    rows = spark.createDataFrame([(b,) for b in raw], "b binary").select("b", drop_bom(decode_utf8(F.col("b"))).alias("t"))
    assert all(r.t == bytes(r.b).decode("utf-8", "ignore").removeprefix("\ufeff") for r in rows.collect())


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ('x = "a"', ("literal", "x", "a")),
        ("const k = 'v';", ("literal", "k", "v")),
        ('self.password: str = "a\\"d"  # hi', ("literal", "password", 'a\\"d')),
        ('"k": "v",', ("literal", "k", "v")),
        ("k-1: 'v' // c", ("literal", "k-1", "v")),
        ('x == "a"', None),
        ('x = f"a"', ("expression", "x", None)),
        ('x = rb"a"', ("literal", "x", "a")),
        ("x = foo()", ("expression", "x", None)),
        ('const = "q"', ("literal", "const", "q")),
        ('x = ""', ("literal", "x", "")),
        ('x = "a" b', ("expression", "x", None)),
        ("bearer: x", None),
        ('\xa0y\u2003=\x1c"z"', ("literal", "y", "z")),
    ],
)
def test_assignment_forms(spark, line, expected):
    found = spark.createDataFrame([(line,)], "l string").select(classify_assignment(F.col("l")).alias("a")).first().a
    assert (None if found is None else tuple(found)) == expected


def test_long_literals_do_not_recurse(spark):
    lines = ['x = "' + "a\\\\" * 300_000 + '"', 'x = "' + "\U0001f600a" * 200_000 + '"', "x = '" + " " * 500_000 + "' ;" + " " * 100_000 + "z"]
    frame = spark.createDataFrame([(x,) for x in lines], "l string")
    found = [r.n for r in frame.select(F.length(extract_assignment(F.col("l"))["value"]).alias("n")).collect()]
    assert found == [900_000, 400_000, None]


def test_dotenv_forms(spark):
    lines = {"A=1": ("A", "1"), ' N = "q v" ': ("N", "q v"), "export X=1": None, "# c=1": None, "": None, "A='x": ("A", "'x"), "A=b=c # d": ("A", "b=c # d")}
    frame = spark.createDataFrame([(x,) for x in lines], "l string")
    for r in frame.select("l", extract_dotenv(F.col("l")).alias("d")).collect():
        assert (None if r.d is None else tuple(r.d)) == lines[r.l]


def test_candidate_and_exposure(spark):
    rows = [("x", "K7mP2xQ9vL4sN8zA1c"), ("api-key", "abc"), ("password", "my long pass phrase"), ("VITE_API_TOKEN", "abc"), ("VITE_TITLE", "Hi"), ("other", "abc")]
    frame = spark.createDataFrame(rows, "n string, v string").select(
        "n", analyze_candidate(F.col("n"), F.col("v")).alias("a"), analyze_client_exposure(F.col("n"), F.col("v")).alias("e"))
    got = {r.n: r for r in frame.collect()}
    assert (got["x"].a.score, got["x"].a.is_suspicious, got["x"].a.entropy) == (60, True, round(entropy(rows[0][1]), 3))
    assert got["api-key"].a.score == 40 and not got["api-key"].a.is_suspicious
    assert got["password"].a.reasons == ["Sensitive variable name", "Long secret-like value"]
    assert got["VITE_API_TOKEN"].e.is_risky and got["VITE_API_TOKEN"].e.framework == "Vite"
    assert got["VITE_API_TOKEN"].e.reasons == ["Client-exposed environment variable", "Sensitive credential name", "Sensitive variable name"]
    assert not got["VITE_TITLE"].e.is_risky and got["VITE_TITLE"].e.is_client_exposed
    assert got["other"].e.framework is None and got["other"].e.candidate_score == 0


def test_context_flags(spark):
    h = "0123456789abcdef" * 4
    rows = [
        ("request_id", "123e4567-e89b-12d3-a456-426614174000", {"looks_like_uuid", "has_identifier_name"}),
        ("commit_sha", h[:40], {"looks_like_fixed_hash", "is_hex_only", "has_identifier_name", "looks_like_safe_hash_metadata"}),
        ("password_hash", h, {"looks_like_fixed_hash", "is_hex_only"}),
        ("a", "${KEY}", {"looks_like_reference"}), ("a", "%X%", {"looks_like_reference"}), ("a", "%%", set()),
        ("a", "os.getenv('X')", {"looks_like_reference"}), ("a", "YOUR_key", {"looks_like_placeholder"}),
        ("NEXT_PUBLIC_X", "a", {"has_public_frontend_prefix"}), ("a", "abcdef.ghijkl.mnopqr", {"looks_like_jwt"}),
        ("a", "amber bridge-canyon.härbor", {"looks_like_passphrase"}), ("a", "amber bridge canyon", set()),
    ]
    frame = spark.createDataFrame([(n, v) for n, v, _ in rows], "n string, v string")
    flags = [c for c in context_features(F.col("n"), F.col("v"))][8:]
    for r, (_, _, wanted) in zip(frame.select(*flags).collect(), rows, strict=True):
        assert {k for k, on in r.asDict().items() if on} == wanted


def test_globs_match_python(spark):
    rng = random.Random(5)
    globs = ["*.log", "src/*", "a?c", "[a-c]x", "[!a]x", "[]]", "[z-a]", "[!z-a]", "a[", "x.y+z", "[a^b]", "[\\d]", "a[[]b", "*[0-9-]*", "*", "**", "?", "*?", "?*", "a*a", "ab*ba", "*a*b*", "[!]a]*", "[--a]", "[a-c-x]"]
    names = ["a.log", "src/x/y", "abc", "bx", "ax", "]", "q", "a[", "x.y+z", "^", "\\", "d", "a[b", "v-1", "", "xAyz", "a", "aa", "aba", "abba", "日本a", "😀", "a😀b"]
    names += ["".join(rng.choice("abcx[]^-.") for _ in range(3)) for _ in range(40)]
    globs += ["".join(rng.choice(["a", "b", "/", "?", "*", "*", "[ab]", "[!a]", "[a-b]", "[", "]", "-", "é", "😀"]) for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    names += ["".join(rng.choice("ab/é😀-") for _ in range(rng.randrange(9))) for _ in range(60)]
    pairs = [(g, n) for g in globs for n in names]
    frame = spark.createDataFrame(pairs, "g string, n string")
    hit = glob_matches(F.col("n"), F.col("c"))
    matched = frame.withColumn("c", compile_glob(F.col("g"))).select("g", "n", hit.alias("hit"))
    for r in matched.collect():
        assert r.hit == fnmatchcase(r.n, r.g), (r.g, r.n)


def test_paths(spark):
    cases = {"a/./b/../c": "a/c", "../x": None, "a//b/": "a/b", "a/../../b": None, ".env": ".env", "/abs": "/abs", "a/..": ""}
    frame = spark.createDataFrame([(p,) for p in cases], "p string")
    got = {r.p: r.q for r in frame.select("p", relative_path(F.col("p")).alias("q")).collect()}
    assert {k: v for k, v in got.items() if k != "/abs"} == {k: v for k, v in cases.items() if k != "/abs"}
    rooted = frame.select("p", relative_path(F.col("p"), F.lit("/r")).alias("q")).collect()
    assert {r.p: r.q for r in rooted} == {**cases, "/abs": None}
    names = {".py": "", "a.py": ".py", "b.PY": ".py", "a.": "", "x/.env": "", "d.tar.gz": ".gz", "..x": ".x"}
    frame = spark.createDataFrame([(p,) for p in names], "p string")
    assert {r.p: r.s for r in frame.select("p", suffix(F.col("p")).alias("s")).collect()} == names
    assert frame.where(is_supported_file(F.col("p"))).count() == 3


@pytest.mark.parametrize("rule, hits, misses", [
    ("a.py", ["a.py", "x/a.py"], ["aa.py", "a.py/b"]),
    ("*.py", ["a.py", "x/y.py", ".py"], ["a.pyc"]),
    ("*", ["a", "x/y"], []),
    ("src/", ["src", "src/a", "src/b/c"], ["srcs/a", "x/src/a"]),
    ("/src/*.js", ["src/a.js", "src/b/c.js"], ["x/src/a.js"]),
    ("t[a-c]?.md", ["tb1.md", "x/ta2.md"], ["td1.md", "tb.md"]),
    ("a[b", ["a[b"], ["ab"]),
])
def test_ignore_rules_by_kind(spark, rule, hits, misses):
    files = spark.createDataFrame([("p", x) for x in hits + misses], "project_id string, path string")
    rules = spark.createDataFrame([("p", [rule])], "project_id string, patterns array<string>")
    assert {r.path for r in mark_ignored(files, rules).where("ignored").collect()} == set(hits)


def test_no_regex_is_compiled_per_row(spark):
    files = spark.createDataFrame([("p", "a.py")], "project_id string, path string")
    rules = ignore_rules(spark.createDataFrame([("p", ["a?[b]*.py"])], "project_id string, patterns array<string>"))
    plan = mark_ignored(files, rules)._jdf.queryExecution().optimizedPlan().toString()
    patterns = re.findall(r"RLIKE\([^,()]*(?:\([^()]*\))?[^,()]*, ([^)]{0,20})", plan)
    assert "globs" in plan and not any(re.search(r"#\d", p) for p in patterns)


def test_entropy_does_not_measure_its_text_by_character(spark):
    """A length inside the lambda was counted anew for every distinct character, twice."""
    texts = spark.createDataFrame([("aaa",), ("abab",), ("a" * 7,)], "v string")
    bits = texts.select(shannon_entropy(F.col("v")).alias("b"))
    assert [r.b for r in bits.collect()] == [0.0, 1.0, 0.0]
    plan = bits._jdf.queryExecution().analyzed().toString()
    merge = plan[plan.index("lambdafunction((") :].split("lambdafunction(CASE")[0]
    assert "length(v#" not in merge and "array_sort(" not in plan


def test_digit_share_of_plain_text_needs_no_class(spark):
    values = ["a1b22", "\u0663a", "12\u00b2", "", None, "\U0001f600" * 2 + "7"]
    frame = spark.createDataFrame([(v,) for v in values], "v string").select(digit_ratio(F.col("v")).alias("r"))
    assert [r.r for r in frame.collect()] == [0.6, 0.5, 1.0, 0.0, None, 1 / 3]
    assert "translate(" in frame._jdf.queryExecution().analyzed().toString()
