"""DuckDB formulations of the registered queries, written independently of the engine.

DuckDB matches with RE2 (no lookaround, no possessive quantifiers) and the derived
corpora are ASCII, so the patterns here are the plain textbook forms.
"""

from __future__ import annotations

from workload import corpora as C

Q = "''"  # a single quote inside a SQL literal
_QUOTED = rf"""("(?:[^"\\]|\\.)*"|{Q}(?:[^{Q}\\]|\\.)*{Q})"""
_COMMENT = r"(?:(?:#|//).*)?$"
# Fixed values up to _KEYWORDS: dotenv lines and the names that count as credentials.
ENV = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=(.*)$"
_PW = "password|passwd|pwd"
_AK = "api[_-]?key|secret[_-]?key|client[_-]?secret|access[_-]?token|auth[_-]?token"
_KEYWORDS = (
    "password|passwd|pwd|secret|token|api_key|apikey|client_secret|access_key|credential|credentials"
)


def ctes(*parts: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in parts)


def sensitive(n: str) -> str:
    return f"regexp_matches(replace(lower({n}), '-', '_'), '{_KEYWORDS}')"


def compact(v: str) -> str:
    return rf"NOT regexp_matches({v}, '[\s\x{{85}}\p{{Z}}\x1C-\x1F]')"


def variety(v: str) -> str:
    kinds = " + ".join(
        f"CAST(regexp_matches({v}, '{k}') AS INT)" for k in (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}")
    )
    return f"({kinds}) >= 2"


def entropy(v: str) -> str:
    return f"CASE WHEN {v} = '' THEN 0.0 ELSE list_entropy(string_split({v}, '')) END"


def mask(v: str) -> str:
    t = f"trim({v})"
    return (
        f"CASE WHEN length({t}) <= 8 THEN repeat('*', length({t})) "
        f"ELSE substr({t}, 1, 4) || '********' || right({t}, 4) END"
    )


def signals(n: str, v: str, prefix: str = "") -> str:
    """Score parts of a name and value as columns."""
    return (
        f"CAST({sensitive(n)} AS INT) AS {prefix}s1, "
        f"CAST(length({v}) >= 16 AND ({compact(v)} OR {sensitive(n)}) AS INT) AS {prefix}s2, "
        f"CAST({compact(v)} AND {entropy(v)} >= 3.5 AS INT) AS {prefix}s3, "
        f"CAST({compact(v)} AND {variety(v)} AS INT) AS {prefix}s4"
    )


def score(prefix: str = "") -> str:
    return f"(40 * {prefix}s1 + 20 * {prefix}s2 + 25 * {prefix}s3 + 15 * {prefix}s4)"


def reasons(prefix: str = "", first: str = "") -> str:
    texts = ("Sensitive variable name", "Long secret-like value", "High entropy", "Character variety")
    picks = [f"CASE WHEN {prefix}s{i} = 1 THEN '{t}' END" for i, t in enumerate(texts, 1)]
    return f"concat_ws('|', {', '.join(([first] if first else []) + picks)})"


def unquote(v: str) -> str:
    return f"substr({v}, 2, length({v}) - 2)"


def env_value(line: str) -> str:
    t = f"trim(regexp_extract({line}, '{ENV}', 2))"
    pair = f"length({t}) >= 2 AND left({t}, 1) = right({t}, 1) AND left({t}, 1) IN ('\"', '{Q}')"
    return f"CASE WHEN {pair} THEN {unquote(t)} ELSE {t} END"


def framework(n: str) -> str:
    return (
        f"CASE WHEN starts_with(upper({n}), 'VITE_') THEN 'Vite' "
        f"WHEN starts_with(upper({n}), 'NEXT_PUBLIC_') THEN 'Next.js' END"
    )


def semantic(n: str) -> str:
    return (
        f"CASE WHEN starts_with(upper({n}), 'VITE_') THEN substr({n}, 6) "
        f"WHEN starts_with(upper({n}), 'NEXT_PUBLIC_') THEN substr({n}, 13) ELSE {n} END"
    )


BASE = "regexp_extract(path, '[^/]*$')"
SUFFIX = rf"lower(regexp_extract({BASE}, '^.+(\.[^.]+)$', 1))"
DOTENV = f"{BASE} IN ('.env', '.env.local', '.env.development', '.env.production')"
CODE_FILE = f"{SUFFIX} IN ('.py', '.js', '.jsx', '.ts', '.tsx')"
SUPPORTED = (
    f"({SUFFIX} IN ('.py', '.js', '.jsx', '.ts', '.tsx', '.json', '.yaml', '.yml', '.html') OR {DOTENV})"
)
ARTIFACT_EXT = f"{SUFFIX} IN ('.js', '.mjs', '.cjs', '.css', '.html', '.json', '.map', '.txt')"
OWNED = r"regexp_matches(regexp_replace(path, '^(\./)+', ''), '^(dist|build|\.next/static)(/|$)')"
SKIPPED = r"regexp_matches(path, '(^|/)(\.git|\.venv|__pycache__|node_modules)(/|$)')"

# Reason texts of coverage limitations.
_SIZE = "'File exceeds the safe source scan limit of 2097152 bytes.'"
_BINARY = "'Binary content was detected in a supported text file.'"


def _reason(during: str, link: str) -> str:
    return (
        f"CASE WHEN is_symlink THEN 'Symbolic links are not followed during {link} security scans.' "
        f"WHEN length > 2097152 THEN {_SIZE} "
        f"WHEN NOT readable OR text IS NULL THEN 'File content could not be read safely{during}.' "
        f"WHEN contains(substr(text, 1, 8192), chr(0)) THEN {_BINARY} END"
    )


SOURCE_REASON = _reason("", "working-tree")
OTHER_REASON = _reason(" during artifact analysis", "artifact")
STAGED_REASON = (
    "CASE WHEN mode NOT IN ('100644', '100755') THEN "
    "'Staged Git entry is not a regular file (mode ' || mode || ').' "
    f"WHEN length > 2097152 THEN {_SIZE} "
    f"WHEN contains(substr(text, 1, 8192), chr(0)) THEN {_BINARY} END"
)


def roles(files: str, staged: bool = False, ignored: str = "false") -> str:
    if staged:
        seen = f"NOT {SKIPPED} AND NOT {ignored}"
        cols = (
            f"{seen} AND NOT {OWNED} AND {SUPPORTED} AS source, "
            f"{seen} AND {OWNED} AND {ARTIFACT_EXT} AS artifact, "
            f"{seen} AND NOT {OWNED} AND {DOTENV} AS dotenv, "
            f"{STAGED_REASON} AS source_reason, {STAGED_REASON} AS other_reason"
        )
    else:
        regular = "(NOT is_symlink OR readable)"
        cols = (
            f"NOT {SKIPPED} AND NOT {ignored} AND NOT {OWNED} AND {SUPPORTED} AS source, "
            f"{OWNED} AND {ARTIFACT_EXT} AND NOT {ignored} AND {regular} AS artifact, "
            f"NOT {SKIPPED} AND NOT {ignored} AND {DOTENV} AND {regular} AS dotenv, "
            f"{SOURCE_REASON} AS source_reason, {OTHER_REASON} AS other_reason"
        )
    return f"SELECT *, {cols} FROM ({files}) f"


LINES = r"""
SELECT project_id, path, {code} AS is_code, {dotenv} AS is_dotenv,
  generate_subscripts(parts, 1) AS line, unnest(parts) AS t
FROM (SELECT *, regexp_split_to_array(text, '\r\n|\n') AS parts FROM {source}) s"""


def lines(source: str) -> str:
    return LINES.format(code=CODE_FILE, dotenv=DOTENV, source=source)


# A line is taken apart in steps: a declaration word goes, then the target, then what stands
# behind its sign; or else a key before a colon.
_BARE = r"regexp_replace(regexp_replace(t, '^\s+', ''), '^(export\s+)?(const|let|var)\s+', '')"
_STEPS = rf"""
SELECT *, is_set AND right_side <> '' AND left(right_side, 1) <> '=' AS is_expression,
  CASE WHEN is_set THEN regexp_extract(right_side, '^\s*[rRuUbB]{{0,2}}{_QUOTED}\s*;?\s*{_COMMENT}', 1) ELSE '' END AS lit1,
  CASE WHEN key <> '' THEN regexp_extract(substr(line_start, length(key) + 1), '^\s*:\s*{_QUOTED}\s*,?\s*{_COMMENT}', 1) ELSE '' END AS lit2
FROM (
  SELECT *, target <> '' AND regexp_matches(rest, '^\s*(:[^=]+)?=') AS is_set,
    regexp_extract(rest, '^\s*(:[^=]+)?=(.*)$', 2) AS right_side,
    CASE left(line_start, 1) WHEN '"' THEN regexp_extract(line_start, '^"[A-Za-z_][A-Za-z0-9_-]*"')
      WHEN chr(39) THEN regexp_extract(line_start, '^{Q}[A-Za-z_][A-Za-z0-9_-]*{Q}')
      ELSE regexp_extract(line_start, '^[A-Za-z_][A-Za-z0-9_-]*') END AS key
  FROM (
    SELECT *, substr(bare, length(target) + 1) AS rest FROM (
      SELECT *, regexp_extract(bare, '^[A-Za-z_$][A-Za-z0-9_$]*([.][A-Za-z_$][A-Za-z0-9_$]*)*') AS target FROM (
        SELECT *, {_BARE} AS bare, regexp_replace(t, '^\s+', '') AS line_start FROM lines) a) b) c) d"""
PARSED = f"""
SELECT *, regexp_extract(target, '[^.]*$') AS target_name,
  CASE WHEN lit1 <> '' THEN regexp_extract(target, '[^.]*$') WHEN lit2 <> '' THEN trim(key, '"' || chr(39)) END AS name,
  CASE WHEN lit1 <> '' THEN {unquote("lit1")} WHEN lit2 <> '' THEN {unquote("lit2")} END AS val
FROM ({_STEPS}) p"""


def _known(kind: str, severity: str, values: str, where: str, distinct: bool = False) -> str:
    found = f"list_distinct({values})" if distinct else values
    return (
        f"SELECT project_id, path, line, '{kind}' AS type, '{severity}' AS severity, "
        f"unnest({found}) AS raw, t FROM layer2 WHERE {where}"
    )


def _named(words: str) -> str:
    return f"regexp_full_match(name, '(?i)(?:[A-Za-z0-9]+[_-])*(?:{words})')"


# Patterns of credentials in raw lines.
_TAIL = rf"""\s*[:=]\s*["{Q}]?([^"{Q}\s#]{{N,}})"""
_RAW_PW = rf"(?i)\b(?:[A-Za-z0-9]+[_-])*(?:{_PW})\b" + _TAIL.replace("N", "6")
_RAW_AK = rf"(?i)\b(?:{_AK})\b" + _TAIL.replace("N", "8")
_BEARER = r"(?i)\bBearer\s+([A-Za-z0-9._\-]{12,})"
_DBURL = r"(?i)\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?)://[^:\s]+:([^@\s]+)@"


def scan_ctes(files: str, staged: bool = False, ignored: str = "false") -> list[tuple[str, str]]:
    """CTEs up to ``findings`` and ``scanned`` for a file corpus."""
    text_only = "source AND source_reason IS NULL"
    limits = (
        f"SELECT project_id, path AS file, 1 AS line, 'Scan Coverage Limitation' AS type, "
        "'MEDIUM' AS severity, '-' AS masked_value, -1 AS candidate_score, '' AS framework, "
        "{reason} AS reasons, {keys} FROM roles WHERE {role} AND {reason} IS NOT NULL"
    )
    limit_union = [limits.format(reason="source_reason", role="source", keys=_keys(0, line="1"))]
    if staged:
        limit_union.append(limits.format(reason="other_reason", role="artifact", keys=_keys(0, line="1")))
    else:
        limit_union += [
            limits.format(reason="other_reason", role="dotenv", keys=_keys(1, line="1")),
            limits.format(reason="other_reason", role="artifact", keys=_keys(2, line="1")),
        ]
    known = " UNION ALL ".join(
        [
            _known("Hardcoded Password", "HIGH", "[val]",
                   rf"is_code AND name IS NOT NULL AND {_named(_PW)} AND regexp_full_match(val, '[^\s#]{{6,}}')"),
            _known("API Key", "HIGH", "[val]",
                   rf"is_code AND name IS NOT NULL AND {_named(_AK)} AND regexp_full_match(val, '[^\s#]{{8,}}')"),
            _known("Hardcoded Password", "HIGH", f"regexp_extract_all(t, '{_RAW_PW}', 1)", "NOT is_code"),
            _known("API Key", "HIGH", f"regexp_extract_all(t, '{_RAW_AK}', 1)", "NOT is_code"),
            _known("Bearer Token", "HIGH", f"regexp_extract_all(t, '{_BEARER}', 1)", "true", True),
            _known("Database Credential", "CRITICAL", f"regexp_extract_all(t, '{_DBURL}', 1)", "true", True),
        ]
    )
    exposed = (
        "SELECT * FROM (SELECT *, CAST(regexp_matches(replace(lower(sem), '-', '_'), "
        f"'{_KEYWORDS}') AS BOOLEAN) AS esens, {signals('sem', 'ev', 'e')} FROM ("
        f"SELECT project_id, path, line, {framework('en')} AS fw, {semantic('en')} AS sem, ev FROM ("
        f"SELECT *, regexp_extract(t, '{ENV}', 1) AS en, {env_value('t')} AS ev FROM lines WHERE is_dotenv) a"
        f") b WHERE fw IS NOT NULL) c WHERE esens OR {score('e')} >= 50"
    )
    return [
        ("roles", roles(files, staged, ignored)),
        ("scanned", "SELECT project_id, path, source OR artifact AS scanned FROM roles"),
        ("safe", f"SELECT project_id, path, text FROM roles WHERE {text_only}"),
        ("lines", lines("safe")),
        ("exposed", exposed),
        ("layer2", f"SELECT p.* FROM ({PARSED}) p ANTI JOIN exposed USING (project_id, path, line)"),
        ("known", known),
        (
            "generic",
            f"SELECT *, {signals('name', 'val')} FROM (SELECT l.* FROM layer2 l ANTI JOIN known "
            "USING (project_id, path, line) WHERE name IS NOT NULL) g",
        ),
        ("inventory", inventory("roles")),
        (
            "spread",
            "SELECT a.project_id, a.path, i.*, "
            "substr(a.text, 1, strpos(a.text, i.raw) - 1) AS before FROM roles a "
            "JOIN inventory i ON a.project_id = i.project_id AND contains(a.text, i.raw) "
            "WHERE a.artifact AND a.other_reason IS NULL",
        ),
        (
            "findings",
            " UNION ALL ".join(limit_union)
            + f" UNION ALL SELECT project_id, path, line, 'Client-Side Secret Exposure', 'CRITICAL', {mask('ev')}, "
            f"{score('e')}, fw, concat_ws('|', 'Client-exposed environment variable', "
            f"CASE WHEN esens THEN 'Sensitive credential name' END, nullif({reasons('e')}, '')), {_keys(0)} FROM exposed"
            f" UNION ALL SELECT project_id, path, line, type, severity, {mask('raw')}, -1, '', '', {_keys(0, detector=_DETECTORS)} FROM known"
            f" UNION ALL SELECT project_id, path, line, 'Unknown Secret Candidate', 'MEDIUM', {mask('val')}, "
            f"{score()}, '', {reasons()}, {_keys(0)} FROM generic WHERE {score()} >= 50"
            " UNION ALL SELECT project_id, path, length(before) - length(replace(before, chr(10), '')) + 1, "
            f"'Artifact Secret Exposure', 'CRITICAL', {mask('raw')}, candidate_score, 'Artifact', "
            "'Secret-like environment value was propagated into a shipped build artifact.|Source variable: ' "
            f"|| variable_name || '|Source file: ' || regexp_extract(source_path, '[^/]*$'), {_keys(2, 'source_path', 'source_line')} FROM spread",
        ),
    ]


#: Where a known finding stands among those of its line: detector, first place, longer values first.
_DETECTORS = "list_position(['Hardcoded Password', 'API Key', 'Bearer Token', 'Database Credential'], type) * 100000000 + strpos(t, raw) * 10000 - length(raw)"


def _keys(phase: int, path: str = "''", line: str = "line", detector: str = "0") -> str:
    """What orders a report after the project: phase, then (after the file) path, line, detector."""
    return f"{phase} AS phase, {path} AS order_path, {line} AS order_line, {detector} AS ordinal"


def report(files: str) -> str:
    """Findings with their place in report order."""
    order = "project_id, phase, file, order_path, order_line, ordinal, type, masked_value, reasons"
    return (
        f"{ctes(*scan_ctes(files))} SELECT {FINDING_COLUMNS}, row_number() OVER (ORDER BY {order}) AS position FROM findings"
    )


def inventory(role_table: str) -> str:
    """First occurrence of every secret-like dotenv value."""
    return f"""
SELECT project_id AS owner, project_id, raw, path AS source_path, line AS source_line, variable_name,
  {score()} AS candidate_score, {reasons()} AS reasons
FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, raw ORDER BY path, line) AS rn
  FROM (
    SELECT *, {signals("variable_name", "raw")} FROM (
      SELECT project_id, path, line, regexp_extract(t, '{ENV}', 1) AS variable_name, {env_value("t")} AS raw
      FROM (SELECT project_id, path, generate_subscripts(parts, 1) AS line, unnest(parts) AS t
            FROM (SELECT *, regexp_split_to_array(text, '\\r\\n|\\n') AS parts FROM {role_table}
                  WHERE dotenv AND other_reason IS NULL) d) l) v
    WHERE length(raw) >= 8) j
  WHERE s1 = 1 OR {score()} >= 50) r
WHERE rn = 1"""


FINDING_COLUMNS = (
    "project_id, file, CAST(line AS INT) AS line, type, severity, masked_value, "
    "CAST(candidate_score AS INT) AS candidate_score, coalesce(framework, '') AS framework, reasons"
)


def findings(files: str, staged: bool = False, ignored: str = "false") -> str:
    return f"{ctes(*scan_ctes(files, staged, ignored))} SELECT {FINDING_COLUMNS} FROM findings"


def gate(files: str, staged: bool = False, mode: str = "project") -> str:
    count = ", ".join(
        f"CAST(count(*) FILTER (severity = '{s}') AS BIGINT) AS {s.lower()}_count"
        for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")
    )
    return (
        f"{ctes(*scan_ctes(files, staged))} SELECT coalesce(s.project_id, f.project_id) AS project_id, "
        f"'{mode}' AS mode, coalesce(n, 0) AS files_scanned, coalesce(critical_count, 0) AS critical_count, "
        "coalesce(high_count, 0) AS high_count, coalesce(medium_count, 0) AS medium_count, "
        "coalesce(low_count, 0) AS low_count, coalesce(total, 0) AS findings_count, "
        "CASE WHEN coalesce(total, 0) = 0 THEN 'passed' ELSE 'failed' END AS gate "
        "FROM (SELECT project_id, CAST(count(*) FILTER (scanned) AS BIGINT) AS n FROM scanned GROUP BY 1) s FULL JOIN "
        f"(SELECT project_id, CAST(count(*) AS BIGINT) AS total, {count} FROM findings GROUP BY 1) f "
        "ON s.project_id = f.project_id"
    )
