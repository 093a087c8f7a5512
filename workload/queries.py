"""Registered queries: every operator over whole given tables, with its DuckDB oracle."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietkey.functions import assignments as A
from quietkey.functions.candidate import (
    analyze_candidate,
    analyze_client_exposure,
    without_client_prefix,
)
from quietkey.functions.features import (
    CONTEXT_FEATURES,
    CONTEXT_FLAGS,
    NUMERIC_FEATURES,
    context_features,
    numeric_features,
)
from quietkey.functions.text import (
    LINE_BREAK,
    decode_utf8,
    mask_secret,
    shannon_entropy,
    split_lines,
)
from quietkey.lab import errors as R
from quietkey.lab import fusion as U
from quietkey.lab import models as M
from quietkey.lab import profile as D
from quietkey.lab.advisory import fit_advisory
from quietkey.lab.frozen import bundle_checks, dataset_identity, holdout_report, observed, table_digest
from quietkey.lab.metrics import calculate_metrics
from quietkey.lab.separation import compare_separation, separation_names, strictly_separate
from quietkey.lab.split import stratified_split
from quietkey.lab.synth import SPARK, SPECS, Dialect, sample_sql, synth_candidates
from quietkey.operators import ignore as I
from quietkey.operators import limits as L
from quietkey.operators import paths as P
from quietkey.operators.changes import change_set
from quietkey.operators.findings import public_findings
from quietkey.operators.ordering import name_checkpoints
from quietkey.operators.propagation import secret_inventory
from quietkey.plans.gatebench import (
    case_results,
    corpus_digest,
    family_metrics,
    gate_metrics,
)
from quietkey.plans.scan import project_roles, scan_change_set, scan_projects, scan_text
from quietkey.sources.projects import write_files
from workload import corpora as C
from workload import oracles as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query and, where SQL can say the same, its oracle."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def flat(findings: DataFrame, *more: str) -> DataFrame:
    """Public findings with plain columns, for value comparison."""
    return findings.select(
        *more,
        "project_id",
        "file",
        "line",
        "type",
        "severity",
        "masked_value",
        F.coalesce("candidate_score", F.lit(-1)).alias("candidate_score"),
        F.coalesce("framework", F.lit("")).alias("framework"),
        F.array_join("reasons", "|").alias("reasons"),
    )


@query("scan_findings", O.findings(C.FILES))
def scan_findings(spark, sf):
    return flat(scan_projects(C.files(spark, sf)).public())


@query("scan_by_kind", O.findings(C.FILES))
def scan_by_kind(spark, sf):
    """The same findings from a stored table in which each part of a scan reads its own partitions."""
    name_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"
    write_files(C.files(spark, sf), folder)
    return flat(scan_projects(spark.read.parquet(folder)).public())


@query("scan_report", O.report(C.FILES))
def scan_report(spark, sf):
    report = scan_projects(C.files(spark, sf)).report()
    return flat(report, "position")


@query("scan_gate_summary", O.gate(C.FILES))
def scan_gate_summary(spark, sf):
    return scan_projects(C.files(spark, sf)).summary().drop("ml_advisory_enabled")


# --- paths, ignore rules, limits -------------------------------------------------------

_ROLE_COLUMNS = "project_id, path, CAST(source AS INT) AS source, CAST(artifact AS INT) AS artifact, CAST(dotenv AS INT) AS dotenv"


@query("file_roles", f"{O.ctes(('roles', O.roles(C.FILES)))} SELECT {_ROLE_COLUMNS} FROM roles")
def file_roles(spark, sf):
    roles = project_roles(C.files(spark, sf))
    return roles.select(
        "project_id", "path", *[F.col(c).cast("int").alias(c) for c in ("source", "artifact", "dotenv")]
    )


@query(
    "file_predicates",
    f"""SELECT path, {O.SUFFIX} AS suffix, CAST({O.SUPPORTED} AS INT) AS supported,
      CAST({O.CODE_FILE} AS INT) AS code, CAST({O.DOTENV} AS INT) AS dotenv,
      CAST({O.OWNED} AS INT) AS artifact_path, CAST({O.ARTIFACT_EXT} AS INT) AS artifact_file,
      CAST({O.SKIPPED} AS INT) AS skipped FROM ({C.FILES}) f""",
)
def file_predicates(spark, sf):
    path = P.relative_path(F.col("path"))
    flags = {
        "supported": P.is_supported_file(path), "code": P.is_code_file(path),
        "dotenv": P.is_dotenv_file(path), "artifact_path": P.is_artifact_path(path),
        "artifact_file": P.is_artifact_file(path), "skipped": P.in_skipped_directory(path),
    }
    return C.files(spark, sf).select(
        F.col("path"), P.suffix(path).alias("suffix"), *[c.cast("int").alias(n) for n, c in flags.items()]
    )


_RAW_PATHS = """SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN 'a/./b/../c' || o_orderkey
    WHEN 1 THEN '../x' || o_orderkey WHEN 2 THEN 'a//b/' || o_orderkey || '/' WHEN 3 THEN 'a/../../b'
    WHEN 4 THEN './src/.env' WHEN 5 THEN 'plain/' || o_orderkey || '.py' ELSE 'a/b/../../..hidden/' || o_orderkey END AS path
  FROM orders"""


@query(
    "relative_paths",
    f"""SELECT k, coalesce(array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]),
        list_transform(string_split(path, '/'), lambda s: [s])),
        lambda acc, s: CASE WHEN acc IS NULL OR acc = ['<out>'] THEN ['<out>'] WHEN s[1] IN ('', '.') THEN acc
          WHEN s[1] = '..' THEN CASE WHEN len(acc) = 0 THEN ['<out>'] ELSE acc[1:len(acc) - 1] END
          ELSE list_concat(acc, s) END), '/'), '') AS inside FROM ({_RAW_PATHS}) r""",
)
def relative_paths(spark, sf):
    return C.corpus(spark, sf, _RAW_PATHS).select(
        "k", F.coalesce(P.relative_path(F.col("path")), F.lit("<out>")).alias("inside")
    )


# Every rule of the derived rule files, restated as a regex over the whole path or name.
_IGNORED = r"""(r.c IS NOT NULL AND CASE r.c % 5
    WHEN 0 THEN starts_with(path, 'src/') OR regexp_full_match(path, '.*\.yaml')
    WHEN 1 THEN regexp_full_match(path, 'web/.*') OR starts_with(path, 'dist/')
    WHEN 2 THEN regexp_full_match(path, 'svc.*/\.env') OR regexp_full_match(path, 'app.[0-4].*\.js')
      OR regexp_full_match(regexp_extract(path, '[^/]*$'), 'app.[0-4].*\.js')
    WHEN 3 THEN regexp_full_match(regexp_extract(path, '[^/]*$'), 'mod[^1-8].*\.py')
      OR regexp_full_match(path, '\.next/static/.*[a-c.]js')
    ELSE path = 'api' OR regexp_full_match(path, 'api/data.*') END)"""
# Rules see the path inside the project, without leading "./".
_IGNORED = re.sub(r"\bpath\b", r"regexp_replace(path, '^(\\./)+', '')", _IGNORED)
_RULED = f"""SELECT f.*, {_IGNORED} AS ignored FROM ({C.FILES}) f LEFT JOIN
  (SELECT 'p' || c_custkey AS project_id, c_custkey AS c FROM customer WHERE c_custkey % 3 = 0) r
  ON f.project_id = r.project_id"""


def _rules(spark, sf):
    rows = C.corpus(spark, sf, C.RULE_FILES)
    rule_files = rows.select(
        "project_id", F.lit(I.DEFAULT_IGNORE_FILE).alias("path"), F.lit(True).alias("readable"),
        F.col("text").cast("binary").alias("content"),
    )
    return I.rules_from_files(rule_files)


@query("ignore_rules", """SELECT 'p' || c_custkey AS project_id, CASE c_custkey % 5 WHEN 0 THEN 'src/|*.yaml'
    WHEN 1 THEN 'web/*|dist/' WHEN 2 THEN '/svc*/.env|app?[0-4]*.js' WHEN 3 THEN 'mod[!1-8]*.py|.next/static/*[a-c.]js'
    ELSE 'api|api/data*' END AS patterns FROM customer WHERE c_custkey % 3 = 0""")
def ignore_rules(spark, sf):
    return _rules(spark, sf).select("project_id", F.array_join("patterns", "|").alias("patterns"))


@query("ignored_files", f"SELECT project_id, path, CAST(ignored AS INT) AS ignored FROM ({_RULED}) x")
def ignored_files(spark, sf):
    marked = I.mark_ignored(C.files(spark, sf), _rules(spark, sf))
    return marked.select("project_id", "path", F.col("ignored").cast("int").alias("ignored"))


@query("scan_with_ignore_rules", O.findings(_RULED, ignored="ignored"))
def scan_with_ignore_rules(spark, sf):
    return flat(scan_projects(C.files(spark, sf), _rules(spark, sf)).public())


@query(
    "coverage_limitations",
    f"""SELECT path, coalesce(reason, '') AS reason FROM
      (SELECT path, {O.SOURCE_REASON} AS reason FROM ({C.FILES}) f) r""",
)
def coverage_limitations(spark, sf):
    reason = L.read_limitation(L.SOURCE_REASONS)
    return C.files(spark, sf).select("path", F.coalesce(reason, F.lit("")).alias("reason"))


# --- text, lines, extraction -----------------------------------------------------------

_BREAKS = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def _text_lines(table: str, key: str, text: str) -> str:
    return f"""SELECT {key} AS id, CAST(len(p) AS BIGINT) AS lines, CAST(list_max(list_transform(p, lambda x: length(x))) AS BIGINT) AS longest
      FROM (SELECT {key}, CASE WHEN q[len(q)] = '' THEN q[1:len(q) - 1] ELSE q END AS p
        FROM (SELECT {key}, regexp_split_to_array({text}, '{_BREAKS}') AS q FROM {table}) a) b"""


@query("source_lines", _text_lines("documents", "doc_id", "text"))
def source_lines(spark, sf):
    lines = C.table(spark, sf, "documents").select("doc_id", split_lines(F.col("text")).alias("p"))
    return lines.select(
        F.col("doc_id").alias("id"), F.size("p").cast("bigint").alias("lines"),
        F.array_max(F.transform("p", F.length)).cast("bigint").alias("longest"),
    )


_LINE_SOURCE = f"SELECT * FROM ({C.FILES}) f WHERE text IS NOT NULL"
_LINE_CTE = O.lines(f"({_LINE_SOURCE}) g")


def _file_lines(spark, sf):
    text = C.corpus(spark, sf, _LINE_SOURCE)
    lines = text.select("project_id", "path", F.posexplode(F.split("text", LINE_BREAK)).alias("p", "t"))
    return lines.withColumn("line", F.col("p") + 1)


@query(
    "assignments",
    f"""{O.ctes(("lines", _LINE_CTE), ("parsed", O.PARSED))} SELECT path, CAST(line AS INT) AS line,
      CASE WHEN name IS NOT NULL THEN 'literal' WHEN is_expression THEN 'expression' ELSE '' END AS kind,
      coalesce(name, CASE WHEN is_expression THEN target_name ELSE '' END) AS variable_name,
      coalesce(val, '') AS value FROM parsed""",
)
def assignments(spark, sf):
    found = A.classify_assignment(F.col("t"))
    rows = _file_lines(spark, sf).select("path", "line", found.alias("a"))
    return rows.select("path", "line", *[F.coalesce(f"a.{c}", F.lit("")).alias(c) for c in ("kind", "variable_name", "value")])


@query(
    "dotenv_assignments",
    f"""{O.ctes(("lines", _LINE_CTE))} SELECT path, CAST(line AS INT) AS line,
      regexp_extract(t, '{O.ENV}', 1) AS variable_name,
      CASE WHEN regexp_extract(t, '{O.ENV}', 1) = '' THEN '' ELSE {O.env_value("t")} END AS value FROM lines""",
)
def dotenv_assignments(spark, sf):
    rows = _file_lines(spark, sf).select("path", "line", A.extract_dotenv(F.col("t")).alias("a"))
    return rows.select("path", "line", *[F.coalesce(f"a.{c}", F.lit("")).alias(c) for c in ("variable_name", "value")])


# The given texts hold next to no credentials, so some get a line with a fake one.
_TEXT_TABLES = """SELECT 'documents' AS project_id, 'd' || doc_id || '.yaml' AS path, text || CASE doc_id % 6
    WHEN 0 THEN chr(10) || 'db_password: ' || substr(md5('d' || doc_id), 1, 11) WHEN 1 THEN chr(10) || 'auth: Bearer ' || md5('d' || doc_id)
    WHEN 2 THEN chr(10) || 'url: mysql://app:' || substr(md5('d' || doc_id), 1, 9) || '@host/db' ELSE '' END AS text FROM documents
  UNION ALL SELECT 'pages', 'w' || page_id || '.html', html || CASE page_id % 4
    WHEN 0 THEN chr(10) || 'client-secret: ' || md5('w' || page_id) WHEN 1 THEN chr(10) || 'token: "' || upper(md5('w' || page_id)) || 'x"' ELSE '' END FROM pages
  UNION ALL SELECT 'conversations', 'c' || conv_id || '_' || turn || '.py', text || CASE (conv_id + turn) % 5
    WHEN 0 THEN chr(10) || 'api_key = "' || md5('c' || conv_id) || '"' WHEN 1 THEN chr(10) || 'password = load()' ELSE '' END FROM conversations"""
_TEXT_FILES = f"""SELECT *, CAST(1 AS BIGINT) AS length, false AS is_symlink, true AS readable FROM ({_TEXT_TABLES}) t"""


def _text_findings(spark, sf):
    texts = C.corpus(spark, sf, _TEXT_TABLES)
    return scan_text(texts, F.col("path"), F.col("text"), F.col("project_id")), texts


@query(
    "scan_text_tables",
    f"{O.ctes(*O.scan_ctes(_TEXT_FILES))} SELECT s.project_id, coalesce(f.n, 0) AS findings, s.files FROM "
    "(SELECT project_id, CAST(count(*) FILTER (scanned) AS BIGINT) AS files FROM scanned GROUP BY 1) s LEFT JOIN "
    "(SELECT project_id, CAST(count(*) AS BIGINT) AS n FROM findings GROUP BY 1) f ON s.project_id = f.project_id",
)
def scan_text_tables(spark, sf):
    hits, texts = _text_findings(spark, sf)
    counted = texts.select("project_id", F.lit(1).alias("files"), F.lit(0).alias("findings")).unionByName(
        hits.select("project_id", F.lit(0).alias("files"), F.lit(1).alias("findings")))
    return counted.groupBy("project_id").agg(F.sum("files").alias("files"), F.sum("findings").alias("findings"))


@query("text_findings", f"{O.ctes(*O.scan_ctes(_TEXT_FILES))} SELECT project_id, file, type, severity, masked_value, "
       "CAST(candidate_score AS INT) AS candidate_score, reasons FROM findings")
def text_findings(spark, sf):
    return flat(public_findings(_text_findings(spark, sf)[0])).drop("line", "framework")


# --- scalar functions over quoted HTML attributes and derived candidates ---------------

_ATTRIBUTES = """SELECT page_id, unnest(regexp_extract_all(html, '([A-Za-z-]+)="([^"]*)"', 1)) AS variable_name,
  unnest(regexp_extract_all(html, '([A-Za-z-]+)="([^"]*)"', 2)) AS value FROM pages"""


def _attributes(spark, sf):
    pattern = F.lit('([A-Za-z-]+)="([^"]*)"')
    pairs = F.arrays_zip(
        F.regexp_extract_all("html", pattern, F.lit(1)).alias("variable_name"),
        F.regexp_extract_all("html", pattern, F.lit(2)).alias("value"),
    )
    return C.table(spark, sf, "pages").select("page_id", F.inline(pairs))


@query(
    "entropy_and_mask",
    f"""SELECT page_id, value, round({O.entropy("value")}, 6) AS entropy, {O.mask("value")} AS masked FROM ({_ATTRIBUTES}) a""",
)
def entropy_and_mask(spark, sf):
    value = F.col("value")
    return _attributes(spark, sf).select(
        "page_id", "value", F.round(shannon_entropy(value), 6).alias("entropy"), mask_secret(value).alias("masked"))


_ANALYSIS = f"""SELECT *, {O.signals("variable_name", "value")} FROM ({C.CANDIDATES}) c"""


@query(
    "candidate_analysis",
    f"""SELECT sample_id, CAST(length(value) AS INT) AS length, round({O.entropy("value")}, 3) AS entropy,
      CAST({O.score()} AS INT) AS score, CAST({O.score()} >= 50 AS INT) AS suspicious, {O.reasons()} AS reasons FROM ({_ANALYSIS}) a""",
)
def candidate_analysis(spark, sf):
    found = analyze_candidate(F.col("variable_name"), F.col("value"))
    rows = C.corpus(spark, sf, C.CANDIDATES).select("sample_id", found.alias("a"))
    return rows.select("sample_id", "a.length", "a.entropy", "a.score",
        F.col("a.is_suspicious").cast("int").alias("suspicious"), F.array_join("a.reasons", "|").alias("reasons"))


_EXPOSURE = f"""SELECT *, {O.signals("sem", "value")} FROM (SELECT *, {O.framework("variable_name")} AS fw,
  {O.semantic("variable_name")} AS sem FROM ({C.CANDIDATES}) c) d"""


@query(
    "client_exposure",
    f"""SELECT sample_id, coalesce(fw, '') AS framework, sem AS semantic_name,
      CAST(fw IS NOT NULL AND (s1 = 1 OR {O.score()} >= 50) AS INT) AS risky,
      CAST(CASE WHEN fw IS NULL THEN 0 ELSE {O.score()} END AS INT) AS score,
      CASE WHEN fw IS NULL THEN '' ELSE concat_ws('|', 'Client-exposed environment variable',
        CASE WHEN s1 = 1 THEN 'Sensitive credential name' END, nullif({O.reasons()}, '')) END AS reasons FROM ({_EXPOSURE}) e""",
)
def client_exposure(spark, sf):
    name = F.col("variable_name")
    rows = C.corpus(spark, sf, C.CANDIDATES).select(
        "sample_id", without_client_prefix(name).alias("semantic_name"),
        analyze_client_exposure(name, F.col("value")).alias("e"))
    return rows.select("sample_id", F.coalesce("e.framework", F.lit("")).alias("framework"), "semantic_name",
        F.col("e.is_risky").cast("int").alias("risky"), F.col("e.candidate_score").alias("score"),
        F.array_join("e.reasons", "|").alias("reasons"))


_NOT_DIGIT, _NOT_UPPER, _ALNUM = r"[^\p{Nd}]", r"[^\p{Lu}]", r"[\p{L}\p{N}]"


def _share(chars: str) -> str:
    return f"CASE WHEN value = '' THEN 0.0 ELSE CAST(length(regexp_replace(value, '{chars}', '', 'g')) AS DOUBLE) / length(value) END"


_NUMERIC = rf"""CAST(length(value) AS INT) AS length, round({O.entropy("value")}, 6) AS entropy,
  round({_share(_NOT_DIGIT)}, 6) AS digit_ratio, round({_share(_NOT_UPPER)}, 6) AS uppercase_ratio,
  round({_share(_ALNUM)}, 6) AS special_ratio, CAST({O.sensitive("variable_name")} AS INT) AS has_sensitive_name,
  CAST({O.compact("value")} AS INT) AS is_compact, CAST({O.variety("value")} AS INT) AS has_character_variety"""
_V = "trim(value)"
_TOKENS = "list_filter(regexp_split_to_array(lower(variable_name), '[^a-z0-9]+'), lambda w: w <> '')"
_WORDS = rf"list_filter(regexp_split_to_array({_V}, '[\s.-]+'), lambda w: w <> '')"
# Hints of a placeholder; below, prefixes of references and words of identifier and hash names.
_HINTS = (
    "example", "placeholder", "replace", "redacted", "not-configured", "not_configured", "fake", "demo", "sample",
    "your-", "your_", "insert-", "insert_", "do-not-use", "do_not_use",
)
_HASH = f"regexp_full_match({_V}, '[0-9a-fA-F]{{40}}|[0-9a-fA-F]{{64}}')"
_CONTEXT = rf"""CAST(regexp_full_match({_V}, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}') AS INT) AS looks_like_uuid,
  CAST({_HASH} AS INT) AS looks_like_fixed_hash,
  CAST(length({_V}) >= 16 AND regexp_full_match({_V}, '[0-9a-fA-F]+') AS INT) AS is_hex_only,
  CAST(regexp_matches(lower({_V}), '^(\$\{{|\$env:|process\.env\.|env\.|vault://|os\.getenv\()') OR
    (length({_V}) > 2 AND left({_V}, 1) = '%' AND right({_V}, 1) = '%') AS INT) AS looks_like_reference,
  CAST(regexp_matches(lower(value), '{'|'.join(_HINTS)}') AS INT) AS looks_like_placeholder,
  CAST(regexp_matches(upper(trim(variable_name)), '^(VITE_|NEXT_PUBLIC_)') AS INT) AS has_public_frontend_prefix,
  CAST(list_has_any({_TOKENS}, ['id','identifier','uuid','ref','reference','request','trace','build','commit','checksum','digest']) AS INT) AS has_identifier_name,
  CAST(regexp_full_match({_V}, '[A-Za-z0-9_-]{{6,}}\.[A-Za-z0-9_-]{{6,}}\.[A-Za-z0-9_-]{{6,}}') AS INT) AS looks_like_jwt,
  CAST(NOT contains({_V}, '://') AND len({_WORDS}) BETWEEN 4 AND 8 AND
    len(list_filter({_WORDS}, lambda w: NOT regexp_full_match(w, '\p{{L}}{{3,}}'))) = 0 AS INT) AS looks_like_passphrase,
  CAST({_HASH} AND NOT {O.sensitive("variable_name")} AND
    list_has_any({_TOKENS}, ['commit','revision','checksum','digest','sha','fingerprint','etag','repository','source']) AS INT) AS looks_like_safe_hash_metadata"""
_FEATURED = f"SELECT *, {_NUMERIC}, {_CONTEXT} FROM ({C.CANDIDATES}) c"


@query("ml_features", f"SELECT sample_id, {_NUMERIC} FROM ({C.CANDIDATES}) c")
def ml_features(spark, sf):
    return C.corpus(spark, sf, C.CANDIDATES).select("sample_id", *numeric_features(F.col("variable_name"), F.col("value")))


@query("html_attribute_features", f"SELECT page_id, variable_name, value, {_NUMERIC}, {_CONTEXT} FROM ({_ATTRIBUTES}) a")
def html_attribute_features(spark, sf):
    return _attributes(spark, sf).select("page_id", "variable_name", "value", *context_features(F.col("variable_name"), F.col("value")))


@query("context_features", f"SELECT sample_id, {_NUMERIC}, {_CONTEXT} FROM ({C.CANDIDATES}) c")
def context_feature_table(spark, sf):
    return C.corpus(spark, sf, C.CANDIDATES).select("sample_id", *context_features(F.col("variable_name"), F.col("value")))


@query("candidate_text", f"SELECT sample_id, variable_name || ' = ' || value AS text FROM ({C.CANDIDATES}) c")
def candidate_text_column(spark, sf):
    return C.corpus(spark, sf, C.CANDIDATES).select("sample_id", A.candidate_text(F.col("variable_name"), F.col("value")).alias("text"))


# --- inventory, propagation, change sets -----------------------------------------------

@query(
    "secret_inventory",
    f"""{O.ctes(("roles", O.roles(C.FILES)), ("inv", O.inventory("roles")))} SELECT project_id, source_path,
      CAST(source_line AS INT) AS source_line, variable_name, CAST(candidate_score AS INT) AS candidate_score, reasons,
      {O.mask("raw")} AS masked_value FROM inv""",
)
def inventory(spark, sf):
    roles = project_roles(C.files(spark, sf))
    safe = roles.where(F.col("dotenv") & L.read_limitation(L.ARTIFACT_REASONS).isNull())
    found = secret_inventory(safe.select("project_id", "path", decode_utf8(F.col("content")).alias("text")))
    return found.select("project_id", "source_path", "source_line", "variable_name", "candidate_score",
        F.array_join("reasons", "|").alias("reasons"), mask_secret(F.col("raw_value")).alias("masked_value"))


_CHANGED = f"""SELECT n.* FROM ({C.NEW_INDEX}) n LEFT JOIN ({C.OLD_INDEX}) o ON n.project_id = o.project_id AND n.path = o.path
  WHERE o.path IS NULL OR ((n.text IS DISTINCT FROM o.text OR n.mode <> o.mode)
    AND (n.mode = '120000') = (o.mode = '120000'))"""


def _index(spark, sf, sql):
    return C.files(spark, sf, sql)


@query("change_set", f"SELECT project_id, path, mode FROM ({_CHANGED}) c")
def change_set_entries(spark, sf):
    return change_set(_index(spark, sf, C.NEW_INDEX), _index(spark, sf, C.OLD_INDEX)).select("project_id", "path", "mode")


@query("scan_change_set", O.findings(_CHANGED, staged=True))
def scan_changes(spark, sf):
    changed = change_set(_index(spark, sf, C.NEW_INDEX), _index(spark, sf, C.OLD_INDEX))
    return flat(scan_change_set(changed).public())


@query("change_set_gate", O.gate(_CHANGED, staged=True, mode="staged"))
def change_set_gate(spark, sf):
    changed = change_set(_index(spark, sf, C.NEW_INDEX), _index(spark, sf, C.OLD_INDEX))
    return scan_change_set(changed).summary().drop("ml_advisory_enabled")


@query("content_sha256", f"SELECT project_id, path, sha256(text) AS sha256 FROM ({C.FILES}) f WHERE text IS NOT NULL")
def content_sha256(spark, sf):
    files = C.files(spark, sf).where(F.col("content").isNotNull())
    return files.select("project_id", "path", F.sha2("content", 256).alias("sha256"))


# --- gate benchmark --------------------------------------------------------------------

_PROJECT_CASES = f"SELECT f.* FROM ({C.CASE_FILES}) f JOIN ({C.CASES}) c ON f.project_id = c.project_id WHERE c.track <> 'staged'"
_STAGED_CASES = f"SELECT f.*, '100644' AS mode FROM ({C.CASE_FILES}) f JOIN ({C.CASES}) c ON f.project_id = c.project_id WHERE c.track = 'staged'"


def _case_results(spark, sf):
    project = scan_projects(C.files(spark, sf, _PROJECT_CASES))
    staged = scan_change_set(C.files(spark, sf, _STAGED_CASES))
    findings = project.findings.select("project_id", "type").unionByName(staged.findings.select("project_id", "type"))
    return case_results(C.corpus(spark, sf, C.CASES), findings)


def _prefixed(prefix: str, parts: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Rename CTEs so that two scans fit in one statement."""
    names = [n for n, _ in parts]
    out = []
    for name, sql in parts:
        for n in names:
            sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {prefix}{n}", sql)
        out.append((f"{prefix}{name}", sql))
    return out


_BOTH = (
    _prefixed("a_", O.scan_ctes(_PROJECT_CASES)) + _prefixed("b_", O.scan_ctes(_STAGED_CASES, staged=True))
    + [("hits", "SELECT project_id, type FROM a_findings UNION ALL SELECT project_id, type FROM b_findings"),
       ("results", f"""SELECT c.*, CASE WHEN h.n IS NULL THEN 'passed' ELSE 'failed' END AS predicted_gate,
          coalesce(h.n, 0) AS findings_count, coalesce(h.types, []) AS types FROM ({C.CASES}) c LEFT JOIN
          (SELECT project_id, CAST(count(*) AS BIGINT) AS n, list_sort(list(DISTINCT type)) AS types FROM hits GROUP BY 1) h
          ON c.project_id = h.project_id""")]
)


@query(
    "gate_case_results",
    f"""{O.ctes(*_BOTH)} SELECT project_id, family, track, expected_gate, predicted_gate, findings_count,
      array_to_string(types, '|') AS finding_types, CAST(predicted_gate = expected_gate AS INT) AS correct_gate,
      CASE WHEN expected_type IS NULL THEN -1 ELSE CAST(list_contains(types, expected_type) AS INT) END AS expected_type_found FROM results""",
)
def gate_case_results(spark, sf):
    return _case_results(spark, sf).select(
        "project_id", "family", "track", "expected_gate", "predicted_gate", "findings_count",
        F.array_join("finding_types", "|").alias("finding_types"), F.col("correct_gate").cast("int").alias("correct_gate"),
        F.coalesce(F.col("expected_type_found").cast("int"), F.lit(-1)).alias("expected_type_found"))


_CELL_SQL = """CAST(count(*) FILTER (track <> 'coverage') AS BIGINT) AS cases,
  CAST(count(*) FILTER (track <> 'coverage' AND expected_gate = 'failed' AND predicted_gate = 'failed') AS BIGINT) AS true_positive,
  CAST(count(*) FILTER (track <> 'coverage' AND expected_gate = 'passed' AND predicted_gate = 'passed') AS BIGINT) AS true_negative,
  CAST(count(*) FILTER (track <> 'coverage' AND expected_gate = 'passed' AND predicted_gate = 'failed') AS BIGINT) AS false_positive,
  CAST(count(*) FILTER (track <> 'coverage' AND expected_gate = 'failed' AND predicted_gate = 'passed') AS BIGINT) AS false_negative,
  CAST(count(*) AS BIGINT) AS gate_cases, CAST(count(*) FILTER (predicted_gate = expected_gate) AS BIGINT) AS gate_correct"""


def _div(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


@query(
    "gate_benchmark",
    f"""{O.ctes(*_BOTH, ("cells", f"SELECT {_CELL_SQL} FROM results"))} SELECT *,
      {_div("true_positive + true_negative", "cases")} AS accuracy, {_div("true_positive", "(true_positive + false_positive)")} AS precision,
      {_div("true_positive", "(true_positive + false_negative)")} AS recall,
      {_div("2 * true_positive", "(2 * true_positive + false_positive + false_negative)")} AS f1,
      {_div("false_positive", "(false_positive + true_negative)")} AS false_positive_rate,
      {_div("false_negative", "(false_negative + true_positive)")} AS false_negative_rate,
      gate_cases - gate_correct AS gate_incorrect, {_div("gate_correct", "gate_cases")} AS gate_accuracy FROM cells""",
)
def gate_benchmark(spark, sf):
    return gate_metrics(_case_results(spark, sf))


@query(
    "gate_benchmark_families",
    f"""{O.ctes(*_BOTH)} SELECT family, CAST(count(*) AS BIGINT) AS total,
      avg(CAST(predicted_gate = expected_gate AS DOUBLE)) AS gate_accuracy,
      coalesce(avg(CASE WHEN expected_type IS NOT NULL THEN CAST(list_contains(types, expected_type) AS DOUBLE) END), -1.0) AS expected_type_recall,
      CAST(count(*) FILTER (track <> 'coverage' AND expected_gate = 'passed' AND predicted_gate = 'failed') AS BIGINT) AS false_positive,
      CAST(count(*) FILTER (track <> 'coverage' AND expected_gate = 'failed' AND predicted_gate = 'passed') AS BIGINT) AS false_negative
      FROM results GROUP BY family""",
)
def gate_benchmark_families(spark, sf):
    families = family_metrics(_case_results(spark, sf))
    return families.withColumn("expected_type_recall", F.coalesce("expected_type_recall", F.lit(-1.0)))


def _merkle(name: str, source: str, key: str) -> str:
    """CTEs that fold hashes ``h`` along their prefix; the last one is ``<name>0``."""
    steps = [f"{name}s AS (SELECT {key}, h AS node, h || ':' || count(*) AS digest FROM {source} GROUP BY 1, 2)"]
    previous, node, digest = f"{name}s", "node", "digest"
    for width in (8, 6, 4, 2, 0):
        steps.append(
            f"{name}{width} AS (SELECT {key}, substr({node}, 1, {width}) AS node, "
            f"sha256(string_agg({digest}, '' ORDER BY {digest})) AS digest FROM {previous} GROUP BY 1, 2)")
        previous = f"{name}{width}"
    return ", ".join(steps)


@query(
    "gate_corpus_digest",
    f"""WITH fh AS (SELECT project_id, sha256(path || chr(10) || sha256(coalesce(text, ''))) AS h FROM ({C.CASE_FILES}) f),
      {_merkle("f", "fh", "project_id")},
      ch AS (SELECT family, sha256(c.project_id || chr(10) || family || chr(10) || track || chr(10) || expected_gate || chr(10)
        || coalesce(expected_type, '') || chr(10) || coalesce(digest, '')) AS h FROM ({C.CASES}) c LEFT JOIN f0 ON c.project_id = f0.project_id),
      {_merkle("c", "ch", "family")} SELECT family, digest FROM c0""",
)
def gate_corpus_digest(spark, sf):
    return corpus_digest(C.corpus(spark, sf, C.CASES), C.files(spark, sf, C.CASE_FILES))


# --- dataset profile -------------------------------------------------------------------

def _candidates(spark, sf):
    rows = C.corpus(spark, sf, C.CANDIDATES)
    return rows.select("*", *context_features(F.col("variable_name"), F.col("value")))


_LABELS = "CAST(count(*) FILTER (label = 1) AS BIGINT)"
_SAFE = "CAST(count(*) FILTER (label = 0) AS BIGINT)"
_ALL = "CAST(count(*) AS BIGINT)"


@query(
    "dataset_validation",
    f"""SELECT '' AS missing_columns, CAST(bool_and(label IN (0, 1)) AND count(DISTINCT label) = 2 AS INT) AS valid_labels,
      CAST(0 AS BIGINT) AS missing_values, CAST(count(*) - count(DISTINCT sample_id) AS BIGINT) AS duplicate_sample_ids,
      CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({_FEATURED}) d)) AS BIGINT) AS duplicate_rows,
      CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT variable_name, value FROM ({C.CANDIDATES}) e)) AS BIGINT) AS duplicate_candidates
      FROM ({C.CANDIDATES}) c""",
)
def dataset_validation(spark, sf):
    checked = D.validate_dataset(_candidates(spark, sf), D.V3_COLUMNS, strict_labels=True)
    return checked.withColumn("missing_columns", F.array_join("missing_columns", "|")).withColumn(
        "valid_labels", F.col("valid_labels").cast("int"))


@query("dataset_summary", f"""SELECT {_ALL} AS total_samples, {_LABELS} AS secret_samples, {_SAFE} AS safe_samples,
  {_div(_LABELS, _ALL)} AS secret_ratio FROM ({C.CANDIDATES}) c""")
def dataset_summary(spark, sf):
    return D.summarize(C.corpus(spark, sf, C.CANDIDATES))


_MEANS = ", ".join(f"round(avg({c}), 4) AS {c}" for c in NUMERIC_FEATURES)


@query("feature_summary", f"SELECT label, {_MEANS} FROM ({_FEATURED}) f GROUP BY label")
def feature_summary(spark, sf):
    return D.feature_summary(_candidates(spark, sf))


@query("sample_type_distribution", f"SELECT label, sample_type, {_ALL} AS count FROM ({C.CANDIDATES}) c GROUP BY 1, 2")
def sample_type_distribution(spark, sf):
    return D.sample_type_distribution(C.corpus(spark, sf, C.CANDIDATES))


@query("hard_examples", f"""SELECT CAST(count(*) FILTER (label = 1 AND has_sensitive_name = 0) AS BIGINT) AS positive_without_sensitive_name,
  CAST(count(*) FILTER (label = 0 AND has_sensitive_name = 1) AS BIGINT) AS negative_with_sensitive_name FROM ({_FEATURED}) f""")
def hard_examples(spark, sf):
    return D.hard_example_counts(_candidates(spark, sf))


@query("sensitive_name_rates", f"""SELECT CAST(count(*) FILTER (has_sensitive_name = 1) AS BIGINT) AS sensitive_name_samples,
  round(avg(label) FILTER (has_sensitive_name = 1), 4) AS sensitive_name_secret_rate,
  CAST(count(*) FILTER (has_sensitive_name = 0) AS BIGINT) AS non_sensitive_name_samples,
  round(avg(label) FILTER (has_sensitive_name = 0), 4) AS non_sensitive_name_secret_rate FROM ({_FEATURED}) f""")
def sensitive_name_rates(spark, sf):
    return D.sensitive_name_rates(_candidates(spark, sf))


@query("sensitive_name_table", f"""SELECT has_sensitive_name, {_ALL} AS samples, {_LABELS} AS secret_samples, {_SAFE} AS safe_samples,
  {_div(_LABELS, _ALL)} AS secret_rate FROM ({_FEATURED}) f GROUP BY 1""")
def sensitive_name_table(spark, sf):
    return D.sensitive_name_table(_candidates(spark, sf))


def _unpivot(flags, select: str) -> str:
    return " UNION ALL ".join(select.replace("$", f) for f in flags)


@query("context_activation", f"""WITH f AS ({_FEATURED}) """ + _unpivot(CONTEXT_FLAGS,
    f"SELECT '$' AS feature, label, CAST(sum($) AS BIGINT) AS activated, {_ALL} AS total, avg($) AS activation_rate FROM f GROUP BY label"))
def context_activation(spark, sf):
    return D.context_activation_by_label(_candidates(spark, sf))


@query("context_secret_rates", f"""WITH f AS ({_FEATURED}) """ + _unpivot(CONTEXT_FLAGS,
    f"""SELECT '$' AS feature, CAST(sum($) AS BIGINT) AS activated, CAST(sum($ * label) AS BIGINT) AS secret_count,
    CAST(sum($ * (1 - label)) AS BIGINT) AS safe_count, {_div("sum($ * label)", "sum($)")} AS secret_rate_when_active FROM f"""))
def context_secret_rates(spark, sf):
    return D.context_secret_rates(_candidates(spark, sf))


@query("context_overlap", f"""WITH f AS ({_FEATURED}) """ + _unpivot(D.OVERLAP_FLAGS,
    """SELECT '$' AS feature, CAST(sum($ * (1 - label)) AS BIGINT) AS safe_activations, CAST(sum($ * label) AS BIGINT) AS secret_activations,
    CAST(sum($ * label) > 0 AND sum($ * (1 - label)) > 0 AS INT) AS appears_in_both_classes FROM f"""))
def context_overlap(spark, sf):
    return D.context_overlap(_candidates(spark, sf)).withColumn("appears_in_both_classes", F.col("appears_in_both_classes").cast("int"))


def _activation(dataset: str, source: str) -> str:
    return _unpivot(CONTEXT_FLAGS, f"SELECT '{dataset}' AS dataset, '$' AS feature, CAST(sum($) AS BIGINT) AS activated, {_ALL} AS total, avg($) AS activation_rate FROM f WHERE source = '{source}'")


@query("activation_comparison", f"WITH f AS ({_FEATURED}) " + _activation("training_v2", "orders_0") + " UNION ALL " + _activation("challenge_v1_dev", "orders_1"))
def activation_comparison(spark, sf):
    rows = C.corpus(spark, sf, C.CANDIDATES)
    return D.compare_activation(rows.where("source = 'orders_0'"), rows.where("source = 'orders_1'"))


@query("hash_metadata_by_label", f"""SELECT label, CAST(sum(looks_like_safe_hash_metadata) AS BIGINT) AS activated, {_ALL} AS total,
  avg(looks_like_safe_hash_metadata) AS rate FROM ({_FEATURED}) f GROUP BY label""")
def hash_metadata_by_label(spark, sf):
    return D.hash_metadata_by_label(_candidates(spark, sf))


# --- separation and identities ---------------------------------------------------------

def _shared(columns: str) -> str:
    one = f"SELECT DISTINCT {columns} FROM ({C.CANDIDATES}) c WHERE source ="
    return f"({one} 'orders_0' INTERSECT {one} 'orders_1')"


def _all_of(source: str) -> str:
    return f"(SELECT {_ALL} FROM ({C.CANDIDATES}) c WHERE source = '{source}')"


@query(
    "dataset_separation",
    f"""SELECT (SELECT {_ALL} FROM ({C.CANDIDATES}) c WHERE source = 'orders_0') AS training_samples,
      (SELECT {_ALL} FROM ({C.CANDIDATES}) c WHERE source = 'orders_1') AS development_samples,
      (SELECT {_ALL} FROM {_shared("variable_name, value")} s) AS shared_candidate_pairs,
      (SELECT {_ALL} FROM {_shared("value")} s) AS shared_exact_values,
      (SELECT string_agg(sample_type, '|' ORDER BY sample_type) FROM {_shared("sample_type")} s) AS shared_sample_types,
      '' AS shared_sources, 'orders_0' AS training_sources, 'orders_1' AS development_sources, 0 AS strictly_separate""",
)
def dataset_separation(spark, sf):
    rows = C.corpus(spark, sf, C.CANDIDATES)
    report = strictly_separate(compare_separation(rows.where("source = 'orders_0'"), rows.where("source = 'orders_1'"), named=True))
    return report.select("training_samples", "development_samples", "shared_candidate_pairs", "shared_exact_values",
        F.array_join("shared_type_names", "|").alias("shared_sample_types"), F.array_join("shared_source_names", "|").alias("shared_sources"),
        *(F.array_join(c, "|").alias(c) for c in ("training_sources", "development_sources")),
        F.col("strictly_separate").cast("int").alias("strictly_separate"))


@query("separation_names", f"""SELECT what, name, CAST(count(*) FILTER (source = 'orders_0') AS BIGINT) AS in_training,
    CAST(count(*) FILTER (source = 'orders_1') AS BIGINT) AS in_development FROM
    (SELECT source, 'type' AS what, sample_type AS name FROM ({C.CANDIDATES}) c UNION ALL SELECT source, 'source', source FROM ({C.CANDIDATES}) d) u
  GROUP BY what, name""")
def shared_names(spark, sf):
    rows = C.corpus(spark, sf, C.CANDIDATES)
    return separation_names(rows.where("source = 'orders_0'"), rows.where("source = 'orders_1'"))


@query("dataset_separation_disjoint", f"""SELECT {_all_of("orders_0")} AS training_samples, {_all_of("orders_1")} AS development_samples,
  CAST(0 AS BIGINT) AS shared_candidate_pairs, CAST(0 AS BIGINT) AS shared_exact_values, CAST(0 AS BIGINT) AS shared_sample_types,
  CAST(0 AS BIGINT) AS shared_sources, 1 AS strictly_separate""")
def dataset_separation_disjoint(spark, sf):
    own = {c: F.concat_ws("/", "source", c) for c in ("value", "sample_type")}
    rows = C.corpus(spark, sf, C.CANDIDATES).withColumns(own)
    report = strictly_separate(compare_separation(rows.where("source = 'orders_0'"), rows.where("source = 'orders_1'")))
    return report.withColumn("strictly_separate", F.col("strictly_separate").cast("int"))


# Three sets of a bundle; the third shares some values with the second, nothing with the first.
_BUNDLE = {
    "training": f"SELECT * FROM ({C.CANDIDATES}) c WHERE source = 'orders_0'",
    "development": f"SELECT sample_id, variable_name, 'd' || value AS value, label, 'd' || sample_type AS sample_type, framework, source FROM ({C.CANDIDATES}) c WHERE source = 'orders_1'",
    "holdout": f"SELECT sample_id, variable_name, CASE WHEN length(value) = 21 THEN 'd' ELSE 'h' END || value AS value, label, 'h' || sample_type AS sample_type, framework, 'held' AS source FROM ({C.CANDIDATES}) c",
}


@query("frozen_bundle", " UNION ALL ".join(
    f"""SELECT '{n}' AS name, {_ALL} AS samples, min(source) AS first_source, max(source) AS last_source, {_SAFE} AS safe_samples, {_LABELS} AS secret_samples,
    (SELECT {_ALL} FROM (SELECT value FROM ({q}) a INTERSECT SELECT value FROM ({_BUNDLE['holdout']}) h) i) AS shared_values FROM ({q}) b"""
    for n, q in _BUNDLE.items()))
def frozen_bundle(spark, sf):
    held = {n: observed(n, C.corpus(spark, sf, q)) for n, q in _BUNDLE.items()}
    shared = {r["what"]: r for r in bundle_checks(held).collect()}["value"]
    values = C.corpus(spark, sf, _BUNDLE["holdout"]).select("value").distinct().count()
    rows = []
    for name, one in held.items():
        seen = one.seen.get
        rows.append((name, *(seen[c] for c in ("samples", "first_source", "last_source", "safe_samples", "secret_samples")), values if name == "holdout" else shared[name]))
    return spark.createDataFrame(rows, "name string, samples long, first_source string, last_source string, safe_samples long, secret_samples long, shared_values long")


@query("dataset_identity", f"""SELECT {_ALL} AS samples, string_agg(DISTINCT source, '|' ORDER BY source) AS sources,
  {_SAFE} AS safe_samples, {_LABELS} AS secret_samples FROM ({C.CANDIDATES}) c""")
def identity(spark, sf):
    found = dataset_identity(C.corpus(spark, sf, C.CANDIDATES))
    return found.withColumn("sources", F.array_join("sources", "|"))


_ROW = " || ',' || ".join(
    f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    for c in ("framework", "label", "sample_id", "sample_type", "source", "value", "variable_name"))


@query("table_digest", f"""WITH rh AS (SELECT 0 AS one, sha256({_ROW}) AS h FROM ({C.CANDIDATES}) c), {_merkle("r", "rh", "one")}
  SELECT (SELECT {_ALL} FROM rh) AS samples, digest FROM r0""")
def digest(spark, sf):
    return table_digest(C.corpus(spark, sf, C.CANDIDATES))


# --- predictions: metrics, errors, fusion ----------------------------------------------

_CONFUSION = """CAST(count(*) FILTER (label = 0 AND p = 0) AS BIGINT) AS true_negatives, CAST(count(*) FILTER (label = 0 AND p = 1) AS BIGINT) AS false_positives,
  CAST(count(*) FILTER (label = 1 AND p = 0) AS BIGINT) AS false_negatives, CAST(count(*) FILTER (label = 1 AND p = 1) AS BIGINT) AS true_positives"""
_RATES = f"""{_div("true_positives + true_negatives", "(true_positives + true_negatives + false_positives + false_negatives)")} AS accuracy,
  {_div("true_positives", "(true_positives + false_positives)")} AS precision, {_div("true_positives", "(true_positives + false_negatives)")} AS recall,
  {_div("2 * true_positives", "(2 * true_positives + false_positives + false_negatives)")} AS f1"""


def _auc(source: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {by + "," if by else ""} (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (CAST(sum(label) AS DOUBLE) * sum(1 - label)) AS roc_auc
      FROM (SELECT *, rank() OVER ({part}ORDER BY s) + (count(*) OVER (PARTITION BY {by + ", " if by else ""}s) - 1) / 2.0 AS r FROM ({source}) x) y {"GROUP BY " + by if by else ""}"""


@query(
    "classification_metrics",
    f"""WITH m AS (SELECT {_ALL} AS samples, {_CONFUSION} FROM (SELECT label, text_prediction AS p FROM ({C.PREDICTIONS}) v) w)
      SELECT m.*, {_RATES}, (SELECT roc_auc FROM ({_auc(f"SELECT label, text_probability AS s FROM ({C.PREDICTIONS}) v")}) a) AS roc_auc FROM m""",
)
def classification_metrics(spark, sf):
    return calculate_metrics(C.corpus(spark, sf, C.PREDICTIONS), "label", "text_prediction", "text_probability")


def _grid(weights, thresholds, other: str) -> str:
    def number(x: float) -> str:
        return f"CAST('{x!r}' AS DOUBLE)"

    ws = ", ".join(f"({number(w)}, {number(1.0 - w)})" for w in weights)
    ts = ", ".join(f"({number(t)})" for t in thresholds)
    return f"""WITH b AS (SELECT label, w, o, w * text_probability + o * {other} AS s FROM ({C.PREDICTIONS}) v, (VALUES {ws}) g(w, o)),
      auc AS ({_auc("SELECT * FROM b", "w")}),
      cells AS (SELECT w, o, t, {_CONFUSION} FROM (SELECT *, CAST(s >= t AS INT) AS p FROM b, (VALUES {ts}) h(t)) c GROUP BY 1, 2, 3),
      grid AS (SELECT c.w AS text_weight, c.o AS other_weight, c.t AS threshold, true_negatives, false_positives, false_negatives,
        true_positives, {_RATES}, roc_auc, false_positives + false_negatives AS total_errors FROM cells c JOIN auc ON c.w = auc.w)"""


_V1_GRID = _grid(U.V1_WEIGHTS, U.V1_THRESHOLDS, "numerical_probability")
_V2_GRID = _grid(U.V2_WEIGHTS, U.V2_THRESHOLDS, "context_probability")


def _v1(spark, sf):
    return U.search_fusion(C.corpus(spark, sf, C.PREDICTIONS), U.V1_WEIGHTS, U.V1_THRESHOLDS, other="numerical_probability")


def _v2(spark, sf):
    return U.search_fusion(C.corpus(spark, sf, C.PREDICTIONS))


@query("fusion_grid_v1", f"{_V1_GRID} SELECT * FROM grid")
def fusion_grid_v1(spark, sf):
    return _v1(spark, sf)


@query("fusion_grid_v2", f"{_V2_GRID} SELECT * FROM grid")
def fusion_grid_v2(spark, sf):
    return _v2(spark, sf)


@query("rank_gate_configurations", f"""{_V1_GRID} SELECT * FROM grid WHERE recall >= 0.85 OR
  (SELECT max(recall) FROM grid) < 0.85""")
def rank_gate(spark, sf):
    return U.rank_gate_configurations(_v1(spark, sf))


@query("rank_configurations", f"{_V2_GRID} SELECT * FROM grid ORDER BY f1 DESC, recall DESC, precision DESC, accuracy DESC, text_weight, threshold")
def rank_configurations(spark, sf):
    return U.rank_configurations(_v2(spark, sf))


@query("high_recall_configurations", f"{_V2_GRID} SELECT * FROM grid WHERE recall >= 0.95 ORDER BY precision DESC, f1 DESC, false_positives, text_weight, threshold LIMIT 10")
def high_recall(spark, sf):
    return U.high_recall_configurations(_v2(spark, sf))


@query("locked_policy", f"{_V2_GRID} SELECT * FROM grid WHERE recall >= 0.98 ORDER BY precision DESC, f1 DESC, false_positives, text_weight, threshold LIMIT 1")
def locked_policy(spark, sf):
    return U.select_locked_configuration(_v2(spark, sf))


@query("locked_fusion_metrics", f"{_grid([0.70], [0.50], 'context_probability')} SELECT * FROM grid")
def locked_fusion(spark, sf):
    return U.evaluate_fusion(C.corpus(spark, sf, C.PREDICTIONS))


_FUSED = f"""SELECT *, CAST(fusion_probability >= 0.5 AS INT) AS fusion_prediction FROM (SELECT *,
  CAST('0.7' AS DOUBLE) * text_probability + CAST('0.30000000000000004' AS DOUBLE) * context_probability AS fusion_probability FROM ({C.PREDICTIONS}) v) w"""


@query("fusion_decisions", f"SELECT sample_id, fusion_probability, fusion_prediction FROM ({_FUSED}) f")
def fusion_decisions(spark, sf):
    decided = U.fusion_decisions(C.corpus(spark, sf, C.PREDICTIONS), 0.70, 0.50)
    return decided.select("sample_id", "fusion_probability", "fusion_prediction")


@query("fusion_errors", f"""SELECT sample_id, CASE WHEN label = 1 THEN 'FN' ELSE 'FP' END AS cell FROM ({_FUSED}) f WHERE label <> fusion_prediction""")
def fusion_errors(spark, sf):
    decided = U.fusion_decisions(C.corpus(spark, sf, C.PREDICTIONS), 0.70, 0.50)
    sides = [R.model_errors(decided, "fusion_prediction", k) for k in ("false_negative", "false_positive")]
    split = R.error_split(sides[0].unionByName(sides[1]), "fusion_prediction")
    return split.select("sample_id", "cell")


@query("error_split", f"""SELECT CASE WHEN label = text_prediction THEN 'T' ELSE 'F' END || CASE WHEN text_prediction = 1 THEN 'P' ELSE 'N' END AS cell,
  {_ALL} AS count FROM ({C.PREDICTIONS}) v GROUP BY 1""")
def error_cells(spark, sf):
    return R.error_split(C.corpus(spark, sf, C.PREDICTIONS), "text_prediction").groupBy("cell").count()


@query("model_disagreements", f"""SELECT sample_id, CASE WHEN label = 1 THEN 'text_fixed' ELSE 'numeric_fixed' END AS kind FROM ({C.PREDICTIONS}) v
  WHERE numerical_prediction = 0 AND text_prediction = 1""")
def model_disagreements(spark, sf):
    rows = C.corpus(spark, sf, C.PREDICTIONS)
    fixed = R.text_fixed_secrets(rows).select("sample_id", F.lit("text_fixed").alias("kind"))
    return fixed.unionByName(R.numeric_fixed_safe(rows).select("sample_id", F.lit("numeric_fixed").alias("kind")))


@query("error_type_distribution", f"""SELECT sample_type, {_ALL} AS count FROM ({C.PREDICTIONS}) v
  WHERE label = 0 AND context_prediction = 1 GROUP BY 1""")
def error_type_distribution(spark, sf):
    return R.value_counts(R.model_errors(C.corpus(spark, sf, C.PREDICTIONS), "context_prediction", "false_positive"))


@query("agreement_summary", f"""SELECT CAST(count(*) FILTER (a AND b) AS BIGINT) AS both_correct, CAST(count(*) FILTER (NOT a AND NOT b) AS BIGINT) AS both_wrong,
  CAST(count(*) FILTER (a AND NOT b) AS BIGINT) AS numerical_only_correct, CAST(count(*) FILTER (NOT a AND b) AS BIGINT) AS text_only_correct
  FROM (SELECT numerical_prediction = label AS a, text_prediction = label AS b FROM ({C.PREDICTIONS}) v) w""")
def agreement_summary(spark, sf):
    return R.agreement_summary(C.corpus(spark, sf, C.PREDICTIONS))


@query("outcome_summary", f"""SELECT CASE WHEN a AND b THEN 'both_correct' WHEN a THEN 'context_only_correct' WHEN b THEN 'text_only_correct'
  ELSE 'both_wrong' END AS outcome, {_ALL} AS count FROM (SELECT context_prediction = label AS a, text_prediction = label AS b FROM ({C.PREDICTIONS}) v) w GROUP BY 1""")
def outcome_summary(spark, sf):
    rows = C.corpus(spark, sf, C.PREDICTIONS)
    context = rows.drop("text_prediction", "text_probability")
    return R.value_counts(R.complementarity(context, rows), "outcome")


@query("worst_errors", f"""SELECT sample_id, text_probability FROM ({C.PREDICTIONS}) v WHERE label = 0 AND text_prediction = 1
  ORDER BY text_probability DESC, sample_id LIMIT 20""")
def worst_errors(spark, sf):
    return R.worst_errors(C.corpus(spark, sf, C.PREDICTIONS), "text_prediction", "text_probability", "false_positive", 20).select(
        "sample_id", "text_probability")


@query("stratified_split", f"""SELECT label, CAST(ceil(count(*) * 0.2) AS BIGINT) AS test_samples,
  CAST(count(*) - ceil(count(*) * 0.2) AS BIGINT) AS train_samples FROM ({C.CANDIDATES}) c GROUP BY 1""")
def split_sizes(spark, sf):
    rows = stratified_split(C.corpus(spark, sf, C.CANDIDATES))
    return rows.groupBy("label").agg(F.count_if("is_test").alias("test_samples"), F.count_if(~F.col("is_test")).alias("train_samples"))


_TEST_IDS = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(sample_id || '|42'), sample_id) AS k,
  count(*) OVER (PARTITION BY label) AS n FROM ({C.CANDIDATES}) c) d WHERE k <= ceil(n * 0.2)"""


@query("stratified_test_ids", f"SELECT sample_id, label FROM ({_TEST_IDS}) t")
def split_ids(spark, sf):
    return stratified_split(C.corpus(spark, sf, C.CANDIDATES)).where("is_test").select("sample_id", "label")


# --- model inputs and split evaluation -------------------------------------------------

def _scaled(c: str) -> str:
    return f"round(CASE WHEN stddev_pop({c}) OVER () = 0 THEN 0.0 ELSE ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END, 6) + 0.0 AS {c}"


@query("scaled_features", f"SELECT sample_id, {', '.join(map(_scaled, NUMERIC_FEATURES))} FROM ({_FEATURED}) f")
def scaled_features(spark, sf):
    rows = M.scaled_features(_candidates(spark, sf))
    return rows.select("sample_id", *((F.round(F.col("scaled")[i], 6) + F.lit(0.0)).alias(c) for i, c in enumerate(NUMERIC_FEATURES)))


_GRAMS = " UNION ALL ".join(f"SELECT sample_id, unnest(list_transform(range(1, length(t) - {n - 2}), lambda i: substr(t, i, {n}))) AS g FROM texts" for n in M.NGRAM_SIZES)


@query("text_term_weights", rf"""WITH texts AS (SELECT sample_id, regexp_replace(lower(variable_name || ' = ' || value), '\s\s+', ' ', 'g') AS t FROM ({C.CANDIDATES}) c),
  tf AS (SELECT sample_id, g, count(*) AS n FROM ({_GRAMS}) u GROUP BY 1, 2),
  df AS (SELECT g, count(*) AS d FROM tf GROUP BY 1 HAVING count(*) >= {M.MIN_DOCUMENTS}),
  raw AS (SELECT sample_id, (1 + ln(n)) * (ln((1.0 + (SELECT count(*) FROM texts)) / (1 + d)) + 1) AS w FROM tf JOIN df USING (g)),
  unit AS (SELECT sample_id, w / sqrt(sum(w * w) OVER (PARTITION BY sample_id)) AS w FROM raw)
  SELECT sample_id, {_ALL} AS terms, round(sum(w), 6) AS weight_sum, round(max(w), 6) AS weight_max FROM unit GROUP BY 1""")
def text_term_weights(spark, sf):
    rows = M.text_weights(C.corpus(spark, sf, C.CANDIDATES)).where(F.size("weights") > 0)
    weight = F.transform("weights", lambda x: x["weight"])
    total = F.aggregate(weight, F.lit(0.0), lambda a, w: a + w)
    return rows.select("sample_id", F.size("weights").cast("bigint").alias("terms"), F.round(total, 6).alias("weight_sum"),
        F.round(F.array_max(weight), 6).alias("weight_max"))


# A given model: fixed numbers for every feature, so that SQL can score what the engine scores.
def _given(features, derived: bool) -> M.TabularModel:
    n = len(features)
    return M.TabularModel(
        tuple(features), tuple(i % 4 * 0.5 for i in range(n)), tuple((2.0, 0.5, 4.0)[i % 3] for i in range(n)),
        tuple((0.75, -0.5, 0.25, 1.5, -1.25)[i % 5] for i in range(n)), -0.375, derived,
    )


def _margin(model: M.TabularModel) -> str:
    terms = zip(model.features, model.means, model.deviations, model.coefficients, strict=True)
    return " + ".join([f"CAST({model.intercept} AS DOUBLE)", *(f"CAST({w} AS DOUBLE) * ((CAST({f} AS DOUBLE) - {m}) / {d})" for f, m, d, w in terms)])


_GIVEN_NUMERIC, _GIVEN_CONTEXT = _given(NUMERIC_FEATURES, False), _given(CONTEXT_FEATURES, True)


def _sigmoid(model: M.TabularModel) -> str:
    return f"1.0 / (1.0 + exp(-({_margin(model)})))"


@query("scored_numeric", f"""SELECT sample_id, label, round(p, 9) AS probability, CAST(p > 0.5 AS INT) AS prediction FROM
  (SELECT sample_id, label, {_sigmoid(_GIVEN_NUMERIC)} AS p FROM ({_FEATURED}) f) s""")
def scored_numeric(spark, sf):
    rows = _GIVEN_NUMERIC.predict(_candidates(spark, sf), "numeric")
    return rows.select("sample_id", "label", F.round("numeric_probability", 9).alias("probability"), F.col("numeric_prediction").alias("prediction"))


@query("scored_context", f"""SELECT sample_id, label, round(p, 9) AS probability, CAST(p > 0.5 AS INT) AS prediction FROM
  (SELECT sample_id, label, {_sigmoid(_GIVEN_CONTEXT)} AS p FROM ({_FEATURED}) f) s""")
def scored_context(spark, sf):
    rows = _GIVEN_CONTEXT.predict(C.corpus(spark, sf, C.CANDIDATES), "context")
    return rows.select("sample_id", "label", F.round("context_probability", 9).alias("probability"), F.col("context_prediction").alias("prediction"))


@query("split_evaluation", f"""SELECT sample_id, label, CASE WHEN label = 1 THEN CASE WHEN p > 0.5 THEN 'TP' ELSE 'FN' END
    ELSE CASE WHEN p > 0.5 THEN 'FP' ELSE 'TN' END END AS cell FROM
  (SELECT f.sample_id, f.label, {_sigmoid(_GIVEN_NUMERIC)} AS p FROM ({_FEATURED}) f JOIN ({_TEST_IDS}) t ON f.sample_id = t.sample_id) s""")
def split_evaluation(spark, sf):
    return M.split_evaluation(_candidates(spark, sf), lambda training: _GIVEN_NUMERIC, "numerical").select("sample_id", "label", "cell")


# --- synthesis: one pair of samples per order ------------------------------------------

_DUCKDB = Dialect("CAST('0x' || {0} AS BIGINT)", "array_to_string(list_transform(range(1, {0} + 1), lambda i: {1}), '')")


def _digits(text: str, number: str) -> str:
    """A row as a number that sums exactly: 12 hex digits of its MD5."""
    return number.format(f"substr(md5({text}), 1, 12)")


_ROW = "sample_id || '|' || variable_name || '|' || value || '|' || label || '|' || sample_type"


def _total(number):
    """The sum of whole numbers of up to 15 digits, by which no table overflows."""
    return F.sum(number.cast("decimal(15,0)")).cast("decimal(38,0)")


def _made(spec) -> str:
    """The rows of a specification by DuckDB, added up per sample type with their features."""
    fields = ("variable_name", "value", "sample_type")
    sides = " UNION ALL ".join(
        f"SELECT printf('{spec.prefix}-%06d', index * 2 + {2 - label}) AS sample_id, {label} AS label, "
        + ", ".join(f"{sample_sql(spec, label, f, dialect=_DUCKDB)} AS {f}" for f in fields) + " FROM t"
        for label in (1, 0))
    return f"""WITH t AS (SELECT CAST(o_orderkey AS BIGINT) AS index FROM orders), made AS ({sides}), featured AS (SELECT *, {_NUMERIC} FROM made)
      SELECT label, sample_type, {_ALL} AS count, CAST(sum({_digits(_ROW, _DUCKDB.number)}) AS DECIMAL(38, 0)) AS digest,
        CAST(sum(has_sensitive_name) AS BIGINT) AS sensitive_names, CAST(sum(length(value)) AS BIGINT) AS characters,
        CAST(count(DISTINCT variable_name || '=' || value) AS BIGINT) AS pairs FROM featured GROUP BY 1, 2"""


def _synth(spark, sf, spec):
    # Order keys are dense from zero in the given table.
    keys = C.corpus(spark, sf, "SELECT CAST(o_orderkey AS BIGINT) AS index FROM orders")
    return synth_candidates(keys, spec)


def _register_synthesis(name: str, spec) -> None:
    @query(f"synth_{name}", _made(spec))
    def synthesis(spark, sf):
        return _synth(spark, sf, spec).groupBy("label", "sample_type").agg(
            F.count("*").alias("count"),
            _total(F.expr(_digits(_ROW, SPARK.number))).alias("digest"),
            F.sum("has_sensitive_name").cast("bigint").alias("sensitive_names"),
            F.sum(F.length("value")).cast("bigint").alias("characters"),
            F.count_distinct(F.concat_ws("=", "variable_name", "value")).alias("pairs"),
        )


for _name, _spec in SPECS.items():
    _register_synthesis(_name, _spec)


# --- trained models: rows only, no SQL can train them ----------------------------------

def _labelled(spark, sf):
    return _candidates(spark, sf).where("source = 'orders_0'"), _candidates(spark, sf).where("source = 'orders_1'")


def _register_model(name: str, fit) -> None:
    @query(f"model_{name}")
    def model(spark, sf):
        training, other = _labelled(spark, sf)
        return M.evaluate(fit(training), other, name, name)


for _name, _fit in (("numeric", M.fit_numeric), ("context", M.fit_context), ("text", M.fit_text), ("hybrid", M.fit_hybrid)):
    _register_model(_name, _fit)


@query("model_coefficients")
def model_coefficients(spark, sf):
    model = M.fit_context(_labelled(spark, sf)[0])
    return R.ranked_coefficients(spark, model.features, model.coefficients)


@query("model_predictions")
def model_predictions(spark, sf):
    training, other = _labelled(spark, sf)
    return M.baseline_predictions(training, other).select(
        "sample_id", "label", "numerical_prediction", "numerical_probability", "text_prediction", "text_probability")


@query("advisory_findings")
def advisory_findings(spark, sf):
    advisory = fit_advisory(_labelled(spark, sf)[0])
    public = scan_projects(C.files(spark, sf), advisory=advisory).public()
    return public.select("project_id", "file", "line", "type", "ml_advisory.risk_score", "ml_advisory.prediction")


@query("locked_holdout_report")
def locked_holdout_report(spark, sf):
    training, other = _labelled(spark, sf)
    return holdout_report(training, other).drop("locked_configuration", "evaluation_policy")
