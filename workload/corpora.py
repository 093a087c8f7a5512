"""Derived corpora: SQL over the given tables that Spark and DuckDB both run.

The tables hold hardly any source code, so projects, candidates and predictions are
derived from their keys; every corpus grows with its table. All secrets are fake.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# One file per order; the project is the customer. Some paths start with a dot segment, and some
# projects hold nothing that is scanned.
FILES = """
SELECT CASE WHEN kind = 7 AND k % 5 = 0 THEN 'r' || k ELSE 'p' || c END AS project_id,
  CASE kind
    WHEN 0 THEN 'src/mod' || k || '.py' WHEN 1 THEN 'web/page' || k || '.ts'
    WHEN 2 THEN 'config/set' || k || '.yaml' WHEN 3 THEN 'svc' || k || '/.env'
    WHEN 4 THEN CASE WHEN k % 36 = 4 THEN './dist/app' ELSE 'dist/app' END || k || '.js' WHEN 5 THEN 'build/map' || k || '.js.map'
    WHEN 6 THEN 'node_modules/lib' || k || '/index.js' WHEN 7 THEN 'docs/read' || k || '.md'
    WHEN 8 THEN 'api/data' || k || '.json' WHEN 9 THEN '.next/static/chunk' || k || '.js'
    WHEN 10 THEN 'ui/View' || k || '.JSX' ELSE 'svc' || k || '/.env.production' END AS path,
  CASE WHEN k % 241 = 0 THEN 2097153 ELSE length(body) END AS length,
  k % 211 = 0 AS is_symlink,
  k % 223 <> 0 AS readable,
  CASE WHEN k % 241 = 0 THEN NULL WHEN k % 251 = 0 THEN body || chr(0) || 'tail' ELSE body END AS text
FROM (
  SELECT k, c, kind, CASE
    WHEN kind IN (0, 1, 10) THEN
      '# module ' || k || nl
      || CASE k % 5 WHEN 0 THEN 'password = "' || substr(h, 1, 12) || '"'
           WHEN 1 THEN 'self.db_password: str = "' || substr(h, 3, 10) || '"  # note'
           WHEN 2 THEN 'password = os.getenv("PASSWORD")'
           WHEN 3 THEN 'const admin_pwd = ' || chr(39) || substr(h, 1, 5) || chr(39) || ';'
           ELSE 'if password == "' || substr(h, 1, 9) || '":' END || nl
      || CASE k % 4 WHEN 0 THEN 'const api_key = "' || h || '";'
           WHEN 1 THEN 'export let user.access_token = r"' || substr(h, 2, 20) || '"'
           WHEN 2 THEN 'client_secret = load_secret()'
           ELSE 'apiKey: "' || substr(h, 5, 16) || '",' END || nl
      || CASE k % 6 WHEN 0 THEN 'AUTH = "Bearer ' || h || '"'
           WHEN 1 THEN 'msg = "Bearer ' || h || ' bearer ' || h || ' Bearer ' || substr(h, 1, 14) || '"'
           WHEN 2 THEN 'DB = "postgresql://user:' || substr(h, 1, 10) || '@host:5432/db"'
           WHEN 3 THEN 'pwd = "mysql://root:' || substr(h, 4, 9) || '@db/app"'
           WHEN 4 THEN 'NOTE = "Use a bearer token from your store"'
           ELSE 'url = "sqlite:///app.db"' END || nl
      || CASE k % 7 WHEN 0 THEN 'value = "' || upper(substr(h, 1, 9)) || substr(h, 10, 9) || '"'
           WHEN 1 THEN 'session_credential = "' || substr(h, 1, 16) || '"'
           WHEN 2 THEN 'title = "Welcome to the application"'
           WHEN 3 THEN 'secret_note = "short"'
           WHEN 4 THEN '"asset_id": ' || chr(39) || 'asset-' || k || '-' || upper(substr(h, 1, 12)) || chr(39) || '  // id'
           WHEN 5 THEN 'x = "a' || chr(92) || '"' || h || '"'
           ELSE 'total = total + 1;' END || nl
    WHEN kind IN (2, 8) THEN
      CASE k % 4 WHEN 0 THEN 'db_password: ' || substr(h, 1, 11)
           WHEN 1 THEN '"password": "' || substr(h, 1, 11) || '",'
           WHEN 2 THEN 'app-user_pwd = "' || substr(h, 1, 6) || '"'
           ELSE 'PASSWD=' || substr(h, 1, 4) END || nl
      || CASE k % 3 WHEN 0 THEN 'service-api-key: ' || substr(h, 1, 18)
           WHEN 1 THEN 'SERVICE_API_KEY=' || substr(h, 1, 18)
           ELSE '{auth-token: "' || h || '", secret_key: ' || substr(h, 7, 9) || '}' END || nl
      || CASE k % 2 WHEN 0 THEN 'token: "' || h || '"' ELSE 'name: "demo"' END
    WHEN kind IN (3, 11) THEN
      '# environment' || nl || 'SERVER_SECRET=' || s || nl
      || CASE k % 3 WHEN 0 THEN 'VITE_API_KEY=' || substr(h, 1, 20)
           WHEN 1 THEN 'NEXT_PUBLIC_SITE=demo' ELSE 'vite_blob="' || upper(h) || substr(h, 1, 3) || '"' END || nl
      || CASE k % 2 WHEN 0 THEN 'API_TOKEN = "' || h || '" ' ELSE 'export MODE=test' END || nl
      || 'DB_PASSWORD=' || chr(39) || substr(h, 1, 7) || chr(39) || nl || 'LOCAL_ID=' || upper(substr(h, 1, 10)) || substr(h, 11, 10)
    WHEN kind IN (4, 5, 9) THEN
      'var a = 1;' || chr(10)
      || CASE k % 3 WHEN 0 THEN 'window.K="' || s || '";' || s WHEN 1 THEN 'window.K="public";'
           ELSE 'window.K="' || substr(s, 1, 20) || '";' END || chr(10)
      || 'var b="' || md5('s' || (c + 1)) || '";'
    ELSE 'password = "' || h || '"' || nl END AS body
  FROM (
    SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 12 AS kind,
      md5('f' || o_orderkey) AS h, md5('s' || o_custkey) AS s,
      CASE WHEN o_orderkey % 9 = 0 THEN chr(13) || chr(10) ELSE chr(10) END AS nl
    FROM orders) keyed) built
"""

# Ignore rules of every third customer project, as the text of its rule file.
RULE_FILES = """
SELECT 'p' || c_custkey AS project_id,
  CASE c_custkey % 5 WHEN 0 THEN 'src/' || chr(10) || '# note' || chr(10) || '*.yaml'
    WHEN 1 THEN './web' || chr(92) || '*' || chr(10) || '' || chr(10) || 'dist/'
    WHEN 2 THEN '  /svc*/.env  ' || chr(13) || chr(10) || 'app?[0-4]*.js'
    WHEN 3 THEN 'mod[!1-8]*.py' || chr(10) || '.next/static/*[a-c.]js'
    ELSE 'api' || chr(10) || 'api/data*' END AS text
FROM customer WHERE c_custkey % 3 = 0
"""

# Index entries: the order files before and after a commit.
NEW_INDEX = f"""
SELECT project_id, path, CASE WHEN length % 17 = 0 THEN '120000' ELSE '100644' END AS mode,
  0 AS stage, length, text FROM ({FILES}) f
"""
OLD_INDEX = f"""
SELECT project_id, path, CASE WHEN length % 19 = 0 THEN '100755' WHEN length % 17 = 0 THEN '120000'
    ELSE '100644' END AS mode, 0 AS stage, length,
  CASE WHEN length % 3 = 0 THEN text || 'x' ELSE text END AS text
FROM ({FILES}) f WHERE length % 4 <> 0
"""

# One gate case per customer: eight exposed, eight safe and two coverage families.
CASES = """
SELECT 'g' || c_custkey AS project_id, CASE c_custkey % 18
    WHEN 0 THEN 'hardcoded_password' WHEN 1 THEN 'api_key' WHEN 2 THEN 'bearer_token'
    WHEN 3 THEN 'database_credential' WHEN 4 THEN 'client_side_exposure'
    WHEN 5 THEN 'generic_secret_candidate' WHEN 6 THEN 'artifact_propagation'
    WHEN 7 THEN 'staged_secret' WHEN 8 THEN 'safe_password_expression'
    WHEN 9 THEN 'safe_api_expression' WHEN 10 THEN 'safe_bearer_text'
    WHEN 11 THEN 'safe_database_url' WHEN 12 THEN 'safe_client_public'
    WHEN 13 THEN 'safe_high_entropy_identifier' WHEN 14 THEN 'safe_artifact_nonpropagation'
    WHEN 15 THEN 'safe_staged_change' WHEN 16 THEN 'coverage_oversized_file'
    ELSE 'coverage_binary_content' END AS family,
  CASE WHEN c_custkey % 18 >= 16 THEN 'coverage' WHEN c_custkey % 18 IN (7, 15) THEN 'staged'
    ELSE 'project' END AS track,
  CASE WHEN c_custkey % 18 BETWEEN 8 AND 15 THEN 'passed' ELSE 'failed' END AS expected_gate,
  CASE c_custkey % 18
    WHEN 0 THEN 'Hardcoded Password' WHEN 1 THEN 'API Key' WHEN 2 THEN 'Bearer Token'
    WHEN 3 THEN 'Database Credential' WHEN 4 THEN 'Client-Side Secret Exposure'
    WHEN 5 THEN 'Unknown Secret Candidate' WHEN 6 THEN 'Artifact Secret Exposure'
    WHEN 16 THEN 'Scan Coverage Limitation' WHEN 17 THEN 'Scan Coverage Limitation'
    END AS expected_type
FROM customer
"""
CASE_FILES = """
SELECT 'g' || k AS project_id, path, CASE WHEN f = 16 THEN 2097153 + k ELSE length(text) END AS length,
  false AS is_symlink, true AS readable, CASE WHEN f = 16 THEN NULL ELSE text END AS text
FROM (
  SELECT k, f, CASE f
      WHEN 0 THEN CASE k % 3 WHEN 0 THEN 'jobs/mailer.py' WHEN 1 THEN 'web/login.jsx' ELSE 'ops/cache.yaml' END
      WHEN 1 THEN CASE k % 3 WHEN 0 THEN 'lib/maps.tsx' WHEN 1 THEN 'deploy/keys.yml' ELSE 'lib/rates.py' END
      WHEN 2 THEN 'net/probe.py' WHEN 3 THEN 'store/pool.ts' WHEN 4 THEN '.env.local'
      WHEN 5 THEN 'jobs/sync.py' WHEN 6 THEN '.env.production' WHEN 7 THEN 'api/hook.ts'
      WHEN 8 THEN 'admin/setup.py' WHEN 9 THEN 'lib/rates.ts' WHEN 10 THEN 'help/text.py'
      WHEN 11 THEN 'store/local.py' WHEN 12 THEN '.env.development' WHEN 13 THEN 'media/sprites.py'
      WHEN 14 THEN '.env' WHEN 15 THEN 'pages/about.py' WHEN 16 THEN 'data/huge.py'
      ELSE 'data/blob.html' END AS path,
    CASE f
      WHEN 0 THEN CASE k % 3 WHEN 0 THEN '# nightly mail' || n || 'smtp_pwd = "' || v || '"' || n || 'retries = 3'
        WHEN 1 THEN 'let portal_passwd = "' || v || '";' || n || 'export default portal;' ELSE 'host: cache-1' || n || 'redis_password: ' || v END
      WHEN 1 THEN CASE k % 3 WHEN 0 THEN 'const zoom = 4;' || n || 'const access_token = "' || v || '";'
        WHEN 1 THEN 'stage: blue' || n || 'client-secret: ' || v ELSE 'auth_token = "' || v || '"' || n || 'pages = 2' END
      WHEN 2 THEN 'import http' || n || 'HEADERS = "Bearer ' || v || '"'
      WHEN 3 THEN 'const size = 5;' || n || 'const dsn = "mysql://reader:' || v || '@db-7:3306/shop";'
      WHEN 4 THEN 'MODE=dark' || n || CASE k % 3 WHEN 0 THEN 'VITE_SIGNING_SECRET=' ELSE 'NEXT_PUBLIC_ADMIN_TOKEN=' END || v
      WHEN 5 THEN 'limit = 20' || n || CASE k % 3 WHEN 0 THEN 'partner_credential' ELSE 'handoff_secret' END || ' = "' || v || '"'
      WHEN 6 THEN 'PORT=8080' || n || 'BILLING_SECRET=' || v
      WHEN 7 THEN '// hooks' || n || 'const hook_pwd = "' || v || '";'
      WHEN 8 THEN 'password = read_prompt(3)' || n || 'label = "setup"' WHEN 9 THEN 'const apiKey = vault.lookup(4);' || n || 'let n = 1;'
      WHEN 10 THEN 'HELP = "Send the bearer token that your admin issued"' || n || 'rows = 2'
      WHEN 11 THEN 'DSN = "duckdb:///tmp/shop.db"' || n || 'pool = 1'
      WHEN 12 THEN 'PORT=80' || n || CASE k % 3 WHEN 0 THEN 'VITE_PAGE_TITLE' ELSE 'NEXT_PUBLIC_THEME' END || '=Harbour'
      WHEN 13 THEN 'frames = 8' || n || 'sprite_name = "SP-' || k || '-t7Q2mX9bL4wZ8c"'
      WHEN 14 THEN 'PORT=8081' || n || 'BILLING_SECRET=' || v WHEN 15 THEN 'TITLE = "About the harbour office"' || n || 'order = 1'
      WHEN 16 THEN 'A' ELSE '<p>' || chr(0) || '</p>' END || n AS text
  FROM (SELECT c_custkey AS k, c_custkey % 18 AS f, 'Zq' || substr(md5('case' || c_custkey), 1, 15) || '7Rk' AS v, chr(10) AS n FROM customer) a
  UNION ALL
  SELECT k, f, CASE k % 3 WHEN 0 THEN 'build/js/main.js' WHEN 1 THEN '.next/static/main.js' ELSE 'dist/js/main.js' END AS path,
    '/* bundle */' || chr(10) || '(()=>{let q="' || CASE WHEN f = 6 THEN v ELSE 'nothing to hide' END || '";})();' || chr(10) AS text
  FROM (SELECT c_custkey AS k, c_custkey % 18 AS f, 'Zq' || substr(md5('case' || c_custkey), 1, 15) || '7Rk' AS v FROM customer) b
  WHERE f IN (6, 14)
) cased
"""

# Labelled candidates, one per order.
CANDIDATES = """
SELECT 'S' || o_orderkey AS sample_id,
  CASE o_orderkey % 11 WHEN 0 THEN 'api_key' WHEN 1 THEN 'request_id' WHEN 2 THEN 'commit-sha'
    WHEN 3 THEN 'VITE_API_KEY' WHEN 4 THEN 'next_public_title' WHEN 5 THEN 'value'
    WHEN 6 THEN 'session.credential' WHEN 7 THEN 'password_hash' WHEN 8 THEN 'release_notes'
    WHEN 9 THEN 'MODULE_CHECKSUM' ELSE 'DbPassword' END AS variable_name,
  CASE o_orderkey % 13 WHEN 0 THEN h WHEN 1 THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)
    WHEN 2 THEN h || substr(h, 1, 8) WHEN 3 THEN h || upper(h) WHEN 4 THEN '${KEY_' || upper(substr(h, 1, 4)) || '}'
    WHEN 5 THEN 'replace-me-' || substr(h, 1, 5) WHEN 6 THEN substr(h, 1, 12) || '.' || h || '.' || upper(substr(h, 3, 9))
    WHEN 7 THEN 'amber bridge-canyon.' || CASE WHEN o_orderkey % 2 = 0 THEN 'harbor' ELSE 'x1' END
    WHEN 8 THEN '%TOKEN_' || substr(h, 1, 3) || '%' WHEN 9 THEN ' ' || upper(substr(h, 1, 15)) || '!@ '
    WHEN 10 THEN '' WHEN 11 THEN 'Please enter your password' ELSE upper(substr(h, 1, 10)) || substr(h, 11, 10) || '_-' END AS value,
  CASE WHEN o_custkey % 3 = 0 THEN 1 - CAST(o_orderkey % 2 AS INT) ELSE CAST(o_orderkey % 2 AS INT) END AS label,
  'type_' || (o_orderkey % 7) AS sample_type,
  CASE WHEN o_orderkey % 11 = 3 THEN 'Vite' ELSE 'none' END AS framework,
  'orders_' || (o_custkey % 2) AS source
FROM (SELECT o_orderkey, o_custkey, md5('c' || (o_orderkey - o_orderkey % 17)) AS h FROM orders) hashed
"""

# Predictions with probabilities that are exact in both engines.
PREDICTIONS = """
SELECT sample_id, label, sample_type, numerical_probability, text_probability, context_probability,
  CASE WHEN numerical_probability >= 0.5 THEN 1 ELSE 0 END AS numerical_prediction,
  CASE WHEN text_probability >= 0.5 THEN 1 ELSE 0 END AS text_prediction,
  CASE WHEN context_probability >= 0.5 THEN 1 ELSE 0 END AS context_prediction
FROM (
  SELECT 'S' || o_orderkey AS sample_id, CAST(o_custkey % 2 AS INT) AS label,
    'type_' || (o_orderkey % 7) AS sample_type,
    CAST(((o_orderkey * 7919) % 701 + (o_custkey % 2) * 170) AS DOUBLE) / 1024 AS numerical_probability,
    CAST(((o_orderkey * 104729) % 719 + (o_custkey % 2) * 345) AS DOUBLE) / 1024 AS text_probability,
    CAST(((o_orderkey * 1299709) % 757 + (o_custkey % 2) * 239) AS DOUBLE) / 1024 AS context_probability
  FROM orders) scored
"""

#: Keys that a task makes a corpus of at most; what a fit keeps of them fits in memory.
KEYS_PER_TASK = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as it is stored: a task per split, and a row group lies in one split."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derived corpus as a DataFrame.

    A corpus is far wider than the keys it is made of, and a table of one row group would leave
    it to one task, so the keys are dealt to as many tasks as the session runs at once, or to
    several times as many where a task would hold over ``KEYS_PER_TASK`` of them. A filter on
    what is made of the keys would be pushed below the exchange, into the few tasks that read
    the table, and build the corpus there; it doesn't pass a generator.
    """
    for name in ("documents", "pages", "conversations"):
        if f"FROM {name}" in sql:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    for name in ("orders", "customer"):
        if f"FROM {name}" in sql:
            keys = table(spark, sf_dir, name)
            cores = max(spark.sparkContext.defaultParallelism, 2)
            turns = max(-(-keys.count() // (cores * KEYS_PER_TASK)), 1)
            dealt = keys.select(*(c for c in keys.columns if c in sql)).repartition(cores * turns)
            row = F.explode(F.array(F.struct(*dealt.columns))).alias("row")
            dealt.select(row).select("row.*").createOrReplaceTempView(name)
    return spark.sql(sql)


def files(spark: SparkSession, sf_dir: str, sql: str = FILES) -> DataFrame:
    """A file corpus in the shape the scanner reads: content as bytes."""
    return corpus(spark, sf_dir, sql).withColumn("content", F.col("text").cast("binary")).drop("text")
