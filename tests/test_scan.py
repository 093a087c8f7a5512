"""Project, change-set and text scans: detector semantics, limits, propagation."""

import os
import random
import uuid

import pytest
from conftest import FILES, file_row
from pyspark.sql import functions as F

from quietkey.operators import joins, propagation
from quietkey.operators.changes import change_set, write_index
from quietkey.operators.findings import checked_advisory
from quietkey.operators.ignore import rules_from_files
from quietkey.operators.propagation import propagation_findings, secret_inventory
from quietkey.plans.scan import scan_change_set, scan_projects, scan_text
from quietkey.sources import projects
from quietkey.sources.projects import files_table, list_projects, read_files, write_files, write_manifest
from quietkey.streaming.scan import stream_findings

VALUE = "Zx81QpLm77RtYw"
RANDOM = "K7mP2xQ9vL4sN8zA1c"


def kinds(rows):
    return [r.type for r in rows]


CASES = [
    ("config.py", f'DB_PASSWORD = "{VALUE}"', ["Hardcoded Password"]),
    ("config.py", 'WELCOME = "Please enter your password"', []),
    ("mystery.py", f'x = "{RANDOM}"', ["Unknown Secret Candidate"]),
    ("mystery.py", f'﻿x = "{RANDOM}"', ["Unknown Secret Candidate"]),
    (".env", f"VITE_API_KEY={VALUE}", ["Client-Side Secret Exposure"]),
    (".env", "VITE_TITLE=Shop", []),
    ("a.py", "password = generate_password()\napi_key = load_key()", []),
    ("a.ts", f'self.password = "{VALUE}"', ["Hardcoded Password"]),
    (".env", f"DB_PASSWORD={VALUE}", ["Hardcoded Password"]),
    ("app.py", f'm = "Bearer {VALUE} Bearer {VALUE}"', ["Bearer Token"]),
    ("app.py", f'm = "Bearer {VALUE} bearer {VALUE}2"', ["Bearer Token", "Bearer Token"]),
    ("c.py", f'password = "postgresql://u:{VALUE}@h/db"', ["Hardcoded Password", "Database Credential"]),
    ("c.json", f'{{"password": "{VALUE}"}}', []),
    ("c.yaml", f"a-b_password: {VALUE}\nxpassword: {VALUE}", ["Hardcoded Password"]),
    ("c.yaml", f"SERVICE_API_KEY={VALUE}\nservice-api-key: {VALUE}", ["API Key"]),
    ("c.yaml", f"PAſſWORD={VALUE}", ["Hardcoded Password"]),
    ("c.yaml", f"äpassword={VALUE}", []),
    ("notes.md", f'password = "{VALUE}"', []),
    ("node_modules/a.py", f'password = "{VALUE}"', []),
    ("a.PY", f'my__password = "{VALUE}"', ["Unknown Secret Candidate"]),
]


def test_detectors(spark):
    """Every case is a project of its own, so one scan covers them all."""
    rows = [file_row(p, c, project=str(i)) for i, (p, c, _) in enumerate(CASES)]
    found = scan_projects(spark.createDataFrame(rows, FILES)).public(ordered=True).collect()
    for i, case in enumerate(CASES):
        assert [r.type for r in found if r.project_id == str(i)] == case[2], case
    assert VALUE not in str(found) and RANDOM not in str(found)


def test_limitations(scan):
    rows = scan(
        file_row("big.py", None, length=2 * 1024 * 1024 + 1),
        file_row("bin.py", b"print('x')\x00y"),
        file_row("gone.py", None, length=3, readable=False),
        file_row("link.py", None, length=3, link=True),
        file_row(".env", b"A=\x00"),
        file_row("dist/.env", b"A=\x00"),
        file_row("dist/a.js", b"\x00"),
        file_row("unseen.py", None, readable=False),
    )
    assert set(kinds(rows)) == {"Scan Coverage Limitation"}
    # An unsafe dotenv source is reported by the scan and by the inventory.
    assert [r.file for r in rows] == [
        ".env", "big.py", "bin.py", "gone.py", "link.py", "unseen.py", ".env", "dist/.env", "dist/a.js",
    ]
    assert all((r.line, r.masked_value, len(r.reasons)) == (1, "-", 1) for r in rows)


def test_propagation_once_per_artifact(scan):
    rows = scan(
        (".env", f"API_KEY={VALUE}\nAPP_TITLE=Storefront"),
        ("b/.env", f"OTHER_TOKEN={VALUE}"),
        ("dist/a.js", f"x\r\ny\n{VALUE}{VALUE}"),
        ("dist/b.js", "Storefront"),
        ("dist/node_modules/c.js", VALUE),
        ("build/d.png", VALUE),
    )
    found = [r for r in rows if r.type == "Artifact Secret Exposure"]
    assert [(r.file, r.line, r.framework) for r in found] == [
        ("dist/a.js", 3, "Artifact"), ("dist/node_modules/c.js", 1, "Artifact"),
    ]
    assert found[0].reasons[1:] == ["Source variable: API_KEY", "Source file: .env"]


def test_ignore_rules(scan):
    files = [(p, f'password = "{VALUE}"') for p in ("src/a.py", "src/sub/b.py", "c.py", "web/src/d.py")]
    assert [r.file for r in scan(*files, rules=["src/"])] == ["c.py", "web/src/d.py"]
    assert [r.file for r in scan(*files, rules=["/c.py", "./web\\*"])] == ["src/a.py", "src/sub/b.py"]
    assert [r.file for r in scan(*files, rules=["[!c]*.py"])] == ["c.py"]


def test_large_rule_tables_use_the_salted_join(spark, monkeypatch):
    monkeypatch.setattr(joins.is_small, "__defaults__", (0,))
    rows = [file_row("src/a.py", f'password = "{VALUE}"'), file_row("b.py", f'password = "{VALUE}"')]
    rules = spark.createDataFrame([("p", ["src/"])], "project_id string, patterns array<string>")
    assert [r.file for r in scan_projects(spark.createDataFrame(rows, FILES), rules).public().collect()] == ["b.py"]


def test_gate_summary(spark):
    rows = [file_row("a.py", f'password = "{VALUE}"'), file_row("b.py", "x = 1"), file_row("c.py", "y = 1", project="q")]
    result = {r.project_id: r for r in scan_projects(spark.createDataFrame(rows, FILES)).summary().collect()}
    assert (result["p"].gate, result["p"].files_scanned, result["p"].high_count) == ("failed", 2, 1)
    assert (result["q"].gate, result["q"].findings_count, result["q"].ml_advisory_enabled) == ("passed", 0, False)


def _brute(inventory, artifacts):
    return {
        (p, path, v, text[: text.find(v)].count("\n") + 1)
        for p, v in inventory for q, path, text in artifacts if p == q and v in text
    }


def test_propagation_matches_brute_force_on_a_hot_project(spark):
    """Most rows in one project, long shared prefixes, long lines, surrogate pairs."""
    rng = random.Random(11)
    shared = "https://api.internal.example.test/v1/login?key="
    project = lambda: "hot" if rng.random() < 0.7 else f"p{rng.randrange(5)}"
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    inventory = [(project(), rng.choice([shared, "", "\U0001f600é"]) + hexed(rng.choice([8, 9, 24]))) for _ in range(150)]
    inventory += [("hot", "aaaaaaaa"), ("hot", "aaaaaaaaa"), ("hot", shared + "\U0001f600")]
    artifacts = []
    for i in range(60):
        p = project()
        own = [v for q, v in inventory if q == p or rng.random() < 0.1]
        body = "".join(rng.choice([shared, "\n", "\U0001f600", "x" * 50, rng.choice(own or ["z"]), hexed(5)]) for _ in range(40))
        artifacts.append((p, f"dist/{i}.js", body + ("q" * 70_000 + rng.choice(own or ["z"]) if i % 10 == 0 else "")))
    artifacts.append(("hot", "dist/edge.js", "y" * 65_532 + inventory[0][1] + "a" * 8))
    table = spark.createDataFrame(
        [(p, v, ".env", i, "N", 40, []) for i, (p, v) in enumerate(sorted(set(inventory)))],
        "project_id string, raw_value string, source_path string, source_line int, variable_name string, candidate_score int, reasons array<string>",
    )
    texts = spark.createDataFrame(artifacts, "project_id string, path string, text string")
    found = propagation_findings(table, texts).collect()
    got = [(r.project_id, r.file, r.raw_value, r.line) for r in found]
    assert len(got) == len(set(got))
    assert set(got) == _brute(sorted(set(inventory)), artifacts)


def test_inventory_keeps_the_first_occurrence(spark):
    rows = [("p", "b/.env", "TOKEN=abcdefgh1"), ("p", "a/.env", "X=1\nSECRET=abcdefgh1\nAPI_KEY=abcdefgh1"), ("q", ".env", "PWD=abcdefgh1\nNAME=abcdefgh2\nSHORT_KEY=abc")]
    got = secret_inventory(spark.createDataFrame(rows, "project_id string, path string, text string")).collect()
    assert {(r.project_id, r.source_path, r.source_line, r.variable_name) for r in got} == {("p", "a/.env", 2, "SECRET"), ("q", ".env", 1, "PWD")}


INDEX = "project_id string, path string, mode string, stage int, length bigint, content binary"


def _index(spark, *rows):
    return spark.createDataFrame([("p", p, m, s, len(c), c.encode()) for p, m, s, c in rows], INDEX)


def test_change_set(spark):
    old = _index(spark, ("same.py", "100644", 0, "a"), ("mod.py", "100644", 0, "a"), ("gone.py", "100644", 0, "a"),
                 ("chmod.py", "100644", 0, "a"), ("typed.py", "100644", 0, "a"))
    new = _index(spark, ("same.py", "100644", 0, "a"), ("mod.py", "100644", 0, f'password = "{VALUE}"'),
                 ("chmod.py", "100755", 0, "a"), ("typed.py", "120000", 0, "a"), ("new.py", "120000", 0, "b"),
                 (".env", "100644", 0, f"A_TOKEN={VALUE}"), ("dist/a.js", "100644", 0, VALUE), ("dist/node_modules/x.js", "100644", 0, VALUE))
    changed = change_set(new, old)
    assert {r.path for r in changed.collect()} == {"mod.py", "chmod.py", "new.py", ".env", "dist/a.js", "dist/node_modules/x.js"}
    result = scan_change_set(changed)
    rows = result.public(ordered=True).collect()
    assert [(r.file, r.type) for r in rows] == [
        ("dist/a.js", "Artifact Secret Exposure"), ("mod.py", "Hardcoded Password"), ("new.py", "Scan Coverage Limitation")]
    assert rows[2].reasons == ["Staged Git entry is not a regular file (mode 120000)."]
    assert result.summary().first().files_scanned == 5
    # A dotenv value outside the change set explains nothing.
    alone = scan_change_set(changed.where("path <> '.env'")).public().collect()
    assert "Artifact Secret Exposure" not in kinds(alone)


def test_bucketed_snapshots_meet_without_an_exchange(spark, tmp_path):
    rows = lambda new: [("p%d" % (i % 3), f"a{i}.py", "100644", 0, 1, b"x" if i % 5 or not new else b"y") for i in range(200) if new or i % 7]
    names = []
    for new in (False, True):
        names.append(f"snapshot_{uuid.uuid4().hex}")
        write_index(spark.createDataFrame(rows(new), INDEX), names[-1], 4, str(tmp_path / names[-1]))
    try:
        old, new = map(spark.table, names)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        changed = change_set(new, old)
        plan = changed._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert {r.path for r in changed.collect()} == {f"a{i}.py" for i in range(200) if i % 5 == 0 or i % 7 == 0}
        plain = change_set(spark.createDataFrame(rows(True), INDEX), spark.createDataFrame(rows(False), INDEX))
        assert {r.path for r in plain.collect()} == {r.path for r in changed.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def _hot_project(rng):
    """Inventory and artifacts with most rows in one project."""
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    inventory = sorted({("hot" if rng.random() < 0.8 else f"p{rng.randrange(4)}", "https://host.example/" * rng.randrange(2) + hexed(12)) for _ in range(3000)})
    artifacts = [(p, f"dist/{i}.js", "".join(rng.choice(["\n", hexed(4), rng.choice(inventory)[1]]) for _ in range(12))) for i, p in enumerate(rng.choice(["hot", "p0", "p9"]) for _ in range(80))]
    return inventory, artifacts


def test_lists_of_every_level_hold_each_value_once(spark, monkeypatch):
    inventory, artifacts = _hot_project(random.Random(3))
    table = spark.createDataFrame([(p, v, ".env", 1, "N", 40, []) for p, v in inventory], "project_id string, raw_value string, source_path string, source_line int, variable_name string, candidate_score int, reasons array<string>")
    texts = spark.createDataFrame(artifacts, "project_id string, path string, text string")
    for least, lists in ((10_000, 1), (30, 64), (1, 2000)):
        monkeypatch.setattr(propagation, "LIST_VALUES", least)
        packed = propagation.packed_inventory(table).collect()
        assert sorted((r.project_id, v.raw_value) for r in packed for v in r["values"]) == inventory
        count = sum(r.project_id == "hot" for r in packed)
        assert count == 1 if lists == 1 else lists / 2 < count <= 4096
        found = propagation_findings(table, texts).collect()
        got = [(r.project_id, r.file, r.raw_value, r.line) for r in found]
        assert len(got) == len(set(got)) and set(got) == _brute(inventory, artifacts)


def test_a_scan_reads_its_files_three_times_and_shuffles_no_window(spark, tmp_path):
    stored = str(tmp_path / "files")
    spark.createDataFrame([file_row(".env", f"A_TOKEN={VALUE}"), file_row("dist/a.js", VALUE)], FILES).write.parquet(stored)
    found = scan_projects(spark.read.parquet(stored)).public()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 3
    assert "Artifact Secret Exposure" in kinds(found.collect())


def test_unmerged_and_unknown_entries_stop_the_scan(spark):
    with pytest.raises(Exception, match="Unmerged"):
        change_set(_index(spark, ("a.py", "100644", 2, "a")), _index(spark, ("a.py", "100644", 0, "b"))).collect()
    with pytest.raises(Exception, match="mode"):
        scan_change_set(_index(spark, ("a.py", None, 0, "a"))).public().collect()


def test_directory_source(spark, tmp_path):
    for name, text in {".env": f"A_TOKEN={VALUE}", "src/deep/er/a.py": f'password = "{VALUE}"', "dist/node_modules/x.js": VALUE,
                       ".next/static/c.js": VALUE, "node_modules/b.py": "x", "notes.md": "x", ".scanignore": "skip.py\n", "skip.py": f'password = "{VALUE}"'}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "big.py").write_bytes(b"a" * (2 * 1024 * 1024 + 1))
    os.symlink(tmp_path / "big.py", tmp_path / "link.py")
    roots = spark.createDataFrame([("p", str(tmp_path))], "project_id string, root string")
    files = read_files(list_projects(roots, spread=4), spread=4)
    stored = str(tmp_path.parent / (tmp_path.name + "-files"))
    write_files(files, stored)
    table = spark.read.parquet(stored)
    result = scan_projects(table, rules_from_files(table))
    rows = result.public(ordered=True).collect()
    assert [(r.file, r.type) for r in rows] == [
        ("big.py", "Scan Coverage Limitation"),
        ("link.py", "Scan Coverage Limitation"), ("src/deep/er/a.py", "Hardcoded Password"),
        (".next/static/c.js", "Artifact Secret Exposure"), ("dist/node_modules/x.js", "Artifact Secret Exposure")]
    assert result.summary().first().files_scanned == 6
    plan = result.public()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "dotenv" in plan


def test_a_deep_tree_is_listed_folder_by_folder_and_read_by_kind(spark, tmp_path):
    root = tmp_path / "tree"
    deep = root.joinpath(*[f"d{i}" for i in range(25)])
    deep.mkdir(parents=True)
    (deep / ".env").write_text(f"A_TOKEN={VALUE}")
    for i in range(40):
        folder = root / f"wide{i}" / "x"
        folder.mkdir(parents=True)
        (folder / f"f{i}.py").write_text(f'password = "{VALUE}"')
    (root / "dist").mkdir()
    (root / "dist" / "a.js").write_text(VALUE)
    (root / "empty").mkdir()
    roots = spark.createDataFrame([("p", str(root)), ("q", f"file://{root}"), ("none", str(tmp_path / "gone"))], "project_id string, root string")
    manifest = list_projects(roots, spread=4)
    want = sorted(str(f.relative_to(root)) for f in root.rglob("*") if f.is_file())
    for project in ("p", "q"):
        assert sorted(r.path for r in manifest.where(F.col("project_id") == project).collect()) == want
    listed = list(projects._children("p", str(root), ""))
    assert all("/" not in e[2] for e in listed) and sum(e[6] for e in listed) == 43
    stored = str(tmp_path / "manifest")
    write_manifest(manifest, stored, parts=3)
    # Only what is asked for is opened: other files are gone by then.
    for f in root.rglob("*.py"):
        f.unlink()
    dotenvs = files_table(spark, stored, ["dotenv"]).collect()
    assert {(r.project_id, bytes(r.content).decode()) for r in dotenvs} == {("p", f"A_TOKEN={VALUE}"), ("q", f"A_TOKEN={VALUE}")}
    assert files_table(spark, stored, ["dotenv", "artifact"], 14).count() == 2
    sources = files_table(spark, stored, ["source"])
    assert sources.count() == 80 and sources.where("readable").count() == 0
    found = scan_projects(files_table(spark, stored)).public().where("project_id = 'p'").collect()
    assert sorted(kinds(found)) == ["Artifact Secret Exposure", *["Scan Coverage Limitation"] * 40]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a.py", f'password = "{VALUE}"'), ("b.yaml", f"token: \"{VALUE}{VALUE}\"")]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    table = spark.createDataFrame(rows, "path string, text string")
    table.write.parquet(source)
    stream = spark.readStream.schema(table.schema).parquet(source)
    stream_findings(stream, F.col("path"), F.col("text"), F.lit("p"), out, str(tmp_path / "ck")).awaitTermination()
    batch = scan_text(table, F.col("path"), F.col("text"), F.lit("p"))
    streamed = spark.read.parquet(out)
    assert sorted((r.file, r.type) for r in streamed.collect()) == sorted((r.file, r.type) for r in batch.collect())


def test_advisory_contract(spark):
    good = "named_struct('available', true, 'model', 'm', 'mode', 'advisory', 'risk_score', 0.1D, 'threshold', 0.5D, 'prediction', 'x', 'calibrated', false, 'blocking', {})"
    frame = spark.range(1).select(F.expr(good.format("false")).alias("a"))
    assert frame.select(checked_advisory(F.col("a")).alias("b")).first().b.mode == "advisory"
    with pytest.raises(Exception, match="blocking"):
        spark.range(1).select(checked_advisory(F.expr(good.format("true")))).collect()
