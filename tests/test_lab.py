"""Generators, models, fusion, metrics, splits and frozen gates."""

import dataclasses
import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietkey.functions.features import NUMERIC_FEATURES
from quietkey.lab import errors, frozen, fusion, metrics, models, profile, separation
from quietkey.lab.advisory import ArtifactError, fit_advisory, load_advisory, save_advisory
from quietkey.lab.split import stratified_split
from quietkey.lab.synth import DEV, FINAL, HOLDOUT, SPECS, V2, V3, generate
from quietkey.operators.detectors import GENERIC
from quietkey.plans.scan import scan_projects


@pytest.mark.parametrize("name", list(SPECS))
def test_generators(spark, name):
    spec = SPECS[name]
    rows = generate(spark, spec, 60)
    counts = {(r.label, r.sample_type): r["count"] for r in profile.sample_type_distribution(rows).collect()}
    assert sum(v for (label, _), v in counts.items() if label == 1) == 60 == sum(counts.values()) / 2
    assert {t for _, t in counts} == {f.sample_type for f in (*spec.positive, *spec.negative, *spec.hard)}
    got = sorted(map(tuple, rows.collect()), key=str)
    again = generate(spark.newSession(), spec, 60).repartition(3)
    assert got == sorted(map(tuple, again.collect()), key=str)
    assert {r.variable_name + r.value for r in rows.collect()} != {r.variable_name + r.value for r in generate(spark, spec, 60, seed=7).collect()}
    if spec.context:
        assert rows.select("variable_name", "value").distinct().count() == 120


def test_dataset_profile(spark):
    v2 = generate(spark, V2)
    hard = profile.hard_example_counts(v2).first()
    assert hard.negative_with_sensitive_name == 200 and 150 < hard.positive_without_sensitive_name < 300
    checks = profile.validate_dataset(v2.unionByName(v2.limit(3))).first()
    assert (checks.duplicate_sample_ids, checks.duplicate_rows, checks.missing_columns, checks.valid_labels) == (3, 3, [], True)
    assert profile.validate_dataset(v2.drop("source")).first().missing_columns == ["source"]
    overlap = {r.feature: r.appears_in_both_classes for r in profile.context_overlap(generate(spark, V3)).collect()}
    assert all(overlap.values())


def _newton(x, y, penalty):
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.diag([penalty] * (x.shape[1] - 1) + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ w)
    return w[:-1]


def test_numeric_model_solves_the_reference_objective(spark):
    rows = generate(spark, V2, 150)
    data = rows.select(*NUMERIC_FEATURES, "label").toPandas()
    x = data[list(NUMERIC_FEATURES)].to_numpy(float)
    scale = x.std(axis=0)
    scaled = (x - x.mean(axis=0)) / np.where(scale == 0, 1, scale)
    model = models.fit_numeric(rows)
    assert np.allclose(model.coefficients, _newton(scaled, data["label"].to_numpy(float), 1.0), atol=2e-3)
    ranked = errors.ranked_coefficients(spark, model.features, model.coefficients).collect()
    assert [r.absolute_coefficient for r in ranked] == sorted((abs(c) for c in model.coefficients), reverse=True)


def test_term_weights_follow_smooth_sublinear_tfidf(spark):
    rows = spark.createDataFrame([("ab", "abab  ABAB", 1), ("ab", "zz", 0), ("q", "abab", 0)], "variable_name string, value string, label int")
    row = models.text_weights(rows).where("value LIKE 'abab %'").first()
    texts = ["ab = abab abab", "ab = zz", "q = abab"]
    grams = [[t[i:i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)] for t in texts]
    df = {g: sum(g in d for d in grams) for d in grams for g in d}
    raw = {g: (1 + np.log(grams[0].count(g))) * (np.log(4 / (1 + df[g])) + 1) for g in set(grams[0]) if df[g] >= 2}
    norm = np.sqrt(sum(v * v for v in raw.values()))
    assert sorted(x.weight for x in row.weights) == pytest.approx(sorted(v / norm for v in raw.values()))
    model = models.fit_text(rows)
    idf = dict(zip(model.counts.vocabulary, model.idf, strict=True))
    assert idf == pytest.approx({g: np.log(4 / (1 + n)) + 1 for g, n in df.items() if n >= 2})


def test_metrics_and_grid_match_numpy(spark):
    rng = np.random.default_rng(3)
    y, t, o = rng.integers(0, 2, 500), rng.integers(0, 40, 500) / 40, rng.random(500)
    frame = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(y, t, o)], "label int, text_probability double, context_probability double")

    def auc(s):
        pos, neg = s[y == 1], s[y == 0]
        return ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))

    assert metrics.roc_auc(frame, "label", "text_probability").first().roc_auc == pytest.approx(auc(t))
    grid = fusion.search_fusion(frame).collect()
    assert len(grid) == len(fusion.V2_WEIGHTS) * len(fusion.V2_THRESHOLDS)
    for r in grid:
        s = r.text_weight * t + (1 - r.text_weight) * o
        assert (r.true_positives, r.false_positives) == (((s >= r.threshold) & (y == 1)).sum(), ((s >= r.threshold) & (y == 0)).sum())
        assert r.true_positives + r.true_negatives + r.false_positives + r.false_negatives == 500
        assert r.roc_auc == pytest.approx(auc(s))
    one_class = frame.where("label = 1")
    assert metrics.roc_auc(one_class, "label", "text_probability").first().roc_auc is None
    with pytest.raises(ValueError):
        fusion.fusion_probability(F.col("a"), F.col("b"), 1.5)


def test_complementarity_rejects_unequal_frames(spark):
    schema = "sample_id string, label int, context_prediction int, text_prediction int, text_probability double"
    frame = spark.createDataFrame([("a", 1, 1, 0, 0.2), ("b", 0, 1, 0, 0.1), ("c", 1, 0, 0, 0.1)], schema)
    context = frame.drop("text_prediction", "text_probability")
    got = {r.sample_id: r.outcome for r in errors.complementarity(context, frame).collect()}
    assert got == {"a": "context_only_correct", "b": "text_only_correct", "c": "both_wrong"}
    for other in (frame.limit(2), frame.withColumn("label", F.lit(1))):
        with pytest.raises(Exception, match="must"):
            errors.complementarity(context, other).collect()


def test_separation(spark):
    left, right = generate(spark, V3, 40), generate(spark, DEV, 40)
    report = separation.strictly_separate(separation.compare_separation(left, right)).first()
    assert report.strictly_separate and (report.training_samples, report.development_samples) == (80, 80)
    mixed = separation.strictly_separate(separation.compare_separation(left, right.unionByName(left.limit(2), allowMissingColumns=True))).first()
    assert not mixed.strictly_separate and mixed.shared_candidate_pairs == 2


def test_split_is_stratified_and_stable(spark):
    rows = generate(spark, V3, 300)
    split = stratified_split(rows)
    assert {r.label: r["count"] for r in split.where("is_test").groupBy("label").count().collect()} == {0: 60, 1: 60}
    ids = {r.sample_id for r in split.where("is_test").collect()}
    assert ids == {r.sample_id for r in stratified_split(rows.repartition(5)).where("is_test").collect()}
    assert ids != {r.sample_id for r in stratified_split(rows, seed=1).where("is_test").collect()}


def test_frozen_sets_and_holdout_bundle(spark, tmp_path):
    sets = {}
    for name, spec in (("training", V3), ("development", DEV), ("holdout", HOLDOUT)):
        rows, path = generate(spark, spec, 30), str(tmp_path / name)
        columns = tuple(rows.columns)
        frozen.write_candidates(rows.coalesce(1), path)
        identity = frozen.Identity(frozen.file_sha256(spark, path), 60, spec.source, {0: 30, 1: 30})
        back = frozen.validate_frozen(spark, path, identity, columns)
        assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
        sets[name] = (back, path, identity)
    wrong = frozen.Identity("0" * 64, 60, V3.source, {0: 30, 1: 30})
    with pytest.raises(ValueError, match="SHA-256"):
        frozen.validate_frozen(spark, sets["training"][1], wrong)
    bundle = frozen.load_holdout_bundle(spark, {n: (p, i) for n, (_, p, i) in sets.items()}, {n: tuple(f.columns) for n, (f, _, _) in sets.items()})
    assert {n: f.count() for n, f in bundle.items()} == dict.fromkeys(sets, 60)
    frozen.require_separation(sets["training"][0], sets["holdout"][0], "training")
    with pytest.raises(ValueError, match="separation"):
        frozen.require_separation(sets["training"][0], sets["training"][0], "training")
    with pytest.raises(Exception, match="(?i)exist"):
        frozen.write_candidates(sets["training"][0], sets["training"][1])
    digest = frozen.table_digest(sets["training"][0]).first()
    assert digest == frozen.table_digest(sets["training"][0].repartition(4)).first()


def test_advisory_never_changes_findings_and_survives_storage(spark, tmp_path):
    training = generate(spark, V3, 150)
    advisory = fit_advisory(training)
    text = 'x = "K7mP2xQ9vL4sN8zA1c"\npassword = "Zx81QpLm77RtYw"'.encode()
    files = spark.createDataFrame([("p", "a.py", len(text), False, True, text)],
        "project_id string, path string, length bigint, is_symlink boolean, readable boolean, content binary")
    plain = scan_projects(files).public().drop("ml_advisory").collect()
    scored = scan_projects(files, advisory=advisory).public()
    assert sorted(map(str, scored.drop("ml_advisory").collect())) == sorted(map(str, plain))
    for r in scored.collect():
        assert (r.ml_advisory is not None) == (r.type == GENERIC)
        if r.ml_advisory:
            assert 0 <= r.ml_advisory.risk_score <= 1 and not r.ml_advisory.blocking
    path = str(tmp_path / "model")
    expected = save_advisory(spark, advisory, path, V3.source, "0" * 64, 300)
    loaded = load_advisory(spark, path, expected)
    rows = training.limit(20)
    pick = lambda a: {r.sample_id: r.ml_advisory.risk_score for r in a.score(rows).collect()}
    assert pick(loaded) == pytest.approx(pick(advisory))
    with pytest.raises(ArtifactError):
        load_advisory(spark, path, "0" * 64)
    target = next((tmp_path / "model" / "models" / "context").glob("part-*"))
    target.write_bytes(target.read_bytes() + b" ")
    for crc in target.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ArtifactError):
        load_advisory(spark, path, expected)


def test_hashed_advisory_survives_storage(spark, tmp_path):
    training = generate(spark, V3, 60)
    advisory = fit_advisory(training, hash_buckets=1 << 12)
    path = str(tmp_path / "model")
    expected = save_advisory(spark, advisory, path, V3.source, "0" * 64, 120)
    loaded = load_advisory(spark, path, expected)
    rows = training.limit(20)
    pick = lambda a: {r.sample_id: r.ml_advisory.risk_score for r in a.score(rows).collect()}
    assert pick(loaded) == pytest.approx(pick(advisory))


def test_a_bundle_reads_every_set_once_and_stops_at_a_mismatch(spark, tmp_path):
    sets, columns = {}, {}
    for name, spec in (("training", V3), ("development", DEV), ("holdout", HOLDOUT)):
        rows, path = generate(spark, spec, 20), str(tmp_path / name)
        frozen.write_candidates(rows, path)
        columns[name] = tuple(rows.columns)
        sets[name] = (path, frozen.Identity(frozen.file_sha256(spark, path), 40, spec.source, {0: 20, 1: 20}))
    held = {n: frozen.observed(n, frozen.read_candidates(spark, p, columns[n])) for n, (p, _) in sets.items()}
    checks = frozen.bundle_checks(held)
    assert checks._jdf.queryExecution().executedPlan().toString().count("FileScan") == 3
    assert {r.what: (r.training, r.development) for r in checks.collect()} == dict.fromkeys(("pair", "value", "type", "source"), (0, 0))
    assert held["training"].verify(sets["training"][1])["samples"] == 40
    assert set(frozen.load_holdout_bundle(spark, sets, columns)) == set(sets)
    for wrong in ({"samples": 39}, {"source": "x"}, {"labels": {0: 40}}):
        path, right = sets["holdout"]
        broken = {**sets, "holdout": (path, dataclasses.replace(right, **wrong))}
        with pytest.raises(ValueError, match="holdout"):
            frozen.load_holdout_bundle(spark, broken, columns)
    again = {**sets, "development": sets["holdout"]}
    with pytest.raises(ValueError, match="separation from development"):
        frozen.load_holdout_bundle(spark, again, {**columns, "development": columns["holdout"]})


def _tree(path, length, known):
    """The hash tree of a sparse file from its few filled blocks."""
    size = frozen.BLOCK_BYTES
    zero = hashlib.sha256(bytes(size)).hexdigest()
    n = max(1, -(-length // size))
    level = [zero] * n
    with open(path, "rb") as source:
        for i in {*known, n - 1}:
            source.seek(i * size)
            level[i] = hashlib.sha256(source.read(size)).hexdigest()
    while len(level) > 1:
        parts = [level[i : i + frozen.TREE_FAN] for i in range(0, len(level), frozen.TREE_FAN)]
        level = [hashlib.sha256("".join(p).encode()).hexdigest() if len(p) > 1 else p[0] for p in parts]
    return level[0]


@pytest.mark.parametrize("length", [5, 1 << 20, (1 << 20) + 1, 3 * (1 << 30) + 12_345])
def test_large_files_hash_in_ranges(spark, tmp_path, length):
    path = tmp_path / "big.bin"
    with open(path, "wb") as out:
        out.truncate(length)
        for at in (0, length // 2):
            out.seek(at)
            out.write(b"mark"[: max(0, min(4, length - at))])
    want = _tree(path, length, {0, length // 2 // frozen.BLOCK_BYTES})
    for blocks in (64, 1000) if length > 1 << 30 else (1, 64):
        row = frozen.tree_sha256(spark, str(path), blocks).first()
        assert (row.length, row.digest) == (length, want)
    if length <= 1 << 20:
        assert want == hashlib.sha256(path.read_bytes()).hexdigest() == frozen.file_sha256(spark, str(path))


def test_reports_are_written_once(spark, tmp_path):
    report = metrics.calculate_metrics(spark.createDataFrame([(1, 1), (0, 1)], "label int, prediction int"))
    frozen.save_report(report, str(tmp_path / "r"))
    with pytest.raises(Exception, match="(?i)exist"):
        frozen.save_report(report, str(tmp_path / "r"))
    row = spark.read.json(str(tmp_path / "r")).first()
    assert (row.true_positives, row.false_positives, row.precision) == (1, 1, 0.5)


def test_model_inputs_and_split_evaluation(spark):
    rows = generate(spark, V3, 60)
    scaled = models.scaled_features(rows).select(*(f(F.col("scaled")[i]) for i in range(2) for f in (F.avg, F.stddev_pop))).first()
    assert list(scaled) == pytest.approx([0, 1, 0, 1], abs=1e-9)
    weights = models.text_weights(rows).select(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x["weight"] * x["weight"]).alias("w"))
    assert all(r.w == pytest.approx(1.0) for r in weights.collect())
    tested = models.split_evaluation(rows, models.fit_numeric, "numerical")
    assert tested.count() == 24
    assert all(r.cell[0] == "FT"[r.numerical_prediction == r.label] and r.cell[1] == "NP"[r.numerical_prediction] for r in tested.collect())


def test_table_digest_sees_values_nulls_and_copies(spark):
    def digest(*rows):
        return frozen.table_digest(spark.createDataFrame(list(rows), "a string, b string")).first().digest

    assert digest(("x", "y"), ("1", None)) == digest(("1", None), ("x", "y"))
    different = [digest(), digest(("ab", "c")), digest(("a", "bc")), digest(("a", None)), digest(("a", "")), digest(("ab", "c"), ("ab", "c"))]
    assert len(set(different)) == len(different)


def test_final_set_is_validated_and_reported(spark):
    final = generate(spark, FINAL, 30)
    frozen.validate_final(final, 60)
    with pytest.raises(ValueError, match="size or label"):
        frozen.validate_final(final, 80)
    with pytest.raises(ValueError, match="source"):
        frozen.validate_final(final, 60, "elsewhere")
    report = frozen.final_report(generate(spark, V3, 60), final, "0" * 64).first()
    assert report.status == "FINAL_EVALUATION" and report.policy.used_for_training is False
    assert sum(report[c] for c in metrics.CONFUSION) == 60


def test_auc_of_ten_million_distinct_scores(spark):
    n = 10_000_000
    score = F.pmod(F.col("id") * 2_654_435_761, F.lit(n * 8 + 3))
    frame = spark.range(n).select(score.alias("score"), (F.pmod(F.xxhash64("id"), F.lit(100)) < F.lit(20) + score / (n * 0.16)).cast("int").alias("label"))
    tied = metrics.tied_scores(frame, "label", "score")
    plan = metrics.auc_of_ties(tied)
    rows = frame.toPandas()
    order = np.argsort(rows["score"].to_numpy(), kind="stable")
    label = rows["label"].to_numpy()[order].astype(np.int64)
    assert len(np.unique(rows["score"])) == n
    wins = int((np.cumsum(1 - label) * label).sum())
    assert plan.first().roc_auc == pytest.approx(wins / (label.sum() * (1 - label).sum()), abs=1e-12)


def test_structural_checks_shuffle_narrow_rows_once(spark):
    v2 = generate(spark, V2, 40)
    doubled = v2.unionByName(v2.limit(7)).unionByName(v2.limit(4).withColumn("sample_id", F.concat("sample_id", F.lit("x"))))
    seen = profile.validate_dataset(doubled)
    assert (seen.first().duplicate_rows, seen.first().duplicate_sample_ids) == (7, 7)
    pairs = [(r.variable_name, r.value) for r in doubled.collect()]
    assert seen.first().duplicate_candidates == len(pairs) - len(set(pairs))
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    nothing = profile.validate_dataset(v2.limit(0)).first()
    assert (nothing.duplicate_rows, nothing.missing_values, nothing.valid_labels) == (0, 0, True)
    assert not profile.validate_dataset(v2.limit(0), strict_labels=True).first().valid_labels


def test_text_scores_are_the_sigmoid_of_weighted_terms(spark):
    rows = generate(spark, V3, 60)
    for fit in (models.fit_text, models.fit_hybrid):
        model = fit(rows)
        place = {g: i for i, g in enumerate(model.counts.vocabulary)}
        for r in model.predict(rows, "p").collect():
            text = f"{r.variable_name} = {r.value}".lower()
            tf = Counter(text[i : i + n] for n in models.NGRAM_SIZES for i in range(len(text) - n + 1))
            held = {place[g]: (1 + np.log(n)) * model.idf[place[g]] for g, n in tf.items() if g in place}
            margin = model.intercept + sum(v * model.weights[t] for t, v in held.items()) / np.sqrt(sum(v * v for v in held.values()))
            if model.numeric:
                n = model.numeric
                margin += sum(c * (r[f] - m) / d if d else 0 for f, m, d, c in zip(n.features, n.means, n.deviations, n.coefficients))
            assert r.p_probability == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-9)
            assert r.p_prediction == (r.p_probability > 0.5)
        assert metrics.calculate_metrics(model.predict(rows, "p"), "label", "p_prediction").first().accuracy > 0.8
