"""What holds on tables larger than the given ones."""

import random
from collections import Counter

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from quietkey.lab import lexical, models, separation, terms
from quietkey.lab.synth import V3, generate
from quietkey.operators.changes import change_set
from quietkey.operators.ordering import positioned
from quietkey.plans.scan import scan_change_set
from workload import corpora
from workload import queries as Q


def test_digest_of_more_rows_than_a_long_holds(spark):
    rows = spark.range(100_000).select(Q._total(F.lit((1 << 48) - 1)).alias("digest"))
    assert int(rows.first().digest) == 100_000 * ((1 << 48) - 1)


def test_separation_names_what_both_sets_share(spark):
    columns = "variable_name string, value string, sample_type string, source string"
    left = spark.createDataFrame([("a", "1", "t", "x"), ("b", "2", "u", "x")], columns)
    right = spark.createDataFrame([("a", "3", "u", "y"), ("c", "4", "t", "z")], columns)
    row = separation.compare_separation(left, right, named=True).first()
    assert (row.shared_type_names, row.shared_source_names) == (["t", "u"], [])
    assert (row.training_sources, row.development_sources) == (["x"], ["y", "z"])
    assert (row.shared_sample_types, row.shared_sources) == (2, 0)


def test_terms_are_counted_and_found_by_code_points(spark, monkeypatch):
    texts = ["abcabc", "xabc\x00\U0001f511\U0001f511k", "", "ab", "\U0001f511\U0001f511kabc"] * 3
    monkeypatch.setattr(terms, "BLOCK", 9)
    grams = [[t[i : i + n] for n in terms.NGRAM_SIZES for i in range(len(t) - n + 1)] for t in texts]
    total, held = Counter(g for x in grams for g in x), Counter(g for x in grams for g in set(x))
    merged = {}
    for _, block in terms._blocks(texts):
        for batch in terms._block_counts(block):
            for r in batch.to_pylist():
                d, o = merged.get(r["term"], (0, 0))
                merged[r["term"]] = (d + r["documents"], o + r["occurrences"])
    assert merged == {g: (held[g], total[g]) for g in total}
    kept = tuple(sorted(g for g in total if total[g] > 3))
    row, term, count = terms.held_terms(texts, terms.Terms(kept).trie)
    found = {(r, kept[t]): c for r, t, c in zip(row.tolist(), term.tolist(), count.tolist(), strict=True)}
    assert found == {(i, g): c for i, x in enumerate(grams) for g, c in Counter(x).items() if g in set(kept)}
    assert not terms.held_terms(texts, terms.Terms(()).trie)[0].size


def test_terms_are_weighed_once_below_a_filter(spark):
    rows = generate(spark, V3, 30).repartition(4)
    plan = models.text_weights(rows).where(F.size("weights") > 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("ArrowEvalPython") == 1


def test_hybrid_features_name_no_place(spark, monkeypatch):
    seen = []
    fit = models._fit
    monkeypatch.setattr(models, "_fit", lambda stages, frame, samples: seen.append(frame) or fit(stages, frame, samples))
    for buckets in (None, 1 << 10):
        model = models.fit_hybrid(generate(spark, V3, 40), buckets)
        assert len(seen[-1].schema["_text"].metadata.get("ml_attr", {}).get("attrs", {})) == 0
        assert len(model.numeric.coefficients) == len(models.NUMERIC_FEATURES)


def test_a_fit_makes_its_vectors_once_and_adds_up_large_blocks(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def numbers(i):
        made.add(1)
        return [float(i % 7), float(i % 3)]

    rows = spark.range(200).select(F.col("id"), (F.col("id") % 2).cast("double").alias("_label"))
    vector = array_to_vector(numbers.asNondeterministic()("id"))
    stage = models._regression("_features", 200, 1e-5)
    models._fit([stage], rows.select(vector.alias("_features"), "_label"), 200)
    assert made.value == 200
    assert stage.getMaxBlockSizeInMB() == models.BLOCK_MB > 1


def test_keys_of_a_large_table_meet_more_tasks(spark, tmp_path, monkeypatch):
    spark.range(100).selectExpr("id AS o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(corpora, "KEYS_PER_TASK", 5)
    keys = corpora.corpus(spark, str(tmp_path), "SELECT o_orderkey FROM orders")
    assert (keys.rdd.getNumPartitions(), keys.count()) == (24, 100)


def test_positioned_rows_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def number(i):
        made.add(1)
        return i * 7 % 100

    rows = spark.range(0, 100, 1, 4).select(number.asNondeterministic()("id").alias("n"))
    placed = positioned(rows, ["n"]).collect()
    assert made.value == 100 and all(r.position == r.n + 1 for r in placed)


def test_named_terms_are_stored(spark, tmp_path):
    held = terms.Terms(("abc", "\x00bc", "zz zz"))
    held.save(str(tmp_path / "t"))
    assert terms.Terms.load(str(tmp_path / "t")) == held


def test_a_corpus_is_filtered_behind_its_exchange(spark, tmp_path):
    """Below it the few tasks that read the keys would build the whole corpus."""
    spark.range(100).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    old = corpora.files(spark, str(tmp_path), corpora.OLD_INDEX)
    plan = old._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan[plan.index("Exchange") :].replace("DataFilters", "").replace("PushedFilters", "").replace("PartitionFilters", "")
    assert 0 < old.count() < 100


def test_a_change_set_moves_the_content_of_each_role_alone(spark, tmp_path):
    index = "project_id string, path string, mode string, stage int, length bigint, content binary"
    spark.createDataFrame([("p", "a.py", "100644", 0, 5, b"a = 1")], index).write.parquet(str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    plan = scan_change_set(change_set(stored, stored)).findings._jdf.queryExecution().optimizedPlan().toString()
    joined = [line for line in plan.split("LeftOuter")[1:]]
    # The sources, the artifacts and the dotenv files: what each join reads of the new entries.
    roles = [any(m in j[: j.index("Relation")] for m in ("dist|build", "IN (.env")) for j in joined]
    assert roles == [False, True, True]


def _some_texts(many):
    draw = random.Random(4)
    return ["".join(draw.choice("abé\U0001f511 ") for _ in range(draw.choice([0, 2, 3, 7, 30]))) for _ in range(many)]


def test_a_task_adds_up_the_terms_of_all_its_blocks(monkeypatch):
    texts = _some_texts(60)
    grams = [[t[i : i + n] for n in terms.NGRAM_SIZES for i in range(len(t) - n + 1)] for t in texts]
    total, held = Counter(g for x in grams for g in x), Counter(g for x in grams for g in set(x))
    # Whole; given out where many are pending; more letters than are numbered.
    for pending, letter in ((1 << 20, 9), (40, 9), (1 << 20, 1)):
        monkeypatch.setattr(terms, "_PENDING", pending)
        monkeypatch.setattr(terms, "_LETTER", letter)
        counter, rows = terms._Counter(), []
        for i in range(0, 60, 20):
            rows += [r for batch in counter.add(texts[i : i + 20]) for r in batch.to_pylist()]
        rows += [r for batch in counter.rest() for r in batch.to_pylist()]
        merged = Counter()
        for r in rows:
            merged.update({(r["term"], "d"): r["documents"], (r["term"], "o"): r["occurrences"]})
        assert merged == {(g, k): c[g] for k, c in (("d", held), ("o", total)) for g in total}
        assert (len(rows) == len(total)) == (pending == 1 << 20 and letter == 9)


def test_longest_terms_stand_for_all_counts_of_a_text(monkeypatch):
    texts = _some_texts(60)
    monkeypatch.setattr(terms, "BLOCK", 90)
    grams = [[t[i : i + n] for n in terms.NGRAM_SIZES for i in range(len(t) - n + 1)] for t in texts]
    known = sorted({g for x in grams for g in x})
    for kept in (known, known[::3], []):
        place, trie = {g: i for i, g in enumerate(kept)}, terms.Terms(kept).trie
        draw = np.random.default_rng(1)
        weight, idf, error = draw.random(len(kept)), draw.random(len(kept)) + 1, draw.random(len(texts))
        sums, found, first, slopes = trie.chain_sums(weight * idf), [], 0, np.zeros(len(kept))
        for block in terms.chains(texts, trie, trie.chain_sums(idf * idf)):
            found += lexical.margins(block, sums).tolist()
            own = error[first : first + len(block.squares)] * lexical._inverse(block)
            lexical._add(slopes, block.term, block.times, own[block.text])
            lexical._add(slopes, block.other, block.others, block.share * own[block.of])
            first += len(block.squares)
        wanted = np.zeros((len(texts), len(kept)))
        for i, x in enumerate(grams):
            for g, n in Counter(g for g in x if g in place).items():
                wanted[i, place[g]] = (1 + np.log(n)) * idf[place[g]]
        wanted /= np.maximum(np.linalg.norm(wanted, axis=1), 1e-300)[:, None]
        assert np.allclose(found, wanted @ weight)
        assert np.allclose(trie.spread(slopes) * idf, wanted.T @ error)


def test_a_lexical_fit_holds_no_row_in_the_memory_of_executors(spark, monkeypatch):
    held, least = [], lexical.minimise

    def watched(value, *more):
        levels = [x.storageLevel() for x in spark.sparkContext._jsc.sc().getRDDStorageInfo()]
        held.extend((x.useDisk(), x.useMemory()) for x in levels)
        return least(value, *more)

    monkeypatch.setattr(lexical, "minimise", watched)
    rows = generate(spark, V3, 40)
    model = models.fit_text(rows)
    assert (True, False) in held and not any(memory for _, memory in held)
    # The slopes vanish where the loss is least.
    made = model.predict(rows, "p").select("label", "p_probability", F.concat("variable_name", F.lit(" = "), "value").alias("t")).toPandas()
    trie, slopes = model.counts.trie, np.zeros(len(model.idf))
    for block in terms.chains(made["t"].str.lower().tolist(), trie, trie.chain_sums(model.idf**2)):
        own = (made["p_probability"] - made["label"]).to_numpy() * lexical._inverse(block)
        lexical._add(slopes, block.term, block.times, own[block.text])
        lexical._add(slopes, block.other, block.others, block.share * own[block.of])
    assert np.abs(trie.spread(slopes) * model.idf + model.weights).max() < 0.05
