"""Every operator on awkward tables: nulls, empty and long texts, ties, repeats, clashing names."""

import pytest

from quietkey.llm import alignment, decontamination, language_id, mixing, pieces, pii, quality, secret_scan, simhash, token_counts, toxicity, url_filters

NAMES = "row fp quality secrets pii leaks shard place mix_key mix_size host path rule verdict digest n_tokens score held_out component_id hash found ids decoded groups links block rank rule_digest rule_salt turn_ mix_turn mix_mark best url salt given judged_url coded"
LONG = "many different words follow here " * 4000
ROWS = [
    (1, "some plain text about nothing in particular", "en", "a", 43),
    (1, "some plain text about nothing in particular", "en", "a", 43),
    (2, None, None, None, None),
    (None, "a text without an id, mail x.y@example.com", "en", "a", None),
    (3, "", "", "", 0),
    (4, LONG, "en", "b", len(LONG)),
    (5, "\x00\t\n \x0b", "de", "b", 5),
    (6, "ünïcödé 日本語 😀 \U0010ffff", "xx", "b", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark, empty=False):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([] if empty else ROWS, SCHEMA).repartition(3)
    return docs.withColumns({n: F.lit("x") for n in NAMES.split()})


def bench(spark):
    return spark.createDataFrame([(7, "text about nothing in particular"), (8, None), (9, ""), (None, "never there at all")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 1), (3, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


PER_ROW = {
    "secrets": lambda s, d: secret_scan.scan_secrets(d),
    "tokens": lambda s, d: token_counts.count_tokens(d),
    "pieces": lambda s, d: pieces.decode_pieces(pieces.encode_pieces(d)),
    "pieces_both": lambda s, d: pieces.code_pieces(d),
    "alignment": lambda s, d: alignment.align_documents(d),
    "quality": lambda s, d: quality.judge_quality(d),
    "simhash": lambda s, d: simhash.link_documents(d),
    "mixing": lambda s, d: mixing.mix_plan(d),
    "language": lambda s, d: language_id.identify_languages(d),
    "pii": lambda s, d: pii.replace_pii(d, pii.TRIAL_KEY),
    "pii_stage": lambda s, d: pii.without_pii(d, pii.TRIAL_KEY),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, labels(s)),
    "urls": lambda s, d: url_filters.judge_urls(d, url_filters.url_rules(s), url="text"),
}
FILTERS = {
    "leaks": lambda s, d: decontamination.find_leaks(d, bench(s)),
    "leaks_stage": lambda s, d: decontamination.without_leaks(d, bench(s)),
    "quality_stage": lambda s, d: quality.keep_quality(d),
    "dedup_stage": lambda s, d: simhash.keep_one(d),
    "mix": lambda s, d: mixing.mix(d),
}


@pytest.mark.parametrize("name", [*PER_ROW, *FILTERS])
def test_awkward_and_empty_tables(spark, name):
    apply = {**PER_ROW, **FILTERS}[name]
    rows = apply(spark, odd(spark)).collect()
    if name in PER_ROW:
        assert len(rows) == len(ROWS)
    assert apply(spark, odd(spark, empty=True)).collect() == []


def test_stages_keep_columns(spark):
    docs = odd(spark)
    for name in ("leaks_stage", "quality_stage", "dedup_stage"):
        assert FILTERS[name](spark, docs).columns == docs.columns
    assert pii.without_pii(docs, pii.TRIAL_KEY).columns == docs.columns


def test_awkward_results(spark):
    leaks = FILTERS["leaks"](spark, odd(spark)).collect()
    assert sorted((r.doc_id, r.item_id) for r in leaks) == [(1, 7), (1, 7)]
    kept = simhash.keep_one(odd(spark)).collect()
    # Texts without words are one group (U+0000 is a word); the repeated row stays once.
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 2), (False, 4), (False, 5), (False, 6), (True, 0)]
    lang = {(r.doc_id, r.text): r for r in language_id.identify_languages(odd(spark)).collect()}
    assert lang[2, None].lang_pred == lang[3, ""].lang_pred == "und"
    assert lang[2, None].score == 0.0
    texts = {r.doc_id: r.pii for r in pii.replace_pii(odd(spark), pii.TRIAL_KEY).collect()}
    assert texts[2].text is None and texts[3].text == "" and texts[None].n_email == 1
    assert "x.y@example.com" not in texts[None].text
