"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns: one odd table through every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import decontaminate, mixing, ngram_join, pii_feistel, ppm_score, quality_rules, sharding, substring_dedup, token_counts, warc_zip
from quillspark.llm.common import materialise

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, slot string, n int, cls string, name string, kept string, p string, part int, counts string, law string, least int"
BASE = " ".join(f"w{i}" for i in range(120))


def _row(i, t):
    return (i, t, None, "s", 1, 7, "x", "y", 3, "c", "n", "k", "p", 1, "z", "l", 5)


ROWS = [
    (1, BASE), (2, BASE), (2, BASE), (3, None), (4, ""), (5, " \n\t "), (None, BASE), (None, None), (6, "one"), (7, "ONE"),
    (8, "long " * 60_000), (9, BASE + " tail"), (10, "é " * 70 + BASE), (11, "x" * 50_000), (-5, "minus " + BASE), (12, "the quick brown fox jumps over the lazy dog near the old river bank today"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([_row(i, t) for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (8, 0, 0), (9, 1, None), (None, 1, 1), (12, 1, 0), (12, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the old river"), (2, None), (3, ""), (None, "zz yy xx ww vv uu")], "item_id long, text string")


@pytest.fixture(scope="module")
def merges(tmp_path_factory):
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def operators(labels, benchmark, merges):
    return {
        "tokens": lambda d: token_counts.count_tokens(d, merges),
        "mix": lambda d: mixing.mix_report(d, labels),
        "ppm": ppm_score.score,
        "quality": quality_rules.judge,
        "shards": lambda d: sharding.assign(d),
        "shard_digest": lambda d: sharding.digest(d),
        "pii": pii_feistel.pseudonymise,
        "repeats": lambda d: substring_dedup.remove_repeats(d, keep_text=True),
        "groups": ngram_join.groups,
    }


NAMES = ["tokens", "mix", "ppm", "quality", "shards", "shard_digest", "pii", "repeats", "groups"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_comes_back(name, odd, labels, benchmark, merges):
    rows = operators(labels, benchmark, merges)[name](odd).collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == sorted((i for i, _ in ROWS), key=str)


def test_values_of_odd_rows(odd, labels, benchmark, merges):
    """Null, empty and blank texts, repeated rows, rows without an id."""
    ops = operators(labels, benchmark, merges)
    rows = lambda name: sorted((tuple(r.asDict().items()) for r in ops[name](odd).collect()), key=str)
    by = lambda name: {(r["doc_id"], r.get("n_tokens", 0)): r for r in map(dict, rows(name))}
    mix = [dict(r) for r in rows("mix")]
    assert all(r["kept"] and r["n_tokens"] == 0 for r in mix if r["doc_id"] in (3, 4, 5)) and len({r["p_good"] for r in mix if r["doc_id"] == 2}) == 1
    ppm = by("ppm")
    assert {i for i, n in ppm if n == 1} >= {3, 4, 5} and all(r["held_out"] for (i, _), r in ppm.items() if i is None)
    quality = [dict(r) for r in rows("quality")]
    assert all(r["base_failed"] and not r["kept"] and r["n_words"] == 0 for r in quality if r["doc_id"] in (3, 4, 5))
    assert len({tuple(r.values()) for r in quality if r["doc_id"] == 2}) == 1
    shards = [dict(r) for r in rows("shard_digest")]
    assert {r["size"]: r["text_crc32"] for r in shards if r["doc_id"] in (3, 4)} == {1: 0} and len({(r["doc_id"], r["shard"], r["slot"]) for r in shards}) == len(shards)
    pii = [dict(r) for r in rows("pii")]
    assert {(r["doc_id"], r["text"], r["n_replaced"]) for r in pii if r["doc_id"] in (3, 4, 5)} == {(3, None, 0), (4, "", 0), (5, " \n\t ", 0)} and all(r["size"] == 7 for r in pii)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(name, odd, labels, benchmark, merges):
    assert operators(labels, benchmark, merges)[name](odd.limit(0)).collect() == []


def test_filters_keep_columns_and_stand_empty_tables(odd, labels, benchmark):
    for f in (quality_rules.filter_documents, ngram_join.keep_one, lambda d: decontaminate.clean(d, benchmark), lambda d: mixing.mix(d, labels)):
        out = f(odd)
        assert out.columns == odd.columns
        out.collect()
        assert f(odd.limit(0)).collect() == []


def test_matches_and_empty_benchmark(odd, benchmark):
    found = decontaminate.matches(odd, benchmark).collect()
    assert [(r["doc_id"], r["item_id"], r["distance"]) for r in found] == [(12, 1, 0)]
    assert decontaminate.matches(odd, benchmark.limit(0)).collect() == []


def test_defined_results(odd, merges):
    groups = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.groups(odd).collect()}
    assert groups[(3, 0)] == 3 and groups[(4, 0)] == 4 and groups[(6, 1)] == 6 and groups[(7, 1)] == 6
    assert {groups[(i, 117)] for i in (1, 2)} == {-5} and groups[(-5, 118)] == -5 and groups[(9, 118)] == -5
    repeats = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substring_dedup.remove_repeats(odd).collect()}
    assert repeats[(-5, 121)] == 0 and repeats[(1, 120)] == 120 and repeats[(2, 120)] == 120 and repeats[(None, 120)] == 0 and repeats[(9, 121)] == 120
    tokens = {(r["doc_id"], r["n_bytes"]): r["n_tokens"] for r in token_counts.count_tokens(odd, merges).collect()}
    assert tokens[(3, 0)] == 0 and tokens[(4, 0)] == 0


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, tiny):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (docs, docs.limit(0)):
        d = rows
        for name, stage in corpus_pipeline.STAGES:
            d = materialise(stage(spark, d, tiny), "stage")
            if name != "sharding":
                assert d.columns == docs.columns
        assert d.filter(F.col("shard").isNull()).count() == 0


def test_pages_edge_cases(spark):
    big = "x" * 1200
    pages = spark.createDataFrame([(1, "u", big), (2, "u\nv", big), (2, "u", big), (3, None, None), (4, "s", "short"), (5, "s", "short"), (None, "n", big), (None, None, "y" * 1500)], "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in warc_zip.round_trip(pages).collect())
    assert got == sorted([(1, "revisit", 2, 1200), (2, "response", 0, 1200), (2, "response", 0, 1200), (3, "response", 0, 0), (4, "response", 0, 5), (5, "response", 0, 5), (0, "revisit", 2, 1200), (0, "response", 0, 1500)])
    assert warc_zip.round_trip(pages.limit(0)).collect() == []
