"""The pipeline on the tiny documents, each stage against brute force over its own input."""

import collections
import re

import numpy as np
import pytest
from test_llm_operators import brute_groups

import corpus_pipeline
from quillspark.llm import decontaminate, mixing, quality_rules
from quillspark.llm.common import materialise


@pytest.fixture(scope="module")
def steps(spark, tiny):
    docs = [spark.read.parquet(f"{tiny}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(materialise(stage(spark, docs[-1], tiny), name.replace(" ", "-")))
    return docs


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_quality_stage(steps):
    before, after = texts(steps[0]), texts(steps[1])
    found = {i: quality_rules.measure(t) for i, t in before.items()}
    post = quality_rules.fit(collections.Counter(map(quality_rules.votes, found.values())))
    assert set(after) == {i for i, m in found.items() if not quality_rules.base_failed(m) and post[quality_rules.votes(m)] >= 0.5}


def test_near_duplicate_stage(steps):
    before = texts(steps[1])
    groups = brute_groups(list(before.items()), 5, 80)
    assert set(texts(steps[2])) == {i for i, (_, component) in groups.items() if i == component}


def test_decontamination_stage(spark, tiny, steps):
    before = texts(steps[2])
    low = lambda t: np.array([hash(w) for w in re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()).split()], np.int64)
    items = [low(r["text"]) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    dirty = {i for i, t in before.items() if any(decontaminate.edit_distance(item, low(t))[0] <= decontaminate.allowed_edits(len(item)) for item in items if len(item))}
    assert dirty and set(texts(steps[3])) == set(before) - dirty


def test_mixing_stage(spark, tiny, steps):
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    report = {r["doc_id"]: r for r in mixing.mix_report(steps[3], labels).collect()}
    kept = set(texts(steps[4]))
    assert kept == {i for i, r in report.items() if r["kept"]}
    n, p = np.array([r["n_tokens"] for r in report.values()]), np.array([[r["p_good"], r["p_low"], r["p_toxic"]] for r in report.values()])
    rate = np.array([r["rate"] for r in report.values()])
    targets = np.array(mixing.targets_of((n @ p).tolist(), mixing.WEIGHTS))
    moved = np.linalg.lstsq(p[rate > 0], 1 - rate[rate > 0], rcond=None)[0]  # rates are those of the least change
    assert np.abs(rate - np.maximum(0, 1 - p @ moved)).max() < 0.02
    assert next(iter(report.values()))["residual"] == pytest.approx(np.abs((n * rate) @ p - targets).max() / n.sum(), abs=1e-6)
    assert all(i in kept for i, r in report.items() if r["rate"] >= 1)


def test_sharding_stage_and_run(spark, tiny, steps):
    rows = steps[5].collect()
    assert {r["doc_id"] for r in rows} == set(texts(steps[4]))
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, tiny).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}
