"""Corpus operators against brute force, libraries, round trips, and planted cases."""

import collections
import hashlib
import io
import math
import random
import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import components as C
from quillspark.llm import decontaminate as D
from quillspark.llm import mixing, ngram_join, pii_feistel, ppm_score, quality_rules, sharding, substring_dedup, token_counts, warc_zip
from quillspark.llm.hashing import Words, windows

rng = random.Random(11)
VOCAB = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]


def words(n):
    return [rng.choice(VOCAB) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, shared passages, runs of words, upper case."""
    rows = [(i, " ".join(words(rng.randint(1, 160)))) for i in range(60)]
    base = words(200)
    for i in range(60, 90):
        w = list(base)
        for _ in range(i % 9):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        rows.append((i, " ".join(w)))
    rows += [(i, rows[i - 100][1]) for i in range(100, 120)]
    passage = words(70)
    rows += [(i, " ".join(words(20) + passage[i % 7 :] + words(20))) for i in range(120, 135)]
    rows += [(140 + i, "ha " * (40 + i) + "x y z " + "no no " * i) for i in range(25)]
    rows += [(170, "One Two THREE"), (171, "one two three"), (172, None), (173, "")]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


# --- token counts ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def merger():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    return token_counts.PairMerger(token_counts.load_merges(path)), Tokenizer.from_file(path)


PIECES = st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "'s", "'ll", "<|endoftext|>", "é", "漢", "1", "23", ".", "!!", " ", "　", "\x1c", "\x85", "x" * 300])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(PIECES, max_size=14).map("".join), st.text(max_size=40)))
def test_token_counts_equal_the_library(merger, text):
    ours, library = merger
    assert ours.count(text) == len(library.encode(text, add_special_tokens=False).ids)


# --- hashing ---------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t\x1c中", max_size=30)), max_size=8))
def test_words_and_window_hashes(texts):
    found = Words(pa.array(texts, pa.string()), lower=True)
    expect = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for t in texts for w in (t or "").encode().split()]
    assert [bytes(found.data[a:b]) for a, b in zip(found.start, found.end, strict=True)] == expect
    h = found.hashes()
    assert len(set(h.tolist())) == len(set(expect))
    pairs = list(zip(expect, expect[1:], strict=False))
    assert len(set(windows(h, 2).tolist())) == len(set(pairs))


def test_structured_words_do_not_collide(spark):
    """Words over two letters, built so that polynomials modulo 2^64 agree whatever the base."""
    flips = [0]
    while len(flips) < 1024:
        flips += [1 - x for x in flips]
    a, b = "".join("ab"[x] for x in flips), "".join("ba"[x] for x in flips)
    for n in (8, 32, 64, 65, 1024):
        w = Words(pa.array([f"{a[:n]} {b[:n]}"]))
        assert all(len(set(w.hashes(k).tolist())) == 2 for k in (0, 1))
    left, right = [a] + [f"w{i}" for i in range(60)], [b] + [f"w{i}" for i in range(60)]
    assert len({int(windows(Words(pa.array([" ".join(x)])).hashes(), 61)[0]) for x in (left, right)}) == 2
    # each window and each shingle holds one of the two words
    rows = [(i, " ".join(w for k in range(30) for w in (word, f"v{k}"))) for i, word in ((1, a), (2, b))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["n_removed"] for r in substring_dedup.remove_repeats(df).collect()} == {0}
    assert {r["component_id"] for r in ngram_join.groups(df).collect()} == {1, 2}
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    learned = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10)
    got = {r["doc_id"]: r["n_known"] for r in ppm_score.score(spark.createDataFrame([(held, a), (learned, b)], "doc_id long, text string")).collect()}
    assert got == {held: 1, learned: 2}


# --- similarity ------------------------------------------------------------------------------------


def brute_groups(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_ngram_join_equals_brute_force(corpus, size, percent):
    rows, df = corpus
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.groups(df, size, percent).collect()}
    assert got == brute_groups(rows, size, percent)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**63), min_size=1, max_size=300), st.sets(st.integers(0, 2**63), max_size=60))
def test_bitmaps_bound_the_overlap(a, extra):
    x, y = np.array(sorted(a), np.uint64), np.array(sorted(set(list(a)[::2]) | extra), np.uint64)
    differing = sum(int(v).bit_count() for v in (ngram_join.bitmap(x) ^ ngram_join.bitmap(y)).view(np.uint64))
    assert (len(x) + len(y) - differing) / 2 >= len(np.intersect1d(x, y))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(200, 200)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


# --- repeats ---------------------------------------------------------------------------------------


def test_repeats_equal_brute_force(corpus):
    rows, df = corpus
    split = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(split):
        for k in range(len(split[i]) - 49):
            first.setdefault(tuple(split[i][k : k + 50]), i)
    expect = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        expect[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == expect


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([1, 2, 3, 4, 8, 30, 1000]), st.integers(0, 40), st.integers(0, 40), st.integers(50, 90))
def test_equal_windows_are_likely_in_both_texts(seed, alphabet, before, after, size):
    """Each window of a passage that two texts share is compared, whatever surrounds it."""
    r = np.random.default_rng(seed)
    h = r.integers(1, 2**63, alphabet, dtype=np.uint64)
    passage = h[r.integers(0, alphabet, size)]
    if seed % 3 == 0:  # runs and doubled words
        passage = np.repeat(passage, r.integers(1, 5, size))[:size]
    found = []
    for _ in range(2):
        text = np.concatenate([h[r.integers(0, alphabet, before)], passage, h[r.integers(0, alphabet, after)]])
        found.append((len(text), *substring_dedup.kept_symbols(text, np.zeros(len(text), np.int64))))
    shared = np.intersect1d(found[0][1], found[1][1])
    for n, name, start, length, spans, n_spans in found:
        likely = substring_dedup.likely_windows(np.isin(name, shared), start, length, spans, n_spans, n)
        assert likely[before : before + size - 49].all()


# --- scores ----------------------------------------------------------------------------------------


def brute_ppm(rows, order):
    seen = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    wide = lambda t: [256] * order + list(t) + [256]
    for t, held in rows:
        s = wide(t)
        for p in range(order, len(s)) if not held else ():
            for k in range(order + 1):
                seen[k][tuple(s[p - k : p])][s[p]] += 1
    out = []
    for t, _ in rows:
        s, total = wide(t), 0.0
        for p in range(order, len(s)):
            gone: set = set()
            for k in range(order, -1, -1):
                c = {a: b for a, b in seen[k].get(tuple(s[p - k : p]), {}).items() if a not in gone}
                room = sum(c.values()) + len(c)
                if s[p] in c:
                    total += math.log10(c[s[p]] / room)
                    break
                if room:
                    total += math.log10(len(c) / room)
                gone |= set(c)
            else:
                total -= math.log10(257 - len(gone))
        out.append(total)
    return out


def test_ppm_equals_brute_force(corpus):
    rows, df = corpus
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    low = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()) for _, t in rows]
    count = collections.Counter(w for t, h in zip(low, held, strict=True) if not h for w in t.split())
    ends = held.count(False)
    n, v = sum(count.values()) + ends, len(count) + 1
    log = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    scores = brute_ppm(list(zip(low, held, strict=True)), ppm_score.ORDER)
    got = {r["doc_id"]: r for r in ppm_score.score(df).collect()}
    for (i, _), t, h, s in zip(rows, low, held, scores, strict=True):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, len(t.split()) + 1, sum(count[w] > 0 for w in t.split()) + 1, n)
        assert r["score"] == pytest.approx(s) and r["base_score"] == pytest.approx(sum(log(count[w]) for w in t.split()) + log(ends))


def test_code_lengths_are_a_distribution():
    """Over all symbols after one context, probabilities sum to 1."""
    text = np.frombuffer(b"abracadabra alakazam", np.uint8)
    g, _ = ppm_score.grams(text, np.array([0, len(text)]), 3)
    keys, counts = np.unique(g, return_counts=True)
    low = ppm_score._sums(keys & ((1 << 18) - 1), counts)
    for context in np.unique(keys >> 9)[:12]:
        asked = (context << 9) | np.arange(257)
        every = np.union1d(keys, asked)
        n = np.zeros(len(every), np.int64)
        n[np.searchsorted(every, keys)] = counts
        logs = ppm_score.code_lengths(every, n, 3, low)
        assert (10 ** logs[np.isin(every, asked)]).sum() == pytest.approx(1)


# --- quality ---------------------------------------------------------------------------------------


def test_quality_counts_equal_brute_force(corpus):
    for _, text in corpus[0]:
        m, w = quality_rules.measure(text), (text or "").encode().split()
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        marked = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        assert (m["n_words"], m["n_repeat_words"]) == (len(w), len(marked))
        assert m["word_chars"] == len(re.sub(r"[\x20\x09-\x0d]", "", text or ""))
    m = quality_rules.measure("a b\n\na b\nc#$\n a b")
    assert (m["n_dup_lines"], m["n_symbols"]) == (1, 2)


def test_em_recovers_planted_accuracies():
    r = np.random.default_rng(3)
    good = r.random(20_000) < 0.85
    pattern, truth = [], []
    for y in good:
        pattern.append("".join("-" if r.random() < (0.01 if y else 0.7) else "+" for _ in range(5)))
        truth.append(y)
    post = quality_rules.fit(collections.Counter(pattern))
    assert np.mean([(post[p] >= 0.5) == y for p, y in zip(pattern, truth, strict=True)]) > 0.99


def test_quality_verdicts_agree_with_labels(spark, tiny):
    docs, labels = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.judge(docs).filter("not base_failed").join(labels.filter("toxic = 0"), "doc_id").collect()
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1]) > 0.97


# --- mixing ----------------------------------------------------------------------------------------


def brute_rates(n, p, weights, steps=60_000, limit=np.inf):
    """Rates by many small projected gradient steps, one document a number, and the targets."""
    have = n @ p
    targets = mixing.targets_of(have.tolist(), weights)
    moved = np.zeros(3)
    for _ in range(steps):
        moved = np.clip(moved + 0.5 * ((n * np.maximum(0, 1 - p @ moved)) @ p - targets) / have.sum(), -limit, limit)
    return np.maximum(0, 1 - p @ moved), np.array(targets)


def test_rates_meet_targets_and_brute_force(spark):
    r = np.random.default_rng(5)
    n, p = r.integers(1, 500, 400), r.dirichlet([0.6, 0.3, 0.2], 400)
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n long, p array<double>")
    for weights in ({"low": 0.2, "toxic": 0.12}, {"low": 0.15}, {"toxic": 0.01}, {"low": 0.9, "toxic": 0.9}, {"good": 0.6, "low": 0.3, "toxic": 0.1}, {}):
        for limit in (None, 1.5):
            fit = mixing.fit_rates(rows, weights, tolerance=1e-9, limit=limit)
            got = np.array([x[0] for x in rows.select(mixing.rate_of(fit["moved"])).collect()])
            targets = np.array(fit["targets"])
            assert (got >= 0).all() and np.allclose((n * got) @ p, fit["reached"]) and np.allclose(targets, mixing.targets_of((n @ p).tolist(), weights))
            if limit:
                expect, _ = brute_rates(n, p, weights, limit=limit)
                within = np.abs(fit["moved"]) < limit
                assert np.allclose(got, expect, atol=1e-3) and np.allclose(np.array(fit["reached"])[within], targets[within], rtol=0.01)
            else:
                assert np.allclose(fit["reached"], targets, rtol=0.01, atol=1e-3 * n.sum()) and np.allclose(got, np.maximum(0, 1 - p @ np.array(fit["moved"])))


def test_targets_out_of_reach_give_the_nearest_rates(spark):
    rows = spark.createDataFrame([(100, [0.5, 0.3, 0.2])] * 5, "n long, p array<double>")
    fit = mixing.fit_rates(rows, {"good": 0.9, "low": 0.05, "toxic": 0.05})
    t, q = np.array(fit["targets"]), 500 * np.array([0.5, 0.3, 0.2])
    least = np.linalg.norm(q * (q @ t) / (q @ q) - t)
    assert fit["residual"] > 0.05 and np.linalg.norm(np.array(fit["reached"]) - t) < 1.1 * least
    assert all(abs(m) <= 1.5 for m in mixing.fit_rates(rows, {"good": 0.9, "low": 0.05, "toxic": 0.05}, limit=1.5)["moved"])
    assert mixing.fit_rates(rows.limit(0), {"toxic": 0.1})["residual"] == 0


def test_labels_of_one_domain_do_not_crash(spark, tiny):
    docs, labels = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "labels"))
    for column, value in (("toxic", 1), ("toxic", 0)):
        got = mixing.mix_report(docs, labels.withColumn(column, F.lit(value)).withColumn("quality", F.lit(1))).toPandas()
        assert len(got) == docs.count() and (got.rate >= 0).all() and got.residual.nunique() == 1


def test_default_targets_are_met(spark, tiny):
    docs, labels = (spark.read.parquet(f"{tiny.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = mixing.mix_report(docs, labels).toPandas()
    reached = np.array([(got.n_tokens * got.rate * got[f"p_{d}"]).sum() for d in mixing.DOMAINS])
    assert got.residual.max() <= mixing.TOLERANCE and np.allclose(reached[1:] / reached.sum(), 0.01, rtol=0.02)


def test_labelled_classifier_end_to_end(spark, tiny):
    """On held-out labels: calibrated, soft, and telling toxic from clean; rates meet each target."""
    docs, labels = (spark.read.parquet(f"{tiny.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    report = mixing.mix_report(docs, labels.filter("doc_id % 3 <> 0"))
    rows = report.join(labels, "doc_id", "left").collect()
    n, p = np.array([r["n_tokens"] for r in rows]), np.array([[r["p_good"], r["p_low"], r["p_toxic"]] for r in rows])
    rate = np.array([r["rate"] for r in rows])
    expect, targets = brute_rates(n, p, mixing.WEIGHTS)
    assert np.allclose(rate, expect, atol=0.01) and np.allclose((n * rate) @ p, targets, rtol=0.01)
    assert np.allclose(p.sum(axis=1), 1) and len(np.unique(p[:, 2].round(6))) > 0.9 * len({r["n_tokens"] for r in rows})
    held = [r for r in rows if r["quality"] is not None and r["doc_id"] % 3 == 0]
    for domain, of in (("p_toxic", lambda r: r["toxic"] == 1), ("p_low", lambda r: not r["toxic"] and r["quality"] == 0)):
        assert abs(sum(r[domain] for r in held) / sum(map(of, held)) - 1) < 0.15
    toxic = [r for r in held if r["toxic"] == 1 and r["quality"] == 1]
    clean = [r for r in held if r["toxic"] == 0 and r["quality"] == 1]
    assert np.mean([r["p_toxic"] > 0.5 for r in toxic]) > 0.88 and np.mean([r["p_toxic"] > 0.5 for r in clean]) < 0.02
    assert np.mean([r["kept"] for r in toxic]) < 0.15 and np.mean([r["kept"] for r in clean]) > 0.97


def test_scores_of_a_text_equal_brute_force(spark):
    """Measures, regression and softmax by plain Python, for a made-up model."""
    texts = ["alpha beta, beta gamma", "delta!! delta", None, "", "Alpha."]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    number = {w: spark.range(1).select(mixing._bucket(F.lit(w))).first()[0] for w in ("alpha", "beta", "delta!!", "delta", "\t0 0", "\t0 2", "\t0 20")}
    odds = {number["alpha"]: (1.0, -2.0), number["beta"]: (0.5, 3.0), number["delta!!"]: (-1.0, 0.25)}
    weights = [[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8], [-0.1, 0.3, -0.2, 0.1, 0.2, -0.3, 0.4, 0.5]]
    got = df.select(mixing.scored({"odds": odds, "weights": weights}, F.col("text")).alias("s")).select("s.*").collect()
    for text, row in zip(texts, got, strict=True):
        ws = [w for w in re.split(r"[\s.,;:?]+", (text or "").lower()) if w]
        hits = [odds[number[w]] for w in dict.fromkeys(ws) if w in number and number[w] in odds]
        z = [1, sum(h[0] for h in hits) / 10, sum(h[1] for h in hits) / 10, max([0, *(h[0] for h in hits)]), max([0, *(h[1] for h in hits)])]
        z += [math.log1p(sum(h[k] > mixing.TELLING for h in hits)) for k in (0, 1)] + [math.log1p(len(ws)) / 5]
        e = [1.0] + [math.exp(sum(a * b for a, b in zip(w, z, strict=True))) for w in weights]
        assert row["n"] == len(ws) and row["p"] == pytest.approx([x / sum(e) for x in e])


def test_regression_is_at_its_optimum(spark):
    r = np.random.default_rng(8)
    z = np.c_[np.ones(600), r.normal(size=(600, 7))]
    truth = r.normal(size=(2, 8))
    logs = np.c_[np.zeros(600), z @ truth.T]
    y = np.array([r.choice(3, p=np.exp(q) / np.exp(q).sum()) for q in logs])
    w = np.array(mixing._regress(spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(y, z, strict=True)], "y int, z array<double>")))
    logs = np.c_[np.zeros(600), z @ w.T]
    p = np.exp(logs) / np.exp(logs).sum(axis=1, keepdims=True)
    assert np.abs((p - np.eye(3)[y])[:, 1:].T @ z + mixing.RIDGE * w).max() < 1e-2


# --- sharding --------------------------------------------------------------------------------------


def test_shards_are_even_whole_and_gapless(spark):
    rows = [(i, "t" * (i % 700) + str(i)) for i in range(4000)] + [(10_000 + i, "same text " * 20) for i in range(300)]
    got = sharding.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    load, slots, homes = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[(r["text_crc32"], r["size"])].add(r["shard"])
        text = dict(rows)[r["doc_id"]]
        assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text.encode()))
    assert sorted(load) == list(range(8)) and max(load.values()) < 1.01 * sum(load.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())


def test_a_group_larger_than_a_shard_is_dealt_out(spark):
    rows = [(i, "hot " * 50) for i in range(1000)] + [(5000 + i, "cold %d " % i * 30) for i in range(1500)]
    load = collections.Counter()
    for r in sharding.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        load[r["shard"]] += r["size"]
    assert max(load.values()) < 1.1 * sum(load.values()) / 8


def test_shards_equal_brute_force_on_uneven_keys(spark):
    """Keys that crowd in one corner of the key space: splitters are refined until each meets the tolerance."""
    r = np.random.default_rng(6)
    keys = sorted({int(x) for x in np.concatenate([r.integers(0, 1 << 20, 3000), r.integers(-(2**63), 2**63 - 1, 300)])})
    size = {k: int(r.integers(1, 900)) for k in keys}
    frame = spark.createDataFrame([(k, size[k]) for k in keys], "_key long, _size long")
    total = sum(size.values())
    targets = [total * i / 8 for i in range(1, 8)]
    for target, b in zip(targets, sharding.find_splitters(frame, targets, 0.002 * total / 8), strict=True):
        below = sum(n for k, n in size.items() if k < b)
        best = min(abs(sum(n for k, n in size.items() if k < c) - target) for c in keys)
        assert abs(below - target) <= max(0.002 * total / 8, best) + 1e-6


def test_columns_called_like_new_ones_stay(spark):
    rows = spark.createDataFrame([(1, "a b", 7, "x", "r", 3), (None, None, 8, "y", "s", 4)], "doc_id long, text string, size int, Shard string, row string, _key int")
    out = sharding.assign(rows)
    assert out.columns == ["doc_id", "text", "size", "Shard", "row", "_key", "size_", "text_crc32", "law", "shard_", "slot", "grown_shard"]
    got = {r["size"]: (r["Shard"], r["row"], r["_key"], r["size_"], r["text_crc32"], r["slot"] >= 0) for r in out.collect()}
    assert got == {7: ("x", "r", 3, 4, zlib.crc32(b"a b"), True), 8: ("y", "s", 4, 1, 0, True)}


# --- pseudonyms ------------------------------------------------------------------------------------


def test_pseudonyms_keep_format_and_links(spark):
    texts = [
        "card 4565410125667261, 4565-4101-2566-7261 or 4565410125667262",
        "call +1 (383) 555-6083 or 383-555-6083; ssn 123-45-6789, not 000-12-1234",
        "ip 82.43.185.109 and 999.1.1.1; on 2024-02-29, 29.02.2024, 2023-02-30",
        "GB82 WEST 1234 5698 7654 32 or DE89370400440532013000; Ann.Lee7@mail.example.com",
        "clean text with 12 words and no data at all, v1.2.3, 3.14",
    ]
    got = [r["text"] for r in pii_feistel.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    cards = re.findall(r"[0-9-]{16,}", got[0])
    assert cards[0] == cards[1].replace("-", "") != "4565410125667261" and cards[2] == "4565410125667262"
    assert sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(cards[0]))) % 10 == 0
    a, b = re.search(r"\+1 \((\d{3})\) (\d{3}-\d{4}) or (\d{3}-\d{3}-\d{4})", got[1]).group(1, 2)
    assert f"{a}-{b}" in got[1].split(" or ")[1] and a[0] in "23456789" and "000-12-1234" in got[1] and "123-45-6789" not in got[1]
    assert "999.1.1.1" in got[2] and "2023-02-30" in got[2] and "82.43.185.109" not in got[2]
    iso = re.search(r"on (\d{4})-(\d\d)-(\d\d), (\d\d)\.(\d\d)\.(\d{4})", got[2]).groups()
    assert iso[:3] == (iso[5], iso[4], iso[3]) and iso[:3] != ("2024", "02", "29")
    for iban in re.findall(r"[A-Z]{2}\d\d[ A-Z0-9]{18,}\d", got[3]):
        v = iban.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1
    assert re.search(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}\d@mail\.example\.com$", got[3]) and "Ann.Lee7" not in got[3]
    assert got[4] == texts[4]


def test_pair_network_is_a_permutation(spark):
    df = spark.range(0, 189 * 773, 1).select(pii_feistel.pair_feistel(F.floor(F.col("id") / 773), F.pmod("id", F.lit(773)), 189, 773, "k", lambda x, y: x * 773 + y).alias("v"))
    r = df.agg(F.countDistinct("v"), F.min("v"), F.max("v")).first()
    assert tuple(r) == (189 * 773, 0, 189 * 773 - 1)


def test_components_go_through_classes_without_ids(spark, monkeypatch):
    a, b, c = (" ".join(f"{k}word{i}" for i in range(30)) for k in "abc")
    docs = spark.createDataFrame([(None, a), (5, b), (3, c), (3, c), (9, "alone here in the world")], "doc_id long, text string")

    def through_a(docs, size, percent, counts, names):
        by = {r["name"]: r["cls"] for r in names.collect()}
        return spark.createDataFrame([(by[None], by[5]), (by[None], by[3])], "a long, b long")

    monkeypatch.setattr(ngram_join, "linked_classes", through_a)
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.groups(docs).collect()}
    assert got == {(None, 3), (5, 3), (3, 3), (9, 9)}
    assert sorted(r["doc_id"] or 0 for r in ngram_join.keep_one(docs).collect()) == [0, 3, 3, 9]


# --- decontamination -------------------------------------------------------------------------------


def test_items_cut_at_both_ends_are_found_between_other_texts():
    items = [" ".join(f"item{k}word{i}" for i in range(20)) for k in range(40)]
    block = D.Items(list(range(40)), items)
    texts = []
    for k in range(40):
        texts += [" ".join(words(60)), " ".join(items[k].split()[1:-1])]
    found = block.search(pa.array([*texts, " ".join(words(60))]))
    assert {(r, k, d) for r, k, d, _ in found} == {(2 * k + 1, k, 2) for k in range(40)}


def test_edited_items_are_found_and_clean_texts_left():
    items = [" ".join(words(rng.randint(12, 50))) for _ in range(60)]
    block = D.Items(list(range(60)), items)
    texts, truth = [], []
    for _ in range(300):
        k = rng.randrange(60)
        w = items[k].split()
        for _ in range(rng.randint(0, D.allowed_edits(len(w)))):
            at, kind = rng.randrange(len(w)), rng.random()
            if kind < 0.4:
                w[at] = "zz%d" % rng.randrange(10**6)
            elif kind < 0.7:
                del w[at]
            else:
                w.insert(at, "yy%d" % rng.randrange(10**6))
        texts.append(" ".join(words(rng.randint(0, 60)) + w + words(rng.randint(0, 60))))
        truth.append(k)
    found = collections.defaultdict(set)
    for row, k, *_ in block.search(pa.array(texts)):
        found[row].add(k)
    assert np.mean([t in found[i] for i, t in enumerate(truth)]) >= 0.98
    assert block.search(pa.array([" ".join(words(200)) for _ in range(100)])) == []


def plant(item, kind):
    """A copy of an item (words) with as many edits as are allowed: anywhere, cut at both ends, or both."""
    w, left = list(item), D.allowed_edits(len(item))
    if kind != "edits":
        cut = left if kind == "cut" else left // 2
        head = rng.randint(0, cut)
        w, left = w[head : len(w) - (cut - head)], left - cut
    for _ in range(left):
        at, how = rng.randrange(len(w)), rng.random()
        if how < 0.4:
            w[at] = rng.choice(VOCAB)
        elif how < 0.7:
            del w[at]
        else:
            w.insert(at, rng.choice(VOCAB))
    return w


@pytest.mark.parametrize("kind", ["edits", "cut", "both"])
def test_recall_against_brute_force(kind):
    """Every document against every item by exact edit distance; documents stand side by side in one batch."""
    items = [words(rng.randint(12, 60)) for _ in range(40)]
    block = D.Items(list(range(40)), [" ".join(w) for w in items])
    docs = [(plant(items[i % 40], kind) if i % 3 else []) + (words(rng.randint(0, 40)) if i % 2 else []) for i in range(150)]
    number = {w: i for i, w in enumerate(VOCAB)}
    code = lambda ws: np.array([number[w] for w in ws], np.int64)
    truth = {(i, k): d for i, w in enumerate(docs) for k, item in enumerate(items) if (d := D.edit_distance(code(item), code(w))[0]) <= D.allowed_edits(len(item))}
    found = {(r, k): d for r, k, d, _ in block.search(pa.array([" ".join(w) for w in docs]))}
    assert len(truth) >= 90 and set(found) <= set(truth)
    assert np.mean([t in found for t in truth]) >= 0.98 and all(found[t] == truth[t] for t in found)
    alone = {(i, k): d for i, w in enumerate(docs) for _, k, d, _ in block.search(pa.array([" ".join(w)]))}
    assert alone == found


def test_items_of_all_sizes_are_found():
    sizes = [1, 2, 3, 4, 5, 7, 9, 11, 12, 15, 16, 17, 400, 5000]
    items = [[f"s{n}w{i}" for i in range(n)] for n in sizes]
    block = D.Items(list(range(len(sizes))), [" ".join(w) for w in items])
    texts = [" ".join(w[D.allowed_edits(len(w)) :]) for w in items] + ["x " + " ".join(w) + " y" for w in items]
    assert {(r, k) for r, k, *_ in block.search(pa.array(texts))} == {(r, r % len(sizes)) for r in range(len(texts))}
    with pytest.raises(ValueError, match="recall"):
        D.MAX_WALKS, keep = 0, D.MAX_WALKS
        try:
            D.Items([1], ["a b c"])
        finally:
            D.MAX_WALKS = keep


def test_edit_distance_equals_brute_force():
    for _ in range(200):
        a, b = [rng.randrange(4) for _ in range(rng.randint(1, 8))], [rng.randrange(4) for _ in range(rng.randint(0, 12))]

        def full(x, y):
            row = list(range(len(y) + 1))
            for i, c in enumerate(x, 1):
                new = [i]
                for j, d in enumerate(y, 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
                row = new
            return row[-1]

        expect = min(full(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert D.edit_distance(np.array(a), np.array(b, int))[0] == expect


# --- archives --------------------------------------------------------------------------------------


@pytest.mark.parametrize("zip64", [False, True])
def test_archives_read_like_the_library(zip64):
    writer = warc_zip.ArchiveWriter()
    for i in range(20):
        body = f"<p>{i}</p>".encode() * 50
        writer.add(i, warc_zip.make_record(i, f"http://x/{i}", body, len(body), hashlib.sha1(body).hexdigest(), None))
    data = writer.bytes(zip64)
    directory = warc_zip.ZipDirectory(lambda at, n: data[at : at + n], len(data))
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for name in archive.namelist():
            at, n = directory.stored(name)
            assert data[at : at + n] == archive.read(name)
    base, _ = directory.stored(warc_zip.DATA)
    entry = writer.index[7]
    record = warc_zip.parse_record(data[base + entry["offset"] : base + entry["offset"] + entry["length"]])
    assert (record["page_id"], record["payload"]) == (7, b"<p>7</p>" * 50)


def test_zip64_end_record_is_followed():
    """An archive whose end record defers to ZIP64 for count, size and offset."""
    import struct

    writer = warc_zip.ArchiveWriter()
    writer.add(1, warc_zip.make_record(1, "u", b"p", 1, hashlib.sha1(b"p").hexdigest(), None))
    data = writer.bytes()
    at = data.rfind(warc_zip.EOCD)
    count, size, offset = struct.unpack_from("<HII", data, at + 10)
    record = warc_zip.EOCD64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, size, offset)
    locator = warc_zip.LOCATOR64 + struct.pack("<IQI", 0, at, 1)
    end = warc_zip.EOCD + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    big = data[:at] + record + locator + end
    found = warc_zip.ZipDirectory(lambda a, n: big[a : a + n], len(big))
    assert set(found.members) == {warc_zip.DATA, warc_zip.INDEX, warc_zip.PACKAGE}
