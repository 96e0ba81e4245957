"""Spelling variants, SimHash near-duplicates and embedding whitening against brute force, planted cases and odd tables."""

import collections
import math
import random
import re
import string
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from quillspark.llm import simhash_bk, spelling, whitening

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
rng = random.Random(5)


def texts(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra).repartition(3)


# --- spelling --------------------------------------------------------------------------------------


def counted(rows):
    out = collections.Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            out[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    s, t = sorted((a, b), key=len)
    return len(t) - len(s) == 1 and any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def brute_variants(rows):
    n = counted(rows)
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def found_variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(df).collect()}


def misspelt(word):
    i, c = rng.randrange(len(word)), rng.choice("abé")
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :], word[:i] + c + word[i:]])


def test_variants_equal_brute_force(spark):
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(40)] + ["aaaaaa", "aaaaaaa"]
    rows = []
    for i in range(300):
        chosen = [rng.choice(base[: 1 + rng.randrange(len(base))]) for _ in range(12)]
        rows.append((i, " ".join(misspelt(w) if rng.random() < 0.4 else rng.choice([w, w.upper()]) for w in chosen) + " 12-x"))
    truth = brute_variants(rows)
    assert found_variants(texts(spark, rows)) == truth
    assert len({v[1] for v in truth.values()}) < len(truth) and any(v[0] and v[1] != v[0] for v in truth.values())


def test_variants_of_odd_tables(spark):
    long = "x" * 20_000
    rows = [(None, "apples apples Apples"), (1, None), (2, ""), (3, "12 ---"), (4, f"{long} {long} {long}"), (5, "apple " * 9), (5, "apple " * 9), (6, "applé " * 3), (7, f"{long}y " * 3)]
    wide = texts(spark, [(*r, "w", 1, "f", 2) for r in rows], ", word string, n int, form string, size int")
    assert found_variants(wide) == brute_variants(rows)
    assert found_variants(texts(spark, [(1, "a")]).limit(0)) == {}


def test_neighbours_are_every_string_one_edit_away():
    alphabet = "abé"
    for word in ("aabba", "ababab", "bbbbb"):
        got = list(spelling.neighbours([word], np.array([ord(c) for c in alphabet], np.uint32), lambda h: np.ones(h.shape, bool)))
        truth = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + d :] for d in (0, 1) for i in range(len(word) + 1 - d) for c in alphabet}
        assert len(got) == len({c for _, c in got}) and {c for _, c in got} == truth - {word}
    hashed = {}
    for w in ("abcde", "edcba", "ab", "ba", "été"):
        hashed[w] = int(spelling.word_hash([w])[0])
    assert len(set(hashed.values())) == 5


# --- simhash ---------------------------------------------------------------------------------------


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, radius=3):
    parent = {i: i for i in range(len(prints))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(prints))]


def documents():
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    rows = []
    for _ in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(1, 400))]
        for _ in range(rng.choice([1, 1, 4])):
            rows.append("  ".join(w) if rng.random() < 0.3 else " ".join(w))
            w = list(w)
            w[rng.randrange(len(w))] = rng.choice(vocab)
    return list(enumerate(rows + [None, "", " \n", "One", "one", "Two words", "été Über x", "ha " * 70_000]))


@pytest.mark.parametrize("most", [simhash_bk.SHARD, 20])
def test_near_duplicates_equal_brute_force(spark, most):
    rows = documents()
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_bk.near_duplicates(texts(spark, [(*r, "n", 1) for r in rows], ", node string, name int"), most=most).collect()}
    prints = [brute_print(t) for _, t in rows]
    groups = brute_groups(prints)
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i, _ in rows}
    assert len(set(groups)) < len(set(prints)) < len(rows)


def test_near_duplicates_without_ids_or_rows(spark):
    got = simhash_bk.near_duplicates(texts(spark, [(None, "a b c d"), (None, None), (4, None), (3, "A b c d"), (3, "A b c d")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got) == [(0, 3), (0, 4), (3, 3), (3, 3), (4, 4)]
    assert simhash_bk.near_duplicates(texts(spark, [(1, "a")]).limit(0)).collect() == []


def test_tree_is_a_bk_tree_and_finds_all_within():
    r = np.random.default_rng(2)
    centres = r.integers(0, 2**64, 40, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (3, 2000), dtype=np.uint64))
    prints = np.unique(np.concatenate([centres[r.integers(0, 40, 2000)] ^ flips, r.integers(0, 2**64, 500, dtype=np.uint64)]))
    tree = simhash_bk.Tree.build(r.permutation(prints))
    assert sorted(tree.prints.tolist()) == prints.tolist()
    assert (np.bitwise_count(tree.prints[1:] ^ tree.prints[tree.above[1:]]) == tree.edge[1:]).all()
    assert len(set(zip(tree.above[1:].tolist(), tree.edge[1:].tolist(), strict=True))) == len(prints) - 1
    for radius in (0, 3, 7):
        got = {(int(q), int(tree.prints[n])) for who, node in tree.within(prints, radius) for q, n in zip(prints[who], node, strict=True)}
        far = np.bitwise_count(prints[:, None] ^ prints[None, :])
        assert got == {(int(prints[i]), int(prints[j])) for i, j in np.argwhere(far <= radius)}
    assert list(simhash_bk.Tree.build(prints[:0]).prints) == []


def test_stars_keep_components():
    for _ in range(50):
        n = rng.randint(1, 30)
        edges = np.array([(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 40))])
        a, b = simhash_bk.stars(edges[:, 0], edges[:, 1])

        def label(pairs):
            parent = list(range(n))

            def find(i):
                while parent[i] != i:
                    i = parent[i]
                return i

            for x, y in pairs:
                lo, hi = sorted((find(x), find(y)))
                parent[hi] = lo
            return [find(i) for i in range(n)]

        assert label(zip(a.tolist(), b.tolist(), strict=True)) == label(edges.tolist()) and len(a) < n


# --- whitening -------------------------------------------------------------------------------------


def exact(vectors):
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    fit = [list(v) for v in {tuple(v) for v in x}]
    n, sums = len(fit), [sum(col) for col in zip(*fit, strict=True)]
    d = len(sums)
    centred = [[n * v[i] - sums[i] for i in range(d)] for v in fit]
    cov = [[Fraction(sum(v[i] * v[j] for v in centred), n**3) for j in range(d)] for i in range(d)]
    return x, n, sums, cov


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_whitening_equals_exact_arithmetic(spark, scale):
    r = np.random.default_rng(7)
    vectors = (r.normal(size=(80, 5)) @ r.normal(size=(5, 5)) * scale).tolist()
    vectors += [vectors[0]] * 30
    rows = list(enumerate(vectors))
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), components=3).toPandas()
    x, n, sums, cov = exact(vectors)
    assert len(got) == 3 * len(rows) and set(got.n) == {n} and n == 80
    deviation = {i: sum((n * v - s) ** 2 for v, s in zip(x[i], sums, strict=True)) for i, _ in rows}
    for r_ in got.itertuples():
        assert deviation[r_.vec_id] < 2**63 and r_.deviation == deviation[r_.vec_id] or deviation[r_.vec_id] >= 2**63 and math.isnan(r_.deviation)
    values, axes = np.linalg.eigh(np.array([[float(v) for v in row] for row in cov]))
    values, axes = values[::-1], axes[:, ::-1]
    for k in range(3):
        mine = got[got.component == k + 1].sort_values("vec_id")
        truth = np.array([[float(Fraction(v) - Fraction(s, n)) for v, s in zip(row, sums, strict=True)] for row in x]) @ axes[:, k] / math.sqrt(values[k])
        sign = np.sign(mine.whitened.values @ truth)
        assert np.allclose(mine.whitened, sign * truth, rtol=1e-9, atol=1e-9)
        assert np.allclose(mine.explained, values[k] / float(sum(cov[i][i] for i in range(5))), rtol=1e-9)
    assert got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1


def test_whitening_of_odd_tables(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -1.0]), (2, None), (3, []), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1e300, 0.0]), (7, [None, 1.0]), (8, [1.0]), (9, [0.5, 7.0])]
    table = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, n int, whitened double").repartition(3)
    got = whitening.whiten(table).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == sorted((i, k) for i in (0, 1, 1, 9) for k in (1, 2)) and {r["n"] for r in got} == {3}
    assert whitening.whiten(table.filter("vec_id = 1")).collect() == []  # one vector has no direction
    assert whitening.whiten(table.filter("vec_id = 2")).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 3.0]) for i in range(10)], "vec_id long, embedding array<double>")
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}


def test_limb_products_are_exact():
    r = np.random.default_rng(3)
    for bits in (3, 21, 40, 57):
        y = r.integers(-(2**bits), 2**bits, (300, 4))
        assert sum(int(v[5, 2]) << (whitening.LIMB * i) for i, v in enumerate(whitening.limbs(y))) == int(y[5, 2])
        big = y.astype(object)
        assert (whitening.gram(y) == big.T.dot(big)).all() and (whitening.exact_sum(y) == big.sum(axis=0)).all()
