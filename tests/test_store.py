"""The derived store, mentions, batched neighbours, title lookup, semantic chunks: against brute force and planted cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import embedder
from quillspark.operators import chunking, lexical, links, lookup, mentions, segments, vectors
from quillspark.operators.commits import CommitLog, Conflict
from quillspark.plans import ingest
from quillspark.plans.library import Library
from quillspark.plans.retrieval import Corpus, title_lookup, title_slugs

WIKI = "doc_type string, path string, title string, body string, mtime long"


def page(stem, body, mtime=1):
    return ("wiki", f"wiki/{stem}.md", stem.title(), body, mtime)


def outcomes(report):
    return {r["path"]: r["outcome"] for r in report.collect()}


@pytest.fixture
def store(spark, tmp_path):
    made = Library(spark, f"file://{tmp_path}/store")
    made.commit(spark.createDataFrame([page("a", "alpha words\nsee [[b]]"), page("b", "beta words"), page("copy", "beta words"), page("c", "gamma")], WIKI))
    return made


def state_of(lib):
    docs = {r["path"]: r["hash"] for r in lib.documents().collect()}
    bodies = {r["hash"]: r["body"] for r in lib.live("bodies").collect()}
    assert set(docs.values()) == set(bodies)  # no garbage, nothing lost
    built = chunking.line_chunks(lib.live("bodies"))
    assert {tuple(r) for r in lib.live("chunks").select("hash", "seq", "chunk_text").collect()} == {tuple(r) for r in built.select("hash", "seq", "chunk_text").collect()}
    truth = lexical.LexicalIndex.build(built, "chunk_text", ["hash", "seq"])
    index = lib.index()
    assert index.stats[0] == truth.stats[0] and index.stats[1] == pytest.approx(truth.stats[1])
    for text in ("words", "beta -again", '"alpha words"', "one"):
        got = {(r["hash"], r["seq"]): round(r["raw"], 9) for r in lexical.search(index, text).collect()}
        assert got == {(r["hash"], r["seq"]): round(r["raw"], 9) for r in lexical.search(truth, text).collect()}
    counted = {r["hash"]: r["n"] for r in lib.refs().groupBy("hash").agg(F.sum("refs").alias("n")).filter("n <> 0").collect()}
    assert counted == {h: list(docs.values()).count(h) for h in docs.values()}
    return docs, bodies


def test_commits_guards_and_refusals(spark, store):
    docs, _ = state_of(store)
    guarded = "doc_type string, path string, title string, body string, mtime long, base string, force boolean"
    rows = [
        (*page("a", "alpha words again", 2), docs["wiki/a.md"], None), (*page("b", "beta", 2), "0" * 64, None), (*page("c", "gamma rays", 2), "0" * 64, True),
        (*page("new", "one", 2), "", None), (*page("copy", "beta words", 2), "", None), (*page("new", "zero", 1), "", None),
    ]
    got = outcomes(store.commit(spark.createDataFrame(rows, guarded)))
    assert got == {"wiki/a.md": "updated", "wiki/b.md": "conflict", "wiki/c.md": "updated", "wiki/new.md": "inserted", "wiki/copy.md": "conflict"}
    docs, bodies = state_of(store)
    assert bodies[docs["wiki/new.md"]] == "one" and bodies[docs["wiki/b.md"]] == "beta words"
    store.commit(spark.createDataFrame([("raw", "raw/x", "x", "source text", 1), page("p", "to [[new]]")], WIKI).withColumn("sources", F.when(F.col("doc_type") == "wiki", F.array(F.lit("raw/x")))))
    gone = [("wiki", "wiki/new.md", None), ("raw", "raw/x", None), ("wiki", "wiki/none.md", None), ("wiki", "wiki/b.md", "0" * 64), ("wiki", "wiki/copy.md", None)]
    assert outcomes(store.commit(delete=spark.createDataFrame(gone, "doc_type string, path string, base string"))) == {
        "wiki/new.md": "backlinked", "raw/x": "referenced", "wiki/none.md": "absent", "wiki/b.md": "conflict", "wiki/copy.md": "deleted",
    }
    docs, bodies = state_of(store)
    assert "beta words" in bodies.values()  # the other page still has it
    forced = spark.createDataFrame([("raw", "raw/x", True), ("wiki", "wiki/new.md", True), ("wiki", "wiki/b.md", False)], "doc_type string, path string, force boolean")
    assert set(outcomes(store.commit(delete=forced)).values()) == {"deleted"}
    docs, bodies = state_of(store)
    assert "beta words" not in bodies.values() and set(docs) == {"wiki/a.md", "wiki/c.md", "wiki/p.md"}


def test_random_commits_equal_a_rebuild(spark, store):
    rng = random.Random(4)
    for turn in range(6):
        rows = [page(s, rng.choice(["beta words", "one more", f"body {turn}", "", "alpha words\n\nbeta again"]), 10 + turn) for s in rng.sample("abcdefgh", 3)]
        gone = [("wiki", f"wiki/{s}.md", True) for s in rng.sample("abcdefgh", 2)]
        store.commit(spark.createDataFrame(rows, WIKI), spark.createDataFrame(gone, "doc_type string, path string, force boolean"))
    docs, _ = state_of(store)
    assert len(store.state["segments"]) < 7  # small segments were merged
    store.rechunk(chunking.line_chunks, lambda chunks: chunks.select("hash", "seq", F.array(F.lit(1.0)).alias("embedding")), "m2")
    assert state_of(store)[0] == docs and len(store.state["segments"]) == 1 and store.state["graves"] == []
    assert store.live("vectors").count() == store.live("chunks").count() and store.documents().filter("embed_model = 'm2'").count() == len(docs)
    assert store.vacuum() > 0 and state_of(store)[0] == docs
    pages = store.with_bodies().filter("path <> 'wiki/a.md'").limit(2)
    kept = {r["path"] for r in pages.collect()}
    store.rebuild(pages)
    assert set(state_of(store)[0]) == kept


def test_one_of_two_writers_gets_a_conflict(spark, store):
    other = Library(spark, store.root)
    store.commit(spark.createDataFrame([page("a", "first", 5)], WIKI), tables={"jobs": spark.createDataFrame([("j1", "done")], "job_id string, status string")})
    with pytest.raises(Conflict):
        other.commit(spark.createDataFrame([page("a", "second", 5)], WIKI))
    again = Library(spark, store.root)
    assert again.version == 2 and again.table("jobs").count() == 1 and "first" in {r["body"] for r in again.live("bodies").collect()}
    assert Library(spark, store.root, version=1).documents().count() == 4
    assert CommitLog(spark, f"{store.root}/nothing").last() == (0, {})
    assert segments.live(spark, store.root, {}, "chunks").count() == 0


def test_names_of_any_length_are_found(spark):
    rows = [
        ("the-long-road-to-rome", "The Long Road to Rome and Back", "x"), ("c-plus", "C++", "uses C++ daily"), ("über", "Über", "nothing"), ("k", "", ""),
        ("one", "One", "we took the long road to ROME, über alles; none [[über]] c plus"), ("two", "Two", "the long road to romeo; überall C++x the long road to rome and back"),
    ]
    table = spark.createDataFrame(rows, "stem string, title string, body string")
    solid = r"[^\W]"
    truth = set()
    for s, _, b in rows:
        for d, t, _ in rows:
            for name in filter(None, (t, d.replace("-", " "))):
                first, last = (r"(?<!\w)" if re.match(solid, name[0]) else r"(?<=\w)"), (r"(?!\w)" if re.match(solid, name[-1]) else r"(?=\w)")
                if s != d and re.search(first + re.escape(name) + last, b, re.IGNORECASE) and f"[[{d}]]" not in b:
                    truth.add((s, d))
    for block in (mentions.BLOCK_BYTES, 1, 40):
        assert {tuple(r) for r in links.missing(table, links.names_of(table), block=block).collect()} == truth
    assert ("one", "the-long-road-to-rome") in truth and ("two", "c-plus") in truth and ("one", "über") not in truth
    assert links.missing(table, links.names_of(table).limit(0)).collect() == []


def test_sweep_rewrites_as_one_by_one():
    rng = random.Random(3)
    bits = ["ab", "a", "b", "aa", "ba b", "K", "k", "İ", "i", "ſ", "s", "ß", "[[", "x]]", "]", "-", "é", "É", "Ab C"]
    for turn in range(4000):
        body = "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 25)))
        chosen = bits if turn % 9 == 0 else [b for b in bits if not set("[]") & set(b)]
        targets = {rng.choice(["a-b", "k-s", "x-y", "ab-c", "i-i"]) + str(rng.randint(0, 3)): "".join(rng.choice(chosen) + rng.choice(["", " "]) for _ in range(rng.randint(0, 3))) for _ in range(5)}
        ordered = sorted(targets.items(), key=lambda p: (-len(p[1].encode()), p[0]))
        assert mentions.Sweep(ordered).link(body, "a-b0") == links.link_forward(body, ordered, "a-b0")


def test_best_of_each_task_with_ties_and_zeros():
    r = np.random.default_rng(0)
    m = r.normal(size=(40, 8)).astype(np.float32)[r.integers(0, 40, 3000)]
    m[5] = 0
    ids, q = r.permutation(3000), r.normal(size=(30, 8))
    q[3], q[4] = 0, m[7]
    best = vectors.Best(q, 7)
    for i in range(0, 3000, 700):
        best.add(pa.array([f"h{x:05d}" for x in ids[i : i + 700]]), pa.array(ids[i : i + 700] % 3), pa.array(list(m[i : i + 700])))
    got = best.rows()
    for k in range(30):
        size = np.sqrt((m.astype(float) ** 2).sum(1)) * np.sqrt((q[k] ** 2).sum())
        score = np.where(size > 0, (m.astype(float) * q[k]).sum(1) / np.where(size > 0, size, 1), 0)
        assert got[got.q == k]["hash"].tolist() == [f"h{ids[i]:05d}" for i in np.lexsort((ids, -score))[:7]]


def test_knn_join_of_odd_rows(spark):
    vecs = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 0, [1.0, 0.0]), ("c", 1, [0.0, 0.0]), ("d", 0, None), ("e", 0, [1.0])], "hash string, seq int, embedding array<float>")
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [5.0])], "qid long, probe array<float>")
    rows = {(r["qid"], r["hash"], r["rank"], r["score"]) for r in vectors.knn_join(asked.filter("qid > 1 or probe[0] > 0"), vecs, 2).collect()}
    assert rows == {(1, "a", 1, 1.0), (1, "b", 2, 1.0), (3, "e", 1, 1.0)}
    assert vectors.knn_join(asked.limit(0), vecs, 2).collect() == []


def test_mean_pooling_equals_a_fold(spark):
    rows = [(1, [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], [1, 0, 1]), (2, [[1.0, 2.0]], [0]), (3, None, None), (4, [], []), (5, [[1.5, None]], [1, 1, 1]), (6, [[1.0, 1.0], [2.0, 2.0]], [1])]
    got = {r["k"]: r["pooled"] for r in vectors.mean_pool(spark.createDataFrame(rows, "k int, tokens array<array<float>>, mask array<int>").repartition(2), "k").collect()}
    assert got == {1: [3.0, 4.0], 2: [0.0, 0.0], 3: None, 4: None, 5: [1.5, 0.0], 6: [1.0, 1.0]}


def test_titles_are_looked_up_together(spark):
    docs = spark.createDataFrame(
        [(i, "wiki" if i < 40 else "raw", f"wiki/page-{i}.md" if i < 40 else f"raw/{i}", t, f"h{i}", 1, 1) for i, t in enumerate(["auth migration", "auth service", "auth-tokens guide", "unique heron"] + [f"filler {k}" for k in range(36)] + ["auth raw"])],
        "doc_id long, doc_type string, path string, title string, hash string, size long, mtime long",
    )
    vecs = docs.select("hash", F.lit(0).alias("seq"), F.when(F.col("doc_id") <= 1, F.array(F.col("doc_id") * 2.0 - 1.0, F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).cast("array<float>").alias("embedding"))
    corpus = Corpus(docs, docs.limit(0), vecs, docs.select("doc_id", F.lit("default").alias("name")))
    asked = spark.createDataFrame([(1, "unique heron"), (2, "auth"), (3, "nothing here"), (4, ""), (5, None), (6, '"auth tokens"'), (7, "auth -migration"), (8, "auth")], "tid long, title string")
    probe = lambda t: t.withColumn("probe", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"))
    got = {r["tid"]: r["slug"] for r in title_slugs(corpus, asked, probe).collect()}
    assert got == {1: "page-3", 2: "page-1", 3: None, 4: None, 5: None, 6: "page-2", 7: "page-1", 8: "page-1"}
    assert title_lookup(corpus, "heron") == "page-3" and title_lookup(corpus, "zebra") is None
    many = lexical.search_many(lexical.LexicalIndex.build(docs, "title", ["doc_id"]), asked.select(F.col("title").alias("query")))
    index = lexical.LexicalIndex.build(docs, "title", ["doc_id"])
    for text in ("auth", '"auth tokens"', "auth -migration", "filler"):
        assert {(r["doc_id"], round(r["raw"], 9)) for r in lexical.search(index, text).collect()} == {(r["doc_id"], round(r["raw"], 9)) for r in many.filter(F.col("query") == text).collect()} or text == "filler"


def twin(text, title, limit):
    """The semantic stage written out plainly."""
    count = lambda t: len(t.split())
    out = []
    for s in chunking.sections(text):
        body = s["text"]
        spans = [m.span() for m in chunking.SENTENCE.finditer(body) if m[0].strip()]
        groups = ["".join(body[a:b] for a, b in spans[max(0, i - 1) : i + 2]) for i in range(len(spans))]
        edges = [0, len(body)] if spans else []
        if len(spans) > 1 and all(count(g) <= limit for g in groups):
            vecs = [embedder.embed(g) for g in groups]
            far = []
            for a, b in zip(vecs[:-1], vecs[1:], strict=True):
                na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
                far.append(1 - (sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb) if na * nb else 0))
            ranked, h = sorted(far), 0.95 * (len(far) - 1)
            lo = int(h)
            cut = ranked[lo] + (h - lo) * (ranked[min(lo + 1, len(far) - 1)] - ranked[lo])
            edges = [spans[0][0]] + [spans[i + 1][0] for i, d in enumerate(far) if d > cut + 1e-12] + [len(body)]
        room = limit - count(f"title: {title or 'none'} | text: ")
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            out += [body[a:b]] if count(body[a:b]) <= room else chunking.split_text(body[a:b], room)
    return out


def test_semantic_pipeline_equals_its_twin(spark, tiny):
    from quillspark.plans import catalogue, views

    docs = views.docs(spark, tiny).select("doc_id", "title", "body")
    got = {}
    for r in catalogue.QUERIES["chunk_pipeline"](spark, tiny).orderBy("doc_id", "seq").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    truth = {r["doc_id"]: twin(r["body"], r["title"], chunking.CONTEXT - chunking.MARGIN) for r in docs.collect()}
    assert got == {i: c for i, c in truth.items() if c} and sum(map(len, truth.values())) > len(truth)
    text = "# A\n" + "Cats sit. Cats eat. Cats sleep well. " * 9 + "Stocks fell. Bonds rose. " * 9 + "\n# B\n\nÉt vé. " + "word " * 200 + "\n# C\n"
    rows = chunking.pipeline(text, "T", embedder.embed_all, limit=60)
    assert [t for _, _, t in rows] == twin(text, "T", 60) and all(text.encode()[p : p + n].decode() == t for p, n, t in rows) and max(len(t.split()) for _, _, t in rows) <= 60


def test_documents_that_cannot_be_packed_say_why(spark):
    docs = spark.createDataFrame([(1, "a\n" * 400), (2, "short"), (3, None)], "doc_id long, body string")
    got = {r["doc_id"]: (r["seq"], r["error"]) for r in chunking.pack_documents(docs, 5, 20).collect()}
    assert got[2] == (0, None) and got[1][0] is None and "20 allowed" in got[1][1] and 3 not in got
    turns = spark.createDataFrame([(1, 0, "x" * 4000), (2, 0, "hi")], "conv_id long, turn int, text string")
    got = {r["conv_id"]: (r["turns"], r["error"]) for r in chunking.pack_sessions(turns, 100).collect()}
    assert got[2] == ([0], None) and got[1][0] is None and "tokens" in got[1][1]


def test_references_are_read_together(spark):
    docs = spark.createDataFrame(
        [("wiki", "wiki/a.md", "ab12" + "0" * 60, "Alpha", "one\ntwo\nthree\n"), ("raw", "raw/x", "ab12" + "0" * 60, "Alpha", "one\ntwo\nthree\n"), ("wiki", "wiki/b.md", "ab99" + "0" * 60, "alpha", "b"), ("wiki", "wiki/abba.md", "cc" * 32, "Abba", "c")],
        "doc_type string, path string, hash string, title string, body string",
    )
    refs = [(1, "ab12", None), (2, "AB", None), (3, "abba", None), (4, "ALPHA", 2), (5, "zz", None), (6, "", None), (7, None, None), (8, "ab99" + "0" * 60, None), (9, "a", 2)]
    table = spark.createDataFrame([(*r, 1) for r in refs], "rid long, ref string, first int, count int")
    got = {r["rid"]: (r["status"], r["path"], r["text"]) for r in lookup.read_many(docs, docs, table).collect()}
    assert got == {
        1: ("found", "wiki/a.md", "one\ntwo\nthree\n"), 2: ("ambiguous", None, None), 3: ("found", "wiki/abba.md", "c"), 4: ("found", "wiki/a.md", "two\n"), 5: ("missing", None, None),
        6: ("missing", None, None), 7: ("missing", None, None), 8: ("found", "wiki/b.md", "b"), 9: ("ambiguous", None, None),
    }


def test_changes_out_of_order_and_over_restarts(spark, tmp_path):
    from quillspark.streaming import changes

    rng = random.Random(8)
    rows = [(rng.choice(["modify", "remove", "create"]), f"wiki/p{rng.randrange(9)}.md", None, f"2024-01-0{1 + rng.randrange(9)} 0{rng.randrange(9)}:00:0{i % 10}.{i:03d}") for i in range(120)]
    table = spark.createDataFrame([*rows, ("modify", "notes.txt", None, "2024-01-01 00:00:00")], "kind string, path string, to string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    truth = {r["path"]: (r["action"], r["ts"]) for r in changes.latest(changes.normalise(table)).collect()}
    state, news = {}, []

    def apply(df, number):
        for r in df.collect():
            news.append((r["path"], r["ts"]))
            assert r["path"] not in state or state[r["path"]][1] <= r["ts"]  # what is handed on is newer than all before
            state[r["path"]] = (r["action"], r["ts"])

    for part in range(3):  # each run catches up and ends; state outlives it
        table.filter(F.pmod(F.hash("ts", "path"), F.lit(3)) == part).write.mode("append").parquet(f"file://{tmp_path}/events")
        stream = spark.readStream.schema(changes.SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"file://{tmp_path}/events")
        changes.follow_newest(changes.normalise(stream), f"file://{tmp_path}/checkpoint", apply, late=30 * 86_400).awaitTermination()
    assert state == truth and len(news) > len(truth)


def test_pages_written_by_requests(spark, store):
    from quillspark.plans.requests import write_pages

    store.commit(spark.createDataFrame([("raw", "raw/12/34", "x", "the source", 1), page("red-fox", "about Blue Whale and dogs")], WIKI))
    rows = [
        (1, "Blue Whale", "---\ntitle: t\n---\n\nA red fox, a [[ghost]] and [[red-fox]].", "x", None), (2, "blue whale", "second", None, False), (3, "Red Fox", "x", None, False), (4, "...", "x", None, None),
        (5, "a\tb", "x", None, None), (6, "n" * 300, "x", None, None), (7, "No Source", "x", "missing ref", None), (8, "B", "beta forced", None, True), (9, None, None, None, None),
    ]
    asked = spark.createDataFrame(rows, "rid long, title string, content string, source string, force boolean")
    got = {r["rid"]: (r["outcome"], r["slug"], r["linked"], r["backlinked"], r["suggest_create"]) for r in write_pages(store, asked).collect()}
    assert got[1] == ("accepted", "blue-whale", ["red-fox"], ["red-fox"], ["ghost"]) and got[8] == ("accepted", "b", [], [], [])
    assert [got[i][0] for i in (2, 3, 4, 5, 6, 7, 9)] == ["exists", "exists", "empty_slug", "control_in_title", "long_slug", "source_not_found", "empty_slug"]
    docs, bodies = state_of(store)
    assert bodies[docs["wiki/blue-whale.md"]] == "A [[red-fox]], a [[ghost]] and [[red-fox]]." and bodies[docs["wiki/red-fox.md"]] == "about [[blue-whale]] and dogs" and bodies[docs["wiki/b.md"]] == "beta forced"
    gone = spark.createDataFrame([("raw", "raw/12/34")], "doc_type string, path string")
    assert set(outcomes(store.commit(delete=gone)).values()) == {"referenced"}


def test_sources_added_by_requests(spark, store):
    from quillspark.plans.requests import add_sources

    kind = "rid long, source_path string, content string, collections array<string>"
    first = [(1, "notes/a.txt", "text a", [" Team "]), (2, "https://x.org/deep/b", "text a", ["other"]), (3, "p", " \n", None), (4, "p\x01", "t", None), (5, "p", "t", ["x" * 65]), (6, None, "t", None), (7, "c.md", "# Head\nrest", None)]
    got = {r["rid"]: r["outcome"] for r in add_sources(store, spark.createDataFrame(first, kind)).collect()}
    assert got == {1: "added", 2: "added", 3: "empty", 4: "bad_path", 5: "bad_collection", 6: "bad_path", 7: "added"}
    again = {r["rid"]: (r["outcome"], r["docid"]) for r in add_sources(store, spark.createDataFrame([(1, "other/path", "text a", ["new"]), (2, "c.md", "# Head\nrest", ["z"])], kind)).collect()}
    assert again[1][0] == again[2][0] == "known" and len(again[1][1]) == 7
    rows = {r["title"]: (r["source"], r["collections"]) for r in store.documents().filter("doc_type = 'raw'").collect()}
    assert rows == {"a": ("notes/a.txt", ["new", "other", "team"]), "Head": ("c.md", ["default", "z"])}
    state_of(store)


def test_a_commit_writes_each_body_once_and_exchanges_no_word(spark, tmp_path):
    rows = spark.createDataFrame([("raw", f"raw/{i}", f"t{i}", f"heon {i % 7}\n\n éè ouen heon {i % 7} heon\n ") for i in range(40)], "doc_type string, path string, title string, body string")
    store = Library(spark, f"file://{tmp_path}/lib")
    store.commit(rows)
    with_body = {p.name.split("-")[0] for p in (tmp_path / "lib").iterdir() if p.name != "log" and "body" in spark.read.parquet(f"{p}/bodies" if p.name.startswith("segment") else str(p)).columns}
    assert with_body == {"segment"}
    assert store.live("bodies").count() == 7 and store.live("chunks").count() == 14
    plan = lexical.postings(store.live("chunks"), "chunk_text", ["hash", "seq"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    heon = store.live("postings").filter("term = 'heon' and seq = 1").select("tf", "positions", "dl").distinct().collect()
    assert [tuple(r) for r in heon] == [(2, [2, 4], 5)]
    assert {(r["seq"], r["pos"], r["len"], r["chunk_text"][:4]) for r in store.live("chunks").collect()} == {(0, 0, 6, "heon"), (1, 8, 22, " éè ")}


def test_references_are_read_from_the_best_of_each_key_and_not_from_all_pairs(spark):
    """What a short prefix or a title meets is gathered once a key, so many references to many documents cost their sum."""
    docs = spark.range(300).select(
        F.when(F.col("id") % 4 == 0, "wiki").otherwise("raw").alias("doc_type"), F.concat(F.lit("p/n"), F.col("id").cast("string")).alias("path"),
        F.sha2((F.col("id") % 100).cast("string"), 256).alias("hash"), F.concat(F.lit("T"), (F.col("id") % 3).cast("string")).alias("title"), (F.col("id") % 100).cast("string").alias("body"))
    hashes = {r["path"]: r["hash"] for r in docs.collect()}
    asked = [h[:n] for h in sorted(set(hashes.values()))[:9] for n in (1, 2, 6, 7, 40, 64)] + ["t0", "T2", "n5", "n77", "zz", "", None]
    refs = spark.createDataFrame([(i, r, None, None) for i, r in enumerate(asked)], "rid long, ref string, first int, count int")
    rows = docs.collect()
    for r in lookup.read_many(docs, docs, refs).collect():
        ref = r["ref"] or ""
        tiers = [[d for d in rows if re.fullmatch("[0-9a-f]{1,64}", ref) and d["hash"].startswith(ref)], [d for d in rows if d["path"][2:] == ref], [d for d in rows if ref and d["title"].lower() == ref.lower()]]
        met = next((t for t in tiers if t), [])
        several = met and met is tiers[0] and len({d["hash"] for d in met}) > 1
        best = min(met, key=lambda d: (d["doc_type"] != "wiki", d["path"]), default=None)
        assert (r["status"], r["path"], r["text"]) == (("ambiguous", None, None) if several else ("found", best["path"], best["body"]) if met else ("missing", None, None))
    heavy = docs.select(F.col("path").alias("rid"), F.substring("hash", 1, 1).alias("ref"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("count"))
    metrics = lookup._meetings(docs.select("doc_type", "path", "hash", "title"), heavy)
    assert metrics.count() <= 300


def test_python_steps_hold_one_block_and_small_batches(spark, monkeypatch):
    """Batches are bounded by bytes, a task has one automaton at a time, and the neighbours that it keeps are bounded too."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.createDataFrame([(i, "h%d" % i, "t", f"# a\nshared words {i}. More page-{i % 5}.\n") for i in range(20)], "doc_id long, hash string, title string, body string")
    for make in (chunking.markdown_chunks, chunking.full_pipeline, lambda t: ingest.diff_rows(t.select(F.col("doc_id").alias("id"), F.col("body").alias("old"), F.lit("x").alias("new")))):
        spark.conf.unset(name)
        assert make(texts).count() == 20
        assert int(spark.conf.get(name)) == 4 << 20
    pages = spark.createDataFrame([(f"page-{i}", f"Title {i}", f"of page {i % 7} and title {i % 11}") for i in range(12)], "stem string, title string, body string")
    whole, parts = links.maintain(pages, pages), links.maintain(pages, pages, block=40)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))
    assert parts._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    rows = spark.range(60).select(F.col("id").alias("hash"), F.lit(0).alias("seq"), F.array(F.sin("id"), F.cos("id")).cast("array<float>").alias("embedding"))
    asked = rows.select(F.col("hash").alias("qid"), F.col("embedding").alias("probe"))
    once = sorted(map(tuple, vectors.knn_join(asked, rows, 4).collect()))
    monkeypatch.setattr(vectors, "KEPT", 40)
    split = vectors.knn_join(asked, rows, 4)
    assert split._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 6 and sorted(map(tuple, split.collect())) == once


def test_a_commit_exchanges_only_bodies_that_several_rows_bring(spark, tmp_path, monkeypatch):
    schema = "doc_type string, path string, title string, body string, mtime long"
    first = spark.createDataFrame([("raw", f"raw/{i}", "t", f"body {i if i < 30 else i % 3}", 1) for i in range(40)] + [("raw", "raw/5", "t", "body 9", 0), ("raw", "raw/6", "t", "body gone", 0)], schema)
    second = spark.createDataFrame([("raw", f"raw/{i}", "t", f"body {i}" if i % 2 else f"new {i // 8}", 2) for i in range(40)], schema)

    class Watched(Library):
        plans: list = []

        def _segment(self, bodies, most, born):
            self.plans.append(bodies._jdf.queryExecution().optimizedPlan().toString())
            return super()._segment(bodies, most, born)

    truth = {f"body {i}" for i in range(40) if i % 2} | {f"new {i}" for i in range(5)}
    for named in (800_000, 0):  # hashes to take, or to leave, by a broadcast; or all by an exchange
        monkeypatch.setattr("quillspark.plans.library.NAMED", named)
        store = Watched(spark, f"file://{tmp_path}/lib-{named}")
        store.commit(first)
        assert sorted(r["body"] for r in store.live("bodies").collect()) == sorted(f"body {i}" for i in range(30))
        store.commit(second)
        assert sorted(r["body"] for r in store.live("bodies").collect()) == sorted(truth)
    assert "LeftAnti" in Watched.plans[0] and Watched.plans[0].count("Aggregate [hash") == 1
    assert all("LeftAnti" not in p and "Union" not in p for p in Watched.plans[2:])


def test_whole_names_are_looked_up_by_runs_as_a_pattern_finds_them(spark):
    """One broadcast of keys for names that came in many blocks before; every odd name against the pattern itself."""
    rng = random.Random(5)
    pieces = ["ab", "AB", "é", "É", "_", " ", "-", ".", "ſ", "s", "K", "k", "ͅ", "Ι", "ι", "İ", "i", "ß", "12", "\n"]
    text = lambda n: "".join(rng.choice(pieces) for _ in range(n))
    rows = [(f"p-{i}", text(rng.choice([1, 1, 2, 3, 5, 12])), text(40)) for i in range(60)] + [("long", "ab-" * 9 + "ab", "x"), ("twice", "same", "Same SAME"), ("again", "same", "ab-" * 11 + "ab.")]
    solid = lambda c: c.isalnum() or c == "_"

    def whole(name: str, body: str) -> bool:
        edge = lambda i: (i > 0 and solid(body[i - 1])) != (i < len(body) and solid(body[i]))
        pattern = re.compile(f"(?=({re.escape(name)}))", re.IGNORECASE)
        return any(mentions.fold(name) == mentions.fold(m[1]) and edge(m.start()) and edge(m.start() + len(name)) for m in pattern.finditer(body))

    truth = {(s, d) for s, _, b in rows for d, t, _ in rows if s != d and (whole(t, b) or whole(d.replace("-", " "), b))}
    table = spark.createDataFrame(rows, "stem string, title string, body string")
    assert {tuple(r) for r in links.missing(table, links.names_of(table)).collect()} == truth and len(truth) > 100
    found = links.missing(table, links.names_of(table), block=24 * 40)
    assert {tuple(r) for r in found.collect()} == truth
    names = {n for _, t, _ in rows for n in [t]}
    keys = np.array([mentions.key_of(n) for n in names])
    one = mentions.WholeNames(keys[:, 0], keys[:, 1], keys[:, 2])
    assert any(m == "ab-" * 9 + "ab" for _, m in one.named("ab-" * 9 + "ab."))


def test_late_changes_count_without_python_a_path(spark, tmp_path):
    from quillspark.streaming import changes

    at = lambda d, s=0: f"2024-0{1 + d // 28}-{1 + d % 28:02d} 00:00:0{s}"
    batches = [
        [("modify", "wiki/a.md", at(80)), ("remove", "wiki/b.md", at(1)), ("modify", "wiki/b.md", at(1))],
        [("modify", "wiki/a.md", at(90)), ("modify", "wiki/b.md", at(1)), ("remove", "wiki/a.md", at(3))],
        [("modify", "wiki/late.md", at(2)), ("remove", "wiki/b.md", at(1, 1)), ("modify", "wiki/a.md", at(90)), ("remove", "wiki/a.md", at(89))],
    ]
    news = []
    for part in batches:
        rows = spark.createDataFrame([(k, p, None, t) for k, p, t in part], "kind string, path string, to string, ts string")
        rows.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/events")
        stream = changes.normalise(spark.readStream.schema(changes.SCHEMA).parquet(f"file://{tmp_path}/events"))
        query = changes.follow_newest(stream, f"file://{tmp_path}/checkpoint", lambda df, n: news.append({(r["path"], r["action"], str(r["ts"])) for r in df.collect()}), late=86_400)
        query.awaitTermination()
        plan = query._jsq.explainInternal(False)
        assert "Pandas" not in plan and "StateStoreSave" in plan
    assert news == [{("wiki/a.md", "touch", at(80)), ("wiki/b.md", "touch", at(1))}, {("wiki/a.md", "touch", at(90))}, {("wiki/late.md", "touch", at(2)), ("wiki/b.md", "remove", at(1, 1))}]


def test_a_commit_keeps_text_once_and_no_table_that_nothing_reads(spark, tmp_path):
    """Lines are made from bodies where they are read; chunks of another chunker are stored, and both live on through a merge."""
    rows = lambda n: spark.createDataFrame([("raw", f"raw/{n}-{i}", "t", f"one {n} {i}\n\n two Σ") for i in range(2)], "doc_type string, path string, title string, body string")
    store = Library(spark, f"file://{tmp_path}/lib")
    store.commit(rows(0))
    folders = {p.name.split("-")[0]: p for p in (tmp_path / "lib").iterdir()}
    assert set(folders) == {"log", "documents", "refs", "report", "segment"}
    assert {p.name for p in folders["segment"].iterdir()} == {"bodies", "links", "postings", "sizes"}
    lines = lambda b: {tuple(r) for r in b.select("hash", "seq", "pos", "len", "chunk_text", "dl").collect()}
    assert {r[1:] for r in lines(store.live("chunks"))} == {(0, 0, 7, "one 0 0", 3), (0, 0, 7, "one 0 1", 3), (1, 9, 7, " two Σ", 2)}
    one = store.documents().select("hash").orderBy("path").limit(1)
    assert {r[4] for r in lines(store.chunks_of(one))} == {"one 0 0", " two Σ"}
    assert (store.state["n"], store.state["tokens"]) == (4, 10)
    store.rechunk(lambda b: chunking.line_chunks(b).withColumn("chunk_text", F.upper("chunk_text")))
    store.chunker = chunking.chunks_of_lines
    for n in (1, 2, 3):
        store.commit(rows(n))
    assert len(store.state["segments"]) == 1 and not store.state["segments"][0]["lines"] and store.state["n"] == 16
    assert {r[4] for r in lines(store.live("chunks"))} == {"ONE 0 0", "ONE 0 1", " TWO Σ", " two Σ"} | {f"one {n} {i}" for n in (1, 2, 3) for i in range(2)}
    assert store.live("postings").filter("term = 'two'").count() == 8
    kept = Library(spark, f"file://{tmp_path}/other")
    for n in range(4):
        kept.commit(rows(n))
    assert len(kept.state["segments"]) == 1 and kept.state["segments"][0]["lines"] and kept.live("chunks").count() == kept.state["n"] == 16
    odd = spark.createDataFrame([(str(i), b) for i, b in enumerate(["", "\n", " \t\n\r\n\x0b\na", "\u00a0\nx \n\u2003\n\u3000y\n\n", "a\r\nb\n\f\n\x1c\nc", "\u200b\n\x85\nz"])], "hash string, body string")
    assert sorted(chunking.texts_of_lines(odd).collect()) == sorted(chunking.chunks_of_lines(odd).select("hash", "seq", "chunk_text").collect())
    plan = lexical.postings(chunking.texts_of_lines(odd), "chunk_text", ["hash", "seq"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_a_selection_of_collections_is_judged_once_for_all_lanes(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "wiki").otherwise("raw").alias("doc_type"), F.concat(F.lit("p/"), F.col("id").cast("string")).alias("path"), F.lit("t").alias("title"), F.col("id").cast("string").alias("hash"))
    members = docs.filter("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de").alias("name"))
    corpus = Corpus(docs, docs.limit(0), None, members)
    parts = [corpus.selected(kind, names) for kind in ("wiki", "raw") for names in ([" EN", "default"], ["default", "en"])]
    ids = [{r["doc_id"] for r in p.collect()} for p in parts]
    assert ids[0] == ids[1] == {i for i in range(0, 40, 4)} and ids[2] == ids[3] == {i for i in range(40) if i % 4 and (i % 5 == 0 or i % 2 == 0)}
    assert len({f for p in parts for f in p.inputFiles()}) == len(parts[0].inputFiles()) > 0
    assert all("Join" not in p._jdf.queryExecution().optimizedPlan().toString() for p in parts)
    assert {r["doc_id"] for r in corpus.selected("wiki", []).collect()} == {0, 20} and corpus.selected("wiki", None).count() == 10


@pytest.mark.parametrize("text", ["alpha see", "alpha-words", '"beta words" gamma', "words -beta"])
def test_a_search_reads_and_exchanges_its_postings_once(store, text):
    hits = lexical.search(store.index(), text)
    hits.collect()
    plan = hits._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 1


def test_titles_meet_queries_without_an_exchange_of_pairs_and_without_the_store(spark, tiny, monkeypatch):
    """Titles alike are one text; odd clauses count as in a search of one query; nearest vectors are those of a join."""
    from quillspark.plans import catalogue, views

    monkeypatch.setattr(views, "library", None)
    assert catalogue.QUERIES["title_slugs"](spark, tiny).count() == views.docs(spark, tiny).filter("doc_type = 'wiki'").count()
    long = "x" * 40
    words = ["common heron", "common heron", "common herons nest", f"{long}yz common", f"{long}y", "a b a b", "b a", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(words * 9)], "doc_id long, title string")
    index = lexical.LexicalIndex.build(rows, "title", ["doc_id"])
    asked = ["common heron", f"{long}y", 'common -"heron"', '"a b" a', "common -her", "zebra common", "a a"]
    many = lexical.search_many(index, spark.createDataFrame([(t,) for t in asked], "query string")).collect()
    for text in asked:
        one = {(r["doc_id"], round(r["raw"], 9)) for r in lexical.search(index, text).collect()}
        assert text == "a a" or {(r["doc_id"], round(r["raw"], 9)) for r in many if r["query"] == text} == one
    texts = rows.selectExpr("coalesce(title, '') AS text").groupBy("text").agg(F.count("*").alias("n"), F.lit(True).alias("wanted"))
    found = lexical.search_texts(texts, index.stats, spark.createDataFrame([("common",)], "query string"))
    assert sorted(r["text"] for r in found.collect()) == sorted({t for t in words if t and "common" in t})
    vecs = spark.range(50).selectExpr("concat('h', id % 40) AS hash", "cast(id as int) AS seq", "array(cast(id % 7 as float), cast(1 as float)) AS embedding")
    probes = spark.range(20).selectExpr("id AS qid", "array(cast(id as float), cast(id % 3 as float)) AS probe").union(spark.createDataFrame([(90, None), (91, [1.0])], "qid long, probe array<float>"))
    truth = sorted(map(tuple, vectors.knn_join(probes, vecs, 6).collect()))
    for block in (100, 1 << 20):
        assert sorted(map(tuple, vectors.knn_lookup(probes, vecs, 6, block).collect())) == truth
    assert vectors.knn_lookup(probes, vecs.limit(0), 2).collect() == []


def _exchanged(spark) -> int:
    """Records that this session has exchanged so far."""
    jvm = spark._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(s.shuffleWriteRecords() for s in jvm.scala.jdk.CollectionConverters.SeqHasAsJava(stages).asJava())


def test_missing_links_of_copies_are_not_exchanged(spark, monkeypatch):
    pages = [(f"p-{i}", "twin heron" if i < 300 else f"lone {i}", f"Twin Heron here, p {i + 1}, lone {i + 2} [[p-{i + 1}]] [[p-{i + 3}]] [[none]]") for i in range(320)]
    table = spark.createDataFrame(pages, "stem string, title string, body string").repartition(3)
    truth = set()
    for stem, _, body in pages:
        said = body.lower().replace(",", " ").replace("[", " ").split()
        said = f" {' '.join(said)} "
        truth |= {(stem, s) for s, t, _ in pages if s != stem and f"[[{s}]]" not in body and (f" {t} " in said or f" {s.replace('-', ' ')} " in said)}
    for part in (4000, 70):
        monkeypatch.setattr(links, "PART", part)
        before = _exchanged(spark)
        got = links.missing(table, links.names_of(table)).collect()
        assert len(got) == len(truth) > 90_000 and set(map(tuple, got)) == truth
        assert _exchanged(spark) - before < 20_000


def test_forward_links_take_one_pass_for_many_names_and_copies(spark, monkeypatch):
    monkeypatch.setattr(links, "stage", None)  # pages are written between passes
    targets = spark.range(60_000).selectExpr("concat('doc-', id) AS stem", "IF(id < 400, 'The Same Heron', concat('name ', repeat('long ', 9), id)) AS title")
    body = "the same heron, doc 7 and the same HERON " * 20 + "name " + "long " * 9 + "59999 [[the same heron]] doc 399"
    got = links.maintain(spark.createDataFrame([("doc-1", body)], "stem string, body string"), targets).first()
    few = [(f"doc-{i}", "The Same Heron") for i in range(400)] + [("doc-59999", "name " + "long " * 9 + "59999")]
    few += [(f"doc-{i}", "name " + "long " * 9 + f"{i}") for i in (5999, 599, 9999)]
    assert (got["body"], got["linked"]) == links.link_forward(body, few, "doc-1") and len(got["linked"]) > 40
