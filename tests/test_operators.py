"""Semantics of the engine's operators on small tables, and invariants."""

import json
import math

import pytest
from pyspark.sql import functions as F

from quillspark.functions import embedder, porter
from quillspark.functions import text as T
from quillspark.operators import chunking, fusion, integrity, jobs, lexical, links, store, vectors
from quillspark.operators.lexical import Clause
from quillspark.plans import ingest
from quillspark.plans.retrieval import Corpus, ask, hybrid, title_lookup, with_bodies
from quillspark.sources import files as S
from quillspark.sources import sessions
from quillspark.streaming import changes


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr).first()[0]


def test_query_grammar():
    p = lexical.parse_query
    assert p('rust "borrow checker" -java') == [Clause(("rust",), True), Clause(("borrow", "checker")), Clause(("java",), True, True)]
    assert p("state-of-the-art") == [Clause(("state", "of", "the", "art"))]
    assert p('"open phrase to the end') == [Clause(("open", "phrase", "to", "the", "end"))]
    assert p("-only -negative") == [] and p("  ") == [] and p("!!! ok") == [Clause(("ok",), True)]
    assert p('-"bad words" good') == [Clause(("bad", "words"), False, True), Clause(("good",), True)]


def test_bm25_by_hand(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox", "red red dog", "blue fox fox fox", "green", "grey cat", "white cat"])], "id long, t string")
    index = lexical.LexicalIndex.build(rows, "t", ["id"])
    got = {r["id"]: r["raw"] for r in lexical.search(index, "fox").collect()}
    mean, idf = 14 / 6, math.log((6 - 2 + 0.5) / 2.5)
    assert set(got) == {0, 2}
    assert got[2] == pytest.approx(idf * 3 * 2.2 / (3 + 1.2 * (0.25 + 0.75 * 4 / mean)))
    assert {r["id"] for r in lexical.search(index, "fox -blue").collect()} == {0}
    assert lexical.search(index, "-fox").collect() == []
    assert {r["id"] for r in lexical.search(index, [Clause(("red",)), Clause(("cat",))], "or").collect()} == {0, 1, 4, 5}


def test_index_round_trip_and_stems(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Running runners ran"), (2, "connection connected")], "id long, t string")
    index = lexical.LexicalIndex.build(rows, "t", ["id"], stemmed=True).write(f"file://{tmp_path}/index")
    assert {r["id"] for r in lexical.search(index, [Clause((porter.stem("connecting"),))]).collect()} == {2}


@pytest.mark.parametrize(
    ("word", "stem"),
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("digitizer", "digit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll")],
)
def test_porter(word, stem):
    assert porter.stem(word) == stem


def test_embedder_expression_equals_function(spark):
    for text in ("alpha beta alpha", "", "é ü"):
        assert one(spark, embedder.embed_column(F.col("t"), 32), t=text) == embedder.embed(text, 32)


def test_fusion_is_invariant_to_list_order(spark):
    def lane(name, paths, weight):
        rows = spark.createDataFrame([(p, 0, 1.0 - i / 10) for i, p in enumerate(paths)], "path string, chunk_seq int, score double")
        return fusion.ranked(rows, name, weight, 20)

    a, b = lane("a", ["x", "y", "z"], 2.0), lane("b", ["y", "w"], 1.0)
    one_way = [(r["path"], round(r["rrf"], 9)) for r in fusion.fuse([a, b]).orderBy("position").collect()]
    assert one_way == [(r["path"], round(r["rrf"], 9)) for r in fusion.fuse([b, a]).orderBy("position").collect()]
    assert dict(one_way)["y"] == pytest.approx(2 / 62 + 0.02 + 1 / 61 + 0.05)
    assert fusion.fuse([a]).filter("path = 'x'").first()["rrf"] == pytest.approx(2 / 61)


def test_signal(spark):
    s = lambda a, b, i=False: one(spark, lexical.strong_signal(F.col("a"), F.col("b"), i), a=a, b=b)
    assert s(0.9, 0.7) and not s(0.9, 0.8) and not s(0.84, 0.1) and not s(0.9, 0.7, True)


PAGE = "---\ntitle: \"A: title\"\ncreated_at: 2024-01-01T00:00:00Z\nupdated_at: 2024-01-01T00:00:00Z\nsources:\n  - raw-1\n  - 'raw 2'\ncollections: [ Team , x]\n---\n\n# Head\nFirst line of text\n"


def test_page_parsing(spark):
    rows = spark.createDataFrame([("wiki", "wiki/a-page.md", 1, 10, PAGE), ("wiki", "wiki/plain.md", 1, 10, "# Plain page\nbody")], "doc_type string, path string, mtime long, size long, text string")
    a, b = S.parse(rows).orderBy("path").collect()
    assert (a["title"], a["collections"], a["sources"], a["summary"], a["stem"]) == ("A: title", ["team", "x"], ["raw-1", "raw 2"], "First line of text", "a-page")
    assert a["body"].startswith("# Head") and (b["title"], b["collections"]) == ("Plain page", ["default"])


def test_tree_listing_and_reconcile_twice(spark, tmp_path):
    (tmp_path / "wiki").mkdir()
    body = "raw body"
    import hashlib

    digest = hashlib.sha256(body.encode()).hexdigest()
    (tmp_path / "raw" / digest[:2]).mkdir(parents=True)
    (tmp_path / "raw" / digest[:2] / digest[2:]).write_text(body)
    (tmp_path / "wiki" / "a.md").write_text(PAGE)
    listed = S.listing(spark, f"file://{tmp_path}")
    docs = S.read_tree(spark, f"file://{tmp_path}").cache()
    assert docs.count() == 2 and S.changed(listed, docs).count() == 0
    assert {r["action"] for r in integrity.diff(listed, docs).collect()} == {"skip"}
    assert S.verified_raw(docs).first()["hash_ok"]
    assert integrity.mismatched_raw(docs).count() == 0
    plan = integrity.diff(listed.filter("doc_type = 'raw'"), docs)
    assert integrity.guard(plan, docs).first()["allowed"]


def test_sections_tile_and_nest():
    text = "intro\n# A\ntext\n```\n# not a head\n```\n## B\nmore\n# C\n"
    got = chunking.sections(text)
    assert [s["text"].splitlines()[0] for s in got] == ["intro", "# A", "## B", "# C"]
    assert [s["path"] for s in got] == ["", "", "A", ""] and sum(s["len"] for s in got) == len(text)


def test_packers():
    turns = ["x" * 300] * 10
    packed = chunking.pack_turns(turns, 500, overlap=1)
    assert packed[0] == [0, 1, 2, 3] and all(b[0] == a[-1] for a, b in zip(packed, packed[1:], strict=False))
    with pytest.raises(ValueError, match="turn 0"):
        chunking.pack_turns(["x" * 9000], 500)
    with pytest.raises(ValueError, match="chunks"):
        chunking.pack_turns(turns, 250, limit=2, overlap=0)
    text = "# A\n" + "para one. " * 50 + "\n\n" + "para two. " * 50 + "\n# B\nshort\n"
    chunks = chunking.pack_markdown(text, 200)
    assert "".join(chunks) == text and all(chunking.estimate_tokens(c) <= 200 for c in chunks)
    pieces = chunking.split_text("One two three. Four five six. Seven eight nine. Ten.", 6, 3)
    assert all(len(p.split()) <= 6 for p in pieces) and pieces[0] == "One two three. Four five six."


def test_links():
    body, linked = links.link_forward("Rust Borrow Checker beats rust. See [[tokio]].", [("rust-lang", "Rust"), ("borrow-checker", "Rust Borrow Checker"), ("tokio", "tokio")], "self")
    assert linked == ["borrow-checker", "rust-lang"] and body == "[[borrow-checker]] beats [[rust-lang]]. See [[tokio]]."
    assert links.scrub("a [[known]] b [[un-known]] c [[open", {"known"}) == "a [[known]] b un known c [[open"


def test_forward_links_to_all_pages_in_blocks(spark, tiny):
    from quillspark.plans import catalogue, views

    small = tiny.replace("0.001", "0.01")
    pages = [(r["stem"], r["title"], r["body"]) for r in views.docs(spark, small).filter("doc_type = 'wiki'").collect()]
    names = [p[:2] for p in pages]
    truth = {s: links.link_forward(b, names, s) for s, _, b in pages}
    assert {r["stem"]: (r["body"], r["linked"]) for r in catalogue.QUERIES["forward_link"](spark, small).collect()} == truth
    assert any(int(s.split("-")[1]) >= 200 for _, linked in truth.values() for s in linked)
    rows = [("a-b", "K\u0130\u017f x", "\u212ai\u017f X and c d, a b, c d"), ("c-d", "Kis", "kıS X [[c d"), ("e-f", "\u00dcber [[c-d]]", "über c d"), ("g-h", "", "a b E F")]
    table = spark.createDataFrame(rows, "stem string, title string, body string")
    truth = {s: links.link_forward(b, [r[:2] for r in rows], s) for s, _, b in rows}
    for size in (1, 3, 9):
        assert {r["stem"]: (r["body"], r["linked"]) for r in links.maintain(table, table, size).collect()} == truth


def test_snapshot_table(spark, tmp_path):
    table = store.SnapshotTable(spark, f"file://{tmp_path}/t")
    assert table.current() is None
    table.commit(spark.range(3).withColumn("v", F.lit(1)))
    table.commit(table.read().unionByName(spark.range(5, 6).withColumn("v", F.lit(2))))
    assert table.read().count() == 4 and table.vacuum() == 1 and table.read().count() == 4


def test_job_states(spark):
    rows = spark.createDataFrame([("a", "failed", "boom"), ("b", "completed", None), ("c", "processing", None)], "job_id string, status string, error string")
    new = spark.createDataFrame([("a", "pending", None), ("b", "pending", None), ("d", "pending", None)], rows.schema)
    got = {r["job_id"]: (r["status"], r["error"]) for r in jobs.insert_jobs(rows, new).collect()}
    assert got == {"a": ("pending", None), "b": ("completed", None), "c": ("processing", None), "d": ("pending", None)}


MESSAGES = "\n".join(
    json.dumps(r)
    for r in [
        {"type": "user", "sessionId": "s1", "uuid": "u", "timestamp": "t1", "message": {"role": "user", "content": "hi <private>x</private> there"}},
        {"type": "assistant", "timestamp": "t2", "message": {"content": [{"type": "text", "text": "hello <tool_use>"}, {"type": "thinking", "text": "no"}, {"type": "tool_use", "name": "Bash", "input": {"command": "echo sk-" + "a" * 24}}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result"}]}},
        {"type": "ai-title", "aiTitle": "Auto"},
        {"type": "custom-title", "customTitle": " Named "},
    ]
) + "\n{broken"
RESPONSES = "\n".join(
    json.dumps(r)
    for r in [
        {"type": "session_meta", "payload": {"id": "s2"}},
        {"type": "event_msg", "payload": {"type": "user_message", "message": "ask"}},
        {"type": "response_item", "payload": {"type": "message", "content": [{"type": "output_text", "text": "answer"}]}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "grep", "arguments": '{"pattern": "x"}'}},
    ]
)


def test_sessions(spark):
    chat = json.dumps({"sessionId": "s3", "messages": [{"type": "user", "content": [{"text": "q"}]}, {"type": "gemini", "content": "a", "toolCalls": [{"name": "glob", "args": {"pattern": "*"}}]}]})
    events = json.dumps({"type": "session", "version": 1, "id": "s4"}) + "\n" + json.dumps({"type": "message", "message": {"role": "user", "content": [{"type": "text", "text": "only user"}]}})
    blocks = json.dumps({"session_id": "s5", "session_start": "t0", "messages": [{"role": "user", "content": "/kb-ingest this"}, {"role": "assistant", "content": [{"type": "text", "text": "ok"}]}]})
    envelope = json.dumps({"session_id": "s6", "turns": [{"role": "user", "text": "u"}, {"role": "assistant", "text": "a"}]})
    rows = spark.createDataFrame([("a.jsonl", MESSAGES), ("b.jsonl", RESPONSES), ("c.json", chat), ("d.jsonl", events), ("e.json", blocks), ("f.json", envelope), ("g.txt", "nothing")], "path string, text string")
    got = {r["path"]: r for r in sessions.parse_sessions(rows).collect()}
    assert [got[p]["format"] for p in sorted(got)] == ["messages", "responses", "chat", "events", "blocks", "envelope", None]
    assert [got[p]["filter"] for p in sorted(got)] == ["pass", "pass", "pass", "non_substantive", "internal", "pass", "unreadable"]
    a = got["a.jsonl"]
    assert (a["session_id"], a["title"], len(a["turns"])) == ("s1", "Named", 2) and a["turns"][0]["text"] == "hi  there"
    assert a["turns"][1]["text"] == "hello <​tool_use>\n[Tool: Bash — command: echo [REDACTED]]"
    assert got["b.jsonl"]["turns"][2]["text"] == "[Tool: grep — pattern: x in .]"
    flat = rows.sparkSession.createDataFrame([(1, 0, "user", "hi", "t"), (1, 1, "assistant", " yo ", None)], "conv_id long, turn int, role string, text string, timestamp string")
    assert sessions.render(flat).first()["text"] == "## User [t]\nhi\n\n## Assistant\nyo\n"


def test_exported_sessions(spark):
    messages = spark.createDataFrame([("m1", "s", 1000, '{"role":"user"}'), ("m2", "s", 2000, '{"role":"assistant"}')], "id string, session_id string, time_created long, data string")
    parts = spark.createDataFrame([("m1", 1, '{"type":"text","text":"a"}'), ("m1", 2, '{"type":"text","text":"b"}'), ("m2", 3, '{"type":"tool"}')], "message_id string, time_created long, data string")
    assert [tuple(r) for r in sessions.exported_sessions(messages, parts).collect()] == [("s", 0, "user", "1970-01-01T00:00:01Z", "a\nb")]


def test_replies_and_plans(spark):
    assert ingest.parse_pages('noise {"pages": [{"slug": "A b", "body": "x"}]} more')[0]["slug"] == "A b"
    assert ingest.parse_pages("```json\n[{\"slug\": \"s\", \"body\": \"y\"}]\n```")[0]["body"] == "y"
    assert ingest.parse_pages("- slug: one\n  title: T\n  body: |\n    hello\n    there\n")[0] == {"slug": "one", "title": "T", "body": "hello\nthere"}
    assert ingest.parse_answer("see [[a1]] and [[a1]], [[b2]]")["citations"] == ["a1", "b2"]
    assert ingest.parse_expansion('{"lex": "a", "vec": ["b", 3]}') == {"lex": ["a"], "vec": ["b"], "hyde": []}
    pages = ingest.consolidate(ingest.valid_pages([{"slug": "X", "body": "1"}, {"slug": "x", "body": "2"}, {"slug": "", "body": "3"}]))
    assert pages == [{"slug": "x", "title": "x", "body": "1\n\n2"}]
    plan = ingest.make_plan({"content_hash": "0" * 64}, pages, {"x": {"body": "old"}}, "now")
    assert plan["proposals"][0]["merge_target_slug"] == "x" and "+1" in plan["proposals"][0]["merge_diff"] and ingest.check_plan(plan) == []
    assert [ingest.exit_code(v) for v in (["apply"], ["conflict"], ["apply", "conflict"])] == [0, 3, 4]
    calls = []
    cache: dict = {}
    for _ in range(2):
        ingest.cached("p", cache, lambda p: calls.append(p) or '{"a": 1}', ingest.parse_reply)
    assert len(calls) == 1 and ingest.cached("q", cache, lambda p: "no", ingest.parse_reply) is None and len(cache) == 1
    limits = ingest.model_limits(spark.createDataFrame([("v/big-2",), ("big-2-turbo",), ("none",)], "model string"), spark.createDataFrame([("big-2", 1000, 10), ("big", 500, 5)], "name string, max_input int, max_output int"))
    assert {r["model"]: r["max_input"] for r in limits.collect()} == {"v/big-2": 1000, "big-2-turbo": 1000, "none": 128_000}


def test_ingest_with_a_model(spark):
    rows = spark.createDataFrame([("a.md", "# Topic\ntext"), ("b.md", " "), ("c.md", "fail here")], "source_path string, text string")

    def model(chunk):
        if "fail" in chunk:
            raise RuntimeError("down")
        return json.dumps({"pages": [{"slug": "topic", "title": "Topic", "body": chunk}]})

    found = ingest.extract(ingest.document_jobs(rows), model).collect()
    assert sorted((r["slug"] or "", r["error"] or "") for r in found) == [("", "down"), ("topic", "")]
    known = spark.createDataFrame([("topic", "T"), ("other", "Topic")], "stem string, title string")
    pages = spark.createDataFrame([("topic", "x"), ("new", "Topic"), ("free", "f")], "slug string, title string")
    assert {r["slug"]: r["target"] for r in ingest.split_known(pages, known).collect()} == {"topic": "topic", "new": "other", "free": None}
    page = ingest.compose_page({"slug": "s", "title": "S", "body": "about Other Thing and [[gone-page]]"}, [("other-thing", "Other Thing")], "c", "u", ["r"])
    assert "[[other-thing]]" in page and "gone page" in page and page.startswith("---\ntitle: \"S\"")


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(
        [(i, "wiki" if i % 2 else "raw", f"wiki/page-{i}.md" if i % 2 else f"raw/{i}", f"Title {i}", f"h{i}") for i in range(12)], "doc_id long, doc_type string, path string, title string, hash string"
    )
    chunks = spark.createDataFrame([(f"h{i}", s, t) for i in range(12) for s, t in enumerate([f"filler text number {i}", "gravity waves" if i == 3 else "plain words", "tail"])], "hash string, seq int, chunk_text string")
    vectors = chunks.withColumn("embedding", embedder.embed_column(F.col("chunk_text"), 64))
    members = spark.createDataFrame([(3, "physics"), (5, "misc")], "doc_id long, name string")
    return Corpus(docs, chunks, vectors, members)


def test_hybrid_and_question(spark, corpus):
    probe = embedder.embed("gravity waves", 64)
    rows = hybrid(corpus, "gravity waves", probe, top_k=3).collect()
    assert rows[0]["title"] == "page-3" and rows[0]["body"] == "gravity waves" and rows[0]["rank"] == 1
    assert hybrid(corpus, "gravity waves", None, collections=["misc"]).collect() == []
    small = lambda t: embedder.embed(t, 64)
    out = ask(corpus, "gravity waves", 2, expand=lambda q: {"lex": ["gravity", "unrelated"]}, synthesise=lambda q, r: f"see [[{r[0]['id']}]]", embedder=small)
    assert out["citations"] == ["h3"] and len(out["results"]) == 2
    with pytest.raises(ValueError, match="blank"):
        ask(corpus, "  ")
    assert title_lookup(corpus, "Title 7") == "page-7"
    best = with_bodies(spark.createDataFrame([("h3", None)], "hash string, chunk_seq int"), corpus.chunks, "about gravity").first()
    assert best["body"] == "gravity waves"


def test_knn_join_answers_every_query(spark):
    vecs = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0])], "hash long, seq int, embedding array<float>")
    queries = spark.range(10_050).select(F.col("id").alias("qid"), F.array(F.lit(1.0), (F.col("id") % 2 * 3).cast("double")).cast("array<float>").alias("probe"))
    rows = vectors.knn_join(queries, vecs, 1).collect()
    assert {r["qid"]: r["hash"] for r in rows} == {i: 1 + i % 2 for i in range(10_050)} and len(rows) == 10_050


def test_embedding_queries_see_every_line(spark, tmp_path):
    from quillspark.plans import catalogue

    rows = [(1, "nothing here\nheon of the ouen\nheon of the ouen"), (2, "other words\n\nheon of")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert catalogue.QUERIES["mock_embed"](spark, f"file://{tmp_path}").count() == 5
    found = catalogue.QUERIES["query_embedding"](spark, f"file://{tmp_path}").collect()
    assert len(found) == 2 and found[0]["score"] == 1.0 and 0.5 < found[1]["score"] < 1.0


def test_change_stream(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    lines = [("create", "wiki/a.md", None, 1), ("modify", "wiki/a.md", None, 2), ("remove", "wiki/b.md", None, 3), ("rename", "wiki/c.md", "wiki/d.md", 4), ("create", "wiki/x/deep.md", None, 5), ("error", None, None, 6)]
    (folder / "1.json").write_text("\n".join(json.dumps({"kind": k, "path": p, "to": t, "ts": f"2024-01-01T00:00:0{s}Z"}) for k, p, t, s in lines))
    seen: dict = {}
    query = changes.follow(changes.read_events(spark, f"file://{folder}"), f"file://{tmp_path}/cp", lambda df, n: seen.update({r["path"]: r["action"] for r in df.collect()}))
    query.awaitTermination(60)
    assert seen == {"wiki/a.md": "touch", "wiki/b.md": "remove", "wiki/c.md": "remove", "wiki/d.md": "touch", "": "rescan"}
    docs = spark.createDataFrame([("wiki/a.md", "old"), ("wiki/b.md", "b"), ("wiki/z.md", "z")], "path string, hash string")
    actions = spark.createDataFrame(list(seen.items()), "path string, action string")
    fresh = spark.createDataFrame([("wiki/a.md", "new"), ("wiki/d.md", "d")], "path string, hash string")
    assert {tuple(r) for r in changes.apply_changes(docs, actions, fresh).collect()} == {("wiki/a.md", "new"), ("wiki/d.md", "d"), ("wiki/z.md", "z")}


def test_lint_finds_and_rechecks(spark):
    files = spark.createDataFrame([("wiki", "wiki/a.md", "new body", 8, 1), ("wiki", "wiki/n.md", "b", 1, 1)], "doc_type string, path string, body string, size long, mtime long")
    docs = spark.createDataFrame([("wiki", "wiki/a.md", "0" * 64, 8, 1, "m0"), ("wiki", "wiki/gone.md", "1" * 64, 1, 1, "m1")], "doc_type string, path string, hash string, size long, mtime long, embed_model string")
    pages = spark.createDataFrame([("a", "Alpha Page", "see [[nowhere]] and beta page"), ("beta-page", "Beta Page", "x")], "stem string, title string, body string")
    found = integrity.lint(files, docs, pages, "m1").cache()
    assert {(r["kind"], r["page"], r["target"]) for r in found.collect()} == {
        ("StaleIndex", "a", None), ("UntrackedFile", "n", None), ("MissingFile", "gone", None), ("OutdatedEmbedding", "m0", "1"), ("DanglingLink", "a", "nowhere"), ("MissingLink", "a", "beta-page"),
    }
    later = found.filter("kind <> 'StaleIndex'")
    assert {r["kind"] for r in integrity.still_present(found, later).filter("not present").collect()} == {"StaleIndex"}
    fixed = integrity.repaired(files, docs)
    assert {r["path"] for r in fixed.collect()} == {"wiki/a.md", "wiki/n.md"} and integrity.stale(files, fixed).count() == 0


def test_scalar_edges(spark):
    assert one(spark, T.slug_ascii(F.col("t")), t=" Hello, Wörld!.md") == "hello-w-rld" and one(spark, T.slug_unicode(F.col("t")), t="Wörld  A_b") == "wörld-a-b"
    assert one(spark, T.title_fallback(F.col("b"), F.col("s")), b="x", s="dir/file.tar.gz") == "file.tar" and one(spark, T.title_fallback(F.col("b"), F.col("s")), b="# T \nx", s="u") == "T"
    assert one(spark, T.wiki_links(F.col("t")), t="[[a]] [[b]c]] [[]] [[d") == ["a", "b]c"]
    assert one(spark, T.line_slice(F.col("t"), 2, 5), t="a\nb\nc\n") == "b\nc\n"
    assert one(spark, T.hash_of_raw_path(F.col("t")), t="raw/ab/" + "c" * 62) == "ab" + "c" * 62
    assert one(spark, T.human_size(F.col("n")), n=1536) == "1.5 KB"
    assert one(spark, T.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 0.0]) == 0.0


def test_lines_are_trimmed_of_spaces_and_of_nothing_else(spark):
    """The index of a line is no character to trim: the second line kept neither a 1 at its ends nor the third a 2."""
    rows = spark.createDataFrame([(1, "# a\n1 is 1"), (2, "# a\n\n2 and 2"), (3, "# a\n\u00a0\u3000x \u00a0"), (4, "\u2003\n# b\n")], "i int, body string")
    got = {r["i"]: r["s"] for r in rows.select("i", T.summary_line(F.col("body"), 80).alias("s")).collect()}
    assert got == {1: "1 is 1", 2: "2 and 2", 3: "x", 4: ""}
    cited = rows.limit(1).select(T.citations(F.lit("[[0a0]] [[1b1]] [[ c ]]")).alias("c")).first()["c"]
    assert cited == ["0a0", "1b1", "c"]
