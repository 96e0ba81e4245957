"""Hybrid retrieval: lexical and vector lanes by document type, fused, with bodies; and the question handler.

``Corpus`` holds the tables: docs (doc_id, doc_type, path, title, hash, size, mtime), chunks (hash, seq, chunk_text),
vectors (hash, seq, embedding), memberships (doc_id, name), the indexes of chunks and titles, and the listing of
files (doc_type, path, size, mtime), against which results are dropped that no longer are what was indexed. ``texts`` gives the chunks of
a few bodies (hash) where that reads less than ``chunks``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.embedder import embed
from quillspark.operators import fusion, lexical, vectors
from quillspark.operators.lookup import memberships
from quillspark.session import stage

LANE, POOL, WIDE_POOL = 20, 200, 600
#: Candidates of a title lookup; chunks fetched for each body wanted of a lane and of a pool.
TITLES, OVERFETCH, POOL_FETCH = 5, 3, 15
PRIMARY, EXPANDED = 2.0, 1.0
TOP_K, MOST = 10, 1000
KEYS = ("path", "chunk_seq")


@dataclass
class Expansion:
    """More probes for a question: terms, embeddings and a hypothetical answer."""

    lex: list[str] = field(default_factory=list)
    vectors: list[list[float]] = field(default_factory=list)
    answer: str = ""


@dataclass
class Corpus:
    docs: DataFrame
    chunks: DataFrame
    vectors: DataFrame | None = None
    members: DataFrame | None = None
    index: lexical.LexicalIndex | None = None
    titles: lexical.LexicalIndex | None = None
    files: DataFrame | None = None
    texts: Callable[[DataFrame], DataFrame] | None = None
    _hits: dict[str, DataFrame] = field(default_factory=dict, repr=False)
    _chosen: dict[tuple[str, ...], DataFrame] = field(default_factory=dict, repr=False)

    def lexical(self) -> lexical.LexicalIndex:
        if self.index is None:
            self.index = lexical.LexicalIndex.build(self.chunks, "chunk_text", ["hash", "seq"])
        return self.index

    def hits(self, query: str) -> DataFrame:
        """Chunk hits of a query; the lanes of both document types share one plan."""
        if query not in self._hits:
            self._hits[query] = lexical.search(self.lexical(), query)
        return self._hits[query]

    def selected(self, doc_type: str, collections: list[str] | None) -> DataFrame:
        """Documents of a type. None selects all; a selection those of its collections (``default`` where they have none),
        and an empty one ``default``."""
        rows = self.docs.select("hash", "doc_id", "doc_type", "path", "title")
        if collections is not None and self.members is not None:
            names = tuple(sorted({c.strip().lower() for c in collections} - {""})) or ("default",)
            if names not in self._chosen:  # judged once and not once a lane
                named = memberships(self.docs, self.members).filter(F.arrays_overlap("collections", F.array(*map(F.lit, names)))).select("doc_id")
                self._chosen[names] = stage(rows.join(named, "doc_id", "left_semi"), "selected")
            rows = self._chosen[names]
        return rows.filter(F.col("doc_type") == doc_type)


def lexical_lane(corpus: Corpus, query: str, doc_type: str, collections: list[str] | None) -> DataFrame:
    """Chunk hits with one row for each document that has the body."""
    hits = corpus.hits(query)
    return hits.join(corpus.selected(doc_type, collections), "hash").withColumnRenamed("seq", "chunk_seq")


def vector_lane(corpus: Corpus, probe: list[float], doc_type: str, collections: list[str] | None) -> DataFrame:
    """The best chunk of each of the nearest bodies, with one row for each document."""
    docs = corpus.selected(doc_type, collections)
    pool = POOL if collections in (None, ["default"]) else WIDE_POOL
    near = vectors.nearest(corpus.vectors.join(docs.select("hash").distinct(), "hash", "left_semi"), probe, pool * POOL_FETCH)
    return docs.join(F.broadcast(vectors.collapse(near, pool)), "hash").withColumnRenamed("seq", "chunk_seq")  # at most WIDE_POOL rows


def signal_of(lanes: list[DataFrame], intent: bool = False) -> DataFrame:
    """(lane, s1, s2, strong) of ranked lanes."""
    rows = None
    for lane in lanes:
        part = lane.groupBy("lane").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.withColumn("strong", lexical.strong_signal(F.col("s1"), F.col("s2"), intent))


def hybrid(corpus: Corpus, question: str, probe: list[float] | None = None, expansion: Expansion | None = None, collections: list[str] | None = None, intent: str | None = None, top_k: int = TOP_K) -> DataFrame:
    """(rank, id, path, title, doc_type, chunk_seq, score, signal, body), best first."""
    expansion = expansion or Expansion()
    lanes, primary = [], []
    payload = ("hash", "doc_type", "title")

    def lane(rows: DataFrame, name: str, weight: float) -> DataFrame:
        ranked = fusion.ranked(rows, name, weight, LANE, KEYS).persist()  # at most LANE rows, used by fusion and signal
        lanes.append(ranked)
        return ranked

    for kind in ("wiki", "raw"):
        primary.append(lane(lexical_lane(corpus, question, kind, collections), f"lex-{kind}", PRIMARY))
    if probe is not None and corpus.vectors is not None:
        for kind in ("wiki", "raw"):
            lane(vector_lane(corpus, probe, kind, collections), f"vec-{kind}", PRIMARY)
    for n, term in enumerate(expansion.lex):
        for kind in ("wiki", "raw"):
            lane(lexical_lane(corpus, term, kind, collections), f"lex{n}-{kind}", EXPANDED)
    for n, more in enumerate(expansion.vectors if corpus.vectors is not None else []):
        for kind in ("wiki", "raw"):
            lane(vector_lane(corpus, more, kind, collections), f"vec{n}-{kind}", EXPANDED)
    fused = fusion.fuse(lanes, keys=KEYS, payload=payload).filter("score >= 0")
    if corpus.files is not None:
        fused = unchanged(fused.join(corpus.docs.select("doc_type", "path", "size", "mtime"), ["doc_type", "path"]), corpus.files)
    # at most MOST rows, used by both body joins
    fused = fused.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("position"))).filter(F.col("place") <= min(top_k, MOST)).persist()
    strong = signal_of(primary, intent is not None).agg(F.coalesce(F.max("strong"), F.lit(False)).alias("strong"))
    chunks = corpus.texts(fused.select("hash").distinct()) if corpus.texts is not None else corpus.chunks
    return (
        with_bodies(fused, chunks, question, expansion, intent)
        .crossJoin(F.broadcast(strong))  # one row
        .select(
            F.col("place").alias("rank"),
            T.short_id(F.col("hash")).alias("id"),
            "path",
            F.when(F.col("doc_type") == "wiki", T.stem_of_path(F.col("path"))).otherwise(F.col("title")).alias("title"),
            "doc_type",
            "chunk_seq",
            "score",
            F.when(F.col("strong"), "strong").otherwise("weak").alias("signal"),
            "body",
        )
        .orderBy("rank")
    )


def query_terms(question: str, expansion: Expansion) -> list[str]:
    text = " ".join([question, *expansion.lex, expansion.answer]).lower()
    words = (re.sub(r"^\W+|\W+$", "", w) for w in text.split())
    return list(dict.fromkeys(w for w in words if w and w not in T.STOP_WORDS))


def with_bodies(results: DataFrame, chunks: DataFrame, question: str, expansion: Expansion | None = None, intent: str | None = None) -> DataFrame:
    """Attach chunk text: the chunk that was hit, else the chunk with the most of the question's terms."""
    terms = query_terms(question, expansion or Expansion())
    hints = [w for w in re.findall(r"\w+", (intent or "").lower()) if len(w) > 1 and w not in T.STOP_WORDS]
    mine = chunks.join(F.broadcast(results.select("hash").distinct()), "hash", "left_semi")  # at most MOST rows
    best = mine.groupBy("hash").agg(F.max_by("chunk_text", F.struct(T.chunk_score(F.col("chunk_text"), terms, hints), -F.col("seq"))).alias("best"))
    hit = mine.select("hash", F.col("seq").alias("chunk_seq"), F.col("chunk_text").alias("hit"))
    return results.join(hit, ["hash", "chunk_seq"], "left").join(best, "hash", "left").withColumn("body", F.coalesce("hit", "best")).drop("hit", "best")


def title_slugs(corpus: Corpus, titles: DataFrame, embedder: Callable[[DataFrame], DataFrame] | None = None, collections: list[str] | None = None) -> DataFrame:
    """(tid, slug): the page that each of ``titles`` (tid, title) names, null where no page shares its words.

    The five best pages by title are candidates. If the best stands out it is taken; else it is fused, at twice the
    weight, with the pages nearest to the title's vector: ``embedder`` turns (tid, title) into (tid, probe), for such titles alone.
    """
    pages = corpus.selected("wiki", collections if collections is not None else ["default"]).select("doc_id", "hash", "path")
    asked = titles.select("tid", F.col("title").alias("query"))
    # Titles of the same words match alike: they are one text, of which the first pages by path can be among the best.
    if corpus.titles is not None:
        said, stats = lexical.texts_of(corpus.titles), corpus.titles.stats
    else:
        said, stats = corpus.docs.select("doc_id", F.array_join(F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit(lexical.TOKEN), F.lit(0)), " ").alias("text")), None
    named = stage(pages.join(said, "doc_id"), "named")
    alike = said.groupBy("text").agg(F.count("*").alias("n")).withColumn("wanted", F.lit(False)).union(named.select("text", F.lit(0).cast("long"), F.lit(True)).distinct())
    texts = stage(alike.groupBy("text").agg(F.sum("n").alias("n"), F.bool_or("wanted").alias("wanted")), "texts")
    if stats is None:
        row = texts.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", " ")))).alias("words")).first()
        stats = (row["n"] or 0, row["words"] / row["n"] if row["n"] else 0.0)
    by_path = Window.partitionBy("text").orderBy("path")
    first_of = named.withColumn("nth", F.row_number().over(by_path)).filter(F.col("nth") <= TITLES).select("text", "path")
    hits = lexical.search_texts(texts, stats, asked).join(first_of, "text")
    best_first = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "path")
    five = stage(hits.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= TITLES).select("query", "path", "rank", "score"), "titles")
    signal = five.groupBy("query").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"), F.min_by("path", "rank").alias("first"))
    judged = asked.join(signal, "query", "left").withColumn("strong", lexical.strong_signal(F.col("s1"), F.col("s2")))
    lane = judged.filter("first is not null and not strong").join(five, "query").select("tid", "path", "rank", F.lit(2.0).alias("weight"))
    if embedder is not None and corpus.vectors is not None:
        probes = embedder(judged.filter("first is not null and not strong").select("tid", F.col("query").alias("title"))).select(F.col("tid").alias("qid"), "probe")
        near = vectors.knn_lookup(probes, corpus.vectors.join(named.select("hash").distinct(), "hash", "left_semi"), LANE * OVERFETCH)
        of_body = Window.partitionBy("hash").orderBy("path")
        bodies = named.withColumn("nth", F.row_number().over(of_body)).filter(F.col("nth") <= LANE).select("hash", "path")
        closest = near.groupBy("qid", "hash").agg(F.max("score").alias("score")).join(bodies, "hash")
        nearest_first = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "path")
        ranked = closest.withColumn("rank", F.row_number().over(nearest_first)).filter(F.col("rank") <= LANE)
        lane = lane.union(ranked.select(F.col("qid").alias("tid"), "path", "rank", F.lit(1.0).alias("weight")))
    fused = lane.groupBy("tid", "path").agg(F.sum(fusion.gain(F.col("weight"), F.col("rank"))).alias("rrf"))
    chosen = fused.groupBy("tid").agg(F.min_by("path", F.struct((-F.round("rrf", 12)).alias("back"), "path")).alias("fused"))
    return judged.join(chosen, "tid", "left").select("tid", T.stem_of_path(F.when(F.col("strong"), F.col("first")).otherwise(F.col("fused"))).alias("slug"))


def title_lookup(corpus: Corpus, title: str, embedder: Callable[[DataFrame], DataFrame] | None = None) -> str | None:
    """The slug of the page that a title names, if any."""
    one = corpus.docs.sparkSession.createDataFrame([(0, title)], "tid long, title string")
    return title_slugs(corpus, one, embedder).first()["slug"]


def unchanged(results: DataFrame, files: DataFrame) -> DataFrame:
    """Results whose file still has the size and time of its row."""
    disk = files.select("doc_type", "path", F.col("size").alias("_s"), F.col("mtime").alias("_m"))
    return results.join(disk, ["doc_type", "path"]).filter("size = _s and mtime = _m").drop("_s", "_m")


def ask(corpus: Corpus, question: str, top_k: int = TOP_K, collections: list[str] | None = None, intent: str | None = None, expand: Callable[[str], dict] | None = None, synthesise: Callable[[str, list[dict]], str] | None = None, embedder: Callable[[str], list[float]] = embed) -> dict:
    """Answer a question: retrieve; if the signal is weak and ``expand`` is given, retrieve again with its
    probes; if ``synthesise`` is given, answer from the results. A failing callable falls back to raw results."""
    if not question.strip():
        raise ValueError("the question is blank")
    top_k = max(1, min(top_k, MOST))
    asked = f"{intent}: {question}" if intent else question
    probe = embedder(asked) if corpus.vectors is not None else None
    rows = [r.asDict() for r in hybrid(corpus, question, probe, None, collections, intent, top_k).collect()]  # at most MOST
    if expand and (not rows or rows[0]["signal"] == "weak"):
        try:
            more = expand(asked)
        except Exception:  # noqa: BLE001  any failure of an injected model falls back
            more = {}
        terms = {t for t in re.split("[^A-Za-z0-9]+", question.lower()) if len(t) >= 2}
        lex = [t for t in more.get("lex", []) if any(w in t.lower() for w in terms)]
        probes = [embedder(t) for t in [*more.get("vec", []), *more.get("hyde", [])] if corpus.vectors is not None and any(w in t.lower() for w in terms)]
        again = hybrid(corpus, question, probe, Expansion(lex, probes, " ".join(more.get("hyde", []))), collections, intent, top_k)
        rows = [r.asDict() for r in again.collect()] or rows
    if not rows:
        raise LookupError("nothing matches")
    out = {"results": rows, "answer": None, "citations": []}
    if synthesise:
        try:
            answer = synthesise(question, rows)
            cited = list(dict.fromkeys(re.findall(r"\[\[([^\]]+)\]\]", answer)))
            out |= {"answer": answer, "citations": cited}
        except Exception:  # noqa: BLE001
            pass
    return out


def context_block(rows: list[dict]) -> str:
    """Results as one JSON document."""
    return json.dumps({"results": [{k: r[k] for k in ("id", "title", "doc_type", "rank", "signal", "body")} for r in rows]}, ensure_ascii=False)
