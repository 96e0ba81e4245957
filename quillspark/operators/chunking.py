"""Chunkers: Markdown sections, semantic breaks, sentence packing, and packing for prompts.

Line-wise parsers and packers carry state from line to line, so they run per document in Arrow batches;
distances and percentiles between sentence groups are windows over rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.embedder import embed_all, prompt_prefix
from quillspark.functions.text import SPACES, cosine
from quillspark.session import bounded_batches

CONTEXT, MARGIN = 2048, 4
CHUNK_SIZE, OVERLAP = 1024, 200
MAX_CHUNKS = 20
TURN_TOKENS = 24
HEADER = re.compile(r"^(#+)\s+(.*)$")
FENCE = re.compile(r"^(```|~~~)")
SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+[\"')\]]*(?=\s|$)\s*|\n+|$)")


def estimate_tokens(text: str) -> int:
    return max(-(-len(text) // 3), -(-len(text.encode()) // 4))


def sections(text: str) -> list[dict]:
    """Sections under headings at the start of a line, outside fences; blank ones go.

    Each has byte position and length, its text, and the path of the headings above it.
    """
    out, stack, start, fenced = [], [], 0, False
    own: list[str] = []
    at = 0

    def close(end: int) -> None:
        raw = data[start:end]
        if raw.strip():
            out.append({"seq": len(out), "pos": start, "len": end - start, "text": raw.decode(), "path": "/".join(own[:-1]) if own else ""})

    data = text.encode()
    for line in re.findall(rb"[^\n]*\n|[^\n]+", data):
        shown = line.decode().rstrip("\n")
        if FENCE.match(shown.lstrip()):
            fenced = not fenced
        head = None if fenced else HEADER.match(shown)
        if head:
            close(at)
            start = at
            level = len(head[1])
            stack = [(n, t) for n, t in stack if n < level] + [(level, head[2].strip())]
            own = [t for _, t in stack]
        at += len(line)
    close(at)
    return out


def sentences(text: str) -> list[str]:
    """Sentences with their trailing space; blank ones go."""
    return [s for s in SENTENCE.findall(text) if s.strip()]


# Fixed value: the secondary pattern of the sentence cascade.
PHRASE = r"[^,.;。？！]+[,.;。？！]?|[,.;。？！]"


def _cascade(text: str, size: int, count: Callable[[str], int]) -> list[str]:
    """Pieces of at most ``size`` tokens: by blank lines, sentences, phrases, words, characters."""
    if count(text) <= size:
        return [text]
    for split in (
        lambda t: re.split(r"(?<=\n\n\n)", t),
        sentences,
        lambda t: re.findall(PHRASE, t),
        lambda t: re.findall(r"\S*\s*", t)[:-1] or [t],
        list,
    ):
        parts = [p for p in split(text) if p]
        if len(parts) > 1:
            return [piece for part in parts for piece in _cascade(part, size, count)]
    return [text]


def _packed(costs: list[int], size: int, overlap: int) -> list[range]:
    """Runs of pieces of at most ``size`` tokens, each sharing up to ``overlap`` with the one before."""
    out, first, total = [], 0, 0
    for i, n in enumerate(costs):
        if i > first and total + n > size:
            out.append(range(first, i))
            while first < i and (total > overlap or total + n > size):
                total -= costs[first]
                first += 1
        total += n
    return [*out, range(first, len(costs))] if first < len(costs) else out


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP, count: Callable[[str], int] = lambda t: len(t.split())) -> list[str]:
    """Chunks of at most ``size`` tokens that share up to ``overlap`` with their predecessor."""
    pieces = _cascade(text, size, count)
    chunks = ("".join(pieces[i] for i in run) for run in _packed([count(p) for p in pieces], size, overlap))
    return [c.strip() for c in chunks if c.strip()]


def split_spans(text: str, size: int, overlap: int = OVERLAP, count: Callable[[str], int] = lambda t: len(t.split())) -> list[tuple[int, int]]:
    """The same chunks as places in the text, without the space around them."""
    pieces, places, at = _cascade(text, size, count), [], 0
    for p in pieces:
        at = text.index(p, at)
        places.append((at, at + len(p)))
        at += len(p)
    out = []
    for run in _packed([count(p) for p in pieces], size, overlap):
        start, end = places[run[0]][0], places[run[-1]][1]
        solid = text[start:end].strip()
        if solid:
            start = text.index(solid, start)
            out.append((start, start + len(solid)))
    return out


def semantic_spans(text: str, embed_batch: Callable[[list[str]], np.ndarray], count: Callable[[str], int], limit: int, buffer: int = 1, percent: float = 95.0) -> list[tuple[int, int]]:
    """Places of the chunks of a section: cut where a sentence with its neighbours is further from the next than the percentile of such distances.

    Without a sentence there is none. Where a sentence with its neighbours has more than ``limit`` tokens the section stays whole.
    """
    spans = [m.span() for m in SENTENCE.finditer(text) if m[0].strip()]
    if not spans:
        return []
    if len(spans) == 1:
        return [(0, len(text))]
    said = [text[a:b] for a, b in spans]
    groups = ["".join(said[max(0, i - buffer) : i + 1 + buffer]) for i in range(len(said))]
    if any(count(g) > limit for g in groups):
        return [(0, len(text))]
    v = np.asarray(embed_batch(groups), np.float64)
    norms = np.sqrt((v * v).sum(axis=1))
    size = norms[:-1] * norms[1:]
    far = 1 - np.where(size > 0, (v[:-1] * v[1:]).sum(axis=1) / np.where(size > 0, size, 1), 0.0)
    cuts = [spans[i + 1][0] for i in np.flatnonzero(far > np.percentile(far, percent)).tolist()]
    edges = [spans[0][0], *cuts, len(text)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def pipeline(text: str, title: str, embed_batch: Callable[[list[str]], np.ndarray], count: Callable[[str], int] = lambda t: len(t.split()), limit: int = CONTEXT - MARGIN) -> list[tuple[int, int, str]]:
    """(pos, len, text) in bytes: sections, cut by meaning, and what has more tokens than fit behind the prompt cut again."""
    room = max(1, limit - count(prompt_prefix(title)))
    out, data = [], text.encode()
    for s in sections(text):
        body = s["text"]
        for a, b in semantic_spans(body, embed_batch, count, limit):
            part = body[a:b]
            places = [(0, len(part))] if count(part) <= room else split_spans(part, room, count=count) or [(0, len(part))]
            for x, y in places:
                pos, size = s["pos"] + len(body[: a + x].encode()), len(part[x:y].encode())
                out.append((pos, size, data[pos : pos + size].decode()))
    return out


def pack_markdown(text: str, cap: int, limit: int = MAX_CHUNKS) -> list[str]:
    """Chunks up to ``cap`` tokens of whole top sections, else paragraphs, else lines; too many raise."""
    parts: list[str] = []
    fenced, held = False, ""
    for line in text.splitlines(keepends=True):
        if FENCE.match(line.lstrip()):
            fenced = not fenced
        if not fenced and re.match(r"#{1,2}\s", line) and held:
            parts.append(held)
            held = ""
        held += line
    parts += [held] if held else []

    def fit(part: str, ways: list[str]) -> list[str]:
        if estimate_tokens(part) <= cap or not ways:
            return [part]
        pieces = [x for x in re.split(ways[0], part) if x]
        return [y for x in pieces for y in fit(x, ways[1:])]

    chunks, held = [], ""
    for piece in (x for p in parts for x in fit(p, [r"(?<=\n\n)", r"(?<=\n)"])):
        if held and estimate_tokens(held + piece) > cap:
            chunks.append(held)
            held = ""
        held += piece
    chunks += [held] if held.strip() else []
    if len(chunks) > limit:
        raise ValueError(f"{len(chunks)} chunks, {limit} allowed")
    return chunks


def pack_turns(turns: list[str], cap: int, limit: int = MAX_CHUNKS, overlap: int = 3) -> list[list[int]]:
    """Numbers of whole turns by chunk; each chunk but the first repeats up to ``overlap`` turns, as far as they fit."""
    cost = [estimate_tokens(t) + TURN_TOKENS for t in turns]
    for i, c in enumerate(cost):
        if c > cap:
            raise ValueError(f"turn {i} has {c} tokens")
    reserve = overlap * max(1, sum(cost) // len(cost)) if cost else 0
    chunks: list[list[int]] = []
    held: list[int] = []
    for i, c in enumerate(cost):
        room = cap if not chunks else max(0, cap - reserve)
        if held and sum(cost[j] for j in held) + c > room:
            chunks.append(held)
            held = []
        held.append(i)
    chunks += [held] if held else []
    if len(chunks) > limit:
        raise ValueError(f"{len(chunks)} chunks, {limit} allowed")
    out = chunks[:1]
    for before, chunk in zip(chunks, chunks[1:], strict=False):
        lead = before[-overlap:] if overlap else []
        while lead and sum(cost[j] for j in lead + chunk) > cap:
            lead = lead[1:]
        out.append(lead + chunk)
    return out


# --- as operators ----------------------------------------------------------------------------------

SECTION_SCHEMA = "seq int, pos int, len int, text string, path string"


def line_chunks(docs: DataFrame, body: str = "body") -> DataFrame:
    """(hash, seq, pos, len, chunk_text): lines that are not blank, by byte span; one set for each body."""
    return chunks_of_lines(docs.select("hash", F.col(body).alias("body")).dropDuplicates(["hash"]))


def chunks_of_lines(bodies: DataFrame) -> DataFrame:
    """The same of bodies (hash, body) of which there is one a hash: a body's lines are counted where it is read, without an exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("lines")
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            lines = lists.flatten()
            size = pc.binary_length(lines.cast(pa.binary())).to_numpy().astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(size + 1)])
            row = np.repeat(np.arange(len(n)), n)
            pos = upto[:-1] - np.repeat(upto[np.cumsum(n) - n], n)
            solid = np.flatnonzero(pc.not_equal(pc.utf8_trim(lines, SPACES), "").to_numpy(zero_copy_only=False))
            if not len(solid):
                continue
            own, at = row[solid], pa.array(solid)
            seq = np.arange(len(own)) - np.searchsorted(own, own)
            yield pa.record_batch([batch.column("hash").take(pa.array(own)), pa.array(seq, pa.int32()), pa.array(pos[solid], pa.int32()), pa.array(size[solid], pa.int32()), lines.take(at)], names=["hash", "seq", "pos", "len", "chunk_text"])

    bounded_batches(bodies.sparkSession)
    return bodies.select("hash", F.split("body", "\n").alias("lines")).mapInArrow(run, "hash string, seq int, pos int, len int, chunk_text string")


def texts_of_lines(bodies: DataFrame) -> DataFrame:
    """(hash, seq, chunk_text) of the same chunks, for steps that need no places and have a Python worker of their own."""
    solid = F.filter(F.split("body", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return bodies.select("hash", F.posexplode(solid).alias("seq", "chunk_text"))


def markdown_chunks(docs: DataFrame, body: str = "body") -> DataFrame:
    """(hash, seq, pos, len, text, path) of Markdown sections, one set for each body."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"hash": h, **s} for h, b in zip(batch["hash"], batch["body"], strict=True) for s in sections(b or "")]
            if rows:
                yield pd.DataFrame(rows)

    bounded_batches(docs.sparkSession)
    return docs.select("hash", F.col(body).alias("body")).dropDuplicates(["hash"]).mapInPandas(run, "hash string, " + SECTION_SCHEMA)


def fence_parity(lines: DataFrame) -> DataFrame:
    """Lines (hash, n, line) with whether they are inside a fence."""
    upto = Window.partitionBy("hash").orderBy("n")
    return lines.withColumn("fenced", F.sum(F.col("line").rlike(r"^\s*(```|~~~)").cast("int")).over(upto) % 2 == 1)


def percentile_breaks(groups: DataFrame, percent: float = 0.95) -> DataFrame:
    """Semantic chunks of (hash, seq, embedding): a break where the distance to the next group exceeds the percentile of its body."""
    order = Window.partitionBy("hash").orderBy("seq")
    far = groups.withColumn("distance", 1.0 - cosine(F.col("embedding"), F.lead("embedding").over(order)))
    far = far.withColumn("distance", F.when(F.lead("seq").over(order).isNotNull(), F.col("distance")))
    edge = far.withColumn("limit", F.expr(f"percentile(distance, {percent})").over(Window.partitionBy("hash")))
    cut = edge.withColumn("is_break", F.coalesce(F.col("distance") > F.col("limit"), F.lit(False)))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("chunk", F.coalesce(F.sum(F.col("is_break").cast("int")).over(before), F.lit(0)))


def _per_document(docs: DataFrame, make: Callable[[str], list[str]], body: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, c) for i, b in zip(batch["doc_id"], batch["body"], strict=True) for n, c in enumerate(make(b or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "text"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", F.col(body).alias("body")).mapInPandas(run, "doc_id long, seq int, text string")


def split_documents(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP, body: str = "body") -> DataFrame:
    return _per_document(docs, lambda b: split_text(b, size, overlap), body)


def pack_documents(docs: DataFrame, cap: int, limit: int = MAX_CHUNKS, body: str = "body") -> DataFrame:
    """(doc_id, seq, text, error): packed chunks; a document that cannot be packed has one row that says why."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, b in zip(batch["doc_id"], batch["body"], strict=True):
                try:
                    rows += [(i, n, c, None) for n, c in enumerate(pack_markdown(b or "", cap, limit))]
                except ValueError as e:
                    rows.append((i, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "text", "error"]).astype({"seq": "Int32"})

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", F.col(body).alias("body")).mapInPandas(run, "doc_id long, seq int, text string, error string")


def full_pipeline(docs: DataFrame, embed_batch: Callable[[list[str]], np.ndarray] = embed_all, count: Callable[[str], int] = lambda t: len(t.split()), limit: int = CONTEXT - MARGIN, body: str = "body") -> DataFrame:
    """(doc_id, seq, pos, len, text): the chunks that are stored for retrieval, of documents (doc_id, title, body).

    A document is a row, so its sections, sentence groups, vectors and budget are worked out where it is read, without an exchange.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, *c) for i, t, b in zip(batch["doc_id"], batch["title"], batch["body"], strict=True) for n, c in enumerate(pipeline(b or "", t or "", embed_batch, count, limit))]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "pos", "len", "text"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "title", F.col(body).alias("body")).mapInPandas(run, "doc_id long, seq int, pos int, len int, text string")


def pack_sessions(turns: DataFrame, cap: int, limit: int = MAX_CHUNKS, overlap: int = 3) -> DataFrame:
    """(conv_id, chunk, turns, error): packed turn numbers of (conv_id, turn, text); one session is one group, as prompts need it
    whole. A session that cannot be packed has one row that says why."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        numbers, own = pdf["turn"].tolist(), int(pdf["conv_id"].iloc[0])
        try:
            packed = pack_turns([t or "" for t in pdf["text"]], cap, limit, overlap)
        except ValueError as e:
            return pd.DataFrame({"conv_id": [own], "chunk": pd.array([None], "Int32"), "turns": [None], "error": [str(e)]})
        return pd.DataFrame({"conv_id": [own] * len(packed), "chunk": pd.array(range(len(packed)), "Int32"), "turns": [[numbers[i] for i in c] for c in packed], "error": [None] * len(packed)})

    return turns.groupBy("conv_id").applyInPandas(run, "conv_id long, chunk int, turns array<long>, error string")
