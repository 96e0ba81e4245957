"""An index kept by segments: each commit adds one, graves cover bodies that went, merges fold small ones.

A segment has up to five tables, all keyed by body hash and carrying ``born``, the number of its commit: ``bodies``,
``chunks``, ``postings`` (in term order within each file, so that a query's terms prune row groups and pages), ``vectors`` and
``links``. A grave (hash, died) covers rows of that hash born before it. Statistics for BM25 are kept in the state, which
names segments and graves; nothing is scanned for them.

Chunks that are the lines of bodies repeat their text, so such a segment (``lines``) has no table of chunks: they are made from its
bodies where they are read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import wiki_links
from quillspark.operators import chunking, lexical

SCHEMAS = {
    "bodies": "hash string, body string, born long",
    "chunks": "hash string, seq int, pos int, len int, chunk_text string, dl long, born long",
    "postings": "term string, hash string, seq int, tf long, positions array<int>, dl long, born long",
    "vectors": "hash string, seq int, embedding array<float>, born long",
    "links": "hash string, nth int, dst string, born long",
}
ORDER = {"bodies": ("hash",), "links": ("dst",), "chunks": ("hash", "seq"), "postings": ("term", "hash", "seq"), "vectors": ("hash", "seq")}
#: Segments of one size class that a merge folds into one, and bytes of a row group of postings.
FAN = 4
GROUP_BYTES = 8 << 20
#: Bytes of text of a file of bodies. Chunks and postings are made a file a task, so a sort of a file's postings fits in memory,
#: and its hashes in a dictionary of a row group.
FILE_BYTES = 8 << 20
#: Of zstd: bodies are written once and are the most that compression shortens.
LEVEL = 9


def rows_a_file(n: int, size: int) -> int:
    """Bodies of a file, of ``n`` that have ``size`` bytes."""
    return max(1, FILE_BYTES * n // max(size, 1))


@contextmanager
def _a_file_a_task(spark: SparkSession) -> Iterator[None]:
    """Reads that are carried out meanwhile do not pack files of ``FILE_BYTES`` into larger splits."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(FILE_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _shaped(rows: DataFrame, piece: str, born: int) -> DataFrame:
    rows = rows.withColumn("born", F.lit(born))
    return rows.select(*(F.col(n).cast(t) for n, t in (c.strip().split(" ") for c in SCHEMAS[piece].split(","))))


def _put(rows: DataFrame, path: str, order: tuple[str, ...], most: int = 0, level: int = 3) -> DataFrame:
    out = rows.sortWithinPartitions(*order).write.option("maxRecordsPerFile", most).option("parquet.block.size", GROUP_BYTES).option("parquet.dictionary.page.size", GROUP_BYTES)
    out.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _links(bodies: DataFrame) -> DataFrame:
    return bodies.select("hash", F.posexplode(wiki_links(F.col("body"))).alias("nth", "dst"))


def _sized(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("dl", F.regexp_count(F.lower(F.coalesce("chunk_text", F.lit(""))), F.lit(lexical.TOKEN)).cast("long"))


def _postings(chunks: DataFrame) -> DataFrame:
    return lexical.postings(chunks, "chunk_text", ["hash", "seq"])


def write(root: str, born: int, bodies: DataFrame, most: int, chunker: Callable[[DataFrame], DataFrame], embedder: Callable[[DataFrame], DataFrame] | None = None) -> tuple[dict, DataFrame]:
    """Store a segment of new bodies (hash, body), each once and ``most`` a file, with what follows from them; its description, and
    (hash, chunks, tokens) of the bodies that have chunks."""
    spark = bodies.sparkSession
    name = f"segment-{born}-{uuid.uuid4().hex[:8]}"
    at = f"{root}/{name}"
    kept = _put(_shaped(bodies, "bodies", born), f"{at}/bodies", ORDER["bodies"], most, LEVEL)
    lines = chunker is chunking.chunks_of_lines
    with _a_file_a_task(spark):
        _put(_shaped(_links(kept), "links", born), f"{at}/links", ORDER["links"])
        chunks = chunker(kept.select("hash", "body"))
        if lines:
            texts = _sized(chunking.texts_of_lines(kept))
        else:
            texts = chunks = _put(_shaped(_sized(chunks), "chunks", born), f"{at}/chunks", ORDER["chunks"])
        sizes = _put(texts.groupBy("hash").agg(F.count("*").alias("chunks"), F.sum("dl").alias("tokens")), f"{at}/sizes", ("hash",))
        _put(_shaped(_postings(texts), "postings", born), f"{at}/postings", ORDER["postings"])
    pieces = ["bodies", "links", *([] if lines else ["chunks"]), "postings"]
    if embedder is not None:
        _put(_shaped(embedder(chunks.select("hash", "seq", "pos", "len", "chunk_text")), "vectors", born), f"{at}/vectors", ORDER["vectors"])
        pieces.append("vectors")
    return {"name": name, "born": born, "pieces": pieces, "lines": lines, "n": sizes.agg(F.sum("chunks")).first()[0] or 0}, sizes


def write_graves(root: str, died: int, hashes: DataFrame) -> dict:
    name = f"graves-{died}-{uuid.uuid4().hex[:8]}"
    hashes.select("hash", F.lit(died).cast("long").alias("died")).write.parquet(f"{root}/{name}")
    return {"name": name, "died": died}


def live(spark: SparkSession, root: str, state: dict, piece: str, segments: list[dict] | None = None, hashes: DataFrame | None = None) -> DataFrame:
    """The rows of a table of all segments (or of some) that no grave covers: one scan, and a join with graves where there are any.
    ``hashes`` (hash), few, are the bodies to read alone. Chunks come without ``born``."""
    chosen = state.get("segments", []) if segments is None else segments
    if piece == "chunks" and (lined := [s for s in chosen if s.get("lines")]):
        rows = _sized(chunking.chunks_of_lines(live(spark, root, state, "bodies", lined, hashes)))
        apart = [s for s in chosen if not s.get("lines")]
        return rows.unionByName(live(spark, root, state, "chunks", apart, hashes)) if apart else rows
    chosen = [s for s in chosen if piece in s["pieces"]]
    spare = ["born"] if piece == "chunks" else []
    if not chosen:
        return spark.createDataFrame([], SCHEMAS[piece]).drop(*spare)
    rows = spark.read.schema(SCHEMAS[piece]).parquet(*(f"{root}/{s['name']}/{piece}" for s in chosen))
    if hashes is not None:
        rows = rows.join(F.broadcast(hashes), "hash", "left_semi")
    oldest = min(s["born"] for s in chosen)
    graves = [g for g in state.get("graves", []) if g["died"] > oldest]
    if not graves:
        return rows.drop(*spare)
    dead = spark.read.schema("hash string, died long").parquet(*(f"{root}/{g['name']}" for g in graves)).groupBy("hash").agg(F.max("died").alias("died"))
    return rows.join(dead, (rows["hash"] == dead["hash"]) & (rows["born"] < dead["died"]), "left_anti").drop(*spare)


def merge(spark: SparkSession, root: str, state: dict, fan: int = FAN) -> dict:
    """The state after folding ``fan`` or more segments of one size class, while there are such; graves that cover nothing more go."""
    while True:
        classes: dict[int, list[dict]] = {}
        for s in state["segments"]:
            classes.setdefault(int(math.log(s["n"] + 1, fan)), []).append(s)
        full = next((c for k, c in sorted(classes.items()) if len(c) >= fan), None)
        if full is None:
            break
        born, lines = max(s["born"] for s in full), all(s.get("lines") for s in full)
        pieces = sorted({p for s in full for p in s["pieces"]} | ({"bodies"} if lines else {"chunks"}))
        name = f"segment-{born}-{uuid.uuid4().hex[:8]}"
        made: dict[str, DataFrame] = {}
        with _a_file_a_task(spark):
            for piece in sorted(pieces, key=list(SCHEMAS).index):  # links and postings follow from what lives of bodies and chunks
                rows = _links(made["bodies"]) if piece == "links" else _postings(made["chunks"]) if piece == "postings" else live(spark, root, state, piece, full)
                made[piece] = _put(_shaped(rows, piece, born), f"{root}/{name}/{piece}", ORDER[piece], level=LEVEL if piece == "bodies" else 3)
                if piece == "bodies" and lines:
                    made["chunks"] = chunking.texts_of_lines(made["bodies"])
            n = made["chunks"].count()
        state = state | {"segments": [s for s in state["segments"] if s not in full] + [{"name": name, "born": born, "pieces": pieces, "lines": lines, "n": n}]}
    oldest = min((s["born"] for s in state["segments"]), default=math.inf)
    return state | {"graves": [g for g in state.get("graves", []) if g["died"] > oldest]}


def index(spark: SparkSession, root: str, state: dict) -> lexical.LexicalIndex:
    """The BM25 index of what lives, with its statistics from the state."""
    n, tokens = state.get("n", 0), state.get("tokens", 0)
    return lexical.LexicalIndex(live(spark, root, state, "postings").drop("born"), ["hash", "seq"], stats=(n, tokens / n if n else 0.0))
