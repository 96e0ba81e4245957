"""The knowledge-base tables over the supplied test data, as DataFrames and as SQL with the same columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.chunking import line_chunks
from quillspark.plans.library import Library, members_of
from quillspark.plans.retrieval import Corpus
from quillspark.session import stage, workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: every fourth a wiki page, others raw; raw paths carry the id, as bodies repeat."""
    wiki = F.col("doc_id") % 4 == 0
    stem = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    digest = T.body_hash(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(wiki, "wiki").otherwise("raw").alias("doc_type"),
        digest.alias("hash"),
        stem.alias("stem"),
        F.when(wiki, T.wiki_path(stem)).otherwise(F.concat(T.raw_path(digest), F.lit("-"), F.col("doc_id").cast("string"))).alias("path"),
        F.array_join(F.slice(F.split("text", " ", 5), 1, 4), " ").alias("title"),
        F.col("text").alias("body"),
        "source",
        "lang",
        F.octet_length("text").cast("long").alias("size"),
        (F.col("doc_id") * 1000).alias("mtime"),
        F.when(F.col("doc_id") % 3 == 0, "model-a").when(F.col("doc_id") % 3 == 1, "model-b").alias("embed_model"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships: documents but each fifth are in a collection named by language, each second in one named by source."""
    rows = docs(spark, sf_dir).filter("doc_id % 5 <> 0")
    return rows.select("doc_id", F.col("lang").alias("name")).union(rows.filter("doc_id % 2 = 0").select("doc_id", F.col("source").alias("name")))


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wiki pages with two links each, some to no page."""
    link = lambda k, m: F.concat(F.lit(" [[doc-"), (F.col("doc_id") * k % m).cast("string"), F.lit("]]"))
    return docs(spark, sf_dir).filter("doc_type = 'wiki'").withColumn("body", F.concat("body", link(7, 1500), link(8, 400)))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks(docs(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """The first chunk of the documents (of ``rows`` of them) that have an embedding."""
    keys = (docs(spark, sf_dir) if rows is None else rows).select("doc_id", "hash")
    rows = table(spark, sf_dir, "embeddings").join(keys, F.col("vec_id") == F.col("doc_id"))
    first = rows.groupBy("hash").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return first.select("hash", F.lit(0).alias("seq"), "embedding")


def _signature(spark: SparkSession, path: str) -> str:
    """What changes when the files of a table do."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    summary, status = fs.getContentSummary(place), fs.getFileStatus(place)
    return f"{path} {summary.getLength()} {summary.getFileCount()} {status.getModificationTime()}"


def store_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The folder of a store over a folder of tables as they are now."""
    key = " ".join(_signature(spark, f"{sf_dir}/{t}.parquet") for t in ("documents", "embeddings"))
    return f"{workspace(spark)}/{name}-{hashlib.sha256(key.encode()).hexdigest()[:16]}"


def collections_of(rows: DataFrame) -> DataFrame:
    """``rows`` with the names that ``members`` gives them as a column."""
    names = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(F.array("lang"))
    return rows.withColumn("collections", names)


def library(spark: SparkSession, sf_dir: str) -> Library:
    """The derived store over a folder of tables. It is filled by the first query that asks for it and read by all others of
    the application; where the files change it is filled anew."""
    store = Library(spark, store_path(spark, sf_dir, "library"), embedder=lambda chunks: vectors(spark, sf_dir))
    if not store.version:
        store.commit(collections_of(docs(spark, sf_dir)))
    return store


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The tables of retrieval, from the store."""
    store = library(spark, sf_dir)
    rows = store.documents()
    return Corpus(rows, store.live("chunks"), store.live("vectors"), members_of(rows), store.index(), texts=store.chunks_of)


def titles(spark: SparkSession, sf_dir: str) -> Corpus:
    """The tables of title lookups, which ask for no text: documents and vectors without the store."""
    rows = stage(docs(spark, sf_dir).select("doc_id", "doc_type", "path", "title", "hash"), "titled")
    return Corpus(rows, rows.select("hash").limit(0), vectors(spark, sf_dir, rows), members(spark, sf_dir))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_id") % 7 == 0, "pending").when(F.col("event_id") % 7 == 1, "processing").when(F.col("event_id") % 7 == 2, "failed").otherwise("completed")
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("job_id"), "event_type", status.alias("status"), F.col("ts").alias("updated_at"), F.lit(None).cast("string").alias("error"))


def html_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


DOCS = """docs AS (
  SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'wiki' ELSE 'raw' END AS doc_type, sha256(text) AS hash, 'doc-' || doc_id AS stem,
         CASE WHEN doc_id % 4 = 0 THEN 'wiki/doc-' || doc_id || '.md'
              ELSE 'raw/' || sha256(text)[1:2] || '/' || sha256(text)[3:64] || '-' || doc_id END AS path,
         array_to_string(string_split(text, ' ')[1:4], ' ') AS title, text AS body, source, lang,
         CAST(octet_length(encode(text)) AS BIGINT) AS size, doc_id * 1000 AS mtime,
         CASE doc_id % 3 WHEN 0 THEN 'model-a' WHEN 1 THEN 'model-b' END AS embed_model
  FROM documents)"""
MEMBERS = DOCS + """, members AS (
  SELECT doc_id, lang AS name FROM docs WHERE doc_id % 5 <> 0
  UNION ALL SELECT doc_id, source FROM docs WHERE doc_id % 5 <> 0 AND doc_id % 2 = 0)"""
CHUNKS = DOCS + r""", bodies AS (SELECT DISTINCT hash, body FROM docs
), parts AS (SELECT hash, string_split(body, chr(10)) AS ls FROM bodies
), lines AS (SELECT hash, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM parts
), placed AS (
  SELECT hash, n, line, octet_length(encode(line)) AS len,
         coalesce(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY hash ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM lines
), chunks AS (
  SELECT hash, CAST(row_number() OVER (PARTITION BY hash ORDER BY n) - 1 AS BIGINT) AS seq, CAST(pos AS BIGINT) AS pos, CAST(len AS BIGINT) AS len, line AS chunk_text
  FROM placed WHERE trim(line) <> '')"""
PAGES = DOCS + """, pages_ AS (
  SELECT doc_id, stem, title, body || ' [[doc-' || (doc_id * 7 % 1500) || ']] [[doc-' || (doc_id * 8 % 400) || ']]' AS body FROM docs WHERE doc_type = 'wiki'
), edges AS (
  SELECT stem AS src, generate_subscripts(regexp_extract_all(body, '\\[\\[([^\\]]+)\\]\\]', 1), 1) - 1 AS nth,
         unnest(regexp_extract_all(body, '\\[\\[([^\\]]+)\\]\\]', 1)) AS dst FROM pages_)""".replace("\\\\", "\\")
VECTORS = DOCS + """, vectors AS (
  SELECT hash, 0 AS seq, arg_min(embedding, vec_id) AS embedding FROM embeddings JOIN docs ON vec_id = doc_id GROUP BY hash)"""
JOBS = """jobs AS (
  SELECT CAST(event_id AS VARCHAR) AS job_id, event_type,
         CASE event_id % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' ELSE 'completed' END AS status, ts AS updated_at
  FROM events)"""


def cosine_sql(a: str, b: str) -> str:
    """Cosine in double precision, 0 for a zero norm."""
    dot = lambda x, y: f"list_sum(list_transform(range(1, len({x}) + 1), lambda i: CAST({x}[i] AS DOUBLE) * CAST({y}[i] AS DOUBLE)))"
    return f"CASE WHEN {dot(a, a)} > 0 AND {dot(b, b)} > 0 THEN {dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})) ELSE 0.0 END"


def bm25_sql(clauses: list[tuple[str, list[str], bool]], source: str, keys: str, text: str, mode: str = "and") -> str:
    """CTEs for a boolean query over ``source``: ``scored`` has the keys and raw.

    Clauses are (kind, words, negated) with kind term, prefix or phrase.
    """
    on = keys.split(", ")
    parts = [
        f"tok AS (SELECT {keys}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS term, generate_subscripts(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'), 1) AS pos FROM {source})",
        f"lens AS (SELECT {keys}, len(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS dl FROM {source})",
        "st AS (SELECT count(*) AS nn, avg(dl) AS mean FROM lens)",
    ]
    for i, (kind, words, _) in enumerate(clauses):
        if kind == "phrase":
            joins = "".join(f" JOIN tok t{j} ON {' AND '.join(f't{j}.{k} = t0.{k}' for k in on)} AND t{j}.pos = t0.pos + {j} AND t{j}.term = '{w}'" for j, w in enumerate(words) if j)
            picked = ", ".join(f"t0.{k}" for k in on)
            parts.append(f"c{i} AS (SELECT {picked}, count(*) AS f FROM tok t0{joins} WHERE t0.term = '{words[0]}' GROUP BY {picked})")
        else:
            test = f"term = '{words[0]}'" if kind == "term" else f"starts_with(term, '{words[0]}')"
            parts.append(f"c{i} AS (SELECT {keys}, count(*) AS f FROM tok WHERE {test} GROUP BY {keys})")
    gains, joins, needs = [], [], []
    for i, (_, _, negated) in enumerate(clauses):
        same = " AND ".join(f"lens.{k} = c{i}.{k}" for k in on)
        joins.append(f"LEFT JOIN c{i} ON {same}")
        needs.append(f"c{i}.f IS {'NULL' if negated else 'NOT NULL'}")
        if not negated:
            df = f"(SELECT count(*) FROM c{i})"
            gains.append(f"coalesce(greatest(ln((nn - {df} + 0.5) / ({df} + 0.5)), 1e-6) * c{i}.f * 2.2 / (c{i}.f + 1.2 * (0.25 + 0.75 * dl / mean)), 0)")
    where = " AND ".join(needs) if mode == "and" else "(" + " OR ".join(f"c{i}.f IS NOT NULL" for i in range(len(clauses))) + ")"
    cols = ", ".join(f"lens.{k}" for k in on)
    parts.append(f"scored AS (SELECT {cols}, {' + '.join(gains)} AS raw FROM lens CROSS JOIN st {' '.join(joins)} WHERE {where})")
    return ", ".join(parts)
