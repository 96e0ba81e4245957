"""Reference resolution, filters and dashboards over the document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import line_slice, stem_of_path

CANDIDATES = 16
#: Digits of a hash by which prefixes of at least so many meet hashes.
LEAST = 7


def by_prefix(docs: DataFrame, prefix: str) -> DataFrame:
    """Distinct hashes with a prefix, with the verdict unique or ambiguous, at most sixteen."""
    found = docs.filter(F.col("hash").startswith(prefix.lower())).select("hash").distinct().orderBy("hash").limit(CANDIDATES + 1)
    total = F.count("*").over(Window.partitionBy(F.lit(0)))  # over at most 17 rows
    return found.withColumn("status", F.when(total == 1, "unique").otherwise("ambiguous")).orderBy("hash").limit(CANDIDATES)


def _heads() -> Column:
    """A row for each prefix of a hash that is shorter than LEAST."""
    return F.explode(F.transform(F.sequence(F.lit(1), F.lit(LEAST - 1)), lambda n: F.substr(F.col("hash"), F.lit(1), n)))


def resolve_many(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """(rid, ref, tier, and the columns of documents): for each of ``refs`` (rid, ref) the documents of the first tier that has any:
    1 a hash that begins with it, 2 its stem, 3 its title in any case. Each tier is an equi-join: hashes are met by their first
    LEAST digits, and shorter prefixes by prefixes of their own length.
    """
    asked = refs.select("rid", "ref").filter(F.coalesce("ref", F.lit("")) != "")
    hexed = asked.filter(F.lower("ref").rlike("^[0-9a-f]{1,64}$")).withColumn("low", F.lower("ref"))
    long = hexed.filter(F.length("low") >= LEAST).withColumn("head", F.substring("low", 1, LEAST))
    by_hash = long.join(docs.withColumn("head", F.substring("hash", 1, LEAST)), "head").filter(F.col("hash").startswith(F.col("low"))).drop("head", "low")
    brief = hexed.filter(F.length("low") < LEAST).withColumnRenamed("low", "head")
    by_brief = brief.join(docs.select("hash").distinct().withColumn("head", _heads()), "head").drop("head").join(docs, "hash")
    by_stem = asked.join(docs.withColumn("ref", stem_of_path(F.col("path"))), "ref")
    by_title = asked.withColumn("low", F.lower("ref")).join(docs.withColumn("low", F.lower("title")), "low").drop("low")
    found = None
    for tier, rows in ((1, by_hash), (1, by_brief), (2, by_stem), (3, by_title)):
        part = rows.withColumn("tier", F.lit(tier)).select("rid", "ref", "tier", *docs.columns)
        found = part if found is None else found.union(part)
    best = found.groupBy("rid").agg(F.min("tier").alias("tier"))
    return found.join(best, ["rid", "tier"]).select("rid", "ref", "tier", *docs.columns)


def resolve(docs: DataFrame, ref: str) -> DataFrame:
    """Documents whose hash starts with ``ref``, else whose stem, else whose title is it; the first tier that has any."""
    hexed = ref != "" and all(c in "0123456789abcdef" for c in ref.lower())
    tier = (
        F.when(F.lit(hexed) & F.col("hash").startswith(ref.lower()), 1)
        .when(stem_of_path(F.col("path")) == ref, 2)
        .when(F.lower("title") == ref.lower(), 3)
    )
    found = docs.withColumn("tier", tier).filter("tier is not null")
    best = found.agg(F.min("tier").alias("best"))  # one row
    return found.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("best")


def _meetings(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """(rid, tier, best, low, high): for each reference and tier that has any document, the one to read, and the least and greatest hash.

    Documents (doc_type, path, hash, title) are gathered by the key of the tier before references meet them, so a key that many have costs
    their number and not its product with the references.
    """
    place = F.struct(F.when(F.col("doc_type") == "wiki", 0).otherwise(1).alias("kind"), "path", "doc_type", "hash", "title")

    def gathered(rows: DataFrame, key: Column) -> DataFrame:
        return rows.groupBy(key.alias("key")).agg(F.min("best").alias("best"), F.min("best.hash").alias("low"), F.max("best.hash").alias("high"))

    asked = refs.select("rid", "ref").filter(F.coalesce("ref", F.lit("")) != "")
    each = docs.select(place.alias("best"))
    bodies = each.groupBy(F.col("best.hash").alias("hash")).agg(F.min("best").alias("best"))
    hexed = asked.filter(F.lower("ref").rlike("^[0-9a-f]{1,64}$")).select("rid", F.lower("ref").alias("ref"))
    whole = hexed.filter(F.length("ref") >= LEAST).join(bodies, F.substring("ref", 1, LEAST) == F.substring("hash", 1, LEAST)).filter(F.col("hash").startswith(F.col("ref")))
    by_hash = whole.groupBy("rid").agg(F.min("best").alias("best"), F.min("hash").alias("low"), F.max("hash").alias("high"))
    by_brief = hexed.filter(F.length("ref") < LEAST).withColumnRenamed("ref", "key").join(gathered(bodies.select("best", _heads().alias("head")), F.col("head")), "key")
    by_stem = asked.withColumnRenamed("ref", "key").join(gathered(each, stem_of_path(F.col("best.path"))), "key")
    by_title = asked.select("rid", F.lower("ref").alias("key")).join(gathered(each, F.lower("best.title")), "key")
    found = None
    for tier, rows in ((1, by_hash), (1, by_brief), (2, by_stem), (3, by_title)):
        part = rows.select("rid", F.lit(tier).alias("tier"), "best", "low", "high")
        found = part if found is None else found.union(part)
    return found


def read_many(docs: DataFrame, bodies: DataFrame, refs: DataFrame) -> DataFrame:
    """(rid, ref, status, doc_type, path, id, title, text): each reference read, sliced to ``count`` lines from ``first`` where given.

    A reference resolves to one document: of its tier the wiki page, else the smallest path. Status is found, missing, or ambiguous
    where a hash prefix meets several bodies; these have no text.
    """
    met = _meetings(docs.select("doc_type", "path", "hash", "title"), refs)
    first = met.groupBy("rid").agg(F.min(F.struct("tier", "best", "low", "high")).alias("m"))
    one = first.select("rid", ((F.col("m.tier") == 1) & (F.col("m.low") != F.col("m.high"))).alias("several"), *(F.col(f"m.best.{c}").alias(c) for c in ("doc_type", "path", "hash", "title")))
    named = refs.join(one, "rid", "left").join(bodies.select("hash", "body").dropDuplicates(["hash"]), "hash", "left")
    status = F.when(F.col("path").isNull(), "missing").when(F.col("several"), "ambiguous").otherwise("found")
    text = F.when(F.col("first").isNotNull(), line_slice(F.col("body"), F.col("first"), F.col("count"))).otherwise(F.col("body"))
    only = lambda c: F.when(F.col("status") == "found", c)
    return named.withColumn("status", status).select("rid", "ref", "status", *(only(F.col(c)).alias(c) for c in ("doc_type", "path")), only(F.substring("hash", 1, 7)).alias("id"), only(F.col("title")).alias("title"), only(text).alias("text"))


def ambiguous_prefixes(docs: DataFrame, length: int) -> DataFrame:
    """Hash prefixes that more than one body shares."""
    return docs.select("hash").distinct().groupBy(F.substring("hash", 1, length).alias("prefix")).agg(F.count("*").alias("n")).filter("n > 1")


def memberships(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, collections): sorted names of each document, ``default`` without any."""
    names = members.groupBy("doc_id").agg(F.sort_array(F.collect_set("name")).alias("collections"))
    return docs.select("doc_id").join(names, "doc_id", "left").withColumn("collections", F.coalesce("collections", F.array(F.lit("default"))))


def in_collections(docs: DataFrame, members: DataFrame, wanted: list[str]) -> DataFrame:
    """Documents in any of the named collections."""
    return docs.join(members.filter(F.col("name").isin(wanted)).select("doc_id").distinct(), "doc_id", "left_semi")


def list_sources(docs: DataFrame, members: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Raw documents, newest first, with their source or else their path; no selection means all."""
    raw = docs.filter("doc_type = 'raw'")
    if wanted:
        raw = in_collections(raw, members, wanted)
    return raw.select("doc_id", "hash", F.coalesce("source", "path").alias("source"), "size", "mtime").orderBy(F.desc("mtime"), "doc_id")


def by_paths(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Metadata of (doc_type, path) keys, in one join."""
    return docs.join(keys, ["doc_type", "path"], "left_semi")


def outdated(docs: DataFrame, model: str) -> DataFrame:
    """Hashes embedded with another model; documents never embedded do not count."""
    return docs.filter(F.col("embed_model").isNotNull() & (F.col("embed_model") != model)).select("hash").distinct()


def outdated_models(docs: DataFrame, model: str) -> DataFrame:
    return docs.filter(F.col("embed_model").isNotNull() & (F.col("embed_model") != model)).groupBy("embed_model").agg(F.count("*").alias("n"))


def counts(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"), F.count_if(F.col("doc_type") == "wiki").alias("n_wiki"), F.count_if(F.col("doc_type") == "raw").alias("n_raw"))


def index_lines(docs: DataFrame) -> DataFrame:
    """The wiki index: stem and title by title."""
    return docs.filter("doc_type = 'wiki'").select(stem_of_path(F.col("path")).alias("stem"), "title").orderBy("title", "stem")
