"""Requests to write pages and to add sources, many at once, against a library: each is judged, and what is accepted is one commit.

Refusals are rows. A page's body is linked to all pages with hyphenated stems, and such a new page is linked to from all pages
that mention it; those are rewritten in the same commit, guarded by the hash they were read with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import links, lookup
from quillspark.plans.library import Library
from quillspark.session import stage

#: Bytes of a slug: what a file name leaves beside the ends of a temporary one.
LONGEST_SLUG = 255 - 17


def judge_pages(store: Library, requests: DataFrame) -> DataFrame:
    """Requests (rid, title, content, source, force) with slug, body, the path of their source, and the outcome.

    Outcomes: control_in_title, empty_slug, long_slug, exists (a page, or another request, has the slug and ``force`` is off), source_not_found,
    accepted. Of several requests for a slug the last forced one is taken, else the first.
    """
    docs = store.documents()
    slug = T.slug_ascii(F.coalesce("title", F.lit("")))
    force = F.coalesce("force", F.lit(False))
    rows = requests.select("rid", "title", T.page_body(F.coalesce("content", F.lit(""))).alias("body"), "source", force.alias("force"), slug.alias("slug"))
    existing = docs.filter("doc_type = 'wiki'").select(T.stem_of_path(F.col("path")).alias("slug"), F.col("hash").alias("old_hash"))
    asked = rows.filter("source is not null").select("rid", F.col("source").alias("ref"))
    raw = lookup.resolve_many(docs.select("doc_type", "path", "hash", "title"), asked).filter("doc_type = 'raw'").groupBy("rid").agg(F.min("path").alias("source_path"))
    rows = rows.join(existing, "slug", "left").join(raw, "rid", "left")
    bad = (
        F.when(F.col("title").rlike(r"\p{Cntrl}"), "control_in_title")
        .when(F.col("slug") == "", "empty_slug")
        .when(F.octet_length("slug") > LONGEST_SLUG, "long_slug")
        .when(F.col("old_hash").isNotNull() & ~F.col("force"), "exists")
        .when(F.col("source").isNotNull() & F.col("source_path").isNull(), "source_not_found")
    )
    rows = rows.withColumn("bad", bad)
    chosen = Window.partitionBy("slug", F.col("bad").isNull()).orderBy(F.desc("force"), F.when(F.col("force"), -F.col("rid")).otherwise(F.col("rid")))
    outcome = F.coalesce("bad", F.when(F.row_number().over(chosen) == 1, "accepted").otherwise("exists"))
    return rows.withColumn("outcome", outcome).drop("bad")


def write_pages(store: Library, requests: DataFrame) -> DataFrame:
    """(rid, outcome, slug, docid, linked, backlinked, suggest_create) of each request, after one commit of the accepted ones.

    ``linked``: pages that the body now links to; ``backlinked``: pages that now link to it; ``suggest_create``: links to no page.
    """
    judged = stage(judge_pages(store, requests), "requests")
    taken = judged.filter("outcome = 'accepted'")
    old = store.with_bodies().filter("doc_type = 'wiki'").withColumn("stem", T.stem_of_path(F.col("path")))
    forward = stage(links.maintain(taken.select(F.col("slug").alias("stem"), "body"), old.select("stem", "title")), "forward")
    others = old.join(taken.select(F.col("slug").alias("stem")), "stem", "left_anti")
    backward = stage(links.maintain(others.select("stem", "body"), taken.select(F.col("slug").alias("stem"), "title")).filter(F.size("linked") > 0), "backward")

    sources = F.when(F.col("source_path").isNotNull(), F.array("source_path"))
    clock = (store.documents().agg(F.coalesce(F.max("mtime"), F.lit(0)).alias("last")).first()["last"] or 0) + 1
    pages = taken.drop("body").join(forward.select(F.col("stem").alias("slug"), "body"), "slug").select(
        F.lit("wiki").alias("doc_type"), T.wiki_path(F.col("slug")).alias("path"), "title", "body", sources.alias("sources"), F.coalesce("old_hash", F.lit("")).alias("base"), F.lit(clock).cast("long").alias("mtime")
    )
    rewritten = others.drop("body", "size").join(backward.select("stem", "body"), "stem").withColumns({"base": F.col("hash"), "mtime": F.lit(clock).cast("long")}).drop("hash", "stem")
    store.commit(pages.unionByName(rewritten, allowMissingColumns=True))

    known = store.documents().filter("doc_type = 'wiki'").select(T.stem_of_path(F.col("path")).alias("dst"))
    loose = forward.select(F.col("stem").alias("slug"), F.explode(T.wiki_links(F.col("body"))).alias("dst")).filter("dst <> slug").join(known, "dst", "left_anti")
    suggested = loose.groupBy("slug").agg(F.sort_array(F.collect_set("dst")).alias("suggest_create"))
    back = backward.select(F.col("stem").alias("from"), F.explode("linked").alias("slug")).groupBy("slug").agg(F.sort_array(F.collect_set("from")).alias("backlinked"))
    done = forward.select(F.col("stem").alias("slug"), "linked", T.short_id(T.body_hash(F.col("body"))).alias("docid")).join(back, "slug", "left").join(suggested, "slug", "left")
    none = F.array().cast("array<string>")
    answers = taken.select("rid", "outcome", "slug").join(done, "slug").select("rid", "outcome", "slug", "docid", *(F.coalesce(c, none).alias(c) for c in ("linked", "backlinked", "suggest_create")))
    refused = judged.filter("outcome <> 'accepted'").select("rid", "outcome", "slug", F.lit(None).cast("string").alias("docid"), *(none.alias(c) for c in ("linked", "backlinked", "suggest_create")))
    return answers.union(refused)


def add_sources(store: Library, requests: DataFrame) -> DataFrame:
    """(rid, outcome, docid) for requests (rid, source_path, content, collections), after one commit.

    A source is its content: added once, whatever its path; again only its collections grow, by what is asked for, from ``default`` where it
    had none. Outcomes: empty, bad_path, bad_collection, known, added.
    """
    names = F.coalesce("collections", F.array().cast("array<string>"))
    rows = requests.select("rid", F.coalesce("source_path", F.lit("")).alias("source"), F.coalesce("content", F.lit("")).alias("body"), names.alias("asked"))
    rows = rows.withColumn("hash", T.body_hash(F.col("body"))).withColumn("path", T.raw_path(F.col("hash")))
    old = store.documents().filter("doc_type = 'raw'")
    have = old.select("path", F.col("collections").alias("had"))
    outcome = F.when(F.trim(F.regexp_replace("body", r"\s", " ")) == "", "empty").when(~T.valid_source_path(F.col("source")), "bad_path").when(F.exists("asked", lambda n: ~T.valid_collection(n)), "bad_collection").when(F.col("had").isNotNull(), "known").otherwise("added")
    judged = stage(rows.join(have, "path", "left").withColumn("outcome", outcome), "sources")
    fine = judged.filter("outcome in ('known', 'added')")
    grouped = fine.groupBy("path", "body").agg(F.min_by("source", "rid").alias("source"), F.flatten(F.collect_list("asked")).alias("asked"), F.first("had").alias("had"))
    first = F.when(F.col("had").isNotNull(), F.col("had")).otherwise(F.array().cast("array<string>"))
    wanted = grouped.withColumn("collections", T.normalise_collections(F.concat(first, "asked")))
    kept = old.drop("collections", "size").join(wanted.filter("had is not null").select("path", "body", "collections"), "path")
    new = wanted.filter("had is null").select(F.lit("raw").alias("doc_type"), "path", T.title_fallback(F.col("body"), F.col("source")).alias("title"), "body", "source", "collections")
    store.commit(kept.drop("hash").unionByName(new, allowMissingColumns=True))
    return judged.select("rid", "outcome", F.when(F.col("outcome").isin("known", "added"), T.short_id(F.col("hash"))).alias("docid"))
