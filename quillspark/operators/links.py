"""The link graph: links in bodies, dangling and missing ones, and their upkeep."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import wiki_links
from quillspark.operators.mentions import BLOCK_BYTES, KEY_BYTES, WholeNames, blocks, key_of, link_forward, same_name, sweep_of  # noqa: F401  link_forward is the rewriting of one body
from quillspark.session import bounded_batches, stage

#: Bytes of a key with what belongs to it, and pages of one name that a part has on average.
KEY_SIZE, PART = 24, 1000


def edges(pages: DataFrame, body: str = "body", stem: str = "stem") -> DataFrame:
    """(src, nth, dst): every link of every page, in order."""
    return pages.select(F.col(stem).alias("src"), F.posexplode(wiki_links(F.col(body))).alias("nth", "dst"))


def dangling(pages: DataFrame, body: str = "body", stem: str = "stem") -> DataFrame:
    """Links, each occurrence, to no page."""
    return edges(pages, body, stem).join(pages.select(F.col(stem).alias("dst")).distinct(), "dst", "left_anti").select("src", "nth", "dst")


def backlinks(pages: DataFrame, target: str, body: str = "body", stem: str = "stem") -> DataFrame:
    """Pages other than the target that link to it."""
    return edges(pages, body, stem).filter((F.col("dst") == target) & (F.col("src") != target)).select("src").distinct()


def names_of(pages: DataFrame) -> DataFrame:
    """(stem, name): the titles of pages, and their stems as words."""
    return pages.select("stem", F.col("title").alias("name")).union(pages.select("stem", F.regexp_replace("stem", "-", " ")))


def missing(pages: DataFrame, names: DataFrame, body: str = "body", stem: str = "stem", block: int = KEY_BYTES) -> DataFrame:
    """(src, dst): pages that mention another by one of its ``names`` (stem, name), whole and in any case, without a link to it.

    Names are looked up by hashes of their runs, ``block`` bytes of them a broadcast: a body is read once a block. What was said is
    compared with the names of its hash, and pages meet the pages of a name in parts of ``PART``. A page is met by the name that most share
    with it, and those alone that are met by another of its names are exchanged: pairs by the first are made where they are handed on.
    """
    bounded_batches(pages.sparkSession)
    lower = F.when(F.col("name").rlike(r"^[\x00-\x7F]*$"), F.lower("name")).otherwise(F.col("name"))  # see mentions.plain

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.concat([batch, pd.DataFrame([key_of(n) for n in batch["name"]], columns=["key", "runs", "first"])], axis=1)

    named = stage(names.filter("name <> ''").select("stem", lower.alias("name")).distinct().mapInPandas(keyed, "stem string, name string, key long, runs int, first long"), "names")
    keys = named.select("key", "runs", "first").distinct()
    parts = -(-keys.count() * KEY_SIZE // block)
    said = None
    for nth in range(parts):
        table = keys.filter(F.pmod("key", F.lit(parts)) == nth).toArrow()
        shared = pages.sparkSession.sparkContext.broadcast([table.column(c).to_numpy() for c in ("key", "runs", "first")])

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            matcher = WholeNames(*shared.value)
            for batch in batches:
                yield pd.DataFrame([(s, *m) for s, b in zip(batch["src"], batch["body"], strict=True) for m in matcher.named(b)], columns=["src", "key", "said"])

        part = pages.select(F.col(stem).alias("src"), F.coalesce(body, F.lit("")).alias("body")).mapInPandas(run, "src string, key long, said string")
        said = part if said is None else said.union(part)
    if said is None:
        return pages.select(F.col(stem).alias("src"), F.col(stem).alias("dst")).limit(0)
    said = stage(said, "said")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[same_name(n, s) for n, s in zip(batch["name"], batch["said"], strict=True)]]

    meant = said.select("key", "said").distinct().join(named.select("key", "name").distinct(), "key").mapInPandas(compared, "key long, said string, name string")
    mentions = stage(said.join(meant, ["key", "said"]).select("src", "name").distinct(), "mentions")
    linked = stage(edges(pages, body, stem).select("src", "dst").distinct(), "links")
    sizes = named.groupBy("name").agg(F.count("*").alias("n"))
    main = named.join(sizes, "name").groupBy("stem").agg(F.max_by("name", F.struct("n", "name")).alias("name"))
    main = stage(main.select(F.col("stem").alias("dst"), "name"), "main")
    other = named.select(F.col("stem").alias("dst"), "name").join(main, ["dst", "name"], "left_anti")
    by_other = stage(mentions.join(other, "name").select("src", "dst").filter("src <> dst").distinct(), "others")
    # What is linked or known already is kept from the pairs where they are made, so that they are not exchanged.
    known = linked.union(by_other).distinct().join(main, "dst").groupBy("src", "name").agg(F.collect_list("dst").alias("known"))
    parts = main.groupBy("name").agg(F.ceil(F.count("*") / PART).alias("parts"))
    asked = mentions.join(known, ["src", "name"], "left").join(parts, "name").select("src", "name", "known", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    targets = main.join(parts, "name").select("name", F.pmod(F.xxhash64("dst"), "parts").alias("part"), "dst")
    # Few bytes make many pairs, so sizes do not say how many tasks there should be.
    spark = pages.sparkSession
    asked = asked.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), "name", "part")
    by_main = asked.join(targets, ["name", "part"]).filter((F.col("src") != F.col("dst")) & ~F.coalesce(F.array_contains("known", F.col("dst")), F.lit(False))).select("src", "dst")
    return by_main.union(by_other.join(linked, ["src", "dst"], "left_anti"))


def scrub(body: str, known: set[str]) -> str:
    """Links to unknown pages become their words; an open bracket at the end stays."""
    return re.sub(r"\[\[((?:[^\]]|\](?!\]))+)\]\]", lambda m: m[0] if m[1] in known else m[1].replace("-", " "), body)


def maintain(pages: DataFrame, targets: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """(stem, body, linked): each page rewritten with links to all targets (stem, title; hyphenated stems only).

    Targets come in blocks of at most ``block`` bytes, longest titles first over all blocks, so the result is that of one block.
    Between blocks the pages are a table of the workspace.
    """
    ordered = targets.filter(F.col("stem").contains("-")).select("stem", F.coalesce("title", F.lit("")).alias("title")).orderBy(F.desc(F.octet_length("title")), "stem")
    out = pages.select("stem", F.coalesce("body", F.lit("")).alias("body"), F.array().cast("array<string>").alias("linked"))
    bounded_batches(pages.sparkSession)
    for nth, new in enumerate(blocks(ordered, block)):
        if nth:  # a task that ran all blocks would hold a worker with the names of each
            out = stage(out, "linked")
        shared = pages.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, new))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            sweep = sweep_of(*shared.value)
            for batch in batches:
                done = [sweep.link(b, s) for s, b in zip(batch["stem"], batch["body"], strict=True)]
                yield pd.DataFrame({"stem": batch["stem"], "body": [x[0] for x in done], "linked": [[*old, *x[1]] for old, x in zip(batch["linked"], done, strict=True)]})

        out = out.mapInPandas(run, "stem string, body string, linked array<string>")
    return out


def pages_listing(pages: DataFrame, source: str) -> DataFrame:
    """Pages whose ``sources`` name a source."""
    return pages.filter(F.array_contains("sources", source)).select("stem").distinct()


def degree(pages: DataFrame, body: str = "body", stem: str = "stem") -> DataFrame:
    """Links out and in of every page."""
    e = edges(pages, body, stem).select("src", "dst").distinct()
    out = e.groupBy(F.col("src").alias("stem")).agg(F.count("*").alias("n_out"))
    into = e.groupBy(F.col("dst").alias("stem")).agg(F.count("*").alias("n_in"))
    return pages.select(F.col(stem).alias("stem")).distinct().join(out, "stem", "left").join(into, "stem", "left").fillna(0, ["n_out", "n_in"])


def first_mentions(pages: DataFrame) -> DataFrame:
    """For each title the page that has it first by stem."""
    first = Window.partitionBy(F.lower("title")).orderBy("stem")
    return pages.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
