"""The derived store: documents, bodies, chunks, postings, vectors, links and side tables that change as one commit.

A commit judges every row it is given, writes what the applied ones change, and moves all tables at once by one record
of a log. Rows are judged by their hashes; bodies are read a second time, and those that are new written once. Bodies are counted by change rows (hash, refs, chunks, tokens): a body is indexed when its count leaves zero
and gets a grave when it returns there, so neither asks for a scan of the chunks.

Rows to put: doc_type, path, title, body, and optionally source, mtime, size, sources, collections, embed_model, ``base``, ``force`` and
any other columns to keep. ``base`` guards a row: the hash the writer saw, '' for none; null guards nothing. Outcomes: inserted, updated,
unchanged (its other columns still change), conflict. Of several rows with one key the newest counts.
Rows to delete: doc_type, path, optionally ``base`` and ``force``. Outcomes: deleted, absent, conflict (guard, or the key is also put),
backlinked (another page links to it), referenced (a page lists it as a source). Refused rows change nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import chunking, segments
from quillspark.operators.commits import CommitLog
from quillspark.operators.lexical import LexicalIndex

KEY = ["doc_type", "path"]
DEFAULTS = {"title": "string", "source": "string", "mtime": "long", "size": "long", "sources": "array<string>", "collections": "array<string>", "embed_model": "string"}
REFS = "hash string, refs long, chunks long, tokens long"
#: Tables of change rows that a commit folds into one.
FOLD = 8
#: Hashes that a broadcast names at most, some 160 bytes each; where more would be, all new bodies are exchanged.
NAMED = 800_000


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


class Library:
    """A store under ``root``, at its last commit or at an earlier ``version``. ``chunker`` turns bodies (hash, body), each once, into chunks, ``embedder`` chunks into vectors (hash, seq, embedding)."""

    def __init__(self, spark: SparkSession, root: str, chunker: Callable[[DataFrame], DataFrame] = chunking.chunks_of_lines, embedder: Callable[[DataFrame], DataFrame] | None = None, model: str | None = None, version: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.chunker, self.embedder, self.model = chunker, embedder, model
        self.log = CommitLog(spark, f"{self.root}/log")
        self.version, self.state = self.log.last(version)

    # --- reading -------------------------------------------------------------------------------

    def table(self, name: str) -> DataFrame:
        """A table of the state: ``documents``, or a side table by its name."""
        return self.spark.read.parquet(f"{self.root}/{self.state['tables'][name]}")

    def documents(self) -> DataFrame:
        return self.table("documents")

    def live(self, piece: str) -> DataFrame:
        return segments.live(self.spark, self.root, self.state, piece).drop("born")

    def chunks_of(self, hashes: DataFrame) -> DataFrame:
        """The live chunks of the bodies named by ``hashes`` (hash), few."""
        return segments.live(self.spark, self.root, self.state, "chunks", hashes=hashes)

    def index(self) -> LexicalIndex:
        return segments.index(self.spark, self.root, self.state)

    def refs(self) -> DataFrame:
        """(hash, refs, chunks, tokens) of every body ever counted, as change rows."""
        if not self.state.get("refs"):
            return self.spark.createDataFrame([], REFS)
        return self.spark.read.schema(REFS).parquet(*(f"{self.root}/{r}" for r in self.state["refs"]))

    def with_bodies(self) -> DataFrame:
        return self.documents().join(self.live("bodies"), "hash")

    # --- writing -------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, name: str) -> tuple[DataFrame, str]:
        at = f"{name}-{self.version + 1}-{uuid.uuid4().hex[:8]}"
        rows.write.option("compression", "zstd").parquet(f"{self.root}/{at}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{at}"), at

    def _drop(self, at: str) -> None:
        self.log.fs.delete(self.log.hadoop.fs.Path(f"{self.root}/{at}"), True)

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "doc_type string, path string, hash string")

    def _put_rows(self, rows: DataFrame, old: DataFrame) -> DataFrame:
        rows = rows.withColumns({n: _column(rows, n, k) for n, k in DEFAULTS.items()} | {"base": _column(rows, "base", "string"), "force": F.coalesce(_column(rows, "force", "boolean"), F.lit(False)), "body": F.coalesce("body", F.lit(""))})
        rows = rows.withColumns({"hash": T.body_hash(F.col("body")), "size": F.coalesce("size", F.octet_length("body").cast("long")), "collections": T.normalise_collections(F.coalesce("collections", F.array().cast("array<string>")))})
        if self.model is not None:
            rows = rows.withColumn("embed_model", F.lit(self.model))
        rows = rows.withColumn("_bytes", F.octet_length("body").cast("long")).drop("body")
        newest = Window.partitionBy(*KEY).orderBy(F.desc_nulls_last("mtime"), F.desc("hash"))
        rows = rows.withColumns({"_nth": F.row_number().over(newest), "_older": F.collect_list("hash").over(newest.rowsBetween(1, Window.unboundedFollowing))}).filter("_nth = 1").drop("_nth")
        judged = rows.join(old.select(*KEY, F.col("hash").alias("old_hash")), KEY, "left")
        stale = F.col("base").isNotNull() & (F.col("base") != F.coalesce("old_hash", F.lit(""))) & ~F.col("force")
        return judged.withColumn("outcome", F.when(stale, "conflict").when(F.col("old_hash").isNull(), "inserted").when(F.col("old_hash") == F.col("hash"), "unchanged").otherwise("updated"))

    def _delete_rows(self, rows: DataFrame, old: DataFrame, put: DataFrame) -> DataFrame:
        rows = rows.select(*KEY, _column(rows, "base", "string").alias("base"), F.coalesce(_column(rows, "force", "boolean"), F.lit(False)).alias("force")).dropDuplicates(KEY)
        rows = rows.join(old.select(*KEY, F.col("hash").alias("old_hash")), KEY, "left").join(put.select(*KEY, F.lit(True).alias("also_put")), KEY, "left")
        rows = rows.withColumn("stem", F.when(F.col("doc_type") == "wiki", T.stem_of_path(F.col("path"))))
        wiki = old.filter("doc_type = 'wiki'")
        inbound = self.live("links").join(wiki.select("hash", F.col("path").alias("from")), "hash").filter(T.stem_of_path(F.col("from")) != F.col("dst"))
        rows = rows.join(inbound.select(F.col("dst").alias("stem"), F.lit(True).alias("has_links")).distinct(), "stem", "left")
        listed = wiki.select(F.explode("sources").alias("path"), F.lit("raw").alias("doc_type"), F.lit(True).alias("has_pages")).distinct() if "sources" in wiki.columns else wiki.select("path", "doc_type", F.lit(True).alias("has_pages")).limit(0)
        rows = rows.join(listed, KEY, "left")
        guarded = F.col("base").isNotNull() & (F.col("base") != F.col("old_hash"))
        outcome = F.when(F.col("also_put"), "conflict").when(F.col("old_hash").isNull(), "absent").when(F.col("force"), "deleted").when(guarded, "conflict").when(F.col("has_links"), "backlinked").when(F.col("has_pages"), "referenced").otherwise("deleted")
        return rows.select(*KEY, "old_hash", outcome.alias("outcome"))

    def commit(self, put: DataFrame | None = None, delete: DataFrame | None = None, tables: dict[str, DataFrame] | None = None) -> DataFrame:
        """Apply rows to put and to delete, and replace side tables, as one commit; (doc_type, path, outcome) of every row,
        which is also the side table ``report``.

        Raises ``commits.Conflict`` where another writer has committed since this store was opened; what was written is then in no state.
        """
        born = self.version + 1
        old = self.documents() if "documents" in self.state.get("tables", {}) else self._empty()
        given = put if put is not None else self._empty().drop("hash").withColumn("body", F.lit(""))
        put, put_at = self._write(self._put_rows(given, old), "put")
        spent = [put_at]  # what nothing reads any more when its bodies are written
        if delete is None:
            gone = put.select(*KEY, "old_hash", "outcome").limit(0)
        else:
            gone, gone_at = self._write(self._delete_rows(delete, old, put), "delete")
            spent.append(gone_at)
        applied, removed = put.filter("outcome <> 'conflict'"), gone.filter("outcome = 'deleted'")

        new = applied.drop("_bytes", "_older", "base", "force", "old_hash", "outcome")
        if "documents" in self.state.get("tables", {}):
            documents = old.join(applied.select(*KEY).union(removed.select(*KEY)), KEY, "left_anti").unionByName(new, allowMissingColumns=True)
        else:
            documents = new.select(*KEY, "hash", *(c for c in new.columns if c not in (*KEY, "hash")))
        _, at = self._write(documents, "documents")
        state = {"tables": self.state.get("tables", {}) | {"documents": at}, "segments": list(self.state.get("segments", [])), "graves": list(self.state.get("graves", [])), "refs": list(self.state.get("refs", []))}
        for name, rows in (tables or {}).items():
            state["tables"][name] = self._write(rows, name)[1]

        changed = applied.filter("outcome <> 'unchanged'")
        moves = changed.select("hash", F.lit(1).alias("by")).union(changed.filter("old_hash is not null").select("old_hash", F.lit(-1))).union(removed.select("old_hash", F.lit(-1)))
        delta = moves.groupBy("hash").agg(F.sum("by").alias("by")).filter("by <> 0")
        if self.state.get("refs"):
            known = self.refs().join(delta.select("hash"), "hash", "left_semi").groupBy("hash").agg(*(F.sum(c).alias(c) for c in ("refs", "chunks", "tokens")))
            counted = delta.join(known, "hash", "left").fillna(0, ["refs", "chunks", "tokens"])
        else:
            counted = delta.withColumns({c: F.lit(0).cast("long") for c in ("refs", "chunks", "tokens")})
        verdict = F.when((F.col("refs") <= 0) & (F.col("refs") + F.col("by") > 0), "fresh").when((F.col("refs") > 0) & (F.col("refs") + F.col("by") <= 0), "dead").otherwise("kept")
        counted, counted_at = self._write(counted.withColumn("verdict", verdict), "counted")
        totals = counted.filter("verdict = 'dead'").agg(F.count("*").alias("n"), F.sum("chunks").alias("chunks"), F.sum("tokens").alias("tokens")).first()
        n, tokens = self.state.get("n", 0) - (totals["chunks"] or 0), self.state.get("tokens", 0) - (totals["tokens"] or 0)
        if totals["n"]:
            state["graves"].append(segments.write_graves(self.root, born, counted.filter("verdict = 'dead'")))
        report, state["tables"]["report"] = self._write(put.select(*KEY, "outcome").union(gone.select(*KEY, "outcome")), "report")
        brought, brought_at = self._write(self._brought(put, counted), "brought")
        for folder in spent:
            self._drop(folder)
        sizes = None
        once, several = F.col("new") & (F.col("times") == 1), F.col("new") & (F.col("times") > 1)
        due = brought.agg(F.count_if(once).alias("once"), F.count_if(several).alias("several"), F.count_if(~once).alias("other"), F.count_if("new").alias("n"), F.sum(F.when(F.col("new"), F.col("size"))).alias("size")).first()
        if due["n"]:
            segment, sizes = self._segment(self._new_bodies(given, brought, due, once, several), segments.rows_a_file(due["n"], due["size"]), born)
            if segments.live(self.spark, self.root, state, "bodies", [segment]).count() != due["n"]:
                raise RuntimeError("the rows to put were others when their bodies were read")
            state["segments"].append(segment)
            more = sizes.agg(F.sum("chunks").alias("n"), F.sum("tokens").alias("tokens")).first()
            n, tokens = n + (more["n"] or 0), tokens + (more["tokens"] or 0)
        state["refs"].append(self._write(self._changes(counted, sizes), "refs")[1])
        for folder in (brought_at, counted_at):
            self._drop(folder)
        self._finish(born, state | {"n": n, "tokens": tokens})
        return report

    @staticmethod
    def _brought(put: DataFrame, counted: DataFrame) -> DataFrame:
        """(hash, times, size, new): how many rows bring each body, its bytes where one of them is a newest, and whether it is fresh."""
        brings = F.concat(F.array(F.struct("hash", "_bytes")), F.transform("_older", lambda h: F.struct(h.alias("hash"), F.lit(None).cast("long").alias("_bytes"))))
        brought = put.select(F.inline(brings)).groupBy("hash").agg(F.count("*").alias("times"), F.max("_bytes").alias("size"))
        fresh = counted.filter("verdict = 'fresh'").select("hash", F.lit(True).alias("new"))
        return brought.join(fresh, "hash", "left").fillna(False, ["new"])

    def _new_bodies(self, given: DataFrame, brought: DataFrame, n: Row, once: Column, several: Column) -> DataFrame:
        """(hash, body) of the fresh bodies among the rows given, each once; ``n`` counts what ``brought`` has of each kind.

        A fresh body that one row brings is taken where it is read. Bodies of several rows meet by an exchange, and all do where
        neither the hashes to take so nor the others are few enough to be broadcast.
        """
        bodies = given.select(T.body_hash(F.coalesce("body", F.lit(""))).alias("hash"), F.coalesce("body", F.lit("")).alias("body"))
        if min(n["once"], n["other"]) > NAMED or n["several"] > NAMED:
            return bodies.join(brought.filter("new").select("hash"), "hash", "left_semi").dropDuplicates(["hash"])
        kind, named = ("left_semi", once) if n["once"] <= n["other"] else ("left_anti", ~once)
        taken = bodies.join(F.broadcast(brought.filter(named).select("hash")), "hash", kind)
        if n["several"]:
            taken = taken.union(bodies.join(F.broadcast(brought.filter(several).select("hash")), "hash", "left_semi").dropDuplicates(["hash"]))
        return taken

    def _segment(self, bodies: DataFrame, most: int, born: int) -> tuple[dict, DataFrame]:
        return segments.write(self.root, born, bodies, most, self.chunker, self.embedder)

    @staticmethod
    def _changes(counted: DataFrame, sizes: DataFrame | None) -> DataFrame:
        """Change rows: what a fresh body brings, what a dead one takes with it, and counts alone of others."""
        if sizes is None:
            sizes = counted.select("hash", "chunks", "tokens").limit(0)
        sizes = sizes.select("hash", F.col("chunks").alias("new_chunks"), F.col("tokens").alias("new_tokens"))

        def of(old: str, new: str) -> Column:
            return F.when(F.col("verdict") == "dead", -F.col(old)).when(F.col("verdict") == "fresh", F.coalesce(new, F.lit(0)) - F.col(old)).otherwise(0).cast("long").alias(old)

        return counted.join(sizes, "hash", "left").select("hash", F.col("by").cast("long").alias("refs"), of("chunks", "new_chunks"), of("tokens", "new_tokens"))

    def _finish(self, number: int, state: dict) -> None:
        """Fold what has become many, and make the commit."""
        state = segments.merge(self.spark, self.root, state)
        if len(state["refs"]) >= FOLD:
            all_rows = self.spark.read.schema(REFS).parquet(*(f"{self.root}/{r}" for r in state["refs"]))
            folded = all_rows.groupBy("hash").agg(*(F.sum(c).alias(c) for c in ("refs", "chunks", "tokens"))).filter("refs > 0")
            state["refs"] = [self._write(folded, "refs")[1]]
        self.log.commit(number, state)
        self.version, self.state = number, state

    def rebuild(self, pages: DataFrame) -> DataFrame:
        """Make the pages the only documents; bodies that stay are neither chunked nor embedded again."""
        gone = self.documents().select(*KEY).join(pages.select(*KEY), KEY, "left_anti").withColumn("force", F.lit(True))
        return self.commit(pages, gone)

    def rechunk(self, chunker: Callable[[DataFrame], DataFrame], embedder: Callable[[DataFrame], DataFrame] | None = None, model: str | None = None) -> None:
        """Chunk, and embed, every body anew: one segment in place of all."""
        self.chunker, self.embedder, self.model = chunker, embedder or self.embedder, model or self.model
        born = self.version + 1
        bodies = self.live("bodies")
        held = bodies.agg(F.count("*").alias("n"), F.sum(F.octet_length("body").cast("long")).alias("size")).first()
        segment, sizes = self._segment(bodies, segments.rows_a_file(held["n"], held["size"] or 0), born)
        counts = self.refs().groupBy("hash").agg(F.sum("refs").alias("refs")).filter("refs > 0")
        refs = self._write(counts.join(sizes, "hash", "left").fillna(0, ["chunks", "tokens"]).select("hash", "refs", "chunks", "tokens"), "refs")[1]
        tables = dict(self.state["tables"])
        if self.model is not None:
            tables["documents"] = self._write(self.documents().withColumn("embed_model", F.lit(self.model)), "documents")[1]
        more = sizes.agg(F.sum("chunks").alias("n"), F.sum("tokens").alias("tokens")).first()
        self._finish(born, {"tables": tables, "segments": [segment], "graves": [], "refs": [refs], "n": more["n"] or 0, "tokens": more["tokens"] or 0})

    def vacuum(self) -> int:
        """Delete folders that the last commit does not name; no writer or reader of an older state may be at work."""
        fs, path = self.log.fs, self.log.hadoop.fs.Path
        named = {"log", *self.state["tables"].values(), *(s["name"] for s in self.state["segments"]), *(g["name"] for g in self.state["graves"]), *self.state["refs"]}
        gone = [s.getPath() for s in fs.listStatus(path(self.root)) if s.getPath().getName() not in named]
        for p in gone:
            fs.delete(p, True)
        return len(gone)


def members_of(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, name): memberships that documents carry in ``collections``."""
    return docs.select(key, F.explode("collections").alias("name"))


