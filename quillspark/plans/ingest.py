"""Ingest: documents and transcripts to pages, with injected model callables, and reviewable plans."""

from __future__ import annotations

import difflib
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.chunking import pack_markdown, pack_turns
from quillspark.operators.links import link_forward, scrub
from quillspark.session import bounded_batches

PAGE_CHARS = 20_000
DEFAULT_LIMITS = (128_000, 16_000)
OVERHEAD = 8_000
PLAN_VERSION = 1


def chunk_cap(max_input: int = DEFAULT_LIMITS[0], max_output: int = DEFAULT_LIMITS[1], overhead: int = OVERHEAD) -> int:
    return max(0, max_input - max_input // 10 - overhead - max_output)


def model_limits(models: DataFrame, catalog: DataFrame) -> DataFrame:
    """(model, max_input, max_output): the exact name, else without its provider, else the longest prefix, else the defaults."""
    bare = F.regexp_replace("model", "^[^/]*/", "")
    tier = F.when(F.col("name") == F.col("model"), 3).when(F.col("name") == bare, 2).when(bare.startswith(F.col("name")), 1)
    met = models.join(F.broadcast(catalog), bare.startswith(F.col("name")) | (F.col("name") == F.col("model")), "left").withColumn("tier", tier)
    best = met.groupBy("model").agg(F.max_by(F.struct("max_input", "max_output"), F.struct(F.coalesce("tier", F.lit(0)), F.coalesce(F.length("name"), F.lit(0)))).alias("b"))
    return best.select("model", F.coalesce("b.max_input", F.lit(DEFAULT_LIMITS[0])).alias("max_input"), F.coalesce("b.max_output", F.lit(DEFAULT_LIMITS[1])).alias("max_output"))


# --- replies ---------------------------------------------------------------------------------------


def parse_reply(text: str) -> object | None:
    """JSON of a reply: bare, in a code fence, or somewhere in prose (at most 256 starts are tried)."""
    text = text.strip()
    fenced = re.search(r"(?s)```(?:json|yaml)?\s*\n(.*?)```", text)
    for candidate in (text, fenced[1] if fenced else ""):
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    decoder = json.JSONDecoder()
    for m in list(re.finditer(r"[\[{]", text))[:256]:
        try:
            return decoder.raw_decode(text, m.start())[0]
        except ValueError:
            continue
    return None


def parse_pages(text: str) -> list[dict]:
    """Pages of a reply: {pages: [...]}, a list, one page, or YAML-like blocks that start with a slug."""
    found = parse_reply(text)
    if isinstance(found, dict):
        found = found.get("pages", [found] if "slug" in found else None)
    if not isinstance(found, list):
        found = []
        for block in re.split(r"(?m)^\s*-?\s*(?=slug:)", text)[1:]:
            fields = dict(re.findall(r"(?m)^\s*(slug|title):[ \t]*(.+?)\s*$", block))
            body = re.search(r"(?ms)^\s*body:[ \t]*\|?[ \t]*\n?(.*)", block)
            found.append({**fields, "body": re.sub(r"(?m)^ {2,4}", "", body[1]).strip() if body else ""})
    return [p for p in found if isinstance(p, dict) and isinstance(p.get("slug"), str)]


def parse_expansion(text: str) -> dict:
    """{lex, vec, hyde} as lists of strings."""
    found = parse_reply(text)
    found = found if isinstance(found, dict) else {}
    return {k: [v] if isinstance(v := found.get(k), str) and v else [x for x in v if isinstance(x, str)] if isinstance(v, list) else [] for k in ("lex", "vec", "hyde")}


def parse_answer(text: str) -> dict:
    found = parse_reply(text)
    if isinstance(found, dict) and isinstance(found.get("answer"), str):
        return {"answer": found["answer"], "citations": list(dict.fromkeys(found.get("citations") or []))}
    return {"answer": text.strip(), "citations": list(dict.fromkeys(re.findall(r"\[\[([^\]]+)\]\]", text)))}


def slugify(name: str) -> str:
    return "-".join(filter(None, re.split(r"[\W_]+", name.lower())))


def valid_pages(pages: list[dict]) -> list[dict]:
    """Pages with a slug and a body, the slug normalised, the body cut at 20,000 characters."""
    out = []
    for p in pages:
        slug, body = slugify(p.get("slug") or ""), (p.get("body") or "").strip()[:PAGE_CHARS]
        if slug and body:
            out.append({"slug": slug, "title": (p.get("title") or slug.replace("-", " ")).strip(), "body": body})
    return out


def consolidate(fragments: list[dict], merge: Callable[[dict, dict], dict] | None = None) -> list[dict]:
    """One page a slug, in order of first appearance; later fragments merge in, the first title stays."""
    out: dict[str, dict] = {}
    for p in fragments:
        if p["slug"] not in out:
            out[p["slug"]] = dict(p)
        else:
            have = out[p["slug"]]
            try:
                have["body"] = merge(have, p)["body"] if merge else f"{have['body']}\n\n{p['body']}"
            except Exception:  # noqa: BLE001  a failed merge keeps what there is
                continue
    return list(out.values())


# --- jobs ------------------------------------------------------------------------------------------


def document_jobs(sources: DataFrame, limit: int = 100 << 20) -> DataFrame:
    """(job_id, job_type, source_path, content_hash, text): inbound texts, redacted; empty and oversized ones go."""
    rows = sources.filter((F.octet_length("text") <= limit) & T.valid_source_path(F.col("source_path"))).withColumn("text", T.redact(F.col("text")))
    rows = rows.filter(F.trim("text") != "").withColumn("content_hash", T.body_hash(F.col("text")))
    return rows.select(T.document_job_id(F.col("source_path"), F.col("content_hash")).alias("job_id"), F.lit("document").alias("job_type"), "source_path", "content_hash", "text")


def transcript_jobs(sessions: DataFrame, rendered: DataFrame) -> DataFrame:
    """Jobs of the sessions that pass; ``rendered`` has (session_id, text)."""
    rows = sessions.filter("filter = 'pass'").select("session_id", "path").join(rendered, "session_id").withColumn("content_hash", T.body_hash(F.col("text")))
    return rows.select(F.concat(F.lit("ingest-"), F.substring("content_hash", 1, 16)).alias("job_id"), F.lit("transcript").alias("job_type"), F.col("path").alias("source_path"), "content_hash", "text")


def unseen(jobs: DataFrame, docs: DataFrame) -> DataFrame:
    """Jobs whose content no raw document has."""
    return jobs.join(docs.filter("doc_type = 'raw'").select(F.col("hash").alias("content_hash")), "content_hash", "left_anti")


def extract(jobs: DataFrame, model: Callable[[str], str], cap: int | None = None, limit: int = 20, merge: Callable[[dict, dict], dict] | None = None) -> DataFrame:
    """(job_id, slug, title, body, error): each job chunked, sent to the model, and consolidated; jobs run in parallel tasks."""
    cap = chunk_cap() if cap is None else cap

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for job, kind, text in zip(batch["job_id"], batch["job_type"], batch["text"], strict=True):
                try:
                    if kind == "transcript":
                        turns = [t for t in re.split(r"(?m)^(?=## )", text) if t.strip()]
                        chunks = ["".join(turns[i] for i in c) for c in pack_turns(turns, cap, limit)]
                    else:
                        chunks = pack_markdown(text, cap, limit)
                    pages = consolidate([p for c in chunks for p in valid_pages(parse_pages(model(c)))], merge)
                    rows += [(job, p["slug"], p["title"], p["body"], None) for p in pages]
                except Exception as error:  # noqa: BLE001  a job fails alone
                    rows.append((job, None, None, None, str(error)[:500]))
            yield pd.DataFrame(rows, columns=["job_id", "slug", "title", "body", "error"])

    bounded_batches(jobs.sparkSession)
    return jobs.select("job_id", "job_type", "text").mapInPandas(run, "job_id string, slug string, title string, body string, error string")


def split_known(pages: DataFrame, existing: DataFrame) -> DataFrame:
    """Pages with ``target``: the existing stem that they merge into (by slug, else by title), or null for new ones."""
    by_title = existing.groupBy(F.lower("title").alias("_t")).agg(F.min("stem").alias("_by_title"))
    return (
        pages.join(existing.select(F.col("stem").alias("_by_slug")), pages["slug"] == F.col("_by_slug"), "left")
        .join(by_title, F.lower(pages["title"]) == F.col("_t"), "left")
        .withColumn("target", F.coalesce("_by_slug", "_by_title"))
        .drop("_by_slug", "_by_title", "_t")
    )


def compose_page(page: dict, known: list[tuple[str, str]], created_at: str, updated_at: str, sources: list[str]) -> str:
    """The Markdown of a page: unknown links scrubbed, mentions of known pages linked, head written."""
    stems = {s for s, _ in known} | {page["slug"]}
    body, _ = link_forward(scrub(page["body"], stems), [p for p in known if "-" in p[0]], page["slug"])
    listed = "".join(f"\n  - {json.dumps(s, ensure_ascii=False)}" for s in dict.fromkeys(sources)) or " []"
    return f"---\ntitle: {json.dumps(page['title'], ensure_ascii=False)}\ncreated_at: {created_at}\nupdated_at: {updated_at}\nsources:{listed}\n---\n\n{body.strip()}\n"


# --- plans -----------------------------------------------------------------------------------------


def unified(old: str, new: str) -> str:
    return "".join(difflib.unified_diff(old.splitlines(keepends=True), new.splitlines(keepends=True), "existing", "proposed"))


def diff_rows(pairs: DataFrame) -> DataFrame:
    """(id, diff) of (id, old, new)."""

    @F.pandas_udf("string")
    def diff(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([unified(a or "", b or "") for a, b in zip(old, new, strict=True)])

    bounded_batches(pairs.sparkSession)
    return pairs.select("id", diff("old", "new").alias("diff"))


def make_plan(source: dict, pages: list[dict], existing: dict[str, dict], created_at: str, merge: Callable[[dict, dict], dict] | None = None) -> dict:
    """A plan to review: each page new, or merged into an existing one whose hash it guards."""
    proposals = []
    for n, p in enumerate(pages):
        have = existing.get(p["slug"])
        row = {"index": n, **p, "merge_target_slug": None, "merge_target_hash": None, "merge_diff": None, "dropped": False, "committed": False, "error": None}
        if have:
            row["merge_target_slug"] = p["slug"]
            try:
                merged = merge(have, p) if merge else {"body": f"{have['body']}\n\n{p['body']}"}
                row |= {"body": merged["body"], "merge_target_hash": hashlib.sha256(have["body"].encode()).hexdigest(), "merge_diff": unified(have["body"], merged["body"])}
            except Exception as error:  # noqa: BLE001
                row["error"] = str(error)
        proposals.append(row)
    return {"version": PLAN_VERSION, "source": source, "created_at": created_at, "proposals": proposals}


def check_plan(plan: dict) -> list[str]:
    """What is wrong with a plan."""
    wrong = [] if plan.get("version") == PLAN_VERSION else [f"version {plan.get('version')}"]
    if not re.fullmatch("[0-9a-f]{64}", plan.get("source", {}).get("content_hash", "")):
        wrong.append("source hash")
    seen = set()
    for p in plan.get("proposals", []):
        if p.get("dropped"):
            continue
        if not re.fullmatch("[a-z0-9]+(-[a-z0-9]+)*", p.get("slug", "")):
            wrong.append(f"slug {p.get('slug')!r}")
        if p.get("slug") in seen:
            wrong.append(f"slug {p['slug']!r} twice")
        seen.add(p.get("slug"))
    return wrong


def apply_plan(plan: DataFrame, docs: DataFrame) -> DataFrame:
    """(slug, verdict) of proposals (slug, merge_target_hash, dropped, committed): optimistic, by the hash they saw."""
    now = docs.filter("doc_type = 'wiki'").select(T.stem_of_path(F.col("path")).alias("slug"), F.col("hash").alias("now"))
    verdict = (
        F.when(F.col("dropped"), "dropped")
        .when(F.col("committed"), "already_committed")
        .when(F.col("merge_target_hash").isNull() & F.col("now").isNotNull(), "conflict")
        .when(F.col("merge_target_hash").isNotNull() & ~F.col("merge_target_hash").eqNullSafe(F.col("now")), "conflict")
        .otherwise("apply")
    )
    return plan.join(now, "slug", "left").select("slug", verdict.alias("verdict"))


def exit_code(verdicts: list[str]) -> int:
    """0: all applied, 3: none could be, 4: some."""
    bad, good = verdicts.count("conflict"), verdicts.count("apply") + verdicts.count("already_committed")
    return 0 if not bad else 4 if good else 3


def cached(prompt: str, cache: dict[str, str], model: Callable[[str], str], parse: Callable[[str], object]) -> object:
    """Reply from the cache, else from the model; only replies that parse are kept."""
    key = hashlib.sha256(prompt.encode()).hexdigest()
    if key not in cache:
        reply = model(prompt)
        if not parse(reply):
            return None
        cache.setdefault(key, reply)
    return parse(cache[key])
