"""Scalar text functions as Column expressions: they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no intent.
STOP_WORDS = (
    "the a an and or but if then else when is are was were be been being have has had do does did of in on at to "
    "for with by about as into through during before after above below up down out off over under again further once this "
    "that these those i you he she it we they them my your his her its our their what which who whom how why not no "
    "so than too very just"
).split()
# Secrets that are redacted.
SECRET_PATTERNS = (
    r"sk-[A-Za-z0-9]{20,}",
    r"AKIA[A-Z0-9]{16}",
    r"(?:password|token|secret|key)\s*[:=]\s*[A-Za-z0-9+/=]{32,}",
)
# Blocks removed from transcripts, and markup that must not act as a directive.
BLOCK_TAGS = ("system-reminder", "private", "kb-context", "persisted-output")
DIRECTIVE = r"<(\s*/?(?:antml:function_calls|antml:invoke|antml:parameter|function_calls|invoke|parameter|tool_use|tool_result|thinking)\b)"
# Slug segments that mark an episode and not a subject.
MONTHS = "january february march april may june july august september october november december".split()
EPISODES = ("conversation", "session", "episode")
#: Characters of Unicode's class Zs, which are what trims take off.
SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """A text without the spaces around it. Given as it is to ``transform``, ``F.trim`` would take the index for the characters to trim."""
    return F.trim(text, F.lit(SPACES))


def body_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def short_id(digest: Column) -> Column:
    return F.substring(digest, 1, 7)


def cache_key(*fields: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", *fields), 256)


def document_job_id(source: Column, digest: Column) -> Column:
    return F.concat(F.lit("doc-"), F.sha2(F.concat_ws("\x00", source, digest), 256))


def slug_ascii(name: Column) -> Column:
    """ASCII slug; a trailing ``.md`` goes and other characters become dashes."""
    dashed = F.regexp_replace(F.lower(F.regexp_replace(name, r"\.md$", "")), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def slug_unicode(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def is_bad_slug(slug: Column) -> Column:
    """A year, month or episode segment: the page would not be about one subject."""
    return slug.rlike(r"(^|-)([0-9]{4}|" + "|".join([*MONTHS, *EPISODES]) + r")(-|$)")


def is_kebab(slug: Column) -> Column:
    return slug.rlike("^[a-z0-9]+(-[a-z0-9]+)*$")


def is_digest(value: Column) -> Column:
    return value.rlike("^[0-9a-f]{64}$")


def redact(text: Column) -> Column:
    for pattern in SECRET_PATTERNS:
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return text


def strip_tags(text: Column) -> Column:
    """Remove injected blocks; break directives with a zero-width space after their bracket."""
    for tag in BLOCK_TAGS:
        text = F.regexp_replace(text, f"(?s)<{tag}>.*?</{tag}>", "")
    return F.regexp_replace(text, DIRECTIVE, "<​$1")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.ceil(F.char_length(text) / 3), F.ceil(F.octet_length(text) / 4)).cast("long")


def segment_tokens(text: Column) -> Column:
    return token_estimate(text) + 24


def structured_scale(text: Column) -> Column:
    """1.4 where over 30 % of the first 4 KiB are neither letters nor spaces, else 1."""
    head = F.substring(text, 1, 4096)
    return F.when(F.regexp_count(head, F.lit(r"[^\p{L}\s]")) > 0.3 * F.char_length(head), F.lit(1.4)).otherwise(F.lit(1.0))


def front_block(text: Column) -> Column:
    """The YAML block of a page, null without one."""
    found = F.regexp_extract(F.regexp_replace(text, "^﻿", ""), r"(?s)^---\r?\n(.*?)\n---", 1)
    return F.when(F.regexp_replace(text, "^﻿", "").rlike(r"(?s)^---\r?\n.*?\n---"), found)


def page_body(text: Column) -> Column:
    """A page without its YAML block and at most two newlines after it."""
    clean = F.regexp_replace(text, "^﻿", "")
    return F.when(clean.rlike(r"(?s)^---\r?\n.*?\n---"), F.regexp_replace(clean, r"(?s)^---\r?\n.*?\n---\n?\n?", "")).otherwise(clean)


def front_value(block: Column, name: str) -> Column:
    """A scalar of a YAML block, without its quotes."""
    value = F.trim(F.regexp_extract(block, rf"(?m)^{name}:[ \t]*(.*)$", 1))
    return F.nullif(F.regexp_replace(value, "^[\"']|[\"']$", ""), F.lit(""))


def front_list(block: Column, name: str) -> Column:
    """A list of a YAML block, in flow (``[a, b]``) or block (``- a``) form."""
    flow = F.regexp_extract(block, rf"(?m)^{name}:[ \t]*\[(.*)\]", 1)
    dashed = F.regexp_extract(block, rf"(?m)^{name}:[ \t]*\n((?:[ \t]*-[ \t].*\n?)+)", 1)
    items = F.when(flow != "", F.split(flow, ",")).otherwise(F.regexp_extract_all(dashed, F.lit(r"(?m)-[ \t]+(.*)$"), F.lit(1)))
    return F.filter(F.transform(items, lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")), lambda x: x != "")


def summary_line(body: Column, limit: int) -> Column:
    """The first line that is neither empty nor a heading, cut at a word where too long."""
    line = F.coalesce(F.get(F.filter(F.transform(F.split(body, "\n"), lambda x: trimmed(x)), lambda x: (x != "") & ~x.startswith("#")), F.lit(0)), F.lit(""))
    head = F.substring(line, 1, limit)
    cut = F.when(head.contains(" "), F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)
    return F.when(F.char_length(line) <= limit, line).otherwise(F.concat(cut, F.lit("...")))


def title_fallback(body: Column, source: Column) -> Column:
    """A first-line heading, else the last segment of a URL, else the stem of a path."""
    heading = F.trim(F.regexp_extract(F.substring_index(body, "\n", 1), r"^\s*# (.*)$", 1))
    url = F.regexp_extract(source, r"^https?://.*?([^/]+)/*$", 1)
    stem = F.regexp_replace(F.regexp_extract(source, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    return F.when(heading != "", heading).when(source.rlike("^https?://"), url).otherwise(F.coalesce(stem, F.lit("")))


def line_slice(body: Column, first: int, count: int) -> Column:
    """Lines ``first`` (from 1) onwards, at most ``count``; a final newline is kept."""
    lines = F.split(F.regexp_replace(body, r"\n$", ""), "\n")
    out = F.array_join(F.slice(lines, first, count), "\n")
    return F.when(body.endswith("\n") & (out != ""), F.concat(out, F.lit("\n"))).otherwise(out)


def normalise_collections(names: Column) -> Column:
    """Trimmed, lower-case, distinct, sorted; ``default`` where none is left."""
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda x: F.lower(F.trim(x))), lambda x: x != "")))
    return F.when(F.size(clean) > 0, clean).otherwise(F.array(F.lit("default")))


def valid_collection(name: Column) -> Column:
    return (F.octet_length(name) <= 64) & ~name.rlike(r"\p{Cntrl}")


def valid_source_path(path: Column) -> Column:
    return (F.length(path) > 0) & (F.octet_length(path) <= 2048) & ~path.rlike(r"[\x00-\x08\x0a-\x1f\x7f]")


def intent_terms(text: Column) -> Column:
    """Lower-case words, trimmed of punctuation, of two letters or more, without stop words."""
    words = F.transform(F.split(F.trim(F.lower(text)), r"\s+"), lambda x: F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(words, lambda x: (F.char_length(x) > 1) & ~x.isin(STOP_WORDS))


def chunk_score(text: Column, query: list[str], intent: list[str] = ()) -> Column:
    """1 for each query term that occurs, 0.5 for each intent term."""
    lower = F.lower(text)
    score = F.lit(0.0)
    for terms, weight in ((query, 1.0), (intent, 0.5)):
        for term in terms:
            score = score + F.when(lower.contains(term), F.lit(weight)).otherwise(F.lit(0.0))
    return score


def supported_by(text: Column, question: str) -> Column:
    """Whether a text has any word of the question in it (ASCII letters and digits, two or more)."""
    import re

    terms = sorted({t for t in re.split("[^A-Za-z0-9]+", question.lower()) if len(t) >= 2})
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.lower(text).contains(t)) if terms else F.lit(False)


def wiki_links(body: Column) -> Column:
    """Targets of ``[[target]]``, in order, repeated ones too."""
    return F.regexp_extract_all(body, F.lit(r"\[\[((?:[^\]]|\](?!\]))+)\]\]"), F.lit(1))


def citations(answer: Column) -> Column:
    return F.array_distinct(F.transform(wiki_links(answer), lambda x: trimmed(x)))


def wiki_path(slug: Column) -> Column:
    return F.concat(F.lit("wiki/"), slug, F.lit(".md"))


def raw_path(digest: Column) -> Column:
    return F.concat(F.lit("raw/"), F.substring(digest, 1, 2), F.lit("/"), F.substring(digest, 3, 62))


def hash_of_raw_path(path: Column) -> Column:
    found = F.concat(F.regexp_extract(path, "([0-9a-f]{2})/([0-9a-f]{62})$", 1), F.regexp_extract(path, "([0-9a-f]{2})/([0-9a-f]{62})$", 2))
    return F.nullif(found, F.lit(""))


def stem_of_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.md$", "")


def human_size(size: Column) -> Column:
    kb = F.lit(1024.0)
    return F.when(size < 1024, F.format_string("%d B", size)).when(size < 1024**2, F.format_string("%.1f KB", size / kb)).otherwise(F.format_string("%.1f MB", size / (kb * kb)))


def tool_summary(name: Column, payload: Column) -> Column:
    """A tool call in short: the path, command or pattern, secrets redacted."""

    def field(*names: str) -> Column:
        return F.coalesce(*(F.get_json_object(payload, f"$.{n}") for n in names), F.lit("?"))

    kind = F.lower(name)
    first = F.coalesce(F.get(F.map_values(F.from_json(payload, "map<string,string>")), F.lit(0)), F.lit(""))
    raw = (
        F.when(kind.isin("read", "edit", "write"), F.concat(F.lit("file: "), field("file_path", "filePath", "path")))
        .when(kind.isin("bash", "shell"), F.concat(F.lit("command: "), F.substring(field("command", "cmd"), 1, 100)))
        .when(kind == "grep", F.concat(F.lit("pattern: "), field("pattern"), F.lit(" in "), F.coalesce(F.get_json_object(payload, "$.path"), F.lit("."))))
        .when(kind == "glob", F.concat(F.lit("pattern: "), field("pattern")))
        .otherwise(F.substring(first, 1, 80))
    )
    return redact(raw)


def fit_vector(values: Column, dim: int) -> Column:
    """A vector padded with zeros, or cut, to ``dim``."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0).cast("float"), dim)), 1, dim)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision, 0 where a norm is 0."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def model_budget(max_input: Column, max_output: Column, prompt: Column, index: Column) -> Column:
    """Tokens left for a chunk: input limit less a tenth, the prompt, the index and the answer; at least 0."""
    return F.greatest(max_input - F.floor(max_input / 10) - prompt - index - max_output, F.lit(0)).cast("long")
