"""Conversation transcripts in six formats, parsed to turns.

Records vary within a file and carry free-form JSON, so a file is parsed as a whole in Python; files are
independent and spread over tasks. Malformed lines are skipped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import BLOCK_TAGS, DIRECTIVE, SECRET_PATTERNS

FORMATS = ("messages", "responses", "chat", "events", "blocks", "envelope")
SCHEMA = "path string, session_id string, format string, title string, filter string, turns array<struct<role:string,timestamp:string,text:string>>"
# How prompts begin that the engine itself sends.
INTERNAL = ("/kb-distill", "/kb-ingest", "Extract knowledge from this transcript", "Merge the new content into the existing page")


def strip(text: str) -> str:
    for tag in BLOCK_TAGS:
        text = re.sub(f"(?s)<{tag}>.*?</{tag}>", "", text)
    return re.sub(DIRECTIVE, "<​\\1", text).strip()


def redact(text: str) -> str:
    for pattern in SECRET_PATTERNS:
        text = re.sub(pattern, "[REDACTED]", text)
    return text


def tool_summary(name: str, given: Any) -> str:
    fields = given if isinstance(given, dict) else {}

    def first(*names: str, default: str = "?") -> str:
        return next((fields[n] for n in names if isinstance(fields.get(n), str)), default)

    kind = name.lower()
    if kind in ("read", "edit", "write"):
        raw = "file: " + first("file_path", "filePath", "path")
    elif kind in ("bash", "shell"):
        raw = "command: " + first("command", "cmd")[:100]
    elif kind == "grep":
        raw = f"pattern: {first('pattern')} in {first('path', default='.')}"
    elif kind == "glob":
        raw = "pattern: " + first("pattern")
    else:
        raw = next((v for v in fields.values() if isinstance(v, str)), given if isinstance(given, str) else "")[:80]
    return redact(raw)


def _tool(name: Any, given: Any) -> str:
    name = name if isinstance(name, str) else "unknown"
    return f"[Tool: {name} — {tool_summary(name, given)}]"


def _records(text: str) -> Iterator[dict]:
    for line in text.splitlines():
        try:
            found = json.loads(line)
        except ValueError:
            continue
        if isinstance(found, dict):
            yield found


def _parts(content: Any) -> list[dict]:
    return [p for p in content if isinstance(p, dict)] if isinstance(content, list) else []


def _texts(content: Any, kind: str | None = "text") -> list[str]:
    found = [p.get("text") for p in _parts(content) if kind is None or p.get("type") == kind]
    return [s for s in (strip(t) for t in found if isinstance(t, str)) if s]


class Session:
    def __init__(self):
        self.id, self.title, self.turns = "", None, []

    def say(self, role: str, record: dict, text: str) -> None:
        stamp = record.get("timestamp")
        stamp = stamp.strip() if isinstance(stamp, str) else ""
        if text:
            self.turns.append((role, stamp or None, text))

    def verdict(self) -> str:
        users = [t for r, _, t in self.turns if r == "user"]
        if not users or not any(r == "assistant" for r, _, _ in self.turns):
            return "non_substantive"
        return "internal" if users[0].strip().startswith(INTERNAL) else "pass"


def _messages(text: str) -> Session:
    s, auto, named = Session(), None, None
    for r in _records(text):
        s.id = s.id or (r["sessionId"] if isinstance(r.get("sessionId"), str) else "")
        message = r.get("message") if isinstance(r.get("message"), dict) else {}
        kind, content = r.get("type"), message.get("content")
        role = (message.get("role") or "").strip() if isinstance(message.get("role"), str) else ""
        if kind == "user" and isinstance(content, str):
            s.say(role or "user", r, strip(content))
        elif kind == "assistant":
            parts = []
            for p in _parts(content):
                if p.get("type") == "text":
                    parts += _texts([p])
                elif p.get("type") == "tool_use":
                    parts.append(_tool(p.get("name"), p.get("input")))
            s.say(role or "assistant", r, "\n".join(parts))
        elif kind == "ai-title" and isinstance(r.get("aiTitle"), str):
            auto = r["aiTitle"].strip() or auto
        elif kind == "custom-title":
            named = (r.get("customTitle") or r.get("title") or "").strip() or named
    s.title = named or auto
    return s


def _responses(text: str) -> Session:
    s = Session()
    for r in _records(text):
        p = r.get("payload") if isinstance(r.get("payload"), dict) else {}
        kind, inner = r.get("type"), p.get("type")
        if kind == "session_meta" and isinstance(p.get("id"), str):
            s.id = p["id"]
        elif kind == "turn_context" and isinstance(p.get("prompt"), str):
            s.say("user", r, strip(p["prompt"]))
        elif kind == "response_item" and inner == "message":
            for part in _parts(p.get("content")):
                if part.get("type") == "output_text" and isinstance(part.get("text"), str):
                    s.say("assistant", r, part["text"])  # kept as it is
        elif kind == "response_item" and inner == "function_call":
            try:
                given = json.loads(p.get("arguments") or "null")
            except (TypeError, ValueError):
                given = None
            s.say("assistant", r, _tool(p.get("name"), given))
        elif kind == "event_msg" and isinstance(p.get("message"), str):
            if inner == "user_message":
                s.say("user", r, strip(p["message"]))
            elif inner == "agent_message":
                s.say("assistant", r, p["message"])
    return s


def _chat(text: str) -> Session:
    s = Session()
    try:
        whole = json.loads(text)
    except ValueError:
        whole = None
    if isinstance(whole, dict) and isinstance(whole.get("messages"), list):
        s.id, rows = whole.get("sessionId") or "", whole["messages"]
    else:
        rows = []
        for r in _records(text):
            if "$set" in r:
                continue
            if not s.id and "kind" in r and isinstance(r.get("sessionId"), str):
                s.id = r["sessionId"]
            else:
                rows.append(r)
    for r in (x for x in rows if isinstance(x, dict)):
        if r.get("type") == "user":
            for t in _texts(r.get("content"), None):
                s.say("user", r, t)
        elif r.get("type") == "gemini":
            parts = [strip(r["content"])] if isinstance(r.get("content"), str) and strip(r["content"]) else []
            parts += [_tool(c.get("name"), c.get("args")) for c in _parts(r.get("toolCalls"))]
            s.say("assistant", r, "\n".join(parts))
    return s


def _events(text: str) -> Session:
    s = Session()
    for r in _records(text):
        if r.get("type") == "session":
            s.id = r.get("id") or s.id
        elif r.get("type") == "message" and isinstance(r.get("message"), dict):
            role = r["message"].get("role")
            if role in ("user", "assistant"):
                s.say(role, r, "\n".join(_texts(r["message"].get("content"))))
    return s


def _blocks(text: str) -> Session:
    s = Session()
    whole = json.loads(text)
    s.id = whole.get("session_id") or ""
    for r in _parts(whole.get("messages")):
        content = r.get("content")
        words = strip(content) if isinstance(content, str) else "\n".join(_texts(content))
        if r.get("role") in ("user", "assistant"):
            s.say(r["role"], {"timestamp": r.get("timestamp") or whole.get("session_start")}, words)
    return s


def _envelope(text: str) -> Session:
    s = Session()
    whole = json.loads(text)
    s.id = whole.get("session_id") or ""
    for r in _parts(whole.get("turns")):
        s.say(r.get("role") or "user", r, strip(r.get("text") or ""))
    return s


PARSERS = {"messages": _messages, "responses": _responses, "chat": _chat, "events": _events, "blocks": _blocks, "envelope": _envelope}


def sniff(path: str, text: str) -> str | None:
    """The format by extension and the keys of the first record."""
    if path.endswith(".json"):
        try:
            whole = json.loads(text)
        except ValueError:
            return None
        if not isinstance(whole, dict):
            return None
        if "turns" in whole and "session_id" in whole:
            return "envelope"
        if "session_id" in whole and "messages" in whole:
            return "blocks"
        return "chat" if "sessionId" in whole and "messages" in whole else None
    first = next(_records(text), {})
    if first.get("type") == "session" and "version" in first:
        return "events"
    if "payload" in first or first.get("type") in ("session_meta", "event_msg") or "response_id" in first:
        return "responses"
    if "kind" in first and "sessionId" in first:
        return "chat"
    return "messages" if "uuid" in first or "sessionId" in first else None


def parse_sessions(files: DataFrame, form: str | None = None) -> DataFrame:
    """Sessions of (path, text) rows; files that no format fits, or that do not parse, have filter ``unreadable``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                kind = form or sniff(path, text or "")
                try:
                    s = PARSERS[kind](text or "") if kind else None
                except (ValueError, AttributeError, TypeError):
                    s = None
                if s is None:
                    out.append((path, None, kind, None, "unreadable", []))
                else:
                    out.append((path, s.id, kind, s.title, s.verdict(), [{"role": r, "timestamp": t, "text": x} for r, t, x in s.turns]))
            yield pd.DataFrame(out, columns=["path", "session_id", "format", "title", "filter", "turns"])

    return files.select("path", "text").mapInPandas(run, SCHEMA)


def read_sessions(spark: SparkSession, glob: str, form: str | None = None) -> DataFrame:
    """Session files of a glob, whole; trajectory and reset siblings are left out."""
    rows = spark.read.format("binaryFile").load(glob).filter(~F.col("path").rlike(r"\.(trajectory|reset)[^/]*$"))
    return parse_sessions(rows.select("path", F.col("content").cast("string").alias("text")), form)


def exported_sessions(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Turns from exported tables: messages (id, session_id, time_created ms, data) and their parts (message_id, time_created, data)."""
    from pyspark.sql import Window

    text = parts.filter(F.get_json_object("data", "$.type") == "text").select("message_id", F.struct("time_created", F.get_json_object("data", "$.text").alias("t")).alias("p"))
    joined = text.groupBy("message_id").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list("p")), lambda p: p["t"])).alias("text"))
    rows = messages.join(joined, messages["id"] == joined["message_id"], "left")
    order = Window.partitionBy("session_id").orderBy("time_created", "id")
    stamp = F.date_format(F.timestamp_millis("time_created"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.filter("text <> ''").select("session_id", (F.row_number().over(order) - 1).alias("turn"), F.get_json_object("data", "$.role").alias("role"), stamp.alias("timestamp"), "text")


def render(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, text): sessions as headed sections in order."""
    role = F.when(F.lower("role") == "user", "User").when(F.lower("role") == "assistant", "Assistant").otherwise(F.col("role"))
    stamp = F.when(F.col("timestamp").isNotNull(), F.concat(F.lit(" ["), F.col("timestamp"), F.lit("]"))).otherwise("") if "timestamp" in turns.columns else F.lit("")
    section = F.concat(F.lit("## "), role, stamp, F.lit("\n"), F.trim("text"), F.lit("\n"))
    listed = turns.select(key, F.struct(order, section.alias("s")).alias("t")).groupBy(key).agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return listed.select(key, F.array_join(F.transform("ts", lambda t: t["s"]), "\n").alias("text"))


def classify(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, filter): sessions without both sides are not substantive; those that the engine started are internal."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col(order)))
    internal = F.lit(False)
    for start in INTERNAL:
        internal = internal | F.coalesce(F.trim("first").startswith(start), F.lit(False))
    sides = turns.groupBy(key).agg(F.max((F.col("role") == "user").cast("int")).alias("u"), F.max((F.col("role") == "assistant").cast("int")).alias("a"), first.alias("first"))
    return sides.select(key, F.when((F.col("u") == 0) | (F.col("a") == 0), "non_substantive").when(internal, "internal").otherwise("pass").alias("filter"))
