"""Quality rules as weak supervision.

Every rule votes good (1), bad (-1) or abstains (0) on a document. Expectation-maximisation over the
counts of vote patterns (at most 3 to the number of rules, however many documents) estimates how each
rule votes on good and on bad documents, and the share of good ones. The posterior of good then
decides, in place of an all-must-pass filter.

Defined results: a null or empty text has no words and fails the base rule; repeated rows are judged
each alike; a null id stays null; on an empty table nothing is estimated and nothing returned; extra
columns, clashing names included, pass through ``filter_documents`` untouched.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialise, prepare_python, slices

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Base rule: fewer words, or a larger percentage of words in repeated windows, always fails.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rules: the measure, the bounds of a good vote and the bounds outside which the vote is bad.
RULES: dict[str, tuple[str, tuple[float, float], tuple[float, float]]] = {
    "length": ("n_words", (80, math.inf), (50, math.inf)),
    "repetition": ("repeat_share", (0, 0.10), (0, 0.30)),
    "symbols": ("symbol_rate", (0, 0.01), (0, 0.10)),
    "lines": ("dup_line_share", (0, 0.10), (0, 0.30)),
    "word_length": ("mean_word", (3.0, 9.0), (2.5, 12.0)),
    "capitals": ("upper_share", (0, 0.15), (0, 0.50)),
    "exclaims": ("exclaim_rate", (0, 0.05), (0, 0.25)),
    "variety": ("top_word_share", (0, 0.12), (0, 0.30)),
    "digits": ("digit_share", (0, 0.05), (0, 0.25)),
}
STEPS = 100


def measure(text: str | None) -> dict[str, float]:
    """The counts of the base rule and the measures that the rules look at."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes split at exactly the six ASCII spaces
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        counts = Counter(windows)
        if len(counts) < len(windows):
            end = 0
            for i, window in enumerate(windows):
                if counts[window] > 1:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    n_symbols = sum(map(text.count, SYMBOLS))
    dup_lines = len(lines) - len(set(lines))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return {
        "n_words": n,
        "word_chars": chars,
        "n_symbols": n_symbols,
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeated,
        "repeat_share": repeated / max(n, 1),
        "symbol_rate": n_symbols / max(n, 1),
        "dup_line_share": dup_lines / max(len(lines), 1),
        "mean_word": chars / max(n, 1),
        "upper_share": upper / max(chars, 1),
        "exclaim_rate": text.count("!") / max(n, 1),
        "top_word_share": (max(Counter(words).values()) if n >= 20 else 0) / max(n, 1),
        "digit_share": sum(map(text.count, "0123456789")) / max(chars, 1),
    }


_UPPER = bytes(range(65, 91))


def votes(m: Mapping[str, float]) -> str:
    """The vote pattern, a character a rule: ``+`` good, ``-`` bad, ``0`` abstains."""
    out = []
    for name, good, fair in RULES.values():
        x = m[name]
        out.append("+" if good[0] <= x <= good[1] else "0" if fair[0] <= x <= fair[1] else "-")
    return "".join(out)


def base_failed(m: Mapping[str, float]) -> bool:
    return m["n_words"] < MIN_WORDS or 100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"]


def fit(patterns: Mapping[str, int], steps: int = STEPS) -> dict[str, float]:
    """Posterior of good for every pattern, by expectation-maximisation.

    It starts from the view that one bad vote makes a document suspect. Half a pseudo-count a cell
    keeps estimates off 0 and 1.
    """
    if not patterns:
        return {}
    total = sum(patterns.values())
    width = len(next(iter(patterns)))
    post = {p: 0.1 if "-" in p else 0.95 for p in patterns}
    for _ in range(steps):
        good = sum(n * post[p] for p, n in patterns.items())
        prior = (good + 1) / (total + 2)
        ratio = []
        for j in range(width):
            mass = {v: [0.5, 0.5] for v in "+0-"}
            for p, n in patterns.items():
                mass[p[j]][0] += n * post[p]
                mass[p[j]][1] += n * (1 - post[p])
            sums = [sum(m[k] for m in mass.values()) for k in (0, 1)]
            ratio.append({v: math.log(m[0] / sums[0]) - math.log(m[1] / sums[1]) for v, m in mass.items()})
        base = math.log(prior) - math.log1p(-prior)
        new = {p: 1 / (1 + math.exp(-max(-500.0, min(500.0, base + sum(r[v] for r, v in zip(ratio, p, strict=True)))))) for p in patterns}
        moved = max(abs(new[p] - post[p]) for p in patterns)
        post = new
        if moved < 1e-9:
            break
    return post


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row: id, base counts, base verdict and vote pattern; one narrow map."""
    prepare_python(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [measure(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), *(pa.array([m[c] for m in found], pa.int64()) for c in COUNTS), pa.array([base_failed(m) for m in found], pa.bool_()), pa.array([votes(m) for m in found], pa.string())],
                names=["doc_id", *COUNTS, "base_failed", "votes"],
            )

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "base_failed boolean", "votes string"])
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, schema)


def posteriors(found: DataFrame) -> dict[str, float]:
    """Fit on the patterns of all rows; what reaches the driver has one row a pattern (at most 3^9)."""
    return fit({r["votes"]: r["n"] for r in found.groupBy("votes").agg(F.count("*").alias("n")).collect()})


def judge(docs: DataFrame, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """Per row of ``docs``: base counts, base verdict, votes, posterior of good, and whether it is kept."""
    found = materialise(measured(docs, text), "votes")
    post = posteriors(found)
    scores = docs.sparkSession.createDataFrame(list(post.items()), "votes string, posterior double")
    return (
        found.join(F.broadcast(scores), "votes", "left")  # a row a pattern: bounded by 3^9
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce("posterior", F.lit(0.0)) >= threshold))
        .select("doc_id", *COUNTS, "base_failed", "kept", "votes", "posterior")
    )


def filter_documents(docs: DataFrame, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Measures are taken twice (to fit, then to filter) in place of a join on ids, which may be null or repeat.
    """
    post = posteriors(measured(docs.withColumn("doc_id", F.lit(None).cast("long")) if "doc_id" not in docs.columns else docs, text))
    schema = docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            keep = []
            for t in batch.column(text).to_pylist():
                m = measure(t)
                keep.append(not base_failed(m) and post.get(votes(m), 0.0) >= threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
