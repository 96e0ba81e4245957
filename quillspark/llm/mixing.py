"""Mixing to target weights with soft domain membership, in DataFrame operations alone.

A classifier fitted on a bounded sample of the labelled rows gives each document posteriors over the
domains ``good``, ``low`` and ``toxic``. Words and marks of shape are hashed to buckets, and each bucket has
log odds of either sign for ``low`` and for ``toxic`` against ``good``, drawn in by their standard error.
A document's sums, maxima and counts of these and its length go into a multinomial logistic regression,
which is fitted on odds that come from other folds of the sample, so its posteriors are calibrated.

Rates, one a document and none negative, are then fitted so that the expected tokens of each domain, the
sum of rate x tokens x posterior, match the targets in the least-squares sense. Steps of projected
gradient descent start from rates of 1: against the gradient of the squared residuals, which lies in the
span of the posteriors, then projected onto the nonnegative rates. So after any number of steps the rates
are max(0, 1 - posterior . m) for one vector ``m`` of as many numbers as domains. A step is one distributed
aggregate: the totals, and the Gram matrix of the posteriors over rows with a rate above 0, which scales
the step. The fit ends when each domain's residual is within the tolerance. Where no nonnegative rates meet the
targets it ends when steps no longer bring them nearer, with the nearest rates it met; the residual that is left is
reported. A ``limit`` on the numbers of ``m``, off by default, keeps a classifier that cannot tell from emptying the corpus;
a domain whose number stands at it may miss its target.

Targets: where each domain has a weight, these are the shares of the largest whole that repeats no domain.
Otherwise they are the largest shares that domains may have: one that has less keeps what it has, those
without a weight keep all. A document is kept with the probability of its rate (surely if above 1), drawn
from a hash of its id and text.

Defined results: a null or blank text has 0 tokens, the posterior of a text without words, and stays; a
long text is read whole; rows with a null id are treated as any other; repeated rows share their
posterior and their fate; of several labels of an id the first domain by name counts, of several texts of a labelled id
the one of the smallest hash; with no labelled rows all posteriors are equal, and labels of one domain alone give posteriors by
length alone; an empty table gives no rows; extra columns pass through ``mix``, whatever
their names.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialise

DOMAINS = ("good", "low", "toxic")
#: Largest shares of the expected tokens.
WEIGHTS = {"low": 0.01, "toxic": 0.01}
#: Labelled rows that the classifier is fitted on, at most.
SAMPLE_ROWS = 20_000
#: Buckets of words, labelled rows that a bucket must stand in, and standard errors by which log odds are drawn to 0.
BUCKETS = 1 << 16
LEAST_ROWS = 5
CAUTION = 1.5
#: Log odds from which a word counts as telling.
TELLING = 1.5
#: Folds of the sample, ridge of the regression, and its steps at most.
FOLDS = 3
RIDGE = 1.0
NEWTON_STEPS = 25
#: Length to which a step of the regression or the fit is cut.
LONGEST_STEP = 10.0
#: Steps of the fit at most, and the residual, as part of all tokens, at which it ends.
STEPS = 50
TOLERANCE = 1e-4
#: Steps without an improvement by a hundredth after which no better rates are looked for.
PATIENCE = 12
SYMBOLS = "[#*$%&|<>!]"
SPACES = " \t\n\x0b\x0c\r.,;:?"
MEASURES = 8


def _bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``."""
    return F.transform(F.array(value), use)[0]


def words_column(text: Column) -> Column:
    """The lower-case words of a text, apart by white space and the marks ``. , ; : ?``."""
    body = F.btrim(F.lower(text), F.lit(SPACES))
    return F.when(F.length(body) > 0, F.split(body, r"[\x20\x09-\x0D.,;:?]+")).otherwise(F.array().cast("array<string>"))


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def buckets_column(words: Column, text: Column) -> Column:
    """Distinct buckets of a document: of its words, of symbols in 20 words, and of the variety of its words."""
    n = F.greatest(F.size(words), F.lit(1))
    symbols = F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0))

    def marked(distinct: Column) -> Column:
        marks = [F.least(F.floor(symbols * 20 / n), F.lit(20)), F.floor(F.size(distinct) * 10 / n)]
        return F.array_distinct(F.concat(distinct, F.array(*(_bucket(F.concat(F.lit(f"\t{i} "), m.cast("string"))) for i, m in enumerate(marks)))))

    return _bind(F.array_distinct(F.transform(words, _bucket)), marked)


def label_domain() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")


def _table(odds: dict[int, tuple[float, float]]) -> Column:
    """Log odds by bucket as one constant; null where a bucket has none."""
    return F.from_json(F.lit(json.dumps([{"l": odds[b][0], "t": odds[b][1]} if b in odds else None for b in range(BUCKETS)], separators=(",", ":"))), "array<struct<l: double, t: double>>")


def odds_table(found: DataFrame) -> DataFrame:
    """The same as one row of one column ``odds``, from rows of a bucket ``b`` and its ``all``: BUCKETS entries whatever the corpus."""
    dense = found.sparkSession.range(BUCKETS).withColumnRenamed("id", "b").join(found.select("b", "all"), "b", "left")
    entries = F.array_sort(F.collect_list(F.struct("b", "all")))
    return materialise(dense.agg(F.transform(entries, lambda e: e["all"]).alias("odds")), "odds")


def _measures(s, n: Column) -> Column:
    return F.array(F.lit(1.0), s["sl"] / 10, s["st"] / 10, s["ml"], s["mt"], F.log1p(s["kl"]), F.log1p(s["kt"]), F.log1p(n.cast("double")) / 5)


def measures(table: Column, buckets: Column, n: Column) -> Column:
    """What the regression looks at: 1, sums, maxima and telling counts for low and toxic, and length."""

    def measured(t: Column) -> Column:
        hits = F.filter(F.transform(buckets, lambda b: t[b]), lambda e: e.isNotNull())
        start = F.struct(*(F.lit(0.0).alias(c) for c in ("sl", "st", "ml", "mt", "kl", "kt")))

        def add(acc: Column, e: Column) -> Column:
            return F.struct(
                (acc["sl"] + e["l"]).alias("sl"), (acc["st"] + e["t"]).alias("st"), F.greatest(acc["ml"], e["l"]).alias("ml"), F.greatest(acc["mt"], e["t"]).alias("mt"),
                (acc["kl"] + (e["l"] > TELLING).cast("double")).alias("kl"), (acc["kt"] + (e["t"] > TELLING).cast("double")).alias("kt"),
            )

        return F.aggregate(hits, start, add, lambda s: _measures(s, n))

    return _bind(table, measured)


def _softmax(logs: Column) -> Column:
    spread = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return _bind(spread, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda acc, y: acc + y)))


def _posterior(weights: list[list[float]], z: Column) -> Column:
    def dot(w: list[float]) -> Column:
        return sum((z[k] * F.lit(w[k]) for k in range(1, MEASURES)), z[0] * F.lit(w[0]))

    return _bind(F.array(F.lit(0.0), *(dot(w) for w in weights)), _softmax)


def solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """A linear system of a few unknowns, by elimination with pivots."""
    rows = [[*row, r] for row, r in zip(matrix, right, strict=True)]
    n = len(rows)
    for i in range(n):
        best = max(range(i, n), key=lambda j: abs(rows[j][i]))
        rows[i], rows[best] = rows[best], rows[i]
        for j in range(i + 1, n):
            by = rows[j][i] / rows[i][i]
            rows[j] = [a - by * b for a, b in zip(rows[j], rows[i], strict=True)]
    out = [0.0] * n
    for i in reversed(range(n)):
        out[i] = (rows[i][n] - sum(rows[i][j] * out[j] for j in range(i + 1, n))) / rows[i][i]
    return out


def _regress(rows: DataFrame) -> list[list[float]]:
    """Weights of the multinomial regression of ``y`` (1 low, 2 toxic) on ``z``, by Newton steps of bounded length; each is one aggregate."""
    k = range(MEASURES)
    w = [[0.0] * MEASURES for _ in (1, 2)]
    pairs = [(i, j) for i in k for j in k if i <= j]
    for _ in range(NEWTON_STEPS):
        # the weights are one constant array, so all steps share their generated code
        constant = F.from_json(F.lit(json.dumps(w)), "array<array<double>>")
        logs = F.array(F.lit(0.0), *(F.aggregate(F.zip_with(F.col("z"), constant[c], lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x) for c in (0, 1)))
        p = rows.select("y", "z", _softmax(logs).alias("p")).select(*(F.col("z")[i].alias(f"z{i}") for i in k), F.col("p")[1].alias("p1"), F.col("p")[2].alias("p2"), (F.col("y") == 1).cast("double").alias("y1"), (F.col("y") == 2).cast("double").alias("y2"))
        weight = {(0, 0): F.col("p1") * (1 - F.col("p1")), (0, 1): -F.col("p1") * F.col("p2"), (1, 1): F.col("p2") * (1 - F.col("p2"))}
        slopes = [F.sum((F.col(f"p{c + 1}") - F.col(f"y{c + 1}")) * F.col(f"z{i}")).alias(f"g{c}_{i}") for c in (0, 1) for i in k]
        bends = [F.sum(v * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"h{c}{d}_{i}_{j}") for (c, d), v in weight.items() for i, j in pairs]
        got = p.agg(*slopes, *bends).first()
        slope = [(got[f"g{c}_{i}"] or 0.0) + RIDGE * w[c][i] for c in (0, 1) for i in k]
        bend = [[(got[f"h{min(c, d)}{max(c, d)}_{min(i, j)}_{max(i, j)}"] or 0.0) + RIDGE * (c == d and i == j) for d in (0, 1) for j in k] for c in (0, 1) for i in k]
        step = solve(bend, slope)
        shorter = min(1.0, LONGEST_STEP / max(LONGEST_STEP, *map(abs, step)))
        w = [[w[c][i] - shorter * step[c * MEASURES + i] for i in k] for c in (0, 1)]
        if max(map(abs, step)) < 1e-4:
            break
    return w


def fit_classifier(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> dict | None:
    """Log odds by bucket and weights of the regression; nothing where no row is labelled.

    At most ``sample`` labelled ids are drawn, by hash, so they may be broadcast. ``table`` is a one-row table of the log
    odds of all BUCKETS buckets; the weights are a few numbers.
    """
    drawn = labels.select(F.col("doc_id").alias("_id"), label_domain().alias("domain")).filter("_id is not null and domain is not null").groupBy("_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    words = _bind(words_column(F.coalesce(F.col("text"), F.lit(""))), lambda w: F.struct(F.size(w).alias("n"), buckets_column(w, F.col("text")).alias("b")))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select(F.array_position(F.array(*map(F.lit, DOMAINS)), F.col("domain")).cast("int").alias("y"), F.pmod(F.xxhash64(F.lit("fold"), "_id"), F.lit(FOLDS)).cast("int").alias("fold"), words.alias("s"), "_id", F.xxhash64("text").alias("_t"))
    # of rows that share a labelled id the one of the smallest hash of its text is learned from
    rows = rows.select("_id", F.struct("_t", (F.col("y") - 1).alias("y"), "fold", F.col("s.n").alias("n"), F.col("s.b").alias("b")).alias("r"))
    rows = materialise(rows.groupBy("_id").agg(F.min("r").alias("r")).select("_id", "r.y", "r.fold", "r.n", "r.b"), "labelled")
    totals = {(r["fold"], r["y"]): r["n"] for r in rows.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return None
    everything = list(range(FOLDS))
    cells = [(f, y) for f in everything for y in range(len(DOMAINS))]
    counts = rows.select("fold", "y", F.explode("b").alias("b")).groupBy("b").agg(*(F.sum(((F.col("fold") == f) & (F.col("y") == y)).cast("long")).alias(f"c{f}{y}") for f, y in cells))

    def odds(folds: list[int]) -> Column:
        """Log odds of low and toxic in some folds, drawn in; null where both are 0 or rows are too few."""
        n = [sum(totals.get((f, y), 0) for f in folds) for y in range(len(DOMAINS))]
        c = [sum(F.col(f"c{f}{y}") for f in folds) for y in range(len(DOMAINS))]
        pair = []
        for y in (1, 2):
            log = F.log((c[y] + 0.5) / (n[y] + 1)) - F.log((c[0] + 0.5) / (n[0] + 1))
            error = CAUTION * F.sqrt(1 / (c[y] + 0.5) + 1 / (c[0] + 0.5))
            pair.append(F.round(F.signum(log) * F.greatest(F.lit(0.0), F.abs(log) - error), 4) if n[y] and n[0] else F.lit(0.0))
        return F.when((c[0] + c[1] + c[2] >= LEAST_ROWS) & ((pair[0] != 0) | (pair[1] != 0)), F.struct(pair[0].alias("l"), pair[1].alias("t")))

    sets = {**{f"without_{f}": [x for x in everything if x != f] for f in everything}, "all": everything}
    found = materialise(counts.select("b", *(odds(folds).alias(name) for name, folds in sets.items())), "odds")

    # the measures of the labelled rows, each by the odds of the other folds, as sums over a join
    other = F.lit(None).cast("struct<l: double, t: double>")
    for f in everything:
        other = F.when(F.col("fold") == f, F.col(f"without_{f}")).otherwise(other)
    hits = rows.select("_id", "fold", F.explode("b").alias("b")).join(found, "b").select("_id", other.alias("e")).filter("e is not null")
    sums = hits.groupBy("_id").agg(
        *(F.sum(f"e.{c}").alias(f"s{c}") for c in "lt"), *(F.greatest(F.lit(0.0), F.max(f"e.{c}")).alias(f"m{c}") for c in "lt"), *(F.sum((F.col(f"e.{c}") > TELLING).cast("double")).alias(f"k{c}") for c in "lt"),
    )
    joined = rows.select("_id", "y", "n").join(sums, "_id", "left").fillna(0.0)
    weights = _regress(materialise(joined.select("y", _measures({c: F.col(c) for c in ("sl", "st", "ml", "mt", "kl", "kt")}, F.col("n")).alias("z")), "measures"))
    return {"table": odds_table(found), "weights": weights}


def scored(model: dict | None, text: Column, table: Column | None = None) -> Column:
    """Struct of ``n``, the words of a text, and ``p``, its posteriors in the order of DOMAINS; log odds by bucket are ``table``, or the model's own."""

    def classify(words: Column) -> Column:
        if model is None:
            p = F.array(*(F.lit(1.0 / len(DOMAINS)) for _ in DOMAINS))
        else:
            p = _bind(measures(_table(model["odds"]) if table is None else table, buckets_column(words, text), F.size(words)), lambda z: _posterior(model["weights"], z))
        return F.struct(F.size(words).cast("long").alias("n"), p.alias("p"))

    return _bind(words_column(F.coalesce(text, F.lit(""))), classify)


def posteriors(docs: DataFrame, model: dict | None, *columns: Column | str) -> DataFrame:
    """``columns`` of ``docs``, with ``n``, ``p`` and ``_h``, a hash of the text, as a written table."""
    rows = docs.select(*columns, F.col("text").alias("_text"))
    names = [c for c in rows.columns if c != "_text"]
    if model is not None:  # a scalar subquery: one row, worked out once and held by each task, beside no document
        rows = rows.withColumn("_odds", model["table"].select("odds").scalar())
    rows = rows.select(*names, scored(model, F.col("_text"), None if model is None else F.col("_odds")).alias("s"), F.xxhash64("_text").alias("_h"))
    return materialise(rows.select(*names, "s.n", "s.p", "_h"), "posteriors")


def targets_of(have: list[float], weights: dict[str, float]) -> list[float]:
    """Target totals from what the domains have."""
    if all(d in weights for d in DOMAINS):
        share = [weights[d] / sum(weights.values()) for d in DOMAINS]
        total = min((h / w for h, w in zip(have, share, strict=True) if w > 0), default=0.0)
        return [w * total for w in share]
    out = list(have)
    for _ in range(200):
        total = sum(out)
        out = [min(h, weights[d] * total) if d in weights else h for d, h in zip(DOMAINS, have, strict=True)]
        if abs(sum(out) - total) <= 1e-12 * total:
            break
    return out


def rate_of(moved: list[float]) -> Column:
    """The rate of a row with the posteriors ``p``."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum(F.col("p")[i] * F.lit(moved[i]) for i in range(len(DOMAINS))))


def fit_rates(rows: DataFrame, weights: dict[str, float], steps: int = STEPS, tolerance: float = TOLERANCE, limit: float | None = None) -> dict:
    """``moved`` (see rate_of), ``targets``, ``reached`` and ``residual`` for rows of ``n`` (tokens) and ``p`` (posteriors)."""
    k = range(len(DOMAINS))
    limit = math.inf if limit is None else limit

    def look(moved: list[float]) -> tuple[list[float], list[list[float]], float]:
        """Totals, Gram matrix, and what the rates cost together with what they are moved for."""
        rate = rate_of(moved)
        mass = F.when(rate > 0, F.col("n")).otherwise(F.lit(0))
        pulled = sum(F.col("p")[i] * F.lit(moved[i]) for i in k)
        got = rows.agg(
            *(F.sum(rate * F.col("n") * F.col("p")[i]).alias(f"t{i}") for i in k), *(F.sum(mass * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}{j}") for i in k for j in k if i <= j),
            F.sum(F.col("n") * ((rate - 1) * (rate - 1) / 2 + rate * pulled)).alias("cost"),
        ).first()
        return [float(got[f"t{i}"] or 0.0) for i in k], [[float(got[f"g{min(i, j)}{max(i, j)}"] or 0.0) for j in k] for i in k], float(got["cost"] or 0.0)

    moved = [0.0 for _ in k]
    reached, gram, cost = look(moved)
    everything = sum(reached)
    targets = targets_of(reached, weights) if everything else reached
    best, since = None, 0
    for turn in range(steps + 1):
        off = [a - b for a, b in zip(reached, targets, strict=True)]
        far = sum(o * o for o in off)
        since = 0 if best is None or far < 0.98 * best[0] else since + 1
        if best is None or far < best[0]:
            best = far, moved, reached, max(map(abs, off)) / everything if everything else 0.0
        free = [i for i in k if not (moved[i] >= limit and off[i] > 0 or moved[i] <= -limit and off[i] < 0)]
        if turn == steps or since > PATIENCE or max((abs(off[i]) for i in free), default=0.0) <= tolerance * everything:
            break
        small = 1e-9 * sum(gram[i][i] for i in k) + 1e-12
        value = cost - sum(m * t for m, t in zip(moved, targets, strict=True))
        # Newton's direction; where the posteriors are all but collinear, each domain's own
        ways = solve([[gram[i][j] + small * (i == j) for j in free] for i in free], [off[i] for i in free]), [off[i] / (sum(gram[i]) + small) for i in free]
        found = None
        for step in (dict(zip(free, way, strict=True)) for way in ways):
            size = min(1.0, LONGEST_STEP / max(LONGEST_STEP, *map(abs, step.values())))
            while size > 1e-5 and found is None:
                tried = [max(-limit, min(limit, moved[i] + size * step.get(i, 0.0))) for i in k]
                new = look(tried)
                if new[2] - sum(m * t for m, t in zip(tried, targets, strict=True)) > value:
                    found = tried, new
                size /= 4
            if found is not None:
                break
        if found is None:
            break
        moved, (reached, gram, cost) = found
    _, moved, reached, residual = best
    return {"moved": moved, "targets": targets, "reached": reached, "residual": residual}


def _kept(rate: Column) -> Column:
    draw = F.pmod(F.xxhash64(F.lit("mix"), F.col("doc_id"), F.col("_h")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.col("n") == 0) | (draw < rate)


def mix_report(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, limit: float | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, posteriors, rate, whether it is kept, and the residual of the fit as part of all tokens."""
    rows = posteriors(docs, fit_classifier(docs, labels), "doc_id")
    fit = fit_rates(rows, WEIGHTS if weights is None else weights, limit=limit)
    rate = rate_of(fit["moved"])
    return rows.select("doc_id", F.col("n").alias("n_tokens"), *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)), rate.alias("rate"), _kept(rate).alias("kept"), F.lit(float(fit["residual"])).alias("residual"))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, limit: float | None = None) -> DataFrame:
    """The rows of ``docs`` that the rates keep, with all their columns."""
    # with the rows themselves: ids may be null or repeat, and scoring twice costs more
    rows = posteriors(docs, fit_classifier(docs, labels), F.struct(*docs.columns).alias("_row"), "doc_id")
    rate = rate_of(fit_rates(rows, WEIGHTS if weights is None else weights, limit=limit)["moved"])
    return rows.filter(_kept(rate)).select("_row.*")
