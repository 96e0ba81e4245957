"""Pseudonyms against a plain Python twin: scan, validate, permute."""

import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F

from quillspark.llm import pii_feistel as P

KEY = P.DEFAULT_KEY + "|"
FIRST = datetime.date(1800, 1, 1).toordinal()


def amount(text, digits=12):
    return int(hashlib.sha256(text.encode()).hexdigest()[:digits], 16)


def pair(x, y, a, b, tweak):
    for r in range(4):
        x = (x + amount(f"{tweak}|{r}|x|{y}")) % a
        y = (y + amount(f"{tweak}|{r}|y|{x}")) % b
    return x, y


def chars(value, tweak):
    def half(own, other, r):
        s = hashlib.sha512(f"{tweak}|{r}|{other}".encode()).hexdigest()
        out = ""
        for i, c in enumerate(own):
            by = int(s[i % 32 * 4 : i % 32 * 4 + 4], 16)
            for low, size in P.CLASSES:
                if low <= ord(c) < low + size:
                    c = chr(low + (ord(c) - low + by) % size)
                    break
            out += c
        return out

    left, right = value[: len(value) // 2], value[len(value) // 2 :]
    for r in range(0, 8, 2):
        right = half(right, left, r)
        left = half(left, right, r + 1)
    return left + right


def luhn(digits):
    return sum(sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


def refill(raw, new):
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in raw)


def card(raw):
    d = re.sub("[^0-9]", "", raw)
    if not 13 <= len(d) <= 19 or luhn(d) or len(set(d)) == 1:
        return None
    body = chars(d[:-1], KEY + "card")
    return refill(raw, body + next(c for c in "0123456789" if luhn(body + c) == 0))


def iban(raw):
    v = raw.replace(" ", "")
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", raw) or not 15 <= len(v) <= 34 or number(v[4:] + v[:4]) % 97 != 1:
        return None
    body = chars(v[4:], KEY + "iban")
    it = iter(v[:2] + f"{98 - number(body + v[:2] + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(it) for c in raw)


def phone(raw):
    d = re.sub("[^0-9]", "", raw)
    if not re.fullmatch("[2-9][0-9]{2}[2-9][0-9]{6}", d[-10:]):
        return None
    ten = [chr(200 + int(c) - 2) if i in (0, 3) else c for i, c in enumerate(d[-10:])]
    return refill(raw, d[:-10] + "".join(str(ord(c) - 198) if ord(c) >= 200 else c for c in chars("".join(ten), KEY + "phone")))


def ssn(raw):
    area, group, serial = map(int, raw.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    areas = [x for x in range(1, 900) if x != 666]
    x, y = pair(areas.index(area), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, KEY + "ssn")
    return f"{areas[x]:03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d}"


def ip(raw):
    o = list(map(int, raw.split(".")))
    if max(o) > 255:
        return None
    x, y = pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, KEY + "ip")
    return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"


def moved(day, fits):
    """The day of the same cycle that the permutation leads to; years before 1 stand for those after 9999."""
    n = day.toordinal() - FIRST
    cycle = n // 146_097
    at = n % 146_097
    while True:
        x, y = pair(at // 773, at % 773, 189, 773, KEY + "date")
        at = x * 773 + y
        for c in (20, -5) if cycle in (20, -5) else (cycle,):
            ordinal = FIRST + c * 146_097 + at
            if 1 <= ordinal <= datetime.date.max.toordinal() and fits(found := datetime.date.fromordinal(ordinal)):
                return found


def date(raw):
    def day(y, m, d):
        try:
            return datetime.date(int(y), int(m), int(d))
        except ValueError:
            return None

    if raw[4] == "-":
        at = day(raw[:4], raw[5:7], raw[8:])
        return at and (lambda d: f"{d.year:04d}-{d.month:02d}-{d.day:02d}")(moved(at, lambda d: True))
    s = raw[2]
    if at := day(raw[6:], raw[3:5], raw[:2]):
        return (lambda d: f"{d.day:02d}{s}{d.month:02d}{s}{d.year:04d}")(moved(at, lambda d: True))
    at = day(raw[6:], raw[:2], raw[3:5])
    return at and (lambda d: f"{d.month:02d}{s}{d.day:02d}{s}{d.year:04d}")(moved(at, lambda d: d.day > 12))


def usual(raw):
    sizes, marks = [len(x) for x in re.split("[ -]", raw)], set(re.findall("[ -]", raw))
    form = len(sizes) == 1 or len(marks) == 1 and (sizes[:3] == [4, 4, 4] and len(sizes) in (4, 5) and sizes[3] <= 4 and sizes[4:] in ([], [1], [2], [3]) or sizes[:2] == [4, 6] and len(sizes) == 3 and sizes[2] in (4, 5))
    return card(raw) if form else None


def twin(text):
    """One kind after another, over the parts that are still open."""
    parts = [(text, False)]

    def simple(pattern, make):
        def cut(t):
            out, at = [], 0
            for m in re.finditer(pattern, t):
                new = make(m[0])
                out += [(t[at : m.start()], False), (new if new else m[0], bool(new))]
                at = m.end()
            return [*out, (t[at:], False)]

        return cut

    def runs(pattern, group, make, most):
        def cut(t):
            out, at = [], 0
            for m in re.finditer(pattern, t):
                out.append((t[at : m.start()], False))
                at = m.end()
                tokens, i, opened = re.findall(group, m[0]), 0, ""
                while i < len(tokens):
                    for k in range(min(most, len(tokens) - i), 0, -1):
                        raw = "".join(tokens[i : i + k])
                        value = re.sub("[ -]$", "", raw)
                        if new := make(value):
                            out += [(opened, False), (new, True)]
                            opened, i = raw[len(value) :], i + k
                            break
                    else:
                        opened += tokens[i]
                        i += 1
                out.append((opened, False))
            return [*out, (t[at:], False)]

        return cut

    digits = r"(?<![0-9])[0-9]+(?:[ -][0-9]+)*"
    enough = lambda make: lambda v: make(v) if v[0].isdigit() else None
    for cut in (
        simple(P.PATTERNS["email"][1], lambda m: chars(m.split("@")[0], KEY + "email") + "@" + m.split("@")[1]),
        runs(P.PATTERNS["iban"][1], "[A-Z0-9]+ ?", lambda v: iban(v) if re.match("[A-Z]{2}[0-9]{2}", v) else None, 9),
        simple(P.PATTERNS["date"][1], date),
        simple(P.PATTERNS["ip"][1], ip),
        simple(P.PATTERNS["ssn"][1], ssn),
        simple(P.PATTERNS["phone"][1], phone),
        runs(digits, "[0-9]+[ -]?", enough(usual), 5),
        runs(digits, "[0-9]+[ -]?", enough(card), 19),
    ):
        parts = [p for t, done in parts for p in ([(t, True)] if done else cut(t))]
    return "".join(t for t, _ in parts), sum(done for _, done in parts)


def made_card(r):
    n = "".join(r.choice("0123456789") for _ in range(r.choice([12, 14, 15, 18])))
    n += next(c for c in "0123456789" if luhn(n + c) == 0)
    step = r.choice([99, 4, 4, 5, 3])
    return r.choice("- ").join(n[i : i + step] for i in range(0, len(n), step))


def made_iban(r):
    body = "".join(r.choice("0123456789ABCXYZ") for _ in range(r.choice([11, 12, 18, 20, 23])))
    v = "DE" + f"{98 - int(''.join(str(int(c, 36)) for c in body + 'DE00')) % 97:02d}" + body
    return v if r.random() < 0.5 else " ".join(v[i : i + 4] for i in range(0, len(v), 4))


MAKE = [
    made_card, made_card, made_iban,
    lambda r: f"{r.randrange(0, 10000):04d}-{r.randrange(0, 14):02d}-{r.randrange(0, 33):02d}",
    lambda r: (lambda s: f"{r.randrange(0, 33):02d}{s}{r.randrange(0, 33):02d}{s}{r.randrange(0, 10000):04d}")(r.choice("./")),
    lambda r: ".".join(str(r.randrange(0, 280)) for _ in range(4)),
    lambda r: f"{r.randrange(0, 1000):03d}-{r.randrange(0, 100):02d}-{r.randrange(0, 10000):04d}",
    lambda r: r.choice(["", "+1 ", "1-"]) + r.choice(["({}) ", "{}-", "{}."]).format(r.randrange(100, 1000)) + f"{r.randrange(100, 1000)}-{r.randrange(0, 10000):04d}",
    lambda r: r.choice(["a", "Ann.Lee7", "x_y+z"]) + "@" + r.choice(["mail.example.com", "b.co"]),
    lambda r: str(r.randrange(0, 10 ** r.randrange(1, 6))), lambda r: "of the", lambda r: "REF", lambda r: "AB12", lambda r: "2024", lambda r: "naïve 漢",
]


def test_generated_texts_equal_the_twin(spark):
    r = random.Random(4)
    texts = ["".join(r.choice(MAKE)(r) + r.choice([" ", " ", " ", ", ", "-", "\n", "/"]) for _ in range(r.randrange(1, 9))) for _ in range(600)]
    texts += ["order 12 4565410125667261", "4565410125667261 20", "4565410125667261 12/25", "BE68 5390 0754 7034 2024", "1 " * 3000 + "4565 4101 2566 7261", "x" * 30_000 + " a@b.co", "AB12 " * 2000 + "GB82 WEST 1234 5698 7654 32 and"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: (x["text"], x["n_replaced"]) for x in P.pseudonymise(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == twin(t), t[:200]
    assert sum(n for _, n in got.values()) > 800
    for card_text in texts[600:603]:
        assert "4565410125667261" not in got[texts.index(card_text)][0]


def test_dates_are_permuted(spark):
    """Every way of writing keeps to itself, and no two dates of it meet."""
    days = spark.range(-146_097, 2 * 146_097).select(F.date_add(F.lit(P.FIRST_DAY).cast("date"), F.col("id").cast("int")).alias("d"))
    edge = spark.range(0, 73_000).select(F.explode(F.array(F.date_add(F.lit("9999-12-31").cast("date"), (-F.col("id")).cast("int")), F.date_add(F.lit("0001-01-01").cast("date"), F.least(F.col("id"), F.lit(72_682)).cast("int")))).alias("d"))
    for rows, pattern, month_first in ((days.filter("dayofmonth(d) > 12"), "MM/dd/yyyy", True), (days, "dd.MM.yyyy", False), (edge.distinct(), "yyyy-MM-dd", False)):
        text = rows.select(F.date_format("d", pattern).alias("t")).filter(F.length("t") == 10)
        if not month_first:
            text = text.sample(0.2, 3)
        found = text.select("t", P._date(F.col("t"), KEY).alias("n"))
        n = found.agg(F.count("*").alias("all"), F.countDistinct("n").alias("kinds"), F.countDistinct("t").alias("old"), F.min(F.length("n")).alias("short"), F.sum((F.substring("n", 4, 2).try_cast("int") > 12).cast("int")).alias("unlike")).first()
        assert n["kinds"] == n["old"] == n["all"] and n["short"] == 10
        assert not month_first or n["unlike"] == n["all"]


def test_clashing_names_pass_through(spark):
    row = spark.createDataFrame([(None, "4565410125667261", 7, "a", "b")], "doc_id long, text string, N_replaced int, row string, pieces string")
    out = P.pseudonymise(row)
    assert out.columns == ["doc_id", "text", "N_replaced", "row", "pieces", "n_replaced_"]
    assert tuple(out.first())[2:] == (7, "a", "b", 1)
