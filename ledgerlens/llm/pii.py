"""PII spans, natively: patterns propose, checksums confirm, context words adjust a score.

Each kind's pattern runs once over the whole text: matches are wrapped in a
marker character, the text is split there, and running sums of the pieces'
lengths, by doubling, give code-point offsets. The patterns use possessive
quantifiers and lookbehinds so that every run of characters is read once,
however long it is, without changing what the plain leftmost patterns match.
Words in the WINDOW characters on either side of a span raise its score, or
lower it if they speak for another kind of number; base kinds are kept at any
score, added kinds from ADDED_MIN_SCORE on.

Null text counts as empty. Repeated rows give repeated results, null ids are
ids like others, other columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import whole

MARK = "\x01"
#: Fixed: order of kinds at equal starts; the first four are the base kinds.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "ssn"]
#: Equal to the plain patterns named in the README. \G lets a match begin where the last one ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Fixed: a text without this cannot match, which spares the pattern.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Words near a span that make its kind likelier.
CONTEXT = {
    "email": "mail|contact|write|reply",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|payment|pay",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|transfer",
    "ssn": "ssn|social|security",
}
#: Words near a span that speak for another kind of number.
AGAINST = "order|invoice|version|release|isbn|part|serial|item|section|page"
#: Confidence of a span by its pattern and checksum alone; nearby words add or take CONTEXT_ADDS.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
CONTEXT_ADDS, WINDOW, ADDED_MIN_SCORE = 0.2, 40, 0.5


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn checksum."""
    turned = F.split(F.reverse(digits), "")

    def add(acc, c):
        d = c.cast("int")
        return F.struct((acc["i"] + 1).alias("i"), (acc["t"] + F.when(acc["i"] % 2 == 0, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).alias("t"))

    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("t"))
    return F.aggregate(F.filter(turned, lambda c: c != ""), zero, add, lambda a: a["t"]) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if an IBAN (spaces removed) passes its mod-97 check."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(rest, c):
        v = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(v < 10, (rest * 10 + v) % 97).otherwise((rest * 100 + v) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _confirmed(kind: str, match: Column) -> Column:
    """The check of each kind; a failing match is dropped without a retry."""
    if kind == "ip":
        part = lambda p: F.coalesce(F.concat(F.lit("0"), F.regexp_replace(p, "^0+", "")).try_cast("int"), F.lit(256)) <= 255
        return F.forall(F.split(match, r"\."), part)
    if kind == "card":
        return F.when(F.length(_digits(match)).between(12, 19), luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(match, " ", ""))
    if kind == "ssn":
        return ~match.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _running(numbers: Column) -> Column:
    """The running sums of an array: shifted copies are added, at twice the distance each time."""
    n = F.size(numbers)
    shifts = F.transform(F.sequence(F.lit(0), F.length(F.bin((n - 1).cast("long"))) - 1), lambda k: F.call_function("shiftleft", F.lit(1), k))
    return F.aggregate(shifts, numbers, lambda acc, k: F.zip_with(acc, F.slice(F.concat(F.array_repeat(F.lit(0), k), acc), F.lit(1), F.size(acc)), lambda x, y: x + y))


def _spans_of(kind: str, text: Column) -> Column:
    """Confirmed spans of one kind in a text, as structs (start, rank, kind, end, match, score)."""

    def cut(parts, ends):
        """Every second piece is a match."""
        piece = lambda i: F.get(parts, i)
        span = lambda i: F.struct(F.get(ends, i - 1).alias("start"), F.get(ends, i).alias("end"), piece(i).alias("match"), F.concat_ws(" ", F.right(piece(i - 1), F.lit(WINDOW)), F.left(piece(i + 1), F.lit(WINDOW))).alias("near"))
        places = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i % 2 == 1)
        return F.transform(places, span)

    parts = F.split(F.regexp_replace(text, PATTERNS[kind], f"{MARK}$0{MARK}"), MARK, -1)
    proposed = _let(parts, lambda p: _let(_running(F.transform(p, lambda x: F.length(x))), lambda e: cut(p, e)))

    def scored(s):
        says = lambda words: F.lower(s["near"]).rlike(rf"\b(?:{words})")
        score = F.lit(PRIOR[kind]) + F.when(says(CONTEXT[kind]), CONTEXT_ADDS).otherwise(0.0) - F.when(says(AGAINST), CONTEXT_ADDS).otherwise(0.0)
        return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["match"].alias("match"), F.round(F.least(F.lit(1.0), score), 6).alias("score"))

    spans = F.transform(F.filter(proposed, lambda s: _confirmed(kind, s["match"])), scored)
    if kind not in BASE:
        spans = F.filter(spans, lambda s: s["score"] >= ADDED_MIN_SCORE)
    none = F.from_json(F.lit("[]"), "array<struct<start:int,rank:int,kind:string,end:int,match:string,score:double>>")
    return F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(none) if kind in NEEDS else spans


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and spans, an array of (start, rank, kind, end, match, score) by start and kind.

    Offsets are code points, the end exclusive. All work is on the row itself, so nothing is shuffled.
    """
    raw = whole(F.col(text_col))
    text = F.when(F.contains(raw, F.lit(MARK)), F.translate(raw, MARK, "\x02")).otherwise(raw)  # one neutral character for another, so offsets stay
    docs = docs.select(F.col(id_col), text.alias("__text"))
    return docs.select(id_col, F.array_sort(F.concat(*[_spans_of(k, F.col("__text")) for k in KINDS])).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """A text with each span replaced by [kind]; where spans overlap, the first stays."""

    def put(acc, s):
        free = s["start"] >= acc["at"]
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.when(free, s["end"]).otherwise(acc["at"]).alias("at"), F.when(free, new).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, zero, put, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts, hash and list of a pii_spans() result."""
    text = lambda arr: F.array_join(F.transform(arr, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of_kind(k) for k in KINDS]
    return spans.select(id_col, *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
