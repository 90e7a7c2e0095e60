"""Operator 10: personal data. Regular expressions propose spans, checksums confirm them, context adjusts a score.

Base kinds are reported wherever their pattern and check hold:

* ``email`` and ``phone`` (+ and 9 to 15 digits), ``ip`` (four parts up to 255), ``card`` (13 to 19 digits, Luhn).

Kinds the method adds, reported where base score plus context reaches ``MIN_SCORE``:

* ``iban``: country code, check digits and 11 to 30 more characters, confirmed by ISO 7064 mod-97;
* ``ssn``: ddd-dd-dddd with a number that can be issued; needs a context word;
* ``local_phone``: a number without +, as (ddd) ddd-dddd or ddd-ddd-dddd; needs a context word.

A context word of the kind within ``WINDOW`` characters raises a span's score by ``RAISE``, a
contrary word (order, version, ...) lowers it by as much. Every span carries its score.
Matches are leftmost and not overlapping within a kind; a match that fails its check is
dropped without a second try. An IBAN is tried at each word end from 15 to 34 characters on: the length
of its country counts first, then the longest that passes; the search goes on behind it, or behind
its first word if none passes. An added span that overlaps a base span is left out.

Edge cases: a null text counts as empty, no spans; rows are independent, ids are not looked at;
texts are read whole, in time linear in their length, whatever runs of digits or @ they hold.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_SCORE = 0.6
WINDOW = 40
RAISE = 0.3
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "local_phone")

#: Score of a confirmed match before its context is looked at.
CONFIDENCE = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.9, "ssn": 0.4, "local_phone": 0.4}
#: Words near a span that speak for its kind.
CONTEXT = {
    "email": ("mail", "contact", "correo", "courriel", "kontakt"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "taxpayer"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "teléfono"),
}
#: Words that speak against personal data.
CONTRARY = ("order", "version", "isbn", "invoice", "serial", "example", "article no")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_WORD_END = re.compile(r"(?<=[A-Z0-9])(?![A-Za-z0-9])")
#: Characters of an IBAN by country (the registry's).
_IBAN_CHARS = {c: n for n, codes in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}.items() for c in codes.split()}
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+)-])(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}-)[0-9]{3}-[0-9]{4}(?![0-9-])")
_NOT_DIGITS = {ord(c): None for c in " ().-+"}

Span = tuple[str, int, int, float]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 check of an IBAN without blanks."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str):
    """Every address has one @: its local part is the run before it, back to the end of the last match."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _ibans(text: str):
    """Every IBAN ends with a word; what follows it is looked at on its own."""
    at = 0
    while m := _IBAN.search(text, at):
        start, at = m.start(), m.start() + 4
        flat = {e.start(): text[start:e.start()].replace(" ", "") for e in _WORD_END.finditer(text, start, m.end() + 1) if e.start() <= m.end()}
        own = _IBAN_CHARS.get(text[start:start + 2])
        for end in sorted(flat, key=lambda e: (len(flat[e]) == own, e), reverse=True):
            if len(flat[end]) >= 15 and mod97(flat[end]):
                yield start, end
                at = end
                break


def _issued(area: str, group: str, serial: str) -> bool:
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _proposed(text: str) -> list[tuple[str, int, int]]:
    """Matches that pass their checks, by kind."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (g.lstrip("0") for g in m.groups())):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].translate(_NOT_DIGITS)
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(m[0].translate(_NOT_DIGITS)) <= 15:
                out.append(("phone", *m.span()))
    out += [("iban", a, b) for a, b in _ibans(text)]
    if "-" in text:
        out += [("ssn", *m.span()) for m in _SSN.finditer(text) if _issued(*m.groups())]
        out += [("local_phone", *m.span()) for m in _LOCAL_PHONE.finditer(text)]
    return out


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - WINDOW):start].lower() + "\n" + text[end:end + WINDOW].lower()
    words = re.findall(r"\w+", near)
    has = lambda w: (w in near) if " " in w else any(x.startswith(w) for x in words)
    score = CONFIDENCE[kind] + RAISE * any(map(has, CONTEXT[kind])) - RAISE * any(map(has, CONTRARY))
    return min(1.0, max(0.0, score))


def find_spans(text: str | None, min_score: float = MIN_SCORE) -> list[Span]:
    """(kind, start, end, score) by kind as listed, then start; offsets in code points, end exclusive."""
    found = _proposed(text) if text else []
    base = sorted((a, b) for kind, a, b in found if kind in BASE_KINDS)
    out: list[Span] = []
    for kind, a, b in found:
        score = _score(text, kind, a, b)
        if kind in BASE_KINDS or score >= min_score and not any(a < y and x < b for x, y in base):
            out.append((kind, a, b, score))
    order = {k: i for i, k in enumerate(BASE_KINDS + ADDED_KINDS)}
    return sorted(out, key=lambda s: (order[s[0]], s[1]))


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    if not spans or text is None:
        return text
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


_SPANS = "array<struct<kind: string, start: bigint, end: bigint, score: double>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def spans_column(text: Column, min_score: float = MIN_SCORE) -> Column:
    """All personal data of a text column, as an array of (kind, start, end, score)."""

    @F.arrow_udf(_SPANS)
    def spans(t: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("kind", "start", "end", "score"), s)) for s in find_spans(x, min_score)] for x in t.to_pylist()],
                        _SPANS_ARROW)

    return spans.asNondeterministic()(text)


def find(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id and pii_spans of every document."""
    return docs.select("doc_id", spans_column(F.col("text"), min_score).alias("pii_spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the base spans and all spans as text."""
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("pii_spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("pii_spans")).alias("spans"))


def redacted(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; ``n_chars``, where there is one, follows. No row is dropped."""

    @F.arrow_udf("string")
    def clean(t: pa.Array) -> pa.Array:
        return pa.array([redact(x, find_spans(x, min_score)) for x in t.to_pylist()], pa.string())

    out = docs.withColumn("text", clean.asNondeterministic()(F.col("text")))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def sha256_of(spans: list[Span]) -> str:
    """What ``digest`` gives for a list of spans, for tests and other callers outside Spark."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans if k in BASE_KINDS).encode()).hexdigest()
