"""Canonical text and SHA-256 hashing.

Canonical text: ``key=value`` pairs in a fixed key order joined by ``|``;
values are text with backslash and ``|`` escaped, ``null`` for a missing
value, probabilities as DECIMAL(18,6) text. Both Spark and the DuckDB
oracle produce it byte for byte. Sorted-key JSON is the other payload format.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def esc(value: Column) -> Column:
    s = value.cast("string")
    s = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.coalesce(s, F.lit("null"))


def canonical(pairs: Sequence[tuple[str, Column]]) -> Column:
    return F.concat_ws("|", *[F.concat(F.lit(k + "="), esc(v)) for k, v in pairs])


def prob_text(p: Column) -> Column:
    return p.cast("decimal(18,6)").cast("string")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def short_hash(text: Column) -> Column:
    """A hash's text as its 32 bytes, for shuffles; any other text as its UTF-8 bytes and 33 zeros, so that no two texts become equal."""
    return F.when(text.rlike(r"\A[0-9a-f]{64}\z"), F.unhex(text)).otherwise(F.concat(text.cast("binary"), F.lit(bytearray(33))))


def long_hash(short: Column) -> Column:
    """The text that ``short_hash`` shortened."""
    return F.when(F.length(short) == 32, F.lower(F.hex(short))).otherwise(
        F.substring(short, F.lit(1), F.length(short) - F.lit(33)).cast("string"))


# Characters with a short escape in JSON strings.
JSON_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def json_string(value: Column) -> Column:
    """A JSON string in printable ASCII, other characters escaped as \\uXXXX (lower-case hex, UTF-16); null for null."""
    s = value.cast("string")
    quoted = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))

    def escaped(c: Column) -> Column:
        units = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        wide = F.array_join(F.transform(F.sequence(F.lit(1), F.length(units), F.lit(4)),
                                        lambda i: F.concat(F.lit("\\u"), F.substr(units, i, F.lit(4)))), "")
        out = F.when((c >= " ") & (c <= "~"), c).otherwise(wide)
        for k, v in JSON_ESCAPES.items():
            out = F.when(c == F.lit(k), F.lit(v)).otherwise(out)
        return out

    spelled = F.array_join(F.transform(F.split(s, ""), escaped), "")
    text = F.when(s.rlike("[^ -~]"), spelled).otherwise(quoted)
    return F.coalesce(F.concat(F.lit('"'), text, F.lit('"')), F.lit("null"))


def sorted_json(pairs: Sequence[tuple[str, Column]]) -> Column:
    """A JSON object with sorted keys and the separators ``", "`` and ``": "``, open at its end; values are JSON texts.

    With ``link_text(..., "json")`` this is the second payload format: logs hashed over sorted-key JSON verify with it.
    """
    return F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), v) for k, v in sorted(pairs, key=lambda p: p[0])]))


#: Text before and after the previous hash in a link, and what stands for none, by payload format.
LINK_FORMATS = {"text": ("|previous_hash=", "", "null", ""), "json": (', "previous_hash": ', '"', "null", "}")}


def link_text(payload: Column, previous_hash: Column, link: str = "text") -> Column:
    """Text hashed for one chain link: payload plus the previous link's hash."""
    before, quote, none, after = LINK_FORMATS[link]
    return F.concat(payload, F.lit(before), F.coalesce(F.concat(F.lit(quote), previous_hash, F.lit(quote)), F.lit(none)), F.lit(after))


# DuckDB spellings of the same rules, for the oracle SQL.
def esc_sql(expr: str) -> str:
    return f"COALESCE(replace(replace(CAST({expr} AS VARCHAR), '\\', '\\\\'), '|', '\\|'), 'null')"


def canonical_sql(pairs: Sequence[tuple[str, str]]) -> str:
    return " || '|' || ".join(f"'{k}=' || {esc_sql(v)}" for k, v in pairs)


def prob_text_sql(expr: str) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(18,6)) AS VARCHAR)"
