"""Text functions for questions: topic gate, amount extraction, intent routing."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import Rule, RuleTable

# Banking keywords; plain substring match on lower-cased text
# (so "rd" also hits "card", "emi" hits "premium").
BANK_KEYWORDS = ["loan", "credit", "emi", "interest", "bank", "savings", "fixed deposit", "fd", "rd",
                 "account", "cibil", "statement", "repayment", "overdue", "default", "moratorium"]
MIN_AMOUNT = 50000.0


def any_contains(text: Column, words) -> Column:
    cond = None
    for w in words:
        c = text.contains(w)
        cond = c if cond is None else (cond | c)
    return cond


def is_banking(text: Column) -> Column:
    """Topic gate."""
    return F.coalesce(any_contains(F.lower(text), BANK_KEYWORDS), F.lit(False))


def script_digits() -> tuple[str, str]:
    """The decimal digits of all scripts but ASCII, and the ASCII digits of the same values."""
    other = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(other), "".join(str(unicodedata.decimal(c)) for c in other)


def ascii_digits(text: Column) -> Column:
    """``text`` with the decimal digits of every script written in ASCII."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, *script_digits())).otherwise(text)


def loan_amount(text: Column) -> Column:
    """First number >= 50,000 after removing commas, else null; digits of any script."""
    nums = F.regexp_extract_all(F.replace(ascii_digits(text), F.lit(","), F.lit("")), F.lit("([0-9]+)"), 1)
    vals = F.filter(F.transform(nums, lambda x: x.cast("double")), lambda x: x >= MIN_AMOUNT)
    return F.try_element_at(vals, F.lit(1))


# Intents in routing order, each with the words that route to it (all word groups must hit).
INTENT_WORDS = [
    ("bank_balance", [["bank balance", "average balance"]]),
    ("income", [["income", "salary"]]),
    ("emi_ratio", [["emi"], ["ratio", "income"]]),
    ("credit", [["credit history", "cibil", "score"]]),
    ("behaviour", [["mobile", "digital", "behaviour", "behavior"]]),
    ("utilisation", [["utilisation", "utilization", "usage"]]),
]


def intent(text: Column) -> Column:
    """First matching handler; 'retrieval' when none matches."""
    q = F.lower(text)
    routed = None
    for name, groups in INTENT_WORDS:
        hit = F.lit(True)
        for words in groups:
            hit = hit & any_contains(q, words)
        routed = F.when(hit, F.lit(name)) if routed is None else routed.when(hit, F.lit(name))
    return routed.otherwise(F.lit("retrieval"))


def question_rules() -> tuple[RuleTable, RuleTable]:
    """X1 and X3 as rule tables: the topic gate, and the intents in routing order."""
    return (RuleTable([Rule.any_of("banking", BANK_KEYWORDS)]),
            RuleTable([Rule(name, tuple(tuple(words) for words in groups)) for name, groups in INTENT_WORDS]))


def rupees(x: Column) -> Column:
    """Currency text with thousands separators and no decimals."""
    return F.concat(F.lit("₹"), F.format_number(x, 0))


def fixed(x: Column, digits: int = 2) -> Column:
    """Fixed-point text with correct rounding of the exact binary value (half-even on ties).

    This is the rounding of the original's ``f"{x:.2f}"`` and of C/DuckDB ``printf``.
    ``format_number`` with a pattern rounds the exact value so; ``format_string`` rounds the
    shortest decimal form half-up instead, which differs on ties such as 100.625.
    """
    v = x.cast("double")
    text = F.call_function("format_number", v, F.lit("0." + "0" * digits if digits else "0"))
    return (F.when(F.isnan(v), F.lit("nan")).when(v == float("inf"), F.lit("inf"))
            .when(v == float("-inf"), F.lit("-inf")).otherwise(text))
