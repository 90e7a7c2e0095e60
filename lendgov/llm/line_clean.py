"""Operator 2: line-first cleaning.

Each line with a word is judged by its own rules: ``punctuation`` (it ends a sentence and
is not sown with symbols), ``navigation`` (no menu or table of short items) and ``boilerplate``
(no licence, copyright, cookie or sign-in phrase). Lines that fail are removed; a document that
loses more than ``MAX_LOST`` of its characters in lines is rejected.

Base statistics come from the words ``[^\\x20\\x09-\\x0D]+`` of the whole text: n_words, word_chars,
n_symbols, n_dup_lines and n_repeat_words; ``base_failed`` says that there are fewer than
``MIN_WORDS`` words or that over ``MAX_REPEAT_PCT`` percent of them lie in repeated windows.

Edge cases: null and blank texts have no words, fail the base rules and clean to an empty
text (null stays null); rows are independent, so repeated rows and null ids keep their rows;
texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import astuple, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 10
MAX_REPEAT_PCT = 20
WINDOW = 5
#: Share of the characters in lines with words that a kept document may lose.
MAX_LOST = 0.5
#: A line with more separators than this for each word is navigation.
MAX_SEPARATORS = 0.3
#: A line with more symbols than this for each word fails the punctuation rule.
MAX_SYMBOLS = 0.5

_BLANK = b" \t\n\x0b\x0c\r"
#: Characters that may end a line of prose.
_ENDS = tuple(".!?:;…\"'”’»)]。！？")
_SEPARATORS = re.compile(r"[|·•→]|(?<=\s)[»›>](?=\s)")
_SYMBOLS = re.compile(r"[#*$%&|<>^~{}=\\]")
#: Phrases of boilerplate lines.
_BOILERPLATE = re.compile("|".join((
    r"all rights reserved", r"licensed under", r"general public license", r"copyright", r"©", r"terms of (?:use|service)",
    r"privacy policy", r"cookie (?:policy|settings|notice)", r"we use cookies", r"enable javascript", r"lorem ipsum",
    r"\b(?:sign|log) in\b", r"subscribe (?:to|now)", r"click here", r"share (?:this|on)", r"skip to (?:content|main)",
)), re.IGNORECASE)
#: What every phrase above holds one of, in lower case.
_ANCHORS = ("rights", "licensed", "license", "copyright", "©", "terms of", "privacy", "cookie", "javascript", "lorem", "sign in", "log in",
            "subscribe", "click", "share", "skip to")


@dataclass
class Cleaned:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    lost_punctuation: int
    lost_navigation: int
    lost_boilerplate: int
    lost_share: float
    clean_text: str | None


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more, the first occurrence included."""
    grams = list(zip(*(words[i:] for i in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    often = Counter(grams)
    covered, upto = 0, 0
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered += i + window - max(i, upto)
            upto = i + window
    return covered


@dataclass(frozen=True)
class Held:
    """What a whole text holds at all; rules for what it does not hold need not look at its lines."""

    boilerplate: bool = True
    separators: bool = True
    symbols: bool = True

    @staticmethod
    def by(text: str) -> "Held":
        low = text.lower()
        return Held(any(a in low for a in _ANCHORS), any(c in text for c in "|·•→»›>"), any(c in text for c in "#*$%&|<>^~{}=\\"))


def line_fault(line: str, held: Held = Held()) -> str | None:
    """The rule that a line with a word fails, if any."""
    if held.boilerplate and _BOILERPLATE.search(line):
        return "boilerplate"
    n = len(line.split()) if held.separators or held.symbols else 0
    if held.separators and len(_SEPARATORS.findall(line)) > MAX_SEPARATORS * n:
        return "navigation"
    if not line.rstrip().endswith(_ENDS) or held.symbols and len(_SYMBOLS.findall(line)) > MAX_SYMBOLS * n:
        return "punctuation"
    return None


def clean(text: str | None, max_lost: float = MAX_LOST, min_words: int = MIN_WORDS) -> Cleaned:
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    letters = len(text or "") - (len(raw) - len(raw.translate(None, _BLANK)))
    lines = [x for x in raw.split(b"\n") if x.strip(_BLANK)]
    repeated = repeat_words(words)
    failed = len(words) < min_words or 100 * repeated > MAX_REPEAT_PCT * len(words)

    lost, held = Counter(), Held.by(text or "")
    left, total, gone = [], 0, 0
    for line in (text or "").split("\n"):
        if line.strip():
            total += len(line)
            if fault := line_fault(line, held):
                lost[fault] += 1
                gone += len(line)
                continue
        left.append(line)
    share = gone / total if total else 0.0
    return Cleaned(len(words), letters, len(raw) - len(raw.translate(None, b"#*$%&|<>")), len(lines) - len(set(lines)), repeated, failed,
                   not failed and share <= max_lost, lost["punctuation"], lost["navigation"], lost["boilerplate"], share,
                   None if text is None else "\n".join(left))


_FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
           ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("lost_punctuation", pa.int64()),
           ("lost_navigation", pa.int64()), ("lost_boilerplate", pa.int64()), ("lost_share", pa.float64()), ("clean_text", pa.string())]
_TYPES = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.float64(): "double", pa.string(): "string"}


def cleaned_column(text: Column, with_text: bool = True, max_lost: float = MAX_LOST) -> Column:
    """struct of the statistics and, if asked for, the text without its failed lines."""
    fields = _FIELDS if with_text else _FIELDS[:-1]

    @F.arrow_udf("struct<" + ", ".join(f"{n}: {_TYPES[t]}" for n, t in fields) + ">")
    def run(t: pa.Array) -> pa.Array:
        cols = list(zip(*(astuple(clean(x, max_lost)) for x in t.to_pylist()))) or [()] * len(_FIELDS)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, fields)], [n for n, _ in fields])

    return run.asNondeterministic()(text)


def assess(docs: DataFrame, with_text: bool = False, max_lost: float = MAX_LOST) -> DataFrame:
    """doc_id and the statistics and verdicts of every document (and its cleaned text)."""
    return docs.select("doc_id", cleaned_column(F.col("text"), with_text, max_lost).alias("r")).select("doc_id", "r.*")
