"""Rule tables over texts (J7, X1, X3): all words of all rules are looked for in one pass.

A rule has a name, a priority and one or more groups of words; it holds where the text contains a word of every group (plain
substrings). The words of all rules form one Aho-Corasick automaton, built once per task from the broadcast table, so that a text is read once
however many rules there are. Of the rules that hold, the one with the least priority answers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Rules of a table; it is held by the driver and by every task.
MAX_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    name: str
    groups: tuple[tuple[str, ...], ...]

    @staticmethod
    def any_of(name: str, words: Sequence[str]) -> "Rule":
        return Rule(name, (tuple(words),))


class RuleTable:
    """Rules in order of priority; builds its automaton once per worker."""

    def __init__(self, rules: Sequence[Rule]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        self.rules, self.automaton = list(rules), None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}

    def _built(self):
        if self.automaton is None:
            import ahocorasick

            places: dict[str, list[tuple[int, int]]] = {}
            for i, rule in enumerate(self.rules):
                for g, words in enumerate(rule.groups):
                    for w in words:
                        places.setdefault(w, []).append((i, g))
            self.everywhere = places.pop("", [])  # the empty word is in every text
            self.automaton = ahocorasick.Automaton()
            for w, at in places.items():
                self.automaton.add_word(w, (w, at))
            self.automaton.make_automaton()
        return self.automaton

    def holding(self, text: str) -> list[int]:
        """The rules that hold for the text, by priority."""
        automaton = self._built()
        seen, hit = set(), {}
        for i, g in self.everywhere:
            hit.setdefault(i, set()).add(g)
        if len(automaton):
            for _, (w, at) in automaton.iter(text):
                if w not in seen:
                    seen.add(w)
                    for i, g in at:
                        hit.setdefault(i, set()).add(g)
        return sorted(i for i, groups in hit.items() if len(groups) == len(self.rules[i].groups))


def matched(text: Column, table: RuleTable) -> Column:
    """struct<first: name of the rule that answers (null: none), n: how many rules hold>; null texts have none."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(table)

    @F.arrow_udf("struct<first: string, n: int>")
    def run(texts: pa.Array) -> pa.Array:
        rules = shared.value
        got = [rules.holding(t) if t is not None else [] for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([rules.rules[g[0]].name if g else None for g in got], pa.string()),
                                           pa.array([len(g) for g in got], pa.int32())], ["first", "n"])

    return run.asNondeterministic()(text)
