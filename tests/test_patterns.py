import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lendgov.functions import patterns as PT
from lendgov.functions import text as TX

WORDS = st.text(alphabet="abé", max_size=4)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.lists(WORDS, min_size=1, max_size=3), min_size=1, max_size=3), max_size=8), st.text(alphabet="abéc ", max_size=30))
def test_rules_hold_as_plain_search_says(rules, text):
    table = PT.RuleTable([PT.Rule(str(i), tuple(map(tuple, groups))) for i, groups in enumerate(rules)])
    assert table.holding(text) == [i for i, groups in enumerate(rules) if all(any(w in text for w in g) for g in groups)]


def test_ten_thousand_rules(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(3, 7))) for _ in range(10_000)]
    texts = ["".join(rng.choices("abcdefgh ", k=200)) for _ in range(60)] + [None, ""]
    table = PT.RuleTable([PT.Rule.any_of(f"r{i}", [w]) for i, w in enumerate(words)])
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", PT.matched(F.col("t"), table).alias("m")).orderBy("i").collect()
    for r in got:
        hold = [i for i, w in enumerate(words) if texts[r.i] is not None and w in texts[r.i]]
        assert (r.m.n, r.m.first) == (len(hold), f"r{hold[0]}" if hold else None)
    with pytest.raises(ValueError):
        PT.RuleTable([PT.Rule.any_of("x", ["y"])] * (PT.MAX_RULES + 1))


def test_routes_are_those_of_the_expressions(spark):
    texts = ["What average balance?", "EMI to income", "my card score", "digital usage", "joke", "Emi RATIO", None, "salary and bank balance"]
    gate, intents = TX.question_rules()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(TX.is_banking(F.col("t")).alias("a"), (PT.matched(F.lower("t"), gate)["n"] > 0).alias("b"),
                     F.when(F.col("t").isNotNull(), TX.intent(F.col("t"))).alias("c"), F.when(F.col("t").isNotNull(), F.coalesce(PT.matched(F.lower("t"), intents)["first"], F.lit("retrieval"))).alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in rows)


@pytest.mark.parametrize("text,amount", [("८,००,००० के लिए", 800000.0), ("قرض ٩٠٠٠٠", 90000.0), ("௫௦௦௦௦", 50000.0), ("１２３ then ６００００", 60000.0), ("𝟖𝟎𝟎𝟎𝟎", 80000.0), ("४९९९९", None), ("½ ², 70000", 70000.0)])
def test_amounts_in_any_script(spark, text, amount):
    assert spark.createDataFrame([(text,)], "t string").select(TX.loan_amount(F.col("t"))).first()[0] == amount
