import random
import re
from collections import Counter

from lendgov.llm import line_clean
from lendgov.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def slow_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered),
            len(words) < 10 or 100 * len(covered) > 20 * len(words))


def base(c):
    return (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, c.base_failed)


def test_base_equals_definition_on_noise():
    rng = random.Random(7)
    for _ in range(600):
        text = "".join(rng.choices(["a", "b", " ", " ", "\n", "\t", "\x0b", "\x85", " ", "é", "#", "|", "a b c d e f ", "\n\n"], k=rng.randint(0, 60)))
        assert base(line_clean.clean(text)) == slow_base(text), repr(text)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id").text
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    got = QUERIES["op2_line_cleaning"](spark, SF).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for i, r in got.iterrows():
        assert base(r) == slow_base(docs[i])
    assert not (got.kept & got.base_failed).any()
    verdict = got.kept.reindex(labels.index)
    assert verdict[labels == 0].mean() < 0.1 and verdict[labels == 1].mean() > 0.9


def test_line_rules():
    good = "A line of prose ends like this."
    assert line_clean.line_fault(good) is None and line_clean.line_fault("«Una frase más»") is None
    assert line_clean.line_fault("Home | News | About | Contact.") == "navigation"
    assert line_clean.line_fault("All rights reserved.") == line_clean.line_fault("Licensed under the X License.") == "boilerplate"
    assert line_clean.line_fault("no end of a sentence") == line_clean.line_fault("so### many*** symbols$$$.") == "punctuation"
    text = "\n".join([good, "Home | About", "", "Another sentence follows it here."])
    c = line_clean.clean(text)
    assert c.clean_text == "\n".join([good, "", "Another sentence follows it here."]) and c.kept and c.lost_navigation == 1
    lost = line_clean.clean(good + "\n" + "and then a long line goes on without any end of a sentence in it")
    assert not lost.base_failed and not lost.kept and lost.lost_share > 0.5


def test_edges(edge, empty, nulls):
    got = line_clean.assess(edge, with_text=True).toPandas().set_index("doc_id")
    assert len(got) == edge.count()
    assert got.base_failed[1] and got.clean_text[1] is None and got.clean_text[2] == "" and got.n_words[3] == 0
    assert got.n_words[4] == 60_000 and got.word_chars[8] == 200_000 and got.loc[[7]].n_words.nunique() == 1
    assert line_clean.assess(empty).count() == 0
    assert line_clean.assess(nulls).toPandas().kept.eq(False).all()
