import re
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from trackloom.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text or ""), len(lines) - len(set(lines)), len(covered)


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in rules.query(docs).collect()}
    for i, t in enumerate(texts):
        r, b = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0])
        assert not (r.base_failed and r.kept)


def test_cases(spark):
    words = "the cat of a dog and an old tree in this park".split()
    check(spark, [None, "", " \n\t ", "a b c d e", "a b c d e " * 2, "a " * 40, " ".join(words), " ".join(words) + "\n" + " ".join(words), "x\n\nx\n x\nx", "é|ü <b> \x0b\x0c\x85\xa0z", " ".join(words * 400), "a b c d e f a b c d e"])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n#", max_size=80), min_size=1, max_size=30))
def test_any_texts(spark, texts):
    check(spark, texts)


def test_empty_and_plan(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert rules.query(docs).collect() == []
    plan = rules.query(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rules_say_why(spark):
    good = "The cat of the house and a dog in this park for all of us here."
    docs = spark.createDataFrame([(1, good), (2, "### |||" * 20), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in rules.apply(docs).collect()}
    assert got[1].kept and got[1].failed == []
    assert not got[2].kept and "symbols" in got[2].failed
    assert not got[3].kept and "length" in got[3].failed
