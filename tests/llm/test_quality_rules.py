from __future__ import annotations

import re
from collections import Counter

from salesledger.llm import quality_rules, queries
from llm.conftest import SMALL, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(covered),
    )


def check(docs):
    out = quality_rules.quality(docs)
    for r in out.collect():
        measured = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert measured == brute(r.text), r.doc_id
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.failed_rules) and not (r.kept and r.base_failed)


def test_matches_sql(spark, duck):
    same(queries.op7_quality_rules(spark, SMALL), duck.sql(queries.oracle_sql()["op7_quality_rules"]))


def test_matches_brute_force(spark, documents, odd_documents):
    check(documents)
    check(odd_documents)
    texts = ["a b c d e a b c d e", "a b c d e f a b c d e f a b c d e", "a a a a a a a", "x\vy\x1fz\n\nx\vy\x1fz", "<b>*</b>|\n…"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_odd_rows(spark, odd_documents):
    out = quality_rules.quality(odd_documents)
    assert out.count() == odd_documents.count()
    assert set(odd_documents.columns) < set(out.columns)
    assert quality_rules.quality(odd_documents.limit(0)).count() == 0
    assert quality_rules.quality(odd_documents, rules=(), base=()).where("NOT kept OR base_failed").count() == 0


def test_rules_are_one_projection_of_built_in_functions(documents):
    plan = quality_rules.quality(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Exchange|Generate", plan)
