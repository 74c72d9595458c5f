from __future__ import annotations

import zlib
from collections import Counter

from salesledger.llm import language_id, queries
from llm.conftest import SMALL


def listed(text):
    """N-grams of a text by falling count, by plain loops."""
    folded = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else (c if c.isalpha() else " ") for c in text or "")
    counts = Counter()
    for word in folded.split():
        padded = f" {word} "
        counts.update(word)
        counts.update(padded[i : i + 2] for i in range(len(padded) - 1))
        counts.update(padded[i : i + 3] for i in range(len(padded) - 2))

    def code(gram):
        value = 0
        for c in gram:
            value = value << 21 | ord(c)
        return value

    return [code(g) for g in sorted(counts, key=lambda g: (-counts[g], code(g)))], {code(g): n for g, n in counts.items()}


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    held = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 5 == 0 for d in docs}
    sums: dict[str, Counter] = {}
    for d in docs:
        if not held[d.doc_id] and d.lang is not None and d.text is not None:
            sums.setdefault(d.lang, Counter()).update(listed(d.text)[1])
    profiles = {lang: sorted(c, key=lambda g: (-c[g], g))[:300] for lang, c in sums.items()}
    ranks = {lang: {g: i for i, g in enumerate(p)} for lang, p in profiles.items()}
    got = {r.doc_id: r for r in queries.op3_language_id(spark, SMALL).collect()}
    right = total = 0
    for d in docs:
        own = listed(d.text)[0][:300]
        r = got[d.doc_id]
        assert r.held_out == held[d.doc_id]
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        far = {n: sum(abs(ranks[n][g] - i) if g in ranks[n] else 300 for i, g in enumerate(own)) for n in ranks}
        best = min(sorted(far), key=far.get)
        assert r.lang_pred == best and abs(r.score - (1 - far[best] / (300 * len(own)))) < 1e-12
        if held[d.doc_id] and d.lang:
            right, total = right + (best == d.lang), total + 1
    assert right >= 0.95 * total


def test_odd_rows(odd_documents, documents):
    profiles = language_id.fit(documents)
    out = language_id.predict(odd_documents, profiles)
    assert out.count() == odd_documents.count() and out.columns[-2:] == ["lang_pred", "score"]
    unknown = {r.doc_id for r in out.where("lang_pred = 'und'").collect()}
    assert unknown == {3, 4, 5, 9, None}
    assert out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert language_id.fit(odd_documents.limit(0)) == {}
    assert language_id.predict(odd_documents, {}).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(odd_documents.limit(0), profiles).count() == 0
    assert len(language_id.fit(documents, train_rows=3)) <= 3


def test_long_texts_are_counted_in_chunks():
    text = "abc dé " * (language_id.CHUNK // 3)
    keys, counts = language_id.grams(text)
    assert counts.sum() > 2 * language_id.CHUNK and len(keys) < 40
