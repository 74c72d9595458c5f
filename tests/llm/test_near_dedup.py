from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from salesledger.llm import near_dedup
from salesledger.llm.components import components
from salesledger.llm.hashing import CHUNK, windows, word_hashes


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return set(zip(*[words[i:] for i in range(5)])) if len(words) >= 5 else {tuple(words)}


def brute(texts: dict[int, str | None], percent=75):
    sets = {i: shingles(t) for i, t in texts.items()}
    holders, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for ids in holders.values():
        common.update((a, b) for a in ids for b in ids if a < b)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(docs, result):
    expected = brute({r.doc_id: r.text for r in docs.where("doc_id IS NOT NULL").select("doc_id", "text").collect()})
    got = {r.doc_id: r for r in result.where("doc_id IS NOT NULL").collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_matches_brute_force(spark, documents):
    check(documents, near_dedup.near_duplicates(documents))


def test_group_of_near_copies_without_a_common_centre(spark):
    """Many copies of one text with edits: some reach the threshold with each other, some with none."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(1, 9)), replace=False):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, near_dedup.near_duplicates(docs))


def test_odd_rows(spark, odd_documents):
    result = near_dedup.near_duplicates(odd_documents)
    assert result.count() == odd_documents.count()
    check(odd_documents, result)
    assert result.where("doc_id IS NULL AND kept").count() == 2
    kept = near_dedup.drop_near_duplicates(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(r.doc_id or 0 for r in kept.select("doc_id").collect()) == [0, 0, 1, 3, 4, 5, 6, 8, 9, 10]
    assert near_dedup.near_duplicates(odd_documents.limit(0)).count() == 0
    assert near_dedup.drop_near_duplicates(odd_documents.limit(0)).count() == 0


def test_estimate_is_corrected_for_chance(spark):
    a = near_dedup.signature(near_dedup.minima(np.arange(1, 1001, dtype=np.uint64) << np.uint64(40)))
    rng = np.random.default_rng(1)
    one = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    other = np.concatenate([one[:1500], rng.integers(0, 1 << 63, 500, dtype=np.uint64)])
    sigs = [near_dedup.signature(near_dedup.minima(x)).view(np.int64).tolist() for x in (one, other)]
    df = spark.createDataFrame([tuple(sigs)], "a array<long>, b array<long>")
    value = df.select(F.expr(near_dedup.estimate("a", "b"))).first()[0]
    assert abs(value - 1500 / 2500) < 0.15 and len(a) == 8


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (4, 9), (9, 10), (7, 7)] + [(i, i + 1) for i in range(20, 40)]
    got = {r.node: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 5: 4, 9: 4, 10: 4} | {i: 20 for i in range(21, 41)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_are_hashed_alike_wherever_they_stand():
    texts = ["A b\tc", None, "", "  a  B\nC ", "é É", "x " * CHUNK + "a b c"]
    found = list(word_hashes(texts))
    assert [len(x) for x in found] == [3, 0, 0, 3, 2, CHUNK + 3]
    assert (found[0] == found[3]).all() and found[4][0] != found[4][1] and (found[5][-3:] == found[0]).all()
    assert len(windows(found[0], 4)) == 0 and windows(found[5], 3)[0] == windows(found[5], 3)[1]
