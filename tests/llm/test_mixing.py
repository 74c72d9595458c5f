from __future__ import annotations

import re
from collections import Counter, defaultdict

from salesledger.llm import mixing, queries
from llm.conftest import SMALL, same


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Resharing of the excess, round by round."""
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    capped: set = set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        open_ = [s for s in sizes if s not in capped]
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return share | {s: 2.0 * sizes[s] for s in capped}
        capped |= over


def check(docs, rows):
    counted = Counter((r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect())
    assert counted == Counter((r.doc_id, r.source, r.size) for r in rows)
    sizes: dict = defaultdict(int)
    for (_, source, size), n in counted.items():
        sizes[source] += size * n
    wanted = targets(sizes) if sum(sizes.values()) else {}
    largest, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.taken in (0, r.size, 2 * r.size)
        assert abs(r.target - wanted.get(r.source, 0)) <= 1e-9 * (1 + r.target)
        largest[r.source], taken[r.source] = max(largest[r.source], r.size), taken[r.source] + r.taken
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= largest[source] / 2 + 1e-6, source


def test_query_matches_sql_and_brute_force(spark, duck, documents):
    same(queries.op9_mixing(spark, SMALL), duck.sql(queries.oracle_sql()["op9_mixing"]))
    labels = mixing.label_weights(spark.read.parquet(f"{SMALL}/labels.parquet"))
    first = mixing.mixed(documents, labels).collect()
    check(documents, first)
    again = mixing.mixed(documents.repartition(7), labels.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in first) == sorted((r.doc_id, r.taken) for r in again)


def test_odd_rows(spark, odd_documents):
    check(odd_documents, mixing.mixed(odd_documents).collect())
    out = mixing.mix(odd_documents)
    assert out.columns == odd_documents.columns
    assert out.where("doc_id IS NULL").count() == 2
    assert mixing.mixed(odd_documents.limit(0)).count() == 0 and mixing.mix(odd_documents.limit(0)).count() == 0
    weights = spark.createDataFrame([(1, 0.0), (1, None), (2, -3.0), (None, 1.0), (6, 9.0)], "doc_id long, weight double")
    check(odd_documents, mixing.mixed(odd_documents, weights).collect())
    assert mixing.mixed(odd_documents.where("text IS NULL")).where("taken <> 0 OR target <> 0").count() == 0


def test_mix_repeats_documents_as_taken(spark, documents):
    taken = {r.doc_id: r.taken // max(1, r.size) for r in mixing.mixed(documents).collect() if r.size}
    copies = Counter(r.doc_id for r in mixing.mix(documents).select("doc_id").collect())
    assert {i: n for i, n in taken.items() if n} == dict(copies)


def test_larger_weights_are_taken_more_often(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'one two three' AS text", "concat('s', id % 6) AS source")
    weights = docs.selectExpr("doc_id", "IF(doc_id % 4 < 2, 4D, 1D) AS weight")
    rows = mixing.mixed(docs, weights).where("epochs = 0").collect()
    heavy = [r.sampled for r in rows if r.doc_id % 4 < 2]
    light = [r.sampled for r in rows if r.doc_id % 4 >= 2]
    assert sum(heavy) / len(heavy) > 1.3 * sum(light) / len(light)
