from __future__ import annotations

import zlib
from collections import Counter

import xxhash

from salesledger.llm import sharding


def jump(key: int, shards: int) -> int:
    b, j, key = -1, 0, key % 2**64
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def shard_of(doc_id, shards):
    if doc_id is None:
        return jump(42, shards)
    return jump(xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), 42), shards)


def check(docs, shards=16):
    rows = sharding.with_shards(sharding.sizes(docs), shards).collect()
    texts = Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert len(rows) == sum(texts.values())
    slots = {}
    for r in rows:
        assert r.shard == shard_of(r.doc_id, shards) and r.grown_shard == shard_of(r.doc_id, shards + 1)
        assert r.grown_shard in (r.shard, shards)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    got = Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    assert got == Counter(
        {(i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())): 0 for i, t in texts}
    ) + Counter(
        (i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode()))
        for (i, t), n in texts.items()
        for _ in range(n)
    )


def test_matches_brute_force(documents):
    check(documents)


def test_odd_rows(odd_documents):
    check(odd_documents)
    check(odd_documents, 1)
    assert sharding.with_shards(sharding.sizes(odd_documents.limit(0)), 4).count() == 0


def test_a_new_shard_takes_its_share_only(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    placed = sharding.with_shards(ids, 16).collect()
    moved = sum(r.shard != r.grown_shard for r in placed)
    assert abs(moved - 20_000 / 17) < 150


def test_shards_are_found_in_one_pass_beside_the_counts(spark):
    docs = spark.range(100).selectExpr("id AS doc_id")
    text = sharding.with_shards(docs, 4)._jdf.queryExecution().executedPlan().toString()
    # One for the counts, one for both numbers of shards; the test's plan shows each once, before it runs.
    assert len([line for line in text.splitlines() if "ArrowEvalPython" in line]) == 2
