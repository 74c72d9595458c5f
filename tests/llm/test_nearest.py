from __future__ import annotations

import math

import numpy as np

from salesledger.llm import nearest, queries

MIDDLE = "/root/testdata/sf0.01"


def exact(rows, k=5):
    """All pairs of query and candidate by cosine in double precision."""
    rows = sorted({(i, tuple(v)) for i, v in rows})
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], float)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[q]
        order = [j for j in np.lexsort((ids, -np.round(score, 12))) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def by_query(result):
    out = {}
    for r in sorted(result.collect(), key=lambda r: (r.query_id, r.rank)):
        found = out.setdefault(r.query_id, [])
        assert r["rank"] == len(found) + 1
        found.append((r.vec_id, r.score))
    return out


def recall(got, true):
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in near}) for q, near in true.items())
    return hits / sum(map(len, true.values()))


def test_recall_of_the_query(spark):
    table = spark.read.parquet(f"{MIDDLE}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    true, got = exact(rows), by_query(queries.op8_nearest(spark, MIDDLE))
    assert set(got) == set(true) and recall(got, true) >= 0.95
    vectors = {i: np.array(v, float) for i, v in rows}
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0])) and len({i for i, _ in near}) == 5
        for i, score in near:
            a, b = vectors[q], vectors[i]
            assert abs(score - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) < 1e-12


def test_recall_with_many_lists(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    true = exact([(r.vec_id, r.embedding) for r in table.collect()])
    got = by_query(nearest.nearest(table, per_list=40))
    assert recall(got, true) >= 0.9


def test_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(1, 120)]
    rows += [(i, rows[0][1]) for i in range(200, 260)]  # a frequent vector
    rows += [rows[10], rows[10]]
    bad = [(0, None), (300, []), (350, [0.0] * 8), (400, [1.0, None] + [1.0] * 6), (450, [math.nan] + [1.0] * 7)]
    bad += [(500, [math.inf] + [1.0] * 7), (550, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], "vec_id long, embedding array<float>, score string")
    kept = [(r.vec_id, r.embedding) for r in df.collect() if (r.vec_id, None) not in [(b[0], None) for b in bad]]
    true, got = exact(kept), by_query(nearest.nearest(df))
    assert set(got) == set(true) == {50, 100, 200, 250}
    for q, near in true.items():
        assert [i for i, _ in got[q]] == [i for i, _ in near]
    tiny = df.where("vec_id IN (50, 51)")
    assert [len(x) for x in by_query(nearest.nearest(tiny)).values()] == [1]
    assert nearest.nearest(df.where("vec_id = 50")).count() == 0
    assert nearest.nearest(df.limit(0)).count() == 0


def test_scaled_copies_go_by_id(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(8)
    rows = [(i, (base * 2.0 ** ((i * 7) % 40 - 20)).tolist()) for i in range(1, 61)]
    rows += [(i, rng.standard_normal(8).tolist()) for i in range(61, 99)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = by_query(nearest.nearest(df))
    assert [i for i, _ in got[50]] == [1, 2, 3, 4, 5]
    # Other factors leave rounding errors: the least ids count as well.
    uneven = [(i, (base * (1 + i / 7)).tolist()) for i in range(1, 61)]
    got = by_query(nearest.nearest(spark.createDataFrame(uneven, "vec_id long, embedding array<double>")))
    assert {i for i, _ in got[50]} <= {1, 2, 3, 4, 5, 6}


def test_queries_alone_in_their_list_are_searched_again(spark):
    rng = np.random.default_rng(4)
    tight = [(i, (np.eye(16)[i % 4] + 0.01 * rng.standard_normal(16)).tolist()) for i in range(1, 400) if i % 50]
    lone = [(50 * (i + 1), (np.eye(16)[8 + i] + 0.01 * rng.standard_normal(16)).tolist()) for i in range(7)]
    df = spark.createDataFrame(tight + lone, "vec_id long, embedding array<double>")
    got = by_query(nearest.nearest(df, per_list=20, recall=0.5))
    assert len(got) == 7 and all(len(near) == 5 for near in got.values())


def test_recall_of_the_registered_settings(spark):
    rng = np.random.default_rng(5)
    groups = rng.standard_normal((300, 32))
    vectors = groups[rng.integers(0, 300, 30_000)] + 0.7 * rng.standard_normal((30_000, 32))
    assert len(vectors) // nearest.PER_LIST >= 50
    rows = [(i + 1, v) for i, v in enumerate(vectors.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(by_query(nearest.nearest(df)), exact(rows)) >= 0.9


def test_scan_finds_the_nearest():
    rng = np.random.default_rng(2)
    block = rng.standard_normal((5000, 64))
    block /= np.linalg.norm(block, axis=1, keepdims=True)
    hits = 0
    for query in block[:50]:
        rows, far = nearest.scan(query, block, 6)
        true = np.argsort(((block - query) ** 2).sum(axis=1))[:6]
        hits += len(set(rows.tolist()) & set(true.tolist()))
        assert (np.diff(far) >= 0).all()
    assert hits >= 0.97 * 300
