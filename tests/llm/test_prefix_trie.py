from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from salesledger.llm import prefix_trie as trie
from salesledger.llm import queries
from salesledger.llm.running import _carried, running
from llm.conftest import SMALL, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ordered(rows):
    """Conversations as lists of turns, in the operator's order."""
    out = defaultdict(list)
    digest = lambda r, t: hashlib.md5(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()
    signed = lambda x: int(x, 16) - (1 << 64) * (int(x, 16) >> 63)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            d = digest(role or "", text or "")
            out[conv].append(((turn is not None, turn or 0, (role or "").encode(), signed(d[:16]), signed(d[16:])), (role or "", text or "")))
    return {c: [t for _, t in sorted(turns)] for c, turns in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    leaves, saved = defaultdict(int), defaultdict(int)
    for key, own in members.items():
        worth = (len(own) - 1) * len(WORD.findall(key[-1][1])) if key else 0
        for d in range(len(key) + 1):
            leaves[key[:d]] += not children[key]
            saved[key[:d]] += worth
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (
            min(own), len(key), min(members[key[:-1]]) if key else -1, len(own), len(children[key]), leaves[key], saved[key],
            sha([c for c in own if len(convs[c]) == len(key)]),
        )
        for key, own in members.items()
    )


SCHEMA = "conv_id long, turn int, role string, text string, low long, rep string, conv string"


def nodes(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names
    return sorted(tuple(-1 if v is None else v for v in row) for row in df.collect())


def test_matches_sql(spark, duck):
    same(queries.op11_prefix_trie(spark, SMALL), duck.sql(queries.oracle_sql()["op11_prefix_trie"]))


def random_rows(seed):
    """Conversations over few different turns, so they share beginnings of all lengths, end inside others and repeat."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(150):
        turns = rng.integers(0, 2, int(rng.integers(1, 14)))
        rows += [(c * 3 - 60, i, "ab"[t], f"say {'it ' * t}", 1, "r", "c") for i, t in enumerate(turns)]
    grown = [(1000 + k, i, "a", f"version {i}", 1, "r", "c") for k in range(40) for i in range(k + 1)]
    twigs = [(2000 + k, i, "a", f"twig {i}" if i < k else "other", 1, "r", "c") for k in range(30) for i in range(k + 1)]
    copies = [(3000 + k, i, "b", f"copy {i}", 1, "r", "c") for k in range(60) for i in range(3)]
    return rows + grown + twigs + copies


@pytest.mark.parametrize("seed", [1, 2])
def test_plain_conversations(spark, seed):
    rows = random_rows(seed)
    turns = trie.ordered(spark.createDataFrame(rows, SCHEMA))
    assert nodes(trie.prefix_trie(turns)) == brute(ordered(rows))


def test_rebuilt_and_odd_rows(spark):
    odd = [
        (7, None, "a", "first"), (7, 0, None, None), (7, 0, "", ""), (7, 0, "b", "tie"), (7, 0, "b", "tie"), (7, 0, "a", "tie"),
        (21, 1, "a", "x"), (22, 1, "a", "x"), (23, 5, "é", "🙂 " * 70_000), (None, 1, "a", "no id"), (None, None, None, None),
        (-3, 1, "a", "x"), (-3, 2, "a", "y"), (39, 1, "q", "one"), (1 << 60, 0, "a", "x"),
    ]
    rows = [(*r, None, None, None) for r in odd] + random_rows(3)
    df = spark.createDataFrame(rows, SCHEMA)
    expected = brute(rebuilt(ordered(rows)))
    assert any(n[1] == 0 and n[-1] != hashlib.sha256().hexdigest() for n in expected)  # turnless ones end at the root
    assert nodes(trie.prefix_trie(*trie.rebuilt(trie.ordered(df)))) == expected
    assert nodes(trie.prefix_trie(*trie.rebuilt(trie.ordered(df.limit(0))))) == []


def test_turnless_alone(spark):
    rows = [(c, 0, "a", "x", None, None, None) for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4]
    df = spark.createDataFrame(rows, SCHEMA)
    assert nodes(trie.prefix_trie(*trie.rebuilt(trie.ordered(df)))) == brute(rebuilt(ordered(rows)))


def test_running_over_one_hot_key(spark):
    """A key with most rows spans partitions; sums wrap, equal rows all count."""
    rng = np.random.default_rng(5)
    rows = [(1 if i % 3 else i, int(v), int(w)) for i, (v, w) in enumerate(rng.integers(-(1 << 62), 1 << 62, (3000, 2)))]
    rows += [(1, 0, 1 << 62)] * 500
    df = spark.createDataFrame(rows, "k long, o long, s long").repartition(5)
    got = running(df, "k", ["o"], ["s"]).collect()
    totals = defaultdict(list)
    for k, o, s in sorted(rows):
        totals[k].append((o, s))
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.k, r.number)):
        by[r.k].append(r)
    for k, own in totals.items():
        assert [r.number for r in by[k]] == list(range(1, len(own) + 1)) and [r.o for r in by[k]] == [o for o, _ in own]
        assert by[k][-1].s % (1 << 64) == sum(s for _, s in own) % (1 << 64)


def test_carried():
    edges = [(0, True, False, 5, 1, 9), (0, False, True, 7, 2, 4), (2, True, False, 7, 1, 1), (2, False, True, 7, 6, 6)]
    edges += [(3, True, True, 7, 1, 2), (4, True, False, 7, 1, 1), (4, False, True, 8, 3, 3), (5, True, True, 9, 1, 1)]
    assert _carried(edges, 1) == {2: (7, [2, 4]), 3: (7, [8, 10]), 4: (7, [9, 12])}
