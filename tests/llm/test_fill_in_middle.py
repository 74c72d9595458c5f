from __future__ import annotations

import hashlib
import re

import pytest

from salesledger.llm import fill_in_middle as fim
from salesledger.llm import queries
from llm.conftest import SMALL, same


def brute(doc_id, text, seed=7, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < spm_rate:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = [
    (1, "one line"), (2, "a\nb\nc\n"), (3, "\n\n\n"), (4, ""), (5, None), (6, "has <S> in it\nand more\n"),
    (7, "é\n🙂🙂\r\nlast"), (8, "x" * 3_000_000), (9, "l\n" * 400_000), (None, "no\nkey\n"), (None, None), (2, "a\nb\nc\n"),
    (10, " \n\t\n"), (11, "tail<P"), (12, "<\n>S>\n<M\n"), (13, "\n" + "y" * 500_000 + "\n"),
]


def test_matches_sql(spark, duck):
    same(queries.op12_fill_in_middle(spark, SMALL), duck.sql(queries.oracle_sql()["op12_fill_in_middle"]))


@pytest.mark.parametrize("rate,spm_rate,seed", [(100, 50, 7), (40, 100, 1), (0, 0, 7)])
def test_against_brute_force(spark, rate, spm_rate, seed, monkeypatch):
    rows = ODD + [(100 + i, "".join(f"line {j} of {i}\n" for j in range(i % 9)) + "end" * (i % 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = fim.fill_in_middle(df, seed, rate, spm_rate).withColumn("back", fim.restored()).collect()
    key = lambda r: str(r)
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got], key=key) == sorted(
        [(i, *brute(i, t, seed, rate, spm_rate)) for i, t in rows], key=key
    )
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {100: {"plain", "psm", "spm"}, 40: {"plain", "spm"}, 0: {"plain"}}[rate]


def test_slices_of_a_batch(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["ab"] * 10 + ["c" * 50] + [""] * 3 + ["d"])
    monkeypatch.setattr(fim, "SLICE_BYTES", 7)
    batch = pa.RecordBatch.from_arrays([texts], ["t"])
    parts = list(fim._slices(batch, texts))
    assert parts == [(0, 3), (3, 3), (6, 3), (9, 1), (10, 1), (11, 4)]


def test_odd_columns(spark, odd_documents):
    names = ["n", "form", "output", "_text", "_draws", "_Text_", "a b"]
    df = odd_documents.withColumns({c: odd_documents.label for c in names})
    out = fim.fill_in_middle(df)
    assert out.columns == [c for c in df.columns if c not in fim.ADDED] + list(fim.ADDED)
    kept = ["doc_id", "text", "score", "_text", "_draws", "_Text_", "`a b`"]
    assert sorted(map(str, out.select(*kept).collect())) == sorted(map(str, df.select(*kept).collect()))
    assert fim.digest(fim.fill_in_middle(df.limit(0))).count() == 0
