from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = str(Path(__file__).resolve().parents[2])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])  # for the Python workers

SMALL = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "conversations", "embeddings", "pages")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and blank texts, a long one, ties, repeated rows, and columns whose names operators use."""
    words = " ".join(f"w{i}" for i in range(120))
    rows = [
        (1, words, "en", "a", "x"),
        (2, words, "en", "a", "x"),
        (2, words, "en", "a", "x"),
        (3, None, "en", None, "x"),
        (4, "", None, "b", None),
        (5, " \n\t ", "fr", "b", "x"),
        (6, "two words", "fr", "b", "x"),
        (7, "two words", "fr", "b", "x"),
        (None, "no number here", "de", "b", "x"),
        (None, None, None, None, None),
        (8, "lang " * 60_000, "de", "c", "x"),
        (9, "12345 67890 ###", "de", "c", "x"),
        (10, "word" * 400_000, "de", "c", "x"),
    ]
    names = ["size", "weight", "seed", "key", "shard", "bin", "band", "home", "h", "w", "label", "score", "slot"]
    names += ["lang_pred", "_block", "_first", "_w", "_l", "_h", "_words", "_lines", "_hashes", "_copies", "_copy", "_spans", "_cut"]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([row + (row[4],) * (len(names) - 1) for row in rows], schema)


def same(got, expected):
    """Rows of a Spark and a DuckDB result agree, whatever their order."""
    names = sorted(got.columns)
    assert names == sorted(expected.columns)
    left = sorted(tuple(map(str, row)) for row in got.select(*names).collect())
    right = sorted(tuple(map(str, row)) for row in expected.select(*names).fetchall())
    assert left == right
