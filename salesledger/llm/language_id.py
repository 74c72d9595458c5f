"""Language identification by rank-order profiles.

A language's profile is the list of its 300 most frequent letter n-grams (1 to 3, words padded by blanks), most frequent
first. A text's own list is compared with each profile: every n-gram adds the distance between its two ranks, the
greatest possible where the profile lacks it. The nearest profile gives the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROFILE = 300
TRAIN_ROWS = 20_000
"""Most labelled documents that a fit reads: those of least hash of doc_id, so a fit on the same table is the same."""

CHUNK = 1 << 18
"""Characters counted at once; the counts of longer texts are summed."""

UNKNOWN = "und"
_BLANK = 32
_PLANES = 0x110000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case letter of each code point that is a letter, else 0."""
    table = np.zeros(_PLANES, np.uint32)
    for code in range(_PLANES):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def _chunk_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = _letters()[np.minimum(codes, _PLANES - 1)]
    padded = np.concatenate([[0], folded, [0]])
    keep = (padded[1:] != 0) | (padded[:-1] != 0)  # one blank between words
    stream = padded[1:][keep].astype(np.int64)
    stream = np.concatenate([[_BLANK], np.where(stream == 0, _BLANK, stream)])
    letter = stream != _BLANK
    two = stream[:-1] << 21 | stream[1:]
    three = (stream[:-2] << 42) | (stream[1:-1] << 21) | stream[2:]
    found = np.concatenate([stream[letter], two[letter[:-1] | letter[1:]], three[letter[1:-1]]])
    found.sort()
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
    return found[first], np.diff(np.append(first, len(found)))


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, packed 21 bits a character, in order, and their counts. None without a letter."""
    text = text or ""
    if len(text) <= CHUNK:
        return _chunk_grams(text)
    parts = [_chunk_grams(text[at : at + CHUNK]) for at in range(0, len(text), CHUNK)]
    keys, slots = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(slots, np.concatenate([c for _, c in parts])).astype(np.int64)


def ranked(keys: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The n-grams by falling count, ties by their code."""
    return keys[np.argsort(-counts, kind="stable")[:most]]


def fit(docs: DataFrame, size: int = PROFILE, train_rows: int = TRAIN_ROWS) -> dict[str, list[int]]:
    """Profiles of the values of ``lang``, from rows with a text and a language.

    At most ``train_rows`` rows are read, those with the least hash of doc_id. The n-grams are counted on the executors; what
    reaches the driver is ``size`` codes a language. No rows give no profiles.
    """
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    picked = labelled.select(F.xxhash64(F.col("doc_id").cast("string")).alias("_order"), "doc_id")
    picked = picked.orderBy("_order", "doc_id").limit(train_rows).select("doc_id").distinct()
    # No more keys than train_rows, by the limit; rows that repeat a key are all read.
    sample = labelled.join(F.broadcast(picked), "doc_id", "left_semi").selectExpr("CAST(lang AS STRING) AS lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), object)
            texts = batch["text"].to_pylist()
            for lang in set(langs):
                found = [grams(texts[i]) for i in np.flatnonzero(langs == lang)]
                keys, slots = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                sums = np.bincount(slots, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(sums)], ["lang", "gram", "n"]
                )

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "rank").select("lang", "gram").collect():
        profiles.setdefault(row.lang, []).append(row.gram)
    return profiles


class _Nearest:
    """Distances of one list to all profiles by one lookup."""

    def __init__(self, profiles: dict[str, list[int]], size: int) -> None:
        self.names, self.size = sorted(profiles), size
        self.keys = np.unique(np.concatenate([np.array(profiles[n], np.int64) for n in self.names]))
        self.ranks = np.full((len(self.keys) + 1, len(self.names)), -1, np.int64)
        for column, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.keys, profiles[name]), column] = np.arange(len(profiles[name]))

    def __call__(self, listed: np.ndarray) -> tuple[str, float]:
        slot = np.searchsorted(self.keys, listed)
        slot[(slot == len(self.keys)) | (self.keys[np.minimum(slot, len(self.keys) - 1)] != listed)] = len(self.keys)
        ranks = self.ranks[slot]
        apart = np.abs(ranks - np.arange(len(listed))[:, None])
        apart[ranks < 0] = self.size
        total = apart.sum(axis=0)
        best = int(total.argmin())
        return self.names[best], 1 - float(total[best]) / (self.size * len(listed))


def predict(
    docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE, names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, or other ``names``; the score is 1 less the distance over the greatest one.

    A text that is null or has no letter is ``und`` with score 0, as is every text where there is no profile. Ties go to
    the language first by name. Whole texts count; other columns pass through, existing ones of these names are replaced.
    """
    columns = [c for c in docs.columns if c not in names]
    kept = docs.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = _Nearest(profiles, size) if profiles else None
        parts = (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256))
        for batch in parts:
            langs, scores = [], []
            for text in batch["text"]:
                keys, counts = grams(text.as_py())
                lang, score = nearest(ranked(keys, counts, size)) if nearest and len(keys) else (UNKNOWN, 0.0)
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                [*columns, *names],
            )

    added = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]
    schema = T.StructType([*kept.schema.fields, *added])
    return kept.mapInArrow(run, schema)


def held_out() -> Column:
    """Fifth of the documents that a fit does not read, by the digest of their number."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
