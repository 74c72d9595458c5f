"""Packing token sequences in document order by dynamic programming.

Documents are dealt to ranges of doc_id; inside a range their tokens form one stream, each document closed by an end
token, and the stream is cut into windows of at most 2048 tokens. Cuts may fall at document ends, at sentence ends for a
small price, and inside long sentences for a high one. The cost of a window is its padding, 2048 less its length
(the last one of a range needs none at a power of two), plus the price of its cut, and

    best[j] = min over i in reach of (best[i] + position[i]) + 2048 - position[j] + price[j]

is a minimum over a sliding range of cuts, kept in a monotone queue: constant time per cut.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
END = 1
SENTENCE_PRICE, INNER_PRICE = 8, 200
"""What a cut at a sentence end, and one inside a sentence, costs in padding tokens."""

LONG = 256
"""A sentence of more tokens may be cut inside, at every 64th token."""

CHUNK = 1 << 18
"""Tokens of a range that are cut together; the rest after the last cut but one moves on to the next chunk."""

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
"""How the byte-level vocabulary splits a text before merging; a fixed value of the tokenizer file."""


def _bytes_of() -> dict[str, int]:
    """Byte behind each character of the vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _encoder(path: str):  # noqa: ANN202
    """Encoder for the vocabulary of a tokenizers file, and which ids close a sentence. One per worker process.

    The merges of such a file are in the order of the ids, so the faster public encoder gives the same ids.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)
    as_byte = _bytes_of()
    added = {token["content"] for token in tokens["added_tokens"]}
    ranks = {bytes(map(as_byte.get, token)): rank for token, rank in tokens["model"]["vocab"].items() if token not in added}
    special = {token["content"]: token["id"] for token in tokens["added_tokens"]}
    encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    closing = np.zeros(max([*ranks.values(), *special.values()]) + 1, bool)
    for token, rank in ranks.items():
        closing[rank] = token[-1:] in (b".", b"!", b"?") or b"\n" in token
    return encoding, closing


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_ids(text: str | None, path: str, special: bool = False) -> np.ndarray:
    """Ids of a text followed by the end token.

    Strings that look like special tokens are ordinary text, or with ``special`` have the ids of the file's added tokens,
    as tokenizers gives them for the file as it loads.
    """
    encoding, _ = _encoder(path)
    allowed = "all" if special else set()
    ids = encoding.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()) if text else np.zeros(0, np.uint32)
    return np.append(ids, np.uint32(END))


def cuts(positions: np.ndarray, prices: np.ndarray, length: int = LENGTH) -> list[int]:
    """Indexes of the cuts, from 0 to the last, that part the stream at the least cost.

    ``positions`` ascend from 0 and no step is longer than ``length``; ``prices`` are those of cutting there.
    """
    at, price = positions.tolist(), prices.tolist()
    best, back = [0.0] * len(at), [0] * len(at)
    waiting: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, len(at)):
        here = at[j]
        while at[waiting[0][1]] < here - length:
            waiting.popleft()
        cost, i = waiting[0]
        cost += length - here
        if j == len(at) - 1:  # the last window may be short, and needs no padding at a power of two
            for k in range(i, j):
                if best[k] < cost and (here - at[k]).bit_count() == 1:
                    cost, i = best[k], k
        cost += price[j]
        best[j], back[j] = cost, i
        reach = cost + here
        while waiting and waiting[-1][0] >= reach:
            waiting.pop()
        waiting.append((reach, j))
    out = [len(at) - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


def _candidates(ids: np.ndarray, ends: np.ndarray, closing: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the stream may be cut, and the price: document ends, sentence ends, and steps inside what is longer."""
    sentence = np.flatnonzero(closing[ids]) + 1
    marks = np.unique(np.concatenate([[0], sentence, ends, [len(ids)]]))
    gaps = np.diff(marks)
    long = np.flatnonzero(gaps > LONG)
    inner = [np.arange(marks[g] + 64, marks[g + 1], 64) for g in long]
    positions = np.unique(np.concatenate([marks, *inner])) if inner else marks
    prices = np.full(len(positions), SENTENCE_PRICE, np.float64)
    if inner:
        prices[np.isin(positions, np.concatenate(inner))] = INNER_PRICE
    prices[np.isin(positions, ends)] = 0
    return positions, prices


_PIECE = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)


class _Packer:
    """Stream of one range: takes documents, gives pieces."""

    def __init__(self, partition: int, closing: np.ndarray, length: int) -> None:
        self.closing, self.length = closing, length
        self.sequence = partition << 33
        self.docs: list[list] = []
        """Of each waiting document: doc_id, ids, first id that is not packed yet."""
        self.waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append([doc_id, ids, 0])
        self.waiting += len(ids)
        if self.waiting >= CHUNK:
            yield from self.pack(last=False)

    def pack(self, last: bool) -> Iterator[tuple]:
        if not self.docs:
            return
        stream = np.concatenate([ids[at:] for _, ids, at in self.docs])
        ends = np.cumsum([len(ids) - at for _, ids, at in self.docs])
        positions, prices = _candidates(stream, ends, self.closing, self.length)
        places = positions[cuts(positions, prices, self.length)].tolist()
        if not last:
            places = places[:-2] if len(places) > 3 else places[:2]
        edges = np.unique(np.concatenate([places, ends[ends <= places[-1]]])).tolist()
        whose = iter(self.docs)
        doc = next(whose)
        begins = set(places)
        for lo, hi in zip(edges, edges[1:]):
            if lo in begins:
                self.sequence += 1
                offset = 0
            doc_id, ids, at = doc
            n = hi - lo
            crc = zlib.crc32(np.ascontiguousarray(ids[at : at + n], "<u4").tobytes())
            yield doc_id, at, n, crc, len(ids), self.sequence, offset
            offset += n
            doc[2] = at + n
            if doc[2] == len(ids):
                doc = next(whose, None)
        self.docs = [d for d in self.docs if d[2] < len(d[1])]
        self.waiting = sum(len(ids) - at for _, ids, at in self.docs)


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece of a document in a sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The ids are those of the tokenizers file as it loads, special tokens in a text included. A null or empty text is one
    end token. Documents follow each other by doc_id, then text; rows that repeat a doc_id
    are packed each on its own, rows without one come first. A document of any length is cut over as many sequences as it
    needs, and an empty table gives no rows. Other columns are not read. ``sequence_id`` is unique, not gapless.
    """
    path = tokenizer or default_tokenizer()
    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "coalesce(CAST(text AS STRING), '') AS text")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The hash beside doc_id parts the rows of a doc_id that repeats.
    ordered = rows.withColumn("_hash", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "_hash")
    ordered = ordered.sortWithinPartitions("doc_id", "_hash").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, closing = _encoder(path)
        packer, out = None, []
        for batch in batches:
            for doc_id, text, part in zip(*(batch[c] for c in ("doc_id", "text", "part"))):
                packer = packer or _Packer(part.as_py(), closing, length)
                out += packer.add(doc_id.as_py(), token_ids(text.as_py(), path, special=True))
                if len(out) >= 4096:
                    yield _pieces(out)
                    out = []
        if packer:
            out += packer.pack(last=True)
        yield _pieces(out)

    return ordered.mapInArrow(
        run,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(_PIECE)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_PIECE)
