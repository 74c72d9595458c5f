"""Passages that repeat across documents, exact or slightly changed, by collinear chaining of shared seeds.

1. Seeds are runs of 6 words; of every 12 neighbouring runs the one with the least hash is a seed, so any 17 equal words
   of two texts share a seed, wherever they stand.
2. A seed's home is its first occurrence, by doc_id and position. Every occurrence in a later document is matched with
   the home alone: a passage in n documents gives n - 1 matches per seed, not pairs of all with all.
3. A document's matches with one home document are chained in both orders with gap costs through a Fenwick tree.
4. The chained stretches of both texts, with a margin, are aligned word by word; unmatched runs end a passage.
5. Beside the chains every exact repeat is found, also a periodic one and one whose seeds have many homes. A run of 50
   words has one long seed, the least hash of the runs of 25 words in it; a block is a stretch of runs with one long seed.
   Equal blocks are matched whole, with the first document that has them. Where one long seed has different blocks, as
   at the ends of a passage, their runs are compared one by one in a second shuffle. A block's home adds to the chains,
   so a changed passage whose short seeds were seen elsewhere still meets the document that has it.
6. Passages of a document are merged over short gaps within one home, and where they touch or overlap whatever their homes;
   those of at least 50 words are reported.

The first document that has a passage keeps it. Repeats inside one document are not looked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesledger.llm.chaining import aligned, chains, segments, trimmed
from salesledger.llm.columns import fresh
from salesledger.llm.hashing import stretches, windows, word_hashes
from salesledger.llm.staging import staged

MIN_WORDS = 50
SEED, WINDOW = 6, 12
MIN_CHAIN = 12
"""Words between the ends of a chain that is worth aligning."""

MARGIN = 24
"""Words added on either side of a chain: the next seed is at most 17 words away."""

MAX_GAP = 8
IDENTITY = 0.75
_DENSE = 3
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _ends(lengths: np.ndarray, short: int) -> np.ndarray:
    """For each word of texts that stand one after another, the first place after its text's last run of ``short`` + 1 words."""
    return np.repeat(np.cumsum(lengths) - short, lengths)


def _least(values: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every ``wide`` neighbouring values the least, and the place of the first such."""
    least, place, reach = values, np.arange(len(values)), 1
    while reach < wide and len(least):
        step = min(reach, wide - reach)
        left = least[:-step] <= least[step:]
        least, place = np.where(left, least[:-step], least[step:]), np.where(left, place[:-step], place[step:])
        reach += step
    return least, place


def seeds_of(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the chosen runs of texts whose words stand one after another; ``lengths`` are their numbers of words."""
    runs = windows(words, SEED)
    if not len(runs):
        return runs, np.zeros(0, np.int64)
    starts = np.cumsum(lengths) - lengths
    end = _ends(lengths, SEED - 1)[: len(runs)]
    at = np.arange(len(runs))
    _, place = _least(runs, WINDOW)
    inside = at[: len(place)] + WINDOW <= end[: len(place)]
    chosen = place[inside]
    # A text with fewer runs than a window has one seed.
    few = np.flatnonzero((lengths >= SEED) & (lengths - SEED + 1 < WINDOW))
    if len(few):
        small = [int(starts[i] + np.argmin(runs[starts[i] : starts[i] + lengths[i] - SEED + 1])) for i in few]
        chosen = np.concatenate([chosen, small])
    chosen = np.unique(chosen)
    repeats = (runs[chosen[1:]] == runs[chosen[:-1]]) & (end[chosen[1:]] == end[chosen[:-1]])
    chosen = chosen[np.concatenate([[True], ~repeats])] if len(chosen) else chosen
    return runs[chosen], chosen


def blocks_of(
    words: np.ndarray, lengths: np.ndarray, min_words: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each block of the texts the long seed and its place, the first and last run, and the hash of all words."""
    k = min_words // 2
    wide = min_words - k + 1
    at = np.arange(max(0, len(words) - k + 1))
    every = stretches(words, at, at + k)
    least, _ = _least(every, wide)
    end = _ends(lengths, min_words - 1)[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) < end)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none, none.view(np.uint64)
    value = least[at]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (end[at[1:]] != end[at[:-1]])])
    first, last = at[new], at[np.concatenate([new[1:], [True]])]
    seed = value[new]
    # The last run of a block begins at its long seed or before; the place is the first one from there on.
    place, apart = last.copy(), np.arange(len(last))
    for _ in range(wide):
        apart = apart[every[place[apart]] != seed[apart]]
        if not len(apart):
            break
        place[apart] += 1
    return seed, place, first, last, stretches(words, first, last + min_words)


SEEDED_AT_ONCE = 1 << 18
"""Words whose seeds are found together; a longer text is on its own."""


def _groups(texts: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    group, size = [], 0
    for words in texts:
        if group and size + len(words) > SEEDED_AT_ONCE:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def _seed(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Seeds, and blocks by their long seed; a block's position is a complement, which tells them apart."""
    for batch in batches:
        for start in range(0, batch.num_rows, 128):
            part = batch.slice(start, 128)
            ids, done = part["doc_id"].to_numpy(zero_copy_only=False).astype(np.int64), 0
            for group in _groups(word_hashes(part["text"].to_pylist())):
                words, lengths = np.concatenate(group), np.array([len(w) for w in group], np.int64)
                starts = np.cumsum(lengths) - lengths
                seeds, at = seeds_of(words, lengths)
                long, place, first, last, block = blocks_of(words, lengths, min_words)
                none = np.zeros(len(seeds), np.int64)
                owner = np.searchsorted(starts + lengths, np.concatenate([at, first]), side="right")
                begin, size = starts[owner], len(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([seeds, long]).view(np.int64)),
                        pa.array(ids[done : done + len(group)][owner]),
                        pa.array(np.concatenate([at - begin[:size], ~(place - begin[size:])]).astype(np.int32)),
                        pa.array(np.concatenate([none, first - begin[size:]]).astype(np.int32)),
                        pa.array(np.concatenate([none, last - begin[size:]]).astype(np.int32)),
                        pa.array(np.concatenate([none, block.view(np.int64)])),
                    ],
                    ["seed", "doc", "pos", "first", "last", "block"],
                )
                done += len(group)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of some size: a step that makes few rows per document sends them together."""
    waiting, rows, size = [], 0, 0
    for batch in batches:
        waiting.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= 1 << 16 or size >= 4 << 20:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
            waiting, rows, size = [], 0, 0
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def _items(batch: pa.RecordBatch, column: str, *fields: str) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Number of each row of a batch with the fields of its list of structs, unpacked once for the whole batch."""
    lists = batch[column]
    offsets, values = lists.offsets.to_numpy(), lists.values
    whole = [values.field(f).to_numpy(zero_copy_only=False) for f in fields]
    for i in range(batch.num_rows):
        yield i, [x[offsets[i] : offsets[i + 1]] for x in whole]


_CHAIN = pa.schema(
    [
        *((c, pa.int64()) for c in ("doc", "home", "start", "end", "home_start", "home_end")),
        *((c, pa.int64()) for c in ("long", "block")),
    ]
)


def _chain(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Chains of each document, from one row with all its matches; its blocks with a shared long seed have no home.

    A block's ``start`` and ``end`` are its first and last run, ``home_start`` is 1 where its long seed has other blocks.
    """
    # A long seed's match is one of seeds at its start, its end and between.
    ahead = np.unique(np.append(np.arange(0, max(min_words // 2 - SEED, 0), WINDOW), max(min_words // 2 - SEED, 0)))
    for batch in batches:
        docs = batch["doc"].to_pylist()
        fields = ("home", "home_pos", "pos", "first", "last", "block", "long", "many")
        for i, (home, home_pos, pos, first, last, block, seed, many) in _items(batch, "matches", *fields):
            doc = docs[i]
            found = pos < 0
            if found.any():
                n = int(found.sum())
                none = pa.nulls(n, pa.int64())
                columns = [
                    np.full(n, doc, np.int64), none, first[found], last[found], many[found], none, seed[found], block[found]
                ]
                yield pa.RecordBatch.from_arrays(
                    [c if c is none else pa.array(c.astype(np.int64)) for c in columns], schema=_CHAIN
                )
            short, long = pos >= 0, (pos < 0) & (home != doc) & (min_words // 2 >= SEED)
            home = np.concatenate([home[short], np.repeat(home[long], len(ahead))])
            home_pos, pos = (
                np.concatenate([x[short], (~x[long][:, None] + ahead).ravel()]) for x in (home_pos, pos)
            )
            if not len(home):
                continue
            order = np.argsort(home, kind="stable")
            home, home_pos, pos = home[order], home_pos[order].astype(np.int64), pos[order].astype(np.int64)
            cuts = np.flatnonzero(np.diff(home)) + 1
            rows = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(home)]):
                if hi - lo < 2:
                    continue
                found = segments(pos[lo:hi], home_pos[lo:hi], SEED, SEED + WINDOW)
                for chain in chains(trimmed(found)):
                    (p0, q0, _), (p1, q1, n) = chain[0], chain[-1]
                    if p1 + n - p0 >= MIN_CHAIN:
                        rows.append((doc, int(home[lo]), p0, p1 + n, q0, q1 + n))
            if rows:
                columns = [*zip(*rows), [None] * len(rows), [None] * len(rows)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_CHAIN)


_SLICE = pa.schema([("chain", pa.int64()), ("side", pa.int32()), ("at", pa.int64()), ("words", pa.binary())])


def _slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of the asked stretches, from one row per document with its text and what is asked of it."""
    for batch in batches:
        for i, asked in _items(batch, "asked", "chain", "side", "start", "end"):
            words = next(word_hashes([batch["text"][i].as_py()])).astype(np.uint32)
            chain, side, start, end = (x.tolist() for x in asked)
            for at in range(0, len(chain), 4096):
                picked = range(at, min(at + 4096, len(chain)))
                starts = [max(0, start[j] - MARGIN) for j in picked]
                cut = [words[s : end[j] + MARGIN].tobytes() for s, j in zip(starts, picked)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chain[j] for j in picked], pa.int64()),
                        pa.array([side[j] for j in picked], pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array(cut, pa.binary()),
                    ],
                    schema=_SLICE,
                )


_PASSAGE = pa.schema(
    [(c, pa.int64()) for c in ("doc", "home", "start", "end", "home_start", "home_end", "matched")]
)


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, home, at, words, home_at, home_words in zip(*(batch[c] for c in range(6))):
            d, a = (np.frombuffer(x.as_py(), np.uint32).astype(np.uint64) for x in (words, home_words))
            at, home_at = at.as_py(), home_at.as_py()
            for start, end, other, other_end, matched in aligned(d, a, _DENSE, MAX_GAP, IDENTITY):
                rows.append(
                    (doc.as_py(), home.as_py(), at + start, at + end, home_at + other, home_at + other_end, matched)
                )
        columns = zip(*rows) if rows else [[]] * len(_PASSAGE)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_PASSAGE)


def _run(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Hash, document and position of the runs of the asked blocks."""
    for batch in batches:
        for i, asked in _items(batch, "asked", "first", "last"):
            words = next(word_hashes([batch["text"][i].as_py()]))
            first, last = (x.astype(np.int64) for x in asked)
            inside = last + min_words <= len(words)  # not so in another text under the same doc_id
            first, sizes = first[inside], (last - first + 1)[inside]
            asked_for = np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
            for start in range(0, len(asked_for), 1 << 18):
                at = asked_for[start : start + (1 << 18)]
                runs = stretches(words, at, at + min_words)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(runs.view(np.int64)),
                        pa.array(np.full(len(at), batch["doc_id"][i].as_py(), np.int64)),
                        pa.array(at.astype(np.int32)),
                    ],
                    ["run", "doc", "pos"],
                )


def _exact(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Stretches of successive repeated blocks and runs with one home, from one row per document."""
    for batch in batches:
        for i, items in _items(batch, "runs", "first", "last", "home", "home_pos"):
            first, last, home, home_pos = (x.astype(np.int64) for x in items)
            order = np.lexsort((home, first))
            first, last, home, home_pos = first[order], last[order], home[order], home_pos[order]
            cut = np.flatnonzero((first[1:] > last[:-1] + 1) | (np.diff(home) != 0)) + 1
            begin = np.concatenate([[0], cut])
            start, end = first[begin], np.maximum.reduceat(last, begin) + min_words
            other_end = np.maximum.reduceat(home_pos + last - first, begin) + min_words
            doc = np.full(len(begin), batch["doc"][i].as_py(), np.int64)
            columns = [doc, home[begin], start, end, home_pos[begin], other_end, end - start]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_PASSAGE)


def matches(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Occurrences of shared seeds beside their home: (doc, pos, home, home_pos, first, last, block, long, many).

    Positions of blocks are complements of their long seed's; ``long`` is their long seed, ``many`` whether it has different blocks, and
    their home has a row too.
    """
    texts = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    texts = texts.where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = texts.mapInArrow(
        lambda batches: _seed(batches, min_words), "seed long, doc long, pos int, first int, last int, block long"
    )
    # Dealt by seed once, for the homes and for the join: both read all columns, so Spark makes one shuffle of them.
    found = found.repartition("seed")
    homes = found.groupBy("seed").agg(
        F.expr("min(struct(doc, pos, first, last)) AS home"), F.max("doc").alias("latest"), F.expr("min(block) < max(block) AS many")
    )
    homes = homes.where("latest > home.doc").select("seed", "home", "many")
    met = found.join(homes, "seed").where("doc > home.doc OR pos < 0")
    return met.selectExpr(
        "doc", "pos", "home.doc AS home", "home.pos AS home_pos", "first", "last", "block", "IF(pos < 0, seed, 0L) AS long",
        "CAST(many AS INT) AS many",
    )


def exact_repeats(texts: DataFrame, blocks: DataFrame, min_words: int) -> DataFrame:
    """Passages all of whose runs of ``min_words`` an earlier document has, from the blocks with a shared long seed.

    A block in a later document than its first one is known whole. So only the blocks of their first document are
    asked for single runs, and only where their long seed has other blocks.
    """
    firsts = blocks.groupBy("block", "long").agg(
        F.expr("min(struct(doc, first, last)) AS home"), F.max("doc").alias("latest"), F.max("many").alias("many")
    )
    firsts = staged(firsts, "blocks")
    known = firsts.where("latest > home.doc").select("block", "long", "home")
    whole = blocks.join(known, ["block", "long"]).where("doc > home.doc").selectExpr(
        "doc", "first", "last", "home.doc AS home", "home.first AS home_pos"
    )
    several = firsts.where("many = 1").select("block", "long", "home")
    asked = blocks.join(several, ["block", "long"]).where("doc = home.doc").groupBy(F.col("doc").alias("doc_id")).agg(
        F.collect_set(F.struct("first", "last")).alias("asked")
    )
    runs = texts.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(
        lambda batches: _packed(_run(batches, min_words)), "run long, doc long, pos int"
    )
    runs = staged(runs, "runs", release=True).repartition("run")
    homes = runs.groupBy("run").agg(F.expr("min(struct(doc, pos)) AS home"), F.max("doc").alias("latest"))
    homes = homes.where("latest > home.doc").select("run", "home")
    single = runs.join(homes, "run").where("doc > home.doc").selectExpr(
        "doc", "CAST(pos AS BIGINT) AS first", "CAST(pos AS BIGINT) AS last", "home.doc AS home",
        "CAST(home.pos AS BIGINT) AS home_pos",
    )
    met = whole.unionByName(single).groupBy("doc").agg(
        F.collect_list(F.struct("first", "last", "home", "home_pos")).alias("runs")
    )
    return met.mapInArrow(
        lambda batches: _packed(_exact(batches, min_words)),
        "doc long, home long, start long, end long, home_start long, home_end long, matched long",
    )


def passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Aligned passages with one home each: doc, home, start, end, home_start, home_end, matched; positions in words."""
    texts = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    grouped = matches(docs, min_words).groupBy("doc").agg(
        F.collect_list(F.struct("home", "home_pos", "pos", "first", "last", "block", "long", "many")).alias("matches")
    )
    found = grouped.mapInArrow(
        lambda batches: _packed(_chain(batches, min_words)),
        "doc long, home long, start long, end long, home_start long, home_end long, long long, block long",
    )
    found = staged(found.withColumn("chain", F.expr("xxhash64(doc, home, start, home_start)")), "chains", release=True)
    blocks = found.where("home IS NULL").selectExpr(
        "doc", "start AS first", "end AS last", "home_start AS many", "long", "block"
    )
    found = found.where("home IS NOT NULL").drop("long", "block")
    wanted = found.selectExpr(
        """inline(array(struct(doc AS doc_id, struct(chain, 0 AS side, start, end) AS ask),
                        struct(home AS doc_id, struct(chain, 1 AS side, home_start AS start, home_end AS end) AS ask)))"""
    )
    # A home may be asked for by any number of documents: its requests stay in rows by the partition they come from.
    wanted = wanted.groupBy("doc_id", F.spark_partition_id().alias("lane")).agg(F.collect_list("ask").alias("asked"))
    named = texts.where("doc_id IS NOT NULL AND text IS NOT NULL")
    cut = named.join(wanted, "doc_id").select("text", "asked").mapInArrow(
        lambda batches: _packed(_slice(batches)), "chain long, side int, at long, words binary"
    )
    sides = cut.groupBy("chain").agg(
        F.expr("max(struct(at, words)) FILTER (WHERE side = 0) AS d"),
        F.expr("max(struct(at, words)) FILTER (WHERE side = 1) AS a"),
    )
    pairs = found.select("chain", "doc", "home").join(sides, "chain").where("d IS NOT NULL AND a IS NOT NULL")
    near = pairs.selectExpr("doc", "home", "d.at", "d.words", "a.at AS home_at", "a.words AS home_words").mapInArrow(
        lambda batches: _packed(_align(batches)), "doc long, home long, start long, end long, home_start long, home_end long, matched long"
    )
    return near.unionByName(exact_repeats(named, blocks, min_words))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per repeated passage of a document that is not the first to have it.

    doc_id, passage (0, 1, ... within the document), start and end in words, n_words, source_doc_id (the home that
    covers most of it), source_start, matched (words equal to that home's). Null or empty texts, texts shorter than
    the shortest passage and rows without doc_id have no rows; equal rows under one doc_id count as one document.
    """
    spans = passages(docs, min_words).groupBy("doc").agg(
        F.collect_set(F.struct("start", "end", "matched", "home", "home_start")).alias("spans")
    )
    return spans.mapInArrow(
        lambda batches: _packed(_merge(batches, min_words)),
        "doc_id long, passage int, start long, end long, n_words long, source_doc_id long, source_start long, matched long",
    )


def merged(
    start: np.ndarray, end: np.ndarray, matched: np.ndarray, home: np.ndarray, home_start: np.ndarray
) -> list[np.ndarray]:
    """Passages of one document put together: start, end, home, home_start, matched.

    Passages of one home up to MAX_GAP words apart are one; passages of different homes are one where they touch or overlap. So
    a word between passages counts as repeated only if one home has the text on both sides of it. Home and matched are those of
    the part with most matched words.
    """
    for by_home, gap in ((True, MAX_GAP), (False, 0)):
        order = np.lexsort((end, start, home) if by_home else (end, start))
        start, end, matched, home, home_start = (x[order] for x in (start, end, matched, home, home_start))
        of = home if by_home else np.zeros(len(home), np.int64)
        group = np.concatenate([[0], np.cumsum(of[1:] != of[:-1])])
        # Ends so far, each home's own: moved apart by more than any end.
        wide = int(end.max()) + MAX_GAP + 1
        reach = np.maximum.accumulate(end + group * wide) - group * wide
        new = np.concatenate([[True], (start[1:] > reach[:-1] + gap) | (group[1:] != group[:-1])])
        first = np.flatnonzero(new)
        best = np.lexsort((home_start, home, matched, np.cumsum(new)))[np.append(first[1:], len(new)) - 1]
        start, end = start[first], np.maximum.reduceat(end, first)
        matched, home, home_start = matched[best], home[best], home_start[best]
    return [start, end, home, home_start, matched]


def _merge(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, given in _items(batch, "spans", "start", "end", "matched", "home", "home_start"):
            start, end, home, home_start, matched = merged(*given)
            long = np.flatnonzero(end - start >= min_words)
            doc = np.full(len(long), batch["doc"][i].as_py(), np.int64)
            columns = [doc, np.arange(len(long), dtype=np.int32), start[long], end[long], (end - start)[long]]
            columns += [home[long], home_start[long], matched[long]]
            names = ["doc_id", "passage", "start", "end", "n_words", "source_doc_id", "source_start", "matched"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (start, end); what stands between them stays as it is."""
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at : starts[min(start, len(starts) - 1)]])
        at = starts[min(end, len(starts) - 1)]
    return "".join([*out, text[at:]])


def drop_repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without the passages that an earlier document has, in the same columns.

    ``n_chars``, where there is such a column, follows the text. A document of which no word is left goes; documents
    without repeated passages stay untouched, also those without words.
    """
    columns = docs.columns
    found, was_cut = fresh("spans", columns), fresh("cut", columns)
    spans = repeated_passages(docs, min_words).groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "end")).alias(found)
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256))
        for batch in parts:
            texts = batch["text"].to_pylist()
            for i, spans in enumerate(batch[found].to_pylist()):
                if spans:
                    texts[i] = cut_out(texts[i], [(s["start"], s["end"]) for s in spans])
            at = batch.schema.get_field_index("text")
            kept = [batch.column(c) for c in columns]
            kept[columns.index("text")] = pa.array(texts, batch.schema.field(at).type)
            cut_here = pa.array([s is not None for s in batch[found].to_pylist()])
            yield pa.RecordBatch.from_arrays([*kept, cut_here], [*columns, was_cut])

    joined = docs.join(spans.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)), "doc_id", "left")
    schema = T.StructType([*docs.schema.fields, T.StructField(was_cut, T.BooleanType())])
    out = joined.select(*columns, found).mapInArrow(cut, schema)
    out = out.where(~F.col(was_cut) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(was_cut), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*columns)
