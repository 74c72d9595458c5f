"""Near-duplicate documents by b-bit MinHash.

1. Each text becomes its set of 5-word shingles, 256 minima of it, 48 bands of 5 minima, and a signature that keeps
   the low 2 bits of every minimum, packed into 8 longs. Texts with one shingle set form a class, seen from here on
   as its smallest doc_id.
2. In every band bucket the members meet the most central of them. The signatures' equal lanes, counted by bit operations
   and corrected for chance equality, estimate the similarity; a pair well below the threshold goes. The others are
   confirmed on the full sets, and the confirmed links give components.
3. Buckets whose members are still in different components are searched whole: members outside the bucket's main
   component meet all others in blocks. Pairs within a component need no link, so nothing is lost and a large group of
   near copies costs one link per member.

Chances: a pair at similarity 0.75 shares a band with 1 - (1 - 0.75**5)**48 > 0.999997 and passes the estimate, 5.5
standard deviations below the threshold, with 1 - 2e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesledger.llm.components import components
from salesledger.llm.hashing import mixed, shingle_set, word_hashes
from salesledger.llm.staging import staged

SHINGLE = 5
PERCENT = 75
HASHES, BANDS, ROWS = 256, 48, 5
BITS = 2
BLOCK, BLOCK_SHINGLES = 256, 1_000_000
"""Members of a group, and their shingles, that step 3 compares at once."""

_CHANCE = 2.0**-BITS
_EVEN = 0x5555555555555555
_rng = np.random.default_rng(5)
_FACTORS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def minima(shingles: np.ndarray) -> np.ndarray:
    """Least value of the set under each of the hash functions."""
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(values), 512):
        least = np.minimum(least, (values[at : at + 512, None] * _FACTORS + _SHIFTS).min(axis=0))
    return least


def signature(least: np.ndarray) -> np.ndarray:
    """The low bits of the mixed minima, 32 lanes to a long."""
    lanes = (mixed(least.astype(np.uint64) + np.uint64(1)) & np.uint64(3)).reshape(-1, 32)
    return np.bitwise_or.reduce(lanes << np.arange(0, 64, 2, dtype=np.uint64), axis=1)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in rows.T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys


_SIGNED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_shingles", pa.int64()),
        ("set_a", pa.int64()),
        ("set_b", pa.int64()),
        ("sig", pa.list_(pa.int64())),
        ("bands", pa.list_(pa.int64())),
    ]
)


def _fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set: two sums of differently mixed members."""
    one = np.add.reduce(mixed(shingles ^ np.uint64(0xA5A5A5A5)))
    two = np.add.reduce(mixed(shingles * np.uint64(0xD6E8FEB86659FD93)))
    return int(one.view(np.int64)), int(two.view(np.int64))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            rows = []
            for doc_id, words in zip(part["doc_id"].to_pylist(), word_hashes(part["text"].to_pylist())):
                shingles = shingle_set(words, SHINGLE)
                if len(shingles):
                    least = minima(shingles)
                    sig, bands = signature(least).view(np.int64), band_keys(least).view(np.int64)
                    rows.append((doc_id, len(shingles), *_fingerprint(shingles), sig, bands))
                else:
                    rows.append((doc_id, 0, 0, 0, None, None))
            columns = zip(*rows) if rows else [[]] * len(_SIGNED)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SIGNED)], schema=_SIGNED)


def estimate(left: str, right: str) -> str:
    """SQL of the similarity estimated from two signatures: equal lanes by bit count, less those equal by chance."""
    unequal = f"bit_count(((x ^ y) | shiftrightunsigned(x ^ y, 1)) & {_EVEN}L)"
    count = f"aggregate(zip_with({left}, {right}, (x, y) -> {unequal}), 0, (n, u) -> n + u)"
    return f"((1 - {count} / {HASHES}D) - {_CHANCE}) / {1 - _CHANCE}"


def _least_estimate(percent: int) -> float:
    """5.5 standard deviations of the estimate below the threshold."""
    p = _CHANCE + (1 - _CHANCE) * percent / 100
    return percent / 100 - 5.5 * (p * (1 - p) / HASHES) ** 0.5 / (1 - _CHANCE)


def _alike(percent: int, a: str, b: str) -> str:
    """SQL: two members may be linked, by their set sizes and signatures."""
    sizes = f"least({a}.n, {b}.n) * 100 >= greatest({a}.n, {b}.n) * {percent}"
    return f"{sizes} AND {estimate(f'{a}.sig', f'{b}.sig')} >= {_least_estimate(percent)}"


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough. Rows arrive by a, whose set is kept from row to row."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_id, kept = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids, others = part["a"].to_pylist(), part["b"].to_pylist()
                good: list[int] = []
                for i, words in enumerate(word_hashes(part["text_b"].to_pylist())):
                    if ids[i] != kept_id:
                        kept_id = ids[i]
                        kept = shingle_set(next(word_hashes([part["text_a"][i].as_py()])), SHINGLE)
                    shingles = shingle_set(words, SHINGLE)
                    common = len(np.intersect1d(kept, shingles, assume_unique=True))
                    if 100 * common >= percent * (len(kept) + len(shingles) - common):
                        good.append(i)
                yield pa.RecordBatch.from_pydict({"a": [ids[i] for i in good], "b": [others[i] for i in good]}, out)

    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    with_b = pairs.join(texts.selectExpr("doc_id AS b", "text AS text_b"), "b")
    both = with_b.join(texts.selectExpr("doc_id AS a", "text AS text_a"), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def _few(rest: DataFrame, tried: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links from the outside of small groups: outsiders meet one row that holds the group."""
    groups = rest.groupBy("main").agg(F.collect_list("m").alias("ys"))
    near = f"e.label <> m.label AND (e.label = main OR e.id < m.id) AND {_alike(percent, 'e', 'm')}"
    met = rest.where("outside").join(groups, "main").selectExpr("m.id AS x", f"explode(filter(ys, e -> {near})) AS e")
    pairs = met.selectExpr("least(x, e.id) AS a", "greatest(x, e.id) AS b").distinct()
    return _confirmed(pairs.join(tried, ["a", "b"], "left_anti"), texts, percent)


def _crowd(rest: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links from the outside of large groups: blocks of outsiders meet blocks of members, compared inside the task.

    Only confirmed pairs leave a task. Signatures are compared first, then the sets of the block by one lookup per
    outsider.
    """
    floor = _least_estimate(percent)

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        x, y = _block(left), _block(right)
        sets = list(x["sets"]), list(y["sets"])
        every = np.concatenate(sets[1])
        owner = np.repeat(np.arange(len(sets[1])), [len(s) for s in sets[1]])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        sizes = np.array([len(s) for s in sets[1]])
        found: list[tuple[int, int]] = []
        for i, shingles in enumerate(sets[0]):
            delta = x["sig"][i] ^ y["sig"]
            unequal = np.bitwise_count((delta | (delta >> np.uint64(1))) & np.uint64(_EVEN)).sum(axis=1)
            close = ((1 - unequal / HASHES) - _CHANCE) / (1 - _CHANCE) >= floor
            close &= (y["label"] != x["label"][i]) & ((y["label"] == y["main"]) | (y["id"] < x["id"][i]))
            if not close.any():
                continue
            starts, ends = np.searchsorted(every, shingles, "left"), np.searchsorted(every, shingles, "right")
            runs = ends - starts
            at = np.repeat(starts - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
            common = np.bincount(owner[at], minlength=len(sizes))
            good = close & (100 * common >= percent * (len(shingles) + sizes - common))
            found += [tuple(sorted((int(x["id"][i]), int(j)))) for j in y["id"][good]]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    known = rest.join(texts.selectExpr("doc_id AS id", "text"), F.col("m.id") == F.col("id"))
    flat = known.selectExpr("main", "outside", "blocks", "fronts", "m.id AS id", "m.label AS label", "m.sig AS sig", "text")
    shown = ["main", "id", "label", "sig", "text"]
    left = flat.where("outside").selectExpr(
        *shown, "pmod(xxhash64(id), fronts) AS front", "explode(sequence(0, blocks - 1)) AS block"
    )
    right = flat.where("fronts > 0").selectExpr(
        *shown, "pmod(xxhash64(id), blocks) AS block", "explode(sequence(0, fronts - 1)) AS front"
    )
    by = ["main", "front", "block"]
    # Fresh column names on either side, as both come from one table.
    left, right = (
        side.select(*[F.col(c).cast("long").alias(c) if c in by else F.col(c).alias(c) for c in side.columns])
        for side in (left, right)
    )
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(check, "a long, b long")


def _block(table: pa.Table) -> dict:
    """Columns of a block as arrays, its texts as shingle sets."""
    sig = np.array(table["sig"].to_pylist(), np.int64).view(np.uint64)
    ids, labels, main = (table[c].to_numpy() for c in ("id", "label", "main"))
    sets = (shingle_set(words, SHINGLE) for words in word_hashes(table["text"].to_pylist()))
    return {"id": ids, "label": labels, "main": main, "sig": sig, "sets": sets}


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable over links), kept.

    Documents are linked when their shingle sets have 100 * intersection >= percent * union. Texts that are null, empty
    or only white space have no shingles and stand alone. A repeated doc_id is taken as one document per row; equal
    rows are one class. A row without doc_id cannot be named, so it stays alone and is kept. Other columns are not read. An empty
    table gives no rows.
    """
    texts = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    signed = staged(
        texts.mapInArrow(
            _sign, "doc_id long, n_shingles long, set_a long, set_b long, sig array<long>, bands array<long>"
        ),
        "signed",
    )
    named = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("class_id"))
    member = staged(
        named.join(classes, ["set_a", "set_b", "n_shingles"]).select("doc_id", "n_shingles", "class_id"), "member"
    )
    rep_ids = member.where("doc_id = class_id").select("doc_id", "n_shingles").distinct()
    reps = staged(
        signed.join(rep_ids, ["doc_id", "n_shingles"]).dropDuplicates(["doc_id"])
        .selectExpr("doc_id AS id", "n_shingles AS n", "sig", "bands"),
        "reps",
    )
    info = reps.select("id", F.struct("n", "sig").alias("info"))

    bucket = reps.select("id", F.explode("bands").alias("band"))
    sizes = bucket.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    crowded = staged(bucket.join(sizes, "band"), "crowded")
    # Who shares many bands with many is the likeliest to be close to all of a bucket: the text that others vary.
    central = crowded.groupBy("id").agg(F.sum("size").alias("rank"))
    ranked = crowded.join(central, "id")
    first = ranked.groupBy("band").agg(F.expr("max_by(id, struct(rank, -id)) AS pivot"))
    shared = staged(crowded.join(first, "band"), "shared")
    # The texts of those that meet anyone are moved once; what compares them later moves only these.
    meeting = crowded.selectExpr("id AS doc_id").distinct()
    rep_texts = staged(
        texts.where("text IS NOT NULL").join(meeting, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts"
    )
    tried = staged(
        shared.where("id <> pivot").selectExpr("least(id, pivot) AS a", "greatest(id, pivot) AS b").distinct(), "tried"
    )
    met = tried.join(info.selectExpr("id AS a", "info AS ia"), "a").join(info.selectExpr("id AS b", "info AS ib"), "b")
    close = met.where(_alike(percent, "ia", "ib")).select("a", "b")
    links = staged(_confirmed(close, rep_texts, percent), "confirmed")
    label = staged(components(links), "label")

    # Step 3: buckets that still hold several components.
    labelled = staged(
        shared.where("size > 2").join(label.withColumnRenamed("node", "id"), "id", "left")
        .selectExpr("band", "id", "coalesce(component_id, id) AS label"),
        "labelled",
    )
    parts = labelled.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    mains = parts.groupBy("band").agg(F.expr("max_by(label, struct(n, label)) AS main"), F.count(F.lit(1)).alias("k"))
    rest = labelled.join(mains.where("k > 1"), "band").select("main", "id", "label").distinct().join(info, "id")
    rest = staged(rest.selectExpr("main", "label <> main AS outside", "struct(id, label, info.*) AS m"), "rest")
    sizes = rest.groupBy("main").agg(
        F.expr(f"int(ceil(greatest(count(1) / {BLOCK}, sum(m.n) / {BLOCK_SHINGLES}))) AS blocks"),
        F.expr(f"int(ceil(greatest(sum(int(outside)) / {BLOCK}, sum(if(outside, m.n, 0)) / {BLOCK_SHINGLES}))) AS fronts"),
    )
    rest = staged(rest.join(sizes, "main"), "sized")
    more = _few(rest.where("blocks = 1"), tried, rep_texts, percent).unionByName(
        _crowd(rest.where("blocks > 1"), rep_texts, percent)
    )
    more = staged(more, "confirmed")
    if not more.isEmpty():
        label = staged(components(label.selectExpr("node AS a", "component_id AS b").unionByName(more)), "label")

    of_doc = member.join(label.withColumnRenamed("node", "class_id"), "class_id", "left").selectExpr(
        "doc_id", "n_shingles", "coalesce(component_id, class_id) AS component_id"
    )
    alone = signed.where("n_shingles = 0 OR doc_id IS NULL").selectExpr("doc_id", "n_shingles", "doc_id AS component_id")
    return of_doc.unionByName(alone).withColumn("kept", F.expr("coalesce(doc_id = component_id, true)"))


def _repeats(texts: DataFrame) -> bool:
    """Whether a doc_id occurs twice."""
    return not texts.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").isEmpty()


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents kept by ``near_duplicates``, one of each group, with all their columns.

    Of rows that repeat the kept doc_id one stays. Documents without words or without doc_id stay.
    """
    verdict = near_duplicates(docs, percent)
    gone = verdict.where("NOT kept").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if not _repeats(docs.select("doc_id")):
        return kept
    named = kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    return named.unionByName(kept.where("doc_id IS NULL"))
