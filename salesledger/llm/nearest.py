"""Approximate nearest neighbours by an adaptive dimension scan inside inverted lists.

Vectors are scaled to length 1, so that the largest cosine is the least distance, and rotated at random, so that any first
columns are a fair sample of a distance. They are dealt to lists by their nearest centre. A query scans the lists of its
nearest centres: after each block of columns, a hypothesis test compares the distance so far, scaled to all columns, with
the query's current k-th best, and candidates that would hardly beat it are abandoned. Survivors get their whole
distance. Scores are computed again in double precision on the vectors as given.

Vectors that are equal once divided by their largest part have the same score with anything. They are one entry with its smallest
ids, so a very frequent vector costs no more than a rare one. Entries whose distances agree to 12 digits are taken by smallest id.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesledger.llm.staging import staged

SAMPLE = 16_384
"""Most vectors that centres are fitted to, those with the least hash of their id."""

PER_LIST, MOST_LISTS = 512, 1024
RECALL = 0.97
"""Share of the true neighbours within the sample whose lists are to be probed; sets the number of probes."""

COLUMNS = 16
CERTAINTY = 2.1
"""Standard errors by which the scaled distance must exceed the k-th best to abandon a candidate."""

DIGITS = 12
"""Digits after the point to which squared distances of unit vectors, computed in different ways, agree."""

BLOCK = 4096
"""Vectors, and queries, of a list that meet in one task at once."""


def rotation(dim: int) -> np.ndarray:
    """Random orthogonal matrix, the same for each dimension."""
    return np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))[0]


def centres(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centres of unit vectors by a few rounds of k-means; a centre without vectors stays."""
    rng = np.random.default_rng(1)
    at = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(part @ at.T).argmax(axis=1) for part in np.array_split(sample, len(sample) // 4096 + 1)])
        sums = np.zeros_like(at)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        at = np.where(norm > 0, sums / np.maximum(norm, 1e-30), at)
    return at


def probes_for(sample: np.ndarray, middle: np.ndarray, k: int, recall: float = RECALL, queries: int = 256) -> int:
    """Lists to probe so that ``recall`` of the true k nearest in the sample lie in them, by brute force over the sample.

    Neighbours are nearer in the whole table than in a sample of it, so their lists are no farther down.
    """
    asked = np.arange(0, len(sample), max(1, len(sample) // queries))
    cosine = sample[asked] @ sample.T
    cosine[np.arange(len(asked)), asked] = -2
    true = np.argpartition(-cosine, min(k, len(sample) - 1) - 1, axis=1)[:, :k]
    lists_of = (sample @ middle.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(sample[asked] @ middle.T), axis=1), axis=1)
    ranks = np.sort(np.take_along_axis(place, lists_of[true], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(recall * len(ranks)))]) + 1


def scan(query: np.ndarray, block: np.ndarray, k: int, columns: int = COLUMNS, certainty: float = CERTAINTY) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``block`` among the k nearest to ``query``, ties to the first rows, and their squared distances, by the adaptive scan."""
    dim = block.shape[1]
    found, far = np.zeros(0, np.int64), np.zeros(0)
    for at, end in itertools.pairwise([*range(0, min(len(block), 256), 64), *range(256, len(block), 2048), len(block)]):
        rows = np.arange(at, end)
        limit = far[k - 1] if len(far) >= k else np.inf
        part = np.zeros(len(rows))
        for d in range(0, dim, columns):
            part += ((block[rows, d : d + columns] - query[d : d + columns]) ** 2).sum(axis=1)
            seen = min(d + columns, dim)
            if seen < dim and limit < np.inf:
                alive = part * dim / seen <= limit * (1 + certainty / seen**0.5) ** 2 + 10.0**-DIGITS
                rows, part = rows[alive], part[alive]
                if not len(rows):
                    break
        found, far = np.concatenate([found, rows]), np.concatenate([far, part.round(DIGITS)])
        best = np.lexsort((found, far))[:k]
        found, far = found[best], far[best]
    return found, far


def _unit(vectors: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = pa.concat_arrays(vectors.chunks) if isinstance(vectors, pa.ChunkedArray) else vectors
    raw = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a finite vector other than zero, of the length that most vectors have: (id, vec)."""
    rows = vectors.selectExpr("CAST(vec_id AS BIGINT) AS id", "CAST(embedding AS ARRAY<DOUBLE>) AS vec").where(
        """id IS NOT NULL AND size(vec) > 0 AND exists(vec, x -> x <> 0)
           AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"""
    )
    dim = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return rows.where(F.size("vec") == (dim.dim if dim else 0))


def nearest(
    vectors: DataFrame, every: int = 50, k: int = 5, per_list: int = PER_LIST, most_lists: int = MOST_LISTS, recall: float = RECALL
) -> DataFrame:
    """The k nearest vectors found for each query: query_id, rank from 1, vec_id, score (cosine).

    Queries are the rows whose vec_id is divisible by ``every``, candidates all rows but the query's own; ties go to the
    smaller vec_id. Vectors that are null, zero, hold a null or a number that is not finite, or have another length than
    most take no part, nor do rows without vec_id. Rows that repeat an id with one vector count once. With fewer candidates
    than k all are returned: a query that finds fewer than k in its lists is searched again in all lists. Every vector is in the
    index; only the centres come from a sample.
    """
    spark = vectors.sparkSession
    # Each vector is divided by its largest part, so that squares stay finite and above zero.
    scaled = "transform(vec, x -> x / array_max(transform(vec, y -> abs(y))))"
    usable = staged(_usable(vectors).selectExpr("id", f"{scaled} AS vec").distinct(), "vectors")

    # The first k + 1 ids of an entry serve any query, its own id left out.
    by_vector = Window.partitionBy("vec").orderBy("id")
    first = usable.withColumn("_n", F.row_number().over(by_vector)).where(F.col("_n") <= k + 1)
    entries = first.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = staged(entries.selectExpr("vec", "ids", "xxhash64(vec) AS entry", "ids[0] AS first"), "entries")
    total = entries.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = entries.select(F.size("vec")).first()[0]
    sample = entries.orderBy(F.xxhash64("first"), "entry").limit(SAMPLE).select("vec").toArrow()
    turn = rotation(dim)
    lists = max(1, min(most_lists, total // per_list))
    turned = _unit(sample["vec"], dim) @ turn
    middle = centres(turned, lists)
    probes = min(len(middle), probes_for(turned, middle, k, recall))

    asks = usable.where(F.pmod("id", F.lit(every)) == 0).withColumnRenamed("id", "query_id")
    asks = staged(asks.join(entries.select("vec", "entry"), "vec").select("query_id", "entry"), "asks")

    def place(n: int):  # noqa: ANN202
        def run(batches):  # noqa: ANN001, ANN202
            for batch in batches:
                if not batch.num_rows:
                    continue
                turned = _unit(batch["vec"], dim) @ turn
                lists_of = np.argsort(-(turned @ middle.T), axis=1, kind="stable")[:, :n] if n > 1 else (turned @ middle.T).argmax(axis=1)[:, None]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(batch["entry"].to_numpy(), n)),
                        pa.array(np.repeat(batch["first"].to_numpy(), n)),
                        pa.array(lists_of.ravel().astype(np.int64)),
                        pa.array([row.tobytes() for row in np.repeat(turned, n, axis=0)], pa.binary()),
                    ],
                    ["entry", "first", "list", "vec"],
                )

        return run

    kinds = "entry long, first long, list long, vec binary"
    placed = staged(entries.select("entry", "first", "vec").mapInArrow(place(1), kinds), "placed")
    blocks = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))

    def search(queries: pa.Table, members: pa.Table) -> pa.Table:
        asked, near, firsts, far = [], [], [], []
        if queries.num_rows and members.num_rows:
            q, b = (
                np.frombuffer(b"".join(t["vec"].to_pylist()), np.float64).reshape(-1, dim) for t in (queries, members)
            )
            # Ties go to the first rows, so these are in the order of ids.
            order = np.argsort(members["first"].to_numpy(), kind="stable")
            b, names, ids = b[order], members["entry"].to_numpy()[order], members["first"].to_numpy()[order]
            for entry, vec in zip(queries["entry"].to_pylist(), q):
                rows, distances = scan(vec, b, k + 1)
                asked += [entry] * len(rows)
                near += names[rows].tolist()
                firsts += ids[rows].tolist()
                far += distances.tolist()
        return pa.table({"a": pa.array(asked, pa.int64()), "b": pa.array(near, pa.int64()), "first": pa.array(firsts, pa.int64()), "far": pa.array(far, pa.float64())})

    def found(asked: DataFrame, probes: int) -> DataFrame:
        """Pairs (a, b): the k + 1 nearest entries to each of ``asked`` in the lists of its nearest centres."""
        sought = entries.select("entry", "first", "vec").join(asked.select("entry").distinct(), "entry", "left_semi")
        sought = staged(sought.select("entry", "first", "vec").mapInArrow(place(probes), kinds), "sought")
        fronts = sought.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("fronts"))
        sizes = F.broadcast(blocks.join(fronts, "list"))  # one row per list, MOST_LISTS at most
        left = sought.join(sizes, "list").selectExpr(
            "list", "entry", "vec", "pmod(xxhash64(entry), fronts) AS front", "explode(sequence(0L, blocks - 1)) AS block"
        )
        right = placed.join(sizes, "list").selectExpr(
            "list", "entry", "first", "vec", "pmod(xxhash64(entry), blocks) AS block", "explode(sequence(0L, fronts - 1)) AS front"
        )
        by = ["list", "block", "front"]
        hits = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(search, "a long, b long, first long, far double")
        closest = Window.partitionBy("a").orderBy("far", "first", "b")
        kept = hits.withColumn("_n", F.row_number().over(closest)).where(F.col("_n") <= k + 1)
        return kept.select("a", "b")

    kept = staged(found(asks, probes), "kept")
    if probes < len(middle):
        # A query's own id is among those of its entries.
        reached = kept.join(entries.selectExpr("entry AS b", "size(ids) AS n"), "b").groupBy("a").agg(F.sum("n").alias("n"))
        enough = reached.where(F.col("n") > k).withColumnRenamed("a", "entry")
        short = staged(asks.join(enough, "entry", "left_anti"), "short")
        if not short.isEmpty():
            more = found(short, len(middle))
            kept = kept.join(short.selectExpr("entry AS a").distinct(), "a", "left_anti").unionByName(more)

    vec_a = entries.select(F.col("entry").alias("a"), F.col("vec").alias("va"))
    vec_b = entries.select(F.col("entry").alias("b"), F.col("vec").alias("vb"), "ids")
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    met = kept.join(vec_a, "a").join(vec_b, "b").select("a", "ids", "va", "vb")
    cosine = f"{dot.format('va', 'vb')} / (sqrt({dot.format('va', 'va')}) * sqrt({dot.format('vb', 'vb')}))"
    scored = met.selectExpr("a", f"{cosine} AS score", "explode(ids) AS vec_id")
    answers = asks.join(scored, asks.entry == scored.a).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
