"""Mixing sources to target weights: whole epochs first, then a weighted sample without replacement.

Sources get weights 3, 1, 2 in turn by name and share 150% of all words in proportion, none more than twice its own size.
A source's documents are all taken as often as its target holds its size whole. The rest of the target is filled by
Efraimidis-Spirakis sampling: each document draws the key -ln(u) / quality, documents are taken by ascending
key until their sizes reach the budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesledger.llm.columns import fresh
from salesledger.llm.staging import staged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BINS = 1024
"""Ranges of keys that a source is cut into; sizes are summed by range, documents ordered only inside one range."""

_WORD = r"[^\\x20\\x09-\\x0D]+"


def target_sql(sources: str, total: str, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> str:
    """SQL of the targets from a table (source, source_size), one row per source; ``total`` is a table name for use inside.

    A source gets the lesser of its cap and a common level times its weight; repeated resharing of the excess ends at the level
    where these add up to the total. In order of cap / weight, holding the sources before one at their caps and sharing the
    rest among the others by weight gives a level that is never above the right one, and reaches it at the right place:
    the level is the greatest of these.
    """
    turn = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return f"""
    SELECT source, source_size, CASE WHEN cap <= level * weight THEN cap ELSE level * weight END AS target
    FROM (SELECT *, max(candidate) OVER () AS level
          FROM (SELECT *, ({share} * sum(source_size) OVER () - ((sum(cap) OVER up) - cap))
                          / (sum(weight) OVER () - ((sum(weight) OVER up) - weight)) AS candidate
                FROM (SELECT *, {most} * source_size AS cap
                      FROM (SELECT source, CAST(source_size AS DOUBLE) AS source_size,
                                   CAST(CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(weights)}
                                        {turn} END AS DOUBLE) AS weight
                            FROM {sources}) AS {total}_w) AS {total}_c
                WINDOW up AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)) AS {total}_l) AS {total}_t"""


def mixed(docs: DataFrame, quality: DataFrame | None = None, seed: str = "mix") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, epochs, sampled, taken.

    ``size`` counts the words of the text (none if null), ``epochs`` how often the whole source is taken, ``sampled`` whether
    the document is in the fractional part, ``taken`` the words that this gives. ``quality`` (doc_id, weight) makes
    documents of larger weight likelier to be sampled; missing weights are 1, and a weight of 0 or less counts as very small. The
    document at which the budget is reached is taken where that comes nearer to the target, so a source misses its target
    by half of one document at most. Draws depend on seed and doc_id: reruns agree, and rows that repeat a doc_id draw
    alike. Null is a source of its own, the last. Documents without words take part with size 0.
    """
    sized = docs.selectExpr(
        "doc_id", "CAST(source AS STRING) AS source", f"CAST(regexp_count(coalesce(CAST(text AS STRING), ''), '{_WORD}') AS BIGINT) AS size"
    )
    if quality is None:
        sized = sized.withColumn("weight", F.lit(1.0))
    else:
        weights = quality.groupBy("doc_id").agg(F.max(F.col("weight").cast("double")).alias("weight"))
        sized = sized.join(weights, "doc_id", "left")
    # 52 bits of the digest, moved off 0, as a draw from (0, 1); DuckDB's SQL can state the same.
    draw = f"(CAST(conv(substring(md5(concat('{seed}', coalesce(CAST(doc_id AS STRING), ''))), 1, 13), 16, 10) AS DOUBLE) + 0.5) / 4503599627370496D"
    keyed = sized.selectExpr(
        "doc_id", "source", "size", f"-ln({draw}) / greatest(coalesce(weight, 1D), 1e-9D) AS key"
    ).selectExpr("*", f"CAST({BINS} * (1 - exp(-key)) AS INT) AS bin")
    keyed = staged(keyed, "keyed")

    bins = staged(keyed.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "bins")
    totals = bins.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    spark = docs.sparkSession
    targets = spark.sql(target_sql("{sources}", "x"), sources=totals)
    targets = targets.selectExpr(
        "source", "source_size", "target",
        "CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INT) ELSE 0 END AS epochs",
    ).selectExpr("*", "target - epochs * source_size AS budget")
    # Sums before each range; at most BINS rows of a source meet here.
    ranges = bins.selectExpr(
        "source", "bin", "sum(bin_size) OVER (PARTITION BY source ORDER BY bin) - bin_size AS before"
    )
    plan = ranges.withColumnsRenamed({"source": "_source", "bin": "_bin"}).join(
        targets.withColumnRenamed("source", "_of"), F.expr("_source <=> _of")
    )
    met = keyed.join(plan, F.expr("source <=> _source AND bin = _bin"))
    summed = met.withColumn(
        "start",
        F.expr(
            "before + sum(size) OVER (PARTITION BY source, bin ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size"
        ),
    )
    return summed.withColumn("sampled", F.expr("size > 0 AND start + size / 2 <= budget AND start < budget")).selectExpr(
        "doc_id", "source", "size", "CAST(source_size AS BIGINT) AS source_size", "target", "epochs", "sampled",
        "size * (epochs + int(sampled)) AS taken",
    )


def label_weights(labels: DataFrame) -> DataFrame:
    """Sampling weights from quality labels: good documents 2, others 0.5; what has no label keeps 1."""
    good = F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0)
    return labels.where("doc_id IS NOT NULL").select("doc_id", good.alias("weight"))


def mix(docs: DataFrame, quality: DataFrame | None = None, seed: str = "mix") -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken.

    Documents that are not taken are left out, documents without words come once per epoch of their source.
    """
    often, copy = fresh("copies", docs.columns), fresh("copy", docs.columns)
    copies = mixed(docs, quality, seed).selectExpr("doc_id", f"epochs + int(sampled) AS {often}")
    copies = copies.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(often).alias(often))
    joined = docs.join(copies, "doc_id", "left")
    often = joined.where(f"coalesce({often}, 1) > 0").selectExpr(
        *[f"`{c}`" for c in docs.columns], f"explode(sequence(1, coalesce({often}, 1))) AS {copy}"
    )
    return often.select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle_sql() -> str:
    """The query's columns in DuckDB's SQL, by running sums over whole sources."""
    draw = "(CAST(('0x' || substr(md5(concat('mix', CAST(doc_id AS VARCHAR))), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496"
    words = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
    return f"""
    WITH q AS (SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5 ELSE 1 END) AS w FROM labels GROUP BY doc_id),
    k AS (SELECT d.doc_id, source, CAST({words} AS BIGINT) AS size, -ln({draw.replace('doc_id', 'd.doc_id')}) / coalesce(w, 1) AS key
          FROM documents AS d LEFT JOIN q ON d.doc_id = q.doc_id),
    s AS (SELECT source, sum(size) AS source_size FROM k GROUP BY source),
    t AS ({target_sql("s", "x")}),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
    p AS (SELECT k.*, source_size, target, epochs, target - epochs * source_size AS budget,
                 sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
          FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
    SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
           CAST(size * (epochs + CASE WHEN size > 0 AND start + size / 2 <= budget AND start < budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM p"""
