"""Connected components by alternating large and small stars, each round a shuffle of the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesledger.llm.staging import staged


def _least(links: DataFrame) -> DataFrame:
    """Links (a, b) with the least neighbour or self of a as ``low``.

    The least is aggregated before the shuffle, and the join back is one that Spark splits at a hub's partition.
    """
    low = links.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return links.join(low, "a")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _least(both).where("b > a").selectExpr("b AS a", "low AS b").where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.selectExpr("greatest(a, b) AS a", "least(a, b) AS b")
    met = _least(down)
    return met.select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """Nodes of ``links`` (a, b) that are not the least of their component, with that least node.

    Returns (node, component_id). The loop ends when a round changes nothing; only a count and a checksum reach the driver.
    """
    links = staged(links.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "links")
    before = None
    while True:
        seen = links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if seen == before or not seen[0]:
            return links.selectExpr("a AS node", "b AS component_id")
        before = seen
        links = staged(_small_star(_large_star(links)), "links")
