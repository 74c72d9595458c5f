"""Budget definition: posts with their accounts and yearly amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesledger import schema as S
from salesledger.operators.closing import Budget

DEFINITION = """
    posts MAP<STRING, STRUCT<name: STRING, sort: INT, factor: INT, account_codes: ARRAY<STRING>>>,
    years MAP<STRING, STRUCT<amounts: MAP<STRING, DECIMAL(18, 2)>>>
"""


def read_budget(spark: SparkSession, path: str) -> Budget:
    """Budget from a JSON document with ``posts`` and ``years``."""
    definition = spark.read.schema(DEFINITION).option("multiLine", True).json(path)
    return budget_tables(definition)


def budget_tables(definition: DataFrame) -> Budget:
    posts = definition.select(F.explode("posts").alias("post_key", "post"))
    post = posts.select("post_key", "post.name", "post.sort", "post.factor")
    post_account = posts.select("post_key", F.posexplode("post.account_codes").alias("pos", "account"))
    years = definition.select(F.explode("years").alias("year", "entry"))
    post_budget = years.select("year", F.explode("entry.amounts").alias("post_key", "amount"))
    return Budget(
        post.select(S.POST.names), post_account.select(S.POST_ACCOUNT.names), post_budget.select(S.POST_BUDGET.names)
    )
