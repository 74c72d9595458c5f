"""Heavy keys, and the shape of the plans."""

from __future__ import annotations

import re

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from salesledger import schema as S
from salesledger.operators import keyfigures, postings
from salesledger.operators.skew import LANES, ROWS_PER_SALT, SHARE, hot_keys, spread_join
from salesledger.plans import export
from salesledger.plans.prepare import prepare, transaction_facts
from salesledger.plans.staging import Staging
from verification import star


def skewed(spark, rows=30000):
    """A third of all rows share one key, and a tenth has none."""
    key = F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 10 = 1 THEN NULL ELSE concat('k', id) END")
    return spark.range(0, rows, 1, 8).select(key.alias("k"), F.lit("copy").alias("v"))


def test_hot_keys(spark):
    df = skewed(spark)
    assert rows_of(hot_keys(df, "k")) == [("hot", 10000)]
    assert hot_keys(df, "k", min_rows=10001).count() == 0
    assert hot_keys(df.where("k <> 'hot'"), "k").count() == 0
    assert hot_keys(df.where("1 = 0"), "k").count() == 0
    many = spark.range(2000).select((F.col("id") % 500).alias("k"))
    assert 0 < hot_keys(many, "k", min_rows=1).count() <= LANES * SHARE


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_join(spark, how):
    left = skewed(spark)
    right = left.select("k").distinct().select("k", F.length("k").alias("n")).where("k IS NULL OR n <> 3 OR k = 'hot'")
    plain = left.join(right, "k", how).groupBy("k", "v").count()
    spread = spread_join(left, right, "k", how).groupBy("k", "v").count()
    assert plain.exceptAll(spread).count() == 0 and spread.exceptAll(plain).count() == 0


def test_spread_join_null_safe(spark):
    left = skewed(spark)
    right = spark.createDataFrame([(None,), ("hot",)], "k string")
    kept = spread_join(left, right, "k", "left_anti", null_safe=True)
    assert kept.count() == left.where("k IS NOT NULL AND k <> 'hot'").count()


def test_heavy_key_is_spread_over_partitions(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        left = skewed(spark).repartition(32)
        right = left.where("k IS NOT NULL").select("k").distinct().withColumn("n", F.lit(1))
        joined = spread_join(left, right, "k", "left").where("k = 'hot'")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 10000 and max(sizes) < 0.3 * sum(sizes)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_a_key_is_repeated_as_often_as_its_rows_ask_for(spark):
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2000")
        left, right = skewed(spark), spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, n int")
        text = plan(spread_join(left, right, "k", "left"))
        found = hot_keys(left, "k").selectExpr(f"int(greatest(2, ceil(rows / {ROWS_PER_SALT})))").first()[0]
        assert "sequence(0, (_salts" in text and found == 10
        given = spread_join(left, right, "k", "left", spark.createDataFrame([("hot",), ("hot",)], "k string"))
        plain = left.join(right, "k", "left")
        assert given.exceptAll(plain).count() == 0 and given.count() == left.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_prepare_reads_staged_reports_twice_and_once(spark):
    stage = Staging(spark)
    sales, booked = (stage(df) for df in heavy_reports(spark))
    facts, hot = stage(transaction_facts(sales, booked)), stage(hot_keys(sales, "transaction_id"))
    text = prepare(sales, booked, hot, facts=facts)._jdf.queryExecution().optimizedPlan().toString()
    scans = prepare(sales, booked, hot, facts=facts)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in text
    number = {name: len(re.findall(rf"FileScan parquet [^\n]*{re.escape(f'{stage.path}/{i}')}\b", scans)) for i, name in enumerate(("sales", "booked", "facts"))}
    assert number["sales"] <= 2 and number["booked"] == 1 and number["facts"] <= 3
    stage.clear()


def test_ledger_from_stored_tables(spark):
    stage = Staging(spark)
    rows = stage(prepare(*heavy_reports(spark)))
    details = stage(export.details_with_totals(rows))
    made = export.reports(details, stage(postings.detail_rows(rows)))
    text = plan(made.ledger)
    assert f"{stage.path}/0" not in text and len(re.findall(rf"{re.escape(f'{stage.path}/1')}\b", text)) == 1
    stage.clear()


def heavy_reports(spark):
    """Sales in which one transaction has a third of all lines, all of them copies, and some have no id."""
    key = "CASE WHEN id % 3 = 0 THEN 'HOT' WHEN id % 30 = 1 THEN NULL ELSE concat('T', id div 2) END"
    sales = spark.range(0, 6000, 1, 8).selectExpr(
        "'24.03.2023, 12:32' AS sold_at", "'Verkauf' AS kind", f"{key} AS transaction_id", "'MC' AS payment",
        "1L AS quantity", "CASE WHEN id % 3 = 0 THEN 'Kaffee' ELSE concat('Menü ', id % 7) END AS description",
        "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS category", "'' AS sku", "'CHF' AS currency",
        *[f"CAST(5 AS DECIMAL(18, 2)) AS {c}" for c in ("list_price", "discount", "price_gross", "price_net", "tax")],
        "'' AS tax_rate", "'a@b.ch' AS account",
    )
    booked = sales.where("transaction_id IS NOT NULL").select("transaction_id").distinct().selectExpr(
        "'2023-03-24 12:32:00' AS booked_at", "transaction_id", "'Umsatz' AS kind", "'Erfolgreich' AS status",
        "'x' AS description", "CAST(CASE WHEN transaction_id = 'HOT' THEN 10000 ELSE 10 END AS DECIMAL(18, 2)) AS amount",
        "CAST(1 AS DECIMAL(18, 2)) AS tip", "CAST(0.3 AS DECIMAL(18, 2)) AS fee",
        "CAST(NULL AS DECIMAL(18, 2)) AS net",
    )
    return sales, booked


def test_prepare_with_a_heavy_transaction(spark):
    sales, booked = heavy_reports(spark)
    out = Staging(spark)(prepare(sales, booked, hot_keys(sales, "transaction_id", min_rows=1000)))
    lines = out.where("purpose = 'Consumption'")
    assert lines.count() == sales.count()
    assert lines.where("transaction_id = 'HOT'").count() == 2000
    tips = out.where("purpose = 'Tip'").groupBy("transaction_id").count()
    headers = sales.where("transaction_id IS NOT NULL").select("transaction_id", "category").distinct()
    expected = headers.groupBy("transaction_id").count()
    assert tips.exceptAll(expected).count() == 0 and expected.exceptAll(tips).count() == 0
    assert out.where("transaction_id IS NULL AND commission IS NOT NULL").count() == 0
    shares = out.where("transaction_id <> 'HOT' AND purpose = 'Consumption'").select("commission").distinct()
    assert rows_of(shares) == [(0.15,)]
    given = spark.createDataFrame([("HOT",), ("T1",)], "transaction_id string")
    named = prepare(sales, booked, given)
    assert named.exceptAll(out).count() == 0 and out.exceptAll(named).count() == 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_reports_scan_once_and_shuffle_sums_only(spark):
    sales, booked = heavy_reports(spark)
    rows = Staging(spark)(prepare(sales, booked))
    text = plan(export.details_with_totals(rows))
    assert text.count("FileScan parquet") == 1
    assert text.count("Exchange hashpartitioning") == 3
    assert re.search(r"PushedFilters: \[IsNotNull\(date\)\]", text)
    assert "account" not in re.search(r"ReadSchema: (.*)", text).group(1)
    sums = keyfigures.label_sums(rows)
    assert sums.count() <= rows.select("date").distinct().count() * 9 * 4 * 3 * 3 * 16


def test_no_cross_join_no_window_no_python(spark):
    sales, booked = heavy_reports(spark)
    rows = Staging(spark)(prepare(sales, booked))
    made = export.reports(export.details_with_totals(rows), rows)
    for df in (prepare(sales, booked), made.details, made.partner, made.accounting, made.ledger):
        text = plan(df)
        for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Window [", "BatchEvalPython", "ArrowEvalPython"):
            assert node not in text
    assert S.INTERMEDIATE.names == prepare(sales, booked).columns


def test_facts_meet_the_lines_hashed(spark):
    sales, booked = heavy_reports(spark)
    facts, hot = Staging(spark)(transaction_facts(sales, booked)), Staging(spark)(hot_keys(sales, "transaction_id"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(prepare(sales, booked, hot, facts=facts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "ShuffledHashJoin [transaction_id" in text


def test_spread_join_hashed_equals_join(spark):
    left = skewed(spark)
    right = left.select("k").distinct().select("k", F.length("k").alias("n")).where("k IS NULL OR n <> 3 OR k = 'hot'")
    for how in ("inner", "left"):
        plain = left.join(right, "k", how).groupBy("k", "v").count()
        spread = spread_join(left, right, "k", how, hashed=True).groupBy("k", "v").count()
        assert plain.exceptAll(spread).count() == 0 and spread.exceptAll(plain).count() == 0


def test_items_meet_their_parts_before_the_texts_of_their_orders(spark):
    plan = star.sales(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 2 and "l_orderkey" in joins[0] and "l_partkey" in joins[1]
