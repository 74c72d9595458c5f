"""Several sites in one call give the rows of one call per site."""

from __future__ import annotations

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from salesledger import schema as S
from salesledger.operators import payments, postings, reconcile, validate
from salesledger.operators.closing import account_balances, with_every_post
from salesledger.operators.redact import add_rows, apply_overrides
from salesledger.operators.skew import HASHED, hot_keys, spread_join
from salesledger.plans import export, jobs
from salesledger.plans.prepare import prepare
from salesledger.plans.staging import Staging
from salesledger.sources.intermediate import read_intermediate
from salesledger.sources.till_csv import read_sales
from test_scale import heavy_reports
from test_sources import SALES_HEADER, TRANSACTIONS_HEADER


def at(df, site):
    return df.select(F.lit(site).alias("site"), "*")


def same(one, other):
    assert one.exceptAll(other).count() == 0 and other.exceptAll(one).count() == 0


@pytest.fixture(scope="module")
def reports(spark):
    """Two sites with the same transaction numbers; the second lacks some lines and books at other times."""
    sales, booked = heavy_reports(spark)
    late = booked.where("transaction_id <> 'T7'").withColumn("booked_at", F.lit("2023-03-24 15:00:00"))
    shift = booked.limit(1).withColumns(
        {"booked_at": F.lit("2023-03-24 13:00:00"), "description": F.lit(S.SHIFT_CHANGE), "transaction_id": F.lit("S")}
    )
    stage = Staging(spark)
    return {"a": (stage(sales), stage(booked)), "b": (stage(sales.where("quantity = 1 AND price_net > 0")), stage(late.unionByName(shift)))}


@pytest.fixture(scope="module")
def both(reports):
    (sales, booked), (sales_b, booked_b) = reports["a"], reports["b"]
    return at(sales, "a").unionByName(at(sales_b, "b")), at(booked, "a").unionByName(at(booked_b, "b"))


def each(reports, build):
    first, second = (at(build(*reports[site]), site) for site in ("a", "b"))
    return first.unionByName(second)


def test_prepare_checks_and_reports(spark, reports, both):
    stage = Staging(spark)
    one = stage(prepare(*both))
    assert one.columns == ["site", *S.INTERMEDIATE.names]
    same(one, each(reports, prepare))
    same(prepare(*both, stage=stage), one)
    assert rows_of(one.groupBy("site", "topic").count().where("topic = 'MiTi'"), "site") == [("a",)]  # b is after its change of shift
    for check in (reconcile.reconcile, reconcile.missing_in_sales, reconcile.missing_in_transactions):
        same(check(*both), each(reports, check))
    assert reconcile.reconcile(*both).select("site").distinct().count() == 1
    same(payments.shift_changes(both[1]), each(reports, lambda s, t: payments.shift_changes(t)))

    single = {site: stage(prepare(*reports[site])) for site in ("a", "b")}
    union = lambda build: at(build(single["a"]), "a").unionByName(at(build(single["b"]), "b"))
    same(export.details_with_totals(one), union(export.details_with_totals))
    same(export.accounting(one), union(export.accounting))
    same(postings.ledger(export.accounting(one), one), union(lambda rows: postings.ledger(export.accounting(rows), rows)))
    same(validate.violations(one), union(validate.violations))


def test_a_missing_site_is_a_violation_and_mixed_tables_an_error(spark, reports, both):
    rows = prepare(*reports["a"]).limit(3)
    found = validate.violations(rows.select(F.lit(None).cast("string").alias("site"), "*"))
    assert found.where("rule = 'missing_site'").count() == 3
    with pytest.raises(ValueError, match="site"):
        prepare(both[0], reports["a"][1])
    with pytest.raises(ValueError, match="site"):
        add_rows(at(rows, "a"), rows)


def test_overrides_of_one_site(spark, both):
    rows = prepare(*both).where("description = 'Menü 1'")
    edits = spark.createDataFrame([("b", "Menü 1", "Verm", None, "Consumption", "x")], "site string, description string, topic string, owner string, purpose string, comment string")
    out = apply_overrides(rows, edits, on=("description",))
    assert sorted(r.site for r in out.where("topic = 'Verm'").select("site").distinct().collect()) == ["b"]
    everywhere = apply_overrides(rows, edits.drop("site"), on=("description",))
    assert everywhere.where("topic <> 'Verm'").count() == 0 and everywhere.columns == out.columns


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_spread_join_over_several_columns(spark, how, null_safe):
    key = "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 10 = 1 THEN NULL ELSE concat('k', id) END"
    left = spark.range(0, 30000, 1, 8).select(F.expr("concat('s', id % 2)").alias("site"), F.expr(key).alias("k"), F.lit("v").alias("v"))
    hot = hot_keys(left, ["site", "k"], min_rows=1000)
    assert hot.columns == [HASHED, "rows"] and hot.count() == 2
    right = left.select("site", "k").distinct().where("k IS NULL OR k = 'hot' OR length(k) <> 3").withColumn("n", F.length("k"))
    given = right.withColumnsRenamed({"site": "site_", "k": "k_"})
    equal = (lambda a, b: F.col(a).eqNullSafe(F.col(b))) if null_safe else (lambda a, b: F.col(a) == F.col(b))
    plain = left.join(given, [equal("site", "site_"), equal("k", "k_")], how)
    plain = plain.select(*[c for c in plain.columns if not c.endswith("_")]).groupBy("site", "k", "v").count()
    same(spread_join(left, right, ["site", "k"], how, null_safe=null_safe).groupBy("site", "k", "v").count(), plain)


def test_closing_has_every_post_at_every_site(spark, both):
    from salesledger.operators.closing import Budget

    journal = spark.createDataFrame(
        [("a", "2025-01-01", "x", "10100", "30100", 1000), ("b", "2025-05-16", "y", "36000", "30700", 200)],
        "site string, date string, description string, debit string, credit string, amount int",
    ).withColumns({"date": F.col("date").cast("date"), "amount": F.col("amount").cast(S.MONEY)})
    post = spark.createDataFrame([("p", "Ertrag", 1, -1), ("q", "Spenden", 2, 1)], S.POST)
    accounts = spark.createDataFrame([("p", 0, "30100"), ("p", 1, "30700"), ("q", 0, "36000")], S.POST_ACCOUNT)
    budget = Budget(post, accounts, spark.createDataFrame([], S.POST_BUDGET))
    full = with_every_post(journal, budget, "202512")
    assert rows_of(full.groupBy("site").count().orderBy("site")) == [("a", 3), ("b", 3)]
    balances = account_balances(full, "202512").orderBy("site", "account")
    assert rows_of(balances) == [("a", "30100", -1000.0), ("a", "36000", 0.0), ("b", "30100", 0.0), ("b", "30700", -200.0), ("b", "36000", 200.0)]


def test_jobs_over_two_sites(spark, tmp_path):
    for site, time in (("north", "12:40"), ("south", "17:00")):
        folder = tmp_path / f"site={site}"
        folder.mkdir()
        (folder / "sales_report_202303.csv").write_text(
            f'{SALES_HEADER}\n"24.03.2023, {time}",Verkauf,T1,MC,1,Kuchen,,,CHF,16.00,0.00,16.00,16.00,0.00,,a@b.ch'
        )
        (folder / "transaction_report_202303.csv").write_text(
            f"{TRANSACTIONS_HEADER}\n2023-03-24 {time}:00,T1,Umsatz,Erfolgreich,Kuchen,16.00,0.00,0.24,16.00"
        )
    pattern, store, out = "/site=([^/]+)/", str(tmp_path / "store"), str(tmp_path / "out")
    inputs = [f"{tmp_path}/site=*/{kind}_*.csv" for kind in ("sales_report", "transaction_report")]
    jobs.run_prepare(spark, *inputs, store, site_pattern=pattern)
    rows = read_intermediate(spark, store, sites=True)
    assert rows_of(rows.orderBy("site"), "site", "month", "topic") == [("north", "202303", "MiTi"), ("south", "202303", "Cafe")]
    pruned = rows.where("site = 'north'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(site" in pruned
    jobs.run_export(spark, store, out, sites=True)
    ledger = spark.read.parquet(f"{out}/banana/main").where("Beschreibung = 'SU Cafe Karte'")
    assert rows_of(ledger, "site", "`Betrag CHF`") == [("south", 16.0)]
    with pytest.raises(Exception, match="no site in the path"):
        read_sales(spark, inputs[0], site_pattern="/place=([^/]+)/").collect()
