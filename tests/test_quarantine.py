"""Rows that cannot be read, and the place of rows in their files."""

from __future__ import annotations

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from salesledger import schema as S
from salesledger.operators import payments, validate
from salesledger.plans import jobs
from salesledger.plans.staging import Staging
from salesledger.sources.quarantine import check_cells, check_sales, check_transactions, read_text_cells
from salesledger.sources.rows import numbered
from salesledger.sources.intermediate import read_intermediate
from test_sources import SALES_HEADER, TRANSACTIONS_HEADER, till  # noqa: F401

GOOD = '"24.03.2023, 12:32",Verkauf,T1,MC,1, foo ,Alkoholfrei,,CHF,16.00,0.00,16.00,,0.00,,a@b.ch'


def sales_file(tmp_path, *lines, name="sales.csv"):
    (tmp_path / name).write_text("\n".join([SALES_HEADER, *lines]) + "\n")
    return str(tmp_path / name)


@pytest.mark.parametrize("staged", [False, True])
def test_good_and_rejected_rows(spark, tmp_path, staged):
    path = sales_file(
        tmp_path,
        GOOD,
        GOOD.replace(",1,", ",one,"),
        GOOD + ",more",
        GOOD.replace("24.03", "31.02"),
        GOOD.rsplit(",", 2)[0],
        GOOD.replace("16.00,0.00", "1'600.00,free"),
        GOOD.replace("24.03.2023, 12:32", "no date"),
        GOOD.replace(" foo ", '""quoted"", text') .replace(',""quoted', ',"""quoted').replace("text,", 'text",'),
    )
    out = check_sales(spark, path, Staging(spark) if staged else None)
    got = rows_of(out.rejected.orderBy("row", "column"), "row", "rule", "column", "value")
    assert got == [
        (3, "unreadable_cell", "Menge", "one"),
        (4, "malformed_row", None, None),
        (5, "unreadable_cell", "Datum", "31.02.2023, 12:32"),
        (6, "malformed_row", None, None),
        (7, "unreadable_cell", "Preis vor Rabatt", "1'600.00"),
        (7, "unreadable_cell", "Rabatt", "free"),
    ]
    texts = {r.row: r.text for r in out.rejected.collect()}
    assert texts[4] == GOOD + ",more" and ",one," in texts[3] and "31.02.2023" in texts[5]
    assert all(r.file.endswith("/sales.csv") for r in out.rejected.collect())
    good = out.rows.orderBy("row")
    assert good.columns == ["file", "row", *S.SALES.names]
    assert rows_of(good, "row", "description", "price_net") == [(2, " foo ", 16.0), (8, " foo ", 16.0), (9, '"quoted", text', 16.0)]


def test_rows_are_numbered_over_many_stretches_of_many_files(spark, tmp_path):
    for k, n in enumerate((500, 1, 0, 333)):
        (tmp_path / f"f{k}.txt").write_text("".join(f"{k}:{i}\n" for i in range(n)))
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        raw = spark.read.text(str(tmp_path))
        assert raw.rdd.getNumPartitions() >= 8
        for out in (numbered(raw), numbered(raw, stage=Staging(spark))):
            rows = out.collect()
            assert len(rows) == 834
            for r in rows:
                k, i = r.value.split(":")
                assert r.file.endswith(f"f{k}.txt") and r.row == int(i) + 1
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_last_change_of_shift_by_row(spark, tmp_path):
    line = "2023-03-24 {},S{},Umsatz,Erfolgreich,SCHICHTWECHSEL,0.01,0.00,0.00,0.01"
    (tmp_path / "t.csv").write_text("\n".join([TRANSACTIONS_HEADER, line.format("15:00:00", 1), line.format("14:00:00", 2)]))
    rows = check_transactions(spark, str(tmp_path / "t.csv")).rows
    assert rows_of(payments.shift_changes(rows), "shift_change") == [("15:00:00",)]
    assert rows_of(payments.shift_changes(rows, F.struct("file", "row")), "shift_change") == [("14:00:00",)]


def test_prepare_job_with_unreadable_rows(spark, till, tmp_path):  # noqa: F811
    sales, booked = till
    with open(sales, "a") as file:
        file.write("\n" + GOOD.replace("T1", "T9").replace(",1,", ",one,"))
    store = str(tmp_path / "store")
    with pytest.raises(jobs.BookkeepingError, match="(?s)unreadable rows in the sales report.*sales_202303.csv.*'row': 6.*Menge"):
        jobs.run_prepare(spark, sales, booked, store)
    stored = spark.read.parquet(f"{store}_violations/unreadable_sales")
    assert rows_of(stored, "row", "value") == [(6, "one")]
    jobs.run_prepare(spark, sales, booked, store, quarantine=str(tmp_path / "apart"))
    assert read_intermediate(spark, store).count() == 5
    assert spark.read.parquet(str(tmp_path / "apart/sales")).count() == 1
    assert spark.read.parquet(str(tmp_path / "apart/transactions")).count() == 0


def cells_file(tmp_path, *rows):
    names = list(S.INTERMEDIATE_COLUMNS)
    lines = [",".join(names), *[",".join(row.get(n, "") for n in names) for row in rows]]
    (tmp_path / "edited.csv").write_text("\n".join(lines))
    return str(tmp_path / "edited.csv")


CELLS = {
    "Date": "45009", "Time": "0.5", "Type": "Sales", "Transaction ID": "T1", "Payment Method": "Card", "Quantity": "1",
    "Description": "Kaffee", "Price (Gross)": "3.50", "Price (Net)": "3.50", "Commission": "0.05", "Topic": "MiTi", "Owner": "LoLa",
    "Purpose": "Consumption",
}


def test_cells_and_violations_name_their_rows(spark, tmp_path):
    path = cells_file(tmp_path, CELLS, {**CELLS, "Topic": "Miti"}, {**CELLS, "Price (Net)": "3,5.0"}, {**CELLS, "Time": "noon", "Owner": " "})
    found = check_cells(spark, path)
    assert rows_of(found.rejected.orderBy("row"), "row", "rule", "column", "value") == [(4, "malformed_row", None, None), (5, "unreadable_cell", "Time", "noon")]
    bad = validate.violations(found.rows).orderBy("row", "rule")
    assert rows_of(bad, "row", "rule") == [(3, "invalid_topic"), (3, "owner_not_allowed"), (5, "miti_without_owner")]
    store = str(tmp_path / "store")
    with pytest.raises(jobs.BookkeepingError, match="malformed rows"):
        jobs.run_reread(spark, path, store)
    extra = found.rows.drop("file", "row").where("time IS NULL")
    jobs.run_reread(spark, path, store, extra, quarantine=str(tmp_path / "apart"))
    assert spark.read.parquet(str(tmp_path / "apart")).count() == 2
    with pytest.raises(jobs.BookkeepingError) as error:
        jobs.run_export(spark, store, str(tmp_path / "out"))
    assert "edited.csv', 'row': 3" in str(error.value) and "'row': None" in str(error.value)
    assert read_intermediate(spark, store).columns == S.STORED_INTERMEDIATE.names


def test_rows_are_numbered_without_a_shuffle_of_them(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        sales_file(tmp_path, GOOD, GOOD.replace(",1,", ",one,"), name=name)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = check_sales(spark, str(tmp_path)).rows
        text = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in text and "array_compact" not in text
    assert [r.row for r in rows.collect()] == [2, 2]


def test_rows_counted_without_their_cells_keep_their_numbers(spark, tmp_path):
    """Of the two times that files are read the first only counts: malformed rows, empty lines and many stretches of a file."""
    lines = [GOOD, GOOD + ",more", "", GOOD.rsplit(",", 2)[0], "  ", *[GOOD.replace(",1,", f",{n},") for n in range(40)]]
    for name in ("a.csv", "b.csv"):
        sales_file(tmp_path, *lines, name=name)
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        found = check_sales(spark, str(tmp_path))
        got = rows_of(found.rows, "file", "row", "quantity")
        malformed = rows_of(found.rejected, "row", "rule")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    for name in ("a.csv", "b.csv"):
        own = sorted((row, quantity) for file, row, quantity in got if file.endswith(name))
        assert own == [(2, 1), *[(n + 5, n) for n in range(40)]]
    assert sorted(malformed) == [(3, "malformed_row")] * 2 + [(4, "malformed_row")] * 2


def test_files_of_other_columns_are_an_error(spark, tmp_path):
    sales_file(tmp_path, GOOD, name="a.csv")
    (tmp_path / "b.csv").write_text(SALES_HEADER.replace("Menge", "Anzahl") + "\n" + GOOD + "\n")
    with pytest.raises(Exception, match="header|Header"):
        read_text_cells(spark, str(tmp_path)).collect()
