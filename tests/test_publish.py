"""Tables of a job appear together, and their files hold rows in whole order."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from conftest import frame, rows_of
from pyspark.sql import functions as F

from salesledger import schema as S
from salesledger.plans import jobs
from salesledger.plans.publish import publication, settle
from salesledger.sources import sinks
from salesledger.sources.intermediate import read_intermediate
from test_sources import SALES_HEADER, TRANSACTIONS_HEADER, till  # noqa: F401


def months(spark, *values: tuple[str, int]):
    return spark.createDataFrame(list(values), "month string, n long")


def write(df, path: str) -> None:
    df.write.partitionBy("month").parquet(path)


def read(spark, path: str) -> list[tuple]:
    return sorted(rows_of(spark.read.schema("n long, month string").parquet(path), "month", "n"))


def names(folder) -> list[str]:
    return sorted(path.name for path in Path(folder).iterdir())


def test_both_tables_or_none(spark, tmp_path):
    target = str(tmp_path / "out")
    with pytest.raises(RuntimeError), publication(spark, target) as run:
        write(months(spark, ("202303", 1)), f"{run}/a")
        raise RuntimeError("lost")
    assert names(tmp_path) == []
    with publication(spark, target) as run:
        write(months(spark, ("202303", 1)), f"{run}/a")
        write(months(spark, ("202303", 2)), f"{run}/b")
        assert not Path(target).exists()
    assert names(tmp_path) == ["out"] and names(target) == ["a", "b"]
    with pytest.raises(FileExistsError), publication(spark, target):
        raise AssertionError("no work is done for a target that exists")
    with pytest.raises(RuntimeError), publication(spark, target, "overwrite") as run:
        write(months(spark, ("202303", 9)), f"{run}/a")
        raise RuntimeError("lost")
    assert read(spark, f"{target}/a") == [("202303", 1)]
    with publication(spark, target, "overwrite") as run:
        write(months(spark, ("202304", 3)), f"{run}/a")
    assert names(tmp_path) == ["out"] and names(target) == ["a"] and read(spark, f"{target}/a") == [("202304", 3)]
    with pytest.raises(ValueError), publication(spark, target, "append"):
        raise AssertionError("unknown mode")


def test_months_replace_months_only(spark, tmp_path):
    target = str(tmp_path / "out")
    with publication(spark, target, "months") as run:
        write(months(spark, ("202303", 1), ("202304", 2)), f"{run}/a")
        write(months(spark, ("202303", 1), ("202304", 2)), f"{run}/b")
    before = names(f"{target}/a/month=202303")
    with publication(spark, target, "months") as run:
        write(months(spark, ("202304", 5), ("202305", 6)), f"{run}/a")
        write(months(spark, ("202305", 6)), f"{run}/b")
    assert names(f"{target}/a/month=202303") == before
    assert read(spark, f"{target}/a") == [("202303", 1), ("202304", 5), ("202305", 6)]
    # The second run has 202304, but no row of it in table b.
    assert read(spark, f"{target}/b") == [("202303", 1), ("202305", 6)]


@pytest.mark.parametrize("mode", ["overwrite", "months"])
def test_a_decided_run_is_completed_later(spark, tmp_path, monkeypatch, mode):
    target = str(tmp_path / "out")
    with publication(spark, target) as run:
        write(months(spark, ("202303", 1), ("202304", 2)), f"{run}/a")
    with monkeypatch.context() as patch:
        moved = []

        def stops(spark_, target_):
            if moved:
                raise KeyboardInterrupt
            moved.append(target_)

        patch.setattr("salesledger.plans.publish.settle", stops)
        with pytest.raises(KeyboardInterrupt), publication(spark, target, mode) as run:
            write(months(spark, ("202304", 7)), f"{run}/a")
    assert read(spark, f"{target}/a") == [("202303", 1), ("202304", 2)]
    settle(spark, target)
    settle(spark, target)
    kept = [("202303", 1)] if mode == "months" else []
    assert read(spark, f"{target}/a") == [*kept, ("202304", 7)] and names(tmp_path) == ["out"]


def test_export_leaves_the_old_reports_whole(spark, till, tmp_path, monkeypatch):  # noqa: F811
    store, out = str(tmp_path / "intermediate"), str(tmp_path / "reports")
    jobs.run_prepare(spark, *till, store)
    jobs.run_export(spark, store, out)
    files = sorted(str(p) for p in Path(out).rglob("*.parquet"))
    written = []

    def third_fails(*args, **kwargs):
        written.append(args)
        if len(written) == 3:
            raise RuntimeError("lost")
        return original(*args, **kwargs)

    original = sinks.write_report
    with monkeypatch.context() as patch:
        patch.setattr(sinks, "write_report", third_fails)
        with pytest.raises(RuntimeError, match="lost"):
            jobs.run_export(spark, store, out, mode="overwrite")
    assert sorted(str(p) for p in Path(out).rglob("*.parquet")) == files
    assert names(tmp_path) == sorted(["intermediate", "reports", *[Path(p).name for p in till]])


def test_one_month_again(spark, till, tmp_path):  # noqa: F811
    store = str(tmp_path / "intermediate")
    jobs.run_prepare(spark, *till, store)
    march = sorted(str(p) for p in Path(f"{store}/month=202303").iterdir())
    sales, booked = tmp_path / "again_sales.csv", tmp_path / "again_booked.csv"
    sales.write_text(f'{SALES_HEADER}\n"03.04.2023, 15:10",Verkauf,T4,Bar,1,Torte,,,CHF,4.00,0.00,4.00,4.00,0.00,,a@b.ch')
    booked.write_text(f"{TRANSACTIONS_HEADER}\n2023-04-03 15:10:00,T4,Umsatz,Erfolgreich,Torte,4.00,0.00,0.00,4.00")
    jobs.run_prepare(spark, str(sales), str(booked), store, mode="months")
    assert sorted(str(p) for p in Path(f"{store}/month=202303").iterdir()) == march
    april = read_intermediate(spark, store).where("month = '202304'")
    assert rows_of(april, "transaction_id", "description") == [("T4", "Torte")]


def test_files_of_a_month_are_in_whole_order(spark, tmp_path):
    n = 20_000
    made = spark.range(0, n, 1, 16).selectExpr(
        "DATE '2023-03-01' + CAST(pmod(xxhash64(id), 60) AS INT) AS date",
        "IF(id % 97 = 0, NULL, lpad(pmod(xxhash64(id, 1), 24), 2, '0') || ':00:00') AS time",
        # A third of the rows agree in date, time and number.
        "'T' || id % 50 AS transaction_id",
        "IF(id % 3 = 0, '', 'd' || id % 1000) AS description",
        "id AS quantity",
    ).selectExpr("IF(quantity % 3 = 0, DATE '2023-03-05', date) AS date", "* EXCEPT (date)")
    filled = frame(spark, S.INTERMEDIATE, []).unionByName(made, allowMissingColumns=True)
    target = str(tmp_path / "stored")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        sinks.write_intermediate(filled, target)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total, most = 0, 0
    for month in sorted(Path(target).glob("month=*")):
        files = sorted(month.glob("*.parquet"))
        most = max(most, len(files))
        rows = [r for f in files for r in pq.read_table(f, partitioning=None).select(sinks.ROW_ORDER).to_pylist()]
        keys = [tuple((r[c] is None, r[c] or (dt.date.min if c == "date" else "")) for c in sinks.ROW_ORDER) for r in rows]
        assert keys == sorted(keys)
        total += len(rows)
    assert total == n and most > 1
    assert read_intermediate(spark, target).agg(F.sum("quantity")).first()[0] == n * (n - 1) // 2
