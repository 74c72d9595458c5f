"""Files in, files out, and the three jobs end to end."""

from __future__ import annotations

import gzip
import json

import pyarrow as pa
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from salesledger import schema as S
from salesledger.functions import dates
from salesledger.plans import jobs
from salesledger.plans.staging import staging
from salesledger.sources.budget import read_budget
from salesledger.sources.intermediate import coerce_cells, read_cells, read_intermediate
from salesledger.sources.journal_xml import HEADERS, POSITIONS, SHEET, _cells, read_journal
from salesledger.sources.till_csv import read_sales, read_transactions
from verification.files import _as_csv, as_cells

SALES_HEADER = (
    "Datum,Typ,Transaktionsnummer,Zahlungsmethode,Menge,Beschreibung,Category,Sku,Währung,Preis vor Rabatt,Rabatt,"
    "Preis (brutto),Preis (netto),Steuer,Steuersatz,Konto"
)
TRANSACTIONS_HEADER = (
    "Datum,Transaktions-ID,Transaktionsart,Status,Beschreibung,Betrag inkl. MwSt.,Trinkgeldbetrag,Gebühr,Netto"
)


@pytest.fixture
def till(tmp_path):
    sales = tmp_path / "sales_202303.csv"
    sales.write_text(
        "\n".join(
            [
                SALES_HEADER,
                '"24.03.2023, 12:32",Verkauf,T1,MC,1, foo ,Alkoholfrei,,CHF,16.00,0.00,16.00,,0.00,,a@b.ch',
                '"24.03.2023, 12:40",Verkauf,T2,Bar,2,Hauptgang,Mittagstisch,,CHF,26.00,0.00,26.00,26.00,0.00,,a@b.ch',
                '"03.04.2023, 15:00",Verkauf,T3,Bar,1,SCHICHTWECHSEL,,,CHF,0.01,0.00,0.01,0.01,0.00,,a@b.ch',
                '"03.04.2023, 15:10",Verkauf,T4,Bar,1,Kuchen,,,CHF,4.00,0.00,4.00,4.00,0.00,,a@b.ch',
            ]
        )
    )
    booked = tmp_path / "transactions_202303.csv"
    booked.write_text(
        "\n".join(
            [
                TRANSACTIONS_HEADER,
                "2023-03-24 12:32:00,T1,Umsatz,Erfolgreich,foo,17.00,1.00,0.24,",
                "2023-03-24 12:40:00,T2,Umsatz,Erfolgreich,Hauptgang,26.00,0.00,0.00,26.00",
                "2023-04-03 15:00:00,T3,Umsatz,Erfolgreich,SCHICHTWECHSEL,0.01,0.00,0.00,0.01",
                "2023-04-03 15:10:00,T4,Umsatz,Erfolgreich,Kuchen,4.00,0.00,0.00,4.00",
            ]
        )
    )
    return str(sales), str(booked)


def test_csv(spark, till):
    sales = read_sales(spark, till[0]).orderBy("transaction_id")
    assert rows_of(sales, "transaction_id", "description", "price_net", "quantity") == [
        ("T1", " foo ", 16.0, 1), ("T2", "Hauptgang", 26.0, 2), ("T3", "SCHICHTWECHSEL", 0.0, 1),
        ("T4", "Kuchen", 4.0, 1),
    ]
    assert rows_of(read_transactions(spark, till[1]).orderBy("transaction_id"), "net")[0] == (17.0,)


def test_csv_with_other_columns(spark, tmp_path):
    names = TRANSACTIONS_HEADER.split(",")
    values = dict(zip(names, "2023-03-24 12:32:00,T1,Umsatz,Erfolgreich,foo,17.00,1.00,0.24,16.76".split(",")))
    order = [names[1], "Kartentyp", *reversed(names[2:]), names[0]]
    lines = [",".join(order), ",".join(values.get(n, "VISA") for n in order)]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    out = read_transactions(spark, str(tmp_path / "a.csv"))
    assert out.schema.names == S.TRANSACTIONS.names
    assert rows_of(out, "booked_at", "transaction_id", "amount", "tip", "fee", "net") == [
        ("2023-03-24 12:32:00", "T1", 17.0, 1.0, 0.24, 16.76)
    ]
    (tmp_path / "b.csv").write_text("\n".join([TRANSACTIONS_HEADER, ",".join(values[n] for n in names)]))
    with pytest.raises(Exception, match="header|Header"):
        read_transactions(spark, str(tmp_path)).collect()


def test_prepare_and_export_jobs(spark, till, tmp_path):
    store, out = str(tmp_path / "intermediate"), str(tmp_path / "reports")
    assert jobs.run_prepare(spark, *till, store).count() == 0
    stored = read_intermediate(spark, store)
    got = rows_of(stored.orderBy("transaction_id", "description"), "transaction_id", "description", "topic", "owner",
                  "commission", "month")
    assert got == [
        ("T1", "Trinkgeld", "MiTi", "MiTi", 0.0141, "202303"),
        ("T1", "foo", "MiTi", "LoLa", 0.2259, "202303"),
        ("T2", "Hauptgang", "MiTi", "MiTi", 0.0, "202303"),
        ("T3", "SCHICHTWECHSEL", "MiTi", "LoLa", 0.0, "202304"),
        ("T4", "Kuchen", "Cafe", None, 0.0, "202304"),
    ]
    pruned = stored.where("month = '202304'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in pruned

    jobs.run_export(spark, store, out)
    details = spark.read.parquet(f"{out}/details/main")
    assert details.count() == 4 and "Net MiTi (LoLA) - Share LoLa" in details.columns
    assert spark.read.parquet(f"{out}/mittagstisch/main").where("is_total").count() == 2
    assert spark.read.parquet(f"{out}/transactions").count() == stored.count()
    partner_rows = spark.read.parquet(f"{out}/mittagstisch/transactions")
    assert partner_rows.select("topic").distinct().count() == 1 and partner_rows.count() == 4
    assert "10920/20051" in spark.read.parquet(f"{out}/accounting/main").columns
    ledger = spark.read.parquet(f"{out}/banana/main").where("month = '202304'")
    assert rows_of(ledger, "Beschreibung", "KtSoll", "KtHaben", "`Betrag CHF`") == [("SU Cafe bar", "10000", "30200", 4.0)]


def test_prepare_job_stops(spark, till, tmp_path):
    sales, booked = till
    with open(booked, "a") as file:
        file.write("\n2023-04-03 15:10:00,T5,Umsatz,Geplant,x,4.00,0.00,0.00,4.00")
    with pytest.raises(jobs.BookkeepingError, match="missing in the sales report.*T5|T5"):
        jobs.run_prepare(spark, sales, booked, str(tmp_path / "never"))


def test_export_job_stops(spark, till, tmp_path):
    store = str(tmp_path / "intermediate")
    edits = spark.createDataFrame(
        [("T4", "Kuchen", "Kaffee", None, "Consumption", None)],
        "transaction_id string, description string, topic string, owner string, purpose string, comment string",
    )
    jobs.run_prepare(spark, *till, store, overrides=edits)
    with pytest.raises(jobs.BookkeepingError, match="invalid_topic"):
        jobs.run_export(spark, store, str(tmp_path / "never"))


def test_cells(spark):
    cells = {
        "date": ["45009", "x", None], "time": [str((12 * 3600 + 32 * 60) / 86400), "1.5", "0"],
        "quantity": ["2", "2.5", ""], "price_gross": ["16.5", "abc", None], "topic": [" MiTi ", "", None],
        "owner": ["", "  ", "LoLa"],
    }
    names = S.INTERMEDIATE.names
    data = [tuple(cells.get(n, [None] * 3)[i] for n in names) for i in range(3)]
    df = spark.createDataFrame(data, ", ".join(f"{n} string" for n in names))
    out = coerce_cells(df)
    assert [str(v) for v in out.select("date").first()] == ["2023-03-24"]
    assert rows_of(out, "time", "quantity", "price_gross", "topic", "owner") == [
        ("12:32:00", 2, 16.5, "MiTi", None), (None, None, None, None, None), ("00:00:00", None, None, None, "LoLa"),
    ]


def test_cells_from_file(spark, tmp_path):
    path = tmp_path / "intermediate_202303.csv"
    path.write_text(
        "Account,Date,Time,Type,Transaction ID,Payment Method,Quantity,Description,Currency,Price (Gross),Price (Net),"
        "Commission,Topic,Owner,Purpose,Comment\n"
        "a@b.ch,45009,0.5,Sales,T1, Card ,1,foo,CHF,16,16,0.24,MiTi,LoLa,Consumption,\n"
    )
    out = read_cells(spark, str(path))
    assert rows_of(out, "time", "payment_method", "commission") == [("12:00:00", "Card", 0.24)]


def test_months_of_files(spark, tmp_path):
    cases = {
        "intermediate_202303.xlsx": "202303", "intermediate_202312_mod.XLSX": "202312", "intermediat_202303.xlsx": None,
        "abcdefghijkl_202303.xlsx": None, "intermediate_202303_.xls": None, "intermediate_202303aaaaa": None,
    }
    df = spark.createDataFrame(list(cases.items()), "name string, expected string")
    out = df.select("expected", dates.month_of_file(F.col("name"), "intermediate", "xlsx").alias("month"))
    assert all(r.month == r.expected for r in out.collect())
    (tmp_path / "konten_202410_20241113090027.xls").write_text("x")
    found = jobs.file_months(spark, str(tmp_path), "konten", "xls")
    assert rows_of(found) == [("konten_202410_20241113090027.xls", "202410")]


def test_supported_months(spark):
    good = ["202301", "202412", "210012"]
    bad = ["20231", "2023110", "202x11", "202012", "202300", "202313", "210101", None]
    df = spark.createDataFrame([(m,) for m in good + bad], "month string")
    out = df.select(dates.is_supported_month(F.col("month")).alias("ok")).collect()
    assert [r.ok for r in out] == [True] * len(good) + [False] * len(bad)
    jobs.check_month(spark, "202412")
    with pytest.raises(jobs.BookkeepingError):
        jobs.check_month(spark, "202313")


def cell(index, text, kind="String"):
    data = "" if text is None else f'<Data ss:Type="{kind}">{text}</Data>'
    return f'<Cell ss:Index="{index}">{data}</Cell>'


def workbook(path, positions, rows, header=True):
    names = dict(date="Date", description="Description", debit="AccountDebit", credit="AccountCredit", amount="Amount")
    lines = []
    if header:
        lines.append("<Row>" + "".join(cell(positions[k], v) for k, v in names.items()) + "</Row>")
    lines += ["<Row>" + "".join(cell(positions[k], v) for k, v in row.items()) + "</Row>" for row in rows]
    other = "<Row>" + cell(8, "2024-01-31T00:00:00.000") + cell(22, "30100") + "</Row>"
    path.write_text(
        '<?xml version="1.0" encoding="UTF-8"?>\n'
        '<Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" '
        'xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet">\n'
        f'<Worksheet ss:Name="Accounts"><Table>{other}{other}</Table></Worksheet>\n'
        f'<Worksheet ss:Protected="1" ss:Name="Journal"><Table><Row></Row>{"".join(lines)}</Table></Worksheet>\n'
        "</Workbook>\n"
    )


OLD = dict(date=8, description=20, debit=22, credit=24, amount=29)
NEW = dict(date=8, description=19, debit=21, credit=23, amount=25)
ENTRIES = [
    dict(date="2024-01-31T00:00:00.000", description="a", debit="10000", credit="30100", amount="5.00"),
    dict(date="31.01.2024", description="no date", debit="10000", credit="30100", amount="5.00"),
    dict(date="2024-03-01T00:00:00.000", description=None, debit="30100", amount="x"),
]


@pytest.mark.parametrize(("positions", "header"), [(OLD, True), (NEW, True), (OLD, False)])
def test_journal(spark, tmp_path, positions, header):
    workbook(tmp_path / "konten_202403.xls", positions, ENTRIES, header)
    out = read_journal(spark, str(tmp_path)).orderBy("date")
    assert [str(r.date) for r in out.collect()] == ["2024-01-31", "2024-03-01"]
    assert rows_of(out, "description", "debit", "credit", "amount") == [
        ("a", "10000", "30100", 5.0), ("description missing", "30100", "credit missing", 0.0),
    ]


def test_journal_plain_and_odd_workbooks_agree(spark, tmp_path):
    """Rows in plain form are read by patterns, all others element by element; neither is read as one XML record per sheet."""
    entries = [dict(date=f"2024-01-{day:02}", description=f"a &amp; {day} &#228;", debit="1", credit="2", amount="3") for day in range(1, 29)]
    (tmp_path / "plain").mkdir()
    workbook(tmp_path / "plain" / "a.xls", NEW, entries)
    text = (tmp_path / "plain" / "a.xls").read_text()
    odd = {
        "comment": text.replace("<Table>", "<Table><!-- <Row> -->"),
        "quotes": text.replace('"', "'"),
        "blanks": text.replace("</Cell>", "\n</Cell >").replace("<Row>", "<Row >"),
        "cdata": text.replace("a &amp; ", "<![CDATA[a & ]]>"),
        "index": text.replace("<Cell ss:Index", "<Cell ss:StyleID='s1' ss:Index"),
    }
    rows = sorted(rows_of(read_journal(spark, str(tmp_path / "plain"))))
    assert [row[1] for row in rows] == [f"a & {day} ä" for day in range(1, 29)]
    for name, changed in odd.items():
        assert changed != text
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.xls").write_text(changed)
        assert sorted(rows_of(read_journal(spark, str(tmp_path / name)))) == rows, name
    plan = read_journal(spark, str(tmp_path / "plain"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Scan xml" not in plan


def test_packed_workbooks_are_read_by_patterns_up_to_a_size(spark, tmp_path):
    """One batch comes from the patterns over columns; element by element each batch holds one row here."""
    entries = [dict(date=f"2024-01-{day:02}", description="a", debit="1", credit="2", amount="3") for day in range(1, 29)]
    workbook(tmp_path / "a.xls", NEW, entries)
    text = (tmp_path / "a.xls").read_bytes()
    large = text.replace(b"<Row>", b"<Row>" + b" " * (129 << 20), 1)
    (tmp_path / "a.xls.gz").write_bytes(gzip.compress(text))
    cells = _cells(SHEET, HEADERS, POSITIONS, by_name=True, batch=1)

    def batches(name, content):
        given = pa.RecordBatch.from_pydict({"path": [name], "content": pa.array([content], pa.binary())})
        return [batch.to_pylist() for batch in cells(iter([given]))]

    plain, packed, beyond = batches("a.xls", text), batches("a.xls.gz", gzip.compress(text)), batches("a.xls.gz", gzip.compress(large, 1))
    assert len(plain) == 1 and packed == plain and len(beyond) > len(entries)
    dated = [[row for batch in found for row in batch if row["date"] and row["date"][:4] == "2024"] for found in (plain, beyond)]
    assert dated[0] == dated[1] and len(dated[0]) == len(entries)
    with pytest.raises(OSError):
        batches("a.xls.gz", gzip.compress(text)[:-20])
    rows = [rows_of(read_journal(spark, str(tmp_path / name)).orderBy("date")) for name in ("a.xls", "a.xls.gz")]
    assert rows[0] == rows[1] and len(rows[0]) == len(entries)


def test_journal_leaves_out_a_sheet_that_cannot_be_read(spark, tmp_path):
    workbook(tmp_path / "a.xls", NEW, ENTRIES[:1])
    text = (tmp_path / "a.xls").read_text()
    sheet = text[text.index('<Worksheet ss:Protected') : text.index("</Workbook>")]
    (tmp_path / "a.xls").write_text(text.replace("</Workbook>", sheet.replace("</Row>", "", 1) + sheet + "</Workbook>"))
    assert read_journal(spark, str(tmp_path)).count() == 1


def test_close_job(spark, tmp_path):
    definition = {
        "posts": {
            "E30": {"name": "Ertrag", "sort": 1, "factor": -1, "account_codes": ["30100", "30200"]},
            "RX": {"name": "Reserve", "sort": 2, "factor": -1, "account_codes": []},
        },
        "years": {"2024": {"amounts": {"E30": 3.5, "RX": 1}}},
    }
    (tmp_path / "budget.json").write_text(json.dumps(definition))
    budget = read_budget(spark, str(tmp_path / "budget.json"))
    workbook(tmp_path / "konten_202403.xls", NEW, ENTRIES[:1])
    out = jobs.run_close(spark, str(tmp_path / "konten_202403.xls"), budget, str(tmp_path / "closing"))
    assert rows_of(out, "group", "budget", "net", "remaining") == [("Ertrag", 3.5, 5.0, 1.5)]
    assert spark.read.parquet(str(tmp_path / "closing")).count() == 1
    extra = [dict(date="2024-01-31T00:00:00.000", debit="39999", credit="10000", amount="1")]
    workbook(tmp_path / "konten_202404.xls", NEW, extra)
    with pytest.raises(jobs.BookkeepingError, match="39999"):
        jobs.run_close(spark, str(tmp_path / "konten_202404.xls"), budget, str(tmp_path / "never"), "202404")
    with pytest.raises(jobs.BookkeepingError, match="one month"):
        jobs.run_close(spark, str(tmp_path / "konten_*.xls"), budget, str(tmp_path / "never"))


def test_staging_has_its_own_folder_and_leaves_nothing(spark, tmp_path):
    with staging(spark, str(tmp_path)) as stage:
        assert stage(spark.range(3)).count() == 3
        assert stage.path.startswith(str(tmp_path)) and len(list(tmp_path.iterdir())) == 1
    assert list(tmp_path.iterdir()) == []


SALES_HEADER = ",".join(S.SALES_COLUMNS)
SALE = dict(zip(S.SALES_COLUMNS, "24.03.2023 x,Verkauf,T1,MC,1,foo,a,,CHF,16,0,16,16,0,,a@b.ch".split(",")))
SALE["Datum"] = '"24.03.2023, 12:32"'


def sale(**values):
    return ",".join({**SALE, **values}.values())


def test_quoted_cells(spark, tmp_path):
    cells = ['"Menü ""klein"""', '"Menü ""klein"", gross"', '"a\\"', '"x, y"']
    (tmp_path / "a.csv").write_text("\n".join([SALES_HEADER, *[sale(Beschreibung=c) for c in cells]]))
    out = read_sales(spark, str(tmp_path / "a.csv"))
    assert [r.description for r in out.collect()] == ['Menü "klein"', 'Menü "klein", gross', "a\\", "x, y"]
    assert rows_of(out.select("price_gross").distinct()) == [(16.0,)]


@pytest.mark.parametrize("line", [sale().rsplit(",", 9)[0], sale() + ",more", sale(Beschreibung='"two\nlines"')])
def test_ragged_rows_stop_a_narrow_read_too(spark, tmp_path, line):
    (tmp_path / "a.csv").write_text("\n".join([SALES_HEADER, sale(), line]))
    with pytest.raises(Exception, match="[Mm]alformed"):
        read_sales(spark, str(tmp_path / "a.csv")).select("price_gross").collect()


def test_line_breaks_in_cells_on_request(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join([SALES_HEADER, sale(Beschreibung='"two\nlines"'), sale()]))
    out = read_sales(spark, str(tmp_path / "a.csv"), multi_line=True)
    assert sorted(r.description for r in out.collect()) == ["foo", "two\nlines"]


def test_prepare_job_stores_what_it_stops_at(spark, till, tmp_path):
    target = str(tmp_path / "store")
    lines = [f"2023-04-03 15:10:00,X{i},Umsatz,Erfolgreich,x,4.00,0.00,0.00,4.00" for i in range(30)]
    with open(till[1], "a") as file:
        file.write("\n" + "\n".join(lines))
    with pytest.raises(jobs.BookkeepingError, match="all rows: .*store_violations/missing"):
        jobs.run_prepare(spark, *till, target)
    assert spark.read.parquet(f"{target}_violations/missing").where("missing_in = 'sales'").count() == 30


def test_prepare_job_stops_at_double_bookings_and_overrides(spark, till, tmp_path):
    edits = spark.createDataFrame(
        [("T4", "Kuchen", "Cafe", None, "Consumption", None)] * 2,
        "transaction_id string, description string, topic string, owner string, purpose string, comment string",
    )
    with pytest.raises(jobs.BookkeepingError, match="more than once.*duplicate_overrides"):
        jobs.run_prepare(spark, *till, str(tmp_path / "a"), overrides=edits)
    lines = open(till[1]).read().rstrip("\n").split("\n")
    with open(till[1], "w") as file:
        file.write("\n".join([*lines, lines[1]]))
    with pytest.raises(jobs.BookkeepingError, match="booked more than once"):
        jobs.run_prepare(spark, *till, str(tmp_path / "b"))


def test_rows_outside_the_month_of_their_file(spark, till, tmp_path):
    named = str(tmp_path / "sales_report_202303.csv")
    with open(named, "w") as file:
        file.write(open(till[0]).read())
    with pytest.raises(jobs.BookkeepingError, match="another month in sales_report"):
        jobs.run_prepare(spark, named, till[1], str(tmp_path / "never"))


def test_edited_cells_come_back(spark, till, tmp_path):
    store, out = str(tmp_path / "intermediate"), str(tmp_path / "cells")
    jobs.run_prepare(spark, *till, store)
    rows = read_intermediate(spark, store)
    cells = as_cells(rows.drop("month").withColumn("quantity", F.lit(9).cast("bigint")))
    cells.select(*[F.col(inner).alias(outer) for outer, (inner, _) in S.INTERMEDIATE_COLUMNS.items()]).write.option(
        "header", True
    ).csv(out)
    extra = rows.drop("month").limit(1).withColumn("comment", F.lit("by hand"))
    jobs.run_reread(spark, out, str(tmp_path / "edited"), extra)
    edited = read_intermediate(spark, str(tmp_path / "edited"))
    assert edited.count() == rows.count() + 1 and edited.where("comment = 'by hand'").count() == 1
    jobs.run_export(spark, str(tmp_path / "edited"), str(tmp_path / "reports"))


def test_a_time_that_rounds_to_midnight_is_none(spark):
    cells = spark.createDataFrame(
        [tuple("0.999996" if n == "time" else None for n in S.INTERMEDIATE.names)],
        ", ".join(f"{n} string" for n in S.INTERMEDIATE.names),
    )
    assert rows_of(coerce_cells(cells), "time") == [(None,)]


def test_cells_are_read_from_packed_files(spark, tmp_path):
    text = 'description "1", x'
    cells = spark.range(2000).select(*[F.lit(text).alias(name) for name in S.INTERMEDIATE.names])
    path = _as_csv(cells, S.INTERMEDIATE_COLUMNS, str(tmp_path / "cells"))
    files = list((tmp_path / "cells").glob("part-*"))
    assert files and all(file.name.endswith(".csv.gz") for file in files)
    out = read_cells(spark, path)
    assert out.count() == 2000 and out.select("description").distinct().collect() == [(text,)]
