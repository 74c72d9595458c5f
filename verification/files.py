"""Round trips through files: the projected tables written as the library's inputs or outputs, and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesledger import schema as S
from salesledger.operators.closing import Budget
from salesledger.plans import export
from salesledger.plans.close import close_month
from salesledger.operators import validate
from salesledger.sources import sinks
from salesledger.sources.budget import read_budget
from salesledger.sources.intermediate import SECONDS_PER_DAY, SERIAL_OF_1970, read_cells, read_intermediate
from salesledger.sources.journal_xml import read_journal
from salesledger.sources.quarantine import check_cells, check_sales
from salesledger.sources.till_csv import read_sales, read_transactions
from verification import star
from verification.oracle import CLOSING_MONTH

PUNCTUATED = "concat('say \"', description, '\", twice')"
"""A text that needs quoting: quotes, and a comma after one."""


def _path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one; round trips need files, so they need ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _as_csv(df: DataFrame, columns: dict, path: str) -> str:
    """CSV files under the outer column names, with a further column, in reverse order; packed, as text takes several times the room."""
    named = [F.col(inner).alias(outer) for outer, (inner, _) in columns.items()]
    out = df.select(F.lit("x").alias("Kartentyp"), *reversed(named))
    out.write.option("header", True).option("escape", '"').option("emptyValue", "").option("compression", "gzip").csv(path)
    return path


def sales_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = star.sales(spark, sf_dir).withColumn("description", F.expr(PUNCTUATED))
    return read_sales(spark, _as_csv(sales, S.SALES_COLUMNS, _path(spark, "sales")))


def transactions_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    booked = star.transactions(spark, sf_dir).withColumn("description", F.expr(PUNCTUATED))
    return read_transactions(spark, _as_csv(booked, S.TRANSACTION_COLUMNS, _path(spark, "transactions")))


def _by_month(lines: DataFrame, order: list[str], path: str) -> str:
    """One text file per month with the rows in the given order; months lie in folders named after them."""
    one = lines.repartition("month").sortWithinPartitions("month", *order)
    one.select("month", "value").write.partitionBy("month").text(path)
    return f"{path}/*"


def _broken_sales(spark: SparkSession, sf_dir: str) -> str:
    """Sales report as text with a header per month. Rows with some numbers of pieces cannot be read: a cell that is no
    number, a cell too many, one too few, a day that does not exist."""
    cells = {
        "Datum": "concat('\"', CASE quantity WHEN 23 THEN concat('31.02.', substr(sold_at, 7)) ELSE sold_at END, '\"')",
        "Menge": "CASE quantity WHEN 13 THEN 'x13' ELSE CAST(quantity AS STRING) END",
    }
    texts = [cells.get(outer, f"coalesce(CAST({inner} AS STRING), '')") for outer, (inner, _) in S.SALES_COLUMNS.items()]
    most, last = ", ".join(texts[:-1]), texts[-1]
    lines = star.sales(spark, sf_dir).selectExpr(
        "concat(substr(sold_at, 7, 4), substr(sold_at, 4, 2)) AS month", "1 AS part",
        f"""concat(concat_ws(',', {most}), CASE quantity WHEN 19 THEN '' WHEN 17 THEN concat(',', {last}, ',more')
                   ELSE concat(',', {last}) END) AS value""",
    )
    header = lines.select("month").distinct().select("month", F.lit(0).alias("part"), F.lit(",".join(S.SALES_COLUMNS)).alias("value"))
    return _by_month(header.unionByName(lines), ["part", "value"], _path(spark, "broken"))


MONTH = "regexp_extract(file, 'month=([0-9]+)', 1) AS month"


def rejected_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the report by month and row; the text of malformed rows only, as cells are quoted anew in the others."""
    found = check_sales(spark, _broken_sales(spark, sf_dir)).rejected
    return found.selectExpr(MONTH, "row", "rule", "column", "value", "CASE rule WHEN 'malformed_row' THEN text END AS text")


def accepted_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_sales(spark, _broken_sales(spark, sf_dir)).rows.selectExpr(MONTH, *[c for c in ["row", *S.SALES.names]])


def numbered_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited table with wrong labels as one file of cells per month; violations name the row of the file."""
    rows = star.edited(spark, sf_dir, faulty=True, release=True).sortWithinPartitions("date", "description")
    # Sorted like this the rows are shuffled in fewer bytes. Spark leaves out a sort that another one follows, but for the count
    # between them. The month follows from the date, so it is made behind the shuffle and does not go through it.
    month = F.expr("date_format(date, 'yyyyMM')")
    dealt = rows.observe("shuffled", F.count(F.lit(1)).alias("rows")).repartition(month).withColumn("month", month)
    one = dealt.sortWithinPartitions("month", *[F.col(c).asc_nulls_first() for c in S.INTERMEDIATE.names])
    cells = one.selectExpr("month", *[f"{text} AS `{S_OUTER[c]}`" for c, text in cell_texts(S.INTERMEDIATE.names).items()])
    path = _path(spark, "cells")
    # A month is one file, so that its rows have one order; packed, as text takes several times the room, it is read by one task.
    packed = cells.write.partitionBy("month").option("compression", "gzip")
    packed.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    found = validate.violations(check_cells(spark, f"{path}/*").rows)
    return found.selectExpr(MONTH, "row", "rule", "transaction_id", "payment_method", "topic", "owner", "purpose")


S_OUTER = {inner: outer for outer, (inner, _) in S.INTERMEDIATE_COLUMNS.items()}


def as_cells(df: DataFrame) -> DataFrame:
    """The intermediate table as spreadsheet cells: text only, dates as serial numbers, times as parts of a day.

    Cells of rows with few or many pieces are broken as hand edits break them.
    """
    return df.selectExpr(*[f"{text} AS {c}" for c, text in cell_texts(df.columns).items()])


def cell_texts(columns: list[str]) -> dict[str, str]:
    seconds = "(int(split_part(time, ':', 1)) * 3600 + int(split_part(time, ':', 2)) * 60 + int(substr(time, 7)))"
    changed = {
        "date": f"""CASE quantity WHEN 7 THEN '24.03.2023'
                    ELSE CAST(datediff(date, DATE '1970-01-01') + {SERIAL_OF_1970} AS STRING) END""",
        "time": f"""CASE quantity WHEN 1 THEN '0.999996' WHEN 2 THEN '12:32'
                    ELSE CAST({seconds} / {SECONDS_PER_DAY}D AS STRING) END""",
        "price_net": "CASE quantity WHEN 3 THEN '1''000.00' ELSE CAST(price_net AS STRING) END",
        "commission": "CASE quantity WHEN 4 THEN '' ELSE CAST(commission AS STRING) END",
        "quantity": "CASE quantity WHEN 5 THEN '5.5' ELSE CAST(quantity AS STRING) END",
        "topic": "CASE quantity WHEN 6 THEN '  ' ELSE concat(' ', topic) END",
        "owner": "coalesce(concat(owner, '  '), '')",
        "purpose": "concat(purpose, ' ')",
    }
    return {c: changed.get(c, f"CAST({c} AS STRING)") for c in columns}


def cells_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = as_cells(star.intermediate(spark, sf_dir))
    return read_cells(spark, _as_csv(cells, S.INTERMEDIATE_COLUMNS, _path(spark, "cells")))


def stored_intermediate(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "intermediate")
    sinks.write_intermediate(star.intermediate(spark, sf_dir), path)
    return read_intermediate(spark, path).select(*S.INTERMEDIATE.names, "month")


def stored_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and days per month of the stored accounting report."""
    path = _path(spark, "accounting")
    report = export.accounting(star.intermediate(spark, sf_dir))
    sinks.write_report(report, path, S.ACCOUNTING_REPORT, ["date"])
    stored = spark.read.parquet(f"{path}/main")
    paid = F.col(f"`{S.ACCOUNTING_REPORT['payment_sumup']}`")
    return stored.groupBy("month").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.col(f"`{S.ACCOUNTING_REPORT['date']}`")).alias("n_days"),
        F.sum(paid).cast("double").alias("paid"),
    )


def journal_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal as workbooks of 10,000 orders, each row as the ledger writes it.

    Rows meet by book before they become XML, which is written row by row, packed: as text it takes ten times the room.
    """
    book = F.expr("CAST(substr(description, length('Posting ') + 1) AS BIGINT) div 10000")
    journal = star.journal(spark, sf_dir)
    rows = journal.dropna().select(book.alias("book"), F.lit(1).alias("part"), "*")
    cell = "concat('<Cell ss:Index=\"', {at}, '\"><Data ss:Type=\"String\">', {value}, '</Data></Cell>')"
    cells = ", ".join(
        cell.format(at=at, value=value)
        for at, value in (
            (8, "concat(date, 'T00:00:00.000')"),
            (19, "description"),
            (21, "debit"),
            (23, "credit"),
            (25, "amount"),
        )
    )
    head = "".join(
        f'<Cell ss:Index="{at}"><Data ss:Type="String">{name}</Data></Cell>'
        for at, name in ((8, "Date"), (19, "Description"), (21, "AccountDebit"), (23, "AccountCredit"), (25, "Amount"))
    )
    space = "urn:schemas-microsoft-com:office:spreadsheet"
    ends = journal.select(book.alias("book")).distinct().select("book", F.explode(F.array(F.lit(0), F.lit(2))).alias("part"))
    value = f"""CASE part WHEN 1 THEN concat('<Row>', {cells}, '</Row>') WHEN 2 THEN '</Table></Worksheet></Workbook>'
        ELSE '<?xml version="1.0" encoding="UTF-8"?>\n<Workbook xmlns="{space}" xmlns:ss="{space}"><Worksheet ss:Name="Journal"><Table><Row></Row><Row>{head}</Row>' END"""
    books = rows.unionByName(ends, allowMissingColumns=True).repartition("book").sortWithinPartitions("book", "part")
    path = _path(spark, "journal")
    books.select("book", F.expr(value).alias("value")).write.partitionBy("book").option("compression", "gzip").text(path)
    return read_journal(spark, f"{path}/*")


def _budget_json(spark: SparkSession, sf_dir: str) -> Budget:
    """The budget as one JSON document, written and read again."""
    budget = star.budget(spark, sf_dir)
    listed = budget.post_account.groupBy("post_key").agg(
        F.expr("transform(array_sort(collect_list(struct(pos, account))), x -> x.account) AS account_codes")
    )
    posts = budget.post.join(listed, "post_key", "left").agg(
        F.expr("map_from_entries(collect_list(struct(post_key, struct(name, sort, factor, account_codes)))) AS posts")
    )
    amounts = budget.post_budget.groupBy("year").agg(
        F.expr("struct(map_from_entries(collect_list(struct(post_key, amount))) AS amounts) AS entry")
    )
    years = amounts.agg(F.expr("map_from_entries(collect_list(struct(year, entry))) AS years"))
    path = _path(spark, "budget")
    posts.join(years, F.lit(True)).write.json(path)
    return read_budget(spark, path)


def budget_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    budget = _budget_json(spark, sf_dir)
    return budget.post.join(budget.post_account, "post_key", "left")


def budget_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _budget_json(spark, sf_dir).post_budget


def stored_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "closing")
    sinks.write_closing(close_month(star.journal(spark, sf_dir), star.budget(spark, sf_dir), CLOSING_MONTH), path)
    return spark.read.parquet(path)
