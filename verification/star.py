"""Projections of the generated tables onto the library's input tables.

An order is a transaction, its line items are the sales lines. Prices, payment methods, refunds, tips and failed
payments follow from attributes of the rows; descriptions follow from the size of the part, so that every branch of the
labelling rules occurs. ``oracle.py`` states the same projections in DuckDB's SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesledger import schema as S
from salesledger.operators.closing import Budget
from salesledger.operators.redact import apply_overrides
from salesledger.plans.prepare import prepare
from salesledger.plans.staging import Staging

# --- fixed values: part size -> description; every other size keeps the part's name ------------------
DESCRIPTIONS = {
    1: "Hauptgang Vegi Standard",
    2: "Hauptgang Fleisch  Reduziert",
    3: "Hauptgang Vegi Praktikum",
    4: "Kindermenü",
    5: "Seniorenmittagstisch",
    6: "Menü ganz",
    7: "Dessert",
    8: " Kaffee ",
    9: "Recircle Tupper Depot",
    10: "Kerze klein",
    11: "Miete",
    12: "Buffet 1 (PO)",
    13: "  ",
    14: "SCHICHTWECHSEL",
    15: "Trinkgeld",
    16: "Mittagstisch-Nachmittag",
    17: "2-Gang-Menu (mit Vorspeise oder Dessert)",
    18: "Vorsp. + Hauptsp. red.",
    19: "Nachmittag-Abend",
    20: "Praktika",
}

DESCRIPTION = (
    "CASE p_size " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in DESCRIPTIONS.items()) + " ELSE p_name END"
)

_tables: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A generated table. Its plan is kept per session, so the footer is read once however often it is used."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        _tables[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _tables[key]


def _orders(spark: SparkSession, sf_dir: str, sites: int = 1) -> DataFrame:
    """Orders as transactions; with several sites each numbers its transactions anew, so sites share numbers."""
    seconds = "pmod(o_orderkey * 7919, 86400)"
    clock = ", ':', ".join(
        f"lpad({part}, 2, '0')"
        for part in (f"{seconds} div 3600", f"({seconds} div 60) % 60", f"{seconds} % 60")
    )
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "o_orderstatus",
        "o_orderpriority",
        "o_totalprice",
        "CAST(o_orderdate AS DATE) AS day",
        f"concat(date_format(CAST(o_orderdate AS DATE), 'dd.MM.yyyy'), ', ', left(concat({clock}), 5)) AS sold_at",
        f"concat('T', o_orderkey div {sites}) AS order_id",
        f"concat('s', o_orderkey % {sites}) AS site",
        "concat('c', o_custkey, '@b.ch') AS account",
        f"concat({clock}) AS clock",
        "CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'Bar' ELSE 'VISA' END AS payment",
        "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AS refunded",
    )


def _site(sites: int) -> list[str]:
    return ["site"] if sites > 1 else []


def sales(spark: SparkSession, sf_dir: str, sites: int = 1) -> DataFrame:
    """Sales report: the line items, and for refunded orders a second line per item that takes it back.

    What is taken back of large orders is one too little, so their refund does not balance. What follows from the order, the part
    or the item alone is made there, before they meet. The items meet their parts first and with few columns; the rows then come out by
    order, where they compress well and a transaction's lines lie together for all that reads them.
    """
    money = "DECIMAL(18, 2)"
    orders = _orders(spark, sf_dir, sites).selectExpr(
        *_site(sites),
        "o_orderkey",
        "sold_at",
        "order_id",
        "payment",
        "account",
        "refunded",
        "year(day) < 1998 AS early",
        "o_totalprice > 400000 AS large",
    )
    parts = table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        f"{DESCRIPTION} AS description",
        """CASE WHEN p_type = 'ECONOMY' THEN 'Mittagstisch'
                WHEN p_type = 'PROMO' AND p_brand IN ('Brand#7', 'Brand#8') THEN 'Kultur Essen (PO)'
                ELSE lower(p_type) END AS category""",
    )
    items = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey",
        "l_partkey",
        "l_discount = 0 AND l_tax = 0 AS unnumbered",
        "CAST(l_quantity AS BIGINT) AS quantity",
        """CAST(CASE WHEN l_discount = 0.1 AND l_tax = 0.08 THEN 0 WHEN l_linenumber = 7 THEN l_quantity
                     ELSE l_extendedprice END AS DECIMAL(18, 2)) AS price""",
        "l_linestatus = 'O' AND l_returnflag = 'A' AS no_net",
    )
    lines = (
        items.join(parts, F.expr("l_partkey = p_partkey"))
        .join(orders, F.expr("l_orderkey = o_orderkey"))
        .selectExpr(
            *_site(sites),
            "sold_at",
            "CASE WHEN unnumbered THEN NULL ELSE order_id END AS transaction_id",
            "payment",
            "quantity",
            "description",
            "category",
            "price",
            "no_net",
            "account",
            "CASE WHEN refunded THEN array(false, true) ELSE array(false) END AS sides",
            "CASE WHEN early THEN 'Refund' ELSE 'Rückerstattung' END AS refund_kind",
            "CAST(CASE WHEN large THEN 1 ELSE 0 END AS DECIMAL(18, 2)) AS too_little",
        )
    )
    sides = lines.selectExpr("*", "explode(sides) AS back").selectExpr(
        "*", f"CAST(CASE WHEN back THEN too_little - price ELSE price END AS {money}) AS amount"
    )
    columns = {
        "kind": "CASE WHEN back THEN refund_kind ELSE 'Verkauf' END",
        "sku": "''",
        "currency": "'CHF'",
        "list_price": "amount",
        "discount": f"CAST(CASE WHEN NOT back THEN 0 END AS {money})",
        "price_gross": "amount",
        "price_net": "CASE WHEN NOT no_net THEN amount END",
        "tax": f"CAST(CASE WHEN NOT back THEN 0 END AS {money})",
        "tax_rate": "''",
        "account": "CASE WHEN NOT back THEN account END",
    }
    return sides.selectExpr(*_site(sites), *[f"{columns.get(name, name)} AS {name}" for name in S.SALES.names])


def transactions(spark: SparkSession, sf_dir: str, sites: int = 1) -> DataFrame:
    """Transaction report: one revenue row per order, and one without status per refunded order.

    The largest orders are booked twice by mistake.
    """
    money = "DECIMAL(18, 2)"
    booked = (
        _orders(spark, sf_dir, sites)
        .selectExpr(
            "*",
            f"""CAST(CASE WHEN o_orderpriority = '2-HIGH' THEN 2.5
                          WHEN o_orderpriority <> '3-MEDIUM' THEN 0 END AS {money}) AS tip""",
            """CASE WHEN refunded THEN array(false, true) WHEN o_totalprice > 499000 THEN array(false, false)
                    ELSE array(false) END AS sides""",
        )
        .selectExpr("*", f"CAST(CAST(o_totalprice AS {money}) + coalesce(tip, 0) AS {money}) AS amount")
        .selectExpr("*", "explode(sides) AS back")
    )
    return booked.selectExpr(
        *_site(sites),
        "concat(date_format(day, 'yyyy-MM-dd'), ' ', clock) AS booked_at",
        "order_id AS transaction_id",
        "CASE WHEN back THEN 'Rückerstattung' ELSE 'Umsatz' END AS kind",
        """CASE WHEN back THEN NULL
                WHEN o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM' THEN 'Geplant'
                WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' AND o_totalprice < 50000
                THEN 'Fehlgeschlagen' ELSE 'Erfolgreich' END AS status""",
        """CASE WHEN back THEN NULL WHEN o_totalprice < 8000 THEN '1 x SCHICHTWECHSEL'
                ELSE '1 x Hauptgang' END AS description""",
        f"CAST(CASE WHEN back THEN -amount ELSE amount END AS {money}) AS amount",
        "CASE WHEN NOT back THEN tip END AS tip",
        f"""CAST(CASE WHEN back THEN NULL WHEN payment = 'Bar' THEN 0
                      ELSE round(amount * 0.015, 2) END AS {money}) AS fee""",
        "CASE WHEN NOT back AND payment = 'Bar' THEN amount END AS net",
    )


def overrides(spark: SparkSession, sf_dir: str, faulty: bool = False) -> DataFrame:
    """Manual labels by description: topics the heuristics never choose, and with ``faulty`` some wrong ones."""
    topic = """CASE split_part(description, ' ', 1) WHEN 'red' THEN 'Verm' WHEN 'blue' THEN 'SoFe'
               WHEN 'cold' THEN 'Deposit' WHEN 'new' THEN 'Culture' WHEN 'hot' THEN 'Rental' END"""
    owner = "CASE WHEN startswith(description, 'new ') THEN 'PaidOut' END"
    purpose = "CASE WHEN endswith(description, 'ring') THEN 'Tip' ELSE 'Consumption' END"
    if faulty:
        topic = f"""CASE WHEN description = 'red rod' THEN 'Vermiet'
                         WHEN startswith(description, 'old ') THEN 'MiTi' ELSE {topic} END"""
        owner = f"""CASE description WHEN 'blue rod' THEN 'LoLa' WHEN 'new rod' THEN NULL
                         WHEN 'new bolt' THEN 'miti' WHEN 'old rod' THEN 'PaidOut' ELSE {owner} END"""
        purpose = f"CASE WHEN description = 'cold rod' THEN 'Spende' ELSE {purpose} END"
    names = table(spark, sf_dir, "part").selectExpr("p_name AS description").distinct()
    return names.selectExpr(
        "description", f"{topic} AS topic", f"{owner} AS owner", f"{purpose} AS purpose", "'edited' AS comment"
    ).where("topic IS NOT NULL")


def staging(spark: SparkSession, release: bool = False) -> Staging | None:
    """Storage for tables that several steps read, as the jobs have it; none where the session names no shared folder."""
    return Staging(spark, release=release) if spark.conf.get("spark.checkpoint.dir", None) else None


def stored(df: DataFrame) -> DataFrame:
    """``df`` stored and read back, or as it is where there is no shared folder."""
    stage = staging(df.sparkSession)
    return stage(df) if stage else df


def prepared(spark: SparkSession, sf_dir: str, release: bool = False) -> DataFrame:
    return prepare(sales(spark, sf_dir), transactions(spark, sf_dir), stage=staging(spark, release))


def edited(spark: SparkSession, sf_dir: str, faulty: bool = False, release: bool = False) -> DataFrame:
    """Prepared table with the manual labels applied. ``release`` keeps no shuffle files behind the stored tables."""
    return apply_overrides(prepared(spark, sf_dir, release), overrides(spark, sf_dir, faulty), on=("description",))


def intermediate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited table that the export starts from, stored as the job stores it."""
    return stored(edited(spark, sf_dir))


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger journal: every line item credits the account of its part."""
    return journal_of(table(spark, sf_dir, "lineitem"))


def journal_of(items: DataFrame) -> DataFrame:
    return items.selectExpr(
        *[name for name in items.columns if name == "site"],
        "CAST(l_shipdate AS DATE) AS date",
        "concat('Posting ', l_orderkey) AS description",
        """CASE WHEN l_returnflag = 'R' THEN concat('6', lpad(l_suppkey % 1000, 3, '0'))
                WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN '8900'
                ELSE concat('10', lpad(l_suppkey % 1000, 3, '0')) END AS debit""",
        "concat('3', lpad(l_partkey % 10000, 4, '0')) AS credit",
        "CAST(l_extendedprice AS DECIMAL(18, 2)) AS amount",
    )


def budget(spark: SparkSession, sf_dir: str) -> Budget:
    """Nations are the posts. Those of region 4 list no accounts, so part of the journal is not budgeted."""
    nation = table(spark, sf_dir, "nation")
    post = nation.selectExpr(
        "concat('N', n_nationkey) AS post_key",
        "n_name AS name",
        "CAST(n_nationkey + 1 AS INT) AS sort",
        "CASE WHEN n_nationkey < 13 THEN -1 ELSE 1 END AS factor",
    )
    parts = table(spark, sf_dir, "part").selectExpr(
        "concat('3', lpad(p_partkey % 10000, 4, '0')) AS account",
        "CAST(p_partkey % 10000 % 25 AS INT) AS nation",
        "CAST(p_partkey % 10000 div 25 AS INT) AS pos",
    )
    suppliers = table(spark, sf_dir, "supplier").selectExpr(
        "concat('6', lpad(s_suppkey % 1000, 3, '0')) AS account",
        "s_nationkey AS nation",
        "CAST(s_suppkey % 1000 + 400 AS INT) AS pos",
    )
    post_account = (
        parts.unionByName(suppliers)
        .distinct()
        .join(nation.where("n_regionkey <> 4"), F.expr("nation = n_nationkey"))
        .selectExpr("concat('N', nation) AS post_key", "pos", "account")
    )
    post_budget = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
        .groupBy(
            F.expr("CAST(year(o_orderdate) AS STRING) AS year"), F.expr("concat('N', c_nationkey) AS post_key")
        )
        .agg(F.expr("CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DECIMAL(18, 2)) AS amount"))
    )
    return Budget(post, post_account, post_budget)
