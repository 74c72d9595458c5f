"""The registered queries once more, as SQL for DuckDB over the generated tables.

Written independently of the library: key figures are one filtered sum each, reports are spelled out column by
column. Each query is a chain of common table expressions from the generated tables to its result.
"""

from __future__ import annotations

M = "DECIMAL(18, 2)"

STAR = f"""
star_orders AS (
  SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, CAST(o_orderdate AS DATE) AS day,
         'T' || o_orderkey AS order_id, 'c' || o_custkey || '@b.ch' AS account,
         lpad(CAST(((o_orderkey * 7919) % 86400) // 3600 AS VARCHAR), 2, '0') || ':' ||
         lpad(CAST(((o_orderkey * 7919) % 86400) // 60 % 60 AS VARCHAR), 2, '0') || ':' ||
         lpad(CAST(((o_orderkey * 7919) % 86400) % 60 AS VARCHAR), 2, '0') AS clock,
         CASE WHEN o_orderpriority LIKE '4%' OR o_orderpriority LIKE '5%' THEN 'Bar' ELSE 'VISA' END AS payment,
         o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AS refunded
  FROM orders),
sides AS (SELECT unnest([FALSE, TRUE]) AS back),
star_lines AS (
  SELECT o.*, s.back,
         CAST(CASE WHEN l_discount = 0.1 AND l_tax = 0.08 THEN 0
                   WHEN l_linenumber = 7 THEN l_quantity ELSE l_extendedprice END AS {M}) AS price,
         CASE WHEN NOT (l_discount = 0 AND l_tax = 0) THEN o.order_id END AS transaction_id,
         CAST(l_quantity AS BIGINT) AS quantity, p.p_name, p.p_size, p.p_type, p.p_brand,
         l_linestatus = 'O' AND l_returnflag = 'A' AS no_net
  FROM lineitem JOIN star_orders o ON l_orderkey = o.o_orderkey JOIN part p ON l_partkey = p.p_partkey
  JOIN sides s ON o.refunded OR NOT s.back),
star_sales AS (
  SELECT strftime(day, '%d.%m.%Y') || ', ' || substr(clock, 1, 5) AS sold_at,
         CASE WHEN NOT back THEN 'Verkauf' WHEN year(day) < 1998 THEN 'Refund' ELSE 'Rückerstattung' END AS kind,
         transaction_id, payment, quantity,
         CASE WHEN p_size = 1 THEN 'Hauptgang Vegi Standard'
              WHEN p_size = 2 THEN 'Hauptgang Fleisch  Reduziert'
              WHEN p_size = 3 THEN 'Hauptgang Vegi Praktikum'
              WHEN p_size = 4 THEN 'Kindermenü'
              WHEN p_size = 5 THEN 'Seniorenmittagstisch'
              WHEN p_size = 6 THEN 'Menü ganz'
              WHEN p_size = 7 THEN 'Dessert'
              WHEN p_size = 8 THEN ' Kaffee '
              WHEN p_size = 9 THEN 'Recircle Tupper Depot'
              WHEN p_size = 10 THEN 'Kerze klein'
              WHEN p_size = 11 THEN 'Miete'
              WHEN p_size = 12 THEN 'Buffet 1 (PO)'
              WHEN p_size = 13 THEN '  '
              WHEN p_size = 14 THEN 'SCHICHTWECHSEL'
              WHEN p_size = 15 THEN 'Trinkgeld'
              WHEN p_size = 16 THEN 'Mittagstisch-Nachmittag'
              WHEN p_size = 17 THEN '2-Gang-Menu (mit Vorspeise oder Dessert)'
              WHEN p_size = 18 THEN 'Vorsp. + Hauptsp. red.'
              WHEN p_size = 19 THEN 'Nachmittag-Abend'
              WHEN p_size = 20 THEN 'Praktika'
              ELSE p_name END AS description,
         CASE WHEN p_type = 'ECONOMY' THEN 'Mittagstisch'
              WHEN p_type = 'PROMO' AND p_brand IN ('Brand#7', 'Brand#8') THEN 'Kultur Essen (PO)'
              ELSE lower(p_type) END AS category,
         '' AS sku, 'CHF' AS currency, amount AS list_price,
         CAST(CASE WHEN back THEN NULL ELSE 0 END AS {M}) AS discount,
         amount AS price_gross, CASE WHEN no_net THEN NULL ELSE amount END AS price_net,
         CAST(CASE WHEN back THEN NULL ELSE 0 END AS {M}) AS tax, '' AS tax_rate,
         CASE WHEN back THEN NULL ELSE account END AS account
  FROM (SELECT *, CAST(CASE WHEN NOT back THEN price WHEN o_totalprice > 400000 THEN 1 - price ELSE -price END
                       AS {M}) AS amount FROM star_lines)),
star_booked AS (
  SELECT o.*, s.back, t.tip, CAST(CAST(o_totalprice AS {M}) + coalesce(t.tip, 0) AS {M}) AS amount
  FROM star_orders o JOIN sides s ON o.refunded OR NOT s.back
  JOIN (SELECT o_orderkey AS k, CAST(CASE o_orderpriority WHEN '2-HIGH' THEN 2.5 WHEN '3-MEDIUM' THEN NULL
                                     ELSE 0 END AS {M}) AS tip FROM orders) t ON t.k = o.o_orderkey),
star_transactions AS (
  SELECT strftime(day, '%Y-%m-%d') || ' ' || clock AS booked_at, order_id AS transaction_id,
         CASE WHEN back THEN 'Rückerstattung' ELSE 'Umsatz' END AS kind,
         CASE WHEN back THEN NULL
              WHEN o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM' THEN 'Geplant'
              WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' AND o_totalprice < 50000 THEN 'Fehlgeschlagen'
              ELSE 'Erfolgreich' END AS status,
         CASE WHEN back THEN NULL WHEN o_totalprice < 8000 THEN '1 x SCHICHTWECHSEL' ELSE '1 x Hauptgang' END
           AS description,
         CASE WHEN back THEN -amount ELSE amount END AS amount,
         CASE WHEN back THEN NULL ELSE tip END AS tip,
         CAST(CASE WHEN back THEN NULL WHEN payment = 'Bar' THEN 0 ELSE round(amount * 0.015, 2) END AS {M}) AS fee,
         CASE WHEN NOT back AND payment = 'Bar' THEN amount END AS net
  FROM (SELECT * FROM star_booked UNION ALL
        SELECT * FROM star_booked WHERE o_totalprice > 499000 AND NOT refunded))"""

PREPARE = f"""
norm_sales AS (
  SELECT * REPLACE (
    CASE WHEN description IN ('SCHICHTWECHSEL', 'Mittagstisch-Nachmittag', 'Nachmittag-Abend') THEN 0
         ELSE price_gross END AS price_gross,
    CASE WHEN description IN ('SCHICHTWECHSEL', 'Mittagstisch-Nachmittag', 'Nachmittag-Abend') THEN 0
         WHEN price_net IS NULL THEN price_gross ELSE price_net END AS price_net)
  FROM star_sales),
refund_ids AS (SELECT DISTINCT transaction_id FROM norm_sales WHERE kind IN ('Refund', 'Rückerstattung')),
clean_sales AS (
  SELECT * FROM norm_sales n
  WHERE NOT EXISTS (SELECT 1 FROM refund_ids r WHERE r.transaction_id = n.transaction_id)),
clean_transactions AS (
  SELECT * FROM star_transactions t
  WHERE NOT EXISTS (SELECT 1 FROM refund_ids r WHERE r.transaction_id IS NOT DISTINCT FROM t.transaction_id)),
shifts AS (
  SELECT date, max(time) AS shift_change
  FROM (SELECT CAST(substr(booked_at, 1, 10) AS DATE) AS date, substr(booked_at, 12, 8) AS time
        FROM clean_transactions WHERE description LIKE '%SCHICHTWECHSEL%')
  WHERE isodow(date) < 6 AND time > '12:00:00' AND time < '16:00:00'
  GROUP BY date),
base AS (
  SELECT transaction_id, amount AS commissioned_total, fee, coalesce(tip, 0) AS tip, substr(booked_at, 12, 8) AS time
  FROM clean_transactions WHERE kind = 'Umsatz' AND status = 'Erfolgreich'),
tip_lines AS (
  SELECT DISTINCT s.sold_at, s.kind, s.transaction_id, s.payment, CAST(1 AS BIGINT) AS quantity,
         'Trinkgeld' AS description, s.category, s.sku, s.currency, b.tip AS list_price,
         CAST(0 AS {M}) AS discount, b.tip AS price_gross, b.tip AS price_net, CAST(0 AS {M}) AS tax,
         CAST(NULL AS VARCHAR) AS tax_rate, s.account
  FROM clean_sales s JOIN base b ON b.transaction_id = s.transaction_id WHERE b.tip > 0),
lines AS (
  SELECT u.* REPLACE (trim(u.description) AS description),
         CAST(strptime(substr(u.sold_at, 1, 10), '%d.%m.%Y') AS DATE) AS date
  FROM (SELECT * FROM clean_sales UNION ALL SELECT * FROM tip_lines) u),
timed AS (
  SELECT l.*, b.time, isodow(l.date) IN (6, 7) AS weekend, coalesce(s.shift_change, '14:15:00') AS shift_change,
         CAST(round_even(CAST(price_gross AS DOUBLE) / CAST(nullif(commissioned_total, 0) AS DOUBLE)
              * CAST(fee AS DOUBLE), 4) AS DECIMAL(18, 4)) AS commission
  FROM lines l LEFT JOIN base b ON b.transaction_id = l.transaction_id LEFT JOIN shifts s ON s.date = l.date),
topics AS (
  SELECT *,
    CASE WHEN category = 'Mittagstisch' THEN 'MiTi'
         WHEN contains(category, ' (PO)') THEN 'Culture'
         WHEN starts_with(description, 'Recircle Tupper Depot') THEN 'Packaging'
         WHEN starts_with(description, 'Kerze') THEN 'Culture'
         WHEN description = 'Miete' THEN 'Rental'
         WHEN time >= '06:00:00' AND time < '18:00:00' AND weekend THEN 'Culture'
         WHEN time >= '06:00:00' AND time <= shift_change AND NOT weekend THEN 'MiTi'
         WHEN time > shift_change AND time < '18:00:00' AND NOT weekend THEN 'Cafe'
         ELSE 'Culture' END AS topic
  FROM timed),
prepared AS (
  SELECT account, date, time, CASE kind WHEN 'Verkauf' THEN 'Sales' ELSE 'Refund' END AS type, transaction_id,
    CASE payment WHEN 'Bar' THEN 'Cash' ELSE 'Card' END AS payment_method, quantity, description, currency,
    price_gross, price_net, commission, topic,
    CASE WHEN topic NOT IN ('MiTi', 'Culture') THEN NULL
         WHEN category = 'Mittagstisch' THEN 'MiTi'
         WHEN contains(category, ' (PO)') THEN 'PaidOut'
         WHEN topic = 'Culture' AND contains(description, ' (PO)') THEN 'PaidOut'
         WHEN topic = 'MiTi' AND (regexp_matches(description, 'Hauptgang|Kinderteller|Senioren-Mittagstisch'
              '|Seniorenmittagstisch|Kindermenü|Kinderpasta|Menü|Dessert|Praktik|Vorspeise'
              '|Vorsp\\. \\+ Hauptsp\\.|Hauptspeise|Trinkgeld') OR (description = '' AND price_gross >= 5)) THEN 'MiTi'
         ELSE 'LoLa' END AS owner,
    CASE WHEN contains(description, 'Trinkgeld') THEN 'Tip' ELSE 'Consumption' END AS purpose,
    CAST(NULL AS VARCHAR) AS comment
  FROM topics)"""


def _edited(faulty: bool) -> str:
    wrong_topic = "WHEN d = 'red rod' THEN 'Vermiet' WHEN w = 'old' THEN 'MiTi'" if faulty else ""
    wrong_owner = (
        "WHEN d = 'blue rod' THEN 'LoLa' WHEN d = 'new rod' THEN NULL WHEN d = 'new bolt' THEN 'miti' "
        "WHEN d = 'old rod' THEN 'PaidOut'"
        if faulty
        else ""
    )
    wrong_purpose = "WHEN d = 'cold rod' THEN 'Spende'" if faulty else ""
    return f"""
edits AS (
  SELECT * FROM (
    SELECT d,
      CASE {wrong_topic} WHEN w = 'red' THEN 'Verm' WHEN w = 'blue' THEN 'SoFe' WHEN w = 'cold' THEN 'Deposit'
           WHEN w = 'new' THEN 'Culture' WHEN w = 'hot' THEN 'Rental' END AS topic,
      CASE {wrong_owner} WHEN w = 'new' THEN 'PaidOut' END AS owner,
      CASE {wrong_purpose} WHEN d LIKE '%ring' THEN 'Tip' ELSE 'Consumption' END AS purpose
    FROM (SELECT DISTINCT p_name AS d, split_part(p_name, ' ', 1) AS w FROM part))
  WHERE topic IS NOT NULL),
intermediate AS (
  SELECT p.* REPLACE (
    CASE WHEN e.d IS NULL THEN p.topic ELSE e.topic END AS topic,
    CASE WHEN e.d IS NULL THEN p.owner ELSE e.owner END AS owner,
    CASE WHEN e.d IS NULL THEN p.purpose ELSE e.purpose END AS purpose,
    CASE WHEN e.d IS NULL THEN p.comment ELSE 'edited' END AS comment)
  FROM prepared p LEFT JOIN edits e ON e.d = p.description)"""


def _net(alias: str, predicate: str) -> str:
    return f"CAST(round_even(sum(coalesce(price_net, 0)) FILTER (WHERE {predicate}), 2) AS {M}) AS {alias}"


def _fee(alias: str, predicate: str) -> str:
    return f"CAST(round_even(sum(coalesce(commission, 0)) FILTER (WHERE {predicate}), 2) AS {M}) AS {alias}"


def _meals(alias: str, predicate: str) -> str:
    miti = "topic = 'MiTi' AND owner = 'MiTi' AND purpose <> 'Tip'"
    return f"CAST(sum(coalesce(quantity, 0)) FILTER (WHERE {miti} AND ({predicate})) AS BIGINT) AS {alias}"


def _figures() -> list[str]:
    out = []
    for topic in ("MiTi", "Cafe", "Verm", "SoFe", "Deposit", "Packaging", "Rental", "Culture"):
        for method in ("Cash", "Card"):
            out.append(
                _net(
                    f"{topic}_{method}".lower(),
                    f"topic = '{topic}' AND payment_method = '{method}' AND purpose <> 'Tip'",
                )
            )
    for owner in ("LoLa", "PaidOut"):
        for method in ("Cash", "Card"):
            out.append(
                _net(
                    f"culture_{owner}_{method}".lower(),
                    f"topic = 'Culture' AND owner = '{owner}' AND payment_method = '{method}' AND purpose <> 'Tip'",
                )
            )
    out += [
        _net("cafe_tips", "topic = 'Cafe' AND purpose = 'Tip'"),
        _net("miti_tips", "topic = 'MiTi' AND purpose = 'Tip'"),
        _net("verm_tips", "topic = 'Verm' AND purpose = 'Tip'"),
        _net("miti_tips_cash", "topic = 'MiTi' AND payment_method = 'Cash' AND purpose = 'Tip'"),
        _net("miti_tips_card", "topic = 'MiTi' AND payment_method = 'Card' AND purpose = 'Tip'"),
        _net("tips_cash", "payment_method = 'Cash' AND purpose = 'Tip'"),
        _net("tips_card", "payment_method = 'Card' AND purpose = 'Tip'"),
        _fee("miti_commission", "topic = 'MiTi' AND owner = 'MiTi'"),
        _fee("lola_commission", "topic <> 'MiTi' OR owner = 'LoLa'"),
        _fee("lola_commission_miti", "topic = 'MiTi' AND owner = 'LoLa'"),
        _fee("miti_total_commission", "topic = 'MiTi'"),
        _net("gross_miti_miti", "topic = 'MiTi' AND owner = 'MiTi' AND purpose <> 'Tip'"),
        _net("gross_miti_lola", "topic = 'MiTi' AND owner = 'LoLa' AND purpose <> 'Tip'"),
        _net(
            "gross_miti_miti_card",
            "topic = 'MiTi' AND owner = 'MiTi' AND payment_method = 'Card' AND purpose <> 'Tip'",
        ),
    ]
    return out + MEALS


MEALS = [
    _meals(
        "meal_count_regular",
        "(description LIKE '%Hauptgang%' AND description NOT LIKE '%Kinder%' AND description NOT LIKE '%Reduziert%' "
        "AND description NOT LIKE '%Praktikum%') OR description LIKE '%Seniorenmittagstisch%' "
        "OR description LIKE '%Senioren-Mittagstisch%' OR description LIKE '%Gang-Menu%' "
        "OR description LIKE '%Hauptsp%' OR description LIKE 'Menü%' OR description LIKE 'Praktika%'",
    ),
    _meals("meal_count_reduced", "description LIKE '%Reduziert'"),
    _meals("meal_count_praktikum", "description LIKE '%Praktikum'"),
    _meals("meal_count_children", "description LIKE '%Kinder%'"),
    _net(
        "total_praktikum",
        "topic = 'MiTi' AND owner = 'MiTi' AND purpose <> 'Tip' AND description LIKE '%Praktikum'",
    ),
]

COUNTS = ["meal_count_regular", "meal_count_reduced", "meal_count_children", "meal_count_praktikum"]

FIGURES = f"""
figures AS (
  SELECT strftime(date, '%Y%m') AS month, date, {", ".join(_figures())}
  FROM intermediate GROUP BY date)"""


def _z(name: str) -> str:
    return f"coalesce({name}, 0)"


def _r(formula: str, alias: str) -> str:
    return f"CAST(round_even({formula}, 2) AS {M}) AS {alias}"


def _pair(name: str) -> str:
    return _r(f"{_z(name + '_cash')} + {_z(name + '_card')}", f"{name}_total")


_TOPICS = ["miti", "cafe", "verm", "sofe", "deposit", "packaging", "rental", "culture"]

DETAILS = f"""
level1 AS (
  SELECT *, {", ".join(_pair(n) for n in [*_TOPICS, "culture_lola", "culture_paidout", "tips"])},
    {_r(" + ".join(_z(t + "_cash") for t in _TOPICS), "gross_cash")},
    {_r(" + ".join(_z(t + "_card") for t in _TOPICS), "gross_card")},
    {_r(_z("miti_card"), "gross_card_miti")},
    {_r("coalesce(miti_commission, 0) + coalesce(lola_commission, 0)", "total_commission")},
    {_r("coalesce(gross_miti_lola, 0) - coalesce(lola_commission_miti, 0)", "net_miti_lola")},
    CAST(2 * (coalesce(meal_count_reduced, 0) + coalesce(meal_count_praktikum, 0)) AS {M}) AS sponsored_reductions
  FROM figures),
level2 AS (
  SELECT *,
    {_r("gross_card - coalesce(miti_card, 0)", "gross_card_lola")},
    {_r("gross_cash + coalesce(tips_cash, 0)", "sumup_cash")},
    {_r("gross_card + coalesce(tips_card, 0)", "sumup_card")},
    {_r("gross_card - total_commission", "net_card_total")},
    {_r("0.2 * net_miti_lola", "contribution_miti")},
    {_r("net_miti_lola * 0.8", "share_lola")},
    {_r("coalesce(miti_card, 0) + coalesce(miti_tips_card, 0) - coalesce(miti_total_commission, 0)",
        "net_payment_sumup_miti")}
  FROM level1),
details AS (
  SELECT month, date,
    sumup_cash AS su_cash, sumup_card AS su_card, sumup_cash + sumup_card AS su_total, tips_total AS su_tips,
    miti_cash, miti_card, miti_total, cafe_cash, cafe_card, cafe_total, culture_cash, culture_card, culture_total,
    culture_lola_cash, culture_lola_card, culture_lola_total,
    culture_paidout_cash, culture_paidout_card, culture_paidout_total,
    verm_cash, verm_card, verm_total, packaging_cash, packaging_card, packaging_total,
    deposit_cash, deposit_card, deposit_total, rental_cash, rental_card, rental_total,
    sofe_cash, sofe_card, sofe_total, gross_cash, tips_cash, sumup_cash, gross_card, tips_card, sumup_card,
    gross_cash + gross_card AS gross_total, tips_total, sumup_cash + sumup_card AS sumup_total, gross_card_miti,
    miti_commission, gross_card_miti - coalesce(miti_commission, 0) AS net_card_miti, gross_card_lola,
    lola_commission, lola_commission_miti, gross_card_lola - coalesce(lola_commission, 0) AS net_card_lola,
    gross_card AS gross_card_total, total_commission, net_card_total, net_payment_sumup_miti,
    miti_tips_cash, miti_tips_card, miti_tips, cafe_tips, verm_tips, gross_miti_miti, gross_miti_lola,
    gross_miti_miti_card,
    coalesce(gross_miti_miti_card, 0) - coalesce(miti_commission, 0) AS net_miti_miti_card,
    net_miti_lola, contribution_miti, share_lola, sponsored_reductions,
    net_payment_sumup_miti - share_lola + sponsored_reductions AS debt_to_miti,
    coalesce(gross_miti_lola, 0) - contribution_miti AS income_lola_miti,
    net_card_total + coalesce(tips_card, 0) AS paidout_sumup,
    meal_count_regular, meal_count_reduced, meal_count_children, meal_count_praktikum, total_praktikum
  FROM level2)"""

MEASURES = [
    *["su_cash", "su_card", "su_total", "su_tips", "miti_cash", "miti_card", "miti_total", "cafe_cash", "cafe_card"],
    *["cafe_total", "culture_cash", "culture_card", "culture_total", "culture_lola_cash", "culture_lola_card"],
    *["culture_lola_total", "culture_paidout_cash", "culture_paidout_card", "culture_paidout_total", "verm_cash"],
    *["verm_card", "verm_total", "packaging_cash", "packaging_card", "packaging_total", "deposit_cash"],
    *["deposit_card", "deposit_total", "rental_cash", "rental_card", "rental_total", "sofe_cash", "sofe_card"],
    *["sofe_total", "gross_cash", "tips_cash", "sumup_cash", "gross_card", "tips_card", "sumup_card", "gross_total"],
    *["tips_total", "sumup_total", "gross_card_miti", "miti_commission", "net_card_miti", "gross_card_lola"],
    *["lola_commission", "lola_commission_miti", "net_card_lola", "gross_card_total", "total_commission"],
    *["net_card_total", "net_payment_sumup_miti", "miti_tips_cash", "miti_tips_card", "miti_tips", "cafe_tips"],
    *["verm_tips", "gross_miti_miti", "gross_miti_lola", "gross_miti_miti_card", "net_miti_miti_card"],
    *["net_miti_lola", "contribution_miti", "share_lola", "sponsored_reductions", "debt_to_miti"],
    *["income_lola_miti", "paidout_sumup", "meal_count_regular", "meal_count_reduced", "meal_count_children"],
    *["meal_count_praktikum", "total_praktikum"],
]


def _summed(name: str) -> str:
    kind = "BIGINT" if name in COUNTS else M
    return f"CAST(coalesce(sum({name}), 0) AS {kind}) AS {name}"


TOTALS = f"""
full_details AS (
  SELECT month, date, FALSE AS is_total, {", ".join(MEASURES)} FROM details
  UNION ALL
  SELECT month, NULL, TRUE, {", ".join(_summed(m) for m in MEASURES)} FROM details GROUP BY month)"""

ACCOUNTING = f"""
accounting AS (
  SELECT month, is_total, date,
    CAST(net_card_total + coalesce(tips_card, 0) AS {M}) AS payment_sumup,
    CAST(gross_cash - coalesce(miti_cash, 0) - culture_paidout_total AS {M}) AS total_cash_debit,
    CAST(gross_card_lola + coalesce(tips_card, 0) - coalesce(miti_tips_card, 0) AS {M}) AS total_card_debit,
    deposit_cash AS p10000_23050, cafe_cash AS p10000_30200, verm_cash AS p10000_30700, sofe_cash AS p10000_30810,
    rental_cash AS p10000_31000, culture_lola_cash AS p10000_32000, packaging_cash AS p10000_46000,
    culture_paidout_cash AS p10000_20121, culture_paidout_card AS p10920_20121,
    culture_paidout_total AS p20121_10000,
    deposit_card AS p10920_23050, cafe_card AS p10920_30200, verm_card AS p10920_30700, sofe_card AS p10920_30810,
    rental_card AS p10920_31000, culture_lola_card AS p10920_32000, packaging_card AS p10920_46000,
    CAST(net_card_miti + coalesce(miti_tips_card, 0) AS {M}) AS p10920_20051,
    CAST(coalesce(tips_card, 0) - coalesce(miti_tips_card, 0) AS {M}) AS p10920_10910,
    lola_commission AS p68450_10920, sponsored_reductions AS p59991_20051, total_praktikum AS p59991_20120,
    debt_to_miti AS p20051_10930, income_lola_miti AS p20051_30500, debt_to_miti AS p10930_10100
  FROM full_details),
nets AS (
  SELECT *,
    p10920_30200 + p10920_30700 + p10920_30810 + p10920_23050 + p10920_31000 + p10920_32000 + p10920_46000
      + p10920_20051 + p10920_20121 + p10920_10910 - payment_sumup - p68450_10920 AS n10920,
    p10000_20121 + p10920_20121 - p20121_10000 AS n20121,
    p10920_20051 - p20051_10930 - p20051_30500 + p59991_20051 AS n20051
  FROM accounting)"""

POSTING_COLUMNS = [
    *["p10000_23050", "p10000_30200", "p10000_30700", "p10000_30810", "p10000_31000", "p10000_32000", "p10000_46000"],
    *["p10000_20121", "p10920_20121", "p20121_10000", "p10920_23050", "p10920_30200", "p10920_30700", "p10920_30810"],
    *["p10920_31000", "p10920_32000", "p10920_46000", "p10920_20051", "p10920_10910", "p68450_10920", "p59991_20051"],
    *["p59991_20120", "p20051_10930", "p20051_30500", "p10930_10100"],
]

POSTINGS = f"""
texts(posting, text) AS (VALUES
  ('p10000_23050', 'Schlüsseldepot bar'), ('p10000_30200', 'Cafe bar'),
  ('p10000_30700', 'Verkäufe bei Vermietung bar'), ('p10000_30810', 'Sommerfest bar'),
  ('p10000_31000', 'Vermietungen bar'), ('p10000_32000', 'Kulturverkäufe bar'), ('p10000_46000', 'Recircle bar'),
  ('p10000_20121', 'Kooperation bar'), ('p10920_20121', 'Kooperation Karte'),
  ('p20121_10000', 'Kooperation Ausbezahlt'), ('p10920_23050', 'Schlüsseldepot Karte'),
  ('p10920_30200', 'Cafe Karte'), ('p10920_30700', 'Verkäufe Vermietung Karte'),
  ('p10920_30810', 'Sommerfest Karte'), ('p10920_31000', 'Vermietungen Karte'),
  ('p10920_32000', 'Kulturverkäufe Karte'), ('p10920_46000', 'Recircle Karte'),
  ('p10920_20051', 'Netto-Ertrag + Tips Karte MiTi'), ('p10920_10910', 'Tips Karte LoLa'),
  ('p68450_10920', 'Kartenkommission'), ('p59991_20051', 'Preisreduktionen'), ('p59991_20120', 'Essen Praktikum'),
  ('p20051_10930', 'Anteil MiTi'), ('p20051_30500', 'Verkäufe Mittagstisch LoLa'),
  ('p10930_10100', 'Überweisung an MiTi')),
summary AS (
  SELECT u.month,
    CASE WHEN posting <> 'p10930_10100' THEN last_day(strptime(u.month || '01', '%Y%m%d')) END AS datum,
    'SU ' || text AS beschreibung, substr(posting, 2, 5) AS kt_soll, substr(posting, 8, 5) AS kt_haben, betrag_chf
  FROM (SELECT month, unnest(ARRAY[{", ".join(f"'{c}'" for c in POSTING_COLUMNS)}]) AS posting,
               unnest([{", ".join(POSTING_COLUMNS)}]) AS betrag_chf FROM accounting WHERE is_total) u
  JOIN texts USING (posting)
  WHERE betrag_chf <> 0),
correction AS (
  SELECT month, last_day(strptime(month || '01', '%Y%m%d')) AS datum, 'SU Rundungskorrektur 20051' AS beschreibung,
    CASE WHEN n20051 > 0 THEN '20051' ELSE '68450' END AS kt_soll,
    CASE WHEN n20051 < 0 THEN '20051' ELSE '68450' END AS kt_haben, abs(n20051) AS betrag_chf
  FROM nets WHERE is_total AND n20051 <> 0),
detail_postings AS (
  SELECT strftime(date, '%Y%m') AS month, date AS datum, description AS beschreibung,
         CASE payment_method WHEN 'Card' THEN '10920' ELSE '10000' END AS kt_soll, '31000' AS kt_haben,
         price_net AS betrag_chf
  FROM intermediate WHERE topic = 'Rental'
  UNION ALL
  SELECT strftime(date, '%Y%m'), date,
         CASE payment_method WHEN 'Card' THEN 'SU Kooperation Karte' ELSE 'SU Kooperation bar' END,
         CASE payment_method WHEN 'Card' THEN '10920' ELSE '10000' END, '20121', sum(coalesce(price_net, 0))
  FROM intermediate WHERE owner = 'PaidOut' GROUP BY date, payment_method
  UNION ALL
  SELECT strftime(date, '%Y%m'), date, 'SU Kooperation Ausbezahlt', '20121', '10000', sum(coalesce(price_net, 0))
  FROM intermediate WHERE owner = 'PaidOut' GROUP BY date)"""

LEDGER_COLUMNS = (
    "month, datum, {blank} AS beleg, {blank} AS rechnung, beschreibung, kt_soll, kt_haben, {blank} AS anzahl, "
    "{blank} AS einheit, {blank} AS preis_einheit, CAST(betrag_chf AS DOUBLE) AS betrag_chf"
)
BLANK = LEDGER_COLUMNS.format(blank="''")
MISSING = LEDGER_COLUMNS.format(blank="CAST(NULL AS VARCHAR)")

FIRST_MONTH, CLOSING_MONTH = "199810", "199907"

CLOSING = f"""
journal AS (
  SELECT CAST(l_shipdate AS DATE) AS date,
    CASE WHEN l_returnflag = 'R' THEN '6' || lpad(CAST(l_suppkey % 1000 AS VARCHAR), 3, '0')
         WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN '8900'
         ELSE '10' || lpad(CAST(l_suppkey % 1000 AS VARCHAR), 3, '0') END AS debit,
    '3' || lpad(CAST(l_partkey % 10000 AS VARCHAR), 4, '0') AS credit,
    CAST(l_extendedprice AS {M}) AS amount
  FROM lineitem),
post AS (
  SELECT 'N' || n_nationkey AS post_key, n_name AS name, n_nationkey + 1 AS sort,
         CASE WHEN n_nationkey < 13 THEN -1 ELSE 1 END AS factor, n_regionkey
  FROM nation),
listed AS (
  SELECT DISTINCT '3' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') AS account,
         'N' || (p_partkey % 10000 % 25) AS post_key, p_partkey % 10000 // 25 AS pos FROM part
  UNION
  SELECT DISTINCT '6' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0'), 'N' || s_nationkey, s_suppkey % 1000 + 400
  FROM supplier),
post_account AS (SELECT l.* FROM listed l JOIN post p USING (post_key) WHERE p.n_regionkey <> 4),
account_post AS (
  SELECT account, name, sort, factor, post_key FROM post_account JOIN post USING (post_key)
  QUALIFY row_number() OVER (PARTITION BY account ORDER BY sort) = 1),
year_budget AS (
  SELECT 'N' || c_nationkey AS post_key, sum(CAST(o_totalprice AS {M})) AS budget
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) = 1999 GROUP BY ALL),
movements AS (
  SELECT date, account, amount
  FROM (SELECT date, debit AS account, amount FROM {{journal}}
        UNION ALL SELECT date, credit, -amount FROM {{journal}})
  WHERE regexp_matches(account, '^[3456789][0-9]{{{{3,4}}}}$') AND date < DATE '1999-08-01'),
balances AS (SELECT account, sum(amount) AS balance FROM movements GROUP BY account),
closing AS (
  SELECT '{CLOSING_MONTH}' AS month, name AS "group", CAST(sort AS INTEGER) AS sort,
         coalesce(budget, 0) AS budget, sum(balance * factor) AS net, factor
  FROM balances JOIN account_post USING (account) LEFT JOIN year_budget USING (post_key)
  WHERE account <> '8900' GROUP BY ALL)"""

CLOSING_RESULT = (
    'SELECT month, "group", sort, CAST(budget AS DOUBLE) AS budget, CAST(net AS DOUBLE) AS net, '
    "CAST((budget - net) * factor AS DOUBLE) AS remaining FROM closing"
)


def _chain(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def _closing(journal: str = "journal") -> str:
    return CLOSING.format(journal=journal)


def _doubles(names: list[str]) -> str:
    return ", ".join(n if n in COUNTS else f"CAST({n} AS DOUBLE) AS {n}" for n in names)


SALES_OUT = (
    "sold_at, kind, transaction_id, payment, quantity, description, category, sku, currency, "
    "CAST(list_price AS DOUBLE) AS list_price, CAST(discount AS DOUBLE) AS discount, "
    "CAST(price_gross AS DOUBLE) AS price_gross, CAST(price_net AS DOUBLE) AS price_net, "
    "CAST(tax AS DOUBLE) AS tax, tax_rate, account"
)
TRANSACTIONS_OUT = (
    "booked_at, transaction_id, kind, status, description, CAST(amount AS DOUBLE) AS amount, "
    "CAST(tip AS DOUBLE) AS tip, CAST(fee AS DOUBLE) AS fee, CAST(net AS DOUBLE) AS net"
)
INTERMEDIATE_OUT = (
    "account, date, time, type, transaction_id, payment_method, quantity, description, currency, "
    "CAST(price_gross AS DOUBLE) AS price_gross, CAST(price_net AS DOUBLE) AS price_net, "
    "CAST(commission AS DOUBLE) AS commission, topic, owner, purpose, comment"
)
CHECKED_OUT = (
    "date, time, transaction_id, payment_method, description, CAST(price_net AS DOUBLE) AS price_net, topic, owner, "
    "purpose, comment"
)
OWNER_RULES = """
  SELECT *, 'miti_without_owner' AS rule FROM intermediate WHERE topic = 'MiTi' AND coalesce(owner, '') = ''
  UNION ALL
  SELECT *, 'culture_without_owner' FROM intermediate WHERE topic = 'Culture' AND coalesce(owner, '') = ''
  UNION ALL
  SELECT *, 'owner_not_allowed' FROM intermediate
  WHERE topic NOT IN ('MiTi', 'Culture') AND coalesce(owner, '') <> ''"""


BROKEN_OUT = """
    account, CASE WHEN quantity <> 7 OR quantity IS NULL THEN date END AS date,
    CASE WHEN quantity NOT IN (1, 2) OR quantity IS NULL THEN time END AS time, type, transaction_id, payment_method,
    CASE WHEN quantity <> 5 THEN quantity END AS quantity, description, currency,
    CAST(price_gross AS DOUBLE) AS price_gross,
    CASE WHEN quantity <> 3 OR quantity IS NULL THEN CAST(price_net AS DOUBLE) END AS price_net,
    CASE WHEN quantity <> 4 OR quantity IS NULL THEN CAST(commission AS DOUBLE) END AS commission,
    CASE WHEN quantity <> 6 OR quantity IS NULL THEN topic END AS topic, owner, purpose, comment"""
"""The intermediate table after a reading in which cells of rows with some numbers of pieces do not parse."""


def _by_month(period: str) -> str:
    """Closings of the months from FIRST_MONTH on, each from all movements before its end that ``period`` admits."""
    tables = _closing().split("year_budget AS")[0].rstrip().rstrip(",")
    return f"""{_chain(tables)},
        months AS (SELECT strftime(m, '%Y%m') AS month, m + INTERVAL 1 MONTH AS cut
                   FROM (SELECT unnest(generate_series(DATE '{FIRST_MONTH[:4]}-{FIRST_MONTH[4:]}-01',
                         DATE '{CLOSING_MONTH[:4]}-{CLOSING_MONTH[4:]}-01', INTERVAL 1 MONTH)) AS m)),
        mv AS (SELECT date, debit AS account, amount FROM journal UNION ALL SELECT date, credit, -amount FROM journal
               UNION ALL SELECT make_date(y, 1, 1), account, 0 FROM post_account, (VALUES (1998), (1999)) AS v(y)
               WHERE pos = 0),
        yearly AS (SELECT 'N' || c_nationkey AS post_key, year(o_orderdate) AS year, sum(CAST(o_totalprice AS {M})) AS budget
                   FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
        nets AS (SELECT months.month, post_key, name, sort, factor, sum(amount * factor) AS net
                 FROM mv JOIN months ON mv.date < months.cut AND {period} JOIN account_post USING (account)
                 WHERE account <> '8900' AND regexp_matches(account, '^[3456789][0-9]{{3,4}}$') GROUP BY ALL)
        SELECT month, name AS "group", CAST(sort AS INTEGER) AS sort, CAST(coalesce(budget, 0) AS DOUBLE) AS budget,
               CAST(net AS DOUBLE) AS net, CAST((coalesce(budget, 0) - net) * factor AS DOUBLE) AS remaining
        FROM nets n LEFT JOIN yearly y ON n.post_key = y.post_key AND CAST(left(month, 4) AS INTEGER) = y.year"""


def _per_site(chain: str, select: str) -> str:
    """The same chain once for each of two sites, which number their transactions from their own orders."""
    parts = []
    for site in (0, 1):
        own = chain.replace("FROM orders", f"FROM (SELECT * FROM orders WHERE o_orderkey % 2 = {site})")
        own = own.replace("'T' || o_orderkey", "'T' || (o_orderkey // 2)")
        parts.append(f"SELECT 's{site}' AS site, * FROM ({own} {select})")
    return " UNION ALL ".join(parts)


def _per_site_journal(sql: str) -> str:
    """``sql`` on the journal of each site, against the budget of all."""
    parts = [sql.replace("FROM lineitem", f"FROM (SELECT * FROM lineitem WHERE l_orderkey % 2 = {k})") for k in (0, 1)]
    return " UNION ALL ".join(f"SELECT 's{k}' AS site, * FROM ({part})" for k, part in enumerate(parts))


def _cell(name: str) -> str:
    cell = {
        "sold_at": "'\"' || CASE quantity WHEN 23 THEN '31.02.' || substr(sold_at, 7) ELSE sold_at END || '\"'",
        "quantity": "CASE quantity WHEN 13 THEN 'x13' ELSE CAST(quantity AS VARCHAR) END",
    }
    return cell.get(name, f"coalesce(CAST({name} AS VARCHAR), '')")


_SALES_CELLS = [
    *["sold_at", "kind", "transaction_id", "payment", "quantity", "description", "category", "sku", "currency"],
    *["list_price", "discount", "price_gross", "price_net", "tax", "tax_rate", "account"],
]

BROKEN_SALES = f"""
broken AS (
  SELECT *, substr(sold_at, 7, 4) || substr(sold_at, 4, 2) AS month,
    {" || ',' || ".join(_cell(c) for c in _SALES_CELLS[:-1])} ||
    CASE quantity WHEN 19 THEN '' WHEN 17 THEN ',' || {_cell("account")} || ',more' ELSE ',' || {_cell("account")} END AS line
  FROM star_sales),
placed AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY line) + 1 AS row FROM broken)"""
"""Each month is a file: a header, then the lines in order."""

_IN_FILE = ", ".join(f"{c} NULLS FIRST" for c in (
    *["account", "date", "time", "type", "transaction_id", "payment_method", "quantity", "description", "currency"],
    *["price_gross", "price_net", "commission", "topic", "owner", "purpose", "comment"],
))

LEDGER_RESULT = f"""
            SELECT {BLANK} FROM summary WHERE (month, kt_haben) NOT IN (SELECT (month, kt_haben) FROM replaced)
            UNION ALL
            SELECT {MISSING} FROM correction
            WHERE (month, kt_haben) NOT IN (SELECT (month, kt_haben) FROM replaced)
            UNION ALL
            SELECT {BLANK} FROM detail_postings"""


SHIFTS = "description IN ('SCHICHTWECHSEL', 'Mittagstisch-Nachmittag', 'Nachmittag-Abend')"


def oracle_sql() -> dict[str, str]:
    prepare = _chain(STAR, PREPARE)
    export = _chain(STAR, PREPARE, _edited(False))
    faulty = _chain(STAR, PREPARE, _edited(True))
    figures = _chain(STAR, PREPARE, _edited(False), FIGURES)
    details = _chain(STAR, PREPARE, _edited(False), FIGURES, DETAILS)
    totals = _chain(STAR, PREPARE, _edited(False), FIGURES, DETAILS, TOTALS)
    accounting = _chain(STAR, PREPARE, _edited(False), FIGURES, DETAILS, TOTALS, ACCOUNTING)
    postings = _chain(STAR, PREPARE, _edited(False), FIGURES, DETAILS, TOTALS, ACCOUNTING, POSTINGS)
    figure_names = [f.rsplit(" AS ", 1)[1] for f in _figures()]
    meal_names = [f.rsplit(" AS ", 1)[1] for f in MEALS]
    missing = """
      SELECT {side}.transaction_id, count(*) AS n_rows FROM {side}
      WHERE NOT EXISTS (SELECT 1 FROM {other} WHERE {other}.transaction_id = {side}.transaction_id)
      GROUP BY {side}.transaction_id"""
    ids = """,
      s AS (SELECT transaction_id FROM star_sales WHERE transaction_id IS NOT NULL),
      t AS (SELECT transaction_id FROM star_transactions
            WHERE status IN ('Erfolgreich', 'Geplant') AND transaction_id IS NOT NULL)"""
    in_sales, in_transactions = missing.format(side="t", other="s"), missing.format(side="s", other="t")
    posting_names = [*["payment_sumup", "total_cash_debit", "total_card_debit"], *POSTING_COLUMNS]
    with_dummies = (
        "(SELECT * FROM journal UNION ALL SELECT DATE '1999-01-01', account, account, 0 FROM post_account "
        "WHERE pos = 0)"
    )
    return {
        "normalize_sales": f"{prepare} SELECT {SALES_OUT} FROM norm_sales",
        "normalize_transactions": f"""{_chain(STAR)}
            SELECT {TRANSACTIONS_OUT} FROM (SELECT * REPLACE (coalesce(net, amount) AS net) FROM star_transactions)""",
        "missing_in_sales": f"{_chain(STAR)}{ids} {in_sales}",
        "missing_in_transactions": f"{_chain(STAR)}{ids} {in_transactions}",
        "reconcile": f"""{_chain(STAR)}{ids}
            SELECT *, 'sales' AS missing_in FROM ({in_sales}) UNION ALL
            SELECT *, 'transactions' FROM ({in_transactions})""",
        "refund_violations": f"""{prepare}
            SELECT transaction_id, CAST(sum(price_net) AS DOUBLE) AS total_net FROM norm_sales
            WHERE transaction_id IN (SELECT transaction_id FROM refund_ids)
            GROUP BY transaction_id HAVING sum(price_net) <> 0""",
        "drop_refunded_sales": f"{prepare} SELECT {SALES_OUT} FROM clean_sales",
        "drop_refunded_transactions": f"{prepare} SELECT {TRANSACTIONS_OUT} FROM clean_transactions",
        "duplicate_transactions": f"""{_chain(STAR)}
            SELECT transaction_id, count(*) AS n_rows FROM star_transactions
            WHERE kind = 'Umsatz' AND status = 'Erfolgreich' GROUP BY transaction_id HAVING count(*) > 1""",
        "shift_changes": f"{prepare} SELECT date, shift_change FROM shifts",
        "commission_base": f"""{prepare}
            SELECT transaction_id, CAST(commissioned_total AS DOUBLE) AS commissioned_total,
                   CAST(fee AS DOUBLE) AS fee, CAST(tip AS DOUBLE) AS tip, time FROM base""",
        "tip_lines": f"{prepare} SELECT {SALES_OUT} FROM tip_lines",
        "tip_lines_per_transaction": f"""{prepare}
            SELECT {SALES_OUT} FROM (SELECT * FROM tip_lines QUALIFY row_number() OVER (
              PARTITION BY transaction_id, price_net ORDER BY sold_at, kind, payment, category, sku, currency, account) = 1)""",
        "allocate_commission": f"""{prepare}
            SELECT transaction_id, description, CAST(price_gross AS DOUBLE) AS price_gross,
                   CAST(commission AS DOUBLE) AS commission FROM prepared""",
        "infer_topic": f"{prepare} SELECT transaction_id, date, time, description, topic FROM prepared",
        "infer_owner": f"{prepare} SELECT transaction_id, description, topic, owner FROM prepared",
        "infer_labels": f"""{prepare}
            SELECT topic, owner, purpose, type, payment_method, count(*) AS n_rows FROM prepared GROUP BY ALL""",
        "prepare_intermediate": f"{prepare} SELECT {INTERMEDIATE_OUT} FROM prepared",
        "apply_overrides": f"{export} SELECT {INTERMEDIATE_OUT} FROM intermediate",
        "reread_intermediate": f"{export} SELECT {BROKEN_OUT} FROM intermediate",
        "read_cells_csv": f"""{export}
            SELECT {BROKEN_OUT} FROM (SELECT * REPLACE (nullif(description, '') AS description) FROM intermediate)""",
        "stored_intermediate": f"{export} SELECT {INTERMEDIATE_OUT}, strftime(date, '%Y%m') AS month FROM intermediate",
        "stored_report": f"""{accounting}
            SELECT month, count(*) AS n_rows, count(date) AS n_days, CAST(sum(payment_sumup) AS DOUBLE) AS paid
            FROM accounting GROUP BY month""",
        "read_sales_csv": f"""{prepare}
            SELECT {SALES_OUT} FROM (SELECT * REPLACE ('say "' || description || '", twice' AS description,
                nullif(tax_rate, '') AS tax_rate, nullif(sku, '') AS sku, coalesce(price_net, price_gross) AS price_net)
              FROM star_sales)""",
        "read_transactions_csv": f"""{_chain(STAR)}
            SELECT {TRANSACTIONS_OUT} FROM (SELECT * REPLACE (coalesce(net, amount) AS net,
              'say "' || description || '", twice' AS description) FROM star_transactions)""",
        "read_journal": f"""{_chain(_closing().replace("AS date,", "AS date, 'Posting ' || l_orderkey AS description,", 1))}
            SELECT date, description, debit, credit, CAST(amount AS DOUBLE) AS amount FROM journal""",
        "read_budget_posts": f"""{_chain(_closing())}
            SELECT p.post_key, name, CAST(p.sort AS INTEGER) AS sort, factor, account,
                   CAST(CASE WHEN account IS NOT NULL
                             THEN row_number() OVER (PARTITION BY p.post_key ORDER BY pos) - 1 END AS INTEGER) AS pos
            FROM post p LEFT JOIN post_account a ON p.post_key = a.post_key""",
        "read_budget_amounts": f"""
            SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, 'N' || c_nationkey AS post_key,
                   CAST(sum(CAST(o_totalprice AS {M})) AS DOUBLE) AS amount
            FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
        "stored_closing": f"{_chain(_closing(with_dummies))} {CLOSING_RESULT}",
        "duplicate_overrides": """
            SELECT o_orderpriority AS transaction_id, o_orderstatus AS description, count(*) AS n_rows
            FROM orders GROUP BY ALL HAVING count(*) > 1""",
        "month_of_file": """
            WITH n AS (SELECT o_orderkey % 7 AS k, o_orderdate AS d FROM orders),
            f AS (SELECT CASE k WHEN 1 THEN 'intermediat_' ELSE 'intermediate_' END
                  || CASE k WHEN 2 THEN year(d) || '' || month(d) WHEN 3 THEN strftime(d, '%m.%y') ELSE strftime(d, '%Y%m') END
                  || CASE k WHEN 4 THEN '_edited' ELSE '' END
                  || CASE k WHEN 5 THEN '.csv' WHEN 6 THEN '.XLSX' ELSE '.xlsx' END AS file_name FROM n),
            m AS (SELECT file_name, CASE WHEN length(file_name) >= 24 AND starts_with(file_name, 'intermediate_')
                                          AND lower(file_name) LIKE '%.xlsx' THEN substr(file_name, 14, 6) END AS month FROM f)
            SELECT file_name, month,
                   coalesce(regexp_full_match(month, '(202[3-9]|20[3-9][0-9]|2100)(0[1-9]|1[0-2])'), false) AS supported FROM m""",
        "zero_value_rows": f"""{prepare}
            SELECT {INTERMEDIATE_OUT} FROM prepared WHERE coalesce(price_net, 0) = 0
            AND description NOT IN ('SCHICHTWECHSEL', 'Mittagstisch-Nachmittag', 'Nachmittag-Abend')""",
        "invalid_values": f"""{faulty}
            SELECT 'topic' AS field, {CHECKED_OUT} FROM intermediate WHERE coalesce(topic, '') NOT IN
              ('MiTi', 'Cafe', 'Verm', 'SoFe', 'Deposit', 'Rental', 'Culture', 'Packaging')
            UNION ALL
            SELECT 'owner', {CHECKED_OUT} FROM intermediate
            WHERE coalesce(owner, '') NOT IN ('LoLa', 'MiTi', 'PaidOut', '')
            UNION ALL
            SELECT 'purpose', {CHECKED_OUT} FROM intermediate
            WHERE coalesce(purpose, '') NOT IN ('Consumption', 'Tip')
            UNION ALL
            SELECT 'payment_method', {CHECKED_OUT} FROM intermediate
            WHERE coalesce(payment_method, '') NOT IN ('Cash', 'Card')""",
        "topic_owner_violations": f"{faulty} SELECT {CHECKED_OUT}, rule FROM ({OWNER_RULES})",
        "violations": f"""{faulty}
            SELECT rule, count(*) AS n_rows FROM (
              {OWNER_RULES}
              UNION ALL SELECT *, 'invalid_topic' FROM intermediate WHERE coalesce(topic, '') NOT IN
                ('MiTi', 'Cafe', 'Verm', 'SoFe', 'Deposit', 'Rental', 'Culture', 'Packaging')
              UNION ALL SELECT *, 'invalid_owner' FROM intermediate
                WHERE coalesce(owner, '') NOT IN ('LoLa', 'MiTi', 'PaidOut', '')
              UNION ALL SELECT *, 'invalid_purpose' FROM intermediate
                WHERE coalesce(purpose, '') NOT IN ('Consumption', 'Tip')
              UNION ALL SELECT *, 'invalid_payment_method' FROM intermediate
                WHERE coalesce(payment_method, '') NOT IN ('Cash', 'Card')
              UNION ALL SELECT *, 'missing_date' FROM intermediate WHERE date IS NULL)
            GROUP BY rule""",
        "unusual_owners": f"""{faulty}
            SELECT {CHECKED_OUT} FROM intermediate
            WHERE (topic = 'MiTi' AND owner = 'PaidOut') OR (topic = 'Culture' AND owner = 'MiTi')""",
        "tips_in_detail_postings": f"""{export}
            SELECT date, CAST(sum(coalesce(price_net, 0)) AS DOUBLE) AS tips FROM intermediate
            WHERE (topic = 'Rental' OR owner = 'PaidOut') AND purpose = 'Tip' GROUP BY date""",
        "partner_transactions": f"{export} SELECT {INTERMEDIATE_OUT} FROM intermediate WHERE topic = 'MiTi'",
        "daily_key_figures": f"{figures} SELECT month, date, {_doubles(figure_names)} FROM figures",
        "unreported_figures": f"""{export}
            SELECT strftime(date, '%Y%m') AS month, date,
              {", ".join(_fee(f"f_{t}_total_commission".lower(), f"topic = '{t}'").replace(f"AS {M})", "AS DOUBLE)")
                         for t in ("Deposit", "Packaging", "Rental", "Culture"))},
              CAST(round_even(sum(coalesce(price_net, 0)) FILTER (WHERE topic = 'MiTi' AND owner = 'LoLa'
                AND payment_method = 'Cash' AND purpose <> 'Tip'), 2) AS DOUBLE) AS f_gross_miti_lola_cash
            FROM intermediate GROUP BY date""",
        "meal_counts": f"{figures} SELECT month, date, {_doubles(meal_names)} FROM figures",
        "daily_details": f"{details} SELECT month, date, {_doubles(MEASURES)} FROM details",
        "details_with_total": f"{totals} SELECT month, date, is_total, {_doubles(MEASURES)} FROM full_details",
        "miti_report": f"""{totals}
            SELECT month, is_total, date, meal_count_regular AS hauptgang,
              coalesce(meal_count_reduced, 0) + coalesce(meal_count_praktikum, 0) AS reduziert,
              meal_count_children AS kind, CAST(gross_miti_miti AS DOUBLE) AS kueche,
              CAST(gross_miti_lola AS DOUBLE) AS total_bar,
              CAST(round_even(coalesce(gross_miti_lola, 0) * 0.8, 2) AS DOUBLE) AS anteil_lola,
              CAST(round_even(coalesce(gross_miti_lola, 0) * 0.2, 2) AS DOUBLE) AS anteil_miti,
              CAST(coalesce(miti_cash, 0) + coalesce(miti_tips_cash, 0) AS DOUBLE) AS einnahmen_bar,
              CAST(miti_tips_cash AS DOUBLE) AS davon_tg_bar,
              CAST(coalesce(miti_card, 0) + coalesce(miti_tips_card, 0) AS DOUBLE) AS einnahmen_karte,
              CAST(miti_tips_card AS DOUBLE) AS davon_tg_karte, CAST(miti_total AS DOUBLE) AS total_einnahmen,
              CAST(lola_commission_miti AS DOUBLE) AS kommission_bar,
              CAST(coalesce(gross_miti_lola, 0) - coalesce(lola_commission_miti, 0) AS DOUBLE) AS netto_bar,
              CAST(gross_miti_miti_card AS DOUBLE) AS karte_miti, CAST(miti_commission AS DOUBLE) AS kommission_miti,
              CAST(net_miti_miti_card AS DOUBLE) AS netto_karte_miti,
              CAST(net_payment_sumup_miti AS DOUBLE) AS net_total_karte,
              CAST(-share_lola AS DOUBLE) AS verkauf_lola, CAST(sponsored_reductions AS DOUBLE) AS gesponsort,
              CAST(debt_to_miti AS DOUBLE) AS ueberweisung
            FROM full_details""",
        "accounting_report": f"{accounting} SELECT month, is_total, date, {_doubles(posting_names)} FROM accounting",
        "balance_violations": f"""{_chain(STAR, PREPARE, _edited(True), FIGURES, DETAILS, TOTALS, ACCOUNTING)}
            SELECT month, date, is_total, account, CAST(net AS DOUBLE) AS net, severity FROM (
              SELECT month, date, is_total, '10920' AS account, n10920 AS net, 'error' AS severity FROM nets
              UNION ALL SELECT month, date, is_total, '20121', n20121, 'error' FROM nets
              UNION ALL SELECT month, date, is_total, '20051', n20051, 'info' FROM nets)
            WHERE abs(net) > 0.05""",
        "rounding_correction": f"{postings} SELECT {MISSING} FROM correction",
        "posting_summary": f"{postings} SELECT {BLANK} FROM summary",
        "posting_details": f"{postings} SELECT {BLANK} FROM detail_postings",
        "banana_ledger": f"""{postings},
            replaced AS (SELECT DISTINCT month, kt_haben FROM detail_postings) {LEDGER_RESULT}""",
        "journal_movements": f"""{_chain(_closing())}
            SELECT date, account, CAST(amount AS DOUBLE) AS amount FROM movements""",
        "account_balances": f"{_chain(_closing())} SELECT account, CAST(balance AS DOUBLE) AS balance FROM balances",
        "account_balances_since_new_year": f"""{_chain(_closing())}
            SELECT account, CAST(sum(amount) AS DOUBLE) AS balance FROM movements
            WHERE date >= DATE '1999-01-01' GROUP BY account""",
        "unbudgeted_accounts": f"""{_chain(_closing())}
            SELECT account, CAST(balance AS DOUBLE) AS balance FROM balances
            WHERE account <> '8900' AND account NOT IN (SELECT account FROM post_account)""",
        "budget_closing": f"{_chain(_closing())} {CLOSING_RESULT}",
        "dummy_postings": f"""{_chain(_closing())}
            SELECT DATE '1999-01-01' AS date, 'Dummy post' AS description, account AS debit, account AS credit,
                   CAST(0 AS DOUBLE) AS amount FROM post_account WHERE pos = 0""",
        "closing_all_posts": f"{_chain(_closing(with_dummies))} {CLOSING_RESULT}",
        "rejected_sales": f"""{_chain(STAR, BROKEN_SALES)}
            SELECT month, row, CASE WHEN quantity IN (17, 19) THEN 'malformed_row' ELSE 'unreadable_cell' END AS rule,
                   CASE quantity WHEN 13 THEN 'Menge' WHEN 23 THEN 'Datum' END AS "column",
                   CASE quantity WHEN 13 THEN 'x13' WHEN 23 THEN '31.02.' || substr(sold_at, 7) END AS value,
                   CASE WHEN quantity IN (17, 19) THEN line END AS text
            FROM placed WHERE quantity IN (13, 17, 19, 23)""",
        "accepted_sales": f"""{_chain(STAR, BROKEN_SALES)}
            SELECT month, row, {SALES_OUT} FROM (SELECT * REPLACE (
                nullif(tax_rate, '') AS tax_rate, nullif(sku, '') AS sku,
                CASE WHEN {SHIFTS} THEN 0 ELSE price_gross END AS price_gross,
                CASE WHEN {SHIFTS} THEN 0 ELSE coalesce(price_net, price_gross) END AS price_net)
              FROM placed) WHERE quantity IS NULL OR quantity NOT IN (13, 17, 19, 23)""",
        "numbered_violations": f"""{faulty},
            placed AS (SELECT *, strftime(date, '%Y%m') AS month,
                              row_number() OVER (PARTITION BY strftime(date, '%Y%m') ORDER BY {_IN_FILE}) + 1 AS row
                       FROM intermediate),
            reread AS (SELECT month, row, {BROKEN_OUT} FROM placed),
            found AS ({OWNER_RULES.replace("intermediate", "reread")}
              UNION ALL SELECT *, 'invalid_topic' FROM reread WHERE coalesce(topic, '') NOT IN
                ('MiTi', 'Cafe', 'Verm', 'SoFe', 'Deposit', 'Rental', 'Culture', 'Packaging')
              UNION ALL SELECT *, 'invalid_owner' FROM reread
                WHERE coalesce(owner, '') NOT IN ('LoLa', 'MiTi', 'PaidOut', '')
              UNION ALL SELECT *, 'invalid_purpose' FROM reread
                WHERE coalesce(purpose, '') NOT IN ('Consumption', 'Tip')
              UNION ALL SELECT *, 'missing_date' FROM reread WHERE date IS NULL)
            SELECT month, row, rule, transaction_id, payment_method, topic, owner, purpose FROM found""",
        "sites_reconcile": _per_site(
            f"{_chain(STAR)}{ids}",
            f"SELECT *, 'sales' AS missing_in FROM ({in_sales}) UNION ALL SELECT *, 'transactions' FROM ({in_transactions})",
        ),
        "sites_refund_violations": _per_site(
            prepare,
            """SELECT transaction_id, CAST(sum(price_net) AS DOUBLE) AS total_net FROM norm_sales
               WHERE transaction_id IN (SELECT transaction_id FROM refund_ids)
               GROUP BY transaction_id HAVING sum(price_net) <> 0""",
        ),
        "sites_prepare": _per_site(export, f"SELECT {INTERMEDIATE_OUT} FROM intermediate"),
        "sites_details": _per_site(totals, f"SELECT month, date, is_total, {_doubles(MEASURES)} FROM full_details"),
        "sites_ledger": _per_site(
            f"{postings}, replaced AS (SELECT DISTINCT month, kt_haben FROM detail_postings)", LEDGER_RESULT
        ),
        "sites_closing": _per_site_journal(f"{_chain(_closing(with_dummies))} {CLOSING_RESULT}"),
        "sites_closing_by_month": _per_site_journal(_by_month("true")),
        "closing_by_month": _by_month("true"),
        "closing_by_month_since_new_year": _by_month("year(mv.date) = CAST(left(months.month, 4) AS INTEGER)"),
    }
