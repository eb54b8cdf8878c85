"""Pieces of the SQL twins: ledger views, inline inputs and exact arithmetic."""

from __future__ import annotations

ORDERS = (
    "(SELECT CAST(o_orderkey AS VARCHAR) AS txn_id, CAST(o_orderdate AS DATE) AS date, 'CUST #' || o_custkey AS merchant, CAST(o_totalprice AS DECIMAL(20,2)) AS amount, "
    "o_orderstatus AS account, nullif(o_orderpriority, '5-LOW') AS category, o_orderkey AS seq FROM orders)"
)
LINES = (
    "(SELECT l_orderkey || '-' || l_linenumber AS txn_id, CAST(l_shipdate AS DATE) AS date, p_brand || ' #' || l_partkey AS merchant, "
    "CAST(CASE WHEN l_returnflag = 'R' THEN -CAST(l_extendedprice AS DECIMAL(20,2)) ELSE CAST(l_extendedprice AS DECIMAL(20,2)) END AS DECIMAL(20,2)) AS amount, "
    "l_linestatus AS account, p_type AS category, l_orderkey * 10 + l_linenumber AS seq FROM lineitem JOIN part ON l_partkey = p_partkey)"
)
EVENTS = (
    "(SELECT CAST(event_id AS VARCHAR) AS txn_id, CAST(ts AS DATE) AS date, event_type AS merchant, CAST(value AS DECIMAL(20,2)) AS amount, CAST(user_id % 4 AS VARCHAR) AS account, "
    "CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS VARCHAR) AS category, event_id AS seq FROM events)"
)
LEDGER = "(SELECT txn_id, date, merchant, merchant_key, amount, account, category, id AS seq FROM ledger_transactions)"

# merchant, first date, months between charges, charges, first and later price, charge from which the later holds, number
SERIES_ROWS = """
('NETFLIX', DATE '2025-01-05', 1, 18, 15.49, 19.36, 10, 1), ('SPOTIFY', DATE '2025-01-31', 1, 17, 9.99, 9.99, 99, 2), ('INSURANCE', DATE '2024-01-15', 3, 10, 210.00, 220.50, 6, 3),
('RENT', DATE '2025-10-31', 1, 8, 1200.00, 1200.00, 99, 4), ('GYM', DATE '2025-03-10', 1, 3, 30.00, 30.00, 99, 5), ('CHEAPER', DATE '2025-02-01', 1, 12, 11.99, 9.99, 6, 6),
('SLIGHT', DATE '2025-02-03', 1, 12, 10.00, 10.30, 6, 7), ('YEARLY', DATE '2019-06-30', 12, 7, 80.00, 99.00, 5, 8), ('OLD PAPER', DATE '2020-01-20', 1, 14, 5.25, 5.25, 99, 9),
('CLOUD', DATE '2025-05-28', 1, 13, 0.99, 2.99, 12, 10), ('BIMONTHLY', DATE '2024-12-29', 2, 9, 42.10, 45.00, 4, 11)
"""
# Irregular and doubled charges: merchant, date, amount, number
SINGLE_ROWS = """
('CAFE', DATE '2026-01-03', 5.00, 501), ('CAFE', DATE '2026-01-09', 5.00, 502), ('CAFE', DATE '2026-05-02', 5.00, 503), ('CAFE', DATE '2026-11-20', 5.00, 504),
('NETFLIX', DATE '2025-04-05', 15.49, 505), ('TARGET T-1234', DATE '2026-03-14', 188.40, 506), ('TARGET T-1234', DATE '2026-03-14', 188.40, 507),
('REFUNDS', DATE '2026-02-01', -12.00, 508), ('REFUNDS', DATE '2026-02-03', -12.00, 509), ('REFUNDS', DATE '2026-02-06', -12.00, 510), ('REFUNDS', DATE '2026-02-20', -12.00, 511)
"""
SERIES_COLUMNS = "merchant, start, step, n, was, now, turn, base"
SERIES = (
    "(SELECT CAST(seq AS VARCHAR) AS txn_id, date, merchant, CAST(amount AS DECIMAL(20,2)) AS amount, 'card' AS account, CAST(NULL AS VARCHAR) AS category, seq FROM ("
    "SELECT merchant, CAST(start + to_months(CAST(step * i AS INTEGER)) AS DATE) AS date, CASE WHEN i + 1 >= turn THEN now ELSE was END AS amount, CAST(base * 1000 + i AS BIGINT) AS seq "
    f"FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM (VALUES {SERIES_ROWS}) s({SERIES_COLUMNS})) "
    f"UNION ALL SELECT merchant, date, amount, CAST(number AS BIGINT) FROM (VALUES {SINGLE_ROWS}) t(merchant, date, amount, number)))"
)
SPARK_SERIES = (
    "SELECT CAST(seq AS STRING) AS txn_id, date, merchant, CAST(amount AS DECIMAL(20,2)) AS amount, 'card' AS account, CAST(NULL AS STRING) AS category, seq FROM ("
    "SELECT merchant, add_months(start, CAST(step * i AS INT)) AS date, CASE WHEN i + 1 >= turn THEN now ELSE was END AS amount, CAST(base * 1000 + i AS BIGINT) AS seq "
    f"FROM (SELECT *, explode(sequence(0, n - 1)) AS i FROM (VALUES {SERIES_ROWS}) AS s({SERIES_COLUMNS})) "
    f"UNION ALL SELECT merchant, date, amount, CAST(number AS BIGINT) FROM (VALUES {SINGLE_ROWS}) AS t(merchant, date, amount, number))"
)

# Series planted for the customers: each third one has a monthly subscription, whose price rises for some in the second half; each
# third one buys at odd times, and is charged twice now and then.
_PLANTED = (
    "(SELECT CAST(seq AS {s}) AS txn_id, date, merchant, CAST(cents * 0.01 AS DECIMAL(20,2)) AS amount, 'card' AS account, CAST(NULL AS {s}) AS category, seq FROM ("
    "SELECT concat('SUB #', c_custkey) AS merchant, CAST({month} AS DATE) AS date, 599 + 100 * (c_custkey % 40) + CASE WHEN c_custkey % 9 = 0 AND i >= 6 THEN 150 + c_custkey % 7 ELSE 0 END AS cents, "
    "CAST(c_custkey * 100 + i AS BIGINT) AS seq FROM (SELECT c_custkey, {range} AS i FROM customer WHERE c_custkey % 3 = 0) x "
    "UNION ALL SELECT concat('SHOP #', c_custkey), CAST({day} AS DATE), 250 + (c_custkey * {pair}) % 9000, CAST(c_custkey * 100 + i AS BIGINT) FROM (SELECT c_custkey, {range} AS i FROM customer WHERE c_custkey % 3 = 1) y) z)"
)
PLANTED = _PLANTED.format(
    s="VARCHAR", pair="(i // 2)", range="unnest(generate_series(0, 11))", month="DATE '2025-01-01' + CAST(c_custkey % 28 AS INTEGER) + to_months(CAST(i AS INTEGER))",
    day="DATE '2025-01-01' + CAST(i // 2 * (5 + c_custkey % 31) + i % 2 * (c_custkey % 6) AS INTEGER)",
)
SPARK_PLANTED = _PLANTED.format(
    s="STRING", pair="(i div 2)", range="explode(sequence(0, 11))", month="add_months(date_add(DATE '2025-01-01', CAST(c_custkey % 28 AS INT)), i)",
    day="date_add(DATE '2025-01-01', CAST(i div 2 * (5 + c_custkey % 31) + i % 2 * (c_custkey % 6) AS INT))",
)


def half_up(numerator: str, denominator: str) -> str:
    """Exact division of integers, half away from zero; the denominator is positive."""
    return f"(sign({numerator}) * ((2 * abs({numerator}) + {denominator}) // (2 * {denominator})))"


def money(cents: str) -> str:
    return f"CAST(CAST({cents} AS DECIMAL(28,0)) * 0.01 AS DECIMAL(20,2))"


def cents(amount: str) -> str:
    return f"CAST({amount} * 100 AS HUGEINT)"


def average(where: str = "") -> str:
    return f"CASE WHEN count(*) > 0 THEN {money(half_up(cents('sum(amount)'), 'count(*)'))} END"


def aggregate(agg: str) -> str:
    made = {"sum": "sum(amount)", "count": "count(*)", "avg": average(), "max": "max(amount)", "min": "min(amount)"}[agg]
    return f"coalesce(CAST({made} AS DECIMAL(20,2)), 0.00)"


def headline(source: str, where: str = "TRUE", agg: str = "sum") -> str:
    return f"SELECT count(*) AS matched, CAST({aggregate(agg)} AS DECIMAL(20,2)) AS value FROM {source} t WHERE {where}"


def groups(source: str, key: str, where: str = "TRUE", agg: str = "sum") -> str:
    return f"SELECT {key} AS key, count(*) AS count, CAST({aggregate(agg)} AS DECIMAL(20,2)) AS value FROM {source} t WHERE {where} GROUP BY 1"


def recurring(source: str) -> str:
    return f"""WITH r AS (SELECT *, date - lag(date) OVER (PARTITION BY merchant ORDER BY date, seq) AS gap FROM {source} t),
g AS (SELECT merchant, count(*) AS occurrences, count(DISTINCT amount) AS amounts, min(date) AS first_date, max(date) AS last_date,
  arg_min(amount, (date, seq)) AS first_amount, arg_max(amount, (date, seq)) AS last_amount, median(gap) AS median_gap,
  count(gap) AS k, sum(gap) AS s1, sum(gap * gap) AS s2 FROM r GROUP BY merchant),
c AS (SELECT * FROM g WHERE occurrences >= 4 AND amounts <= 3 AND median_gap >= 20 AND s1 > 0 AND (k = 1 OR 16 * k * (k * s2 - s1 * s1) <= (k - 1) * s1 * s1))
"""
