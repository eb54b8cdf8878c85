"""Queries over ledgers: spending questions, ingest, categories, sequences, forecast, imports."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import STATES, labelled, normalized_merchant, rule_category
from ..operators import categorize, forecast, ledger, query, sequences
from ..operators.query import Filters
from ..schema import CATEGORIES, FALLBACK, RULES, UNCATEGORIZED
from ..session import checkpoint_root, forget
from ..sources.ledger import events_ledger, lineitem_ledger, orders_ledger, parsed_rows, stored_ledger
from ..sources.tables import table
from ..streaming import projections
from . import sql as S
from .registry import Registry

registry = Registry()
add = registry.add

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", UNCATEGORIZED)
SPRING = Filters(date_from=date(1996, 3, 1), date_to=date(1996, 5, 31))


def series(spark: SparkSession, _: str = "") -> DataFrame:
    """Monthly, quarterly and irregular charges, written out inline."""
    return spark.sql(S.SPARK_SERIES)


def _ask(name: str, source, sql_source: str, filters: Filters, where: str, agg: str = "sum", group_by: str = "none", key: str = "") -> None:
    statement = S.groups(sql_source, key, where, agg) if key else S.headline(sql_source, where, agg)

    @add(name, statement)
    def ask(spark: SparkSession, folder: str) -> DataFrame:
        result = query.query(source(spark, folder), filters, agg, group_by)
        return result.headline if result.groups is None else result.groups


_KEYS = {"month": "strftime(date, '%Y-%m')", "category": f"coalesce(category, '{UNCATEGORIZED}')", "merchant": "merchant"}
_RANGE = "date BETWEEN DATE '1996-03-01' AND DATE '1996-05-31'"
_URGENT = Filters(categories=("1-URGENT", UNCATEGORIZED), allowed=PRIORITIES)
_ask("q_sum_all", orders_ledger, S.ORDERS, Filters(), "TRUE")
_ask("q_avg_all", orders_ledger, S.ORDERS, Filters(), "TRUE", "avg")
_ask("q_max_all", lineitem_ledger, S.LINES, Filters(), "TRUE", "max")
_ask("q_min_all", lineitem_ledger, S.LINES, Filters(), "TRUE", "min")
_ask("q_count_all", lineitem_ledger, S.LINES, Filters(), "TRUE", "count")
_ask("q_sum_by_month", orders_ledger, S.ORDERS, Filters(), "TRUE", "sum", "month", _KEYS["month"])
_ask("q_count_by_month", orders_ledger, S.ORDERS, Filters(), "TRUE", "count", "month", _KEYS["month"])
_ask("q_avg_by_category", orders_ledger, S.ORDERS, Filters(), "TRUE", "avg", "category", _KEYS["category"])
_ask("q_sum_by_merchant", lineitem_ledger, S.LINES, Filters(), "TRUE", "sum", "merchant", _KEYS["merchant"])
_ask("q_stored_by_category", stored_ledger, S.LEDGER, Filters(), "TRUE", "sum", "category", _KEYS["category"])
_ask("q_closed_range", orders_ledger, S.ORDERS, SPRING, _RANGE)
_ask("q_open_from", orders_ledger, S.ORDERS, Filters(date_from=date(1997, 1, 1)), "date >= DATE '1997-01-01'")
_ask("q_open_to", orders_ledger, S.ORDERS, Filters(date_to=date(1992, 12, 31)), "date <= DATE '1992-12-31'")
_ask("q_category_in", orders_ledger, S.ORDERS, _URGENT, f"coalesce(category, '{UNCATEGORIZED}') IN ('1-URGENT', '{UNCATEGORIZED}')")
_ask("q_merchant_contains", lineitem_ledger, S.LINES, Filters(merchant_contains="BRAND#1"), "contains(lower(merchant), 'brand#1')")
_ask("q_account", lineitem_ledger, S.LINES, Filters(account="F"), "account = 'F'")
_ask(
    "q_all_filters", lineitem_ledger, S.LINES, Filters(date(1995, 1, 1), date(1996, 12, 31), (), "#2", "O"),
    "date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND account = 'O' AND contains(lower(merchant), '#2')",
)
_ask("q_empty_is_zero", orders_ledger, S.ORDERS, Filters(account="nobody"), "account = 'nobody'", "max")


@add("q_headline_and_groups", f"SELECT {_KEYS['category']} AS key, count(*) AS count, CAST({S.aggregate('sum')} AS DECIMAL(20,2)) AS value FROM {S.ORDERS} t GROUP BY ROLLUP (1)")
def q_headline_and_groups(spark: SparkSession, folder: str) -> DataFrame:
    return query.headline_and_groups(orders_ledger(spark, folder))


@add("q_top_merchants", f"{S.groups(S.ORDERS, 'merchant')} ORDER BY value DESC, min(seq), key LIMIT 40")
def q_top_merchants(spark: SparkSession, folder: str) -> DataFrame:
    return query.groups(orders_ledger(spark, folder), group_by="merchant").limit(40)


@add("q_uncategorized", f"SELECT txn_id, date, merchant, amount, account FROM {S.ORDERS} t WHERE category IS NULL OR category = ''")
def q_uncategorized(spark: SparkSession, folder: str) -> DataFrame:
    return query.uncategorized(orders_ledger(spark, folder)).select("txn_id", "date", "merchant", "amount", "account")


@add(
    "q_describe",
    "SELECT count(*) AS rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT account) AS accounts, count(category) AS categorized "
    f"FROM {S.ORDERS} t",
)
def q_describe(spark: SparkSession, folder: str) -> DataFrame:
    return query.describe(orders_ledger(spark, folder))


@add("q_accounts", f"SELECT account, count(*) AS count FROM {S.LINES} t GROUP BY account")
def q_accounts(spark: SparkSession, folder: str) -> DataFrame:
    return query.accounts(lineitem_ledger(spark, folder))


@add("q_merchants_topk", f"SELECT merchant, count(*) AS count FROM {S.ORDERS} t GROUP BY merchant ORDER BY count DESC, merchant LIMIT 50")
def q_merchants_topk(spark: SparkSession, folder: str) -> DataFrame:
    return query.merchants(orders_ledger(spark, folder), 50)


@add("q_fetch", f"SELECT txn_id, date, merchant, amount, account FROM {S.ORDERS} t WHERE {_RANGE} ORDER BY date, seq LIMIT 50")
def q_fetch(spark: SparkSession, folder: str) -> DataFrame:
    matched = orders_ledger(spark, folder).where(SPRING.condition())
    return matched.orderBy("date", "seq").limit(50).select("txn_id", "date", "merchant", "amount", "account")


# --- ingest -----------------------------------------------------------------------------------------------------------

RAW = """('a', '2026-01-05', ' STARBUCKS #1 ', '5.005', 'card'), ('b', '2026/1/6', 'X', '-12.3', 'card'), ('c', ' 01/07/2026 ', 'Y', ' 1e2 ', 'cash'),
('d', '2026-13-01', 'Z', '7', 'card'), ('e', '2026-01-08', 'Q', '1,234.5', 'card'), ('f', '08.01.2026', 'W', 'abc', 'card'), ('a', '2026-01-05', 'AGAIN', '0.004', 'card')"""
_DATE = "coalesce(try_strptime(trim(date), '%Y-%m-%d'), try_strptime(trim(date), '%Y/%m/%d'), try_strptime(trim(date), '%m/%d/%Y'))"
_PARSED = f"SELECT txn_id, CAST({_DATE} AS DATE) AS date, trim(merchant) AS merchant, TRY_CAST(trim(amount) AS DECIMAL(20,2)) AS amount, account FROM (VALUES {RAW}) t(txn_id, date, merchant, amount, account)"


def _raw(spark: SparkSession) -> DataFrame:
    return parsed_rows(spark.sql(f"SELECT * FROM (VALUES {RAW}) AS t(txn_id, date, merchant, amount, account)"))


@add("ingest_parse", f"SELECT * FROM ({_PARSED}) WHERE date IS NOT NULL AND amount IS NOT NULL")
def ingest_parse(spark: SparkSession, _: str) -> DataFrame:
    return _raw(spark).where(F.size("bad") == 0).drop("bad")


@add("ingest_reject", f"SELECT txn_id, concat_ws(',', CASE WHEN date IS NULL THEN 'date' END, CASE WHEN amount IS NULL THEN 'amount' END) AS bad FROM ({_PARSED}) WHERE date IS NULL OR amount IS NULL")
def ingest_reject(spark: SparkSession, _: str) -> DataFrame:
    return _raw(spark).where(F.size("bad") > 0).select("txn_id", F.array_join("bad", ",").alias("bad"))


@add("ingest_flip_sign", f"SELECT txn_id, CAST(-amount AS DECIMAL(20,2)) AS amount FROM ({_PARSED}) WHERE date IS NOT NULL AND amount IS NOT NULL")
def ingest_flip_sign(spark: SparkSession, _: str) -> DataFrame:
    rows = parsed_rows(spark.sql(f"SELECT * FROM (VALUES {RAW}) AS t(txn_id, date, merchant, amount, account)"), flip_sign=True)
    return rows.where(F.size("bad") == 0).select("txn_id", "amount")


# The same over all raw lines of the new batches; their identifiers repeat and have placeholders, so the line's ``id`` goes along.
_STRIPPED = lambda column: f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"
_INCOMING = (
    f"SELECT id, {_STRIPPED('txn_id')} AS txn_id, CAST({_DATE} AS DATE) AS date, {_STRIPPED('merchant')} AS merchant, TRY_CAST(trim(amount) AS DECIMAL(20,2)) AS amount, "
    f"{_STRIPPED('account')} AS account FROM incoming_transactions"
)


def _incoming(spark: SparkSession, folder: str, flip_sign: bool = False) -> DataFrame:
    raw = table(spark, folder, "incoming_transactions").select("id", "txn_id", "date", "merchant", "amount", "account")
    return parsed_rows(raw, flip_sign)


@add("ingest_parse_incoming", f"SELECT * FROM ({_INCOMING}) WHERE date IS NOT NULL AND amount IS NOT NULL")
def ingest_parse_incoming(spark: SparkSession, folder: str) -> DataFrame:
    return _incoming(spark, folder).where(F.size("bad") == 0).select("id", "txn_id", "date", "merchant", "amount", "account")


@add("ingest_reject_incoming", f"SELECT id, txn_id, concat_ws(',', CASE WHEN date IS NULL THEN 'date' END, CASE WHEN amount IS NULL THEN 'amount' END) AS bad FROM ({_INCOMING}) WHERE date IS NULL OR amount IS NULL")
def ingest_reject_incoming(spark: SparkSession, folder: str) -> DataFrame:
    return _incoming(spark, folder).where(F.size("bad") > 0).select("id", "txn_id", F.array_join("bad", ",").alias("bad"))


@add("ingest_flip_sign_incoming", f"SELECT id, txn_id, CAST(-amount AS DECIMAL(20,2)) AS amount FROM ({_INCOMING}) WHERE date IS NOT NULL AND amount IS NOT NULL")
def ingest_flip_sign_incoming(spark: SparkSession, folder: str) -> DataFrame:
    return _incoming(spark, folder, flip_sign=True).where(F.size("bad") == 0).select("id", "txn_id", "amount")


# --- merchants and categories -----------------------------------------------------------------------------------------

_STATES = ",".join(f"'{code}'" for code in STATES)


def _key_sql(merchant: str) -> str:
    words = f"string_split_regex(trim(translate({merchant}, '*/', '  ')), '\\s+')"
    named = f"CASE WHEN len({words}) >= 3 AND {words}[-1] IN ({_STATES}) THEN {words}[1:len({words}) - 2] ELSE {words} END"
    return f"coalesce(nullif(lower(array_to_string(list_filter({named}, lambda w: NOT regexp_matches(w, '[0-9]')), ' ')), ''), lower(trim({merchant})))"


NAMES = """('CHIPOTLE 1234'), ('PEETS #88'), ('BEST BUY #245'), ('TARGET T-1234'), ('SPOTIFY P0A1B2C3'), ('AMZN Mktp US*2H4KJ'), ('STARBUCKS #1234 SEATTLE WA'), ('NETFLIX.COM'),
('UBER *EATS'), ('FEDEX OFFICE IN'), ('RENT WA'), ('#1234'), ('1234'), ('  DELTA  AIR   LINES 0062 '), ('A/B C')"""


@add("norm_merchant", f"SELECT merchant, {_key_sql('merchant')} AS merchant_key FROM (SELECT DISTINCT merchant FROM {S.LINES} t UNION SELECT merchant FROM (VALUES {NAMES}) v(merchant))")
def norm_merchant(spark: SparkSession, folder: str) -> DataFrame:
    names = lineitem_ledger(spark, folder).select("merchant").union(spark.sql(f"SELECT * FROM (VALUES {NAMES}) AS v(merchant)")).distinct()
    return names.select("merchant", normalized_merchant(F.col("merchant")).alias("merchant_key"))


@add("norm_ledger", "SELECT DISTINCT merchant, merchant_key FROM ledger_transactions")
def norm_ledger(spark: SparkSession, folder: str) -> DataFrame:
    merchants = table(spark, folder, "ledger_transactions").select("merchant").distinct()
    return merchants.select("merchant", normalized_merchant(F.col("merchant")).alias("merchant_key"))


KEYS = "('starbucks'), ('blue bottle coffee'), ('safeway'), ('netflix.com'), ('peets trader joes'), ('pacific property mgmt'), ('unknown'), ('whole foods market'), ('')"
_RULES = "CASE " + " ".join(f"WHEN contains(k, '{w}') THEN '{c}'" for w, c in sorted(RULES, key=lambda r: -len(r[0]))) + " END"


@add("rule_match", f"SELECT k AS merchant_key, {_RULES} AS category FROM (VALUES {KEYS}) t(k)")
def rule_match(spark: SparkSession, _: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM (VALUES {KEYS}) AS t(merchant_key)").select("merchant_key", rule_category(F.col("merchant_key")).alias("category"))


@add("rule_match_ledger", f"SELECT k AS merchant_key, {_RULES} AS category FROM (SELECT DISTINCT merchant_key AS k FROM ledger_transactions) t")
def rule_match_ledger(spark: SparkSession, folder: str) -> DataFrame:
    keys = table(spark, folder, "ledger_transactions").select("merchant_key").distinct()
    return keys.select("merchant_key", rule_category(F.col("merchant_key")).alias("category"))


# A cache by key: the first letters of the category that most of a merchant's rows have. Keys of the stored ledger that are named for a trade are known.
_KNOWN = "SELECT merchant_key, max(category) AS category FROM ledger_transactions WHERE merchant_key LIKE '%coffee' OR merchant_key LIKE '%market' GROUP BY merchant_key"
_DECIDED = f"""SELECT d.merchant_key, coalesce(ruled, CASE WHEN c.category IN ({", ".join(f"'{c}'" for c in CATEGORIES)}) THEN c.category END, '{FALLBACK}') AS category,
CASE WHEN ruled IS NOT NULL THEN 'rule' WHEN c.category IS NOT NULL THEN 'cache' ELSE 'model' END AS tier FROM (SELECT DISTINCT merchant_key, {_RULES.replace("contains(k", "contains(merchant_key")} AS ruled
FROM ledger_transactions) d LEFT JOIN ({_KNOWN}) c ON c.merchant_key = d.merchant_key"""


def _decided(spark: SparkSession, folder: str) -> DataFrame:
    stored = table(spark, folder, "ledger_transactions")
    known = stored.where(F.col("merchant_key").endswith("coffee") | F.col("merchant_key").endswith("market")).groupBy("merchant_key").agg(F.max("category").alias("category"))
    return categorize.decided_keys(stored, known)


@add("categorize_tiers", _DECIDED)
def categorize_tiers(spark: SparkSession, folder: str) -> DataFrame:
    return _decided(spark, folder).select("merchant_key", "category", "tier")


@add(
    "tier_stats",
    "SELECT count(*) AS merchants, count(*) FILTER (tier = 'rule') AS by_rule, count(*) FILTER (tier = 'cache') AS by_cache, count(*) FILTER (tier = 'model') AS by_model, "
    "count(*) FILTER (tier = 'model') AS fallback, round(count(*) FILTER (tier = 'cache') / nullif(count(*) FILTER (tier <> 'rule'), 0), 6) AS cache_hit_rate "
    f"FROM ({_DECIDED})",
)
def tier_stats(spark: SparkSession, folder: str) -> DataFrame:
    return categorize.tier_stats(_decided(spark, folder))


def _tagged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Rows tagged by merchant key, and the stored categories as truth."""
    stored = table(spark, folder, "ledger_transactions").withColumn("txn_id", F.col("id").cast("string"))
    return categorize.categorized(stored, _decided(spark, folder)), stored.where(F.col("category").isNotNull())


_TAGGED = f"SELECT t.id, t.merchant, d.category AS got, t.category AS want FROM ledger_transactions t JOIN ({_DECIDED}) d ON d.merchant_key = t.merchant_key"


@add(
    "per_class_pr",
    f"WITH j AS ({_TAGGED}), p AS (SELECT got AS category, count(*) AS predicted, count(*) FILTER (got = want) AS hits FROM j GROUP BY 1), s AS (SELECT want AS category, count(*) AS support "
    "FROM j GROUP BY 1) SELECT category, coalesce(hits, 0) AS hits, coalesce(predicted, 0) AS predicted, coalesce(support, 0) AS support, coalesce(round(hits / nullif(predicted, 0), 6), 0.0) AS precision, "
    "coalesce(round(hits / nullif(support, 0), 6), 0.0) AS recall FROM p FULL JOIN s USING (category) WHERE category IN (" + ", ".join(f"'{c}'" for c in CATEGORIES) + ")",
)
def per_class_pr(spark: SparkSession, folder: str) -> DataFrame:
    return categorize.per_class(*_tagged(spark, folder))


@add("top_misclassified", f"SELECT merchant, count(*) AS count FROM ({_TAGGED}) WHERE got IS DISTINCT FROM want GROUP BY merchant ORDER BY count DESC, merchant LIMIT 10")
def top_misclassified(spark: SparkSession, folder: str) -> DataFrame:
    return categorize.top_misclassified(*_tagged(spark, folder))


# --- sequences --------------------------------------------------------------------------------------------------------


def duplicates_sql(source: str, keys: str, tie: str) -> str:
    return f"""WITH s AS (SELECT *, CASE WHEN date - lag(date) OVER (PARTITION BY {keys} ORDER BY date, {tie}) <= 3 THEN 0 ELSE 1 END AS starts FROM {source} t),
i AS (SELECT *, sum(starts) OVER (PARTITION BY {keys} ORDER BY date, {tie} ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT {keys}, CAST(count(*) AS INTEGER) AS times, string_agg(txn_id, ',' ORDER BY date, {tie}) AS txn_ids, string_agg(CAST(date AS VARCHAR), ',' ORDER BY date, {tie}) AS dates FROM i GROUP BY {keys}, island HAVING count(*) >= 2"""


def _flat(found: DataFrame) -> DataFrame:
    return found.withColumn("txn_ids", F.array_join("txn_ids", ",")).withColumn("dates", F.array_join(F.col("dates").cast("array<string>"), ","))


@add("dup_charges", duplicates_sql(S.LEDGER, "merchant, amount", "seq"))
def dup_charges(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(sequences.duplicate_charges(stored_ledger(spark, folder)))


@add("dup_charges_series", duplicates_sql(S.SERIES, "merchant, amount", "seq"))
def dup_charges_series(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(sequences.duplicate_charges(series(spark)))


@add("dup_members", f"WITH d AS ({duplicates_sql(S.LEDGER, 'merchant, amount', 'seq')}) SELECT merchant, amount, CAST(times AS BIGINT) AS times, unnest(string_split(txn_ids, ',')) AS txn_id FROM d")
def dup_members(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each charge of a cluster, with the number of its cluster's charges; no cluster is gathered."""
    members = sequences.duplicate_members(stored_ledger(spark, folder))
    sizes = members.groupBy("merchant", "amount", "island").agg(F.count("*").alias("times"))
    return members.join(sizes, ["merchant", "amount", "island"]).select("merchant", "amount", "times", "txn_id")


@add("dup_charges_account", duplicates_sql(f"(SELECT * FROM {S.LEDGER} x WHERE amount > 0)", "account, merchant_key, amount", "txn_id"))
def dup_charges_account(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(sequences.account_duplicates(table(spark, folder, "ledger_transactions")))


@add("recurring", f"{S.recurring(S.SERIES)} SELECT merchant, occurrences, median_gap, first_date, last_date, first_amount, last_amount FROM c")
def recurring(spark: SparkSession, _: str) -> DataFrame:
    return sequences.recurring(series(spark)).select("merchant", "occurrences", "median_gap", "first_date", "last_date", "first_amount", "last_amount")


@add("recurring_ledger", f"{S.recurring(S.LEDGER)} SELECT merchant, occurrences, median_gap, first_amount, last_amount FROM c")
def recurring_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.recurring(stored_ledger(spark, folder)).select("merchant", "occurrences", "median_gap", "first_amount", "last_amount")


_MONTHS = "CAST(greatest((year(last_date) - year(first_date)) * 12 + month(last_date) - month(first_date) + 1, 1) AS HUGEINT)"
_MONTHLY = S.half_up(f"({S.cents('last_amount')} * occurrences)", _MONTHS)


def _subscriptions_sql(source: str) -> str:
    return f"{S.recurring(source)} SELECT merchant, last_amount AS amount, occurrences, {S.money(_MONTHLY)} AS monthly, {S.money(_MONTHLY + ' * 12')} AS yearly, first_date AS first_seen, last_date AS last_seen FROM c"


@add("subscriptions", _subscriptions_sql(S.SERIES))
def subscriptions(spark: SparkSession, _: str) -> DataFrame:
    return sequences.subscriptions(series(spark))


@add("subscriptions_ledger", _subscriptions_sql(S.LEDGER))
def subscriptions_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.subscriptions(stored_ledger(spark, folder))


def _subscription_total_sql(source: str) -> str:
    return f"SELECT count(*) AS subscriptions, CAST(sum(yearly) AS DECIMAL(20,2)) AS yearly FROM ({_subscriptions_sql(source)})"


@add("subscription_total", _subscription_total_sql(S.SERIES))
def subscription_total(spark: SparkSession, _: str) -> DataFrame:
    return sequences.subscription_total(series(spark))


# Without any subscription the total is 0.
@add("subscription_total_ledger", f"SELECT subscriptions, coalesce(yearly, 0.00) AS yearly FROM ({_subscription_total_sql(S.LEDGER)})")
def subscription_total_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.subscription_total(stored_ledger(spark, folder))


def _price_increases_sql(source: str) -> str:
    return (
        f"{S.recurring(source)} SELECT c.merchant, first_amount AS was, last_amount AS now, min(r.date) AS since, occurrences, "
        f"{S.money(S.half_up('(' + S.cents('last_amount') + ' * 100)', S.cents('first_amount')))} AS ratio, CAST((last_amount - first_amount) * 12 AS DECIMAL(20,2)) AS yearly_extra "
        "FROM c JOIN r ON r.merchant = c.merchant AND r.amount = c.last_amount WHERE first_amount > 0 AND last_amount * 100 > first_amount * 105 GROUP BY c.merchant, first_amount, last_amount, occurrences"
    )


@add("price_increases", _price_increases_sql(S.SERIES))
def price_increases(spark: SparkSession, _: str) -> DataFrame:
    return sequences.price_increases(series(spark))


@add("price_increases_ledger", _price_increases_sql(S.LEDGER))
def price_increases_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.price_increases(stored_ledger(spark, folder))


def _outliers_sql(source: str, group: str) -> str:
    place = lambda p, step: f'least(({p} * (n - 1)) // 100 + {step}, n - 1)'
    at = lambda p, step: f"max(c) FILTER (i = {place(p, step)})"
    quartile = lambda p: f"({at(p, 0)} * (100 - ({p} * (max(n) - 1)) % 100) + {at(p, 1)} * (({p} * (max(n) - 1)) % 100))"
    return f"""WITH g AS (SELECT *, {group} AS grp, {S.cents("amount")} AS c FROM {source} t),
r AS (SELECT grp, c, row_number() OVER (PARTITION BY grp ORDER BY c) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM g),
q AS (SELECT grp, 4 * {quartile(75)} - 3 * {quartile(25)} AS fence FROM r GROUP BY grp HAVING count(*) >= 4)
SELECT txn_id, merchant, amount, g.grp AS "group", {S.money(S.half_up("fence", "100"))} AS threshold,
CASE WHEN fence > 0 THEN {S.money(S.half_up("(c * 10000)", "greatest(fence, 1)"))} ELSE 0.00 END AS ratio FROM g JOIN q ON q.grp = g.grp WHERE c * 100 > fence"""


def _outliers(name: str, source, sql_source: str, group_by: str, group: str) -> None:
    @add(name, _outliers_sql(sql_source, group))
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return sequences.outliers(source(spark, folder), group_by)


_outliers("outliers_category", events_ledger, S.EVENTS, "category", f"coalesce(category, '{UNCATEGORIZED}')")
_outliers("outliers_merchant", stored_ledger, S.LEDGER, "merchant", "merchant")
_outliers("outliers_none", stored_ledger, S.LEDGER, "none", "'全部'")

# --- forecast ---------------------------------------------------------------------------------------------------------

TODAY = date(2026, 9, 22)


@add("coverage_months", f"SELECT strftime(date, '%Y-%m') AS year_month, min(date) AS first, max(date) AS last, count(*) AS count, CAST(DATE '2026-09-22' - (SELECT max(date) FROM {S.LEDGER} m) AS INTEGER) AS lag_days FROM {S.LEDGER} t GROUP BY 1")
def coverage_months(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.coverage(stored_ledger(spark, folder), TODAY)


@add(
    "project_period",
    f"""WITH b AS (SELECT min(date) AS first, max(date) AS last FROM {S.ORDERS} t), o AS (SELECT first, least(DATE '1996-09-11', last, DATE '1996-09-30') AS through FROM b),
s AS (SELECT through, coalesce(sum(amount), 0.00) AS observed, count(t.date) AS count, through - DATE '1996-09-01' + 1 AS observed_days FROM o LEFT JOIN {S.ORDERS} t ON t.date BETWEEN DATE '1996-09-01' AND o.through
WHERE first <= DATE '1996-09-01' AND through >= DATE '1996-09-01' GROUP BY through)
SELECT DATE '1996-09-01' AS period_start, DATE '1996-09-30' AS period_end, through AS observed_through, CAST(observed AS DECIMAL(20,2)) AS observed, count, CAST(observed_days AS BIGINT) AS observed_days, CAST(30 AS BIGINT) AS total_days,
{S.money(S.half_up('(' + S.cents('observed') + ' * 30)', 'observed_days'))} AS projected, {S.money(S.half_up(S.cents('observed'), 'observed_days'))} AS daily_rate, TRUE AS is_partial, through >= DATE '1996-09-30' AS is_complete FROM s""",
)
def project_period(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.projected(orders_ledger(spark, folder), date(1996, 9, 1), date(1996, 9, 30), date(1996, 9, 11))


_SPAN = "((year(last_date) - year(first_date)) * 12 + month(last_date) - month(first_date))"


def _upcoming_sql(source: str, today: date, days: int) -> str:
    return f"""{S.recurring(source)}, m AS (SELECT *, CAST(round_even(median_gap, 0) AS INTEGER) AS interval_days, CASE WHEN {_SPAN} > 0 THEN CAST(round_even({_SPAN} / (occurrences - 1), 0) AS INTEGER) ELSE 0 END AS months FROM c),
e AS (SELECT *, unnest(generate_series(1, 240)) AS n FROM m WHERE interval_days > 0), w AS (SELECT *, CASE WHEN months > 0 THEN CAST(last_date + to_months(CAST(months * n AS INTEGER)) AS DATE) ELSE last_date + CAST(interval_days * n AS INTEGER) END AS due FROM e)
SELECT merchant, last_amount AS amount, min(due) AS next_date, interval_days, occurrences FROM w WHERE due >= DATE '{today}' GROUP BY merchant, last_amount, interval_days, occurrences HAVING min(due) <= DATE '{today}' + {days}"""


@add("upcoming_charges", _upcoming_sql(S.SERIES, date(2026, 6, 2), 60))
def upcoming_charges(spark: SparkSession, _: str) -> DataFrame:
    return forecast.upcoming_charges(series(spark), date(2026, 6, 2), 60)


@add("upcoming_charges_ledger", _upcoming_sql(S.LEDGER, TODAY, 60))
def upcoming_charges_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.upcoming_charges(stored_ledger(spark, folder), TODAY, 60)


# The same over series planted for the customers of the folder, which grow with it.
_PLANTED_DAY = date(2026, 1, 3)


def planted(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "customer").createOrReplaceTempView("customers_of_series")
    return spark.sql("SELECT * FROM " + S.SPARK_PLANTED.replace("FROM customer WHERE", "FROM customers_of_series WHERE"))


@add("recurring_planted", f"{S.recurring(S.PLANTED)} SELECT merchant, occurrences, median_gap, first_amount, last_amount FROM c")
def recurring_planted(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.recurring(planted(spark, folder)).select("merchant", "occurrences", "median_gap", "first_amount", "last_amount")


@add("subscriptions_planted", _subscriptions_sql(S.PLANTED))
def subscriptions_planted(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.subscriptions(planted(spark, folder))


@add("subscription_total_planted", f"SELECT subscriptions, coalesce(yearly, 0.00) AS yearly FROM ({_subscription_total_sql(S.PLANTED)})")
def subscription_total_planted(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.subscription_total(planted(spark, folder))


@add("price_increases_planted", _price_increases_sql(S.PLANTED))
def price_increases_planted(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.price_increases(planted(spark, folder))


@add("upcoming_charges_planted", _upcoming_sql(S.PLANTED, _PLANTED_DAY, 30))
def upcoming_charges_planted(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.upcoming_charges(planted(spark, folder), _PLANTED_DAY, 30)


@add("dup_charges_planted", duplicates_sql(S.PLANTED, "merchant, amount", "seq"))
def dup_charges_planted(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(sequences.duplicate_charges(planted(spark, folder)))


@add("month_bounds", "SELECT DISTINCT strftime(date, '%Y-%m') AS month, CAST(date_trunc('month', date) AS DATE) AS first, last_day(date) AS last FROM " + S.ORDERS + " t")
def month_bounds(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("date")
    return orders_ledger(spark, folder).select(F.date_format(d, "yyyy-MM").alias("month"), F.trunc(d, "month").alias("first"), F.last_day(d).alias("last")).distinct()


# --- ledger -----------------------------------------------------------------------------------------------------------


@add(
    "monthly_summary",
    "SELECT account, strftime(date, '%Y-%m') AS month, CAST(sum(greatest(amount, 0.00)) AS DECIMAL(20,2)) AS gross_expense, CAST(sum(greatest(-amount, 0.00)) AS DECIMAL(20,2)) AS credits, "
    f"CAST(sum(amount) AS DECIMAL(20,2)) AS net_expense, count(*) AS transaction_count FROM {S.LINES} t GROUP BY 1, 2",
)
def monthly_summary(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.monthly_summary(lineitem_ledger(spark, folder))


OVERRIDES = "('beantide coffee', '餐饮外卖', 1), ('beantide coffee', '咖啡', 2), ('zumblo ride', '旅行', 1), ('not a merchant', '其他', 1)"


def _overrides(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM (VALUES {OVERRIDES}) AS o(merchant_key, category, version)")


_CURRENT = f"SELECT merchant_key, arg_max(category, version) AS override, max(version) AS version FROM (VALUES {OVERRIDES}) o(merchant_key, category, version) GROUP BY merchant_key"


@add("override_join", f"SELECT id, coalesce(override, category) AS category FROM ledger_transactions t LEFT JOIN ({_CURRENT}) o ON o.merchant_key = t.merchant_key")
def override_join(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.with_overrides(table(spark, folder, "ledger_transactions").select("id", "merchant_key", "category"), _overrides(spark)).select("id", "category")


@add(
    "category_state",
    f"SELECT coalesce(s.merchant_key, o.merchant_key) AS merchant_key, coalesce(override, own) AS category, coalesce(version, 0) AS version FROM (SELECT merchant_key, first(category ORDER BY id) AS own "
    f"FROM ledger_transactions GROUP BY merchant_key) s FULL JOIN ({_CURRENT}) o ON o.merchant_key = s.merchant_key",
)
def category_state(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.category_state(table(spark, folder, "ledger_transactions").withColumn("seq", F.col("id")), _overrides(spark))


def _halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Orders but every third as stored, all orders as incoming, with the amount of every hundredth changed."""
    rows = orders_ledger(spark, folder)
    changed = F.when(F.col("seq") % 100 == 0, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(20,2)")
    return rows.where(F.col("seq") % 3 != 0), rows.withColumn("amount", changed)


@add("import_states", f"SELECT txn_id, CASE WHEN seq % 3 = 0 THEN 'new' WHEN seq % 100 = 0 THEN 'conflict' ELSE 'repeated' END AS state FROM {S.ORDERS} t")
def import_states(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.classified(*_halves(spark, folder)).select("txn_id", "state")


@add("import_validation", "SELECT txn_id, CASE WHEN trim(merchant) = '' THEN 'merchant' WHEN trim(txn_id) = '' THEN 'txn_id' WHEN amount <> round(amount, 2) OR abs(amount) >= 100000000000000000 THEN 'amount' WHEN category NOT IN ("
     + ", ".join(f"'{c}'" for c in CATEGORIES) + ") THEN 'category' END AS error FROM (VALUES ('a', 'X', 1.00, '其他'), ('b', ' ', 1.00, NULL), (' ', 'Y', 2.00, NULL), ('c', 'Z', 0.005, NULL), ('d', 'Z', 1.50, 'nope'), ('e', 'Z', 100000000000000000.00, NULL)) t(txn_id, merchant, amount, category)")
def import_validation(spark: SparkSession, _: str) -> DataFrame:
    rows = spark.sql("SELECT *, 'card' AS account FROM (VALUES ('a', 'X', 1.00, '其他'), ('b', ' ', 1.00, NULL), (' ', 'Y', 2.00, NULL), ('c', 'Z', 0.005, NULL), ('d', 'Z', 1.50, 'nope'), ('e', 'Z', 100000000000000000.00, NULL)) AS t(txn_id, merchant, amount, category)")
    return rows.select("txn_id", ledger.row_error().alias("error"))


@add("category_accuracy", "SELECT count(*) FILTER (category IS NOT DISTINCT FROM want) AS correct, count(*) AS total, round(count(*) FILTER (category IS NOT DISTINCT FROM want) / count(*), 6) AS accuracy FROM (SELECT category, CASE WHEN id % 3 = 0 THEN '其他' ELSE category END AS want FROM ledger_transactions)")
def category_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "ledger_transactions").select(F.col("id").alias("txn_id"), "category")
    return categorize.accuracy(rows, rows.withColumn("category", F.when(F.col("txn_id") % 3 == 0, "其他").otherwise(F.col("category"))))


@add("missing_events", "SELECT t.id, t.batch_id, b.created_at FROM ledger_transactions t JOIN import_batches b ON b.id = t.batch_id WHERE t.id NOT IN (SELECT ledger_id FROM event_deliveries WHERE ledger_id IS NOT NULL)")
def missing_events(spark: SparkSession, folder: str) -> DataFrame:
    found = projections.missing_events(*(table(spark, folder, t) for t in ("ledger_transactions", "import_batches", "event_deliveries")))
    return found.select("id", "batch_id", "created_at")


@add("delivery_status", "SELECT 'delivered' AS state, count(DISTINCT ledger_id) AS events FROM event_deliveries WHERE ledger_id IS NOT NULL UNION ALL SELECT 'pending', count(*) FROM ledger_transactions WHERE id NOT IN (SELECT ledger_id FROM event_deliveries WHERE ledger_id IS NOT NULL)")
def delivery_status(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows of the ledger have an event that was delivered, and how many wait for one."""
    return projections.delivery_status(*(table(spark, folder, t) for t in ("ledger_transactions", "event_deliveries")))


# --- the stored ledger ------------------------------------------------------------------------------------------------


def _store(spark: SparkSession) -> ledger.LedgerStore:
    """A ledger of its own for one query, gone with the session."""
    folder = f"{checkpoint_root(spark)}/ledger-{uuid.uuid4().hex}"
    forget(spark, folder)
    return ledger.LedgerStore(spark, folder)


_OLD = f"(SELECT count(*) FROM {S.ORDERS} t WHERE seq % 3 <> 0)"
_ALL = f"(SELECT count(*) FROM {S.ORDERS} t)"


@add(
    "import_repeat",
    f"SELECT 1 AS step, {_OLD} AS imported, 0 AS skipped, FALSE AS repeated UNION ALL SELECT 2, 0, {_OLD}, TRUE UNION ALL SELECT 3, 0, {_OLD}, TRUE UNION ALL SELECT 4, {_ALL} - {_OLD}, {_OLD}, FALSE",
)
def import_repeat(spark: SparkSession, folder: str) -> DataFrame:
    """Two thirds of the orders imported, the same again, once more by content alone, then all orders."""
    store, rows = _store(spark), orders_ledger(spark, folder).withColumn("category", F.lit(None).cast("string"))
    old = rows.where(F.col("seq") % 3 != 0)
    steps = [store.import_rows(old, "one"), store.import_rows(old, "copy"), store.import_rows(old.orderBy(F.desc("seq")), "reordered"), store.import_rows(rows, "all", "hash of all")]
    made = [(i, r.imported, r.skipped, r.repeated_file) for i, r in enumerate(steps, 1)]
    return spark.createDataFrame(made, "step int, imported long, skipped long, repeated boolean")


_TAGS = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"


@add("import_tagged", f"SELECT {_TAGS}[1 + seq % {len(CATEGORIES)}] AS category, count(*) AS rows, CAST(sum(amount) AS DECIMAL(20,2)) AS amount FROM {S.ORDERS} t GROUP BY 1")
def import_tagged(spark: SparkSession, folder: str) -> DataFrame:
    """The orders as a file that was categorized before it was imported."""
    store, rows = _store(spark), orders_ledger(spark, folder).withColumn("category", F.lit(None).cast("string"))
    tagged = rows.withColumn("category", F.element_at(F.array(*map(F.lit, CATEGORIES)), (1 + F.col("seq") % len(CATEGORIES)).cast("int")))
    store.import_file(rows, "orders.csv", b"orders", tagged)
    return store.transactions().groupBy("category").agg(F.count("*").alias("rows"), F.sum("amount").cast("decimal(20,2)").alias("amount"))


_FIRST = "(SELECT merchant_key AS k, first(category ORDER BY id) AS c FROM ledger_transactions WHERE merchant_key = (SELECT min(merchant_key) FROM ledger_transactions) GROUP BY 1)"


@add(
    "correction_log",
    f"SELECT k AS merchant_key, c AS before_category, '旅行' AS category, 0 AS before_version, 1 AS version, TRUE AS changed, 'r1' AS request_id FROM {_FIRST} UNION ALL SELECT k, '旅行', '旅行', 1, 1, FALSE, 'r2' FROM {_FIRST} "
    f"UNION ALL SELECT k, '旅行', '娱乐', 1, 2, TRUE, 'r3' FROM {_FIRST}",
)
def correction_log(spark: SparkSession, folder: str) -> DataFrame:
    """The audit of four corrections of the first merchant: one, the same request again, one that changes nothing, another."""
    store, rows = _store(spark), table(spark, folder, "ledger_transactions")
    first = rows.agg(F.min("merchant_key")).first()[0]
    store.import_rows(stored_ledger(spark, folder).join(rows.where(F.col("merchant_key") == first).select(F.col("id").alias("seq")), "seq", "left_semi"), "bill")
    for category, version, request in (("旅行", 0, "r1"), ("旅行", 0, "r1"), ("旅行", 1, "r2"), ("娱乐", 1, "r3")):
        store.correct_category(first, category, version, request)
    return store.audits().drop("created_at")
