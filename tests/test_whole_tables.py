"""Queries over the stored tables, where an earlier twin has its rows inline."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest

import __spark_entry__
from quillspark.plans import sql as S


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    ledger = spark.sql(S.SPARK_SERIES).selectExpr("*", "seq AS id", "lower(merchant) AS merchant_key").drop("seq")
    ledger.write.parquet(f"{path}/ledger_transactions.parquet")
    lines = [(1, "a\t", " 2026/1/6", "　X ", "+12.30 ", "card"), (2, None, "2026-13-01", "Y", "7", "card"), (3, "c", "01/07/2026\t", "Z", "1,234.5", "card")]
    spark.createDataFrame(lines, "id long, txn_id string, date string, merchant string, amount string, account string").write.parquet(f"{path}/incoming_transactions.parquet")
    spark.sql("SELECT 1L AS l_orderkey, n AS l_linenumber, 7L AS l_partkey, 10.0 * n AS l_extendedprice, if(n = 4, 'R', 'N') AS l_returnflag, 'O' AS l_linestatus, date_add(DATE '1996-01-01', n) AS l_shipdate FROM (SELECT explode(array(1, 2, 3, 4, 5, 6)) AS n)").write.parquet(f"{path}/lineitem.parquet")
    spark.sql("SELECT 7L AS p_partkey, 'Brand#1' AS p_brand, 'TIN' AS p_type").write.parquet(f"{path}/part.parquet")
    return path


@pytest.mark.parametrize("name", ["subscriptions", "subscription_total", "price_increases"])
def test_series_in_the_ledger(spark, folder, name):
    known = __spark_entry__.queries()
    rows = known[f"{name}_ledger"](spark, folder).collect()
    assert rows and rows == known[name](spark, folder).collect()


def test_upcoming_of_the_ledger(spark, folder):
    found = {r["merchant"]: r["next_date"] for r in __spark_entry__.queries()["upcoming_charges_ledger"](spark, folder).collect()}
    assert found["SPOTIFY"] == date(2026, 9, 30) and found["INSURANCE"] == date(2026, 10, 15)


def test_lines_of_the_batches(spark, folder):
    known = __spark_entry__.queries()
    assert [tuple(r) for r in known["ingest_parse_incoming"](spark, folder).collect()] == [(1, "a", date(2026, 1, 6), "X", Decimal("12.30"), "card")]
    assert sorted(tuple(r) for r in known["ingest_reject_incoming"](spark, folder).collect()) == [(2, None, "date"), (3, "c", "amount")]
    assert [tuple(r) for r in known["ingest_flip_sign_incoming"](spark, folder).collect()] == [(1, "a", Decimal("-12.30"))]


def test_rules_over_every_key(spark, folder):
    got = {r["merchant_key"]: r["category"] for r in __spark_entry__.queries()["rule_match_ledger"](spark, folder).collect()}
    assert len(got) == 14 and got["netflix"] == "订阅" and got["refunds"] is None


def test_traps_of_the_lines(spark, folder):
    assert __spark_entry__.queries()["trap_check_lines"](spark, folder).first().asDict() == {"doubled_days": 0, "refunds": 1, "small_regular": 0, "risen": 0, "far_outliers": 0, "wide_spread": 0}
