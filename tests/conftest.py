from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest

from quillspark.schema import TRANSACTION
from quillspark.session import build_session

GOLDEN = [
    ("1", date(2026, 1, 5), "STARBUCKS #1234", "5.00", "credit", "咖啡"), ("2", date(2026, 1, 20), "STARBUCKS #1234", "6.00", "credit", "咖啡"), ("3", date(2026, 2, 3), "SAFEWAY #9", "120.00", "credit", "超市"),
    ("4", date(2026, 2, 14), "TST* SUSHI PALACE", "80.00", "credit", "餐饮外卖"), ("5", date(2026, 2, 28), "SAFEWAY #9", "100.00", "credit", "超市"), ("6", date(2026, 3, 1), "UBER *TRIP", "30.00", "checking", "交通"),
    ("7", date(2026, 3, 15), "AMZN Mktp US", "200.00", "credit", "购物"), ("8", date(2026, 3, 31), "AMZN Mktp US", "-50.00", "credit", "购物"),
]


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def bill(spark):
    """Makes transactions of (txn_id, date, merchant, amount, account, category) rows."""

    def make(rows):
        return spark.createDataFrame([(i, d, m, Decimal(a), acc, c, n) for n, (i, d, m, a, acc, c) in enumerate(rows)], TRANSACTION)

    return make


@pytest.fixture(scope="session")
def golden(bill):
    return bill(GOLDEN)


@pytest.fixture(scope="session")
def charges(bill):
    """Makes a merchant's transactions of (date, amount) pairs."""

    def make(*series):
        return bill([(f"{m}{i}", d, m, str(a), "card", None) for m, rows in series for i, (d, a) in enumerate(rows)])

    return make


def months(year: int, month: int, day: int, count: int, step: int = 1) -> list[date]:
    return [date(year + (month - 1 + i * step) // 12, (month - 1 + i * step) % 12 + 1, day) for i in range(count)]
