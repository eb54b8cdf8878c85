from __future__ import annotations

from datetime import date
from decimal import Decimal as D

import pytest

from quillspark.errors import QueryError
from quillspark.operators import query as Q
from quillspark.operators.query import Filters


def ask(txns, agg="sum", **filters):
    row = Q.headline(txns, Filters(**filters), agg).first()
    return row["matched"], row["value"]


@pytest.mark.parametrize("agg,value", [("sum", "491.00"), ("avg", "61.38"), ("max", "200.00"), ("min", "-50.00"), ("count", "8")])
def test_aggregates(golden, agg, value):
    assert ask(golden, agg) == (8, D(value))


@pytest.mark.parametrize(
    "filters,expected",
    [
        (dict(date_from=date(2026, 2, 3), date_to=date(2026, 2, 28)), (3, "300.00")),
        (dict(date_from=date(2026, 3, 1)), (3, "180.00")),
        (dict(date_to=date(2026, 1, 31)), (2, "11.00")),
        (dict(categories=("咖啡",)), (2, "11.00")),
        (dict(categories=("咖啡", "超市")), (4, "231.00")),
        (dict(merchant_contains="starBUCKS"), (2, "11.00")),
        (dict(merchant_contains="%"), (0, "0.00")),
        (dict(account="checking"), (1, "30.00")),
        (dict(date_from=date(2026, 2, 1), categories=("超市",)), (2, "220.00")),
        (dict(categories=("旅行",)), (0, "0.00")),
    ],
)
def test_filters(golden, filters, expected):
    assert ask(golden, **filters) == (expected[0], D(expected[1]))


def test_rows_without_category_are_their_own_group(bill, golden):
    more = golden.unionByName(bill([("9", date(2026, 4, 1), "X", "1.00", "credit", None)]))
    assert ask(more, categories=("未分类",)) == (1, D("1.00"))
    assert [r["key"] for r in Q.groups(more).collect()][-1] == "未分类"


def test_groups_are_ordered(golden):
    assert [(r["key"], str(r["value"])) for r in Q.groups(golden).collect()] == [("超市", "220.00"), ("购物", "150.00"), ("餐饮外卖", "80.00"), ("交通", "30.00"), ("咖啡", "11.00")]
    assert [r["key"] for r in Q.groups(golden, group_by="month").collect()] == ["2026-01", "2026-02", "2026-03"]
    assert [r["key"] for r in Q.groups(golden, group_by="merchant").collect()][:2] == ["SAFEWAY #9", "AMZN Mktp US"]
    counted = Q.groups(golden, agg="count", group_by="merchant").first()
    assert (counted["key"], counted["value"]) == ("STARBUCKS #1234", D(2))  # three have two; the first seen leads


def test_grouping_leaves_the_headline_alone(golden):
    for group in ("none", "category", "month", "merchant"):
        assert Q.query(golden, group_by=group).headline.first()["value"] == D("491.00")
    rows = {r["key"]: r["value"] for r in Q.headline_and_groups(golden).collect()}
    assert rows[None] == D("491.00") and rows["超市"] == D("220.00")


def test_bad_requests_are_refused(golden):
    for wrong in (lambda: Filters(categories=("nope",)), lambda: Filters(date(2026, 2, 1), date(2026, 1, 1)), lambda: Q.headline(golden, agg="median"), lambda: Q.query(golden, group_by="week"), lambda: Q.merchants(golden, 0), lambda: Q.fetch(golden, limit=201)):
        with pytest.raises(QueryError):
            wrong()


def test_empty_table(golden):
    none = golden.limit(0)
    assert ask(none, "max") == (0, D("0.00")) and Q.groups(none).count() == 0
    assert Q.describe(none).first()["rows"] == 0
    with pytest.raises(QueryError):
        Q.require_categories(none)


def test_lists(golden):
    assert [(r["account"], r["count"]) for r in Q.accounts(golden).collect()] == [("credit", 7), ("checking", 1)]
    assert [r["merchant"] for r in Q.merchants(golden, 2).collect()] == ["AMZN Mktp US", "SAFEWAY #9"]
    rows, total = Q.fetch(golden, Filters(account="credit"), 3)
    assert ([r["txn_id"] for r in rows.collect()], total) == (["1", "2", "3"], 7)
    assert Filters(account="a").describe() == "account a" and Filters().describe() == "all transactions"
    assert Q.uncategorized(golden).count() == 0
