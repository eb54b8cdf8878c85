from __future__ import annotations

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from quillspark.errors import IngestError
from quillspark.functions.columns import normalized_merchant, rule_category
from quillspark.operators import categorize as K
from quillspark.sources.ledger import read_bill, write_bill

NAMES = {
    "CHIPOTLE 1234": "chipotle", "PEETS #88": "peets", "BEST BUY #245": "best buy", "TARGET T-1234": "target", "SPOTIFY P0A1B2C3": "spotify", "SHELL OIL 57440": "shell oil",
    "AMZN Mktp US*2H4KJ": "amzn mktp us", "DELTA AIR LINES 0062": "delta air lines", "STARBUCKS #1234 SEATTLE WA": "starbucks", "NETFLIX.COM": "netflix.com", "UBER *EATS": "uber eats",
    "FEDEX OFFICE IN": "fedex", "RENT WA": "rent wa", "#1234": "#1234", "1234": "1234", "  ": "", "AB　CD": "ab cd", "CAFÉ ² X": "café x",
}


def test_normalization_is_idempotent(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "n string").withColumn("k", normalized_merchant(F.col("n"))).withColumn("again", normalized_merchant(F.col("k"))).collect()
    assert {r["n"]: r["k"] for r in rows} == NAMES
    assert all(r["again"] == r["k"] for r in rows)
    assert spark.sql("select cast(null as string) n").select(normalized_merchant(F.col("n"))).first()[0] is None


def bill_file(tmp_path, text):
    path = tmp_path / "bill.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_read_bill(spark, tmp_path):
    path = bill_file(tmp_path, "txn_id,date,merchant,amount,account\na,2026-01-05, X ,1.005,card\na,2026/1/5,Y,-2,card\nb, 01/05/2026 ,Z,3,card\n")
    rows = read_bill(spark, path).orderBy("seq").collect()
    assert [(r["txn_id"], r["date"], r["merchant"], r["amount"]) for r in rows] == [("a", date(2026, 1, 5), "X", D("1.01")), ("a", date(2026, 1, 5), "Y", D("-2.00")), ("b", date(2026, 1, 5), "Z", D("3.00"))]


def test_rename_flip_and_write(spark, tmp_path):
    path = bill_file(tmp_path, "id,when,merchant,amount,account,more\na,2026-01-05,X,1.00,card,?\n")
    rows = read_bill(spark, path, {"txn_id": "id", "date": "when"}, flip_sign=True)
    assert rows.first()["amount"] == D("-1.00")
    write_bill(rows, str(tmp_path / "out"))
    assert read_bill(spark, str(tmp_path / "out")).first()["amount"] == D("-1.00")


def test_bad_files_name_the_place(spark, tmp_path):
    with pytest.raises(IngestError, match="amount"):
        read_bill(spark, bill_file(tmp_path, "txn_id,date,merchant,account\na,2026-01-05,X,card\n"))
    with pytest.raises(IngestError, match="line 3.*date"):
        read_bill(spark, bill_file(tmp_path, "txn_id,date,merchant,amount,account\na,2026-01-05,X,1,card\nb,05.01.2026,X,1,card\n"))


def test_rules(spark):
    keys = {"starbucks": "咖啡", "safeway": "超市", "netflix.com": "订阅", "unknown": None, "peets trader joes": "超市"}
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", rule_category(F.col("k")).alias("c")).collect()
    assert {r["k"]: r["c"] for r in rows} == keys


def test_three_tiers(spark, bill):
    day = date(2026, 1, 1)
    txns = bill([(str(i), day, m, "1.00", "a", None) for i, m in enumerate(["STARBUCKS #1", "STARBUCKS #2", "KNOWN 7", "ASKED", "LOST", None])])
    known = spark.createDataFrame([("known", "购物"), ("lost", "no such"), ("asked", None)], "merchant_key string, category string")

    def classify(keys):
        return keys.select("merchant_key", F.when(F.col("merchant_key") == "asked", "旅行").otherwise("nonsense").alias("category"))

    decided = K.decided_keys(txns, known, classify)
    assert {r["merchant_key"]: (r["category"], r["tier"], r["fell_back"]) for r in decided.collect()} == {
        "starbucks": ("咖啡", "rule", False), "known": ("购物", "cache", False), "asked": ("旅行", "model", False), "lost": ("其他", "model", True),
    }
    stats = K.tier_stats(decided).first()
    assert (stats["merchants"], stats["by_rule"], stats["by_cache"], stats["by_model"], stats["fallback"], stats["cache_hit_rate"]) == (4, 1, 1, 2, 1, 0.333333)
    assert {r["txn_id"]: r["category"] for r in K.categorized(txns, decided).collect()}["1"] == "咖啡"


def test_precision_and_recall(spark):
    tagged = spark.createDataFrame([("1", "A", "咖啡"), ("2", "A", "咖啡"), ("3", "B", "超市"), ("4", "B", None)], "txn_id string, merchant string, category string")
    truth = spark.createDataFrame([("1", "咖啡"), ("2", "超市"), ("3", "超市")], "txn_id string, category string")
    rows = {r["category"]: r for r in K.per_class(tagged, truth).collect()}
    assert (rows["咖啡"]["precision"], rows["咖啡"]["recall"], rows["超市"]["precision"], rows["超市"]["recall"], rows["超市"]["support"]) == (0.5, 1.0, 1.0, 0.5, 2)
    assert [(r["merchant"], r["count"]) for r in K.top_misclassified(tagged, truth).collect()] == [("A", 1)]
