"""The transaction model and the fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = "decimal(20,2)"

# The categories, the label of rows without one, and the fallback category.
CATEGORIES = ["房租", "水电燃气", "通讯", "超市", "餐饮外卖", "咖啡", "交通", "购物", "订阅", "医疗", "娱乐", "旅行", "其他"]
UNCATEGORIZED = "未分类"
FALLBACK = "其他"

# Merchant keywords and their category; the longest keyword that occurs wins.
RULES = [
    ("starbucks", "咖啡"), ("blue bottle", "咖啡"), ("peets", "咖啡"), ("safeway", "超市"), ("trader joes", "超市"), ("whole foods", "超市"), ("costco", "超市"),
    ("pacific property", "房租"), ("city utilities", "水电燃气"), ("verizon", "通讯"), ("netflix", "订阅"), ("spotify", "订阅"), ("readly", "订阅"),
]

AGGREGATES = ("sum", "count", "avg", "max", "min")
GROUPINGS = ("none", "category", "month", "merchant")

TRANSACTION = T.StructType(
    [
        T.StructField("txn_id", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("merchant", T.StringType()),
        T.StructField("amount", T.DecimalType(20, 2)),
        T.StructField("account", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)

# Limits of the stored strings and amounts, and the published event's type.
LIMITS = {"account": 128, "txn_id": 256, "merchant": 512, "merchant_key": 512, "batch_id": 32, "category": 64}
LARGEST_AMOUNT = "100000000000000000"
EVENT_TYPE, EVENT_VERSION, EVENT_BYTES = "ledger.transaction_imported.v1", 1, 65_536
