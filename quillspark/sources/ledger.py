"""Transactions from CSV files and from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IngestError
from ..functions.columns import money, parsed_date, stripped
from ..schema import MONEY
from .tables import table

REQUIRED = ("txn_id", "date", "merchant", "amount", "account")


def parsed_rows(raw: DataFrame, flip_sign: bool = False) -> DataFrame:
    """Typed transactions of rows of text, with ``bad``: the columns that can't be read.

    Text is trimmed. Rows with the same identifier are kept as they are. A null
    date or amount is unreadable.
    """
    amount = money(stripped(F.col("amount").cast("string")))
    typed = raw.select(
        "*", parsed_date(stripped(F.col("date"))).alias("__date"), (-amount if flip_sign else amount).cast(MONEY).alias("__amount")
    )
    bad = F.filter(F.array(F.when(F.col("__date").isNull(), F.lit("date")), F.when(F.col("__amount").isNull(), F.lit("amount"))), lambda x: x.isNotNull())
    others = [stripped(F.col(c)).alias(c) if c in ("txn_id", "merchant", "account") else F.col(c) for c in raw.columns if c not in ("date", "amount")]
    return typed.select(*others, F.col("__date").alias("date"), F.col("__amount").alias("amount"), bad.alias("bad"))


def read_bill(spark: SparkSession, path: str, columns: dict[str, str] | None = None, flip_sign: bool = False) -> DataFrame:
    """Transactions of a CSV file with a header; ``columns`` names the file's columns for ours.

    Raises IngestError for a missing column, and for the first unreadable row,
    with its line. ``seq`` is the order of rows in the file.
    """
    names = {c: c for c in REQUIRED} | (columns or {})
    text = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).csv(path)
    missing = sorted(set(names.values()) - set(text.columns))
    if missing:
        raise IngestError(f"missing columns {missing}; the header has {text.columns}")
    raw = text.select(*(F.col(f"`{names[c]}`").cast("string").alias(c) for c in REQUIRED)).withColumn("seq", F.monotonically_increasing_id())
    rows = parsed_rows(raw, flip_sign)
    wrong = rows.where(F.size("bad") > 0).orderBy("seq").select("seq", "bad", "txn_id").first()
    if wrong:
        line = rows.where(F.col("seq") < wrong["seq"]).count() + 2
        raise IngestError(f"line {line} ({wrong['txn_id']}): unreadable {', '.join(wrong['bad'])}")
    return rows.drop("bad").withColumn("category", F.lit(None).cast("string"))


def write_bill(txns: DataFrame, path: str) -> None:
    """The five columns as CSV, in order, without categories."""
    txns.orderBy("date", "seq").select("txn_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "merchant", F.col("amount").cast("string").alias("amount"), "account").write.mode(
        "overwrite"
    ).option("header", True).csv(path)


def write_labels(txns: DataFrame, path: str) -> None:
    txns.orderBy("date", "seq").select("txn_id", "category").write.mode("overwrite").option("header", True).csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("txn_id string, category string").option("header", True).csv(path)


def orders_ledger(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("txn_id"), F.col("o_orderdate").cast("date").alias("date"),
        F.concat(F.lit("CUST #"), F.col("o_custkey").cast("string")).alias("merchant"), F.col("o_totalprice").cast(MONEY).alias("amount"),
        F.col("o_orderstatus").alias("account"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("category"), F.col("o_orderkey").alias("seq"),
    )


def lineitem_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with their part as merchant; returned ones are refunds."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    price = F.col("l_extendedprice").cast(MONEY)
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("txn_id"), F.col("l_shipdate").cast("date").alias("date"),
        F.concat("p_brand", F.lit(" #"), F.col("l_partkey").cast("string")).alias("merchant"),
        F.when(F.col("l_returnflag") == "R", -price).otherwise(price).cast(MONEY).alias("amount"),
        F.col("l_linestatus").alias("account"), F.col("p_type").alias("category"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


def events_ledger(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(
        F.col("event_id").cast("string").alias("txn_id"), F.col("ts").cast("date").alias("date"), F.col("event_type").alias("merchant"), F.col("value").cast(MONEY).alias("amount"),
        (F.col("user_id") % 4).cast("string").alias("account"), (F.get_json_object("props", "$.k").cast("long") % 5).cast("string").alias("category"), F.col("event_id").alias("seq"),
    )


def stored_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The accepted history of the test tables in the transaction model."""
    return table(spark, folder, "ledger_transactions").select("txn_id", "date", "merchant", F.col("amount").cast(MONEY).alias("amount"), "account", "category", F.col("id").alias("seq"))
