"""Exactly one copy of each message from an at-least-once feed.

A message is known by its identifier (32 hexadecimal digits, however written,
or any other text as it stands) or by the ledger row it carries.  Copies are ranked by delivery number, the
first one of an identifier stays, and receipts kept from earlier runs take
precedence over every delivery.  Contents are compared by hash, so no payload
is shuffled.

Skew: every shuffle on an identifier runs after a map-side aggregation to one
row per (identifier, content), so a hot identifier reaches its reducer as few
rows.  The one join back to the deliveries has that small side and is a shuffle
join which the adaptive skew rule may split.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written


def canonical_json(value) -> str:
    """Sorted keys, no blanks, no escapes beyond those JSON needs."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def unwrap(text: str):
    """The JSON value of ``text``; a string that itself holds JSON is opened once."""
    value = json.loads(text)
    if isinstance(value, str):
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value


@F.pandas_udf(T.StringType())
def canonical_sha256(payload: pd.Series) -> pd.Series:
    """SHA-256 of the canonical form; of the raw text where that is not JSON; null for null."""

    def one(text):
        if text is None:
            return None
        try:
            text = canonical_json(unwrap(text))
        except ValueError:
            text = "raw:" + text
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    return payload.map(one, na_action="ignore")


#: Digits of an identifier as the producer makes it.
DIGITS = 32


def identifier(raw: Column) -> Column:
    """An identifier as bytes: its 32 hexadecimal digits however written, else the whole text as it stands; null for blank.

    Case, separators, brackets and the marks before a UUID or a hexadecimal
    number don't count.  A text that isn't 32 digits then is another kind of
    identifier, and nothing is taken from it but white space at its ends; a zero
    byte before it keeps it apart from digits.
    """
    text = F.trim(raw)
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"^(urn:)?uuid:|^0x", ""), r"[\s{}()\[\]:._-]", "")
    short = F.when(bare.rlike(rf"^[0-9a-f]{{1,{DIGITS}}}$"), F.lpad(bare, DIGITS, "0"))  # zeros at the beginning may be left out
    return F.coalesce(F.unhex(short), F.when(text != "", F.concat(F.lit(b"\x00"), F.encode(text, "utf-8"))))


def message_keys(deliveries: DataFrame) -> DataFrame:
    """(delivery_id, event, content, ledger, body) of each delivery; hashes as binary.

    ``content`` is the given hash, or the hash of the canonical payload where
    none was given.  ``body`` hashes the ``transaction`` object, whose keys a
    VARIANT keeps sorted; it is null while only the hash of a message is known.
    """
    doc = F.try_parse_json(F.col("payload"))
    opened = F.when(F.schema_of_variant(doc) == "STRING", F.try_parse_json(F.try_variant_get(doc, "$", "string"))).otherwise(doc)
    rows = deliveries.select(
        F.col("delivery_id").cast("long").alias("delivery_id"),
        F.col("event_id"),
        F.col("ledger_id").cast("long").alias("ledger_id"),
        opened.alias("doc"),
        F.lower("payload_hash").alias("given"),
        F.when(F.col("payload_hash").isNull(), F.col("payload")).alias("unhashed"),
    )
    text = F.to_json(F.try_variant_get("doc", "$.transaction", "variant"))
    return rows.select(
        "delivery_id",
        F.coalesce(identifier(F.col("event_id")), identifier(F.try_variant_get("doc", "$.event_id", "string"))).alias("event"),
        F.unhex(F.coalesce("given", canonical_sha256("unhashed"))).alias("content"),
        F.coalesce("ledger_id", F.try_variant_get("doc", "$.transaction.id", "long")).alias("ledger"),
        F.unhex(F.sha2(text, 256)).alias("body"),
    )


def _judged(deliveries: DataFrame, receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All deliveries as (delivery_id, event, content), and the contents that count with their first delivery."""
    # Payloads are parsed and hashed once; what is kept of each is a few hashes.
    keys = written(message_keys(deliveries))
    # An event without identifier stands for itself, so that ledger rows can still match it.
    keyed = keys.where(F.col("content").isNotNull() & F.col("delivery_id").isNotNull()).withColumn(
        "event", F.coalesce("event", F.concat(F.lit(b"\x00none"), F.col("content")))
    )
    contents = keyed.groupBy("event", "content").agg(F.min("delivery_id").alias("first"), F.max("body").alias("body"), F.max("ledger").alias("ledger"))
    kept = receipts.select(
        identifier(F.col("event_id")).alias("event"), F.unhex(F.lower("payload_hash")).alias("content")
    ).where(F.col("event").isNotNull() & F.col("content").isNotNull())
    # One row per event: the content that counts. Receipts come before any delivery.
    claims = contents.select("event", "content", "first").unionByName(kept.select("event", "content", F.lit(-1).cast("long").alias("first")))
    leading = claims.groupBy("event").agg(F.min(F.struct("first", "content")).alias("lead"))
    receipted = kept.groupBy("event", "content").agg(F.lit(True).alias("receipted"))
    sound = (
        contents.join(leading, "event")
        .join(receipted, ["event", "content"], "left")
        .where((F.col("content") == F.col("lead.content")) | F.col("receipted"))
        .select("event", "content", "first", "body", "ledger", F.coalesce("receipted", F.lit(False)).alias("receipted"))
    )
    owners = sound.where(F.col("ledger").isNotNull()).groupBy("ledger").agg(F.min(F.struct("first", "event", "body")).alias("owner"))
    verdict = (
        sound.join(owners, "ledger", "left")
        .withColumn("other", F.col("owner").isNotNull() & (F.col("owner.event") != F.col("event")) & (F.col("owner.first") < F.col("first")))
        .withColumn("reissued", F.col("other") & F.coalesce(F.col("body") == F.col("owner.body"), F.lit(False)))
        .withColumn("clash", F.col("other") & F.coalesce(F.col("body") != F.col("owner.body"), F.lit(False)))
        .where(F.col("receipted") | ~F.col("clash"))
        .select("event", "content", "first", (F.col("receipted") | F.col("reissued")).alias("all_copies"))
    )
    return keyed.select("delivery_id", "event", "content"), verdict


def repeated_deliveries(deliveries: DataFrame, receipts: DataFrame) -> DataFrame:
    """The deliveries to drop: (delivery_id).

    * Same identifier and same content as the first delivery of that identifier,
      or as a receipt of any consumer.
    * Same ledger row and same transaction as an earlier event with another identifier.
    * A known identifier or ledger row with other content is a conflict; it is
      not reported and never becomes the copy that others are compared with.

    Nulls: a delivery without identifier is known by its ledger row only; one
    without ledger row by its identifier only; one without either, or without
    payload and hash, is never a repeat.  Rows that repeat a ``delivery_id``
    count once.  Empty tables give an empty result.  Other columns are ignored.
    """
    keyed, verdict = _judged(deliveries, receipts)
    return (
        keyed.join(verdict, ["event", "content"])
        .where(F.col("all_copies") | (F.col("delivery_id") > F.col("first")))
        .select("delivery_id")
        .distinct()
    )


def conflicting_deliveries(deliveries: DataFrame, receipts: DataFrame) -> DataFrame:
    """(delivery_id) of the deliveries that contradict a known identifier or ledger row; a consumer must stop at them."""
    keyed, verdict = _judged(deliveries, receipts)
    return keyed.join(verdict, ["event", "content"], "left_anti").select("delivery_id").distinct()


def deliver_once(deliveries: DataFrame, receipts: DataFrame) -> DataFrame:
    """The deliveries with all repeats taken out (columns unchanged); conflicts stay for the consumer to reject."""
    found = repeated_deliveries(deliveries, receipts).select(F.col("delivery_id").alias("__repeat"))
    return deliveries.join(found, deliveries["delivery_id"] == found["__repeat"], "left_anti")
