"""Finance projections over a stream of imported transactions.

Two independent consumers read the same events, each with its own checkpoint and
receipts: monthly summaries and duplicate charges.  No watermark is set, since a
late event must change its month and its cluster however late it is; state is
tables in a shared folder.  A micro-batch writes only folders named by its epoch,
overwriting what an interrupted attempt left, so a replay has no second effect.
Receipts and results are read from epochs that were completed.

The cost of a micro-batch doesn't grow with history: receipts lie in folders by
the hash of their key and applied rows by account, merchant and amount, and a
batch reads the folders of its own keys only.  ``compact`` puts the results of
many epochs together.

An invalid event, or one that contradicts an earlier one, stops the stream; its
offset isn't committed.  Where messages have their place (``partition`` and
``offset``), the events before an invalid one are applied first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import ExitStack

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidEvent
from ..functions.columns import normalized_merchant
from ..operators.ledger import monthly_summary
from ..operators.sequences import account_duplicates
from ..schema import EVENT_BYTES, EVENT_TYPE, EVENT_VERSION, LARGEST_AMOUNT, LIMITS, MONEY
from ..storage import exists, read_mark, write_mark

SOURCE = "id bigint, txn_id string, date string, merchant string, merchant_key string, amount string, category string, batch_id string"
ENVELOPE = f"event_id string, event_type string, schema_version int, account string, occurred_at double, transaction struct<{SOURCE.replace(' bigint', ':bigint').replace(' string', ':string')}>"
CONSUMERS = ("summary", "anomalies")
APPLIED = "event_id string, payload_hash string, source_hash string, ledger_id bigint, account string, txn_id string, date date, merchant string, merchant_key string, amount decimal(20,2)"
RECEIPTS = "kind string, key string, content string"
GROUP = ["account", "merchant_key", "amount"]
#: Folders that receipts and applied rows are laid out in.
BUCKETS = 16
SUMMARY = "account string, month string, gross_expense decimal(20,2), credits decimal(20,2), net_expense decimal(20,2), transaction_count bigint"
FINDINGS = "account string, merchant_key string, amount decimal(20,2), times int, txn_ids array<string>, dates array<date>, id string"


def event_of(txns: DataFrame, occurred: Column | None = None) -> DataFrame:
    """(key, value) of the event of each stored transaction: JSON with sorted keys, keyed by account."""
    if occurred is None:
        occurred = F.unix_timestamp(F.col("date").cast("timestamp")).cast("double")
    row = F.struct(
        F.col("amount").cast("string").alias("amount"), "batch_id", "category", F.date_format("date", "yyyy-MM-dd").alias("date"), "id", "merchant", "merchant_key", "txn_id"
    )
    envelope = F.struct(
        "account", F.md5(F.concat_ws("|", F.lit("event"), F.col("id").cast("string"))).alias("event_id"), F.lit(EVENT_TYPE).alias("event_type"), occurred.alias("occurred_at"),
        F.lit(EVENT_VERSION).alias("schema_version"), row.alias("transaction"),
    )
    return txns.select(F.col("account").alias("key"), F.to_json(envelope, {"ignoreNullFields": "false"}).alias("value"))


def validated(messages: DataFrame) -> DataFrame:
    """Events read from ``value`` (JSON text) with ``error``: what is wrong first, or null.

    The hash of the envelope is that of its value with sorted keys; the hash of
    the source is that of the ledger row's fields.
    """
    t = lambda c: F.col(f"e.transaction.{c}")
    parsed = messages.withColumn("e", F.from_json("value", ENVELOPE))
    # Columns of their own, each read twice or more below: else the planner writes them out, and they are worked out several times for each event.
    parsed = parsed.withColumns({"text": sorted_text(), "normalized": normalized_merchant(t("merchant")), "exact": t("amount").try_cast("decimal(38,18)"), "day": F.try_to_timestamp(t("date"), F.lit("yyyy-MM-dd"))})
    parsed = parsed.withColumns({"hash": F.unhex(F.sha2("text", 256)), "is_object": F.col("text").startswith("{")})
    normalized, exact, day = F.col("normalized"), F.col("exact"), F.col("day")
    bad_text = lambda c, name: c.isNull() | (F.trim(c) == "") | (F.char_length(c) > LIMITS[name])
    checks: list[tuple[str, Column]] = [
        ("size", F.octet_length("value") > EVENT_BYTES), ("json", ~F.coalesce("is_object", F.lit(False))), ("event_id", ~F.coalesce(F.col("e.event_id").rlike("^[0-9a-f]{32}$"), F.lit(False))),
        ("event_type", ~F.col("e.event_type").eqNullSafe(EVENT_TYPE)), ("schema_version", ~F.col("e.schema_version").eqNullSafe(EVENT_VERSION)),
        ("occurred_at", ~F.coalesce((F.col("e.occurred_at") >= 0) & (F.col("e.occurred_at") < float("inf")), F.lit(False))), ("account", bad_text(F.col("e.account"), "account")),
        ("transaction.id", ~F.coalesce(t("id") > 0, F.lit(False))), *((f"transaction.{c}", bad_text(t(c), c)) for c in ("txn_id", "merchant", "batch_id")),
        ("transaction.merchant_key", normalized.isNull() | ~t("merchant_key").eqNullSafe(normalized)), ("transaction.category", t("category").isNotNull() & bad_text(t("category"), "category")),
        ("transaction.date", ~F.coalesce(F.date_format(day, "yyyy-MM-dd") == t("date"), F.lit(False))),
        ("transaction.amount", F.coalesce((F.char_length(t("amount")) > 64) | exact.isNull() | (exact != exact.cast("decimal(22,2)")) | (F.abs(exact) >= F.lit(LARGEST_AMOUNT).cast("decimal(22,2)")), F.lit(True))),
    ]
    if "key" in messages.columns:  # events of an account stay in order only if they are keyed by it
        checks.append(("key", ~F.col("key").cast("string").eqNullSafe(F.col("e.account"))))
    place = [c for c in ("partition", "offset") if c in messages.columns]
    error = F.coalesce(*(F.when(bad, F.lit(name)) for name, bad in checks))
    source = F.to_json(F.struct(F.col("e.account").alias("account"), *(t(c).alias(c) for c in ("id", "txn_id", "date", "merchant", "merchant_key")), exact.cast(MONEY).cast("string").alias("amount"), t("category").alias("category"), t("batch_id").alias("batch_id")))
    return parsed.select(
        F.col("e.event_id").alias("event_id"), F.hex("hash").alias("payload_hash"), F.sha2(source, 256).alias("source_hash"), t("id").alias("ledger_id"), F.col("e.account").alias("account"),
        t("txn_id").alias("txn_id"), day.cast("date").alias("date"), t("merchant").alias("merchant"), t("merchant_key").alias("merchant_key"),
        exact.cast(MONEY).alias("amount"), error.alias("error"), *place,
    )


def sorted_text() -> Column:
    """``value`` as JSON with sorted keys and no blanks, or null if it isn't JSON; ``e`` is what was read from it.

    A value that is, letter by letter, what its known fields come to needs no second reading. Texts with escapes and
    moments that aren't written with an exponent are left out of this, since not every writer gives them alike.
    """
    t = lambda c: F.col(f"e.transaction.{c}").alias(c)
    fields = sorted(f.split(" ")[0] for f in SOURCE.split(", "))
    own = F.struct(*(F.col(f"e.{c}").alias(c) for c in ("account", "event_id", "event_type", "occurred_at", "schema_version")), F.struct(*map(t, fields)).alias("transaction"))
    alike = (F.col("e.occurred_at") >= 1e7) & (F.col("e.occurred_at") < float("inf")) & ~F.contains("value", F.lit("\\")) & (F.to_json(own, {"ignoreNullFields": "false"}) == F.col("value"))
    return F.when(alike, F.col("value")).otherwise(F.to_json(F.try_parse_json("value")))


def backfill(txns: DataFrame, batches: DataFrame, published: DataFrame) -> DataFrame:
    """(key, value) of the events that stored transactions lack; they occurred when their batch was imported.

    ``published`` has the ``ledger_id`` of the rows that have an event.  A second
    run finds nothing more, and the transactions themselves stay as they are.
    """
    lacking = missing_events(txns, batches, published)
    return event_of(lacking.drop("occurred_at"), F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6)


def missing_events(txns: DataFrame, batches: DataFrame, published: DataFrame) -> DataFrame:
    """Transactions of a listed batch that no event stands for, with their batch's ``created_at``."""
    known = batches.select(F.col("id").alias("batch_id"), "created_at")
    there = published.where(F.col("ledger_id").isNotNull()).select(F.col("ledger_id").alias("id")).distinct()
    return txns.join(there, "id", "left_anti").join(known, "batch_id")


def delivery_status(txns: DataFrame, published: DataFrame) -> DataFrame:
    """(state, events): ledger rows with a delivered event, and those that wait for one."""
    there = published.where(F.col("ledger_id").isNotNull()).select(F.col("ledger_id").alias("id")).distinct()
    count = lambda rows, state: rows.agg(F.lit(state).alias("state"), F.count("*").alias("events"))
    return count(there, "delivered").unionByName(count(txns.join(there, "id", "left_anti"), "pending"))


def buckets_of(rows: DataFrame, *key: str) -> list[int]:
    """The folders that rows fall into, at most BUCKETS."""
    return [r[0] for r in rows.select(bucket(*key)).distinct().collect()]


def bucket(*key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")


class Projection:
    """One consumer's receipts and results in a folder."""

    def __init__(self, spark: SparkSession, folder: str, consumer: str) -> None:
        if consumer not in CONSUMERS:
            raise ValueError(f"unknown consumer {consumer!r}; known are {CONSUMERS}")
        self.spark, self.consumer, self.folder = spark, consumer, f"{folder.rstrip('/')}/{consumer}"

    def _read(self, name: str, schema: str) -> DataFrame:
        """A table laid out by bucket and epoch."""
        there = exists(self.spark, f"{self.folder}/{name}")
        schema += ", bucket int, epoch bigint"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def _write(self, name: str, rows: DataFrame, epoch: int, *key: str) -> None:
        """Write the rows of an epoch; what an interrupted attempt at it wrote is replaced."""
        laid = rows.withColumn("bucket", bucket(*key)).withColumn("epoch", F.lit(epoch).cast("long")).hint("rebalance", "bucket")
        laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "epoch").parquet(f"{self.folder}/{name}")

    def applied(self, before: int | None = None) -> DataFrame:
        rows = self._read("applied", APPLIED)
        return rows if before is None else rows.where(F.col("epoch") < before)

    def receipts(self) -> DataFrame:
        """(kind, key, content) of every event and ledger row that was seen, applied or not."""
        return self._read("receipts", RECEIPTS)

    def process(self, batch: DataFrame, epoch: int) -> None:
        """Apply a micro-batch: events known by id or ledger row are skipped, contradictions raise."""
        if self._known(batch, epoch):
            return
        events = validated(batch).persist()
        try:
            # An aggregate: first() would read one partition, then four, and so on.
            wrong = events.where(F.col("error").isNotNull()).agg(F.min(F.struct("event_id", "error")).alias("e")).first()["e"]
            if wrong and {"partition", "offset"} <= set(events.columns):
                stops = events.where(F.col("error").isNotNull()).groupBy("partition").agg(F.min("offset").alias("stop"))  # a row for each partition of the topic
                self._apply(events.join(stops, "partition", "left").where(F.col("stop").isNull() | (F.col("offset") < F.col("stop"))), epoch)
            if wrong:
                raise InvalidEvent(f"event {wrong['event_id']}: {wrong['error']}")
            self._apply(events, epoch)
        finally:
            events.unpersist()

    def _known(self, batch: DataFrame, epoch: int) -> bool:
        """Whether each message is, letter by letter, the text with sorted keys of an event that has a receipt: then nothing is left to check or apply.

        Its hash is that of the receipt, so it needn't be parsed as a whole; other messages are, and give the same result.
        """
        if not exists(self.spark, f"{self.folder}/receipts"):
            return False
        field = lambda name: F.get_json_object("value", f"$.{name}")
        keyed = F.col("key").cast("string").eqNullSafe(field("account")) if "key" in batch.columns else F.lit(True)
        told = batch.select(F.lit("event").alias("kind"), F.when(keyed, field("event_id")).alias("key"), F.unhex(F.sha2("value", 256)).alias("content"))
        receipts = self.receipts().where((F.col("epoch") < epoch) & (F.col("kind") == "event")).withColumn("content", F.unhex("content"))
        # Most batches are new, and then any message tells: the first is looked for in its own folder before all are.
        for first in told.withColumn("bucket", bucket("kind", "key")).take(1):
            if first["key"] is None or receipts.where((F.col("bucket") == first["bucket"]) & (F.col("key") == first["key"]) & (F.col("content") == F.lit(bytes(first["content"])))).isEmpty():
                return False
        near = receipts.where(F.col("bucket").isin(buckets_of(told, "kind", "key")))
        # The hash is that of the whole text, so where it is the same, the identifier is.
        return told.join(near.select("content"), (told["content"] == near["content"]) & told["key"].isNotNull(), "left_anti").isEmpty()

    def _apply(self, events: DataFrame, epoch: int) -> None:
        claim = lambda kind, key, content: F.struct(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.col(content).alias("content"))
        claims = events.select(F.explode(F.array(claim("event", "event_id", "payload_hash"), claim("ledger", "ledger_id", "source_hash"))).alias("c")).select("c.*").repartition("kind", "key").distinct().persist()
        with ExitStack() as cleanup:
            cleanup.callback(claims.unpersist)
            near = self.receipts().where(F.col("bucket").isin(buckets_of(claims, "kind", "key")) & (F.col("epoch") < epoch)).select("kind", "key", F.col("content").alias("was"))
            earlier = claims.join(near, ["kind", "key"]).select("kind", "key", (F.col("was") != F.col("content")).alias("clash")).persist()
            cleanup.callback(earlier.unpersist)
            within = claims.groupBy("kind", "key").agg((F.count("*") > 1).alias("clash"))  # contents are distinct
            bad = within.unionByName(earlier).where("clash").agg(F.min(F.struct("kind", "key")).alias("c")).first()["c"]
            if bad:
                raise InvalidEvent(f"{bad['kind']} {bad['key']} came again with other content")
            fields = [f.split()[0] for f in APPLIED.replace("decimal(20,2)", "decimal").split(", ")]
            known = earlier.where("kind = 'ledger'").select(F.col("key").cast("long").alias("ledger_id"))
            # Nothing known and as many events as ledger rows, as a rule: then there is nothing to choose from, and nothing to sort.
            if earlier.isEmpty() and events.count() == claims.where("kind = 'ledger'").count():
                new = events.select(*fields)
            else:
                new = events.groupBy("ledger_id").agg(F.min(F.struct(*fields)).alias("e")).select("e.*").join(known, "ledger_id", "left_anti").select(*fields).persist()
                cleanup.callback(new.unpersist)
            self._write("applied", new, epoch, *GROUP)
            self._project(new, epoch)
            # Receipts come last: a batch that has them is done.
            self._write("receipts", claims, epoch, "kind", "key")

    def _project(self, new: DataFrame, epoch: int) -> None:
        if self.consumer == "summary":
            # Sums of the epoch's own rows; readers add epochs up.
            self._write("result", monthly_summary(new), epoch, "account", "month")
            return
        # All rows of the groups that changed; readers take a group's last epoch. Further rows never take a group's last cluster away, so groups without one need no row.
        changed = new.select(*GROUP).distinct()
        before = self.applied(epoch).where(F.col("bucket").isin(buckets_of(changed, *GROUP))).join(changed, GROUP, "left_semi")
        rows = new.unionByName(before.select(*new.columns))
        found = account_duplicates(rows).withColumn("id", F.sha2(F.to_json(F.struct(*GROUP, "txn_ids", "dates")), 256))
        self._write("result", found.select(*(f.split()[0] for f in FINDINGS.replace("decimal(20,2)", "decimal").split(", "))), epoch, *GROUP)

    def _current(self) -> DataFrame:
        schema = SUMMARY if self.consumer == "summary" else FINDINGS
        mark = read_mark(self.spark, f"{self.folder}/compacted")
        rows = self._read("result", schema)
        if mark is None:
            return rows.drop("bucket")
        name, upto = mark.split()
        together = self.spark.read.schema(f"{schema}, epoch bigint").parquet(f"{self.folder}/{name}")
        return rows.where(F.col("epoch") > int(upto)).drop("bucket").unionByName(together)

    def _latest(self) -> DataFrame:
        rows = self._current()
        if self.consumer == "summary":
            money = [F.sum(c).cast(MONEY).alias(c) for c in ("gross_expense", "credits", "net_expense")]
            return rows.groupBy("account", "month").agg(*money, F.sum("transaction_count").alias("transaction_count"))
        last = rows.groupBy(*GROUP).agg(F.max("epoch").alias("epoch"))
        return rows.join(last, [*GROUP, "epoch"], "left_semi").where(F.col("id").isNotNull()).drop("epoch")

    def result(self) -> DataFrame:
        return self._latest()

    def compact(self) -> None:
        """Put the results so far into one table. Run between micro-batches; readers see either state."""
        last = self._current().agg(F.max("epoch")).first()[0]
        if last is None:
            return
        name = f"compacted-{uuid.uuid4().hex}"
        self._latest().withColumn("epoch", F.lit(last).cast("long")).write.parquet(f"{self.folder}/{name}")
        write_mark(self.spark, f"{self.folder}/compacted", f"{name} {last}")


def run_projection(messages: DataFrame, projection: Projection, checkpoint: str, available_now: bool = True):
    """Start the streaming query of one consumer; ``messages`` has a JSON ``value``."""
    apply: Callable[[DataFrame, int], None] = projection.process
    writer = messages.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).queryName(f"{projection.consumer}-{abs(hash(checkpoint))}")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def kafka_messages(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The committed events of a topic; needs the Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    source = reader.option("startingOffsets", "earliest").option("kafka.isolation.level", "read_committed").load()
    return source.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "partition", "offset")


def to_kafka(events: DataFrame, servers: str, topic: str, checkpoint: str):
    """Publish (key, value) at least once."""
    return events.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()
