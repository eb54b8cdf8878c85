"""The durable ledger: idempotent imports, category corrections, monthly summaries.

Files of a batch are written first and count only once the batch is listed in
the ``batches`` table, so a failed import leaves nothing behind. There is one
importer at a time; Spark is no transaction system. Rows lie in folders by the
hash of (account, txn_id), and an import reads the folders of its own rows only.

A correction is one small file, created only if there is none for that merchant
and version yet: of two corrections at once one is refused. These files are the
audit log, and the overrides are read from them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IngestError, LedgerConflict, QueryError
from ..functions.columns import known_category, normalized_merchant, year_month
from ..schema import CATEGORIES, LARGEST_AMOUNT, LIMITS, MONEY
from ..storage import exists, write_mark

SOURCE = ["date", "merchant", "amount"]
BATCHES = "id string, source_name string, content_hash string, imported_rows long, skipped_rows long, last_seq long, created_at timestamp"
ROWS = "txn_id string, date date, merchant string, merchant_key string, amount decimal(20,2), account string, category string, seq long, batch_id string"
AUDITS = "merchant_key string, before_category string, category string, before_version long, version long, changed boolean, request_id string, created_at timestamp"
#: Folders that stored rows are laid out in.
BUCKETS = 64
#: How often a correction is tried while others change the same merchant.
TRIES = 3


def row_error(amount: str = "amount") -> Column:
    """Why a row can't be stored; null if it can."""
    text = lambda c: F.col(c).isNull() | (F.trim(c) == "") | (F.char_length(c) > LIMITS[c])
    wrong = F.lit(None).cast("string")
    for c in ("merchant", "txn_id", "account"):
        wrong = F.when(text(c), F.lit(c)).otherwise(wrong)
    exact = F.col(amount).cast("decimal(30,6)")  # types that compare without losing digits
    return F.coalesce(wrong, F.when(exact.isNull() | (exact != exact.cast("decimal(26,2)")) | (F.abs(exact) >= F.lit(LARGEST_AMOUNT).cast("decimal(26,2)")), F.lit("amount")).when(
        F.col("category").isNotNull() & ~known_category(F.col("category")), F.lit("category")
    ))


def classified(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Each incoming row with ``state``: new, repeated (an earlier row agrees) or conflict (one differs).

    Rows are known by (account, txn_id); the earlier row is a stored one or the
    first of the batch. The category is no part of what must agree. Of the
    stored rows only those that the batch names are grouped.
    """
    key = ["account", "txn_id"]
    named = lambda rows, which: rows.select(*key, F.struct(F.lit(which).alias("which"), F.col("seq").alias("seq"), *SOURCE).alias("row"))
    met = named(stored, 0).join(incoming.select(*key).distinct(), key, "left_semi")
    first = met.unionByName(named(incoming, 1)).groupBy(*key).agg(F.min("row").alias("first"))
    joined = incoming.join(first, key)
    differs = F.lit(False)
    for c in SOURCE:
        differs |= ~F.col(f"first.{c}").eqNullSafe(F.col(c))
    own = (F.col("first.which") == 1) & (F.col("first.seq") == F.col("seq"))
    return joined.withColumn("state", F.when(differs, "conflict").when(own, "new").otherwise("repeated")).drop("first")


def with_overrides(stored: DataFrame, overrides: DataFrame) -> DataFrame:
    """Stored rows with the current category of their merchant key, an override before the row's own."""
    current = overrides.groupBy("merchant_key").agg(F.max_by("category", "version").alias("override"))
    return stored.join(current, "merchant_key", "left").withColumn("category", F.coalesce("override", "category")).drop("override")


def category_state(stored: DataFrame, overrides: DataFrame) -> DataFrame:
    """(merchant_key, category, version): the last override, else the first row's category at version 0."""
    own = stored.groupBy("merchant_key").agg(F.min_by("category", "seq").alias("own"))
    current = overrides.groupBy("merchant_key").agg(F.max_by("category", "version").alias("override"), F.max("version").alias("version"))
    return own.join(current, "merchant_key", "full").select("merchant_key", F.coalesce("override", "own").alias("category"), F.coalesce("version", F.lit(0)).alias("version"))


def monthly_summary(txns: DataFrame) -> DataFrame:
    """(account, month, gross_expense, credits, net_expense, transaction_count)."""
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast(MONEY)
    a, zero = F.col("amount"), F.lit(0).cast(MONEY)
    return txns.groupBy("account", year_month(F.col("date")).alias("month")).agg(
        total(F.greatest(a, zero)).alias("gross_expense"), total(F.greatest(-a, zero)).alias("credits"), total(a).alias("net_expense"), F.count("*").alias("transaction_count")
    )


def payload_hash(rows: DataFrame) -> str:
    """A hash of what the rows of a batch say, in their order, for a batch that comes without a file."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("account", "txn_id", "date", "merchant", "amount", "category", "seq")]
    row = F.sha2(F.concat_ws("\x1f", *fields), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)"))
    totals = rows.agg(F.count("*"), *(part(i).alias(f"p{i}") for i in range(4))).first()
    return content_hash("-".join(map(str, totals)).encode())


def content_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def row_bucket() -> Column:
    return F.pmod(F.xxhash64("account", "txn_id"), F.lit(BUCKETS)).cast("int")


def retagged(source: DataFrame, tagged: DataFrame) -> DataFrame:
    """The categorized rows of a file, if they are the file's rows and differ in category only."""
    fields = ["seq", "account", "txn_id", *SOURCE]
    ours, theirs = source.select(*fields), tagged.select(*fields)
    if not ours.exceptAll(theirs).isEmpty() or not theirs.exceptAll(ours).isEmpty():
        raise IngestError("categorized rows must be those of the file, in its order")
    return tagged


@dataclass(frozen=True)
class ImportResult:
    batch_id: str
    imported: int
    skipped: int
    repeated_file: bool


@dataclass(frozen=True)
class Correction:
    merchant: str
    before_category: str | None
    category: str
    before_version: int
    version: int
    changed: bool
    request_id: str | None


class LedgerStore:
    """A ledger in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        there = exists(self.spark, f"{self.folder}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def batches(self) -> DataFrame:
        return self._table("batches", BATCHES)

    def audits(self) -> DataFrame:
        """Every correction that was made, and the repeatable answers to those that changed nothing."""
        folder = f"{self.folder}/corrections"
        return self.spark.read.schema(AUDITS).json(folder) if exists(self.spark, folder) else self.spark.createDataFrame([], AUDITS)

    def overrides(self) -> DataFrame:
        return self.audits().where("changed").select("merchant_key", "category", "version")

    def rows(self) -> DataFrame:
        """The rows of listed batches, as stored."""
        return self._table("rows", f"{ROWS}, bucket int").drop("bucket").join(self.batches().select(F.col("id").alias("batch_id")), "batch_id", "left_semi")

    def _rows_near(self, incoming: DataFrame) -> DataFrame:
        """The listed rows in the folders that the rows of a batch fall into."""
        wanted = [r[0] for r in incoming.select(row_bucket()).distinct().collect()]  # at most BUCKETS
        near = self._table("rows", f"{ROWS}, bucket int").where(F.col("bucket").isin(wanted)).drop("bucket")
        return near.join(self.batches().select(F.col("id").alias("batch_id")), "batch_id", "left_semi")

    def transactions(self) -> DataFrame:
        return with_overrides(self.rows(), self.overrides()).orderBy("date", "seq")

    def import_file(self, rows: DataFrame, source_name: str, data: bytes, tagged: DataFrame | None = None) -> ImportResult:
        """Import the rows read from a file, or the same rows with categories; the file's bytes are its identity."""
        return self.import_rows(rows if tagged is None else retagged(rows, tagged), source_name, content_hash(data))

    def import_rows(self, incoming: DataFrame, source_name: str, content_hash: str | None = None) -> ImportResult:
        """Add the new rows of a batch. The same file again changes nothing; a changed row refuses the whole batch.

        Without a hash the rows' own content is the identity of the batch.
        """
        wrong = incoming.withColumn("error", row_error()).where(F.col("error").isNotNull()).first()
        if wrong:
            raise LedgerConflict(f"row {wrong['txn_id']!r} can't be stored: {wrong['error']}")
        identity = content_hash or payload_hash(incoming)
        earlier = self.batches().where(F.col("content_hash") == identity).first()
        if earlier:
            return ImportResult(earlier["id"], 0, incoming.count(), True)
        states = classified(self._rows_near(incoming), incoming).persist()
        try:
            counts = {r["state"]: r["n"] for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}
            if counts.get("conflict"):
                clash = states.where(F.col("state") == "conflict").first()
                raise LedgerConflict(f"{clash['account']}/{clash['txn_id']} was imported with other content; nothing of {source_name} was written")
            batch = uuid.uuid4().hex
            last = self.batches().agg(F.coalesce(F.max("last_seq"), F.lit(-1))).first()[0]
            new = states.where(F.col("state") == "new").withColumn("merchant_key", normalized_merchant(F.col("merchant"))).withColumn("batch_id", F.lit(batch))
            fields = [f.split()[0] for f in ROWS.replace("decimal(20,2)", "decimal").split(", ")]
            laid = new.withColumn("seq", F.col("seq") + F.lit(last + 1)).select(*fields, row_bucket().alias("bucket")).hint("rebalance", "bucket")
            laid.write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/rows")
            last = states.agg(F.coalesce(F.max("seq") + F.lit(last + 1), F.lit(last))).first()[0]
        finally:
            states.unpersist()
        result = ImportResult(batch, counts.get("new", 0), counts.get("repeated", 0), False)
        listed = [(batch, source_name, identity, result.imported, result.skipped, last, datetime.now(timezone.utc).replace(tzinfo=None))]
        self.spark.createDataFrame(listed, BATCHES).write.mode("append").parquet(f"{self.folder}/batches")
        return result

    def category_of(self, key: str) -> tuple[str | None, int] | None:
        """(category, version) of a merchant key; None for a merchant without transactions."""
        state = category_state(self.rows().where(F.col("merchant_key") == key), self.overrides().where(F.col("merchant_key") == key)).first()
        return (state["category"], state["version"]) if state else None

    def correct_category(self, merchant: str, category: str, expected_version: int | None = None, request_id: str | None = None) -> Correction:
        """Set a merchant's category.

        A request that was made before gets its answer again, if it is the same
        request. Without an expected version the current one is taken. A category
        that is the current one changes nothing, but a request is remembered.
        """
        if category not in CATEGORIES:
            raise QueryError(f"unknown category {category}; known are {CATEGORIES}")
        if expected_version is not None and (isinstance(expected_version, bool) or expected_version < 0):
            raise QueryError("a version is a number from 0")
        if request_id is not None and not (request_id.strip() and len(request_id) <= 128):
            raise QueryError("a request is named by 1 to 128 characters")
        key = self.spark.range(1).select(normalized_merchant(F.lit(merchant)).alias("k")).first()["k"]
        for _ in range(TRIES):
            done = self.audits().where(F.col("request_id") == request_id).first() if request_id is not None else None
            if done:
                if (done["merchant_key"], done["category"]) != (key, category):
                    raise LedgerConflict("this request was used for another correction")
                return Correction(key, done["before_category"], category, done["before_version"], done["version"], done["changed"], request_id)
            known = self.category_of(key)
            if known is None:
                raise QueryError(f"unknown merchant {key}")
            before, version = known
            if expected_version is not None and version != expected_version:
                raise LedgerConflict(f"{key} is at version {version}, not {expected_version}")
            changed = before != category
            made = Correction(key, before, category, version, version + changed, changed, request_id)
            if not changed and request_id is None:
                return made
            name = f"{hash_of(key)}-{made.version}" if changed else f"same-{hash_of(request_id)}"
            audit = {
                "merchant_key": key, "before_category": before, "category": category, "before_version": version, "version": made.version, "changed": changed,
                "request_id": request_id, "created_at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ"),
            }
            if write_mark(self.spark, f"{self.folder}/corrections/{name}.json", json.dumps(audit, ensure_ascii=False), replace=False):
                return made
        raise LedgerConflict(f"{key} is being corrected by others; try again")


def hash_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:32]
