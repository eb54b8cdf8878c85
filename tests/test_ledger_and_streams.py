from __future__ import annotations

import json
from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from quillspark.errors import IngestError, InvalidEvent, LedgerConflict, QueryError
from quillspark.operators import ledger as L
from quillspark.operators.ledger import LedgerStore, category_state, classified, content_hash, monthly_summary, with_overrides
from quillspark.streaming import projections as P
from quillspark.streaming.projections import CONSUMERS, Projection, event_of, run_projection, validated


def rows(bill, *ids, amount="1.00", category=None, account="card"):
    return bill([(i, date(2026, 1, 1), "STARBUCKS #1", amount, account, category) for i in ids])


def test_import_is_idempotent_at_both_levels(spark, bill, tmp_path):
    store = LedgerStore(spark, str(tmp_path))
    first = rows(bill, "a", "b").unionByName(rows(bill, "a", account="credit"))
    one = store.import_rows(first, "one.csv", content_hash(b"1"))
    assert (one.imported, one.skipped, one.repeated_file) == (3, 0, False)
    again = store.import_rows(first, "copy.csv", content_hash(b"1"))
    assert again.repeated_file and again.batch_id == one.batch_id and (again.imported, again.skipped) == (0, 3)
    two = store.import_rows(rows(bill, "a", "new"), "two.csv", content_hash(b"2"))
    assert (two.imported, two.skipped) == (1, 1)
    assert store.rows().count() == 4 and store.batches().count() == 2


def test_changed_row_refuses_the_batch(spark, bill, tmp_path):
    store = LedgerStore(spark, str(tmp_path))
    store.import_rows(rows(bill, "a"), "one.csv")
    with pytest.raises(LedgerConflict):
        store.import_rows(rows(bill, "a", amount="2.00").unionByName(rows(bill, "z")), "two.csv")
    with pytest.raises(LedgerConflict):
        store.import_rows(rows(bill, "x", category="nope"), "three.csv")
    assert store.rows().count() == 1


def test_rows_of_an_unlisted_batch_do_not_count(spark, bill, tmp_path):
    store = LedgerStore(spark, str(tmp_path))
    store.import_rows(rows(bill, "a"), "one.csv")
    store.rows().withColumn("batch_id", F.lit("torn")).withColumn("bucket", F.lit(1)).write.mode("append").partitionBy("bucket").parquet(f"{tmp_path}/rows")
    assert store.rows().count() == 1


def test_repeats_within_a_batch(bill):
    batch = bill([("a", date(2026, 1, 1), "X", "1.00", "c", None), ("a", date(2026, 1, 1), "X", "1.00", "c", "咖啡"), ("b", date(2026, 1, 1), "X", "1.00", "c", None), ("b", date(2026, 1, 2), "X", "1.00", "c", None)])
    states = [(r["txn_id"], r["state"]) for r in classified(batch.limit(0), batch).orderBy("seq").collect()]
    assert states == [("a", "new"), ("a", "repeated"), ("b", "new"), ("b", "conflict")]


def test_import_without_hash_and_with_categories(spark, bill, tmp_path):
    store = LedgerStore(spark, str(tmp_path))
    batch = rows(bill, "a", "b")
    one = store.import_rows(batch, "memory")
    again = store.import_rows(batch, "memory")
    assert again.repeated_file and again.batch_id == one.batch_id and (again.imported, again.skipped) == (0, 2)
    assert not store.import_rows(rows(bill, "a", "c"), "memory").repeated_file
    with pytest.raises(IngestError):
        store.import_file(rows(bill, "x", "y"), "f.csv", b"f", rows(bill, "x", "z", category="咖啡"))
    assert store.import_file(rows(bill, "x", "y"), "f.csv", b"f", rows(bill, "x", "y", category="咖啡")).imported == 2
    assert {r["txn_id"]: r["category"] for r in store.rows().collect()} == {"a": None, "b": None, "c": None, "x": "咖啡", "y": "咖啡"}
    assert len({r["seq"] for r in store.rows().collect()}) == 5


def test_an_import_reads_only_the_folders_of_its_rows(spark, bill, tmp_path):
    store = LedgerStore(spark, str(tmp_path))
    store.import_rows(rows(bill, *map(str, range(200))), "one.csv")
    wanted = rows(bill, "7").select(L.row_bucket().alias("b")).first()["b"]
    for folder in (tmp_path / "rows").glob("bucket=*"):
        if folder.name != f"bucket={wanted}":
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"unreadable")
    assert store.import_rows(rows(bill, "7"), "two.csv").skipped == 1


def test_corrections_are_versioned(spark, bill, tmp_path):
    store = LedgerStore(spark, str(tmp_path))
    store.import_rows(rows(bill, "a", category="咖啡"), "one.csv")
    first = store.correct_category("Starbucks #9", "购物", 0, "r1")
    assert (first.before_category, first.category, first.before_version, first.version, first.changed) == ("咖啡", "购物", 0, 1, True)
    assert store.correct_category("Starbucks #9", "购物", 0, "r1") == first  # the same request
    same = store.correct_category("STARBUCKS", "购物", 1, "r2")
    assert (same.version, same.changed) == (1, False) and store.correct_category("STARBUCKS", "购物").version == 1
    for wrong, error in (
        (("STARBUCKS", "旅行", 0, "r3"), LedgerConflict), (("STARBUCKS", "旅行", 1, "r1"), LedgerConflict), (("STARBUCKS", "旅行", 1, "r2"), LedgerConflict),
        (("nobody", "旅行", 0, "r4"), QueryError), (("STARBUCKS", "nope", 1, "r5"), QueryError), (("STARBUCKS", "旅行", -1, "r6"), QueryError), (("STARBUCKS", "旅行", 1, " "), QueryError),
    ):
        with pytest.raises(error):
            store.correct_category(*wrong)
    assert store.transactions().first()["category"] == "购物"
    assert {(r["request_id"], r["changed"], r["version"]) for r in store.audits().collect()} == {("r1", True, 1), ("r2", False, 1)}


def test_of_two_corrections_at_once_one_counts(spark, bill, tmp_path):
    store = LedgerStore(spark, str(tmp_path))
    store.import_rows(rows(bill, "a", category="咖啡"), "one.csv")
    late = LedgerStore(spark, str(tmp_path))
    seen = late.category_of
    stale = [seen("starbucks")]
    store.correct_category("starbucks", "购物", 0, "r1")
    late.category_of = lambda key: stale.pop() if stale else seen(key)  # what it saw before the other was done
    with pytest.raises(LedgerConflict):
        late.correct_category("starbucks", "旅行", 0, "r2")
    assert store.correct_category("starbucks", "旅行", 1, "r3").version == 2


def test_overrides_and_state(spark):
    stored = spark.createDataFrame([("x", "咖啡", "2026-01-02", 2), ("x", "购物", "2026-01-01", 1), (None, "其他", "2026-01-01", 3)], "merchant_key string, category string, date string, seq long")
    changes = spark.createDataFrame([("x", "旅行", 1), ("x", "娱乐", 2), ("y", "超市", 1)], "merchant_key string, category string, version long")
    # The first row is the one with the smallest number, whatever its date.
    assert {(r["merchant_key"], r["category"]) for r in with_overrides(stored, changes).collect()} == {("x", "娱乐"), (None, "其他")}
    assert {(r["merchant_key"], r["category"], r["version"]) for r in category_state(stored, changes).collect()} == {("x", "娱乐", 2), ("y", "超市", 1), (None, "其他", 0)}
    assert ("x", "购物", 0) in {(r["merchant_key"], r["category"], r["version"]) for r in category_state(stored, changes.limit(0)).collect()}


def event(i, amount="1.00", day="2026-10-01", account="card", merchant="TARGET #1", event_id=None, **more):
    transaction = {"id": i, "txn_id": f"txn-{i}", "date": day, "merchant": merchant, "merchant_key": "target", "amount": amount, "category": None, "batch_id": "b"}
    return {"event_id": event_id or f"{i:032x}", "event_type": "ledger.transaction_imported.v1", "schema_version": 1, "account": account, "occurred_at": 1.5, "transaction": transaction, **more}


def messages(spark, *events):
    return spark.createDataFrame([(e if isinstance(e, str) else json.dumps(e),) for e in events], "value string")


def test_monthly_summary_and_redelivery(spark, tmp_path):
    projection = Projection(spark, str(tmp_path), "summary")
    events = [event(i, a) for i, a in enumerate(("0.10", "0.20", "-0.01", "0.00"), 1)]
    projection.process(messages(spark, *events, *events), 0)
    projection.process(messages(spark, *events, event(1, "0.10", event_id="f" * 32)), 1)  # again, and under another id
    row = projection.result().first()
    assert (row["gross_expense"], row["credits"], row["net_expense"], row["transaction_count"]) == (D("0.30"), D("0.01"), D("0.29"), 4)


def test_replayed_epoch_has_no_second_effect(spark, tmp_path):
    projection = Projection(spark, str(tmp_path), "summary")
    for _ in range(2):
        projection.process(messages(spark, event(1)), 0)
    assert projection.result().first()["transaction_count"] == 1


@pytest.mark.parametrize("second", [event(1, "2.00"), event(1, "2.00", event_id="f" * 32)])
def test_contradictions_stop_the_stream(spark, tmp_path, second):
    projection = Projection(spark, str(tmp_path), "summary")
    projection.process(messages(spark, event(1)), 0)
    with pytest.raises(InvalidEvent):
        projection.process(messages(spark, event(5), second), 1)
    assert projection.result().first()["transaction_count"] == 1


def test_late_event_joins_a_cluster(spark, tmp_path):
    projection = Projection(spark, str(tmp_path), "anomalies")
    projection.process(messages(spark, event(1, "10.00", "2026-10-01"), event(2, "10.00", "2026-10-07")), 0)
    assert projection.result().count() == 0
    projection.process(messages(spark, event(3, "10.00", "2026-10-04"), event(4, "10.00", "2026-10-04", account="other")), 1)
    assert [r["txn_ids"] for r in projection.result().collect()] == [["txn-1", "txn-3", "txn-2"]]


@pytest.mark.parametrize(
    "value,error",
    [
        ("not json", "json"), (event(1, event_id="X"), "event_id"), (event(1, event_type="other"), "event_type"), (event(1, schema_version=2), "schema_version"), (event(1, occurred_at=-1), "occurred_at"),
        (event(1, account=" "), "account"), (event(0), "transaction.id"), (event(1, day="2026-1-05"), "transaction.date"), (event(1, day="2026-02-30"), "transaction.date"), (event(1, "1.005"), "transaction.amount"),
        (event(1, "NaN"), "transaction.amount"), (event(1, "100000000000000000"), "transaction.amount"), (event(1, merchant="OTHER"), "transaction.merchant_key"), (event(1), None), (event(1, "1e2"), None),
    ],
)
def test_validation(spark, value, error):
    assert validated(messages(spark, value)).first()["error"] == error


def test_keys_and_places_of_messages(spark, tmp_path):
    rows = [("card", event(1), 0, 5), ("other", event(2), 0, 6), ("card", event(3), 0, 7), ("card", event(4), 1, 1)]
    batch = spark.createDataFrame([(k, json.dumps(e), *place) for k, e, *place in rows], "key string, value string, partition int, offset long")
    assert [r["error"] for r in validated(batch).orderBy("partition", "offset").collect()] == [None, "key", None, None]
    projection = Projection(spark, str(tmp_path), "summary")
    for _ in range(2):  # the batch is tried again
        with pytest.raises(InvalidEvent):
            projection.process(batch, 0)
        # What came before the bad one in its partition, and the other partition.
        assert projection.result().first()["transaction_count"] == 2


def test_every_event_leaves_receipts_and_batches_read_their_own_folders(spark, tmp_path):
    projection = Projection(spark, str(tmp_path), "summary")
    projection.process(messages(spark, *(event(i) for i in range(1, 40))), 0)
    again = event(7, event_id="f" * 32)
    projection.process(messages(spark, again), 1)
    assert projection.receipts().where("kind = 'event'").count() == 40 and projection.result().agg(F.sum("transaction_count")).first()[0] == 39
    with pytest.raises(InvalidEvent):  # the second identifier is known too
        projection.process(messages(spark, event(9, event_id="f" * 32)), 2)
    wanted = set(P.buckets_of(projection.receipts().where(F.col("key").isin("7", "f" * 32, event(7)["event_id"])), "kind", "key"))
    for folder in (tmp_path / "summary" / "receipts").glob("bucket=*"):
        if int(folder.name[7:]) not in wanted:
            for file in folder.rglob("*.parquet"):
                file.write_bytes(b"unreadable")
    projection.process(messages(spark, again, event(7)), 3)


@pytest.mark.parametrize("consumer", CONSUMERS)
def test_compacted_results_are_the_same(spark, tmp_path, consumer):
    projection = Projection(spark, str(tmp_path), consumer)
    projection.compact()
    for epoch in range(3):
        projection.process(messages(spark, event(2 * epoch + 1, "10.00"), event(2 * epoch + 2, "10.00")), epoch)
        if epoch == 1:
            projection.compact()
    before = sorted(map(str, projection.result().collect()))
    projection.compact()
    assert before and sorted(map(str, projection.result().collect())) == before


def test_backfill_gives_each_row_one_event(spark, bill):
    stored = bill([(str(i), date(2026, 1, 1 + i), "TARGET #1", "5.00", "card", None) for i in range(4)]).withColumn("id", F.col("seq") + 1).withColumn("merchant_key", F.lit("target")).withColumn("batch_id", F.when(F.col("seq") < 3, "b").otherwise("unlisted"))
    batches = spark.createDataFrame([("b", "2026-02-01 00:00:00.5")], "id string, at string").select("id", F.col("at").cast("timestamp_ntz").alias("created_at"))
    published = spark.createDataFrame([(2,), (None,), (2,)], "ledger_id long")
    rows = validated(P.backfill(stored, batches, published)).collect()
    assert sorted(r["ledger_id"] for r in rows) == [1, 3] and all(r["error"] is None for r in rows)
    assert json.loads(P.backfill(stored, batches, published).first()["value"])["occurred_at"] == 1769904000.5
    known = published.unionByName(spark.createDataFrame([(1,), (3,)], "ledger_id long"))
    assert P.backfill(stored, batches, known).count() == 0


def test_two_streams_over_files(spark, tmp_path, bill):
    stored = bill([(str(i), date(2026, 1, 1 + i), "TARGET #1", "5.00", "card", None) for i in range(6)]).withColumn("id", F.col("seq") + 1).withColumn("merchant_key", F.lit("target")).withColumn("batch_id", F.lit("b"))
    event_of(stored).select("value").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = {}
    for consumer in CONSUMERS:
        projection = Projection(spark, f"{tmp_path}/state", consumer)
        run_projection(stream, projection, f"{tmp_path}/checkpoint-{consumer}").awaitTermination()
        found[consumer] = projection.result().collect()
    assert found["summary"][0]["transaction_count"] == 6 and found["anomalies"][0]["times"] == 6
    assert monthly_summary(stored.limit(0)).count() == 0


def test_groups_without_a_cluster_leave_no_results(spark, tmp_path):
    projection = Projection(spark, str(tmp_path), "anomalies")
    projection.process(messages(spark, *(event(i, f"{i}.00") for i in range(1, 6)), event(6, "5.00")), 0)
    projection.process(messages(spark, event(7, "4.00", "2026-10-02"), event(8, "5.00"), event(9, "9.00")), 1)
    assert projection._read("result", P.FINDINGS).count() == 3  # the cluster of 5.00 in both epochs, that of 4.00 in the second
    assert sorted((r["amount"], r["times"]) for r in projection.result().collect()) == [(D("4.00"), 2), (D("5.00"), 3)]


def test_known_texts_are_not_read_again(spark, tmp_path, monkeypatch):
    txns = spark.createDataFrame([(i, f"t{i}", "card", date(2026, 10, i), "TARGET #1 \"é\\", "target \"é\\", D("1.10"), None, "b") for i in (1, 2)], "id long, txn_id string, account string, date date, merchant string, merchant_key string, amount decimal(20,2), category string, batch_id string")
    batch = event_of(txns)
    projection = Projection(spark, str(tmp_path), "summary")
    projection.process(batch, 0)
    with pytest.raises(InvalidEvent):  # a wrong key is still found
        projection.process(batch.withColumn("key", F.lit("other")), 1)
    spaced = batch.withColumn("value", F.concat("value", F.lit(" ")))
    projection.process(spaced, 1)  # another text of the same events
    with monkeypatch.context() as patched:
        patched.setattr(P, "validated", None)
        projection.process(batch, 2)
        with pytest.raises(TypeError):
            projection.process(spaced, 3)
    assert projection.result().first()["transaction_count"] == 2


def test_a_new_batch_reads_the_folder_of_one_message(spark, tmp_path):
    projection = Projection(spark, str(tmp_path), "summary")
    projection.process(messages(spark, *(event(i) for i in range(1, 60))), 0)
    new = messages(spark, *(event(i) for i in range(100, 160)))
    first = new.limit(1).select(F.lit("event").alias("kind"), F.get_json_object("value", "$.event_id").alias("key"))
    (wanted,) = P.buckets_of(first, "kind", "key")
    for folder in (tmp_path / "summary" / "receipts").glob("bucket=*"):
        if int(folder.name[7:]) != wanted:
            for file in folder.rglob("*.parquet"):
                file.write_bytes(b"unreadable")
    assert not projection._known(new, 1)


def test_sorted_text_is_that_of_a_whole_reading(spark):
    canonical = lambda e, **more: json.dumps(e, sort_keys=True, separators=(",", ":"), **more)
    whole = canonical(event(1, merchant="CAFÉ 咖啡 😀 ~/"), ensure_ascii=False).replace('"occurred_at":1.5', '"occurred_at":1.7589E9')
    texts = [canonical(event(1)), json.dumps(event(1)), canonical(event(1, merchant='A "B" \\ \n')), canonical(event(1, merchant="é"), ensure_ascii=True), canonical(event(1, extra=1)), "{}", "x", "[1]", ""]
    swaps = [("E9", v) for v in ("E9", "E7", "E300", "E09", "E+9", "e9")] + [("1.7589E9", v) for v in ("1758900000", "1758900000.0", "17589000.50", "1.0", "0.001", "-0.0", '"1.7589E9"', "null")]
    swaps += [('"id":1', v) for v in ('"id":01', '"id":1.0', '"id":-0', '"id":"1"', '"id":9223372036854775807')] + [("}}", v) for v in ("}} ", "}}}", "}}{}", '},"x":1}')] + [("{", "{ "), ("~", "\\u007e"), ("/", "\\/"), ("~", "\u2028")]
    rows = spark.createDataFrame([(t,) for t in (*texts, *(whole.replace(a, b, 1) for a, b in swaps))], "value string").withColumn("e", F.from_json("value", P.ENVELOPE))
    # A second column keeps the optimizer from folding the two into one.
    for r in rows.select("value", P.sorted_text().alias("found"), F.to_json(F.try_parse_json("value")).alias("text")).collect():
        assert r["found"] == r["text"], r["value"]
