from __future__ import annotations

import json
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quillspark.errors import QueryError
from quillspark.operators import metrics as M
from quillspark.operators import traps
from quillspark.operators.messages import canonical_json, canonical_sha256, conflicting_deliveries, deliver_once, identifier, repeated_deliveries

DELIVERIES = "delivery_id long, event_id string, ledger_id long, payload string, payload_hash string, account string, event string"
RECEIPTS = "consumer string, event_id string, payload_hash string"


def test_retrieval_metrics(spark):
    evidence = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1)], "case_id long, evidence_id long")
    matched = spark.createDataFrame([(1, 1, 5), (2, 1, 10), (3, 1, 11)], "case_id long, evidence_id long, rank int")
    rows = {r["case_id"]: r for r in M.retrieval_metrics(evidence, matched).collect()}
    assert (rows[1]["evidence_recall_5"], rows[1]["hit_5"], rows[1]["hit_3"]) == (0.5, 1.0, 0.0)
    assert (rows[2]["mrr_10"], rows[3]["mrr_10"], rows[3]["candidate_recall_20"]) == (0.1, 0.0, 1.0)


def test_review_guards(spark):
    rows = spark.createDataFrame([("a", 1, "g", 0.5), ("a", 1, "g", None)], "id string, trial int, review_group string, s double")
    with pytest.raises(QueryError):
        M.review_summary(rows, ("s",))
    with pytest.raises(QueryError):
        M.review_summary(spark.createDataFrame([("a", 1, "g", 1.5)], rows.schema), ("s",))
    assert M.review_summary(rows.limit(0), ("s",)).count() == 0


def test_p95_and_vectors(spark):
    values = spark.createDataFrame([("a", v) for v in range(1, 41)] + [("b", 7)], "g string, v int")
    assert {r["g"]: r["p95"] for r in M.p95(values, "g", "v").collect()} == {"a": 39, "b": 7}
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [float("nan"), 1.0]), (5, None)], "vec_id long, embedding array<double>")
    assert sorted(r["vec_id"] for r in M.bad_vectors(vectors, 2).collect()) == [2, 3, 4, 5]


# --- one copy of each message -----------------------------------------------------------------------------------------


def envelope(event: str, ledger: int, amount: str = "1.00") -> dict:
    return {"event_id": event, "amount_at": 1.0, "transaction": {"id": ledger, "amount": amount, "category": None}}


def sha(value) -> str:
    import hashlib

    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def expected(rows, receipts):
    """Deliveries one by one, in order."""
    kept: dict[str, set] = {}
    for _, e, h in receipts:
        kept.setdefault(e, set()).add(h)
    first, owner, dropped = {}, {}, set()
    for d, event, ledger, payload, given, *_ in sorted(rows, key=lambda r: r[0]):
        event = event.lower().strip().strip("{}").replace("-", "")
        value = json.loads(payload)
        h, body = given or sha(value), canonical_json(value["transaction"])
        ledger = value["transaction"]["id"]
        if event in kept:
            if h in kept[event]:
                dropped.add(d)
                owner.setdefault(ledger, (event, body))
            continue
        if event in first:
            if first[event] == h:
                dropped.add(d)
            continue
        if ledger in owner and owner[ledger][0] != event:
            if owner[ledger][1] != body:
                first[event] = None
                continue
            dropped.add(d)
        first[event] = h
        owner.setdefault(ledger, (event, body))
    return dropped


@pytest.mark.parametrize("seed", range(4))
def test_equals_one_by_one_processing(spark, seed):
    rng = random.Random(seed)
    rows, receipts = [], []
    for d in range(120):
        event, ledger = f"{rng.randrange(25):032x}", rng.randrange(1, 20)
        value = envelope(event, ledger, rng.choice(["1.00", "1.00", "2.00"]))
        keys = list(value)
        rng.shuffle(keys)
        payload = json.dumps({k: value[k] for k in keys}, indent=rng.choice([None, 1]))
        written = rng.choice([event, event.upper(), "{" + event + "}", f" {event[:8]}-{event[8:]} "])
        rows.append((d, written, rng.choice([ledger, None]), payload, rng.choice([sha(value), None]), "a", "x"))
        if rng.random() < 0.1:
            receipts.append(("summary", event, sha(value)))
    # one receipt for each event, as a consumer would have written it
    receipts = list({e: (c, e, h) for c, e, h in receipts}.values())
    given, kept = spark.createDataFrame(rows, DELIVERIES), spark.createDataFrame(receipts, RECEIPTS)
    found = {r["delivery_id"] for r in repeated_deliveries(given, kept).collect()}
    assert found == expected(rows, receipts)
    stays = deliver_once(given, kept)
    assert stays.columns == given.columns and {r["delivery_id"] for r in stays.collect()} == {r[0] for r in rows} - found
    assert not found & {r["delivery_id"] for r in conflicting_deliveries(given, kept).collect()}


def test_null_and_damaged_messages(spark):
    e, o = "a" * 32, "b" * 32
    v = envelope(e, 1)
    rows = [
        (1, e, None, json.dumps(v), None, None, None), (2, e, 1, None, sha(v), None, None), (2, e, 1, None, sha(v), None, None),  # hash only; and the row again
        (3, o, 1, json.dumps(envelope(o, 1)), None, None, None),  # re-issued
        (4, None, None, None, None, None, None), (5, None, None, "{broken", None, None, None), (6, "c" * 32, None, "{broken", None, None, None), (7, "c" * 32, None, "{broken", None, None, None),
        (8, e, 1, json.dumps(json.dumps(v)), None, None, None),  # a JSON string that holds the JSON
        (9, "d" * 32, 9, "x" * 200_000, None, None, None), (None, e, 1, json.dumps(v), None, None, None),
    ]
    found = [r["delivery_id"] for r in repeated_deliveries(spark.createDataFrame(rows, DELIVERIES), spark.createDataFrame([(None, None, None), ("c", "zz", None)], RECEIPTS)).collect()]
    assert sorted(found) == [2, 3, 7, 8]


def test_empty_and_hot(spark):
    none = spark.createDataFrame([], DELIVERIES)
    receipts = spark.createDataFrame([], RECEIPTS)
    assert repeated_deliveries(none, receipts).count() == 0 and deliver_once(none, receipts).count() == 0
    one = spark.range(5000).select(F.col("id").alias("delivery_id"), F.lit("e" * 32).alias("event_id"), F.lit(1).cast("long").alias("ledger_id"), F.lit('{"transaction":{"id":1}}').alias("payload"), F.lit(None).cast("string").alias("payload_hash"))
    assert repeated_deliveries(one, receipts).count() == 4999


def test_canonical_hash(spark):
    rows = spark.createDataFrame([('{"b":1.0,"a":"é"}',), ('{"a": "\\u00e9", "b": 1.0}',), (None,)], "p string").select(canonical_sha256("p").alias("h")).collect()
    assert rows[0]["h"] == rows[1]["h"] == sha({"a": "é", "b": 1.0}) and rows[2]["h"] is None


# --- the entry module --------------------------------------------------------------------------------------------------


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    names = e.queries()
    assert set(e.oracle_sql()) <= set(names) and len(names) > 80


def test_core_imports_nothing_of_the_optional_package():
    code = "import sys; sys.modules['quillspark.llm'] = None\nimport __spark_entry__ as e\nassert 'p4_found' in e.queries() and 'p7_ids' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0


def test_identifiers_of_other_kinds_stay_whole(spark):
    digits = "0a" * 16
    forms = [digits, digits.upper(), f"{{{digits}}}", f" {digits} ", f"urn:uuid:{digits[:8]}-{digits[8:]}", f"0x{digits}", digits[1:]]
    others = ["a" * 32 + "1111", "a" * 32 + "2222", "zz-ab", "xyab", "ab", ""]
    rows = spark.createDataFrame([(x,) for x in forms + others], "raw string").select("raw", identifier(F.col("raw")).alias("found")).collect()
    assert {bytes(r["found"]) for r in rows[: len(forms)]} == {bytes.fromhex(digits)}
    kept = [r["found"] and bytes(r["found"]) for r in rows[len(forms) :]]
    assert len(set(kept)) == len(others) and kept[-1] is None and kept[4] == bytes.fromhex("ab".rjust(32, "0"))
    deliveries = spark.createDataFrame([(i, x, None, '{"a":1}', None) for i, x in enumerate(others[:4] + ["zz-ab"])], "delivery_id long, event_id string, ledger_id long, payload string, payload_hash string")
    receipts = spark.createDataFrame([], "consumer string, event_id string, payload_hash string")
    assert [r["delivery_id"] for r in repeated_deliveries(deliveries, receipts).collect()] == [4]


def test_percentiles_interpolate(spark):
    values = {"a": [1.0, 5.0, 2.0, 2.0, None], "b": [7.0], "c": [None]}
    rows = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double")
    got = {r["g"]: (r["low"], r["mid"], r["high"]) for r in M.percentiles(rows, "g", "v", {"low": 0.0, "mid": 0.5, "high": 0.95}).collect()}
    assert got == {"a": (1.0, 2.0, pytest.approx(4.55)), "b": (7.0, 7.0, 7.0)}
    assert M.percentiles(rows.limit(0), "g", "v", {"p": 0.5}).count() == 0


def test_small_summaries(spark):
    cases = spark.createDataFrame([("g", 1, 2), ("g", None, None), ("h", 3, 4)], "case_group string, file_rank int, heading_rank int")
    assert {tuple(r) for r in M.rank_summary(cases).collect()} == {("g", 2, 1, 0.5, 0.0, 0.5, 2.0), ("h", 1, 1, 0.0, 0.0, 0.0, 4.0)}
    passages = spark.createDataFrame([("a", "x" * 100), ("b", "x" * 40), ("b", "x" * 40), ("c", None)], "g string, t string")
    assert {(r["g"], r["problem"]) for r in M.context_gate(passages, "g", "t").collect()} == {("a", None), ("b", "short"), ("c", "none")}
    steps = spark.createDataFrame([("t", "abcd", True, False), ("t", "ab", False, True), ("u", None, False, True), ("v", "abc", False, True)], "task_id string, content string, is_call boolean, is_answer boolean")
    assert {tuple(r) for r in M.context_accounting(steps).collect()} == {("t", 1, 6, 2, 4), ("u", 0, 0, 0, 0), ("v", 0, 3, 3, 0)}
    repeated = spark.createDataFrame([("1", "q"), ("2", "q"), ("3", None)], "id string, question string")
    assert [tuple(r) for r in M.repeated_cases(repeated, "id", "question").collect()] == [("question", "q", 2)]


def test_traps_of_a_bill(spark):
    rows = [("s", f"2026-{m:02d}-01", "10.00" if m < 7 else "14.00", "订阅") for m in range(1, 13)] + [("d", "2026-01-05", "30.00", "购物")] * 2 + [("d", "2026-02-05", "-1.00", "购物"), ("w", "2026-01-01", "1.00", "购物"), ("w", "2026-01-02", "3000.00", "购物")]
    bill = spark.createDataFrame([(str(i), d, m, a, c, i) for i, (m, d, a, c) in enumerate(rows)], "txn_id string, date string, merchant string, amount string, category string, seq long").withColumn("amount", F.col("amount").cast("decimal(20,2)"))
    found = traps.trap_check(bill).first().asDict()
    assert found == {"doubled_days": 1, "refunds": 1, "small_regular": 1, "risen": 2, "wide_spread": 1, "far_outliers": 0}
    labels = bill.select("txn_id", F.when(F.col("merchant") == "w", "x").otherwise("y").alias("category"))
    assert traps.trap_check(bill, labels).first()["far_outliers"] == 0 and traps.trap_check(bill.limit(0)).first()["risen"] == 0
    many = bill.unionByName(spark.createDataFrame([(f"m{i}", "2026-03-01", "v", "1.00", "购物", 100 + i) for i in range(40)], "txn_id string, date string, merchant string, amount string, category string, seq long").withColumn("amount", F.col("amount").cast("decimal(20,2)")))
    assert traps.trap_check(many).first()["far_outliers"] == 1
