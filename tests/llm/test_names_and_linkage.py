from __future__ import annotations

import random
from itertools import combinations, product

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import linkage as L
from quillspark.llm import names as N
from quillspark.llm.components import components

GROUPS = [
    ["berte gerkure pharmacy", "bertee gerkure pharmacy", "b. gerkure pharmacy", "sq gerkure berte phcy", "bérte gerkure pharmacy", "pharmacy berte gerkure", "bertegerkure drugstore", "brt gerkure pharm", "berte gerkure pharmacy ltd", "berte gerkure pharmacy eastvenne tx"],
    ["berte gerkure laundry", "berte-gerkure lndry"],  # the same owner in another line of business
    ["anthony kaven gendulon", "tony kaven gendulon", "kaven gendulon, anthony", "anhtony kaven gendulon", "anthony kavengendulon", "mr kaven gendulon", "a. kaven gendulon"],
    ["anthony lazo gabonzu"],
    ["zumblo meals"], ["zumblo ride"], ["beantide coffee"],
    ["huke tonbeden cinema", "huke's tonbeden cinema", "the huke & tonbeden cinema"],
    ["fegi luzibu auto repair", "phegi luzibu garage"],
]


def test_variants(spark):
    rows = [(n, "x", "y", "z") for group in GROUPS for n in group for _ in range(2)] + [(None, "x", "y", "z"), ("", "x", "y", "z"), ("...", "x", "y", "z"), ("x" * 30_000, None, None, None)]
    found = N.NameGroups(spark.createDataFrame(rows, "merchant_key string, name string, root string, line string"), "merchant_key")
    assert {tuple(r) for r in found.pairs().collect()} == {tuple(sorted(p)) for g in GROUPS for p in combinations(g, 2)}
    sizes = {r["name"]: (r["group_id"], r["group_size"]) for r in found.groups().collect()}
    assert sizes["zumblo ride"] == ("zumblo ride", 1) and sizes["tony kaven gendulon"] == (min(GROUPS[2]), 7) and "" not in sizes


def test_an_initial_that_fits_two_owners_joins_neither(spark):
    names = ["berte gerkure pharmacy", "bonsa gerkure pharmacy", "b. gerkure pharmacy"]
    assert N.NameGroups(spark.createDataFrame([(n,) for n in names], "k string"), "k").pairs().count() == 0


def test_short_names_and_names_without_vowels(spark):
    groups = [["ab bakery", "ac bakery", "abc bakery"], ["a noodles"], ["b noodles"], ["li cinema", "l cinema"], ["kaven lynch market", "kaven lynch mart", "kaven lnych market"], ["flynn byrd books", "flynn byrb books", "flynn byrd bks"]]
    groups += [["grtwd travel", "grtwda travel"]]
    found = {tuple(r) for r in N.NameGroups(spark.createDataFrame([(n,) for g in groups for n in g], "k string"), "k").pairs().collect()}
    assert found == {tuple(sorted(p)) for g in groups for p in combinations(g, 2)}


@pytest.mark.parametrize("a", ["a", "ab", "abc"])
def test_an_edit_of_a_short_name_is_found(a):
    for b in {a[:i] + c + a[i + k :] for i in range(len(a) + 1) for k in (0, 1) for c in ("", "x")} - {a, ""}:
        if min(len(a), len(b)) < N.SEGMENTS and max(len(a), len(b)) > 1:
            assert set(N.indexed(a)) & set(N.probed(b)) or set(N.indexed(b)) & set(N.probed(a)), (a, b)


def test_empty(spark):
    assert N.NameGroups(spark.createDataFrame([], "k string"), "k").pairs().count() == 0


def edit(rng, text):
    i = rng.randrange(len(text))
    kind = rng.randrange(4)
    if kind == 0:
        return text[:i] + text[i + 1 :]
    if kind == 1:
        return text[:i] + rng.choice("abeknz") + text[i:]
    if kind == 2 and i + 1 < len(text):
        return text[:i] + text[i + 1] + text[i] + text[i + 2 :]
    return text[:i] + rng.choice("abeknz") + text[i + 1 :]


def test_two_edits_always_meet_in_the_index():
    rng = random.Random(4)
    missed = total = 0
    for _ in range(3000):
        a = "".join(rng.choice("abeknz") for _ in range(rng.randrange(8, 16)))
        b = edit(rng, edit(rng, a))
        if N.swap_distance(a, b, 2) <= 2 and len(b) >= 3:
            total += 1
            missed += not (set(N.indexed(a)) & set(N.probed(b)))
    assert total > 2000 and missed <= total * 0.003  # two swaps across cuts of both sets


def test_names_with_other_letters_are_no_candidates(spark):
    owners = ["".join(p) for p in product("bdgklm", "ou", "nrstvz", "ei")]  # 144 that all end alike
    names = [f"{o}kaven books" for o in owners] + ["bonekavne books"]
    rows = N.NameGroups(spark.createDataFrame([(n,) for n in names], "k string"), "k")
    name = {r["id"]: r["name"] for r in rows.names.collect()}
    met = {tuple(sorted((name[r["a"]], name[r["b"]]))) for r in rows._candidates().collect()}
    near = {p for p in combinations(sorted(names), 2) if N.swap_distance(*(n.split()[0] for n in p), 2) <= 2}
    assert near <= met and len(met) < len(names) * (len(names) - 1) / 2 * 0.9
    assert {tuple(sorted((r["a"], r["b"]))) for r in rows.strong.collect()} == near


def test_letters_never_tell_two_edits_apart():
    rng = random.Random(6)
    for _ in range(3000):
        a = "".join(rng.choice("abeknzwcyqphfé1") for _ in range(rng.randrange(2, 16)))
        b = edit(rng, edit(rng, a) or "a") or "a"
        for x, y in ((a, b), (N.sound([a]), N.sound([b])), (a[3:] + a[:3], b)):
            x, y = N.letters([x]), N.letters([y])
            assert (x & ~y).bit_count() <= 2 and (y & ~x).bit_count() <= 2 and x < 1 << 63, (a, b)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", max_size=8), st.text(alphabet="abc", max_size=8))
def test_banded_distance_equals_the_full_table(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                table[i][j] = i + j
                continue
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                table[i][j] = min(table[i][j], table[i - 2][j - 2] + 1)
    for most in (0, 1, 2, 9):
        assert N.swap_distance(a, b, most) == min(table[-1][-1], most + 1)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- linkage ----------------------------------------------------------------------------------------------------------

LEDGER = "id long, txn_id string, account string, date string, merchant string, amount string, batch_id string, key string, block int"
INCOMING = "id long, batch_id string, line_no int, txn_id string, date string, merchant string, amount string, account string"
STORED = [
    (1, "FT0130414002-7826", "card-5550001", "2026-01-05", "STARBUCKS #1", "10.00"), (2, "T000012", "card-5550001", "2026-01-05", "STARBUCKS #1", "10.00"), (3, "C186710C7586", "sav-1358050", "2026-02-01", "BERTE GERKURE PHARMACY", "7.25"),
    (4, "FT0130414002-9999", "card-5550001", "2026-03-05", "ANNA BELLO CINEMA", "-3.00"), (5, "T000013", "card-5550001", "2026-04-01", "TWICE", "5.00"), (6, "T000014", "card-5550001", "2026-04-01", "TWICE", "5.00"),
]


def link(spark, new, stored=STORED, **more):
    ledger = spark.createDataFrame([(*r, "b", "x", 1) for r in stored], LEDGER).withColumn("date", F.col("date").cast("date")).withColumn("amount", F.col("amount").cast("decimal(20,2)"))
    incoming = spark.createDataFrame([(i, "n", 1, t, d, m, a, acc) for i, t, acc, d, m, a in new], INCOMING)
    return {r["duplicate_id"]: r["original_id"] for r in L.duplicates(ledger, incoming, **more).collect()}


@pytest.mark.parametrize(
    "new,original",
    [
        (("FT0130414002-7826", "card-5550001", "2026-01-05", "STARBUCKS #1", "10.00"), 1),
        ((" ref ft0130414002 7826\t", "CARD 5550001", "2026/01/05", "PURCHASE STARBUCKS", "+10.00 "), 1),
        (("0130414002-7826", "信用卡5550001", "01/08/2026", "anything else", "10.0"), 1),  # three days
        (("0130414002-7826", "5550001", "01/09/2026", "STARBUCKS #1", "10.00"), None),  # four
        (("002-7826", "555 0001", "2026-01-05", "STARBUCKS #1", "10.00"), 1),  # the end of it
        (("FT0130414002-7828", "card-5550001", "2026-01-05", "STARBUCKS #1", "10.00"), 1),  # one wrong
        (("FT1030414002-7826", "card-5550001", "2026-01-05", "STARBUCKS #1", "10.00"), 1),  # two swapped
        (("FT1030414002-7828", "card-5550001", "2026-01-05", "STARBUCKS #1", "10.00"), None),
        (("12", "card-5550001", "2026-01-05", "STARBUCKS #1", "10.00"), 2),
        (("#T-000012", "card-5550001", "2026-01-05", "STARBUCKS #1", "10.00"), 2),
        (("T000013", "card-5550001", "2026-01-05", "STARBUCKS #1", "10.00"), None),  # running numbers are never damaged
        (("T000012", "card-5550001", "2026-01-05", "STARBUCKS #1", "10.01"), None),  # changed at its source
        (("T000012", "card-9990001", "2026-01-05", "STARBUCKS #1", "10.00"), None),
        (("0xc186701c7586", "sav_1358050", "2026-02-01", "B. GERKURE", "7.25"), 3),
        (("10C7586", "sav-1358050", "2026-02-01", "BERTE GERKURE PHARMACY", "7.25"), None),
        (("710C7586", "sav-1358050", "2026-02-01", "BERTE GERKURE PHARMACY", "7.25"), 3),
        ((None, "sav-1358050", "2026-02-01", "berte gerkure phcy", "7.25"), 3),
        (("N/A", "sav-1358050", "2026-02-02", "BERTE GERKURE PHARMACY", "7.25"), None),  # without identifier all must agree
        (("-", "sav-1358050", "2026-02-01", "OTHER SHOP", "7.25"), None),
        (("", "card-5550001", "2026-04-01", "TWICE", "5.00"), 5),  # the smaller of two real charges
        (("x", "", "2026-04-01", "TWICE", "5.00"), None), (("x", "card-5550001", "no date", "TWICE", "5.00"), None), (("x", "card-5550001", None, None, None), None),
    ],
)
def test_single_records(spark, new, original):
    assert link(spark, [(100, *new)]) == ({100: original} if original else {})


def test_records_of_the_batches_themselves(spark):
    same = ("card-1", "2026-01-01", "SHOP", "1.00")
    new = [
        (100, "FT9000000001-0001", *same), (101, "FT9000000001-0002", *same), (102, "9000000001-0001", *same), (102, "9000000001-0001", *same), (103, None, *same), (104, "", *same), (105, "FT9000000001-0003", *same),
        (106, None, "card-2", "2026-01-01", "SHOP", "1.00"), (107, None, "card-2", "2026-01-01", "SHOP", "1.00"), (108, "T000077", "card-2", "2026-01-01", "SHOP", "1.00"),
    ]
    # 101 and 105 are one character from 100: taken for damage of it, like the tail 102 belongs to it.
    assert link(spark, new, []) == {101: 100, 102: 100, 103: 100, 104: 100, 105: 100, 107: 106, 108: 106}


def test_a_record_without_identifier_ties_nothing_together(spark):
    new = [(100, None, "card-5550001", "2026-04-01", "TWICE", "5.00"), (101, "T000014", "card-5550001", "2026-04-01", "TWICE", "5.00")]
    assert link(spark, new) == {100: 5, 101: 6}


def frames(spark, stored, batches):
    ledger = spark.createDataFrame([(*r, "b", "x", 1) for r in stored], LEDGER)
    return ledger, [spark.createDataFrame([(i, "n", 1, t, d, m, a, acc) for i, t, acc, d, m, a in new], INCOMING) for new in batches]


def one_by_one(store, batches, files=None, weights=None):
    found = {}
    for batch in batches:
        linked = store.link(batch, files, weights)
        found |= {r["duplicate_id"]: r["original_id"] for r in linked.repeats.collect()}
        store.accept(linked)
    return found


def test_batches_one_after_another_equal_all_at_once(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    ledger, incoming, files = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("ledger_transactions", "incoming_transactions", "import_batches"))
    whole = L.LinkageStore.of(ledger, f"{tmp_path}/whole").link(incoming, files)
    expected = {r["duplicate_id"]: r["original_id"] for r in whole.repeats.collect()}
    ids = sorted(r["id"] for r in incoming.select("id").collect())
    cuts = [ids[len(ids) * i // 3] for i in range(3)] + [ids[-1] + 1]
    store = L.LinkageStore.of(ledger, f"{tmp_path}/steps")
    parts = [incoming.where((F.col("id") >= a) & (F.col("id") < b)) for a, b in zip(cuts, cuts[1:])]
    assert expected and one_by_one(store, parts, files, whole.weights) == expected
    again = L.LinkageStore(spark, f"{tmp_path}/steps")  # as a later run finds it
    assert {r["node"]: r["root"] for r in again.representatives().where("node <> root").collect()} == expected
    # The same batch once more is found as it was, and adds nothing.
    linked = again.link(parts[1], files)
    assert {r["duplicate_id"]: r["original_id"] for r in linked.repeats.collect()} == {k: v for k, v in expected.items() if cuts[1] <= k < cuts[2]}
    assert linked.records.count() == 0 and linked.representatives.count() == 0


def test_only_the_buckets_of_a_batch_are_read(spark, tmp_path):
    ledger = spark.read.parquet("/root/testdata/sf0.001/ledger_transactions.parquet")
    store = L.LinkageStore.of(ledger, f"{tmp_path}/store", buckets=64)
    row = ledger.orderBy("id").first()
    batch = spark.createDataFrame([(10**9, "n", 1, row["txn_id"], str(row["date"]), row["merchant"], str(row["amount"]), row["account"])], INCOMING)
    touched = store.touched(L.normalised(batch))
    assert len(touched) == 1
    for folder in (tmp_path / "store" / store.state["records"][0]).glob("bucket=*"):
        if folder.name != f"bucket={touched[0]}":
            for file in folder.iterdir():
                file.write_bytes(b"unreadable")
    assert [tuple(r) for r in store.link(batch).repeats.collect()] == [(row["id"], 10**9)]
    # What was built before isn't built again: the same folder is served without any history.
    assert L.LinkageStore.of(ledger.limit(0), f"{tmp_path}/store").link(batch).repeats.count() == 1


def test_weights_decide(spark):
    new = [(100, "FT0130414002-7828", "card-5550001", "2026-01-06", "OTHER SHOP", "10.00"), (101, "FT0130414002-7826", "card-5550001", "2026-01-05", "STARBUCKS #1", "10.00")]
    base = L.learn(pd.DataFrame(columns=[*L.PATTERN, "n"]))
    strict = L.Weights(base.levels | {"id_level": base.levels["id_level"] | {"damaged": -9.0}}, base.odds)
    never = L.Weights({f: {v: -1000.0 for v in levels} for f, levels in base.levels.items()}, 0.0)
    assert link(spark, new, weights=L.Weights(base.levels | {"id_level": base.levels["id_level"] | {"damaged": 9.0}}, base.odds)) == {100: 1, 101: 1}
    assert link(spark, new, weights=strict) == {101: 1} and link(spark, new, weights=never) == {}


def test_a_batch_joins_old_clusters(spark, tmp_path):
    same = ("card-1", "2026-01-01", "SHOP", "1.00")
    first, second = [(100, "FT0000000000-0000", *same)], [(200, "FT0000000000-0022", *same)]
    between = [(300, "FT0000000000-0002", *same)]
    ledger, batches = frames(spark, [], [first, second, between])
    store = L.LinkageStore.of(ledger, f"{tmp_path}/store")
    assert one_by_one(store, batches[:2]) == {}
    linked = store.link(batches[2])
    assert [tuple(r) for r in linked.repeats.collect()] == [(100, 300)]
    assert {r["node"]: r["root"] for r in linked.representatives.collect()} == {200: 100, 300: 100}
    store.accept(linked)
    assert {r["node"]: r["root"] for r in store.representatives().where("node <> root").collect()} == {200: 100, 300: 100}


def test_same_identifier_on_other_days(spark):
    stored = [(1, "C186710C7586", "sav-1", "2026-01-01", "SHOP", "1.00"), (2, "C186710C7586", "sav-1", "2026-01-20", "SHOP", "1.00")]
    assert link(spark, [(100, "C186710C7586", "sav-1", "2026-01-20", "SHOP", "1.00")], stored) == {100: 2}


def test_an_earlier_record_without_identifier_is_the_first(spark, tmp_path):
    same = ("card-1", "2026-01-01", "SHOP", "1.00")
    rows = [(10, None, *same), (20, "T000001", *same), (30, "T000001", *same), (40, "T000002", *same), (50, "", *same)]
    expected = {20: 10, 30: 10, 50: 10}  # 40 is another transaction
    assert link(spark, rows, []) == expected
    ledger, batches = frames(spark, [], [[r] for r in rows])
    assert one_by_one(L.LinkageStore.of(ledger, f"{tmp_path}/store"), batches) == expected


def test_files_sent_again(spark, tmp_path):
    ledger = spark.createDataFrame([(1, "C186710C7586", "sav-1", "2026-01-01", "SHOP", "1.00", "old", "x", 1), (2, None, "sav-1", "2026-01-02", "SHOP", "2.00", "old", "x", 1)], LEDGER)
    lines = [(11, "new", 1, "C186710C7586", "2026-01-01", "SHOP", "1.00", "sav-1"), (12, "new", 2, None, "2026-01-02", "SHOP", "2.00", "sav-1"), (13, "other", 1, "C186710C7586", "2026-01-01", "SHOP", "1.00", "sav-1")]
    files = spark.createDataFrame([("old", "h", 1), ("new", "h", 2), ("other", "k", 3), ("none", None, 4)], "id string, content_hash string, created_at int")
    store = L.LinkageStore.of(ledger, f"{tmp_path}/store")
    batch = spark.createDataFrame(lines, INCOMING)
    filed = store._filed(L.normalised(batch), files)
    assert {r["id"]: (r["file"], r["resent"]) for r in filed.collect()} == {11: ("old", True), 12: ("old", True), 13: (None, False)}
    assert {r["duplicate_id"]: r["original_id"] for r in store.link(batch, files).repeats.collect()} == {11: 1, 12: 2, 13: 1}
    # The file speaks for a line: its weight alone turns a pair that the others speak against.
    base = L.learn(pd.DataFrame(columns=[*L.PATTERN, "n"]))
    doubtful = L.Weights(base.levels | {"file_level": {"copied": 100.0, "apart": -100.0}}, base.odds)
    assert {r["duplicate_id"]: r["original_id"] for r in store.link(batch, files, doubtful).repeats.collect()} == {11: 1, 12: 2}


def test_every_swap_is_inside_a_mask():
    for length in L.LENGTHS:
        held = L.masks(length)
        assert all(any(a <= i and i + 2 <= b for a, b in held) for i in range(length - 1))


def test_empty_and_hot(spark):
    assert link(spark, []) == {} and link(spark, [], []) == {}
    hot = [(1000 + i, "FT0130414002-7826", "card-5550001", "2026-01-05", "STARBUCKS #1", "10.00") for i in range(1500)]
    assert set(link(spark, hot).values()) == {1}


def test_weights_prefer_agreement():
    rows = [("same", "same", "same", "same", 500), ("damaged", "same", "same", "written", 40), ("other", "far", "other", "same", 300), ("missing", "same", "same", "same", 60), ("missing", "same", "other", "same", 50)]
    counts = pd.DataFrame([(*r[:4], "apart", r[4]) for r in rows], columns=[*L.PATTERN, "n"])
    weights = L.learn(counts)
    assert weights.levels["id_level"]["same"] > 0 > weights.levels["id_level"]["other"] and weights.levels["merchant_level"]["same"] > weights.levels["merchant_level"]["other"]
    assert weights.levels["date_level"]["far"] < L.learn(counts.head(0)).levels["date_level"]["far"] < 0
