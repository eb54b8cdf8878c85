from __future__ import annotations

import random

import pytest

from quillspark.llm import spans as S

ALPHABET = "abcdefgh 中文字句。"


def brute(texts: dict[int, str], least: int):
    """Pairs of records with a common window, and how many characters of each lie in one."""
    owners: dict[str, set[int]] = {}
    for i, t in texts.items():
        for p in range(len(t) - least + 1):
            owners.setdefault(t[p : p + least], set()).add(i)
    pairs = {(a, b) for group in owners.values() for a in group for b in group if a < b}
    shared = {}
    for i, t in texts.items():
        covered = set()
        for p in range(len(t) - least + 1):
            if len(owners[t[p : p + least]]) > 1:
                covered.update(range(p, p + least))
        shared[i] = len(covered)
    return pairs, shared


def runs(texts: dict[int, str], least: int):
    """The maximal intervals of each text that another one holds, and the smallest record each is linked with."""
    owners: dict[str, set[int]] = {}
    for i, t in texts.items():
        for p in range(len(t) - least + 1):
            owners.setdefault(t[p : p + least], set()).add(i)
    intervals = set()
    group = {i: i for i in texts}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for held in owners.values():
        for i in held:
            a, b = sorted((find(i), find(min(held))))
            group[b] = a
    for i, t in texts.items():
        begin = end = None
        for p in range(len(t) - least + 1):
            if len(owners[t[p : p + least]]) > 1:
                if begin is not None and p <= end:
                    end = p + least
                else:
                    intervals |= {(i, begin, end)} if begin is not None else set()
                    begin, end = p, p + least
        intervals |= {(i, begin, end)} if begin is not None else set()
    return intervals, {i: find(i) for i in texts}


def corpus(rng, least):
    fresh = lambda n: "".join(rng.choice(ALPHABET) for _ in range(n))
    texts = {i: fresh(rng.randrange(0, 400)) for i in range(30)}
    for _ in range(25):
        passage = fresh(rng.choice([least - 1, least, least + 1, least * 2, 3 * least]))
        for i in rng.sample(range(30), rng.choice([2, 2, 3, 6])):
            cut = rng.randrange(0, len(texts[i]) + 1)
            texts[i] = texts[i][:cut] + passage + texts[i][cut:]
    texts[30], texts[31], texts[32] = texts[3], texts[3], texts[3] + "!"
    texts[33], texts[34] = "x" * 700, "x" * 500 + "y"
    texts[35] = "ab" * 300
    texts[36] = "short"
    texts[37] = "short"
    return texts


@pytest.mark.parametrize("seed,paired", [(1, 64), (2, 64), (3, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, paired):
    monkeypatch.setattr(S, "PAIRED", paired)  # 1: every hash goes by its windows
    least, gram = 60, 24
    texts = corpus(random.Random(seed), least)
    rows = [(i, t, 0) for i, t in texts.items()] + [(90, None, 0), (91, "", 0), (None, texts[3], 0), (5, texts[5], 0)]
    found = S.SharedSpans(spark.createDataFrame(rows, "doc_id long, text string, hash int"), "doc_id", "text", least, gram)
    pairs, shared = brute(texts, least)
    assert {tuple(r) for r in found.pairs().collect()} == pairs
    got = {r["doc_id"]: r for r in found.shared().collect()}
    assert {i: r["shared_chars"] for i, r in got.items()} == shared | {90: 0, 91: 0}
    intervals, groups = runs(texts, least)
    assert {tuple(r) for r in found.intervals().collect()} == intervals
    # Copies shorter than the least length are a class, but not linked by a span.
    assert {i: r["group_id"] for i, r in got.items()} == groups | {37: 36, 90: 90, 91: 91}
    assert {got[i]["class_id"] for i in (3, 30, 31)} == {3} and got[37]["class_id"] == 36 and got[90]["class_id"] == 90


def test_production_length(spark):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(160))
    rows = [(1, "x1" + passage + "y1"), (2, passage), (3, passage[:159]), (4, "long " + "z" * 40_000 + passage)]
    found = S.SharedSpans(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert sorted(map(tuple, found.pairs().collect())) == [(1, 2), (1, 4), (2, 4)]


def test_empty_and_copies_only(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.SharedSpans(none, "doc_id", "text").pairs().count() == 0 and S.SharedSpans(none, "doc_id", "text").shared().count() == 0
    copies = spark.createDataFrame([(i, "abc" * 100) for i in range(40)], "doc_id long, text string")
    found = S.SharedSpans(copies, "doc_id", "text")
    assert found.pairs().count() == 780 and found.shared().where("shared_chars = 300 and class_id = 0 and group_id = 0").count() == 40


def test_texts_that_meet_in_a_hash(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "a" * 200), (2, "b" * 200), (3, "a" * 200), (4, None)], "doc_id long, text string")
    monkeypatch.setattr(S.F, "xxhash64", lambda *c: S.F.length(c[-1] if len(c) > 1 else c[0]).cast("long") if len(c) == 1 else S.F.crc32(S.F.concat_ws("|", *c)))
    classes = {r["doc_id"]: r["c"] for r in texts.select("doc_id", S.text_classes(texts).alias("c")).collect()}
    assert classes[1] == classes[3] != classes[2]


def test_every_span_keeps_an_anchor():
    rng = random.Random(9)
    for _ in range(50):
        passage = "".join(rng.choice("ab") for _ in range(60))
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(80))) for _ in range(2))
        owner, _, hashes = S.anchors([a + passage + b, b + passage + a], 60, 24)
        assert set(hashes[owner == 0]) & set(hashes[owner == 1])


@pytest.mark.parametrize("paired", [64, 1])
def test_repeats_within_one_text_are_not_shared(spark, monkeypatch, paired):
    monkeypatch.setattr(S, "PAIRED", paired)
    rng = random.Random(11)
    least, gram = 60, 24
    fresh = lambda n: "".join(rng.choice(ALPHABET) for _ in range(n))
    passage = fresh(90)
    # Every window of the repeated passage is in another text too, in pieces that are too short to be shared.
    pieces = [passage[p : p + least - 1] for p in range(0, 90, 8)]
    texts = {1: fresh(30) + passage + fresh(30) + passage + fresh(30)} | {i: fresh(50) + piece + fresh(50) for i, piece in enumerate(pieces, 2)}
    common = fresh(70)
    texts |= {50: common + fresh(40) + common + fresh(20), 51: fresh(20) + common + fresh(20)}
    found = S.SharedSpans(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id", "text", least, gram)
    pairs, shared = brute(texts, least)
    assert {tuple(r) for r in found.pairs().collect()} == pairs
    assert {r["doc_id"]: r["shared_chars"] for r in found.shared().collect()} == shared
    assert shared[1] == 0 and shared[50] >= 140
