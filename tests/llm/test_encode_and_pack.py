from __future__ import annotations

import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import encode as E
from quillspark.llm import packing as K

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    tokenizer = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def mine(texts):
    ids, begin, *_ = E.encode_batch(texts, E.DEFAULT_VOCABULARY)
    return [ids[begin[i] : begin[i + 1]].tolist() for i in range(len(texts))]


ALPHABET = "'srtmdvelLa \t\n\r　  é中文字12½²,.!?-_🙂​\x1c\x85𝒜́"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=30), max_size=5))
def test_equals_the_library(reference, texts):
    assert mine(texts) == [reference(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_unicode(reference, text):
    assert mine([text]) == [reference(text)] and E.decode(mine([text])[0]) == text


def test_contractions_and_spaces(reference):
    texts = ["I'll 'twas don't ''s 's'll 'r 're've'l", "a  b   c\n\n d \n", " ", "", "  ", "'", "x'", "it's  's", "<|endoftext|>"]
    assert mine(texts) == [reference(t) for t in texts]


def test_the_scan_is_associative_and_ends():
    machine = E.automaton()
    size = len(machine["then"])
    for a in range(size):
        for b in range(size):
            for c in range(size):
                assert machine["then"][machine["then"][a, b], c] == machine["then"][a, machine["then"][b, c]]


def test_frames(spark, reference):
    rng = random.Random(1)
    long = "".join(rng.choice(ALPHABET) for _ in range(30_000))
    rows = [(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (None, "a b", None), (1, "a b", "x"), (4, long, "x"), (5, "字" * 30_000, "x"), (6, "0" * 40_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"] or 0, r["ids"]) for r in E.encode_documents(docs, "doc_id", "text").collect()), key=str)
    assert got == sorted(((i or 0, reference(t or "")) for i, t, _ in rows), key=str)
    counts = E.count_tokens(docs, "doc_id", "text").groupBy().sum("n_tokens").first()[0]
    assert counts == sum(len(ids) for _, ids in got)
    assert E.encode_documents(docs.limit(0), "doc_id", "text").count() == 0


def test_offsets_find_parts_of_a_text(spark):
    docs = spark.createDataFrame([(1, "héllo wörld 中文 it's"), (2, None)], "doc_id long, text string")
    row = E.encode_documents(docs, "doc_id", "text", offsets=True).where("doc_id = 1").first()
    bounds = [*row["firsts"], len(row["ids"])]
    pieces = [E.decode(row["ids"][a:b]) for a, b in zip(bounds, bounds[1:])]
    text = "héllo wörld 中文 it's"
    assert "".join(pieces) == text and [text[a:].startswith(p) for a, p in zip(row["offsets"], pieces)] == [True] * len(pieces)


def test_other_vocabulary(spark, tmp_path):
    path = tmp_path / "bytes.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" " + str(i).encode() for i in range(256)))
    docs = spark.createDataFrame([(1, "aé")], "doc_id long, text string")
    assert E.encode_documents(docs, "doc_id", "text", str(path)).first()["ids"] == list("aé".encode())


# --- packing ----------------------------------------------------------------------------------------------------------


def check(rows, sizes, capacity):
    """Every token lies in one place, nothing overlaps, and only large items are cut."""
    boxes, items = {}, {}
    for key, piece, box, at, first, n in rows:
        boxes.setdefault(box, []).append((at, n))
        items.setdefault(key, []).append((first, n))
    for parts in boxes.values():
        place = 0
        for at, n in sorted(parts):
            assert at == place
            place += n
        assert place <= capacity
    for key, n in sizes.items():
        parts = sorted(items[key])
        assert sum(p for _, p in parts) == n and [f for f, _ in parts] == [i * capacity for i in range(len(parts))]
        assert len(parts) == 1 or n > capacity


def first_fit_decreasing(sizes, capacity):
    rest, room = [], []
    for n in sizes:
        full, part = divmod(n, capacity)
        room += [0] * full
        rest += [part] * bool(part)
    for n in sorted(rest, reverse=True):
        at = next((i for i, r in enumerate(room) if r >= n), None)
        if at is None:
            room.append(capacity - n)
        else:
            room[at] -= n
    return len(room)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_rule_is_the_best_level_each_time(sizes):
    packer = K.SumOfSquares(16)
    for size in (min(s, 16) for s in sizes):
        before = packer.level.copy()

        def cost(h, size=size, before=before):
            n = before.copy()
            if h:
                n[h] -= 1
            if h + size < 16:
                n[h + size] += 1
            return int((n**2).sum())

        allowed = [h for h in range(16 - size + 1) if not h or before[h]]
        _, at = packer.place(size)
        assert cost(at) == min(map(cost, allowed)) and at in allowed


def test_packing(spark):
    rng = random.Random(7)
    sizes = {i: rng.choice([1, 7, 300, 500, 1100, 2047, 2048, 2049, 9000]) for i in range(2000)}
    rows = [(i, n, "x") for i, n in sizes.items()]
    items = spark.createDataFrame([*rows, (None, 5, "x"), (9999, 0, "x"), (9998, None, "x")], "doc_id long, n_tokens long, container string")
    for buckets in (1, 5):
        placed = K.pack(items, "doc_id", "n_tokens", buckets)
        got = [tuple(r) for r in placed.collect()]
        check([(-1 if r[0] is None else r[0], *r[1:]) for r in got], sizes | {-1: 5}, 2048)
        assert sum(r[0] is None for r in got) == 1
        assert len({r[2] for r in got}) <= first_fit_decreasing([*sizes.values(), 5], 2048) * 1.03 + 5 * buckets
    assert K.pack(items.limit(0), "doc_id", "n_tokens", 1).count() == 0


def test_packing_documents(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "x " * 5000), (5, "hot"), (5, "hot")], "doc_id long, text string")
    rows = K.pack_documents(docs, "doc_id", "text").collect()
    assert {r["doc_id"] for r in rows} == {1, 4, 5} and sum(r["doc_id"] == 5 for r in rows) == 2
    assert max(r["piece"] for r in rows if r["doc_id"] == 4) >= 2
    same = sorted(map(tuple, K.pack_documents(docs.repartition(3), "doc_id", "text").collect()))
    assert same == sorted(map(tuple, rows))  # a lost task repeats the same places
    assert K.pack_documents(docs.where(F.lit(False)), "doc_id", "text").count() == 0
