from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from quillspark.llm import hmm as H
from quillspark.llm import ocr as O

SCHEMA = "part_id long, source string, location string, method string, page int, slide int, text string, label string, kind string"
CLEAN = "The refund of 12.00 came in June. Utilities were high and the remaining summary changes nothing at all.\nMoving rent to travel is a long-term plan with a cross-check.\n2024年8月1日的收入已经登记，贷款余额需要更正。"


def pages(spark, *rows):
    return O.ScannedPages(spark.createDataFrame([(i, s, f"第{p}页", m, p if keep else None, None, t, "x", "y") for i, s, m, p, keep, t in rows], SCHEMA))


def clean(first=100, sources=("n1", "n2", "n3")):
    return [(first + i, s, "native", 1, True, CLEAN) for i, s in enumerate(sources)]


def scan(header, number, *body):
    return "\n".join([header, number, *body])


BOOK = [
    (1, "a", "ocr", 1, True, scan("Household Guide", "- 7 -", "The refund of 12.00 came in June and the rema-", "ining summary chang¬", "es nothing. Utilitics were h1gh.", "", "Moving rent to tra-")),
    (2, "a", "ocr", 2, False, scan("Househo1d Guide", "- 8 -", "vel is a plan with a cross-", "check of Benlu Hafi and the long-", "term summary was 1O.50 at Gebi")),
    (3, "a", "native+ocr", 3, True, scan("Household Guide", "- 9 -", "", "2024年8月1曰的收入己经登记")),
]


def test_kinds(spark):
    found = {(r["part_id"], r["line_no"]): r["kind"] for r in pages(spark, *BOOK, *clean()).found().collect()}
    assert found == {
        (1, 1): "header", (1, 2): "page_number", (1, 3): "hyphen", (1, 4): "hyphen", (1, 5): "misread", (1, 7): "hyphen",
        (2, 1): "header", (2, 2): "page_number", (2, 5): "misread", (3, 1): "header", (3, 2): "page_number", (3, 4): "misread",
    }


def test_paragraphs(spark):
    rows = pages(spark, *BOOK, *clean()).paragraphs().where("source = 'a'").orderBy("paragraph_no").collect()
    assert [r["text"] for r in rows] == [
        "The refund of 12.00 came in June and the remaining summary changes nothing. Utilities were high.",
        "Moving rent to travel is a plan with a cross-check of Benlu Hafi and the long-term summary was 10.50 at Gebi",
        "2024年8月1日的收入已经登记",
    ]


@pytest.mark.parametrize(
    "line,value",
    [
        ("- 12 -", ("framed", 12)), ("· l2 ·", ("framed", 12)), ("[1O]", ("framed", 10)), ("p. 7", ("framed", 7)), ("13 / 36", ("pages", 13)), ("第2页 共18页", ("pages", 2)), ("Page l0 of 14", ("pages", 10)),
        ("xxxii", ("roman", 32)), ("xiv", ("roman", 14)), ("105", ("plain", 105)), ("12,345.00", None), ("Budget", None), ("", None), ("2024-01-02", None),
    ],
)
def test_page_numbers(line, value):
    assert O.page_number(line) == value


def code(**values):
    made = 0
    for name, size in reversed(H.FEATURES.items()):
        made = made * size + values.get(name, 0)
    return made


def test_decoding_is_the_best_path():
    rng = random.Random(2)
    model = H.LineModel.prior()
    for _ in range(30):
        pages = [[rng.choice([H.BLANK, code(letters=rng.randrange(4), figure=rng.randrange(5), length=rng.randrange(3))]) for _ in range(rng.randrange(1, 5))] for _ in range(3)]
        packed = H.packed(pages)
        with np.errstate(divide="ignore"):
            here, start, step = np.log(model.likelihood(packed)), np.log(model.start), np.log(model.step)
        found = model.decode(packed)

        def score(p, path, here=here, start=start, step=step):
            return start[path[0]] + here[p, 0, path[0]] + sum(step[a, b] + here[p, t, b] for t, (a, b) in enumerate(zip(path, path[1:]), 1))

        for p, page in enumerate(pages):
            best = max(score(p, path) for path in itertools.product(range(len(H.STATES)), repeat=len(page)))
            assert score(p, list(found[p, : len(page)])) == pytest.approx(best)


def test_the_model_follows_the_pages():
    head, number, body = code(letters=2), code(figure=2), code(length=2)
    pages = [[head, H.BLANK, body, body, body, number]] * 400 + [[body, body, body, H.BLANK, body, number]] * 100
    model = H.LineModel.prior().fitted(pages)
    assert [H.KINDS[s] for s in model.decode(H.packed(pages[:1]))[0]] == ["head", "break", "body", "body", "body", "number"]
    assert model.start[0] > 0.5 > H.LineModel.prior().start[0] and model.step[2, 5] > H.LineModel.prior().step[2, 5]
    assert H.LineModel.prior().fitted([]).start[0] == H.START["top_head"]
    assert sorted(i for some in H.batches(pages, 12) for i in some) == list(range(500))


def test_heads_of_three_lines_and_blank_lines_at_the_end(spark):
    text = "words of the refund that came in June are here\n" * 6
    rows = [(i, "a", "ocr", i, True, f"Household Guide\nSecond Part\nThird Line\n- {i} -\n{text}{i}\n\n\n") for i in range(1, 7)]
    found = {(r["part_id"], r["line_no"]): r["kind"] for r in pages(spark, *rows, *clean()).found().where("kind in ('header', 'page_number')").collect()}
    assert found == {(i, n): k for i in range(1, 7) for n, k in ((1, "header"), (2, "header"), (3, "header"), (4, "page_number"), (11, "page_number"))}


def test_letters_of_a_code_are_no_digits(spark):
    rows = [(1, "a", "ocr", 1, True, "The refund at acl-12 came in June.\nThe refund at abl-1l2 came in June.")]
    assert [r["line_no"] for r in pages(spark, *rows, *clean()).found().where("kind = 'misread'").collect()] == [2]



def test_a_heading_of_clean_pages_is_no_running_head(spark):
    rows = [(i, "b", "ocr", i, True, f"Budget\n{x} were high") for i, x in enumerate(("Utilities", "The refund of June", "All changes"), 1)] + [(9, "c", "native", 1, True, "Budget\n" + CLEAN)]
    assert pages(spark, *rows).found().count() == 0


def test_table_numbers_at_the_end_are_no_page_numbers(spark):
    rows = [(i, "b", "ocr", i, True, f"{x} came in June.\n\n{x}\n{n}") for i, n, x in ((1, 40, "Benlu Hafi"), (2, 3, "Gebi Sono"), (3, 17, "Ruta Mino"))]
    assert pages(spark, *rows, *clean()).found().count() == 0


def test_nulls_empty_and_long(spark):
    long = " ".join(["the refund came in June"] * 4000)
    rows = [(1, None, "ocr", 1, True, None), (2, None, "ocr", 1, True, ""), (3, "s", None, 1, True, "the refund"), (4, "s", "ocr", 2, True, long), (4, "s", "ocr", 2, True, long), (5, "s", "ocr", 3, True, "tbe refund"), *clean()]
    scanned = pages(spark, *rows)
    assert [tuple(r) for r in scanned.found().collect()] == [(5, 1, "misread")]
    # The pages end within a sentence, so their lines are one paragraph.
    assert "the refund " + long + " the refund" in {r["text"] for r in scanned.paragraphs().collect()}
    none = O.ScannedPages(spark.createDataFrame([], SCHEMA))
    assert none.found().count() == 0 and none.paragraphs().count() == 0
    assert pages(spark, (1, "s", "ocr", 1, True, "no clean page here")).found().count() == 0
