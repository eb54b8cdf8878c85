"""Splitting of oversized texts at natural boundaries.

A hierarchy of separators: section, paragraph, line, sentence, word, character.
A unit that does not fit is cut by the next finer separator; separators stay
with the text before them, so the units join to the text again.  Units are then
packed greedily, and every piece but the first begins with the last characters
of the piece before it.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 900, 90
#: White space at the ends of a section that does not count.
EDGE = " \t\r\n　"

#: Places after which a text may be cut, from coarse to fine.
SEPARATORS = [
    re.compile(r"\n(?=#{1,6} )|\n(?=\*\*[^*\n]+\*\*[ \t]*\r?\n)|(?:\r?\n[ \t　]*){3,}"),
    re.compile(r"(?:\r?\n[ \t　]*){2,}"),
    re.compile(r"\r?\n|\r(?!\n)"),
    re.compile(r"[。！？!?…]+[”’」』）)\"']*[ \t　]*|[.;；][”’)\"']*(?:[ \t　]+|$)"),
    re.compile(r"[ \t　]+|[，、,：:|]"),
]


def characters(text: str, most: int) -> list[str]:
    """Cuts of at most ``most`` code points that do not part a mark from its letter, unless marks alone exceed it."""
    out, begin = [], 0
    while len(text) - begin > most:
        end = begin + most
        while end > begin + most // 2 and (unicodedata.combining(text[end]) or text[end] in "‍️" or text[end - 1] == "‍"):
            end -= 1
        out.append(text[begin:end])
        begin = end
    return [*out, text[begin:]]


def units(text: str, most: int, level: int = 0) -> list[str]:
    """Parts of at most ``most`` code points that join to ``text``, each cut at the coarsest separator that does."""
    if len(text) <= most:
        return [text] if text else []
    if level == len(SEPARATORS):
        return characters(text, most)
    ends = [m.end() for m in SEPARATORS[level].finditer(text)]
    parts = [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)]) if b > a]
    return [unit for part in parts for unit in units(part, most, level + 1)]


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(begin, end) of each piece; consecutive pieces share exactly ``overlap`` code points."""
    pieces, begin, end = [], 0, 0
    for unit in units(text, limit - overlap):
        if end + len(unit) - begin > limit:
            pieces.append((begin, end))
            begin = end - overlap
        end += len(unit)
    if end > begin:
        pieces.append((begin, end))
    return pieces


def split_texts(rows: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """All columns of ``rows`` but ``text``, with piece_no, n_pieces, piece_start and piece_text.

    White space at both ends is removed first.  A text within the limit is one
    piece; a null or blank one is one piece with an empty text.  Only oversized
    texts reach Python, whole.  Repeated rows are cut alike.  A column of
    ``rows`` with the name of a result column is replaced by it.
    """

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])))
    def cut_at(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"begin": a, "end": b} for a, b in spans(t, limit, overlap)], na_action="ignore")

    made = ["piece_no", "n_pieces", "piece_start", "piece_text"]
    kept = [c for c in rows.columns if c != text and c not in made]
    body = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(EDGE))
    whole = F.array(F.struct(F.lit(0).alias("begin"), F.char_length("__body").alias("end")))
    cuts = rows.select(*kept, body.alias("__body")).withColumn("__cuts", F.coalesce(cut_at(F.when(F.char_length("__body") > limit, F.col("__body"))), whole))
    return cuts.select(*kept, F.size("__cuts").alias("n_pieces"), "__body", F.posexplode("__cuts").alias("piece_no", "__at")).select(
        *kept, "piece_no", "n_pieces", F.col("__at.begin").alias("piece_start"),
        F.expr("substring(__body, __at.begin + 1, __at.end - __at.begin)").alias("piece_text"),
    )
