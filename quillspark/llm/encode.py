"""Encoding of a corpus with a byte-level BPE vocabulary.

Pre-tokenisation without regex: code points become an array of classes, each
class is a transition function of a ten-state automaton, and the state at every
position follows from an associative scan of these functions.  Functions are
numbered elements of a finite monoid, so composing two is one table look-up.
The automaton is definite (a few classes fix the state whatever came before),
so the doubling scan ends after about two rounds, as soon as every prefix is a
constant function.  Token boundaries are a function of neighbouring states.

The slices then go through pair merging with a cache of slices, and the code
point offset of every slice can be kept for decoding parts of a text.

The table of the vocabulary is a parameter (``vocabulary``: a path to a rank
file); nothing is trained here.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Classes of code points.
SEP, LETTER, NUMBER, OTHER, SPACE, BLANK, APOSTROPHE, ONE_LETTER, WANTS_E, WANTS_L, LETTER_E = range(11)
# States: what the token in progress is after a code point. AP: an apostrophe that opens a token;
# AE, AL: apostrophe and r or v, apostrophe and l; DONE: a complete contraction.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_BLANK, AP, AE, AL, DONE = range(10)
STATES, CLASSES = 10, 11

# The code points of White_Space.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Code points handled at once in a worker; longer texts are taken alone, whole.
CHUNK = 1 << 21
#: Slices remembered by a worker; the cache starts anew beyond it. Longer slices are merged each time.
CACHED_SLICES, CACHED_LENGTH = 1 << 18, 48


def step(state: int, kind: int) -> int:
    """The automaton: the state after a code point of class ``kind``."""
    if kind == SEP:
        return START
    if kind == SPACE:
        return AFTER_SPACE
    if kind == BLANK:
        return AFTER_BLANK
    if kind == NUMBER:
        return IN_NUMBERS
    if kind == OTHER:
        return IN_OTHERS
    if kind == APOSTROPHE:
        return IN_OTHERS if state in (IN_OTHERS, AP, AFTER_SPACE) else AP
    if state == AP:
        return {ONE_LETTER: DONE, WANTS_E: AE, WANTS_L: AL}.get(kind, IN_LETTERS)
    if (state, kind) in ((AE, LETTER_E), (AL, WANTS_L)):
        return DONE
    return IN_LETTERS


def opens(before: int, state: int) -> bool:
    """Whether a token starts at a code point, from the states before and after it.

    White space and unfinished contractions also depend on the next state; see ``boundaries``.
    """
    if state in (START, AP, AE, AL):
        return True
    if state in (AFTER_SPACE, AFTER_BLANK):
        return before not in (AFTER_SPACE, AFTER_BLANK)
    if state == IN_NUMBERS:
        return before not in (IN_NUMBERS, AFTER_SPACE)
    if state == IN_OTHERS:
        return before not in (IN_OTHERS, AP, AFTER_SPACE)
    if state == IN_LETTERS:
        return before not in (IN_LETTERS, AFTER_SPACE, AE, AL)
    return False  # DONE


@lru_cache(maxsize=1)
def automaton() -> dict[str, np.ndarray]:
    """Monoid of the transition functions: element of each class, composition table, values of constants."""
    functions = [tuple(step(s, c) for s in range(STATES)) for c in range(CLASSES)]
    number = {f: i for i, f in enumerate(dict.fromkeys(functions))}
    members = list(number)
    grown = 0
    while grown < len(members):
        f = members[grown]
        for g in dict.fromkeys(functions):
            h = tuple(g[x] for x in f)
            if h not in number:
                number[h] = len(members)
                members.append(h)
        grown += 1
    size = len(members)
    then = np.zeros((size, size), np.uint8 if size <= 256 else np.uint16)  # then[first, second]
    for i, f in enumerate(members):
        for j, g in enumerate(members):
            then[i, j] = number[tuple(g[x] for x in f)]
    return {
        "of_class": np.array([number[f] for f in functions], then.dtype),
        "then": then,
        "constant": np.array([len(set(f)) == 1 for f in members]),
        "value": np.array([f[START] for f in members], np.uint8),
        "opens": np.array([[opens(a, b) for b in range(STATES)] for a in range(STATES)]),
    }


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point, from the general category."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = BLANK
    table[0x20] = SPACE
    for text, kind in (("'", APOSTROPHE), ("stmd", ONE_LETTER), ("rv", WANTS_E), ("l", WANTS_L), ("e", LETTER_E)):
        table[[ord(c) for c in text]] = kind
    return table


def states(kinds: np.ndarray) -> np.ndarray:
    """The state after every position, by a doubling scan of the transition functions."""
    machine = automaton()
    scan = machine["of_class"][kinds]
    shift = 1
    while shift < len(scan) and not machine["constant"][scan[shift:]].all():
        scan = np.concatenate([scan[:shift], machine["then"][scan[:-shift], scan[shift:]]])
        shift *= 2
    return machine["value"][scan]


def boundaries(kinds: np.ndarray) -> np.ndarray:
    """True where a token starts; ``kinds`` begins and ends with SEP, and each SEP is a token."""
    state = states(kinds)
    start = np.empty(len(state), bool)
    start[0] = True
    start[1:] = automaton()["opens"][state[:-1], state[1:]]
    blank = (state == AFTER_SPACE) | (state == AFTER_BLANK)
    following = state[1:]
    # The last white space before a visible character is a token of its own, or opens that one's.
    start[:-1] |= blank[:-1] & ~blank[1:] & (following != START)
    # The letter of an unfinished contraction starts a token only if the contraction stays unfinished.
    start[:-1] &= ~(((state[:-1] == AE) | (state[:-1] == AL)) & (following == DONE))
    return start


class Merger(dict):
    """Ids of a slice by byte-pair merging, remembered by slice."""

    def __init__(self, vocabulary: str) -> None:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        # Only the merging is used; the pattern below never runs.
        self.core = tiktoken.Encoding(vocabulary, pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> list[int]:
        ids = self.core._encode_single_piece(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_SLICES:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def merger(vocabulary: str) -> Merger:
    return Merger(vocabulary)


def encode_batch(texts: list[str], vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, where each text's ids begin, and for each slice its code point offset and first id.

    The second array has one more entry than there are texts.
    """
    joined = "\n" + "\n".join(texts) + "\n"  # each of these line ends is made a separator below
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = class_table()[points]
    separators = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    kinds[separators] = SEP
    starts = np.flatnonzero(boundaries(kinds))
    first = np.searchsorted(starts, separators)  # the separators' own places among the tokens
    ends = np.append(starts[1:], len(joined))
    mask = np.ones(len(starts), bool)
    mask[first] = False
    starts, ends = starts[mask], ends[mask]
    look_up = merger(vocabulary)
    pieces = map(joined.__getitem__, map(slice, starts.tolist(), ends.tolist()))
    found = list(map(look_up.__getitem__, pieces))
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.fromiter(chain.from_iterable(found), np.int32, int(begin[-1]))
    slices_before = first - np.arange(len(first))
    return ids, begin[slices_before], starts - separators[np.searchsorted(separators, starts) - 1] - 1, begin[:-1]


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about CHUNK code points."""
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > CHUNK:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def shipped(spark: SparkSession, vocabulary: str) -> str:
    """The name by which tasks find a file of the driver, sent to every executor once. Files of different content need different names."""
    spark.sparkContext.addFile(vocabulary)
    return os.path.basename(vocabulary)


def _encoded(batches, vocabulary: str, make):
    vocabulary = SparkFiles.get(vocabulary)
    for batch in batches:
        texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
        at = 0
        for some in chunks(texts):
            yield make(batch.column(0).slice(at, len(some)), *encode_batch(some, vocabulary))
            at += len(some)


def encode_documents(docs: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY, offsets: bool = False) -> DataFrame:
    """(key, ids) of each row; with ``offsets`` also the slices' code point offsets and first positions in ids.

    Null and empty texts give the empty list; every row gives one row, also
    repeated ones and those with a null key.  Whole texts are encoded, however
    long.  Other columns are not read.
    """
    kind = docs.schema[key].dataType
    fields = [T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if offsets:
        fields += [T.StructField("offsets", T.ArrayType(T.IntegerType())), T.StructField("firsts", T.ArrayType(T.IntegerType()))]

    def make(keys, ids, begin, slice_start, slice_first):
        columns = [keys, pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))]
        if offsets:
            cuts = np.append(np.searchsorted(slice_first, begin[:-1]), len(slice_first))
            per_text = np.searchsorted(begin, slice_first, "right") - 1
            columns += [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int32())) for x in (slice_start, slice_first - begin[per_text])]
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    name = shipped(docs.sparkSession, vocabulary)

    def encode(batches):
        yield from _encoded(batches, name, make)

    return docs.select(key, text).mapInArrow(encode, T.StructType(fields))


def count_tokens(docs: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, n_tokens) of each row; 0 for null and empty texts."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_tokens", T.LongType())])

    def make(keys, _, begin, *__):
        return pa.RecordBatch.from_arrays([keys, pa.array(np.diff(begin), pa.int64())], names=[key, "n_tokens"])

    name = shipped(docs.sparkSession, vocabulary)

    def count(batches):
        yield from _encoded(batches, name, make)

    return docs.select(key, text).mapInArrow(count, schema)


def decode(ids: list[int], vocabulary: str = DEFAULT_VOCABULARY) -> str:
    """The text of a list of ids."""
    core = merger(vocabulary).core
    return b"".join(map(core.decode_single_token_bytes, ids)).decode("utf-8", "surrogatepass")
