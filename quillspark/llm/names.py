"""Variant spellings of names typed by people.

A name is read into the owner's words and a line of business.  Words that say
nothing about who it is (processor prefixes, articles, legal forms, a trailing
town and state) go, accents are folded and nicknames written out.

Variants are found by a pigeonhole segment join on the owner's letters: each
string is cut into three segments, at least one of which survives two edits, so
every string looks up its position-shifted substrings in an inverted index of
the segments of other names in the same line of business.  A second set of cuts,
one place further, keeps swaps of neighbours that cross a cut of the first.
Where they meet, candidates whose letters differ by more than the allowed edits
are left out, before any pair is written.  The rest are verified by banded edit
distance, then by the distance that counts a swap as one edit.

Initials and words written without vowels lose more than two letters.  They are
looked up as views of full names, and count only if all full names they fit are
the same owner.  A name without vowels may also be a whole one (Lynch, Byrd), so
it goes through the segment join as well; one with an initial does not.  Links
close to groups, and every pair of a group is reported.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .components import components

# Words of a line of business, with the short forms and other words in use for it.
LINES = {
    "dental": ["dental clinic", "dntl clinic", "dental", "dentist", "clinic", "dental clnc"],
    "electric": ["electric", "electr", "elec", "power"],
    "noodles": ["noodle house", "noodle hse", "ndl house", "ndl hse", "noodles", "noodle"],
    "restaurant": ["restaurant", "restrnt", "restaurnt", "rest", "rstrnt", "diner"],
    "streaming": ["streaming", "streamng", "stream", "strm"],
    "auto": ["auto repair", "auto rpr", "auto", "garage"],
    "cinema": ["cinema", "cine", "movies"],
    "books": ["books", "bookstore", "bookshop", "bks"],
    "hardware": ["hardware", "hdwe", "hdwr", "tools"],
    "coffee": ["coffee", "coffe", "cof", "cafe"],
    "pharmacy": ["pharmacy", "pharm", "phcy", "drugstore"],
    "property": ["property mgmt", "property management", "property mgt", "prop mgt", "prop mgmt", "properties"],
    "wireless": ["wireless", "wireles", "wrls", "mobile"],
    "fitness": ["fitness", "fitnes", "fit club", "gym"],
    "bakery": ["bakery", "bkry", "bakeshop", "bakers"],
    "laundry": ["laundry", "lndry", "laundromat", "cleaners"],
    "market": ["market", "mrkt", "mkt", "mart"],
    "travel": ["travel agency", "trvl agcy", "travel", "tours"],
}
# Processor prefixes, forms of address, legal forms, and the codes of states.
PREFIXES = set("pos sq tst qr pp paypal purchase".split())
COURTESY = set("mr mrs ms miss dr".split())
LEGAL = set("llc ltd inc co corp gmbh plc company".split())
STATES = set(
    "al ak az ar ca co ct de dc fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa "
    "wv wi wy".split()
)
# Short forms of given names.
NICKNAMES = {
    "anthony": "tony ant", "charles": "chuck charlie chas", "dorothy": "dot dottie dolly", "edward": "ed eddie ned", "elizabeth": "liz beth betty lizzie eliza betsy",
    "james": "jim jimmy jamie", "katherine": "kate kathy katie kat kitty", "margaret": "maggie peggy meg marge", "rebecca": "becky becca", "richard": "rick dick rich richie",
    "robert": "bob rob bobby robbie", "susan": "sue susie suzy", "theodore": "ted teddy theo", "william": "bill will billy willy liam", "michael": "mike mick", "joseph": "joe joey",
    "thomas": "tom tommy", "jennifer": "jen jenny", "patricia": "pat patty trish", "daniel": "dan danny", "matthew": "matt", "andrew": "andy drew", "christopher": "chris kit",
    "nicholas": "nick", "samuel": "sam sammy", "benjamin": "ben benny", "alexander": "alex al", "victoria": "vicky tori", "deborah": "deb debbie", "barbara": "barb babs",
    "stephen": "steve", "steven": "steve", "gregory": "greg", "lawrence": "larry", "raymond": "ray", "ronald": "ron", "donald": "don", "kenneth": "ken", "timothy": "tim",
    "frederick": "fred freddy", "gerald": "gerry jerry", "leonard": "len lenny", "pamela": "pam", "sandra": "sandy", "cynthia": "cindy", "catherine": "cathy cate", "jacqueline": "jackie",
}

# Letters written for the same sound.
SOUND_FROM, SOUND_TO = "wcyq", "vkjk"
SOUNDS = str.maketrans(SOUND_FROM, SOUND_TO)

GIVEN = {short: full for full, shorts in NICKNAMES.items() for short in shorts.split()} | {full: full for full in NICKNAMES}
PHRASES = {tuple(phrase.split()): line for line, phrases in LINES.items() for phrase in phrases}
LONGEST = max(map(len, PHRASES))
#: Stands for the given name that a form of address replaces.
UNNAMED = "~"
SEGMENTS = 3
EDITS = SEGMENTS - 1


def swap_distance(a: str, b: str, most: int) -> int:
    """Edits between two strings, a swap of neighbours counting one; ``most`` + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        new = [most + 1] * (len(b) + 1)
        new[0] = i if i <= most else most + 1
        for j in range(low, high + 1):
            y = b[j - 1]
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before and j > 1 and i > 1 and x == b[j - 2] and a[i - 2] == y:
                new[j] = min(new[j], before[j - 2] + 1)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def near_line(words: tuple[str, ...]) -> str | None:
    """The line of business of these words, allowing one edit in each longer word."""
    if words in PHRASES:
        return PHRASES[words]
    for phrase, line in PHRASES.items():
        if len(phrase) == len(words) and all(x == y or (len(y) >= 5 and swap_distance(x, y, 1) <= 1) for x, y in zip(words, phrase)):
            return line
    return None


def read_name(name: str) -> tuple[str, list[str]]:
    """(line of business, words of the owner); the line is 'person' for people and '' where none is known."""
    text = unicodedata.normalize("NFKD", name.casefold())
    text = "".join(c for c in text if not unicodedata.combining(c))
    if text.count(",") == 1:
        back, front = text.split(",")
        text = f"{front} {back}"
    text = re.sub(r"['’]s\b", "", text)
    words = re.findall(r"[^\W_]+", text)
    while len(words) > 1 and words[0] in PREFIXES:
        words = words[1:]
    if len(words) > 3 and words[0] == "the":  # before a shorter name it may be a damaged word of it
        words = words[1:]
    # What may stand after the name: nothing, a legal form, a town and its state, or both.
    tails = [words]
    if len(words) > 1 and words[-1] in LEGAL:
        tails.append(words[:-1])
    for shorter in list(tails):
        if len(shorter) >= 4 and shorter[-1] in STATES:
            tails.append(shorter[:-2])
    for kept in tails:
        if line := line_of(kept):
            return line
    words = tails[-1]
    if words[:1] and words[0] in COURTESY and len(words) > 2:
        return "person", [UNNAMED, *words[1:]]
    given = [i for i, w in enumerate(words) if w in GIVEN]
    if given and len(words) > 1:
        at = given[0]  # a given name in another place was moved there
        return "person", [GIVEN[words[at]], *words[at + 1 :], *words[:at]]
    return ("person" if len(words) >= 3 else ""), words


def line_of(words: list[str]) -> tuple[str, list[str]] | None:
    """The line of business that the words end or begin with, and the other words."""
    for size in range(min(LONGEST, len(words) - 1), 0, -1):
        for part, rest in ((words[-size:], words[:-size]), (words[:size], words[size:])):
            line = near_line(tuple(part))
            if line:
                return line, rest
    return None


READ = T.StructType([T.StructField("line", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))])


@F.pandas_udf(READ)
def read_names(names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_name(n) for n in names], columns=["line", "words"])


def compared(line: str, words: list[str]) -> list[str]:
    """The letters that the index is built on: a person's without the given name, which too many share."""
    return forms(words[1:] if line == "person" and len(words) > 1 else words)


def forms(words: list[str]) -> list[str]:
    """The letters of the words, and with those that spell the same sound made alike."""
    plain = "".join(words)
    alike = sound(words)
    return [plain] if plain == alike else [plain, alike]


def sound(words: list[str]) -> str:
    return "".join(words).replace("ph", "f").translate(SOUNDS)


def within(a: list[str], b: list[str], most: int) -> bool:
    """Whether two owners' words are within ``most`` edits, as written or as they sound."""
    x, y = forms(a), forms(b)
    return any(swap_distance(p, q, most) <= most for p, q in {(x[0], y[0]), (x[-1], y[-1])})


#: Letters counted in ``letters``, three bits each: those that stay apart in ``sound`` and have no part in "ph", and two for all other characters.
COUNTED = {c: i for i, c in enumerate("abdegijklmnorstuvxz")}


def letters(words: list[str]) -> int:
    """Which letters the words have at least once, twice and three times, alike for both forms and for each order of the words.

    An edit takes away one bit at most and adds one at most, a swap none.
    """
    seen: dict[int, int] = {}
    for c in "".join(words).translate(SOUNDS):
        if c not in "phf":
            at = COUNTED.get(c, len(COUNTED) + ord(c) % 2)
            seen[at] = seen.get(at, 0) + 1
    return sum((1 << min(n, 3)) - 1 << 3 * at for at, n in seen.items())


@F.pandas_udf(T.LongType())
def letters_of(words: pd.Series) -> pd.Series:
    return pd.Series([letters(list(w)) for w in words], dtype="int64")


def cuts(length: int) -> Iterator[tuple[int, int, int]]:
    """(number of segment, start, end) of the segments of a string, for both sets of cuts."""
    for shift in (0, 1):
        edges = [0, *(min(length, length * i // SEGMENTS + shift) for i in range(1, SEGMENTS)), length]
        for i in range(SEGMENTS):
            yield shift * SEGMENTS + i, edges[i], edges[i + 1]


def shortened(text: str) -> Iterator[tuple[int, int, str]]:
    """A short string and what is left of it without a letter: two such within an edit, of which one is too short to cut, agree in one of these."""
    for part in {text, *(text[:i] + text[i + 1 :] for i in range(len(text)))} - {""}:
        yield 0, -1, part


def indexed(text: str) -> Iterator[tuple[int, int, str]]:
    if len(text) < SEGMENTS:
        yield from shortened(text)
        return
    for number, begin, end in cuts(len(text)):
        yield len(text), number, text[begin:end]


def probed(text: str) -> Iterator[tuple[int, int, str]]:
    """Substrings at which a segment of a string within EDITS edits may lie; of a string too short to cut, within one edit."""
    if len(text) <= SEGMENTS:
        yield from shortened(text)
    for length in range(len(text) - EDITS, len(text) + EDITS + 1):
        if length < SEGMENTS:
            continue
        extra = len(text) - length
        for number, begin, end in cuts(length):
            i = number % SEGMENTS
            # Not more than i edits to the left of segment i, nor EDITS - i to its right.
            for at in range(max(begin - i, begin + extra - (EDITS - i)), min(begin + i, begin + extra + EDITS - i) + 1):
                if 0 <= at and at + end - begin <= len(text):
                    yield length, number, text[at : at + end - begin]


def turned(words: list[str]) -> list[list[str]]:
    """The words in each order that moves words from the front to the end."""
    return [words[i:] + words[:i] for i in range(len(words))]


ENTRY = T.ArrayType(T.StructType([T.StructField("length", T.IntegerType()), T.StructField("number", T.IntegerType()), T.StructField("part", T.StringType())]))


@F.pandas_udf(ENTRY)
def index_entries(lines: pd.Series, words: pd.Series) -> pd.Series:
    return pd.Series([list(dict.fromkeys(e for form in compared(n, list(w)) for e in indexed(form))) for n, w in zip(lines, words)])


@F.pandas_udf(ENTRY)
def probe_entries(lines: pd.Series, words: pd.Series) -> pd.Series:
    return pd.Series([list(dict.fromkeys(e for order in orders(n, list(w)) for form in compared(n, order) for e in probed(form))) for n, w in zip(lines, words)])


def orders(line: str, words: list[str]) -> list[list[str]]:
    return [words] if line == "person" else turned(words)


def nearly(x: str, y: str) -> Column:
    """Whether some order of the words of column x is within the banded edit distance of those of y; a swap costs two there."""
    words, size = F.col(x), F.size(x)
    plain = F.array_join(y, "")
    orders_of = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.array_join(F.slice(words, i, size), ""), F.array_join(F.slice(words, F.lit(1), i - 1), "")))
    alike = lambda t: F.translate(F.replace(t, F.lit("ph"), F.lit("f")), SOUND_FROM, SOUND_TO)
    within_band = lambda p, q: F.levenshtein(p, q, 2 * EDITS) >= 0
    return F.exists(orders_of, lambda o: within_band(o, plain) | within_band(alike(o), alike(plain)))


@F.pandas_udf(T.BooleanType())
def same_owner(lines: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether some order of one owner's words is within the allowed edits of the other's."""

    def one(line, x, y):
        x, y = sorted((list(x), list(y)), key=len, reverse=True)
        if line == "person":  # the given name is compared as well
            return within(x, y, EDITS)
        most = EDITS if sum(map(len, y)) >= 8 else 1
        return any(within(order, y, most) for order in turned(x))

    return pd.Series([one(*row) for row in zip(lines, a, b)], dtype=bool)


VIEW = T.ArrayType(T.StringType())


def bare(word: str) -> str:
    """A word without its vowels, but for the first letter."""
    return word[0] + re.sub("[aeiou]", "", word[1:])


@F.pandas_udf(T.StructType([T.StructField("own", T.StringType()), T.StructField("full", VIEW), T.StructField("typed", T.BooleanType())]))
def views(lines: pd.Series, words: pd.Series) -> pd.DataFrame:
    """``own``: the view by which a shortened name is looked up; ``full``: the views of a full name; ``typed``: whether no word is an initial."""

    def one(line, given):
        given = list(given)
        if len(given) < 2:
            return None, [], True
        short = [i for i, w in enumerate(given) if len(w) == 1 or w == UNNAMED or (len(w) > 1 and w.isalpha() and bare(w) == w)]
        if len(short) == len(given):
            return None, [], True
        if short:
            return "|".join([line, *given]), [], all(len(given[i]) > 1 and given[i] != UNNAMED for i in short)
        made = []
        for i, w in enumerate(given):
            for form in (w[0], bare(w), re.sub("[aeiou]", "", w), *([UNNAMED] if line == "person" and not i else [])):
                if form and form != w:
                    made.append("|".join([line, *given[:i], form, *given[i + 1 :]]))
        return None, list(dict.fromkeys(made)), True

    return pd.DataFrame([one(*row) for row in zip(lines, words)], columns=["own", "full", "typed"])


class NameGroups:
    """The names of a column that stand for one owner.

    Null and empty names, and names without a letter or digit, belong to no
    group.  Names are compared once however many rows have them, so repeated
    rows and hot names cost nothing; names of other lines of business are never
    compared.  Empty tables give empty results, other columns are ignored.
    """

    def __init__(self, rows: DataFrame, name: str) -> None:
        # Cut here, else the planner reads every row's name before it takes the distinct ones.
        distinct = cut(rows.select(F.col(name).alias("name")).where(F.col("name") != "").distinct())
        read = distinct.withColumn("read", read_names("name")).select("name", "read.line", "read.words").where(F.size("words") > 0)
        # The id stands for the name in what is shuffled; it stays as it is, since this is cut.
        self.names = cut(read.withColumns({"view": views("line", "words"), "letters": letters_of("words"), "id": F.monotonically_increasing_id()}))
        self.strong = cut(self._strong())
        self.roots = cut(self._roots())

    def _candidates(self) -> DataFrame:
        """(a, b): ids of names that meet in the index and whose letters don't tell them apart."""
        full = self.names.where(F.col("view.typed"))

        def entries(function, side):
            # Entries travel as hashes; a collision only adds a candidate.
            rows = full.select("id", "letters", F.col("line").alias("l"), F.explode(function("line", "words")).alias("e"))
            return rows.select(F.xxhash64("l", "e.length", "e.number", "e.part").alias("entry"), F.col("id").alias(side), F.col("letters").alias(f"of_{side}"))

        # In the join, not after it: in a large line of business most names that share a segment have nothing else in common, and their pairs grow with the square of the names.
        lacks = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(y))) <= EDITS
        met = entries(index_entries, "a").join(entries(probe_entries, "b"), "entry").where((F.col("a") != F.col("b")) & lacks("of_a", "of_b") & lacks("of_b", "of_a"))
        return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def _strong(self) -> DataFrame:
        words = self.names.select("id", "line", F.struct("name", "words").alias("n"))
        both = self._candidates().join(words.select(F.col("id").alias("a"), "line", F.col("n").alias("m")), "a").join(
            words.select(F.col("id").alias("b"), F.col("line").alias("other"), "n"), "b"
        )
        both = both.where("line = other").select("line", F.least("m", "n").alias("m"), F.greatest("m", "n").alias("n"))
        both = both.select("line", F.col("m.name").alias("a"), F.col("m.words").alias("x"), F.col("n.name").alias("b"), F.col("n.words").alias("y"))
        close = both.where(nearly("x", "y") | nearly("y", "x"))
        return close.where(same_owner("line", "x", "y")).select("a", "b")

    def _roots(self) -> DataFrame:
        """(name, root): the groups of full names, with shortened ones that fit a single group."""
        grouped = components(self.strong)
        rooted = self.names.join(grouped.withColumnRenamed("node", "name"), "name", "left").withColumn("linked", F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "name"))
        full = rooted.where(F.col("view.own").isNull()).select("root", F.explode("view.full").alias("own")).distinct()
        single = full.groupBy("own").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low = high")
        short = rooted.where(F.col("view.own").isNotNull()).select("name", "root", "linked", F.col("view.own").alias("own"))
        found = cut(short.join(single, "own", "left").select("name", "root", "linked", "low", "own"))
        alone = found.where("not linked").select("name", F.coalesce("low", "own").alias("root"))
        named = rooted.where(F.col("view.own").isNull()).select("name", "root").unionByName(alone).unionByName(found.where("linked").select("name", "root"))
        # Names without vowels that are within edits of others stay with them, and bring the group that their view fits.
        both = found.where("linked and low is not null and low <> root").select("root", "low").distinct()
        if both.isEmpty():
            return named
        joined = components(both, "root", "low").withColumnsRenamed({"node": "root", "root": "first"})
        return named.join(joined, "root", "left").select("name", F.coalesce("first", "root").alias("root"))

    def groups(self) -> DataFrame:
        """(name, group_id, group_size): the smallest name of each name's group."""
        sized = self.roots.groupBy("root").agg(F.min("name").alias("group_id"), F.count("*").alias("group_size"))
        return self.roots.join(sized, "root").select("name", "group_id", "group_size")

    def pairs(self) -> DataFrame:
        """(key_a, key_b), key_a < key_b: every pair of each group."""
        a, b = self.roots.withColumnRenamed("name", "key_a"), self.roots.withColumnRenamed("name", "key_b")
        return a.join(b, "root").where("key_a < key_b").select("key_a", "key_b")
