"""Repair of text from scanned pages.

Lines are labelled by a left-to-right hidden Markov model (``hmm``): running
heads and page numbers may open a page, then body lines and breaks alternate,
then heads and numbers may close it.  Its transitions and emissions are fitted
by Viterbi training to the pages themselves.  What a line looks like is measured over
the whole table: how often its letters stand near the ends of scanned pages and
how often elsewhere, whether a clean page has it, whether its number moves in
step with the page; and on its page: its length, ending and indent.

Clean pages also give the words and characters that there are.  A line end is a
word break if the two parts join to such a word and the hyphenated form is none.
A word is misread if it isn't among them but becomes one when characters that
scanners take for one another are made alike.  Lookups are joins on words, so no
vocabulary is sent to all tasks.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, written
from .hmm import BLANK, FEATURES, KINDS, LineModel, batches, packed
from .names import swap_distance

#: Lines that aren't blank at either end of a page whose letters and numbers are compared with those of other pages.
ZONE = 4
#: One part in so many is a good share: of a source's pages that a head stands on, or that have a number in step.
SHARE = 5
#: Pages that the model is fitted to, at most; which ones is decided by a hash of their number.
FIT_PAGES = 10_000
# Marks that end a broken word; the last three are never part of a word.
MARKS = "-‐–¬\xad"
HARD_MARKS = "¬\xad"
# Characters that scanners take for one another, single and in pairs.
ALIKE = ("01!|5$@†cbi", "olllssatehl")
PAIRS = (("rn", "m"), ("ii", "u"), ("cl", "d"), ("vv", "w"))
# Letters read for digits.
DIGIT_LIKE = str.maketrans("OolIiSBZ", "00111582")

#: A capitalised word on at least this share of the clean pages is no name.
NAME_SHARE = 0.02

ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
NUMBERED = [
    ("pages", re.compile(r"(?:第\s*([\dOolISBZ]+)\s*页|page\s+([\dOolISBZ]+)\s+(?:of|0f)|([\dOolISBZ]+)\s*/\s*[\dOolISBZ]+$).*", re.I)),
    ("framed", re.compile(r"(?:p\.\s*|[-—–·•~\[(]\s*)([\dOolISBZ]+)\s*[-—–·•~\])]?$", re.I)),
    ("roman", re.compile(r"(?=1*[ivxlc])([ivxlc1]+)$")),
    ("plain", re.compile(r"([\dOolISBZ]{1,4})$")),
]


def page_number(line: str) -> tuple[str, int] | None:
    """(style, value) of a line that is only a page number."""
    text = line.strip()
    for style, pattern in NUMBERED:
        found = pattern.match(text)
        if not found:
            continue
        digits = next(g for g in found.groups() if g)
        if style == "roman":
            digits = digits.replace("1", "i")
            values = [ROMAN[c] for c in digits]
            return style, sum(-v if any(w > v for w in values[i + 1 : i + 2]) else v for i, v in enumerate(values))
        digits = digits.translate(DIGIT_LIKE)
        if digits.isdigit():
            return style, int(digits)
    return None


def folded(text: Column) -> Column:
    """The text with characters that are taken for one another made alike."""
    x = F.translate(F.lower(text), *(s[:8] for s in ALIKE))
    for wrong, right in PAIRS:
        x = F.replace(x, F.lit(wrong), F.lit(right))
    return F.translate(x, *(s[8:] for s in ALIKE))


def head_key(line: Column) -> Column:
    """The letters of a line, folded, without numbers: what running heads have in common."""
    bare = F.regexp_replace(line, r"(?<![\p{L}])[\dOolISBZ]+(?![\p{L}])", "")
    return F.regexp_replace(folded(bare), r"[^\p{L}]", "")


@F.pandas_udf(T.StructType([T.StructField("style", T.StringType()), T.StructField("value", T.LongType())]))
def page_numbers(lines: pd.Series) -> pd.DataFrame:
    found = [page_number(x) or (None, None) for x in lines]
    return pd.DataFrame({"style": pd.Series([s for s, _ in found], dtype=object), "value": pd.Series([v for _, v in found], dtype="Int64")})


@F.pandas_udf(T.BooleanType())
def near_head(keys: pd.Series, heads: pd.Series) -> pd.Series:
    """Whether a line's key is a source's running head up to one wrong character in five."""

    def one(key, known):
        if known is None or not key or len(key) < 4:
            return False
        most = (len(key) + 4) // 5
        return any(swap_distance(key, h, most) <= most for h in known)

    return pd.Series([one(k, h) for k, h in zip(keys, heads)], dtype=bool)


#: Values of a line's features: its letters and its number.
OTHER, CLEAN, RUNNING, NEARLY = range(4)
NO_FIGURE, NAMED, IN_STEP, IN_ROMAN, BARE = range(5)


def page_codes(lines: list[str], known: dict[int, tuple[int, int]]) -> list[int]:
    """The features of each line of a page as one number, BLANK for a blank line; ``known`` has letters and number of the lines near the ends."""
    widths = {i: width(line.strip()) for i, line in enumerate(lines) if line.strip()}
    widest = max(widths.values(), default=1)
    codes = []
    for i, line in enumerate(lines):
        if i not in widths:
            codes.append(BLANK)
            continue
        share = widths[i] / widest
        lead = len(line) - len(line.lstrip())
        values = (
            *known.get(i, (OTHER, NO_FIGURE)), (share >= 0.35) + (share >= 0.75),
            int(line.rstrip()[-1] in MARKS), (lead > 0) + (lead > 4),
        )
        code = 0
        for value, size in zip(reversed(values), reversed(FEATURES.values())):
            code = code * size + value
        codes.append(code)
    return codes


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def coded(lines: pd.Series, zones: pd.Series) -> pd.Series:
    def one(page, known):
        return page_codes(list(page), {} if known is None else {z["line_no"]: (z["letters"], z["figure"]) for z in known})

    return pd.Series([one(*row) for row in zip(lines, zones)])


def labels_by(model: LineModel):
    """The labels of pages of codes, by a fitted model."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def labels(codes: pd.Series) -> pd.Series:
        pages = [list(c) for c in codes]
        found: list = [None] * len(pages)
        for some in batches(pages):
            for i, states in zip(some, model.decode(packed([pages[i] for i in some]))):
                found[i] = [KINDS[s] for s in states[: len(pages[i])]]
        return pd.Series(found)

    return labels


#: A run of letters, and of characters that stand in for letters; Chinese is judged by character instead.
WORD = r"[[\p{L}&&[^\p{IsHan}]]\d!|$@†'’]+"
#: A run of digits and letters read for digits, with at least one of each, or such a letter alone.
ODD_NUMBER = r"(?<![\p{IsLatin}\d])(?=[\dOolISBZ.,/-]*[OolISBZ])(?=[\dOolISBZ.,/-]*\d)[\dOolISBZ][\dOolISBZ.,/-]*(?![\p{IsLatin}])|(?<![\p{IsLatin}\d'])[OolSBZ](?![\p{IsLatin}\d'])"

#: What every odd number has, found more cheaply.
MAYBE_ODD = r"[\d.,/-][OolISBZ]|[OolISBZ][\d.,/-]|(?<![\p{IsLatin}\d'])[OolSBZ](?![\p{IsLatin}\d'])"


class ScannedPages:
    """The labelled lines and repaired paragraphs of a table of pages.

    Pages whose ``method`` does not name ocr are taken as clean.  A null page
    number is read from ``location``; null texts have no lines, null sources
    are a source of their own.  Repeated rows give repeated lines with the same
    labels.  Texts are taken whole; other columns are ignored.
    """

    def __init__(self, parts: DataFrame) -> None:
        self.parts = parts.where(F.col("text").isNotNull()).select(
            F.col("part_id").cast("long").alias("part_id"),
            F.coalesce("source", F.lit("")).alias("source"),
            F.coalesce(F.col("page").cast("long"), F.expr("try_cast(regexp_extract(location, '([0-9]+)', 1) as bigint)"), F.lit(0)).alias("page"),
            F.coalesce(F.col("method").contains("ocr"), F.lit(False)).alias("scanned"),
            F.split("text", "\n").alias("lines"),
        )
        self.lines = written(self._labelled())
        self.kinds = cut(self._kinds())

    def _zones(self) -> DataFrame:
        """(part_id, line_no, letters, figure): what the lines near the ends of scanned pages are like on other pages."""
        # The lines that aren't blank, each with its place among them.
        shown = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("line_no"), x.alias("line"))), lambda x: F.trim(x["line"]) != "")
        visible = self.parts.select("source", "part_id", "page", "scanned", shown.alias("shown")).select("source", "part_id", "page", "scanned", F.size("shown").alias("n"), F.posexplode("shown").alias("rank", "x"))
        near = F.col("scanned") & ((F.col("rank") < ZONE) | (F.col("rank") >= F.col("n") - ZONE))
        keyed = visible.select("source", "part_id", "page", "scanned", near.alias("zone"), "x.line_no", "x.line").withColumn("key", head_key(F.col("line"))).withColumn("hash", F.xxhash64("key"))
        # A running head stands on a good share of the pages, two or more, of nearly every source that has it, near the end, and on no clean page.
        page = F.when(F.col("zone"), F.col("part_id"))
        sizes = self.parts.where("scanned").groupBy("source").agg(F.count("*").alias("pages"))
        by_source = keyed.where("key <> ''").groupBy("hash", "source").agg(
            (F.count_if("zone") > 0).cast("int").alias("there"), (F.min(page) < F.max(page)).alias("several"),
            F.count(F.when(F.col("zone"), 1)).alias("near"), F.count(F.when(~F.col("zone") & F.col("scanned"), 1)).alias("inside"), F.count(F.when(~F.col("scanned"), 1)).alias("clean"),
        )
        again = F.col("several") & (F.col("near") * SHARE >= F.col("pages"))
        counts = by_source.join(sizes, "source", "left").groupBy("hash").agg(
            F.count(F.when(again, 1)).alias("repeated"), F.sum("there").alias("sources"), F.sum("near").alias("near"), F.sum("inside").alias("inside"), F.sum("clean").alias("clean"),
        )
        running = (F.col("clean") == 0) & (F.col("near") > F.col("inside")) & (F.col("repeated") > 0) & (F.col("repeated") * 3 >= F.col("sources"))
        letters = counts.where("near > 0").select("hash", F.when(running, RUNNING).when(F.col("clean") > 0, CLEAN).otherwise(OTHER).alias("letters")).where(F.col("letters") != OTHER)
        zones = keyed.where("zone").join(letters, "hash", "left").withColumn("number", page_numbers("line"))
        # A line without letters is no head, like one that a clean page has.
        zones = zones.withColumn("letters", F.when(F.col("key") == "", CLEAN).otherwise(F.coalesce("letters", F.lit(OTHER))))
        known = zones.where(F.col("letters") == RUNNING).groupBy("source").agg(F.collect_set("key").alias("heads"))  # a source has a few heads
        steps = zones.where(F.col("number.style").isNotNull()).select("source", "part_id", "number.style", (F.col("number.value") - F.col("page")).alias("step"))
        # Numbers of a table are in step with a page or two by chance; those of pages on a good share of the source's pages.
        met = steps.groupBy("source", "style", "step").agg((F.min("part_id") < F.max("part_id")).alias("several"), F.count("*").alias("n"))
        steady = met.join(sizes, "source").select("source", "style", "step", (F.col("several") & (F.col("n") * SHARE >= F.col("pages"))).alias("again"))
        judged = (
            zones.withColumn("style", F.col("number.style")).withColumn("step", F.col("number.value") - F.col("page"))
            .join(steady, ["source", "style", "step"], "left").join(known, "source", "left")
        )
        figure = (
            F.when(F.col("style").isNull(), NO_FIGURE).when(F.col("style").isin("pages", "framed"), NAMED).when(F.col("again"), IN_STEP).when(F.col("style") == "roman", IN_ROMAN).otherwise(BARE)
        )
        like = F.when(F.col("style").isNotNull(), OTHER).when((F.col("letters") == OTHER) & near_head("key", "heads"), NEARLY).otherwise(F.col("letters"))
        return judged.select("part_id", "line_no", like.alias("letters"), figure.alias("figure")).distinct()

    def _labelled(self) -> DataFrame:
        """(part_id, source, page, scanned, line_no, line, label): every line; labels are null on clean pages."""
        zones = self._zones().groupBy("part_id").agg(F.collect_list(F.struct("line_no", "letters", "figure")).alias("zones"))  # 2 ZONE lines of a page
        pages = written(self.parts.where("scanned").join(zones, "part_id", "left").withColumn("codes", coded("lines", "zones")).drop("zones"))
        some = pages.select("part_id", "codes").orderBy(F.xxhash64("part_id"), "part_id").limit(FIT_PAGES).select("codes").collect()
        self.model = LineModel.prior().fitted([r["codes"] for r in some])
        scanned = pages.withColumn("labels", labels_by(self.model)("codes"))
        rows = scanned.select("part_id", "source", "page", "scanned", F.posexplode(F.arrays_zip("lines", "labels")).alias("line_no", "l")).select(
            "part_id", "source", "page", "scanned", "line_no", F.col("l.lines").alias("line"), F.col("l.labels").alias("label")
        )
        clean = self.parts.where(~F.col("scanned")).select("part_id", "source", "page", "scanned", F.posexplode("lines").alias("line_no", "line")).withColumn(
            "label", F.when(F.trim("line") == "", "break").otherwise("body")
        )
        return rows.unionByName(clean)

    def _kinds(self) -> DataFrame:
        """(part_id, line_no, kind, joined): what is wrong with each line of the scanned pages."""
        body = self.lines.where("label = 'body'")
        # The next body line of the same page, or the first of the next page, by a join of a page's own list.
        pages = body.groupBy("source", "page", "part_id", "scanned").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("own"))
        first = pages.groupBy("source", "page").agg(F.min(F.struct("part_id", F.element_at("own", 1)["line"].alias("line")))["line"].alias("next_page"))
        follows = first.select("source", (F.col("page") - 1).alias("page"), "next_page")
        linked = pages.join(follows, ["source", "page"], "left")
        rest = F.concat(F.transform(F.slice("own", 2, F.size("own")), lambda x: x["line"]), F.array("next_page"))
        before = F.concat(F.array(F.lit(None).cast("string")), F.transform("own", lambda x: x["line"]))
        ending = rf"([\p{{L}}\d!|$@†]+)([{MARKS}])[ \t　]*$"
        opening = r"^[ \t　]*([\p{L}\d!|$@†]+)"
        found = lambda text, pattern, group: F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group)
        zipped = F.arrays_zip(F.col("own").alias("own"), rest.alias("next"), F.slice(before, 1, F.size("own")).alias("last"))
        # Of the neighbours only the parts of words at the line ends are kept.
        # A look at the last character spares most lines the search.
        broken_off = lambda text: F.coalesce(F.right(F.rtrim(text), F.lit(1)).isin(*MARKS) | text.rlike(rf"[{MARKS}][\t　 ]+$"), F.lit(False))
        near = linked.select("part_id", "scanned", F.explode(zipped).alias("z")).select(
            "part_id", "scanned", "z.own.line_no", "z.own.line", "z.next", "z.last", broken_off(F.col("z.own.line")).alias("off"), broken_off(F.col("z.last")).alias("last_off")
        ).select(
            "part_id", "scanned", "line_no", "line", F.when(F.col("off"), found(F.col("line"), ending, 1)).otherwise("").alias("left"), F.when(F.col("off"), found(F.col("line"), ending, 2)).otherwise("").alias("mark"),
            F.when(F.col("off"), found(F.col("next"), opening, 1)).otherwise("").alias("right"), F.when(F.col("last_off"), found(F.col("last"), ending, 1)).otherwise("").alias("left_before"),
        )
        near = written(near)
        broken = near.withColumn("joined", F.when((F.col("left") != "") & (F.col("right") != "") & F.col("right").rlike(r"^\p{Ll}|^[\d!|$@†]+\p{Ll}"), F.concat("left", "right")))
        scanned = broken.where("scanned")

        words = lambda text: F.filter(F.regexp_extract_all(text, F.lit(rf"({WORD})"), 1), lambda w: w.rlike(r"[\p{L}†@]"))
        clean = near.where(~F.col("scanned"))
        vocabulary = clean.select(F.explode(words(F.lower("line"))).alias("word")).distinct()
        compounds = clean.select(F.explode(F.regexp_extract_all(F.lower("line"), F.lit(r"(\p{L}+(?:-\p{L}+)+)"), 1)).alias("compound")).distinct()
        characters = clean.select(F.explode(F.array_distinct(F.split("line", ""))).alias("character")).distinct()
        # Words that can have been meant: those that clean pages write in lower case, or on many pages with a capital, unlike names.
        used = clean.select("part_id", F.explode(words(F.col("line"))).alias("word")).groupBy("word").agg(F.count_distinct("part_id").alias("pages"))
        enough = max(2, clean.select("part_id").distinct().count() * NAME_SHARE)
        usual = used.where(F.col("word").rlike(r"^\p{Ll}") | (F.col("pages") >= enough))
        meant = usual.select(F.lower("word").alias("word"), "pages", folded(F.col("word")).alias("form"), F.col("word").rlike(r"^\p{Lu}").alias("capital"))
        forms = meant.select("form").distinct()

        # Broken words: the two parts join to a word, and are no compound.
        asked = scanned.where(F.col("joined").isNotNull()).select(
            "part_id", "line_no", "mark", "right", F.lower("joined").alias("joined"), folded(F.col("joined")).alias("form"),
            F.lower(F.concat("left", F.lit("-"), "right")).alias("compound"),
        )
        answered = (
            asked.join(forms.withColumn("word_like", F.lit(True)), "form", "left")
            .join(compounds.withColumn("is_compound", F.lit(True)), "compound", "left")
        )
        hyphen = answered.where(
            (F.col("word_like") & F.col("is_compound").isNull()) | F.col("mark").isin(*HARD_MARKS)
        ).select("part_id", "line_no", F.lit(True).alias("hyphen"))

        # Misread words and characters. The parts of broken words are not words of their own.
        begun = F.when(F.col("left_before") != "", F.regexp_replace("line", opening, "")).otherwise(F.col("line"))
        kept = F.when(F.col("left") != "", F.regexp_replace(begun, ending, "")).otherwise(begun)
        tokens = scanned.select("part_id", "line_no", F.explode(F.array_distinct(words(kept))).alias("token"))
        distinct = tokens.select("token").distinct().withColumn("word", F.lower("token")).withColumn("form", folded(F.col("token")))
        unknown = distinct.join(vocabulary, "word", "left_anti")
        # A word with a capital must be meant as one that is written so, or it is a name.
        capital = unknown.withColumn("capital", F.col("token").rlike(r"^\p{Lu}"))
        best = lambda rows: rows.groupBy("form").agg(F.max_by("word", F.struct("pages", "word")).alias("right"))
        wrong = (
            capital.where("capital").join(best(meant.where("capital")), "form").unionByName(capital.where("not capital").join(best(meant), "form"))
            .select("token", F.when(F.col("capital"), F.initcap("right")).otherwise(F.col("right")).alias("right"))
        )
        by_word = tokens.join(wrong, "token").select("part_id", "line_no", "token", "right")
        self.word_fixes = by_word
        # The second part of a broken word is misread if the word that is meant doesn't end in it.
        tails = scanned.where("left_before <> ''").select("part_id", "line_no", F.lower(found(F.col("line"), opening, 1)).alias("tail"), "left_before").where("tail <> ''")
        whole = tails.withColumn("word", F.lower(F.concat("left_before", "tail"))).withColumn("form", folded(F.col("word"))).join(vocabulary, "word", "left_anti")
        by_tail = whole.join(best(meant), "form").where(~F.endswith("right", F.col("tail"))).select("part_id", "line_no")
        # The characters there are, at most as many as Unicode has, are taken out of each line at once.
        known = "".join(sorted(r[0] for r in characters.where("character <> ''").collect()))
        left = F.translate(F.regexp_replace("line", rf"[{MARKS}]", ""), known, "")
        strange = scanned.where(left.rlike(r"[^\x00-\x7f]|[@!|$]")).select("part_id", "line_no") if known else scanned.select("part_id", "line_no").limit(0)
        # A name may break within a line of Chinese text, so a letter alone at its ends is no number.
        inner = F.when(F.col("line").rlike(r"\p{IsHan}"), F.regexp_replace("line", r"^[A-Za-z](?![\p{IsLatin}\d.,])|(?<![\p{IsLatin}\d.,])[A-Za-z]$", "")).otherwise(F.col("line"))
        # The letters of a code such as ab-1234 are none of its number.
        by_number = scanned.where(F.col("line").rlike(MAYBE_ODD)).where(F.regexp_replace(inner, r"\b\p{Ll}{2,}-(?=\d)", "").rlike(ODD_NUMBER)).select("part_id", "line_no")
        self.near = near
        misread = by_word.select("part_id", "line_no").unionByName(by_tail).unionByName(strange).unionByName(by_number).distinct().withColumn("misread", F.lit(True))

        labelled = self.lines.where("scanned").select("part_id", "line_no", "label").distinct()
        found = labelled.join(hyphen.distinct(), ["part_id", "line_no"], "left").join(misread, ["part_id", "line_no"], "left")
        kind = (
            F.when(F.col("label") == "head", "header").when(F.col("label") == "number", "page_number")
            .when(F.col("hyphen"), "hyphen").when(F.col("misread"), "misread")
        )
        return found.select("part_id", "line_no", kind.alias("kind"))

    def found(self) -> DataFrame:
        """(part_id, line_no from 1, kind) of the lines that are no clean body text."""
        return self.kinds.where(F.col("kind").isNotNull()).select("part_id", (F.col("line_no") + 1).cast("int").alias("line_no"), "kind")

    def _character_fixes(self) -> DataFrame:
        """(part_id, line_no, pos, right): characters that no clean page has, and what clean pages have between the same neighbours."""
        spread = self.near.select("part_id", "line_no", "scanned", F.posexplode(F.split("line", "")).alias("pos", "character"), "line")
        around = spread.select(
            "part_id", "line_no", "scanned", "pos", "character",
            F.expr("substring(line, pos, 1)").alias("before"), F.expr("substring(line, pos + 2, 1)").alias("after"),
        ).where((F.col("pos") > 0) & F.col("character").rlike(r"\p{IsHan}"))
        known = around.where(~F.col("scanned"))
        strange = around.where("scanned").join(known.select("character").distinct(), "character", "left_anti")
        contexts = strange.select("before", "after").distinct()
        usual = known.join(contexts, ["before", "after"], "left_semi").groupBy("before", "after", "character").agg(F.count("*").alias("n"))
        best = usual.groupBy("before", "after").agg(F.max_by("character", F.struct("n", "character")).alias("right"))
        return strange.join(best, ["before", "after"]).select("part_id", "line_no", "pos", "right")

    def paragraphs(self) -> DataFrame:
        """(source, paragraph_no, page, text): the repaired text of each source in page order.

        Heads and page numbers are left out, broken words joined, misread words,
        digits and characters put right where clean pages tell how.  A paragraph
        ends at a break and at a short line, and goes on over the end of a page
        in the middle of a sentence.
        """
        words = self.word_fixes.groupBy("part_id", "line_no").agg(F.collect_set(F.struct("token", "right")).alias("words"))
        characters = self._character_fixes().groupBy("part_id", "line_no").agg(F.collect_set(F.struct("pos", "right")).alias("characters"))
        body = self.lines.where(F.col("label").isin("body", "break")).distinct()
        dressed = body.join(self.kinds, ["part_id", "line_no"], "left").join(words, ["part_id", "line_no"], "left").join(characters, ["part_id", "line_no"], "left")
        row = F.struct("line_no", "line", "label", "kind", "scanned", "words", "characters")
        pages = dressed.groupBy("source", "page", "part_id").agg(F.array_sort(F.collect_list(row), lambda a, b: a["line_no"] - b["line_no"]).alias("rows"))
        made = pages.select("source", "page", "part_id", F.posexplode(page_paragraphs("rows")).alias("no", "p")).select("source", "page", "part_id", "no", "p.*")
        made = cut(made)
        # Only marks are put in order, not text; they are dealt by range, so no task needs all of a source.
        place = ["page", "part_id", "no"]
        marks = made.select("source", *place, "open_start", "open_end")
        dealt = cut(marks.repartitionByRange("source", *place).withColumn("block", F.spark_partition_id()))
        inside, across = Window.partitionBy("source", "block").orderBy(*place), Window.partitionBy("source").orderBy("block")
        ends = dealt.groupBy("source", "block").agg(F.max_by("open_end", F.struct(*place)).alias("last")).withColumn("before", F.lag("last").over(across)).drop("last")
        flagged = dealt.join(ends, ["source", "block"]).withColumn("open_before", F.coalesce(F.lag("open_end").over(inside), "before", F.lit(False)))
        begun = flagged.withColumn("begins", (~(F.col("open_start") & F.col("open_before") & (F.col("no") == 0))).cast("int"))
        sums = begun.groupBy("source", "block").agg(F.sum("begins").alias("n"))
        earlier = sums.select("source", "block", F.coalesce(F.sum("n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
        numbered = begun.join(earlier, ["source", "block"]).withColumn("paragraph_no", F.col("earlier") + F.sum("begins").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        parts = numbered.select("source", "page", "part_id", "no", "paragraph_no").join(made.select("source", "page", "part_id", "no", "text", "joins"), ["source", "page", "part_id", "no"])
        grouped = parts.groupBy("source", "paragraph_no").agg(F.min("page").alias("page"), F.array_sort(F.collect_list(F.struct("page", "part_id", "no", "text", "joins"))).alias("parts"))
        text = F.aggregate(
            "parts", F.struct(F.lit("").alias("text"), F.lit(True).alias("joins")),
            lambda a, x: F.struct(F.concat(a["text"], F.when(a["joins"], F.lit("")).otherwise(F.lit(" ")), x["text"]).alias("text"), x["joins"].alias("joins")),
        )["text"]
        return grouped.select("source", "paragraph_no", "page", text.alias("text"))


HAN = re.compile(r"[\u3000-\u303f\u4e00-\u9fff\uff00-\uffef]")
ODD = re.compile(r"(?<![A-Za-z0-9])(?=[0-9OolISBZ.,/-]*[OolISBZ])(?=[0-9OolISBZ.,/-]*[0-9])[0-9OolISBZ][0-9OolISBZ.,/-]*(?![A-Za-z])")


def repaired(line: str, kind: str | None, words: dict[str, str], characters: dict[int, str]) -> str:
    """A line with its misread words, characters and digits put right, without the mark of a broken word."""
    text = "".join(characters.get(i, c) for i, c in enumerate(line))
    for token, right in words.items():
        text = re.sub(rf"(?<!\w){re.escape(token)}(?!\w)", lambda _, r=right: r, text)
    text = ODD.sub(lambda m: m[0].translate(DIGIT_LIKE), text)
    return re.sub(rf"[{MARKS}]\s*$", "", text) if kind == "hyphen" else text.rstrip()


PARAGRAPHS = T.ArrayType(
    T.StructType(
        [T.StructField("text", T.StringType()), T.StructField("joins", T.BooleanType()), T.StructField("open_start", T.BooleanType()), T.StructField("open_end", T.BooleanType())]
    )
)


def width(text: str) -> int:
    return sum(2 if HAN.match(c) else 1 for c in text)


@F.pandas_udf(PARAGRAPHS)
def page_paragraphs(pages: pd.Series) -> pd.Series:
    def one(rows):
        rows = list(rows)
        widest = max((width(r["line"]) for r in rows), default=0)
        # Chinese pages break lines anywhere, also within numbers and Latin names.
        dense = 2 * sum(bool(HAN.search(r["line"])) for r in rows) >= sum(r["label"] == "body" for r in rows)
        done, text, joins, last_break = [], "", True, False
        for i, r in enumerate(rows):
            if r["label"] == "break":
                last_break = True
                continue
            line = repaired(r["line"], r["kind"], {w["token"]: w["right"] for w in (r["words"] if r["words"] is not None else [])}, {c["pos"]: c["right"] for c in (r["characters"] if r["characters"] is not None else [])})
            before = rows[i - 1] if i else None
            goes_on = text and not last_break and before is not None and before["scanned"] and (before["kind"] == "hyphen" or width(before["line"]) >= 0.6 * widest)
            if text and not goes_on:
                done.append((text, joins))
                text, joins = "", True
            if text and not joins and not dense and text[-1:] not in MARKS:
                text += " "
            text += line.strip() if not text else line.lstrip()
            joins, last_break = r["kind"] == "hyphen", False
        if text:
            done.append((text, joins))
        body = [r for r in rows if r["label"] == "body"]
        if not done or not body:
            return []
        first, last = body[0], body[-1]
        full = last["kind"] == "hyphen" or (width(last["line"]) >= 0.6 * widest and not re.search(r"[.。！？!?:：]\s*$", last["line"]))
        opens = rows[0] is first
        return [
            {"text": t, "joins": bool(j or dense), "open_start": bool(opens and k == 0), "open_end": bool(k == len(done) - 1 and full and rows[-1] is last)} for k, (t, j) in enumerate(done)
        ]

    return pages.map(one)
