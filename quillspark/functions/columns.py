"""Column expressions shared by the operators. Everything here runs in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CATEGORIES, MONEY, RULES, UNCATEGORIZED

# The codes of the US states and the federal district.
STATES = (
    "AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA "
    "WV WI WY".split()
)
DATE_FORMATS = ("y-M-d", "y/M/d", "M/d/y")


def stripped(text: Column) -> Column:
    """Without white space at its ends, tabs and wide spaces included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def money(value: Column) -> Column:
    """Two decimals, half up; null where the text is no number."""
    return F.trim(value.cast("string")).try_cast(MONEY)


def parsed_date(value: Column) -> Column:
    """The first of the accepted formats that fits; null where none does."""
    text = F.trim(value)
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(form)).cast("date") for form in DATE_FORMATS))


def cents(amount: Column) -> Column:
    return (amount * 100).cast("long")


def half_up(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator rounded half away from zero, both integers; exact."""
    doubled = 2 * F.abs(numerator) + F.abs(denominator)
    whole = (doubled - doubled % (2 * F.abs(denominator))) / (2 * F.abs(denominator))
    return F.signum(numerator).cast("long") * F.signum(denominator).cast("long") * F.round(whole).cast("long")


def as_money(in_cents: Column) -> Column:
    return (in_cents.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY)


def average(total: Column, count: Column) -> Column:
    """Sum divided by count, in money, half up; null for no rows."""
    return F.when(count > 0, as_money(half_up(cents(total), F.when(count > 0, count).otherwise(1))))


def labelled(category: Column) -> Column:
    return F.coalesce(category, F.lit(UNCATEGORIZED))


def year_month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def normalized_merchant(merchant: Column) -> Column:
    """The merchant's key: codes and a trailing town with its state taken out, lower case.

    A name that would become empty keeps its own lower-case form.
    """
    spaced = F.regexp_replace(F.translate(merchant, "*/", "  "), r"(?U)^\s+|\s+$", "")
    words = F.split(spaced, r"(?U)\s+")
    state = F.element_at(words, -1).isin(STATES) & (F.size(words) >= 3)
    named = F.when(state, F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(1)))).otherwise(words)
    plain = F.filter(named, lambda w: ~w.rlike(r"[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]"))
    key = F.coalesce(F.nullif(F.lower(F.array_join(plain, " ")), F.lit("")), F.lower(F.regexp_replace(merchant, r"(?U)^\s+|\s+$", "")))
    # Most names are ASCII words between single blanks, without a digit, star or slash or a state at their end: nothing is taken out of them.
    whole = merchant.rlike(r"^[!-)+-.:-~]+( [!-)+-.:-~]+)*\z") & ~F.substring_index(merchant, " ", -1).isin(STATES)
    return F.when(whole, F.lower(merchant)).otherwise(key)


def rule_category(key: Column) -> Column:
    """The category of the longest keyword in the key; the earlier of equally long ones."""
    ordered = sorted(enumerate(RULES), key=lambda r: (-len(r[1][0]), r[0]))
    found = F.lit(None).cast("string")
    for _, (word, category) in reversed(ordered):
        found = F.when(key.contains(word), F.lit(category)).otherwise(found)
    return found


def known_category(category: Column) -> Column:
    return category.isin(CATEGORIES)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in doubles; 1 where a vector has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm(a) == 0) | (norm(b) == 0), F.lit(1.0)).otherwise(1 - dot / (norm(a) * norm(b)))


# The most characters of a tool's answer, and the note that the rest was left out.
MOST_SHOWN, CUT_NOTE = 20_000, ("\n…[已截断，原文共 ", " 字符]")


def shortened(text: Column, most: int = MOST_SHOWN) -> Column:
    """A long text cut, with a note of its whole length."""
    note = F.concat(F.lit(CUT_NOTE[0]), F.char_length(text).cast("string"), F.lit(CUT_NOTE[1]))
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), note)).otherwise(text)


def shown_money(amount: Column) -> Column:
    """An amount with two decimals and marks between thousands, its sign written out."""
    return F.format_number(amount.cast(MONEY), 2)


def shown_value(value: Column, agg: str) -> Column:
    """An aggregate as it is shown: counts as whole numbers with their unit, all others as money."""
    return F.concat(F.format_number(value.cast("long"), 0), F.lit(" 笔")) if agg == "count" else shown_money(value)


# Words that mark a request as a single one, a correction, or a preference.
ONE_OFF = ["这次", "本次", "今天", "刚刚", "刚才", "眼下", "这一次", "帮我看看", "帮我查"]
CORRECTION = ["应该", "不是", "改成", "纠正", "归到", "算作", "属于"]
PREFERENCE = ["我喜欢", "我习惯", "我住", "我不用", "我不要", "别把", "不要"]
# A remembered line is a dash, a date if one likes, a kind in brackets, and text.
_DATE, _KIND, _TEXT = r"[0-9]{4}(?:-[0-9]{2}){2}", r"[^]]+", r"\S(?:.*\S)?"
MEMORY_LINE = rf"^-\s*(?:({_DATE})\s*|)\[({_KIND})]\s*({_TEXT})\s*$"


def has_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found |= text.contains(word)
    return found


def worth_remembering(text: Column) -> Column:
    """Long enough to be reused, and not about a single occasion."""
    clean = F.trim(text)
    return (F.char_length(clean) >= 4) & ~has_any(clean, ONE_OFF)


def memory_kind(text: Column) -> Column:
    return F.when(has_any(text, CORRECTION), "纠正").when(has_any(text, PREFERENCE), "偏好").otherwise("事实")


def shown_number(text: Column) -> Column:
    """The number of a rendered cell such as ``12,057.34`` or ``308 笔``; null where it is none."""
    bare = F.trim(F.regexp_replace(F.trim(text), "笔$", ""))
    return F.when(bare.rlike(r"^-?[\d,]+(\.\d+)?$"), F.replace(bare, F.lit(","), F.lit("")).try_cast("double"))


def json_object(text: Column) -> Column:
    """The part of a model's answer from its first brace to its last, or an empty object."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), F.lit("{}"))
