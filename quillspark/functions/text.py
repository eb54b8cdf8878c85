"""Tokens of mixed Chinese and Latin text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ranges of Chinese characters, and words that carry no meaning in a query.
CJK = "㐀-䶿一-鿿豈-﫿"
STOPWORDS = (
    "的 了 是 在 有 和 与 及 或 就 都 也 很 不 没 这 那 哪 什 么 怎 吗 呢 吧 啊 把 被 给 让 从 对 而 但 之 其 此 该 些 个 我 你 他 她 它 们 什么 怎么 为什么 哪些 哪个 多少 "
    "是不是 有没有 可以 需要 应该 我们 你们 他们 这个 那个 一下 一些 的话 怎样 如何"
).split()

#: A run of Chinese characters, or of letters and digits that begins with another one.
RUNS = rf"([{CJK}]+|[\p{{L}}\p{{N}}]+)"


def tokens(text: Column, drop_stopwords: bool = True) -> Column:
    """Single characters and pairs of a Chinese run, other runs whole in lower case; an array, empty for null."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUNS), 1)

    def of(run: Column) -> Column:
        length = F.char_length(run)
        single = F.transform(F.sequence(F.lit(1), length), lambda i: F.substring(run, i, 1))
        pairs = F.when(length > 1, F.transform(F.sequence(F.lit(1), F.greatest(length - 1, F.lit(1))), lambda i: F.substring(run, i, 2))).otherwise(F.array().cast("array<string>"))
        return F.when(run.rlike(f"^[{CJK}]"), F.concat(single, pairs)).otherwise(F.array(F.lower(run)))

    found = F.flatten(F.transform(runs, of))
    return F.filter(found, lambda t: ~is_stopword(t)) if drop_stopwords else found


def is_stopword(token: Column) -> Column:
    """A listed word, or a pair of two listed characters."""
    single = [w for w in STOPWORDS if len(w) == 1]
    return token.isin(STOPWORDS) | ((F.char_length(token) == 2) & F.substring(token, 1, 1).isin(single) & F.substring(token, 2, 1).isin(single))
