"""Word normalisation for bag-of-words uses, and JSON helpers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions import porter

# Common English words without content.
STOPWORDS = tuple("a about after all also an and any are as at be because been but by can could did do does for from had has have he her him his how i if in into is it its just me more most my no not of on one or our out over she so some such than that the their them then there these they this those to up us was we were what when which who will with would you your".split())


def content_words(c: Column) -> Column:
    """Words of letters in lower case, stopwords and single letters left out; null gives an empty array."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(\p{L}+)"), 1)
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))


def stem(word: str) -> str:
    """A light English stemmer: plural and participle endings, where three letters or more are left."""
    for end, to in (("sses", "ss"), ("ies", "y"), ("ing", ""), ("ed", ""), ("ly", ""), ("s", "")):
        if word.endswith(end) and len(word) - len(end) >= 3 and not (end == "s" and word.endswith(("ss", "us", "is"))):
            return word[: -len(end)] + to
    return word


def normalised(c: Column, reduce: Callable[[str], str] | None = None) -> Column:
    """Content words as one text; reduce (a stemmer or lemmatiser) is applied to each if given, in Arrow batches."""
    joined = F.array_join(content_words(c), " ")
    if reduce is None:
        return joined

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: " ".join(map(reduce, t.split())))

    return F.pandas_udf(run, "string")(joined)


def stemmed(c: Column) -> Column:
    """The stems of the content words as one text, without leaving the JVM."""
    return F.array_join(F.transform(content_words(c), porter.stem), " ")


def from_json(c: Column, schema: str, default: Column | None = None) -> Column:
    """The value of a JSON text; null or default where it is none."""
    parsed = F.from_json(c, schema, {"mode": "PERMISSIVE"})
    return parsed if default is None else F.coalesce(parsed, default)


def to_json(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def percent(c: Column, digits: int = 2) -> Column:
    """A share as text, for example 12.34%."""
    return F.concat(F.format_number(100 * c, digits), F.lit("%"))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0
