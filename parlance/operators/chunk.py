"""Turns cut into chunks of whole sentences below a number of tokens."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import SENTENCE_BREAK

_BREAK = re.compile(SENTENCE_BREAK)
_TOKEN = re.compile(r"\w+|[^\w\s]")


def count_tokens(text: str) -> int:
    """Words and single signs; the counter that needs no vocabulary."""
    return len(_TOKEN.findall(text))


def token_counts(texts: Sequence[str]) -> list[int]:
    return [count_tokens(t) for t in texts]


def _packed(units: list[tuple[str, int]], most: int) -> list[tuple[str, int]]:
    """Units joined greedily while their counts stay within most."""
    out: list[tuple[list[str], int]] = []
    for text, n in units:
        if out and out[-1][1] + n <= most:
            out[-1] = (out[-1][0] + [text], out[-1][1] + n)
        else:
            out.append(([text], n))
    return [(" ".join(x), n) for x, n in out]


def chunks_of(texts: Sequence[str | None], most: int, counts: Callable[[Sequence[str]], Sequence[int]]) -> list[list[tuple[str, int]]]:
    """For each text its (chunk, tokens): sentences packed greedily; a sentence over the limit is packed by words, on its
    own. All sentences of all texts are counted in one call, and so are the words of all long sentences."""
    said = [[x for x in (y.strip() for y in _BREAK.split(" ".join((t or "").split()))) if x] for t in texts]
    sizes = iter(counts([x for xs in said for x in xs]))
    sized = [[(x, next(sizes)) for x in xs] for xs in said]
    long = [x.split() for xs in sized for x, n in xs if n > most]
    sizes = iter(counts([w for ws in long for w in ws]))
    words = iter([[(w, next(sizes)) for w in ws] for ws in long])
    out = []
    for xs in sized:
        made: list[tuple[str, int]] = []
        short: list[tuple[str, int]] = []
        for sentence in xs:
            if sentence[1] <= most:
                short.append(sentence)
            else:
                made += _packed(short, most) + _packed(next(words), most)
                short = []
        out.append(made + _packed(short, most))
    return out


def chunks(text: str | None, most: int = 200, count: Callable[[str], int] = count_tokens) -> list[tuple[str, int]]:
    return chunks_of([text], most, lambda xs: [count(x) for x in xs])[0]


def chunk(df: DataFrame, most: int = 200, counts: Callable[[Sequence[str]], Sequence[int]] = token_counts, text: str = "segment_text", parent: str = "segment_id") -> DataFrame:
    """segments to chunks: adds chunk_id, chunk_text and n_tokens and keeps the other columns but the text.

    counts: the tokens of each of a batch of texts, for example WordPieces(...).count_texts.
    """

    @F.pandas_udf("array<struct<chunk_text:string,n_tokens:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"chunk_text": c, "n_tokens": n} for c, n in cs] for cs in chunks_of(texts.tolist(), most, counts)], dtype=object)

    others = [c for c in df.columns if c != text]
    out = df.select(*others, F.posexplode(cut(F.col(text))).alias("_i", "_c"))
    return out.select(*others, F.concat(parent, F.lit("_c"), (F.col("_i") + 1).cast("string")).alias("chunk_id"), "_c.*")
