"""Word pieces: how many pieces of a vocabulary the words of a text are made of, by the greedy longest match.

The vocabulary is a trie in three arrays. All distinct words of an Arrow batch walk it side by side, a character at a
time, so the cost in numpy calls is that of the longest word and not of the number of words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# What the uncased models of this kind take for a sign of its own, and the longest word they look up.
PUNCTUATION = r"\p{P}$+<=>^`|~"
CJK = r"\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\U00020000-\U0002A6DF\U0002A700-\U0002CEAF\U0002F800-\U0002FA1F"
CONTROL = r"[[\p{Cc}\p{Cf}\p{Co}\p{Cs}\p{Cn}\uFFFD]--[\t\n\r]]"
INSIDE = "##"
LONGEST_WORD = 100

#: Pieces of a vocabulary, which every worker holds; about 100 bytes each.
MOST_PIECES = 500_000

_CONTROL = regex.compile(CONTROL, regex.V1)
_WORD = regex.compile(rf"[{PUNCTUATION}{CJK}]|[^\s{PUNCTUATION}{CJK}]+")
_START, _GO_ON = 0, 1


def words_of(text: str | None) -> list[str]:
    """The words and signs of a text in lower case, without accents and control characters."""
    bare = unicodedata.normalize("NFD", _CONTROL.sub("", text or ""))
    return _WORD.findall("".join(c for c in bare if unicodedata.category(c) != "Mn").lower() if not bare.isascii() else bare.lower())


def words(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([words_of(t) for t in texts], dtype=object)

    return run(text)


class WordPieces:
    """A vocabulary: pieces that begin a word as they are, pieces within a word with INSIDE before them."""

    def __init__(self, pieces: Iterable[str]):
        steps: dict[int, int] = {}
        ends, count = [False, False], 2
        distinct = sorted(set(pieces))
        if len(distinct) > MOST_PIECES:
            raise ValueError(f"{len(distinct)} pieces; a vocabulary has at most {MOST_PIECES}")
        for piece in distinct:
            at, letters = (_GO_ON, piece[len(INSIDE) :]) if piece.startswith(INSIDE) and len(piece) > len(INSIDE) else (_START, piece)
            for c in letters:
                key = at << 21 | ord(c)
                if key not in steps:
                    steps[key] = count
                    ends.append(False)
                    count += 1
                at = steps[key]
            ends[at] = ends[at] or bool(letters)
        self.keys = np.array(sorted(steps), np.int64)
        self.to = np.array([steps[k] for k in self.keys.tolist()], np.int64)
        self.ends = np.array(ends, bool)

    def counts(self, words: Sequence[str]) -> np.ndarray:
        """The number of pieces of each word; 1 for a word that no pieces make up or that is too long to be looked up."""
        sizes = np.array([len(w) for w in words], np.int64)
        out = np.minimum(sizes, 1)
        if not len(self.keys):
            return out
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        at = np.flatnonzero((sizes > 0) & (sizes <= LONGEST_WORD))
        place, end = begin[at], (begin + sizes)[at]
        state, best, n = np.full(len(at), _START), np.full(len(at), -1), np.zeros(len(at), np.int64)
        while len(at):
            key = state << 21 | letters[np.minimum(place, len(letters) - 1)]
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            goes = (place < end) & (self.keys[slot] == key)
            state = np.where(goes, self.to[slot], state)
            place = place + goes
            best = np.where(goes & self.ends[state], place, best)
            found = ~goes & (best >= 0)  # the longest piece here is known
            n = n + found
            whole, lost = found & (best == end), ~goes & (best < 0)
            out[at[whole]] = n[whole]
            place, state, best = np.where(found, best, place), np.where(found, _GO_ON, state), np.where(found, -1, best)
            stay = ~(whole | lost)
            at, place, end, state, best, n = at[stay], place[stay], end[stay], state[stay], best[stay], n[stay]
        return out

    def count_texts(self, texts: Sequence[str]) -> list[int]:
        """The number of pieces of each text; a word of the batch is matched once."""
        known: dict[str, int] = {}
        ids, of = [], []
        for i, t in enumerate(texts):
            for w in words_of(t):
                ids.append(known.setdefault(w, len(known)))
                of.append(i)
        if not ids:
            return [0] * len(texts)
        each = self.counts(list(known))[np.array(ids)]
        return np.bincount(np.array(of), weights=each, minlength=len(texts)).astype(np.int64).tolist()


def read_vocabulary(spark, path: str) -> WordPieces:
    """The vocabulary of a text file with one piece a line."""
    rows = spark.read.text(path).where("value <> ''").limit(MOST_PIECES + 1).collect()
    return WordPieces(r.value for r in rows)


def n_pieces(text: Column, vocabulary: WordPieces) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(vocabulary.count_texts(texts.tolist()), dtype="int64")

    return run(text)
