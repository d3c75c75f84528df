"""Quality rules, line first: lines are judged and removed one by one, then the document by what it has lost.

A line fails by the first rule that holds:

* punctuation: it has no letter or digit, or half or more of its words (of three or more) carry a run of two or more
  symbols, or it is shorter than ten words and ends in no sentence mark while the next or previous line with words is
  like that too (a list of fragments),
* navigation: menu separators (| » › > ·) stand between a third or more of its words, or it is a known menu phrase,
* boilerplate: it holds a phrase of cookie notices, scripts, sign-up calls or placeholder text.

A document is kept if it passes the whole-text rules (10 words or more; at most 20 % of its words within 5-word windows
that occur again) and its failing lines hold no more than half of its words. The one outer rule that guards short
documents is that a document of one line is judged by the symbol and boilerplate rules only.

Null and empty texts have no words and fail. Columns other than doc_id and text are not read by `judge`.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import BLANKS, words_of

#: A document fails below so many words.
LEAST_WORDS = 10
#: Percent of words in repeated windows beyond which a document fails.
MOST_REPEATED = 20
WINDOW = 5
#: Share of a document's words that may go with failing lines.
MOST_LOST = 0.5
SHORT_LINE = 10

# The symbols that are counted, sentence marks, menu separators and phrases.
SYMBOLS = "#*$%&|<>"
ENDS = (".", "!", "?", ":", ";", ",", "…", '"', "'", "”", "’", "»", ")", "]", "。", "！", "？")
SEPARATORS = frozenset("|»›>·•/")
MENU = frozenset(("home", "login", "log in", "sign in", "sign up", "register", "next", "previous", "back", "menu", "search", "skip to content", "read more", "share", "top", "contact", "contact us", "about us", "site map", "sitemap", "startseite", "anmelden", "kontakt", "impressum", "suche", "accueil", "connexion", "rechercher", "inicio", "contacto", "buscar"))
PHRASES = ("accept cookies", "accept all cookies", "we use cookies", "uses cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "enable javascript", "subscribe to our newsletter", "sign up for our", "click here", "lorem ipsum", "page not found", "add to cart", "powered by", "alle rechte vorbehalten", "cookies akzeptieren", "tous droits réservés", "accepter les cookies", "todos los derechos reservados", "aceptar cookies", "política de privacidad")
BOILERPLATE = re.compile(r"\b(?:" + "|".join(PHRASES) + r")\b", re.IGNORECASE)
_RUN = re.compile(r"[#*$%&|<>!?~^=_]{2,}")


def _repeated_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that occur twice or more, all their occurrences included."""
    if len(words) < WINDOW + 1:
        return 0
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered = upto = 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + WINDOW - max(i, upto)
            upto = i + WINDOW
    return covered


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = words_of(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            dup += line in seen
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), dup, _repeated_words(words)


def _fragment(line: str, n: int) -> bool:
    return n < SHORT_LINE and not line.rstrip(BLANKS).endswith(ENDS)


def line_fails(line: str, n: int, lone: bool, beside_fragment: bool) -> str | None:
    """The rule that a line of n words fails, or None. lone: it is the document's only line with words;
    beside_fragment: the next or previous line with words is a short line without a sentence mark too."""
    if not any(c.isalnum() for c in line):
        return "punctuation"
    words = line.split()
    if len(words) >= 3 and 2 * sum(_RUN.search(w) is not None for w in words) >= len(words):
        return "punctuation"
    if not lone:
        if sum(len(w) == 1 and w in SEPARATORS for w in words) * 3 >= len(words) and len(words) >= 3:
            return "navigation"
        if n < SHORT_LINE and line.strip(BLANKS + ".:|»›>").lower() in MENU:
            return "navigation"
        if _fragment(line, n) and beside_fragment:
            return "punctuation"
    if BOILERPLATE.search(line):
        return "boilerplate"
    return None


# Signs of a rule's symbols, and the four letters that count as k, s or i where case does not.
_MARKS = re.compile(r"[#*$%&|<>~^=_»›·•/\u017f\u0130\u0131\u212a]|[!?]{2}")


def _plain(text: str, lines: list[str]) -> bool:
    """No line can fail: a cheap test that most texts pass."""
    if _MARKS.search(text):
        return False
    low = text.lower()
    if any(p in low for p in PHRASES):
        return False
    for line in lines:
        x = line.rstrip(BLANKS)
        if x and (not x.endswith(ENDS) or not (x[0].isalnum() or any(c.isalnum() for c in x)) or x.strip(BLANKS + ".:|»›>").lower() in MENU):
            return False
    return True


def clean_lines(text: str | None) -> tuple[str, int, int, Counter]:
    """(text without failing lines, words in them, lines removed, removals by rule); lines without words stay."""
    if not text:
        return text or "", 0, 0, Counter()
    lines = text.split("\n")
    if _plain(text, lines):
        return text, 0, 0, Counter()
    sizes = [len(words_of(x)) for x in lines]
    full = [i for i, n in enumerate(sizes) if n]
    lost, why = 0, Counter()
    gone: set[int] = set()
    fragment = {i: _fragment(lines[i], sizes[i]) for i in full}
    for at, i in enumerate(full):
        near = any(fragment[full[j]] for j in (at - 1, at + 1) if 0 <= j < len(full))
        if rule := line_fails(lines[i], sizes[i], len(full) == 1, near):
            gone.add(i)
            lost += sizes[i]
            why[rule] += 1
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), lost, len(gone), why


def verdict(text: str | None) -> dict:
    """All that the operator says of one text."""
    n, chars, symbols, dup, repeated = measures(text)
    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
    cleaned, lost, gone, why = clean_lines(text)
    return {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeated, "base_failed": failed, "kept": not failed and lost <= MOST_LOST * n,
        "n_lines_removed": gone, "n_words_removed": lost, "by_punctuation": why["punctuation"], "by_navigation": why["navigation"], "by_boilerplate": why["boilerplate"], "clean_text": cleaned,
    }


_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, n_words_removed long, by_punctuation long, by_navigation long, by_boilerplate long"


def judge(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, the measures, the verdict and, if asked for, the text without failing lines.

    Rows are independent: no shuffle, whole texts of any length, repeated rows each get their own verdict; an empty
    table gives an empty result.
    """

    def run(batches):
        for pdf in batches:
            out = pd.DataFrame([verdict(t if isinstance(t, str) else None) for t in pdf["text"]], columns=[*(c.split()[0] for c in _COLUMNS.split(", ")), "clean_text"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out if with_text else out.drop(columns="clean_text")

    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInPandas(run, f"doc_id string, {_COLUMNS}" + ", clean_text string" * with_text).withColumn("doc_id", F.col("doc_id").cast("long"))


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, as they came, but for their text, which loses its failing lines.

    The columns are those of docs; a column n_chars gets the new text's length in code points.
    """
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            found = [verdict(t) for t in batch.column(at).to_pylist()]
            keep = [i for i, v in enumerate(found) if v["kept"]]
            text = pa.array([found[i]["clean_text"] for i in keep], batch.schema.field(at).type)
            yield batch.take(pa.array(keep, pa.int64())).set_column(at, batch.schema.field(at), text)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
