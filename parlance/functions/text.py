"""Text functions as column expressions. Null in, null out unless said otherwise; all run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that scraping leaves behind, marks of pages that are no transcript, control characters, tags, names
# in front of a role, what breaks lines.
ARTEFACTS = ("View Summary", "Click here for webcast")
PAGE_JUNK = ("upgrade now", "trial access", "help center", "log in", "sign in")
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
TAG = r"<[^>]+>"
NAME = r"[A-Z][A-Za-z.'\-]+(?:\s[A-Z][A-Za-z.'\-]+){0,4}"
LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
#: Consecutive repeats of lines below this length go.
REPEAT_BELOW = 140
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z0-9\"'])"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


#: All characters that Unicode counts as white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space (Unicode) at either end. A pattern would look at every blank inside, too."""
    return F.btrim(c, F.lit(WHITE))


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_text(c: Column, repeat_below: int = REPEAT_BELOW) -> Column:
    """Removes control characters, tags, artefacts and repeated lines, and normalises white space; null becomes "".

    repeat_below: repeats of shorter lines go; with 0 all lines stay, for texts that were put together out of cleaned ones."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    t = F.regexp_replace(t, CONTROL, " ")
    t = F.regexp_replace(t, TAG, " ")
    for phrase in ARTEFACTS:
        t = F.regexp_replace(t, rf"(?iU)\b{phrase}\b", " ")
    t = F.regexp_replace(t, r"\r\n?", "\n")
    lines = F.transform(F.split(t, "\n"), squeeze)
    return F.transform(F.array(lines), lambda x: _joined(x, repeat_below))[0]


def _joined(lines: Column, repeat_below: int) -> Column:
    # A repeat equals the line kept before it, hence also the line just before it.
    kept = F.filter(lines, lambda x, i: ~((i > 0) & (x != "") & (x == F.get(lines, i - 1)) & (F.length(x) < repeat_below)))
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def normalize_text(c: Column) -> Column:
    """Line ends and no-break blanks made plain, blanks squeezed, lines without text dropped."""
    t = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), " ", " ")
    return F.array_join(F.filter(F.transform(F.split(t, "\n"), lambda x: strip(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: x != ""), "\n")


def html_to_text(c: Column) -> Column:
    """The text of a page: scripts, styles and tags become blanks, white space is squeezed."""
    t = F.regexp_replace(c, r"(?i)<script[\s\S]*?</script>", " ")
    t = F.regexp_replace(t, r"(?i)<style[\s\S]*?</style>", " ")
    return normalize_text(F.regexp_replace(F.regexp_replace(t, TAG, " "), r"(?U)\s+", " "))


def payload_text(kind: Column, body: Column) -> Column:
    """Text of an HTTP body: HTML if its type says so or it starts with a tag, else plain."""
    is_html = F.lower(F.coalesce(kind, F.lit(""))).contains("html") | strip(body).startswith("<")
    return F.when(is_html, html_to_text(body)).otherwise(normalize_text(body))


def lines_of(c: Column) -> Column:
    """The lines of a text, cut at every line break that Unicode knows."""
    return F.split(c, LINE_BREAKS)


def first_line(c: Column) -> Column:
    """The first line with text, stripped; null if there is none."""
    return F.get(F.filter(F.transform(lines_of(c), strip), lambda x: x != ""), F.lit(0))


def head(c: Column, n: int = 20) -> Column:
    return F.array_join(F.slice(lines_of(c), 1, n), "\n")


def title_or_first_line(title: Column, raw: Column) -> Column:
    return F.when(strip(F.coalesce(title, F.lit(""))) != "", title).otherwise(F.substring(first_line(raw), 1, 200))


def company_or_from_title(company: Column, title: Column) -> Column:
    from_title = F.when(title.contains("-"), strip(F.split_part(title, F.lit("-"), F.lit(1))))
    return F.when(strip(F.coalesce(company, F.lit(""))) != "", company).otherwise(F.coalesce(from_title, company))


def ticker_in(header: Column) -> Column:
    """A ticker in brackets, else behind a label; null if there is none."""
    bracket = F.nullif(F.regexp_extract(header, r"\(([A-Z]{1,6}(?:\.[A-Z])?)\)", 1), F.lit(""))
    label = F.nullif(F.regexp_extract(header, r"(?i)\b(?:Ticker|Symbol)\s*[:\-]\s*([A-Z]{1,6}(?:\.[A-Z])?)\b", 1), F.lit(""))
    return F.coalesce(bracket, label)


def title_key(c: Column) -> Column:
    """Letters, digits and underscores of a title in lower case; null is ""."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+", "")


def company_key(c: Column) -> Column:
    """Spelling variants of a company made equal: & is and, lower case, single blanks."""
    return strip(F.regexp_replace(F.lower(F.replace(c, F.lit("&"), F.lit(" and "))), r"(?U)\s+", " "))


def prefix_key(c: Column, n: int = 250) -> Column:
    return F.regexp_replace(F.lower(F.substring(F.coalesce(c, F.lit("")), 1, n)), r"(?U)\s+", " ")


def sentences(c: Column) -> Column:
    """The sentences of a text; an empty array if it has none."""
    t = squeeze(F.coalesce(c, F.lit("")))
    return F.filter(F.split(t, SENTENCE_BREAK), lambda x: x != "")


def n_tokens(c: Column) -> Column:
    """Words and single signs."""
    return F.regexp_count(c, F.lit(TOKEN))


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def text_flags(c: Column, least: int) -> Column:
    """non_empty, min_length_ok, ui_junk and ok of a scraped text."""
    t = normalize_text(F.coalesce(c, F.lit("")))
    full, long_enough = t != "", F.length(t) >= least
    junk = F.lower(t).rlike("|".join(map(re.escape, PAGE_JUNK)))
    return F.struct(full.alias("non_empty"), long_enough.alias("min_length_ok"), junk.alias("ui_junk"), (full & long_enough & ~junk).alias("ok"))


def header_fields(lines: Column) -> Column:
    """company_name, title, subtitle and event_type from a page's header lines."""
    clean = F.filter(F.transform(lines, normalize_text), lambda x: x != "")
    title = F.coalesce(F.get(clean, F.lit(1)), F.get(clean, F.lit(0)))
    return F.struct(
        F.get(clean, F.lit(0)).alias("company_name"), title.alias("title"), F.get(clean, F.lit(2)).alias("subtitle"), F.when(F.lower(title).contains("earnings call"), F.lit("Earnings Call")).alias("event_type")
    )


def participants(c: Column) -> Column:
    """Distinct names of a comma list in order, those of one character left out."""
    return F.sort_array(F.array_distinct(F.filter(F.transform(F.split(c, ","), strip), lambda x: F.length(x) > 1)))


def speaker_blocks(blocks: Column) -> Column:
    """Blocks with text, their fields stripped; empty speakers and roles are null."""
    empty = lambda x: F.nullif(strip(F.coalesce(x, F.lit(""))), F.lit(""))
    tidy = F.transform(blocks, lambda b: F.struct(empty(b["speaker"]).alias("speaker"), empty(b["role"]).alias("role"), normalize_text(F.coalesce(b["text"], F.lit(""))).alias("text")))
    return F.filter(tidy, lambda b: b["text"] != "")


def company_before_comma(title: Column) -> Column:
    return F.when(title.contains(","), strip(F.split_part(title, F.lit(","), F.lit(1)))).otherwise(title)


def capitalised(c: Column) -> Column:
    """Words that are all lower or all upper case get a capital first; others stay."""
    one = lambda w: F.when((w == F.lower(w)) | (w == F.upper(w)), F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 100_000)))).otherwise(w)
    return F.array_join(F.transform(F.filter(F.split(squeeze(c), " "), lambda w: w != ""), one), " ")


def short_id(*parts: Column, kind: str = "sha1", length: int = 16) -> Column:
    """The first hex digits of a digest over parts joined by |; null parts are empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha1(joined) if kind == "sha1" else F.sha2(joined, 256), 1, length)


def source_of_path(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.rlike("r2k|russel2k|russell2k"), "r2k").when(p.contains("sp"), "sp").otherwise("r1000")


def has_role_mark(c: Column, roles: Sequence[str] = ("Executive", "Analyst", "Operator")) -> Column:
    """Whether a text can hold a glued mark at all; the patterns of marks take time in proportion to the square of a line."""
    found = c.contains(roles[0])
    for role in roles[1:]:
        found = found | c.contains(role)
    return found


def inline_markers(c: Column, roles: Sequence[str] = ("Executive", "Analyst", "Operator")) -> Column:
    """Speaker marks that are glued to a name or to the text get lines of their own."""
    return F.transform(F.array(c), lambda t: _marked(t, roles))[0]


def _marked(c: Column, roles: Sequence[str]) -> Column:
    marked = F.replace(c, F.lit("OperatorOperator"), F.lit("\nOperator\n"))
    for end in ("(?=[A-Z])", r"(?U)\b"):
        marked = F.regexp_replace(marked, rf"(?<!\n)({NAME})({'|'.join(roles)}){end}", "\n$1$2\n")
    t = F.when(has_role_mark(c, roles), marked).otherwise(c)
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))
