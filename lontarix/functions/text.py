"""Text functions as Columns: analyzer, surface keys, units, normalization, headings. All run in the JVM but NFC."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A term: letters, joined by inner hyphens, and digits, joined by inner slashes; nothing else is part of one.
TERM = r"(?:\p{L}+(?:-\p{L}+)*|[0-9]+(?:/[0-9]+)*)+"
#: A source unit: a run of letters, marks and numbers, or any other single character that isn't white space.
UNIT = r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"
ROMAN = r"M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})"
#: Limits of the analyzer.
MAX_TEXT_BYTES, MAX_TERM_BYTES, MAX_TERMS = 2_000_000, 256, 100_000
#: Ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    """Lower-case A-Z alone; other letters keep their case."""
    return F.translate(col(c), UPPER, LOWER)


def _stream_safe_nfc(text: str) -> str:
    """NFC with U+034F put in after every 30 non-starters, as stream-safe text asks for."""
    out, run = [], 0
    for ch in unicodedata.normalize("NFD", text):
        run = run + 1 if unicodedata.combining(ch) else 0
        if run > 30:
            out.append("͏")
            run = 1
        out.append(ch)
    return unicodedata.normalize("NFC", "".join(out))


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """NFC, stream-safe. ASCII texts come back as they are; use it only where texts may be decomposed."""
    return text.map(lambda t: t if t is None or t.isascii() else _stream_safe_nfc(t))


def terms(c: Column | str) -> Column:
    """Array of a text's terms in order. The text is taken to be in NFC."""
    return F.regexp_extract_all(ascii_lower(c), F.lit(TERM), F.lit(0))


def checked_terms(c: Column | str) -> Column:
    """``terms`` that fails on a text, a term or a number of terms over the limits. The terms are found once."""

    def checked(one: Column) -> Column:
        found = one["terms"]
        bad = (one["size"] > MAX_TEXT_BYTES) | (F.size(found) > MAX_TERMS) | F.exists(found, lambda t: F.octet_length(t) > MAX_TERM_BYTES)
        return F.when(bad, F.raise_error(F.lit("analyzer limit exceeded")).cast("array<string>")).otherwise(found)

    one = F.struct(terms(c).alias("terms"), F.octet_length(col(c)).alias("size"))
    return F.element_at(F.transform(F.array(one), checked), 1)


def composed(c: Column | str) -> Column:
    """NFC of a text. Only a text with a character from U+0300 on can change, so no other goes to Python."""
    text = col(c)
    return F.coalesce(nfc(F.when(text.rlike(r"[\x{0300}-\x{10FFFF}]"), text)), text)


def analyzed(c: Column | str) -> Column:
    """The analyzer: NFC, then terms; fails on a text or a number of terms over the limits. ``checked_term`` checks each one.

    A term and what ends it take two bytes, so shorter texts need no count.
    """
    return analyzed_composed(composed(c))


def analyzed_composed(c: Column | str) -> Column:
    """``analyzed`` of a text in NFC."""
    text = col(c)
    found, size = terms(text), F.octet_length(text)
    bad = (size > MAX_TEXT_BYTES) | ((size >= 2 * MAX_TERMS - 1) & (F.size(found) > MAX_TERMS))
    return F.when(bad, F.raise_error(F.lit("analyzer limit exceeded")).cast("array<string>")).otherwise(found)


def checked_term(c: Column | str) -> Column:
    """A term; fails on one over the limit."""
    return F.when(F.octet_length(col(c)) > MAX_TERM_BYTES, F.raise_error(F.lit("analyzer limit exceeded")).cast("string")).otherwise(col(c))


def surface(c: Column | str) -> Column:
    """Surface key: white space collapsed, trimmed, lower-cased by all of Unicode."""
    return F.lower(F.trim(F.regexp_replace(col(c), r"\s+", " ")))


def units(c: Column | str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(UNIT), F.lit(0))


def collapse_space(c: Column | str) -> Column:
    """Question normalization for unquoted text: white space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def normalize_text(c: Column | str) -> Column:
    """Line ends to LF, runs of horizontal space to one, soft hyphens dropped, ligatures spelled out."""
    out = F.regexp_replace(col(c), "\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+", " ")
    out = F.regexp_replace(out, "­", "")
    for lig, plain in LIGATURES.items():
        out = F.replace(out, F.lit(lig), F.lit(plain))
    return out


def is_roman(c: Column | str) -> Column:
    """Canonical Roman numerals of 1 to 3999, upper case."""
    return (F.length(col(c)) > 0) & col(c).rlike(f"^{ROMAN}$")


#: Fixed values: (kind, level, pattern of the trimmed line). The first that matches is the line's heading; those of level 50
#: and more are markers that text may follow, the others take the whole line.
HEADINGS: list[tuple[str, int, str]] = [
    ("PARAGRAPH", 50, r"^\([0-9]{1,4}\)(?:\s.*)?$"),
    ("ITEM", 60, r"^[A-Za-z]\.(?:\s.*)?$"),
    ("ITEM", 70, r"^[0-9]{1,4}\.(?:\s.*)?$"),
    ("EXPLANATION", 5, r"(?i)^PENJELASAN(?: ATAS)?$"),
    ("ANNEX", 5, r"(?i)^LAMPIRAN(?:\s+(?:[IVXLCDM]+|[0-9A-Z]*[0-9][0-9A-Z]*))?$"),
    ("CHAPTER", 10, r"(?i)^BAB\s+(?:[0-9]+|[IVXLCDM]+)$"),
    ("PART", 20, r"(?i)^BAGIAN\s+\p{L}+$"),
    ("PARAGRAPH", 30, r"(?i)^PARAGRAF\s+(?:[0-9]+|[IVXLCDM]+)$"),
    ("ARTICLE", 40, r"(?i)^PASAL\s+(?=[0-9A-Z]{1,12}$)[0-9A-Z]*[0-9][0-9A-Z]*$"),
    ("ARTICLE", 35, rf"(?i)^PASAL\s+(?=[IVXLCDM]){ROMAN}$"),
]


def _heading(line: Column | str, pick: int) -> Column:
    text = F.trim(col(line))
    out = F.lit(None)
    for row in reversed(HEADINGS):
        short = F.lit(True) if row[1] >= 50 else F.octet_length(text) <= 512
        out = F.when(text.rlike(row[2]) & short, F.lit(row[pick])).otherwise(out)
    return out


def heading_level(line: Column | str) -> Column:
    """Level of a heading line (its depth order), null for other lines and for whole-line headings over 512 bytes."""
    return _heading(line, 1).cast("int")


def heading_kind(line: Column | str) -> Column:
    return _heading(line, 0).cast("string")


_MARKER = re.compile(r"\([0-9]+\)|[A-Za-z]\.|[0-9]+\.")


def heading_of(line: str) -> tuple[str, int, str] | None:
    """(kind, level, label) of a line, in Python for the per-document parsers."""
    text = line.strip()
    if not text:
        return None
    for kind, level, pattern in _COMPILED:
        if pattern.match(text) and (level >= 50 or len(text.encode()) <= 512):
            return kind, level, _MARKER.match(text).group() if level >= 50 else text
    return None


_COMPILED = [(k, n, re.compile(p.replace(r"\p{L}", r"[^\W\d_]"), re.DOTALL)) for k, n, p in HEADINGS]


def span_of_quote(text: Column, prefix: Column, quote: Column, suffix: Column) -> Column:
    """(start, stop) in UTF-8 bytes of ``quote`` where prefix, quote and suffix occur exactly once together, else null.

    Overlapping occurrences count, so the second search starts one character on.
    """
    whole = F.concat(prefix, quote, suffix)
    at = F.position(whole, text)
    again = F.position(whole, text, at + 1)
    start = F.octet_length(F.substring(text, F.lit(1), at - 1)) + F.octet_length(prefix)
    once = (at > 0) & (again == 0) & (F.length(quote) > 0)
    return F.when(once, F.struct(start.cast("long").alias("start"), (start + F.octet_length(quote)).cast("long").alias("stop")))


def byte_length(c: Column | str) -> Column:
    return F.octet_length(col(c)).cast("long")


def rounded(c: Column, digits: int = 6) -> Column:
    """Half-up by floor, which any SQL engine repeats exactly."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / F.lit(scale)


def trusted_url(c: Column | str) -> Column:
    """http or https, with a host, without user info."""
    return F.coalesce(col(c).rlike(r"(?i)^https?://[^/?#@\s]+(?:[/?#]\S*)?$"), F.lit(False))
