"""Title and text normalisation."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as trimmed from titles and URLs: ASCII controls, NEL, the separators.
WHITE_SPACE = "\t\n\v\f\r\x85" + "".join(
    char for char in map(chr, range(0x3001)) if unicodedata.category(char) in ("Zs", "Zl", "Zp")
)


def sanitize_title(title: Column) -> Column:
    """Letters and decimal digits, lower-cased; every other run becomes one space."""
    words = F.trim(F.regexp_replace(title, r"[^\p{L}\p{Nd}]+", " "))
    # Spark's lower() follows the full Unicode mapping, which expands the dotted
    # capital I and picks a word-final sigma; titles use the one-to-one mapping.
    return F.lower(F.translate(words, "İΣ", "iσ"))


def trim_space(text: Column) -> Column:
    """Trim Unicode white space; Spark's plain trim() strips U+0020 only."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    """True where nothing but white space is left, or the value is missing."""
    return F.coalesce(trim_space(text) == "", F.lit(True))


def first_line(text: Column) -> Column:
    """Text before the first line feed; a carriage return before it stays."""
    return F.substring_index(text, "\n", 1)


def title_or_href(title: Column, href: Column) -> Column:
    """The title as it is, or the href where the title is blank."""
    return F.when(is_blank(title), href).otherwise(title)


def rfc1123(ts: Column) -> Column:
    """Mail-style date with a numeric zone, in the session time zone."""
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss Z")
