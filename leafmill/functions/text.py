"""Text predicates and scalar functions, all built in: they stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character classes and patterns of the text rules.
BLANKS = " \t\n\x0b\x0c\r"
CYRILLIC = "А-Яа-яЇїІіЄєҐґ"
LETTERS = CYRILLIC + "A-Za-z"
GLUED_HYPHEN = r"[,.)(]-|-[,.)(]"
GLUED_SIGN = rf"[{LETTERS}][)(,\p{{Nd}}][{LETTERS}]"
GLUED_DIGIT = rf"\p{{Nd}}[{CYRILLIC}]{{2,}}"
HEADING_WORD = r"^(частина|часть|розділ|раздел|глава|part|chapter)([^\p{L}\p{N}_]|$)"
# The two imprint patterns are one alternative each: RE2 and Java know no common word border, so a border is spelt out for both ends of the first.
IMPRINT_CODE = r"(^|[^\p{L}\p{N}_])(удк|ббк|isbn|issn|ean)([^\p{L}\p{N}_]|$)"
IMPRINT_MARK = r"^[^\p{L}\p{N}_]*[а-яa-zё]\s\p{Nd}{2,4}([^\p{L}\p{N}_]|$)"
LEADERS = r"[.…]{2,}\s*\p{Nd}{1,4}\s*$"
PAGE_NUMBER = r"^[\p{Nd}ivxlcXVILC]{1,4}$"
TOC_TITLES = ("содержание", "оглавление", "contents", "зміст", "змiст")
SENTENCE_END = r"[.!?…:»\")]\s*$"
LOWER_START = r"^[а-яёїієґa-z]"
CAPITAL_START = r"^[«\"(]?\s*[—–-]?\s*[А-ЯЁЇІЄҐA-Z\p{Nd}]"
HYPHEN_END = r"[А-Яа-яЁёЇїІіЄєҐґA-Za-z]-$"
WORD, NO_WORD = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]+"
SECRET = r"key=[A-Za-z0-9_.-]+"
MARKED_LETTER = "[A-Za-zА-Яа-яЁёЇіІїЄєҐґ]"
TOKEN_EDGE = "().,;:«»\"'·—-"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def blank_as_null(c: Column) -> Column:
    """Null for null and blank: the rules treat an empty string as missing."""
    return F.nullif(strip(c), F.lit(""))


def either(c: Column, other: Column) -> Column:
    """The stripped text, or the other where it is blank."""
    return F.coalesce(blank_as_null(c), other)


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def has_letter(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\p{L}"), F.lit(False))


def looks_garbled(c: Column) -> Column:
    """Whether a text layer is damaged: signs or digits glued into words. The rules apply in this order."""
    letters, digits = count_of(c, r"\p{L}"), count_of(c, r"\p{Nd}")
    odd = count_of(c, GLUED_SIGN) + count_of(c, GLUED_DIGIT)
    short = (F.length(c) <= 40) & c.rlike("[)(]") & c.rlike(r"\p{Nd}") & c.rlike(f"[{CYRILLIC}]") & (digits <= 4)
    return (
        F.when(c.isNull() | (c == ""), False)
        .when((digits >= 4) & (letters <= 1), True)
        .when(letters < 2, False)
        .when(c.rlike(GLUED_HYPHEN), True)
        .when(short, True)
        .otherwise((odd >= 2) | ((odd >= 1) & (F.length(c) <= 80)))
    )


def junk_tokens(c: Column) -> Column:
    """Tokens in which, edges stripped, a letter, a digit and one of / ; : = ) ( meet."""
    cores = F.transform(F.split(strip(c), r"[\s]+"), lambda t: F.btrim(t, F.lit(TOKEN_EDGE)))
    return F.size(F.filter(cores, lambda t: (F.length(t) >= 3) & t.rlike(MARKED_LETTER) & t.rlike(r"\p{Nd}") & t.rlike("[/;:=)(]")))


def suspect_garble(c: Column) -> Column:
    return looks_garbled(c) | (F.coalesce(junk_tokens(c), F.lit(0)) >= 2)


def header_key(c: Column) -> Column:
    """A running header without its numbers."""
    return F.lower(strip(F.regexp_replace(c, r"\p{Nd}+", "")))


def cache_key(c: Column) -> Column:
    """A text without white space, hyphens and soft hyphens, lower case."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[\\s\\-­]+", ""))


def one_spaced(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"\s+", " "))


def heading_level(size: Column, text: Column, body: Column) -> Column:
    """h1, h2, h3 or para by type size against the body's, and by words and codes."""
    t = strip(text)
    plain = (F.length(t) > 80) | looks_garbled(t) | F.lower(t).rlike(IMPRINT_CODE) | F.lower(t).rlike(IMPRINT_MARK)
    word = F.lower(t).rlike(HEADING_WORD) & (F.length(t) < 50) & ~t.rlike("[.!?]$")
    return (
        F.when(plain, "para")
        .when(word | (size >= body * 1.9), "h1")
        .when(size >= body * 1.55, "h2")
        .when(size >= body * 1.28, "h3")
        .otherwise("para")
    )


def escape_html(c: Column) -> Column:
    marks = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    return reduce(lambda x, m: F.replace(x, F.lit(m[0]), F.lit(m[1])), marks, c)


def mask_keys(c: Column, limit: int = 200) -> Column:
    """Values of key= in a message are hidden, and the message is cut."""
    return F.left(F.regexp_replace(c, SECRET, "key=***"), F.lit(limit))


def joined_lines(c: Column) -> Column:
    """Hyphens at line ends before a lower-case Cyrillic letter are taken out, line ends become blanks."""
    return strip(F.replace(F.regexp_replace(c, "-\n([а-яёїієґ])", "$1"), F.lit("\n"), F.lit(" ")))


def without_leaders(c: Column) -> Column:
    """Each line's dot leaders and what follows are dropped, then white space is one blank."""
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"(?m)\.{2,}.*$", ""), r"\s+", " "), F.lit(" ."))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def hex_channels(c: Column) -> Column:
    """red, green, blue of #rgb or #rrggbb; null for what is no colour."""
    bare = F.regexp_replace(F.coalesce(strip(c), F.lit("")), "^#+", "")
    full = F.when(F.length(bare) == 3, F.regexp_replace(bare, "(.)", "$1$1")).otherwise(bare)
    part = lambda i: F.conv(F.substring(full, i, 2), 16, 10).cast("int")
    return F.when(full.rlike("^[0-9a-fA-F]{6}$"), F.struct(part(1).alias("red"), part(3).alias("green"), part(5).alias("blue")))


def time_budget(pages: Column, proofread: Column, floor: int = 1800, per_100: int = 1200, cap: int = 14400, fallback: int = 3600) -> Column:
    """Seconds a job may take; the fixed limit where the page count is unknown."""
    scaled = (F.lit(floor) + F.floor(F.lit(per_100) * pages / 100)) * F.when(proofread, 2).otherwise(1)
    return F.when(pages.isNull(), F.lit(fallback)).otherwise(F.greatest(F.lit(floor), F.least(F.lit(cap), scaled))).cast("long")


def progress_percent(done: Column, total: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(99), F.floor(done * 99 / F.greatest(total, F.lit(1))))).cast("int")
