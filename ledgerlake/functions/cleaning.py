"""Column cleaners: every one is a Catalyst expression, column in, column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of missing values and of booleans, and rating words.
MISSING = ("nan", "none", "")
TRUE, FALSE = ("true", "yes", "1", "y"), ("false", "no", "0", "n")
WORDS = {"one": 1.0, "two": 2.0, "three": 3.0, "four": 4.0, "five": 5.0}
#: Month before day; a format that does not fit gives null and the next one is tried.
DATE_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy HH:mmXXX", "MM/dd/yyyy HH:mm", "MM/dd/yyyy", "MM-dd-yyyy",
    "dd/MM/yyyy HH:mmXXX", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "dd-MM-yyyy", "d-MMM-yyyy", "MMM d, yyyy", "MMM dd, yyyy", "MMMM d, yyyy",
)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def number(c: Column) -> Column:
    return strip(c).try_cast("double")


def currency(c: Column) -> Column:
    """Amount without currency codes and signs; a minus stays; null if no number is left."""
    bare = F.regexp_replace(F.regexp_replace(c, r"\b(USD|AED|EUR|GBP|INR)\b", ""), "[$£€]", "")
    return F.regexp_replace(strip(bare), r"[^\d.\-]", "").try_cast("double")


def date(c: Column) -> Column:
    """UTC date from any of DATE_FORMATS, else null."""
    return F.to_date(F.coalesce(*[F.try_to_timestamp(strip(c), F.lit(f)) for f in DATE_FORMATS]))


def category(c: Column) -> Column:
    low = F.lower(strip(c))
    return F.when(~low.isin(*MISSING), low)


def full_name(first: Column, last: Column) -> Column:
    """Null if either part is null."""
    return F.concat(first, F.lit(" "), last)


def boolean(c: Column) -> Column:
    low = F.lower(strip(c))
    return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def rating(c: Column) -> Column:
    """1 to 5 from words, fractions (scaled to 5, half to even at one decimal) or numbers."""
    low = F.lower(strip(c))
    words = F.coalesce(*[F.when(low == w, F.lit(v)) for w, v in WORDS.items()])
    top, bottom = (F.nullif(F.regexp_extract(low, r"^([\d.]+)\s*/\s*(\d+)$", i), F.lit("")).try_cast("double") for i in (1, 2))
    return F.coalesce(words, F.bround(clamp(top / F.nullif(bottom, F.lit(0.0)) * 5, 1.0, 5.0), 1), clamp(low.try_cast("double"), 1.0, 5.0))


def plain_text(c: Column) -> Column:
    """Without tags and Markdown marks, links reduced to their text; null if nothing is left."""
    text = F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.nullif(strip(F.regexp_replace(text, "[*_`#~]", "")), F.lit(""))


def canonical(c: Column, names: dict[str, str]) -> Column:
    """Known spellings replaced, others unchanged."""
    mapping = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(mapping, c), c)


def flag(condition: Column) -> Column:
    """0 or 1, never null."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def text_or_null(c: Column) -> Column:
    return F.when(~F.lower(strip(c)).isin(*MISSING), strip(c))


def mask_pii(c: Column) -> Column:
    """E-mail addresses keep two characters and the domain; phone numbers go."""
    long = F.regexp_replace(c, r"([a-zA-Z0-9._%+\-]{2})[a-zA-Z0-9._%+\-]+@([a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})", "$1***@$2")
    short = F.regexp_replace(long, r"(?<![a-zA-Z0-9._%+\-*])[a-zA-Z0-9._%+\-]{1,2}@([a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})", "***@$1")
    return F.regexp_replace(short, r"(\+?1?\s?)?(\(?\d{3}\)?[\s.\-]?)(\d{3}[\s.\-]?\d{4})", "[PHONE REDACTED]")
