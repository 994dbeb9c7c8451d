"""Column functions of the categorisation feeds: keys, texts, flags and features.  All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_space(c: Column) -> Column:
    """Without white space of any kind at either end (``trim`` takes blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def norm_merchant(c: Column, null_as_blank: bool = False) -> Column:
    """Merchant key: lower case, trimmed; null stays null unless ``null_as_blank``."""
    key = F.lower(strip_space(c))
    return F.coalesce(key, F.lit("")) if null_as_blank else key


def desc_text(c: Column) -> Column:
    """Lower-case description, null as the empty text."""
    return F.lower(F.coalesce(c, F.lit("")))


def native_pair(primary: Column, sub: Column, keep_primary: bool = False) -> Column:
    """``primary | sub``; null if either is, or with ``keep_primary`` the primary alone when there is no sub."""
    return F.concat_ws(" | ", primary, sub) if keep_primary else F.concat(primary, F.lit(" | "), sub)


def split_pair(c: Column) -> tuple[Column, Column]:
    """Both sides of the first `` | ``; empty texts where a side is missing."""
    parts = F.split(F.coalesce(c, F.lit("")), r" \| ", 2)
    return F.get(parts, 0), F.coalesce(F.get(parts, 1), F.lit(""))


def abs_amount(c: Column) -> Column:
    """Absolute amount to two places."""
    return F.round(F.abs(c), 2)


def log_amount(c: Column) -> Column:
    return F.log1p(F.abs(c))


def is_credit(direction: Column) -> Column:
    return (direction == "credit").cast("int")


def model_text(vendor: Column, description: Column) -> Column:
    """``vendor | description`` in lower case, nulls as empty texts."""
    return F.lower(F.concat(F.coalesce(vendor, F.lit("")), F.lit(" | "), F.coalesce(description, F.lit(""))))


def surrogate_key(*cols: Column) -> Column:
    """SHA-256 of the fields joined by ``|``, nulls as empty texts."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)


def safe_double(c: Column) -> Column:
    """Number, or null where the text is none."""
    return c.try_cast("double")


def safe_ts(c: Column) -> Column:
    """Timestamp of an ISO text with optional fraction and an offset, or null."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX"))


def string_shape(c: Column) -> Column:
    """Shape of a merchant key, in this order: person_like, short_token, two_word, long_tail."""
    person = c.rlike(r"^(mr|mrs|ms|miss|dr) [a-z]") | c.rlike(r"^[a-z]\.? [a-z]+$")
    return F.when(person, "person_like").when(F.length(c) <= 4, "short_token").when(c.rlike(r"^[a-z]+ [a-z]+$"), "two_word").otherwise("long_tail")


def conf_bucket(c: Column) -> Column:
    """Confidence bucket, upper edges open except the last."""
    return F.when(c >= 0.9, "0.9-1.0").when(c >= 0.7, "0.7-0.9").when(c >= 0.5, "0.5-0.7").otherwise("0.0-0.5")


def clean_merchant(c: Column) -> Column:
    """Canonical form: lower case, without card suffixes, point-of-sale codes, references and lone numbers at the end."""
    out = F.lower(strip_space(c))
    out = F.regexp_replace(out, r"\b(pos|card|ref|txn)\b[ :#]*[0-9a-z]*$", "")
    out = F.regexp_replace(out, r"[*#][0-9a-z]+", "")
    out = F.regexp_replace(out, r"[ ]+[0-9]+$", "")
    return F.regexp_replace(strip_space(out), r"\s+", " ")


def draw_key(seed: int, *cols: Column) -> Column:
    """A reproducible random order: md5 of the seed and the key."""
    return F.md5(F.concat(F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))
