"""Text expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control, no-break and zero-width characters removed from imported text.
INVISIBLE_CHARS = r"[\t\n\r\u00a0\u180e\u2007\u200b-\u200f\u202f\u2060\ufeff]"
# Fixed value: what a phone number may consist of.
PHONE_CHARS = r"^[0-9\s+.\-]*$"


def clean_text(col: Column) -> Column:
    return F.regexp_replace(col, INVISIBLE_CHARS, "")


def like_any(col: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    """True when any LIKE pattern matches; backslash escapes ``_`` and ``%``."""
    match = (lambda p: col.ilike(p)) if ignore_case else (lambda p: col.like(p))
    return reduce(lambda a, b: a | b, [match(p) for p in patterns])


def keep_if_full_match(col: Column, pattern: str) -> Column:
    """The value itself when all of it matches, else NULL."""
    return F.when(col.rlike(pattern), col)


def phone_number(col: Column) -> Column:
    """Trimmed number made of digits, blanks, plus, dot and dash with at least one digit, else NULL."""
    trimmed = F.btrim(col)
    return F.btrim(F.when(trimmed.rlike("[0-9]"), keep_if_full_match(trimmed, PHONE_CHARS)))


def postal_code(col: Column) -> Column:
    """Five-digit zero-padded code; NULL for letters, over 10 characters or over 99999."""
    trimmed = F.btrim(col)
    usable = trimmed.rlike("^[0-9.]+$") & (F.length(trimmed) <= 10)
    number = F.when(usable, clean_text(trimmed)).try_cast("int")
    return F.when(number.between(0, 99999), F.lpad(number.cast("string"), 5, "0"))


def street_of(col: Column) -> Column:
    """Text before the first digit, or all of it when it starts with one."""
    head = F.regexp_substr(col, F.lit("^[^0-9]*"))
    return F.when(F.length(head) > 0, head).otherwise(col)


def house_number_of(col: Column) -> Column:
    """Text from the first digit, or NULL when nothing stands before it."""
    return F.when(~col.rlike("^([0-9]|$)"), F.regexp_substr(col, F.lit("(?s)[0-9].*")))


def normalised(col: Column) -> Column:
    return F.lower(F.btrim(col))


def domain_name(col: Column) -> Column:
    """Lower-case domain without trailing dots."""
    return F.lower(F.rtrim(col, F.lit(".")))


def email_domain(col: Column) -> Column:
    return F.split_part(col, F.lit("@"), F.lit(2))


def main_domain(col: Column, root: str, country_root: str) -> Column:
    """Roll a dotted domain up to its main domain: ``root.<3rd part>`` or ``country_root.<4th part>``."""
    lowered = F.lower(col)
    part = lambda n: F.split_part(lowered, F.lit("."), F.lit(n))
    return (
        F.when(lowered == root, F.lit(root))
        .when(lowered.startswith(country_root + "."), F.concat(F.lit(country_root + "."), part(4)))
        .otherwise(F.concat(F.lit(root + "."), part(3)))
    )


def flag_labels(flags: dict[str, str]) -> list[Column]:
    """One label column per boolean column: the label when true, else NULL."""
    return [F.when(F.col(flag), F.lit(label)).alias(f"role_{label}") for flag, label in flags.items()]
