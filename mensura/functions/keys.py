"""Comparison keys for names that are spelled in several ways; all native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other alphabets that look like Latin ones, and super- or subscript digits.
LOOKALIKES = (
    "АВЕКМНОРСТУХЅІЈ"
    "авекмнорстухѕіј"
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
    "αορν"
    "µμ"
    "⁰¹²³⁴⁵⁶⁷⁸⁹"
    "₀₁₂₃₄₅₆₇₈₉"
)
LATIN = (
    "ABEKMHOPCTYXSIJ"
    "abekmhopctyxsij"
    "ABEZHIKMNOPTYX"
    "aopv"
    "uu"
    "0123456789"
    "0123456789"
)

#: Unicode's white space; and the same with zero-width characters.
SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
BLANKS = SPACES + "\u200b\u200c\u200d\u2060\ufeff"

# What stands for a missing value in a text field.
MISSING = ("", "nan", "na", "n/a", "none", "null", "-", "–", "—", "<na>")


def unify(text: Column) -> Column:
    """Look-alike letters, full-width forms and digit variants as plain ASCII."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    return F.translate(text, LOOKALIKES + wide, LATIN + plain)


def strip(text: Column) -> Column:
    """Without outer white space of any kind and zero-width characters."""
    return F.btrim(text, F.lit(BLANKS))


def trim_spaces(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.btrim(text, F.lit(SPACES))


def name_key(text: Column) -> Column:
    """Lower-case ASCII letters and digits only: equal for spellings that differ in case, blanks, marks or look-alikes."""
    return F.regexp_replace(F.lower(unify(text)), "[^a-z0-9]+", "")


def file_key(path: Column) -> Column:
    """name_key of a file's stem: folders and a pdf ending don't count."""
    stem = F.regexp_replace(F.regexp_replace(strip(path), r"^.*[/\\]", ""), r"(?i)\.pdf$", "")
    return name_key(stem)


def filled(text: Column) -> Column:
    """True if a text field holds something: not null, not blank and no stand-in for missing."""
    return F.coalesce(~F.lower(strip(text)).isin(*MISSING), F.lit(False))
