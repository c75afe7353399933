"""Numbers from text: one quantity in any of the usual notations, or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mensura.functions.keys import strip

_NUM = r"[+\-−]?(?:\d{1,3}(?:[ ']\d{3})+(?:[.,]\d+)?|\d{1,3}(?:,\d{3}){2,}(?:\.\d+)?|\d{1,3}(?:\.\d{3}){2,}(?:,\d+)?|\d{1,3}(?:,\d{3})+\.\d+|\d{1,3}(?:\.\d{3})+,\d+|\d+(?:[.,]\d*)?|[.,]\d+)"
_EXP = r"(?:\s*[eE][+\-−]?\d+|\s*[×x*·]\s*10\s*(?:\^|\*\*)?\s*[⁺⁻+\-−]?[\d⁰¹²³⁴⁵⁶⁷⁸⁹]+)?"
_ABOUT = r"(?:(?:ca\.?|c\.|approx\.?|approximately|about|~|≈|=)\s*)?"
_UNCERTAIN = rf"(?:\s*(?:±|\+/-|\+-|\+/−)\s*{_NUM}{_EXP}|\s*\(\s*(?:±\s*)?{_NUM}\s*\))?"
# A unit: letters, degree, percent, micro and middle dot, possibly with exponents and divisions; '/10' is the scale of a sensory score.
_UNIT = r"(?:\s*(?:/\s*\d+|1/s|[%°ºµμA-Za-z][%°ºµμA-Za-z.·]*(?:[ /·*]{1,3}[A-Za-zµμ%°º]+){0,3}[⁻^\-−]*[\d¹²³]*))?"

#: A text that states exactly one quantity; its unit and uncertainty may stand beside it.
QUANTITY = rf"^\s*{_ABOUT}({_NUM})({_EXP}){_UNIT}{_UNCERTAIN}{_UNIT}\s*$"
#: Words between or beside numbers that turn them into ranges, limits or references.
NOT_ONE = r"(?i)(?:\bto\b|\bbis\b|\band\b|\bor\b|\bfig|\btab|\beq\b|\bref|\bsee\b|\bmin\b\s*\d|\bmax\b\s*\d)"


def plain_number(text: Column) -> Column:
    """Double of a plain number: decimal point or comma, sign, exponent. Anything else is null.

    A single comma is a decimal comma; 'nan' and 'inf' are null.
    """
    t = F.translate(strip(text), ",−", ".-")
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


def quantity(text: Column) -> Column:
    """Double of a text that states exactly one quantity, else null.

    Plain, signed, grouped and exponent notations, decimal points and commas; a unit or an uncertainty may stand
    beside the number. Ranges, limits (<, ≤, >, 'below'), words, references, stand-ins for missing, null and blank
    texts give null.
    """
    t = F.translate(strip(text), "\u00a0\u2009\u202f", "   ")
    fast = F.when(t.rlike(r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"), t.try_cast("double"))
    # marks before another kind of mark, and marks that occur several times, group digits; a comma that is left is a decimal comma
    number = F.translate(F.regexp_extract(t, QUANTITY, 1), "− '", "-")
    for groups in (r",(?=[^.]*\.)", r"\.(?=[^,]*,)", r",(?=.*,)|(?<=,\d{3}),(?=\d{3})", r"\.(?=.*\.)|(?<=\.\d{3})\.(?=\d{3})"):
        number = F.regexp_replace(number, groups, "")
    power = F.regexp_replace(F.translate(F.regexp_extract(t, QUANTITY, 2), "⁺⁻−⁰¹²³⁴⁵⁶⁷⁸⁹", "+--0123456789"), r"^\s*(?:[eE]|[×x*·]\s*10\s*(?:\^|\*\*)?)\s*", "e")
    slow = F.when(t.rlike(QUANTITY) & ~t.rlike(NOT_ONE), F.concat(F.translate(number, ",", "."), power).try_cast("double"))
    return F.coalesce(fast, slow)
