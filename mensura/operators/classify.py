"""Names, categories, methods and links of extracted entities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from mensura.functions.keys import trim_spaces
from mensura.schema import CATEGORIES, CONFIDENCE, INPUTS, OUTPUTS, TEXT_NAMES, UNITS, VARIABLE_UNITS


def lookup(key: Column, table: Mapping[str, object]) -> Column:
    """The table's value of a key, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def category(entity: Column) -> Column:
    """The first category of which the entity, letter case aside, contains a word; null without one."""
    e = F.lower(entity)
    out = F.lit(None).cast("string")
    for name, words in reversed(CATEGORIES.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(e, F.lit(w))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def variable(entity: Column, names: Mapping[str, str] = TEXT_NAMES) -> Column:
    """The variable that an entity names, or null."""
    return lookup(trim_spaces(F.lower(entity)), names)


def confidence(method: Column) -> Column:
    """Ordinal confidence of an extraction method, 1 is best; null for other methods."""
    return lookup(method, CONFIDENCE)


def pattern_category(name: Column) -> Column:
    """Category of a value found by a pattern: its variable's name up to the first underscore."""
    return F.split_part(name, F.lit("_"), F.lit(1))


def sheet_method(sheet: Column) -> Column:
    """Method that a sheet's name tells: OCR, Table or NLP. Null counts as NLP."""
    s = F.lower(F.coalesce(sheet, F.lit("")))
    return F.when(F.contains(s, F.lit("ocr")), "OCR").when(s.endswith("ext") | F.contains(s, F.lit("table")), "Table").otherwise("NLP")


def role(name: Column) -> Column:
    """Input, Output or Other."""
    return F.when(name.isin(*INPUTS), "Input").when(name.isin(*OUTPUTS), "Output").otherwise("Other")


def unit(name: Column) -> Column:
    """The unit in which the wide dataset holds a variable, or null."""
    return lookup(name, VARIABLE_UNITS)


def words(text: Column) -> Column:
    """Words of a text between blanks, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def nearest_number(tokens: Column, centre: Column) -> Column:
    """Index (from 0) of the number token nearest to a position, the first of equally near ones; null without a number."""
    places = F.filter(F.transform(tokens, lambda w, i: F.when(w.rlike(r"^[0-9]+([.,][0-9]+)?$"), F.struct(F.abs(i - centre).alias("d"), i.alias("i")))), lambda p: p.isNotNull())
    return F.array_min(places)["i"]


def unit_after(tokens: Column, at: Column, units: Sequence[str] = UNITS) -> Column:
    """The token after a position, in lower case, if it is a unit; else null."""
    after = F.lower(F.get(tokens, at + 1))
    return F.when(after.isin(*units), after)
