"""Resolution of variable and paper names against their tables of right spellings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.functions.keys import LATIN, LOOKALIKES, file_key, name_key

#: variable_guide is a fixed table; its names become a literal map. More rows than this are an error.
MOST_VARIABLES = 10_000


def _key(text: str) -> str:
    return re.sub("[^a-z0-9]+", "", text.translate(str.maketrans(LOOKALIKES, LATIN)).lower())


def variable_names(guide: DataFrame) -> dict[str, str]:
    """Key of each spelling (variable and label) -> right spelling. A bounded read: the guide has a row per variable."""
    rows = guide.select("variable", "label").where("variable is not null").limit(MOST_VARIABLES + 1).collect()
    if len(rows) > MOST_VARIABLES:
        raise ValueError("variable_guide has more rows than a guide can have")
    names = {_key(r.variable): r.variable for r in rows}
    return {**{_key(r.label): r.variable for r in rows if r.label}, **names}


def resolve_variable(text: Column, names: dict[str, str]) -> Column:
    """The right spelling of a variable, or null."""
    if not names:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv]), name_key(text))


def ascii_column(variable: str) -> str:
    """An ASCII column name for a variable."""
    return re.sub("[^a-z0-9]+", "_", variable.translate(str.maketrans(LOOKALIKES, LATIN)).lower()).strip("_")


def paper_keys(headers: DataFrame) -> DataFrame:
    """(paper_key, paper): right spelling of each paper; of several with one key the smallest."""
    return headers.where("paper is not null").groupBy(file_key(F.col("paper")).alias("paper_key")).agg(F.min("paper").alias("paper"))
