"""Text of documents: body, cleaning, sentences, digit repair and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.schema import BODY_END, BODY_START, LABEL_STEPS


def body(text: Column, start: str = BODY_START, end: str = BODY_END) -> Column:
    """The text from the first start marker on, up to the first end marker after it; a marker that is missing cuts nothing."""
    rest = F.coalesce(F.nullif(F.regexp_extract(text, f"(?is){start}.*", 0), F.lit("")), text)
    return F.get(F.split(rest, f"(?i){end}", 2), F.lit(0))


def clean(text: Column) -> Column:
    """Control characters as blanks, runs of blanks as one, no outer white space."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1F\x7F]", " "), " {2,}", " "), r"(?U)^\s+|\s+$", "")


def sentences(df: DataFrame, text: str, least: int = 20) -> DataFrame:
    """df without the text, with a row for each sentence: sentence_no (from 0, short ones counted) and sentence.

    A sentence ends at .!? before a blank and a capital or a digit (a rule in place of a language model). Sentences of
    less than `least` characters, null and empty texts give no row.
    """
    parts = F.split(F.regexp_replace(clean(F.col(text)), r"([.!?]) +([A-Z0-9])", "$1\n$2"), "\n")
    keep = [c for c in df.columns if c not in (text, "sentence_no", "sentence")]
    return df.select(*keep, F.posexplode_outer(parts).alias("sentence_no", "_s")).select(*keep, "sentence_no", F.trim("_s").alias("sentence")).where(F.length("sentence") >= least)


def repair_digits(text: Column) -> Column:
    """Letters that are misread digits (O o l I B S Z G) as digits, in words that hold a digit; blanks between words become one."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike(r"(?U)\d"), F.translate(w, "OolIBSZG", "00118526")).otherwise(w)), " ")


def lines(df: DataFrame, text: str) -> DataFrame:
    """df without the text, with a row for each line that isn't blank: line_no (from 0, blank ones counted) and line, without outer blanks."""
    keep = [c for c in df.columns if c not in (text, "line_no", "line")]
    rows = df.select(*keep, F.posexplode_outer(F.split(F.col(text), "\n")).alias("line_no", "_l"))
    return rows.select(*keep, "line_no", F.regexp_replace("_l", r"(?U)^\s+|\s+$", "").alias("line")).where("line <> ''")


def study_label(name: Column) -> Column:
    """A study's short name from a file name: publishers' marks removed, cut to 14 characters if it is an item number, else to 22."""
    n = name
    for mark in ("1-s2.0-", "-mainext", "-main", "-v2"):
        n = F.replace(n, F.lit(mark), F.lit(""))
    return F.when(n.startswith("S") & (F.length(n) > 8), F.substring(n, 1, 14)).otherwise(F.btrim(F.substring(n, 1, 22), F.lit("-_ ")))


def paper_label(name: Column) -> Column:
    """A paper's short label: item numbers cut to 18 characters, other names as their first four words, cut to 28."""
    item = name.startswith("1-s2.0-") | name.startswith("S0") | name.startswith("S2")
    words = F.filter(F.split(F.replace(name, F.lit("-"), F.lit(" ")), r"\s+"), lambda w: w != "")
    return F.when(item, F.btrim(F.substring(F.replace(name, F.lit("1-s2.0-"), F.lit("")), 1, 18), F.lit("-_ "))).otherwise(F.substring(F.array_join(F.slice(words, 1, 4), " "), 1, 28))


def variable_label(name: Column) -> Column:
    """A variable's display name."""
    for a, b in LABEL_STEPS:
        name = F.replace(name, F.lit(a), F.lit(b))
    return name


def stem(path: Column) -> Column:
    """A file's name without folders and its last ending."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
