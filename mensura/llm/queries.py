"""Queries p1, p3, p6, p7 and p8 over the project's tables, and their SQL where there is one."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.functions.keys import MISSING, file_key, strip
from mensura.functions.names import paper_keys, resolve_variable, variable_names
from mensura.functions.numbers import quantity
from mensura.llm import encode as encoding
from mensura.llm import quality as text_quality
from mensura.llm.linkage import link, paper_values, papers, studies, study_facts, study_rules, usual_words
from mensura.session import cut
from mensura.llm.mixing import mix
from mensura.llm.survivor import Groups
from mensura.plans import oracles as sql
from mensura.sources.tables import spread, table


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """A public tokenizer's file: in the folder of MENSURA_TOKENIZERS, else in /opt/tokenizers."""
    return os.path.join(os.environ.get("MENSURA_TOKENIZERS", "/opt/tokenizers"), name)


def p1_links(spark: SparkSession, folder: str) -> DataFrame:
    """The study of each paper, with the rule that found it and its confidence."""
    measured = paper_values(table(spark, folder, "extended_with_ocr"), table(spark, folder, "variable_guide"))
    left, right = cut(studies(table(spark, folder, "example_data"))), cut(papers(table(spark, folder, "paper_headers"), measured))
    usual = usual_words([left, right])
    return link(left, right, "study_id", "paper", study_rules(usual), study_facts(list(usual)))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_links(spark, folder).select("study_id", "paper")


#: The fields that a measurement's record is made of.
FIELDS = ("sheet", "entity", "value", "unit", "sentence")


def _few(rows: DataFrame, most: int, name: str) -> list:
    """All rows of a small table; more than it may have are an error, so that none is left out."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"{name} has more than {most} rows")
    return got


def measurement_groups(spark: SparkSession, folder: str) -> Groups:
    """Rows of extended_with_ocr by measurement: paper key, sample number and variable."""
    names = variable_names(table(spark, folder, "variable_guide"))
    methods = table(spark, folder, "relation_methods").where("relation_method is not null and trust is not null")
    trust = {r.relation_method: r.trust for r in _few(methods, 100, "relation_methods")}
    low = {c: F.lower(strip(F.col(c))).alias(f"_{c}") for c in FIELDS}  # once, as several columns are made of each
    names_ = ("row_id", "paper", "sample_no", "normalized_variable", "relation_method", "loaded_at")
    rows = spread(table(spark, folder, "extended_with_ocr").select(*names_, *FIELDS)).select(*names_, *low.values())
    has = lambda c: F.coalesce(~F.col(f"_{c}").isin(*MISSING), F.lit(False))
    fields = {c: (has(c), F.coalesce(quantity(F.col(f"_{c}")).cast("string"), F.col(f"_{c}")) if c == "value" else F.col(f"_{c}")) for c in FIELDS}
    order = sorted(set(names.values()))
    number = {v: i for i, v in enumerate(order)}
    variable = resolve_variable(F.col("normalized_variable"), {k: str(number[v]) for k, v in names.items()}).cast("smallint")
    return Groups(rows, {"paper": F.xxhash64(file_key(F.col("paper"))), "sample_no": F.col("sample_no"), "variable": F.when(F.col("paper").isNotNull(), variable)}, F.col("row_id"), F.col("relation_method"), trust, F.col("loaded_at"), fields)


def _of_known_papers(spark: SparkSession, folder: str, df: DataFrame) -> DataFrame:
    papers = paper_keys(table(spark, folder, "paper_headers")).select(F.xxhash64("paper_key").alias("paper"), F.col("paper").alias("_spelled"))
    return df.join(papers, "paper").withColumn("paper", F.col("_spelled")).drop("_spelled")


def _spelled(spark: SparkSession, folder: str, df: DataFrame) -> DataFrame:
    order = sorted(set(variable_names(table(spark, folder, "variable_guide")).values()))
    return df.withColumn("variable", F.get(F.lit(order), F.col("variable").cast("int")))


def p3_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving row of every measurement, single ones included."""
    groups = measurement_groups(spark, folder).compact()
    return _spelled(spark, folder, _of_known_papers(spark, folder, groups.survivors(groups.quality())))


def p3_fused(spark: SparkSession, folder: str) -> DataFrame:
    """Every field value judged true of every measurement."""
    groups = measurement_groups(spark, folder)
    return _spelled(spark, folder, _of_known_papers(spark, folder, groups.fused(groups.quality())))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    groups = measurement_groups(spark, folder).compact()
    kept = groups.survivors(groups.quality()).where("n_rows >= 2 and whole")
    return _of_known_papers(spark, folder, kept).select("row_id")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.encode(table(spark, folder, "documents"), "doc_id", "text", tokenizer_path())


def p6_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Ids with, for each, the character of the text at which its pre-token begins."""
    return encoding.encode(table(spark, folder, "documents"), "doc_id", "text", tokenizer_path(), offsets="starts")


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sized = cut(encoding.count_tokens(table(spark, folder, "documents"), ["doc_id", "source"], "text", tokenizer_path()))
    return mix(sized, "doc_id", table(spark, folder, "mix_targets"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document stands in the mix of sources."""
    return _mixed(spark, folder)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source of the mix."""
    return _mixed(spark, folder)[1]


def _common_words(spark: SparkSession, folder: str) -> text_quality.Words:
    return text_quality.Words.of([r.word for r in _few(table(spark, folder, "common_words").where("word is not null").select("word"), 10_000, "common_words")])


def p8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics and label shares of every document."""
    return text_quality.quality(table(spark, folder, "documents"), "doc_id", "text", _common_words(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_quality(spark, folder).where("list_share + table_share + junk_share > 0.5").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p1_links": p1_links, "p3_found": p3_found, "p3_survivors": p3_survivors, "p3_fused": p3_fused,
    "p6_ids": p6_ids, "p6_offsets": p6_offsets, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_quality": p8_quality,
}

def _survivors_sql() -> str:
    """The rows to keep, by windows over each measurement."""
    has = " | ".join(f"(CASE WHEN {sql.is_filled(c)} THEN {1 << i} ELSE 0 END)" for i, c in enumerate(FIELDS))
    rows = f"SELECT o.row_id, p.paper, o.sample_no, n.variable, o.loaded_at, coalesce(m.trust, 0) AS trust, {has} AS mask FROM extended_with_ocr o JOIN papers p ON {sql.file_key('o.paper')} = p.paper_key JOIN names n ON {sql.name_key('o.normalized_variable')} = n.k LEFT JOIN relation_methods m ON o.relation_method = m.relation_method WHERE o.sample_no IS NOT NULL"
    group = "OVER (PARTITION BY paper, sample_no, variable)"
    return f"WITH {sql.NAMES}, {sql.PAPERS}, r AS ({rows}), g AS (SELECT *, count(*) {group} AS n, bit_or(mask) {group} AS whole, max(loaded_at) {group} AS latest, max(trust) {group} AS top FROM r) SELECT min(row_id) AS row_id FROM g WHERE n >= 2 AND mask = whole AND loaded_at = latest AND trust = top GROUP BY paper, sample_no, variable"


ORACLES: dict[str, str] = {"p3_found": _survivors_sql()}
