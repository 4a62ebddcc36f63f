"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, token output."""

from pyspark.sql import DataFrame, SparkSession

from meridia.llm import decontam, jaccard, mixing, quality, tokens
from meridia.llm.common import staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the base rules and their group's robust model accept. Null and short texts go; an empty table stays empty."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, 0.8): that of the least id. Equal rows are copies; rows without words stay."""
    return jaccard.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no item of sf_dir's benchmark. Null texts and null ids stay unless their text holds one."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the target weights of their source ask, three times at most. A null source is a source."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' index: doc_id, start, n_tokens, ids_crc32 of each row, read back from the files."""
    return tokens.token_table(docs)


STAGES = [("quality", quality_rules), ("jaccard", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("tokens", token_output)]
ORACLE_SQL = None  # groups of near copies, alignment and the tokenizer are beyond SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, in order; between stages the rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs)
    return docs
