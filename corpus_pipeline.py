"""From documents to packed sequences: quality rules, one of each group of near copies, no benchmark text, no personal
data, packed windows. Each stage is written as Parquet and read again by the next; it writes itself, as Arrow batches are
small only while ``stage`` writes: those of a caller's write hold 10,000 texts or 64 MB, in the executor and its workers.

Nulls: a null or empty text fails the quality rules, so no later stage of a run meets one; a stage that is called alone
takes them as its operator says: near duplicates and decontamination keep them, pseudonyms leave them, packing gives
their end id. Null hosts are one host. Repeated rows are copies, of which rows that share a doc_id stay or go together.
Rows without a doc_id are kept by every stage that judges by id. Other columns, whatever their names, pass through.
Empty tables give empty tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontam, jaccard, packing, pii, quality
from lectern.llm.queries import DEMO_KEY, vocabulary
from lectern.llm.util import stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that are frequent on their host. Exact copies of a text count as
    one document, as the next stage removes them: their lines are no boilerplate, and one of them stays."""
    return stage(quality.clean(docs, texts_once=True), "quality_rules")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return stage(jaccard.keep_one(docs), "near_duplicates")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return stage(decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark")), "decontamination")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents under pseudonyms."""
    return stage(pii.pseudonymise(docs, DEMO_KEY, counts=False), "personal_data")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed windows."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", pack)]
#: No SQL: the last stage needs a tokenizer, pseudonyms a keyed permutation. tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = step(spark, docs, sf_dir)
    return docs
