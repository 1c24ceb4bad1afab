"""The corpus pipeline: documents in, packed training sequences out.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. run() applies them to the whole table.

Every stage takes nulls in any column, empty tables and further columns, whatever their names. Rows that are equal in id and
text are one document given several times: every stage treats them alike and keeps or drops them together, so they are packed
as often as they are given. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hyperslice.llm import decontam, linededup, nearcopies, packing, toxicity
from hyperslice.llm.common import drop, id_bucket, settled, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; null and empty texts stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), id_bucket("doc_id", 5) == 0)
    return docs.filter(toxicity.score(model)("text") < 0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one are cut out; documents of which nothing is left go."""
    return linededup.dedup(docs, min_chars=1)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that SimHash links (five-word shingles, similarity 0.8), the one with the smallest id stays; null ids stay."""
    found = nearcopies.near_copies(docs, shingle=5, least=0.8)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, exactly or reworded; null and empty texts stay, as all do without items."""
    for free in decontam.clean(docs, table(spark, sf_dir, "benchmark")):
        docs = docs.filter(free)
    return docs


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, with its ids and its place in a sequence; a null or empty text is its end id alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: Edit joins, fitted models and subword ids are beyond SQL. The tests hold each stage's operator against brute force, and of
#: the stages together their columns only.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        old = docs
        docs = settled(lambda stage=stage, old=old: stage(spark, old, sf_dir), name)
        drop(old)
    return docs
