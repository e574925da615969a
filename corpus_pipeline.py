"""From raw documents to a mixed training corpus, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the docs of the next. All but the last return the columns
of documents. Rows with a null id stay in every stage as far as their texts allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmeld.llm import langid
from gridmeld.llm.common import fresh, held_out, written
from gridmeld.llm.decontaminate import contaminated
from gridmeld.llm.lines import line_dedup
from gridmeld.llm.mixing import mix
from gridmeld.llm.neardup import near_duplicates

#: The language model has no SQL form, so neither has the pipeline; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those that no language model fits."""
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return langid.identify(docs, model).where("not lang_rejected").select(docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that many documents share; n_chars follows the text."""
    return line_dedup(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies."""
    number = fresh(docs.columns)
    kept = near_duplicates(docs.select("doc_id", "text"), words=5, percent=80).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias(number))
    found = docs.join(written(kept.where("kept").select("doc_id", number), "kept"), "doc_id")
    # of rows that share an id each text stays once: equal rows are one before any shuffle
    kind = f"{number}kind"
    row = F.first(F.struct(*docs.columns)).alias(number)
    repeated = found.where(F.col(number) > 1).groupBy("doc_id", F.xxhash64("text").alias(kind)).agg(row).select(f"{number}.*")
    return found.where(F.col(number) == 1).select(docs.columns).unionByName(repeated).unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, re-parameterised ones too; one word alone is no item here. Rows are told
    apart by id and text, so of rows that share an id only those with such a text go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    row = fresh(docs.columns)
    keyed = docs.withColumn(row, F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    bad = written(contaminated(keyed.select(row, "text"), items, id_col=row).where("kind != 'word'").select(row).distinct(), "contaminated")
    return keyed.join(bad, row, "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that the sources meet their targets."""
    return mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_common_lines),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
