"""From raw documents to a mixed, clean corpus in five stages, each written as Parquet and read by the next.

In all stages but the last, rows are documents with the columns they came with, whatever other columns there are; a null or empty
text never leads to removal, repeated rows are each judged alike, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablelens.llm import decontaminate, linededup, mixing, neardup, toxicity
from tablelens.llm.common import materialize, table, work_dir


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is over the cut go. Without labels of both classes none goes; of contradicting labels the more severe holds."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier one go, by (id, position), short ones too; a null text stays null, an emptied one is the empty string."""
    return linededup.clean(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the smallest id stays, with all rows of that id and text; texts without words are no duplicates."""
    return neardup.clean(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go; an item without words matches nothing, and without items none goes."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: none of texts without words; a null source is a source, the last in order."""
    return mixing.mix(docs, keep=["doc_id", "source"]).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("near_dedup", near), ("decontaminate", benchmark), ("mix", mix)]

#: Ordinal regression and sketches have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), work_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"{path}/{i}-{name}", "snappy")
    return docs
