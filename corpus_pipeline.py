"""The corpus pipeline over `documents`: toxicity, line dedup, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but
the last return the columns of documents; rows carry their doc_id through, and a document
that the mix takes several times is as many rows with its id.

Cases: a null or empty text has the score of no evidence, is one empty line, has no duplicate,
size 0, and packs to its end token; a null source is a source of its own, a null doc_id is a
document; of rows repeated in full near-duplicates keep one (of texts without words, all); other
columns pass through, whatever their names; an empty table gives no piece. What a stage wrote
is removed once the next has written its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import linededup, mixing, neardup, packing, toxicity
from tidemark.operators.lineage import shared_folder

#: No SQL: the models of toxicity, the signatures and the tokenizer are beyond it.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that others keep; n_chars follows the text. No row goes."""
    done = linededup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packing(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near duplicates", one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each returns is written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = _written(spark, docs)
            if before is not None:
                _remove(spark, before)
            docs, before = spark.read.parquet(path), path
    return docs


def stored(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return spark.read.parquet(_written(spark, docs))


def _written(spark: SparkSession, docs: DataFrame) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs.write.parquet(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
