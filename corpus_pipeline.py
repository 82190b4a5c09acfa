"""A training corpus in five stages: quality classifier, line dedup, MinHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again
as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import lines, mixing, near_dedup, packing, quality
from chronofold.llm.common import ensure_checkpoint_dir, fresh, read

#: Words that a packing worker remembers: fewer than in packing alone, since its executor holds the other stages' memory too.
CACHE = 200_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines within one edit of an earlier line go; so does a document of which nothing is left. Null texts stay null."""
    n, dropped = fresh("__lines", docs), fresh("__dropped", docs)
    rest = lines.drop_lines(docs, lines=n, dropped=dropped).where(~((F.col(dropped) > 0) & (F.trim("text") == "")) | F.col("text").isNull())
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.when(F.col(dropped) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rest.select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document with the least doc_id stays."""
    gone = fresh("__gone", docs)
    away = near_dedup.near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias(gone))
    return docs.join(away, F.col("doc_id").cast("long") == F.col(gone), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes each of them; those without words go."""
    return mixing.mix_whole(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of packing.WINDOW tokens."""
    return packing.pack_documents(docs, cache=CACHE)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No stage but mixing could be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir() or spark.conf.get('spark.checkpoint.dir')}/pipeline-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(path)
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            files.delete(jvm.org.apache.hadoop.fs.Path(f"{base}/{k - 1}"), True)
    return STAGES[-1][1](spark, docs, sf_dir)
