"""Exact dedup with a heavy-hitter split: frequent digests are resolved map-side, the rest by an ordinary shuffle."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.common import as_bytes, batches, cut, read

#: Counters of a Misra-Gries summary: each digest with over 1/(COUNTERS + 1) of the rows is among them.
COUNTERS = 512


def _digests(it):
    import pyarrow as pa

    for batch in batches(it):
        # bytes.lower() changes A-Z only, whatever the text's language
        out = [hashlib.sha256(x.lower()).digest() for x in as_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "digest"])


def misra_gries(it, counters: int = COUNTERS):
    """One summary of at most ``counters`` digests for a partition, as rows (digest, n)."""
    import pyarrow as pa

    held: dict[bytes, int] = {}
    for batch in batches(it):
        for x in batch.column(0).to_pylist():
            if x in held:
                held[x] += 1
            elif len(held) < counters:
                held[x] = 1
            else:
                held = {k: v - 1 for k, v in held.items() if v > 1}
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["digest", "n"])


def exact_dedup(docs: DataFrame, *, counters: int = COUNTERS) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept for each row of ``docs``.

    Texts are equal if identical after lower-casing A-Z; a null text counts as empty. Of equal texts the row
    with the largest doc_id stays (null is below all). Of repeated rows with that doc_id exactly one stays. An
    empty table gives no rows; other columns are not read.

    Misra-Gries summaries of the partitions, added up, name at most ``counters`` digests that can be frequent;
    their exact counts and winners, a broadcast of as many rows at most, settle their rows without a shuffle
    however large such a group is. All other digests have under 1/counters of the rows each, and are grouped
    and joined on the digest.
    """
    rows = cut(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_digests, "doc_id long, digest binary").withColumn("row", F.monotonically_increasing_id()))
    heavy = (
        rows.select("digest")
        .mapInArrow(lambda it: misra_gries(it, counters), "digest binary, n long")
        .groupBy("digest")
        .agg(F.sum("n").alias("n"))
        .where("n > 1")
        .orderBy(F.desc("n"), "digest")
        .limit(counters)
        .select("digest")
    )
    winner = [F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size")]
    verified = cut(rows.join(F.broadcast(heavy), "digest", "left_semi").groupBy("digest").agg(*winner))
    hot = F.broadcast(verified)
    frequent = rows.join(hot, "digest")
    rest = rows.join(hot.select("digest"), "digest", "left_anti")
    ordinary = rest.join(rest.groupBy("digest").agg(*winner), "digest")
    return frequent.unionByName(ordinary).select(
        "doc_id",
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, text_sha256, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
