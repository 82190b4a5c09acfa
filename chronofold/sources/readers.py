"""Scans: review and metadata logs as JSON lines, prepared Parquet tables, and the star-schema binding."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.functions.time import from_millis

REVIEW = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("parent_asin", T.StringType()), T.StructField("timestamp", T.LongType()), T.StructField("verified_purchase", T.BooleanType())])
METADATA = T.StructType([T.StructField(c, T.StringType()) for c in ("parent_asin", "title", "main_category", "store")])


def require(*paths: str) -> None:
    """Missing local inputs by name, before any job starts. Paths with a scheme are left to Spark."""
    missing = [str(p) for p in paths if "://" not in str(p) and not Path(str(p)).exists()]
    if missing:
        raise FileNotFoundError(f"missing inputs: {', '.join(missing)}")


def read_reviews(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """user_id, item_id, event_ts, verified_purchase of complete rows.

    A gzip file is one unsplittable task; ``partitions`` spreads its rows before anything heavier.
    """
    rows = spark.read.schema(REVIEW).json(path)
    if partitions:
        rows = rows.repartition(partitions)
    return canonical(rows.withColumn("event_ts", from_millis(F.col("timestamp"))), user="user_id", item="parent_asin", flag=F.col("verified_purchase"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(METADATA).json(path)
    return catalog_columns(rows, "parent_asin", "title", "main_category", "store")


def canonical(rows: DataFrame, *, user: str, item: str, flag) -> DataFrame:
    return rows.select(
        F.col(user).alias("user_id"), F.col(item).alias("item_id"), F.col("event_ts").cast("timestamp").alias("event_ts"), F.coalesce(flag, F.lit(False)).alias("verified_purchase")
    ).where("user_id IS NOT NULL AND item_id IS NOT NULL AND event_ts IS NOT NULL")


def catalog_columns(rows: DataFrame, item: str, title: str, category: str, brand: str) -> DataFrame:
    text = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    return rows.select(F.col(item).alias("item_id"), text(title, "title"), text(category, "main_category"), text(brand, "brand"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of a star schema in the roles of a review log."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("event_ts"))
    return canonical(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), user="o_custkey", item="l_partkey", flag=F.col("l_linestatus") == "F")


def star_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_columns(table(spark, sf_dir, "part"), "p_partkey", "p_name", "p_type", "p_brand")


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log in the same roles; its item is a key in a JSON column."""
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumnRenamed("ts", "event_ts")
    return canonical(rows, user="user_id", item="k", flag=F.col("event_type") == "purchase")


def read_folds(spark: SparkSession, paths: list[str], expected: int = 3) -> DataFrame:
    """Candidate rows of all folds, which have to be just ``expected`` files; a query's rows stand together, in order."""
    if len(paths) != expected:
        raise ValueError(f"{expected} fold files are needed; there are {len(paths)}")
    return spark.read.parquet(*paths).repartition("fold", "query_id").sortWithinPartitions("fold", "query_id", "ord")
