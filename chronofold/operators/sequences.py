"""Strict-prior histories: what a user did before the time of a target, events at that same time excluded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.time import micros
from chronofold.functions.vectors import left_pad
from chronofold.operators.prepare import warm_events

#: target split: splits whose events may stand in its histories.
VISIBLE = {"train": ("train",), "validation": ("train", "validation"), "test": ("train", "validation", "test")}


def visible_events(interactions: DataFrame, target_split: str) -> DataFrame:
    if target_split not in VISIBLE:
        raise ValueError(f"no such split: {target_split}")
    return warm_events(interactions, *VISIBLE[target_split])


def in_vocabulary(events: DataFrame) -> DataFrame:
    """Events whose user and item both occur in training."""
    train = events.where("split = 'train'")
    return events.join(train.select("user_id").distinct(), "user_id", "left_semi").join(train.select("item_id").distinct(), "item_id", "left_semi")


def user_sequences(events: DataFrame) -> DataFrame:
    """user_id and its items in order of time, then id. One user's log is one row, as a replay reads it."""
    ordered = F.sort_array(F.collect_list(F.struct("event_ts", "item_id")))
    return events.groupBy("user_id").agg(F.transform(ordered, lambda x: x["item_id"]).alias("items"))


def examples(events: DataFrame, target_split: str, history_size: int = 20, min_prior: int = 2, *, by: tuple[str, ...] = ()) -> DataFrame:
    """user_id, item_id (the target), event_ts, prior_count, history (last ``history_size`` items before event_ts) and seen (all of them).

    prior_count is the rank of the time in the user's log less one, so tied events don't see each other. One
    shuffle by user (and ``by``) gives the ranks, each user's log once, and the user's targets; only targets are
    then set beside the log, and what they keep of it is their answer. There is no inequality join.
    """
    if history_size < 1:
        raise ValueError("history_size has to be at least 1")
    if min_prior < 1:
        raise ValueError("min_prior has to be at least 1")
    keys = [*by, "user_id"]
    placed = events.withColumn("__prior", (F.rank().over(Window.partitionBy(*keys).orderBy("event_ts")) - 1).cast("int"))
    is_target = (F.col("split") == target_split) & (F.col("__prior") >= min_prior)
    users = placed.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("event_ts", "item_id"))), lambda x: x["item_id"]).alias("__log"),
        F.collect_list(F.when(is_target, F.struct("item_id", "event_ts", F.col("__prior").alias("prior_count")))).alias("__targets"),
    )
    chosen = users.where(F.size("__targets") > 0).select(*keys, "__log", F.explode("__targets").alias("__t")).select(*keys, "__log", "__t.*")
    size = F.least(F.col("prior_count"), F.lit(history_size))
    return chosen.select(
        *by, "user_id", "item_id", "event_ts", "prior_count",
        F.slice("__log", F.col("prior_count") - size + 1, size).alias("history"),
        F.slice("__log", F.lit(1), F.col("prior_count")).alias("seen"),
    )


def sequence_examples(interactions: DataFrame, target_split: str, history_size: int = 20, min_prior: int = 2) -> DataFrame:
    return examples(in_vocabulary(visible_events(interactions, target_split)), target_split, history_size, min_prior)


def padded(rows: DataFrame, history_size: int = 20) -> DataFrame:
    """``rows`` with history at a fixed length, -1 in front, for numeric item ids."""
    return rows.withColumn("history", left_pad(F.col("history").cast("array<long>"), history_size))


def histories_long(rows: DataFrame) -> DataFrame:
    """A row for each item of each history, slot 0 first."""
    return rows.select("user_id", "item_id", "event_ts", F.posexplode("history").alias("slot", "history_item"))


def dense_index(values: DataFrame, column: str) -> DataFrame:
    """``column`` with its 0-based place in sorted order, by range partitions and their sizes: no single sort task."""
    ordered = values.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column)
    from chronofold.session import cut_lineage

    held = cut_lineage(ordered.withColumn("__seq", F.monotonically_increasing_id()))
    part = F.shiftright("__seq", 33)
    starts = held.groupBy(part.alias("__p")).count().withColumn("__start", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return held.join(starts, part == F.col("__p")).select(column, (F.col("__start") + F.col("__seq").bitwiseAND((1 << 33) - 1)).alias("index"))


def unsafe_histories(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Examples with a history event at or after their target's time: none, if histories are strict."""
    times = events.select("user_id", F.col("item_id").alias("history_item"), micros(F.col("event_ts")).alias("history_us"))
    return histories_long(rows).join(times, ["user_id", "history_item"]).where(F.col("history_us") >= micros(F.col("event_ts")))


def is_replay_safe(history_times: list, target_time) -> bool:
    return all(t < target_time for t in history_times)
