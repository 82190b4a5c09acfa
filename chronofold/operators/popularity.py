"""Time-decayed popularity: fit, global ranking, and what a user hasn't seen of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.time import age_days, half_life_weight, micros


def fit_popularity(events: DataFrame, half_life_days: float) -> DataFrame:
    """item_id and the sum of its events' weights, which halve with each half-life before the newest event.

    The sum combines map-side; one row for each item and task is shuffled.
    """
    if half_life_days <= 0:
        raise ValueError("the half-life has to be positive")
    newest = events.agg(F.max(micros(F.col("event_ts"))).alias("__newest"))
    weight = half_life_weight(age_days(F.col("__newest"), micros(F.col("event_ts"))), half_life_days)
    return events.join(F.broadcast(newest)).groupBy("item_id").agg(F.sum(weight).alias("score"))


def rank_popular(scores: DataFrame, limit: int, digits: int = 9) -> DataFrame:
    """The first ``limit`` items with their 1-based rank: score, rounded so that the order of summing can't show, then id."""
    if limit < 1:
        raise ValueError("limit has to be at least 1")
    top = scores.withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), "item_id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "item_id")))


def first_unseen(queries: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """query_id, item_id, score, rank of the first ``k`` popular items outside each query's ``seen``.

    Only the first k + (longest ``seen``) items can matter. They are cut from the ranking once; a query takes
    its own first k + size(seen) of them by an equi-join on the rank's number, so no pair is made that couldn't be used.
    """
    if k < 1:
        raise ValueError("k has to be at least 1")
    longest = queries.agg(F.coalesce(F.max(F.size("seen")), F.lit(0)).alias("n")).first()["n"]
    head = rank_popular(scores, k + longest).withColumnRenamed("rank", "place")
    asked = queries.select("query_id", "seen", F.explode(F.sequence(F.lit(1), F.lit(k) + F.size("seen"))).alias("place"))
    open_items = asked.join(head, "place").where(~F.array_contains("seen", F.col("item_id")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return open_items.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "item_id", "score", "rank")


def lists(queries: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """``queries`` with popularity_items and popularity_scores: first_unseen's list as arrays, in one pass over queries.

    The head of the ranking is one row that each task gets; a query looks at its first k + size(seen) items only.
    """
    if k < 1:
        raise ValueError("k has to be at least 1")
    longest = queries.agg(F.coalesce(F.max(F.size("seen")), F.lit(0)).alias("n")).first()["n"]
    ranked = F.sort_array(F.collect_list(F.struct("rank", "item_id", "score")))
    head = rank_popular(scores, k + longest).agg(ranked.alias("__head"))
    own = F.slice("__head", F.lit(1), F.lit(k) + F.greatest(F.coalesce(F.size("seen"), F.lit(0)), F.lit(0)))
    best = F.slice(F.filter(own, lambda x: ~F.array_contains("seen", x["item_id"])), 1, k)
    rows = queries.join(F.broadcast(head)).withColumn("__best", best)
    return rows.withColumn("popularity_items", F.transform("__best", lambda x: x["item_id"])).withColumn("popularity_scores", F.transform("__best", lambda x: x["score"])).drop("__head", "__best")


def recommend_popular(scores: DataFrame, seen: list, limit: int) -> list:
    """For one user."""
    if limit < 1:
        raise ValueError("limit has to be at least 1")
    return [r["item_id"] for r in scores.where(~F.col("item_id").isin(*seen) if seen else F.lit(True)).orderBy(F.desc("score"), "item_id").limit(limit).collect()]
