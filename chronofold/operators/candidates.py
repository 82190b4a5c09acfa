"""The union of candidate lists with each source's rank, and the features a ranker sees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.vectors import inverse_rank
from chronofold.operators import shipping

#: Sources in the order that settles ties: an item stands where its first source has it.
SOURCES = ("neural", "popularity", "cf")
#: The ranker's inputs, in order.
FEATURES = (
    "neural_inverse_rank", "popularity_inverse_rank", "cf_inverse_rank", "source_count",
    "popularity_score", "user_history_length", "category_affinity", "brand_affinity",
)


def merge_ranks(lists: dict[str, DataFrame]) -> DataFrame:
    """query_id, item_id, a rank for each source (null where it lacks the item), source_count and ord, the place in the union.

    One pass over the concatenated lists, one shuffle by query and item; each (source, query, item) is one row.
    """
    rows = None
    for place, source in enumerate(SOURCES):
        part = lists[source].select("query_id", "item_id", F.lit(place).alias("s"), F.col("rank").cast("int").alias("rank"))
        rows = part if rows is None else rows.unionByName(part)
    ranks = [F.min(F.when(F.col("s") == i, F.col("rank"))).alias(f"{s}_rank") for i, s in enumerate(SOURCES)]
    merged = rows.groupBy("query_id", "item_id").agg(*ranks, F.count_distinct("s").cast("int").alias("source_count"), F.min(F.struct("s", "rank")).alias("__first"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("__first.s", "__first.rank"))
    return merged.withColumn("ord", order).drop("__first")


def union_coverage(union: DataFrame, targets: DataFrame) -> DataFrame:
    """Recall of each source and of the union over all ``targets`` (query_id, item_id), and the mean number of candidates."""
    hits = targets.withColumnRenamed("item_id", "target").join(union, "query_id", "left").groupBy("query_id").agg(
        *(F.max(((F.col("item_id") == F.col("target")) & F.col(f"{s}_rank").isNotNull()).cast("int")).alias(s) for s in SOURCES),
        F.max((F.col("item_id") == F.col("target")).cast("int")).alias("any"),
        F.count("item_id").alias("n"),
    )
    mean = lambda c, name: F.round(F.coalesce(F.avg(F.coalesce(c, F.lit(0))), F.lit(0.0)), 6).alias(name)
    return hits.agg(F.count("*").alias("examples"), *(mean(F.col(s), f"{s}_recall") for s in SOURCES), mean(F.col("any"), "union_recall"), mean(F.col("n"), "mean_candidates"))


def affinity(queries: DataFrame, items: DataFrame, column: str) -> DataFrame:
    """query_id, value, share of the query's history that has it. Empty values count as history but match nothing."""
    rows = queries.select("query_id", F.size("history").alias("n"), F.explode("history").alias("item_id")).join(items.select("item_id", F.col(column).alias("value")), "item_id")
    return rows.where("value <> ''").groupBy("query_id", "value").agg((F.count("*") / F.max("n")).alias("share"))


def ranker_features(union: DataFrame, queries: DataFrame, items: DataFrame, popularity: DataFrame, *, history_size: int = 20) -> DataFrame:
    """``union`` with FEATURES. ``queries``: query_id, history (at most ``history_size`` newest items), prior_count.

    Histories meet metadata before they meet candidates: a share for each query and value, then joined by it,
    so no candidate is ever paired with each history item.
    """
    size = F.least(F.size("history"), F.lit(history_size))
    asked = queries.withColumn("history", F.slice("history", F.size("history") - size + 1, size))
    meta = items.select("item_id", "main_category", "brand")
    rows = union.join(meta, "item_id", "left").join(popularity.select("item_id", F.col("score").alias("__score")), "item_id", "left").join(asked.select("query_id", "prior_count"), "query_id")
    for column in ("main_category", "brand"):
        share = affinity(asked, items, column).select("query_id", F.col("value").alias(column), F.col("share").alias(f"__{column}"))
        rows = rows.join(share, ["query_id", column], "left")
    return rows.select(
        "query_id", "item_id", "ord",
        *(inverse_rank(F.col(f"{s}_rank")).alias(f"{s}_inverse_rank") for s in SOURCES),
        "source_count",
        F.coalesce("__score", F.lit(0.0)).alias("popularity_score"),
        F.col("prior_count").alias("user_history_length"),
        F.coalesce("__main_category", F.lit(0.0)).alias("category_affinity"),
        F.coalesce("__brand", F.lit(0.0)).alias("brand_affinity"),
    )


def listed(rows: DataFrame, source: str) -> DataFrame:
    """query_id and the list of ``rows`` (query_id, item_id, score, rank) as arrays."""
    each = F.sort_array(F.collect_list(F.struct("rank", "item_id", "score")))
    return rows.groupBy("query_id").agg(F.transform(each, lambda x: x["item_id"]).alias(f"{source}_items"), F.transform(each, lambda x: x["score"]).alias(f"{source}_scores"))


def beside(queries: DataFrame, lists: DataFrame, source: str) -> DataFrame:
    """``queries`` with a source's arrays, empty where it has no list."""
    none = {c: F.coalesce(c, F.array().cast(lists.schema[c].dataType)) for c in (f"{source}_items", f"{source}_scores")}
    return queries.join(lists, "query_id", "left").withColumns(none)


def items_of(*sources: str):
    """Column of the different items that the arrays of some sources list, in the order of the union."""
    return F.array_distinct(F.concat(*(f"{s}_items" for s in sources)))


def place_of(source: str, item):
    """Column of an item's rank in a source's array, null where it's missing."""
    return F.nullif(F.array_position(f"{source}_items", item), F.lit(0)).cast("int")


def union_of_lists(rows: DataFrame) -> DataFrame:
    """``rows`` (queries with the arrays of all SOURCES) with candidates: merge_ranks's rows as an array. Nothing is shuffled."""

    def candidate(item, place):
        count = sum(F.array_contains(f"{s}_items", item).cast("int") for s in SOURCES)
        return F.struct(item.alias("item_id"), *(place_of(s, item).alias(f"{s}_rank") for s in SOURCES), count.alias("source_count"), (place + 1).alias("ord"))

    return rows.withColumn("candidates", F.transform(items_of(*SOURCES), candidate))


def merge_lists(rows: DataFrame) -> DataFrame:
    """merge_ranks of queries with the arrays of all SOURCES."""
    return union_of_lists(rows).select("query_id", F.inline("candidates"))


def coverage_of_lists(rows: DataFrame) -> DataFrame:
    """union_coverage of queries (query_id, item_id as the target) with the arrays of all SOURCES."""
    has = lambda s: F.array_contains(f"{s}_items", F.col("item_id")).cast("int")
    hits = rows.select(*(has(s).alias(s) for s in SOURCES), F.greatest(*(has(s) for s in SOURCES)).alias("any"), F.size(items_of(*SOURCES)).alias("n"))
    mean = lambda c, name: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(name)
    return hits.agg(F.count("*").alias("examples"), *(mean(s, f"{s}_recall") for s in SOURCES), mean("any", "union_recall"), mean("n", "mean_candidates"))


def union_sizes(rows: DataFrame) -> DataFrame:
    """query_id, candidates (different items) and listings (those of each source) of queries with the arrays of all SOURCES."""
    listings = sum(F.size(f"{s}_items").cast("long") for s in SOURCES)
    return rows.select("query_id", F.size(items_of(*SOURCES)).cast("long").alias("candidates"), listings.alias("listings")).where("candidates > 0")


def group_sizes_of_lists(rows: DataFrame) -> DataFrame:
    """group_sizes of hit_queries_only, from queries (item_id is the target) with the arrays of all SOURCES."""
    union = items_of(*SOURCES)
    return rows.where(F.array_contains(union, F.col("item_id"))).select("query_id", F.size(union).cast("long").alias("group_size"))


class Features:
    """What an item brings to FEATURES: numbers of its category and brand (-1: empty or none) and its popularity, by sorted item."""

    COLUMNS = ("main_category", "brand")

    def __init__(self, items) -> None:
        items = items()
        names = shipping.plain(items.column("item_id")) if items is not None else np.zeros(0)
        order = np.argsort(names)
        self.names, self.codes = names[order], {}
        for c in self.COLUMNS if items is not None else ():
            held = items.column(c).combine_chunks().dictionary_encode()
            empty = np.array([not x for x in held.dictionary.to_pylist()] + [True])
            code = held.indices.fill_null(-1).to_numpy()[order]
            self.codes[c] = np.where(empty[code], -1, code).astype(np.int64)
        self.score = items.column("score").to_numpy()[order] if items is not None else np.zeros(0)

    def shares(self, column: str, owner, item, size, asked, wanted) -> np.ndarray:
        """Of each (asked, wanted) the share of the query's history that has the item's value."""
        if not len(owner):
            return np.zeros(len(asked))
        code, many = self.codes[column], int(self.codes[column].max(initial=0)) + 1
        value = code[item]
        key, n = np.unique((owner * many + value)[value >= 0], return_counts=True)
        own = np.where(wanted >= 0, code[wanted], -1)
        at = shipping.places(key, asked * many + own)
        return np.where((own >= 0) & (at >= 0), n[at] / size[asked] if len(n) else 0.0, 0.0)


def union_arrays(batch) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """merge_ranks of queries with the arrays of all SOURCES: each candidate's query (by place in ``batch``), item, ranks
    (0 where a source lacks it), source_count and ord, in the order of the union."""
    parts, lengths = zip(*(shipping.flat(batch.column(f"{s}_items")) for s in SOURCES))
    owner = np.concatenate([np.repeat(np.arange(batch.num_rows), n) for n in lengths])
    source = np.repeat(np.arange(len(SOURCES)), [len(x) for x in parts])
    rank = np.concatenate([shipping.spans(np.ones(len(n), np.int64), n) for n in lengths])
    names, code = np.unique(np.concatenate([x for x in parts if len(x)] or parts[:1]), return_inverse=True)
    key = owner * max(1, len(names)) + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    group, first = np.cumsum(new) - 1, order[new]
    ranks = []
    for i in range(len(SOURCES)):
        own = np.flatnonzero(source[order] == i)[::-1]  # of an item listed twice the first place holds
        ranks.append(np.zeros(len(first), np.int64))
        ranks[-1][group[own]] = rank[order[own]]
    by = np.lexsort((rank[first], source[first], owner[first]))
    first, ranks = first[by], [r[by] for r in ranks]
    n = np.bincount(owner[first], minlength=batch.num_rows)
    return owner[first], names[code[first]] if len(names) else names, ranks, sum((r > 0).astype(np.int32) for r in ranks), shipping.spans(np.ones(len(n), np.int64), n).astype(np.int32)


def _featured(whole, held: Features, history_size: int, step: int = 1024):
    """Some queries of ``whole`` at a time, their candidates' places among them, and the candidates' columns."""
    for at in range(0, whole.num_rows, step):
        batch = whole.slice(at, step)
        history, lengths = shipping.flat(batch.column("history"))
        owner, known, _, _ = shipping.last_known(shipping.places(held.names, history), lengths, history_size)
        size = np.minimum(lengths, history_size)
        asked, item, ranks, count, order = union_arrays(batch)
        wanted = shipping.places(held.names, item)
        out = {"item_id": item, "ord": order, "source_count": count, "user_history_length": batch.column("prior_count").to_numpy(zero_copy_only=False)[asked]}
        for s, r in zip(SOURCES, ranks):
            out[f"{s}_inverse_rank"] = np.where(r > 0, 1.0 / np.maximum(r, 1), 0.0)
        out["popularity_score"] = np.where(wanted >= 0, held.score[wanted], 0.0) if len(held.names) else np.zeros(len(asked))
        for c, name in zip(Features.COLUMNS, ("category_affinity", "brand_affinity")):
            out[name] = held.shares(c, owner, known, size, asked, wanted)
        yield batch, asked, out


def _ship_features(items: DataFrame, popularity: DataFrame):
    meta = items.select("item_id", "main_category", "brand").join(popularity.select("item_id", F.col("score").cast("double").alias("score")), "item_id", "full").na.fill({"score": 0.0})
    return shipping.ship(Features, meta)


def features_of_lists(rows: DataFrame, items: DataFrame, popularity: DataFrame, *, history_size: int = 20) -> DataFrame:
    """ranker_features of queries with the arrays of all SOURCES: workers hold the items' metadata, and candidates are never shuffled."""
    from pyspark.sql.pandas.types import to_arrow_type

    shared = _ship_features(items, popularity)
    asked = rows.select("query_id", "history", "prior_count", *(f"{s}_items" for s in SOURCES))
    kinds = {c: asked.schema[c].dataType.simpleString() for c in ("query_id", "prior_count")}
    double = ["neural_inverse_rank", "popularity_inverse_rank", "cf_inverse_rank", "popularity_score", "category_affinity", "brand_affinity"]
    types = {"query_id": kinds["query_id"], "item_id": items.schema["item_id"].dataType.simpleString(), "ord": "int", "source_count": "int", "user_history_length": kinds["prior_count"]} | {c: "double" for c in double}
    columns = ("query_id", "item_id", "ord", *FEATURES)
    arrow = {"item_id": to_arrow_type(items.schema["item_id"].dataType), "user_history_length": to_arrow_type(asked.schema["prior_count"].dataType)}

    def run(it):
        import pyarrow as pa

        held = shared.value.built
        for whole in it:
            for batch, asked, out in _featured(whole, held, history_size):
                out = {c: pa.array(x.tolist() if x.dtype.kind in "UO" else x, arrow.get(c)) for c, x in out.items()}
                out["query_id"] = batch.column("query_id").take(pa.array(asked))
                yield pa.RecordBatch.from_arrays([out[c] for c in columns], names=list(columns))

    return asked.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in columns))


def system_listing(items: DataFrame, popularity: DataFrame, predict, most: int, *, history_size: int = 20):
    """The pass (see shipping.through) over queries with the arrays of all SOURCES that adds system_items and system_scores: the
    ``most`` best candidates by ``predict`` (scores of rows of single-precision FEATURES), ties in the order of the union."""
    from pyspark.sql.pandas.types import to_arrow_type

    shared, kind = _ship_features(items, popularity), items.schema["item_id"].dataType
    arrow = to_arrow_type(kind)

    def run(it):
        import pyarrow as pa

        held = shared.value.built
        for whole in it:
            for batch, asked, out in _featured(whole, held, history_size):
                score = predict(np.stack([out[c].astype(np.float32) for c in FEATURES], 1))
                best = np.lexsort((out["ord"], -score, asked))
                n = np.bincount(asked, minlength=batch.num_rows)
                best = best[shipping.spans(np.cumsum(n) - n, np.minimum(n, most))]
                cuts = np.cumsum(np.minimum(n, most))[:-1]
                found = [shipping.lists_of(np.split(out["item_id"][best], cuts), arrow), shipping.lists_of(np.split(score[best], cuts), pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, "system_items", "system_scores"])

    return run, {"system_items": f"array<{kind.simpleString()}>", "system_scores": "array<double>"}


def hit_queries_only(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Candidate rows with a label, of those queries whose target was retrieved; a missed target is never put in."""
    labelled = rows.join(targets.select("query_id", F.col("item_id").alias("__target")), "query_id").withColumn("label", (F.col("item_id") == F.col("__target")).cast("int"))
    hit = labelled.where("label = 1").select("query_id").distinct()
    return labelled.join(hit, "query_id", "left_semi").drop("__target")


def group_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query_id").count().withColumnRenamed("count", "group_size")
