"""Item-item cosine: sparse co-occurrence, recency-weighted scores, and the list with its unscored rest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.vectors import cosine
from chronofold.operators import shipping
from chronofold.operators.sequences import dense_index
from chronofold.session import cut_lineage

DIGITS = 9
#: Items of a user's basket that meet as one; similarities and queries that one task of a product holds.
BASKET, PAIRS, QUERIES = 1_000, 1_000_000, 20_000
#: Edges that each worker may hold; with more, similarities are dealt out in blocks.
EDGES = 1 << 24
#: Products that a task makes at once.
PRODUCTS = 1 << 18


def fit_edges(events: DataFrame) -> DataFrame:
    """user_id, item_id and how often they occur together."""
    return events.groupBy("user_id", "item_id").agg(F.count("*").cast("double").alias("value"))


def item_norms(edges: DataFrame) -> DataFrame:
    return edges.groupBy("item_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))


def cosine_pairs(edges: DataFrame) -> DataFrame:
    """item_i, item_j, similarity of all items that share a user (an item with itself among them).

    The join runs within users, so the pairs of a user's basket are what grows. A basket of more than BASKET items
    is cut into parts, and each two parts meet under a key of their own, so a hot user's pairs are many tasks.
    Pairs are summed map-side before they are shuffled.
    """
    norms = item_norms(edges)
    sizes = edges.groupBy("user_id").agg(F.ceil(F.count("*") / BASKET).cast("int").alias("parts"))
    split = edges.join(sizes, "user_id").withColumn("part", F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = split.select("user_id", F.col("item_id").alias("item_i"), F.col("value").alias("a"), F.col("part").alias("p"), every.alias("q"))
    right = split.select("user_id", F.col("item_id").alias("item_j"), F.col("value").alias("b"), every.alias("p"), F.col("part").alias("q"))
    products = left.join(right, ["user_id", "p", "q"]).groupBy("item_i", "item_j").agg(F.sum(F.col("a") * F.col("b")).alias("product"))
    ni, nj = norms.select(F.col("item_id").alias("item_i"), F.col("norm").alias("norm_i")), norms.select(F.col("item_id").alias("item_j"), F.col("norm").alias("norm_j"))
    return products.join(ni, "item_i").join(nj, "item_j").select("item_i", "item_j", cosine(F.col("product"), F.col("norm_i"), F.col("norm_j")).alias("similarity"))


def weighted_history(queries: DataFrame, norms: DataFrame, decay: float, history_size: int) -> DataFrame:
    """query_id, item_i, weight: of the last ``history_size`` items those with a norm, decay ** (places from the newest of them)."""
    if not 0 < decay <= 1:
        raise ValueError("decay has to be in (0, 1]")
    size = F.least(F.size("history"), F.lit(history_size))
    last = queries.select("query_id", F.posexplode(F.slice("history", F.size("history") - size + 1, size)).alias("slot", "item_i"))
    usable = last.join(norms.where("norm > 0").select(F.col("item_id").alias("item_i")), "item_i", "left_semi")
    newest_first = Window.partitionBy("query_id").orderBy(F.desc("slot"))
    return usable.withColumn("weight", F.pow(F.lit(float(decay)), F.row_number().over(newest_first) - 1)).select("query_id", "item_i", "weight")


def score_queries(queries: DataFrame, edges: DataFrame, *, decay: float = 0.8, history_size: int = 20) -> DataFrame:
    """query_id, item_id, score > 0 of unseen items. ``queries``: query_id, history and seen (arrays)."""
    pairs = cosine_pairs(edges)
    weights = weighted_history(queries, item_norms(edges), decay, history_size)
    scored = weights.join(pairs, "item_i").groupBy("query_id", F.col("item_j").alias("item_id")).agg(F.round(F.sum(F.col("weight") * F.col("similarity")), DIGITS).alias("score"))
    seen = queries.select("query_id", F.explode(F.array_union("seen", "history")).alias("item_id"))
    return scored.join(seen, ["query_id", "item_id"], "left_anti")


def rank_scored(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _best_of_block(k: int, item_type, query_type):
    """Cogroup of queries (query_id, items, weights, seen) and similarities (item_i, item_j, similarity): each query's ``k`` best."""

    def run(queries, pairs):
        import pyarrow as pa

        out: list[list] = [[], [], []]
        if queries.num_rows and pairs.num_rows:
            rows, at = np.unique(np.array(pairs.column("item_i").to_pylist()), return_inverse=True)
            names, column = np.unique(np.array(pairs.column("item_j").to_pylist()), return_inverse=True)
            order = np.argsort(at, kind="stable")
            column, value = column[order], pairs.column("similarity").to_numpy()[order]
            start = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(rows)))])
            row_of, place = {x: i for i, x in enumerate(rows.tolist())}, {x: i for i, x in enumerate(names.tolist())}
            for name, items, weights, seen in zip(*(queries.column(c).to_pylist() for c in ("query_id", "items", "weights", "seen"))):
                use = [(row_of[x], w) for x, w in zip(items, weights) if x in row_of]
                if not use:
                    continue
                spans = [slice(start[i], start[i + 1]) for i, _ in use]
                found = np.concatenate([column[x] for x in spans])
                score = np.bincount(found, np.concatenate([value[x] * w for x, (_, w) in zip(spans, use)]), minlength=len(names))
                score = np.round(score, DIGITS)
                scored = np.zeros(len(names), bool)
                scored[found] = True
                scored[[place[x] for x in seen if x in place]] = False
                among = np.flatnonzero(scored)
                if len(among) > k:
                    own = score[among]
                    among = among[own >= np.partition(own, len(own) - k)[len(own) - k]]
                # Names are sorted, so a stable sort breaks ties by item.
                best = among[np.argsort(-score[among], kind="stable")][:k]
                out[0] += [name] * len(best)
                out[1] += names[best].tolist()
                out[2] += score[best].tolist()
        return pa.table([pa.array(out[0], query_type), pa.array(out[1], item_type), pa.array(out[2], pa.float64())], names=["query_id", "item_id", "score"])

    return run


def best_scored(queries: DataFrame, pairs: DataFrame, norms: DataFrame, k: int, *, decay: float = 0.8, history_size: int = 20) -> DataFrame:
    """query_id, item_id, score, rank: the ``k`` best scored unseen items, as score_queries has them.

    A blocked sparse product: similarities are dealt by item_j to blocks of some PAIRS, queries to blocks of some
    QUERIES, and each two meet in one task, where a query's scores are one dense row of the block. So the neighbours
    of 20 items are never rows, and k a query and block is all that is shuffled. ``pairs`` should be checkpointed.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    item, query = pairs.schema["item_j"].dataType, queries.schema["query_id"].dataType
    weights = weighted_history(queries, norms, decay, history_size).groupBy("query_id").agg(F.collect_list("item_i").alias("items"), F.collect_list("weight").alias("weights"))
    rows = cut_lineage(weights.join(queries.select("query_id", F.array_union("seen", "history").alias("seen")), "query_id"))
    columns, salts = max(4, -(-pairs.count() // PAIRS)), max(1, -(-rows.count() // QUERIES))
    left = rows.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(salts).cast("long"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    right = pairs.withColumn("block", F.pmod(F.xxhash64("item_j"), F.lit(columns)).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    schema = f"query_id {query.simpleString()}, item_id {item.simpleString()}, score double"
    best = left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt")).applyInArrow(_best_of_block(k, to_arrow_type(item), to_arrow_type(query)), schema)
    return rank_scored(best, k)


class Baskets:
    """Edges by user and by item, as places of sorted users and items."""

    def __init__(self, edges, items) -> None:
        items, edges = items(), edges()
        order = np.argsort(items.column("index").to_numpy()) if items is not None else np.zeros(0, np.int64)
        self.names = shipping.plain(items.column("item_id"))[order] if items is not None else np.zeros(0)
        n = len(self.names)
        user, item = (edges.column(c).to_numpy() if edges is not None else np.zeros(0, np.int32) for c in ("u", "i"))
        # Without the column all edges count once.
        value = edges.column("value").to_numpy() if edges is not None and "value" in edges.column_names else None
        del items, edges, order
        self.norm = np.sqrt(np.bincount(item, None if value is None else value * value, minlength=n))
        self.user_size, self.item_size = np.bincount(user), np.bincount(item, minlength=n)
        self.user_start, self.item_start = (np.cumsum(x) - x for x in (self.user_size, self.item_size))
        # Products that each item's neighbours are made of.
        self.cost = np.zeros(n, np.int64)
        for at in range(0, len(item), 1 << 21):
            cut = slice(at, at + (1 << 21))
            self.cost += np.bincount(item[cut], self.user_size[user[cut]], minlength=n).astype(np.int64)
        order = np.argsort(user, kind="stable")
        self.items_of, self.item_value = item[order], None if value is None else value[order]
        order = None
        order = np.argsort(item, kind="stable")
        self.users_of, self.user_value = user[order], None if value is None else value[order]

    def products(self, owner: np.ndarray, item: np.ndarray, weight: np.ndarray):
        """(owner, item, product) of all neighbours of items, weighted, not yet summed nor divided by the neighbours' norms."""
        n = self.item_size[item]
        at = shipping.spans(self.item_start[item], n)
        owner, weight, user = np.repeat(owner, n), np.repeat(weight / self.norm[item], n), self.users_of[at]
        if self.user_value is not None:
            weight = weight * self.user_value[at]
        return owner, weight, user

    def neighbours(self, owner, weight, user):
        n = self.user_size[user]
        at = shipping.spans(self.user_start[user], n)
        value = np.repeat(weight, n)
        return np.repeat(owner, n), self.items_of[at], value if self.item_value is None else value * self.item_value[at]

    def summed(self, owner: np.ndarray, item: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys owner * items + neighbour, and their scores."""
        n = len(self.names)
        owner, weight, user = self.products(owner, item, weight)
        sizes = np.cumsum(self.user_size[user])
        if not len(sizes):
            return np.zeros(0, np.int64), np.zeros(0)
        if sizes[-1] <= 2 * PRODUCTS or owner[0] != owner[-1]:
            owner, found, value = self.neighbours(owner, weight, user)
            key = owner * n + found
            order = np.argsort(key)
            key, value = key[order], value[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, total = key[first], np.add.reduceat(value, first)
        else:  # one query with many products: a dense row, some of them at a time
            total, met = np.zeros(n), np.zeros(n, bool)
            for part in np.split(np.arange(len(user)), np.flatnonzero(np.diff(sizes // PRODUCTS)) + 1):
                _, found, value = self.neighbours(owner[part], weight[part], user[part])
                total += np.bincount(found, value, minlength=n)
                met[found] = True
            found = np.flatnonzero(met)
            key, total = owner[0] * n + found, total[found]
        return key, np.round(total / self.norm[key % n], DIGITS)

    def scored(self, batch, decay: float, history_size: int):
        """For some queries at a time, by the products that they need: (first, last, usable, taken, owner, item, score).

        ``usable`` tells how many usable items a query's history has; ``taken`` are (owner, item) of what it has seen.
        """
        n = len(self.names)
        history, lengths = shipping.flat(batch.column("history"))
        owner, item, rank, _ = shipping.last_known(shipping.places(self.names, history), lengths, history_size)
        usable = np.bincount(owner, minlength=len(lengths))
        seen, sizes = shipping.flat(batch.column("seen"))
        seen = shipping.places(self.names, np.concatenate([seen, history]) if len(seen) and len(history) else seen if len(seen) else history)
        seen_owner = np.concatenate([np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(lengths)), lengths)])
        taken = np.unique(seen_owner[seen >= 0] * n + seen[seen >= 0])
        cost = np.cumsum(np.bincount(owner, self.cost[item], minlength=len(lengths)))
        ends = np.concatenate([np.flatnonzero(np.diff(cost // PRODUCTS)) + 1, [len(lengths)]])
        first = 0
        for last in ends.tolist():
            for a, b in ((first, last),) if last - first == 1 or cost[last - 1] - (cost[first - 1] if first else 0) <= 2 * PRODUCTS else [(x, x + 1) for x in range(first, last)]:
                own = slice(*np.searchsorted(owner, [a, b]))
                key, score = self.summed(owner[own], item[own], decay ** rank[own].astype(float))
                known = taken[slice(*np.searchsorted(taken, [a * n, b * n]))]
                free = ~np.isin(key, known, assume_unique=True)
                yield a, b, usable, known, key[free] // n if n else key, key[free] % n if n else key, score[free]
            first = last

    def best(self, batch, k: int, decay: float, history_size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Each query's k best items and their scores, with unscored ones by id if there are fewer; nothing without a usable history."""
        items, scores, n = [], [], len(self.names)
        for a, b, usable, known, owner, item, score in self.scored(batch, decay, history_size):
            cuts, closed = np.searchsorted(owner, np.arange(a, b + 1)), np.searchsorted(known, np.arange(a, b + 1) * n)
            for q in range(a, b):
                own = slice(cuts[q - a], cuts[q - a + 1])
                found, value = item[own], score[own]
                if len(value) > k:
                    among = np.flatnonzero(value >= np.partition(value, len(value) - k)[len(value) - k])
                    found, value = found[among], value[among]
                # Items are sorted, so a stable sort breaks ties by item.
                order = np.argsort(-value, kind="stable")[:k]
                found, value = found[order], value[order]
                if len(found) < k and usable[q]:
                    taken = np.concatenate([known[closed[q - a] : closed[q - a + 1]] - q * n, found])
                    rest = np.setdiff1d(np.arange(min(n, len(taken) + k - len(found))), taken)[: k - len(found)]
                    found, value = np.concatenate([found, rest]), np.concatenate([value, np.zeros(len(rest))])
                items.append(self.names[found])
                scores.append(value)
        return items, scores


def shipped(edges: DataFrame):
    """A broadcast of Baskets, or None if there are more than EDGES edges."""
    if edges.count() > EDGES:
        return None
    norms = item_norms(edges)
    items, users = dense_index(norms, "item_id"), dense_index(edges, "user_id").withColumnRenamed("index", "u")
    numbered = edges.join(items, "item_id").join(users, "user_id").select(F.col("u").cast("int"), F.col("index").cast("int").alias("i"), *([] if edges.where("value <> 1").isEmpty() else ["value"]))
    return shipping.ship(Baskets, numbered, items)


def lists(queries: DataFrame, edges: DataFrame, k: int, *, decay: float = 0.8, history_size: int = 20, shared=None) -> DataFrame | None:
    """``queries`` with cf_items and cf_scores: top_k's list as arrays, empty without a usable history. Needs no shuffle of
    queries: each worker holds the edges, and a query's scores are sums over its items' users' items. None if there are too many edges."""
    if not 0 < decay <= 1:
        raise ValueError("decay has to be in (0, 1]")
    shared = shared or shipped(edges)
    return None if shared is None else shipping.through(queries, [listing(shared, edges.schema["item_id"].dataType, k, decay=decay, history_size=history_size)])


def listing(shared, kind, k: int, *, decay: float = 0.8, history_size: int = 20):
    """The pass (see shipping.through) that makes lists."""
    if not 0 < decay <= 1:
        raise ValueError("decay has to be in (0, 1]")
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def run(it):
        import pyarrow as pa

        baskets = shared.value.built
        for batch in it:
            if batch.num_rows:
                items, scores = baskets.best(batch, k, decay, history_size)
                yield pa.RecordBatch.from_arrays([*batch.columns, shipping.lists_of(items, arrow), shipping.lists_of(scores, pa.float64())], names=[*batch.schema.names, "cf_items", "cf_scores"])

    return run, {"cf_items": f"array<{kind.simpleString()}>", "cf_scores": "array<double>"}


def scores(queries: DataFrame, edges: DataFrame, *, decay: float = 0.8, history_size: int = 20) -> DataFrame:
    """score_queries, by the same method."""
    from pyspark.sql.pandas.types import to_arrow_type

    shared = shipped(edges)
    if shared is None:
        return score_queries(queries, edges, decay=decay, history_size=history_size)
    item, query = edges.schema["item_id"].dataType, queries.schema["query_id"].dataType
    item_arrow = to_arrow_type(item)

    def run(it):
        import pyarrow as pa

        baskets = shared.value.built
        for batch in it:
            names = batch.column("query_id")
            for _, _, _, _, owner, found, score in baskets.scored(batch, decay, history_size) if batch.num_rows else ():
                ids = baskets.names[found]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(owner)), pa.array(ids.tolist() if ids.dtype.kind == "U" else ids, item_arrow), pa.array(score)], names=["query_id", "item_id", "score"])

    return queries.select("query_id", "history", "seen").mapInArrow(run, f"query_id {query.simpleString()}, item_id {item.simpleString()}, score double")


def top_k(queries: DataFrame, edges: DataFrame, k: int, *, decay: float = 0.8, history_size: int = 20, index: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """query_id, item_id, score, rank: the best ``k`` unseen items, then unscored ones by id while fewer than k.

    A query with nothing usable in its history has no list. ``pairs`` are the edges' cosine_pairs, if they were
    made before. Unscored items come without a product of queries and catalogue: a query that lacks d items needs
    the first d free ids, and these are among the first d + (its seen and scored items) of the catalogue, so it
    asks for just those places. Up to EDGES edges each worker holds them all, and lists are made there (see lists).
    """
    held = lists(queries.select("query_id", "history", "seen"), edges, k, decay=decay, history_size=history_size)
    if held is not None:
        return unlisted(held, "cf")
    norms = item_norms(edges)
    best = cut_lineage(best_scored(queries, pairs if pairs is not None else cut_lineage(cosine_pairs(edges)), norms, k, decay=decay, history_size=history_size))
    usable = weighted_history(queries, norms, decay, history_size).select("query_id").distinct()
    counts = best.groupBy("query_id").agg(F.count("*").alias("have"), F.collect_list("item_id").alias("items"))
    lacking = (
        queries.join(usable, "query_id", "left_semi")
        .join(counts, "query_id", "left")
        .select("query_id", F.coalesce("have", F.lit(0)).alias("have"), F.array_union(F.array_union("seen", "history"), F.coalesce("items", F.expr("slice(history, 1, 0)"))).alias("taken"))
        .where(F.col("have") < k)
    )
    places = index if index is not None else dense_index(norms, "item_id")
    asked = lacking.select("query_id", "have", "taken", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k) - F.col("have") + F.size("taken") - 1)).alias("index"))
    free = asked.join(places, "index").where(~F.array_contains("taken", F.col("item_id")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("index")) + F.col("have")
    rest = free.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "item_id", F.lit(0.0).alias("score"), F.col("rank").cast("int"))
    return best.select("query_id", "item_id", "score", "rank").unionByName(rest)


def unlisted(rows: DataFrame, source: str) -> DataFrame:
    """query_id, item_id, score, rank of the lists that ``rows`` have as arrays from ``source``."""
    names = [f"{source}_items", f"{source}_scores"]
    each = rows.select("query_id", F.posexplode(F.arrays_zip(*names)).alias("place", "x"))
    return each.select("query_id", F.col(f"x.{names[0]}").alias("item_id"), F.col(f"x.{names[1]}").alias("score"), (F.col("place") + 1).alias("rank"))


def recommend_cf(edges: DataFrame, history: list, seen: list | None = None, limit: int = 10, **more) -> list:
    """For one user; neither argument is changed."""
    spark = edges.sparkSession
    schema = edges.schema["item_id"].dataType.simpleString()
    query = spark.createDataFrame([(0, list(history), list(seen or []))], f"query_id long, history array<{schema}>, seen array<{schema}>")
    return [r["item_id"] for r in top_k(query, edges, limit, **more).orderBy("rank").collect()]
