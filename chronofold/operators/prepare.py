"""From an event log to time-safe interactions: window, dedup, split, training-only k-core, warm flags."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.time import micros, months_before
from chronofold.session import cut_lineage, sweep


def recent(events: DataFrame, months: int) -> DataFrame:
    """Events of the last ``months`` before the newest one, both ends included. The newest is one value, so its join is a scalar's."""
    newest = events.agg(F.max("event_ts").alias("__newest"))
    return events.join(F.broadcast(newest), F.col("event_ts") >= months_before(F.col("__newest"), months)).drop("__newest")


def latest_per_pair(events: DataFrame) -> DataFrame:
    """The last event of each user and item; of several at once a verified one. A max by struct combines map-side, unlike a window."""
    best = F.max(F.struct("event_ts", "verified_purchase")).alias("__best")
    return events.groupBy("user_id", "item_id").agg(best).select("user_id", "item_id", F.col("__best.event_ts").alias("event_ts"), F.col("__best.verified_purchase").alias("verified_purchase"))


def exact_quantiles(df: DataFrame, column: str, probabilities: list[float], bits: int = 12) -> list[float]:
    """Interpolated quantiles of a column of longs by radix selection.

    Each pass counts values by ``bits`` more of their leading bits, only where a wanted rank lies, so what
    reaches the driver is bounded and no task sorts or holds all values.
    """
    span = df.agg(F.count(column).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).first()
    if not span["n"]:
        raise ValueError("no values to take quantiles of")
    low, width = span["low"], max(1, (span["high"] - span["low"]).bit_length())
    at = [(span["n"] - 1) * p for p in probabilities]
    ranks = sorted({int(h) for h in at} | {min(span["n"] - 1, int(h) + 1) for h in at})
    found = {r: (0, r) for r in ranks}  # rank: leading bits so far, rank among those that share them
    shift = -(-width // bits) * bits
    value = F.col(column) - F.lit(low)
    while shift > 0:
        prefixes = {p for p, _ in found.values()}
        rows = df.where(F.shiftright(value, shift).isin(*prefixes))
        shift -= bits
        counts = sorted((r["b"], r["count"]) for r in rows.where(F.col(column).isNotNull()).groupBy(F.shiftright(value, shift).alias("b")).count().collect())
        for rank, (prefix, inside) in list(found.items()):
            for b, n in counts:
                if b >> bits == prefix:
                    if inside < n:
                        found[rank] = (b, inside)
                        break
                    inside -= n
    exact = {r: low + v for r, (v, _) in found.items()}
    out = []
    for h in at:
        a, b = exact[int(h)], exact[min(span["n"] - 1, int(h) + 1)]
        out.append(a + (b - a) * (h - int(h)))
    return out


@dataclass(frozen=True)
class Boundaries:
    """Starts of validation and test, in microseconds since the epoch."""

    validation: float
    test: float

    def __post_init__(self) -> None:
        if self.validation >= self.test:
            raise ValueError("validation has to start before test")


def check_fractions(validation: float, test: float) -> None:
    if validation <= 0 or test <= 0 or validation + test >= 1:
        raise ValueError("fractions have to be positive and sum to less than one")


def quantile_boundaries(events: DataFrame, validation: float, test: float) -> Boundaries:
    check_fractions(validation, test)
    return Boundaries(*exact_quantiles(events.select(micros(F.col("event_ts")).alias("us")), "us", [1 - validation - test, 1 - test]))


def positional_boundaries(timestamps: list[datetime], validation: float, test: float) -> tuple[datetime, datetime]:
    """The other rule: the values at the positions count * (1 - fraction) of the sorted list, without interpolation."""
    check_fractions(validation, test)
    if len(timestamps) < 3:
        raise ValueError("three timestamps are needed at least")
    ordered = sorted(timestamps)
    first, second = (ordered[int(len(ordered) * p)] for p in (1 - validation - test, 1 - test))
    if first >= second:
        raise ValueError("the timestamps give no three periods")
    return first, second


def split_name(timestamp, boundaries: tuple) -> str:
    return "train" if timestamp < boundaries[0] else "validation" if timestamp < boundaries[1] else "test"


def label_split(events: DataFrame, boundaries: Boundaries) -> DataFrame:
    us = micros(F.col("event_ts"))
    return events.withColumn("split", F.when(us < F.lit(boundaries.validation), "train").when(us < F.lit(boundaries.test), "validation").otherwise("test"))


#: Events of a group whose core one task settles; with more, rounds are joins. Ids (numbers) that a join sends to each worker.
CORE_EVENTS, SENT_IDS = 1 << 24, 1 << 21


def _packed(by: tuple[str, ...]):
    """Rows (by, user_id, item_id) as compressed Arrow buffers of up to a million rows of one group."""

    def run(it):
        import pyarrow as pa
        import pyarrow.compute as pc

        def pack(batches):
            whole = pa.Table.from_batches(batches)
            for group in whole.select(by).group_by(by).aggregate([]).to_pylist():
                rows = whole
                for c, x in group.items():
                    rows = rows.filter(pc.equal(rows.column(c), x))
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, rows.select(["user_id", "item_id"]).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_table(rows.select(["user_id", "item_id"]))
                told = {c: pa.array([x], whole.schema.field(c).type) for c, x in group.items()}
                yield pa.RecordBatch.from_pydict(told | {"raw": pa.array([out.getvalue().to_pybytes()], pa.binary()), "n": pa.array([rows.num_rows], pa.int64())})

        held, n = [], 0
        for batch in it:
            held, n = [*held, batch] if batch.num_rows else held, n + batch.num_rows
            if n >= 1 << 20:
                yield from pack(held)
                held, n = [], 0
        if held:
            yield from pack(held)

    return run


def settled(user: np.ndarray, item: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the users and items that the k-core of the rows (user, item) has."""
    while len(user):
        kept = (np.bincount(user) >= k)[user] & (np.bincount(item) >= k)[item]
        if kept.all():
            break
        user, item = user[kept], item[kept]
    return np.unique(user), np.unique(item)


def _settle(by: tuple[str, ...], k: int):
    """Of a group's packed rows: its core's users, then its core's items."""

    def run(rows):
        import pyarrow as pa

        columns: dict[str, list] = {"user_id": [], "item_id": []}
        for raw in rows.column("raw"):
            part = pa.ipc.open_stream(raw.as_buffer()).read_all()
            for c, held in columns.items():
                held += part.column(c).chunks
        names, numbers = {}, {}
        for c in list(columns):
            kind, parts = columns[c][0].type, columns.pop(c)
            # One array, as each chunk would bring a dictionary of its own; strings beyond 2 GB need long offsets.
            coded = pa.concat_arrays([x.cast(pa.large_string()) for x in parts] if pa.types.is_string(kind) else parts).dictionary_encode()
            names[c], numbers[c] = coded.dictionary.cast(kind), coded.indices.to_numpy()
            del parts, coded
        found = dict(zip(names, settled(numbers["user_id"], numbers["item_id"], k)))
        own = {c: pa.array(rows.column(c).to_pylist()[:1] * sum(map(len, found.values())), rows.schema.field(c).type) for c in by}
        for c, other in (("user_id", "item_id"), ("item_id", "user_id")):
            parts = [names[c].take(pa.array(found[c])), pa.nulls(len(found[other]), names[c].type)]
            own[c] = pa.concat_arrays(parts if c == "user_id" else parts[::-1])
        return pa.table(own)

    return run


def core_ids(events: DataFrame, k: int, most_rounds: int = 200, *, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(``by``, user_id) and (``by``, item_id) of the rows left when users and items with under ``k`` rows are dropped
    together, round by round, until none is. With ``by`` each of its groups has a core of its own.

    The rounds need keys only. Packed, the keys of a group are a few bytes a row, and up to CORE_EVENTS rows of it are
    settled in one task, so no round writes anything. With more, each round is a checkpoint of the keys that are left.
    """
    if k < 1:
        raise ValueError("k has to be at least 1")
    keys = events.select(*by, "user_id", "item_id").where("user_id IS NOT NULL AND item_id IS NOT NULL")
    group = by or ("__group",)
    keyed = keys if by else keys.withColumn("__group", F.lit(0))
    kinds = {c: keyed.schema[c].dataType.simpleString() for c in (*group, "user_id", "item_id")}
    packs = cut_lineage(keyed.mapInArrow(_packed(group), ", ".join(f"{c} {kinds[c]}" for c in group) + ", raw binary, n long"))
    if (packs.groupBy(*group).agg(F.sum("n").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0) <= CORE_EVENTS:
        found = cut_lineage(packs.groupBy(*group).applyInArrow(_settle(group, k), ", ".join(f"{c} {x}" for c, x in kinds.items())))
        return tuple(found.where(F.col(c).isNotNull()).select(*by, c) for c in ("user_id", "item_id"))
    del packs
    rows = _core_by_rounds(keys, k, most_rounds, by)
    return tuple(cut_lineage(rows.select(*by, c).distinct()) for c in ("user_id", "item_id"))


def _core_by_rounds(keys: DataFrame, k: int, most_rounds: int, by: tuple[str, ...]) -> DataFrame:
    """The core's rows of ``keys``. Both counts of a round see the same rows, supports are counted map-side first, and
    what a round no longer needs is let go."""
    rows = cut_lineage(keys)
    before = rows.count()
    for _ in range(most_rounds):
        enough = lambda c: rows.groupBy(*by, c).count().where(F.col("count") >= k).select(*by, c)  # noqa: B023, E731
        rows = cut_lineage(rows.join(enough("user_id"), [*by, "user_id"], "left_semi").join(enough("item_id"), [*by, "item_id"], "left_semi").select(*keys.columns))
        sweep(rows.sparkSession)
        after = rows.count()
        if after == before:
            return rows
        before = after
    raise RuntimeError("the k-core did not settle")


def sent(ids: DataFrame) -> DataFrame:
    """A table of one column of different ids, to be broadcast if they are numbers and at most SENT_IDS."""
    numbers = len(ids.columns) == 1 and ids.dtypes[0][1] in ("int", "bigint")
    return F.broadcast(ids) if numbers and ids.count() <= SENT_IDS else ids


def between(events: DataFrame, users: DataFrame, items: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """The events whose user and item are both named."""
    return events.join(sent(users), [*by, "user_id"], "left_semi").join(sent(items), [*by, "item_id"], "left_semi").select(*events.columns)


def k_core(events: DataFrame, k: int, most_rounds: int = 200, *, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of the k-core (see core_ids): just those between its users and items, as no other row could have been dropped."""
    return cut_lineage(between(events, *core_ids(events, k, most_rounds, by=by), by=by))


def k_core_rows(interactions, k: int, *, user: str = "user_id", item: str = "item_id") -> tuple[set[str], set[str]]:
    """The users and items of the k-core of a few rows (mappings) on the driver; the input isn't changed."""
    if k < 1:
        raise ValueError("k has to be at least 1")
    left = [(str(r[user]), str(r[item])) for r in interactions]
    while True:
        users, items = Counter(u for u, _ in left), Counter(i for _, i in left)
        kept = [(u, i) for u, i in left if min(users[u], items[i]) >= k]
        if len(kept) == len(left):
            return set(users), set(items)
        left = kept


def warm_flags(events: DataFrame, core: DataFrame) -> DataFrame:
    return flagged(events, *(core.select(c).distinct() for c in ("user_id", "item_id")))


def flagged(events: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """warm_flags by the different users and items of the core."""
    rows = events.join(sent(users).withColumn("__u", F.lit(True)), "user_id", "left").join(sent(items).withColumn("__i", F.lit(True)), "item_id", "left")
    return rows.select("user_id", "item_id", "event_ts", "verified_purchase", "split", F.col("__u").isNotNull().alias("is_warm_user"), F.col("__i").isNotNull().alias("is_warm_item"))


def warm_events(interactions: DataFrame, *splits: str) -> DataFrame:
    return interactions.where(F.col("split").isin(*splits) & F.col("is_warm_user") & F.col("is_warm_item"))


def item_catalog(items: DataFrame, interactions: DataFrame) -> DataFrame:
    """Metadata of the items that occur, one row each; of several the least by title, category, brand."""
    seen = items.join(interactions.select("item_id").distinct(), "item_id", "left_semi")
    return seen.groupBy("item_id").agg(F.min(F.struct("title", "main_category", "brand")).alias("m")).select("item_id", "m.*")


def manifest_counts(interactions: DataFrame) -> DataFrame:
    warm = lambda flag, c: F.count_distinct(F.when(F.col(flag), F.col(c)))
    return interactions.agg(F.count("*").alias("total_events"), F.count_if(F.col("split") == "train").alias("train_events"), warm("is_warm_user", "user_id").alias("warm_users"), warm("is_warm_item", "item_id").alias("warm_items"))
