"""Helpers shared by the corpus operators: reading, lineage cuts, exact distributed prefix sums, text hashing."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: One word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one NumPy step handles at once.
CHUNK = 1 << 18


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared checkpoint folder; in local mode without one, make a temporary folder."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="chronofold-"))


#: Rows of a few numbers that one partition holds without strain.
ROWS = 50_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once and go on from there.

    Row ids and samples made before the cut stay what they are when an executor is lost afterwards. ``rows`` is for
    tables of a few numbers: they go on in as few partitions as hold so many rows each, as counted while writing.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if rows is None:
        return df.checkpoint(eager=True)
    told = Observation()
    held = df.observe(told, F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    n = told.get.get("n")
    return held if n is None else held.coalesce(max(1, -(-n // rows)))


def text_key() -> Column:
    """A content key of the columns doc_id and text: the same whenever and wherever a row is read."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


#: Keys with more than this share of all rows, at most its inverse in number, are settled by a broadcast.
HOT = 1 / 1000


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of ``rows`` with ``table``, which has one row for each key, where a key may hold any share of the rows.

    The keys of more than HOT of all rows (1000 at most, whatever the data) are counted first, and their rows meet
    a broadcast; they go through the ordinary join under salts of their own, as rows without a key do, so no task
    gathers them. ``rows`` are read twice and should be checkpointed.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    least = int(rows.count() * HOT)
    hot = cut(counts.where(F.col("__n") > max(1, least)).select(*keys))
    if hot.isEmpty():
        return rows.join(table, keys, "left")
    told = [c for c in table.columns if c not in keys]
    held, salt = fresh("__held", rows, table), fresh("__salt", rows, table)
    few = cut(hot.join(table, keys, "left").select(*keys, F.struct(*told).alias(held)))
    marked = rows.join(F.broadcast(few), keys, "left")
    nowhere = F.col(held).isNotNull() | reduce(or_, (F.col(k).isNull() for k in keys))
    # A literal salt would be taken out of the join's keys again.
    own = F.xxhash64(*keys)
    marked = marked.withColumn(salt, F.when(nowhere, F.xxhash64(*(F.col(c) for c in rows.columns), F.lit(1))).otherwise(own))
    rest = table.withColumn(salt, own).select(*keys, salt, F.struct(*told).alias(f"{held}_rest"))
    out = marked.join(rest, [*keys, salt], "left")
    return out.select(*rows.columns, *(F.when(F.col(held).isNotNull(), F.col(held)[c]).otherwise(F.col(f"{held}_rest")[c]).alias(c) for c in told))


def range_bits(rows: int, least: int = 10, most: int = 18) -> int:
    """Bits of a hash range such that a range of ``rows`` rows' hashes has some ten thousand rows at most."""
    return max(least, min(most, (rows // 10_000).bit_length()))


def running_total(df: DataFrame, group: str, order: list[str], value: Column, out: str, *, totals: DataFrame | None = None, bits: int = 10, part: Column | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of ``group`` that come before a row by ``order``.

    ``part`` deals a group out over ranges of the order: a whole number (not null) that never falls along it.
    Without it ``order[0]`` has to be a well-mixed 64-bit hash (not null), and there are ``2 ** bits`` ranges of
    that. So a group with a third of all rows is no larger task than any other: in each range the sum runs by
    itself, and the ranges' own totals give where each one starts. ``group`` is not null. ``totals`` may be a
    narrow form of ``df`` with the same rows to take these totals from.
    """
    part = F.shiftright(F.col(order[0]), 64 - bits) if part is None else part
    at, inner, named, span, start = (fresh(x, df) for x in ("__part", "__inside", "__group", "__range", "__start"))
    starts = (
        (df if totals is None else totals)
        .groupBy(F.col(group).alias(named), part.alias(span))
        .agg(F.sum(value).alias("__sum"))
        .withColumn(start, F.coalesce(F.sum("__sum").over(Window.partitionBy(named).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("__sum")
    )
    inside = Window.partitionBy(group, at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn(at, part).withColumn(inner, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(starts, (F.col(group) == F.col(named)) & (F.col(at) == F.col(span))).withColumn(out, F.col(start) + F.col(inner)).drop(at, span, named, start, inner)


def chunks(sizes: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``limit`` bytes together; a longer text stands alone."""
    i = 0
    while i < len(sizes):
        j, total = i + 1, int(sizes[i])
        while j < len(sizes) and total + int(sizes[j]) <= limit:
            total += int(sizes[j])
            j += 1
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """Finish of splitmix64: a bijection of 64 bits that leaves no visible structure."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, up to one more multiple of it."""
    p = np.uint64((1 << 31) - 1)
    x = (x & p) + (x >> np.uint64(31))
    return (x & p) + (x >> np.uint64(31))


class Powers:
    """Prefix hashes by which the hash of any range of bytes or code points costs a few look-ups.

    Two polynomials modulo the prime 2**31 - 1, so two different ranges of n units agree with odds of (n / 2**31)**2
    at most over the choice of the bases, whatever their content.
    """

    P = (1 << 31) - 1
    BASES = (1_204_377_149, 1_871_246_033)

    def __init__(self) -> None:
        self.up = np.ones((2, 1), np.uint64)
        self.down = np.ones((2, 1), np.uint64)

    def grow(self, n: int) -> None:
        while self.up.shape[1] <= n:
            m = self.up.shape[1]
            for name, sign in (("up", 1), ("down", -1)):
                old = getattr(self, name)
                step = np.array([[pow(base, sign * m, self.P)] for base in self.BASES], np.uint64)
                setattr(self, name, np.concatenate([old, _fold(old * step)], 1))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """h with h[:, i] over data[:i], as sums that grow."""
        n = len(data)
        self.grow(n + 1)
        h = np.zeros((2, n + 1), np.uint64)
        p, by = np.uint64(self.P), np.uint64(31)
        for i in range(0, n, 1 << 14):
            x = data[i : i + (1 << 14)].astype(np.uint64)
            x += np.uint64(1)
            end = i + len(x)
            for j in range(2):
                term = x * self.up[j, i:end]
                high = term >> by
                term &= p
                term += high
                np.cumsum(term, out=h[j, i + 1 : end + 1])
                h[j, i + 1 : end + 1] += h[j, i]
        return h

    def raw(self, h: np.ndarray, start: np.ndarray, end: np.ndarray, shift: np.ndarray | int = 0) -> np.ndarray:
        """Both polynomials of data[start:end], as if it stood ``shift`` units further on: shape (2, n), below 2**32."""
        out = _fold(_fold(h[:, end] - h[:, start]) * self.down[:, start])
        return _fold(out * self.up[:, shift]) if np.any(shift) else out

    def finish(self, raw: np.ndarray) -> np.ndarray:
        """One 62-bit value, mixed."""
        p = np.uint64(self.P)
        raw = _fold(raw)
        raw = np.where(raw >= p, raw - p, raw)
        return mix64(raw[0] + (raw[1] << np.uint64(31)))

    def span(self, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end], wherever the range lies."""
        return self.finish(self.raw(h, start, end))


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A cheap value of each ``width`` bytes (a power of two), for choosing places by its high bits: equal bytes, equal values. Decides nothing."""
    h, n = _BYTES[data], 1
    while n < width:
        high = h[: len(h) - n] * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
        high += h[n:]
        h, n = high, n * 2
    return h


def as_bytes(column) -> list[bytes]:
    """An Arrow string or binary column as bytes, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def release() -> None:
    """Give freed memory back to the system: a worker lives on for other tasks, beside all that its executor holds."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def batches(it: Iterable, rows: int = 1024) -> Iterator:
    """Non-empty batches of at most ``rows`` rows, so that Python copies of large texts stay few."""
    for batch in it:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    release()


def by_groups(it: Iterable, keys: list[str], rows: int = 1 << 16) -> Iterator[dict[str, np.ndarray]]:
    """Columns of a sorted partition in pieces of about ``rows`` rows that end where ``keys`` change."""
    held: list[dict[str, np.ndarray]] = []
    n = 0
    join = lambda parts: {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    for batch in it:
        if not batch.num_rows:
            continue
        held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names})
        n += batch.num_rows
        if n < rows:
            continue
        piece = join(held)
        change = np.zeros(n - 1, bool)
        for k in keys:
            change |= piece[k][1:] != piece[k][:-1]
        ends = np.flatnonzero(change)
        if not len(ends):
            held = [piece]
            continue
        end = ends[-1] + 1
        yield {c: x[:end] for c, x in piece.items()}
        held, n = [{c: x[end:] for c, x in piece.items()}], n - end
    if n:
        yield join(held)
    held = []
    release()


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with as many more underscores as it takes to be no column of the frames."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
