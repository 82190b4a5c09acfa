"""Sharding: a uniform shuffle with exact shard sizes by a hypergeometric communication matrix, DataFrame functions only."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.llm.common import cut, fresh, range_bits, read, running_total

SHARDS = 24
SEED = 29
#: Rows that one block of the communication matrix has at least, and how many blocks there are at most. More rows
#: make blocks longer, and these are then ranked in ranges of their own.
BLOCK_ROWS, MAX_BLOCKS = 2_000, 2_048


def _stirling(n: int) -> float:
    """ln n! less Stirling's formula for it."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    s = 1.0 / (n * n)
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - s / 1188) * s) * s) * s) / n


def _deviance(x: float, mean: float) -> float:
    """x ln(x / mean) + mean - x, without loss of digits where x is near the mean."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x if x else mean
    v = (x - mean) / (x + mean)
    total, term, j = (x - mean) * v, 2 * x * v, 1
    while True:
        term *= v * v
        more = total + term / (2 * j + 1)
        if more == total:
            return total
        total, j = more, j + 1


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    """Log-probability of x successes among n, by Loader's saddle-point expansion: full double precision at any size."""
    if x == 0 or x == n:
        rate, other = (q, p) if x == 0 else (p, q)
        return 0.0 if n == 0 else n * (math.log1p(-other) if other < 0.5 else math.log(rate))
    told = _stirling(n) - _stirling(x) - _stirling(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return told - 0.5 * (math.log(2 * math.pi) + math.log(x) + math.log1p(-x / n))


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many good ones ``draws`` draws without replacement give: inversion from the mode outwards, with odds right to double precision at any size."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    share, rest = draws / (good + bad), (good + bad - draws) / (good + bad)
    p = math.exp(_log_binomial(mode, good, share, rest) + _log_binomial(draws - mode, bad, share, rest) - _log_binomial(draws, good + bad, share, rest))
    u = rng.random() - p
    left, right, a, b = p, p, mode, mode
    while u > 0 and (a > low or b < high):
        if b < high:
            right *= (good - b) * (draws - b) / ((b + 1) * (bad - draws + b + 1))
            b += 1
            u -= right
            if u <= 0:
                return b
        if a > low:
            left *= a * (bad - draws + a) / ((good - a + 1) * (draws - a + 1))
            a -= 1
            u -= left
            if u <= 0:
                return a
    return mode


def communication_matrix(blocks: list[int], shards: int, rng: random.Random) -> list[list[int]]:
    """Counts by block and shard as a uniform shuffle of all rows has them: rows sum to ``blocks``, columns to equal sizes."""
    total = sum(blocks)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in blocks:
        rest, row = sum(left), []
        for s in range(shards):
            rest -= left[s]
            k = hypergeometric(rng, left[s], rest, n)
            row.append(k)
            n -= k
        left = [x - k for x, k in zip(left, row)]
        matrix.append(row)
    return matrix


def shuffle_shards(rows: DataFrame, *, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with __shard (0 to shards - 1, counts at most one apart) and __slot (gapless from 0 in each shard).

    ``rows`` should be narrow; it is checkpointed once so that each row has an id for good. Rows are dealt to
    blocks by a hash of that id, so equal or null keys don't gather; at most MAX_BLOCKS block counts reach the
    driver, which draws the matrix. A row's random rank in its block says which shard it goes to; another
    hash permutes each shard. Both ranks are prefix sums over ranges of a hash whose number grows with the
    table, so no task's part does. Texts are not read here, so their length doesn't matter. Equal texts, repeated
    rows and nulls are placed like any other rows. Other columns pass through; __shard and __slot must not be
    among them (ValueError). An empty table gives no rows.
    """
    if {"__shard", "__slot"} & set(rows.columns):
        raise ValueError("rows has a column named __shard or __slot")
    row, block, dice, rank, key, order = (fresh(x, rows) for x in ("__row", "__block", "__dice", "__rank", "__key", "__order"))
    held = cut(rows.withColumn(row, F.monotonically_increasing_id()))
    total = held.count()
    n, bits = max(1, min(MAX_BLOCKS, total // BLOCK_ROWS)), range_bits(total // SHARDS, 8)
    blocked = held.withColumns({block: F.pmod(F.xxhash64(F.lit(seed), row), F.lit(n)).cast("int"), dice: F.xxhash64(F.lit(seed + 1), row)})
    found = {r[block]: r["count"] for r in blocked.groupBy(block).count().collect()}
    matrix = communication_matrix([found.get(b, 0) for b in range(n)], shards, random.Random(seed))
    ends = [[sum(x[: s + 1]) for s in range(shards)] for x in matrix]
    one = F.lit(1).cast("long")
    ranked = running_total(blocked, block, [dice, row], one, rank, bits=range_bits(total // n, 1))
    limits = F.element_at(F.from_json(F.lit(json.dumps(ends)), "array<array<bigint>>"), F.col(block) + 1)
    dealt = ranked.withColumn("__shard", F.size(F.filter(limits, lambda x: x <= F.col(rank))))
    dealt = dealt.withColumns({key: F.concat(F.lit("s"), F.col("__shard").cast("string")), order: F.xxhash64(F.lit(seed + 2), row)})
    return running_total(dealt, key, [order, row], one, "__slot", bits=bits).drop(row, block, dice, rank, key, order)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffle_shards(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
