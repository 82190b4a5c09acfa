"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.llm.common import WORD, cut, fresh, range_bits, read, running_total

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
SEED = 17
#: Words of a packet at least, and packets of one pass over all words at most.
PACKET, MOST_PACKETS = 64, 1 << 22
#: Sources whose last documents are sent to all tasks (under 200 bytes each for names of ordinary length); beyond, they are joined.
BROADCAST_SOURCES = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Targets for a table (source_key, source, source_size) with a row for each source.

    Sources weigh ``weights`` in turn, in code-point order with null last. The budget is ``share`` of all
    sizes. A fair queue serves each source at the rate of its weight until it has served all its repeats, so
    at virtual time v a source has sent min(repeats * size, weight * v); v* is where these sum to the budget.
    Sorting the sources by the time at which they run dry gives v* in closed form. The windows have one row
    for each source, not for each document.
    """
    turn = Window.orderBy(F.col("source").isNull(), "source")
    dry = Window.orderBy("__dry", "source_key")
    before, rest = dry.rowsBetween(Window.unboundedPreceding, -1), dry.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    return (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int")).cast("double"))
        .withColumn("__cap", F.col("source_size") * float(repeats))
        .withColumn("__dry", F.col("__cap") / F.col("weight"))
        .withColumn("__budget", F.sum("source_size").over(everything) * share)
        .withColumn("__v", (F.col("__budget") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("__first", F.row_number().over(dry))
        .withColumn("v", F.coalesce(F.min(F.when(F.col("__v") <= F.col("__dry"), F.struct("__first", "__v"))).over(everything)["__v"], F.max("__dry").over(everything)))
        .withColumn("target", F.least(F.col("__cap"), F.col("weight") * F.col("v")))
        .select("source_key", "source_size", "weight", "target")
    )


def packet_words(words: int) -> int:
    """Words of a packet: few, and so many that all words are some millions of packets."""
    return max(PACKET, words // MOST_PACKETS)


def source_key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))


def document_key(seed: int) -> Column:
    """A document's place in the shuffle of its source: the first 60 bits of an MD5 over the seed, doc_id and the text's MD5."""
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    told = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text)
    return F.conv(F.substring(F.md5(told.cast("binary")), 1, 15), 16, 10).cast("long")


def stream(docs: DataFrame, size: Column, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, targets, packets): rows (row, doc_id, source, source_key, size, hash) of ``docs`` (doc_id, source, text and
    whatever ``size`` needs), each source's target, and what the mix sends, in order.

    Each source's documents are shuffled by a hash of doc_id, text and the seed, and stand ``repeats`` times one after
    another. A document is sent in packets of some words, so a long one doesn't hold its source back. A packet's
    virtual finish time is the source's words up to its end over the source's weight. All sources' packets (row,
    source_key, hash, pass, packet, words, finish) are sorted by it in ranges of equal virtual time, ``before`` is the
    exact prefix sum of words along that one order, and the order is cut where ``share`` of all words is reached:
    ``taken`` is a packet's words before the cut. A source that has run dry has no more packets in the order, so the
    others take its place at once. A source is off its target by a packet at most. Documents without words send none.
    """
    held = cut(docs.select("doc_id", "source", source_key().alias("source_key"), size.alias("size"), document_key(seed).alias("hash")).withColumn("row", F.monotonically_increasing_id()))
    sizes = held.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(sizes, weights=weights, share=share, repeats=repeats).drop("source"))
    told = held.agg(F.count("*").alias("n"), F.sum("size").alias("words")).first()
    latest = targets.agg(F.max(F.col("source_size") * repeats / F.col("weight"))).first()[0] or 0.0
    words = told["words"] or 0
    packet = packet_words(words)
    bits, budget = range_bits((told["n"] + words // packet) * repeats), int(words * share)
    own = running_total(held.where("size > 0").select("row", "source_key", "hash", "size"), "source_key", ["hash", "row"], F.col("size"), "own", part=F.shiftright("hash", 60 - bits))
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    sent = own.join(targets.select("source_key", "source_size", "weight"), "source_key").withColumn("pass", number(F.lit(repeats))).withColumn("packet", number(F.ceil(F.col("size") / packet)))
    end = F.least(F.col("size"), (F.col("packet") + 1) * packet)
    finish = (F.col("own") + end + F.col("pass") * F.col("source_size")).cast("double") / F.col("weight")
    timed = sent.select("row", "source_key", "hash", "pass", "packet", (end - F.col("packet") * packet).alias("words"), finish.alias("finish"), F.lit("").alias("all"))
    span = F.floor(F.col("finish") * (float(1 << bits) / max(latest, 1.0))).cast("long")
    ordered = running_total(timed, "all", ["finish", "source_key", "pass", "hash", "row", "packet"], F.col("words"), "before", part=span)
    taken = F.greatest(F.lit(0), F.least(F.col("words"), F.lit(budget) - F.col("before"))).cast("long")
    return held, targets, ordered.drop("all").withColumn("taken", taken)


def mix(docs: DataFrame, size: Column, **settings) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and finish (of the first pass) for each row of ``docs``: see ``stream``.

    Null source: a source of its own, last in the order. Null doc_id: hashed as such, with the text. Repeated rows:
    documents of their own; which of them a cut falls on can't be told. Empty and null texts: size 0, nothing
    taken. Texts of any length count whole. Other columns are not read, so their names can't clash. Empty table:
    no rows. Reruns give the same mix.
    """
    rows, targets, packets = stream(docs, size, **settings)
    sent = packets.groupBy("row").agg(F.sum("taken").alias("taken"), F.max(F.when(F.col("pass") == 0, F.col("finish"))).alias("finish"))
    out = rows.join(targets, "source_key").join(sent, "row", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "finish")


def mix_whole(docs: DataFrame, *, seed: int = SEED, **settings) -> DataFrame:
    """``docs``, each row as often as the mix takes it whole: a pass counts if at least half of its words lie before the cut.

    A source takes its documents in their shuffled order, so what it has taken is told by its last document: the
    texts are never shuffled, but meet one row for each source. Rows with one doc_id and text are taken alike. Null
    and empty texts, which hold no word to take, go. All columns pass through, whatever their names.
    """
    _, _, packets = stream(docs, n_words(F.col("text")), seed=seed, **settings)
    passes = packets.where("taken > 0").groupBy("row", "pass").agg(F.first("source_key").alias("source_key"), F.first("hash").alias("hash"), F.sum("taken").alias("taken"))
    sizes = packets.where("pass = 0").groupBy("row").agg(F.sum("words").alias("size"))
    whole = passes.join(sizes, "row").where("taken * 2 >= size")
    last = cut(whole.groupBy("source_key").agg(F.max(F.struct("pass", "hash")).alias("last")))
    few = last.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    own, at, told, copy = (fresh(x, docs) for x in ("__key", "__hash", "__last", "__copy"))
    last = last.select(F.col("source_key").alias(own), F.col("last").alias(told))
    rows = docs.where(F.col("text").rlike(WORD)).withColumns({own: source_key(), at: document_key(seed)}).join(F.broadcast(last) if few else last, own)
    times = (F.col(told)["pass"] + F.when(F.col(at) <= F.col(told)["hash"], 1).otherwise(0)).cast("int")
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, n_words(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken", "finish")


SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS hash,
    CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS source_key, row_number() OVER () AS row FROM documents),
s AS (SELECT source_key, source, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} + 1]::DOUBLE AS weight FROM s),
c AS (SELECT *, source_size * {float(REPEATS)}::DOUBLE AS cap, cap / weight AS dry, sum(source_size) OVER () * {SHARE}::DOUBLE AS budget FROM w),
v AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY dry, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY dry, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS reach FROM c),
t AS (SELECT source_key, source_size, weight, budget, least(cap, weight * coalesce((SELECT reach FROM v WHERE reach <= dry ORDER BY dry, source_key LIMIT 1), (SELECT max(dry) FROM v))) AS target FROM v),
o AS (SELECT d.*, source_size, weight, budget, target, greatest({PACKET}, sum(size) OVER () // {MOST_PACKETS})::BIGINT AS mtu,
    coalesce(sum(size) OVER (PARTITION BY d.source_key ORDER BY hash, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS own FROM d JOIN t USING (source_key)),
n AS (SELECT *, unnest(range({REPEATS})) AS pass FROM o WHERE size > 0),
m AS (SELECT *, unnest(range((size + mtu - 1) // mtu)) AS packet FROM n),
f AS (SELECT *, least(size, (packet + 1) * mtu) - packet * mtu AS words, (own + least(size, (packet + 1) * mtu) + pass * source_size)::DOUBLE / weight AS finish FROM m),
b AS (SELECT *, coalesce(sum(words) OVER (ORDER BY finish, source_key, pass, hash, row, packet ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM f)
SELECT doc_id, size, source_size, target, sum(greatest(0, least(words, floor(budget)::BIGINT - before)))::BIGINT AS taken, max(finish) FILTER (pass = 0) AS finish FROM b GROUP BY row, doc_id, size, source_size, target
UNION ALL SELECT doc_id, size, source_size, target, 0, NULL FROM o WHERE size = 0
"""
