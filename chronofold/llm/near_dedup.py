"""MinHash near-dedup by an LSH forest: neighbours in several sorted signature orders, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.common import ROWS, Powers, as_bytes, batches, by_groups, chunks, cut, mix64, read, spread_join, text_key
from chronofold.llm.components import _local_forest, connected_components
from chronofold.session import sweep

SHINGLE = 5
PERCENT = 85
#: Sorted orders (trees), and the least depth of a region in signature values. Two sets that share 85 % miss all
#: regions of that depth with odds of 6e-11. A crowded region is followed down to twice the depth.
TREES, HEAD = 32, 4
PERMUTATIONS = TREES * HEAD
#: A region of this many more sets than one is compared in full where it stands; a larger one is deepened.
REACH = 4
#: Rounds in which the sets of a crowded head meet one of them. The rest meet each other in blocks: of so many rows
#: of counts first, then of so many sets and shingles.
ROUNDS, BLOCK_ROWS, BLOCK_SETS, BLOCK_SHINGLES = 2, 4096, 512, 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = mix64(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)
_TURN = mix64(np.arange(1000, 1000 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
_POWERS = Powers()


def shingle_sets(texts: list[bytes]):
    """For each text the sorted distinct 64-bit hashes of its 5-word shingles, A-Z in lower case."""
    sizes = np.array([len(t) + 1 for t in texts])
    for i, j in chunks(sizes):
        data = np.frombuffer(b"\n".join(texts[i:j]).lower() + b"\n", np.uint8)
        space = _SPACE[data]
        word = ~space
        starts = np.flatnonzero(word & np.concatenate([[True], space[:-1]]))
        ends = np.flatnonzero(space & np.concatenate([[False], word[:-1]]))
        words = _POWERS.span(_POWERS.prefix(data), starts, ends)
        cuts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes[i:j])]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            w = words[a:b]
            k = min(SHINGLE, len(w))
            if not k:
                yield w
                continue
            n = len(w) - k + 1
            s = np.full(n, k, np.uint64)
            for x in range(k):
                s = s + mix64(w[x : x + n] + np.uint64(x)) * _TURN[x]
            yield np.unique(mix64(s))


def set_digest(members: bytes) -> bytes:
    return hashlib.blake2b(members, digest_size=16).digest()


def sketch(s: np.ndarray) -> np.ndarray:
    """PERMUTATIONS least values of a set, 32 bits each."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max)
    for x in range(0, len(s), 512):
        least = np.minimum(least, (s[x : x + 512, None] * _ODD[None, :]).min(0))
    return (least >> np.uint64(32)).astype(np.uint32)


def _signatures(it):
    import pyarrow as pa

    for batch in batches(it):
        n, digest, signature = [], [], []
        for s in shingle_sets(as_bytes(batch.column("text"))):
            n.append(len(s))
            digest.append(set_digest(s.tobytes()))
            signature.append(sketch(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(signature, pa.binary())], names=["doc_id", "key", "n", "digest", "signature"])


def _orders(it):
    """A row for each tree: the head's hash, the next four values packed (their order is the signature's), the id."""
    import pyarrow as pa

    for batch in batches(it):
        ids = np.asarray(batch.column("id"))
        v = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(len(ids), PERMUTATIONS)
        v = np.concatenate([v, v[:, : HEAD * 2]], 1).astype(np.uint64)
        for t in range(TREES):
            head = np.full(len(ids), t, np.uint64)
            for x in range(HEAD):
                head = mix64(head * _TURN[x] + v[:, t * HEAD + x])
            tail = np.zeros(len(ids), np.uint64)
            for x in range(HEAD, 2 * HEAD):
                tail = (tail << np.uint64(16)) | (v[:, t * HEAD + x] >> np.uint64(16))
            yield pa.RecordBatch.from_arrays([pa.array(head.view(np.int64)), pa.array((tail ^ np.uint64(1 << 63)).view(np.int64)), pa.array(ids)], names=["head", "tail", "id"])


def common_prefix(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Signature values that each row of a sorted order shares with the next one, from HEAD to 2 * HEAD; 0 where heads differ."""
    apart = tail[1:].view(np.uint64) ^ tail[:-1].view(np.uint64)
    depth = HEAD + sum((apart >> np.uint64(16 * x) == 0).astype(np.int64) for x in range(HEAD))
    return np.where(head[1:] == head[:-1], depth, 0)


def regions(prefix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows i and i + k of an order: the depth to which they agree, and how many rows agree with them to that depth (REACH + 2: more).

    ``prefix`` has REACH + 1 zeros at both ends.
    """
    pad, m = REACH + 1, len(prefix) - 2 * (REACH + 1)
    depth = prefix[pad : pad + m - k + 1].copy()
    for x in range(1, k):
        depth = np.minimum(depth, prefix[pad + x : pad + x + m - k + 1])
    size = np.full(len(depth), k + 1)
    for step, at in ((-1, pad - 1), (1, pad + k)):
        more = np.ones(len(depth), bool)
        for x in range(pad):
            more = more & (prefix[at + step * x : at + step * x + len(depth)] >= depth)
            size += more
    return depth, np.minimum(size, REACH + 2)


def _neighbours(it):
    """Pairs (u, v) of a sorted partition that meet in a region of at most REACH + 1 sets, at whatever depth that is
    (crowded: 0), and of a set and the next one where the region stays crowded (crowded: 1).

    Depth is adapted to the place: from HEAD on a region is deepened until so few sets share its prefix.
    """
    import pyarrow as pa

    keep = 2 * (REACH + 1)
    head, tail, ids = (np.zeros(0, np.int64),) * 3
    done = 0

    def found(limit: int):
        prefix = np.concatenate([np.zeros(REACH + 1, np.int64), common_prefix(head, tail), np.zeros(REACH + 1, np.int64)])
        u, v, crowded, at_head = [], [], [], []
        for k in range(1, min(REACH, len(ids) - 1) + 1):
            depth, size = regions(prefix, k)
            i = np.flatnonzero((depth >= HEAD) & ((size <= REACH + 1) | (k == 1)))
            i = i[(i + k >= done) & (i + k < limit)]
            u.append(np.minimum(ids[i], ids[i + k]))
            v.append(np.maximum(ids[i], ids[i + k]))
            # Only a region that is small at HEAD already is settled by its pairs; what a crowded one leaves is for crowded_links.
            crowded.append(regions(np.minimum(prefix, HEAD), k)[1][i] > REACH + 1)
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v)), pa.array(np.concatenate(crowded).astype(np.int32))], names=["u", "v", "crowded"])

    for batch in batches(it, 1 << 14):
        head, tail, ids = (np.concatenate([x, np.asarray(batch.column(c))]) for x, c in ((head, "head"), (tail, "tail"), (ids, "id")))
        limit = max(done, len(ids) - (REACH + 1))
        yield from found(limit)
        drop = max(0, limit - keep)
        head, tail, ids, done = head[drop:], tail[drop:], ids[drop:], limit - drop
    yield from found(len(ids))


def _edge_rows(it):
    """The first and last rows of a sorted partition, by which neighbours across its borders are found."""
    import pyarrow as pa

    keep = 2 * (REACH + 1)
    first, last = None, None
    for batch in batches(it, 1 << 14):
        part = pa.Table.from_batches([batch])
        first = part if first is None else first if first.num_rows >= keep else pa.concat_tables([first, part])
        first = first.slice(0, keep)
        last = part if last is None else pa.concat_tables([last, part])
        last = last.slice(max(0, last.num_rows - keep)).combine_chunks()
    if first is not None:
        yield from pa.concat_tables([first, last]).combine_chunks().to_batches()


def candidate_pairs(sets: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) with the number of orders in which they meet, for sets (id, signature); crowded pairs are hints only.

    Across borders of partitions only their few first and last rows meet, so heads that span partitions gather
    a bounded number of rows for each of these. A region that a border makes look smaller gives more pairs, never fewer.
    """
    rows = sets.mapInArrow(_orders, "head long, tail long, id long").repartitionByRange("head", "tail", "id").sortWithinPartitions("head", "tail", "id")
    within = rows.mapInArrow(_neighbours, "u long, v long, crowded int")
    edges = rows.mapInArrow(_edge_rows, "head long, tail long, id long").distinct()
    across = edges.repartition("head").sortWithinPartitions("head", "tail", "id").mapInArrow(_neighbours, "u long, v long, crowded int")
    return within.unionByName(across).where("u <> v").groupBy("u", "v").agg(F.count("*").alias("votes"), F.min("crowded").alias("crowded"))


def _packed_sets(it):
    import pyarrow as pa

    for batch in batches(it, 128):
        texts = [zlib.decompress(x) for x in batch.column("packed").to_pylist()]
        members = [s.tobytes() for s in shingle_sets(texts)]
        same = [set_digest(m) == d for m, d in zip(members, batch.column("digest").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(members, pa.binary())], names=["id", "members"]).filter(pa.array(same, pa.bool_()))


def _confirm(percent: int):
    def run(it):
        import pyarrow as pa

        for batch in batches(it, 512):
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def least_agreement(percent: int) -> float:
    """Pairs whose signatures agree less than this are dropped before the exact check: 6.3 standard deviations below ``percent``."""
    p = percent / 100
    return p - 6.3 * (p * (1 - p) / PERMUTATIONS) ** 0.5


def _agree(percent: int):
    return lambda it: _agreeing(it, least_agreement(percent))


def _agreeing(it, least: float):
    import pyarrow as pa

    for batch in batches(it):
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, PERMUTATIONS) for c in "ab")
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array((a == b).mean(1) >= least))


def _beside(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    left = values.select(F.col("id").alias("u"), F.col(column).alias("a"))
    right = values.select(F.col("id").alias("v"), F.col(column).alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")


def _pack_texts(it):
    import pyarrow as pa

    for batch in batches(it):
        packed = [zlib.compress(x, 1) for x in as_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(packed, pa.binary())], names=["doc_id", "key", "packed"])


def _shared(sets: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """How many members each two of the sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = times[at] > 1
    column, owner = (np.cumsum(times > 1) - 1)[at[use]], owner[use]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.int64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        i, j = np.searchsorted(column, [low, low + step])
        held = np.zeros((len(sets), int(column[j - 1]) - low + 1), np.float32)
        held[owner[i:j], column[i:j] - low] = 1
        both += (held @ held.T).astype(np.int64)
    return both


def _groups(links):
    """Apply ``links`` to each (head, a, b) of a sorted partition."""

    def run(it):
        for piece in by_groups(it, ["head", "a", "b"], 1):
            ends = np.flatnonzero((piece["head"][1:] != piece["head"][:-1]) | (piece["a"][1:] != piece["a"][:-1]) | (piece["b"][1:] != piece["b"][:-1])) + 1
            for i, j in zip([0, *ends], [*ends, len(piece["head"])]):
                yield links({c: x[i:j] for c, x in piece.items()})

    return run


def _meet(percent: int):
    """Links between the components of each (head, a, b) of a sorted partition, all its sets compared in full."""

    def links(group):
        import pyarrow as pa

        ids, component = group["id"], group["component"]
        sets = [np.frombuffer(m, np.uint64) for m in group["members"]]
        n, both = np.array([len(s) for s in sets]), _shared(sets)
        linked = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (component[:, None] != component[None, :])
        u, v = np.nonzero(np.triu(linked, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[u], ids[v])), pa.array(np.maximum(ids[u], ids[v]))], names=["u", "v"])

    return lambda it: _local_forest(_groups(links)(it))


def _may_link(percent: int, step: int = 256):
    """Of each (head, a, b): the sets that by their counts could be linked to a set of another component.

    ``k`` of a set's n shingles occur in any other set at all, so two sets share the lesser k at most.
    """

    def possible(group):
        import pyarrow as pa

        n, k, component = group["n"], group["k"], group["component"]
        any_of = np.zeros(len(n), bool)
        for i in range(0, len(n), step):
            both = np.minimum(k[i : i + step, None], k[None, :])
            may = (100 * both >= percent * (n[i : i + step, None] + n[None, :] - both)) & (component[i : i + step, None] != component[None, :])
            any_of[i : i + step] = may.any(1)
        return pa.RecordBatch.from_arrays([pa.array(group["head"][any_of]), pa.array(group["id"][any_of])], names=["head", "id"])

    return _groups(possible)


def _with_component(rows: DataFrame, found: DataFrame, column: str = "id", out: str = "component") -> DataFrame:
    return rows.join(found.select(F.col("id").alias(column), F.col("component").alias("__root")), column, "left").withColumn(out, F.coalesce("__root", column)).drop("__root")


def _mixed(rows: DataFrame, *more) -> DataFrame:
    """A row for each head with sets of two components at least."""
    heads = rows.groupBy("head").agg(F.min("component").alias("__low"), F.max("component").alias("__high"), *more)
    return heads.where("__low <> __high").drop("__low", "__high")


def _regions(rows: DataFrame) -> DataFrame:
    """(head, id, n) of the heads with several components. Heads that share sets become one, where that's fewer pairs."""
    rows = cut(rows.join(_mixed(rows).select("head"), "head", "left_semi"), ROWS)
    heads = rows.groupBy("head").agg(F.min("id").alias("least"), F.count("*").alias("size"))
    region = connected_components(rows.join(heads, "head").select(F.col("id").alias("u"), F.col("least").alias("v")))
    sizes = region.groupBy("component").agg(F.count("*").alias("all"))
    apart = heads.join(region.withColumnRenamed("id", "least"), "least").groupBy("component").agg(F.sum(F.col("size") * F.col("size")).alias("pairs"))
    whole = sizes.join(apart, "component").select("component", (F.col("all") * F.col("all") <= F.col("pairs")).alias("whole"))
    # A family may hold most of these rows, and its component is one key.
    rows = spread_join(cut(rows.select("head", "id", "n").join(region, "id"), ROWS), whole, ["component"])
    return rows.select(F.when(F.col("whole"), F.xxhash64("component")).otherwise(F.col("head")).alias("head"), "id", "n").distinct()


def _in_blocks(rows: DataFrame, most_sets: int, most_shingles: int | None) -> DataFrame | None:
    """``rows`` (head, id, n, component, ..) copied to block pairs (a, b), so that any two sets of a head but those of
    its largest component meet in one; None if no head has several components."""
    parts = rows.groupBy("head", "component").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    of = lambda column, own, most: F.sum(F.when(own, F.col(column)).otherwise(0)) / most
    blocks = lambda own: F.ceil(of("sets", own, most_sets) if most_shingles is None else F.greatest(of("sets", own, most_sets), of("shingles", own, most_shingles))).cast("long")
    largest = _mixed(parts, F.max(F.struct("sets", "component")).alias("m")).select("head", F.col("m.component").alias("largest"))
    is_largest = F.col("component") == F.col("largest")
    largest = cut(parts.join(largest, "head").groupBy("head", "largest").agg(blocks(is_largest).alias("own"), blocks(~is_largest).alias("others")), ROWS)
    if largest.isEmpty():
        return None
    salt = F.pmod(F.xxhash64("id"), F.when(is_largest, F.col("own")).otherwise(F.col("others")))
    return (
        rows.join(largest, "head")
        .withColumn("block", F.when(is_largest, F.col("others") + salt).otherwise(salt))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_largest, F.col("others")).otherwise(F.col("own") + F.col("others")) - 1)))
        .select(*rows.columns, F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    )


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("head", "a", "b").sortWithinPartitions("head", "a", "b")


def _shingle_rows(it):
    import pyarrow as pa

    for batch in batches(it, 128):
        members = batch.column("members").to_pylist()
        ids = np.repeat(np.asarray(batch.column("id")), [len(m) // 8 for m in members])
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(members), np.int64)), pa.array(ids)], names=["shingle", "id"])


def _decided(rows: DataFrame, members: DataFrame, percent: int) -> DataFrame | None:
    """The links (u, v) between components of the heads of ``rows`` (head, id, n, component), each pair decided.

    A shingle that no other set holds is in no intersection. What a set holds besides bounds its similarity to
    any other, and sets that can't reach ``percent`` with a set of another component leave before any sets are
    compared. In a star of copies, each edited in places of its own, that is nearly all of them.
    """
    open_sets = members.join(rows.select("id").distinct(), "id", "left_semi")
    alone = open_sets.mapInArrow(_shingle_rows, "shingle long, id long").groupBy("shingle").agg(F.count("*").alias("times"), F.min("id").alias("id")).where("times = 1").groupBy("id").agg(F.count("*").alias("alone"))
    counted = cut(rows.join(alone, "id", "left").withColumn("k", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone").where(100 * F.col("k") >= percent * F.col("n")), ROWS)
    narrow = _in_blocks(counted, BLOCK_ROWS, None)
    if narrow is None:
        return None
    may = _by_block(narrow).mapInArrow(_may_link(percent), "head long, id long").distinct()
    dealt = _in_blocks(cut(counted.drop("k").join(may, ["head", "id"], "left_semi"), ROWS), BLOCK_SETS, BLOCK_SHINGLES)
    if dealt is None:
        return None
    return _by_block(dealt.join(members, "id")).mapInArrow(_meet(percent), "u long, v long")


def crowded_links(sets: DataFrame, members: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """``links``, and such that any two linked sets under one head of more than REACH + 1 sets are in one component.

    A family is mostly held by one set, which stands under the largest heads. So the sets of a head first meet the
    one whose heads hold the most, a linear number of pairs; in the next round those left over meet one of
    themselves. Then each head that still has several components (or the region of heads that share sets with it)
    is decided whole (see _decided), but for pairs within its largest component: no pair of two components goes
    undecided.
    """
    some = sets.join(members.select("id"), "id", "left_semi")
    rows = some.select("id", "signature").mapInArrow(_orders, "head long, tail long, id long").select("head", "id")
    heads = cut(rows.groupBy("head").agg(F.count("*").alias("size")).where(F.col("size") > REACH + 1), ROWS)
    if heads.isEmpty():
        return links
    rows = cut(rows.join(heads, "head"), ROWS)
    score = cut(rows.groupBy("id").agg(F.sum("size").alias("score")), ROWS)
    sets = cut(some.join(score.select("id"), "id", "left_semi").select("id", "n", "signature"))
    members = cut(members.join(score.select("id"), "id", "left_semi"))
    sweep(members.sparkSession)
    rows = cut(rows.select("head", "id").join(score, "id").join(sets.select("id", "n"), "id"), ROWS)
    found = connected_components(links)
    left = rows
    for _ in range(ROUNDS):
        left = cut(_with_component(left, found), ROWS)
        middle = cut(_mixed(left, F.max(F.struct("score", (-F.col("id")).alias("id"), "component")).alias("m")).select("head", (-F.col("m.id")).alias("middle"), F.col("m.component").alias("own")), ROWS)
        if middle.isEmpty():
            break
        left = left.join(middle, "head").where("component <> own")
        pairs = left.select(F.least("id", "middle").alias("u"), F.greatest("id", "middle").alias("v")).distinct()
        likely = cut(_beside(pairs, sets, "signature").mapInArrow(_agree(percent), "u long, v long"), ROWS)
        links = cut(links.unionByName(_beside(likely, members, "members").mapInArrow(_confirm(percent), "u long, v long")), ROWS)
        found = connected_components(links)
        left = _with_component(_with_component(left.drop("component", "own"), found), found, "middle", "own").where("component <> own").select("head", "id", "score", "n")
    decided = _decided(cut(_with_component(_regions(_with_component(rows, found)), found), ROWS), members, percent)
    return links if decided is None else links.unionByName(cut(decided, ROWS))


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``, linked at ``percent`` Jaccard similarity or more.

    Words are separated by the six ASCII white-space characters, A-Z count as lower case, and a set holds the
    distinct 5-word shingles; a text of fewer words is one shingle as a whole, and one without words (or null)
    has no shingle and no link. Texts of any length are taken whole; a very long one is one row's work. component_id
    is the least doc_id that links reach. A null doc_id has no links and is its own component. Repeated rows have
    one decision, and so have rows with one doc_id and equal sets. Columns but doc_id and text are not read, so
    their names can't clash. An empty table gives no rows.

    1. One pass over the texts leaves each row's set size, set digest and MinHash signature.
    2. Rows with equal sets become one set: copies never meet as pairs.
    3. Forest: each set stands in TREES sorted orders of its signature, range-partitioned so that a crowded
       region spans tasks. Sets that share a prefix of HEAD values are a region; one of more than REACH + 1 sets
       is deepened until it isn't. Regions' pairs are candidates.
    4. Each set's most promising candidate is confirmed on the full sets; components follow. Then each
       remaining pair between different components is confirmed, unless its signatures are far apart. A pair
       within a component can't change the result.
    5. Heads whose regions had to be deepened are decided whole: see crowded_links.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", text_key())
    rows = cut(text.mapInArrow(_signatures, "doc_id long, key long, n long, digest binary, signature binary"))
    sets = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.first("signature").alias("signature"), F.first("n").alias("n"))
    sets = cut(sets.select("digest", "first.doc_id", "first.key", "signature", "n", F.monotonically_increasing_id().alias("id")))
    pairs = cut(candidate_pairs(sets.select("id", "signature")), ROWS)
    sweep(docs.sparkSession)  # of the orders, the largest shuffle but the texts'
    ends = pairs.select(F.col("u").alias("id"), "v", "votes").unionByName(pairs.select(F.col("v").alias("id"), F.col("u").alias("v"), "votes"))
    wanted = sets.select("doc_id", "key", "digest", "id").join(ends.select("id").distinct(), "id", "left_semi")
    members = cut(
        text.where("doc_id IS NOT NULL")
        .mapInArrow(_pack_texts, "doc_id long, key long, packed binary")
        .join(wanted, ["doc_id", "key"])
        .mapInArrow(_packed_sets, "id long, members binary")
        .groupBy("id")
        .agg(F.first("members").alias("members"))
    )
    sweep(docs.sparkSession)  # of the packed texts
    confirm = _confirm(percent)
    best = ends.groupBy("id").agg(F.max(F.struct("votes", (-F.col("v")).alias("other"))).alias("best")).select("id", (-F.col("best.other")).alias("other"))
    chosen = best.select(F.least("id", "other").alias("u"), F.greatest("id", "other").alias("v")).distinct()
    first = cut(_beside(chosen, members, "members").mapInArrow(confirm, "u long, v long"), ROWS)
    sweep(docs.sparkSession)  # of the sets that met
    so_far = connected_components(first)
    root = lambda side: so_far.select(F.col("id").alias(side), F.col("component").alias(f"{side}_root"))
    size = lambda side: sets.select(F.col("id").alias(side), F.col("n").alias(f"{side}_n"))
    apart = (
        pairs.where("crowded = 0")
        .select("u", "v")
        .join(chosen, ["u", "v"], "left_anti")
        .join(root("u"), "u", "left")
        .join(root("v"), "v", "left")
        .where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v"))
        .join(size("u"), "u")
        .join(size("v"), "v")
        .where(100 * F.least("u_n", "v_n") >= percent * F.greatest("u_n", "v_n"))
        .select("u", "v")
    )
    likely = cut(_beside(apart, sets, "signature").mapInArrow(_agree(percent), "u long, v long"), ROWS)
    second = cut(_beside(likely, members, "members").mapInArrow(confirm, "u long, v long"), ROWS)
    sweep(docs.sparkSession)
    links = crowded_links(sets, members, first.unionByName(second), percent)
    del members
    sweep(docs.sparkSession)
    found = connected_components(links)
    rooted = sets.select("digest", "id", "doc_id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = rooted.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = cut(rooted.join(least, "component").select("digest", "component_id"), ROWS)
    narrow = rows.select("doc_id", "key", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).otherwise(F.unhex(F.hex(F.xxhash64("doc_id", "key")))).alias("digest"))
    out = spread_join(narrow, by_set, ["digest"])
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
