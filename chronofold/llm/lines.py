"""Line dedup by a deletion-neighbourhood join: lines within one edit of an earlier line go."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.common import HOT, Powers, as_bytes, batches, by_groups, chunks, cut, fresh, mix64, read

#: Shorter lines (blank ones, headings, bullets) always stay.
MIN_CHARS = 16
#: Texts with candidate lines are looked up by a broadcast of up to this many lines (under 100 bytes each), and by a shuffle beyond.
BROADCAST_LINES = 100_000
#: Segments by which lines that can't have a neighbour are told apart before any deletion variant is made.
SEGMENTS = 4
#: Lines that a map task remembers to have sent, and variants that it sends at once.
SENT, AT_ONCE = 1 << 17, 1 << 16
_POWERS = Powers()
_C = mix64(np.arange(77, 81, dtype=np.uint64)) | np.uint64(1)


def names(lines: list[bytes]) -> np.ndarray:
    """A row (hi, lo) for each line: a 128-bit digest that no known method makes collide."""
    return np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in lines), np.int64).reshape(-1, 2)


class Lines:
    """Some lines as code points, with hashes of any part of them."""

    def __init__(self, lines: list[str]) -> None:
        data = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.h = _POWERS.prefix(data)
        self.end = np.cumsum([len(x) for x in lines])
        self.start = np.concatenate([[0], self.end[:-1]]).astype(np.int64)

    def segment_keys(self) -> np.ndarray:
        """A row for each line: for it as the longer and as the shorter of a pair, its content without one segment."""
        out = np.empty((len(self.start), 2 * SEGMENTS), np.int64)
        part = lambda a, b: _POWERS.span(self.h, a, b)
        for i in range(2):
            m = self.end - self.start - (1 - i)
            for j in range(SEGMENTS):
                a, b = m * j // SEGMENTS, m * (j + 1) // SEGMENTS
                k = part(self.start, self.start + a) * _C[1] + part(self.end - (m - b), self.end) * _C[2] + m.astype(np.uint64) * _C[3] + np.uint64(j)
                out[:, i * SEGMENTS + j] = mix64(k).view(np.int64)
        return out


def _each(it):
    """(doc, k, number, text, bytes) of all lines that are long enough, some texts at a time."""
    for batch in batches(it, 256):
        raw = as_bytes(batch.column("text"))
        doc, key = batch.column("doc").to_pylist(), batch.column("k").to_pylist()
        for i, j in chunks(np.array([len(t) for t in raw])):
            got = []
            for t, d, k in zip(raw[i:j], doc[i:j], key[i:j]):
                for number, line in enumerate(t.split(b"\n")):
                    if len(line) >= MIN_CHARS and (len(line) >= 4 * MIN_CHARS or len(line.decode("utf-8", "surrogatepass")) >= MIN_CHARS):
                        got.append((d, k, number, line))
            if got:
                yield got


def _occurrences(it):
    import pyarrow as pa

    for got in _each(it):
        doc, k, number, line = zip(*got)
        name = names(line)
        yield pa.RecordBatch.from_pydict({"hi": name[:, 0], "lo": name[:, 1], "doc": np.array(doc, np.int64), "k": np.array(k, np.int64), "number": np.array(number, np.int32)})


def _segments(it):
    """Keys of distinct lines: a task sends a line once as long as it remembers it, so a very common one isn't many rows."""
    import pyarrow as pa

    sent: set[int] = set()
    for got in _each(it):
        lo = names([x[3] for x in got])[:, 1]
        use = []
        for i, x in enumerate(lo.tolist()):
            if x not in sent:
                sent.add(x)
                use.append(i)
        if len(sent) > SENT:
            sent.clear()
        if use:
            lines = Lines([got[i][3].decode("utf-8", "surrogatepass") for i in use])
            yield pa.RecordBatch.from_pydict({"key": lines.segment_keys().ravel(), "line": np.repeat(lo[use], 2 * SEGMENTS), "code": np.tile(np.arange(2 * SEGMENTS, dtype=np.int32), len(use))})


def _shared(it):
    """Of a partition sorted by key and line that has all rows of its keys: the lines whose key another line has too."""
    import pyarrow as pa

    for piece in by_groups(it, ["key"]):
        key, line = piece["key"], piece["line"]
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        new_line = new_key | np.concatenate([[True], line[1:] != line[:-1]])
        group = np.cumsum(new_key) - 1
        keep = new_line & (np.bincount(group, new_line) > 1)[group]
        yield pa.RecordBatch.from_pydict({"line": line[keep], "code": piece["code"][keep]})


def _named_lines(it):
    """The texts of the wanted lines of each row."""
    import pyarrow as pa

    for batch in batches(it, 256):
        out = []
        for doc, k, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc", "k", "text", "wanted"))):
            lines = text.split("\n")
            out += [(w["hi"], w["lo"], doc, k, w["number"], sorted(set(w["codes"])), lines[w["number"]]) for w in wanted]
        hi, lo, doc, k, number, codes, text = zip(*out)
        longs = [pa.array(x, pa.int64()) for x in (hi, lo, doc, k)]
        yield pa.RecordBatch.from_arrays([*longs, pa.array(number, pa.int32()), pa.array(codes, pa.list_(pa.int32())), pa.array(text, pa.string())], names=["hi", "lo", "doc", "k", "number", "codes", "text"])


def _variants(it):
    """Deletion neighbourhood: a line as it is (at -1), and without the character at each place where a shared key leaves room."""
    import pyarrow as pa

    for batch in batches(it):
        for hi, lo, doc, k, number, codes, text in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "doc", "k", "number", "codes", "text"))):
            h, n = Lines([text]).h, len(text)
            places = np.zeros(n, bool)
            for c in codes:
                m, j = n - (1 - c // SEGMENTS), c % SEGMENTS
                places[m * j // SEGMENTS : m * (j + 1) // SEGMENTS + 1] = True
            places, size = np.flatnonzero(places), np.array([n], np.uint64)
            # A line is as many variants as characters; a very long one goes in several batches.
            for i in range(0, len(places) + 1, AT_ONCE):
                e = places[i : i + AT_ONCE]
                zero, end = np.zeros(len(e), np.int64), np.full(len(e), n)
                key = mix64(_POWERS.finish(_POWERS.raw(h, zero, e) + _POWERS.raw(h, e + 1, end, e)) + (size - np.uint64(1)) * _C[0])
                at = e.astype(np.int32)
                if not i:
                    whole = mix64(_POWERS.span(h, np.array([0]), np.array([n])) + size * _C[0])
                    key, at = np.concatenate([key, whole]), np.concatenate([at, [-1]]).astype(np.int32)
                if len(at):
                    same = lambda x, t=np.int64: np.full(len(at), x, t)  # noqa: B023, E731
                    yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "place": at, "doc": same(doc), "k": same(k), "number": same(number, np.int32), "hi": same(hi), "lo": same(lo)})


def _earlier(it):
    """Of a partition sorted by key and place: lines with the earliest line that has an equal variant."""
    import pyarrow as pa

    for piece in by_groups(it, ["key"]):
        key, place, doc, k, number, hi, lo = (piece[c] for c in ("key", "place", "doc", "k", "number", "hi", "lo"))
        # Positions in the corpus as numbers that compare alike within this piece; a line has one position.
        order = np.empty(len(key), np.int64)
        by_position = np.lexsort((number, k, doc))
        order[by_position] = np.cumsum(np.concatenate([[0], (np.diff(doc[by_position]) != 0) | (np.diff(k[by_position]) != 0) | (np.diff(number[by_position]) != 0)]))
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        spot = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (place[1:] != place[:-1])]))
        never = np.iinfo(np.int64).max

        def least(of: np.ndarray, use: np.ndarray) -> np.ndarray:
            out = np.full(of[-1] + 1, never)
            np.minimum.at(out, of[use], order[use])  # noqa: B023
            return out

        left_out = place >= 0
        # One place, one rest: the lines differ in that character alone. A line that is itself the rest lacks it.
        before = np.where(left_out, np.minimum(least(spot, left_out)[spot], least(group, ~left_out)[group]), least(group, left_out)[group])
        hit = np.flatnonzero(before < order)
        other = by_position[np.searchsorted(order[by_position], before[hit])]
        yield pa.RecordBatch.from_pydict({"hi": hi[hit], "lo": lo[hit], "doc": doc[other], "k": k[other], "number": number[other], "ohi": hi[other], "olo": lo[other]})


def within_one(a: str, b: str) -> bool:
    """Whether one character put in, left out or replaced at most makes a line of the other; linear in their length."""
    if abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    same = 0
    if short != long[: len(short)]:
        low, high = 0, len(short)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if short[low:middle] == long[low:middle] else (low, middle)
        same = low
    else:
        return True
    return short[same:] == long[same + 1 :] if len(short) < len(long) else short[same + 1 :] == long[same + 1 :]


def _verified(it):
    import pyarrow as pa

    for batch in batches(it):
        near = [within_one(a, b) for a, b in zip(batch.column("text").to_pylist(), batch.column("before").to_pylist())]
        yield batch.select(["hi", "lo"]).filter(pa.array(near, pa.bool_()))


def _packed(batch):
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    return pa.array([None if t is None else pack(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], pa.binary())


def drop_lines(docs: DataFrame, *, lines: str = "n_lines", dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with text rebuilt from the lines that stay, and counts of its lines and of those dropped, named as told.

    Lines are what stands between line feeds. One goes if an earlier line is the same or one edit (a character
    put in, left out or replaced) away; earlier by doc_id (null first), then place in the text. Lines under
    MIN_CHARS characters stay. A null text stays null and counts no line; a text whose lines all go is left
    empty. Rows with one doc_id and one text are one document given twice: they keep the same lines. Rows with
    one doc_id and several texts come in the order of a hash of the text. Texts and lines of any length are
    taken whole. An empty table gives no rows. Other columns pass through, whatever their names; if one is named
    like a count, that is a ValueError.

    1. Lines are named by 128-bit digests; equal lines have one name, a first place and a count.
    2. Two lines within one edit agree outside one of SEGMENTS segments. Lines that share no such key with
       another leave: they have no neighbour.
    3. Of the others all variants with one character left out go, as hashed keys, where a shared key leaves
       room for the edit. Lines with equal variants of the same place, or a line equal to another's variant,
       are neighbours. All lines with one variant differ in one place, so such a group is bounded by line
       length times alphabet and can't grow with the corpus.
    4. The edit distance of each line to its earliest neighbour is verified on the texts.
    5. Places of lines that go: of the few very common lines by a broadcast, of all others by a join.
    """
    if {lines, dropped} & set(docs.columns):
        raise ValueError(f"docs has a column named {lines} or {dropped}: choose other names for the counts")
    own, key = fresh("__doc", docs), fresh("__k", docs)
    named = docs.withColumns({own: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), key: F.xxhash64("doc_id", "text")})
    bodies = named.where("text IS NOT NULL").select(F.col(own).alias("doc"), F.col(key).alias("k"), F.col("text").cast("string").alias("text"))
    occurrences = bodies.mapInArrow(_occurrences, "hi long, lo long, doc long, k long, number int")
    classes = occurrences.groupBy("hi", "lo").agg(F.min(F.struct("doc", "k", "number")).alias("first"), F.count("*").alias("n"))
    # By hash: for ranges all keys would be made twice, once to sample them. A key's rows are 20 bytes for each of its different lines.
    shared = cut(bodies.mapInArrow(_segments, "key long, line long, code int").repartition("key").sortWithinPartitions("key", "line").mapInArrow(_shared, "line long, code int"))
    codes = shared.groupBy(F.col("line").alias("lo")).agg(F.collect_set("code").alias("codes"))
    known = cut(classes.join(codes, "lo", "left").where("n > 1 OR codes IS NOT NULL"))
    by_row = known.where("codes IS NOT NULL").groupBy(F.col("first.doc").alias("doc"), F.col("first.k").alias("k")).agg(F.collect_list(F.struct("hi", "lo", F.col("first.number").alias("number"), "codes")).alias("wanted"))
    few = known.where("codes IS NOT NULL").limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    candidates = cut(bodies.join(F.broadcast(by_row) if few else by_row, ["doc", "k"]).mapInArrow(_named_lines, "hi long, lo long, doc long, k long, number int, codes array<int>, text string").dropDuplicates(["hi", "lo"]))
    near = (
        candidates.mapInArrow(_variants, "key long, place int, doc long, k long, number int, hi long, lo long")
        .repartition("key")
        .sortWithinPartitions("key", "place")
        .mapInArrow(_earlier, "hi long, lo long, doc long, k long, number int, ohi long, olo long")
        .groupBy("hi", "lo")
        .agg(F.min(F.struct("doc", "k", "number", "ohi", "olo")).alias("found"))
        .select("hi", "lo", "found.ohi", "found.olo")
    )
    texts = candidates.select("hi", "lo", "text")
    verified = (
        near.join(texts, ["hi", "lo"])
        .join(texts.select(F.col("hi").alias("ohi"), F.col("lo").alias("olo"), F.col("text").alias("before")), ["ohi", "olo"])
        .mapInArrow(_verified, "hi long, lo long")
        .withColumn("near", F.lit(True))
    )
    affected = cut(known.drop("codes").join(verified, ["hi", "lo"], "left").where("n > 1 OR near").select("hi", "lo", "n", "first", F.coalesce("near", F.lit(False)).alias("near")))
    return _rebuilt(named, _places(occurrences, affected).select(F.col("doc").alias(own), F.col("k").alias(key), F.col("gone")), docs, own, key, lines, dropped)


def _places(occurrences: DataFrame, affected: DataFrame) -> DataFrame:
    """(doc, k, gone): numbers of the lines of a text that go."""
    total = affected.agg(F.sum("n")).first()[0] or 0
    least = int(total * HOT)
    hot = F.broadcast(affected.where(F.col("n") > least).select("hi", "lo", F.col("first").alias("hot_first"), F.col("near").alias("hot_near")))
    rest = affected.where(F.col("n") <= least).select(F.col("hi").alias("rhi"), F.col("lo").alias("rlo"), "first", "near")
    told = F.col("hot_first").isNotNull()
    # A settled row goes on under a key of its own, so it lands anywhere.
    spread = F.when(told, F.xxhash64("doc", "k", "number")).otherwise(F.col("hi"))
    rows = occurrences.join(hot, ["hi", "lo"], "left").withColumn("hi", spread)
    rows = rows.join(rest, (F.col("hi") == F.col("rhi")) & (F.col("lo") == F.col("rlo")) & ~told, "left")
    first, near = F.coalesce("hot_first", "first"), F.coalesce("hot_near", "near")
    return (
        rows.where(first.isNotNull() & (near | (F.col("doc") != first["doc"]) | (F.col("k") != first["k"]) | (F.col("number") != first["number"])))
        .groupBy("doc", "k")
        .agg(F.collect_set("number").alias("gone"))
    )


def _rebuilt(named: DataFrame, gone: DataFrame, docs: DataFrame, own: str, key: str, lines: str, dropped: str) -> DataFrame:
    """``docs`` without the lines in ``gone``; texts are packed while they are joined."""
    columns = docs.columns
    body, drop = fresh("__packed", named), fresh("__gone", named)
    rest = [c for c in named.columns if c != "text"]

    def pack(it):
        import pyarrow as pa

        for batch in batches(it):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), _packed(batch)], names=[*rest, body])

    slim = named.select(*rest, F.col("text").cast("string").alias("text"))
    packed = slim.mapInArrow(pack, named.select(*rest, F.lit(None).cast("binary").alias(body)).schema)
    schema = docs.withColumn("text", F.lit(None).cast("string")).select(*columns, F.lit(0).cast("long").alias(lines), F.lit(0).cast("long").alias(dropped)).schema

    def build(it):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches(it, 256):
            texts, n, went = [], [], []
            for raw, numbers in zip(batch.column(body).to_pylist(), batch.column(drop).to_pylist()):
                parts = None if raw is None else unpack(raw).split(b"\n")
                n.append(len(parts or ()))
                went.append(len(numbers or ()))
                if numbers:
                    numbers = set(numbers)
                    parts = [x for i, x in enumerate(parts) if i not in numbers]
                texts.append(None if parts is None else b"\n".join(parts).decode("utf-8", "surrogatepass"))
            made = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*(made if c == "text" else batch.column(c) for c in columns), pa.array(n, pa.int64()), pa.array(went, pa.int64())], names=[*columns, lines, dropped])

    return packed.join(gone.withColumnRenamed("gone", drop), [own, key], "left").mapInArrow(build, schema)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
