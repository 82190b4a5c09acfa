"""Repeated-substring removal: sorted position-rank pairs at growing lengths, reranked until unique or at the threshold."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.common import as_bytes, batches, by_groups, chunks, cut, mix64, read, rolling

LENGTH = 200
#: Length of the first rank. Each LENGTH-byte string holds this many more starts of such a rank, and is placed by the least of them.
FIRST = 32
#: Bits for a position when the least rank is sought, so ties go to the leftmost: enough for any text that Arrow holds (2 GB).
_BITS = np.uint64(31)
#: Windows that are told apart together in round two.
CELL = 16
#: Bytes of text that are stored, sent and worked on together; a longer text is a block by itself.
BLOCK = 1 << 20
#: Positions that one step over a block handles.
STEP = 1 << 14


def names(data: bytes, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A row of two 64-bit numbers for each data[low:high]: a 128-bit digest that no known method makes collide."""
    view, digest = memoryview(data), hashlib.blake2b
    return np.frombuffer(b"".join([digest(view[a:b], digest_size=16).digest() for a, b in zip(low.tolist(), high.tolist())]), np.uint64).reshape(-1, 2)


def _pack(it):
    """Neighbouring texts as compressed blocks."""
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor(level=6).compress
    for batch in batches(it):
        ids, texts = batch.column("doc_id"), as_bytes(batch.column("text"))
        sizes = np.array([len(t) for t in texts])
        out = [(ids.slice(i, j - i).to_pylist(), sizes[i:j].tolist(), pack(b"".join(texts[i:j]))) for i, j in chunks(sizes, BLOCK)]
        names, lengths, packed = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int32())), pa.array(packed, pa.binary())], names=["doc_ids", "sizes", "packed"])


def _blocks(batch):
    """(row in the batch, block, doc_ids, Windows) of each block."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for k in range(batch.num_rows):
        yield k, Windows(unpack(batch.column("packed")[k].as_py()), np.array(batch.column("sizes")[k].as_py(), np.int64))


class Windows:
    """All LENGTH-byte windows of the texts of a block, in runs that are placed by the same anchor."""

    def __init__(self, data: bytes, sizes: np.ndarray) -> None:
        self.bytes, self.data = data, np.frombuffer(data, np.uint8)
        self.offset = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self._runs = None

    @property
    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors, and the first and last window that each places."""
        if self._runs is None:
            self._runs = self._find()
        return self._runs

    def _find(self):
        n = len(self.data)
        if n < LENGTH:
            return (np.zeros(0, np.int64),) * 3
        self.rank = np.empty(n - FIRST + 1, np.uint64)
        m = np.empty(n - LENGTH + 1, np.uint64)
        # Some positions at a time, so that all steps stay in the processor's cache.
        for i in range(0, len(m), STEP):
            size = min(STEP, len(m) - i)
            rank = rolling(self.data[i : i + size + LENGTH - 1], FIRST)
            self.rank[i : i + len(rank)] = rank
            x = (rank >> _BITS << _BITS) | np.arange(i, i + len(rank), dtype=np.uint64)
            reach, width = LENGTH - FIRST + 1, 1
            while width * 2 <= reach:
                x = np.minimum(x[:-width], x[width:])
                width *= 2
            m[i : i + size] = np.minimum(x[: len(x) - (reach - width)], x[reach - width :])
        ends = np.repeat(self.offset[1:], np.diff(self.offset))
        p = np.flatnonzero(ends[: len(m)] - np.arange(len(m)) >= LENGTH)
        if not len(p):
            return (np.zeros(0, np.int64),) * 3
        a = (m[p] & np.uint64((1 << 31) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        return a[new], p[new], p[np.concatenate([new[1:], [len(p)]]) - 1]

    def hull(self, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Name of the bytes from left to right as far as the text of ``at`` goes, and of how far ``at`` is in it."""
        doc = np.searchsorted(self.offset, at, "right") - 1
        left, right = np.maximum(self.offset[doc], left), np.minimum(self.offset[doc + 1], right)
        return names(self.bytes, left, right) + mix64((at - left).astype(np.uint64))[:, None]

    def run_of(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        anchors, low, high = self.runs
        i = np.searchsorted(anchors, anchor)
        return low[i], high[i]

    def cells(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells of each anchor's run: index of the anchor, and number of the cell, counted back from the anchor."""
        low, high = self.run_of(anchor)
        first, last = (anchor - high) // CELL, (anchor - low) // CELL
        n = last - first + 1
        which = np.repeat(np.arange(len(anchor)), n)
        return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[which]

    def in_cell(self, anchor: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last window of the run that lie in a cell."""
        low, high = self.run_of(anchor)
        return np.maximum(low, anchor - CELL * (cell + 1) + 1), np.minimum(high, anchor - CELL * cell)


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = high - low + 1
    which = np.repeat(np.arange(len(low)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]


def _rows(key, hull, block, pos, weight, known):
    import pyarrow as pa

    n = len(key)
    hull = np.ascontiguousarray(hull.T).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(hull[0]), pa.array(hull[1]), pa.array(np.full(n, block)), pa.array(pos.astype(np.int64)), pa.array(np.broadcast_to(weight, n).astype(np.int8)), pa.array(np.broadcast_to(known, n).astype(bool))],
        names=["key", "hull", "more", "block", "pos", "weight", "known"],
    )


ROWS = "key long, hull long, more long, block long, pos long, weight byte, known boolean"


def _anchors(it):
    """Round one: an anchor's rank at FIRST, and of all the bytes that its windows could hold."""
    for batch in batches(it, 1):
        for k, w in _blocks(batch):
            a = w.runs[0]
            if len(a):
                yield _rows(w.rank[a], w.hull(a, a - (LENGTH - FIRST), a + LENGTH), batch.column("block")[k].as_py(), a, 1, False)


def _listed(batch, k: int, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pos, whole and weight of the marks of one block."""
    flat = batch.column(column).slice(k, 1).flatten()
    return flat.field("pos").to_numpy(zero_copy_only=False), flat.field("whole").to_numpy(zero_copy_only=False).astype(bool), flat.field("weight").to_numpy(zero_copy_only=False)


def _cells(it):
    """Round two: of each anchor with a weight the cells of CELL windows, the bytes that all of them hold and that any could."""
    for batch in batches(it, 1):
        for k, w in _blocks(batch):
            pos, whole, weight = _listed(batch, k, "marks")
            use = weight > 0
            if use.any():
                a = pos[use]
                which, cell = w.cells(a)
                a = a[which]
                low, high = a - CELL * (cell + 1) + 1, a - CELL * cell
                # Cells of neighbouring runs may lie in one place, each with windows of its own: anchor and number tell them apart.
                key = mix64(names(w.bytes, high, low + LENGTH)[:, 0] + w.rank[a] * np.uint64(3) + cell.astype(np.uint64))
                yield _rows(key, w.hull(high, low, high + LENGTH), batch.column("block")[k].as_py(), a * CELL + cell, weight[use][which], whole[use][which])


def _windows(it):
    """Round three: of each cell with a weight the single windows, by their rank at LENGTH."""
    for batch in batches(it, 1):
        for k, w in _blocks(batch):
            pos, whole, weight = _listed(batch, k, "marks")
            use = weight > 0
            if use.any():
                low, high = w.in_cell(pos[use] // CELL, pos[use] % CELL)
                which, p = _spread(low, high)
                name = names(w.bytes, p, p + LENGTH)
                yield _rows(np.ascontiguousarray(name[:, 0]), np.stack([name[:, 1], np.zeros(len(p), np.uint64)], 1), batch.column("block")[k].as_py(), p, weight[use][which], whole[use][which])


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each row and first row of each group, for sorted rows."""
    change = np.zeros(len(columns[0]), bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.cumsum(change) - 1, np.flatnonzero(change)


def _pieces(it):
    """(columns, is the first, is the last) of each piece of a sorted partition; a key lies in one piece."""
    before, first = None, True
    for piece in by_groups(it, ["key"]):
        if before is not None:
            yield before, first, False
            first = False
        before = piece
    if before is not None:
        yield before, first, True


def _rerank(it):
    """Of a sorted partition: rows whose hull recurs (whole), and one row for each hull of a key that has several
    (weight: 1, or 2 for a hull that recurs); a row whose key is unique goes.

    The keys at the partition's ends may go on in the next one, so they count as having several hulls.
    """
    import pyarrow as pa

    for t, first, last in _pieces(it):
        group, group_first = _groups(t["key"])
        kind, kind_first = _groups(t["key"], t["hull"], t["more"])
        size = np.add.reduceat(t["weight"].astype(np.int64), kind_first)
        mixed = np.bincount(group[kind_first], minlength=len(group_first)) > 1
        mixed[0] |= first
        mixed[-1] |= last
        known = t["known"].astype(bool)
        whole = (size[kind] > 1) | known
        weight = np.zeros(len(kind), np.int8)
        weight[kind_first] = np.where(mixed[group[kind_first]], np.minimum(size, 2), 0)
        keep = (whole & ~known) | (weight > 0)
        yield pa.RecordBatch.from_arrays([pa.array(t["block"][keep]), pa.array(t["pos"][keep]), pa.array(whole[keep]), pa.array(weight[keep])], names=["block", "pos", "whole", "weight"])


def _rerank_windows(it):
    """Of a sorted partition: windows that recur and aren't known to (edge false), and a row for each key at its ends."""
    import pyarrow as pa

    for t, begins, ends in _pieces(it):
        group, first = _groups(t["key"], t["hull"])
        total = np.add.reduceat(t["weight"].astype(np.int64), first)
        keep = np.flatnonzero((total[group] > 1) & ~t["known"].astype(bool))
        edges = np.unique(first[[0] * begins + [-1] * ends])
        at = np.concatenate([keep, edges])
        edge = np.repeat([False, True], [len(keep), len(edges)])
        yield pa.RecordBatch.from_arrays([pa.array(t["key"][at]), pa.array(t["hull"][at]), pa.array(t["block"][at]), pa.array(t["pos"][at]), pa.array(total[group[at]]), pa.array(edge)], names=["key", "hull", "block", "pos", "total", "edge"])


def _removed(it):
    """What is left of each text, from its recurring anchors (marks), cells and windows."""
    import pyarrow as pa

    for batch in batches(it, 1):
        for k, w in _blocks(batch):
            n = len(w.data)
            depth = np.zeros(n + 1, np.int32)

            def cover(low, high):
                np.add.at(depth, low, 1)
                np.add.at(depth, high + LENGTH, -1)

            pos, whole, _ = _listed(batch, k, "marks")
            if whole.any():
                cover(*w.run_of(pos[whole]))
            pos, whole, _ = _listed(batch, k, "cells")
            if whole.any():
                cover(*w.in_cell(pos[whole] // CELL, pos[whole] % CELL))
            single = batch.column("more").slice(k, 1).flatten().to_numpy()
            if len(single):
                cover(single, single)
            gone = np.cumsum(depth)[:n] > 0
            removed, spans, kept = [], [], []
            for a, b in zip(w.offset[:-1], w.offset[1:]):
                g = gone[a:b]
                removed.append(int(g.sum()))
                spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if b > a else 0)
                kept.append(w.data[a:b][~g].tobytes() if removed[-1] else w.data[a:b].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column("doc_ids")[k].as_py(), pa.int64()), pa.array(np.diff(w.offset)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) for each row of ``docs``.

    Each byte goes that lies in a LENGTH-byte string which starts anywhere else too, in any row or the same one;
    strings are judged on the input. Null text: empty. A text under LENGTH bytes keeps all. Repeated rows are
    texts of their own, so both lose what they share. An empty table gives no rows.

    Prefix doubling over suffixes sorts a rank for each byte, at growing lengths, until it is unique or the
    length is at the threshold. Here ranks are hashes, and the rounds are thinned without loss. Each window is
    placed by the least FIRST-byte rank in it, which recurs with it. Round one sorts (rank at FIRST, rank of all
    the bytes around it) for these anchors, one byte in 85; unique ranks leave, and where all surroundings agree
    all windows there are known to recur. Where they differ, round two sorts the same pair for cells of CELL
    neighbouring windows, one row for each kind of surroundings; where these differ still, round three sorts
    the single windows at LENGTH. Partitions are ranges of the sorted pairs, so a rank with a third of all
    positions spans tasks; keys at partition ends go on to the next round, and the last round's are settled by
    themselves. The ranks that decide are 128-bit digests of the bytes, so no two strings that differ are taken for
    equal. Texts may have up to 2 GB, as Arrow has it; columns but doc_id and text are not read, so their names
    can't clash.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pack, "doc_ids array<long>, sizes array<int>, packed binary")
    held = cut(rows.withColumn("block", F.monotonically_increasing_id()))
    order = ["key", "hull", "more", "block", "pos"]

    def marked(pairs: DataFrame) -> DataFrame:
        found = pairs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_rerank, "block long, pos long, whole boolean, weight byte")
        return cut(found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "whole", "weight"))).alias("marks")))

    def again(marks: DataFrame) -> DataFrame:
        """The blocks with marks to look into; only these marks go along."""
        open_marks = marks.select("block", F.filter("marks", lambda x: x["weight"] > 0).alias("marks")).where(F.size("marks") > 0)
        return held.drop("doc_ids").join(open_marks, "block")

    marks = marked(held.select("block", "sizes", "packed").mapInArrow(_anchors, ROWS))
    cells = marked(again(marks).mapInArrow(_cells, ROWS))
    windows = again(cells).mapInArrow(_windows, ROWS).repartitionByRange("key", "hull", "block", "pos").sortWithinPartitions("key", "hull", "block", "pos")
    found = cut(windows.mapInArrow(_rerank_windows, "key long, hull long, block long, pos long, total long, edge boolean"))
    edges = found.where("edge")
    across = edges.where("total = 1").join(edges.groupBy("key", "hull").agg(F.sum("total").alias("sum")).where("sum > 1").select("key", "hull"), ["key", "hull"], "left_semi")
    more = found.where("NOT edge").select("block", "pos").unionByName(across.select("block", "pos")).groupBy("block").agg(F.sort_array(F.collect_list("pos")).alias("more"))
    sure = lambda df, name: df.select("block", F.filter("marks", lambda x: x["whole"]).alias(name)).where(F.size(name) > 0)
    told = sure(marks, "marks").join(sure(cells, "cells"), "block", "full").join(more, "block", "full")
    none = F.expr("cast(array() as array<struct<pos: bigint, whole: boolean, weight: tinyint>>)")
    out = held.join(told, "block", "left").select("doc_ids", "sizes", "packed", F.coalesce("marks", none).alias("marks"), F.coalesce("cells", none).alias("cells"), F.coalesce("more", F.expr("cast(array() as array<bigint>)")).alias("more"))
    return out.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("kept")
