"""Packing: deficit round-robin over source queues fills each window to the sources' token proportions."""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.common import as_bytes, batches, cut, read, running_total

WINDOW = 4096
END = 2
#: A queue is served once its deficit reaches this many tokens, so documents aren't cut to crumbs.
GRANULE = 256
#: Queues at most: with more sources the largest have their own, and all others share one.
MAX_QUEUES = 4096
SEED = 41
#: Words that a worker remembers the ids of; a full cache starts anew.
CACHE = 600_000
#: Fixed-point bits of a round's quantum.
SHIFT = 16


def splits_at_space(spec: dict) -> bool:
    """Whether a vocabulary file is of the kind that can be encoded word by word: NFC, white space made even, lower
    case; pre-tokens by a pattern that leaves white space out; bytes as letters; special tokens in <| |>."""
    normal, pre, model = (spec.get(x) or {} for x in ("normalizer", "pre_tokenizer", "model"))
    kinds = [x.get("type") for x in normal.get("normalizers", [])]
    parts = pre.get("pretokenizers", [])
    return (
        kinds == ["NFC", "Replace", "Lowercase"]
        and normal["normalizers"][1].get("pattern") == {"Regex": "\\s+"}
        and [x.get("type") for x in parts] == ["Split", "ByteLevel"]
        and (parts[0].get("behavior"), parts[0].get("invert")) == ("Removed", True)
        and "\\s" in parts[0].get("pattern", {}).get("Regex", "")
        and (parts[1].get("add_prefix_space"), parts[1].get("use_regex")) == (False, False)
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and all("<|" in x["content"] for x in spec.get("added_tokens", []))
    )


class Encoder(dict):
    """Ids of a text by a vocabulary file. One whose pre-tokens never cross white space goes word by word, through a
    cache; for any other kind of file the library encodes each text.

    A missing word of plain letters and marks is split by the file's own pattern and merged by the library's
    model; any other word goes through the whole library, and so does a text with anything unusual about its spaces.
    """

    def __init__(self, path: str, cache: int = CACHE) -> None:
        import regex
        from tokenizers import Tokenizer

        self.cache = cache
        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        self.fast = splits_at_space(spec)
        if not self.fast:
            self.dtype = np.dtype("<u4")
            return
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.simple = regex.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.merge = self.whole.model.tokenize
        # The byte-to-letter rule of byte-level vocabularies: visible bytes stand for themselves, others follow from 256 on.
        visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = (b for b in range(256) if b not in set(visible))
        self.letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.cache:
            self.clear()
        text = word.decode()
        if self.simple(text) and "<|" not in text:
            parts = self.split(text.lower())
            if parts == [text]:
                out = array(self.dtype.char, [t.id for t in self.merge(text if text.isascii() else word.decode("latin-1").translate(self.letters))]).tobytes()
            else:
                # A pre-token stands in the cache as the word that it is by itself.
                out = b"".join([self[p.encode()] for p in parts])
        else:
            out = np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        if len(word) <= 48:
            self[word] = out
        return out

    def encode(self, text: bytes) -> bytes:
        if not self.fast:
            return np.array(self.whole.encode(text.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, self.dtype).tobytes()
        # bytes.split() splits at ASCII white space only, which no pre-token of such a file holds. The file's own
        # lower case comes to the same words, but for its special tokens.
        return b"".join(map(self.__getitem__, (text if b"<|" in text else text.lower()).split()))


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache: int = CACHE) -> Encoder:
    if (path, cache) not in _ENCODERS:
        _ENCODERS[path, cache] = Encoder(path, cache)
    return _ENCODERS[path, cache]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize(docs: DataFrame, vocabulary: str | None = None, cache: int = CACHE) -> DataFrame:
    """doc_id, queue, n and ids (compressed little-endian ids with END last) of each row's whole text; ``cache`` words a worker remembers."""
    vocabulary = vocabulary or default_vocabulary()

    def run(it):
        import pyarrow as pa
        import zstandard

        e, pack = encoder(vocabulary, cache), zstandard.ZstdCompressor(level=3).compress
        end = np.array([END], e.dtype).tobytes()
        for batch in batches(it):
            n, packed = [], []
            for text in as_bytes(batch.column("text")):
                ids = e.encode(text) + end
                n.append(len(ids) // e.dtype.itemsize)
                packed.append(pack(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "source", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, source string, n long, ids binary")


class Rounds:
    """The round-robin in closed form: how much each queue has sent by any round, so that no task depends on another.

    In a round a queue's deficit grows by its share of WINDOW tokens (its part of ``mixture``, or else of all tokens);
    it sends whole granules of what has piled up, and all that it still holds once its credit covers that. What it
    can't send is carried to the next round, across windows and partitions alike. The stream is the rounds one
    after another, in each the queues in turn; its tokens WINDOW by WINDOW are the sequences. A queue that is
    empty leaves the windows to the others.
    """

    def __init__(self, totals: list[int], window: int = WINDOW, granule: int = GRANULE, mixture: list[float] | None = None) -> None:
        self.total = np.array(totals, np.int64)
        parts = [float(t) for t in totals] if mixture is None else mixture
        everything = sum(parts) or 1.0
        self.quantum = np.array([max(1, round(window * x / everything * (1 << SHIFT))) for x in parts], np.int64)
        self.granule = granule
        self.phase = np.arange(len(totals), dtype=np.int64) * granule // max(1, len(totals))

    def sent(self, rounds: np.ndarray, queue: int | None = None) -> np.ndarray:
        """Tokens sent before each round, for one queue or (as columns) all."""
        pick = slice(None) if queue is None else slice(queue, queue + 1)
        # A queue's credit is of no use beyond its total, and so can't overflow.
        credit = np.minimum(rounds[:, None], self.last(pick)) * self.quantum[pick] >> SHIFT
        whole = (credit + self.phase[pick]) // self.granule * self.granule
        out = np.where(credit >= self.total[pick], self.total[pick], np.minimum(whole, self.total[pick]))
        return np.where(rounds[:, None] <= 0, 0, out)

    def last(self, pick) -> np.ndarray:
        """The first round before which a queue has sent all."""
        return -(-(self.total[pick] << SHIFT) // self.quantum[pick])

    def sending(self, queue: int, before: int, n: int) -> np.ndarray:
        """The rounds in which a queue sends any of the ``n`` tokens after its first ``before``: one for each granule at most, however far apart."""
        q, total, phase = int(self.quantum[queue]), int(self.total[queue]), int(self.phase[queue])
        granules = np.arange(before // self.granule + 1, (before + n - 1) // self.granule + 2, dtype=np.int64)
        credit = np.minimum(granules * self.granule - phase, total)
        # The least round at whose start the credit is there; the tokens went in the one before. Nothing goes before round 0.
        return np.unique(np.maximum(-(-(credit << SHIFT) // q), 1) - 1)

    def starts(self, rounds: np.ndarray, queue: int, most: int = 1 << 18) -> np.ndarray:
        """Where in the stream a queue's turn of each round begins."""
        out = np.empty(len(rounds), np.int64)
        step = max(1, most // len(self.total))
        for i in range(0, len(rounds), step):
            now = rounds[i : i + step]
            out[i : i + step] = self.sent(now + 1)[:, :queue].sum(1) + self.sent(now)[:, queue:].sum(1)
        return out

    def pieces(self, queue: int, before: int, n: int, window: int = WINDOW) -> list[tuple[int, int, int]]:
        """(start, length, stream position) of a document with ``n`` tokens after ``before`` of its queue's."""
        r = self.sending(queue, before, n)
        low, high = self.sent(r, queue)[:, 0], self.sent(r + 1, queue)[:, 0]
        a, b = np.maximum(low, before), np.minimum(high, before + n)
        use = np.flatnonzero(b > a)
        base = self.starts(r[use], queue)
        out: list[tuple[int, int, int]] = []
        for start, length, at in zip((a[use] - before).tolist(), (b[use] - a[use]).tolist(), (base + a[use] - low[use]).tolist()):
            while length:
                k = min(length, window - at % window)
                if out and out[-1][2] + out[-1][1] == at and at % window:
                    out[-1] = (out[-1][0], out[-1][1] + k, out[-1][2])
                else:
                    out.append((start, k, at))
                start, at, length = start + k, at + k, length - k
        return out


def _queues(held: DataFrame, own: int) -> tuple[DataFrame, dict[str, int]]:
    """``held`` with its queue column settled, and the tokens of each queue: the ``own`` largest sources by themselves, all others as one."""
    sums = held.groupBy("queue").agg(F.sum("n").alias("n"))
    if sums.limit(own + 1).count() > own:
        large = F.broadcast(cut(sums.orderBy(F.desc("n"), "queue").limit(own - 1).select("queue")).withColumn("__large", F.lit(True)))
        held = held.join(large, "queue", "left").withColumn("queue", F.when(F.col("__large"), F.col("queue")).otherwise("#")).drop("__large")
        sums = held.groupBy("queue").agg(F.sum("n").alias("n"))
    return held, {r["queue"]: r["n"] for r in sums.collect()}


def pack(tokens: DataFrame, *, item: int = 2, window: int = WINDOW, granule: int = GRANULE, max_queues: int = MAX_QUEUES, mixture: dict[str | None, float] | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of tokenized documents, each in its place in a sequence; ``with_ids`` adds the piece's ids.

    ``mixture`` has target weights of sources; one that it doesn't name, and all without it, weigh their share of
    all tokens. Source queues hold their documents in a hashed order; what comes before a document in its queue is
    an exact distributed prefix sum. The driver learns the sum of each queue, at most ``max_queues`` numbers: with
    more sources the largest have queues of their own, and the others share one, in which their documents stand
    shuffled. All sequences but the last hold ``window`` tokens, and each has its queues within a granule of
    their weights as long as they last. The last one's length isn't a full window; it is the only padding.

    Null text: END alone. Null source: a queue of its own. Repeated rows: documents of their own. A text of any
    length is cut. Columns but doc_id, source and text are not read, so their names can't clash. An empty table
    gives no rows.
    """
    queue = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))
    held = cut(tokens.withColumn("row", F.monotonically_increasing_id()).withColumn("queue", queue).withColumn("order", F.xxhash64(F.lit(SEED), "row", "doc_id")).drop("source"))
    held, sums = _queues(held, max_queues)
    names = sorted(sums)
    weights = None
    if mixture is not None:
        told = {"-" if k is None else f"+{k}": float(v) for k, v in mixture.items()}
        everything = max(1, sum(sums.values()))
        weights = [told.get(x, sums[x] / everything) for x in names]
    index, rounds = {x: i for i, x in enumerate(names)}, Rounds([sums[x] for x in names], window, granule, weights)
    placed = running_total(held, "queue", ["order", "row"], F.col("n"), "before", totals=held.select("queue", "order", "row", "n"))

    def cut_up(it):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        types = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})
        for batch in batches(it):
            out: list[tuple] = []
            for doc, name, before, n, packed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "queue", "before", "n", "ids"))):
                ids = np.frombuffer(unpack(packed), f"<u{item}").astype("<u4")
                for start, length, at in rounds.pieces(index[name], before, n, window):
                    own = ids[start : start + length]
                    out.append((doc, start, length, zlib.crc32(own.tobytes()), n, at // window, at % window) + ((own,) if with_ids else ()))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), types.values())], names=list(types))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return placed.select("doc_id", "queue", "before", "n", "ids").mapInArrow(cut_up, schema)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, cache: int = CACHE, **more) -> DataFrame:
    vocabulary = vocabulary or default_vocabulary()
    return pack(tokenize(docs, vocabulary, cache), item=encoder(vocabulary, cache).dtype.itemsize, **more)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
