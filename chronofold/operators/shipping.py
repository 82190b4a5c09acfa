"""Tables that each worker holds whole: sent as compressed Arrow buffers, and built once a worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows that a pass sees at once: a query with three lists of 200 is 10 KB, and each pass holds its lists more than once.
STEP = 1024


class Shipped:
    """Arrow buffers of some tables and the function that builds from them what tasks use; a worker keeps what was built."""

    def __init__(self, tables: list[list[bytes]], build: Callable) -> None:
        self.tables, self.build, self._built = tables, build, None

    @property
    def built(self):
        if self._built is None:
            import pyarrow as pa

            self._built = self.build(*(lambda parts=parts: read(parts) for parts in self.tables))
            self.build, self.tables = None, []
            pa.default_memory_pool().release_unused()  # else a worker keeps what building took
        return self._built


def read(parts: list[bytes]):
    """The Arrow table of some buffers, which are let go one by one; None without rows."""
    import pyarrow as pa

    found = []
    while parts:
        found.append(pa.ipc.open_stream(parts.pop()).read_all())
    return pa.concat_tables(found) if found else None


def packed(df: DataFrame) -> list[bytes]:
    """``df`` on the driver as compressed Arrow buffers, never as rows. The caller bounds the number of rows."""

    def pack(it):
        import pyarrow as pa

        for batch in it:
            if batch.num_rows:
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_batch(batch)
                yield pa.RecordBatch.from_pydict({"raw": pa.array([out.getvalue().to_pybytes()], pa.binary())})

    return [bytes(r["raw"]) for r in df.mapInArrow(pack, "raw binary").collect()]


def ship(build: Callable, *tables: DataFrame):
    """A broadcast whose ``value.built`` is ``build`` of functions that read the tables, each once, so that a table needn't outlive its use."""
    return tables[0].sparkSession.sparkContext.broadcast(Shipped([packed(t) for t in tables], build))


def through(rows: DataFrame, passes: list[tuple[Callable, dict[str, str]]]) -> DataFrame:
    """``rows`` with the columns of some passes (a function of batches, and the types of what it adds), one after another
    in one worker: a mapInArrow for each would hold a worker for each at once."""

    def run(it):
        it = (whole.slice(at, STEP) for whole in it for at in range(0, whole.num_rows, STEP))
        for each, _ in passes:
            it = each(it)
        return it

    return rows.mapInArrow(run, rows.withColumns({c: F.lit(None).cast(kind) for _, more in passes for c, kind in more.items()}).schema)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of arrays in one, and the length of each array (null: 0)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    values = column.flatten()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return plain(values), lengths if len(column) else np.zeros(0, np.int64)


def plain(values) -> np.ndarray:
    """Ids as NumPy has them: strings by code points, which is the order of their bytes."""
    import pyarrow as pa

    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
        return np.array(values.to_pylist(), str) if len(values) else np.array([], "U1")
    return values.to_numpy(zero_copy_only=False)


def places(names: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of each value in the sorted ``names``, -1 where it's none of them."""
    if not len(names) or not len(values):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(names, values), len(names) - 1)
    return np.where(names[at] == values, at, -1)


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each of the lengths, one after another."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def last_known(known: np.ndarray, lengths: np.ndarray, newest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of arrays one after another their last ``newest`` values that are no -1: owner, value, places from the newest kept one, places from the end."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    back = np.repeat(np.cumsum(lengths), lengths) - 1 - np.arange(len(known))
    kept = (back < newest) & (known >= 0)
    owner, known, back = owner[kept], known[kept], back[kept]
    ends = np.cumsum(np.bincount(owner, minlength=len(lengths)))
    return owner, known, ends[owner] - 1 - np.arange(len(owner)), back


def lists_of(parts: list[np.ndarray], kind):
    """A column of arrays of Arrow's ``kind``."""
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.tolist() if values.dtype.kind in "UO" else values, kind))
