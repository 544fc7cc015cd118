"""What the vector operators share: usable rows, whole-number components, packed blocks."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(embedding: str = "embedding") -> Column:
    """A vector is there, and none of its components is null, NaN or infinite."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(embedding).isNotNull() & good


def whole(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale x) of all components in a row, and where each vector starts (one place more than vectors).

    The product is taken in doubles. A component beyond 64 bits is an error.
    """
    starts = np.concatenate(([0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))))
    cells = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(cells) and not np.abs(cells).max() < 2.0**63:
        raise OverflowError("a scaled component does not fit a long")
    return cells.astype(np.int64), starts.astype(np.int64)


BLOCK = "part long, dim int, ids binary, labels binary, cells binary"


def packed(rows: DataFrame, scale: float, size: int) -> DataFrame:
    """Blocks of at most ``size`` vectors of one length, from (vec_id, label, embedding) as partitioned.

    Rows must come by length of vector within a partition. ``part`` tells blocks apart. One
    open block is held in memory.
    """
    names = [f.split()[0] for f in BLOCK.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, held, count, dim = TaskContext.get().partitionId() << 32, 0, [], 0, -1

        def out():
            ids, labels, cells = (np.concatenate(c).astype("<i8").tobytes() for c in zip(*held))
            columns = [[first + made], [dim], [ids], [labels], [cells]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cells, starts = whole(batch.column(2), scale)
            lengths, at = np.diff(starts), 0
            while at < len(ids):
                if held and (count >= size or lengths[at] != dim):
                    yield out()
                    made, held, count = made + 1, [], 0
                dim = int(lengths[at])
                alike = lengths[at : at + size - count] == dim
                to = at + (len(alike) if alike.all() else int(alike.argmin()))
                held.append((ids[at:to], labels[at:to], cells[starts[at] : starts[to]]))
                count, at = count + to - at, to
        if held:
            yield out()

    return rows.select("vec_id", "label", "embedding").mapInArrow(run, BLOCK)


def unpacked(dim: int, *columns: bytes) -> list[np.ndarray]:
    """ids, labels and so on as numbers, the last one as one row per vector."""
    *plain, cells = (np.frombuffer(c, "<i8") for c in columns)
    return [*plain, cells.reshape(len(plain[0]), dim)]
