"""Best-fit packing of tokenised documents into sequences of fixed length.

Documents are tokenised where they are read, and only a row for each piece is written. Pieces
are dealt into shards of bounded size, and each shard is packed online, long pieces first, with
a fixed number of open sequences, found through a bitset keyed by free space.
"""

import math
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudinv.llm.byte_bpe import encoder
from cloudinv.llm.common import read, stored

LENGTH = 2048
OPEN = 4096
SHARD = 16_384


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter."""
    first = n % length
    starts = [0] if first else []
    starts += range(first, n, length)
    return [(s, (first if first and not s else length)) for s in starts]


def pieces(docs: DataFrame, length: int = LENGTH, ranks_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (little-endian 32-bit) of every document.

    A document is the ids of its text and then id 0. A null text is empty. Rows are taken as
    they are: repeated rows give repeated pieces, a null doc_id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path)
        for batch in batches:
            ids, rows = batch.column(0), batch.column(1)
            for at in range(0, len(ids), 256):
                out = []
                for doc_id, text in zip(ids[at : at + 256].to_pylist(), rows[at : at + 256].to_pylist()):
                    tokens = bpe.ids(text or "") + b"\0\0\0\0"
                    for piece, (start, n) in enumerate(cut(len(tokens) // 4, length)):
                        own = tokens[4 * start : 4 * (start + n)]
                        out.append((doc_id, piece, start, n, zlib.crc32(own), own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=list(names)
                )

    names = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "ids": "binary"}
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, ", ".join(f"{n} {t}" for n, t in names.items())
    )


def best_fit(sizes, length: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Bin number and offset of each item, in the order of arrival.

    An item goes to the open bin with the least space that still holds it. Bit f of ``spaces``
    is set while an open bin has f free places. A full bin closes; with more than ``open_bins``
    open, the fullest closes.
    """
    spaces, by_space, n_open, made = 0, {}, 0, 0
    bins, offsets = [], []
    for size in sizes:
        fit = spaces >> size
        if fit:
            space = size + (fit & -fit).bit_length() - 1
            own = by_space[space]
            b = own.pop()
            if not own:
                spaces ^= 1 << space
        else:
            space, b = length, made
            made, n_open = made + 1, n_open + 1
        bins.append(b)
        offsets.append(length - space)
        left = space - size
        if not left:
            n_open -= 1
            continue
        by_space.setdefault(left, []).append(b)
        spaces |= 1 << left
        if n_open > open_bins:
            fullest = (spaces & -spaces).bit_length() - 1
            own = by_space[fullest]
            own.pop()
            n_open -= 1
            if not own:
                spaces ^= 1 << fullest
    return bins, offsets


def pack(
    found: DataFrame, length: int = LENGTH, open_bins: int = OPEN, shard: int = SHARD
) -> DataFrame:
    """``found`` (written pieces, any columns) with ``sequence_id`` and ``offset``.

    Shards hold about ``shard`` rows each, so their number grows with the input and no task
    with its size. Sequence ids are unique; offsets within a sequence have no gaps. Columns
    ``sequence_id`` and ``offset`` of the input are replaced; no rows give no rows.
    """
    n = max(1, math.ceil(found.count() / shard))
    found = found.drop("sequence_id", "offset")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows.pop("__shard").iloc[0])
        rows = rows.sort_values("length", ascending=False, kind="stable")
        bins, offsets = best_fit(rows["length"].tolist(), length, open_bins)
        return rows.assign(
            sequence_id=pd.Series(bins, rows.index, dtype="int64") + (number << 32),
            offset=pd.Series(offsets, rows.index, dtype="int64"),
        )

    dealt = found.withColumn("__shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)))
    kinds = ", ".join(f"`{c}` {t}" for c, t in found.dtypes)
    return dealt.groupBy("__shard").applyInPandas(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, length: int = LENGTH, ranks_path: str | None = None) -> DataFrame:
    """Tokenise, cut and pack ``docs``; a row for each piece, without the ids themselves."""
    return pack(stored(pieces(docs, length, ranks_path).drop("ids"), "pieces"), length)


def op8_best_fit_packing(spark, sf_dir) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
