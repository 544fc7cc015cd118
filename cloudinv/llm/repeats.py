"""Remove byte strings that occur earlier in the corpus, by sorting a sampled set of its suffixes.

Of the ``LENGTH - SEED + 1`` seeds (strings of SEED bytes) in a string of LENGTH bytes, the one with
the least hash is its anchor. Equal strings have equal anchors at equal places, so only suffixes at
anchors, about one in 27, take part:

1. Texts that another row holds as a whole are settled first; only the first holder goes on.
2. Anchors are dealt by their hash, and those whose seed occurs once are dropped.
3. The suffixes at the others, with all strings that they are the anchor of, are range-partitioned by
   their leading bytes: the splitters come from what a bounded sample of documents sends, by its bytes,
   and a seed that fills a bucket has one of its own. A bucket sorts its suffixes by multikey
   quicksort, eight bytes at a time, and marks the strings that occur earlier.
4. A seed found more than DENSE times would make a bucket grow with the corpus. Its strings are dealt
   by a 128-bit hash of the string instead. A task sends on only its first holder of each string; the
   buckets compare these first holders, which stands for the comparison across buckets' borders.

Seeds found in a share of a bounded sample of documents are known to be repeated, and are not counted
in step 2, so that no part there gathers a seed that a third of all documents share.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudinv.llm.common import read, stored, text_key
from cloudinv.llm.lm import BITS_EACH, build_filter, mix, places, segments

LENGTH, SEED = 100, 48
#: Bytes of text that a task works on at a time.
CHUNK = 1 << 18
#: Documents of the sample, and in how many of them a frequent seed is found.
SAMPLE, FREQUENT = 2000, 10
#: Places of a seed up to which they meet in one bucket.
DENSE = 20_000
#: Strings of a bucket that are compared at a time.
STRINGS = 1 << 17
#: Buckets for strings of dense seeds, for each range of leading bytes.
SPREAD = 16
#: Anchors of one part in step 2, bytes of one bucket in step 3, most ranges of leading bytes, and
#: least segments of the document filter.
PART, BUCKET, RANGES, SEGMENTS = 1_000_000, 1 << 21, 4096, 128
#: Most segments of the document filter (32 MB, 16.7 million keys); with more keys there is none.
MOST_SEGMENTS = 4096
NONE = -(2**63)

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _join(a: np.ndarray, b: np.ndarray, by: np.uint64 = _A) -> np.ndarray:
    return mix(a * by + b)


class Hashes:
    """Hashes of the strings at each place of a buffer; those that run over its end are void."""

    def __init__(self, data: bytes):
        n = len(data)
        self.n = n
        padded = data + bytes(LENGTH + 8)
        eight = mix(np.ndarray((n + LENGTH,), "<u8", padded, strides=(1,)))
        sixteen = _join(eight[: n + 84], eight[8 : n + 92])
        self.eight, self.thirty_two = eight, _join(sixteen[: n + 68], sixteen[16 : n + 84])
        self.seed = _join(self.thirty_two[: n + 36], sixteen[32 : n + 68])

    def anchors(self) -> np.ndarray:
        """The place of the anchor of the string at each place; ties go to the first."""
        m = (self.seed >> np.uint64(24) << np.uint64(24)) | np.arange(len(self.seed), dtype=np.uint64)
        width, whole = 1, LENGTH - SEED + 1
        m = np.concatenate((m, np.full(whole, ~np.uint64(0))))
        while 2 * width <= whole:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        rest = whole - width
        m = np.minimum(m[: self.n], m[rest : self.n + rest])
        return (m & np.uint64(0xFFFFFF)).astype(np.int64)

    def strings(self, at: np.ndarray, by: np.uint64 = _A) -> np.ndarray:
        """Hashes of the LENGTH bytes at each place of ``at``."""
        first = _join(self.thirty_two[at], self.thirty_two[at + 32], by)
        return _join(first, _join(self.thirty_two[at + 64], self.eight[at + 92], by), by)


def chunks(docs) -> Iterator[tuple[bytes, list[tuple]]]:
    """Buffers of about CHUNK bytes and their pieces (key, offset in the document, start, end).

    ``docs``: (key, bytes). A long document is cut into pieces that overlap by LENGTH - 1 bytes, so
    each string lies in exactly one of them.
    """
    held, pieces, size = [], [], 0
    for key, data in docs:
        for at in range(0, max(1, len(data) - LENGTH + 1), CHUNK):
            own = data[at : at + CHUNK + LENGTH - 1]
            held.append(own)
            pieces.append((key, at, size, size + len(own)))
            size += len(own)
            if size >= CHUNK:
                yield b"".join(held), pieces
                held, pieces, size = [], [], 0
    if held:
        yield b"".join(held), pieces


def runs(data: bytes, pieces: list[tuple]):
    """(hashes, piece, anchor, first, last): the strings at first..last have one anchor."""
    found = Hashes(data)
    starts = np.array([p[2] for p in pieces])
    ends = np.array([p[3] for p in pieces])
    counts = np.maximum(ends - starts - LENGTH + 1, 0)
    piece = np.repeat(np.arange(len(pieces)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + starts[piece]
    anchor = found.anchors()[place]
    edge = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])))) if len(place) else np.zeros(0, np.int64)
    last = np.append(edge[1:], len(place)) - 1 if len(place) else edge
    return found, piece[edge], anchor[edge], place[edge], place[last]


def _keyed(batch: pa.RecordBatch):
    return (((d, s), (t or "").encode()) for d, s, t in zip(*(batch.column(c).to_pylist() for c in ("doc", "sub", "text"))))


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names.split())


def prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """(doc, row, text) of each row, the few rows that need special care, how many bytes and rows.

    Special rows: ``copy``, another doc has the same text and comes first; ``sub``, the place of the
    text among several under one doc; ``same``, how many rows are alike in both.
    """
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("row", text_key())
    rows = stored(
        base.select("doc", "row", F.hash("text").alias("g"), F.octet_length("text").cast("long").alias("n"))
        .groupBy("doc", "row", "g", "n").agg(F.count("*").alias("same")), "rows"
    )
    copied = rows.groupBy("row", "g", "n").agg(F.min("doc").alias("first"), F.count("*").alias("held")).where("held > 1")
    copies = (
        rows.join(copied.hint("rebalance"), ["row", "g", "n"]).where("doc > first").select("doc", "row", F.lit(True).alias("copy"))
    )
    shared = rows.groupBy("doc").agg(F.collect_set("row").alias("all")).where(F.size("all") > 1)
    subs = shared.select("doc", F.posexplode(F.array_sort("all")).alias("sub", "row"))
    special = (
        copies.select("doc", "row", "copy", F.lit(None).cast("int").alias("sub"), F.lit(None).cast("long").alias("same"))
        .union(subs.select("doc", "row", F.lit(None), "sub", F.lit(None)))
        .union(rows.where("same > 1").select("doc", "row", F.lit(None), F.lit(None), "same"))
        .groupBy("doc", "row").agg(F.coalesce(F.max("copy"), F.lit(False)).alias("copy"),
                                   F.coalesce(F.max("sub"), F.lit(0)).alias("sub"),
                                   F.coalesce(F.max("same"), F.lit(1)).alias("same"))
    )
    total, n = rows.agg(F.coalesce(F.sum(F.col("n") * F.col("same")), F.lit(0)), F.coalesce(F.sum("same"), F.lit(0))).first()
    return base, stored(special, "special"), total, n


def first_holders(base: DataFrame, special: DataFrame) -> DataFrame:
    """(doc, sub, text) of the rows that hold a text first."""
    near, others = with_lists(base, special, ["doc", "row"])
    found = near.where("copy IS NULL OR NOT copy")
    once = found.where("same IS NULL OR same = 1")
    alike = found.where("same > 1").dropDuplicates(["doc", "row"])
    columns = ["doc", F.coalesce("sub", F.lit(0)).alias("sub"), "text"]
    return once.select(*columns).union(alike.select(*columns)).union(others.select("doc", F.lit(0), "text"))


def sampled(some: DataFrame, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Of a bounded sample: hashes of seeds found in FREQUENT documents, and those of them that must
    be found over DENSE / 2 times in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, pieces in chunks(_keyed(batch)):
                found, piece, anchor, _, _ = runs(data, pieces)
                seen = np.unique(np.stack([found.seed[anchor], piece.astype(np.uint64)], axis=1), axis=0)[:, 0]
                seed, count = np.unique(seen, return_counts=True)
                yield _batch("seed n", seed.view(np.int64), count)

    got = some.mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    often = got.where(f"n >= {FREQUENT}").toArrow()
    seeds, n = (often.column(c).to_numpy() for c in ("seed", "n"))
    return np.sort(seeds.view(np.uint64)), np.sort(seeds[n / share > DENSE / 2].view(np.uint64))


def wanted(batch: pa.RecordBatch, often: np.ndarray, heavy: np.ndarray):
    """Of each buffer (data, found, pieces, piece, anchor, first, last, own, hot): as :func:`runs`, and
    which runs have a repeated seed, those of seeds found over DENSE times apart."""
    listed = dict(zip(zip(batch.column("doc").to_pylist(), batch.column("sub").to_pylist()), batch.column("places").to_pylist()))
    for data, pieces in chunks(_keyed(batch)):
        found, piece, anchor, first, last = runs(data, pieces)
        if not len(piece):
            continue
        seed = found.seed[anchor]
        own, hot = np.isin(seed, often), np.isin(seed, heavy)
        edges = np.searchsorted(piece, np.arange(len(pieces) + 1))
        for i, p in enumerate(pieces):
            a, b = edges[i], edges[i + 1]
            places = anchor[a:b] + (p[1] - p[2])
            own[a:b] |= np.isin(places, listed[p[0]])
            hot[a:b] |= np.isin(-2 - places, listed[p[0]])
        yield data, found, pieces, piece, anchor, first, last, np.flatnonzero(own & ~hot), hot


def sent_bytes(some: DataFrame, often: np.ndarray, heavy: np.ndarray) -> DataFrame:
    """(lead, n): how many bytes of strings the documents of a sample send for each seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, _, _, _, anchor, first, last, own, _ in wanted(batch, often, heavy):
                leads = [data[a : a + SEED] for a in anchor[own].tolist()]
                yield _batch("lead n", pa.array(leads, pa.binary()), (last - first + LENGTH)[own])

    return some.mapInArrow(run, "lead binary, n long").groupBy("lead").agg(F.sum("n").alias("n"))


def split(sent: DataFrame, share: float) -> tuple[np.ndarray, int]:
    """Sorted splitting seeds, and over how many buckets by hash the seeds of a range are dealt.

    ``sent``: (lead, n) of a sample, which is ``share`` of all. A bucket gets about BUCKET bytes, a
    seed with as many gets a range of its own. Of the lighter leads some come to the driver, by
    their weight; they stand for the others. So it gets some 128 leads for each range.
    """
    total = sent.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(1, min(RANGES, math.ceil(total / share / BUCKET)))
    step = max(1.0, total / ranges / 64)
    chance = F.pmod(F.xxhash64("lead"), F.lit(1 << 20)) / (1 << 20)
    picked = sorted((bytes(r.lead), max(step, r.n)) for r in sent.where(chance * step < F.col("n")).collect())
    cuts, held, goal = [], 0.0, sum(n for _, n in picked) / ranges
    for i, (lead, n) in enumerate(picked):
        if i and held + n > goal:
            cuts.append(lead)
            held = 0.0
        held += n
    return np.unique(np.array(cuts, f"S{SEED}")), max(1, math.ceil(total / share / BUCKET / ranges))


def repeated_anchors(firsts: DataFrame, total: int, often: np.ndarray) -> DataFrame:
    """(doc, sub, places): where the anchors stand whose seed is found more than once.

    The place p of a seed found over DENSE times is given as -2 - p. A document with frequent seeds,
    which need no count, has the place -1 as well.
    """
    parts = max(8, math.ceil(total / 27 / PART))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, pieces in chunks(_keyed(batch)):
                found, piece, anchor, _, _ = runs(data, pieces)
                if not len(piece):
                    continue
                keys = np.array([p[0] for p in pieces], np.int64)
                shift = np.array([p[1] - p[2] for p in pieces])
                seed = found.seed[anchor]
                hot = np.isin(seed, often)
                sure = np.unique(piece[hot])
                columns = [
                    np.concatenate(x)
                    for x in (
                        (seed[~hot], np.zeros(len(sure), np.uint64)),
                        (keys[piece[~hot], 0], keys[sure, 0]),
                        (keys[piece[~hot], 1].astype(np.int32), keys[sure, 1].astype(np.int32)),
                        ((anchor + shift[piece])[~hot].astype(np.int32), np.full(len(sure), -1, np.int32)),
                    )
                ]
                spread = np.where(columns[3] < 0, mix(columns[1].view(np.uint64)), columns[0])
                part = (spread >> np.uint64(32)) % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                columns, part = [c[order] for c in columns], part[order]
                cuts = np.append(np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))), len(part)).tolist()
                yield _batch(
                    "part seed doc sub at", part[cuts[:-1]].astype(np.int64),
                    *[pa.array([c[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for c in columns],
                )

    def again(held) -> pa.RecordBatch:
        seed, doc, sub, at = (np.concatenate(x) for x in held)
        order = np.argsort(seed, kind="stable")
        seed, doc, sub, at = seed[order], doc[order], sub[order], at[order]
        edge = np.flatnonzero(np.concatenate(([True], seed[1:] != seed[:-1])))
        times = np.diff(np.append(edge, len(seed)))
        times = np.repeat(times, times)
        at = np.where((times > DENSE) & (at >= 0), -2 - at, at).astype(np.int32)
        keep = (times > 1) | (at == -1)
        return _batch("doc sub at", doc[keep], sub[keep], at[keep])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = ([], [], [], []), None
        for batch in batches:
            for own, *arrays in zip(*(c.to_pylist() for c in batch.columns)):
                if own != part and part is not None:
                    yield again(held)
                    held = ([], [], [], [])
                part = own
                for got, array, kind in zip(held, arrays, ("u8", "i8", "i4", "i4")):
                    got.append(np.frombuffer(array, kind))
        if part is not None:
            yield again(held)

    sent = firsts.select("doc", "sub", "text").mapInArrow(
        send, "part long, seed binary, doc binary, sub binary, at binary"
    )
    counted = sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(count, "doc long, sub int, at int")
    return counted.groupBy("doc", "sub").agg(F.collect_list("at").alias("places"))


def with_lists(docs: DataFrame, lists: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``docs`` that have a row in ``lists``, left joined with it by one or two keys, and other ``docs``.

    A Bloom filter with BITS_EACH bits for each row of ``lists`` keeps most of the others out of the
    shuffle. Rows that only seem to be in it come back from the join without a list. Where the filter
    would pass MOST_SEGMENTS, all ``docs`` are joined and there are no others.
    """
    n_segments = max(SEGMENTS, math.ceil(lists.count() * BITS_EACH / 65_536))
    if n_segments > MOST_SEGMENTS:
        return docs.join(lists, keys, "left"), docs.where("false")

    def keyed(batches):
        for batch in batches:
            found = _doc_key(*(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            yield _batch("key level", found.view(np.int64), np.ones(len(found), np.int64))

    two = [F.col(k).cast("long").alias(n) for k, n in zip((keys[0], keys[-1]), ("one", "other"))]
    bits = build_filter(lists.select(*two).mapInArrow(keyed, "key long, level long"), n_segments)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def maybe(one: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series(_in_filter(shared.value, _doc_key(one.to_numpy(), other.to_numpy())))

    marked = docs.withColumn("__maybe", maybe(*two))
    near = marked.where("__maybe").drop("__maybe").join(lists, keys, "left")
    return near, marked.where("NOT __maybe").drop("__maybe")


def _in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; every key has the one level 1."""
    found, at, flat = np.ones(len(keys), bool), segments(keys, len(bits)) << 13, bits.reshape(-1)
    for p in places(keys, 1):
        found &= (flat[at + (p >> 3)] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return found


def _doc_key(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return mix(one.astype(np.int64).view(np.uint64) * _A + other.astype(np.int64).view(np.uint64))


ROW = "bucket long, seed long, other long, doc long, sub int, start long, stop long, string binary"
NAMES = "bucket seed other doc sub start stop string"


def send_suffixes(
    near: DataFrame, often: np.ndarray, heavy: np.ndarray, splitters: np.ndarray, parts: int, least: int
) -> DataFrame:
    """Suffixes with their strings for the buckets, of which frequent seeds have at least ``least``; see ROW.

    With ``string``: the bytes from ``start`` to ``stop`` of a document, whose strings have one anchor.
    Without: one string of a frequent seed, its hash in seed and other. With a null seed: a stretch
    from ``start`` to ``stop`` that is settled already.
    """
    buckets = (len(splitters) + 1) * parts
    dealt = max(least, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, found, pieces, piece, anchor, first, last, own, hot in wanted(batch, often, heavy):
                shift = np.array([p[1] - p[2] for p in pieces])
                keys = np.array([p[0] for p in pieces], np.int64)
                seed = found.seed[anchor]
                leads = np.array([data[a : a + SEED] for a in anchor[own].tolist()], f"S{SEED}")
                to = np.searchsorted(splitters, leads, side="right").astype(np.int64) * parts
                to += ((seed[own] >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
                strings = [data[a : b + LENGTH] for a, b in zip(first[own].tolist(), last[own].tolist())]
                doc, sub, by = keys[piece[own], 0], keys[piece[own], 1].astype(np.int32), shift[piece[own]]
                yield _batch(
                    NAMES, to, seed[own].view(np.int64), (anchor - first)[own], doc, sub,
                    first[own] + by, last[own] + by + LENGTH, pa.array(strings, pa.binary()),
                )
                yield from frequent(found, keys, shift, piece[hot], first[hot], last[hot])

    def frequent(found, keys, shift, piece, first, last):
        n = last - first + 1
        which = np.repeat(piece, n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        one, two = found.strings(at), found.strings(at, _B)
        doc, sub, start = keys[which, 0], keys[which, 1].astype(np.int32), at + shift[which]
        order = np.lexsort((start, sub, doc, two, one))
        one, two, doc, sub, start = (x[order] for x in (one, two, doc, sub, start))
        again = np.zeros(len(one), bool)
        again[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
        f, empty = ~again, pa.nulls(int((~again).sum()), pa.binary())
        yield _batch(
            NAMES, buckets + ((one[f] >> np.uint64(32)) % np.uint64(SPREAD * dealt)).astype(np.int64), one[f].view(np.int64),
            two[f].view(np.int64), doc[f], sub[f], start[f], start[f] + LENGTH, empty,
        )
        doc, sub, begin, end = stretches(doc[again], sub[again], start[again])
        yield _batch(
            NAMES, -1 - ((mix(doc.view(np.uint64)) >> np.uint64(32)) % np.uint64(dealt)).astype(np.int64),
            pa.nulls(len(doc), pa.int64()), pa.nulls(len(doc), pa.int64()), doc, sub, begin, end, pa.nulls(len(doc), pa.binary()),
        )

    return near.where("places IS NOT NULL").select("doc", "sub", "text", "places").mapInArrow(run, ROW)


def stretches(doc: np.ndarray, sub: np.ndarray, start: np.ndarray):
    """The bytes covered by strings at ``start``, as few stretches."""
    order = np.lexsort((start, sub, doc))
    doc, sub, start = doc[order], sub[order], start[order]
    apart = np.ones(len(doc), bool)
    apart[1:] = (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]) | (start[1:] > start[:-1] + LENGTH)
    edge = np.flatnonzero(apart)
    last = np.append(edge[1:], len(doc)) - 1 if len(doc) else edge
    return doc[edge], sub[edge], start[edge], start[last] + LENGTH


def equal_strings(data: bytes, at: np.ndarray, length: int) -> np.ndarray:
    """A class number for the ``length`` bytes at each place; equal bytes, equal class.

    Multikey quicksort with eight bytes as a character: what is equal so far is sorted by the next
    character, and what is alone is left.
    """
    words = np.ndarray((len(data),), ">u8", data + bytes(8), strides=(1,))
    group, alive, made = np.zeros(len(at), np.int64), np.arange(len(at)), 1
    for k in range(0, length, 8):
        k = min(k, length - 8)
        key = words[at[alive] + k].astype(np.uint64)
        order = np.lexsort((key, group[alive]))
        alive, key = alive[order], key[order]
        g = group[alive]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (key[1:] != key[:-1]))) if len(alive) else np.zeros(0, bool)
        group[alive] = made + np.cumsum(new)
        made += int(new.sum()) + 1
        alone = new & np.append(new[1:], True)
        alive = alive[~alone]
    return group


def repeated_in_bucket(doc, sub, start, anchor, strings: list[bytes]) -> Iterator[tuple]:
    """Stretches of ``strings`` whose LENGTH bytes occur earlier in the bucket.

    Suffixes with one seed are looked at together, about STRINGS strings at a time.
    """
    order = np.lexsort((start, sub, doc))
    doc, sub, start, anchor = doc[order], sub[order], start[order], anchor[order]
    strings = [strings[i] for i in order.tolist()]
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    seed = equal_strings(b"".join(strings), np.cumsum(sizes) - sizes + anchor, SEED)
    # Of one seed, suffixes stay in the order of their documents.
    order = np.argsort(seed, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], seed[order][1:] != seed[order][:-1])))
    upto = np.append(np.cumsum(sizes[order] - LENGTH + 1)[edge[1:] - 1], (sizes - LENGTH + 1).sum())
    ends, at, done = np.append(edge[1:], len(order)), 0, 0
    while at < len(edge):
        last = max(at, int(np.searchsorted(upto, done + STRINGS, side="right")) - 1)
        own = order[edge[at] : ends[last]]
        at, done = last + 1, upto[last]
        if len(own) > 1:
            yield _later(doc[own], sub[own], start[own], seed[own], [strings[i] for i in own.tolist()])


def _later(doc, sub, start, seed, strings: list[bytes]) -> tuple:
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    data, begin, n = b"".join(strings), np.cumsum(sizes) - sizes, sizes - LENGTH + 1
    which = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[which]
    label = np.zeros(len(at), np.uint64)
    for a in range(0, len(data), CHUNK):
        x, y = np.searchsorted(at, (a, a + CHUNK))
        label[x:y] = Hashes(data[a : a + CHUNK + LENGTH]).strings(at[x:y] - a)
    label = _join(label, seed[which].astype(np.uint64))
    # Of one seed, strings are in the order of their documents, so the first of a class is the earliest.
    by = np.argsort(label, kind="stable")
    edge = np.concatenate(([True], label[by][1:] != label[by][:-1]))
    head, later = by[np.flatnonzero(edge)[np.cumsum(edge) - 1]][~edge], by[~edge]
    words = np.ndarray((len(data),), "<u8", data + bytes(8), strides=(1,))
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        if (words[at[later] + k] != words[at[head] + k]).any():
            # Two strings share a hash: sort all of them whole.
            label = equal_strings(data, at, LENGTH)
            by = np.argsort(label, kind="stable")
            later = by[1:][label[by][1:] == label[by][:-1]]
            break
    return stretches(doc[which[later]], sub[which[later]], (at - begin[which] + start[which])[later])


def settle(sent: DataFrame) -> DataFrame:
    """(doc, sub, start, stop): stretches that occur earlier, from the rows of :func:`send_suffixes`."""

    def bucket(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        col = lambda t, c: t.column(c).to_numpy()
        settled = table.filter(pa.compute.is_null(table.column("seed")))
        yield _batch("doc sub start stop", *[col(settled, c) for c in ("doc", "sub", "start", "stop")])
        rest = table.filter(pa.compute.is_valid(table.column("seed")))
        whole = rest.filter(pa.compute.is_valid(rest.column("string")))
        single = rest.filter(pa.compute.is_null(rest.column("string")))
        if whole.num_rows:
            own = [col(whole, c) for c in ("doc", "sub", "start", "other")]
            for found in repeated_in_bucket(*own, whole.column("string").to_pylist()):
                yield _batch("doc sub start stop", *found)
        if single.num_rows:
            one, two, doc, sub, start = (col(single, c) for c in ("seed", "other", "doc", "sub", "start"))
            order = np.lexsort((start, sub, doc, two, one))
            one, two, doc, sub, start = (x[order] for x in (one, two, doc, sub, start))
            again = np.zeros(len(one), bool)
            again[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
            yield _batch("doc sub start stop", *stretches(doc[again], sub[again], start[again]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], None
        for batch in batches:
            own = batch.column(0).to_numpy()
            cuts = np.append(np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))), len(own)).tolist()
            for a, b in zip(cuts, cuts[1:]):
                if own[a] != number and held:
                    yield from bucket(held)
                    held = []
                number = own[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from bucket(held)

    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        run, "doc long, sub int, start long, stop long"
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (start, stop), kept (the remaining bytes) of each row.

    Each byte covered by a string of LENGTH bytes that starts earlier too is removed: in a row with a
    smaller doc_id, or earlier in the same text. Matches do not cross texts, overlaps count, and
    strings are judged on the input. A null text is empty. A null doc_id is smaller than all others;
    of different texts under one doc_id one has an arbitrary but fixed place before the other; of
    rows alike in id and text all but one are repeats. Texts shorter than LENGTH stay.
    """
    base, special, total, n = prepared(docs)
    share = min(1.0, SAMPLE / max(1, n))
    some = stored(first_holders(base.sample(share, 7), special), "sample")
    often, heavy = sampled(some, share)
    firsts = first_holders(base, special)
    anchors = stored(repeated_anchors(firsts, total, often), "anchors")
    near, _ = with_lists(firsts, anchors, ["doc", "sub"])
    # The sample has some SAMPLE rows, which bounds the broadcast of their ids.
    listed = anchors.join(F.broadcast(some.select("doc", "sub").distinct()), ["doc", "sub"])
    splitters, parts = split(stored(sent_bytes(some.join(listed, ["doc", "sub"]), often, heavy), "sent"), share)
    least = max(4, math.ceil(total / BUCKET))
    found = stored(settle(send_suffixes(near, often, heavy, splitters, parts, least)), "stretches")

    # All that is known of the texts under one doc_id, nearly always one.
    care = special.select("doc", F.struct("row", "copy", "sub", "same").alias("care"), F.lit(None).alias("span"))
    known = care.union(found.select("doc", F.lit(None), F.struct("sub", "start", "stop")))
    known = stored(known.groupBy("doc").agg(F.collect_list("care").alias("care"), F.collect_list("span").alias("spans")), "known")
    cut, whole = with_lists(base, known, ["doc"])
    rows = cut.withColumn("nth", F.lit(1)).unionByName(whole.withColumn("nth", F.lit(1)), allowMissingColumns=True)
    if not special.where("same > 1").isEmpty():
        nth = F.row_number().over(Window.partitionBy("doc", "row").orderBy(F.lit(1)))
        several = F.exists("care", lambda c: (c["row"] == F.col("row")) & (c["same"] > 1))
        marked = cut.withColumn("several", F.coalesce(several, F.lit(False)))
        alike = marked.where("several").drop("several").withColumn("nth", nth)
        rows = rows.join(special.where("same > 1").select("doc", "row"), ["doc", "row"], "left_anti").unionByName(alike)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                own, out = batch.slice(at, 512), []
                for text, row, nth, care, spans in zip(*(own.column(c).to_pylist() for c in columns)):
                    data, merged = text.encode(), []
                    mine = next((c for c in care or () if c["row"] == row), {"sub": 0, "copy": False})
                    spans = sorted((s["start"], s["stop"]) for s in spans or () if s["sub"] == mine["sub"])
                    if mine["copy"] or nth > 1:
                        spans = [(0, len(data))] if len(data) >= LENGTH else []
                    for start, stop in spans:
                        if merged and start <= merged[-1]["stop"]:
                            merged[-1]["stop"] = max(merged[-1]["stop"], stop)
                        else:
                            merged.append({"start": start, "stop": stop})
                    edges = [0, *(x for s in merged for x in (s["start"], s["stop"])), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    out.append((len(data), len(data) - len(kept), len(merged), merged, kept))
                n_bytes, n_removed, n_spans, all_spans, kept = zip(*out)
                yield _batch(
                    "doc n_bytes n_removed n_spans spans kept", own.column("doc"), n_bytes, n_removed, n_spans,
                    pa.array(all_spans, kind), pa.array(kept, pa.binary()),
                )

    columns = ["text", "row", "nth", "care", "spans"]
    done = rows.select("doc", *columns).mapInArrow(
        run, "doc long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:bigint,stop:bigint>>, kept binary"
    )
    return done.select(F.when(F.col("doc") != NONE, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "spans", "kept")


def op4_suffix_dedup(spark, sf_dir) -> DataFrame:
    found = remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
