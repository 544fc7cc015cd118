"""A bigram language model whose counts are held in a log-frequency Bloom filter.

Counting: each task turns its texts into packed arrays of (history, word, count), one for each
part of the hash space, and a part is added up by one task. Histories that are very frequent in a
bounded sample are dealt by (history, word), so that no part gathers one of them whole.

Filter: a count of c is held as its level, 1 + floor(log_b(c / cut)), by inserting the key once for
each level up to its own. A reader probes level after level until one is missing. The cut-off is 2 at
every size: bigrams found once are left to the share of their words. The number of segments follows the
entries. The filter stays in the shared folder; its segments and the probes meet in a shuffle, where a
block of texts asks for each of its keys once. One of bounded size may be broadcast instead.

Probability of word w after history h, with the kept counts q (rounded down to their level):

    P(w | h) = (q(h, w) + K(h) * P(w)) / S(h),   S(h) = c(h) + T(h),   K(h) = S(h) - sum of q(h, .)

T(h): words kept after h; P(w): the smoothed share of w. Whatever is cut off or rounded away goes to
K, so the probabilities after a frequent h add up to one. Only false positives of the filter, a
fraction of a percent of the probes, add to that. For rare histories S and K come from the filter
too, S rounded up and K rounded down to a level, so that theirs add up to one or less, never more.
"""

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudinv.llm.common import held_out, read, stored

FOLDS, HELD = 7, 2
BASE = math.sqrt(2.0)
#: Bigrams found less often are not kept.
CUT = 2.0
#: Segments of 65,536 bits: the least that are made, and how many of them a task holds at a time.
SEGMENTS, TOGETHER = 4096, 512
BITS_EACH = 16
PROBES = 4
#: Most words whose exact counts and history weights are broadcast.
FREQUENT = 1 << 18
#: Tokens of one packed array, and of one part of the counting.
BLOCK, PART = 1 << 19, 1_000_000
#: Bytes of a token, about.
TOKEN = 6
#: A word is dealt apart if it makes over this share of a sample of documents.
HOT_SHARE, HOT_SAMPLE = 1 / 1000, 2000
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))

_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A bigram's 48-bit key; ``w``: the upper half of the word's hash.

    A key that is not there is taken for one that is by one in 2**48 for each entry, far below what
    the filter itself gets wrong, and sorted keys take four bytes each when they travel.
    """
    return mix(h + w * _C1) >> _KEY


def history_key(h: np.ndarray, kind: np.uint64) -> np.ndarray:
    return mix(h ^ kind) >> _KEY


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, the low bytes of all first, so that zeros lie together and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplaned(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).tobytes(), kind)


def steps(x: np.ndarray) -> bytes:
    """Sorted numbers as the planes of their differences."""
    return planes(np.diff(x, prepend=np.uint64(0)))


def unstepped(data: bytes) -> np.ndarray:
    return np.cumsum(unplaned(data, "<u8"), dtype=np.uint64)


_KEY = np.uint64(16)
S_KEY, K_KEY = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


#: A number for each byte, the same for A-Z and a-z, and the odd base of the words' polynomials.
_BYTES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _C1)
_BYTES[65:91] = _BYTES[97:123]
_POINT = int(_C2)
#: Bytes that are hashed at once, few enough for a processor's cache.
_AT_ONCE = (1 << 17) - 1


class _Powers:
    """Powers of the base, up and down, for as many bytes as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            make = lambda base: np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)])
            self.up, self.down = make(_POINT), make(pow(_POINT, -1, 1 << 64))


_POWERS = _Powers()


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words that begin and end at places in ``data``, A-Z as a-z.

    A word's polynomial is a difference of running sums, divided by the power of where it begins.
    """
    out = np.empty(len(begins), np.uint64)
    at = 0
    while at < len(begins):
        first = begins[at]
        to = max(at + 1, int(np.searchsorted(ends, first + _AT_ONCE, "right")))
        n = int(ends[to - 1] - first)
        _POWERS.grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data[first : first + n]] * _POWERS.up[:n], out=sums[1:])
        start = begins[at:to] - first
        out[at:to] = (sums[ends[at:to] - first] - sums[start]) * _POWERS.down[start]
        at = to
    return mix(out)


def token_blocks(column) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, histories, words, index of the text of each token), about BLOCK tokens at a time.

    ``column``: an Arrow array of texts. Words are ``[^\\x20\\x09-\\x0D]+``. The end stands before the first
    word too, so it is the history of each text's first token.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts = column.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK * TOKEN, "right")) - 1)
        places = offsets[at : to + 1] - offsets[at]
        data = whole[offsets[at] : offsets[to]]
        word = np.concatenate(([False], ~((data == 32) | ((data >= 9) & (data <= 13))), [False]))
        starts = np.zeros(len(data) + 2, bool)
        starts[places + 1] = True
        begins = np.flatnonzero(word[1:-1] & (~word[:-2] | starts[1:-1]))
        ends = np.flatnonzero(word[1:-1] & (~word[2:] | starts[2:])) + 1
        many = np.diff(np.searchsorted(begins, places))
        doc = np.repeat(np.arange(to - at), many)
        w = np.full(len(begins) + to - at, END)
        w[np.arange(len(begins)) + doc] = word_hashes(data, begins, ends)
        h = np.concatenate((END[None], w[:-1]))
        yield slice(at, to), h, w, np.repeat(np.arange(to - at), many + 1)
        at = to


def _unique(x: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _unique_places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, each once, and where each number stands among them."""
    order = np.argsort(x)
    ranked = x[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(x) else np.zeros(0, bool)
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(new) - 1
    return ranked[new], at


def _summed(h: np.ndarray, w: np.ndarray, n: np.ndarray | None):
    """Equal (h, w) once, sorted by h, with the sum of n."""
    key = mix(h + w * _C1)
    order = np.argsort(key)
    first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1]))) if len(key) else order
    counted = np.add.reduceat(n[order], first) if n is not None else np.diff(np.append(first, len(key)))
    at = order[first]
    return h[at], w[at], counted.astype(np.int64)


def sampled(train: DataFrame) -> tuple[list[int], int]:
    """Hashes of very frequent words, and about how many tokens there are, from a bounded sample.

    Both only decide how the counting is dealt out, not what is counted.
    """
    documents = train.count()
    share = min(1.0, HOT_SAMPLE / max(1, documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, w, _ in token_blocks(batch.column(0)):
                word, n = np.unique(w, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["w", "n"])

    found = train.select("text").sample(share, 0).mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    found = stored(found, "sample")
    tokens = found.agg(F.sum("n")).first()[0] or 0
    often = found.where(F.col("n") > tokens * HOT_SHARE).collect()
    return [r["w"] & 0xFFFFFFFFFFFFFFFF for r in often], math.ceil(tokens / share) + documents


def count_grams(train: DataFrame, parts: int, hot: list[int]) -> DataFrame:
    """(h, w, n): bigrams found twice or more, and with a null w each history's own count.

    ``hot`` histories have a row for each part that holds some of it.
    """
    hot_words = np.array(sorted(hot), np.uint64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, h, w, _ in token_blocks(batch.column(0)):
                h, w, n = _summed(h, w >> np.uint64(32), None)
                spread = mix(h)
                if len(hot_words):
                    spread = np.where(np.isin(h, hot_words), mix(h + w * _C1), spread)
                part = (spread >> np.uint64(32)) % np.uint64(parts)
                order = np.lexsort((h, part))
                h, w, n, part = h[order], w[order].astype(np.uint32), n[order].astype(np.uint32), part[order]
                edges = _runs(part)
                packed = [_bundle(h[a:b], w[a:b], n[a:b]) for a, b in edges]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(part[a]) for a, _ in edges], pa.int64()),
                        *[pa.array(x, pa.binary()) for x in (zip(*packed) if packed else [[]] * 4)],
                    ],
                    ["part", "h", "many", "w", "n"],
                )

    def merged(held) -> Iterator[pa.RecordBatch]:
        h, w, n = (np.concatenate(x) for x in held)
        h, w, n = _summed(h, w.astype(np.uint64), n.astype(np.int64))
        order = np.argsort(h, kind="stable")
        h, w, n = h[order], w[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        yield _rows(h[first], None, np.add.reduceat(n, first))
        again = n > 1
        yield _rows(h[again], w[again], n[again])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = ([], [], []), None
        for batch in batches:
            for own, h, many, w, n in zip(*(c.to_pylist() for c in batch.columns)):
                if own != part and part is not None:
                    yield from merged(held)
                    held = ([], [], [])
                part = own
                h = np.repeat(unstepped(h), unplaned(many, "<u4"))
                for got, array in zip(held, (h, np.frombuffer(w, "<u4"), unplaned(n, "<u4"))):
                    got.append(array)
        if part is not None:
            yield from merged(held)

    packed = train.select("text").mapInArrow(pack, "part long, h binary, many binary, w binary, n binary")
    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(add, "h long, w long, n long")


def _bundle(h: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Bigrams in order of history: each history once, how many words it has, the words, the counts."""
    edges = _runs(h)
    first = np.array([a for a, _ in edges], np.int64)
    return steps(h[first]), planes(np.diff(np.append(first, len(h))).astype("<u4")), w.tobytes(), planes(n)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of each run of equal values."""
    cuts = [*np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))).tolist(), len(x)] if len(x) else []
    return list(zip(cuts, cuts[1:]))


def _rows(h, w, n) -> pa.RecordBatch:
    second = pa.nulls(len(h), pa.int64()) if w is None else pa.array(w.view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), second, pa.array(n)], ["h", "w", "n"])


def level(n, cut: float = 1.0, up: bool = False):
    """Column: the level of a count, 0 below ``cut``; ``up`` rounds up."""
    exact = F.log(n / F.lit(cut)) / F.lit(math.log(BASE))
    steps = F.ceil(exact - 1e-9) if up else F.floor(exact + 1e-9)
    return F.when(n >= cut, 1 + steps).otherwise(0).cast("long")


def segments(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(8)) % np.uint64(n)).astype(np.int64)


def places(keys: np.ndarray, lv) -> list[np.ndarray]:
    """The bits of each key's entry for a level, within its segment."""
    x = mix(keys + np.asarray(lv, np.uint64) * _C1)
    return [((x >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64) for i in range(PROBES)]


def levels(bits: np.ndarray, keys: np.ndarray, segment: np.ndarray | None = None) -> np.ndarray:
    """The highest level up to which all entries of each key are in the filter.

    ``segment``: the row of ``bits`` for each key, if ``bits`` is not the whole filter.
    """
    found, alive, lv = np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
    at = (segments(keys, len(bits)) if segment is None else segment) << 13
    flat = bits.reshape(-1)
    while len(alive):
        lv += 1
        ok = np.ones(len(alive), bool)
        for p in places(keys[alive], lv):
            ok &= (flat[at[alive] + (p >> 3)] >> (p & 7).astype(np.uint8) & 1).astype(bool)
        alive = alive[ok]
        found[alive] = lv
    return found


def filter_segments(entries: DataFrame, n_segments: int) -> DataFrame:
    """(segment, bits) from rows of key, level. Each segment is made by one task; empty ones have no row."""

    def route(batches):
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(segments(key, n_segments)), batch.column(0), batch.column(1)], ["segment", "key", "level"]
            )

    def fill(batches):
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            segment, key, top = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            key = key.view(np.uint64)
            lv = 1
            while len(key):
                order = np.argsort(segment, kind="stable")
                segment, key, top = segment[order], key[order], top[order]
                first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
                spots = places(key, lv)
                for a, b in zip(first, [*first[1:], len(key)]):
                    bits = made.setdefault(int(segment[a]), np.zeros(65_536, bool))
                    for p in spots:
                        bits[p[a:b]] = True
                lv += 1
                more = top >= lv
                segment, key, top = segment[more], key[more], top[more]
        for s, bits in made.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([s]), pa.array([np.packbits(bits, bitorder="little").tobytes()])], ["segment", "bits"]
            )

    routed = entries.select("key", "level").mapInArrow(route, "segment long, key long, level long")
    tasks = max(8, math.ceil(n_segments / TOGETHER))
    return routed.repartition(tasks, "segment").mapInArrow(fill, "segment long, bits binary")


def build_filter(entries: DataFrame, n_segments: int = SEGMENTS) -> np.ndarray:
    """(n_segments, 8192) bytes from rows of key, level."""
    rows = filter_segments(entries, n_segments).toArrow()
    out = np.zeros((n_segments, 8192), np.uint8)
    for s, b in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
        out[s] = np.frombuffer(b, np.uint8)
    return out


@dataclass
class Model:
    """What is broadcast: the filter and at most FREQUENT words, both bounded by parameters.

    A filter beyond that bound is in ``dealt`` as rows (segment, bits), and is not broadcast.
    """

    tokens: int
    types: int
    cut: float
    n_segments: int
    bits: np.ndarray | None
    words: np.ndarray  # sorted hashes of frequent words, with
    counts: np.ndarray
    weight_s: np.ndarray
    weight_k: np.ndarray
    dealt: DataFrame | None = None

    def log_share(self, count):
        """Of a word counted so often; the types count one more for the unknown."""
        return np.log10((count + 1.0) / (self.tokens + self.types + 1.0))

    def _frequent(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(self.words, words)
        place[place == len(self.words)] = 0
        return place, self.words[place] == words if len(self.words) else np.zeros(len(words), bool)

    def asked(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """All keys whose levels :meth:`score_block` may read, once each."""
        rare = _unique(h)
        rare = rare[~self._frequent(rare)[1]]
        pairs = pair_key(h, w >> np.uint64(32))
        return _unique(np.concatenate((history_key(rare, S_KEY), history_key(rare, K_KEY), pairs)))

    def score_block(self, h: np.ndarray, w: np.ndarray, read: Callable[[np.ndarray], np.ndarray] | None = None):
        """For each token: its count or -1 if not among the frequent words, the log10 of its
        probability, and whether the log10 of its share has still to be added to that.

        ``read`` gives the levels of keys; by default they are read from ``bits``.
        """
        read = read or (lambda keys: levels(self.bits, keys))
        both, at = _unique_places(np.concatenate((w, h)))
        place, frequent = self._frequent(both)
        count, s, k = np.full(len(both), -1, np.int64), np.zeros(len(both)), np.zeros(len(both))
        count[frequent], s[frequent], k[frequent] = (
            x[place[frequent]] for x in (self.counts, self.weight_s, self.weight_k)
        )
        history = np.zeros(len(both), bool)
        history[at[len(w) :]] = True
        rest = np.flatnonzero(~frequent & history)
        up = read(history_key(both[rest], S_KEY))
        rest, up = rest[up > 0], up[up > 0]
        down = read(history_key(both[rest], K_KEY))
        s[rest] = BASE ** (up - 1.0)
        k[rest] = np.where(down > 0, BASE ** np.maximum(down - 1.0, 0), 0)
        k = np.minimum(k, s)
        w_at, h_at = at[: len(w)], at[len(w) :]
        count, s, k = count[w_at], s[h_at], k[h_at]
        known = s > 0
        lv = np.zeros(len(w), np.int64)
        lv[known] = read(pair_key(h[known], w[known] >> np.uint64(32)))
        held = np.floor(self.cut * BASE ** (np.arange(256) - 1.0) + 1e-9)
        held[0] = 0
        q = held[lv]
        q = np.minimum(q, s)
        # A kept bigram's word occurs at least as often as the bigram.
        share = 10 ** self.log_share(np.where(count >= 0, count, q))
        with np.errstate(divide="ignore"):
            direct = np.log10(np.maximum((q + np.maximum(k, 0) * share) / np.where(known, s, 1), 1e-300))
            backed = np.where(known, np.log10(np.maximum(k, 0.5) / np.where(known, s, 1)), 0.0)
        seen = q > 0
        return count, np.where(seen, direct, backed), ~seen


def train_model(
    train: DataFrame, n_segments: int = SEGMENTS, frequent: int = FREQUENT, broadcast_to: int = 0
) -> tuple[Model, DataFrame]:
    """The model of ``train.text`` and the exact (w, c) of every token; see the module's text.

    ``n_segments``: the least number of segments. A filter of up to ``broadcast_to`` segments is
    broadcast; by default none is, so that a corpus is scored in the same way at every size.
    """
    hot, about = sampled(train)
    grams = stored(count_grams(train, max(8, math.ceil(about / PART)), hot), "grams")
    counts = grams.where("w IS NULL").groupBy("h").agg(F.sum("n").alias("c"))
    counts = stored(counts, "counts")
    tokens, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    pairs = grams.where("w IS NOT NULL")

    kept = pairs.where(F.col("n") >= CUT).withColumn("level", level(F.col("n"), CUT))
    q = F.floor(F.lit(CUT) * F.pow(F.lit(BASE), F.col("level") - 1) + 1e-9)
    # A frequent history has rows in several parts; each of its words is in one of them.
    sums = kept.groupBy("h").agg(F.sum(q).alias("q"), F.count("*").alias("t"), F.sum("level").alias("entries"))
    histories = stored(
        sums.join(counts, "h").select(
            "h", "c", "entries", (F.col("c") + F.col("t")).cast("double").alias("s"),
            (F.col("c") + F.col("t") - F.col("q")).cast("double").alias("k"),
        )
        .withColumn("s_level", level(F.col("s"), up=True)).withColumn("k_level", level(F.col("k"))),
        "histories",
    )
    need = histories.agg(F.sum(F.col("entries") + F.col("s_level") + F.col("k_level"))).first()[0] or 0
    n_segments = max(n_segments, math.ceil(need * BITS_EACH / 65_536))

    bucket = F.floor(F.log2("c") * 16).cast("int")
    least, total = 1 << 30, 0
    for b, n in sorted(counts.groupBy(bucket.alias("b")).count().collect(), reverse=True):
        if total + n > frequent:
            break
        least, total = b, total + n
    top = counts.where(bucket >= least).join(histories.select("h", "s", "k"), "h", "left").toArrow()
    order = np.argsort(top.column("h").to_numpy().view(np.uint64))
    word, c, s, k = (
        np.nan_to_num(top.column(x).to_numpy())[order] if x != "h" else top.column(x).to_numpy().view(np.uint64)[order]
        for x in ("h", "c", "s", "k")
    )

    def keyed(batches):
        for batch in batches:
            h, w, lv, kind = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            h, w = h.view(np.uint64), w.view(np.uint64)
            key = np.select([kind == 0, kind == 1], [pair_key(h, w), history_key(h, S_KEY)], history_key(h, K_KEY))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(2)], ["key", "level"])

    none, rare = F.lit(0).cast("long"), histories.join(counts.where(bucket < least).select("h"), "h", "left_semi")
    entries = (
        kept.select("h", "w", "level", none.alias("kind"))
        .union(rare.select("h", none, "s_level", none + 1))
        .union(rare.select("h", none, "k_level", none + 2))
        .where("level > 0")
    )
    entries = entries.mapInArrow(keyed, "key long, level long")
    bits = dealt = None
    if n_segments > broadcast_to:
        dealt = stored(filter_segments(entries, n_segments), "segments")
    else:
        bits = build_filter(entries, n_segments)
    return Model(tokens, types, CUT, n_segments, bits, word, c.astype(np.int64), s, k, dealt), counts


def _in_parts(keys: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """Sorted keys in order of the part of the filter they are in, the runs of one part, and the parts."""
    part = segments(keys, n) // TOGETHER
    # Small numbers sort by their bytes.
    order = np.argsort(part.astype(np.uint16) if n // TOGETHER < 1 << 16 else part, kind="stable")
    return keys[order], _runs(part[order]), part[order]


def answers(blocks: DataFrame, broadcast, dealt: DataFrame) -> DataFrame:
    """(block, part, levels): the levels of all keys that a block asks for, in the order of ``_in_parts``.

    A block asks once for each of its keys, and answers are one byte each: the block makes its keys
    again and knows which is which.
    """
    n = broadcast.value.n_segments

    def ask(rows: pa.Table) -> pa.Table:
        keys, edges, part = _in_parts(_asked(broadcast.value, token_blocks(rows.column("text"))), n)
        return pa.table(
            [
                pa.array([int(part[a]) for a, _ in edges], pa.int64()), pa.nulls(len(edges), pa.int64()),
                pa.array([rows.column("block")[0].as_py()] * len(edges), pa.int64()),
                pa.array([steps(keys[a:b]) for a, b in edges], pa.binary()),
            ],
            ["part", "segment", "block", "data"],
        )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, number = np.zeros((TOGETHER, 8192), np.uint8), None
        for batch in batches:
            for part, segment, block, data in zip(*(batch.column(c) for c in ("part", "segment", "block", "data"))):
                if part.as_py() != number:
                    bits[:], number = 0, part.as_py()
                if segment.is_valid:
                    bits[segment.as_py() % TOGETHER] = np.frombuffer(data.as_buffer(), np.uint8)
                    continue
                keys = unstepped(data.as_py())
                lv = levels(bits, keys, segments(keys, n) % TOGETHER).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.as_py()]), pa.array([number]), pa.array([lv.tobytes()], pa.binary())],
                    ["block", "part", "levels"],
                )

    none = F.lit(None).cast("long")
    made = dealt.select(F.floor(F.col("segment") / TOGETHER).alias("part"), "segment", none.alias("block"), F.col("bits").alias("data"))
    asks = blocks.groupBy("block").applyInArrow(ask, "part long, segment long, block long, data binary")
    met = made.union(asks).repartition(math.ceil(n / TOGETHER), "part").sortWithinPartitions("part", F.col("segment").isNull())
    return met.mapInArrow(answer, "block long, part long, levels binary")


def _asked(model: Model, blocks: Iterable[tuple]) -> np.ndarray:
    """All keys that tokens ask for, sorted; the order of the texts makes no difference."""
    found = [model.asked(h, w) for _, h, w, _ in blocks]
    return (_unique(np.concatenate(found)) if len(found) > 1 else found[0]) if found else np.zeros(0, np.uint64)


def score_documents(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score for every row of ``docs``.

    A null or empty text is its end alone. Rows are scored one by one, repeated ones too; a null
    doc_id stays null. ``docs`` is read from files or a written table, where a task that runs again finds
    the rows as they were. The exact shares of words that are not broadcast come from a join with
    ``counts``; such words are rare by construction, so none of them makes a hot key.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(replace(model, dealt=None))
    names = ["t", "uid", "tf", "tf0", "doc_id", "n", "known", "base", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from score(batch, token_blocks(batch.column("text")), None)

    def run_block(rows: pa.Table, told: pa.Table) -> pa.Table:
        """The texts of a block, whose keys stand in the order in which they were asked."""
        model, rows = broadcast.value, rows.combine_chunks()
        blocks = list(token_blocks(rows.column("text")))
        keys, edges, part = _in_parts(_asked(model, blocks), model.n_segments)
        given = dict(zip(told.column("part").to_pylist(), told.column("levels").to_pylist()))
        lv = np.concatenate([np.frombuffer(given[int(part[a])], np.uint8) for a, _ in edges])
        order = np.argsort(keys)
        keys, lv = keys[order], lv[order].astype(np.int64)
        (batch,) = rows.to_batches()

        def read(asked: np.ndarray) -> np.ndarray:
            own, at = _unique_places(asked)
            return lv[np.searchsorted(keys, own)][at]

        return pa.Table.from_batches(list(score(batch, blocks, read)))

    def score(batch: pa.RecordBatch, blocks: Iterable[tuple], read) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        uid, ids = batch.column("uid").to_numpy(), batch.column("doc_id")
        for own, h, w, doc in blocks:
            count, logs, backed = model.score_block(h, w, read)
            size, exact = own.stop - own.start, count >= 0
            share = np.where(exact, model.log_share(np.maximum(count, 0)), 0)
            sums = [np.bincount(doc, x, size) for x in (np.ones(len(w)), exact, share, logs + share * backed)]
            zero = pa.array(np.zeros(size, np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(mix(uid[own].astype(np.uint64)).view(np.int64)), pa.array(uid[own]), zero, zero,
                    ids[own.start : own.stop], *[pa.array(x.astype(np.int64)) for x in sums[:2]],
                    *[pa.array(x) for x in sums[2:]],
                ],
                names,
            )
            far = np.flatnonzero(~exact)
            for a in range(0, len(far), 1 << 16):
                f = far[a : a + (1 << 16)]
                nothing = [pa.nulls(len(f), t) for t in (pa.int64(),) * 3 + (pa.float64(),) * 2]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(w[f].view(np.int64)), pa.array(uid[own][doc[f]]),
                        pa.array(np.ones(len(f), np.int32)), pa.array(backed[f].astype(np.int32)), *nothing,
                    ],
                    names,
                )

    kinds = "t long, uid long, tf int, tf0 int, doc_id long, n long, known long, base double, score double"
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("uid"))
    if model.dealt is None:
        found = rows.mapInArrow(run, kinds)
    else:
        # The texts are shuffled by block once: asking and scoring read the same exchange.
        n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        block = F.pmod(F.xxhash64("uid"), F.lit(math.ceil(n_bytes / TOKEN / BLOCK) or 1))
        blocks = rows.select("uid", "doc_id", "text", block.alias("block"))
        told = answers(blocks, broadcast, model.dealt)
        found = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run_block, kinds)
    joined = found.join(counts.withColumnRenamed("h", "t"), "t", "left")
    share = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(model.tokens + model.types + 1)))
    return (
        joined.groupBy("uid")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.sum("n").alias("n_tokens"),
            (F.sum("known") + F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0))).alias("n_known"),
            (F.sum("base") + F.sum(F.col("tf") * share)).alias("base_score"),
            (F.sum("score") + F.sum(F.col("tf0") * share)).alias("score"),
        )
        .drop("uid")
    )


def op6_lm_score(spark, sf_dir) -> DataFrame:
    """Scores of all ``documents``, learned from those outside the held-out fold; see :func:`score_documents`.

    Null and empty texts are their end alone; null ids are never held out.
    """
    docs = read(spark, sf_dir, "documents")
    held = held_out("doc_id", FOLDS, HELD)
    model, counts = train_model(docs.where(~held))
    return score_documents(docs, model, counts).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
