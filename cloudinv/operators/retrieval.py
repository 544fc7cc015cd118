"""Schema documents: retrieval by vector, rendering, checks."""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cloudinv.functions.text import strip
from cloudinv.sources.tables import staged

DEFAULT_K = 5
MAX_K = 25
# Vectors and queries that meet in one task at a time, about.
VECTOR_BLOCK = 8192
QUERY_PAGE = 4096
# At most so many pivots, taken from so many vectors; a pivot has a block of vectors at least, on average.
MOST_PIVOTS, SAMPLE = 256, 4096
# Distances are rounded to ten decimals; bounds are loosened by more.
_SLACK = 1e-8
# Queries multiplied with a batch of vectors at a time, which bounds the product.
_QUERIES_AT_ONCE = 256

# Texts that rendered documents and contexts contain.
SEPARATOR = "\n\n---\n\n"
NO_DESCRIPTION = "_(no description)_"
NO_DOCUMENT = "_(no enriched doc bundled)_"


def _first_per_query(query: np.ndarray, k: int) -> np.ndarray:
    """True for the first k entries of every run of equal, sorted query numbers."""
    starts = np.flatnonzero(np.diff(query, prepend=-1))
    runs = np.diff(np.append(starts, len(query)))
    return np.arange(len(query)) - np.repeat(starts, runs) < k


def _packed(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows as Arrow tables by ``keys``: the keys, and the other columns as ``name``.

    A key may come in several pieces, which does no harm.
    """
    others = [c for c in rows.columns if c not in keys]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.column_stack([batch.column(k).to_numpy() for k in keys])
            for key in np.unique(numbers, axis=0):
                own = batch.filter(pa.array((numbers == key).all(axis=1))).select(others)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema) as stream:
                    stream.write_batch(own)
                columns = [pa.array([int(k)]) for k in key] + [pa.array([sink.getvalue().to_pybytes()])]
                yield pa.RecordBatch.from_arrays(columns, [*keys, name])

    # Sorted after the shuffle, so that a piece is as good as a whole batch.
    dealt = rows.select(*keys, *others).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(pack, ", ".join([*(f"{k} long" for k in keys), f"{name} binary"]))


def _frame(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(packed).read_all().to_pandas()


def _nearest(vectors: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame | None:
    """The k nearest of some vectors for each of some queries, by place in ``queries``."""
    # In key order, so that of equal distances the smaller key comes first.
    frame = vectors.sort_values("key", ignore_index=True)
    found = []
    widths = frame["embedding"].map(len).to_numpy()
    asked = queries["embedding"].map(len).to_numpy()
    for width in np.intersect1d(widths, asked):
        own, mine = np.flatnonzero(widths == width), np.flatnonzero(asked == width)
        block, matrix = (
            np.array(side["embedding"].iloc[rows].tolist(), dtype=np.float64)
            for side, rows in ((frame, own), (queries, mine))
        )
        lengths, directions = np.linalg.norm(block, axis=1), np.linalg.norm(matrix, axis=1)
        own, block = own[lengths > 0], block[lengths > 0] / lengths[lengths > 0, None]
        mine, matrix = mine[directions > 0], matrix[directions > 0] / directions[directions > 0, None]
        for at in range(0, len(mine), _QUERIES_AT_ONCE):
            # Ten decimals: equal vectors tie however the product was blocked.
            distance = np.round(1.0 - block @ matrix[at : at + _QUERIES_AT_ONCE].T, 10)
            if len(distance) > k:
                limit = np.partition(distance, k - 1, axis=0)[k - 1]
                row, query = np.nonzero(distance <= limit)
            else:
                row, query = np.nonzero(np.isfinite(distance))
            order = np.lexsort((row, distance[row, query], query))
            row, query = row[order], query[order]
            chosen = _first_per_query(query, k)
            row, query = row[chosen], query[chosen]
            best = frame.drop(columns="embedding").iloc[own[row]]
            found.append(best.assign(distance=distance[row, query], _query=mine[query + at]))
    return pd.concat(found) if found else None


def _unit(vectors: list) -> np.ndarray:
    """Vectors of one width as rows of length one; those of length zero stay."""
    block = np.array(vectors, dtype=np.float64)
    lengths = np.linalg.norm(block, axis=1, keepdims=True)
    return np.divide(block, lengths, out=np.zeros_like(block), where=lengths > 0)


class Pivots:
    """Fixed directions, by width; vectors belong to the nearest one.

    For a pivot p whose vectors lie within a radius r of it, no vector of it is nearer to a query q
    than |q - p| - r. Distances are chords of the unit sphere; a cosine distance c is a chord of sqrt(2 c).
    """

    def __init__(self, sample: list, count: int):
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.count = 0
        for width in sorted({len(v) for v in sample}):
            points = _unit([v for v in sample if len(v) == width])
            share = max(1, count * len(points) // len(sample))
            picked, near = [0], np.linalg.norm(points - points[0], axis=1)
            while len(picked) < share and near.max() > 0:
                picked.append(int(near.argmax()))
                near = np.minimum(near, np.linalg.norm(points - points[picked[-1]], axis=1))
            self.by_width[width] = np.arange(self.count, self.count + len(picked)), points[picked]
            self.count += len(picked)
        # Widths that the sample lacks share one more, of which nothing is known.
        self.radius, self.size = np.full(self.count + 1, np.inf), np.zeros(self.count + 1, np.int64)

    def _chords(self, vectors: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
        """(places in ``vectors``, pivots, chords) width by width."""
        widths = vectors.map(len).to_numpy()
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            if width not in self.by_width:
                yield rows, None, None
                continue
            numbers, points = self.by_width[width]
            block = _unit(vectors.iloc[rows].tolist())
            square = (block**2).sum(1)[:, None] + 1 - 2 * block @ points.T
            yield rows, numbers, np.sqrt(np.maximum(square, 0))

    def place(self, vectors: pd.Series) -> pd.DataFrame:
        """The nearest pivot of each vector and the chord to it."""
        pivot, gap = np.full(len(vectors), self.count), np.full(len(vectors), np.inf)
        for rows, numbers, chords in self._chords(vectors):
            if numbers is not None:
                best = chords.argmin(axis=1)
                pivot[rows], gap[rows] = numbers[best], chords[np.arange(len(rows)), best]
        return pd.DataFrame({"pivot": pivot, "gap": gap})

    def nearest(self, queries: pd.Series, k: int) -> pd.Series:
        """For each query its nearest pivots, as many as hold ``k`` vectors together."""
        out = [np.array([self.count])] * len(queries)
        for rows, numbers, chords in self._chords(queries):
            if numbers is not None:
                order = np.argsort(chords, axis=1, kind="stable")
                enough = np.cumsum(self.size[numbers][order], axis=1) >= k
                for row, ranked, held in zip(rows, order, enough):
                    out[row] = numbers[ranked[: 1 + (int(held.argmax()) if held.any() else len(ranked) - 1)]]
        return pd.Series([[p for p in o if self.size[p]] for o in out], index=queries.index, dtype=object)

    def reachable(self, queries: pd.Series, worst: pd.Series, k: int) -> pd.Series:
        """The other pivots that may hold a vector as near as ``worst``, a cosine distance or NaN for none."""
        out = [np.array([self.count])] * len(queries)
        limits = np.sqrt(2 * np.maximum(worst.to_numpy(dtype=np.float64), 0) + _SLACK)
        for rows, numbers, chords in self._chords(queries):
            if numbers is not None:
                least = chords - self.radius[numbers][None, :] - _SLACK
                near = ~(least > limits[rows, None])
                for row, own in zip(rows, near):
                    out[row] = numbers[own]
        met = self.nearest(queries, k)
        return pd.Series(
            [[p for p in o if self.size[p] and p not in set(m)] for o, m in zip(out, met)], index=queries.index, dtype=object
        )


def _pieces(sizes: dict[int, int], size: int, pivot: str) -> Column:
    """How many pieces of about ``size`` rows each pivot has; one entry for each pivot."""
    entries = [x for p, n in sizes.items() for x in (F.lit(p).cast("long"), F.lit(max(1, math.ceil(n / size))).cast("long"))]
    return F.element_at(F.create_map(*entries), F.col(pivot)) if entries else F.lit(1).cast("long")


def _each(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def _sizes(rows: DataFrame) -> dict[int, int]:
    return {r["pivot"]: r["count"] for r in rows.groupBy("pivot").count().collect()}


def _met(vectors: DataFrame, held: dict, asked: DataFrame, sizes: dict, page_size: int, k: int, out: T.StructType) -> DataFrame:
    """The k nearest to each query among the vectors of the pivot it was sent to, piece by piece.

    ``held`` and ``sizes`` say how many vectors and queries a pivot has, ``vectors`` are packed by
    pivot and piece.
    """
    page = F.pmod(F.xxhash64("_row"), _pieces(sizes, page_size, "pivot")).alias("queries_piece")
    right = _packed(asked.select("*", page), ["pivot", "queries_piece"], "queries")
    right = right.withColumn("vectors_piece", _each(_pieces(held, VECTOR_BLOCK, "pivot")))
    left = vectors.where(F.col("pivot").isin(list(sizes)))
    left = left.withColumn("queries_piece", _each(_pieces(sizes, page_size, "pivot")))
    pairs = left.join(right, ["pivot", "vectors_piece", "queries_piece"])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        for batch in batches:
            for some, others in zip(*(column.to_pylist() for column in batch.columns)):
                asking = _frame(others)
                best = _nearest(_frame(some), asking, k)
                if best is not None:
                    who = asking.iloc[best["_query"].to_numpy()]
                    best = best.assign(_row=who["_row"].to_numpy(), query_id=who["query_id"].to_numpy())
                    table = pa.Table.from_pandas(best[out.names], schema=arrow, preserve_index=False)
                    yield from table.to_batches()

    return pairs.select("vectors", "queries").mapInArrow(nearest, out)


def cosine_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_K,
    where: Column | None = None,
    page_size: int = QUERY_PAGE,
    pivots: int | None = None,
) -> DataFrame:
    """The k nearest vectors of every query, with rank, metadata and cosine distance.

    ``vectors`` has ``key``, ``embedding`` and metadata columns, ``queries`` has
    ``query_id`` and ``embedding``. Every row of ``queries`` is answered by itself, also
    rows that share an id or have none. Rows without a vector, or with one of length zero,
    have no direction and match nothing; :func:`unanswerable` lists them.

    Vectors are dealt to pivots, and those of a pivot into pieces. A query first meets its nearest
    pivots, as many as hold k vectors. Its k-th distance then rules out every pivot whose
    vectors all lie farther, and the query is sent to the others only. Each piece of vectors and
    each piece of queries is one key of a join. No query passes through the driver, which holds
    the pivots and one line for each. Queries are numbered in a written table, so a task that
    runs again numbers them as before.
    """
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be between 1 and {MAX_K}")
    pool = vectors if where is None else vectors.where(where)
    present = pool.where(F.col("key").isNotNull() & (F.size("embedding") > 0))
    asked = queries.select("query_id", "embedding").where(F.size("embedding") > 0)
    asked = staged(asked.select(F.monotonically_increasing_id().alias("_row"), "query_id", "embedding"), "queries")
    n = present.count()
    wanted = min(MOST_PIVOTS, math.ceil(n / VECTOR_BLOCK)) if pivots is None else pivots
    sample = [] if wanted < 2 else (
        present.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("embedding").toArrow()["embedding"].to_pylist()
    )
    fixed = Pivots(sample, wanted)
    place, count = fixed.place, fixed.count

    @F.pandas_udf("pivot long, gap double")
    def placed(embedding: pd.Series) -> pd.DataFrame:
        return place(embedding)

    if count:
        near = staged(present.withColumn("_at", placed("embedding")).select("*", "_at.*").drop("_at"), "placed")
        for r in near.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("r")).collect():
            fixed.size[r["pivot"]], fixed.radius[r["pivot"]] = r["n"], r["r"]
        near = near.drop("gap")
    else:
        near = present.withColumn("pivot", F.lit(0).cast("long"))
        fixed.size[0] = n
    held = {p: int(m) for p, m in enumerate(fixed.size) if m}
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), _pieces(held, VECTOR_BLOCK, "pivot"))
    pieces = _packed(near.withColumn("vectors_piece", number), ["pivot", "vectors_piece"], "vectors")
    pieces = staged(pieces, "pieces") if count else pieces

    meta = [f for f in present.schema.fields if f.name != "embedding"]
    head = [T.StructField("_row", T.LongType()), queries.schema["query_id"]]
    out = T.StructType([*head, *meta, T.StructField("distance", T.DoubleType())])
    by_query = Window.partitionBy("_row").orderBy("distance", "key")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)

    @F.pandas_udf("array<long>")
    def first(embedding: pd.Series) -> pd.Series:
        return fixed.nearest(embedding, k)

    @F.pandas_udf("array<long>")
    def others(embedding: pd.Series, worst: pd.Series) -> pd.Series:
        return fixed.reachable(embedding, worst, k)

    if not count:
        sent = asked.withColumn("pivot", F.lit(0).cast("long"))
        found = best(_met(pieces, held, sent, {0: asked.count()}, page_size, k, out))
        return found.drop("_row").withColumn("distance", F.round("distance", 4))
    sent = staged(asked.withColumn("pivot", F.explode(first("embedding"))), "sent")
    found = staged(best(_met(pieces, held, sent, _sizes(sent), page_size, k, out)).drop("rank"), "first")
    worst = found.groupBy("_row").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d"))
    limits = worst.select("_row", F.when(F.col("n") == k, F.col("d")).alias("worst"))
    again = asked.join(limits, "_row", "left").withColumn("pivot", F.explode(others("embedding", "worst")))
    again = staged(again.drop("worst"), "again")
    found = best(found.unionByName(_met(pieces, held, again, _sizes(again), page_size, k, out)))
    return found.drop("_row").withColumn("distance", F.round("distance", 4))


def unanswerable(queries: DataFrame) -> DataFrame:
    """Rows of ``queries`` that match nothing: no vector, an empty one, or one of length zero."""
    known = F.exists("embedding", lambda x: x != 0)
    return queries.where(F.col("embedding").isNull() | ~F.coalesce(known, F.lit(False)))


def _bullets(items: Column, render) -> Column:
    return F.array_join(F.transform(items, render), "\n")


def _section(title: str, items: Column, body: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(f"## {title}\n\n"), body, F.lit("\n\n"))).otherwise("")


def render_docs(fields: DataFrame, enrichment: DataFrame) -> DataFrame:
    """One markdown document per enriched type, its field paths in order.

    ``fields`` holds ``resource_type, path, type`` with a path once per type.
    """
    listed = fields.groupBy("resource_type").agg(
        F.array_sort(F.collect_list(F.struct("path", "type"))).alias("paths")
    )
    doc = enrichment.join(listed, "resource_type", "left")
    paths = F.coalesce(F.col("paths"), F.array().cast("array<struct<path:string,type:string>>"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    described = strip(text("description"))
    plain = lambda x: F.concat(F.lit("- "), F.coalesce(x, F.lit("")))
    document = F.concat(
        # Fixed values from here on: the headings of a rendered document.
        F.lit("# "),
        F.col("resource_type"),
        F.lit("\n\n- **Service**: "),
        text("service"),
        F.lit("\n- **Category**: "),
        text("category"),
        F.lit("\n- **Field count**: "),
        F.size(paths).cast("string"),
        F.lit("\n\n## Description\n\n"),
        F.when(described != "", described).otherwise(NO_DESCRIPTION),
        F.lit("\n\n"),
        _section("Common queries", F.col("common_queries"), _bullets(F.col("common_queries"), plain)),
        _section(
            "Notable fields",
            F.col("notable_fields"),
            _bullets(
                F.filter("notable_fields", lambda f: f.isNotNull()),
                lambda f: F.concat(
                    F.lit("- `"),
                    F.coalesce(f["path"], F.lit("")),
                    F.lit("` — "),
                    F.coalesce(f["description"], F.lit("")),
                ),
            ),
        ),
        _section(
            "Related resource types",
            F.col("relationships_to"),
            _bullets(F.col("relationships_to"), plain),
        ),
        F.lit("## All field paths\n\n"),
        F.array_join(
            F.transform(paths, lambda f: F.concat(F.lit("- `"), f["path"], F.lit("`: "), f["type"], F.lit("\n"))),
            "",
        ),
    )
    return doc.select("resource_type", document.alias("document"))


def parse_doc_metadata(docs: DataFrame) -> DataFrame:
    """Service, category and field count from the document text; the last line of a
    kind counts, and a field count that is no integer is skipped."""

    def last(label: str, value: str) -> Column:
        pattern = rf"(?m)^\s*- \*\*{label}\*\*:[^\S\n]*({value})[^\S\n]*$"
        found = F.regexp_extract_all("document", F.lit(pattern), F.lit(1))
        return F.try_element_at(found, F.lit(-1))

    return docs.select(
        "resource_type",
        last("Service", r"[^\n]*?").alias("service"),
        last("Category", r"[^\n]*?").alias("category"),
        last("Field count", r"[+-]?\d+").try_cast("int").alias("field_count"),
    )


def pending(
    raw: DataFrame,
    done: DataFrame,
    key: str = "resource_type",
    force: bool = False,
    only: tuple[str, ...] = (),
    limit: int = 0,
) -> DataFrame:
    """The work list: everything not done yet, or everything with ``force``.

    ``only`` and ``limit`` choose from all keys, in key order, before done ones go.
    """
    chosen = raw.where(F.col(key).isin(*only)) if only else raw
    if limit > 0:
        chosen = chosen.orderBy(key).limit(limit)
    return chosen if force else chosen.join(done.select(key).distinct(), key, "left_anti")


def invalid_paths(enrichment: DataFrame, fields: DataFrame) -> DataFrame:
    """Notable fields that are no exact member of the type's field list."""
    notable = enrichment.select(
        "resource_type", F.explode("notable_fields").alias("field")
    ).select("resource_type", F.col("field.path").alias("path"))
    known = fields.select("resource_type", "path").distinct()
    return notable.join(known, ["resource_type", "path"], "left_anti")


def context_for(matches: DataFrame, docs: DataFrame) -> DataFrame:
    """The documents of a query's matches, joined in rank order.

    A query has at most ``MAX_K`` matches. A type without a document gets a placeholder.
    """
    block = F.coalesce(
        F.col("document"),
        F.concat(F.lit("# "), F.col("resource_type"), F.lit(f"\n\n{NO_DOCUMENT}\n")),
    )
    ranked = matches.join(docs.select("resource_type", "document"), "resource_type", "left").select(
        "query_id", F.struct("rank", block.alias("block")).alias("entry")
    )
    ordered = F.array_sort(F.collect_list("entry"))
    return ranked.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda e: e["block"]), SEPARATOR).alias("context")
    )
