"""Snapshot documents read item by item, in memory that does not grow with the document."""

import codecs
import json
import re
import zlib
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cloudinv.schema import ITEM
from cloudinv.sources.snapshots import Day, snapshot_glob

FORMAT = "snapshot_items"
SCHEMA = "source_key string, value string, error string"
#: Compressed bytes read at once; bytes and files of a partition; characters and rows of a batch.
CHUNK = 1 << 18
PARTITION, FILES = 64 << 20, 256
BATCH, ROWS = 4 << 20, 2000


class BrokenDocument(ValueError):
    """The file is no archive, or its text is no snapshot document."""


def inflated(chunks: Iterator[bytes]) -> Iterator[str]:
    """The text of a gzip file of one or more members, piece by piece."""
    text = codecs.getincrementaldecoder("utf-8-sig")()
    member, inside = zlib.decompressobj(31), False
    try:
        for data in chunks:
            while data:
                if member.eof:
                    member = zlib.decompressobj(31)
                inside = True
                yield text.decode(member.decompress(data, 4 * CHUNK))
                data = member.unused_data if member.eof else member.unconsumed_tail
        if not inside or not member.eof:
            raise BrokenDocument("the archive is cut off")
        yield text.decode(b"", True)
    except (zlib.error, UnicodeDecodeError) as error:
        raise BrokenDocument(str(error)) from None


def _no_constant(name: str):
    raise BrokenDocument(f"{name} is no JSON")


class Window:
    """The part of a JSON text that is looked at; what lies before ``at`` is let go."""

    _blank = re.compile(r"[ \t\n\r]*")
    _decoder = json.JSONDecoder(parse_constant=_no_constant)
    #: A name or an escape that the window's end cuts off is shorter than this.
    _cut = 16

    def __init__(self, pieces: Iterator[str]):
        self.pieces, self.text, self.at, self.whole = pieces, "", 0, False

    def _more(self) -> None:
        """As much text again as is held, so that a long value is not tried too often."""
        held, got = [self.text[self.at :]], 0
        while got <= len(held[0]):
            piece = next(self.pieces, None)
            if piece is None:
                self.whole = True
                break
            held.append(piece)
            got += len(piece)
        self.text, self.at = "".join(held), 0

    def peek(self) -> str:
        """The next character that is no blank; empty at the end."""
        while True:
            self.at = self._blank.match(self.text, self.at).end()
            if self.at < len(self.text) or self.whole:
                return self.text[self.at : self.at + 1]
            self._more()

    def take(self, *allowed: str) -> str:
        found = self.peek()
        if found not in allowed:
            raise BrokenDocument(f"{found or 'the end'} where one of {allowed} belongs")
        self.at += 1
        return found

    def value(self) -> tuple[object, str]:
        """The next value and its text."""
        self.peek()
        while True:
            try:
                found, end = self._decoder.raw_decode(self.text, self.at)
                # A number near the end may go on in the next piece, such as 1 to 1.5 or 1e-5.
                if self.whole or self.text[end - 1] in '"]}' or end < len(self.text) - 3:
                    text, self.at = self.text[self.at : end], end
                    return found, text
            except json.JSONDecodeError as error:
                cut = error.msg.startswith("Unterminated") or error.pos >= len(self.text) - self._cut
                if self.whole or not cut:
                    raise BrokenDocument(str(error)) from None
            except RecursionError:
                raise BrokenDocument("values lie too deep") from None
            self._more()


def item_texts(pieces: Iterator[str], member: str = "configurationItems") -> Iterator[str]:
    """The text of each element of one member of a JSON object; an absent or null member has none."""
    window = Window(pieces)
    window.take("{")
    end = window.peek()
    if end == "}":
        window.take("}")
    while end != "}":
        name, _ = window.value()
        window.take(":")
        if name != member:
            window.value()
        elif window.peek() == "[":
            window.take("[")
            more = window.peek() != "]" or window.take("]") != "]"
            while more:
                yield window.value()[1]
                more = window.take(",", "]") == ","
        elif window.value()[0] is not None:
            raise BrokenDocument(f"{member} is no list")
        end = window.take(",", "}")
    if window.peek():
        raise BrokenDocument("text after the document")


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


def file_system(uri: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a URI or local path, the path in it, and what goes before such paths in Spark's names."""
    scheme, _, rest = uri.rpartition("://") if "://" in uri else ("file", "", uri.removeprefix("file:"))
    system, path = pafs.FileSystem.from_uri(rest if scheme == "file" else f"{scheme.replace('s3a', 's3')}://{rest}")
    # Paths of object stores begin with the bucket, others with a slash after the host.
    host = rest.split("/")[0] if path.startswith("/") else ""
    return system, path.rstrip("/"), "file:" if scheme == "file" else f"{scheme}://{host}"


def _pattern(glob: str) -> re.Pattern:
    parts = re.split(r"(\*|\{[^}]*\})", glob)
    form = {"*": "[^/]*"}
    return re.compile("".join(
        form.get(p) or ("(?:%s)" % "|".join(map(re.escape, p[1:-1].split(","))) if p.startswith("{") else re.escape(p)) for p in parts
    ) + r"/[^/]*\.json\.gz")


class ItemsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.glob = options["path"], options["glob"]

    def partitions(self) -> list[Files]:
        """Files of like size go together, up to a number of compressed bytes."""
        system, root, _ = file_system(self.root)
        wanted = _pattern(self.glob)
        listed = system.get_file_info(pafs.FileSelector(f"{root}/AWSLogs", recursive=True, allow_not_found=True))
        found = [f for f in listed if f.is_file and wanted.fullmatch(f.path.removeprefix(root).lstrip("/"))]
        parts: list[list[str]] = []
        room = 0
        for f in sorted(found, key=lambda f: (-f.size, f.path)):
            if not parts or f.size > room or len(parts[-1]) >= FILES:
                parts.append([])
                room = PARTITION
            parts[-1].append(f.path)
            room -= f.size
        return [Files(p) for p in parts] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _, scheme = file_system(self.root)

        def texts(path: str) -> Iterator[str]:
            with system.open_input_stream(path, compression=None) as stream:
                yield from item_texts(inflated(iter(lambda: stream.read(CHUNK), b"")))

        rows: list[tuple] = []
        held = 0
        for path in partition.paths:
            key, n = scheme + path, 0
            try:
                # A document counts only as a whole, and is too large to be kept until its end.
                for _ in texts(path):
                    pass
            except BrokenDocument as error:
                rows.append((key, None, str(error)))
                continue
            for n, text in enumerate(texts(path), 1):
                rows.append((key, text, None))
                held += len(text)
                if held >= BATCH or len(rows) >= ROWS:
                    yield self._batch(rows)
                    rows, held = [], 0
            if not n:
                rows.append((key, None, None))
        yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["source_key", "value", "error"])


class SnapshotItems(DataSource):
    """``spark.read.format("snapshot_items").option("glob", ...).load(root)``.

    A row for each item with its JSON text; one row without text for a document without items, and
    one with ``error`` for a file that is no snapshot, of which no item counts.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ItemsReader:
        return ItemsReader(dict(self.options))


def read_item_texts(spark: SparkSession, root: str, region: str = "*", day: Day | date = None, account: str = "*") -> DataFrame:
    """``source_key, value, error`` of all items below a root, documents of any size."""
    spark.dataSource.register(SnapshotItems)
    glob = snapshot_glob("", region, day, account).lstrip("/")
    return spark.read.format(FORMAT).option("glob", glob).load(root)


def read_items(spark: SparkSession, root: str, region: str = "*", day: Day = None, account: str = "*") -> DataFrame:
    """``item, source_key``, as ``explode_items`` gives them; broken files are left out."""
    texts = read_item_texts(spark, root, region, day, account).where("value IS NOT NULL")
    return texts.select(F.from_json("value", ITEM).alias("item"), "source_key")


def read_lines(spark: SparkSession, root: str, region: str = "*", day: Day = None) -> DataFrame:
    """``value, source_key``: the text of every item as it was delivered."""
    return read_item_texts(spark, root, region, day).where("value IS NOT NULL").select("value", "source_key")
