"""Schema property files and rendered schema documents, read from and written to one file per type."""

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from cloudinv.functions.text import source_key
from cloudinv.sources.items import file_system

_PROPERTIES = ".properties.json"

# File names carry the colons of type names, which the check-sum layer over local disks
# cannot handle. Other file systems ignore these options.
_LOCAL_DISK = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
}


def _named_texts(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """``resource_type, value`` of whole files, the type from the file name."""
    name = F.element_at(F.split(source_key(F.col("_metadata.file_path")), "/"), -1)
    return (
        spark.read.options(**_LOCAL_DISK)
        .option("pathGlobFilter", f"*{suffix}")
        .text(root, wholetext=True)
        .select(F.replace(name, F.lit(suffix), F.lit("")).alias("resource_type"), "value")
    )


def parse_schema_fields(files: DataFrame, text: str = "value") -> DataFrame:
    """``resource_type, path, type`` from texts holding one JSON object per type."""
    return files.select(
        "resource_type", F.explode(F.from_json(text, "map<string,string>")).alias("path", "type")
    )


def read_schema_fields(spark: SparkSession, root: str) -> DataFrame:
    """The fields of all ``{type}.properties.json`` files of a folder."""
    return parse_schema_fields(_named_texts(spark, root, _PROPERTIES))


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """``resource_type, document`` from ``{type}.md`` files."""
    return _named_texts(spark, root, ".md").withColumnRenamed("value", "document")


# -- writing ---------------------------------------------------------------------------

FORMAT = "typed_files"
_STAGING = "_staging"


@dataclass
class Written(WriterCommitMessage):
    """Where one attempt of a task put its files, and the names they are to have."""

    folder: str
    names: list[str]


class TypedFilesWriter(DataSourceWriter):
    """Each attempt of a task writes into a folder of its own; the commit gives files their names.

    So an attempt that fails, or that runs beside another one, leaves nothing behind that a
    reader sees, and a failed job leaves the files as they were.
    """

    def __init__(self, root: str, suffix: str, overwrite: bool):
        self.root, self.suffix, self.overwrite = root.rstrip("/"), suffix, overwrite
        self.run = uuid.uuid4().hex

    def _at(self) -> tuple[pafs.FileSystem, str, str]:
        system, root, _ = file_system(self.root)
        return system, root, f"{root}/{_STAGING}/{self.run}"

    def write(self, rows: Iterator[Row]) -> Written:
        system, _, staging = self._at()
        folder, names = f"{staging}/{uuid.uuid4().hex}", []
        for row in rows:
            if not row["name"] or "/" in row["name"]:
                raise ValueError(f"no file name: {row['name']}")
            if not names:
                system.create_dir(folder)
            names.append(row["name"] + self.suffix)
            with system.open_output_stream(f"{folder}/{names[-1]}", compression=None) as out:
                out.write((row["value"] or "").encode())
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root, staging = self._at()
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a type has several documents")
        system.create_dir(root)
        for message in done:
            for name in message.names:
                system.move(f"{message.folder}/{name}", f"{root}/{name}")
        if self.overwrite:
            kept = set(names)
            for old in system.get_file_info(pafs.FileSelector(root)):
                if old.is_file and old.base_name.endswith(self.suffix) and old.base_name not in kept:
                    system.delete_file(old.path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, root, staging = self._at()
        if system.get_file_info(staging).type == pafs.FileType.Directory:
            system.delete_dir(staging)
        place = f"{root}/{_STAGING}"
        if system.get_file_info(place).type == pafs.FileType.Directory and not system.get_file_info(pafs.FileSelector(place)):
            system.delete_dir(place)


class TypedFiles(DataSource):
    """``df.write.format("typed_files").option("suffix", ".md").save(root)`` for rows of name and value.

    ``overwrite`` also removes files of the suffix that the rows do not name; ``append`` leaves them.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> TypedFilesWriter:
        return TypedFilesWriter(self.options["path"], self.options["suffix"], overwrite)


def _write(rows: DataFrame, root: str, suffix: str, mode: str) -> None:
    rows.sparkSession.dataSource.register(TypedFiles)
    rows.write.format(FORMAT).option("suffix", suffix).mode(mode).save(root)


def write_schema_fields(fields: DataFrame, root: str, mode: str = "overwrite") -> None:
    """``resource_type, path, type`` as one ``{type}.properties.json`` object per type."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "type"))))
    texts = fields.groupBy("resource_type").agg(F.to_json(entries).alias("value"))
    _write(texts.select(F.col("resource_type").alias("name"), "value"), root, _PROPERTIES, mode)


def write_documents(docs: DataFrame, root: str, mode: str = "overwrite") -> None:
    """``resource_type, document`` as one ``{type}.md`` file per type."""
    _write(docs.select(F.col("resource_type").alias("name"), F.col("document").alias("value")), root, ".md", mode)
