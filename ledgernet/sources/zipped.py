"""Delimited text in zip archives as a Spark data source, read and written.

Each archive is a partition: the task that reads it opens the file itself and streams the
member, so that no archive passes through a row or the driver. The module travels to the
workers by value, which therefore need not have the package, and imports nothing of it.
"""

from __future__ import annotations

import io
import json
import sys
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv as pa_csv
from pyarrow import fs as pa_fs
from pyspark import cloudpickle
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ENCODING = "ISO-8859-1"
SEPARATOR = ";"
#: The size of an archive without members, of which the library finds no end record in Arrow's files.
NO_MEMBERS = 22


def file_system(uri: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system of an address and the path in it; a bare path is a mounted one."""
    if uri.startswith("file:"):
        return pa_fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pa_fs.FileSystem.from_uri(uri) if "://" in uri else (pa_fs.LocalFileSystem(), uri)


def parsed(member, columns: dict[str, list[str]], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Delimited text to batches of the target columns, all as text."""
    # Column names come from the first line; naming their types keeps codes such as 007.
    header = member.readline().decode(ENCODING).rstrip("\r\n")
    names = [n.strip().strip('"').lower() for n in header.split(SEPARATOR)]
    if not header:
        return
    try:
        reader = pa_csv.open_csv(
            member,
            read_options=pa_csv.ReadOptions(column_names=names, encoding=ENCODING),
            parse_options=pa_csv.ParseOptions(delimiter=SEPARATOR, newlines_in_values=True),
            convert_options=pa_csv.ConvertOptions(
                column_types={n: pa.string() for n in names}, null_values=[""], strings_can_be_null=True
            ),
        )
    except pa.ArrowInvalid as error:
        if "Empty CSV file" in str(error):
            return
        raise
    for batch in reader:
        arrays = []
        for target, sources in columns.items():
            found = [s for s in [*sources, target] if s in names]
            arrays.append(batch.column(names.index(found[0])) if found else pa.nulls(batch.num_rows, pa.string()))
        yield pa.RecordBatch.from_arrays(arrays, schema=out)


@dataclass
class Archive(InputPartition):
    uri: str

    def __init__(self, uri: str):
        super().__init__(uri)
        self.uri = uri


class ArchiveReader(DataSourceReader):
    def __init__(self, uris: list[str], columns: dict[str, list[str]]):
        self.uris, self.columns = uris, columns

    def partitions(self) -> list[Archive]:
        # An empty list would count as one partition of unknown content.
        return [Archive(uri) for uri in self.uris] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        system, path = file_system(partition.uri)
        out = pa.schema([(name, pa.string()) for name in self.columns])
        with system.open_input_file(path) as file:
            if file.size() == NO_MEMBERS:
                return
            with zipfile.ZipFile(file) as archive, archive.open(archive.namelist()[0]) as member:
                yield from parsed(member, self.columns, out)


@dataclass
class Written(WriterCommitMessage):
    """Where a task has put its archive: a name that counts only once the job commits."""

    path: str | None


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, prefix: str):
        self.folder, self.prefix = folder, prefix

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = file_system(self.folder)
        system.create_dir(folder, recursive=True)
        path = f"{folder}/_{uuid.uuid4().hex}"
        some = False
        with system.open_output_stream(path) as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as archive:
            with archive.open(f"{self.prefix}.csv", "w", force_zip64=True) as member:
                for batch in iterator:
                    out = io.BytesIO()
                    options = pa_csv.WriteOptions(include_header=not some, delimiter=SEPARATOR, quoting_style="all_valid")
                    pa_csv.write_csv(batch, out, options)
                    member.write(out.getvalue().decode().encode(ENCODING, "replace"))
                    some = True
        return Written(path if some else None)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = file_system(self.folder)
        for i, path in enumerate(m.path for m in messages if m is not None and m.path):
            system.move(path, f"{folder}/{self.prefix}{i}.zip")

    def abort(self, messages: list[Written | None]) -> None:
        for path in (m.path for m in messages if m is not None and m.path):
            file_system(self.folder)[0].delete_file(path)


class ArchiveSource(DataSource):
    """Format ``zipped_text``.

    To read: ``uris``, a JSON list of archives, of each of which the first member is read,
    and ``columns``, JSON of each target column with the header names it can have. To
    write: a folder and the ``prefix`` of the archives, one per task that has rows.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_text"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(json.loads(self.options["uris"]), json.loads(self.options["columns"]))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], self.options.get("prefix", "part"))
