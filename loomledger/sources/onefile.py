"""A sink that makes one new file, or none: tasks write parts, the commit joins them.

Lines are made and sorted by Spark. Each task streams its lines into a part of its own in a folder beside the target; the
commit copies the parts in order, a megabyte at a time, into one file there and renames it. A failed job deletes the folder, so
nothing is left; a target that is there is an error, before the work and again before the rename. One file is one writer's work: its bytes
pass the committer as a stream, never as a whole."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

_CHUNK = 1 << 20


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(f"file://{path}")


@dataclass
class _Part(WriterCommitMessage):
    place: int
    name: str
    lines: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, header: str | None, end: str) -> None:
        self.path, self.header, self.end = path.rstrip("/"), header, end
        self.folder = f"{self.path}.parts-{uuid.uuid4().hex}"
        self._must_be_new()
        # Made once, here: a straggling task of a failed job finds no folder to write into.
        system, folder = _located(self.folder)
        system.create_dir(folder, recursive=True)

    def _must_be_new(self) -> None:
        system, path = _located(self.path)
        if system.get_file_info(path).type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.path} is there already")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        context = TaskContext.get()
        system, folder = _located(self.folder)
        name, lines = f"{folder}/part-{context.partitionId():08d}-{context.taskAttemptId()}", 0
        with system.open_output_stream(name) as out:
            for row in iterator:
                out.write((row[0] + self.end).encode())
                lines += 1
        return _Part(context.partitionId(), name, lines)

    def commit(self, messages: list) -> None:
        system, folder = _located(self.folder)
        target = _located(self.path)[1]
        with system.open_output_stream(f"{folder}/whole") as out:
            if self.header is not None:
                out.write((self.header + self.end).encode())
            for part in sorted((m for m in messages if m is not None), key=lambda m: m.place):
                with system.open_input_stream(part.name) as piece:
                    while chunk := piece.read(_CHUNK):
                        out.write(chunk)
        try:
            self._must_be_new()
            system.move(f"{folder}/whole", target)
        finally:
            system.delete_dir(folder)

    def abort(self, messages: list) -> None:
        system, folder = _located(self.folder)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class OneFile(DataSource):
    """Options: path, header (absent: none), end."""

    @classmethod
    def name(cls) -> str:
        return "one_file"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("header"), self.options.get("end", "\n"))


def write_lines(lines: DataFrame, path: str, header: str | None = None, end: str = "\n") -> None:
    """Write the one text column of lines, in the order of its partitions, as one new file."""
    lines.sparkSession.dataSource.register(OneFile)
    writer = lines.write.format("one_file").option("path", path).option("end", end)
    (writer if header is None else writer.option("header", header)).mode("append").save()


def csv_cell(value: Column) -> Column:
    """A text as a CSV cell: quoted where it holds quotes, commas or line ends; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame) -> tuple[str, Column]:
    """(header, line): arrays, maps and structs are JSON."""
    cells = [csv_cell(F.to_json(F.col(f"`{c}`")) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`")) for c, t in df.dtypes]
    quoted = [f'"{c.replace(chr(34), chr(34) * 2)}"' if any(x in c for x in '",\r\n') else c for c in df.columns]
    return ",".join(quoted), F.concat_ws(",", *cells)
