"""The text form of discretised series as a Spark data source.

    spark.dataSource.register(DiscretisedSource)
    spark.read.format("discretised").option("layout", "error").load(path)

The schema comes from the four header lines.  A read is cut into byte ranges of about ``partitionBytes``; each line
belongs to the range in which it begins, so the file is read once.  ``position`` is the place of the line in the files
by name: ascending, with gaps; ``order.with_index`` makes a dense index of it.  Files may lie wherever pyarrow's file
systems reach, and a directory is its files in the order of their names.

A series (``idx``, the base columns, the codes) is written as parts that a commit numbers by their first ``idx`` and puts
behind a header with the count of all rows; until then parts are hidden, and an abort removes them.  Rows should come
sorted within partitions that are ranges of ``idx``.  Options: ``layout``, and ``specs``, the third header line.

A file ends at trailing empty lines.  As a range cannot know of an empty line in another one, rows after an empty line
are an error here; ``files.read_discretised`` cuts such a file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from pulsegrid.functions.binning import parse_spec
from pulsegrid.sources.files import LAYOUTS, WHOLE

PARTITION_BYTES = 64 << 20
HEADER_LINES = 4


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the visible files, by name."""
    from pyarrow import fs

    store, at = _store(path)
    found = store.get_file_info(at)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [found] if found.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File]
    return sorted((f.path, f.size) for f in infos if not f.base_name.startswith((".", "_")))


def _lines(stream) -> Iterator[tuple[int, str]]:
    """(where it begins, line) from where the stream is."""
    at, rest = stream.tell(), b""
    while block := stream.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            yield at, line.decode().rstrip("\r")
            at += len(line) + 1
    if rest:
        yield at, rest.decode().rstrip("\r")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    before: int  # bytes of the files ahead of this one


class DiscretisedReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, partition_bytes: int):
        self.schema, self.path, self.partition_bytes = schema, path, partition_bytes
        self.types = [int if isinstance(f.dataType, (IntegerType, LongType)) else float for f in schema.fields[1:]]

    def partitions(self) -> list[Range]:
        files = _files(self.path)
        skip = _header(self.path)[1]
        out, before = [], 0
        for path, size in files:
            first = min(size, skip - before) if before < skip else 0
            out += [Range(path, a, min(size, a + self.partition_bytes), before) for a in range(first, size, self.partition_bytes)]
            before += size
        return out or [Range(files[0][0], 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        store, _ = _store(self.path)
        with store.open_input_file(partition.path) as stream:
            if partition.start:
                stream.seek(partition.start - 1)
                if stream.read(1) != b"\n":  # the line began in the range before
                    at, line = next(_lines(stream), (partition.end, ""))
                    stream.seek(at + len(line.encode()) + 1)
                    partition = Range(partition.path, stream.tell(), partition.end, partition.before)
            stream.seek(partition.start)
            empty = False
            for at, line in _lines(stream):
                if not line:
                    empty = True
                elif empty:
                    raise ValueError(f"{partition.path}: a row after an empty line, at byte {at}")
                if at >= partition.end and not empty:
                    return
                if line:
                    fields = line.split(",")
                    if len(fields) != len(self.types):
                        raise ValueError(f"{partition.path}: {len(fields)} fields at byte {at}, not {len(self.types)}")
                    yield (partition.before + at, *[kind(x) for kind, x in zip(self.types, fields)])


def _header(path: str) -> tuple[list[str], int]:
    """The header lines, and the bytes that they take of the files by name."""
    found, before = [], 0
    store, _ = _store(path)
    for name, size in _files(path):
        with store.open_input_file(name) as stream:
            for at, line in _lines(stream):
                if len(found) == HEADER_LINES:
                    return found, before + at
                found.append(line)
        before += size
        if len(found) == HEADER_LINES:
            return found, before
    raise ValueError(f"{path} has no header")


@dataclass
class Part(WriterCommitMessage):
    path: str
    rows: int
    first: int


class DiscretisedWriter(DataSourceWriter):
    def __init__(self, schema: StructType, path: str, layout: str, specs: str, overwrite: bool):
        self.path, self.layout, self.specs, self.overwrite = path, layout, specs, overwrite
        dims = [parse_spec(s).name.lower() for s in specs.split(";")]
        self.names = [*LAYOUTS[layout], *dims]
        lower = [n.lower() for n in schema.names]
        missing = [n for n in ("idx", *self.names) if n not in lower]
        if missing:
            raise ValueError(f"columns are missing: {', '.join(missing)}")
        self.places, self.idx = [lower.index(n) for n in self.names], lower.index("idx")

    def write(self, iterator: Iterator) -> Part:
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        name, n, first = f"{at}/.part-{uuid.uuid4().hex}", 0, 0
        with store.open_output_stream(name) as out:
            for row in iterator:
                if n == 0:
                    first = row[self.idx]
                out.write((",".join("" if row[k] is None else str(row[k]) for k in self.places) + "\n").encode())
                n += 1
        return Part(name, n, first)

    def commit(self, messages: list) -> None:
        store, at = _store(self.path)
        if self.overwrite:
            for old, _ in _files(self.path):
                store.delete_file(old)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.first)
        head = [str(sum(m.rows for m in parts)), str(len(self.specs.split(";"))), self.specs, ",".join(self.names)]
        kept = 0
        for m in parts:
            if m.rows:
                kept += 1
                store.move(m.path, f"{at}/part-{kept:08d}")
            else:
                store.delete_file(m.path)
        with store.open_output_stream(f"{at}/header") as out:  # sorts before the parts
            out.write(("\n".join(head) + "\n").encode())

    def abort(self, messages: list) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.path)


class DiscretisedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "discretised"

    def _layout(self) -> str:
        layout = self.options.get("layout", "error")
        if layout not in LAYOUTS:
            raise ValueError(f"no layout {layout!r}")
        return layout

    def schema(self) -> StructType:
        lines, _ = _header(self.options["path"])
        specs = [parse_spec(s) for s in lines[2].split(";")]
        if len(specs) != int(lines[1]):
            raise ValueError(f"{self.options['path']} names {len(specs)} dimensions, not {lines[1]}")
        base = [StructField(n, WHOLE.get(n, DoubleType())) for n in LAYOUTS[self._layout()]]
        return StructType([StructField("position", LongType()), *base, *[StructField(s.name.lower(), IntegerType()) for s in specs]])

    def reader(self, schema: StructType) -> DiscretisedReader:
        return DiscretisedReader(schema, self.options["path"], int(self.options.get("partitionbytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DiscretisedWriter:
        return DiscretisedWriter(schema, self.options["path"], self._layout(), self.options["specs"], overwrite)
