"""Records as JSON lines, as a data source: a growing folder is read by offsets, and writes are committed.

Reading: a file counts up to its last line end, so a line that is still being written
isn't read.  An offset is the number of bytes of each file that was read; a batch is
the bytes between two offsets, so one that is run again reads the same records.

Writing: tasks write to files of their own; a commit names those that count, in a
manifest that is put in place by one move.  A reader takes what manifests name, so
the files of failed or repeated tasks are never seen.  A streaming batch has one
manifest by its number: written again, it changes nothing.

Paths are those that ``pyarrow.fs`` knows (local or shared mounts, object stores, HDFS).
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: Bytes that a task reads, about; bytes of lines that are parsed at a time.
SPLIT, CHUNK = 32 << 20, 4 << 20
#: The column that says why a line couldn't be read, if the schema has it.
ERROR = "_error"
_MANIFESTS = "_commits"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _list(path: str) -> list[tuple[str, int]]:
    """Files that count: those that manifests name, or where there are none all .jsonl files; by name."""
    from pyarrow import fs

    store, root = _fs(path)
    found = {f.path: f.size for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if f.type == fs.FileType.File}
    manifests = [p for p in found if p.startswith(f"{root}/{_MANIFESTS}/") and p.endswith(".json")]
    if not manifests:
        return sorted((p, n) for p, n in found.items() if p.endswith(".jsonl") and "/_" not in p[len(root) :])
    named = []
    for m in sorted(manifests):
        with store.open_input_stream(m) as f:
            named += [f"{root}/{x['file']}" for x in json.loads(f.read())]
    return sorted((p, found[p]) for p in named)


def _whole(path: str, name: str, size: int, after: int) -> int:
    """Bytes of a file up to its last line end, looked for from the end; at least ``after``."""
    store, _ = _fs(path)
    with store.open_input_file(name) as f:
        end = size
        while end > after:
            start = max(after, end - (64 << 10))
            f.seek(start)
            at = f.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return after


@dataclass
class Stretch(InputPartition):
    """Bytes of a file: the lines that begin in [start, end)."""

    name: str
    first: int
    start: int
    end: int
    last: int


def stretches(name: str, first: int, last: int, split: int = SPLIT) -> list[Stretch]:
    return [Stretch(name, first, at, min(at + split, last), last) for at in range(first, last, split)]


def _lines(path: str, s: Stretch) -> Iterator[bytes]:
    """The stretch's lines, some at a time."""
    store, _ = _fs(path)
    with store.open_input_file(s.name) as f:
        at = s.start
        if at > s.first:  # the line that reaches in from before is the other task's
            f.seek(at - 1)
            while at < s.last:
                block = f.read(min(64 << 10, s.last - at + 1))
                cut = block.find(b"\n")
                if cut >= 0:
                    at += cut
                    break
                at += len(block)
        while at < s.end:
            f.seek(at)
            block = f.read(min(CHUNK, s.last - at))
            cut = block.rfind(b"\n") + 1
            while not cut and at + len(block) < s.last:  # a line longer than a chunk
                block += f.read(min(CHUNK, s.last - at - len(block)))
                cut = block.rfind(b"\n") + 1
            block = block[: cut or len(block)]
            if at + len(block) > s.end:  # only lines that begin before the end
                stop = block.find(b"\n", max(0, s.end - at - 1)) + 1
                block = block[: stop or len(block)]
            at += len(block)
            yield block


def _value(v, kind: pa.DataType):
    if v is None:
        return None
    if pa.types.is_string(kind) and not isinstance(v, str):
        return json.dumps(v, ensure_ascii=False)
    return pa.scalar(v, kind).as_py()


def parsed(block: bytes, schema: pa.Schema) -> pa.RecordBatch:
    """Records of some lines; what a record lacks is null, so is what doesn't fit, and a broken line is a row with its error."""
    from pyarrow import json as reader

    asked = pa.schema([f for f in schema if f.name != ERROR])
    try:
        lines = [x for x in block.split(b"\n") if x.strip()]
        t = reader.read_json(io.BytesIO(b"\n".join(lines)), parse_options=reader.ParseOptions(explicit_schema=asked, unexpected_field_behavior="ignore")) if lines else asked.empty_table()
        if len(t) == len(lines):
            cols = {f.name: t.column(f.name).combine_chunks() if f.name in t.column_names else pa.nulls(len(t), f.type) for f in schema}
            return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols.values()], schema=schema)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        pass  # line by line
    rows = []
    for line in lines:
        row, error = dict.fromkeys(schema.names), None
        try:
            got = json.loads(line)
            if not isinstance(got, dict):
                raise ValueError("no object")
            for f in asked:
                try:
                    row[f.name] = _value(got.get(f.name), f.type)
                except (pa.ArrowInvalid, pa.ArrowTypeError, TypeError, ValueError) as e:
                    error = f"{f.name}: {e}"[:200]
        except ValueError as e:
            error = f"{type(e).__name__}: {e}"[:200]
        if ERROR in row:
            row[ERROR] = error
        elif error and all(v is None for v in row.values()):
            continue  # nothing of it can be shown
        rows.append(row)
    return pa.RecordBatch.from_pylist(rows, schema=schema)


class _Read:
    def __init__(self, path: str, schema: StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.arrow = path, to_arrow_schema(schema)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        for block in _lines(self.path, partition):
            yield parsed(block, self.arrow)


class BatchReader(_Read, DataSourceReader):
    def partitions(self) -> list[Stretch]:
        return [s for name, size in _list(self.path) for s in stretches(name, 0, size)] or [Stretch("", 0, 0, 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.name else iter(())


class StreamReader(_Read, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {name: _whole(self.path, name, size, self.known.get(name, 0)) for name, size in _list(self.path)}
        self.known = found
        return found

    def __init__(self, path: str, schema: StructType):
        super().__init__(path, schema)
        self.known: dict[str, int] = {}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return [s for name, to in sorted(end.items()) for s in stretches(name, start.get(name, 0), to)]

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    file: str
    records: int


class _Write:
    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = _fs(self.path)
        name, n = f"data/{self.run}-{uuid.uuid4().hex}.jsonl", 0  # a task that is run again has a file of its own
        store.create_dir(f"{root}/data", recursive=True)
        with store.open_output_stream(f"{root}/{name}") as f:
            for row in iterator:
                f.write(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str).encode() + b"\n")
                n += 1
        return Written(name, n)

    def _committed(self, messages: list[Written | None], name: str) -> None:
        from pyarrow import fs

        store, root = _fs(self.path)
        store.create_dir(f"{root}/{_MANIFESTS}", recursive=True)
        to = f"{root}/{_MANIFESTS}/{name}.json"
        if store.get_file_info(to).type == fs.FileType.File:
            self._dropped(messages)  # this batch counts already
            return
        temporary = f"{root}/{_MANIFESTS}/.{name}-{self.run}"
        with store.open_output_stream(temporary) as f:
            f.write(json.dumps([{"file": m.file, "records": m.records} for m in messages if m and m.records]).encode())
        store.move(temporary, to)

    def _dropped(self, messages: list[Written | None]) -> None:
        store, root = _fs(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{root}/{m.file}")


class BatchWriter(_Write, DataSourceWriter):
    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = _fs(self.path)
        before = [f.path for f in store.get_file_info(fs.FileSelector(f"{root}/{_MANIFESTS}", allow_not_found=True)) if f.path.endswith(".json")] if self.overwrite else []
        self._committed(messages, f"batch-{self.run}")
        for p in before:  # what was there before counts no more
            store.delete_file(p)

    def abort(self, messages: list[Written | None]) -> None:
        self._dropped(messages)


class StreamWriter(_Write, DataSourceStreamWriter):
    """name: of the query that writes; its batches are told apart from those of others by it."""

    def __init__(self, path: str, name: str):
        super().__init__(path)
        self.name = re.sub(r"\W", "_", name)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self._committed(messages, f"stream-{self.name}-{batchId:012}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._dropped(messages)


class Records(DataSource):
    """``spark.read.format("records").schema(..).load(path)``; options: path, and for a streaming sink name."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        raise ValueError("records need a schema")

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options["path"], overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options["path"], self.options.get("name", "stream"))


def register(spark) -> None:
    spark.dataSource.register(Records)
