"""A Python data source of binary records: byte ranges of files are read, and parts written, by many tasks.

Reading. Each file is cut into ranges of whole records; a task opens the file, goes to its range and gives it out in batches, so
neither the size of a file nor of a task's share is ever held. A length that does not fit the format is an error.

Writing. A task writes its rows, in the order in which they come, as files of bounded size under names of its own attempt, and tells
the driver their names and numbers of records. Only when all tasks are done does the driver list these files, by partition, in a
manifest. Readers take positions from the counts in that list, never from values, and look at no other file. A failed task
deletes its files, a failed job those of its other tasks; what a lost executor left behind is in no manifest and goes at the commit.
Stores are those that Arrow opens by their address.
"""

from __future__ import annotations

import fnmatch
import json
import os
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME, MANIFEST = "quarry_records", "_manifest.json"
STEP = 1 << 18
RANGE, PART = 32 << 20, 32 << 20
_SCHEMAS = {
    "floats": "path string, first long, pos long, value float",
    "edges": "path string, first long, pos long, src int, dst int, weight int",
    "header": "path string, v int, e int",
    "matrix": "i int, j int, dist int",
}


def opened(path: str):
    """The Arrow file system of an address and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))


def listed(path: str) -> list[tuple[str, int, int | None]]:
    """Path, bytes and (where a manifest says so) records of the files of a file, a folder or a pattern of names, in order."""
    from pyarrow import fs

    store, at = opened(path)
    folder, pattern = os.path.split(at)
    if any(c in pattern for c in "*?["):
        found = [f for f in store.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatch(f.base_name, pattern)]
    elif store.get_file_info(at).type == fs.FileType.Directory:
        found = [f for f in store.get_file_info(fs.FileSelector(at)) if f.base_name[0] not in "._" or f.base_name == MANIFEST]
    else:
        found = [store.get_file_info(at)]
    sizes = {f.base_name: (f.path, f.size) for f in found if f.is_file}
    if MANIFEST in sizes:
        with store.open_input_stream(sizes[MANIFEST][0]) as held:
            return [(*sizes[name], records) for name, records in json.loads(held.read())["files"]]
    if not sizes:
        raise FileNotFoundError(f"no files of records at {path}")
    return [(*sizes[name], None) for name in sorted(sizes)]


class RecordsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options["kind"]
        self.wide = int(options.get("vertices", 0))
        self.range, self.codec = int(options.get("range", RANGE)), options.get("codec")
        self.head, self.record = {"floats": (0, 4), "edges": (8, 12), "header": (8, 12), "matrix": (0, 4 * self.wide)}[self.kind]
        self.begin, self.end = int(options.get("begin", 0)), int(options.get("end", (1 << 63) - 1))

    def partitions(self) -> list[InputPartition]:
        out, first = [], 0
        for path, size, records in listed(self.path):
            if self.kind == "header":
                out.append(InputPartition((path, size, 0, 0, 0)))
                continue
            packed = bool(self.codec) and path.endswith(self.codec)
            if not packed:
                records = self._records(path, size)
            high = max(1, self.range // max(self.record, 1)) if not packed else max(records or 1, 1)
            a, b = max(0, self.begin - first), min(records, self.end - first)
            out += [InputPartition((path, size, first, k, min(k + high, b))) for k in range(a, b, high)] or [InputPartition((path, size, first, 0, 0))]
            first += records
        return out or [InputPartition(("", 0, 0, 0, 0))]  # none at all would be read as one

    def _records(self, path: str, size: int) -> int:
        if self.kind == "matrix" and (not self.record or size % self.record):
            raise ValueError(f"{path}: {size} bytes are no whole rows of {self.wide} cells")
        if self.kind == "floats" and size % 4:
            raise ValueError(f"{path}: {size} bytes are no whole floats")
        return (size - self.head) // self.record  # of edges, the range's task compares this with the header

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, size, first, a, b = partition.value
        if not path:
            return
        store, _ = opened(self.path)
        with store.open_input_file(path) as file:
            if self.head:
                head = np.frombuffer(file.read(self.head), "<i4")
                if len(head) < 2:
                    raise ValueError(f"{path}: {size} bytes hold no header")
                if self.kind == "header":
                    yield pa.RecordBatch.from_pydict({"path": [path], "v": pa.array(head[:1]), "e": pa.array(head[1:])})
                    return
                if size != self.head + self.record * int(head[1]):
                    raise ValueError(f"{path}: {head[1]} edges announced, {(size - self.head) / self.record:g} found")
            if self.kind == "matrix":
                yield from self._cells(file, path, first, a, b)
                return
            for k in range(a, b, STEP):
                n = min(STEP, b - k)
                file.seek(self.head + k * self.record)
                data = file.read(n * self.record)
                where = {"path": pa.array([path]).dictionary_encode().take(pa.array(np.zeros(n, np.int32))).cast(pa.string()), "first": pa.array(np.full(n, first)), "pos": pa.array(np.arange(k, k + n))}
                if self.kind == "floats":
                    yield pa.RecordBatch.from_pydict(where | {"value": pa.array(np.frombuffer(data, "<f4"))})
                else:
                    triples = np.frombuffer(data, "<i4").reshape(-1, 3)
                    yield pa.RecordBatch.from_pydict(where | {c: pa.array(triples[:, i]) for i, c in enumerate(("src", "dst", "weight"))})

    def _cells(self, file, path: str, first: int, a: int, b: int) -> Iterator[pa.RecordBatch]:
        whole = None
        if self.codec and path.endswith(self.codec):
            whole = pa.CompressedInputStream(pa.BufferReader(file.read()), self.codec).read()
            if len(whole) != (b - a) * self.record:
                raise ValueError(f"{path}: {len(whole)} bytes are no whole rows of {self.wide} cells")
        if whole is not None:
            yield from self._tiles(np.frombuffer(whole, "<i4").reshape(b - a, self.wide), first + a)
            return
        high = max(1, STEP // max(self.wide, 1))
        for top in range(a, b, high):
            n = min(high, b - top)
            for left in range(0, self.wide, STEP):
                wide = min(STEP, self.wide - left)  # all of the row, or a piece of a single one
                file.seek(top * self.record + 4 * left)
                data = file.read(4 * (n * wide))
                i, j = np.arange(first + top, first + top + n, dtype="<i4"), np.arange(left, left + wide, dtype="<i4")
                yield pa.RecordBatch.from_pydict({"i": pa.array(np.repeat(i, wide)), "j": pa.array(np.tile(j, n)), "dist": pa.array(np.frombuffer(data, "<i4"))})

    def _tiles(self, rows: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
        """The cells of a file by columns: runs of equal ``j`` and recurring ``i`` stay small where they are written again."""
        high, wide = min(len(rows), STEP), max(1, STEP // max(len(rows), 1))
        for top in range(0, len(rows), high):
            i = np.arange(first + top, first + min(top + high, len(rows)), dtype="<i4")
            for left in range(0, self.wide, wide):
                j = np.arange(left, min(left + wide, self.wide), dtype="<i4")
                cells = rows[top : top + high, left : left + wide].T.ravel()
                yield pa.RecordBatch.from_pydict({"i": pa.array(np.tile(i, len(j))), "j": pa.array(np.repeat(j, len(i))), "dist": pa.array(cells)})


class RecordsWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options["kind"]
        self.suffix, self.most = options.get("suffix", ""), int(options.get("part", PART))
        self.wide = int(options.get("vertices", 0))

    def _parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int]]:
        """Bytes of the files of one task, and their records."""
        if self.kind == "blocks":  # each row is a file
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("data", "records")), strict=True)
            return
        held, records, size = [], 0, 0
        head = lambda n: np.array([self.wide, n], "<i4").tobytes() if self.kind == "edges" else b""
        for batch in batches:
            if self.kind == "edges":
                data = np.column_stack([np.asarray(batch.column(c)) for c in ("src", "dst", "weight")]).astype("<i4").tobytes()
            else:
                data = np.asarray(batch.column("value"), dtype="<f4").tobytes()
            held.append(data)
            records, size = records + batch.num_rows, size + len(data)
            if size >= self.most:
                yield head(records) + b"".join(held), records
                held, records, size = [], 0, 0
        if records:
            yield head(records) + b"".join(held), records

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, folder = opened(self.path)
        store.create_dir(folder, recursive=True)
        message, own = WriterCommitMessage(), f"part-{task.partitionId():08d}"
        message.files, attempt = [], uuid.uuid4().hex
        try:
            for k, (data, records) in enumerate(self._parts(iterator)):
                name = f"{own}-{k:06d}-{attempt}{self.suffix}"
                message.files.append((name, records))
                with store.open_output_stream(f"{folder}/{name}") as out:
                    out.write(data)
        except BaseException:
            _removed(store, folder, [name for name, _ in message.files])
            raise
        return message

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, folder = opened(self.path)
        store.create_dir(folder, recursive=True)
        files = sorted(tuple(f) for m in messages if m is not None for f in m.files)
        known = {name for name, _ in files}
        _removed(store, folder, [f.base_name for f in store.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("part-") and f.base_name not in known])
        with store.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps({"files": files}).encode())

    def abort(self, messages: list) -> None:
        store, folder = opened(self.path)
        _removed(store, folder, [name for m in messages if m is not None for name, _ in m.files])


def _removed(store, folder: str, names: list[str]) -> None:
    for name in names:
        try:
            store.delete_file(f"{folder}/{name}")
        except FileNotFoundError:  # it was not begun
            pass


class Records(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _SCHEMAS[self.options["kind"]]

    def reader(self, schema) -> DataSourceReader:
        return RecordsReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return RecordsWriter(dict(self.options))


_known: set[str] = set()


def registered(spark: SparkSession) -> str:
    """The source's name, after the session has learnt it. It is sent to workers by value, as they may not know this package."""
    session = f"{spark.sparkContext.applicationId}-{id(spark._jsparkSession)}"
    if session not in _known:
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
        spark.dataSource.register(Records)
        _known.add(session)
    return NAME


def records(path: str) -> int:
    """How many records the manifest of a written folder counts."""
    return sum(n or 0 for _, _, n in listed(path))
