"""Files of binary records as a Python data source: byte ranges in, part files with a two-phase commit out.

A data set is a file or a folder of part files in name order. Records are numbered over all of it (or over each file), and
a long file is read by many tasks. Where all records have one size, ranges follow from the files' lengths. Where sizes vary, a pass
over the headers makes an index first: a task a file hops from header to header and notes where a record begins after
every `split` bytes; then ranges are read side by side. The driver sees names, lengths and ranges, never a record.

File systems are those that Arrow knows by their URI (local, S3, GCS, HDFS).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lattica.sources.layouts import LAYOUTS, Layout, Window

#: Bytes of a range, and ranges of a data set at most: then ranges grow instead, so a plan stays small.
SPLIT, RANGES = 1 << 26, 100_000
#: Bytes of records that are decoded at once.
CHUNK = 1 << 23
#: What a writer says of the parts it has written, beside them.
MANIFEST = "_records"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    store, inside = fs.FileSystem.from_uri(path)
    return store, inside.rstrip("/")


def knows(path: str) -> bool:
    try:
        _store(path)
        return True
    except (pa.ArrowInvalid, OSError):
        return False


def files(path: str) -> list[tuple[str, int]]:
    """(path, length) of a data set's files, in name order; names that begin with . or _ don't count."""
    store, inside = _store(path)
    info = store.get_file_info(inside)
    if info.type == fs.FileType.File:
        return [(inside, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [f for f in store.get_file_info(fs.FileSelector(inside)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
    return sorted((f.path, f.size) for f in found)


@dataclass
class Range(InputPartition):
    """Bytes [start, stop) of a file, which hold whole records, the first of that number."""

    path: str
    start: int
    stop: int
    first: int


def _width(total: int, split: int) -> int:
    return max(1, split, -(-total // RANGES))


def fixed_ranges(layout: Layout, path: str, split: int) -> list[Range]:
    listed = files(path)
    bad = [p for p, n in listed if n < layout.head or (n - layout.head) % layout.record]
    if bad:
        raise ValueError(f"not a whole number of records of {layout.record} bytes: {bad[:3]}")
    width = max(1, _width(sum(n for _, n in listed), split) // layout.record) * layout.record
    out, before = [], 0
    for name, n in listed:
        for at in range(layout.head, n, width):
            out.append(Range(name, at, min(n, at + width), before + (at - layout.head) // layout.record))
        before += (n - layout.head) // layout.record if layout.one_number else 0
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.layout = options["path"], LAYOUTS[options["layout"]]
        self.split = int(options.get("split", SPLIT))
        self.ranges = [Range(*r) for r in json.loads(options["ranges"])] if "ranges" in options else None

    def partitions(self) -> list[Range]:
        # a data set without records is one empty range: a source needs a partition
        return (fixed_ranges(self.layout, self.path, self.split) if self.ranges is None else self.ranges) or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.start >= part.stop:
            return
        schema = pa_schema(self.layout.schema)
        store, _ = _store(self.path)
        with store.open_input_file(part.path) as file:
            window = Window(file, part.stop)
            name = self.path if part.path == _store(self.path)[1] else f"{self.path.rstrip('/')}/{part.path.rsplit('/', 1)[-1]}"
            at, first = part.start, part.first
            while at < part.stop:
                end, n = self._chunk(window, at, part.stop)
                columns = self.layout.decode(window(at, end - at), name, first)
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
                at, first = end, first + n

    def _chunk(self, window: Window, at: int, stop: int) -> tuple[int, int]:
        """(end, number) of the records that are decoded together: CHUNK bytes, or one longer record."""
        if self.layout.record:
            n = min(-(-(stop - at) // self.layout.record), max(1, CHUNK // self.layout.record))
            return at + n * self.layout.record, n
        n, end = 0, at
        while end < stop and (not n or end - at < CHUNK):
            end, n = end + checked(self.layout, window, end), n + 1
        return end, n


def checked(layout: Layout, window: Window, at: int) -> int:
    n = layout.length(window, at)
    if n <= 0:
        raise ValueError(f"a record of {n} bytes at byte {at}")
    return n


class _Indexer(DataSourceReader):
    """A partition a file: where records begin, about every split bytes."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.layout, self.split = options["path"], LAYOUTS[options["layout"]], int(options.get("split", SPLIT))

    def partitions(self) -> list[Range]:
        listed = files(self.path)
        self.width = _width(sum(n for _, n in listed), self.split)
        return [Range(name, self.layout.head, n, self.width) for name, n in listed] or [Range("", 0, 0, 1)]

    def read(self, part: Range) -> Iterator[tuple[str, int, int, int]]:
        if part.start >= part.stop:
            return
        width = part.first
        store, _ = _store(self.path)
        with store.open_input_file(part.path) as file:
            window, at, start, n = Window(file, part.stop), part.start, part.start, 0
            while at < part.stop:
                at, n = at + checked(self.layout, window, at), n + 1
                if at > part.stop:
                    raise ValueError(f"{part.path}: a record goes on beyond the end of the file")
                if at - start >= width or at == part.stop:
                    yield part.path, start, at, n
                    start, n = at, 0


@dataclass
class Part(WriterCommitMessage):
    held: str
    name: str
    records: int


class _Writer(DataSourceArrowWriter):
    """Tasks write under names of their own in a folder beside the parts; commit renames what succeeded, then says what there is."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.layout, self.suffix = options["path"], LAYOUTS[options["layout"]], options.get("suffix", "")
        self.held = f"_writing-{uuid.uuid4().hex}"
        store, inside = _store(self.path)
        if not overwrite and store.get_file_info(inside).type != fs.FileType.NotFound and files(self.path):
            raise FileExistsError(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, inside = _store(self.path)
        held = f"{inside}/{self.held}/{uuid.uuid4().hex}"
        n = 0

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal n
            for batch in iterator:
                n += batch.num_rows
                yield batch

        store.create_dir(held.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(held) as out:
            if self.layout.header is None:
                for data in self.layout.encode(counted()):
                    out.write(data)
            else:  # such a file says first how many records it has, so a part's bytes wait for its number
                body = list(self.layout.encode(counted()))
                out.write(self.layout.header(n))
                for data in body:
                    out.write(data)
        return Part(held, f"part-{context.partitionId():06d}{self.suffix}", n)

    def commit(self, messages: list[Part | None]) -> None:
        store, inside = _store(self.path)
        for name, _ in files(self.path):
            if name.endswith(self.suffix):
                store.delete_file(name)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.name)
        some = [m for m in parts if m.records] or parts[:1]
        for m in some:
            store.move(m.held, f"{inside}/{m.name}")
        with store.open_output_stream(f"{inside}/{MANIFEST}{self.suffix}") as out:
            out.write(json.dumps({"parts": [[m.name, m.records] for m in some]}).encode())
        store.delete_dir(f"{inside}/{self.held}")

    def abort(self, messages: list[Part | None]) -> None:
        store, inside = _store(self.path)
        if store.get_file_info(f"{inside}/{self.held}").type != fs.FileType.NotFound:
            store.delete_dir(f"{inside}/{self.held}")


class RecordFiles(DataSource):
    """format("lattica_records"): options path, layout, split, suffix, and ranges, which only varying records need."""

    @classmethod
    def name(cls) -> str:
        return "lattica_records"

    def schema(self) -> str:
        return LAYOUTS[self.options["layout"]].schema

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


class RecordIndex(DataSource):
    """format("lattica_record_index"): ranges of whole records in files whose records vary in size."""

    @classmethod
    def name(cls) -> str:
        return "lattica_record_index"

    def schema(self) -> str:
        return "path string, start long, stop long, n long"

    def reader(self, schema: object) -> DataSourceReader:
        return _Indexer(dict(self.options))


def pa_schema(schema: str) -> pa.Schema:
    """The Arrow schema of "name type, ..." with the types that layouts use."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(", "))])


def index(spark: SparkSession, path: str, layout: str, split: int = SPLIT) -> list[list]:
    """[path, start, stop, first] of each range; RANGES and a range a file at most."""
    spark.dataSource.register(RecordIndex)
    rows = spark.read.format("lattica_record_index").option("layout", layout).option("split", split).load(path).toArrow().to_pylist()
    out, before, last = [], 0, None
    for r in sorted(rows, key=lambda r: (r["path"], r["start"])):
        if r["path"] != last and not LAYOUTS[layout].one_number:
            before = 0
        last = r["path"]
        out.append([r["path"], r["start"], r["stop"], before])
        before += r["n"]
    return out


def read(spark: SparkSession, path: str, layout: str, split: int | None = None) -> DataFrame:
    split = SPLIT if split is None else split
    spark.dataSource.register(RecordFiles)
    reader = spark.read.format("lattica_records").option("layout", layout).option("split", split)
    ranges = [astuple(r) for r in fixed_ranges(LAYOUTS[layout], path, split)] if LAYOUTS[layout].record else index(spark, path, layout, split)
    return reader.option("ranges", json.dumps(ranges)).load(path)


def write(rows: DataFrame, path: str, layout: str, order: list[str], suffix: str = "", whole: list[str] | None = None, parts: int | None = None) -> int:
    """Write rows in order as part files and give their number. Rows that agree in the columns of whole stay in one part.

    The cluster sorts rows into ranges between sampled quantiles; parts are named by range, so name order is key order.
    """
    spark = rows.sparkSession
    spark.dataSource.register(RecordFiles)
    ranged = rows.repartitionByRange(*([parts] if parts else []), *(whole or order)).sortWithinPartitions(*order)
    ranged.write.format("lattica_records").option("layout", layout).option("suffix", suffix).mode("overwrite").save(path)
    store, inside = _store(path)
    with store.open_input_stream(f"{inside}/{MANIFEST}{suffix}") as f:
        return sum(n for _, n in json.loads(f.read())["parts"])
