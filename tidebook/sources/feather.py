"""Arrow IPC (Feather) files as a Spark data source: a partition for each few record batches, of which only the needed columns are read.

A file's footer tells where its batches lie; a task opens the file there, memory-mapped where it is local.
"""

from __future__ import annotations

from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema


#: Bytes of a file that one partition reads, about.
PARTITION_BYTES = 64 << 20


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + quote(path.removeprefix("file:")))


def _open(path: str, columns: list[int] | None = None):
    from pyarrow import fs

    system, inner = _system(path)
    source = pa.memory_map(inner) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(inner)
    return pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=columns, use_threads=False))


def _plain(schema: pa.Schema) -> pa.Schema:
    return pa.schema([pa.field(f.name, pa.string() if pa.types.is_large_string(f.type) else f.type) for f in schema])


_PLACE = [pa.field("file_idx", pa.int32()), pa.field("row_block", pa.int64()), pa.field("row_idx", pa.int64())]


class ArrowReader(DataSourceReader):
    def __init__(self, files: list[str], columns: list[str] | None):
        self.files, self.columns = files, columns

    def partitions(self):
        out = []
        for i, path in enumerate(self.files):
            n, size = _open(path).num_record_batches, max(1, _system(path)[0].get_file_info(_system(path)[1]).size)
            step = max(1, n * PARTITION_BYTES // size)
            out += [InputPartition((i, path, k, min(n, k + step))) for k in range(0, n, step)]
        return out or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        i, path, low, high = partition.value
        schema = _open(path).schema
        names = [n for n in schema.names if self.columns is None or n in self.columns]
        reader = _open(path, [schema.get_field_index(n) for n in names])
        target = _plain(pa.schema([reader.schema.field(n) for n in names]))
        for k in range(low, high):
            b = reader.get_batch(k)
            n = b.num_rows
            # row_block is the batch, so that no task needs to know the rows before it.
            place = {"file_idx": pa.array(np.full(n, i, np.int32)), "row_block": pa.array(np.full(n, k, np.int64)), "row_idx": pa.array(np.arange(n))}
            cols = [b.column(f.name).cast(f.type) for f in target] + [place[f.name] for f in _PLACE]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *place])


class ArrowSource(DataSource):
    """Option files: paths, one a line, all of the first one's schema; option columns: the columns to read, all without it."""

    @classmethod
    def name(cls):
        return "arrow_ipc"

    def _files(self):
        return self.options["files"].split("\n")

    def _columns(self):
        return self.options["columns"].split("\n") if "columns" in self.options else None

    def schema(self):
        s, columns = _plain(_open(self._files()[0]).schema), self._columns()
        return from_arrow_schema(pa.schema([*(f for f in s if columns is None or f.name in columns), *_PLACE]))

    def reader(self, schema):
        return ArrowReader(self._files(), self._columns())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrowSource)


def write_feather(events: DataFrame, folder: str) -> DataFrame:
    """Write each partition of a flat DataFrame as one Arrow IPC file in a folder that executors share; returns (path, rows)."""

    def run(batches):
        from pyspark import TaskContext

        path = f"{folder.rstrip('/')}/part-{TaskContext.get().partitionId():05d}.mbo.json.feather"
        system, inner = _system(path)
        system.create_dir(inner.rsplit("/", 1)[0])
        writer, rows = None, 0
        with system.open_output_stream(inner) as f:
            for b in batches:
                writer = writer or pa.ipc.new_file(f, b.schema)
                writer.write_batch(b)
                rows += b.num_rows
            if writer:
                writer.close()
        if writer is None:
            system.delete_file(inner)
        else:
            yield pa.RecordBatch.from_pydict({"path": [path], "rows": [rows]}, schema=pa.schema([("path", pa.string()), ("rows", pa.int64())]))

    return events.mapInArrow(run, "path string, rows long")
