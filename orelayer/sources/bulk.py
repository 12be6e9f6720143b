"""Bulk loads in chunks that are committed one by one: a load that fails keeps its chunks, and the next run goes on after them.

A data source writer puts every ``commit_every`` rows of a task into a file under a temporary name, which a rename commits. Rows are dealt and sorted
by their key, so the chunks of a partition are the same on every run: a task first lists those that are there and skips their rows.
Two attempts of one task write the same chunk, so neither a retry nor a speculative copy doubles a row. When all tasks are done, the
driver writes the ledger: the chunks with their rows, as the tasks told them; until then the load counts as unfinished.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "orelayer_chunks"
# A column of rows on their way to the writer, never stored: why a row is refused.
REFUSED = "_orelayer_refused"


@dataclass
class Chunks(WriterCommitMessage):
    """What a task has committed: file names with their rows, and how many of them were there before."""

    rows: dict[str, int]
    found: int


class ChunkWriter(DataSourceArrowWriter):
    def __init__(self, path: str, commit_every: int, refuses: bool):
        self.path, self.commit_every, self.refuses = path, commit_every, refuses

    def _folder(self) -> tuple[fs.FileSystem, str]:
        files, root = fs.FileSystem.from_uri(self.path)
        return files, root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Chunks:
        files, root = self._folder()
        part = TaskContext.get().partitionId()
        prefix = f"part-{part:06d}-"
        there = {}
        for info in files.get_file_info(fs.FileSelector(f"{root}/chunks", allow_not_found=True)):
            if info.base_name.startswith(prefix) and info.base_name.endswith(".parquet"):
                with files.open_input_file(info.path) as f:
                    there[info.base_name] = pq.ParquetFile(f).metadata.num_rows
        told: dict[str, int] = {}
        held: list[pa.RecordBatch] = []
        size = 0

        def commit(rows: pa.Table) -> None:
            name = f"{prefix}{len(told):08d}.parquet"
            if name not in there:
                # The name of an attempt of its own, outside the folder of chunks, until the chunk is whole.
                draft = f"{root}/drafts/{uuid.uuid4().hex}"
                with files.open_output_stream(draft) as f:
                    pq.write_table(rows, f)
                files.move(draft, f"{root}/chunks/{name}")
            elif there[name] != rows.num_rows:
                raise ValueError(f"chunk {name} has {there[name]} rows, this run gives it {rows.num_rows}: the source has changed since")
            told[name] = rows.num_rows

        for batch in iterator:
            refused = None
            if self.refuses:
                reasons, batch = batch.column(REFUSED), batch.drop_columns([REFUSED])
                if reasons.null_count < len(reasons):
                    at = reasons.is_valid().index(True).as_py()
                    refused, batch = reasons[at].as_py(), batch.slice(0, at)
            held.append(batch)
            size += batch.num_rows
            while size >= self.commit_every:
                rows = pa.Table.from_batches(held)
                commit(rows.slice(0, self.commit_every))
                rest = rows.slice(self.commit_every)
                held, size = rest.to_batches(), rest.num_rows
            if refused is not None:
                raise ValueError(f"refused: {refused}")
        if size:
            commit(pa.Table.from_batches(held))
        if extra := set(there) - set(told):
            raise ValueError(f"chunks that this run does not have: {sorted(extra)[:3]}; the source has changed since")
        return Chunks(told, len(set(told) & set(there)))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = self._folder()
        chunks = {name: rows for m in messages if m for name, rows in m.rows.items()}
        ledger = {"rows": sum(chunks.values()), "found": sum(m.found for m in messages if m), "chunks": chunks}
        with files.open_output_stream(f"{root}/drafts/ledger") as f:
            f.write(json.dumps(ledger).encode())
        files.move(f"{root}/drafts/ledger", f"{root}/ledger.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Chunks stay: they are what the next run goes on from."""


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(self.options["path"], int(self.options["commit_every"]), REFUSED in schema.names)


def bulk_load(df: DataFrame, path: str, keys: Sequence[str], *, partitions: int, commit_every: int = 1000, must_hold: Column | None = None) -> dict:
    """Load ``df`` into ``path``, a folder or URI that all executors reach; returns the ledger.

    A row for which ``must_hold`` does not hold ends the run, as a constraint of a database does; the chunks before it stay: the
    writer itself refuses the row, after it has committed them.
    ``keys`` tell rows apart: with them the same rows make the same chunks. A load that is finished is not repeated. A run with other
    keys, partitions or chunk sizes than the one that began is an error.
    """
    files, root = fs.FileSystem.from_uri(path)
    for folder in ("chunks", "drafts"):
        files.create_dir(f"{root}/{folder}")
    layout = {"keys": list(keys), "partitions": partitions, "commit_every": commit_every}
    if (began := _json(files, f"{root}/layout.json")) not in (None, layout):
        raise ValueError(f"this load began with {began}")
    if done := ledger(path):
        return done
    with files.open_output_stream(f"{root}/layout.json") as f:
        f.write(json.dumps(layout).encode())
    df.sparkSession.dataSource.register(ChunkSource)
    dealt = df.repartition(partitions, *keys).sortWithinPartitions(*keys)
    if must_hold is not None:
        dealt = dealt.withColumn(REFUSED, F.when(~must_hold | must_hold.isNull(), F.to_json(F.struct(*keys))))
    # Rows come to the writer a chunk at a time, so that a row that fails does not take whole chunks before it along.
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, min(commit_every, int(before)))
    try:
        dealt.write.format(FORMAT).option("path", path).option("commit_every", commit_every).mode("append").save()
    finally:
        conf.set(name, before)
    return ledger(path)


def ledger(path: str) -> dict | None:
    """Rows, chunks, and chunks that earlier runs had committed; None while the load is unfinished."""
    files, root = fs.FileSystem.from_uri(path)
    return _json(files, f"{root}/ledger.json")


def _json(files: fs.FileSystem, path: str) -> dict | None:
    if files.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(path) as f:
        return json.loads(f.read())


def loaded(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of the committed chunks, of a finished load or of one that is not."""
    return spark.read.schema(schema).parquet(f"{path}/chunks")
