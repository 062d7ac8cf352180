"""Export of texts as files ``<pk>.md``, one each, through Spark's interface for data sources in Python.

Tasks write below a staging folder of the run; when all have succeeded other tasks move the files to their places, one
rename each and a staged folder a task, and where one fails to write the staging folder goes and nothing has changed. So a
repeated or lost task leaves no half file; the driver sees the names of folders only, not of files. A file of the same pk is replaced, others stay. Meant for exports that people read; tables are for the rest.

Paths are those of pyarrow's file systems (local, HDFS, object stores), seen by the driver and all executors. Letters and
digits of a pk and ``-_.`` stay as they are, other bytes are percent-encoded; of several texts of one pk the greatest
counts; null pks and texts make no file. ``scan_markdown`` reads them again: one task lists the folder, a batch of names at a time,
and others open the files, so here too the driver sees no file, where Spark's own reader holds the state of each in it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..session import existing, ship
from .files import decoded

NAME = "markdown_files"

#: Names that are listed at once, bytes of files that a task holds, about, and tasks for each core that open files.
NAMES, HELD, TASKS = 10_000, 8_000_000, 8


def _source():
    """The data source's class; made here, so that it is sent to workers by value."""

    @dataclass
    class Staged(WriterCommitMessage):
        folder: str

    def opened(path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path)

    class Writer(DataSourceWriter):
        def __init__(self, path: str, run: str):
            self.path, self.run = path, run

        def write(self, iterator):
            from urllib.parse import quote

            from pyspark import TaskContext

            system, base = opened(self.path)
            folder = f"{base}/_staged-{self.run}/{TaskContext.get().taskAttemptId()}"
            system.create_dir(folder)
            for row in iterator:
                name = quote(row["pk"], safe="-_.") + ".md"
                with system.open_output_stream(f"{folder}/{name}") as out:
                    out.write(row["text"].encode())
            return Staged(folder)

        def commit(self, messages):
            system, base = opened(self.path)
            system.create_dir(f"{base}/_staged-{self.run}")
            with system.open_output_stream(f"{base}/_staged-{self.run}/written") as out:
                out.write("\n".join(x.folder for x in messages if x).encode())

        def abort(self, messages):
            from pyarrow import fs

            system, base = opened(self.path)
            if system.get_file_info(f"{base}/_staged-{self.run}").type != fs.FileType.NotFound:
                system.delete_dir(f"{base}/_staged-{self.run}")

    class Files(DataSource):
        @classmethod
        def name(cls):
            return NAME

        def writer(self, schema, overwrite):
            return Writer(self.options["path"], self.options["run"])

    return Files


def _mover(path: str):
    """Moves the files of staged folders; a repeated task moves those that are left."""

    def move(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(path)
        for b in batches:
            moved = 0
            for folder in b.column(0).to_pylist():
                for info in system.get_file_info(fs.FileSelector(folder)):
                    system.move(info.path, f"{base}/{info.base_name}")
                    moved += 1
            yield pa.RecordBatch.from_arrays([pa.array([moved], pa.int64())], names=["moved"])

    return move


def export_markdown(rows: DataFrame, path: str, pk_col: str = "pk", text_col: str = "text") -> None:
    """A file for each pk of ``rows`` below ``path``, a URI."""
    from pyarrow import fs

    spark = rows.sparkSession
    spark.dataSource.register(_source())
    path, run = path.rstrip("/"), uuid.uuid4().hex
    known = rows.select(F.col(pk_col).cast("string").alias("pk"), F.col(text_col).cast("string").alias("text")).where("pk is not null and text is not null")
    known.groupBy("pk").agg(F.max("text").alias("text")).write.format(NAME).mode("append").option("path", path).option("run", run).save()
    system, base = fs.FileSystem.from_uri(path)
    with system.open_input_stream(f"{base}/_staged-{run}/written") as told:
        folders = told.read().decode().split("\n")
    folders = [x for x in folders if x]
    if folders:  # as many as there were tasks
        staged = spark.createDataFrame([(i, x) for i, x in enumerate(folders)], "n int, folder string").repartitionById(len(folders), "n")
        staged.select("folder").mapInArrow(_mover(path), "moved long").agg(F.sum("moved")).collect()
    system.delete_dir(f"{base}/_staged-{run}")


def _names(path: str):
    """Names of the markdown files in a folder; of a local one, which may be a shared mount, never all at once."""

    def found():
        import os

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(path)
        if isinstance(system, fs.LocalFileSystem):
            with os.scandir(base) as entries:
                yield from (e.name for e in entries if e.is_file())
        else:
            yield from (x.base_name for x in system.get_file_info(fs.FileSelector(base)) if x.type == fs.FileType.File)

    def listed(batches):
        from itertools import islice

        import pyarrow as pa

        for b in batches:
            names = (x for _ in range(b.num_rows) for x in found() if x.endswith(".md"))
            while some := list(islice(names, NAMES)):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["name"])

    return listed


def _opened(path: str):
    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(path)
        rows = lambda held: pa.RecordBatch.from_arrays([pa.array([f"{path}/{n}" for n, _ in held], pa.string()), pa.array([x for _, x in held], pa.binary())], names=["path", "content"])
        for b in batches:
            held, size = [], 0
            for name in b.column(0).to_pylist():
                with system.open_input_stream(f"{base}/{name}") as told:
                    held.append((name, told.read()))
                size += len(held[-1][1])
                if size >= HELD:
                    yield rows(held)
                    held, size = [], 0
            if held:
                yield rows(held)

    return read


def scan_markdown(spark: SparkSession, path: str) -> DataFrame:
    """source, text, error of every file ``*.md`` in the folder ``path``, as ``scan_texts`` has them, empty ones too."""
    ship(spark)
    path = path.rstrip("/")
    if not existing(spark, [path]):
        return spark.createDataFrame([], "source string, text string, error string")
    names = spark.range(0, 1, 1, 1).mapInArrow(_names(path), "name string")
    tasks = TASKS * spark.sparkContext.defaultParallelism
    return decoded(names.repartition(tasks, "name").mapInArrow(_opened(path), "path string, content binary"))
