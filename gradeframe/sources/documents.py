"""Keyed documents (S13, S17, S18, S22): one file per key at a path that a column names.

``partitionBy`` can only make a folder per key with part files in it; tools
that read ``raw_output/<qid>/test_case_results.json`` need the file itself. The
rows of a document are pieces of its text. They are dealt by path and sorted by
position, and a data source writer streams them into one file, so a document
of any length never stands in memory and a task has one file open at a time.

Writing is all or nothing. Tasks write below a job folder that no scan looks
into; a task that fails removes what it wrote, a job that fails removes the job
folder. Only after all tasks have committed does a second Spark job move the
files to their paths, each move by the task that has its line of the manifest.
Moving is repeatable, so a lost executor or a broken run (``publish`` again)
leaves no half document, and a document that replaces another does so at once.

Files are written by the Python workers through ``pyarrow.fs`` (mounted
folders, HDFS, S3, GCS); the root must be a shared one, as for any sink.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

PIECES = "path string, part long, piece string"


def file_system(root: str):
    """(file system, path) of a folder given as a path or URI."""
    from pyarrow import fs
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root[len("file:"):].lstrip("/")
    if "://" not in root:
        return fs.LocalFileSystem(), root
    return fs.FileSystem.from_uri(root)


def remove_job(job: str, tries: int = 20) -> None:
    """Remove a job folder; tasks that are still being stopped may come in between, so more than once."""
    from pyarrow.fs import FileType
    fs, at = file_system(job)
    for k in range(tries):
        if fs.get_file_info(at).type == FileType.NotFound:
            return
        try:
            fs.delete_dir(at)
        except OSError:
            if k == tries - 1:
                raise
            time.sleep(0.1)


def checked(path: str | None) -> str:
    """A path below the root whose every part can be a file name that scans see."""
    parts = (path or "").split("/")
    if any(p in ("", ".", "..") or p[0] in "_." or "\0" in p for p in parts):
        raise ValueError(f"{path!r} is no path of a document: empty or hidden parts are none")
    return path


@dataclass
class Attempt(WriterCommitMessage):
    name: str


class DocumentWriter(DataSourceArrowWriter):
    """Rows (PIECES) sorted by path and part -> staged files and a manifest per task attempt."""

    def __init__(self, job: str):
        self.job = job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        fs, job = file_system(self.job)
        name = uuid.uuid4().hex
        folder, manifest = f"{job}/{name}", f"{job}/manifest-{name}.json"
        made, out, path = [], None, None
        try:
            fs.create_dir(folder, recursive=False)         # fails once the job folder is gone: a late task brings nothing back
            with fs.open_output_stream(manifest) as lines:
                for b in iterator:
                    for p, piece in zip(b.column("path").to_pylist(), b.column("piece"), strict=True):
                        if out is None or p != path:
                            if out is not None:
                                out.close()
                            path, staged = p, f"{name}/{len(made)}"
                            made.append(staged)
                            out = fs.open_output_stream(f"{job}/{staged}")
                            lines.write((json.dumps({"staged": staged, "path": checked(p)}) + "\n").encode())
                        if piece.is_valid:
                            out.write(piece.as_buffer())
                if out is not None:
                    out.close()
        except BaseException:
            with contextlib.suppress(OSError):             # the job may have been removed meanwhile
                if out is not None:
                    out.close()
                fs.delete_dir(folder)
                fs.delete_file(manifest)
            raise
        return Attempt(name)

    def commit(self, messages: list[Attempt | None]) -> None:
        """Name the attempts that count: one per task, so their number is bounded by the tasks."""
        fs, job = file_system(self.job)
        with fs.open_output_stream(f"{job}/attempts") as f:
            f.write("".join(f"{m.name}\n" for m in messages if m is not None).encode())

    def abort(self, messages: list[Attempt | None]) -> None:
        remove_job(self.job)


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gradeframe_documents"

    def schema(self) -> str:
        return PIECES

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["job"])


def publish(spark: SparkSession, root: str, job: str) -> None:
    """Move the staged files of a committed job to their paths and remove the job folder. May be repeated."""
    from ..session import ship_package
    ship_package(spark)
    fs, at = file_system(job)
    with fs.open_input_stream(f"{at}/attempts") as f:
        attempts = f.read().decode().split()

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileType
        fs, top = file_system(root)
        _, staged_in = file_system(job)
        for b in batches:
            for row in b.to_pylist():
                staged, path = f"{staged_in}/{row['staged']}", f"{top}/{row['path']}"
                if fs.get_file_info(staged).type == FileType.NotFound:
                    continue                       # moved by an earlier attempt
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                if fs.type_name == "hdfs" and fs.get_file_info(path).type != FileType.NotFound:
                    fs.delete_file(path)           # others replace the file in one step
                fs.move(staged, path)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["moved"])

    if attempts:
        manifests = spark.read.schema("staged string, path string").json([f"{job}/manifest-{a}.json" for a in attempts])
        manifests.mapInArrow(move, "moved long").agg(F.sum("moved")).collect()
    fs.delete_dir(at)


def write_documents(pieces: DataFrame, root: str) -> None:
    """Write PIECES rows as one file per ``path`` below ``root``: the pieces in the order of ``part``.

    Equal positions are ordered by their text; null pieces are empty, so a path
    whose only piece is null or empty gives an empty file; no rows write
    nothing. Other files below the root stay, one at the same path is replaced.
    A path with an empty or hidden part (``_``, ``.``) is an error, and nothing
    is written then.
    """
    from ..session import ship_package
    spark = pieces.sparkSession
    ship_package(spark)
    spark.dataSource.register(DocumentSource)
    job = f"{root.rstrip('/')}/_documents-{uuid.uuid4().hex}"
    fs, at = file_system(job)
    fs.create_dir(at, recursive=True)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.select(F.col("path").cast("string"), F.col("part").cast("long"), F.col("piece").cast("string"))
    ordered = rows.repartition(tasks, "path").sortWithinPartitions("path", "part", "piece")
    try:
        ordered.write.format(DocumentSource.name()).option("job", job).mode("append").save()
    except Exception:
        remove_job(job)              # what a task still wrote while the job was given up
        raise
    publish(spark, root, job)


def whole(path: Column, doc: Column) -> list[Column]:
    """The columns of a document of one piece."""
    return [path.alias("path"), F.lit(0).cast("long").alias("part"), doc.alias("piece")]
