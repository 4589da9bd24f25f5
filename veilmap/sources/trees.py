"""File trees listed, read and written by tasks."""

import os
import posixpath
import sys
import uuid
from collections import deque
from urllib.parse import urlparse

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmap.sources.storage import materialize

# Functions for Python workers travel with the job, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])

# A task lists about so many folders before it hands the rest on.
FOLDERS = 500
_ROWS = 10_000
READ_BYTES = 16 << 20
TASK_BYTES = 128 << 20


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder: a plain path, or a URI of any scheme that Arrow's file
    systems serve (file, hdfs, viewfs, s3, gs, abfs); others are an error."""
    scheme = urlparse(uri).scheme
    if not scheme or len(scheme) == 1:
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    try:
        return pafs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid as e:
        raise ValueError(f"cannot write or read file trees at {uri!r}: {e}") from e


def existing_folder(uri: str) -> str:
    """The folder as a URI without a slash at the end; an error if it is missing or a file."""
    filesystem, base = open_folder(uri)
    kind = filesystem.get_file_info(base).type
    if kind == pafs.FileType.NotFound:
        raise FileNotFoundError(f"target directory does not exist: {uri}")
    if kind != pafs.FileType.Directory:
        raise NotADirectoryError(f"target path is not a directory: {uri}")
    return f"file:{base}" if isinstance(filesystem, pafs.LocalFileSystem) else uri.rstrip("/")


def _suffix(name: str) -> str:
    return name[name.rfind("."):].lower() if name.rfind(".") > 0 else ""


def _expand(uri: str, extensions: set[str]):
    """Files below the folders of each batch, and the folders that the task has not come to."""
    def run(batches):
        filesystem, base = open_folder(uri)
        base = base.rstrip("/")
        local = isinstance(filesystem, pafs.LocalFileSystem)

        def listed(folder: str) -> tuple[list, list]:
            files, folders = [], []
            for info in filesystem.get_file_info(pafs.FileSelector(posixpath.join(base, folder) if folder else base)):
                relative = info.path[len(base) + 1:]
                if info.type == pafs.FileType.Directory:
                    # A link to a folder could lead back up.
                    if not (local and os.path.islink(info.path)):
                        folders.append(relative)
                elif info.type == pafs.FileType.File and _suffix(info.base_name) in extensions:
                    files.append((relative, info.size))
            return files, folders

        def rows(files, folders):
            names = [f for f, _ in files] + [None] * len(folders)
            return pd.DataFrame({"relative_path": pd.Series(names, dtype=object),
                                 "size": pd.Series([s for _, s in files] + [0] * len(folders), dtype="int64"),
                                 "folder": pd.Series([None] * len(files) + folders, dtype=object)})

        waiting, given, done, held = deque(), 0, 0, []
        for batch in batches:
            waiting.extend(batch["folder"])
        given = len(waiting)
        while waiting and done < max(given, FOLDERS):
            files, folders = listed(waiting.popleft())
            done += 1
            waiting.extend(folders)
            held += files
            while len(held) >= _ROWS:
                yield rows(held[:_ROWS], [])
                held = held[_ROWS:]
        yield rows(held, [])
        rest = list(waiting)
        for at in range(0, len(rest), _ROWS):
            yield rows([], rest[at:at + _ROWS])
    return run


def list_files(spark: SparkSession, uri: str, extensions) -> DataFrame:
    """(relative_path, size) of the files below a folder whose name ends in one of `extensions`, in any case;
    hidden names are names like others, links to folders are not followed.

    Folders not yet listed are a table.  Each round deals it to the tasks; a task lists its folders and
    what it finds below them, up to `FOLDERS`, and hands on the rest.  The driver sees one count a round.
    """
    wanted = {e.lower() for e in extensions}
    frontier, found = spark.createDataFrame([("",)], "folder string"), []
    while True:
        step = materialize(frontier.mapInPandas(
            _expand(uri, wanted), "relative_path string, size long, folder string"), "listing")
        found.append(step.where("relative_path is not null").select("relative_path", "size"))
        frontier = step.where("folder is not null").select("folder")
        left = frontier.count()
        if not left:
            break
        tasks = max(spark.sparkContext.defaultParallelism, left // FOLDERS)
        frontier = frontier.repartition(min(left, tasks))
    files = found[0]
    for more in found[1:]:
        files = files.unionByName(more)
    return files


def _read(uri: str):
    def run(batches):
        filesystem, base = open_folder(uri)
        names, contents, size = [], [], 0

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["relative_path", "content"])

        for batch in batches:
            for relative in batch.column("relative_path").to_pylist():
                with filesystem.open_input_stream(posixpath.join(base, relative), compression=None) as f:
                    content = f.read()
                if names and size + len(content) > READ_BYTES:
                    yield out()
                    names, contents, size = [], [], 0
                names.append(relative)
                contents.append(content)
                size += len(content)
        yield out()
    return run


def read_files(files: DataFrame, uri: str) -> DataFrame:
    """(relative_path, content) of listed files, dealt to tasks of about `TASK_BYTES`, a few megabytes held at a time."""
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    tasks = max(1, min(total[1], max(files.sparkSession.sparkContext.defaultParallelism, -(-total[0] // TASK_BYTES))))
    return files.select("relative_path").repartition(tasks).mapInArrow(_read(uri), "relative_path string, content binary")


def _stage(uri: str):
    """Writes each content below a folder; returns (path, relative_path, success)."""
    def run(batches):
        filesystem, base = open_folder(uri)
        for batch in batches:
            done = []
            for relative, content in zip(batch["relative_path"], batch["content"]):
                ok = content is not None
                if ok:
                    target = posixpath.join(base, relative)
                    # A task that runs twice leaves whole files.
                    part = f"{target}.part-{uuid.uuid4().hex}"
                    try:
                        filesystem.create_dir(posixpath.dirname(target), recursive=True)
                        with filesystem.open_output_stream(part, compression=None) as f:
                            f.write(content)
                        filesystem.move(part, target)
                    except OSError:
                        ok = False
                done.append(ok)
            yield batch[["path", "relative_path"]].assign(success=done)
    return run


def _publish(staged: str, uri: str):
    """Moves staged files into a folder that exists; a move that was done before counts as done."""
    def run(batches):
        filesystem, source = open_folder(staged)
        _, target = open_folder(uri)
        for batch in batches:
            done = []
            for relative, ok in zip(batch["relative_path"], batch["success"]):
                if ok:
                    a, b = posixpath.join(source, relative), posixpath.join(target, relative)
                    try:
                        if filesystem.get_file_info(a).type == pafs.FileType.File:
                            filesystem.create_dir(posixpath.dirname(b), recursive=True)
                            filesystem.move(a, b)
                        else:
                            ok = filesystem.get_file_info(b).type == pafs.FileType.File
                    except OSError:
                        ok = False
                done.append(ok)
            yield batch[["path"]].assign(success=done)
    return run


def write_files(rows: DataFrame, uri: str) -> DataFrame:
    """Writes (path, relative_path, content) as files below a folder and returns (path, success).

    All files are staged beside the folder first.  If that job fails, the staged files are deleted and the
    folder is as it was.  Then they are published: by one rename where the folder does not exist yet, else
    file by file in tasks.  A null content, or a file that cannot be written, is a failure in the status.
    """
    filesystem, base = open_folder(uri)
    base = base.rstrip("/")
    staged = f"{uri.rstrip('/')}.staged-{uuid.uuid4().hex}"
    _, place = open_folder(staged)
    try:
        status = materialize(rows.mapInPandas(_stage(staged), "path string, relative_path string, success boolean"), "status")
        if filesystem.get_file_info(base).type == pafs.FileType.NotFound:
            filesystem.create_dir(place, recursive=True)
            try:
                filesystem.move(place, base)
                return status.select("path", "success")
            except (OSError, NotImplementedError):
                pass  # a store without renames of folders
        return materialize(status.mapInPandas(_publish(staged, uri), "path string, success boolean"), "status")
    finally:
        if filesystem.get_file_info(place).type == pafs.FileType.Directory:
            filesystem.delete_dir(place)
