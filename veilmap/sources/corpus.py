"""Texts from file trees and tables, and back."""

import os
import posixpath
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmap.operators.detect import as_keys
from veilmap.sources.trees import existing_folder, list_files, open_folder, read_files, write_files

# Extensions read by default.
DEFAULT_EXTENSIONS = (".log", ".txt", ".md", ".ps1")


def check_extensions(extensions) -> list[str]:
    extensions = as_keys(extensions)
    if not extensions:
        raise ValueError("extensions cannot be empty")
    for e in extensions:
        if not e.startswith("."):
            raise ValueError(f"extensions must start with '.', got {e!r}")
    return extensions


def has_extension(path: Column, extensions=DEFAULT_EXTENSIONS) -> Column:
    """The last suffix of the file name, any case, is one of `extensions`.
    A name that only starts with a dot has no suffix."""
    suffix = F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)
    return F.lower(suffix).isin(*check_extensions(extensions))


def read_corpus(spark: SparkSession, path: str, extensions=DEFAULT_EXTENSIONS) -> DataFrame:
    """(path, relative_path, text, readable) for every matching file below `path`, whatever its name.

    The tree is listed by tasks and once for all names; contents of other files are never read.
    `text` is null and `readable` false where the bytes are not UTF-8.
    """
    extensions = check_extensions(extensions)
    top = existing_folder(path)
    files = read_files(list_files(spark, top, extensions), top)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select(F.concat(F.lit(f"{top}/"), "relative_path").alias("path"), "relative_path", text.alias("text")).withColumn(
        "readable", F.col("text").isNotNull())


def corpus_from_table(df: DataFrame, key, text: str) -> DataFrame:
    """Key and whole text of any table; other columns are pruned from the scan."""
    return df.select(*as_keys(key), F.col(text).alias("text"))


def relative_to(path: Column, root: str) -> Column:
    """The part of `path` below `root`, null outside of it."""
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(root)), F.substring(path, len(root) + 1, 2**31 - 1))


def check_output(source: str, out: str) -> None:
    """The output folder must not be the source folder or lie inside it."""
    def place(uri: str) -> tuple[str, str, str]:
        parts = urlparse(uri)
        if parts.scheme in ("", "file") or len(parts.scheme) == 1:
            return "file", "", os.path.realpath(open_folder(uri)[1])
        return parts.scheme, parts.netloc, posixpath.normpath(parts.path or "/")
    a, b = place(source), place(out)
    if a[:2] == b[:2] and posixpath.commonpath([a[2], b[2]]) == a[2]:
        raise ValueError(f"output {out!r} cannot be inside the source {source!r}")


def write_corpus(df: DataFrame, out: str, text: str = "text") -> None:
    """Texts as a table keyed by relative path."""
    df.select("relative_path", F.col(text).alias("text")).write.mode("overwrite").parquet(out)


def export_tree(df: DataFrame, out: str, text: str = "text") -> DataFrame:
    """One file per row (text or bytes) below `out`, a folder all executors reach, given as path or
    URI; returns (path, success).  A null content or a file that cannot be written is a failure.

    A run that dies leaves `out` as it was: see `trees.write_files`.
    """
    open_folder(out)  # an unknown scheme is an error before anything runs
    return write_files(df.select("path", "relative_path", F.col(text).cast("binary").alias("content")), out)


def run_report(status: DataFrame) -> DataFrame:
    """One row: how many files were processed, how many succeeded and failed."""
    return status.agg(F.count("*").alias("processed"),
                      F.count_if("success").alias("success"),
                      F.count_if(~F.col("success")).alias("failed"))


def failed_paths(status: DataFrame) -> DataFrame:
    return status.where(~F.col("success")).select("path")
