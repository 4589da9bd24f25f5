"""Where intermediate results that are used several times are kept."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it in `spark.checkpoint.dir`.

    Where the driver is the only executor, a temporary folder is made if none is named, and
    deleted at exit.  On a cluster that names none, each executor would write to a disk of its own, so
    that is an error.
    """
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set {_SETTING} to a folder that the driver and all executors share")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="veilmap-"))
        atexit.register(shutil.rmtree, _local_folder[0], ignore_errors=True)
    return _local_folder[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/veilmap-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts the lineage, survives lost executors, and gives the
    optimizer true sizes for its join choices."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, prefix: str = "veilmap-") -> int:
    """Deletes what this package has written to the shared folder, once no result is needed any
    more: intermediates hold original values in clear.  Returns how many entries went."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{prefix}*")) or []
    return sum(bool(fs.delete(s.getPath(), True)) for s in found)
