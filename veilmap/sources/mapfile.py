"""The translation map as CSV."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmap.operators.maps import from_text_rows, last_wins, to_text_rows, valid_entries, validate_map
from veilmap.schemas import MAP, MAP_COLUMNS

# Doubled quotes, not backslashes, escape a quote: UNC paths are full of backslashes.
FILE_ROWS = 200_000
_CSV = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


def _rows(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        raw = spark.read.options(multiLine=True, **_CSV).csv(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    order = [F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line")]
    return from_text_rows(raw.select(*MAP_COLUMNS, *order))


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """Valid rows, the last one per original value; a missing file is an empty map.
    Rows that break a rule are left out, see `rejected_rows`."""
    rows = _rows(spark, path)
    if rows is None:
        return spark.createDataFrame([], MAP)
    latest = last_wins(valid_entries(rows), "original_value", [F.col("_file"), F.col("_line")])
    return latest.select(MAP_COLUMNS)


def rejected_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows `read_map` leaves out, with the rules they break."""
    rows = _rows(spark, path)
    if rows is None:
        return validate_map(spark.createDataFrame([], MAP))
    return validate_map(rows).where(F.size("violations") > 0).select(*MAP_COLUMNS, "violations")


def write_rows(rows: DataFrame, path: str, order=None, **options) -> None:
    """Overwrite `path` with CSV part files of at most `FILE_ROWS` rows, which are read by one task each.
    With `order` (columns) the files' names are in the order of the rows, which is what `read_map` goes by."""
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select(MAP_COLUMNS).write.mode("overwrite").options(
        emptyValue="", maxRecordsPerFile=FILE_ROWS, **_CSV, **options).csv(path)


def write_map(m: DataFrame, path: str, single_file: bool = False, order=None) -> None:
    """Overwrite `path` with CSV part files, in `order` if given; `single_file` puts a small map into one."""
    rows = to_text_rows(m)
    write_rows(rows.coalesce(1) if single_file else rows, path, order)
