"""Helpers shared by the operators of this subpackage."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows and keys live in two columns of one table that holds nothing else, so no column of
# the input can clash with a name used inside an operator.
ROW, KEY = "_row", "_key"


def row_key(doc_id: Column, text: Column) -> Column:
    """Identity of a document row that is never null: its id and a hash of its text.
    Rows equal in both count as one document."""
    return F.struct(doc_id.alias("id"), F.xxhash64(text).alias("h"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_row: all columns of the input, _key: identity)."""
    return docs.select(F.struct("*").alias(ROW), row_key(F.col(id_col), F.col(text_col)).alias(KEY))


def spread(df: DataFrame) -> int:
    """Partitions of a shuffle as the session sets them."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
