"""From raw findings to the inventory of distinct identifiers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmap.operators.detect import as_keys, find, select_kinds


def scan(df: DataFrame, key, text: str, types=None, extra=(),
         suppress_nested: bool = False) -> DataFrame:
    """Findings per document: host names inside an accepted user principal name dropped,
    the first finding per type and value kept.  Needs no shuffle."""
    kinds = select_kinds(types)
    return find(df, key, text, kinds, extra, hosts_in_upn="upn" not in kinds,
                suppress_nested=suppress_nested, first_per_value=True)


def documents_with_findings(findings: DataFrame, key) -> DataFrame:
    return findings.select(*as_keys(key)).distinct()


def unique_identifiers(findings: DataFrame, key) -> DataFrame:
    """One row per type and value with the confidence of its first finding, documents
    taken in key order.  Map-side aggregation reduces frequent values before the shuffle."""
    keys = as_keys(key)
    group = ["identifier_type", "value"]
    integral = len(keys) == 1 and isinstance(
        findings.schema[keys[0]].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    if integral:
        # Key, position and confidence packed into one decimal: a fixed-width buffer, so
        # Spark aggregates by hash and need not sort the raw findings.
        # A null key comes first, as in the order of structs.
        number = F.coalesce(F.col(keys[0]).cast("decimal(38,0)"), F.lit("-9223372036854775809").cast("decimal(38,0)"))
        packed = (number * F.lit(10**13).cast("decimal(38,0)")
                  + (F.col("start_pos").cast("bigint") * 1000
                     + F.round(F.col("confidence") * 100).cast("bigint")).cast("decimal(38,0)")
                  ).cast("decimal(38,0)")
        first = findings.groupBy(*group).agg(F.min(packed).alias("_first"))
        percent = F.pmod(F.col("_first"), F.lit(1000).cast("decimal(38,0)")).cast("int")
        return first.select(*group, (percent / F.lit(100.0)).alias("confidence"))
    return findings.groupBy(*group).agg(F.min_by(
        "confidence", F.struct(*keys, "start_pos")).alias("confidence"))


def report(identifiers: DataFrame) -> DataFrame:
    """The inventory as text, two decimals of confidence, in order."""
    return identifiers.select(
        "identifier_type", "value", F.format_number("confidence", 2).alias("confidence")
    ).orderBy("identifier_type", "value")


def type_counts(identifiers: DataFrame) -> DataFrame:
    return (identifiers.groupBy("identifier_type").agg(F.count("*").alias("n"))
            .orderBy("identifier_type"))


def approve(identifiers: DataFrame, types) -> DataFrame:
    """Identifiers of the approved types only."""
    return identifiers.where(F.col("identifier_type").isin(*as_keys(types)))
