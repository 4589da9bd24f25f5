"""Row shapes shared by every operator."""

from pyspark.sql import types as T

IDENTIFIER_TYPES = ("ipv4", "cidr", "hostname", "upn", "guid", "sid", "mac", "unc")
SCOPES = ("global", "project")

SPAN = T.StructType([
    T.StructField("start_pos", T.IntegerType()),
    T.StructField("end_pos", T.IntegerType()),
    T.StructField("value", T.StringType()),
])

FINDING = T.StructType([
    T.StructField("identifier_type", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("start_pos", T.IntegerType()),
    T.StructField("end_pos", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
])

MAP = T.StructType([
    T.StructField("identifier_type", T.StringType()),
    T.StructField("original_value", T.StringType()),
    T.StructField("anonymized_value", T.StringType()),
    T.StructField("scope", T.StringType()),
    T.StructField("preserve_format", T.BooleanType()),
])

FINDING_COLUMNS = FINDING.fieldNames()
MAP_COLUMNS = MAP.fieldNames()
