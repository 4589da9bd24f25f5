"""The translation map as a DataFrame: checks, merging, updates, inversion."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmap.schemas import IDENTIFIER_TYPES, MAP, MAP_COLUMNS, SCOPES


def violations(check_type: bool = False) -> Column:
    """Names of the entry rules a map row breaks."""
    original, fake = F.coalesce("original_value", F.lit("")), F.coalesce("anonymized_value", F.lit(""))
    rules = {
        "empty original_value": original == "",
        "empty anonymized_value": fake == "",
        "unknown scope": ~F.coalesce(F.col("scope").isin(*SCOPES), F.lit(False)),
        "values identical": original == fake,
    }
    if check_type:
        rules["unknown identifier_type"] = ~F.coalesce(
            F.col("identifier_type").isin(*IDENTIFIER_TYPES), F.lit(False))
    return F.array_compact(F.array(*[F.when(b, F.lit(n)) for n, b in rules.items()]))


def validate_map(m: DataFrame, check_type: bool = False) -> DataFrame:
    return m.withColumn("violations", violations(check_type))


def valid_entries(m: DataFrame, check_type: bool = False) -> DataFrame:
    return m.where(F.size(violations(check_type)) == 0)


def last_wins(m: DataFrame, by: str, order) -> DataFrame:
    """One row per `by`, the last in `order`; aggregated before the shuffle, so a value that occurs
    very often is no more work than others."""
    columns = m.columns
    newest = F.max_by(F.struct(*columns), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_newest")
    return m.groupBy(F.col(by).alias("_by")).agg(newest).select("_newest.*")


def distinct_entries(m: DataFrame) -> DataFrame:
    """One entry per original value.  Of several the project's is taken, then the greatest fake."""
    return last_wins(m.select(MAP_COLUMNS), "original_value", [
        F.col("scope"), F.col("anonymized_value"), F.col("identifier_type"), F.col("preserve_format")])


def merge_maps(global_map: DataFrame, project_map: DataFrame) -> DataFrame:
    """All entries; on the same original the project entry wins, whatever its type."""
    return upsert_entries(global_map, project_map)


def upsert_entries(m: DataFrame, new: DataFrame, on_conflict: str = "replace") -> DataFrame:
    """Add entries by original value; `replace` prefers the new ones, `keep` the old.  Within either
    map an original that occurs several times counts once, as `distinct_entries` says."""
    if on_conflict not in ("replace", "keep"):
        raise ValueError(f"on_conflict must be 'replace' or 'keep', got {on_conflict!r}")
    ranked = m.select(*MAP_COLUMNS, F.lit(on_conflict == "keep").alias("_first")).unionByName(
        new.select(*MAP_COLUMNS, F.lit(on_conflict == "replace").alias("_first")))
    return last_wins(ranked, "original_value", [
        F.col("_first"), F.col("scope"), F.col("anonymized_value"), F.col("identifier_type"),
        F.col("preserve_format")]).select(MAP_COLUMNS)


def manual_entry(spark: SparkSession, identifier_type: str, original: str, fake: str) -> DataFrame:
    """One checked hand-written project entry."""
    entry = spark.createDataFrame([(identifier_type, original, fake, "project", True)], MAP)
    broken = entry.select(violations(check_type=True).alias("v")).head()["v"]
    if broken:
        raise ValueError(f"invalid map entry: {', '.join(broken)}")
    return entry


def add_mapping(m: DataFrame, identifier_type: str, original: str, fake: str) -> DataFrame:
    return upsert_entries(m, manual_entry(m.sparkSession, identifier_type, original, fake))


def show_map(global_map: DataFrame, project_map: DataFrame, scope: str = "merged") -> DataFrame:
    columns = ["identifier_type", "original_value", "anonymized_value", "scope"]
    if scope == "global":
        return global_map.select(columns)
    if scope == "project":
        return project_map.select(columns)
    if scope == "merged":
        return merge_maps(global_map, project_map).select(columns)
    raise ValueError(f"scope must be 'global', 'project' or 'merged', got {scope!r}")


def mapping(m: DataFrame) -> DataFrame:
    return m.select("original_value", "anonymized_value")


def invert(m: DataFrame, order=None) -> DataFrame:
    """Fake to original.  Of several originals with one fake the last wins, in `order`
    if given, else global before project and then by original."""
    order = order or [F.col("scope"), F.col("original_value")]
    return last_wins(m, "anonymized_value", order).select(
        "identifier_type", F.col("anonymized_value").alias("original_value"),
        F.col("original_value").alias("anonymized_value"), "scope", "preserve_format")


def to_text_rows(m: DataFrame) -> DataFrame:
    """Map rows as five text columns."""
    return m.select(*[F.col(c).cast("string") for c in MAP_COLUMNS[:4]],
                    F.lower(F.col("preserve_format").cast("string")).alias("preserve_format"))


def from_text_rows(rows: DataFrame) -> DataFrame:
    """Five text columns as map rows: cells stripped, the flag true only for "true"."""
    stripped = {c: F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", "") for c in MAP_COLUMNS}
    return rows.withColumns(stripped).withColumn(
        "preserve_format", F.coalesce(F.lower("preserve_format") == "true", F.lit(False)))
