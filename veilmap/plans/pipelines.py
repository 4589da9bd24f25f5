"""Whole runs over file trees: discover, anonymise, reveal."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmap.operators.findings import approve, scan, unique_identifiers
from veilmap.operators.generate import generate_map
from veilmap.operators.maps import merge_maps, upsert_entries
from veilmap.operators.replace import anonymize, reveal
from veilmap.sources.corpus import DEFAULT_EXTENSIONS, check_output, export_tree, read_corpus
from veilmap.sources.storage import materialize


def scan_tree(spark: SparkSession, source: str, extensions=DEFAULT_EXTENSIONS, types=None) -> DataFrame:
    """Distinct identifiers of the readable files below `source`."""
    files = read_corpus(spark, source, extensions)
    return unique_identifiers(scan(files, "relative_path", "text", types), "relative_path")


def grow_map(project_map: DataFrame, identifiers: DataFrame, approved=None, on_conflict: str = "keep",
             **rules) -> DataFrame:
    """The project map with fakes for the (approved) identifiers.

    `keep` leaves mapped originals alone, so earlier outputs stay revealable; `replace`
    draws new fakes for them.
    """
    wanted = identifiers if approved is None else approve(identifiers, approved)
    if on_conflict == "replace":
        renewed = project_map.join(
            wanted.select(F.col("value").alias("original_value")), "original_value", "left_anti")
        return upsert_entries(project_map, generate_map(wanted, renewed, **rules))
    return upsert_entries(project_map, generate_map(wanted, project_map, **rules), "keep")


def _rewrite(spark, source, out, m, extensions, rewrite) -> DataFrame:
    check_output(source, out)
    files = read_corpus(spark, source, extensions)
    return export_tree(rewrite(files, m, "text", "path"), out)


def anonymize_tree(spark: SparkSession, source: str, out: str, global_map: DataFrame,
                   project_map: DataFrame, extensions=DEFAULT_EXTENSIONS) -> DataFrame:
    """Writes the anonymised files below `out`; returns (path, success).  With an empty map
    the files are copied unchanged."""
    m = materialize(merge_maps(global_map, project_map), "map")
    return _rewrite(spark, source, out, m, extensions, anonymize)


def reveal_tree(spark: SparkSession, source: str, out: str, global_map: DataFrame,
                project_map: DataFrame, extensions=DEFAULT_EXTENSIONS) -> DataFrame:
    """Writes the revealed files below `out`; an empty map is an error."""
    m = materialize(merge_maps(global_map, project_map), "map")
    if m.isEmpty():
        raise ValueError("no mappings found, cannot reveal files")
    return _rewrite(spark, source, out, m, extensions, reveal)
