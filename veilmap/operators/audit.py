"""Checks that a map and its application are reversible and complete."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmap.operators.detect import as_keys
from veilmap.operators.replace import anonymize, bounded_automaton, find_mapped, occurring_values, reveal, rows_with_keys


def roundtrip(df: DataFrame, m: DataFrame, key, text: str, order=None) -> DataFrame:
    """(key, source_sha256, revealed_sha256, identical) per document."""
    keys = as_keys(key)
    # Only a hash of the source goes through the replacements.
    both = df.select(*keys, F.sha2(text, 256).alias("_source"), F.col(text).alias("_text"))
    back = reveal(anonymize(both, m, "_text"), m, "_text", order=order)
    revealed = F.sha2("_text", 256)
    return back.select(
        *keys, F.col("_source").alias("source_sha256"), revealed.alias("revealed_sha256"),
        F.col("_source").eqNullSafe(revealed).alias("identical"))


def roundtrip_report(df: DataFrame, m: DataFrame, key, text: str, order=None) -> DataFrame:
    return roundtrip(df, m, key, text, order).agg(
        F.count("*").alias("documents"),
        F.count_if(~F.col("identical")).alias("mismatches"))


def residual_leaks(df: DataFrame, m: DataFrame, key, text: str) -> DataFrame:
    """Keys of the documents in which some original value still occurs."""
    keys = as_keys(key)
    held = bounded_automaton(m)
    if held is None:
        return find_mapped(df, keys, text, m).select(*keys).distinct()
    return rows_with_keys(df, keys, text, held)


def ambiguous_fakes(m: DataFrame) -> DataFrame:
    """Fakes shared by several originals: `reveal` cannot tell these apart."""
    return (m.groupBy("anonymized_value").agg(F.count("*").alias("originals"))
            .where("originals > 1"))


def fakes_that_are_originals(m: DataFrame) -> DataFrame:
    return m.select("anonymized_value").distinct().join(
        m.select(F.col("original_value").alias("anonymized_value")), "anonymized_value", "left_semi")


def _fakes_as_keys(m: DataFrame) -> DataFrame:
    return m.select(F.col("anonymized_value").alias("original_value"), F.lit("").alias("anonymized_value")).distinct()


def fakes_in_corpus(df: DataFrame, m: DataFrame, key, text: str) -> DataFrame:
    """Fakes that the untouched corpus contains already, with the number of documents."""
    keys = as_keys(key)
    found = find_mapped(df, keys, text, _fakes_as_keys(m))
    return (found.groupBy(F.col("original_value").alias("anonymized_value"), *keys).agg(F.lit(1))
            .groupBy("anonymized_value").agg(F.count("*").alias("documents")))


def seen_fakes(df: DataFrame, m: DataFrame, text: str) -> DataFrame:
    """(anonymized_value): the fakes of `fakes_in_corpus`, without a count of documents and so without a row per
    occurrence."""
    return occurring_values(df, text, _fakes_as_keys(m)).select(F.col("original_value").alias("anonymized_value"))


def fake_collisions(df: DataFrame, m: DataFrame, key, text: str) -> DataFrame:
    """(anonymized_value, reason): fakes that make a round trip unsafe."""
    return (seen_fakes(df, m, text).withColumn("reason", F.lit("in corpus"))
            .unionByName(fakes_that_are_originals(m).withColumn("reason", F.lit("is an original"))))
