"""Fakes that the corpus does not contain.

A fake that already stands in a text cannot be told from the original text when the map is
turned round.  Strings of the corpus that look like fakes count as names in use while numbers and
slots are given out; what still occurs, inside longer tokens for instance, is found exactly and
drawn again.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmap.functions.pools import ACCOUNT_STEMS, HOST_WORDS
from veilmap.operators.audit import seen_fakes
from veilmap.operators.generate import generate_map
from veilmap.schemas import MAP_COLUMNS
from veilmap.sources.storage import materialize

# Redraws before giving up.
TURNS = 40

# Shapes of what `generate_map` gives out, without word boundaries.
_SHAPES = (
    rf"SRV-(?:{'|'.join(HOST_WORDS)})-[0-9]{{1,15}}",
    rf"(?:{'|'.join(ACCOUNT_STEMS)})[0-9]{{1,15}}@",
    r"(?:10|172|192)(?:\.[0-9]{1,3}){3}(?:/[0-9]{1,2})?",
    r"S-1-5-21(?:-[0-9]{10})++",
    r"[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}",
    r"[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}",
)


def names_like_fakes(df: DataFrame, text: str) -> DataFrame:
    """(name): the distinct strings of the texts that have the shape of a fake.

    Equal strings are combined in the tasks, so one that stands in every text crosses the network once
    a task.  The bare address of a CIDR is a name of its own; null texts have none.
    """
    found = F.flatten(F.array(*[F.regexp_extract_all(F.col(text), F.lit(s), F.lit(0)) for s in _SHAPES]))
    names = df.select(F.explode(F.array_distinct(found)).alias("name"))
    bare = F.when(F.contains("name", F.lit("/")), F.array("name", F.substring_index("name", "/", 1))).otherwise(F.array("name"))
    return names.select(F.explode(bare).alias("name")).distinct()


def generate_unseen(df: DataFrame, key, text: str, identifiers: DataFrame, existing: DataFrame | None = None,
                    **options) -> DataFrame:
    """`generate_map` for the identifiers (identifier_type, value) with fakes of which none occurs in a text of `df`,
    not even inside a longer word.  Entries of `existing` stay as they are, also where their fakes occur.

    `options` are those of `generate_map`.  With `linked`, all host names and UNC paths are drawn again
    together, so that a server keeps the fake of its host name.  Each turn reads the texts once; the
    same texts must come each time.
    """
    together = ("hostname", "unc") if options.get("linked") else ()
    avoid, done, rest = materialize(names_like_fakes(df, text), "seen-names"), [], identifiers
    for _ in range(TURNS):
        known = reduce(DataFrame.unionByName, done + ([] if existing is None else [existing.select(MAP_COLUMNS)])) \
            if done or existing is not None else None
        drawn = materialize(generate_map(rest, known, avoid=avoid, **options), "drawn")
        seen = materialize(seen_fakes(df, drawn, text), "seen")
        hit = drawn.join(seen, "anonymized_value", "left_semi")
        kinds = [r[0] for r in hit.select("identifier_type").distinct().collect()]  # at most one row per type
        if not kinds:
            return reduce(DataFrame.unionByName, [*done, drawn])
        again = together if set(kinds) & set(together) else ()
        done.append(drawn.join(seen, "anonymized_value", "left_anti").where(~F.col("identifier_type").isin(*again))
                    .select(MAP_COLUMNS))
        rest = hit.where(~F.col("identifier_type").isin(*again)).unionByName(
            drawn.where(F.col("identifier_type").isin(*again)), allowMissingColumns=True).select(
            "identifier_type", F.col("original_value").alias("value"))
        avoid = avoid.unionByName(seen.select(F.col("anonymized_value").alias("name")))
    raise ValueError("no fakes found that the corpus does not contain")
