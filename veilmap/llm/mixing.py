"""Mixing sources to target weights by Poisson replication.

Every document is repeated k times, k drawn from a Poisson distribution whose mean is the
repetition rate of its source; the distribution is inverted at a uniform number hashed
from seed and document, so a lost task draws the same counts again.  The copies are dealt
to partitions and ordered by a hash: a global shuffle.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmap.llm.common import ROW, spread
from veilmap.sources.storage import materialize

FEW_SOURCES = 10_000

# One draw inverts a mean of at most this; larger means are sums of independent draws.
STEP = 16
_TABLE = 128
_LEAST = 1e-18
_BITS = 52


def unit_number(*parts: Column) -> Column:
    """A number in [0, 1) hashed from the given texts."""
    digits = F.substring(F.md5(F.concat_ws("/", *parts).cast("binary")), 1, _BITS // 4)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << _BITS))


def poisson_table(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as long as P(X = k) matters to a number of 52 bits."""
    first = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"))
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(_TABLE)), F.array(first),
        lambda all_, k: F.array_append(all_, F.struct(
            (F.element_at(all_, -1)["p"] * mean / k).alias("p"),
            (F.element_at(all_, -1)["c"] + F.element_at(all_, -1)["p"] * mean / k).alias("c"))))
    return F.transform(F.filter(steps, lambda s: s["p"] >= _LEAST), lambda s: s["c"])


def source_rates(docs: DataFrame, source: str = "source", text: str = "text",
                 weights: Mapping[str, float] | None = None, temperature: float = 0.5,
                 epochs: float = 1.0) -> tuple[DataFrame, int]:
    """((source, size, rate), number of sources): how often documents of each source are repeated on average.

    A source of s characters and target weight w gets the rate `epochs * total * w / (s * sum of
    weights)`.  Without `weights` the weight of a source is s ** temperature.  Sources that
    `weights` does not name have weight 0.  Only three totals reach the driver.
    """
    size = F.sum(F.length(F.coalesce(F.col(text), F.lit(""))).cast("long"))
    sizes = docs.groupBy(F.col(source).alias("source")).agg(
        F.greatest(size, F.lit(1)).cast("double").alias("size"))
    if weights is None:
        weight = F.pow("size", F.lit(float(temperature)))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    weighed = materialize(sizes.withColumn("weight", weight), "sources")
    total, weights_sum, n = weighed.agg(F.sum("size"), F.sum("weight"), F.count("*")).first()
    rate = F.col("weight") * F.lit(epochs * total / weights_sum if weights_sum else 0.0) / F.col("size")
    return weighed.select("source", "size", rate.alias("rate")), n


def _join_rates(rows: DataFrame, rates: DataFrame, n_sources: int) -> DataFrame:
    """Adds the draws of each source to rows with a column `source`.

    Up to `FEW_SOURCES` (counted) the rates are broadcast.  Beyond that only sources with more
    than a partition's share of all text are, of which there are at most as many as partitions;
    the others are joined by key.
    """
    draws = F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int")
    rates = rates.withColumn("draws", draws).withColumn("table", poisson_table(F.col("rate") / F.col("draws")))
    rates = rates.select(F.struct("source").alias("s"), "size", "draws", "table")
    if n_sources <= FEW_SOURCES:
        return rows.join(F.broadcast(rates.drop("size")), F.struct("source") == F.col("s")).drop("s")
    share = rates.agg(F.sum("size")).first()[0] / spread(rows)
    hot = F.broadcast(rates.where(F.col("size") > share).drop("size"))
    rest = rates.where(F.col("size") <= share).drop("size")
    on = F.struct("source") == F.col("s")
    return rows.join(hot, on).drop("s").unionByName(
        rows.join(hot.select("s"), on, "left_anti").join(rest, on).drop("s"))


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text",
        weights: Mapping[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0,
        seed: str = "mix") -> DataFrame:
    """All columns of `docs` for every copy, and `copy` (from 1) and `mix_key`; copies are dealt to
    partitions and ordered by `mix_key`.

    Rates as in `source_rates`.  A null source is a source of its own.  Documents with a null id
    are told apart by their text; rows equal in id (or, without one, in text) draw equal counts.
    Null and empty texts count no characters but are mixed.  Columns named `copy` or `mix_key`
    are replaced.  An empty table gives no rows.
    """
    rates, n_sources = source_rates(docs, source, text, weights, temperature, epochs)
    name = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    kept = [c for c in docs.columns if c not in ("copy", "mix_key")]
    rows = docs.select(F.struct(*[docs[c] for c in kept]).alias(ROW), name.alias("name"),
                       F.col(source).alias("source"))
    counted = _join_rates(rows, rates, n_sources)
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("draws")), F.lit(0),
        lambda n, j: n + F.size(F.filter("table", lambda c: c <= unit_number(F.lit(seed), F.col("name"), j.cast("string")))))
    copies = (counted.select(ROW, "name", count.alias("n")).where("n > 0")
              .select(ROW, "name", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")))
    key = F.md5(F.concat_ws("/", F.lit(seed), "name", F.lit("copy"), F.col("copy").cast("string")).cast("binary"))
    return (copies.select(ROW, "copy", key.alias("mix_key")).repartition("mix_key")
            .sortWithinPartitions("mix_key").select(f"{ROW}.*", "copy", "mix_key"))
