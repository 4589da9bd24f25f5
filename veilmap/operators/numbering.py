"""Dense numbers and free slots inside groups of any size.

A group may hold a third of all rows, so no window ever spans one: rows are ranked
inside small buckets and the counts of the earlier buckets are added.  Buckets follow
the sort order, hence the result equals one `row_number` over the whole group.  Where the
caller has checked that all rows together are few (`small`), that one window is used.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_SLOTS_PER_BUCKET = 1 << 16


def ordinal(df: DataFrame, group, bucket: Column, order, name: str = "ordinal",
            small: bool = False) -> DataFrame:
    """1, 2, 3, ... inside `group` ordered by (bucket, order)."""
    group = list(group)
    if small:
        whole = W.partitionBy(*group).orderBy(bucket, *order)
        return df.withColumn(name, F.row_number().over(whole).cast("bigint"))
    df = df.withColumn("_bucket", bucket)
    inside = W.partitionBy(*group, "_bucket").orderBy(*order)
    earlier = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = (df.groupBy(*group, "_bucket").agg(F.count("*").alias("_size"))
              .select(*group, "_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0))
                      .alias("_before")))
    return (df.withColumn(name, F.row_number().over(inside).cast("bigint"))
            .join(before, [*group, "_bucket"])
            .withColumn(name, F.col(name) + F.col("_before")).drop("_bucket", "_before"))


def free_slots(requests: DataFrame, taken: DataFrame, group, rank: str = "ordinal",
               slot: str = "slot", small: bool = False) -> DataFrame:
    """Gives the request of rank k (from 1) the k-th slot (from 0) of its group that is
    not taken.

    A taken slot with j taken ones below it has `slot - j` free slots below it.  The k-th
    free slot is therefore k - 1 plus the number of taken slots with at most k - 1 free
    ones below: a running count over requests and taken slots merged by that number.
    """
    group = list(group)
    held = ordinal(taken.select(*group, slot).distinct(), group,
                   F.floor(F.col(slot) / _SLOTS_PER_BUCKET), [F.col(slot)], "_j", small)
    steps = (held.groupBy(*group, (F.col(slot) - F.col("_j") + 1).alias("_key"))
             .agg(F.count("*").alias("_taken")))
    others = [c for c in requests.columns if c not in group]
    events = requests.select("*", (F.col(rank) - 1).alias("_key"), F.lit(0).cast("bigint").alias("_taken"),
                             F.lit(1).alias("_asks")).unionByName(
        steps.select(*group, "_key", "_taken", F.lit(0).alias("_asks")), allowMissingColumns=True)
    if small:
        whole = (W.partitionBy(*group).orderBy("_key", "_asks")
                 .rowsBetween(W.unboundedPreceding, W.currentRow))
        return (events.withColumn("_passed", F.sum("_taken").over(whole)).where("_asks = 1")
                .select(*group, *others, (F.col("_key") + F.col("_passed")).alias(slot)))
    events = events.withColumn("_bucket", F.floor(F.col("_key") / _SLOTS_PER_BUCKET))
    earlier = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = (steps.groupBy(*group, F.floor(F.col("_key") / _SLOTS_PER_BUCKET).alias("_bucket"))
              .agg(F.sum("_taken").alias("_size"))
              .unionByName(requests.select(
                  *group, F.floor((F.col(rank) - 1) / _SLOTS_PER_BUCKET).alias("_bucket"),
                  F.lit(0).cast("bigint").alias("_size")).distinct())
              .groupBy(*group, "_bucket").agg(F.sum("_size").alias("_size"))
              .select(*group, "_bucket",
                      F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before")))
    inside = (W.partitionBy(*group, "_bucket").orderBy("_key", "_asks")
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    return (events.withColumn("_passed", F.sum("_taken").over(inside))
            .where("_asks = 1").join(before, [*group, "_bucket"])
            .select(*group, *others, (F.col("_key") + F.col("_passed") + F.col("_before")).alias(slot)))
