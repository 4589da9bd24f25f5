"""Comparing the members of groups of any size in tasks of bounded size."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmap.sources.storage import materialize


def block_pairs(members: DataFrame, group: list[str], member: str, limit: int) -> DataFrame:
    """Members of groups with at least two, as rows of block pairs.

    A group of m members is cut into ceil(m / limit) blocks by a hash of the member, and a row is
    sent to every pair of blocks (bi <= bj) its own block (`own`) belongs to: no task gets more
    than about 2 * limit members, and every two members meet in exactly one pair of blocks.
    """
    members = materialize(members, "members")
    sizes = members.groupBy(*group).agg(F.count("*").alias("m")).where("m > 1")
    sizes = materialize(sizes.select(*group, F.ceil(F.col("m") / limit).cast("int").alias("parts")), "sizes")
    cut = members.join(sizes, group).withColumn("own", F.pmod(F.xxhash64(member), F.col("parts")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other")).drop(
        "other", "parts")


def sorted_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, offsets): whole groups of rows that come ordered by non-null integer keys."""
    held: list[pa.RecordBatch] = []

    def cut(table):
        cols = [table.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(len(table) - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        return np.flatnonzero(change) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        at = cut(table)
        if len(at):
            yield table.slice(0, at[-1]), np.concatenate([[0], at])
            held = table.slice(at[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.concatenate([[0], cut(table), [len(table)]])


def smallest_reachable(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric adjacency matrix the first row it is connected with."""
    n = len(near)
    label = np.arange(n, dtype=np.int32)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], n).min(axis=1)).astype(np.int32)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
