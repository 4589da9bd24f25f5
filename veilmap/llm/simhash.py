"""SimHash near-dedup by covering locality-sensitive hashing.

Bit i of a fingerprint gets a random vector m(i) of r + 1 bits.  For every non-zero vector v of
r + 1 bits there is one table, keyed by the fingerprint under a mask: the bits i with an odd
number of ones in m(i) AND v.  Two fingerprints that differ in at most r bits differ in
vectors spanning at most r dimensions; some v is orthogonal to them all, and in its table the
two collide.  So 2**(r+1) - 1 tables find every pair within the radius, without exception.
"""

import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmap.llm.blocks import block_pairs, smallest_reachable, sorted_groups, whole_groups
from veilmap.llm.common import KEY, ROW, keyed
from veilmap.llm.components import components
from veilmap.sources.storage import materialize

RADIUS = 3
SHINGLE = 3
_BLOCK = 1024
_PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_runs(data: bytes):
    """Lists of the words of a text, from pieces of bounded length."""
    at = 0
    while at < len(data):
        end = at + _PIECE
        if end < len(data):
            found = _SPACE.search(data, end)
            end = found.start() if found else len(data)
        yield data[at:end].split()
        at = end


def fingerprint_of(text: str | None, k: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the k-word shingles of a text, repeats included."""
    counts, total, tail, few = np.zeros(64, np.int64), 0, [], True
    digest = xxhash.xxh64_intdigest
    for words in word_runs((text or "").encode().lower()):
        words = tail + words
        n = len(words) - k + 1
        if n > 0:
            few = False
            if k == 3:
                hashes = [digest(b"%b %b %b" % x, 42) for x in zip(words, words[1:], words[2:])]
            else:
                hashes = [digest(b" ".join(words[i:i + k]), 42) for i in range(n)]
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
            total += n
        tail = words[len(words) - k + 1:] if n > 0 and k > 1 else ([] if k == 1 else words)
    if few and tail:
        bits = np.unpackbits(np.array([digest(b" ".join(tail), 42)], "<u8").view(np.uint8), bitorder="little")
        counts, total = bits.astype(np.int64), 1
    set_ = np.packbits(2 * counts > total, bitorder="little").view("<i8")
    return int(set_[0])


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_of(t) for t in texts], dtype="int64")


def hex64(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def covering_masks(radius: int = RADIUS, seed: int = 1, bits: int = 64) -> list[int]:
    """Masks of the tables; every set of `radius` bits is left out by one of them at least."""
    rng = random.Random(seed)
    vectors = [rng.randrange(1, 1 << (radius + 1)) for _ in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
            for v in range(1, 1 << (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _link_blocks(radius: int, keys: list[str]):
    def run(batches):
        for table, offsets in whole_groups(batches, keys):
            prints = table.column("fp").combine_chunks().to_numpy()
            sizes = np.diff(offsets)
            firsts = offsets[:-1][sizes == 2]
            x, y = prints[firsts], prints[firsts + 1]
            close = np.bitwise_count((x ^ y).view(np.uint64)) <= radius
            a, b = [x[close]], [y[close]]
            for i in np.flatnonzero(sizes > 2):
                own = np.sort(prints[offsets[i]:offsets[i + 1]])
                near = np.bitwise_count((own[:, None] ^ own[None, :]).view(np.uint64)) <= radius
                root = smallest_reachable(near)
                tied = root != np.arange(len(own))
                a.append(own[root[tied]])
                b.append(own[tied])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
    return run


def link_fingerprints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root) for distinct fingerprints (column `fp`) that reach a smaller one over links of at
    most `radius` bits.  Links inside a table's bucket are found by comparing blocks of
    bounded size, of which each hands on a spanning forest instead of all pairs."""
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part"))
                       for i, m in enumerate(covering_masks(radius))])
    members = prints.select("fp", F.inline(tables))
    pairs = block_pairs(members, ["t", "part"], "fp", _BLOCK)
    keys = ["t", "part", "bi", "bj"]
    edges = sorted_groups(pairs.select(*keys, "fp"), keys).mapInArrow(_link_blocks(radius, keys), "a long, b long")
    return components(edges).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of `docs`: (id, fp, component): `component` is the smallest id
    reachable over links of at most `radius` differing bits.

    Null and empty texts have fingerprint zero and link like others.  Equal fingerprints are
    one node, so copies cost nothing.  A null id is passed over when the smallest is taken; if all
    are null, so is the component.  Other columns are ignored.
    """
    prints = materialize(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text)).alias("fp")), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    roots = link_fingerprints(nodes.select("fp"), radius)
    tied = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = tied.groupBy("root").agg(F.min("first").alias("component"))
    named = materialize(tied.join(least, "root").select("fp", "component"), "named")
    return prints.join(named, "fp").select("id", "fp", "component")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """`docs` without near-duplicates: of every group of linked documents the one with the smallest
    id stays (of equal ids, one); columns as they were."""
    found = near_duplicates(keyed(docs, id_col, text).select(KEY, F.col(f"{ROW}.{text}").alias("text")), KEY, "text", radius)
    first = found.groupBy("component").agg(F.count("*")).select(F.col("component").alias("k"))
    rows = keyed(docs, id_col, text).join(first, F.col(KEY) == F.col("k"), "left_semi")
    return rows.dropDuplicates([KEY]).select(f"{ROW}.*")
