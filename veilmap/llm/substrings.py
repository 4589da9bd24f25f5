"""Substring dedup by prefix-partitioned suffix trees.

Suffixes are compared to a depth of `WINDOW` words.  A suffix stands in the group of one short
prefix: the run of `PREFIX` words with the smallest hash inside its first `WINDOW` words, which
equal suffixes share wherever they stand.  Groups of one suffix hold no repeat and end there.
Neighbouring suffixes mostly share the prefix and travel as one row, so a text is not copied
once per suffix.  A prefix that occurs too often for a task is lengthened to all
`WINDOW` words; such a group is a single deep node and only its size is needed.  In every other group
the nodes of depth `WINDOW` with two leaves or more are the repeats, and neighbouring leaves join to
maximal ones.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmap.llm.blocks import sorted_groups, whole_groups
from veilmap.llm.common import KEY, ROW, row_key
from veilmap.llm.words import hashed_words, mixed, rolling
from veilmap.sources.storage import materialize

WINDOW = 35
PREFIX = 6
# A group of this many rows takes a few megabytes.
MOST = 20_000


def _sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum, maximum) over every run of n items."""
    width = 1
    out = x
    while 2 * width <= n:
        out = pick(out[:-width], out[width:])
        width *= 2
    return pick(out[:len(x) - n + 1], out[n - width:]) if width < n else out


def _prefixes(h: np.ndarray, at: np.ndarray, window: int, prefix: int):
    """(grams, least, valid): hashes of runs of `prefix` words, the smallest of each window, and
    which windows lie inside one text."""
    grams = rolling(mixed(h ^ np.uint64(0xA0761D6478BD642F)), prefix)
    least = _sliding(grams, window - prefix + 1, np.minimum)
    last = np.repeat(at[1:], np.diff(at))
    return grams, least, (np.arange(len(least)) + window <= last[:len(least)])


def _collect(window: int, prefix: int):
    """Per text the prefixes its windows stand under, and those it has more than once."""
    def run(batches):
        for batch in batches:
            key, rows = batch.column("d"), []
            for lo, _, h, at in hashed_words(batch.column("text"), lower=False):
                if len(h) < window:
                    continue
                grams, least, valid = _prefixes(h, at, window, prefix)
                most = _sliding(np.concatenate([np.zeros(window - prefix, np.uint64), np.where(valid, least, np.uint64(0)),
                                                np.zeros(window - prefix, np.uint64)]), window - prefix + 1, np.maximum)
                place = np.flatnonzero(most[:len(grams)] == grams)
                row = np.searchsorted(at, place, "right") - 1
                order = np.lexsort((grams[place], row))
                row, a = row[order], grams[place][order]
                new = np.ones(len(a), bool)
                new[1:] = (row[1:] != row[:-1]) | (a[1:] != a[:-1])
                again = np.zeros(len(a), bool)
                again[:-1] = new[:-1] & ~new[1:]
                for chosen, kind in ((new, 0), (again, 1)):
                    values, owner = a[chosen].view(np.int64), row[chosen]
                    some, first = np.unique(owner, return_index=True)
                    for r, part in zip(some, np.split(values, first[1:])):
                        rows.append((lo + int(r), kind, part))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [key.take(pa.array([r[0] for r in rows])), pa.array([r[1] for r in rows], pa.int32()),
                     pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["d", "kind", "a"])
    return run


def _suffixes(window: int, prefix: int):
    """Runs of neighbouring windows under one shared prefix, with the hashes of the windows."""
    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            text = pa.array([unzip.decompress(t.as_buffer()) for t in batch.column("zipped")], pa.binary()).cast(pa.string())
            shared, hot = batch.column("shared"), batch.column("hot")
            for lo, hi, h, at in hashed_words(text, lower=False):
                if len(h) < window:
                    continue
                _, least, valid = _prefixes(h, at, window, prefix)
                whole = rolling(h, window)
                out = []
                for r in range(lo, hi):
                    start, end = at[r - lo], min(at[r - lo + 1], len(least))
                    own = least[start:end].view(np.int64)
                    known = shared[r].values.to_numpy()
                    hit = np.flatnonzero(valid[start:end] & np.isin(own, known))
                    if not len(hit):
                        continue
                    cut = np.flatnonzero((np.diff(hit) > 1) | (own[hit[1:]] != own[hit[:-1]])) + 1
                    often = set(hot[r].values.to_pylist())
                    for run_ in np.split(hit, cut):
                        a = int(own[run_[0]])
                        out.append((r, a, a in often, int(run_[0]), whole[start + run_[0]:start + run_[-1] + 1].view(np.int64)))
                if out:
                    at_row = pa.array([o[0] for o in out])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("d").take(at_row), batch.column("h").take(at_row), pa.array([o[1] for o in out], pa.int64()),
                         pa.array([o[2] for o in out]), pa.array([o[3] for o in out], pa.int32()),
                         pa.array([o[4] for o in out], pa.list_(pa.int64()))], ["d", "h", "a", "often", "start", "w"])
    return run


def _deep_nodes(window: int):
    """In groups of suffixes: the leaves below nodes of full depth with two leaves or more, as word spans."""
    def run(batches):
        for table, _ in whole_groups(batches, ["a"]):
            lists = table.column("w").combine_chunks()
            size = np.diff(lists.offsets.to_numpy())
            w = lists.flatten().to_numpy()
            _, node, leaves = np.unique(w, return_inverse=True, return_counts=True)
            deep = leaves[node] > 1
            row = np.repeat(np.arange(len(size)), size)
            place = np.repeat(table.column("start").to_numpy(), size) + np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
            row, place = row[deep], place[deep]
            if not len(row):
                continue
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(row)) - 1
            at = pa.array(row[first])
            yield pa.RecordBatch.from_arrays(
                [table.column("d").take(at).combine_chunks(), table.column("h").take(at).combine_chunks(),
                 pa.array(place[first].astype(np.int32)), pa.array((place[last] + window).astype(np.int32))], ["d", "h", "start", "end"])
    return run


def repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, most: int = MOST) -> DataFrame:
    """(d, h, spans): word spans (start, end) of repeated windows; `docs` holds d, h (two hashes that name a
    row), text and zipped (the text, compressed)."""
    lists = materialize(docs.select("d", "text").mapInArrow(_collect(window, prefix), "d long, kind int, a array<long>"), "prefixes")
    each = lists.select("d", "kind", F.explode("a").alias("a"))
    shared = each.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a", (F.col("n") > most).alias("often"))
    shared = materialize(shared, "shared")
    marked = each.where("kind = 0").join(shared, "a").groupBy("d").agg(
        F.collect_list("a").alias("shared"), F.collect_list(F.when(F.col("often"), F.col("a"))).alias("hot"))
    rows = docs.select("d", "h", "zipped").join(marked, "d")
    runs = rows.mapInArrow(_suffixes(window, prefix), "d long, h long, a long, often boolean, start int, w array<long>")
    runs = materialize(runs, "suffixes")
    found = sorted_groups(runs.where("not often").drop("often"), ["a"]).mapInArrow(
        _deep_nodes(window), "d long, h long, start int, end int")
    found = found.select("d", "h", F.array(F.struct("start", "end")).alias("spans"))
    # Prefixes that occur very often: whole windows are the prefix.  Equal runs of windows are counted
    # as one before they are shuffled, and get their spans back run by run.  As in the groups above, two
    # hashes decide: that of the prefix and that of the window.
    often = runs.where("often").select("d", "h", "a", "start", "w")
    kinds = materialize(often.groupBy("a", "w").agg(F.count("*").alias("n")).withColumn(
        "run", F.monotonically_increasing_id()), "runs")
    # A window that a run holds several times, as periodic texts do, is one leaf with a weight.
    leaves = kinds.select("run", "a", "n", "w", F.explode(F.array_distinct("w")).alias("node"))
    weight = F.col("n") * F.size(F.filter("w", lambda x: x == F.col("node")))
    leaves = leaves.select("run", "a", "node", weight.alias("n"))
    nodes = leaves.groupBy("a", "node").agg(F.sum("n").alias("n")).where("n > 1").select("a", "node")
    deep = leaves.join(nodes, ["a", "node"]).groupBy("run").agg(F.collect_set("node").alias("nodes"))
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.array_contains("nodes", F.get("w", i)))
    deep = materialize(kinds.join(deep, "run").select("a", "w", at.alias("at")), "deep-nodes")
    first, last = F.element_at("at", 1), F.element_at("at", -1)
    spans = F.when(F.size("at") == last - first + 1, F.array(F.struct(first.alias("start"), (last + window).alias("end")))).otherwise(
        F.transform("at", lambda i: F.struct(i.alias("start"), (i + window).alias("end"))))
    placed = F.transform("spans", lambda x: F.struct((F.col("start") + x["start"]).alias("start"),
                                                     (F.col("start") + x["end"]).alias("end")))
    hit = often.join(deep.select("a", "w", spans.alias("spans")), ["a", "w"]).select("d", "h", placed.alias("spans"))
    return found.unionByName(hit)


@F.pandas_udf(T.BinaryType())
def _zipped(texts: pd.Series) -> pd.Series:
    zip_ = zstandard.ZstdCompressor(level=3)
    return pd.Series([zip_.compress((t or "").encode()) for t in texts])


@F.pandas_udf(T.StructType().add("text", "string").add("n_words", "long").add("n_removed", "long"))
def _kept(zipped: pd.Series, spans: pd.Series) -> pd.DataFrame:
    unzip, out = zstandard.ZstdDecompressor(), []
    for data, found in zip(zipped, spans):
        words = unzip.decompress(data).split()
        n = len(words)
        if found is not None and len(found):
            step = np.zeros(n + 1, np.int32)
            np.add.at(step, [s["start"] for s in found], 1)
            np.add.at(step, [s["end"] for s in found], -1)
            words = [w for w, depth in zip(words, np.cumsum(step)[:n]) if not depth]
        out.append((b" ".join(words).decode(), n, n - len(words)))
    return pd.DataFrame(out, columns=["text", "n_words", "n_removed"])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW,
                     prefix: int = PREFIX, most: int = MOST) -> DataFrame:
    """`docs` with `text` as its kept words joined by one space, and `n_words`, `n_removed`.

    A word goes if it lies in a run of `window` successive words of its text that also starts
    somewhere else, in any text; runs are judged on the input.  Words are runs of bytes other than ASCII
    white space.  Null texts have no words and become empty.  Rows equal in id and text are different
    places, so each repeats the other; null ids are allowed.  Columns named `n_words` or `n_removed` are
    replaced.  An empty table stays empty.
    """
    others = [c for c in docs.columns if c not in (text, "n_words", "n_removed")]
    key = row_key(F.col(id_col), F.col(text))
    # Two hashes name a row; rows equal in id and text share them, and with them their repeats.
    rows = docs.select(F.struct(*others, F.lit(0).alias("_")).alias(ROW), F.xxhash64(F.struct(F.col(id_col), F.col(text))).alias("d"),
                       key["h"].alias("h"), F.col(text).alias("text"), _zipped(F.col(text)).alias("zipped"))
    spans = repeats(rows.select("d", "h", "text", "zipped"), window, prefix, most)
    spans = spans.groupBy("d", "h").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    joined = rows.drop("text").join(spans, ["d", "h"], "left").select(ROW, _kept("zipped", "spans").alias(KEY))
    columns = [F.col(f"{KEY}.text").alias(text) if c == text else F.col(f"{ROW}.`{c}`").alias(c)
               for c in docs.columns if c not in ("n_words", "n_removed")]
    return joined.select(*columns, f"{KEY}.n_words", f"{KEY}.n_removed")
