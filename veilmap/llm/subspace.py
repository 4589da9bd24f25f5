"""Embedding near-dedup by a pigeonhole join over subspaces.

Unit vectors with cosine t are sqrt(2 - 2t) apart.  They are rotated and cut into blocks of few
dimensions; if the squared distance is within the budget, that of some block is within the
block's proportional share.  Each block is range-joined over a grid of its first
coordinates, and what any block finds is verified on the original vectors.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmap.llm.blocks import block_pairs, smallest_reachable, sorted_groups, whole_groups
from veilmap.llm.components import components
from veilmap.sources.storage import materialize

THRESHOLD = 0.98
BLOCKS = 8
_BLOCK = 1024
_PAIRS = 1 << 15
_SLACK = 1e-7
_KEYS = ["label", "dim", "block", "x", "y"]
_UP = ((0, 1), (1, -1), (1, 0), (1, 1))


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _rotated(vectors: np.ndarray) -> np.ndarray:
    """Rotated unit vectors; row by row, so that a vector gives the same bits in every task."""
    turn = rotation(vectors.shape[1])
    out = np.empty_like(vectors)
    for i, v in enumerate(vectors):
        out[i] = (v / np.sqrt((v * v).sum())) @ turn
    return out


def _spans(dim: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)
    return list(zip(edges[:-1], edges[1:]))


def _budget(span: tuple[int, int], dim: int, threshold: float) -> float:
    return (2 - 2 * threshold) * (span[1] - span[0]) / dim + _SLACK


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _place(threshold: float, kind: pa.DataType):
    """Rows of the grid cells of every block: a vector's own cell, and as guest the
    later neighbour cells that its range reaches."""
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = batch.filter(pa.array(dims == dim))
                z = _rotated(_matrix(rows.column("vec"), int(dim)))
                for b, span in enumerate(_spans(int(dim))):
                    r = np.sqrt(_budget(span, int(dim), threshold))
                    width = 2 * r
                    flat = [z[:, span[0]], z[:, span[0] + 1] if span[1] - span[0] > 1 else np.zeros(len(z))]
                    cell = [np.floor(c / width).astype(np.int64) for c in flat]
                    off = [c / width - k for c, k in zip(flat, cell)]
                    for dx, dy in ((0, 0), *_UP):
                        near = np.ones(len(z), bool)
                        for d, o in ((dx, off[0]), (dy, off[1])):
                            near &= (o >= 0.5 - 1e-9) if d > 0 else (o <= 0.5 + 1e-9) if d < 0 else True
                        at = np.flatnonzero(near)
                        own = rows.take(pa.array(at))
                        full = lambda v: pa.array(np.full(len(at), v, np.int64))
                        yield pa.RecordBatch.from_arrays(
                            [own.column("label"), full(dim), full(b), pa.array(cell[0][at] + dx), pa.array(cell[1][at] + dy),
                             pa.array(np.full(len(at), (dx, dy) == (0, 0))), own.column("node"), own.column("n"),
                             own.column("vec").cast(kind)],
                            [*_KEYS, "home", "node", "n", "vec"])
    return run


def _join(threshold: float, keys: list[str]):
    """Verified links of each block pair: per node the members it links with, and a spanning forest."""
    def links(table):
        dim, block = table.column("dim")[0].as_py(), table.column("block")[0].as_py()
        x = _matrix(table.column("vec").combine_chunks(), dim)
        home = table.column("home").to_numpy()
        own, bi, bj = (table.column(c).to_numpy() for c in ("own", "bi", "bj"))
        spans = _spans(dim)
        lo, hi = spans[block]
        z = _rotated(x)
        length = np.sqrt((x * x).sum(axis=1))
        part = z[:, lo:hi]
        sq = (part * part).sum(axis=1)
        cross = bi[0] != bj[0]
        left = np.flatnonzero(own == bi) if cross else np.arange(len(x))
        right = np.flatnonzero(own == bj) if cross else left
        if not len(left) or not len(right):
            return np.empty((0, 2), int)
        near = sq[left][:, None] + sq[right][None, :] - 2 * part[left] @ part[right].T <= _budget(spans[block], dim, threshold) + _SLACK
        near &= home[left][:, None] | home[right][None, :]
        if not cross:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        i, j = left[i], right[j]
        found = []
        for at in range(0, len(i), _PAIRS):
            p, q = i[at:at + _PAIRS], j[at:at + _PAIRS]
            for b in range(block + 1):  # a pair counts in the first block that finds it
                d = z[p, spans[b][0]:spans[b][1]] - z[q, spans[b][0]:spans[b][1]]
                within = (d * d).sum(axis=1) <= _budget(spans[b], dim, threshold)
                keep = within if b == block else ~within
                p, q = p[keep], q[keep]
            cosine = (x[p] * x[q]).sum(axis=1) / (length[p] * length[q])
            found.append(np.stack([p, q], axis=1)[cosine >= threshold])
        return np.concatenate(found) if found else np.empty((0, 2), int)

    def run(batches):
        for table, offsets in whole_groups(batches, keys):
            a, b, n = [], [], []
            for s, e in zip(offsets[:-1], offsets[1:]):
                group = table.slice(s, e - s)
                pairs = links(group) if e - s > 1 else ()
                if not len(pairs):
                    continue
                node = group.column("node").to_numpy()
                many = group.column("n").to_numpy()
                count = np.zeros(len(node), np.int64)
                np.add.at(count, pairs[:, 0], many[pairs[:, 1]])
                np.add.at(count, pairs[:, 1], many[pairs[:, 0]])
                near = np.zeros((len(node), len(node)), bool)
                near[pairs[:, 0], pairs[:, 1]] = near[pairs[:, 1], pairs[:, 0]] = True
                root = smallest_reachable(near)
                linked = count > 0
                a.append(node[linked])
                b.append(node[root][linked])
                n.append(count[linked])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b, n)], ["a", "b", "n"])
    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links long, component_id, kept): rows of equal label whose cosine, in double
    precision, is at least `threshold` are linked; `component_id` is the smallest id reachable,
    `kept` marks it.

    Vectors that are null, empty or zero, hold null or non-finite components or have a null label
    link with nothing; nor do vectors of different length.  Equal vectors of a label are one class
    that counts as often as it occurs.  A null id is passed over when the smallest is taken.
    Other columns are ignored.  Pairs never leave their task: per node a count and one edge of
    a spanning forest do, and cells beyond a fixed size are compared block by block.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label).cast("long").alias("label"), F.col(vec).alias("vec"))
    good = ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = rows.where(F.col("label").isNotNull() & good & F.exists("vec", lambda v: v != 0))
    classes = usable.groupBy("label", "vec").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    classes = materialize(classes.select("*", F.size("vec").cast("long").alias("dim"),
                                         F.monotonically_increasing_id().alias("node")), "classes")
    kind = pa.list_(pa.float64() if "double" in dict(vectors.dtypes)[vec] else pa.float32())
    fields = f"{', '.join(f'{k} long' for k in _KEYS)}, home boolean, node long, n long, vec {dict(rows.dtypes)['vec']}"
    placed = classes.select("label", "dim", "node", "n", "vec").mapInArrow(_place(threshold, kind), fields)
    keys = [*_KEYS, "bi", "bj"]
    pairs = block_pairs(placed, _KEYS, "node", _BLOCK)
    found = materialize(sorted_groups(pairs, keys).mapInArrow(_join(threshold, keys), "a long, b long, n long"), "links")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    roots = components(found.select("a", "b"))
    tied = classes.join(counts, "node", "left").join(roots, "node", "left").select(
        "label", "vec", "first", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("root", "node").alias("root"))
    least = tied.groupBy("root").agg(F.min("first").alias("component"))
    named = materialize(tied.join(least, "root").select("label", "vec", "n_links", "component"), "named")
    return rows.join(named, ["label", "vec"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"))
