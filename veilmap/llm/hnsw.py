"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Rows are dealt to shards of bounded size by a hash of their id.  A shard's graph is a row of flat
arrays: vectors, members (rows with equal vectors share a node), nodes of each level, and
neighbour lists of fixed width.  Query blocks of bounded size meet every shard, search its
graph with a beam, and the shards' results are merged.

Nearness is the inner product.  Vectors get one more coordinate that makes them equally long, so
that graph neighbours are nearest in the usual sense; for queries it is 0 and changes no product.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilmap.sources.storage import materialize

SHARD = 16_384
BLOCK = 16_384
LINKS = 16
CANDIDATES = 48
BEAM = 128
_STEP = 4
_INDEX = ("dim int, shard int, vectors array<double>, members array<long>, member_at array<int>, "
          "nodes array<int>, node_at array<int>, links array<int>")


def _diverse(sim: np.ndarray, cand: np.ndarray, x: np.ndarray, width: int) -> np.ndarray:
    """Neighbours chosen from candidates (rows, best first; -1 for none): a candidate is taken if no
    taken one is nearer to it than the row itself; left places go to the nearest others."""
    rows, n = cand.shape
    near = np.where(cand[:, :, None] >= 0, x[cand], 0)
    between = np.einsum("rid,rjd->rij", near, near)
    taken = np.zeros((rows, n), bool)
    for j in range(n):
        blocked = np.where(taken, between[:, j, :], -np.inf).max(axis=1) > sim[:, j]
        taken[:, j] = (cand[:, j] >= 0) & ~blocked & (taken.sum(axis=1) < width)
    order = np.argsort(np.where(taken, 0, 1) + np.where(cand < 0, 2, 0), axis=1, kind="stable")[:, :width]
    out = np.take_along_axis(cand, order, axis=1)
    if out.shape[1] < width:
        out = np.concatenate([out, np.full((rows, width - out.shape[1]), -1, out.dtype)], axis=1)
    return out


def level_links(x: np.ndarray, width: int, block: int = 256) -> np.ndarray:
    """Neighbour lists (n x width, -1 for none) of one level: nodes are inserted in order; each is linked
    with diverse ones among its nearest earlier nodes, found by block products within the shard,
    and these link back, keeping a diverse selection when their lists are full."""
    n = len(x)
    links = np.full((n, width), -1, np.int32)
    for at in range(0, n, block):
        end = min(at + block, n)
        sim = x[at:end] @ x[:end].T
        sim[np.arange(at, end)[:, None] <= np.arange(end)[None, :]] = -np.inf
        k = min(CANDIDATES, end)
        best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(sim, best, 1), axis=1, kind="stable"), 1).astype(np.int32)
        value = np.take_along_axis(sim, best, 1)
        best = np.where(np.isfinite(value), best, -1)
        chosen = _diverse(value, best, x, min(LINKS, width))
        links[at:end, :chosen.shape[1]] = chosen
        source = np.repeat(np.arange(at, end, dtype=np.int32), chosen.shape[1])
        target = chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        hit, first, many = np.unique(target, return_index=True, return_counts=True)
        if not len(hit):
            continue
        merged = np.full((len(hit), width + int(many.max())), -1, np.int32)
        merged[:, :width] = links[hit]
        row = np.repeat(np.arange(len(hit)), many)
        merged[row, width + np.arange(len(source)) - np.repeat(first, many)] = source
        value = np.where(merged >= 0, np.einsum("rd,rcd->rc", x[hit], x[merged]), -np.inf)
        order = np.argsort(-value, axis=1, kind="stable")[:, :2 * width]
        links[hit] = _diverse(np.take_along_axis(value, order, 1), np.take_along_axis(merged, order, 1), x, width)
    return links


def _longer(x: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(axis=1)
    return np.concatenate([x, np.sqrt(np.maximum(sq.max() - sq, 0))[:, None]], axis=1)


def build(pdf: pd.DataFrame) -> pd.DataFrame:
    """The index row of one shard."""
    pdf = pdf.sort_values("id", kind="stable")
    raw = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
    _, first, inverse = np.unique(raw, axis=0, return_index=True, return_inverse=True)
    inverse = inverse.ravel()
    order = np.argsort(inverse, kind="stable")
    x = _longer(raw[first])
    rng = np.random.default_rng(len(first))
    shuffled = rng.permutation(len(x))
    level = np.floor(-np.log(1 - rng.random(len(x))) / np.log(LINKS)).astype(int)
    level[0] = level.max()
    nodes, links = [], []
    for height in range(level.max() + 1):
        own = shuffled[level >= height]
        lists = level_links(x[own], 2 * LINKS if height == 0 else LINKS)
        nodes.append(own)
        links.append(np.where(lists >= 0, own[lists], -1).ravel())
    return pd.DataFrame([{
        "dim": int(pdf["dim"].iloc[0]), "shard": int(pdf["shard"].iloc[0]), "vectors": raw[first].ravel(),
        "members": pdf["id"].to_numpy()[order], "member_at": np.searchsorted(inverse[order], np.arange(len(first) + 1)),
        "nodes": np.concatenate(nodes), "node_at": np.cumsum([0] + [len(v) for v in nodes]), "links": np.concatenate(links)}])


def _descend(queries: np.ndarray, x: np.ndarray, nodes: np.ndarray, lists: np.ndarray, at: np.ndarray) -> np.ndarray:
    place = np.full(len(x), -1)
    place[nodes] = np.arange(len(nodes))
    value = (queries * x[at]).sum(axis=1)
    moving = np.arange(len(queries))
    while len(moving):
        near = lists[place[at[moving]]]
        sims = np.where(near >= 0, np.einsum("bcd,bd->bc", x[near], queries[moving]), -np.inf)
        best = sims.argmax(axis=1)
        top = sims[np.arange(len(moving)), best]
        better = top > value[moving]
        at[moving[better]] = near[np.arange(len(moving)), best][better]
        value[moving[better]] = top[better]
        moving = moving[better]
    return at


def _beam(queries: np.ndarray, x: np.ndarray, lists: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Nodes found per query (-1 for none), by expanding the best open nodes of each beam."""
    b, n = len(queries), len(x)
    if n <= width:
        return np.tile(np.arange(n), (b, 1))
    rows = np.arange(b)
    found, value = np.full((b, width), -1), np.full((b, width), -np.inf)
    found[:, 0], value[:, 0] = start, (queries * x[start]).sum(axis=1)
    open_ = found >= 0
    seen = np.zeros((b, n), bool)
    seen[rows, start] = True
    active = rows
    while len(active):
        waiting = np.where(open_[active], value[active], -np.inf)
        pick = np.argsort(-waiting, axis=1, kind="stable")[:, :_STEP]
        usable = np.take_along_axis(waiting, pick, 1) > -np.inf
        go = usable.any(axis=1)
        active, pick, usable = active[go], pick[go], usable[go]
        if not len(active):
            break
        open_[active[:, None], pick] = False
        near = lists[np.where(usable, found[active[:, None], pick], 0)]
        near = np.where(usable[:, :, None], near, -1).reshape(len(active), -1)
        near = np.sort(near, axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~seen[active[:, None], near]
        r, c = np.nonzero(fresh)
        seen[active[r], near[r, c]] = True
        sims = np.full(near.shape, -np.inf)
        sims[r, c] = np.einsum("kd,kd->k", x[near[r, c]], queries[active[r]])
        ids = np.concatenate([found[active], np.where(fresh, near, -1)], axis=1)
        vals = np.concatenate([value[active], sims], axis=1)
        flags = np.concatenate([open_[active], fresh], axis=1)
        keep = np.argpartition(-vals, width - 1, axis=1)[:, :width]
        found[active], value[active] = np.take_along_axis(ids, keep, 1), np.take_along_axis(vals, keep, 1)
        open_[active] = np.take_along_axis(flags, keep, 1) & (found[active] >= 0)
    return found


def _search(k: int, width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The block of queries of one row in the graph of the same row."""
        (r,) = pdf.itertuples(index=False)
        raw = r.vectors.reshape(-1, r.dim)
        x = _longer(raw)
        own = np.asarray(r.query_ids)
        asked = np.concatenate(r.query_vecs).reshape(-1, r.dim)
        queries = np.concatenate([asked, np.zeros((len(asked), 1))], axis=1)
        out = []
        for lo in range(0, len(own), 256):
            q = queries[lo:lo + 256]
            at = np.full(len(q), r.nodes[r.node_at[-2]])
            links_at = len(r.links)
            for height in range(len(r.node_at) - 2, 0, -1):
                nodes = r.nodes[r.node_at[height]:r.node_at[height + 1]]
                lists = r.links[links_at - len(nodes) * LINKS:links_at].reshape(-1, LINKS)
                links_at -= len(nodes) * LINKS
                at = _descend(q, x, nodes, lists, at)
            base = np.empty((len(x), 2 * LINKS), np.int32)
            base[r.nodes[:len(x)]] = r.links[:links_at].reshape(-1, 2 * LINKS)
            found = _beam(q, x, base, at, width)
            for i, nodes in enumerate(found):
                nodes = nodes[nodes >= 0]
                score = (raw[nodes] * asked[lo + i]).sum(axis=1)
                nodes, score = nodes[order := np.argsort(-score, kind="stable")], score[order]
                # Members are in order of ids: k + 1 of each node are enough beside the query itself.
                many = np.minimum(r.member_at[nodes + 1] - r.member_at[nodes], k + 1)
                upto = int(np.searchsorted(np.cumsum(many), k + 1)) + 1
                last = score[min(upto, len(score)) - 1]
                upto = int(np.searchsorted(-score, -last, "right"))
                ids = np.concatenate([r.members[r.member_at[v]:r.member_at[v] + m] for v, m in zip(nodes[:upto], many[:upto])])
                value = np.repeat(score[:upto], many[:upto])
                other = ids != own[lo + i]
                ids, value = ids[other], value[other]
                best = np.lexsort((ids, -value))[:k]
                out.append(pd.DataFrame({"query_id": own[lo + i], "vec_id": ids[best], "score": value[best]}))
        return pd.concat(out)
    return run


def usable(vec: str):
    """Vectors that are not null, hold no null or non-finite component and are not zero."""
    good = ~F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col(vec).isNotNull() & good & F.exists(vec, lambda v: v != 0)


def index(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding", shard: int = SHARD) -> DataFrame:
    """The graphs of all usable vectors, one row per shard, as a table in the shared folder."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where(
        usable("vec") & F.col("id").isNotNull())
    rows = rows.withColumn("dim", F.size("vec"))
    shards = max(1, -(-rows.count() // shard))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return materialize(rows.groupBy("dim", "shard").applyInPandas(build, _INDEX), "graphs")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec: str = "embedding",
            beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found to each query, by inner product in double
    precision, nearest first, ties to the smaller id; a row with the query's id is no candidate.

    `queries` has the columns of `vectors`.  Vectors that are null, empty or zero or hold null or
    non-finite components take no part, nor do rows without an id; vectors of different length never
    meet.  Repeated ids are candidates each.  Other columns are ignored.  Every query meets every
    shard, in blocks of `BLOCK` queries.
    """
    graphs = index(vectors, id_col, vec)
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where(
        usable("vec") & F.col("id").isNotNull()).withColumn("dim", F.size("vec"))
    blocks = max(1, -(-asked.count() // BLOCK))
    grouped = asked.groupBy("dim", F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(blocks)).cast("int").alias("block")).agg(
        F.collect_list("id").alias("query_ids"), F.collect_list("vec").alias("query_vecs"))
    shards = graphs.select("dim", "shard")
    pairs = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(
        materialize(grouped, "query-blocks").join(shards, "dim"), ["dim", "shard", "block"])
    # The keys of the join: no further shuffle, and one graph in memory at a time.
    found = pairs.groupBy("dim", "shard", "block").applyInPandas(_search(k, beam), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
