"""Prefix tree of conversations: which first turns are shared by whom.

A conversation becomes a key: for each turn in order the digest of its role and text, and its
number of words.  Keys are sorted over the cluster, so conversations with a common beginning are
neighbours.  Blocks of neighbours are joined by union-find, over the edges between them in descending
order of the turns they have in common: where components meet, a node of the tree branches.

What can go on in a neighbouring block lies on the path of the block's first or of its last key.  All
other nodes are final.  The two paths, with what the final nodes below them add up to, are the block's
contracted forest; they are keys again, and are sorted and joined in the same way until one block is left.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmap.sources.storage import materialize

# Bytes of a turn in a key: 16 of its digest, 4 of its number of words.
ENTRY = 20
BLOCK = 4096
BLOCK_BYTES = 32 << 20
_EMPTY = hashlib.sha256(b"").hexdigest()

# depth, members, smallest member, members that end here, children, leaves and savings of what is final below.
_MARK = pa.list_(pa.list_(pa.int64()))
_ROW = {"kind": pa.string(), "block": pa.int64(), "conv": pa.int64(), "depth": pa.int64(), "parent": pa.int64(),
        "ask": pa.binary(), "digest": pa.binary(), "n": pa.int64(), "ends": pa.int64(), "children": pa.int64(),
        "leaves": pa.int64(), "saved": pa.int64(), "key": pa.binary(), "marks": _MARK, "text": pa.string()}
_SCHEMA = ("kind string, block long, conv long, depth long, parent long, ask binary, digest binary, n long, ends long, "
           "children long, leaves long, saved long, key binary, marks array<array<long>>, text string")
COLUMNS = ["depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_entry(role: Column, text: Column) -> Column:
    """A turn as hexadecimal digits: digest of role and text, and number of words; null is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    own = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.concat(F.substring(F.sha2(own, 256), 1, 32), F.lpad(F.hex(words), 8, "0"))


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, entries: array<string>): the turns of each conversation in order, null first; equal numbers are ordered by
    role, then by the digest of the text, and all are kept.  Rows without a conversation id are left out.
    A conversation is one row of 40 bytes a turn; its texts are not collected."""
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        turn_entry(F.col(role), F.col(text)).alias("entry"))
    listed = F.sort_array(F.collect_list(F.struct("turn", "role", "entry")))
    return rows.groupBy("conv").agg(F.transform(listed, lambda t: t["entry"]).alias("entries"))


def _shared(a: bytes, b: bytes) -> int:
    """How many turns two keys have in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // ENTRY
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax()) // ENTRY


class _Words:
    """Sums of words over the turns of keys, summed up once per key."""

    def __init__(self, keys: list[bytes]):
        self._keys, self._sums = keys, {}

    def between(self, item: int, first: int, last: int) -> int:
        """Words of the turns at depths first .. last; the root has none."""
        first = max(first, 1)
        if last < first:
            return 0
        sums = self._sums.get(item)
        if sums is None:
            entries = np.frombuffer(self._keys[item], np.uint8).reshape(-1, ENTRY)[:, 16:].astype(np.int64)
            sums = self._sums[item] = np.concatenate([[0], np.cumsum(entries @ (1 << np.array([24, 16, 8, 0])))])
        return int(sums[last] - sums[first - 1])


class _Node:
    __slots__ = ("depth", "item", "kids", "open", "n", "conv", "ends", "children", "leaves", "saved", "digest")

    def __init__(self, depth: int, item: int, kids: list, open_: int):
        self.depth, self.item, self.kids, self.open = depth, item, kids, open_
        self.n = self.ends = self.children = self.leaves = self.saved = 0
        self.conv = None
        self.digest = b""

    def add(self, n: int, conv: int, ends: int, children: int, leaves: int, saved: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n, self.ends, self.children = self.n + n, self.ends + ends, self.children + children
        self.leaves, self.saved = self.leaves + leaves, self.saved + saved


def _nodes(keys: list[bytes], marks: list[list[list[int]]], root: bool) -> list[_Node]:
    """Nodes at which components of sorted keys meet or a mark stands, deepest first.

    Edges between neighbours and marks are taken in descending order of depth.  `root` asks for a node of
    depth 0 in any case.  A node is open towards the first key (1), the last (2), or not (0).
    """
    events: dict[int, tuple[list, list]] = {}
    for i in range(1, len(keys)):
        events.setdefault(_shared(keys[i - 1], keys[i]), ([], []))[0].append(i)
    for i, own in enumerate(marks):
        for depth, *mark in own:
            events.setdefault(depth, ([], []))[1].append((i, mark))
    if root:
        events.setdefault(0, ([], []))[1].append((0, None))
    above, size = list(range(len(keys))), [1] * len(keys)
    top: list[_Node | None] = [None] * len(keys)
    low, high = list(range(len(keys))), list(range(len(keys)))

    def find(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    out = []
    for depth in sorted(events, reverse=True):
        edges, own = events[depth]
        met: dict[int, list] = {}

        def tops(r: int) -> list:
            return met.pop(r, None) or ([top[r]] if top[r] is not None else [])

        for i in edges:
            a, b = find(i - 1), find(i)
            one, two = tops(a), tops(b)
            if len(one) < len(two):
                one, two = two, one
            one.extend(two)
            if size[a] < size[b]:
                a, b = b, a
            above[b], size[a] = a, size[a] + size[b]
            low[a], high[a] = min(low[a], low[b]), max(high[a], high[b])
            top[a] = None
            met[a] = one
        for i, _ in own:
            r = find(i)
            if r not in met:
                met[r] = tops(r)
        for r, kids in met.items():
            towards = 1 if low[r] == 0 else 2 if high[r] == len(keys) - 1 else 0
            # On an open path every node is described by the path's own key.
            item = 0 if towards == 1 else len(keys) - 1 if towards == 2 else low[r]
            top[r] = _Node(depth, item, kids, towards)
            out.append(top[r])
        for i, mark in own:
            if mark:
                top[find(i)].add(*mark)
    return out


def _digests(keys: list[bytes], nodes: list[_Node]) -> None:
    by_item: dict[int, list[_Node]] = {}
    for node in nodes:
        by_item.setdefault(node.item, []).append(node)
    for item, own in by_item.items():
        h, at = hashlib.blake2b(digest_size=16), 0
        for node in sorted(own, key=lambda v: v.depth):
            h.update(keys[item][at:node.depth * ENTRY])
            at = node.depth * ENTRY
            node.digest = h.digest()


def contract(keys: list[bytes], marks: list[list[list[int]]], block: int, last: bool) -> list[dict]:
    """Joins one block of sorted keys: rows of final nodes, and the keys of the contracted forest (none if `last`)."""
    nodes, words, rows = _nodes(keys, marks, last), _Words(keys), []
    _digests(keys, nodes)
    left: dict[int, list] = {1: [], 2: []}
    for node in nodes:
        is_open = node.open and not last
        final = [k for k in node.kids if last or not k.open]
        for kid in final:
            between = (kid.n - 1) * words.between(kid.item, node.depth + 1, kid.depth - 1)
            node.add(kid.n, kid.conv, 0, 1, kid.leaves, kid.saved + between)
        if is_open:
            if node.n:
                left[node.open].append([node.depth, node.n, node.conv, node.ends, node.children, node.leaves, node.saved])
        else:
            node.leaves += node.children == 0
            node.saved += (node.n - 1) * words.between(node.item, node.depth, node.depth)
        for kid in final:
            rows += _written(kid, node, is_open, words, block)
        if last and node.depth == 0:
            rows += _written(node, None, False, words, block)
    for towards, item in ((1, 0), (2, len(keys) - 1)):
        if left[towards]:
            rows.append({"kind": "item", "key": keys[item], "marks": left[towards]})
    return rows


def _written(node: _Node, parent: _Node | None, ask: bool, words: _Words, block: int) -> Iterator[dict]:
    """Rows of a final node and of the nodes with one child between its parent and it."""
    first = parent.depth + 1 if parent else node.depth
    saved = node.saved
    for depth in range(node.depth, first - 1, -1):
        own = depth == node.depth
        if not own:
            saved += (node.n - 1) * words.between(node.item, depth, depth)
        above = node.conv if depth > first else parent.conv if parent and not ask else None
        yield {"kind": "node", "block": block, "conv": node.conv, "depth": depth, "parent": above,
               "ask": parent.digest if ask and depth == first else None, "digest": node.digest if own else None,
               "n": node.n, "ends": node.ends if own else 0, "children": node.children if own else 1,
               "leaves": node.leaves, "saved": saved}


def _ends(keys: list[bytes], convs: list[int]) -> Iterator[dict]:
    """Rows of the conversations with equal keys, ids joined by commas."""
    at = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[at]:
            yield {"kind": "ends", "digest": hashlib.blake2b(keys[at], digest_size=16).digest(), "conv": convs[at],
                   "text": ",".join(map(str, convs[at:i]))}
            at = i


def _table(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in _ROW.items()], list(_ROW))


def _blocks(batches) -> Iterator[list[tuple]]:
    """Rows in order, in blocks of at most `BLOCK` and about `BLOCK_BYTES`, but of four at least."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("key", "conv", "marks")]):
            if len(held) >= BLOCK or (size > BLOCK_BYTES and len(held) >= 4):
                yield held
                held, size = [], 0
            held.append(row)
            size += len(row[0])
    if held:
        yield held


def _level(level: int, last: bool = False):
    def run(batches):
        block = (level << 56) + (TaskContext.get().partitionId() << 28)
        for rows in _blocks(batches):
            keys, convs, marks = map(list, zip(*rows))
            out = []
            if not level:
                out += _ends(keys, convs)
                marks = [[[len(k) // ENTRY, 1, c, 1, 0, 0, 0]] for k, c in zip(keys, convs)]
            yield _table(out + contract(keys, marks, block, last))
            block += 1
    return run


def _sha256(batches):
    """SHA-256 of each digest's chunks, which come in order, fed one after the other."""
    now, h = None, None
    for batch in batches:
        done = []
        for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist()):
            if digest != now:
                if h is not None:
                    done.append((now, h.hexdigest()))
                now, h = digest, hashlib.sha256()
                h.update(text.encode())
            else:
                h.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())],
                                         ["digest", "sha"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()])], ["digest", "sha"])


def prefix_tree(sequences: DataFrame, id_name: str = "conv_id") -> DataFrame:
    """One row per node of the prefix tree of (conv: long, entries: array<string>); see `conversations`.

    A node is a sequence of first turns; its members are the conversations that start with it.  Columns: the smallest
    member, named `id_name`, depth, the parent's smallest member (`parent_<id_name>`, null for the root), n_convs, n_children,
    n_leaves (childless nodes in the subtree), saved_tokens (over the subtree, words of a node's last turn for each member
    but one) and ends_sha256 (of the ids of members that end here, ascending, joined by commas).

    Conversations without turns are members of the root; equal ones share all their nodes; a null `entries` is empty.
    Ids must be distinct and not null.  An empty table has no nodes.  No task holds more than a block of keys, and ids of one
    node reach the task that hashes them in chunks.
    """
    rows = sequences.select("conv", F.unhex(F.coalesce(F.array_join("entries", ""), F.lit(""))).alias("key"),
                            F.lit(None).cast("array<array<long>>").alias("marks"))
    rows = materialize(rows, "keys")
    done = materialize(rows.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(_level(0), _SCHEMA), "tree")
    ends = done.where("kind = 'ends'").select("digest", "conv", "text")
    shas = ends.repartition("digest").sortWithinPartitions("digest", "conv").select("digest", "text").mapInArrow(
        _sha256, "digest binary, sha string")
    nodes, level = done.where("kind = 'node'"), 1
    while True:
        items = materialize(done.where("kind = 'item'").select("key", "conv", "marks"), "forest")
        n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.length("key")), F.lit(0))).first()
        if n <= 4 or (n <= BLOCK and size <= BLOCK_BYTES):
            break
        parts = min(n // 8 + 1, max(-(-n // BLOCK), -(-size // BLOCK_BYTES)))
        done = materialize(items.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(_level(level), _SCHEMA), "tree")
        nodes, level = nodes.unionByName(done.where("kind = 'node'")), level + 1
    # At most `BLOCK` contracted keys are left.
    done = materialize(items.coalesce(1).sortWithinPartitions("key").mapInArrow(_level(level, True), _SCHEMA), "tree")
    nodes = nodes.unionByName(done.where("kind = 'node'"))
    # A final node under an open one learns its parent's smallest member: each block asks once per parent.
    asked = nodes.where("ask is not null")
    known = nodes.where("digest is not null").select(F.col("digest").alias("ask"), F.col("conv").alias("found"))
    answers = asked.select("block", "ask").distinct().join(known, "ask")
    told = asked.join(answers, ["block", "ask"]).withColumn("parent", F.col("found")).select(nodes.columns)
    nodes = nodes.where("ask is null").unionByName(told)
    ending = nodes.where("ends > 0").join(shas, "digest").select(*nodes.columns, "sha")
    nodes = nodes.where("ends = 0").withColumn("sha", F.lit(_EMPTY)).unionByName(ending)
    return nodes.select(
        F.col("conv").alias(id_name), "depth", F.col("parent").alias(f"parent_{id_name}"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.col("sha").alias("ends_sha256"))
