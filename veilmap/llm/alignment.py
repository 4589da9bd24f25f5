"""Alignment of two tokenizers over the texts of a corpus, in Arrow arrays.

Both tokenizers encode every text.  Token lengths, summed up within each document, give the byte
offset where a token ends; a hash join on (document, end) finds the places where both end, which cut the
tokens into groups, and every end of either is one link: the two tokens that cover the bytes before it.

Documents travel in packs of a few megabytes, as ids.  A pack counts its linked id pairs with a grouping in
its task; Spark adds up the partial counts, and each pack gets the counts of its own distinct pairs
back, aligns its ids again and sums up.  So a pair crosses the network once per pack, however often it occurs.
"""

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmap.sources.storage import materialize

PACK = 8 << 20
SLICE = 1 << 20
SEGMENT = 1 << 16
# A run without (or of) white space of this length goes to the library whose merging of one long word is not quadratic.
_RUN = re.compile(r"\S{2048}|\s{2048}")
# Fixed value: the words of byte-level models, as their configuration names them.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=[^\s▁]) (?=[A-Za-z])")


def _large(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


def _segments(text: str) -> list[str]:
    """The text cut before blanks between words, where both kinds of model start a new token
    whatever comes before; short texts are one segment."""
    if len(text) <= SEGMENT:
        return [text]
    out, at = [], 0
    while len(text) - at > SEGMENT:
        cut = _CUT.search(text, at + SEGMENT)
        if cut is None:
            break
        out.append(text[at:cut.start()])
        at = cut.start()
    return [*out, text[at:]]


class ByteLevelBPE:
    """A byte-level model in the JSON form of the `tokenizers` library; texts are encoded behind one
    blank, and strings of special tokens are plain text."""

    def __init__(self, source: str):
        self.source = source
        spec = json.loads(source)
        words, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"]:
            raise ValueError("only byte-level models without normaliser and prefix are supported")
        # Printable characters stand for the bytes; the others are moved behind 255 in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in set(plain)]
        code = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}
        special = {t["id"] for t in spec["added_tokens"]}
        self.bytes_ = [b""] * (1 + max(max(words.values()), max(special, default=0)))
        for word, i in words.items():
            if i not in special:
                self.bytes_[i] = bytes(code[c] for c in word)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        # Merges in order of ids can be ranked by the id of what they make.
        self._ranked = all(words.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs))
        self._fast = self._exact = None

    def __reduce__(self):
        return ByteLevelBPE, (self.source,)

    @classmethod
    def load(cls, path: str) -> "ByteLevelBPE":
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    def _library(self):
        if self._exact is None:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_str(self.source)
            self._exact.encode_special_tokens = True
        return self._exact

    def _ranks(self):
        if self._fast is None:
            import tiktoken

            ranks = {b: i for i, b in enumerate(self.bytes_) if b}
            self._fast = tiktoken.Encoding("ranks", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})
        return self._fast

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if not self._ranked or _RUN.search(text):
            ids = self._library().encode(" " + text, add_special_tokens=False).ids
            return np.array(ids, np.int32)
        first, *rest = _segments(text)
        return np.concatenate([self._ranks().encode_to_numpy(s, allowed_special=set(), disallowed_special=()).astype(np.int32)
                               for s in (" " + first, *rest)])


class PieceBPE:
    """A sentence-piece model with a prefixed blank and byte fallback, as a serialised file."""

    def __init__(self, source: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.source, self._model = source, None
        model = proto.ModelProto()
        model.ParseFromString(source)
        if not model.normalizer_spec.add_dummy_prefix:
            raise ValueError("only models that add a blank in front are supported")
        self.bytes_ = []
        for p in model.pieces:
            self.bytes_.append(bytes([int(p.piece[3:5], 16)]) if p.type == 6 else
                               p.piece.replace("▁", " ").encode() if p.type in (1, 4) else b"")
        # A blank inside a piece would let tokens span the places where long texts are cut.
        self._whole = any("▁" in p.piece.lstrip("▁") for p in model.pieces)

    def __reduce__(self):
        return PieceBPE, (self.source,)

    @classmethod
    def load(cls, path: str) -> "PieceBPE":
        with open(path, "rb") as f:
            return cls(f.read())

    def encode(self, text: str) -> np.ndarray:
        if self._model is None:
            import sentencepiece

            self._model = sentencepiece.SentencePieceProcessor(model_proto=self.source)
        first, *rest = [text] if self._whole else _segments(text)
        # The model puts back the blank that the later segments start with.
        return np.concatenate([np.array(self._model.encode(s), np.int32) for s in (first, *[s[1:] for s in rest])])


class _Side:
    """A tokenizer's tables as Arrow arrays."""

    def __init__(self, model):
        self.model = model
        self.bytes_ = pa.array(model.bytes_, pa.large_binary())
        self.sizes = pa.array([len(b) for b in model.bytes_], pa.int64())
        self.names = pa.array([str(i) for i in range(len(model.bytes_))], pa.large_string())

    def lists(self, texts: list) -> pa.LargeListArray:
        ids = [self.model.encode(t or "") for t in texts]
        at = np.cumsum([0, *map(len, ids)])
        return pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(np.concatenate(ids), pa.int32()))

    def joined(self, lists: pa.LargeListArray) -> pa.Array:
        flat = pc.take(self.bytes_, pc.list_flatten(lists))
        return pc.binary_join(pa.LargeListArray.from_arrays(lists.offsets, flat), pa.scalar(b"", pa.large_binary()))

    def ends(self, lists: pa.LargeListArray, name: str) -> pa.Table:
        """(doc, end, <name>: place of the token): where each token ends within its document."""
        doc = pc.list_parent_indices(lists)
        total = pc.cumulative_sum(pc.take(self.sizes, pc.list_flatten(lists)))
        upto = pa.concat_arrays([pa.array([0], pa.int64()), total])
        end = pc.subtract(total, pc.take(pc.take(upto, lists.offsets[:-1]), doc))
        return pa.table({"doc": doc, "end": end, name: pa.array(np.arange(len(doc)), pa.int64())})

    def written(self, flat: pa.Array, ends: np.ndarray) -> pa.Array:
        """The ids of each group as decimals, joined by commas."""
        at = pa.array(np.concatenate([[0], ends]), pa.int64())
        return pc.binary_join(pa.LargeListArray.from_arrays(at, pc.take(self.names, flat)), _large(","))


def _kept(lists: pa.LargeListArray, good: np.ndarray) -> pa.LargeListArray:
    """Lists of rows that are not good are emptied."""
    if good.all():
        return lists
    many = np.diff(lists.offsets.to_numpy())
    flat = lists.values.to_numpy()[np.repeat(good, many)]
    at = np.concatenate([[0], np.cumsum(np.where(good, many, 0))])
    return pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(flat, pa.int32()))


def _encoded(texts: pa.Array, a: _Side, b: _Side) -> tuple[pa.LargeListArray, pa.LargeListArray]:
    """Ids of both models; none for texts that one of them does not give back byte for byte."""
    words = texts.to_pylist()
    one, two = a.lists(words), b.lists(words)
    source = pc.binary_join_element_wise(_large(""), texts.cast(pa.large_string()), _large(" ")).cast(pa.large_binary())
    good = pc.and_(pc.equal(a.joined(one), source), pc.equal(b.joined(two), source)).fill_null(False).to_numpy(zero_copy_only=False)
    good &= np.array([bool(w) for w in words])
    return _kept(one, good), _kept(two, good)


class _Aligned:
    """Ends of the tokens of some texts, joined: one row per end of either model, in order."""

    def __init__(self, one: pa.LargeListArray, two: pa.LargeListArray, a: _Side, b: _Side):
        ends = a.ends(one, "a").join(b.ends(two, "b"), ["doc", "end"], join_type="full outer", use_threads=False)
        ends = ends.sort_by([("doc", "ascending"), ("end", "ascending")]).combine_chunks()
        self.doc, self.rows = ends.column("doc").to_numpy(), len(one)
        self._at = [ends.column(c).combine_chunks() for c in "ab"]
        self._flat, self._sides = [pc.list_flatten(x) for x in (one, two)], (a, b)
        self.common = pc.and_(*[x.is_valid() for x in self._at])

    def codes(self) -> pa.Array:
        """The two ids of each link as one number: the tokens over the bytes before an end are the next ones to end."""
        one, two = [pc.take(f, pc.fill_null_backward(x)).cast(pa.int64()) for f, x in zip(self._flat, self._at)]
        return pc.add(pc.multiply(one, len(self._sides[1].sizes)), two)

    def offsets(self, of: np.ndarray) -> pa.Array:
        return pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=self.rows))]), pa.int64())

    def groups(self) -> tuple[np.ndarray, pa.Array]:
        """Number of groups of each text, and the groups written out."""
        parts = [s.written(f, pc.filter(x, self.common).to_numpy() + 1) for s, f, x in zip(self._sides, self._flat, self._at)]
        of = self.doc[self.common.to_numpy(zero_copy_only=False)]
        group = pc.binary_join_element_wise(*parts, _large("|"))
        return np.bincount(of, minlength=self.rows), pc.binary_join(
            pa.LargeListArray.from_arrays(self.offsets(of), group), _large(";"))


def _packed(pack: int, ids: list[pa.RecordBatch], counts: list[pa.Table], width: int) -> pa.RecordBatch:
    """One row: the ids of a pack's documents as a compressed Arrow stream, its distinct pairs and their counts."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, ids[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        for batch in ids:
            out.write_batch(batch)
    total = pa.concat_tables(counts).group_by("code", use_threads=False).aggregate([("count_all", "sum")])
    code = total.column("code").to_numpy()
    columns = [pa.array([pack], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
    for x in (code // width, code % width, total.column("count_all_sum").to_numpy()):
        columns.append(pa.array([x], pa.list_(pa.int64())))
    return pa.RecordBatch.from_arrays(columns, ["pack", "data", "a", "b", "n"])


def _slices(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    """The rows of a batch in parts of about `SLICE` bytes, or one row."""
    size = pc.binary_length(batch.column("text")).fill_null(0).cast(pa.int64()).to_numpy()
    part = np.cumsum(size) // SLICE
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(size)]])
    return [batch.slice(i, j - i) for i, j in zip(cuts, cuts[1:]) if j > i]


def _pack(a_model, b_model):
    def run(batches):
        a, b = _Side(a_model), _Side(b_model)
        # The number of the partition and a count name a pack alike if a task runs again.
        pack = TaskContext.get().partitionId() << 32
        ids, counts, size = [], [], 0
        for batch in batches:
            for rows in _slices(batch):
                if ids and size + rows.nbytes > PACK:
                    yield _packed(pack, ids, counts, len(b.sizes))
                    ids, counts, size, pack = [], [], 0, pack + 1
                one, two = _encoded(rows.column("text"), a, b)
                counts.append(pa.table({"code": _Aligned(one, two, a, b).codes()}).group_by(
                    "code", use_threads=False).aggregate([([], "count_all")]))
                ids.append(pa.RecordBatch.from_arrays([rows.column("id"), one, two], ["id", "a", "b"]))
                size += rows.nbytes
        if ids:
            yield _packed(pack, ids, counts, len(b.sizes))
    return run


def _answer(a_model, b_model):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The documents of one pack with sums over the counts of their links."""
        a, b = _Side(a_model), _Side(b_model)
        width = len(b.sizes)
        known = pc.add(pc.multiply(right.column("a"), width), right.column("b")).combine_chunks()
        count, best = right.column("count").combine_chunks(), right.column("best").combine_chunks().cast(pa.int64())
        out = []
        for ids in pa.ipc.open_stream(left.column("data")[0].as_buffer()):
            one, two = ids.column("a"), ids.column("b")
            aligned = _Aligned(one, two, a, b)
            place = pc.index_in(aligned.codes(), value_set=known)
            sums = pa.table({"doc": aligned.doc, "count": pc.take(count, place), "best": pc.take(best, place)}).group_by(
                "doc", use_threads=False).aggregate([([], "count_all"), ("best", "sum"), ("count", "sum")])
            n_groups, groups = aligned.groups()
            cols = [ids.column("id"), np.diff(one.offsets.to_numpy()), np.diff(two.offsets.to_numpy()), n_groups]
            for name in ("count_all", "best_sum", "count_sum"):
                x = np.zeros(ids.num_rows, np.int64)
                x[sums.column("doc").to_numpy()] = sums.column(name).to_numpy()
                cols.append(x)
            out.append(pa.RecordBatch.from_arrays([*map(pa.array, cols), groups.cast(pa.string())], ["id", *RESULT]))
        return pa.Table.from_batches(out)
    return run


RESULT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def packs(docs: DataFrame, a, b, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(pack, data, a, b, n): ids of the documents in packs, and each pack's distinct linked pairs with counts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return materialize(rows.mapInArrow(
        _pack(a, b), "pack long, data binary, a array<long>, b array<long>, n array<long>"), "aligned")


def pair_counts(packed: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links hold a pair of ids, and whether no other pair of its `b` has more."""
    partial = packed.select(F.inline(F.arrays_zip("a", "b", "n")))
    counts = materialize(partial.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair-counts")
    # One row per id of the second vocabulary at most.
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, a, b, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for every row.

    `a` and `b` are loaded models (`ByteLevelBPE`, `PieceBPE`).  `groups` holds the aligned ids as text,
    `a1,a2|b1;a3|b2,b3`.  `n_links` counts pairs of overlapping tokens, `count_sum` adds up how many links of the
    corpus hold the same two ids, and `n_best` counts links whose pair no pair of the same `b` id surpasses.

    Null and empty texts, and those that one of the models does not give back byte for byte, have no tokens: zeros
    and an empty `groups`.  Repeated rows are counted and returned each, null ids are a value like others, other
    columns are ignored, and an empty table gives no rows.  A very long text is encoded in segments, cut
    where neither model has a token across.
    """
    packed = packs(docs, a, b, id_col, text)
    asked = packed.select("pack", F.inline(F.arrays_zip("a", "b")))
    answers = asked.join(pair_counts(packed), ["a", "b"]).select("pack", "a", "b", "count", "best")
    kind = docs.select(F.col(id_col)).schema[0].dataType
    schema = T.StructType([T.StructField("id", kind), *[T.StructField(c, T.LongType()) for c in RESULT[:-1]],
                           T.StructField("groups", T.StringType())])
    found = packed.select(F.col("pack").alias("own"), "data").groupBy("own").cogroup(answers.groupBy("pack")).applyInArrow(_answer(a, b), schema)
    return found.withColumnRenamed("id", id_col)
