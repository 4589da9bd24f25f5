"""Language-model scoring by Katz backoff over bigrams.

Good-Turing discounted counts; bigrams below `min_count` are left to the unigram (1: none is); per context,
the mass that seen bigrams leave goes to the unseen ones with exactly normalised weights.

Texts are packed: a pack holds the documents of a few megabytes, compressed.  Each pack asks for
the counts of its own distinct words and then bigrams, in lists by partition; the partition
adds up what the packs have seen and answers each pack in the order it asked.  So a word or
bigram crosses the network once per pack, not once per occurrence, and the model lives in
partitioned tables that no task reads whole.  A word's hash travels once per pack: the answer numbers
it within its partition, and bigrams are lists of such numbers, with the counts of their second words, so that
the unigram mass of what follows a context is summed where its bigrams are.
"""

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmap.llm.common import spread
from veilmap.llm.words import hashed_words, mixed
from veilmap.sources.storage import materialize

ORDER, CUT, MIN_COUNT = 2, 5, 2
HEAD = 1 << 16
PACK = 16 << 20
_START, _END = np.uint64(1), np.uint64(2)
_LIST = "kind string, pack string, p long, data array<binary>, ints array<long>"
_TYPES = {"kind": pa.string(), "pack": pa.string(), "p": pa.int64(), "data": pa.list_(pa.binary()), "ints": pa.list_(pa.int64())}


def _rows(rows: list[dict]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r.get(f) for r in rows], t) for f, t in _TYPES.items()], list(_TYPES))


def _squeezed(x: np.ndarray) -> bytes:
    """Doubles, or whole numbers from 0 on in their least width, compressed with bytes of equal rank together."""
    if x.dtype.kind != "f":
        x = x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))
    ranks = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return x.dtype.str[1:].encode() + len(x).to_bytes(8, "little") + pa.compress(ranks.tobytes(), "zstd", asbytes=True)


def _numbers(data: bytes) -> np.ndarray:
    """What `_squeezed` was given; whole numbers as int64 or uint64."""
    kind, n = np.dtype(data[:2].decode()), int.from_bytes(data[2:10], "little")
    if not n:
        return np.zeros(0, np.float64 if kind.kind == "f" else np.int64)
    ranks = pa.decompress(data[10:], n * kind.itemsize, "zstd", asbytes=True)
    x = np.frombuffer(ranks, np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).ravel()
    return x if kind.itemsize == 8 else x.astype(np.int64)


def _steps(x: np.ndarray) -> np.ndarray:
    """Ascending numbers as the first and the differences; `np.cumsum` gives them back."""
    return np.diff(x, prepend=x.dtype.type(0))


def _slices(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    """The rows of a batch in equal parts of about half a pack at most."""
    parts = max(1, -(-2 * batch.nbytes // PACK))
    rows = -(-batch.num_rows // parts)
    return [batch.slice(at, rows) for at in range(0, batch.num_rows, max(rows, 1))]


def _pack(batches):
    """Documents packed into compressed Arrow streams."""
    def out(held):
        table = pa.Table.from_batches(held)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table, max_chunksize=1000)
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().hex]), pa.array([sink.getvalue().to_pybytes()], pa.large_binary()).cast(pa.binary())],
            ["pack", "data"])

    held, size = [], 0
    for batch in batches:
        for part in _slices(batch):
            if held and size + part.nbytes > PACK:
                yield out(held)
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held:
        yield out(held)


@dataclass
class _Counted:
    """Distinct words and bigrams of a pack, and the documents they stand in."""
    rows: pa.Table          # all columns but the text
    ends: np.ndarray        # tokens up to the end of each document
    token: np.ndarray       # each token as index into words
    words: np.ndarray       # distinct hashes, ascending; start and end marks among them
    word_n: np.ndarray      # occurrences in training documents
    pair: np.ndarray        # each token's bigram as index into pairs
    first: np.ndarray       # context of each distinct bigram, as index into words
    second: np.ndarray
    pair_n: np.ndarray


def _ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in ascending order, and the place of each item among them."""
    order = np.argsort(x, kind="stable")
    x = x[order]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    place = np.empty(len(x), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return x[new], place


def _count(data: bytes) -> _Counted:
    table = pa.ipc.open_stream(data).read_all()
    use = table.column("train").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
    stream, lengths = [np.array([_START])], []
    for batch in table.to_batches():
        for lo, hi, h, at in hashed_words(batch.column("text"), lower=True):
            h = np.where(h <= _END, h + np.uint64(3), h)
            stream.append(np.insert(h, at[1:], _END))
            lengths.append(np.diff(at) + 1)
    rows, n = table.drop_columns(["text"]), np.concatenate(lengths)
    table = batch = None
    words, place = _ranked(np.concatenate(stream))
    stream = None
    # Shifted by the start mark in front, `place` is each token's predecessor but at starts of texts.
    ends = np.cumsum(n)
    before = place[:-1].copy()
    before[ends[:-1]] = place[0]
    place = place[1:]
    seen = np.repeat(use, n)
    word_n = np.bincount(place[seen], minlength=len(words))
    code = before.astype(np.int64) * len(words)
    code += place
    before = None
    pairs, pair = _ranked(code)
    code = None
    return _Counted(rows, ends, place, words, word_n, pair, (pairs // len(words)).astype(np.int32),
                    (pairs % len(words)).astype(np.int32), np.bincount(pair[seen], minlength=len(pairs)))


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(parts)).astype(np.int64)


def _pair_part(first: np.ndarray, second: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """Bigrams are where their context is numbered, but for hot contexts."""
    p = first % parts
    spread_out = np.flatnonzero(np.isin(first, hot))
    p[spread_out] = _part(first[spread_out].view(np.uint64) ^ mixed(second[spread_out].view(np.uint64)), parts)
    return p


def _split(p: np.ndarray, parts: int):
    """Index arrays by partition, in ascending order each."""
    order = np.argsort(p, kind="stable")
    return np.split(order, np.searchsorted(p[order], np.arange(1, parts)))


def _ask_words(parts: int):
    def run(batches):
        for batch in batches:
            for pack, data in zip(batch.column("pack").to_pylist(), batch.column("data")):
                c = _count(data.as_buffer())
                for p, at in enumerate(_split(_part(c.words, parts), parts)):
                    if len(at):
                        yield from _rows([{"kind": "list", "pack": pack, "p": p, "data": [
                            _squeezed(_steps(c.words[at])), _squeezed(c.word_n[at])]}]).to_batches()
    return run


def _numbered(c: _Counted, parts: int, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, dict]:
    """(count, number) of each word of a pack from the answers of the words' partitions, and what else they hold
    as {partition: (words, data)}."""
    n, number, more = np.zeros(len(c.words), np.int64), np.zeros(len(c.words), np.int64), {}
    by = _split(_part(c.words, parts), parts)
    for kind, p, data in zip(answers.column("kind").to_pylist(), answers.column("p").to_pylist(), answers.column("data").to_pylist()):
        if kind != "pairs":
            n[by[p]] = _numbers(data[0])
            number[by[p]] = np.cumsum(_numbers(data[1])) * parts + p
            more[p] = by[p], data[2:]
    return n, number, more


def _ask_pairs(parts: int, hot: np.ndarray, head: np.ndarray):
    """A list holds the distinct contexts, how many bigrams each has, and of these the second words, their counts (0 for
    frequent ones) and the bigrams' own."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        c, out = _count(left.column("data")[0].as_buffer()), []
        n, number, _ = _numbered(c, parts, right)
        n[np.isin(number, head)] = 0
        for p, at in enumerate(_split(_pair_part(number[c.first], number[c.second], hot, parts), parts)):
            if len(at):
                heads, runs = np.unique(c.first[at], return_counts=True)
                out.append({"kind": "list", "pack": left.column("pack")[0].as_py(), "p": p, "data": [_squeezed(x) for x in (
                    number[heads], runs, number[c.second[at]], n[c.second[at]], c.pair_n[at])]})
        return _rows(out)
    return run


def _class_counts(n: np.ndarray) -> np.ndarray:
    """How many items occur r times, r = 1 .. CUT + 1."""
    return np.bincount(n[n <= CUT + 1], minlength=CUT + 2)[1:]


def _answer_words(table: pa.Table) -> pa.Table:
    """Adds up the lists of one partition and numbers its words: their counts, sums, and each pack's answer."""
    lists = table.column("data").to_pylist()
    asked = [np.cumsum(_numbers(steps).astype(np.uint64), dtype=np.uint64) for steps, _ in lists]
    words, place = np.unique(np.concatenate(asked), return_inverse=True)
    n = np.bincount(place, np.concatenate([_numbers(seen) for _, seen in lists]), len(words)).astype(np.int64)
    p, out = table.column("p")[0].as_py(), []
    cuts = np.cumsum([len(a) for a in asked])[:-1]
    for pack, at in zip(table.column("pack").to_pylist(), np.split(place, cuts)):
        out.append({"kind": "back", "pack": pack, "p": p, "data": [_squeezed(n[at]), _squeezed(_steps(at))]})
    out.append({"kind": "table", "p": p, "data": [_squeezed(n)]})
    out.append({"kind": "sums", "p": p, "ints": np.concatenate([[n.sum(), (n > 0).sum()], _class_counts(n[n > 0])])})
    return _rows(out)


def _frequent(parts: int, total: int, most: int):
    """(number, count) of the words that make up at least a `most`-th of all tokens."""
    def run(batches):
        for batch in batches:
            for p, (counts,) in zip(batch.column("p").to_pylist(), batch.column("data").to_pylist()):
                n = _numbers(counts)
                at = np.flatnonzero((n > 0) & (n * most >= total))
                yield pa.RecordBatch.from_arrays([pa.array(at * parts + p, pa.int64()), pa.array(n[at], pa.int64())], ["w", "n"])
    return run


def discounts(classes: list[int]) -> np.ndarray:
    """Good-Turing discount ratios of counts 0 .. CUT + 1 (1 beyond CUT; 0 for 0), in Katz's form.
    Where the classes do not give ratios within (0, 1), half a count is taken off."""
    d = np.ones(CUT + 2)
    d[0] = 0
    r, n = np.arange(1, CUT + 1), np.array(classes, float)
    with np.errstate(all="ignore"):
        share = (CUT + 1) * n[CUT] / n[0]
        got = ((r + 1) * n[1:CUT + 1] / (n[:CUT] * r) - share) / (1 - share)
    d[1:-1] = np.where(np.isfinite(got) & (got > 0) & (got < 1), got, (r - 0.5) / r)
    return d


@dataclass
class Unigrams:
    """The lower order: discounted relative frequencies; the mass taken off is that of any unseen token."""
    total: int
    kinds: int
    d: np.ndarray
    unseen: float
    scale: float = 1.0

    @classmethod
    def fitted(cls, total: int, kinds: int, classes: list[int]) -> "Unigrams":
        d = discounts(classes)
        r = np.arange(1, CUT + 1)
        taken = ((1 - d[1:-1]) * r * np.array(classes[:CUT])).sum()
        if taken > 0:
            return cls(total, kinds, d, taken / total)
        # Without rare words no mass is taken off: half a count is kept for unseen ones.
        return cls(total, kinds, d, 0.5 / (total + 0.5), total / (total + 0.5))

    def p(self, n: np.ndarray) -> np.ndarray:
        return np.where(n > 0, self.scale * self.d[np.minimum(n, CUT + 1)] * n / max(self.total, 1), self.unseen)


def _answer_pairs(uni: Unigrams, head: np.ndarray, head_n: np.ndarray, parts: int, min_count: int):
    """Adds up bigrams of one partition: answers, class sums, and per context what its stored bigrams hold and the
    unigram mass of their second words, for the partition that numbers it."""
    def run(table: pa.Table) -> pa.Table:
        p = table.column("p")[0].as_py()
        lists = [[_numbers(x) for x in row] for row in table.column("data").to_pylist()]
        cuts = np.cumsum([len(x[2]) for x in lists])[:-1]
        v = np.concatenate([np.repeat(x[0], x[1]) for x in lists])
        w, w_n, seen = (np.concatenate([x[i] for x in lists]) for i in (2, 3, 4))
        lists = None
        order = np.lexsort((w, v))
        new = np.ones(len(order), bool)
        new[1:] = (v[order][1:] != v[order][:-1]) | (w[order][1:] != w[order][:-1])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        n = np.bincount(place, seen).astype(np.int64)
        out = [{"kind": "pairs", "pack": pack, "p": p, "data": [_squeezed(back)]}
               for pack, back in zip(table.column("pack").to_pylist(), np.split(n[place], cuts))]
        out.append({"kind": "sums", "p": p, "ints": _class_counts(n)})
        first = order[new][n >= min_count]
        v, w, w_n, n = v[first], w[first], w_n[first], n[n >= min_count]
        if len(v):
            ctx, inv = np.unique(v, return_inverse=True)
            held = [np.bincount(inv, n == r, len(ctx)) for r in range(min_count, CUT + 1)]
            held.append(np.bincount(inv, np.where(n > CUT, n, 0), len(ctx)))
            if len(head):
                at = np.minimum(np.searchsorted(head, w), len(head) - 1)
                w_n = np.where(head[at] == w, head_n[at], w_n)
            mass = np.bincount(inv, uni.p(w_n), len(ctx))
            for q in np.unique(ctx % parts):
                at = np.flatnonzero(ctx % parts == q)
                out.append({"kind": "ctx", "p": q, "data": [
                    _squeezed(ctx[at] // parts), _squeezed(mass[at]), *[_squeezed(h[at].astype(np.int64)) for h in held]]})
        return _rows(out)
    return run


def _weights(d: np.ndarray, docs: int, parts: int, min_count: int):
    """Answers each pack with the logarithms of the backoff weight and of the scale of seen
    bigrams for each of its words as context, as lists of distinct ones and each word's place in these."""
    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("kind").to_pylist(), table.column("pack").to_pylist(), table.column("data").to_pylist()))
        p = table.column("p")[0].as_py()
        count = _numbers(next(data for kind, _, data in rows if kind == "table")[0]).copy()
        if p == _part(np.array([_START]), parts)[0]:
            # The mark of starts is the least of all hashes.
            count[0] = docs
        ctx = [[_numbers(x) for x in data] for kind, _, data in rows if kind == "ctx"]
        alpha, scale = np.zeros(len(count)), np.zeros(len(count))
        if ctx:
            place, mass, *held = (np.concatenate(x) for x in zip(*ctx))
            at, place = np.unique(place, return_inverse=True)
            held = np.stack([np.bincount(place, h, len(at)) for h in held], 1)
            r = np.arange(min_count, CUT + 1)
            seen, c = held @ np.append(d[min_count:CUT + 1] * r, 1.0), count[at].astype(float)
            # A context whose bigrams are all frequent leaves nothing: half a count is kept for others.
            left_over = np.maximum(1 - seen / c, 0.5 / (c + 0.5))
            scale[at] = np.log10((1 - left_over) / (seen / c))
            alpha[at] = np.log10(left_over / np.maximum(1 - np.bincount(place, mass, len(at)), 1e-12))
        both, which = np.unique(alpha + 1j * scale, return_inverse=True)
        out = []
        for kind, pack, data in rows:
            if kind == "back":
                used, at = np.unique(which[np.cumsum(_numbers(data[1]))], return_inverse=True)
                out.append({"kind": "word", "pack": pack, "p": p, "data": [
                    *data, _squeezed(both[used].real), _squeezed(both[used].imag), _squeezed(at)]})
        return _rows(out)
    return run


def _score(parts: int, hot: np.ndarray, uni: Unigrams, d: np.ndarray, docs: int, names: list[str], min_count: int):
    """Scores the documents of one pack from the answers to its lists."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        c = _count(left.column("data")[0].as_buffer())
        alpha, scale = np.zeros(len(c.words)), np.zeros(len(c.words))
        n_pair = np.zeros(len(c.first), np.int64)
        n_word, number, weights = _numbered(c, parts, right)
        for words, (a, s, at) in weights.values():
            alpha[words], scale[words] = _numbers(a)[_numbers(at)], _numbers(s)[_numbers(at)]
        by_pair = _split(_pair_part(number[c.first], number[c.second], hot, parts), parts)
        for kind, p, data in zip(right.column("kind").to_pylist(), right.column("p").to_pylist(), right.column("data").to_pylist()):
            if kind == "pairs":
                n_pair[by_pair[p]] = _numbers(data[0])
        context = np.where(c.words == _START, docs, n_word)
        lower = np.log10(uni.p(n_word))
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = np.log10(d[np.minimum(n_pair, CUT + 1)] * n_pair / context[c.first]) + scale[c.first]
        value = np.where(n_pair >= min_count, seen, alpha[c.first] + lower[c.second])
        base = np.log10((n_word + 0.5) / (uni.total + 0.5 * (uni.kinds + 1)))
        at = np.concatenate([[0], c.ends[:-1]])
        del seen, n_pair, alpha, scale
        sums = [np.add.reduceat(value[c.pair], at), np.add.reduceat(base[c.token], at),
                np.add.reduceat((n_word > 0).astype(np.int64)[c.token], at)]
        out = c.rows
        for name, col in zip(names, (np.diff(np.append(at, c.ends[-1])), sums[2], np.full(len(at), uni.total), sums[1], sums[0])):
            out = out.append_column(name, pa.array(col))
        return out
    return run


RESULT = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def score(docs: DataFrame, train: str = "train", id_col: str = "doc_id", text: str = "text",
          min_count: int = MIN_COUNT) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) for every row; the model is
    learnt from the rows whose boolean column `train` is true.

    Null and empty texts are one end mark.  Repeated rows are counted and scored each.  A null `train` is
    false.  Without training rows, or on an empty table, scores come from an empty model: every
    token is unseen.  Other columns are ignored.  `n_known` counts tokens seen in training;
    `base_score` is the additive unigram model.
    With `min_count` 1 every bigram of the training rows has its discounted count.
    """
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(train), F.lit(False)).alias("train"), F.col(text).alias("text"))
    packs = materialize(rows.mapInArrow(_pack, "pack string, data binary"), "packs")
    parts = max(spread(docs), 2 * packs.count())
    docs_n = rows.where("train").count()
    words = materialize(packs.mapInArrow(_ask_words(parts), _LIST).groupBy("p").applyInArrow(_answer_words, _LIST), "words")
    sums = words.where("kind = 'sums'").select(F.posexplode("ints").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n"))
    total, kinds, *classes = [r["n"] for r in sums.orderBy("i").collect()] or [0] * (CUT + 3)
    uni = Unigrams.fitted(total, kinds, classes) if total else Unigrams(0, 0, discounts(classes), 1.0)
    # Words of at least a HEAD-th of all tokens; there cannot be more than HEAD.
    head = words.where("kind = 'table'").select("p", "data").mapInArrow(_frequent(parts, total, HEAD), "w long, n long").orderBy("w").toPandas()
    head_w, head_n = head["w"].to_numpy(np.int64), head["n"].to_numpy(np.int64)
    often = words.where("kind = 'table'").select("p", "data").mapInArrow(_frequent(parts, total, parts), "w long, n long")
    # The mark of starts has number 0 in its partition.
    hot = np.append(_part(np.array([_START]), parts), np.array([r["w"] for r in often.collect()], np.int64))
    told = words.where("kind = 'back'")
    pairs = packs.groupBy("pack").cogroup(told.groupBy("pack")).applyInArrow(_ask_pairs(parts, hot, head_w), _LIST)
    pairs = materialize(pairs.groupBy("p").applyInArrow(_answer_pairs(uni, head_w, head_n, parts, min_count), _LIST), "pairs")
    sums = pairs.where("kind = 'sums'").select(F.posexplode("ints").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n"))
    d = discounts([r["n"] for r in sums.orderBy("i").collect()] or [0] * (CUT + 1))
    asked = words.where("kind in ('back', 'table')").unionByName(pairs.where("kind = 'ctx'"))
    answers = asked.groupBy("p").applyInArrow(_weights(d, docs_n, parts, min_count), _LIST).unionByName(pairs.where("kind = 'pairs'"))
    out = f"{id_col} {dict(rows.dtypes)[id_col]}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(
        _score(parts, hot, uni, d, docs_n, RESULT, min_count), out)
