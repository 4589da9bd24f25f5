"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three machines are compiled from a model file and composed with each input: the normaliser
(dummy prefix, spaces to U+2581), the lexicon (one arc per piece, weighted) with the byte
fallback (one arc per character that is no piece), and, for models of merges, an acceptor of
neighbouring pieces.  The ids are the output of the shortest path in the tropical semiring.

Unigram models weigh a piece by its negated score.  A model of merges admits exactly the paths on
which the merges of any two neighbouring pieces end in these two pieces; a text has one such
path, of weight zero, which is what merging yields.

No piece spans a change from another character to U+2581, nor, in most models, from a Latin
letter to ASCII punctuation; the machines pass through one state there.  Inputs are cut at these places and
each distinct part is composed once.
"""

import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
_UNKNOWN_COST = 10.0
_NEVER = float("-inf")
_HELD = 800_000
_ROWS = 256
_PARTS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
# ASCII characters that are neither letters nor digits, and Latin letters.
_PUNCTUATION = "".join(c for c in map(chr, range(128)) if not c.isalnum())
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_IS_LATIN = re.compile(f"[{_LATIN}]")
# Also cut before punctuation that follows a Latin letter.
_FINE_PARTS = re.compile(f"{MARK}*+(?:[^{MARK}{_LATIN}]++|[{_LATIN}]++(?![{re.escape(_PUNCTUATION)}]))*+(?:[{_LATIN}]++)?")


@dataclass
class Transducer:
    """A compiled model; `merges` says that neighbours are constrained."""
    ids: dict[str, int]
    cost: dict[str, float]
    rank: dict[str, float]
    bytes_: list[int]
    output: list[bytes]
    merges: bool
    prefix: bool
    longest: int
    fine: bool
    # The lexicon as arcs: a state is a dictionary from a character to the piece that ends there (or -1) and the next state.
    _arcs: dict = field(init=False, repr=False)
    _pairs: dict = field(default_factory=dict, repr=False)
    _parts: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self._arcs = {}
        for piece, i in self.ids.items():
            state = self._arcs
            for char in piece:
                arc = state.setdefault(char, [-1, {}])
                state = arc[1]
            arc[0] = i

    @classmethod
    def load(cls, path: str) -> "Transducer":
        """Compiles a model file.  Models that squeeze white space, map characters or treat it as a
        suffix are refused, as is one without byte fallback."""
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, trainer = model.normalizer_spec, model.trainer_spec
        if spec.remove_extra_whitespaces or spec.precompiled_charsmap or trainer.treat_whitespace_as_suffix:
            raise ValueError("only models with the identity normaliser are supported")
        merges = trainer.model_type == proto.TrainerSpec.BPE
        return cls.compiled([(p.piece, p.score, p.type) for p in model.pieces], merges, spec.add_dummy_prefix)

    @classmethod
    def compiled(cls, pieces: list[tuple[str, float, int]], merges: bool, prefix: bool) -> "Transducer":
        """pieces: (text, score, type) in order of ids; types as in model files (1 normal, 4 user
        defined, 6 byte; others give no arc)."""
        ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (1, 4)}
        score = {p: s for p, s, kind in pieces if kind in (1, 4)}
        bytes_ = [0] * 256
        output = []
        for i, (p, _, kind) in enumerate(pieces):
            if kind == 6:
                value = int(p[3:5], 16)
                bytes_[value] = i
                output.append(bytes([value]))
            else:
                output.append(p.replace(MARK, " ").encode() if kind in (1, 4) else b"")
        if sum(kind == 6 for _, _, kind in pieces) != 256:
            raise ValueError("the model has no byte fallback")
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("pieces with white space inside are not supported")
        fine = not any(b in _PUNCTUATION and _IS_LATIN.match(a) for p in ids for a, b in zip(p, p[1:]))
        return cls(ids, {p: -s for p, s in score.items()}, score, bytes_, output, merges, prefix, max(map(len, ids)), fine)

    def __reduce__(self):
        return Transducer, (self.ids, self.cost, self.rank, self.bytes_, self.output, self.merges, self.prefix, self.longest, self.fine)

    # -- composition of one part -------------------------------------------------------

    def _merged(self, text: str) -> list[str]:
        """The merges of a short text: the best-scored neighbours first, leftmost of equals."""
        parts, rank = list(text), self.rank.get
        scores = [rank(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == _NEVER:
                break
            at = scores.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = rank(parts[at - 1] + parts[at], _NEVER)
            if at < len(scores):
                scores[at] = rank(parts[at] + parts[at + 1], _NEVER)
        return parts

    def _apart(self, a: str, b: str) -> bool:
        i, j = self.ids.get(a), self.ids.get(b)
        if i is None or j is None:
            return self._merged(a + b) == [a, b]
        key = i * len(self.output) + j
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= _HELD:
                self._pairs.clear()
            known = self._pairs[key] = self._merged(a + b) == [a, b]
        return known

    def _path_of_merges(self, part: str) -> list[str]:
        """The one path on which all neighbours are admitted; every position has one last piece, the longest
        admitted one.  Arcs are taken from left to right, so the first to reach a place is the longest."""
        known_pairs, width, n = self._pairs.get, len(self.output), len(part)
        last: list[tuple[int, int] | None] = [None] * (n + 1)
        own = -1
        for start in range(n):
            if start:
                before = last[start]
                if before is None:
                    continue
                own = before[1]
            arcs, end = self._arcs, start
            for char in part[start:]:
                arc = arcs.get(char)
                if arc is None:
                    break
                piece, arcs = arc
                end += 1
                if piece < 0 or last[end]:
                    continue
                if start:
                    admitted = known_pairs(own * width + piece) if own >= 0 else None
                    if admitted is None:
                        admitted = self._apart(part[before[0]:start], part[start:end])
                    if not admitted:
                        continue
                last[end] = (start, piece)
            # A character that is no piece is an arc of its own, marked by -1.
            if last[start + 1] is None and part[start] not in self.ids:
                if not start or self._apart(part[before[0]:start], part[start]):
                    last[start + 1] = (start, -1)
        out, end = [], n
        while end:
            if last[end] is None:  # no admitted path: not a closed set of merges
                return self._merged(part)
            out.append(part[last[end][0]:end])
            end = last[end][0]
        return out[::-1]

    def _path_of_weights(self, part: str) -> list[str]:
        n, unknown = len(part), max(self.cost.values()) + _UNKNOWN_COST
        best, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                cost = self.cost.get(part[start:end], unknown if start == end - 1 else None)
                if cost is not None and best[start] + cost < best[end]:
                    best[end], back[end] = best[start] + cost, start
        out, end = [], n
        while end:
            out.append(part[back[end]:end])
            end = back[end]
        return out[::-1]

    def _compose(self, part: str) -> bytes:
        path = self._path_of_merges(part) if self.merges else self._path_of_weights(part)
        ids: list[int] = []
        for piece in path:
            known = self.ids.get(piece)
            ids += [known] if known is not None else [self.bytes_[b] for b in piece.encode()]
        return array("i", ids).tobytes()

    def _part(self, part: str) -> bytes:
        found = self._parts.get(part)
        if found is None:
            if len(self._parts) >= _HELD:
                self._parts.clear()
            found = self._parts[part] = self._compose(part)
        return found

    # -- texts --------------------------------------------------------------------------

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text.  A U+2581 of the text itself goes through the byte fallback, so that
        decoding is exact."""
        if not text:
            return np.zeros(0, np.int32)
        if MARK in text:
            own = np.array([self.bytes_[b] for b in MARK.encode()], np.int32)
            runs = text.split(MARK)
            out = [self._run(runs[0], self.prefix)]
            for run in runs[1:]:
                out += [own, self._run(run, False)]
            return np.concatenate(out)
        return self._run(text, self.prefix)

    def _run(self, text: str, prefix: bool) -> np.ndarray:
        normal = (MARK if prefix else "") + text.replace(" ", MARK)
        held = self._parts
        parts = (_FINE_PARTS if self.fine else _PARTS).findall(normal)
        found = list(map(held.get, parts))
        if None in found:
            found = [self._part(p) if f is None else f for p, f in zip(parts, found)]
        return np.frombuffer(b"".join(found), np.int32)

    def decode(self, ids) -> str:
        text = b"".join(map(self.output.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def decode(ids: Column, model: Transducer) -> Column:
    """The text of ids; null for null."""
    @F.pandas_udf("string")
    def texts(lists: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else model.decode(np.asarray(x).tolist()) for x in lists], dtype=object)
    return texts(ids)


def encode_table(docs: DataFrame, model: Transducer, text: str = "text", verify: bool = False) -> DataFrame:
    """`docs` with `ids` (array<int>), and with `verify` also `decoded`: whether the ids decode to the text.

    A null text has null ids and counts as decoded; an empty one has no ids.  Columns of these
    names are replaced.  One pass, no shuffle, a few rows at a time; rows stand for themselves, so ties and
    repeated rows need no rule.
    """
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    place = kept.index(text)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                texts = part.column(place).to_pylist()
                ids = [None if t is None else model.encode(t) for t in texts]
                sizes = np.cumsum([0] + [0 if x is None else len(x) for x in ids])
                flat = pa.array(np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)]))
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat, mask=pa.array([x is None for x in ids]))
                columns = [*part.columns, lists]
                if verify:
                    columns.append(pa.array([x is None or model.decode(x.tolist()) == t for x, t in zip(ids, texts)]))
                yield pa.RecordBatch.from_arrays(columns, [*kept, "ids", *["decoded"] * verify])

    rows = docs.select(*[docs[c] for c in kept])
    schema = T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema.add("decoded", "boolean") if verify else schema)
