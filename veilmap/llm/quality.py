"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad.  Its features are its own and those of the lines before and after it;
neighbouring labels are tied by transition weights.  The forward-backward marginals of the
lines, weighted by their length, make the quality of a document.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmap.llm.common import ROW
from veilmap.llm.words import PIECE, hashes, pieces, spans

PER_CLASS = 2000
MOST_LINES = 1000
CUT = 0.3
_STEPS = 150
_RELABEL = 2
_RIDGE = 1e-3


def _table(chars: bytes) -> np.ndarray:
    held = np.zeros(256, bool)
    held[list(chars)] = True
    return held


_UPPER = _table(bytes(range(65, 91)))
_LETTER = _UPPER | _table(bytes(range(97, 123)))
_DIGIT = _table(b"0123456789")
_PLAIN = _table(b" \t\r\n.,;:'-()\"?")
_SYMBOL = ~(_LETTER | _DIGIT | _PLAIN) & (np.arange(256) < 128)
_STOP = _table(b".?!:;\"')")


def _line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes, lines per text) of the lines of neighbouring texts."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    lines = 1 + np.diff(np.searchsorted(breaks, offsets))
    size = (ends - starts).astype(float)

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=sums[1:])
        return (sums[ends] - sums[starts]).astype(float)

    letters, symbols = total(_LETTER[data]), _SYMBOL[data]
    runs = np.zeros(len(data), bool)
    runs[1:] = symbols[1:] & (data[1:] == data[:-1])
    first, last = spans(data, offsets)
    h = hashes(data, first, last)
    # A word at an empty line's start belongs to the line that ends later.
    line = np.searchsorted(starts, first, "right") - 1
    words = np.bincount(line, minlength=len(starts)).astype(float)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line, same, len(starts))
    order = np.lexsort((h, line))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order], fresh, len(starts))
    closing = np.zeros(len(starts), bool)
    full = size > 0
    closing[full] = _STOP[data[ends[full] - 1]]
    one, word = np.maximum(size, 1), np.maximum(words, 1)
    x = np.stack([
        np.log1p(size), total(_UPPER[data]) / np.maximum(letters, 1), total(symbols) / one, total(runs) / one,
        total(data == ord("!")) / one, total(_DIGIT[data]) / one, repeats / word, distinct / word,
        total(~_table(b" \t\r")[data]) / word / 10, closing, words == 0], axis=1)
    return x, size, lines


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Like `_line_features`, for pieces of a text column.  A text beyond a piece is read in parts cut
    at line ends."""
    for _, _, data, offsets in pieces(column):
        if len(data) <= 2 * PIECE:
            yield _line_features(data, offsets)
            continue
        parts, at = [], 0
        while at < len(data):
            stop = at + PIECE
            while stop < len(data) and not (gap := data[stop:stop + PIECE] == 10).any():
                stop += PIECE
            stop = stop + int(gap.argmax()) if stop < len(data) else len(data)
            parts.append(_line_features(data[at:stop], np.array([0, stop - at])))
            at = stop + 1
        yield np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.array([sum(p[2][0] for p in parts)])


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after (0 where there is none), and a constant."""
    first = np.cumsum(lines) - lines
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first] = 0
    after[first + lines - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


def forward_backward(emit: np.ndarray, lines: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(line is good), expected transitions per pair of neighbours [bad, good]²).

    emit: the log-odds of good of every line; ties: 2 x 2 log weights of neighbouring labels.  All
    texts advance together, line by line; messages are scaled, so no length underflows.
    """
    order = np.argsort(-lines, kind="stable")
    first = (np.cumsum(lines) - lines)[order]
    length = lines[order]
    most = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(most), "left")  # texts longer than t
    local = np.stack([1 / (1 + np.exp(np.clip(emit, -500, 500))), 1 / (1 + np.exp(np.clip(-emit, -500, 500)))], axis=1)
    tie = np.exp(ties - ties.max())
    ahead, back = np.empty_like(local), np.ones_like(local)
    for t in range(most):
        at = first[:active[t]] + t
        now = local[at] * (ahead[at - 1] @ tie if t else 1.0)
        ahead[at] = now / now.sum(axis=1, keepdims=True)
    for t in range(most - 2, -1, -1):
        at = first[:active[t + 1]] + t
        now = (local[at + 1] * back[at + 1]) @ tie.T
        back[at] = now / now.sum(axis=1, keepdims=True)
    both = ahead * back
    good = both[:, 1] / both.sum(axis=1)
    inner = np.ones(len(emit), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    pair = ahead[at - 1][:, :, None] * tie[None] * (local[at] * back[at])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return good, pair.sum(axis=0)


@dataclass
class LineModel:
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    ties: np.ndarray
    offset: float = 0.0
    slope: float = 1.0

    def marginals(self, x: np.ndarray, lines: np.ndarray) -> np.ndarray:
        return forward_backward(with_neighbours((x - self.mean) / self.std, lines) @ self.weights, lines, self.ties)[0]

    def qualities(self, x: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of each text."""
        good, first, weight = self.marginals(x, lines), np.cumsum(lines) - lines, size + 1e-6
        return np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)

    def scores(self, x: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * self.qualities(x, size, lines), -500, 500)))


def fit(x: np.ndarray, size: np.ndarray, lines: np.ndarray, label: np.ndarray, odds: float = 1.0) -> LineModel:
    """Fits weights by likelihood (Adam, full batch).  Lines take the label of their text; in bad texts
    those that the model finds good are then relabelled, the worst line excepted.  Finally the
    document quality is mapped to a probability; `odds` are those of label 1 to 0 over the odds here."""
    model = LineModel(x.mean(axis=0), x.std(axis=0) + 1e-9, np.zeros(3 * x.shape[1] + 1), np.zeros((2, 2)))
    z = with_neighbours((x - model.mean) / model.std, lines)
    doc = np.repeat(np.arange(len(lines)), lines)
    first = np.cumsum(lines) - lines
    y = label[doc].astype(float)
    share = (1 / len(lines)) / lines[doc]  # every text weighs the same
    inner = np.ones(len(y), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    for turn in range(_RELABEL + 1):
        theta = np.concatenate([model.weights, model.ties.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        kinds = (2 * y[at - 1] + y[at]).astype(int)
        have = np.bincount(kinds, minlength=4)
        for step in range(1, _STEPS + 1):
            good, pairs = forward_backward(z @ theta[:-4], lines, theta[-4:].reshape(2, 2))
            slope = np.concatenate([z.T @ ((y - good) * share), (have - pairs.ravel()) / max(len(y), 1)]) - _RIDGE * theta
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
            theta = theta + 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        model.weights, model.ties = theta[:-4], theta[-4:].reshape(2, 2)
        if turn < _RELABEL:
            good = model.marginals(x, lines)
            worst = np.minimum.reduceat(good, first)[doc] == good
            y = np.where(label[doc] == 1, 1.0, ((good > 0.5) & ~worst).astype(float))
    q = model.qualities(x, size, lines)
    a, b = 0.0, 1.0
    for _ in range(50):  # Newton steps for two parameters, slightly damped by a ridge
        p = 1 / (1 + np.exp(-np.clip(a + b * q, -500, 500)))
        w = p * (1 - p)
        g = np.array([(label - p).sum() - 1e-2 * a, ((label - p) * q).sum() - 1e-2 * b])
        h = np.array([[w.sum() + 1e-2, (w * q).sum()], [(w * q).sum(), (w * q * q).sum() + 1e-2]])
        step_ = np.linalg.solve(h, g)
        a, b = a + step_[0], b + step_[1]
    model.offset, model.slope = a + np.log(odds), b
    return model


_SAMPLE = T.StructType().add("lines", "integer").add("x", T.ArrayType(T.DoubleType())).add("size", T.ArrayType(T.DoubleType()))


@F.pandas_udf(_SAMPLE)
def _sampled(texts: pd.Series) -> pd.DataFrame:
    out = []
    for x, size, lines in features(pa.array(texts, pa.string())):
        first = np.cumsum(lines) - lines
        out += [(int(n), x[f:f + n].ravel(), size[f:f + n]) if n <= MOST_LINES else (int(n), None, None)
                for f, n in zip(first, lines)]
    return pd.DataFrame(out, columns=["lines", "x", "size"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
          per_class: int = PER_CLASS) -> LineModel:
    """Fits the model on at most `per_class` labelled texts of each class, those with the smallest hash of
    their id, of which texts beyond `MOST_LINES` lines are left out.  The odds of the classes are counted
    over all labels; of rows with one id the text with the smallest hash counts.  Without labels of both classes the score only knows how often each occurs."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    # One text per id, combined before the shuffle: at most 2 * per_class rows, however often an id occurs.
    rows = rows.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    rows = rows.select("id", "y", F.col("one.text").alias("text"))
    # Filtered here: Spark would move a filter, and the features with it, below the join.
    got = rows.select("id", "y", _sampled("text").alias("f")).select("id", "y", "f.*").toPandas()
    got = got[got["x"].notna()].sort_values(["id", "y"], kind="stable")
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    y = got["y"].to_numpy(int)
    width = len(_line_features(np.zeros(0, np.uint8), np.array([0, 0]))[0][0])
    if len(np.unique(y)) < 2:
        flat = LineModel(np.zeros(width), np.ones(width), np.zeros(3 * width + 1), np.zeros((2, 2)), slope=0.0)
        flat.offset = np.log((n1 + 1) / (n0 + 1))
        return flat
    odds = (n1 / n0) / ((y == 1).sum() / (y == 0).sum())
    return fit(np.concatenate(got["x"].to_list()).reshape(-1, width), np.concatenate(got["size"].to_list()),
               got["lines"].to_numpy(int), y, odds)


def score(docs: DataFrame, model: LineModel, text: str = "text", cut: float = CUT) -> DataFrame:
    """`docs` with `score` (0 to 1) and `predicted` (1 from `cut` on); no shuffle.

    Null and empty texts are one empty line and get a score too.  Columns of these names are replaced.
    """
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        found = [model.scores(*f) for f in features(pa.array(texts, pa.string()))]
        return pd.Series(np.concatenate(found) if found else np.zeros(0))

    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(F.struct(*[docs[c] for c in kept]).alias(ROW), scored(F.col(text)).alias("score"))
    return rows.select(f"{ROW}.*", "score", (F.col("score") >= cut).cast("int").alias("predicted"))
