"""Secrets in texts: three fixed shapes, and strings in a sensitive context that do not compress.

A string near a word such as "password" is a candidate.  Its novelty is the number of compressed
bytes it adds to its surroundings, measured with zstandard and divided by its own length.  The compressor is
primed with the identifiers that occur most in the corpus, so names and words cost a few bytes and
random strings cost their full length.
"""

import re
from bisect import bisect_left, bisect_right
from statistics import median

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds in order, the three shapes, and the shortest match of each that counts.
KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_MIN_VALUE, _MIN_ACCESS = 12, 18
# Words that make what follows them sensitive.
_SENSITIVE = re.compile(r"pass(?:word|wd|phrase|code)|pwd|secret|token|credential|bearer|authorization"
                        r"|(?:api|access|private|auth|signing|encryption)[_ -]?key", re.I | re.A)
_HINTS = (b"pass", b"pwd", b"secret", b"token", b"credential", b"bearer", b"authorization", b"key")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{12,}")

REACH = 48
SURROUNDINGS = (64, 128, 256)
NOVELTY = 0.9
DICTIONARY = 4096
LEVEL = 12
_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                   T.StructField("end", T.LongType()), T.StructField("novelty", T.DoubleType())]))


def base_spans(text: str, hinted: bool = True) -> list[tuple[str, int, int]]:
    """Matches of the fixed shapes, leftmost and non-overlapping within each kind; code points."""
    out = []
    if hinted:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _MIN_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= _MIN_ACCESS]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of at least 12 characters that start at most `REACH` code points after a sensitive word."""
    out, seen = [], -1
    for word in _SENSITIVE.finditer(text):
        at = max(word.end(), seen)
        while (m := _CANDIDATE.search(text, at, max(at, word.end()) + REACH + _MIN_VALUE)) and m.start() <= word.end() + REACH:
            m = _CANDIDATE.match(text, m.start())
            end = m.start() + len(m[0].rstrip(".-"))
            if end - m.start() >= _MIN_VALUE:
                out.append((m.start(), end))
            at = seen = m.end()
    return out


class Novelty:
    """Marginal compressed bytes of a string, by a compressor primed with identifiers."""

    def __init__(self, identifiers: list[str], level: int = LEVEL):
        import zstandard

        primed = {}
        # What stands last in the dictionary is cheapest to refer to.
        content = " ".join(reversed(identifiers)).encode()
        if len(content) >= 8:
            primed["dict_data"] = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            primed["dict_data"].precompute_compress(level=level)
        self._size = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False, **primed).compress

    def of(self, text: str, start: int, end: int) -> float:
        """Bytes that text[start:end] adds to its surroundings, by its own bytes; the median over
        surroundings of several sizes.  Other occurrences of the string do not count as known."""
        own, ratios = text[start:end], []
        for reach in SURROUNDINGS:
            before = text[max(0, start - reach):start].replace(own, "")
            after = text[end:end + reach // 4].replace(own, "")
            added = len(self._size((before + own + after).encode())) - len(self._size((before + after).encode()))
            ratios.append(added / len(own.encode()))
        return median(ratios)


def find(text: str, novelty: Novelty, threshold: float = NOVELTY) -> list[tuple[str, int, int, float | None]]:
    """All spans of a text by start, then kind: the fixed shapes, and novel candidates that overlap none of them."""
    lower = text.encode("utf-8", "replace").lower()
    hinted = any(h in lower for h in _HINTS)
    spans = [(*s, None) for s in base_spans(text, hinted)]
    if hinted:
        starts, ends = _merged(spans)
        for start, end in candidates(text):
            if bisect_left(starts, end) == bisect_right(ends, start):
                value = novelty.of(text, start, end)
                if value >= threshold:
                    spans.append(("novel", start, end, value))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _merged(spans: list[tuple]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint ranges that the spans cover."""
    starts, ends = [], []
    for start, end in sorted((s[1], s[2]) for s in spans):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def frequent_identifiers(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> list[str]:
    """The `size` words of 3 to 24 letters and underscores that occur most often in all texts, most frequent first.
    Words with digits are left out: a secret that is repeated must not become a known word."""
    words = docs.select(F.explode(F.split(F.col(text), "[^A-Za-z_]+")).alias("word")).where(
        F.length("word").between(3, 24))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(size).collect()]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = NOVELTY,
                 dictionary: int = DICTIONARY) -> DataFrame:
    """(id, spans: array<struct<kind, start, end, novelty>>) for every row; code points, end exclusive, ordered by
    start, then kind (assign, access, hex, novel).  `novelty` is null for the fixed shapes.

    A null or empty text has no spans.  Repeated rows are returned each, null ids are a value like others, other
    columns are ignored, and an empty table gives no rows.  A text of any length is searched whole, in time linear in it.
    """
    identifiers = frequent_identifiers(docs, text, dictionary)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("spans", _SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))

    def run(batches):
        novelty = Novelty(identifiers)
        names = ("kind", "start", "end", "novelty")
        for batch in batches:
            found = [[dict(zip(names, s)) for s in find(t.as_py() or "", novelty, threshold)] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, kind)], ["id", "spans"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def written(spans: Column) -> Column:
    """Spans as text, kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] != "novel")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
