"""Identifier detection.

One pass of Arrow tasks over the texts finds all kinds of match, settles which lie inside others and gives
each its confidence.  Nothing here shuffles, so every function also runs on a stream.
"""

from dataclasses import dataclass, field
from functools import lru_cache
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmap.functions import patterns as P
from veilmap.functions.literals import literal_pattern
from veilmap.functions.text import find_spans, let, python_texts
from veilmap.schemas import FINDING, FINDING_COLUMNS

# Detector name -> kinds of match, in the order their findings are listed.
DETECTORS = {
    "ipv4": ("ipv4",),
    "cidr": ("cidr",),
    "hostname": ("fqdn", "netbios"),
    "identity": ("upn", "guid", "sid"),
    "network": ("mac", "unc"),
}

# Kind of match -> identifier type and confidence; for host names in percent points
# before the bonuses.
_KINDS = {
    "ipv4": ("ipv4", 1.0),
    "cidr": ("cidr", 1.0),
    "fqdn": ("hostname", 80),
    "netbios": ("hostname", 70),
    "upn": ("upn", 0.9),
    "guid": ("guid", 1.0),
    "sid": ("sid", 1.0),
    "mac": ("mac", 1.0),
    "unc": ("unc", 0.85),
}
_HOST_KINDS = ("fqdn", "netbios")
_LONG_TEXT = 8192
# Findings that leave a task together.
_FINDINGS = 50_000
# Words of at most this length are kept with their findings, so many at a time.
_SHORT_WORD, _WORDS = 100, 1 << 16


def as_keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


# -- value rules -------------------------------------------------------------------

def valid_private_address(address: Column) -> Column:
    """Four octets of 0-255 inside 10/8, 172.16/12 or 192.168/16, for any string."""
    wide, ascii_digits = P.decimal_digit_table()
    octets = F.split(F.translate(address, wide, ascii_digits), r"\.", -1)

    def check(parts: Column) -> Column:
        numbers = F.transform(parts, lambda o: F.when(
            F.rlike(o, F.lit(r"^[0-9]{1,9}$")), o.cast("int")).otherwise(-1))
        return let(numbers, lambda n: (
            (F.size(n) == 4) & F.forall(n, lambda v: v.between(0, 255))
            & ((F.get(n, F.lit(0)) == 10)
               | ((F.get(n, F.lit(0)) == 172) & F.get(n, F.lit(1)).between(16, 31))
               | ((F.get(n, F.lit(0)) == 192) & (F.get(n, F.lit(1)) == 168)))))
    return F.coalesce(let(octets, check), F.lit(False))


def cidr_parts(df: DataFrame, column: str = "value") -> DataFrame:
    """Adds `ip`, `prefix` and `error` (null when the value is well formed)."""
    value = F.col(column)
    slashes = F.length(value) - F.length(F.replace(value, F.lit("/"), F.lit("")))
    digits = F.split_part(value, F.lit("/"), F.lit(2))
    prefix = F.when(F.rlike(digits, F.lit(r"^\s*\+?[0-9]{1,9}\s*$")), F.trim(digits).cast("int"))
    error = (F.when(slashes != 1, F.lit("invalid CIDR notation"))
             .when(prefix.isNull() | ~prefix.between(0, 32), F.lit("invalid prefix length")))
    return df.withColumn("error", error).withColumns({
        "ip": F.when(F.col("error").isNull(), F.split_part(value, F.lit("/"), F.lit(1))),
        "prefix": F.when(F.col("error").isNull(), prefix)})


def plausible_hostname(name: Column) -> Column:
    """False for what is surely no host: one character, digits, illegal characters,
    a file name, a date."""
    illegal = F.length(F.translate(name, P.ILLEGAL_HOST_CHARS, "")) < F.length(name)
    last_label = F.lower(F.substring_index(name, ".", -1))
    return ((F.length(name) > 1)
            & ~F.rlike(name, F.lit(r"^\p{Nd}+\z"))
            & ~illegal
            & ~(F.contains(name, F.lit(".")) & last_label.isin(*P.FILE_EXTENSIONS))
            & ~F.rlike(name, F.lit(P.DATE_SHAPE)))


# -- detection ---------------------------------------------------------------------

def select_kinds(types=None) -> list[str]:
    """Kinds of match of the named detectors, all by default, in registry order."""
    names = list(DETECTORS) if types is None else as_keys(types)
    unknown = [n for n in names if n not in DETECTORS]
    if unknown:
        raise KeyError(f"unknown detector {unknown}, available: {list(DETECTORS)}")
    return [k for n, kinds in DETECTORS.items() if n in names for k in kinds]


_TELLING_NAME = P.python_pattern(literal_pattern(P.HOST_KEYWORDS)[0])


def _outside(inner: list, outer: list) -> list:
    """The matches of `inner`, ordered by start, that lie inside no match of `outer`."""
    outer, kept, at, reach = sorted(outer, key=lambda m: m.start()), [], 0, -1
    for m in inner:
        while at < len(outer) and outer[at].start() <= m.start():
            reach = max(reach, outer[at].end())
            at += 1
        if m.end() > reach:
            kept.append(m)
    return kept


def _accepted(kind: str, value: str) -> bool:
    """The rules for what a pattern matched.  Of the plausibility rules only these can fail there."""
    if kind in ("ipv4", "cidr"):
        return all(int(octet) < 256 for octet in value.partition("/")[0].split("."))
    if kind == "netbios":
        return bool(P.python_pattern(P.NETBIOS_STRUCTURAL).search(value)) and not P.python_pattern(P.DATE_SHAPE).search(value)
    return kind != "fqdn" or value.rpartition(".")[2].lower() not in P.FILE_EXTENSIONS


@lru_cache(1 << 16)
def _judged(kind: str, value: str) -> tuple[str, float] | None:
    """Identifier type and confidence of a match, for host names in percent points before the bonus for a
    phrase; None if it breaks a rule."""
    if not _accepted(kind, value):
        return None
    name, level = _KINDS[kind]
    return name, level + 10 if kind in _HOST_KINDS and _TELLING_NAME.search(value.lower()) else level


def _near_phrase(text: str) -> bool:
    text = text.lower()
    return any(phrase in text for phrase in P.CONTEXT_PHRASES)


@dataclass
class _Finder:
    """The findings of one text as (type, value, start, end, confidence).

    No pattern matches a blank or looks past one, so each word between blanks is searched alone, and short
    words that came before are not searched again.
    """
    kinds: list[str]
    extra: list[tuple[str, float]]
    nested_netbios: bool
    hosts_in_upn: bool
    suppress_nested: bool
    first_per_value: bool
    seen: dict[str, tuple] = field(default_factory=dict)

    def _matches(self, kind: str, word: str) -> list:
        if kind == "upn":  # those of public mail providers are no organisational names
            return [m for m in P.find_upns(word) if m.group().split("@")[1].lower() not in P.PUBLIC_MAIL_DOMAINS]
        if kind == "fqdn" and len(word) > _LONG_TEXT:
            return list(P.find_names(word))
        return list(P.python_pattern(P.SHORT_FQDN if kind == "fqdn" else getattr(P, kind.upper())).finditer(word))

    def _in_word(self, word: str) -> tuple:
        """(place of the kind, value, start, end, type, level) of what the rules accept."""
        possible, found = P.possible_kinds(word), []
        of = {k: self._matches(k, word) for k in possible if k in self.kinds}
        for kind, matches in of.items():
            if matches and kind in _HOST_KINDS:
                by = [] if self.hosts_in_upn else ["upn"]
                if kind == "netbios":
                    by += ([] if self.nested_netbios else ["fqdn"]) + (["guid", "sid", "mac", "unc"] if self.suppress_nested else [])
                outer = [m for k in by if k in possible for m in (of[k] if k in of else self._matches(k, word))]
                matches = _outside(matches, outer) if outer else matches
            for m in matches:
                judged = _judged(kind, m.group())
                if judged:
                    found.append((self.kinds.index(kind), m.group(), m.start(), m.end(), *judged))
        if len(word) <= _SHORT_WORD:
            if len(self.seen) >= _WORDS:
                self.seen.clear()
            self.seen[word] = tuple(found)
        return tuple(found)

    def __call__(self, text: str, extra_spans) -> list[tuple]:
        spans, at = [], 0
        for word in text.split(" "):
            found = self.seen.get(word)
            if found is None:
                found = self._in_word(word)
            for i, value, start, end, name, level in found:
                spans.append((i, value, at + start, at + end, name, level))
            at += len(word) + 1
        spans.sort(key=itemgetter(0))
        for i, more in enumerate(extra_spans):
            name, level = self.extra[i]
            spans += [(len(self.kinds) + i, s["value"], s["start_pos"], s["end_pos"], name, level) for s in more or ()]
        out, first, phrases = [], set(), None
        for i, value, start, end, name, level in spans:
            if self.first_per_value:
                if (i, value) in first:
                    continue
                first.add((i, value))
            if i < len(self.kinds) and self.kinds[i] in _HOST_KINDS:
                # Ten points more for a telling phrase within reach; at most 95.
                phrases = _near_phrase(text) if phrases is None else phrases
                low, high = max(start - P.CONTEXT_CHARS, 0), end + P.CONTEXT_CHARS
                near = phrases and (low == 0 and high >= len(text) or _near_phrase(text[low:high]))
                level = min(level + 10 if near else level, 95) / 100.0
            out.append((name, value, start, end, level))
        return out


def find(df: DataFrame, key, text: str, kinds, extra=(), nested_netbios: bool = False,
         hosts_in_upn: bool = True, suppress_nested: bool = False,
         first_per_value: bool = False) -> DataFrame:
    """Rows of (key, FINDING) for the given kinds of match.

    nested_netbios    keep flat names that lie inside a dotted match
    hosts_in_upn      keep host names that lie inside an accepted user principal name
    suppress_nested   drop flat names inside a GUID, SID, MAC address or UNC path
    first_per_value   per row and type only the first finding of each value
    extra             further detectors as (type, java_regex, confidence)
    """
    keys, extra = as_keys(key), list(extra)
    taken = [k for k in keys if k in FINDING_COLUMNS or k.startswith("_")]
    if taken:
        raise ValueError(f"rename the key columns {taken}: findings have columns of these names")
    finder = _Finder(list(kinds), [(name, float(level)) for name, _, level in extra], nested_netbios, hosts_in_upn,
                     suppress_nested, first_per_value)
    rows = df.select(*keys, F.col(text).alias("_text"))
    if extra:
        rows = rows.withColumns({f"_extra{i}": find_spans("_text", rx) for i, (_, rx, _) in enumerate(extra)})
    n = len(keys)
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64()]

    def batch_of(batch, row, found):
        kept = batch.take(pa.array(row, pa.int64())).columns[:n] if n else []
        columns = zip(*found) if found else [[]] * len(types)
        return pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t) for c, t in zip(columns, types)]], names=[*keys, *FINDING_COLUMNS])

    def run(batches):
        for batch in batches:
            only_keys = batch.select(keys)
            extras = [batch.column(n + 1 + i) for i in range(len(extra))]
            row, found = [], []
            for i, source in enumerate(python_texts(batch.column(n))):
                if source:
                    got = finder(source, [e[i].as_py() for e in extras])
                    row += [i] * len(got)
                    found += got
                if len(found) >= _FINDINGS:
                    yield batch_of(only_keys, row, found)
                    row, found = [], []
            yield batch_of(only_keys, row, found)

    return rows.mapInArrow(run, T.StructType(rows.select(*keys).schema.fields + FINDING.fields))


def detect(df: DataFrame, key, text: str, kind: str, **options) -> DataFrame:
    """Findings of one kind or one detector."""
    kinds = DETECTORS.get(kind, (kind,))
    return find(df, key, text, kinds, **options)


def detect_all(df: DataFrame, key, text: str, types=None, extra=()) -> DataFrame:
    """Raw findings of all (or the named) detectors, overlaps kept."""
    return find(df, key, text, select_kinds(types), extra)


def finding_violations(findings: DataFrame) -> DataFrame:
    """Adds the array `violations` of broken finding rules; empty means valid."""
    span = F.col("end_pos") - F.col("start_pos")
    rules = {
        "confidence out of range": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
        "negative start": F.col("start_pos") < 0,
        "end before start": span < 0,
        "empty value": F.coalesce(F.col("value"), F.lit("")) == "",
        "length differs from span": F.length("value") != span,
    }
    return findings.withColumn("violations", F.array_compact(F.array(*[
        F.when(broken, F.lit(name)) for name, broken in rules.items()])))
