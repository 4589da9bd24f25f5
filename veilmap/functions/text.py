"""Column expressions that find, place and compare spans inside one text value.

Positions are code points from 0, ends are exclusive.  Everything stays in the JVM.
No expression is quadratic in the size of a text: short arrays are summed directly,
long ones take a doubling scan of n log n steps.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# A control character that marks the borders of a match.  Texts that contain it
# themselves take the slower two-pass form, so the choice of character is free.
MARK = "\x01"

_FEW = 65
_CHUNK = 4096
_SPAN_ARRAY = "array<struct<start_pos:int,end_pos:int,value:string>>"


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def python_texts(column) -> list:
    """The strings of an Arrow column; bytes that are no UTF-8 come as the replacement character."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        raw = column.cast("large_binary" if str(column.type) == "large_string" else "binary")
        return [b if b is None else b.decode("utf-8", "replace") for b in raw.to_pylist()]


def split_at_matches(text: Column, pattern: str) -> Column:
    """[gap, match, gap, match, ..., gap]; their concatenation is the text."""
    return F.when(F.contains(text, F.lit(MARK)), _split_twice(text, pattern)).otherwise(
        F.split(_marked(text, pattern), MARK, -1))


def _marked(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))


def _split_twice(text: Column, pattern: str) -> Column:
    gaps = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    woven = F.flatten(F.zip_with(
        gaps, F.concat(matches, F.array(F.lit(""))), lambda g, m: F.array(g, m)))
    return F.slice(woven, F.lit(1), F.size(matches) * 2 + 1)


def doubling_scan(values: Column, combine) -> Column:
    """Inclusive running `combine` (sum, greatest) over an array in n log n steps."""
    steps = F.filter(
        F.expr("transform(sequence(0, 30), k -> shiftleft(1, k))"), lambda s: s < F.size(values))
    return F.aggregate(
        steps, values,
        lambda acc, step: F.transform(acc, lambda x, i: F.when(
            i >= step, combine(x, F.get(acc, i - step))).otherwise(x)))


def sql_string(value: str) -> str:
    """A SQL literal; raw where possible, so that patterns read as they are."""
    if "'" not in value and not value.endswith("\\"):
        return f"r'{value}'"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# The long expressions below are SQL text: one parse instead of thousands of calls from
# Python to the JVM.  `p` is an array [gap, match, gap, ...], `m` the marked text.
_NO_SPANS = f"cast(array() as {_SPAN_ARRAY})"
_ODD = "sequence(1, size(p) - 2, 2)"
_SCAN = """aggregate(
  filter(transform(sequence(0, 30), k -> shiftleft(1, k)), s -> s < size({values})), {values},
  (acc, step) -> transform(acc, (x, i) -> if(i >= step, {combine}, x)))"""


def _spans_at(start: str) -> str:
    return (f"transform({_ODD}, i -> named_struct('start_pos', {start}, "
            f"'end_pos', {start} + length(get(p, i)), 'value', get(p, i)))")


# The text before the i-th mark, less the marks in it, ends where match i starts.
_PLACE_FEW = _spans_at("length(substring_index(m, char(1), i)) - i + 1")
_PLACE_MANY = (
    "get(transform(array(" + _SCAN.format(
        values="transform(p, x -> length(x))", combine="x + get(acc, i - step)")
    + f"), e -> {_spans_at('get(e, i - 1)')}), 0)")


def find_spans(text: str, pattern: str, required=()) -> Column:
    """All leftmost, non-overlapping matches of `pattern` in the column named `text`, as an
    array of (start_pos, end_pos, value).

    `required` lists groups of substrings; a text lacking all members of one group
    cannot match and skips the regex.  A null text gives a null array.
    """
    rx = sql_string(pattern)
    twice = (f"slice(flatten(zip_with(split({text}, {rx}, -1), concat(regexp_extract_all({text}, {rx}, 0), "
             f"array('')), (g, v) -> array(g, v))), 1, size(regexp_extract_all({text}, {rx}, 0)) * 2 + 1)")
    spans = f"""if(contains({text}, char(1)),
      get(transform(array({twice}), p -> if(size(p) <= 1, {_NO_SPANS}, {_PLACE_MANY})), 0),
      get(transform(array(regexp_replace({text}, {rx}, concat(char(1), '$0', char(1)))), m ->
        get(transform(array(split(m, char(1), -1)), p -> case when size(p) <= 1 then {_NO_SPANS}
          when size(p) <= {_FEW} then {_PLACE_FEW} else {_PLACE_MANY} end), 0)), 0))"""
    for group in required:
        present = " or ".join(f"contains({text}, {sql_string(n)})" for n in group)
        spans = f"if({present}, {spans}, {_NO_SPANS})"
    return F.expr(f"if({text} is not null, {spans}, null)")


def drop_contained(inner: str, outer: list[str]) -> Column:
    """Elements of the span column `inner` that lie inside no element of the span columns
    `outer`; `inner` is ordered by start.

    Small cases compare pairs.  In large ones both kinds are sorted together, and the
    furthest end among the outer spans that start no later decides.
    """
    pairwise = (f"filter({inner}, x -> not exists(o, y -> y.start_pos <= x.start_pos "
                "and x.end_pos <= y.end_pos))")
    events = (
        "sort_array(concat(transform(o, y -> named_struct('at', y.start_pos, 'kind', 0, 'reach', y.end_pos)), "
        f"transform({inner}, x -> named_struct('at', x.start_pos, 'kind', 1, 'reach', -1))))")
    reach = _SCAN.format(values="transform(ev, e -> e.reach)", combine="greatest(x, get(acc, i - step))")
    merged = f"""get(transform(array({events}), ev -> get(transform(array(
        filter(zip_with(ev, {reach}, (e, r) -> named_struct('kind', e.kind, 'reach', r)), z -> z.kind = 1)),
        far -> filter({inner}, (x, j) -> x.end_pos > get(far, j).reach)), 0)), 0)"""
    return F.expr(f"""get(transform(array(concat({', '.join(outer)})), o -> case
        when size(o) = 0 then {inner}
        when cast(size({inner}) as bigint) * size(o) <= 4096 then {pairwise}
        else {merged} end), 0)""")


def chunks(text: Column) -> Column:
    """The text cut into pieces of a fixed number of code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))


def substring_from_chunks(pieces: Column, start: Column, end: Column) -> Column:
    """text[start:end] read from `chunks(text)` at a cost independent of `start`."""
    first = F.floor(start / _CHUNK).cast("int")
    last = F.floor(end / _CHUNK).cast("int")
    # A range inside one piece, the usual case, costs the same however many pieces there are.
    joined = F.when(first == last, F.get(pieces, first)).otherwise(
        F.array_join(F.slice(pieces, first + 1, last - first + 1), ""))
    return F.substring(joined, start - first * _CHUNK + 1, end - start)


def substring_from_chunks_sql(pieces: str, start: str, end: str) -> str:
    """`substring_from_chunks` as SQL text, for use inside lambdas."""
    first, last = f"({start}) div {_CHUNK}", f"({end}) div {_CHUNK}"
    joined = (f"if({first} = {last}, get({pieces}, cast({first} as int)), array_join(slice({pieces}, "
              f"cast({first} as int) + 1, cast({last} - {first} as int) + 1), ''))")
    return f"substring({joined}, cast({start} - {first} * {_CHUNK} as int) + 1, {end} - ({start}))"
