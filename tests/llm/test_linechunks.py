"""Line chunks of bounded size against brute force over repeated runs of lines."""

import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from veilmap.llm import linechunks

DOCS = "doc_id long, text string"


def cut(text, window=2, every=3, least=2, most=12):
    """The rule, line by line."""
    lines = text.split("\n")
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in lines]
    ends, head, last = [], None, None
    for i in range(max(window, least), len(lines) - least + 1):
        seed = 42
        for x in h[i - window:i]:
            seed = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)
        if (seed - (1 << 64) if seed >> 63 else seed) % every:
            continue
        if last is None or i - last >= least:
            ends, head = ends + [i], i
        elif ends[-1] + least <= i:
            ends.append(ends[-1] + least)
        last = i
    starts = [s for a, b in zip([0] + ends, ends + [len(lines)]) for s in range(a, max(a, b - least) + 1, most)]
    return [lines[a:b] for a, b in zip(starts, starts[1:] + [len(lines)])]


def kept_by_rule(rows, **sizes):
    seen, out = set(), {}
    for i, t in sorted(rows):
        kept = []
        for c in cut(t, **sizes):
            if len(c) < sizes.get("least", 2) or tuple(c) not in seen:
                kept += c
            seen.add(tuple(c))
        out[i] = "\n".join(kept)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    passages = [[f"line {p} {k} {rng.random()}" for k in range(30)] for p in range(6)]
    texts = []
    for i in range(80):
        lines = [f"own {i} {k}" for k in range(rng.randrange(1, 6))]
        at = rng.randrange(len(lines) + 1)
        lines[at:at] = passages[rng.randrange(6)][rng.randrange(4):rng.randrange(20, 31)]
        texts.append("\n".join(lines))
    for p in range(1, 8):
        for k in range(4):
            period = [f"period {p} {k} {j}" for j in range(p)]
            texts += ["\n".join([f"before {p} {k} {n}"] + period * (60 // p + n) + [f"after {p} {k} {n}"]) for n in range(3)]
    texts += ["", "one", "a\nb", "a\nb\nc", "\n" * 8]
    return list(enumerate(texts + texts))


@pytest.mark.parametrize("sizes", [{}, {"least": 3, "most": 7}, {"least": 4, "window": 3, "every": 2}])
def test_cut_line_by_line(spark, rows, sizes):
    names = {"least": "min_lines", "most": "max_lines"}
    docs = spark.createDataFrame(rows, DOCS)
    options = {names.get(k, k): v for k, v in sizes.items()}
    got = docs.select("doc_id", linechunks.chunk_lines(F.split("text", "\n", -1), **options).alias("c")).collect()
    least, most = sizes.get("least", 2), sizes.get("most", 12)
    for r, (_, t) in zip(sorted(got), rows):
        assert r.c == cut(t, **sizes)
        assert all(len(c) < most + least for c in r.c)
        assert len(r.c) == 1 or all(len(c) >= least for c in r.c)
    out = linechunks.dedup_lines(docs, **options)
    assert {r.doc_id: r.text for r in out.collect()} == kept_by_rule(rows, **sizes)


def test_copies_lose_all_lines(spark, rows):
    half = len(rows) // 2
    got = {r.doc_id: r for r in linechunks.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    for i, t in rows[half:]:
        assert got[i].text == "" if "\n" in t else got[i].text == t, t
        assert got[i].n_removed == (got[i].n_lines if "\n" in t else 0)


def test_most_lines_of_repeated_runs_go(spark, rows):
    """Lines in a pair of lines that occurs before, by brute force; the rest of a periodic text goes."""
    half = rows[:len(rows) // 2]
    seen, repeated = set(), Counter()
    for i, t in half:
        lines = t.split("\n")
        run = set()
        for k in range(len(lines) - 1):
            if (lines[k], lines[k + 1]) in seen:
                run |= {k, k + 1}
            seen.add((lines[k], lines[k + 1]))
        repeated[i] = len(run)
    got = {r.doc_id: r.n_removed for r in linechunks.dedup_lines(spark.createDataFrame(half, DOCS)).collect()}
    assert all(got[i] <= repeated[i] for i in got)
    assert sum(got.values()) >= 0.75 * sum(repeated.values())
    periodic = [i for i, t in half if t.startswith("before ") and "period" in t]
    assert all(got[i] > 0 for i in periodic[2::3])


def test_time_is_linear_in_the_lines_of_a_text(spark):
    """Two copies of a text: four times the lines take about four times as long."""
    import time

    took = {}
    for n in (20_000, 160_000, 640_000):
        text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n")
        docs = spark.range(2).select(F.col("id").alias("doc_id"), text.alias("text"))
        start = time.perf_counter()
        rows = linechunks.dedup_lines(docs).select("doc_id", "n_lines", "n_removed").collect()
        took[n] = time.perf_counter() - start
        assert sorted(tuple(r) for r in rows) == [(0, n, 0), (1, n, n)]
    assert took[640_000] < 20 and took[640_000] < 8 * took[160_000]
