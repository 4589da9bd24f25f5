"""Line chunks, substrings, SimHash and embeddings against brute force, with odd rows."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from test_linechunks import cut as chunks_of

from veilmap.llm import components, hnsw, linechunks, simhash, subspace, substrings

DOCS = "doc_id long, text string, n_lines string, n_words string, d string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], DOCS)


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# -- line chunks -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def line_rows():
    rng = random.Random(3)
    passages = [[f"line {p} {k} {rng.random()}" for k in range(12)] for p in range(4)]
    rows = []
    for i in range(60):
        lines = [f"own {i} {k}" for k in range(rng.randrange(4))]
        at = rng.randrange(len(lines) + 1)
        lines[at:at] = passages[rng.randrange(4)][:rng.randrange(5, 13)]
        rows.append((i, "\n".join(lines)))
    return rows + [(100, None), (101, ""), (102, "\n\n\n\n\n\n\n\n"), (103, "\n\n\n\n\n\n\n\n"), (None, rows[0][1]),
                   (5, rows[5][1]), (7, "other\ntext"), (104, "x\n" * 5000)]


def test_line_chunks(spark, line_rows):
    out = linechunks.dedup_lines(make(spark, line_rows))
    assert out.columns == ["doc_id", "text", "n_words", "d", "n_lines", "n_removed"]
    places = defaultdict(list)
    distinct = {(i, t) for i, t in line_rows if t is not None}
    for i, t in distinct:
        h = xxhash.xxh64_intdigest(t.encode(), 42)
        h = h - (1 << 64) if h >> 63 else h
        for pos, c in enumerate(chunks_of(t)):
            if len(c) >= 2:
                places["\n".join(c)].append(((i is not None, i or 0), h, pos))
    first = {c: min(p) for c, p in places.items()}
    want = Counter()
    for i, t in line_rows:
        if t is None:
            want[i, None, 0, 0] += 1
            continue
        h = xxhash.xxh64_intdigest(t.encode(), 42)
        h = h - (1 << 64) if h >> 63 else h
        kept, n = [], len(t.split("\n"))
        for pos, c in enumerate(chunks_of(t)):
            if len(c) < 2 or first["\n".join(c)] == ((i is not None, i or 0), h, pos):
                kept += c
        want[i, "\n".join(kept), n, n - len(kept)] += 1
    got = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out.collect())
    assert got == want
    assert sum(r[3] for r in want) > 100


def test_line_chunks_compare_bytes(spark, line_rows, monkeypatch):
    """With a hash that always clashes, the bytes alone decide."""
    def clear(rows):
        return sorted((str(r["doc_id"]), str(r["text"])) for r in rows.collect())
    want = clear(linechunks.dedup_lines(make(spark, line_rows)))
    monkeypatch.setattr(linechunks, "chunk_hash", lambda chunk: F.lit(1).cast("long"))
    assert clear(linechunks.dedup_lines(make(spark, line_rows))) == want


def test_line_chunks_empty(spark):
    assert linechunks.dedup_lines(make(spark, [])).count() == 0


# -- substrings ------------------------------------------------------------------------

def kept_words(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    count = Counter(tuple(w[j:j + window]) for w in words for j in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for j in range(len(w) - window + 1):
            if count[tuple(w[j:j + window])] > 1:
                gone |= set(range(j, j + window))
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


@pytest.mark.parametrize("most", [2, 256])
def test_substrings(spark, most):
    rng = random.Random(5)
    base = [[rng.choice("a b c d e f gg hh é 😀".split()) + str(rng.randrange(40)) for _ in range(90)] for _ in range(5)]
    rows = []
    for i in range(50):
        own = [f"w{rng.randrange(1000)}" for _ in range(rng.randrange(30))]
        b = base[rng.randrange(5)]
        s = rng.randrange(40)
        rows.append((i, " ".join(own) + "\t" + "\n ".join(b[s:s + rng.randrange(20, 50)]) + " " + " ".join(own)))
    rows += [(100, None), (101, ""), (102, "same " * 200), (103, "a b " * 60), (104, "same " * 35), (3, rows[3][1]), (None, rows[4][1])]
    out = substrings.dedup_substrings(make(spark, rows), most=most)
    assert out.columns == ["doc_id", "text", "n_lines", "d", "n_words", "n_removed"]
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in out.collect())
    assert got == Counter((i, *k) for (i, _), k in zip(rows, kept_words(rows, 35)))


def test_substrings_long_text(spark):
    rng = random.Random(6)
    once = " ".join(f"u{rng.random()}" for _ in range(60_000))
    part = once[500_000:503_000]
    rows = [(1, once + " " + "z" * 3_000_000), (2, part)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substrings.dedup_substrings(make(spark, rows)).collect()}
    assert [got[1], got[2]] == kept_words(rows, 35) and got[1][1] > 50


def test_substrings_empty(spark):
    assert substrings.dedup_substrings(make(spark, [])).count() == 0


# -- SimHash ---------------------------------------------------------------------------

def simple_print(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(v >> i & 1 for v in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "one", "One TWO", "a b c", "É é x\x0by z " * 50, "w " * 700_000])
def test_fingerprint(text):
    got = simhash.fingerprint_of(text)
    assert got & (1 << 64) - 1 == simple_print(text)


def test_masks_cover_every_pair():
    rng = random.Random(2)
    masks = simhash.covering_masks()
    assert len(masks) == 15
    for bits in itertools.chain(itertools.combinations(range(64), 2), (rng.sample(range(64), 3) for _ in range(5000))):
        assert any(not any(m >> b & 1 for b in bits) for m in masks)


@pytest.mark.parametrize("block", [4, 1024])
def test_links_of_dense_groups(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "_BLOCK", block)
    rng = random.Random(4)
    prints = {0, 1 << 63}
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(40):
            prints.add(x)
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << b
    prints = sorted(prints)
    signed = [simhash._signed(x) for x in prints]
    links = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    want = {n: r for n, r in roots(signed, links).items() if n != r}
    got = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"))
    assert {r["fp"]: r["root"] for r in got.collect()} == want


def test_near_duplicates_and_keep_first(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(9, text), (4, text.upper()), (6, text + " x"), (2, "another text of words"), (5, None), (3, ""), (8, " "), (2, "another text of words"),
            (None, "lonely words here"), (None, text)]
    df = make(spark, rows)
    got = sorted(((r["id"], r["component"]) for r in simhash.near_duplicates(df, "doc_id").collect()), key=str)
    prints = [simple_print(t) for _, t in rows]
    near = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    group = roots(range(len(rows)), near)
    least = {g: min((rows[k][0] for k in group if group[k] == g and rows[k][0] is not None), default=None) for g in group.values()}
    assert got == sorted(((i, least[group[k]]) for k, (i, _) in enumerate(rows)), key=str)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns and kept.count() == len(set(group.values()))
    assert simhash.keep_first(make(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, i) for i in range(1001, 1300)]
    rest = [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)]
    edges = path + star + rest + [(5, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    want = roots(nodes | {5}, edges)
    assert {n: got.get(n, n) for n in nodes} == {n: want[n] for n in nodes}


# -- embeddings ------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, node string"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    rows = []
    for label in (0, 1):
        for _ in range(12):
            x = rng.standard_normal(16)
            for _ in range(rng.integers(1, 25)):
                x = x + rng.standard_normal(16) * 0.12
                rows.append((len(rows), [float(np.float32(v)) for v in x * rng.uniform(0.5, 2)], label, ""))
    same = rows[0][1]
    n = len(rows)
    rows += [(n, same, 0, ""), (n + 1, same, 0, ""), (n + 2, same, 1, ""), (n + 3, same, None, ""), (n + 4, None, 0, ""), (n + 5, [0.0] * 16, 0, ""),
             (n + 6, [float("nan")] + same[1:], 0, ""), (n + 7, [None] + same[1:], 0, ""), (n + 8, same[:8], 0, ""), (n + 9, [], 0, ""),
             (n + 10, [float("inf")] + same[1:], 0, "")]
    return rows


def links_of(rows):
    ok = [(i, np.array(v, float), lab) for i, v, lab, _ in rows
          if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    return [(a[0], b[0]) for a, b in itertools.combinations(ok, 2) if a[2] == b[2] and len(a[1]) == len(b[1])
            and (a[1] * b[1]).sum() / np.sqrt((a[1] ** 2).sum()) / np.sqrt((b[1] ** 2).sum()) >= 0.98]


@pytest.mark.parametrize("block", [8, 1024])
def test_embedding_dedup(spark, vectors, block, monkeypatch):
    monkeypatch.setattr(subspace, "_BLOCK", block)
    links = links_of(vectors)
    count, root = Counter(x for e in links for x in e), roots([r[0] for r in vectors], links)
    got = subspace.near_duplicates(spark.createDataFrame(vectors, VECTORS)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {
        r[0]: (count[r[0]], root[r[0]], root[r[0]] == r[0]) for r in vectors}
    assert len(links) > 100


def test_embedding_dedup_empty(spark):
    assert subspace.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


# -- nearest neighbours ----------------------------------------------------------------

def test_nearest(spark, vectors, monkeypatch):
    monkeypatch.setattr(hnsw, "BLOCK", 4)
    df = spark.createDataFrame(vectors, VECTORS)
    got = defaultdict(list)
    for r in hnsw.nearest(df, df.where("vec_id % 20 = 0"), k=7).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ok = {i: np.array(v, float) for i, v, _, _ in vectors if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    hits = total = 0
    for q in (i for i in ok if i % 20 == 0):
        want = sorted((-(ok[q] * v).sum(), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:7]
        assert [r for r, *_ in got[q]] == list(range(1, len(want) + 1))
        assert all(s == pytest.approx((ok[q] * ok[i]).sum(), rel=1e-12) for _, i, s in got[q])
        assert [(-s, i) for _, i, s in got[q]] == sorted((-s, i) for _, i, s in got[q])
        hits += len({i for _, i in want} & {i for _, i, _ in got[q]})
        total += len(want)
    assert total and hits >= 0.95 * total


def test_nearest_recall_over_shards(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 24)) * rng.uniform(0.5, 1.5, (3000, 1))
    x[100:140] = x[100]
    rows = [(i, [float(a) for a in v], 0, "") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, VECTORS.replace("float", "double"))
    graphs = hnsw.index(df, shard=1000)
    assert graphs.count() == 3 and graphs.select(F.sum(F.size("members"))).first()[0] == 3000
    got = defaultdict(set)
    for r in hnsw.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, 3000, 50):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(3000), -s))[:20].tolist()) & got[q])
    assert hits >= 0.9 * 20 * 60


def test_nearest_empty(spark):
    df = spark.createDataFrame([], VECTORS)
    assert hnsw.nearest(df, df).count() == 0
