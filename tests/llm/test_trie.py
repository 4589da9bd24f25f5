import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veilmap.llm import trie
from veilmap.llm.queries import QUERIES, with_shared_starts

DATA = "/root/testdata/sf0.01"
TURNS = "conv_id long, turn int, role string, text string, depth int"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def brute_force(convs):
    """{(smallest member, depth): other columns} of {conv: [(role, text), ..]}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, own in members.items():
        gain = (len(own) - 1) * words(k[-1][1]) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += gain
    out = {}
    for k, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(k))
        out[min(own), len(k)] = (min(members[k[:-1]]) if k else None, len(own), children[k], leaves[k], saved[k],
                                 hashlib.sha256(ends.encode()).hexdigest())
    assert len(out) == len(members)
    return out


def listed(rows):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def collected(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = df.collect()
    got = {(r[0], r[1]): tuple(r[2:]) for r in rows}
    assert len(got) == len(rows)
    return got


def random_rows(seed, n, kinds, longest):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(n * 3), n):
        rows += [(c, t, rng.choice("ua"), rng.choice(["", "one", "one two", "x  y\tz"][:kinds]), 1) for t in range(rng.randrange(1, longest))]
    return rows


@pytest.mark.parametrize("block,parts", [(4096, 1), (4, 3), (8, 7)])
def test_against_brute_force(spark, monkeypatch, block, parts):
    monkeypatch.setattr(trie, "BLOCK", block)
    for seed, n, kinds, longest in ((1, 60, 2, 6), (2, 150, 4, 4)):
        rows = random_rows(seed, n, kinds, longest)
        docs = spark.createDataFrame(rows, TURNS).repartition(parts)
        assert collected(trie.prefix_tree(trie.conversations(docs))) == brute_force(listed(rows))


def test_contraction_in_any_blocks():
    """Blocks of any size, contracted level by level, give the tree of one block."""
    rng = random.Random(7)
    for _ in range(60):
        turns = [bytes([rng.randrange(3)] * 16) + (rng.randrange(5)).to_bytes(4, "big") for _ in range(3)]
        keys = sorted((b"".join(rng.choices(turns, k=rng.randrange(5))), c) for c in range(rng.randrange(1, 40)))
        items = [(k, [[len(k) // trie.ENTRY, 1, c, 1, 0, 0, 0]]) for k, c in keys]

        def joined(items, block, last):
            return trie.contract([k for k, _ in items], [m for _, m in items], block, last)

        want = joined(items, 0, True)
        got, block = [], 0
        while len(items) > 4:
            size, after = rng.randrange(4, 9), []
            for at in range(0, len(items), size):
                block += 1
                for row in joined(items[at:at + size], block, False):
                    if row["kind"] == "item":
                        after.append((row["key"], row["marks"]))
                    else:
                        got.append(row)
            assert after == sorted(after, key=lambda x: x[0])
            items = after
            if size >= len(items):
                break
        got += joined(items, block + 1, True)
        place = {r["digest"]: r["conv"] for r in got if r["digest"]}

        def told(rows):
            return sorted((r["conv"], r["depth"], r["n"], r["ends"], r["children"], r["leaves"], r["saved"],
                           -1 if (p := place[r["ask"]] if r["ask"] else r["parent"]) is None else p) for r in rows)
        assert told(got) == told(want)


def test_copies_and_deep_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 16)
    rows = [(c, t, "u", f"turn {t}", 1) for c in range(200) for t in range(3)]
    rows += [(1000, t, "u", f"turn {t}", 1) for t in range(400)] + [(1001, t, "u", f"turn {t}", 1) for t in range(300)]
    docs = spark.createDataFrame(rows, TURNS).repartition(5)
    assert collected(trie.prefix_tree(trie.conversations(docs))) == brute_force(listed(rows))


def test_nulls_ties_and_turnless(spark):
    rows = [(1, None, None, None, 1), (1, 0, "u", "a b", 1), (1, 0, "u", "a b", 1), (2, 0, None, "", 1), (3, 0, "", None, 1),
            (None, 0, "u", "lost", 1), (4, 1, "ua", "b", 1), (5, 1, "u", "ab", 1)]
    docs = spark.createDataFrame(rows, TURNS)
    got = collected(trie.prefix_tree(trie.conversations(docs)))
    assert got == brute_force(listed(rows))
    empty = spark.createDataFrame([(7, []), (9, None), (8, ["0" * 40])], "conv long, entries array<string>")
    got = collected(trie.prefix_tree(empty))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {(7, 0): (None, 3, 1, 1, 0, sha("7,9")), (8, 1): (7, 1, 0, 1, 0, sha("8"))}


def test_empty_table(spark):
    assert trie.prefix_tree(trie.conversations(spark.createDataFrame([], TURNS))).count() == 0


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    want = brute_force(rebuilt(listed(rows)))
    assert collected(QUERIES["op13_prefix_trie"](spark, DATA)) == want
    assert sum(v[1] > 1 for v in want.values()) > 10


def test_shared_starts(spark):
    own = {c: [f"{c}.{t}" for t in range(c % 6)] for c in range(1, 70)}
    docs = spark.createDataFrame([(c, e) for c, e in own.items()], "conv long, entries array<string>")
    assert {r[0]: r[1] for r in with_shared_starts(docs).collect()} == rebuilt(own)
    assert with_shared_starts(docs).where(F.size("entries") == 0).count() > 0
