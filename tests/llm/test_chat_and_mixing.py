"""Chat formatting and source mixing against brute force, with odd rows."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilmap.llm import chat, mixing

SCHEMA = "conv_id long, turn long, role string, text string, n_turns string, example string"
TURNS = [
    (1, 0, "system", "be <turn>good</turn>\n"), (1, 1, "user", r"a \</turn> <\\turn> b"), (1, 2, "assistant", "</turn>\n<turn>x\n"),
    (1, 3, "user", ""), (1, 4, "assistant", "ünï 😀"), (1, 5, "user", "trailing"),
    (2, 0, "user", None), (3, 0, "assistant", "only"), (3, 0, "assistant", "only"), (4, None, None, "no turn"),
    (None, 1, "assistant", "no id"), (5, 0, "as<s%3C\n", "odd role"), (5, 1, "assistant", "%"),
    (-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat_round_trip(spark):
    rows = [(*t, "clash", "clash") for t in TURNS]
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_examples(spark.createDataFrame(rows, SCHEMA))).collect()}
    for conv in {t[0] for t in TURNS}:
        own = sorted(((t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in TURNS if t[0] == conv))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, r, x in own))
        assert got[conv]["loss_chars"] == len(loss) and got[conv]["loss_sha256"] == sha(loss)


def test_chat_examples(spark):
    df = chat.format_examples(spark.createDataFrame([(*t, "", "") for t in TURNS if t[0] == 1], SCHEMA))
    rows = df.orderBy("example").collect()
    assert [r["n_turns"] for r in rows] == [3, 5, 6] and [r["whole"] for r in rows] == [False, False, True]
    # Only the reply is trainable, and control strings occur once per turn.
    assert rows[1]["text"][rows[1]["loss_start"]:rows[1]["loss_end"]] == "ünï 😀"
    assert rows[2]["loss_start"] == rows[2]["loss_end"]
    assert all(r["text"].count("</turn>\n") == r["n_turns"] == r["text"].count("<turn>") for r in rows)


def test_chat_empty_and_long(spark):
    assert chat.format_examples(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "x </turn> " * 100_000
    got = chat.conversation_digests(chat.format_examples(spark.createDataFrame([(1, 0, "assistant", long, "", "")], SCHEMA))).first()
    assert got["loss_sha256"] == sha(long)


DOCS = "doc_id long, text string, source string, copy string, n long"


def draw(mean, u):
    k, p, c = 0, math.exp(-mean), math.exp(-mean)
    while c <= u and k < 128:
        k += 1
        p *= mean / k
        c += p
    return k


def unit(*parts):
    return int(hashlib.md5("/".join(parts).encode()).hexdigest()[:13], 16) / 2 ** 52


def test_mix_counts(spark):
    rows = [(i, "x" * (i % 7), f"s{min(i % 10, 3)}" if i % 11 else None, "clash", i) for i in range(600)]
    rows += [(7, "repeated", "s1", "", 0)] * 2 + [(None, "no id", "s2", "", 0), (None, None, "s0", "", 0)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df, weights={"s0": 1.0, "s1": 3.0, "s2": 0.5}, epochs=3.0)
    assert out.columns == ["doc_id", "text", "source", "n", "copy", "mix_key"]
    size = Counter()
    for _, t, s, *_ in rows:
        size[s] += len(t or "")
    weights = {"s0": 1.0, "s1": 3.0, "s2": 0.5}
    want = Counter()
    for i, t, s, *_ in rows:
        rate = weights.get(s, 0) * 3.0 * sum(size.values()) / 4.5 / size[s]
        draws = max(1, math.ceil(rate / 16))
        name = str(i) if i is not None else hashlib.md5((t or "").encode()).hexdigest()
        want[i, t, s] += sum(draw(rate / draws, unit("mix", name, str(j))) for j in range(1, draws + 1))
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in out.collect())
    assert got == +want
    assert all(max(0, v) and s in weights for (_, _, s), v in got.items())


def test_mix_many_sources_equals_few(spark, monkeypatch):
    df = spark.createDataFrame([(i, "y" * (1 + i % 5), f"s{i % 3 if i % 2 else i}", "", i) for i in range(300)], DOCS)
    few = sorted(r["mix_key"] for r in mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "FEW_SOURCES", 1)
    assert sorted(r["mix_key"] for r in mixing.mix(df).collect()) == few


def test_mix_empty(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("mean", [0.0, 0.3, 1.0, 15.9])
def test_poisson_table(spark, mean):
    cdf = spark.range(1).select(mixing.poisson_table(F.lit(mean)).alias("t")).first()["t"]
    assert cdf[0] == pytest.approx(math.exp(-mean)) and cdf[-1] == pytest.approx(1) and cdf == sorted(cdf)
