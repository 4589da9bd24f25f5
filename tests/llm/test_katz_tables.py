"""What the Katz model keeps and sends."""

import os
import random

import numpy as np

from veilmap.llm import katz


def test_arrays_come_back():
    rng = np.random.default_rng(3)
    top = (1 << 64) - 1
    for x in (np.zeros(0, np.int64), np.array([0]), np.array([255, 256]), np.array([0, top], np.uint64), rng.integers(0, 1 << 40, 999)):
        assert katz._numbers(katz._squeezed(x)).tolist() == x.tolist()
    x = np.append(rng.standard_normal(99), [-np.inf, 0.0])
    assert katz._numbers(katz._squeezed(x)).tolist() == x.tolist()
    x = np.sort(rng.integers(0, top, 500, np.uint64, endpoint=True))
    assert np.cumsum(katz._numbers(katz._squeezed(katz._steps(x))).astype(np.uint64), dtype=np.uint64).tolist() == x.tolist()


def test_tables_are_smaller_than_the_texts(spark, monkeypatch):
    """No table has a row or two hashes for every bigram of the corpus."""
    size = {}

    def measured(df, name, write=katz.materialize):
        table = write(df, name)
        size[name] = sum(os.path.getsize(f.removeprefix("file://")) for f in table.inputFiles())
        return table

    monkeypatch.setattr(katz, "materialize", measured)
    monkeypatch.setattr(katz, "HEAD", 8)
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(500)) for _ in range(400)]
    df = spark.createDataFrame([(i, t, i % 5 != 1) for i, t in enumerate(texts)], "doc_id long, text string, train boolean")
    assert katz.score(df.repartition(4), min_count=1).count() == 400
    assert size["words"] + size["pairs"] < sum(map(len, texts)) / 4, size
