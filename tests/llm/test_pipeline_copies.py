"""Planted exact copies in the stages that remove duplicates."""

import random

import corpus_pipeline


def test_one_of_every_group_of_copies_stays(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    groups = [["\n".join(" ".join(word() for _ in range(8)) for _ in range(n))] * 3 for n in (1, 2, 3, 5, 8, 13, 40) for _ in range(4)]
    texts = [t for k in range(3) for t in (g[k] for g in groups)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("line_dedup", "near_dedup"):
        docs = stages[name](spark, docs, "")
    assert sorted((r.doc_id, r.text, r.n_chars) for r in docs.collect()) == [(i, g[0], len(g[0])) for i, g in enumerate(groups)]
