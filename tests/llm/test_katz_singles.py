"""Bigrams seen once belong to the model that the query scores with."""

from veilmap.llm.queries import op9_katz_score


def test_single_bigrams_are_scored(spark, tmp_path):
    texts = ["a b", "x c", "y b", "y c", "a b", "a c"]
    # Ids of training documents for the first four, of held-out ones for the last two.
    train, held = [], []
    for i in range(400):
        (held if spark.range(1).selectExpr(f"crc32(cast('{i}' as binary)) % 5 = 1 as h").first().h else train).append(i)
        if len(train) >= 4 and len(held) >= 2:
            break
    rows = list(zip(train[:4] + held[:2], texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op9_katz_score(spark, str(tmp_path)).collect()}
    seen, unseen = got[held[0]], got[held[1]]
    assert seen.held_out and unseen.held_out and abs(seen.base_score - unseen.base_score) < 1e-9
    assert seen.score > unseen.score + 0.01
