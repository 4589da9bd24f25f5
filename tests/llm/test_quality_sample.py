"""The sample the line model is fitted on."""

from veilmap.llm import quality


def test_repeated_ids_count_once(spark, monkeypatch):
    """An id with a third of the rows neither fills the driver nor moves the model."""
    good = [(i, f"A plain sentence number {i}, that ends well.\nAnd another one follows.") for i in range(20)]
    bad = [(100 + i, f"$$ {i} ## {i} @@\n{i} {i} {i} %%%") for i in range(20)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id long, quality int")
    sizes, fit = [], quality.fit

    def seen(x, size, lines, y, odds):
        sizes.append(len(lines))
        return fit(x, size, lines, y, odds)
    monkeypatch.setattr(quality, "fit", seen)
    docs = "doc_id long, text string"
    models = [quality.train(spark.createDataFrame(good + bad + more, docs), labels) for more in ([], [good[3]] * 500)]
    assert sizes == [40, 40]
    assert (models[0].weights == models[1].weights).all() and models[0].slope == models[1].slope
    quality.train(spark.createDataFrame(good + bad + [(3, f"other {k}") for k in range(200)], docs), labels)
    assert sizes[2] == 40
