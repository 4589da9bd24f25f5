"""The pipeline against a plain-Python version of its stages, and the queries without SQL against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_chat_and_mixing import draw, unit
from test_dedup import chunks_of, kept_words, links_of, roots, simple_print

import corpus_pipeline
from veilmap.llm import quality
from veilmap.llm.queries import QUERIES, quality_model

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{DATA}/documents.parquet").to_pylist()


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def line_quality(model, text):
    """Forward-backward of one text, label by label."""
    import pyarrow as pa

    (x, size, lines), = quality.features(pa.array([text]))
    emit = quality.with_neighbours((x - model.mean) / model.std, lines) @ model.weights
    n = len(emit)
    ahead = [[-0.5 * emit[0], 0.5 * emit[0]]]
    for t in range(1, n):
        ahead.append([np.logaddexp(*(ahead[-1][a] + model.ties[a, b] for a in (0, 1))) + (b - 0.5) * emit[t] for b in (0, 1)])
    back = [[0.0, 0.0]]
    for t in range(n - 2, -1, -1):
        back.insert(0, [np.logaddexp(*(model.ties[a, b] + (b - 0.5) * emit[t + 1] + back[0][b] for b in (0, 1))) for a in (0, 1)])
    good = [1 / (1 + math.exp(min(500, ahead[t][0] + back[t][0] - ahead[t][1] - back[t][1]))) for t in range(n)]
    q = sum(g * (s + 1e-6) for g, s in zip(good, size)) / sum(s + 1e-6 for s in size)
    return 1 / (1 + math.exp(-(model.offset + model.slope * q)))


def signed_hash(text):
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_pipeline(spark, documents):
    import public_tokenizers
    import sentencepiece

    model = quality_model(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)
    docs = [d for d in documents if line_quality(model, d["text"]) >= 0.3]
    assert 0 < len(docs) < len(documents)
    places = defaultdict(list)
    for d in docs:
        for pos, c in enumerate(chunks_of(d["text"])):
            if len(c) > 1:
                places["\n".join(c)].append((d["doc_id"], signed_hash(d["text"]), pos))
    for d in docs:
        h = signed_hash(d["text"])
        kept = [x for pos, c in enumerate(chunks_of(d["text"])) if len(c) < 2 or min(places["\n".join(c)]) == (d["doc_id"], h, pos) for x in c]
        d["new"], d["lost"] = "\n".join(kept), not kept
    docs = [d | {"text": d["new"], "n_chars": len(d["new"])} for d in docs if not d["lost"]]
    prints = [simple_print(d["text"]) for d in docs]
    near = [(a, b) for a in range(len(docs)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    group = roots(range(len(docs)), near)
    docs = [min((docs[k] for k in group if group[k] == g), key=lambda d: d["doc_id"]) for g in set(group.values())]
    size = Counter()
    for d in docs:
        size[d["source"]] += len(d["text"])
    total, weight = sum(size.values()), sum(math.sqrt(max(1, s)) for s in size.values())
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for d in docs:
        s = max(1, size[d["source"]])
        rate = math.sqrt(s) * total / weight / s
        draws = max(1, math.ceil(rate / 16))
        n = sum(draw(rate / draws, unit("mix", str(d["doc_id"]), str(j))) for j in range(1, draws + 1))
        want[d["doc_id"], d["text"], d["lang"], d["source"], d["n_chars"], tuple(library.encode(d["text"])), True] += n
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "decoded"]
    assert Counter((*r[:5], tuple(r["ids"]), r["decoded"]) for r in got.collect()) == +want


def test_stages_on_empty_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert docs.count() == 0


def test_op3(spark, documents):
    want = {d["doc_id"]: (n, gone, hashlib.sha256(t.encode()).hexdigest())
            for d, (n, gone, t) in zip(documents, kept_words([(0, d["text"]) for d in documents], 35))}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op3_substring_dedup"](spark, DATA).collect()}
    assert got == want


def test_op4(spark, documents):
    prints = {d["doc_id"]: simple_print(d["text"]) for d in documents}
    ids = sorted(prints)
    want = roots(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op4_simhash"](spark, DATA).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_op5(spark, documents):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{DATA}/labels.parquet").to_pylist()}
    got = {r["doc_id"]: r for r in QUERIES["op5_quality_crf"](spark, DATA).collect()}
    assert set(got) == {d["doc_id"] for d in documents}
    assert all(r["held_out"] == (fold(i) == 0) and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    known = [(got[i]["predicted"], y) for i, y in labels.items() if i in got]
    assert sum(p == y for p, y in known) >= 0.9 * len(known)


def test_op7(spark, documents):
    rows = QUERIES["op7_sentencepiece"](spark, DATA)
    assert rows.count() == len(documents) and rows.where(~F.col("round_trip")).count() == 0


def test_op10(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"], "") for r in pq.read_table(f"{DATA}/embeddings.parquet").to_pylist()]
    links = links_of(rows)
    count, root = Counter(x for e in links for x in e), roots([r[0] for r in rows], links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in QUERIES["op10_embedding_dedup"](spark, DATA).collect()}
    assert got == {r[0]: (count[r[0]], root[r[0]], root[r[0]] == r[0]) for r in rows}
