import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilmap.llm import alignment
from veilmap.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
A_PATH, B_PATH = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def models():
    return alignment.ByteLevelBPE.load(A_PATH), alignment.PieceBPE.load(B_PATH)


def byte_decoder():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, n = {}, 0
    for b in range(256):
        table[chr(b) if b in plain else chr(256 + n)] = b
        n += b not in plain
    return table


class Naive:
    def __init__(self):
        self.a = Tokenizer.from_file(A_PATH)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
        self.code = byte_decoder()

    def tokens(self, text):
        if not text:
            return [], []
        a = self.a.encode(" " + text, add_special_tokens=False)
        one = [(i, bytes(self.code[c] for c in self.a.id_to_token(i))) for i in a.ids]
        two = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            two.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        want = (" " + text).encode()
        if b"".join(t for _, t in one) != want or b"".join(t for _, t in two) != want:
            return [], []
        return one, two


def spans(tokens):
    at, out = 0, []
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def brute_force(texts):
    naive = Naive()
    both = [tuple(map(spans, naive.tokens(t))) for t in texts]
    links = [[(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] for a, b in both]
    count = Counter(p for row in links for p in row)
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for (a, b), row in zip(both, links):
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = []
        for lo, hi in zip([0, *cuts], cuts):
            groups.append(",".join(str(x[0]) for x in a if lo <= x[1] < hi) + "|" + ",".join(str(y[0]) for y in b if lo <= y[1] < hi))
        out.append((len(a), len(b), len(groups), len(row), sum(count[p] == most[p[1]] for p in row),
                    sum(count[p] for p in row), ";".join(groups)))
    return out


TEXTS = [None, "", " ", "a", "a▁b", "<|endoftext|> and <s> </s>", "plain words here", "plain words here", "x\0y", "\r\n\t tabs\n\n",
         "  two  blanks  ", "日本語 und ñandú 🙂🙂", "éé", "code = {'a': 1}\n\tprint(code['a'])  # don't", "0123456789" * 7,
         "  wide", "ﬁ ligature", "<0x41>", "aaaa" * 700]


def test_against_brute_force(spark, models):
    rows = [(i if i != 7 else 6, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "null id", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, groups string, n_a int").repartition(3)
    got = alignment.align(docs, *models)
    assert got.columns == ["doc_id", *alignment.RESULT]
    want = Counter((r[0], *x) for r, x in zip(rows, brute_force([r[1] for r in rows])))
    assert Counter(map(tuple, got.collect())) == want


def test_query_on_documents(spark, models):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    short = [d for d in docs]
    want = {d["doc_id"]: (*x[:-1], hashlib.sha256(x[-1].encode()).hexdigest() if x[0] else "")
            for d, x in zip(short, sparse(short))}
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op11_tokenizer_alignment"](spark, DATA).collect()}
    assert got == want


def sparse(docs):
    """The brute force with a sweep instead of all pairs, for long texts."""
    naive, out = Naive(), []
    for d in docs:
        a, b = map(spans, naive.tokens(d["text"]))
        links, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            links.append((a[i][0], b[j][0]))
            end = min(a[i][2], b[j][2])
            i, j = i + (a[i][2] == end), j + (b[j][2] == end)
        cuts = {x[2] for x in a} & {y[2] for y in b}

        def written(tokens):
            out = [[]]
            for t in tokens:
                out[-1].append(str(t[0]))
                if t[2] in cuts:
                    out.append([])
            return [",".join(g) for g in out[:-1]]
        out.append((len(a), len(b), links, ";".join(f"{x}|{y}" for x, y in zip(written(a), written(b))), len(cuts)))
    count = Counter(p for r in out for p in r[2])
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [(na, nb, n, len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), groups)
            for na, nb, links, groups, n in out]


def test_long_texts_are_cut_between_tokens(models, monkeypatch):
    text = " ".join(r["text"] for r in map(lambda i: {"text": f"Wort{i} und, so weiter… l'été 12 345  x▁ y\n"}, range(3000)))
    whole = [m.encode(text) for m in models]
    monkeypatch.setattr(alignment, "SEGMENT", 500)
    assert len(alignment._segments(text)) > 100
    naive = Naive()
    for model, before in zip(models, whole):
        assert (model.encode(text) == before).all()
    assert naive.a.encode(" " + text, add_special_tokens=False).ids == whole[0].tolist()
    assert naive.b.encode(text) == whole[1].tolist()
    assert not re.search(r"\S{2048}", text)


def test_packs_count_alike(spark, models, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(3)
    want = alignment.align(docs, *models).orderBy("doc_id").collect()
    monkeypatch.setattr(alignment, "PACK", 20_000)
    monkeypatch.setattr(alignment, "SLICE", 5_000)
    packs = alignment.packs(docs, *models)
    assert packs.count() > 10 and packs.select("pack").distinct().count() == packs.count()
    assert alignment.align(docs, *models).orderBy("doc_id").collect() == want
    counts = alignment.pair_counts(packs)
    assert counts.where("best").select("b").distinct().count() == counts.select("b").distinct().count()
    assert counts.agg(F.sum("count")).first()[0] == sum(r["n_links"] for r in want)


def test_empty_table(spark, models):
    docs = spark.createDataFrame([], "doc_id int, text string")
    assert alignment.align(docs, *models).count() == 0
