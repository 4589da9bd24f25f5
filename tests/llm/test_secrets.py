import hashlib
import random
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilmap.llm import secrets
from veilmap.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"
# The shapes as the contract words them, without the shortcuts of the operator.
SHAPES = {"assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
          "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}


def brute_force(text):
    out = []
    for m in re.finditer(SHAPES["assign"], text, re.I | re.A):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 12 else []
    for m in re.finditer(SHAPES["access"], text):
        out += [(m.start(), 1, m.end())] if len(m[0]) >= 18 else []
    for m in re.finditer(SHAPES["hex"], text):
        out += [(m.start(), 2, m.end())] if len(m[0]) >= 16 else []
    return [(list(SHAPES)[k], s, e) for s, k, e in sorted(out)]


def secret(seed, n, letters=string.ascii_letters + string.digits):
    return "".join(random.Random(seed).choices(letters, k=n))


HEX = secret(1, 40, "0123456789abcdef")
TEXTS = [None, "", "no secrets", f'Token = "{HEX}"', f"PASSWORD:{secret(2, 11)}", f"apikey:{secret(2, 12)}", f"API_Key = '{secret(3, 20)}'",
         "ſecret=abcdefghijklmn", "toKen=abcdefghijklmn", "AKIA" + "A" * 13, "xAKIA" + "A1" * 7, "é日🙂 " + HEX + " é" + HEX,
         "token=token=abcdefghijklmnop", "password: secret: token=abc", "token" + " " * 5000 + "=" + " " * 5000 + "abcdefghijklmnop",
         f"token='{HEX}", "0123456789abcde", "0123456789abcdefg0123456789abcdef"]


def test_shapes_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, "", "y"), (None, f"token={HEX}", "z")],
                                 "doc_id int, text string, spans string").repartition(3)
    got = secrets.scan_secrets(docs)
    assert got.columns == ["doc_id", "spans"]
    rows = [(r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != "novel"]) for r in got.collect()]
    want = [(i, brute_force(t or "")) for i, t in [*enumerate(TEXTS), (1, ""), (None, f"token={HEX}")]]
    assert Counter(map(str, rows)) == Counter(map(str, want))


def test_random_strings():
    rng = random.Random(5)
    parts = ["token", "Secret", "api_key", "apikey", "passwd", "=", ":", " ", "'", '"', "AKIA", "A", "0af9", "9", "abcdef", "é", "-._", "\n"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(40)))
        assert [s[:3] for s in secrets.find(text, secrets.Novelty([])) if s[0] != "novel"] == brute_force(text), text


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_novel_strings_are_found_and_words_are_not(spark, documents):
    texts = [r["text"] for r in documents.where("length(text) > 400").select("text").limit(150).collect()]
    novelty = secrets.Novelty(secrets.frequent_identifiers(documents))
    hits = words = 0
    for i, text in enumerate(texts):
        at, own = len(text) // 2, secret(i, 16 + i % 24)
        found = secrets.find(f"{text[:at]} the password is {own} now {text[at:]}", novelty)
        hits += any(k == "novel" and s == at + len(" the password is ") and e - s == len(own) for k, s, e, _ in found)
        for word in (w for w in re.findall("[A-Za-z]+", text) if len(w) >= 12):
            found = secrets.find(f"{text[:at]} the password is {word} now {text[at:]}", novelty)
            words += any(k == "novel" for k, *_ in found)
    assert hits >= 0.95 * len(texts)
    assert words <= 0.02 * len(texts)


def test_added_spans_do_not_overlap_base_ones(spark):
    novelty = secrets.Novelty(["password", "the"])
    own, other = secret(9, 30), secret(10, 28)
    text = f"password = {own} and the secret {other}, token {'0123456789abcdef' * 2}"
    found = secrets.find(text, novelty)
    assert [s[0] for s in found] == ["assign", "novel", "hex"]
    assert text[found[1][1]:found[1][2]] == other
    # One long assignment with many hexadecimal runs inside covers a candidate far from its start.
    value = "-".join(["0123456789abcdefg"] * 30) + "-password_" + own
    assert [s[0] for s in secrets.find(f"token={value}", novelty)] == ["assign", *["hex"] * 30]


def test_a_repeated_secret_stays_novel(spark):
    novelty = secrets.Novelty(["password", "the"])
    own = secret(11, 24)
    found = secrets.find(f"password is {own} and again the password is {own}", novelty)
    assert [s[0] for s in found] == ["novel", "novel"]


def test_long_text_is_linear(spark):
    import time

    novelty, took = secrets.Novelty(["the"]), []
    for n in (20_000, 80_000):
        text = f"token {secret(n, 20)} word " * n
        start = time.process_time()
        found = secrets.find(text[:n * 20], novelty, threshold=9)
        took.append(time.process_time() - start)
        assert isinstance(found, list)
    assert took[1] < 8 * took[0] + 1


def test_query_against_brute_force(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op12_secret_scan"](spark, DATA).collect()}
    rows = documents.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        base, out = brute_force(r["text"] or ""), got[r["doc_id"]]
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert out["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert (out["n_assign"], out["n_access"], out["n_hex"]) == tuple(sum(k == x for k, *_ in base) for x in SHAPES)
        assert [s for s in out["spans"].split(",") if s and not s.startswith("novel")] == [s for s in listed.split(",") if s]
    assert sum(r["n_hex"] for r in got.values()) > 0


def test_empty_table(spark):
    assert secrets.scan_secrets(spark.createDataFrame([], "doc_id long, text string")).select(F.size("spans")).count() == 0
