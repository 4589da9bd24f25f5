import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from veilmap.functions import patterns as P
from veilmap.functions.text import drop_contained, find_spans
from veilmap.operators import detect
from veilmap.operators.findings import scan, unique_identifiers

# The patterns as plain Python expressions, and fragments that provoke their edges.
ADDRESS = r"(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})"
PLAIN = {
    "IPV4": (rf"\b{ADDRESS}\b", ["10.", "172.", "16", "31.", "192.168.", "1", "23", ".", "_", "é", "٣", "/", "²", "10.0.0.1"]),
    "CIDR": (rf"\b{ADDRESS}/(?:[0-9]|[1-2][0-9]|3[0-2])\b", ["10.0.0.1", "10.", "/", "3", "1", "24", "33", " ", "_", "."]),
    "NETBIOS": (r"\b[A-Za-z0-9](?:[A-Za-z0-9-]{0,13}[A-Za-z0-9])?\b",
                ["A", "b", "1", "-", "--", "SRV", "_", ".", " ", "é", "ABCDEFGH", "abcdefgh", "²", "́", "\x01"]),
    "FQDN": (r"\b(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,}\b",
             ["a", "com", "1", "-", ".", ".", "_", "x" * 62, "x" * 64, "b-1", " ", "é", "co", "com-x", "😀", "\x01"]),
    "UPN": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", ["a", "@", ".", "com", "-", "_", "%", "+", "é", " ", "c.d"]),
    "GUID": (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
             [str(uuid.UUID(int=random.Random(0).getrandbits(128))), "-", "_", " ", "g", "0f1e2d3c"]),
    "SID": (r"\bS-1-5-21-\d+(?:-\d+)+\b", ["S-1-5-21-", "1", "23", "-", "a", "_", "٣", " ", "S-1-5-21-1-2"]),
    "MAC": (r"\b(?:[0-9a-fA-F]{2}[:\-]){5}[0-9a-fA-F]{2}\b", ["AA", ":", "-", "bb:", "0f-", "1", " ", "_", "AA:BB:CC:DD:EE:"]),
    "UNC": (r"\\\\[A-Za-z0-9._-]+\\[A-Za-z0-9._$-]+(?:\\[A-Za-z0-9._$-]+)*", ["\\", "\\\\", "srv", ".", "-", "$", " ", "é"]),
}


def passes_gate(name):
    return "-" in name or (name.isupper() and len(name) >= 4 and any(c.isdigit() for c in name))


@pytest.mark.parametrize("name", PLAIN)
def test_spans_equal_python_finditer(spark, texts, name):
    plain, fragments = PLAIN[name]
    rng = random.Random(name)
    values = ["".join(rng.choice(fragments) for _ in range(rng.choice([3, 12, 80]))) for _ in range(800)]
    rows = texts(*values).select("id", find_spans("text", getattr(P, name)).alias("s")).collect()
    for row in rows:
        expected = [(m.start(), m.end(), m.group()) for m in re.finditer(plain, values[row.id])]
        found = [tuple(s) for s in row.s]
        if name == "NETBIOS":
            expected = [e for e in expected if passes_gate(e[2])]
            found = [f for f in found if passes_gate(f[2])]
        assert found == expected, values[row.id]


@pytest.mark.parametrize("name,text,count", [
    ("FQDN", "a." * 100_000 + "com", 1), ("FQDN", "1." * 20_000 + "1", 0),
    ("SID", "S-1-5-21-1" + "-2" * 100_000, 1), ("UNC", "\\\\a\\b" + "\\c" * 100_000, 1),
    ("NETBIOS", "abc host-1 " * 50_000, 50_000)])
def test_very_long_runs(texts, name, text, count):
    spans = texts(text).select(find_spans("text", getattr(P, name)).alias("s")).head().s
    assert len(spans) == count
    assert all(text[s.start_pos:s.end_pos] == s.value for s in spans[-3:])


def test_containment_small_and_large(spark):
    rng = random.Random(1)

    def spans(n, gap, size):
        out, at = [], 0
        for _ in range(n):
            at += rng.randint(0, gap)
            end = at + rng.randint(1, size)
            out.append((at, end, "v"))
            at = end
        return out
    for n in (5, 300):
        inner, outer = spans(n, 3, 3), spans(n, 4, 9)
        df = spark.createDataFrame([(inner, outer)], "a array<struct<start_pos:int,end_pos:int,value:string>>, "
                                                     "b array<struct<start_pos:int,end_pos:int,value:string>>")
        kept = [tuple(s) for s in df.select(drop_contained("a", ["b"]).alias("k")).head().k]
        assert kept == [i for i in inner if not any(o[0] <= i[0] and i[1] <= o[1] for o in outer)]


def values(df, kind=None):
    return sorted(r.value for r in df.collect() if kind in (None, r.identifier_type))


def found(texts, text, kind):
    return detect.detect(texts(text), "id", "text", kind)


def test_ipv4(texts):
    inside = ["10.44.7.9", "172.31.255.0", "172.19.3.3", "192.168.0.7", "10.0.0.0"]
    text = "uplink " + " via ".join(inside) + ", done"
    assert values(found(texts, text, "ipv4")) == sorted(inside)
    assert values(found(texts, "9.9.9.9, 172.15.0.1, 172.32.8.8, 192.169.1.1, 10.256.1.1, 210.1.2.3", "ipv4")) == []
    assert values(found(texts, "10.٣.0.1 10.٩٩٩.0.1", "ipv4")) == ["10.٣.0.1"]


def test_cidr_also_gives_its_address(texts):
    df = detect.detect_all(texts("routes 172.20.4.0/22, 10.9.0.1/33"), "id", "text", ["ipv4", "cidr"])
    assert values(df, "cidr") == ["172.20.4.0/22"]
    assert values(df, "ipv4") == ["10.9.0.1", "172.20.4.0"]


def test_hostnames(texts):
    names = ["edge-7", "PUMP44", "gate-2.plant.example", "Relay.yard-5.example.net"]
    assert values(found(texts, " then ".join(names), "hostname")) == sorted(names)
    assert values(found(texts, "see notes.md, pump-4.csv and setup.ini", "hostname")) == []
    assert values(found(texts, "The quick brown fox jumps. It is 2025-03-01, nothing more.", "hostname")) == []
    assert values(found(texts, "VERY-LONG-HOSTNAME-01 utf-8 555-6869 2025-03-01T10", "hostname")) == sorted(
        ["VERY-LONG", "HOSTNAME-01", "utf-8", "555-6869", "2025-03-01T10"])


def test_host_confidence(texts):
    rows = {r.value: r.confidence for r in found(
        texts, "a-1 sql-1 x.y.zz" + " " * 300 + "Connected To b-1 sql-2.zz", "hostname").collect()}
    assert rows == {"a-1": 0.7, "sql-1": 0.8, "x.y.zz": 0.8, "b-1": 0.8, "sql-2.zz": 0.95}


def test_host_confidence_in_a_long_text(texts):
    filler = "word " * 5_000
    text = filler + "b-1 " + filler + "connected to c-1 " + filler + "d-1"
    rows = {r.value: r.confidence for r in found(texts, text, "hostname").collect()}
    assert rows == {"b-1": 0.7, "c-1": 0.8, "d-1": 0.7}


def drawn_guid(seed):
    return str(uuid.UUID(int=random.Random(seed).getrandbits(128)))


def test_identities(texts):
    """Accepted and refused forms of each kind, drawn by rule: public mail domains, glued letters, other authorities."""
    upns = [f"{name}@{domain}" for name in ("m.lee", "x+1_y") for domain in ("plant.example", "ad.mill.example")]
    public = [f"m.lee@{domain}" for domain in P.PUBLIC_MAIL_DOMAINS]
    guids = [drawn_guid(i) for i in range(4)] + [drawn_guid(9).upper()]
    sids = [f"S-1-5-21-{'-'.join(str(7 * i + k) for k in range(n))}" for i, n in enumerate((2, 3, 4))]
    refused = [f"x{guids[0]}", f"{guids[1]}0", "S-1-5-18", "S-1-5-32-555", "S-1-5-21-9"]
    df = found(texts, " ; ".join(upns + public + guids + sids + refused), "identity")
    assert [values(df, k) for k in ("upn", "guid", "sid")] == [sorted(upns), sorted(guids), sorted(sids)]


def test_network(texts):
    pairs = [f"{i * 29 % 256:02x}" for i in range(1, 7)]
    macs = [":".join(pairs), "-".join(pairs).upper()]
    paths = ["\\\\" + "\\".join(parts) for parts in (("nas1", "pay$"), ("nas-2.mill", "a_b", "c.d", "e$"))]
    refused = [":".join(pairs[:5]), ":".join(pairs) + "f", "\\\\nas3", "\\nas4\\x"]
    df = found(texts, " , ".join(macs + paths + refused), "network")
    assert values(df, "mac") == sorted(macs)
    assert values(df, "unc") == sorted(paths)


def test_scan_drops_hosts_in_upns_and_repeats(texts):
    log = "a@corp.local b-1 b-1 user@gmail.com"
    df = scan(texts(log, log, None, ""), "id", "text")
    assert sorted((r.id, r.value, r.start_pos) for r in df.collect()) == sorted(
        (i, v, log.index(v)) for i in (0, 1) for v in ("a@corp.local", "b-1", "gmail.com"))


def test_unknown_detector_and_extra(texts):
    with pytest.raises(KeyError):
        detect.detect_all(texts("x"), "id", "text", ["ipv6"])
    extra = detect.detect_all(texts("order PO-12 it's"), "id", "text", ["ipv4"], [("order", "PO-[0-9]+|it's", 0.5)])
    assert [(r.identifier_type, r.value, r.confidence) for r in extra.collect()] == [
        ("order", "PO-12", 0.5), ("order", "it's", 0.5)]


def test_suppress_nested(texts):
    guid = drawn_guid(2)
    assert values(scan(texts(guid), "id", "text", suppress_nested=True)) == [guid]
    assert len(values(scan(texts(guid), "id", "text"))) > 1


def test_positions_count_code_points(texts):
    text = "😀é 10.0.0.1"
    row = found(texts, text, "ipv4").head()
    assert text[row.start_pos:row.end_pos] == "10.0.0.1"


def test_finding_violations_are_empty_for_detected(texts):
    df = detect.finding_violations(detect.detect_all(texts("10.0.0.1 a-1 u@c.de"), "id", "text"))
    assert df.where(F.size("violations") > 0).count() == 0


def test_cidr_parts(spark):
    df = spark.createDataFrame([("10.0.0.0/8",), ("10.0.0.0",), ("10.0.0.0/40",), ("10.0.0.0/x",)], "value string")
    rows = {r.value: (r.ip, r.prefix, r.error) for r in detect.cidr_parts(df).collect()}
    assert rows["10.0.0.0/8"] == ("10.0.0.0", 8, None)
    assert rows["10.0.0.0"][2] == "invalid CIDR notation"
    assert rows["10.0.0.0/40"][2] == rows["10.0.0.0/x"][2] == "invalid prefix length"


def test_host_context_costs_in_proportion_to_the_text(spark):
    """Four times the text takes about four times as long, whether a telling phrase occurs or not."""
    import time

    line = "edge-7.plant.example and pump-4 plain words here gate-2.yard.example connected to relay-9 "
    seconds = {}
    for n in (1, 1, 4):  # the first run compiles
        df = spark.createDataFrame([(1, line * (n * 6000))], "id long, text string").coalesce(1)
        start = time.perf_counter()
        assert detect.detect(df, "id", "text", "hostname").count() == n * 24000
        seconds[n] = time.perf_counter() - start
    assert seconds[4] < 9 * seconds[1]


def test_null_keys_and_clashing_names(spark):
    df = spark.createDataFrame([(None, "edge-7.plant.example"), (3, "edge-7.plant.example"), (None, "10.1.1.1")], "id long, text string")
    got = {r.value: r.confidence for r in unique_identifiers(scan(df, "id", "text"), "id").collect()}
    assert got == {"edge-7.plant.example": 0.8, "10.1.1.1": 1.0}
    with pytest.raises(ValueError, match="rename"):
        detect.detect(df.withColumnRenamed("id", "value"), "value", "text", "ipv4")
