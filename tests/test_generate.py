import re
import uuid

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilmap.operators import generate as G
from veilmap.operators.audit import fake_collisions
from veilmap.operators.maps import upsert_entries
from veilmap.operators.numbering import free_slots, ordinal
from veilmap.operators.unseen import generate_unseen, names_like_fakes

SAMPLE = [
    ("ipv4", "10.0.1.50"), ("ipv4", "10.0.1.51"), ("ipv4", "192.168.7.1"), ("cidr", "192.168.1.0/24"),
    ("hostname", "SQL-PROD-03"), ("hostname", "DC.contoso.local"), ("hostname", "DC.fabrikam.local"),
    ("upn", "jsmith@contoso.com"), ("upn", "a@b.corp.de"), ("guid", "a1b2c3d4-e5f6-7890-abcd-ef1234567890"),
    ("sid", "S-1-5-21-1-2-3-1001"), ("mac", "AA:BB:CC:11:22:33"), ("mac", "AA-BB-CC-11-22-33"),
    ("unc", "\\\\DC.contoso.local\\Finance$\\q1"), ("unc", "\\\\10.0.0.5\\x"),
]


@pytest.fixture
def ids(spark):
    return lambda rows=SAMPLE: spark.createDataFrame(rows, "identifier_type string, value string")


def fakes(m):
    return {r.original_value: r.anonymized_value for r in m.collect()}


def test_shapes(ids):
    f = fakes(G.generate_map(ids(), suffix="keep"))
    assert re.fullmatch(r"10\.0\.\d+\.\d+", f["10.0.1.50"])
    assert re.fullmatch(r"192\.168\.\d+\.\d+/24", f["192.168.1.0/24"])
    assert re.fullmatch(r"SRV-[A-Z]+-\d\d+", f["SQL-PROD-03"])
    assert re.fullmatch(r"SRV-[A-Z]+-\d\d+\.contoso\.local", f["DC.contoso.local"])
    assert re.fullmatch(r"[a-z]+\d+@fabrikam\.com", f["jsmith@contoso.com"])
    guid = "a1b2c3d4-e5f6-7890-abcd-ef1234567890"
    assert f[guid] == str(uuid.uuid5(uuid.NAMESPACE_URL, guid)) == "741993e0-ca81-5f60-adf7-97525b666055"
    parts = f["S-1-5-21-1-2-3-1001"].split("-")
    assert parts[:4] == ["S", "1", "5", "21"] and all(10**9 <= int(p) < 2**32 for p in parts[4:]) and len(parts) == 8
    assert re.fullmatch(r"aa:bb:cc(:[0-9a-f]{2}){3}", f["AA:BB:CC:11:22:33"])
    assert re.fullmatch(r"AA-BB-CC(-[0-9a-f]{2}){3}", f["AA-BB-CC-11-22-33"])
    assert re.fullmatch(r"\\\\SRV-[A-Z]+-\d\d+\.contoso\.local\\Share\d+\$\\q1", f["\\\\DC.contoso.local\\Finance$\\q1"])


def test_masking_hides_names(ids):
    f = fakes(G.generate_map(ids()))
    assert f["DC.contoso.local"].endswith(".fabrikam.local")
    assert f["DC.fabrikam.local"].endswith(".contoso.local")
    assert f["a@b.corp.de"].endswith("@fabrikam.de")
    assert re.fullmatch(r"\\\\SRV-[A-Z]+-\d\d+\\Share\d+", f["\\\\10.0.0.5\\x"])
    assert fakes(G.generate_map(ids(), upn_domain="second_label"))["a@b.corp.de"].endswith("@fabrikam.corp")


def test_linked_servers_share_the_host_fake(ids):
    f = fakes(G.generate_map(ids(), linked=True))
    assert f["\\\\DC.contoso.local\\Finance$\\q1"].startswith("\\\\" + f["DC.contoso.local"] + "\\Share")


@pytest.mark.parametrize("options", [{}, {"preserve_format": False}, {"linked": True, "unc_tail": "mask"}])
def test_unique_and_never_an_original(ids, options):
    rows = SAMPLE + [("ipv4", f"10.9.{i // 200}.{i % 200}") for i in range(2000)]
    rows += [("hostname", f"host-{i}") for i in range(3000)] + [("mac", f"aa:bb:cc:00:{i // 256:02x}:{i % 256:02x}") for i in range(700)]
    f = fakes(G.generate_map(ids(rows), **options))
    assert len(f) == len(set(rows)) and len(set(f.values())) == len(f) and not set(f) & set(f.values())


def test_mac_prefix_is_new_without_format(ids):
    rows = [("mac", f"{v}{m}{i // 256:02X}{m}{i % 256:02x}{m}07") for i in range(300)
            for v, m in (("aa:bb:cc", ":"), ("00-1B-44", "-"))]
    f = fakes(G.generate_map(ids(rows), preserve_format=False))
    assert len(f) == len(set(f.values())) == len(rows)
    assert all(re.fullmatch("([0-9a-f]{2}[:-]){5}[0-9a-f]{2}", v) and k[2] == v[2] == v[14] for k, v in f.items())
    assert not {v[:8].replace("-", ":") for v in f.values()} & {"aa:bb:cc", "00:1b:44"}
    assert len({v[:8] for v in f.values()}) > 500


@pytest.mark.parametrize("preserve_format", [True, False])
def test_mac_full_prefix_is_redrawn(ids, monkeypatch, preserve_format):
    """Prefixes of three addresses, all taken by the originals under their own: fakes find new prefixes."""
    monkeypatch.setattr(G, "_PER_OUI", 3)
    rows = [("mac", f"aa:bb:cc:00:{i // 256:02x}:{i % 256:02x}") for i in range(40)]
    f = fakes(G.generate_map(ids(rows), preserve_format=preserve_format))
    assert len(f) == len(set(f.values())) == len(rows)
    assert not any(v.startswith("aa:bb:cc") for v in f.values())


def test_same_input_same_map(ids):
    assert fakes(G.generate_map(ids())) == fakes(G.generate_map(ids(SAMPLE[::-1])))


def test_growth_keeps_old_entries_and_avoids_their_fakes(ids):
    old = G.generate_map(ids())
    more = ids(SAMPLE + [("hostname", f"host-{i}") for i in range(500)] + [("ipv4", f"10.0.2.{i}") for i in range(250)])
    grown = fakes(upsert_entries(old, G.generate_map(more, old)))
    assert {k: grown[k] for k in fakes(old)} == fakes(old)
    assert len(set(grown.values())) == len(grown)


def test_full_prefix_overflows_into_free_addresses(ids):
    rows = [("ipv4", f"10.7.{c}.{d}") for c in range(256) for d in range(256)]
    f = fakes(G.generate_map(ids(rows)))
    assert len(f) == len(rows) == len(set(f.values())) and not set(f) & set(f.values())


def test_number_collision_with_real_names(ids):
    rows = [("hostname", f"host-{i}") for i in range(2000)] + [("hostname", f"SRV-ASH-{i:02d}") for i in range(1, 30)]
    f = fakes(G.generate_map(ids(rows)))
    assert not set(f) & set(f.values())


MALFORMED = [("ipv6", "::1"), ("ipv4", "10.0.1"), ("cidr", "10.0.0.1"), ("upn", "a@b@c"), ("mac", "AA:BB"), ("unc", "x"),
             ("sid", "S-1-5-32-1"), ("guid", None), (None, "x")]


def test_malformed_identifiers_are_set_apart(ids):
    good = [("ipv4", "10.0.0.1"), ("hostname", "BOX-1"), ("hostname", "::1")]
    df = ids(good + MALFORMED)
    assert set(fakes(G.generate_map(df))) == {v for _, v in good}
    rejected = G.malformed_identifiers(df).collect()
    assert {(r.identifier_type, r.value) for r in rejected} == set(MALFORMED)
    assert {r.reason for r in rejected} >= {"unknown identifier type", "missing value", "invalid ipv4", "invalid unc"}


def test_malformed_is_an_error_where_strict(ids):
    with pytest.raises(Exception, match="invalid ipv4"):
        G.generate_map(ids([("ipv4", "10.0.0.1"), ("ipv4", "10.0.1")]), strict=True).count()


def test_bucketed_ranks_equal_one_window(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    a = ordinal(df, ["g"], F.substring("h", 1, 2), [F.col("h")])
    b = df.withColumn("ordinal", F.row_number().over(W.partitionBy("g").orderBy("h")).cast("bigint"))
    assert a.exceptAll(b.select(a.columns)).count() == 0


@pytest.mark.parametrize("small", [True, False])
def test_free_slots(spark, small):
    # Taken: a long run that crosses a bucket border, and single slots.
    taken = spark.range(65_000, 66_500).selectExpr("id % 1 as g", "id as slot").unionByName(
        spark.createDataFrame([(0, 0), (0, 3), (0, 3), (0, 70_000), (1, 1)], "g bigint, slot bigint"))
    asks = spark.range(1, 68_001).selectExpr("id % 1 as g", "id as ordinal").unionByName(
        spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "g bigint, ordinal bigint"))
    got = {(r.g, r.ordinal): r.slot for r in free_slots(asks, taken, ["g"], small=small).withColumn(
        "ordinal", F.col("ordinal")).collect()}
    held = set(range(65_000, 66_500)) | {0, 3, 70_000}
    free = [s for s in range(80_000) if s not in held]
    assert all(got[0, k] == free[k - 1] for k in range(1, 68_001))
    assert (got[1, 1], got[1, 2], got[2, 1]) == (0, 2, 0)


def test_full_vendor_prefixes_overflow_without_repeats(ids, monkeypatch):
    """Prefixes of 16 addresses: the rest are placed beside all given ones, however often it takes."""
    monkeypatch.setattr(G, "_PER_OUI", 16)
    rows = [("mac", f"aa:bb:{i % 8:02x}:{i // 256 % 256:02x}:{i % 256:02x}:{i // 65536:02x}") for i in range(3000)]
    f = fakes(G.generate_map(ids(rows)))
    assert len(f) == len(set(r[1] for r in rows)) == len(set(f.values()))


def test_sids_are_redrawn_until_free(ids, monkeypatch):
    monkeypatch.setattr(G, "_SID_NUMBERS", 6)
    rows = [("sid", f"S-1-5-21-{i}-1-2-3") for i in range(150)]
    first = G.generate_map(ids(rows[:60]))
    old = fakes(first)
    f = fakes(G.generate_map(ids(rows + [("sid", v) for v in list(old.values())[:5]]), first))
    assert len(f) == 95 and len(set(f.values()) | set(old.values())) == 155
    assert not set(f.values()) & (set(old) | set(f))


def test_fakes_never_stand_in_the_corpus(ids, texts, spark):
    # Every fake of the plain map and its neighbours occur already, some inside longer words.
    plain = G.generate_map(ids())
    taken = [r.anonymized_value for r in plain.collect()]
    words = {v.split("-")[1] for v in taken if v.startswith("SRV-")}
    corpus = texts(*[f"x{v}y" for v in taken], *[f"aSRV-{w}-{n:02d}9" for w in words for n in range(1, 30)], None, "",
                   " ".join(f"10.0.{c}.{d}" for c in range(1, 4) for d in range(1, 255)))
    for options in ({}, {"linked": True}, {"preserve_format": False}):
        m = generate_unseen(corpus, "id", "text", ids(), **options)
        rows = m.collect()
        assert len(rows) == len({r.anonymized_value for r in rows}) == len(SAMPLE)
        assert not fake_collisions(corpus, m, "id", "text").count()
        assert not any(r.anonymized_value in (t.text or "") for r in rows for t in corpus.collect())
    linked = fakes(generate_unseen(corpus, "id", "text", ids(), linked=True))
    assert linked["\\\\DC.contoso.local\\Finance$\\q1"].startswith("\\\\" + linked["DC.contoso.local"] + "\\Share")


def test_unseen_fakes_without_a_clash_are_the_plain_ones(ids, texts):
    assert fakes(generate_unseen(texts("nothing here", None), "id", "text", ids())) == fakes(G.generate_map(ids()))
    old = G.generate_map(ids(SAMPLE[:6]))
    clash = texts(*[r.anonymized_value for r in old.collect()])
    new = fakes(generate_unseen(clash, "id", "text", ids(), old))
    assert set(new) == {v for _, v in SAMPLE[6:]}
    assert not generate_unseen(texts("a"), "id", "text", ids([])).count()


def test_names_like_fakes(texts):
    got = names_like_fakes(texts("to 10.1.2.3/24 at SRV-APP-7x, SRV-APP-7", "none", None, ""), "text")
    names = {r.name for r in got.collect()}
    assert {"10.1.2.3/24", "10.1.2.3"} <= names and names - {"SRV-APP-7"} == {"10.1.2.3/24", "10.1.2.3"}
