"""Steps whose work must follow the input: candidates of large maps, blocks, partitions, streams."""

import hashlib

import pytest
from pyspark.sql import functions as F

from veilmap.operators import audit, detect
from veilmap.operators import replace as R
from veilmap.plans import corpora, registry
from veilmap.streaming.streams import run_available


@pytest.fixture
def events(spark, tmp_path):
    """A folder with 60,000 events in one row group."""
    rows = spark.range(60_000).selectExpr(
        "id as event_id", "timestamp_ntz '2024-01-01 00:00:00' as ts", "id % 90 as user_id", "'click' as event_type")
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


@pytest.fixture
def guid_map(spark):
    """Keys of every beginning: all three-digit starts occur, so beginnings alone tell nothing."""
    return spark.range(20_000).select(
        F.lit("guid").alias("identifier_type"), F.md5(F.col("id").cast("string")).alias("original_value"),
        F.concat(F.lit("F"), "id").alias("anonymized_value"), F.lit("project").alias("scope"), F.lit(True).alias("preserve_format"))


def test_candidates_of_a_large_map_are_few(spark, guid_map):
    """Hexadecimal text without any key asks the map for next to nothing."""
    df = spark.range(500).select("id", F.concat(*[F.sha2(F.concat("id", F.lit(f"/{i}")), 256) for i in range(4)]).alias("text"))
    tries = R._Tries(R.usable_pairs(guid_map))
    assert R._tried(df, ["id"], "text", tries).count() < 500 * 256 / 20


def test_blocks_are_rewritten_by_their_own_keys(spark, guid_map, monkeypatch):
    monkeypatch.setattr(R, "MAX_AUTOMATON_KEYS", 10)
    monkeypatch.setattr(R, "_PACK_BYTES", 20_000)
    key = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    rows = [(i, f"{key(i)}, {key(7)} {key(i + 50_000)}") for i in range(3_000)]
    out = R.anonymize(spark.createDataFrame(rows, "id long, text string").repartition(2), guid_map, max_keys=10)
    assert {r.id: r.text for r in out.collect()} == {i: f"F{i}, F7 {key(i + 50_000)}" for i in range(3_000)}


def test_stream_takes_a_map_beyond_one_pattern(spark, guid_map, tmp_path):
    rows = [(i, "a " + hashlib.md5(str(i).encode()).hexdigest()) for i in range(30)]
    spark.createDataFrame(rows, "id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
    out = run_available(R.anonymize(stream, guid_map, max_keys=100), "large-map")
    assert {r.id: r.text for r in out.collect()} == {i: f"a F{i}" for i in range(30)}


def test_few_row_groups_are_spread(spark, tmp_path):
    """A file of one row group is no single task, in a table or a stream."""
    events = spark.range(60_000).selectExpr(
        "id as event_id", "timestamp_ntz '2024-01-01 00:00:00' as ts", "id % 90 as user_id", "'click' as event_type")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    lines = corpora.log_lines(spark, str(tmp_path))
    sizes = lines.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 3 and sum(r["count"] for r in sizes) == 60_000


def test_words_are_searched_once(monkeypatch):
    """A word that came before is not searched again; its findings are as in the whole text."""
    searched = []
    matches = detect._Finder._matches
    monkeypatch.setattr(detect._Finder, "_matches", lambda self, kind, word: searched.append(word) or matches(self, kind, word))
    find = detect._Finder(detect.select_kinds(), [], False, True, False, False)
    text = "to SRV-APP-01.corp.local, from a.b@corp.local 10.1.2.3/24"
    once = find(f"server {text}", [])
    found = [f for i in range(50) for f in find(f"server {text} {text} é{i}", [])]
    assert len(searched) < 20 and len(found) == 50 * 2 * len(once)
    assert {(t, v) for t, v, *_ in once} == {("ipv4", "10.1.2.3"), ("cidr", "10.1.2.3/24"), ("hostname", "SRV-APP-01.corp.local"),
                                             ("hostname", "corp.local"), ("upn", "a.b@corp.local")}


def test_words_are_rewritten_once():
    """A word that came before is not searched again; keys with blanks are replaced as well."""
    calls = []

    class Counted:
        def __init__(self, keys):
            self.keys = R._automaton(keys)

        def iter(self, source):
            calls.append(source)
            return self.keys.iter(source)

    replaced = R._rewriter(Counted({"ab": "X", "abc": "Y"}), False)
    assert [replaced(f"abc xab  {i % 3}") for i in range(30)] == [f"Y xX  {i % 3}" for i in range(30)]
    assert len(calls) < 10
    assert R._rewriter(R._automaton({"a b": "X"}), True)("ca b a") == "cX a"


def test_blocks_replace_keys_with_blanks(spark, make_map, monkeypatch):
    monkeypatch.setattr(R, "MAX_AUTOMATON_KEYS", 1)
    df = spark.createDataFrame([(1, "the old host and a-host"), (2, "old  host")], "id long, text string")
    out = R.anonymize(df, make_map({"old host": "H1", "a-host": "H2"}), max_keys=1)
    assert {r.id: r.text for r in out.collect()} == {1: "the H1 and H2", 2: "old  host"}


def test_seen_fakes_shuffle_no_occurrences(spark, texts, make_map, monkeypatch):
    """Which fakes occur needs no row per occurrence, for maps of any size."""
    m = make_map({"a": "F1", "b": "c", "d": "zz"})
    df = texts("F1xc", "F1 F1", None)
    monkeypatch.setattr(audit, "find_mapped", None)
    for most in (R.MAX_AUTOMATON_KEYS, 1):
        monkeypatch.setattr(R, "MAX_AUTOMATON_KEYS", most)
        assert {r[0] for r in audit.seen_fakes(df, m, "text").collect()} == {"F1", "c"}
    assert {tuple(r) for r in audit.fake_collisions(df, m, "id", "text").collect()} == {("F1", "in corpus"), ("c", "in corpus")}


def test_leaks_are_searched_where_lines_were_dealt_out(spark, events, make_map):
    """The search is not moved before the exchange, where a file of one row group is one task."""
    lines = corpora.log_lines(spark, events)
    leaks = audit.residual_leaks(R.anonymize(lines, make_map({"SRV-APP-01": "X"}), "line"),
                                 make_map({"evt=7 ": "", "SRV-APP-01": "", "evt=59999 click": ""}), "line_id", "line")
    plan = leaks._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan[:plan.index("Repartition")] and "RLIKE" not in plan
    assert sorted(r.line_id for r in leaks.collect()) == [7, 59_999]


def test_leaks_of_all_strategies(spark, texts, make_map, monkeypatch):
    df, m = texts("a host-1", "host-2", None, "", "a b"), make_map({"host-1": "x", "st-2": "y"})
    for most in (R.MAX_AUTOMATON_KEYS, 1):
        monkeypatch.setattr(R, "MAX_AUTOMATON_KEYS", most)
        assert sorted(r.id for r in audit.residual_leaks(df, m, "id", "text").collect()) == [0, 1]
    assert audit.residual_leaks(df, m.limit(0), "id", "text").count() == 0


def test_stream_query_takes_any_map(spark, events, monkeypatch):
    """The registered stream is written with a map beyond every broadcast as well, from a folder of files too."""
    m = registry._approved_map(spark, events)
    expected = {tuple(r) for r in R.anonymize(corpora.log_lines(spark, events), m, "line").collect()}
    monkeypatch.setattr(R, "MAX_AUTOMATON_KEYS", 1)
    monkeypatch.setattr(R.Replacer.__init__, "__defaults__", ("auto", 1))
    out = registry.stream_anonymize(spark, events).collect()
    assert len(out) == 60_000 and {tuple(r) for r in out} == expected
