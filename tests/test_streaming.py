import datetime as dt
from collections import Counter

from pyspark.sql import functions as F

from veilmap.operators.detect import detect_all
from veilmap.operators.findings import scan
from veilmap.operators.replace import anonymize, reveal
from veilmap.streaming import streams

SCHEMA = "id bigint, ts timestamp, text string"


def source(spark, folder, batches):
    start = dt.datetime(2025, 3, 1)
    for i, batch in enumerate(batches):
        rows = [(n, start + dt.timedelta(hours=h), t) for n, h, t in batch]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder),
            spark.read.schema(SCHEMA).parquet(folder))


BATCHES = [
    [(1, 0, "host-1 from 10.0.0.1"), (2, 0, "host-1 again"), (3, 1, "u@corp.local")],
    [(4, 2, "host-1 and host-2"), (5, 2, None)],
    [(6, 30, "host-2 10.0.0.1 host-3")],
]


def test_stream_equals_batch(spark, tmp_path, make_map):
    stream, table = source(spark, str(tmp_path / "in"), BATCHES)
    m = make_map({"host-1": "SRV-A-01", "10.0.0.1": "10.0.9.9"})
    for step in (lambda df: anonymize(df, m), lambda df: scan(df, "id", "text")):
        out = streams.run_available(step(stream), "same")
        assert sorted(map(repr, out.collect())) == sorted(map(repr, step(table).collect()))


def test_new_identifiers(spark, tmp_path):
    stream, _ = source(spark, str(tmp_path / "in"), BATCHES)
    found = scan(stream, ["id", "ts"], "text").select("ts", "identifier_type", "value")
    out = streams.run_available(streams.new_identifiers(found, "ts", "10 days"), "new")
    assert sorted(r.value for r in out.collect()) == ["10.0.0.1", "host-1", "host-2", "host-3", "u@corp.local"]


def test_windows(spark, tmp_path):
    stream, _ = source(spark, str(tmp_path / "in"), BATCHES)
    found = detect_all(stream, ["id", "ts"], "text", ["ipv4"])
    out = streams.run_available(streams.type_counts_by_window(found, "ts"), "windows")
    # Only windows the watermark has passed are final.
    assert [(r.window_start.hour, r.n) for r in out.collect()] == [(0, 1)]


def test_map_growth_and_repeated_batch(spark, tmp_path):
    stream, table = source(spark, str(tmp_path / "in"), BATCHES)
    growth = streams.MapGrowth(str(tmp_path / "map"), "id", "text")
    (stream.writeStream.foreachBatch(growth).option("checkpointLocation", str(tmp_path / "state"))
     .trigger(availableNow=True).start().awaitTermination())
    rows = {r.original_value: r.anonymized_value for r in growth.current(spark).collect()}
    assert set(rows) == {"10.0.0.1", "host-1", "host-2", "host-3", "u@corp.local"}
    assert len(set(rows.values())) == len(rows)
    growth(table.where(F.col("id") == 6), 2)
    assert {r.original_value: r.anonymized_value for r in growth.current(spark).collect()} == rows


def test_snapshots_bound_what_a_batch_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams.MapGrowth, "SNAPSHOT", 2)
    growth = streams.MapGrowth(str(tmp_path / "map"), "id", "text")
    for n in range(7):
        batch = spark.createDataFrame([(n, f"host-{n} and host-{n // 2}")], "id bigint, text string")
        growth(batch, n)
        growth(batch, n)  # repeated after a failure
    rows = growth.current(spark)
    assert sorted(r.original_value for r in rows.collect()) == [f"host-{n}" for n in range(7)]
    assert growth._numbers(spark, "snapshot") == [4, 6] and growth._numbers(spark, "batch") == [4, 5, 6]


def test_stream_grows_and_anonymizes(spark, tmp_path):
    stream, table = source(spark, str(tmp_path / "in"), BATCHES)
    sink = streams.GrowingAnonymizer(str(tmp_path / "map"), "id", "text", str(tmp_path / "out"))
    (stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state"))
     .trigger(availableNow=True).start().awaitTermination())
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 6 and not scan(out, "id", "text").join(
        scan(table, "id", "text").select("value"), "value", "left_semi").count()
    back = reveal(out, sink.current(spark)).select("id", "text").collect()
    assert sorted(map(tuple, back)) == sorted((r.id, r.text) for r in table.collect())


def test_stream_with_a_map_beyond_the_pattern(spark, tmp_path, make_map):
    stream, table = source(spark, str(tmp_path / "in"), BATCHES)
    m = make_map({"host-1": "SRV-A-01", "10.0.0.1": "10.0.9.9"})
    streams.anonymize_stream(stream, m, "text", str(tmp_path / "out"), str(tmp_path / "state"), max_keys=1)
    got = spark.read.parquet(str(tmp_path / "out")).select("id", "text").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, anonymize(table, m).select("id", "text").collect()))


def test_windows_close_and_late_rows_are_written_aside(spark, tmp_path):
    hours = [[0, 0, 1], [3, 0, 1, None], [9, 2, 7], [8, 20]]
    start = dt.datetime(2025, 3, 1)
    sink = streams.ClosedWindows(str(tmp_path / "out"), "ts", ["kind"], delay="1 hour")
    closed, late, opened = Counter(), Counter(), Counter()
    high, n = None, 0
    for number, batch in enumerate(hours):
        rows = []
        for h in batch:
            rows.append((n, None if h is None else start + dt.timedelta(hours=h, minutes=7), "ab"[n % 2]))
            n += 1
            if h is None or high is not None and h + 1 <= high - 1 + 7 / 60:
                late[rows[-1]] += 1
            else:
                opened[start + dt.timedelta(hours=h), rows[-1][2]] += 1
        high = max([h for h in batch if h is not None] + ([] if high is None else [high]))
        for k in [k for k in opened if k[0] + dt.timedelta(hours=1) <= start + dt.timedelta(hours=high - 1, minutes=7)]:
            closed[k] += opened.pop(k)
        df = spark.createDataFrame(rows, "id bigint, ts timestamp, kind string")
        sink(df, number)
        sink(df, number)  # repeated after a failure
        assert Counter({(r.window_start, r.kind): r.n for r in sink.closed(spark).collect()}) == closed
        assert Counter(map(tuple, sink.late(spark).collect())) == late
    assert late and len(sink._numbers(spark, "open")) == 2  # what is older is released
    empty = spark.createDataFrame([], "id bigint, ts timestamp, kind string")
    sink(empty, len(hours))
    assert Counter({(r.window_start, r.kind): r.n for r in sink.closed(spark).collect()}) == closed


def test_windows_without_any_time(spark, tmp_path):
    sink = streams.ClosedWindows(str(tmp_path / "out"), "ts")
    sink(spark.createDataFrame([(1, None)], "id bigint, ts timestamp"), 0)
    assert [r.id for r in sink.late(spark).collect()] == [1] and not sink.closed(spark).count()
