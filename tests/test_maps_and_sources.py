import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilmap.operators import maps
from veilmap.plans.pipelines import anonymize_tree, grow_map, reveal_tree, scan_tree
from veilmap.schemas import MAP
from veilmap.sources import corpus, trees
from veilmap.sources.mapfile import read_map, rejected_rows, write_map


def entries(m):
    return {r.original_value: (r.anonymized_value, r.scope) for r in m.collect()}


def test_project_wins_whatever_the_type(make_map):
    g = make_map({"10.0.1.50": "10.0.9.9", "SQL-PROD-03": "SRV-A-1"}, "ipv4", "global")
    p = make_map({"10.0.1.50": "10.0.187.22", "j@c.com": "u@f.com"}, "hostname")
    merged = entries(maps.merge_maps(g, p))
    assert merged == {"10.0.1.50": ("10.0.187.22", "project"), "SQL-PROD-03": ("SRV-A-1", "global"),
                      "j@c.com": ("u@f.com", "project")}
    assert len(entries(g)) == len(entries(p)) == 2
    assert entries(maps.upsert_entries(g, p, "keep"))["10.0.1.50"] == ("10.0.9.9", "global")
    assert maps.show_map(g, p).count() == 3 and maps.show_map(g, p, "global").count() == 2
    with pytest.raises(ValueError):
        maps.show_map(g, p, "other")


def test_entry_rules(spark):
    rows = [("ipv4", "", "x", "project", True), ("ipv4", "x", "", "project", True), ("ipv4", "x", "y", "team", True),
            ("ipv4", "x", "x", "global", True), ("ipv6", "x", "y", "global", True), ("ipv4", "x", "y", "global", False)]
    df = spark.createDataFrame(rows, MAP)
    assert [len(r.violations) for r in maps.validate_map(df, check_type=True).collect()] == [1, 1, 1, 1, 1, 0]
    with pytest.raises(ValueError):
        maps.add_mapping(df.limit(0), "ipv6", "a", "b")
    with pytest.raises(ValueError):
        maps.add_mapping(df.limit(0), "ipv4", "a", "a")
    assert entries(maps.add_mapping(df.where("false"), "ipv4", "a", "b")) == {"a": ("b", "project")}


def test_csv(spark, tmp_path, make_map):
    assert read_map(spark, str(tmp_path / "none.csv")).count() == 0
    path = tmp_path / "map.csv"
    path.write_text('identifier_type,original_value,anonymized_value,scope,preserve_format\n'
                    'ipv4, 10.0.1.50 ,10.0.2.1,project,TRUE\n'
                    'unc,\\\\FILESVR\\a$,"\\\\SRV-X-01\\""q""",global,false\n'
                    'hostname,NA,SRV-NA-01,project,true\n'
                    'hostname,,broken,project,true\n'
                    'ipv4,10.0.1.50,10.0.2.2,project,true\n')
    m = read_map(spark, str(path))
    assert entries(m) == {"10.0.1.50": ("10.0.2.2", "project"), "NA": ("SRV-NA-01", "project"),
                          "\\\\FILESVR\\a$": ('\\\\SRV-X-01\\"q"', "global")}
    assert [r.preserve_format for r in m.where("scope = 'global'").collect()] == [False]
    assert rejected_rows(spark, str(path)).count() == 1
    for single in (False, True):
        out = str(tmp_path / f"out{single}")
        write_map(m, out, single)
        assert sorted(map(tuple, read_map(spark, out).collect())) == sorted(map(tuple, m.collect()))


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in"
    (root / "sub dir").mkdir(parents=True)
    (root / "a.log").write_bytes(b"host SQL-01\r\nfrom 10.0.0.1")
    (root / "sub dir" / "b.TXT").write_text("u@corp.local on SQL-01, é")
    (root / "sub dir" / "c.py").write_text("SQL-01")
    (root / "bad.md").write_bytes(b"SQL-01 \xff\xfe")
    return root


def test_tree_run(spark, tree, tmp_path, make_map):
    found = corpus.read_corpus(spark, str(tree))
    assert sorted((r.relative_path, r.readable) for r in found.collect()) == [
        ("a.log", True), ("bad.md", False), ("sub dir/b.TXT", True)]
    ids = scan_tree(spark, str(tree))
    assert {r.value for r in ids.collect()} == {"SQL-01", "10.0.0.1", "u@corp.local"}
    empty = make_map({})
    m = grow_map(empty, ids)
    out, back = str(tmp_path / "out"), str(tmp_path / "back")
    status = anonymize_tree(spark, str(tree), out, empty, m)
    report = corpus.run_report(status).head()
    assert (report.processed, report.success, report.failed) == (3, 2, 1)
    assert corpus.failed_paths(status).head().path.endswith("bad.md")
    hidden = (tmp_path / "out" / "a.log").read_bytes()
    assert b"SQL-01" not in hidden and b"\r\n" in hidden
    reveal_tree(spark, out, back, empty, m)
    for name in ("a.log", "sub dir/b.TXT"):
        assert (tmp_path / "back" / name).read_bytes() == (tree / name).read_bytes()
    with pytest.raises(ValueError):
        reveal_tree(spark, out, back, empty, empty)
    copied = str(tmp_path / "copy")
    anonymize_tree(spark, str(tree), copied, empty, empty)
    assert (tmp_path / "copy" / "a.log").read_bytes() == (tree / "a.log").read_bytes()


def test_guards(spark, tree, tmp_path):
    for out in (str(tree), str(tree / "x"), str(tree / ".." / "in")):
        with pytest.raises(ValueError):
            corpus.check_output(str(tree), out)
    corpus.check_output(str(tree), str(tmp_path / "in2"))
    with pytest.raises(FileNotFoundError):
        corpus.read_corpus(spark, str(tmp_path / "missing"))
    with pytest.raises(NotADirectoryError):
        corpus.read_corpus(spark, str(tree / "a.log"))
    for bad in ([], ["log"]):
        with pytest.raises(ValueError):
            corpus.read_corpus(spark, str(tree), bad)


def test_extension_of_dot_names(spark):
    df = spark.createDataFrame([("/x/.log",), ("/x.log/y",), ("/x/a.b.LOG",), ("/x/a.",)], "path string")
    assert [r.ok for r in df.select(corpus.has_extension(F.col("path")).alias("ok")).collect()] == [
        False, False, True, False]


def test_replace_redraws_only_when_asked(make_map, spark):
    old = make_map({"host-1": "SRV-OLD-01"})
    ids = spark.createDataFrame([("hostname", "host-1"), ("hostname", "host-2")], "identifier_type string, value string")
    assert entries(grow_map(old, ids))["host-1"][0] == "SRV-OLD-01"
    renewed = entries(grow_map(old, ids, on_conflict="replace"))
    assert renewed["host-1"][0] != "SRV-OLD-01" and len(renewed) == 2


def test_hidden_names_and_uri_targets(spark, tmp_path, make_map):
    tree = tmp_path / "tree"
    names = ["_access.log", ".cache/x.LOG", "sub/a.log", "sub/_d/.b.txt", ".log", "sub/c.py"]
    for name in names:
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text(f"10.0.0.1 in {name}")
    (tree / "_bad.log").write_bytes(b"10.0.0.1 \xc3")
    found = corpus.read_corpus(spark, str(tree))
    assert {r.relative_path: r.text for r in found.collect()} == {
        "_bad.log": None, **{n: f"10.0.0.1 in {n}" for n in names[:4]}}
    out = tmp_path / "uri out"
    m = make_map({"10.0.0.1": "10.0.9.9"})
    status = anonymize_tree(spark, f"file://{tree}", f"file://{out}", m.limit(0), m)
    assert {r.path.rsplit("/", 1)[1]: r.success for r in status.collect()} == {
        "_access.log": True, "x.LOG": True, "a.log": True, ".b.txt": True, "_bad.log": False}
    assert {n: (out / n).read_text() for n in names[:4]} == {n: f"10.0.9.9 in {n}" for n in names[:4]}
    assert not (out / "_bad.log").exists() and not list(out.rglob("*.part-*"))


def test_file_that_cannot_be_written_is_a_failure(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "d").write_text("a file where a folder is needed")
    df = spark.createDataFrame([("a", "d/x.log", "t"), ("b", "y.log", "t")], "path string, relative_path string, text string")
    assert {r.path: r.success for r in corpus.export_tree(df, str(tmp_path / "out")).collect()} == {"a": False, "b": True}
    with pytest.raises(ValueError):
        corpus.export_tree(df, "nowhere://x/y")


def test_output_of_another_store_is_not_inside(tmp_path):
    corpus.check_output("s3://a/x", "hdfs://b/x/y")
    with pytest.raises(ValueError):
        corpus.check_output("s3://a/x", "s3://a/x/y")


def test_duplicates_inside_one_map(spark):
    rows = [("ipv4", "10.0.0.1", f, "project", True) for f in ("10.0.1.1", "10.0.2.2")]
    m = spark.createDataFrame(rows, MAP)
    new = spark.createDataFrame([("ipv4", "10.0.0.1", "10.0.0.9", "project", True)] * 2, MAP)
    assert [r.anonymized_value for r in maps.upsert_entries(m, m.limit(0)).collect()] == ["10.0.2.2"]
    assert [r.anonymized_value for r in maps.upsert_entries(m, new, "replace").collect()] == ["10.0.0.9"]
    assert [r.anonymized_value for r in maps.upsert_entries(m, new, "keep").collect()] == ["10.0.2.2"]


def test_large_tree_is_listed_in_tasks(spark, tmp_path):
    """20,000 files in 2,000 folders, some hidden, listed and read in seconds, over several rounds."""
    want = set()
    for d in range(2000):
        folder = tmp_path / "in" / f"{'._'[d % 2] if d % 10 < 2 else 'd'}{d % 40}" / f"x{d}"
        folder.mkdir(parents=True)
        for f in range(10):
            name = f"{'_' if f == 3 else ''}f {f}.{'log' if f < 9 else 'py'}"
            (folder / name).write_text(f"{d} {f}")
            if f < 9:
                want.add((str((folder / name).relative_to(tmp_path / "in")), len(f"{d} {f}")))
    (tmp_path / "in" / "loop").symlink_to(tmp_path / "in")
    start = time.perf_counter()
    files = trees.list_files(spark, str(tmp_path / "in"), [".log"])
    assert {tuple(r) for r in files.collect()} == want
    assert time.perf_counter() - start < 5
    read = corpus.read_corpus(spark, str(tmp_path / "in"), [".LOG"])
    assert read.select(F.sum(F.length("text"))).first()[0] == sum(n for _, n in want)
    assert read.rdd.getNumPartitions() > 1


def test_contents_are_yielded_by_bytes(tmp_path, monkeypatch):
    monkeypatch.setattr(trees, "READ_BYTES", 100)
    names = [f"{i}.log" for i in range(20)]
    for n in names:
        (tmp_path / n).write_bytes(b"x" * 40)
    (tmp_path / "big.log").write_bytes(b"y" * 400)
    batch = pa.RecordBatch.from_arrays([pa.array([*names, "big.log"])], ["relative_path"])
    out = list(trees._read(str(tmp_path))([batch]))
    assert [r for b in out for r in b.column(0).to_pylist()] == [*names, "big.log"]
    assert max(b.num_rows for b in out) == 2 and len(out) == 11


def test_a_run_that_dies_leaves_nothing(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").cast("string").alias("path"), F.format_string("d/%d.log", "id").alias("relative_path"), "id")
    broken = rows.repartition(4).withColumn("text", F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.lit("t")))
    out = tmp_path / "out"
    with pytest.raises(Exception, match="lost"):
        corpus.export_tree(broken, str(out))
    assert list(tmp_path.iterdir()) == []
    (out / "d").mkdir(parents=True)
    (out / "d" / "1.log").write_text("old")
    with pytest.raises(Exception, match="lost"):
        corpus.export_tree(broken, str(out))
    assert [p.name for p in tmp_path.iterdir()] == ["out"] and (out / "d" / "1.log").read_text() == "old"
    whole = corpus.export_tree(rows.withColumn("text", F.lit("new")), str(out))
    assert whole.where("success").count() == 40 and len(list((out / "d").iterdir())) == 40
    assert (out / "d" / "1.log").read_text() == "new" and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_empty_tree(spark, tmp_path):
    (tmp_path / "in" / "a").mkdir(parents=True)
    assert corpus.read_corpus(spark, str(tmp_path / "in")).count() == 0
