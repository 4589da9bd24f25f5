"""Every operator as a query over the given tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmap.operators import audit, detect, findings, generate, maps, replace, unseen
from veilmap.plans.corpora import log_lines, log_lines_of, spread_events, table
from veilmap.plans.pipelines import anonymize_tree, grow_map, reveal_tree
from veilmap.schemas import MAP_COLUMNS
from veilmap.sources import corpus as files
from veilmap.sources.mapfile import read_map, write_map, write_rows
from veilmap.sources.storage import materialize, new_path
from veilmap.streaming import streams

APPROVED = ("ipv4", "cidr", "mac", "unc")
_KEY, _TEXT = "line_id", "line"
_written: dict[tuple, DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A table that several queries start from, written on first use."""
    slot = (spark.sparkContext.applicationId, sf_dir, name)
    if slot not in _written:
        _written[slot] = materialize(build(), name)
    return _written[slot]


def _hits(kind: str, **options):
    return lambda spark, sf: detect.detect(log_lines(spark, sf), _KEY, _TEXT, kind, **options)


def _identifiers(spark, sf):
    """Distinct identifiers of the log lines."""
    return _once(spark, sf, "inventory", lambda: findings.unique_identifiers(
        findings.scan(log_lines(spark, sf), _KEY, _TEXT), _KEY))


def _full_map(spark, sf):
    return _once(spark, sf, "fullmap", lambda: generate.generate_map(_identifiers(spark, sf)))


def _approved_map(spark, sf):
    return _full_map(spark, sf).where(F.col("identifier_type").isin(*APPROVED))


def _two_scopes(spark, sf):
    """A global map of all fakes, and a project map with other fakes for addresses."""
    m = _full_map(spark, sf)
    project = m.where(F.col("identifier_type").isin("ipv4", "cidr")).withColumns({
        "anonymized_value": F.concat(F.lit("project-"), "anonymized_value"),
        "identifier_type": F.lit("hostname")})
    only = m.where(F.col("identifier_type") == "sid")
    return (m.where(F.col("identifier_type") != "sid").withColumn("scope", F.lit("global")),
            project.unionByName(only))


# -- detection ---------------------------------------------------------------------

def validate_rfc1918(spark, sf):
    tokens = log_lines(spark, sf).select(_KEY, F.explode(F.regexp_extract_all(
        _TEXT, F.lit(r"[0-9]+(?:\.[0-9]+)+"), F.lit(0))).alias("value"))
    return tokens.select(_KEY, "value", detect.valid_private_address(F.col("value")).alias("valid"))


def cidr_parts(spark, sf):
    tokens = log_lines(spark, sf).select(_KEY, F.explode(F.regexp_extract_all(
        _TEXT, F.lit(r"[0-9.]+/[0-9]+"), F.lit(0))).alias("value"))
    return detect.cidr_parts(tokens)


def hostname_fp_filter(spark, sf):
    tokens = log_lines(spark, sf).select(_KEY, F.explode(F.split(_TEXT, " ")).alias("value"))
    return tokens.where(detect.plausible_hostname(F.col("value")))


def hostname_confidence(spark, sf):
    return _hits("hostname")(spark, sf).groupBy("value", "confidence").agg(F.count("*").alias("n"))


def detect_all_raw(spark, sf):
    return detect.detect_all(log_lines(spark, sf), _KEY, _TEXT)


def detect_documents(spark, sf):
    return detect.detect_all(table(spark, sf, "documents"), "doc_id", "text")


def detect_pages(spark, sf):
    return detect.detect_all(table(spark, sf, "pages"), "page_id", "html")


def detect_conversations(spark, sf):
    return detect.detect_all(table(spark, sf, "conversations"), ["conv_id", "turn"], "text")


def finding_violations(spark, sf):
    """Findings of the log lines, damaged by position and length, and what is wrong."""
    f = detect_all_raw(spark, sf)
    damage = F.pmod(F.col("start_pos") + F.length("value"), F.lit(5))
    damaged = f.withColumns({
        "confidence": F.when(damage == 0, F.col("confidence") + 1).otherwise(F.col("confidence")),
        "end_pos": F.when(damage == 1, F.col("start_pos") - 1).otherwise(F.col("end_pos")),
        "value": F.when(damage == 2, F.lit("")).otherwise(F.col("value"))})
    return (detect.finding_violations(damaged)
            .groupBy(F.array_join("violations", "; ").alias("violations"))
            .agg(F.count("*").alias("n")))


# -- findings ----------------------------------------------------------------------

def _scanned(spark, sf):
    return findings.scan(log_lines(spark, sf), _KEY, _TEXT)


def scan_doc_distinct(spark, sf):
    return detect.find(log_lines(spark, sf), _KEY, _TEXT, detect.select_kinds(), first_per_value=True)


def scan_docs_with_hits(spark, sf):
    return findings.documents_with_findings(detect_documents(spark, sf), "doc_id")


def scan_unique(spark, sf):
    return findings.unique_identifiers(_scanned(spark, sf), _KEY)


def scan_approved(spark, sf):
    return findings.approve(scan_unique(spark, sf), APPROVED)


# -- maps --------------------------------------------------------------------------

def map_violations(spark, sf):
    """The map with rows damaged by the length of the original, and the rules they break."""
    m = _full_map(spark, sf)
    damage = F.pmod(F.length("original_value"), F.lit(6))
    damaged = m.withColumns({
        "scope": F.when(damage == 0, F.lit("team")).otherwise(F.col("scope")),
        "anonymized_value": F.when(damage == 1, F.col("original_value"))
                             .when(damage == 2, F.lit("")).otherwise(F.col("anonymized_value")),
        "identifier_type": F.when(damage == 3, F.lit("ipv6")).otherwise(F.col("identifier_type"))})
    return maps.validate_map(damaged, check_type=True).select(
        "original_value", F.array_join("violations", "; ").alias("violations"))


def map_merge(spark, sf):
    return maps.merge_maps(*_two_scopes(spark, sf))


def map_upsert(spark, sf):
    return maps.upsert_entries(*_two_scopes(spark, sf), on_conflict="keep")


def map_add_manual(spark, sf):
    return maps.add_mapping(_approved_map(spark, sf), "hostname", "SQL-PROD-03", "SRV-MANUAL-01")


def map_show(spark, sf):
    return maps.show_map(*_two_scopes(spark, sf), "merged")


def map_projection(spark, sf):
    return maps.mapping(map_merge(spark, sf))


def map_invert(spark, sf):
    """Hosts that share one fake per type: the last original wins."""
    m = _full_map(spark, sf).withColumn(
        "anonymized_value", F.concat(F.lit("fake-"), F.substring(F.md5("original_value"), 1, 2)))
    return maps.invert(m)


def _csv_map(spark, m):
    path = new_path(spark, "mapfile")
    write_map(m, path)
    return path


def map_csv_roundtrip(spark, sf):
    return read_map(spark, _csv_map(spark, map_merge(spark, sf)))


def map_load_last_wins(spark, sf):
    """Global rows with padded cells in part files before those of the project rows."""
    global_map, project = _two_scopes(spark, sf)
    rows = maps.to_text_rows(global_map).withColumns({
        "original_value": F.concat(F.lit(" "), "original_value", F.lit("  ")), "_part": F.lit(0)})
    rows = rows.unionByName(maps.to_text_rows(project).withColumn("_part", F.lit(1)))
    path = new_path(spark, "mapfile")
    write_rows(rows, path, ["_part", "original_value"], ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_map(spark, path)


# -- generation --------------------------------------------------------------------

def _fakes(*types, **options):
    def query(spark, sf):
        ids = findings.approve(_identifiers(spark, sf), types)
        return generate.generate_map(ids, **options).select(
            "identifier_type", "original_value", "anonymized_value")
    return query


def generate_quarantine(spark, sf):
    """The identifiers, some with a wrong type or without their separators: what no fake is generated for."""
    damage = F.pmod(F.length("value"), F.lit(7))
    damaged = _identifiers(spark, sf).withColumns({
        "identifier_type": F.when(damage == 0, F.lit("ipv6")).otherwise(F.col("identifier_type")),
        "value": F.when(damage == 1, F.translate("value", ".@:-\\", "")).otherwise(F.col("value"))})
    return generate.malformed_identifiers(damaged)


def generate_unseen(spark, sf):
    """Log lines after which every fake of the plain map stands as well: per type the entries of a map
    made for them, and how many of its fakes occur in them."""
    lines, plain = log_lines(spark, sf), _full_map(spark, sf)
    also = plain.select(F.lit(-1).cast("long").alias(_KEY), F.concat(
        F.lit("was "), "anonymized_value", F.lit("x")).alias(_TEXT))
    corpus = materialize(lines.unionByName(also), "used-lines")
    m = materialize(unseen.generate_unseen(corpus, _KEY, _TEXT, _identifiers(spark, sf)), "unseen")
    clash = audit.fake_collisions(corpus, m, _KEY, _TEXT).select("anonymized_value").distinct()
    return m.join(clash.withColumn("hit", F.lit(1)), "anonymized_value", "left").groupBy("identifier_type").agg(
        F.count("*").alias("entries"), F.count_distinct("anonymized_value").alias("fakes"), F.count("hit").alias("collisions"))


def fake_uniqueness(spark, sf):
    """Per type: entries, distinct fakes, fakes that are originals."""
    m = _full_map(spark, sf)
    originals = m.select(F.col("original_value").alias("anonymized_value"), F.lit(1).alias("hit"))
    return (m.join(originals, "anonymized_value", "left").groupBy("identifier_type")
            .agg(F.count("*").alias("entries"), F.count_distinct("anonymized_value").alias("fakes"),
                 F.count("hit").alias("fakes_among_originals")))


def map_growth(spark, sf):
    """A map of some types grown by the rest: old entries stay."""
    ids = _identifiers(spark, sf)
    first = generate.generate_map(findings.approve(ids, ("hostname", "guid", "upn")))
    old = materialize(first, "firstmap")
    return grow_map(old, ids).join(old.select(
        "original_value", F.col("anonymized_value").alias("before")), "original_value", "left").groupBy(
        "identifier_type").agg(F.count("*").alias("entries"),
                               F.count_if(F.col("before") == F.col("anonymized_value")).alias("kept"))


# -- replacement -------------------------------------------------------------------

def mapped_occurrences(spark, sf):
    return replace.find_mapped(log_lines(spark, sf), _KEY, _TEXT, _approved_map(spark, sf))


def longest_match(spark, sf):
    return replace.longest_match(mapped_occurrences(spark, sf), _KEY)


def overlap_resolution(spark, sf):
    return replace.resolve_overlaps(longest_match(spark, sf), _KEY)


def anonymize_lines(spark, sf):
    return replace.anonymize(log_lines(spark, sf), _approved_map(spark, sf), _TEXT)


def anonymize_join(spark, sf):
    return replace.anonymize(log_lines(spark, sf), _approved_map(spark, sf), _TEXT, _KEY, engine="join")


def reveal_lines(spark, sf):
    return replace.reveal(anonymize_lines(spark, sf), _approved_map(spark, sf), _TEXT)


def reveal_full(spark, sf):
    """All types anonymised and revealed; equals the log lines."""
    m = _full_map(spark, sf)
    return replace.reveal(replace.anonymize(log_lines(spark, sf), m, _TEXT, _KEY), m, _TEXT, _KEY)


def roundtrip_audit(spark, sf):
    return audit.roundtrip_report(log_lines(spark, sf), _full_map(spark, sf), _KEY, _TEXT)


def residual_leaks(spark, sf):
    return audit.residual_leaks(anonymize_lines(spark, sf), _approved_map(spark, sf), _KEY, _TEXT)


def map_ambiguous_fakes(spark, sf):
    m = _full_map(spark, sf).withColumn(
        "anonymized_value", F.concat(F.lit("fake-"), F.substring(F.md5("original_value"), 1, 3)))
    return audit.ambiguous_fakes(m)


def map_fake_collisions(spark, sf):
    """Fakes chosen to collide: the start of the original and one hexadecimal digit."""
    m = _approved_map(spark, sf)
    shifted = m.withColumn("anonymized_value", F.concat(
        F.substring("original_value", 1, 5), F.substring(F.md5("original_value"), 1, 1)))
    return audit.fake_collisions(log_lines(spark, sf), shifted, _KEY, _TEXT)


# -- corpora and files -------------------------------------------------------------

def corpus_ext_filter(spark, sf):
    suffix = F.element_at(F.array(*map(F.lit, [".log", ".TXT", ".md", ".py", ".Ps1", "", ".log.gz"])),
                          (F.col("doc_id") % 7 + 1).cast("int"))
    named = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("/data/"), "source", F.lit("/doc"), "doc_id", suffix).alias("path"))
    return named.where(files.has_extension(F.col("path")))


def corpus_table(spark, sf):
    """Whole texts of a table, other columns pruned from the scan."""
    return files.corpus_from_table(table(spark, sf, "documents"), "doc_id", "text")


def corpus_status(spark, sf):
    """Files of a run over a tree: written, or not because they are no text."""
    _, status = _tree_run(spark, sf)
    return status.select(F.regexp_extract("path", "(d[0-9]/[^/]*)$", 1).alias("relative_path"), "success")


def corpus_relative_path(spark, sf):
    paths = table(spark, sf, "documents").select("doc_id", F.concat(
        F.element_at(F.array(F.lit("/data/in/"), F.lit("/data/other/")), (F.col("doc_id") % 2 + 1).cast("int")),
        "source", F.lit("/doc"), "doc_id", F.lit(".log")).alias("path"))
    return paths.withColumn("relative_path", files.relative_to(F.col("path"), "/data/in")).where(
        "relative_path is not null")


def _tree(spark, sf):
    """Log lines grouped into one text file per hundred events, as a file tree; some names are hidden or in
    upper case, some files end inside a character."""
    part = F.floor(F.col(_KEY) / 100)
    name = F.concat(F.when(part % 5 == 1, "_").when(part % 5 == 2, ".").otherwise(""), F.lit("part"), part,
                    F.when(part % 7 == 0, ".LOG").otherwise(".log"))
    lines = log_lines(spark, sf).withColumns({
        "path": F.concat(F.lit("d"), F.col(_KEY) % 3, F.lit("/"), name), "broken": part % 11 == 3})
    texts = lines.groupBy("path", "broken").agg(F.sort_array(F.collect_list(F.struct(_KEY, _TEXT))).alias("l")).select(
        F.col("path"), F.col("path").alias("relative_path"), F.concat(
            F.array_join(F.transform("l", lambda x: x[_TEXT]), "\n").cast("binary"),
            F.when(F.col("broken"), F.unhex(F.lit("C3"))).otherwise(F.unhex(F.lit("")))).alias("text"))
    root = new_path(spark, "tree")
    if not files.failed_paths(files.export_tree(texts, root)).isEmpty():
        raise OSError(f"cannot write below {root}")
    return root


def _tree_run(spark, sf):
    root = _tree(spark, sf)
    m = _approved_map(spark, sf)
    out = new_path(spark, "tree-out")
    return out, anonymize_tree(spark, root, out, m.limit(0), m)


def anonymize_corpus(spark, sf):
    out, _ = _tree_run(spark, sf)
    return files.read_corpus(spark, out).select("relative_path", F.md5("text").alias("md5"))


def reveal_corpus(spark, sf):
    out, _ = _tree_run(spark, sf)
    m = _approved_map(spark, sf)
    back = new_path(spark, "tree-back")
    reveal_tree(spark, out, back, m.limit(0), m)
    return files.read_corpus(spark, back).select("relative_path", F.md5("text").alias("md5"))


def run_report(spark, sf):
    return files.run_report(_tree_run(spark, sf)[1])


# -- streams -----------------------------------------------------------------------

def _line_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    # A pattern, so that a stream takes the table as one file or as a folder of files.
    events = spread_events(spark, sf, spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]"))
    # Event time must be an instant; the table holds wall-clock times.
    return log_lines_of(events.withColumn("ts", F.col("ts").cast("timestamp")), with_time=True)


def stream_anonymize(spark, sf):
    stream, out = _line_stream(spark, sf).drop("ts"), new_path(spark, "stream")
    streams.anonymize_stream(stream, _approved_map(spark, sf), _TEXT, out, new_path(spark, "stream-state"))
    return spark.read.schema(stream.schema).parquet(f"{out}/batch=*")


def stream_new_identifiers(spark, sf):
    found = findings.scan(_line_stream(spark, sf), [_KEY, "ts"], _TEXT).select("ts", "identifier_type", "value")
    return streams.run_available(streams.new_identifiers(found, "ts", "7 days"), "new").select(
        "identifier_type", "value")


def stream_map_growth(spark, sf):
    growth = streams.MapGrowth(new_path(spark, "growing"), _KEY, _TEXT)
    (_line_stream(spark, sf).drop("ts").writeStream.foreachBatch(growth)
     .option("checkpointLocation", new_path(spark, "growth-state"))
     .trigger(availableNow=True).start().awaitTermination())
    return growth.current(spark).select(MAP_COLUMNS)


def stream_grow_and_anonymize(spark, sf):
    """A stream anonymised with the map that its own batches grow, and revealed with it: every line
    is as before, and none was written in clear."""
    out = new_path(spark, "grown-lines")
    sink = streams.GrowingAnonymizer(new_path(spark, "growing"), _KEY, _TEXT, out)
    stream = _line_stream(spark, sf).drop("ts")
    (stream.writeStream.foreachBatch(sink).option("checkpointLocation", new_path(spark, "grown-state"))
     .trigger(availableNow=True).start().awaitTermination())
    hidden = spark.read.schema(stream.schema).parquet(f"{out}/batch=*").withColumn("hidden", F.col(_TEXT))
    return replace.reveal(hidden, sink.current(spark), _TEXT).withColumn("hidden", F.col("hidden") != F.col(_TEXT))


def stream_type_window(spark, sf):
    found = detect.detect_all(_line_stream(spark, sf), [_KEY, "ts"], _TEXT)
    counts = streams.type_counts_by_window(found, "ts")
    return _complete(counts).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _arrivals(spark, sf):
    """Log lines in five deliveries by day; of every tenth line the next delivery."""
    events = table(spark, sf, "events")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    day, days = F.datediff("ts", F.lit(first)), F.datediff(F.lit(last), F.lit(first)) + 1
    part = F.floor(day * 4 / days) + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    lines = log_lines_of(events.withColumn("ts", F.col("ts").cast("timestamp")), with_time=True)
    return lines.join(events.select(F.col("event_id").alias(_KEY), part.cast("int").alias("part")), _KEY)


def stream_closed_windows(spark, sf):
    """Deliveries read one by one, the query started anew for each: closed windows, and late findings per window."""
    source, state = new_path(spark, "arrivals"), new_path(spark, "arrivals-state")
    lines = materialize(_arrivals(spark, sf), "deliveries")
    sink = streams.ClosedWindows(new_path(spark, "closed"), "ts", ["identifier_type"])
    for part in range(5):
        lines.where(F.col("part") == part).drop("part").write.mode("append").parquet(source)
        stream = spark.readStream.schema(lines.drop("part").schema).parquet(source)
        found = detect.detect_all(stream, [_KEY, "ts"], _TEXT)
        (found.writeStream.foreachBatch(sink).option("checkpointLocation", state)
         .trigger(availableNow=True).start().awaitTermination())
    late = sink.late(spark).groupBy(F.window("ts", sink.length)["start"].alias("window_start"), "identifier_type").agg(
        F.count("*").alias("n"))
    both = sink.closed(spark).withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return both.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _complete(counts: DataFrame) -> DataFrame:
    """All windows, the open ones too, from the state at the end of the input."""
    spark = counts.sparkSession
    out = new_path(spark, "windows")
    (counts.writeStream.outputMode("complete")
     .foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(out))
     .option("checkpointLocation", new_path(spark, "windows-state"))
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(counts.schema).parquet(out)


QUERIES = {
    "detect_ipv4": _hits("ipv4"),
    "validate_rfc1918": validate_rfc1918,
    "detect_cidr": _hits("cidr"),
    "cidr_parts": cidr_parts,
    "detect_fqdn": _hits("fqdn"),
    "detect_netbios": _hits("netbios", nested_netbios=True),
    "hostname_fp_filter": hostname_fp_filter,
    "netbios_outside_fqdn": _hits("netbios"),
    "hostname_confidence": hostname_confidence,
    "detect_hostname": _hits("hostname"),
    "detect_upn": _hits("upn"),
    "detect_guid": _hits("guid"),
    "detect_sid": _hits("sid"),
    "detect_identity": _hits("identity"),
    "detect_mac": _hits("mac"),
    "detect_unc": _hits("unc"),
    "detect_network": _hits("network"),
    "detect_all_raw": detect_all_raw,
    "detect_documents": detect_documents,
    "detect_pages": detect_pages,
    "detect_conversations": detect_conversations,
    "finding_violations": finding_violations,
    "hostname_not_in_upn": _hits("hostname", hosts_in_upn=False),
    "scan_doc_distinct": scan_doc_distinct,
    "scan_corpus": _scanned,
    "scan_docs_with_hits": scan_docs_with_hits,
    "scan_unique": scan_unique,
    "scan_report": lambda spark, sf: findings.report(scan_unique(spark, sf)),
    "scan_type_counts": lambda spark, sf: findings.type_counts(scan_unique(spark, sf)),
    "scan_approved": scan_approved,
    "map_violations": map_violations,
    "map_merge": map_merge,
    "map_upsert": map_upsert,
    "map_add_manual": map_add_manual,
    "map_show": map_show,
    "map_projection": map_projection,
    "map_invert": map_invert,
    "map_csv_roundtrip": map_csv_roundtrip,
    "map_load_last_wins": map_load_last_wins,
    "generate_map": _fakes("ipv4", "cidr", "hostname", "upn", "guid", "sid", "mac", "unc"),
    "generate_unseen": generate_unseen,
    "fake_ipv4": _fakes("ipv4"),
    "fake_ipv4_free": _fakes("ipv4", preserve_format=False),
    "fake_cidr": _fakes("cidr"),
    "fake_hostname": _fakes("hostname", suffix="keep"),
    "fake_upn": _fakes("upn"),
    "fake_guid": _fakes("guid"),
    "fake_sid": _fakes("sid"),
    "fake_mac": _fakes("mac"),
    "fake_unc": _fakes("unc"),
    "generate_quarantine": generate_quarantine,
    "fake_uniqueness": fake_uniqueness,
    "map_growth": map_growth,
    "mapped_occurrences": mapped_occurrences,
    "longest_match": longest_match,
    "overlap_resolution": overlap_resolution,
    "anonymize_lines": anonymize_lines,
    "anonymize_join": anonymize_join,
    "reveal_lines": reveal_lines,
    "reveal_full": reveal_full,
    "roundtrip_audit": roundtrip_audit,
    "residual_leaks": residual_leaks,
    "map_ambiguous_fakes": map_ambiguous_fakes,
    "map_fake_collisions": map_fake_collisions,
    "corpus_ext_filter": corpus_ext_filter,
    "corpus_table": corpus_table,
    "corpus_status": corpus_status,
    "corpus_relative_path": corpus_relative_path,
    "anonymize_corpus": anonymize_corpus,
    "reveal_corpus": reveal_corpus,
    "run_report": run_report,
    "stream_anonymize": stream_anonymize,
    "stream_new_identifiers": stream_new_identifiers,
    "stream_map_growth": stream_map_growth,
    "stream_grow_and_anonymize": stream_grow_and_anonymize,
    "stream_type_window": stream_type_window,
    "stream_closed_windows": stream_closed_windows,
}
