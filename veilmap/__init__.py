"""Discovery and reversible replacement of infrastructure identifiers on Spark."""

from veilmap.operators.audit import (
    ambiguous_fakes, fake_collisions, residual_leaks, roundtrip, roundtrip_report,
)
from veilmap.operators.detect import detect, detect_all, finding_violations
from veilmap.operators.findings import (
    approve, documents_with_findings, report, scan, type_counts, unique_identifiers,
)
from veilmap.operators.generate import generate_map
from veilmap.operators.maps import (
    add_mapping, invert, mapping, merge_maps, show_map, upsert_entries, validate_map,
)
from veilmap.operators.replace import anonymize, find_mapped, reveal
from veilmap.operators.unseen import generate_unseen, names_like_fakes
from veilmap.plans.pipelines import anonymize_tree, grow_map, reveal_tree, scan_tree
from veilmap.sources.corpus import (
    corpus_from_table, export_tree, failed_paths, read_corpus, run_report, write_corpus,
)
from veilmap.sources.mapfile import read_map, rejected_rows, write_map

__all__ = [name for name in dir() if not name.startswith("_")]
