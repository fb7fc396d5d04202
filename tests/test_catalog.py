"""Registered queries: names, and results beside the SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from catalog.registry import ORACLES, QUERIES
from check_queries import compare

FOLDER = "/root/testdata/sf0.001"

# The operators of the inventory that a user calls, by name.
INVENTORY = """
read_texts read_captures file_inventory parse_capture_key write_texts load_vector_index append_vectors read_id_map
read_logs read_states read_proc_samples export_snapshot import_snapshot with_window exclude_titles gate_paused non_blank
valid_utf8 retention_cutoff retention_whole_days engine_processes log_contains_all of_type backend_toggle pending_docs
hits_to_content orphan_vectors asof_state frames_without_text changed_docs postings_match corpus_stats dir_sizes
vector_index_stats keyword_index_stats resource_totals cycle_report cycle_history archive_health archive_status
term_statistics drop_unchanged first_per_key state_transitions pause_intervals throttle assign_ids pack_batches
capped_pending knn recent_captures log_tail last_successful_run latest_record sample_for_dry_run except_paths hybrid_union
files_of_areas fmt_mib fmt_kib fmt_thousands fmt_time next_quarter_hour next_slot backlog_band basename split_list
before_first_comma title_of progress_pct fmt_instant clamp0 build_keyword_index update_keyword_index keyword_match
keyword_search embed_texts knn_join knn_approx refine_queries semantic_search hybrid_search extract_text capture_stream
index_stream mixed_cycles drop_unchanged_stream gate_stream throttle_stream time_budget durable_batches force_cycle apply_retention
reset_vector_index reconcile_index retain_then_reset delete_latest clear_index full_rebuild dry_run
""".split()

# Many small jobs each; check_queries.py runs every query at any scale.
SLOW = {
    "reembed_changed", "update_ranked_index", "hybrid_search_scan", "refine_queries_scan", "capture_stream", "frame_streams", "index_captured_texts", "drop_unchanged_stream", "gate_stream", "throttle_stream", "index_stream", "mixed_cycles", "append_vectors",
    "cycle_report", "durable_batches", "time_budget", "force_cycle", "keyword_match", "hybrid_search", "refine_queries",
    "build_keyword_index", "update_keyword_index", "dry_run", "apply_retention", "retain_then_reset", "full_rebuild",
    "clear_index", "import_snapshot", "export_snapshot", "reconcile_index", "throttle", "backend_toggle",
}


def test_inventory_is_registered():
    assert set(INVENTORY) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are absent")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query_equals_sql(spark, name):
    assert compare(spark, FOLDER, name).startswith("ok")
