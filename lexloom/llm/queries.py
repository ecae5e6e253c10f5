"""Queries of the training-data operators; the SQL of those that SQL can express on whole tables is in oracles."""

from __future__ import annotations

from lexloom.llm import bpe, format_duplicates, grouped_splits, leaks, lookalikes, near_duplicates, split_overlap, term_counts, truncation
from lexloom.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "p1_found": term_counts.p1_found,
    "p1_terms": term_counts.p1_terms,
    "p2_found": format_duplicates.p2_found,
    "p2_entries": format_duplicates.p2_entries,
    "p3_found": lookalikes.p3_found,
    "p3_canonical": lookalikes.p3_canonical,
    "p4_found": split_overlap.p4_found,
    "p4_report": split_overlap.p4_report,
    "p5_found": grouped_splits.p5_found,
    "p5_splits": grouped_splits.p5_splits,
    "p6_found": near_duplicates.p6_found,
    "p6_groups": near_duplicates.p6_groups,
    "p7_ids": bpe.p7_ids,
    "p8_found": leaks.p8_found,
    "p8_matches": leaks.p8_matches,
    "p8_clean": leaks.p8_clean,
    "p9_found": truncation.p9_found,
    "p9_report": truncation.p9_report,
}
