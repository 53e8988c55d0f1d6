"""Schemas and settings shared by all operators. Rows carry ``doc_id`` and an explicit order, since order is part of results."""

from __future__ import annotations

from dataclasses import dataclass

PAGES = "doc_id string, page_num int, text string"
REFERENCES = "doc_id string, seq bigint, title string, type string, page_numbers array<int>, source string"
GROUND_TRUTH = "gt_seq bigint, title string, type string, page int"


@dataclass(frozen=True)
class Settings:
    """Thresholds and sizes of the pipeline, as published with it."""

    match_threshold: float = 0.75
    page_batch: int = 3
    shown_references: int = 50
    shown_references_search: int = 200
    dedup_cluster_limit: int = 4
    verify_batch: int = 30
    verify_batch_floor: float = 0.3
    verify_global_floor: float = 0.5
    containment_length: int = 10
    first_page_missing: int = 999
