"""Queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from corpusloom.llm import encoding, languages, leakage, near_duplicates, scans, sentences, splitting, tokens
from corpusloom.llm.sql import ORACLE


def queries() -> dict:
    return {
        "p1_found": splitting.p1_found,
        "p1_pieces": splitting.p1_pieces,
        "p4_found": scans.p4_found,
        "p4_paragraphs": scans.p4_paragraphs,
        "p5_found": encoding.p5_found,
        "p5_restored": encoding.p5_restored,
        "p6_found": languages.p6_found,
        "p6_segments": languages.p6_segments,
        "p7_found": near_duplicates.p7_found,
        "p7_groups": near_duplicates.p7_groups,
        "p8_ids": tokens.p8_ids,
        "p9_found": leakage.p9_found,
        "p10_found": sentences.p10_found,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
