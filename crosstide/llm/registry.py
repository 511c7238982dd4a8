"""Queries of this package and, where SQL can say it, the SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, fingerprint, html_text, language_id, near_dups, packing, pii, substring_dedup, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_decontaminate": decontaminate.query,
        "op2_html_text": html_text.query,
        "op3_pii": pii.query,
        "op4_language_id": language_id.query,
        "op5_near_dups": near_dups.query,
        "op6_packing": packing.query,
        "op7_fingerprint": fingerprint.query,
        "op8_chat_format": chat_format.query,
        "op9_substring_dedup": substring_dedup.query,
        "op10_url_filter": url_filter.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.SQL, "op8_chat_format": chat_format.SQL, "op10_url_filter": url_filter.SQL}
