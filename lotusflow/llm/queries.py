"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lotusflow.llm import answers, conversations, encoding, lookalikes, neighbours, packing, pii, splitting


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    return {
        "p1_found": neighbours.p1_found,
        "p1_neighbours": neighbours.p1_neighbours,
        "p2_found": splitting.p2_found,
        "p2_pieces": splitting.p2_pieces,
        "p3_found": lookalikes.p3_found,
        "p3_classes": lookalikes.p3_classes,
        "p3_unified": lookalikes.p3_unified,
        "p4_found": conversations.p4_found,
        "p4_messages": conversations.p4_messages,
        "p5_found": answers.p5_found,
        "p6_ids": encoding.p6_ids,
        "p7_bins": packing.p7_bins,
        "p8_found": pii.p8_found,
        "p8_masked": pii.p8_masked,
    }


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    return {
        "p2_found": splitting.P2_FOUND_SQL,
        "p4_found": conversations.P4_FOUND_SQL,
        "p4_messages": conversations.P4_MESSAGES_SQL,
    }
