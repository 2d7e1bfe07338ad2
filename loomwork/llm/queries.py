"""The corpus operators' queries and DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import (
    centroids, decontaminate, dialogue, disclosure, fixity, html_content, licences, minmax, mixing, ordinal, rules, sharding, tokens)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_fixity": fixity.op1_warc_fixity,
        "op2_ordinal_quality": ordinal.op2_ordinal_quality,
        "op3_html_extract": html_content.op3_html_extract,
        "op4_minmax_dedup": minmax.op4_minmax_dedup,
        "op5_risk_rules": rules.op5_risk_rules,
        "op6_pii_disclosure": disclosure.op6_pii_disclosure,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_mix_sources": mixing.op8_mix_sources,
        "op9_shard_interleave": sharding.op9_shard_interleave,
        "op10_token_counts": tokens.op10_token_counts,
        "op11_licence_scan": licences.op11_licence_scan,
        "op12_conversation_repair": dialogue.op12_conversation_repair,
        "op13_centroid_clusters": centroids.op13_centroid_clusters,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_fixity": fixity.ORACLE,
        "op4_minmax_dedup": minmax.ORACLE,
        "op7_decontaminate": decontaminate.ORACLE,
        "op8_mix_sources": mixing.ORACLE,
        "op9_shard_interleave": sharding.ORACLE,
        "op11_licence_scan": licences.ORACLE,
        "op12_conversation_repair": dialogue.ORACLE,
        "op13_centroid_clusters": centroids.ORACLE,
    }
