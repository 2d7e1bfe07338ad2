"""Outcomes of model calls by HTTP status, headers and JSON body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: how providers word their limits.
DAY = r"(?i)insufficient_quota|per day|\btpd\b|\brpd\b|daily|credits? (are )?exhausted"
MINUTE = r"(?i)per minute|\btpm\b|\brpm\b"
TOO_LONG = r"(?i)context|too many tokens|token count|maximum.*length|too long"


def classify_http(kind: Column, status: Column, body: Column, finish_reason: Column) -> Column:
    """ok, truncated, safety_blocked, rate_limited_*, auth_error, context_exceeded, bad_request, timeout or server_error."""
    part = lambda p: F.coalesce(F.get_json_object(body, p), F.lit(""))
    message = F.concat_ws(" ", part("$.error.message"), part("$.error.code"), part("$.error.status"))
    quota = part("$.error.details[*].violations[*].quotaId")
    native = kind == "gemini_native"
    return (
        F.when((status == 200) & finish_reason.isin("length", "MAX_TOKENS"), "truncated")
        .when((status == 200) & finish_reason.isin("content_filter", "SAFETY", "PROHIBITED_CONTENT", "BLOCKLIST"), "safety_blocked")
        .when(status == 200, "ok")
        .when((status == 429) & native & quota.contains("PerDay"), "rate_limited_day")
        .when((status == 429) & native & quota.contains("PerMinute"), "rate_limited_minute")
        .when((status == 429) & message.rlike(DAY), "rate_limited_day")
        .when((status == 429) & message.rlike(MINUTE), "rate_limited_minute")
        .when(status == 429, "rate_limited_unknown")
        .when(status.isin(401, 403), "auth_error")
        .when((status == 413) | (status == 400) & message.rlike(TOO_LONG), "context_exceeded")
        .when(status.isin(400, 404, 422), "bad_request")
        .when(status.isin(408, 504), "timeout")
        .when(status >= 500, "server_error")
        .otherwise("bad_request"))


def retry_after(kind: Column, header: Column, body: Column) -> Column:
    """Seconds to wait as the body or else the header names them, if at all."""
    delay = F.regexp_extract(F.coalesce(F.get_json_object(body, "$.error.details[0].retryDelay"), F.lit("")), r"^([0-9.]+)s$", 1).try_cast("double")
    return F.coalesce(F.when((kind == "gemini_native") & (delay > 0), delay), header.try_cast("double"))
