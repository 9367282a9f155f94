"""Telemetry roll-up and conformance metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def telemetry_rollup(calls: DataFrame) -> DataFrame:
    """Latency, fallback, refusal, citation and token figures per provider.

    ``calls``: provider, latency_ms, finish_reason, fallback, malformed, citations_emitted,
    citations_verified, prompt_tokens, completion_tokens.
    """
    return calls.groupBy("provider").agg(
        F.count("*").alias("sample_count"),
        F.floor(F.sum("latency_ms") / F.count("latency_ms")).cast("long").alias("avg_latency_ms"),
        F.min("latency_ms").alias("min_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
        F.count_if("fallback").alias("fallback_count"),
        F.count_if(F.col("finish_reason") == "refusal").alias("refusal_count"),
        F.count_if("malformed").alias("malformed_count"),
        F.sum("citations_emitted").alias("citations_emitted"),
        F.sum("citations_verified").alias("citations_verified"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
    )


def conformance(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Counted gates of understanding against expectation, as (metric, passed, total).

    Both sides carry the target columns; ``expected`` also ``is_safety`` and ``checks_intent``.
    """
    e, a = expected.alias("e"), actual.alias("a")
    rows = e.join(a, F.col(f"e.{key}") == F.col(f"a.{key}"))

    def same(name: str) -> Column:
        return F.col(f"e.{name}").eqNullSafe(F.col(f"a.{name}"))

    def same_set(name: str) -> Column:
        return F.sort_array(f"e.{name}") == F.sort_array(f"a.{name}")

    parsed = ~F.col("e.is_safety")
    asks = F.col("e.clarification_required")
    asked = F.col("a.clarification_required")
    unroutable = F.col("e.routing_mode") == "UNROUTABLE"
    closed = (F.col("a.routing_mode") == "UNROUTABLE") & ~asked
    invalid_date = parsed & unroutable & (F.col("e.temporal_scope") == "interval")
    dates = same("temporal_scope") & same("anchor_year") & same("start_date") & same("end_date")
    fields = (
        same("routing_mode") & same_set("structured_domains") & same_set("document_domains") & same("target_entity")
        & same_set("requested_attributes") & dates & same("clarification_required")
        & (~F.col("e.checks_intent") | (same("superlative") & same("question_intent")))
    )
    valid_date = parsed & ~unroutable & (F.col("e.temporal_scope") == "interval")
    extreme = parsed & F.col("e.superlative").isNotNull()
    compare = parsed & (F.col("e.question_intent") == "COMPARISON")
    timeline = parsed & F.array_contains("e.structured_domains", "timeline")
    routable = parsed & ~asks & ~unroutable
    gates = {
        "routing_conformance": (F.when(invalid_date, closed).otherwise(fields), parsed),
        "false_unroutable": (F.col("a.routing_mode") == "UNROUTABLE", routable),
        "clarification_recall": (asked, parsed & asks),
        "clarification_precision": (asks, parsed & asked),
        "false_clarification": (asked, parsed & ~asks),
        "temporal_valid": (dates, valid_date),
        "temporal_invalid": (closed, invalid_date),
        "superlative": (same("superlative"), extreme),
        "comparison": (F.col("a.question_intent") == "COMPARISON", compare),
        "timeline_routing": (F.array_contains("a.structured_domains", "timeline"), timeline),
    }
    counts = rows.agg(
        *[F.count_if(t & p).alias(f"{name}_passed") for name, (p, t) in gates.items()],
        *[F.count_if(t).alias(f"{name}_total") for name, (_, t) in gates.items()],
    )
    parts = ", ".join(f"'{n}', {n}_passed, {n}_total" for n in gates)
    return counts.selectExpr(f"stack({len(gates)}, {parts}) AS (metric, passed, total)")
