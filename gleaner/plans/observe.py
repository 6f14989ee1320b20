"""A reader's view of the audit trail: what came in, what went out and why, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_actions(audit: DataFrame) -> DataFrame:
    """stage, action, n, first (sequence of the first event), sample (one event's inputs)."""
    rows = audit.groupBy("stage", "action").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.min_by("inputs", "seq").alias("sample"))
    return rows.orderBy("first", "stage", "action")


def reason_histogram(docs: DataFrame, n: int = 4) -> DataFrame:
    """The n most frequent reasons of exclusion."""
    gone = docs.filter("decision = 'out_of_scope'")
    return gone.groupBy(F.col("decision_reason").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(n)


def panels(audit: DataFrame) -> str:
    lines, stage = [], None
    for r in stage_actions(audit).collect():  # a few dozen kinds of events
        if r.stage != stage:
            stage = r.stage
            lines.append(f"== {stage} ==")
        lines.append(f"  {r.action}: {r.n}" + (f"  {r.sample[:120]}" if r.sample else ""))
    return "\n".join(lines)
