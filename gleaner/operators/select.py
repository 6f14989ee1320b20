"""Cutoffs on `final`. A cutoff is a score, so ties at it are all in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner import schema as S

INFINITE = float("inf")


@dataclass(frozen=True)
class Knee:
    """Where a target cutoff fell: after the index-th document, over a drop of `gap`."""

    index: int
    gap: float
    last_selected: float
    first_dropped: float


def top_n_cutoff(ranked: DataFrame, n: int) -> float:
    """The score of the n-th document (of the last if there are fewer); nothing qualifies for n <= 0 or no documents."""
    if n <= 0:
        return INFINITE
    rows = ranked.select("final").orderBy(F.desc("final")).limit(n).agg(F.min("final")).first()
    return INFINITE if rows[0] is None else rows[0]


def target_cutoff(ranked: DataFrame, target: int) -> tuple[float, Knee | None]:
    """The largest gap between neighbours within a window around the target; the first one of equals.

    Only the scores up to the window's end are ordered: a bounded top-k, whatever the corpus holds.
    """
    n = ranked.count()
    if not n:
        return INFINITE, None
    if n <= target:
        return ranked.agg(F.min("final")).first()[0], None
    width = max(5, target // 4)
    lo, hi = max(1, target - width), min(n - 1, target + width)
    top = [r.final for r in ranked.select("final").orderBy(F.desc("final")).limit(hi + 1).collect()]  # target + window scores
    index = max(range(lo, hi + 1), key=lambda i: (top[i - 1] - top[i], -i))
    return top[index - 1], Knee(index, top[index - 1] - top[index], top[index - 1], top[index])


def apply_cutoff(ranked: DataFrame, cutoff: float, *, recall_bias: float = 0.0, mode: str = "") -> DataFrame:
    """decision and decision_reason of every ranked document: at or over the cutoff, or less than the bias below it."""
    near = (F.col("final") < cutoff) & (F.col("final") >= cutoff - recall_bias) if recall_bias > 0 else F.lit(False)
    base = f"final boven cutoff ({mode})" if mode else "final boven cutoff"
    return ranked.withColumns(
        {
            "decision": F.when((F.col("final") >= cutoff) | near, S.SELECTED).otherwise(S.OUT_OF_SCOPE),
            "decision_reason": F.when(F.col("final") >= cutoff, base).when(near, f"{base}; recall-bias").otherwise("final onder cutoff"),
        }
    )


def cutoff_of(ranked: DataFrame, mode: str, value: float) -> tuple[float, Knee | None]:
    if mode == "threshold":
        return float(value), None
    if mode == "top_n":
        return top_n_cutoff(ranked, int(value)), None
    if mode == "target":
        return target_cutoff(ranked, int(value))
    raise ValueError(f"unknown cutoff mode {mode!r}")


def first_pass(ranked: DataFrame, n: int) -> DataFrame:
    """rank, id, final of the first n by (final desc, id)."""
    top = ranked.select("id", "final").orderBy(F.desc("final"), "id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("final"), "id")))
