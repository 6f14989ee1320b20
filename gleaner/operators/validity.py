"""Extraction health and the validity gate. Nothing is dropped: a refusal is a decision with a reason."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import schema as S
from gleaner.functions import text as X

MIN_CHARS, REDACTION_SHARE = 50, 0.10
CORRUPT, EMPTY = "validity:corrupt-pdf", "validity:empty-after-ocr"
REDACTION_KEPT = "gelakt maar behouden"


def with_health(docs: DataFrame) -> DataFrame:
    """char_count, parse_ok (if absent) and redaction_ratio of 4 decimals."""
    body = F.coalesce("text", F.lit(""))
    ok = F.coalesce("parse_ok", F.lit(True)) if "parse_ok" in docs.columns else F.lit(True)
    return docs.withColumns({"char_count": F.length(body), "parse_ok": ok, "redaction_ratio": F.round(X.redaction_ratio(body), 4)})


def validity_gate(docs: DataFrame, *, min_chars: int = MIN_CHARS, redaction_share: float = REDACTION_SHARE) -> DataFrame:
    """Corrupt files and short texts become out of scope; a short text that is redacted enough stays, with a note.

    Missing health columns count as usable. A document that was decided before keeps its decision.
    """
    count, ok, ratio = F.col("char_count"), F.coalesce("parse_ok", F.lit(True)), F.coalesce("redaction_ratio", F.lit(0.0))
    short = count.isNotNull() & (count < min_chars)
    redacted = ratio >= redaction_share
    reason = F.when(~ok, CORRUPT).when(short & ~redacted, EMPTY)
    open_ = F.coalesce("decision", F.lit(S.UNDECIDED)) != S.OUT_OF_SCOPE
    hit = open_ & reason.isNotNull()
    return docs.withColumns(
        {
            "decision": F.when(hit, S.OUT_OF_SCOPE).otherwise(F.coalesce("decision", F.lit(S.UNDECIDED))),
            "decision_reason": F.when(hit, reason).otherwise(F.col("decision_reason")),
            "redaction_note": F.when(ok & short & redacted, REDACTION_KEPT).otherwise(F.col("redaction_note")),
        }
    )


def language_signal(docs: DataFrame, detect) -> DataFrame:
    """id, language of the undecided documents with text, by detect(text) -> code or None. It informs, and excludes nothing;
    a detector's error is no language."""

    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str | None:
            try:
                return detect(text)
            except Exception:  # noqa: BLE001 - a detector that is unsure of a text may raise anything
                return None

        return texts.map(one)

    open_ = docs.filter((F.coalesce("decision", F.lit(S.UNDECIDED)) != S.OUT_OF_SCOPE) & (X.strip(F.coalesce("text", F.lit(""))) != ""))
    return open_.select("id", found("text").alias("language")).filter("language is not null")


def decision_counts(docs: DataFrame) -> DataFrame:
    return docs.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("decision") == S.SELECTED).alias("selected"),
        F.count_if(F.col("decision") == S.OUT_OF_SCOPE).alias("out_of_scope"),
        F.count_if(F.col("decision") == S.UNDECIDED).alias("undecided"),
        F.count_if((F.col("decision") == S.OUT_OF_SCOPE) & F.col("decision_reason").startswith("validity:")).alias("validity_excluded"),
    )


def excluded_by_reason(docs: DataFrame) -> DataFrame:
    gone = docs.filter(F.col("decision") == S.OUT_OF_SCOPE)
    return gone.groupBy(X.excluded_kind(F.col("decision_reason")).alias("kind"), F.col("decision_reason").alias("reason")).agg(F.count("*").alias("n"))
