"""Column contracts of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, D, B, I = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType()  # noqa: E741

HEADER_COLUMNS = ("message_id", "in_reply_to", "references", "from_", "to_", "cc", "subject", "date")
#: mail header of each column
HEADERS = dict(zip(HEADER_COLUMNS, ("Message-ID", "In-Reply-To", "References", "From", "To", "Cc", "Subject", "Date"), strict=True))

DOCUMENT_FIELDS = (
    [("id", S), ("source_path", S), ("doc_type", S), ("text", S)]
    + [(c, S) for c in HEADER_COLUMNS]
    + [("filename", S), ("content_type", S), ("attachment_of", S), ("char_count", I), ("parse_ok", B), ("redaction_ratio", D)]
    + [("parse_error", S), ("ocr", S), ("redaction_note", S), ("thread_id", S), ("thread_size", L), ("thread_tip", B)]
    + [("thread_tip_id", S), ("embed_sim", D), ("final", D), ("bm25", D), ("rerank", D), ("llm_relevance", D)]
    + [("decision", S), ("decision_reason", S), ("rationale", S), ("best_passage", S), ("topic", S), ("subtopic", S), ("summary", S)]
)
DOCUMENTS = T.StructType([T.StructField(n, t) for n, t in DOCUMENT_FIELDS])
RELATIONS = T.StructType([T.StructField(n, S) for n in ("source", "kind", "target", "evidence")] + [T.StructField("seq", L)])
AUDIT = T.StructType(
    [T.StructField("ts", S), T.StructField("stage", S), T.StructField("action", S), T.StructField("document_ids", T.ArrayType(S))]
    + [T.StructField(n, S) for n in ("inputs", "model", "location", "prompt")]
    + [T.StructField("seq", L)]
)

THREAD_PARENT, ATTACHMENT_OF, DUPLICATE_OF, OVERLAPS_WITH = "thread-parent", "attachment-of", "duplicate-of", "overlaps-with"
UNDECIDED, SELECTED, OUT_OF_SCOPE = "undecided", "selected", "out_of_scope"


def conform(df: DataFrame) -> DataFrame:
    """df with every document column, missing ones null (decision: undecided), in order; other columns are dropped."""
    have = set(df.columns)
    columns = []
    for name, kind in DOCUMENT_FIELDS:
        if name in have:
            columns.append(F.col(f"`{name}`").cast(kind).alias(name))
        else:
            columns.append(F.lit(UNDECIDED if name == "decision" else None).cast(kind).alias(name))
    return df.select(*columns)
