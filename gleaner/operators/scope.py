"""Scope rules: an ordered list of exclusion rules, the first that applies gives the reason; then an optional model gate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import schema as S
from gleaner.functions import text as X

#: Patterns and reasons of the rules.
FORWARD_SUBJECT = r"(?i)^\s*(fw|fwd|doorst)\s*:"
FORWARD_MARKER = r"(?im)-----\s*Original Message|-+\s*Forwarded message|Begin forwarded message|^\s*Van:\s.+\nAan:"
PROCESS_SENDER = r"(?i)(no-?reply|do-?not-?reply|postmaster|mailer-daemon)"
PROCESS_SUBJECT = (
    r"(?i)(automati(sch|c)|ontvangstbevestiging|out of office|afwezig|read receipt|delivery (status|failure)|niet aanwezig)"
)
INVITE_SUBJECT = r"(?i)^\s*(uitnodiging|invitation)\s*:"
FORWARDED = "alleen doorgestuurd bericht zonder eigen inhoud (regel: forwarded-only)"
INVITE = "agenda-uitnodiging (regel: calendar-invite)"
PROCESS = "procesnotificatie / automatisch bericht (regel: process-notification)"
TAIL = "eerdere mail, vertegenwoordigd door thread-head %s (regel: thread-tail)"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def forwarded_only() -> Column:
    before = F.element_at(F.split(_text("text"), FORWARD_MARKER, 2), 1)
    marked = _text("text").rlike(FORWARD_MARKER)
    return F.when(_text("subject").rlike(FORWARD_SUBJECT) & marked & (F.length(X.strip(before)) < 40), FORWARDED)


def calendar_invite() -> Column:
    kind = _text("content_type").contains("text/calendar")
    return F.when(_text("text").contains("BEGIN:VCALENDAR") | kind | _text("subject").rlike(INVITE_SUBJECT), INVITE)


def process_notification() -> Column:
    return F.when(_text("from_").rlike(PROCESS_SENDER) | _text("subject").rlike(PROCESS_SUBJECT), PROCESS)


def thread_tail() -> Column:
    return F.when((F.coalesce("thread_size", F.lit(1)) > 1) & ~F.coalesce("thread_tip", F.lit(True)), F.format_string(TAIL, F.coalesce("thread_tip_id", F.lit("?"))))


RULES = (forwarded_only, calendar_invite, process_notification, thread_tail)


def scope_filter(docs: DataFrame, rules=RULES) -> DataFrame:
    """One projection; rules hold for mail only. A document that is out of scope already keeps its reason."""
    gone = F.col("decision") == S.OUT_OF_SCOPE
    found = F.when(F.col("doc_type") == "email", F.coalesce(*[rule() for rule in rules]))
    hit = ~gone & found.isNotNull()
    return docs.withColumns(
        {
            "decision": F.when(hit, S.OUT_OF_SCOPE).otherwise(F.col("decision")),
            "decision_reason": F.when(hit, found).otherwise(F.col("decision_reason")),
        }
    )


def model_gate(docs: DataFrame, query: str, llm, store, log=None) -> DataFrame:
    """Asks `llm` about the undecided documents and excludes those it is certain about.

    store(df) materialises the answers, so that each document is asked once however often the result is read; log(answers) gets
    them (id, prompt, verdict).
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            prompts = [gate_prompt(query, k, t or "") for k, t in zip(b["doc_type"], b["text"], strict=True)]
            yield pd.DataFrame({"id": b["id"], "prompt": prompts, "verdict": [llm.complete(p) for p in prompts]})

    asked = docs.filter(F.col("decision") == S.UNDECIDED).select("id", "doc_type", F.substring("text", 1, 1500).alias("text"))
    answers = store(asked.mapInPandas(ask, "id string, prompt string, verdict string"))
    if log:
        log(answers)
    refused = answers.filter(X.is_exclude_verdict(F.col("verdict"))).select("id", F.lit(True).alias("gl_refused"))
    reason = f"LLM-oordeel: met zekerheid buiten scope (UITSLUITEN, model {getattr(llm, 'name', '?')})"
    out = docs.join(refused.dropDuplicates(["id"]), "id", "left")
    hit = F.coalesce("gl_refused", F.lit(False))
    return out.withColumns(
        {
            "decision": F.when(hit, S.OUT_OF_SCOPE).otherwise(F.col("decision")),
            "decision_reason": F.when(hit, reason).otherwise(F.col("decision_reason")),
        }
    ).select(*docs.columns)


def gate_prompt(query: str, doc_type: str, text: str) -> str:
    return f"Vraag: {query}\nSoort: {doc_type}\n---\n{text[:1500]}\n---\nZeker buiten de vraag? Antwoord UITSLUITEN of BEHOUDEN."
