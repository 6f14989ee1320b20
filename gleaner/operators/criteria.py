"""Relevance criteria of a query: from a model's answer, or the query itself."""

from __future__ import annotations

from dataclasses import dataclass

#: What may stand before a label.
BULLETS = "-*0123456789. "


@dataclass(frozen=True)
class Criterion:
    label: str
    description: str


@dataclass(frozen=True)
class Criteria:
    query: str
    items: tuple[Criterion, ...]
    source: str  # "llm" or "fallback"

    def block(self) -> str:
        return "\n".join([f"Zoekvraag: {self.query}", *(f"- {c.label}: {c.description}" for c in self.items)])

    def to_dict(self) -> dict:
        return {"query": self.query, "items": [{"label": c.label, "description": c.description} for c in self.items], "source": self.source}


def parse_criteria(answer: str) -> list[Criterion]:
    """`label: description` lines; bullets and numbers go, lines without both parts too."""
    out = []
    for line in answer.splitlines():
        label, colon, description = line.strip().lstrip(BULLETS).partition(":")
        if colon and label.strip() and description.strip():
            out.append(Criterion(label.strip(), description.strip()))
    return out


def articulate(query: str, llm=None) -> Criteria:
    items = parse_criteria(llm.complete(f"Zoekvraag: {query}\nGeef 3 tot 6 criteria als 'label: omschrijving', een per regel.")) if llm else []
    if items:
        return Criteria(query, tuple(items[:6]), "llm")
    return Criteria(query, (Criterion("zoekvraag", query),), "fallback")
