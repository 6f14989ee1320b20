"""Injected providers: embedding, reranking, language models, loaders. Local ones are real; hosted ones are adapters that need
a client object, so nothing here opens a connection by itself."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import vectors as V


@runtime_checkable
class EmbeddingProvider(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


@runtime_checkable
class RerankerProvider(Protocol):
    def rerank(self, query: str, texts: Sequence[str]) -> list[float]: ...


@runtime_checkable
class LLMProvider(Protocol):
    name: str
    location: str

    def complete(self, prompt: str, system: str | None = None) -> str: ...


@runtime_checkable
class StructuredLLMProvider(LLMProvider, Protocol):
    def complete_json(self, prompt: str, schema: dict | None = None, system: str | None = None) -> str | None: ...


@runtime_checkable
class Loader(Protocol):
    def can_load(self, path: str) -> bool: ...

    def load(self, path: str, content: bytes) -> list[dict]: ...


class NoModel:
    """Stands where no language model may be used; using it is an error."""

    name, location = "none", "none"

    def complete(self, prompt: str, system: str | None = None) -> str:
        raise RuntimeError("no language model is configured for this run")


class HashingEmbed:
    name, location = "hashing", "local"

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            counts = V.hashed_counts(t).astype(float)
            size = np.sqrt((counts * counts).sum())
            out.append((counts / size if size else counts).tolist())
        return out


@dataclass
class LexicalReranker:
    """BM25 over the given texts alone, divided by the highest score; ranking.bm25 is the same over a DataFrame."""

    k1: float = 1.5
    b: float = 0.75
    name: str = "bm25"
    location: str = "local"

    def rerank(self, query: str, texts: Sequence[str]) -> list[float]:
        terms = sorted(set(V.TOKEN.findall(query.lower())))
        toks = [V.TOKEN.findall(t.lower()) for t in texts]
        counts = np.array([[t.count(w) for w in terms] for t in toks], float).reshape(len(texts), len(terms))
        length = np.array([len(t) for t in toks], float)
        mean = length.mean() if len(length) and length.mean() else 1.0
        df = (counts > 0).sum(axis=0)
        idf = np.log(1 + (len(texts) - df + 0.5) / (df + 0.5))
        scale = self.k1 * (1 - self.b + self.b * np.maximum(length, 1) / mean)
        raw = (idf * counts * (self.k1 + 1) / (counts + scale[:, None])).sum(axis=1) if terms else np.zeros(len(texts))
        return (raw / raw.max()).tolist() if len(raw) and raw.max() > 0 else [0.0] * len(texts)


@dataclass
class ScriptedModel:
    """A deterministic stand-in: answer(prompt) -> text, and optionally json_answer(prompt) -> text or None."""

    answer: Callable[[str], str]
    name: str = "scripted"
    location: str = "local"

    def complete(self, prompt: str, system: str | None = None) -> str:
        return self.answer(prompt)


@dataclass
class StructuredScriptedModel(ScriptedModel):
    json_answer: Callable[[str], dict | None] = lambda prompt: None

    def complete_json(self, prompt: str, schema: dict | None = None, system: str | None = None) -> str | None:
        found = self.json_answer(prompt)
        return None if found is None else json.dumps(found, ensure_ascii=False)


def batches(texts: Sequence[str], max_items: int, max_chars: int) -> Iterator[list[str]]:
    """Consecutive groups under both budgets; a text over the budget stands alone."""
    group: list[str] = []
    size = 0
    for t in texts:
        if group and (len(group) == max_items or size + len(t) > max_chars):
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def truncated(texts: Sequence[str], max_chars: int) -> tuple[list[str], int]:
    """Texts of at most max_chars characters (0: any), and how many were shortened."""
    if max_chars <= 0:
        return list(texts), 0
    return [t[:max_chars] for t in texts], sum(len(t) > max_chars for t in texts)


@dataclass
class RemoteEmbed:
    """An embedding service behind `call(list of texts) -> list of vectors`: truncation, batches, retries, and zero vectors
    of the last known size for what stays unanswered."""

    call: Callable[[list[str]], list[list[float]]]
    name: str = "remote"
    location: str = "remote"
    max_items: int = 128
    max_chars: int = 100_000
    clip: int = 8000
    retries: int = 6
    wait: float = 0.5
    dimensions: int = 0
    counters: dict[str, int] = field(default_factory=lambda: {"calls": 0, "retries": 0, "truncated": 0, "failed": 0})

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        clipped, n = truncated(texts, self.clip)
        self.counters["truncated"] += n
        out: list[list[float]] = []
        for group in batches(clipped, self.max_items, self.max_chars):
            found = self._try(group)
            if found:
                self.dimensions = len(found[0])
            out += found or [[0.0] * self.dimensions for _ in group]
        return out

    def _try(self, group: list[str]) -> list[list[float]]:
        for attempt in range(self.retries + 1):
            try:
                self.counters["calls"] += 1
                return self.call(group)
            except (OSError, TimeoutError, ValueError):
                self.counters["retries"] += attempt < self.retries
                if attempt < self.retries:
                    time.sleep(self.wait * 2**attempt)
        self.counters["failed"] += 1
        return []


@dataclass
class RemoteReranker:
    """A reranking service behind `call(query, texts) -> scores`. A set is never split, and a failure is an error."""

    call: Callable[[str, list[str]], list[float]]
    name: str = "remote"
    location: str = "remote"
    clip: int = 8000

    def rerank(self, query: str, texts: Sequence[str]) -> list[float]:
        scores = self.call(query, truncated(texts, self.clip)[0])
        if len(scores) != len(texts):
            raise ValueError("a score for each text is needed")
        return list(scores)


@dataclass
class RemoteModel:
    """A language model behind `call(prompt, system) -> (text, usage)`; usage rows go to `log` if there is one."""

    call: Callable[[str, str | None], tuple[str, dict]]
    name: str = "remote"
    location: str = "remote"
    log: Callable[[dict], None] | None = None

    def complete(self, prompt: str, system: str | None = None) -> str:
        text, usage = self.call(prompt, system)
        if self.log:
            self.log({"model": self.name, **usage})
        return text


@dataclass(frozen=True)
class Providers:
    embed: Any = field(default_factory=HashingEmbed)
    reranker: Any = field(default_factory=LexicalReranker)
    llm: Any = field(default_factory=NoModel)
    no_llm: bool = True
    scope_filter_llm: bool = False
    #: text -> language code or None; only the audit hears of it
    detect_language: Callable[[str], str | None] | None = None


def resolve(profile: str = "local", *, no_llm: bool = True, **parts: Any) -> Providers:
    """The provider set of a profile. `local` needs nothing; `remote` takes its parts as adapters."""
    if profile not in ("local", "remote"):
        raise ValueError(f"unknown profile {profile!r}")
    if profile == "remote" and not parts:
        raise ValueError("the remote profile needs adapters: embed, reranker or llm")
    if not no_llm and "llm" not in parts:
        raise ValueError("a run with a language model needs llm=...")
    return Providers(no_llm=no_llm, **parts)


class Counters:
    """What providers count in the workers, summed on the driver. A task that is run again counts again: it called again."""

    NAMES = ("calls", "retries", "truncated", "failed")

    def __init__(self, spark):
        self.sums = {n: spark.sparkContext.accumulator(0) for n in self.NAMES}

    def counted(self, provider) -> Callable[[Sequence[str]], list[list[float]]]:
        """provider.embed, with what it adds to its own counters added here."""
        sums = self.sums

        def embed(texts: Sequence[str]) -> list[list[float]]:
            own = getattr(provider, "counters", None)
            before = dict(own or {})
            out = provider.embed(texts)
            for n in sums if own else ():
                sums[n].add(own.get(n, 0) - before.get(n, 0))
            return out

        return embed

    def report(self, audit, provider) -> None:
        values = {n: a.value for n, a in self.sums.items()}
        if any(values.values()):
            audit.event("cloud", "transport", inputs=values, model=getattr(provider, "name", "?"), location=getattr(provider, "location", "?"))


def embedding_column(provider: EmbeddingProvider, counters: Counters | None = None):
    """A column function text -> array<double> that calls the provider a batch at a time, in order."""
    if isinstance(provider, HashingEmbed):
        return V.hashing_embed

    call = counters.counted(provider) if counters else provider.embed

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(call([t or "" for t in texts]), index=texts.index)

    return embed


def similarity_column(provider: EmbeddingProvider, query: str, counters: Counters | None = None):
    """A column function text -> cosine with the query's vector."""
    if isinstance(provider, HashingEmbed):
        return V.hashing_similarity(query)
    wanted = np.array(provider.embed([query])[0], float)
    call = counters.counted(provider) if counters else provider.embed

    @F.pandas_udf(T.DoubleType())
    def similarity(texts: pd.Series) -> pd.Series:
        x = np.array(call([t or "" for t in texts]), float)
        scale = np.linalg.norm(x, axis=1) * np.linalg.norm(wanted)
        return pd.Series(np.where(scale > 0, x @ wanted / np.where(scale > 0, scale, 1), 0.0), index=texts.index)

    return similarity
