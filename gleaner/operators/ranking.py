"""Ranking: best passage by cosine, BM25, their mix, and the model's side score. Only `final` decides."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import schema as S
from gleaner.functions import text as X
from gleaner.functions import vectors as V

K1, LENGTH_WEIGHT = 1.5, 0.75
RERANK_ROWS = 100_000


def candidates(docs: DataFrame) -> DataFrame:
    return docs.filter((F.coalesce("decision", F.lit(S.UNDECIDED)) != S.OUT_OF_SCOPE) & (F.coalesce("text", F.lit("")) != ""))


def chunk_rows(docs: DataFrame, *, size: int = X.CHUNK_SIZE, cap: int = 0) -> DataFrame:
    """docs (id, text) -> id, chunk_id, ordinal, chunk; at most `cap` evenly spaced chunks of a document if cap > 0."""
    whole = F.transform(X.chunks(F.col("text"), size), lambda c, i: F.struct(i.alias("ordinal"), c.alias("chunk")))
    rows = docs.select("id", F.inline(X.even_sample(whole, cap)))
    return rows.select("id", F.concat_ws(":", "id", F.col("ordinal").cast("string")).alias("chunk_id"), "ordinal", "chunk")


def retrieve(docs: DataFrame, query: str, *, size: int = X.CHUNK_SIZE, similarity=None) -> DataFrame:
    """docs (id, text) -> id, final (max chunk cosine, 6 decimals), best_passage (of the first chunk that reaches the maximum).

    similarity: a column function text -> double; default: the hashing embedding. A document without chunks has 0 and ''.
    """
    score = (similarity or V.hashing_similarity(query))("chunk")
    scored = chunk_rows(docs, size=size).select("id", "ordinal", "chunk", score.alias("sim"))
    best = scored.groupBy("id").agg(F.max("sim").alias("sim"), F.max_by("chunk", F.struct("sim", -F.col("ordinal"))).alias("best_passage"))
    out = docs.select("id").join(best, "id", "left")
    return out.select("id", F.round(F.coalesce("sim", F.lit(0.0)), 6).alias("final"), F.coalesce("best_passage", F.lit("")).alias("best_passage"))


def bm25(docs: DataFrame, query: str, *, k1: float = K1, b: float = LENGTH_WEIGHT) -> DataFrame:
    """docs (id, text) -> id, bm25 in 0..1: scores of the distinct query terms over these documents, divided by the highest.

    Term counts are made inside each row, so no token is shuffled; one row of statistics is what meets.
    """
    terms = sorted(set(V.TOKEN.findall(query.lower())))
    toks = X.tokens(F.coalesce("text", F.lit("")))
    rows = docs.select("id", toks.alias("toks")).select("id", F.size("toks").alias("len"), *[
        F.size(F.filter("toks", _equals(w))).alias(f"t{i}") for i, w in enumerate(terms)
    ])
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(terms))])
    n, mean, *df = stats.first()
    mean = mean or 1.0
    length = F.greatest(F.col("len"), F.lit(1))
    raw = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(F.lit(1 + (n - df[i] + 0.5) / (df[i] + 0.5)))
        raw = raw + idf * F.col(f"t{i}") * (k1 + 1) / (F.col(f"t{i}") + k1 * (1 - b + b * length / mean))
    scored = rows.select("id", raw.alias("raw"))
    top = scored.agg(F.max("raw")).first()[0] or 0.0
    return scored.select("id", F.round(F.col("raw") / top if top > 0 else F.lit(0.0), 6).alias("bm25"))


def _equals(word: str):
    return lambda t: t == word


def hybrid(cosines: DataFrame, scores: DataFrame, alpha: float = 0.0, digits: int = 6) -> DataFrame:
    """id, final = (1 - alpha) cosine + alpha bm25, rounded to `digits` decimals; the default leaves the cosine."""
    mixed = F.round((1 - alpha) * F.col("final") + alpha * F.col("bm25"), digits)
    return cosines.join(scores, "id").select("id", mixed.alias("final"))


def rerank(docs: DataFrame, query: str, reranker=None, *, most: int = RERANK_ROWS) -> DataFrame:
    """docs with `rerank`, a side score: all stay and `final` is untouched.

    Without a reranker, BM25 as joins. A reranker's scores hang on the whole set, which so goes to one task in order of ids;
    its rows are counted first, and more than `most` are an error before any call is paid for.
    """
    plain = docs.drop("rerank")
    if reranker is None:
        return plain.join(bm25(docs, query).select("id", F.col("bm25").alias("rerank")), "id", "left")
    if docs.limit(most + 1).count() > most:
        raise ValueError(f"a reranker takes one set of at most {most} documents")

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        scores = reranker.rerank(query, [t or "" for t in pdf["text"]])
        return pd.DataFrame({"id": pdf["id"].to_numpy(), "rerank": [round(float(s), 6) for s in scores]})

    clip = getattr(reranker, "clip", 0)
    text = F.substring("text", 1, clip) if clip else F.col("text")
    made = docs.select("id", text.alias("text")).groupBy().applyInPandas(score, "id string, rerank double")
    return plain.join(made, "id", "left")


def top_by_final(docs: DataFrame, k: int) -> DataFrame:
    """The first k documents by (final desc, id); 0 or less: all."""
    return docs.orderBy(F.desc("final"), "id").limit(k) if k > 0 else docs


def model_score(docs: DataFrame, criteria_block: str, llm, store, *, top_k: int = 0, log=None) -> DataFrame:
    """id, llm_relevance, rationale of the top documents; answers are stored once, so a re-read never asks again.

    JSON answers are read first, free-form ones next; an answer without a score counts 0. log(answers) gets id, prompt, answer.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        structured = hasattr(llm, "complete_json")
        for b in batches:
            rows = []
            for i, t in zip(b["id"], b["text"], strict=True):
                prompt = f"{criteria_block}\n---\n{(t or '')[:1500]}\n---\nSCORE (0-100) en MOTIVATIE"
                answer = llm.complete_json(prompt) if structured else None
                rows.append((i, prompt, answer if answer is not None else llm.complete(prompt)))
            yield pd.DataFrame(rows, columns=["id", "prompt", "answer"])

    asked = top_by_final(docs, top_k).select("id", F.substring("text", 1, 1500).alias("text"))
    answers = store(asked.mapInPandas(ask, "id string, prompt string, answer string"))
    if log:
        log(answers)
    return parse_answers(answers)


def parse_answers(answers: DataFrame) -> DataFrame:
    parsed = F.coalesce(X.parse_score_json(F.col("answer")), X.parse_score(F.col("answer")))
    return answers.select("id", parsed.alias("p")).select("id", F.round("p.relevance", 6).alias("llm_relevance"), F.col("p.rationale").alias("rationale"))
