"""Summaries of documents and of clusters by an injected model; each text is asked once and its answer stored."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as X

MAX_WORDS, SNIPPET, CLUSTER_REPS = 100, 2000, 4


def _asked(rows: DataFrame, key: str, llm, store, max_words: int, log=None) -> DataFrame:
    def ask(batches):
        for b in batches:
            prompts = [f"Vat samen in {max_words} woorden:\n{t or ''}" for t in b["body"]]
            yield pd.DataFrame({key: b[key], "prompt": prompts, "raw": [llm.complete(p) for p in prompts]})

    answers = store(rows.mapInPandas(ask, f"{key} {dict(rows.dtypes)[key]}, prompt string, raw string"))
    if log:
        log(answers)
    return answers.select(key, X.truncate_words(X.strip(F.col("raw")), max_words).alias("summary"))


def summarise(docs: DataFrame, llm, store, *, max_words: int = MAX_WORDS, log=None) -> DataFrame:
    """docs (id, text) -> id, summary."""
    return _asked(docs.select("id", F.substring("text", 1, SNIPPET).alias("body")), "id", llm, store, max_words, log)


def summarise_clusters(members: DataFrame, docs: DataFrame, llm, store, *, max_words: int = MAX_WORDS, log=None) -> DataFrame:
    """members (cluster, id, closeness) -> cluster, summary from the first four members."""
    order = Window.partitionBy("cluster").orderBy(F.desc("closeness"), "id")
    first = members.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= CLUSTER_REPS).join(docs.select("id", "text"), "id")
    part = F.concat(F.lit("- "), F.substring("text", 1, SNIPPET // CLUSTER_REPS))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", part.alias("t")))), lambda x: x["t"]), "\n\n")
    return _asked(first.groupBy("cluster").agg(body.alias("body")), "cluster", llm, store, max_words, log)
