"""The relation graph: threads, exact and near duplicates, overlaps, attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner import schema as S
from gleaner.functions import vectors as V
from gleaner.operators import duplicates, threads
from gleaner.sources.files import attachment_relations

KINDS = ["source", "kind", "target", "evidence"]


def numbered(relations: DataFrame) -> DataFrame:
    """Each (source, kind, target) once, with a number that follows the source's order; sources, not the whole, are windows."""
    one = relations.groupBy("source", "kind", "target").agg(F.min("evidence").alias("evidence"))
    order = Window.partitionBy("source").orderBy("kind", "target")
    return one.withColumn("seq", F.row_number().over(order).cast("long")).select(*KINDS, "seq")


def relate(docs: DataFrame, store, *, near: float = duplicates.NEAR, overlap: float = duplicates.OVERLAP, embed=V.hashing_embed) -> tuple[DataFrame, DataFrame]:
    """(documents with thread columns, relations). embed: the run's embedding, text -> vector. Links only: which duplicate stays is decided after ranking."""
    mails = docs.filter("doc_type = 'email'").select("id", "source_path", "message_id", "in_reply_to", "references", "subject", "date")
    links, placed = threads.link_threads(mails, store)
    exact = store(duplicates.exact_duplicates(docs))
    same = exact.select("source", F.lit(S.DUPLICATE_OF).alias("kind"), "target", "evidence")
    first = docs.filter("text != ''").select("id", "source_path", "text").join(exact.select(F.col("source").alias("id")), "id", "left_anti")
    close = duplicates.near_duplicates(first, store, near=near, overlap=overlap, embed=embed)
    relations = links.unionByName(same).unionByName(close.select(*KINDS)).unionByName(attachment_relations(docs))
    columns = ["thread_id", "thread_size", "thread_tip", "thread_tip_id"]
    out = docs.drop(*columns).join(placed, "id", "left")
    return S.conform(out), store(numbered(relations))


def relation_totals(relations: DataFrame) -> DataFrame:
    return relations.agg(
        F.count_distinct(F.when(F.col("kind") == S.DUPLICATE_OF, F.col("source"))).alias("duplicates"),
        F.count_if(F.col("kind") == S.OVERLAPS_WITH).alias("overlaps"),
    )
