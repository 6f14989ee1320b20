"""Conversation threads: parents from headers, then from subject and date; roots by pointer doubling; tips."""

from __future__ import annotations

from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner import schema as S
from gleaner.functions import text as X


@F.pandas_udf(T.TimestampType())
def mail_date(dates: pd.Series) -> pd.Series:
    """RFC 2822 dates in UTC; null where it cannot be read. A date without a zone counts as UTC."""

    def one(raw: str | None) -> datetime | None:
        try:
            found = parsedate_to_datetime(raw)
        except (TypeError, ValueError, IndexError, AttributeError):
            return None
        return found.replace(tzinfo=UTC) if found.tzinfo is None else found.astimezone(UTC)

    return pd.to_datetime(dates.map(one), utc=True)


def header_parents(mails: DataFrame) -> DataFrame:
    """mails (id, source_path, message_id, in_reply_to, references) -> child, parent, evidence.

    In-Reply-To first, else the last known id of References; of repeated message ids the last path wins.
    """
    known = (
        mails.filter(F.length(X.strip(F.coalesce("message_id", F.lit("")))) > 0)
        .groupBy(X.strip(F.col("message_id")).alias("mid"))
        .agg(F.max_by("id", "source_path").alias("parent"))
    )
    replies = mails.select(F.col("id").alias("child"), X.strip(F.col("in_reply_to")).alias("mid"), F.lit(1_000_000).alias("pos"))
    words = F.split(X.strip(F.coalesce("references", F.lit(""))), r"\s+")
    cited = mails.select(F.col("id").alias("child"), F.posexplode(words).alias("pos", "mid"))
    found = replies.unionByName(cited.select("child", "mid", "pos")).join(known, "mid").filter("parent != child")
    best = found.groupBy("child").agg(F.max_by(F.struct("parent", "mid"), "pos").alias("m"))
    return best.select("child", F.col("m.parent").alias("parent"), F.concat(F.lit("header:"), F.col("m.mid")).alias("evidence"))


def subject_parents(mails: DataFrame, linked: DataFrame, store) -> DataFrame:
    """Mails without a header parent, of one subject (prefixes ignored), follow each other by date, then path and id.

    The mails are dealt over ranges of (subject, date, path, id), so one subject of any size fills many tasks. The first mail of a
    range follows the last one of the range before; only those last mails, one a range, meet in one place.
    """
    loose = mails.join(linked.select(F.col("child").alias("id")), "id", "left_anti").withColumn("subj", X.norm_subject(F.coalesce("subject", F.lit(""))))
    keys = [F.col("subj"), F.col("sent").asc_nulls_first(), F.col("source_path"), F.col("id")]
    dealt = loose.filter("subj != ''").select("id", "subj", "sent", "source_path").repartitionByRange(*keys)
    dealt = store(dealt.withColumn("part", F.spark_partition_id()))
    mail = F.struct("id", "subj")
    ends = dealt.groupBy("part").agg(F.max_by(mail, F.struct("subj", "sent", "source_path", "id")).alias("end"))
    ends = ends.select("part", F.lag("end").over(Window.orderBy("part")).alias("end"))  # one row a range
    before = F.coalesce(F.lag(mail).over(Window.partitionBy("part").orderBy(*keys)), F.col("end"))
    chained = dealt.join(ends, "part").withColumn("before", before).filter("before.subj = subj and before.id != id")
    return chained.select(F.col("id").alias("child"), F.col("before.id").alias("parent"), F.concat(F.lit("heuristiek:"), F.col("subj")).alias("evidence"))


def roots(ids: DataFrame, parents: DataFrame, store, max_rounds: int = 40) -> DataFrame:
    """id, root, depth by pointer doubling: rounds grow with the logarithm of the depth.

    Members of a cycle (broken headers) are cut at the smallest id: a parent link from that id is ignored.
    """
    start = ids.join(parents.select(F.col("child").alias("id"), "parent"), "id", "left")
    now = store(start.select("id", F.coalesce("parent", "id").alias("at"), F.when(F.col("parent").isNotNull(), 1).otherwise(0).cast("long").alias("depth"), F.least("id", F.coalesce("parent", "id")).alias("low")))
    for _ in range(max_rounds):
        up = now.select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("depth").alias("d2"), F.col("low").alias("low2"))
        ahead = now.join(up, "at").select("id", F.col("at2").alias("at"), (F.col("depth") + F.col("d2")).alias("depth"), F.least("low", "low2").alias("low"), (F.col("d2") > 0).alias("moved"))
        ahead = store(ahead)
        n_moved, deepest = ahead.agg(F.count_if("moved"), F.max("depth")).first()
        now = ahead.drop("moved")
        if not n_moved:
            return now.select("id", F.col("at").alias("root"), "depth")
        if deepest > 1 << 30:  # only a cycle doubles on and on
            loop = now.filter("depth > 1000000000").select(F.col("low").alias("child")).distinct()
            return roots(ids, parents.join(loop, "child", "left_anti"), store, max_rounds)
    raise RuntimeError("threads deeper than 2^40")


def link_threads(mails: DataFrame, store) -> tuple[DataFrame, DataFrame]:
    """(relations, thread columns by id): thread_id, thread_size, thread_tip, thread_tip_id of every mail.

    The tip is the leaf of greatest depth, then date, then id.
    """
    mails = store(mails.withColumn("sent", mail_date("date")))
    linked = header_parents(mails)
    edges = store(linked.unionByName(subject_parents(mails, linked, store)))
    placed = roots(mails.select("id"), edges.select("child", "parent"), store).join(mails.select("id", "sent"), "id")
    leaves = placed.join(edges.select(F.col("parent").alias("id")).distinct(), "id", "left_anti")
    rank = F.struct("depth", F.coalesce("sent", F.lit("0001-01-01").cast("timestamp")), "id")
    tips = leaves.groupBy("root").agg(F.max_by("id", rank).alias("thread_tip_id"))
    sizes = placed.groupBy("root").agg(F.count("*").alias("thread_size"))
    threads = placed.join(sizes, "root").join(tips, "root", "left").select(
        "id", F.col("root").alias("thread_id"), "thread_size", (F.col("id") == F.coalesce("thread_tip_id", "id")).alias("thread_tip"), "thread_tip_id"
    )
    relations = edges.select(F.col("child").alias("source"), F.lit(S.THREAD_PARENT).alias("kind"), F.col("parent").alias("target"), "evidence")
    return relations, threads
