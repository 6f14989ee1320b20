"""Storing intermediate tables in the shared folder, and the audit trail."""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import schema as S


RANKED_IDS = 10_000


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; a local one is set only where that is unset, in local mode alone."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "gleaner-checkpoints")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/run-{uuid.uuid4().hex}"


def storer(spark: SparkSession):
    """store(df): the rows written as Parquet and read again; lineage ends there and a lost executor costs one task."""
    folder = shared_folder(spark)

    def store(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return store


class Audit:
    """Events of a run in stage order. Single events are kept on the driver; events of many documents are DataFrames."""

    def __init__(self, spark: SparkSession):
        self.spark, self.parts, self.timings, self.seq = spark, [], [], 0

    def event(self, stage: str, action: str, *, inputs: dict | None = None, ids: list[str] | None = None, model=None, location=None, prompt=None):
        self.seq += 1
        row = (datetime.now(UTC).isoformat(), stage, action, ids, json.dumps(inputs, ensure_ascii=False, sort_keys=True) if inputs else None, model, location, prompt, self.seq)
        self.parts.append(self.spark.createDataFrame([row], S.AUDIT))

    def events(self, rows: DataFrame, stage: str, action, *, inputs=None, provider=None, prompt: str | None = None) -> None:
        """One event for each row of rows (id, ...); action: text or column, inputs: struct column or none; provider: whose name and
        place stand as model and location; prompt: the column that holds it."""
        self.seq += 1
        action = F.lit(action) if isinstance(action, str) else action
        made = rows.select(
            F.lit(datetime.now(UTC).isoformat()).alias("ts"), F.lit(stage).alias("stage"), action.alias("action"), F.array("id").alias("document_ids"),
            (F.to_json(inputs) if inputs is not None else F.lit(None).cast("string")).alias("inputs"),
            *[F.lit(getattr(provider, a, "?") if provider is not None else None).cast("string").alias(c) for a, c in (("name", "model"), ("location", "location"))],
            (F.col(prompt) if prompt else F.lit(None)).cast("string").alias("prompt"), F.lit(self.seq).cast("long").alias("seq"),
        )
        self.parts.append(made)

    def ranked(self, rows: DataFrame, stage: str, action: str, score: str, *, inputs: dict, provider=None) -> None:
        """One event whose document_ids are the ids in order of the score; beyond RANKED_IDS documents the order is left to the table."""
        n = rows.count()
        ids = [r.id for r in rows.orderBy(F.desc(score), "id").select("id").collect()] if n <= RANKED_IDS else None  # at most RANKED_IDS
        self.event(stage, action, inputs=inputs | {"candidates": n}, ids=ids, model=getattr(provider, "name", None), location=getattr(provider, "location", None))

    @contextmanager
    def stage(self, name: str):
        began = time.time()
        yield
        ms = round((time.time() - began) * 1000, 1)
        self.timings.append({"stage": name, "ms": ms})
        self.event(name, "timing", inputs={"ms": ms})

    def table(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionByName(p)
        return out
