"""Shared plumbing of the training-data operators: Arrow text batches, hashing and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_ROWS = 250
TEXT = "__gl_text"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, so that a run of very long texts stays small in a Python worker.

    Plans are run after they were made, so the setting stays for the session; other queries get smaller batches, not other results.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def work_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; a local one is set only where that is unset, in local mode alone."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "gleaner-checkpoints")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/gleaner-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """The rows written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = f"{work_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_position(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with columns gl0, gl1, ... and their own names, which so cannot clash with any that an operator adds."""
    return docs.toDF(*[f"gl{i}" for i in range(len(docs.columns))]), docs.columns


def counted_side(df: DataFrame, rows: int) -> DataFrame:
    """A join side, stored, that is broadcast only after it was seen to have at most `rows` rows."""
    kept = stored(df, "side")
    return F.broadcast(kept) if kept.limit(rows + 1).count() <= rows else kept


def texts_bytes(arr: pa.Array) -> Iterator[bytes]:
    """Each text's UTF-8 bytes; a null is empty."""
    for x in arr.cast(pa.large_binary()):
        yield x.as_py() or b""


def release() -> None:
    """Hands unused memory of a finished task back: workers are reused, and their peaks would add up."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library has it
        pass


def map_texts(
    docs: DataFrame,
    text: str,
    keep: Iterable[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
) -> DataFrame:
    """One pass over whole texts: the columns `keep` as they are, then `fields` from make()(texts).

    make() runs once per task, its result once per Arrow batch. The text travels once even where it is kept.
    """
    bounded_batches(docs.sparkSession)
    keep = list(keep)
    named = [docs[c] for c in keep]
    if text in keep:
        source, at = docs.select(*named), keep.index(text)
    else:
        source, at = docs.select(*named, docs[text].cast("string").alias(TEXT)), len(keep)
    schema = T.StructType([source.schema[i] for i in range(len(keep))] + fields)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            made = work(b.column(at))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + made, names=names)
        release()

    return source.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words with a bounded per-task memo."""

    def __init__(self, limit: int = 60_000):
        import xxhash

        self._hash = xxhash.xxh3_64_intdigest
        self._memo: dict[bytes, int] = {}
        self._limit = limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        memo, h = self._memo, self._hash
        if len(memo) > self._limit:
            memo.clear()
        try:
            return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in set(words).difference(memo):
                memo[w] = h(w)
            return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def shingle_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive words, in order; fewer words than k (but some): one for the whole sequence."""
    n = len(word_hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    width = min(k, n)
    out = np.full(n - width + 1, 0x9E3779B97F4A7C15 * (width + 1) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(width):
        out = mix64(out * np.uint64(0x100000001B3) + word_hashes[i : n - width + 1 + i])
    return out


SMALL_SHARE = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; one too small to fill the cores by its files alone (a single row group) is dealt out evenly."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size < SMALL_SHARE * cores else df


def crc_rest(col, mod: int):
    """crc32 of an id's decimal text, modulo `mod`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % mod
