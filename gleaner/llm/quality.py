"""Quality rules and a hashed n-gram log-likelihood ratio between trusted-target and raw-corpus multinomials.

The target multinomial counts the words and word pairs, hashed into `buckets`, of every document labelled good; the raw one
those of all documents. A document's score is its mean log ratio per feature. The threshold is the score below which
a fixed small share of the distinct target scores lies, read from a histogram over all target documents, so it is deterministic.

Scale: counts are summed per task into one vector of `buckets` numbers before they meet, so the shuffle is tasks x
buckets and the broadcast is the bucket table, both independent of the corpus. The label join broadcasts the ids only
below `broadcast_rows`, beyond that both sides are shuffled.

Defined results: a null or empty text has no words and fails the base rule; without any labelled row the ratio is 0 for
all and the threshold rejects none; repeated label rows count once; repeated document rows are each judged; scores equal to
the threshold are kept; a very long text is read whole; an empty table gives an empty result; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

BUCKETS = 1 << 14
MIN_WORDS = 50
REJECTED_TARGET_SHARE = 0.01
HISTOGRAM = (-12.0, 12.0, 4800)
BROADCAST_ROWS = 2_000_000

SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
WHITE = b" \t\n\x0b\x0c\r"
#: continuation bytes of UTF-8 and white space: everything else begins a character of a word
NO_WORD_CHAR = bytes([*range(0x80, 0xC0)]) + WHITE


def features(hashes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket numbers of the words and of the pairs of neighbouring words."""
    pairs = C.mix64(hashes[:-1] * np.uint64(3) + hashes[1:] * np.uint64(0x9E3779B97F4A7C15))
    return (np.concatenate((hashes, pairs)) % np.uint64(buckets)).astype(np.int64)


def base_signals(body: bytes, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    n = len(words)
    chars = len(body.translate(None, NO_WORD_CHAR))
    symbols = len(body.translate(None, NOT_SYMBOLS))
    lines = [x for x in body.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n >= 4:
        windows = C.shingle_hashes(hashes, 3)
        _, at, counts = np.unique(windows, return_inverse=True, return_counts=True)
        twice = counts[at] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : k + len(twice)] |= twice
        repeated = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > 50 * n_words


def trusted_ids(labels: DataFrame, label_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    return labels.filter(labels[quality] == 1).select(labels[label_id].alias("gl_id")).dropna().distinct()


def flag_trusted(docs: DataFrame, ids: DataFrame, doc_id: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with gl_trusted; the ids are broadcast only if a count of at most broadcast_rows was seen."""
    side = ids.withColumn("gl_trusted", F.lit(True))
    if ids.limit(broadcast_rows + 1).count() <= broadcast_rows:
        side = F.broadcast(side)
    out = docs.join(side, docs[doc_id] == F.col("gl_id"), "left")
    return out.withColumn("gl_trusted", F.coalesce("gl_trusted", F.lit(False)))


def bucket_counts(docs: DataFrame, text: str, trusted: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Feature counts over all documents, and over the trusted ones."""
    C.bounded_batches(docs.sparkSession)
    pair = docs.select(docs[text].cast("string").alias("t"), docs[trusted].alias("g"))

    def count(batches):
        hasher = C.WordHasher()
        total = np.zeros((2, buckets), np.int64)
        for b in batches:
            good = b.column(1).to_numpy(zero_copy_only=False)
            for body, g in zip(C.texts_bytes(b.column(0)), good, strict=True):
                words = body.split()
                if words:
                    found = np.bincount(features(hasher(words), buckets), minlength=buckets)
                    total[0] += found
                    if g:
                        total[1] += found
        at = np.flatnonzero(total[0])
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], names=["b", "raw", "good"])

    summed = pair.mapInArrow(count, "b long, raw long, good long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for b, r, g in summed.collect():  # at most `buckets` rows
        raw[b], good[b] = r, g
    return raw, good


def log_ratio(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Smoothed log(target share / raw share) of each bucket; 0 everywhere without target counts."""
    if not good.sum():
        return np.zeros(len(raw))
    p = (good + 1.0) / (good.sum() + len(good))
    q = (raw + 1.0) / (raw.sum() + len(raw))
    return np.log(p / q)


FIELDS = [
    *(T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("llr", T.DoubleType()),
]


def scored(docs: DataFrame, ratio: np.ndarray, *, keep: list[str], text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def make():
        hasher, table = C.WordHasher(), shared.value

        def work(arr: pa.Array) -> list[pa.Array]:
            rows = []
            for body in C.texts_bytes(arr):
                words = body.split()
                hashes = hasher(words)
                signals = base_signals(body, words, hashes)
                llr = float(table[features(hashes, len(table))].mean()) if words else 0.0
                rows.append((*signals, base_failed(signals[0], signals[4]), round(llr, 9)))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            return [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]

        return work

    return C.map_texts(docs, text, keep, FIELDS, make)


def threshold(target: DataFrame, share: float = REJECTED_TARGET_SHARE) -> float:
    """The lower edge of the histogram bin at which more than `share` of the rows of `target` are reached."""
    lo, hi, bins = HISTOGRAM
    b = F.least(F.greatest(F.floor((F.col("llr") - lo) / (hi - lo) * bins), F.lit(0)), F.lit(bins - 1))
    counts = {r.b: r.n for r in target.groupBy(b.alias("b")).agg(F.count("*").alias("n")).collect()}
    total, seen = sum(counts.values()), 0
    for k in sorted(counts):
        seen += counts[k]
        if seen > share * total:
            return lo + k * (hi - lo) / bins
    return lo


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    buckets: int = BUCKETS,
    rejected_target_share: float = REJECTED_TARGET_SHARE,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Per document row: id, the base signals, base_failed, kept, llr. Three passes over the texts, no text shuffled
    while the label ids fit a broadcast."""
    flagged = flag_trusted(docs.select(docs[doc_id], docs[text]), trusted_ids(labels), doc_id, broadcast_rows)
    raw, good = bucket_counts(flagged, text, "gl_trusted", buckets)
    ratio = log_ratio(raw, good)
    target = scored(flagged.filter("gl_trusted"), ratio, keep=[], text=text).filter(~F.col("base_failed"))
    cut = threshold(target, rejected_target_share)
    judged = scored(docs, ratio, keep=[doc_id], text=text)
    kept = ~F.col("base_failed") & (F.col("llr") >= F.lit(cut))
    return judged.withColumn("kept", kept).select(doc_id, *[f.name for f in FIELDS[:6]], "kept", "llr")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))
