"""Byte-level BPE encoding and decoding through a table of distinct words.

1. One pass splits every text into words the way the vocabulary's own splitter does and counts them, per task first;
   the counts meet by word.
2. The words that recur (in two or more tasks), from the count at which at most `table_words` of them are left,
   make the table; each is encoded once, in Spark. Its size is bounded, so it is broadcast.
3. A second pass joins ids back by position: word -> ids from the table. A word outside the table is encoded where it
   stands, once per task; most of those stand in one place of the corpus only.
4. Decoding looks each id up in the worker, in the fixed table of the vocabulary's pieces; there is no join.

The form in which every word of every text is a row, joined by shuffle in both directions, was rejected: it moves
several times the input (README).

Scale: what is shuffled are the distinct words of each task, never texts or positions.

Defined results: a null text encodes as an empty one; repeated rows are each encoded; an empty table is an empty
result; special tokens written in a text are those tokens, as the library does by default; ties between merges are
decided by the vocabulary's ranks; a very long text or word is encoded whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import Counter
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

TABLE_WORDS = 200_000
WORD_BYTES = 64  # longer words are not put in the table, which bounds its bytes
COUNTER_WORDS = 250_000
MEMO_WORDS = 100_000

#: Code points on which this Python's and the splitter's Unicode tables agree (tested); other texts take its own path.
AGREED = ((0x0000, 0x0377), (0x0400, 0x052F), (0x2000, 0x2064), (0x20A0, 0x20BF))
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def default_vocabulary() -> str:
    """The JSON of the byte-level vocabulary of 50,257 ids that this machine offers."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def _char_class(major: str) -> str:
    points = [c for lo, hi in AGREED for c in range(lo, hi + 1) if unicodedata.category(chr(c))[0] == major]
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\u{points[i]:04x}-\\u{points[j]:04x}")
        i = j + 1
    return "".join(out)


@cache
def split_patterns() -> tuple[re.Pattern, re.Pattern]:
    """The splitter's rule in this Python's syntax; and what a text must not hold for it to apply."""
    letter, number, white = _char_class("L"), _char_class("N"), re.escape(WHITE)
    rule = (
        rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{white}{letter}{number}]+"
        rf"|[{white}]+(?![^{white}])|[{white}]+"
    )
    agreed = "".join(f"\\u{lo:04x}-\\u{hi:04x}" for lo, hi in AGREED)
    return re.compile(rule), re.compile(f"[^{agreed}]")


class Vocabulary:
    """A byte-level BPE vocabulary: word splitting, encoding of one word, pieces of ids."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.text, made = text, json.loads(text)
        self.words = Tokenizer.from_str(text)
        self.splitter = self.words.pre_tokenizer  # outlives the change; a second tokenizer would hold the merges twice
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words.encode_special_tokens = True
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        names = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.special_pattern = re.compile("(" + "|".join(names) + ")") if names else None
        self.rule, self.foreign = split_patterns()
        self.ids = {**made["model"]["vocab"], **self.special}

    @cached_property
    def whole(self):
        """The library's own tokenizer, made only where it is asked for: it holds all merges a second time."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.text)

    def split(self, text: str) -> list[str]:
        """The text's words in order; special tokens stand alone."""
        if self.special_pattern and any(s in text for s in self.special):
            parts = self.special_pattern.split(text)
            out = []
            for i, part in enumerate(parts):
                out += [part] if i % 2 else self._split(part)
            return out
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if self.foreign.search(text) is None:
            return self.rule.findall(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)] if text else []

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        out = []
        for w in words:
            if w in self.special:
                out.append(np.array([self.special[w]], "<u4").tobytes())
            else:
                out.append(np.array(self.words.encode(w, add_special_tokens=False).ids, "<u4").tobytes())
        return out

    @cached_property
    def pieces(self) -> list[bytes]:
        """id -> bytes."""
        table = [b""] * (max(self.ids.values()) + 1)
        unit = byte_of_letter()
        for piece, i in self.ids.items():
            table[i] = bytes(unit[c] for c in piece) if all(c in unit for c in piece) else piece.encode()
        return table


@cache
def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 bytes stand for themselves,
    the others follow in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def vocabulary(text: str) -> Vocabulary:
    return Vocabulary(text)


def word_counts(docs: DataFrame, text: str, vocab) -> DataFrame:
    """word, n (occurrences), tasks (in how many counted parts): distinct words of all whole texts."""
    C.bounded_batches(docs.sparkSession)

    def count(batches):
        v = vocabulary(vocab.value)

        def flush(found: Counter):
            rows = list(found.items())
            for i in range(0, len(rows), 20_000):
                part = rows[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["word", "n"])

        found: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    found.update(v.split(t))
            if len(found) > COUNTER_WORDS:
                yield from flush(found)
                found.clear()
        yield from flush(found)
        C.release()

    parts = docs.select(docs[text].cast("string").alias("t")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("tasks"))


def word_table(counts: DataFrame, vocab, table_words: int = TABLE_WORDS) -> DataFrame:
    """word, ids (binary) of at most table_words recurring words; each is encoded once."""
    recurring = C.stored(counts.filter((F.col("tasks") > 1) & (F.octet_length("word") <= WORD_BYTES)).select("word", "n"))
    level = F.least(F.floor(F.log2("n") * 8), F.lit(500)).cast("int")  # at most 501 levels
    sizes = {r.level: r["count"] for r in recurring.groupBy(level.alias("level")).count().collect()}
    total, least = 0, 501
    for k in sorted(sizes, reverse=True):
        if total + sizes[k] > table_words:
            break
        total, least = total + sizes[k], k

    def encode(batches):
        v = vocabulary(vocab.value)
        for b in batches:
            words = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v.encode_words(words), pa.binary())], names=["word", "ids"])

    return recurring.filter(level >= least).select("word").mapInArrow(encode, "word string, ids binary")


class _Joiner:
    """word -> ids: the table, then a bounded memo of words encoded in this task."""

    def __init__(self, vocab: Vocabulary, table: dict[str, bytes]):
        self.vocab, self.table, self.memo = vocab, table, {}

    def __call__(self, text: str) -> bytes:
        words, get, memo = self.vocab.split(text), self.table.get, self.memo
        found = list(map(get, words))
        if None in found:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            missing = list({w for w, x in zip(words, found, strict=True) if x is None and w not in memo})
            memo.update(zip(missing, self.vocab.encode_words(missing), strict=True))
            found = [memo[w] if x is None else x for w, x in zip(words, found, strict=True)]
        return b"".join(found)


def encode_texts(
    docs: DataFrame,
    *,
    keep: list[str],
    text: str = "text",
    vocabulary_json: str | None = None,
    table_words: int = TABLE_WORDS,
    with_ids: bool = True,
) -> DataFrame:
    """The columns `keep`, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<int>) of each whole text."""
    spark = docs.sparkSession
    vocab = spark.sparkContext.broadcast(vocabulary_json or default_vocabulary())
    rows = word_table(word_counts(docs, text, vocab), vocab, table_words).toArrow()  # at most table_words rows
    table = spark.sparkContext.broadcast(dict(zip(rows["word"].to_pylist(), rows["ids"].to_pylist(), strict=True)))
    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []),
    ]

    def make():
        v = vocabulary(vocab.value)
        encode, pieces = _Joiner(v, table.value), v.pieces

        def work(arr: pa.Array) -> list[pa.Array]:
            n, a, b, ids = [], [], [], []
            for t in arr.to_pylist():
                raw = encode(t or "")
                numbers = np.frombuffer(raw, "<u4")
                n.append(len(numbers))
                a.append(hashlib.sha256(raw).hexdigest())
                b.append(hashlib.sha256(decode_bytes(numbers, pieces)).hexdigest())
                if with_ids:
                    ids.append(numbers.astype(np.int32))
            out = [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            return out + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])

        return work

    return C.map_texts(docs, text, keep, fields, make)


def decode_bytes(numbers: np.ndarray, pieces: list[bytes]) -> bytes:
    """The UTF-8 of the decoded text; bytes that are no UTF-8 become U+FFFD."""
    raw = b"".join(map(pieces.__getitem__, numbers.tolist()))
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()


def decode_ids(df: DataFrame, ids: str = "ids", out: str = "text", vocabulary_json: str | None = None) -> DataFrame:
    """df with `out`, the text of the id list; a null list gives null. The pieces are a join side of vocabulary size."""
    vocab = df.sparkSession.sparkContext.broadcast(vocabulary_json or default_vocabulary())

    @F.pandas_udf("string")
    def decoded(col):
        pieces = vocabulary(vocab.value).pieces
        return col.map(lambda x: None if x is None else decode_bytes(np.asarray(x, np.int64), pieces).decode())

    return df.withColumn(out, decoded(df[ids]))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(C.read(spark, sf_dir, "documents"), keep=["doc_id"], with_ids=False)
