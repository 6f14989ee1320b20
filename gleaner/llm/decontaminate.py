"""Benchmark decontamination with a generalised suffix automaton over normalised test items.

Items become sequences of word numbers. One automaton holds all of them; training words stream through it, and at
each word the length of the longest match that ends there is known. A window (13 consecutive item words, or a whole
shorter item) ends at a word exactly if the match is that long and the state, or a state on its suffix-link path,
carries the window.

Scale: documents are read once and not shuffled. The automaton is broadcast in blocks of at most `block_words` item
words, so what is broadcast is bounded however large the benchmark is; with more than one block each block is one
pass over the documents, and hits meet in a merge by document.

Defined results: a null or empty text has no words, no hits and is clean; a null or wordless item has no window; the words of an
item without an id are hit like any other's, but it is not among the items; items of one id count once; repeated document rows
are each judged; ties (a word in windows of several items) count for all of them; a very long text is streamed like any
other; an empty table gives an empty result; other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW = 13
MIN_COVERAGE = 20  # a document is contaminated when 20 * n_hit >= n_words
BLOCK_WORDS = 400_000

#: Upper case to lower case; every byte outside a-z, 0-9 and non-ASCII to a space. UTF-8 keeps non-ASCII apart.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class ItemAutomaton:
    """Generalised suffix automaton; for each state the items whose windows end there."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.shortest = window
        ends: list[tuple[int, int, int]] = []  # state, number of words of the window, item
        self.names = [name for name, _ in items]
        sequences = [[self.numbers.setdefault(w, len(self.numbers)) for w in words] for _, words in items]
        for seq in sequences:
            self._insert(seq)
        for item, seq in enumerate(sequences):
            if not seq:
                continue
            size = min(window, len(seq))
            self.shortest = min(self.shortest, size)
            state, matched = 0, 0
            for i, c in enumerate(seq):
                state = self.next[state][c]
                matched += 1
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                    matched = self.length[state]
                matched = min(matched, self.length[state])
                if i + 1 >= size:
                    ends.append((state, size, item))
        at: dict[int, dict[int, set[int]]] = {}
        for state, size, item in ends:
            at.setdefault(state, {}).setdefault(size, set()).add(item)
        self.at = {s: sorted((size, tuple(sorted(x))) for size, x in by.items()) for s, by in at.items()}
        #: the nearest state on the suffix-link path, itself included, that carries a window
        self.out = [-1] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            self.out[s] = s if s in self.at else self.out[self.link[s]] if self.link[s] >= 0 else -1

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _insert(self, seq: list[int]) -> None:
        last = 0
        for c in seq:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
                continue
            cur, p = self._new(self.length[last] + 1, 0, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            last = cur

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged hit intervals of word positions (end exclusive) and the items with an occurring window."""
        n = len(words)
        if n < self.shortest or not self.numbers:
            return [], set()
        get = self.numbers.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, n)
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for lo, hi in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if hi - lo >= self.shortest:  # an unknown word resets the automaton, so shorter runs hold no window
                self._stream(ids[lo:hi].tolist(), lo, spans, found)
        return spans, found

    def _stream(self, ids: list[int], base: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        following, link, length, out, at = self.next, self.link, self.length, self.out, self.at
        state = matched = 0
        for i, c in enumerate(ids):
            while state and c not in following[state]:
                state = link[state]
                matched = length[state]
            state = following[state].get(c, 0)
            matched = matched + 1 if state else 0
            s, widest = out[state], 0
            while s >= 0:
                for size, items in at[s]:
                    if size <= matched:
                        found.update(items)
                        widest = max(widest, size)
                s = out[link[s]] if link[s] >= 0 else -1
            if widest:
                lo, hi = base + i + 1 - widest, base + i + 1
                while spans and spans[-1][1] >= lo:
                    lo = min(lo, spans.pop()[0])
                spans.append((lo, hi))


def item_blocks(
    benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int
) -> Iterator[ItemAutomaton]:
    """Automata over the items in turn; each takes items until it has block_words words."""
    block: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for name, body in benchmark.select(benchmark[item_id].cast("string"), benchmark[text]).toLocalIterator():
        words = words_of((body or "").encode())
        if not words:
            continue
        if block and size + len(words) > block_words:
            yield ItemAutomaton(block, window)
            block, size = [], 0
        block.append((name, words))
        size += len(words)
    if block:
        yield ItemAutomaton(block, window)


def word_offsets(text: bytes) -> list[tuple[int, int]]:
    import re

    return [m.span() for m in re.finditer(rb"[^ ]+", text.translate(WORD_BYTES))]


RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def _pass(docs: DataFrame, text: str, keep: list[str], automaton, fields: list[T.StructField]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def make():
        auto = shared.value

        def work(arr: pa.Array) -> list[pa.Array]:
            counts, spans, items = [], [], []
            for body in C.texts_bytes(arr):
                words = words_of(body)
                s, found = auto.hits(words) if auto else ([], ())
                counts.append(len(words))
                spans.append([list(x) for x in s])
                items.append(sorted({auto.names[i] for i in found} - {None}) if found else [])
            return [
                pa.array(counts, pa.int64()),
                pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                pa.array(items, pa.list_(pa.string())),
            ]

        return work

    return C.map_texts(docs, text, keep, fields, make)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per document row: its id, n_words, hit_spans (word positions, end exclusive) and items (ids as strings)."""
    blocks = item_blocks(benchmark, item_id, item_text, window, block_words)  # one at a time on the driver
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        return _pass(docs, text, [doc_id], first, RESULT)
    keyed = docs.select(
        docs[doc_id], docs[text], F.xxhash64(docs[doc_id], docs[text]).alias("gl_k"), F.md5(docs[text]).alias("gl_m")
    )
    parts = [_pass(keyed, text, [doc_id, "gl_k", "gl_m"], b, RESULT) for b in chain((first, second), blocks)]
    # a repeated row (same id, same text) meets its like here: count rows of one block to give each back
    all_parts = parts[0].withColumn("gl_b", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        all_parts = all_parts.unionByName(p.withColumn("gl_b", F.lit(i)))
    merged = all_parts.groupBy(doc_id, "gl_k", "gl_m").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_set("hit_spans"))).alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.sum(F.when(F.col("gl_b") == 0, 1).otherwise(0)).alias("copies"),
    )
    union = F.expr(
        "aggregate(s, cast(array() as array<array<bigint>>), (acc, x) -> "
        "CASE WHEN size(acc) > 0 AND element_at(acc, -1)[1] >= x[0] THEN "
        "concat(slice(acc, 1, size(acc) - 1), "
        "array(array(element_at(acc, -1)[0], greatest(element_at(acc, -1)[1], x[1])))) "
        "ELSE concat(acc, array(x)) END)"
    )
    rows = merged.withColumn("hit_spans", union).withColumn("gl_r", F.explode(F.expr("sequence(1, copies)")))
    return rows.select(doc_id, "n_words", "hit_spans", "items")


def _n_hit(col):
    return F.aggregate(col, F.lit(0).cast("long"), lambda acc, x: acc + x[1] - x[0])


def contamination_digest(found: DataFrame, doc_id: str = "doc_id", coverage: int = MIN_COVERAGE) -> DataFrame:
    """The contract's columns from find_contamination's rows."""
    hit = _n_hit(F.col("hit_spans"))
    return found.select(
        doc_id,
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((hit > 0) & (coverage * hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    action: str = "drop",
    window: int = WINDOW,
    coverage: int = MIN_COVERAGE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """All columns of docs. action "drop": contaminated documents go; "excise": their hit spans are cut out of the text.

    Documents below the coverage limit stay as they are. One pass over the documents; with several benchmark blocks one
    for each, stored in between, so that a worker never holds more than one automaton.
    """
    if action not in ("drop", "excise"):
        raise ValueError(action)
    rows, own = C.by_position(docs)
    names, spans = rows.columns, []
    text = names[own.index(text)]
    for i, automaton in enumerate(item_blocks(benchmark, item_id, item_text, window, block_words)):
        rows = C.stored(rows, "block") if i else rows
        spans.append(f"spans{i}")
        rows = _span_pass(rows, text, [*names, *spans[:-1]], automaton, spans[-1])
    if not spans:
        return docs
    if len(spans) > 1:
        rows = C.stored(rows, "block")
    rows = rows.select(*names, F.concat(*spans).alias("spans"))
    if action == "drop":
        judged = C.map_texts(rows, text, [*names, "spans"], [T.StructField("n", T.LongType())], _word_count)
        hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x[0], x[1] - 1)))))
        hit = F.when(F.size("spans") > 0, hit).otherwise(0)
        return judged.filter(~((hit > 0) & (coverage * hit >= F.col("n")))).select(*names).toDF(*own)

    return _excise(rows, text, names, coverage).toDF(*own)


def _word_count():
    return lambda arr: [pa.array([len(words_of(b)) for b in C.texts_bytes(arr)], pa.int64())]


def _span_pass(docs: DataFrame, text: str, keep: list[str], automaton: ItemAutomaton, name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    kind = T.ArrayType(T.ArrayType(T.LongType()))

    def make():
        auto = shared.value

        def work(arr: pa.Array) -> list[pa.Array]:
            found = [[list(x) for x in auto.hits(words_of(b))[0]] for b in C.texts_bytes(arr)]
            return [pa.array(found, pa.list_(pa.list_(pa.int64())))]

        return work

    return C.map_texts(docs, text, keep, [T.StructField(name, kind)], make)


def _excise(rows: DataFrame, text: str, names: list[str], coverage: int) -> DataFrame:
    """The texts of contaminated rows without their hit words."""
    kinds = rows.schema
    body, at = names.index(text), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, spans in zip(C.texts_bytes(b.column(body)), b.column(at).to_pylist(), strict=True):
                marked = np.zeros(len(words_of(raw)), bool)
                for lo, hi in spans:
                    marked[lo:hi] = True
                n_hit = int(marked.sum())
                out.append(_excised(raw, marked) if n_hit and coverage * n_hit >= len(marked) else None)
            new = [x if x is not None else old for x, old in zip(out, b.column(body).to_pylist(), strict=True)]
            columns = [pa.array(new, pa.string()) if i == body else b.column(i) for i in range(at)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([T.StructField(text, T.StringType()) if n == text else kinds[i] for i, n in enumerate(names)])
    return rows.mapInArrow(run, schema)


def _excised(body: bytes, marked: np.ndarray) -> str:
    """The text without its hit words; what stands between two hit words of one span goes with them."""
    at, out, last = word_offsets(body), [], 0
    for i, (lo, hi) in enumerate(at):
        if marked[i]:
            out.append(body[last:lo] if not (i and marked[i - 1]) else b"")
            last = hi
    return b"".join([*out, body[last:]]).decode()


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(find_contamination(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark")))
