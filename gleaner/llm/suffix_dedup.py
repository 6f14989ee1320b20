"""Removal of repeated byte strings by sparse suffix arrays in a logarithmic index family.

A byte goes if a string of `length` bytes that covers it also starts in a document of a smaller id. A suffix array of
every byte position would be many times the input, so suffixes are taken where every string of `length` bytes has one:

* Anchors. In each string of `length` bytes the `gram`-byte string with the least hash is an anchor (a minimiser). Equal
  strings have equal anchors at equal places, so a repeated string is found at an anchor that stands in two documents.
* Chunks and shards. Documents are dealt into chunks of a few MB, anchors into shards by hash. A first round of hashes tells
  each chunk which of its anchors stand elsewhere too; only their suffixes are looked at further.
* Suffix arrays. A record is the suffix at an anchor, `length` bytes of it, then the bytes before the anchor, backwards, and the
  smallest document that holds it. A shard takes the chunks' records in batches; a batch is sorted by its bytes into a suffix array.
* Levels. A batch is merge-scanned against each existing level: records of one anchor string are neighbours there, and as far as
  two agree to the right and to the left, the strings between are in both documents; the larger one is marked. Then the batch
  becomes a level, and levels of like size merge, equal records into one, so each record is merged a logarithmic number of times.
* Long runs of neighbours. Up to `paired` records of one anchor are compared pair by pair. In longer runs the common
  prefixes of neighbours, in suffix order and in the order of the reversed bytes before, number the equal strings at each offset.
* Hot anchors. The records of an anchor with over `wide` occurrences are split, one for each string of `length` bytes around it, and
  dealt by the hash of that string; equal strings meet, and no anchor is more than one shard can hold.
* Last round. Each chunk maps the marks back to its documents and cuts.

Scale: texts are shuffled once, the exchange is reused by all rounds; a common string is sent once by each chunk; all rounds
are one plan with partitions counted from the input's bytes; no driver-side data but that byte count. Bytes, not hashes,
decide. `SuffixIndex` keeps the levels as tables: new batches of documents are judged against them and added.

Defined results: a null text is empty; a text shorter than `length` keeps everything; rows of one id do not count against each
other, whether they repeat or not; rows without an id come after all others and not against each other, and are dealt by their
text; a very long text is one row of its chunk; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

LENGTH = 50
GRAM = 22
CHUNK_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20
SHARD_ANCHORS = 1_000_000
NO_ID = np.iinfo(np.int64).max
BASE = np.uint64(0x9E3779B97F4A7C15)
U1, U40 = np.uint64(1), np.uint64(40)
#: a name in a run: 36 bits of the hash, and 4 bits: how often the chunk has it (as a power of two), or, in answers, whether it is hot
NAME = (U1 << np.uint64(36)) - U1
COUNT_BITS = np.uint64(4)
PAIRED = 12
BATCH_RECORDS = 1 << 16
WIDE = 20_000
SPLIT = 0x80


@cache
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240501).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + U1


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(size, BASE), np.full(size, inverse)
    up[0] = down[0] = U1
    return np.cumprod(up), np.cumprod(down)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each `gram` consecutive bytes."""
    size = 1 << max(20, int(len(data)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[data] * up[: len(data)], out=sums[1:])
    n = len(data) - gram + 1
    return C.mix64((sums[gram:] - sums[:n]) * down[:n])


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each `width` consecutive values, by doubling."""
    step = 1
    while step * 2 <= width:
        x = best(x[: len(x) - step], x[step:])
        step *= 2
    rest = width - step
    return best(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the concatenated texts, and hashes, of all anchors; strings never reach over a text's end."""
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    where, hashes, lo = [], [], 0
    while lo < len(texts):
        hi = int(np.searchsorted(starts, starts[lo] + BLOCK_BYTES, side="right"))
        hi = min(len(texts), max(lo + 1, hi - 1))
        data = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
        if len(data) >= length:
            h = gram_hashes(data, gram)
            width = length - gram + 1
            least = sliding(h, width, np.minimum)  # of the window that starts here
            ends = np.repeat(starts[lo + 1 : hi + 1] - starts[lo], np.diff(starts[lo : hi + 1]))[: len(least)]
            least[np.arange(len(least)) + length > ends] = 0
            padded = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
            at = np.flatnonzero((sliding(padded, width, np.maximum) == h) & (h > 0))
            where.append(at + starts[lo])
            hashes.append(h[at])
        lo = hi
    if not where:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(where), np.concatenate(hashes)


def _bytes(rows: np.ndarray) -> np.ndarray:
    """Each row as one string, which numpy compares by bytes."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


@dataclass
class Level:
    """A sparse suffix array: distinct records by bytes, the smallest document of each, and the offsets marked so far."""

    rows: np.ndarray
    doc: np.ndarray
    mask: np.ndarray

    @staticmethod
    def of(rows: np.ndarray, doc: np.ndarray, mask: np.ndarray | None = None) -> Level:
        """Sorts (runs that are sorted already are merged); equal records become one, which keeps the marks of its smallest document."""
        mask = np.zeros(len(rows), np.uint32) if mask is None else mask
        if not len(rows):
            return Level(rows, doc, mask)
        order = np.argsort(_bytes(rows), kind="stable")
        rows, doc, mask = rows[order], doc[order], mask[order]
        head = np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))
        first = np.flatnonzero(head)
        least = np.minimum.reduceat(doc, first)
        own = np.where(doc == least[np.cumsum(head) - 1], mask, 0).astype(np.uint32)
        return Level(rows[first], least, np.bitwise_or.reduceat(own, first))


def _spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0]..hi[0]-1, lo[1]..hi[1]-1, ..."""
    size = hi - lo
    return np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


class LogFamily:
    """Levels of a geometric family of suffix arrays, the largest first."""

    def __init__(self, length: int, gram: int, paired: int = PAIRED, levels: list[Level] | None = None):
        self.length, self.gram, self.paired = length, gram, paired
        self.levels = sorted(levels or [], key=lambda x: -len(x.rows))

    def add(self, rows: np.ndarray, doc: np.ndarray) -> None:
        """A batch: its suffix array, scanned by itself and against each level, then merged with levels of its size."""
        new = Level.of(rows, doc)
        new.mask |= marks(new.rows, new.doc, None, self.length, self.gram, self.paired)
        for level in self.levels:
            self.merge_scan(level, new)
        while self.levels and len(self.levels[-1].rows) <= 2 * len(new.rows):
            new = self._merged(self.levels.pop(), new)
        self.levels.append(new)

    @staticmethod
    def _merged(a: Level, b: Level) -> Level:
        return Level.of(*(np.concatenate(x) for x in ((a.rows, b.rows), (a.doc, b.doc), (a.mask, b.mask))))

    def merge_scan(self, old: Level, new: Level) -> None:
        """Marks both from each other, where they hold records of one anchor string."""
        if not len(old.rows) or not len(new.rows):
            return
        before, now = _bytes(old.rows[:, : self.gram]), _bytes(new.rows[:, : self.gram])
        edges = np.flatnonzero(np.concatenate(([True], now[1:] != now[:-1], [True])))
        lo, hi = (np.searchsorted(before, now[edges[:-1]], side) for side in ("left", "right"))
        met = hi > lo
        a, b = _spread(lo[met], hi[met]), _spread(edges[:-1][met], edges[1:][met])
        rows = np.concatenate((old.rows[a], new.rows[b]))
        if not len(rows):
            return
        order = np.argsort(_bytes(rows), kind="stable")
        fresh = order >= len(a)
        doc = np.concatenate((old.doc[a], new.doc[b]))[order]
        found = np.empty(len(rows), np.uint32)
        found[order] = marks(rows[order], doc, fresh, self.length, self.gram, self.paired)
        old.mask[a] |= found[: len(a)]
        new.mask[b] |= found[len(a) :]

    def whole(self) -> Level:
        """All levels merged into one."""
        while len(self.levels) > 1:
            self.levels.append(self._merged(self.levels.pop(), self.levels.pop()))
        return self.levels[0]


def pack(h: np.ndarray, extra: np.ndarray) -> bytes:
    """Names of hashes with four bits more, five bytes each."""
    return (((h & NAME) << COUNT_BITS) | extra.astype(np.uint64)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    both = out.view("<u8").ravel()
    return both >> COUNT_BITS, (both & np.uint64(15)).astype(np.int64)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> U40) % np.uint64(shards)).astype(np.int64)


class Chunk:
    """The documents of one chunk."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        self.length, self.gram = length, gram
        self.texts = [x or b"" for x in table["gl_t"].cast(pa.large_binary()).to_pylist()]
        ids = table["gl_id"].combine_chunks()
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = np.where(self.null, NO_ID, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        self.starts = np.concatenate(([0], np.cumsum([len(t) for t in self.texts]))).astype(np.int64)
        self.where, self.hashes = anchors(self.texts, length, gram)
        self.doc = np.searchsorted(self.starts, self.where, side="right") - 1

    def in_two_documents(self) -> np.ndarray:
        """Sorted hashes that stand in documents of two ids here."""
        h, ids = self.hashes, self.ids[self.doc]
        order = np.lexsort((ids, h))
        h, ids = h[order], ids[order]
        return np.unique(h[1:][(h[1:] == h[:-1]) & (ids[1:] != ids[:-1])])

    def records(self, flagged: np.ndarray, hot: np.ndarray) -> Records:
        """The distinct records at anchors with a flagged hash; those of hot ones split."""
        side, span = self.length - self.gram, 2 * self.length - self.gram
        occ = np.flatnonzero(np.isin(self.hashes, flagged))
        at, doc = self.where[occ], self.doc[occ]
        left = np.minimum(at - self.starts[doc], side)
        right = np.minimum(self.starts[doc + 1] - at - self.gram, side)
        data = np.frombuffer(bytes(side) + b"".join(self.texts) + bytes(side), np.uint8)
        rows = np.empty((len(occ), span + 2), np.uint8)
        reach = np.concatenate((np.arange(side, span), np.arange(side)[::-1]))  # the suffix, then what is before it, backwards
        away = np.arange(side)
        for i in range(0, len(occ), 50_000):
            s = slice(i, i + 50_000)
            part = data[at[s, None] + reach]
            part[:, self.gram : self.length][away >= right[s, None]] = 0
            part[:, self.length :][away >= left[s, None]] = 0
            rows[s, :span] = part
        rows[:, span], rows[:, span + 1] = right, left
        return Records(rows, self.hashes[occ], self.ids[doc], occ, hot, self.length, self.gram)


def _distinct(rows: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each distinct row is first, which of them each row is, and their smallest documents."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), doc
    _, first, number = np.unique(_bytes(rows), return_index=True, return_inverse=True)
    least = np.full(len(first), NO_ID)
    np.minimum.at(least, number, doc)
    return first, number, least


class Records:
    """A chunk's distinct records, and what of them is sent: records as they are, and strings of the hot ones."""

    def __init__(self, rows: np.ndarray, hashes: np.ndarray, doc: np.ndarray, occ: np.ndarray, hot: np.ndarray, length: int, gram: int):
        side, span = length - gram, 2 * length - gram
        first, self.number, self.least = _distinct(rows, doc)
        self.occ, self.rows, key = occ, rows[first], hashes[first]
        split = np.isin(key, hot)
        self.plain = np.flatnonzero(~split)
        parts, of, start = [], [], []
        at = np.flatnonzero(split)
        for s in range(side + 1 if len(at) else 0):  # the string begins `side - s` bytes before the anchor
            own = at[(self.rows[at, span] >= s) & (self.rows[at, span + 1] >= side - s)]
            part = self.rows[own]
            part[:, gram + s : length] = 0
            part[:, length + side - s : span] = 0
            part[:, span], part[:, span + 1] = s, SPLIT | (side - s)
            parts.append(part)
            of.append(own)
            start.append(np.full(len(own), s, np.uint32))
        self.of, self.start = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (of, start))
        strings = np.concatenate(parts) if parts else self.rows[:0]
        head, self.string, least = _distinct(strings, self.least[self.of])
        self.sent = np.concatenate((self.rows[self.plain], strings[head]))
        self.sent_least = np.concatenate((self.least[self.plain], least))
        self.key = np.concatenate((key[self.plain], _row_hashes(strings[head])))

    def masks(self, sent: np.ndarray) -> np.ndarray:
        """Marked offsets of each record from those of what was sent."""
        out = np.zeros(len(self.rows), np.uint32)
        out[self.plain] = sent[: len(self.plain)]
        at = len(self.plain) + self.string
        bad = (self.least[self.of] > self.sent_least[at]) | (sent[at] >> self.start & 1).astype(bool)
        np.bitwise_or.at(out, self.of[bad], (np.uint32(1) << self.start[bad].astype(np.uint32)))
        return out


def _by_shard(h: np.ndarray, shards: int):
    if not len(h):
        return
    shard = shard_of(h, shards)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
        yield int(shard[order[lo]]), order[lo:hi]


SENT = T.StructType([T.StructField("shard", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("run", T.BinaryType())])


def _table(rows: list[tuple]) -> pa.Table:
    shard, chunk, run = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"shard": pa.array(shard, pa.int64()), "chunk": pa.array(chunk, pa.int64()), "run": pa.array(run, pa.binary())})


def _first_run(length: int, gram: int, shards: int):
    """Round 1, chunk side: sorted distinct anchor hashes for each shard, with their counts."""

    def run(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        h, n = np.unique(Chunk(table, length, gram).hashes, return_counts=True)
        return _table([(s, chunk, pack(h[at], np.minimum(15, np.log2(n[at]).astype(np.int64)))) for s, at in _by_shard(h, shards)])

    return run


def _first_scan(wide: int):
    """Round 1, shard side: for each chunk those of its hashes that other chunks have too, and whether they are hot."""

    def run(table: pa.Table) -> pa.Table:
        runs = [unpack(x) for x in table["run"].to_pylist()]
        _, number, times = np.unique(np.concatenate([r for r, _ in runs]), return_inverse=True, return_counts=True)
        total = np.bincount(number, np.concatenate([2.0**c for _, c in runs]))
        out, at = [], 0
        for shard, chunk, (names, _) in zip(table["shard"].to_pylist(), table["chunk"].to_pylist(), runs, strict=True):
            mine = number[at : at + len(names)]
            at += len(names)
            common = times[mine] > 1
            if common.any() and chunk >= 0:
                out.append((shard, chunk, pack(names[common], (total[mine] > wide)[common])))
        return _table(out)

    return run


def _second_run(length: int, gram: int, shards: int, fine: int):
    """Round 2, chunk side: the records for each of the finer shards, compressed."""
    import zstandard

    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([])
        number = docs["chunk"][0].as_py()
        chunk = Chunk(docs, length, gram)
        made = chunk.records(*_flagged(chunk, flags, shards))
        squeeze, out = zstandard.ZstdCompressor(level=3), []
        for s, at in _by_shard(made.key, fine):
            body = made.sent[at].tobytes() + made.sent_least[at].astype("<i8").tobytes()
            out.append((s, number, len(at).to_bytes(4, "little") + squeeze.compress(body)))
        return _table(out)

    return run


def _flagged(chunk: Chunk, flags: pa.Table, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the chunk that stand in two documents, here or anywhere; and the hot ones among them."""
    own = np.unique(chunk.hashes)
    marked, hot = np.isin(own, chunk.in_two_documents()), np.zeros(len(own), bool)
    sent: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for s, r in zip(flags["shard"].to_pylist(), flags["run"].to_pylist(), strict=True):
        sent.setdefault(s, []).append(unpack(r))
    for s, at in _by_shard(own, shards):
        for names, extra in sent.get(s, ()):
            marked[at] |= np.isin(own[at] & NAME, names)
            hot[at] |= np.isin(own[at] & NAME, names[extra > 0])
    return own[marked], own[hot]


def _unpacked(raw: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    n = int.from_bytes(raw[:4], "little")
    body = zstandard.ZstdDecompressor().decompress(raw[4:])
    return np.frombuffer(body, np.uint8, n * width).reshape(n, width), np.frombuffer(body, "<i8", n, n * width)


def judged(family: LogFamily, sent: list[tuple[np.ndarray, np.ndarray]], batch_records: int) -> list[np.ndarray]:
    """Takes what each chunk sent (records, documents) into the family batch by batch; the marks of each record of each chunk."""
    rows, doc, size = [], [], 0
    for r, d in sent:
        rows.append(r)
        doc.append(d)
        size += len(r)
        if size >= batch_records:
            family.add(np.concatenate(rows), np.concatenate(doc))
            rows, doc, size = [], [], 0
    if size:
        family.add(np.concatenate(rows), np.concatenate(doc))
    if not family.levels:
        return [np.zeros(0, np.uint32) for _ in sent]
    whole = family.whole()
    names, out, side = _bytes(whole.rows), [], family.length - family.gram
    for r, d in sent:
        at = np.searchsorted(names, _bytes(r))
        out.append(np.where(d > whole.doc[at], offsets_mask(r[:, -1], r[:, -2], side), whole.mask[at]).astype(np.uint32))
    return out


def _second_scan(length: int, gram: int, paired: int, batch_records: int):
    """Round 2, shard side: for each record a bit for each offset at which its string starts in a smaller document."""
    import zstandard

    width = 2 * length - gram + 2

    def run(table: pa.Table, stored: pa.Table | None = None) -> pa.Table:
        levels = stored_levels(stored, width) if stored is not None else []
        sent = [_unpacked(raw, width) for raw in table["run"].to_pylist()]
        found = judged(LogFamily(length, gram, paired, levels), sent, batch_records)
        out = []
        for shard, chunk, (rows, _), mask in zip(table["shard"].to_pylist(), table["chunk"].to_pylist(), sent, found, strict=True):
            split = rows[:, -1] >= SPLIT
            h = [np.unique(gram_hashes_rows(rows[x, :gram])) for x in (~split, split)]
            body = b"".join(len(x).to_bytes(4, "little") for x in h) + b"".join(x.astype("<u8").tobytes() for x in h) + mask.astype("<u4").tobytes()
            out.append((shard, chunk, zstandard.ZstdCompressor(level=1).compress(body)))
        return _table(out)

    return run


def stored_levels(stored: pa.Table, width: int) -> list[Level]:
    """The levels among rows (level, record, doc)."""
    number = stored["level"].to_numpy()
    rows = np.frombuffer(b"".join(stored["record"].to_pylist()), np.uint8).reshape(-1, width)
    doc = stored["doc"].to_numpy().astype(np.int64)
    return [Level.of(rows[number == k], doc[number == k]) for k in np.unique(number).tolist()]


def offsets_mask(left: np.ndarray, right: np.ndarray, side: int) -> np.ndarray:
    """Bits of the offsets s whose string takes side - s <= left bytes before the anchor and s <= right after it."""
    left, right = left.astype(np.int64) & (SPLIT - 1), right.astype(np.int64)
    low, high = side - left, np.minimum(right, side)
    bits = (U1 << (high + 1).astype(np.uint64)) - (U1 << low.astype(np.uint64))
    return np.where(low <= high, bits, 0).astype(np.uint32)


def _row_hashes(data: np.ndarray) -> np.ndarray:
    value, key = _byte_values(), np.zeros(len(data), np.uint64)
    for column in np.ascontiguousarray(data.T):
        key = key * BASE + value[column]
    return C.mix64(key)


def _agreement(same: np.ndarray) -> np.ndarray:
    """How many columns agree before the first that does not."""
    return np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))


def marks(rows: np.ndarray, doc: np.ndarray, fresh: np.ndarray | None, length: int, gram: int, paired: int) -> np.ndarray:
    """Of sorted records: the offsets at which each one's string is also around a record of a smaller document.

    fresh tells two suffix arrays apart that were merged; pairs inside one of them were compared before.
    """
    side, span = length - gram, 2 * length - gram
    found = np.zeros(len(rows), np.uint32)
    if len(rows) < 2:
        return found
    head = np.concatenate(([True], (rows[1:, :gram] != rows[:-1, :gram]).any(axis=1)))
    edges = np.append(np.flatnonzero(head), len(rows))
    size = np.repeat(np.diff(edges), np.diff(edges))
    place = np.arange(len(rows)) - np.repeat(edges[:-1], np.diff(edges))
    small = size <= paired
    for lag in range(1, min(paired, int(size[small].max(initial=1)))):
        at = np.flatnonzero(small & (place + lag < size))
        at = at[fresh[at] != fresh[at + lag]] if fresh is not None else at
        at = at[doc[at] != doc[at + lag]]
        for i in range(0, len(at), 50_000):
            a = at[i : i + 50_000]
            b = a + lag
            right = np.minimum(_agreement(rows[a, gram:length] == rows[b, gram:length]), np.minimum(rows[a, span], rows[b, span]))
            left = np.minimum(_agreement(rows[a, length:span] == rows[b, length:span]), np.minimum(rows[a, span + 1], rows[b, span + 1]) & (SPLIT - 1))
            mask = offsets_mask(left, right, side)
            # a record meets another at one lag only, so plain indexing loses nothing
            found[a] |= np.where(doc[b] < doc[a], mask, 0).astype(np.uint32)
            found[b] |= np.where(doc[a] < doc[b], mask, 0).astype(np.uint32)
    many = np.flatnonzero(~small)
    if len(many):
        found[many] = _marks_of_runs(rows[many], doc[many], head[many], length, gram)
    return found


def _marks_of_runs(rows: np.ndarray, doc: np.ndarray, head: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The same for long runs: at each offset, records with equal bytes on both sides have one number on each."""
    side, span = length - gram, 2 * length - gram
    found = np.zeros(len(rows), np.uint32)
    right, left = rows[:, span].astype(np.int64), rows[:, span + 1].astype(np.int64) & (SPLIT - 1)
    after = np.concatenate(([-1], _agreement(rows[1:, gram:length] == rows[:-1, gram:length])))
    after[head] = -1
    group = np.cumsum(head)
    back = np.argsort(_bytes(np.hstack((group.astype(">u4").view(np.uint8).reshape(-1, 4), rows[:, length:span]))), kind="stable")
    turned = rows[back, length:span]
    before = np.concatenate(([-1], _agreement(turned[1:] == turned[:-1])))
    before[1:][group[back][1:] != group[back][:-1]] = -1
    number = np.empty(len(rows), np.int64)
    for s in range(side + 1):  # the string begins `side - s` bytes before the anchor
        valid = np.flatnonzero((right >= s) & (left >= side - s))
        if not len(valid):
            continue
        number[back] = np.cumsum(before < side - s)
        key, d = (np.cumsum(after < s) * (len(rows) + 1) + number)[valid], doc[valid]
        order = np.lexsort((d, key))
        first = np.concatenate(([True], key[order][1:] != key[order][:-1]))
        least = d[order][np.flatnonzero(first)][np.cumsum(first) - 1]
        earlier = valid[order[least < d[order]]]
        found[earlier] |= np.uint32(1 << s)
    return found


def gram_hashes_rows(rows: np.ndarray) -> np.ndarray:
    """gram_hashes of each row."""
    up, _ = _powers(1 << 20)
    total = np.zeros(len(rows), np.uint64)
    for i in range(rows.shape[1]):
        total += _byte_values()[rows[:, i]] * up[i]
    return C.mix64(total)


def _third(length: int, gram: int, shards: int, with_spans: bool):
    """Round 3: the answers become removed bytes of documents."""
    import zstandard

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _empty()
        chunk = Chunk(docs, length, gram)
        return _cut(chunk, _removed(chunk, answers))

    def _removed(chunk: Chunk, answers: pa.Table) -> np.ndarray:
        hashes, hot, masks = [], [], {}
        for s, raw in zip(answers["shard"].to_pylist(), answers["run"].to_pylist(), strict=True):
            body = zstandard.ZstdDecompressor().decompress(raw)
            n, m = np.frombuffer(body, "<u4", 2).tolist()
            hashes.append(np.frombuffer(body, "<u8", n + m, 8))
            hot.append(hashes[-1][n:])
            masks[s] = np.frombuffer(body, "<u4", -1, 8 + 8 * (n + m))
        change = np.zeros(int(chunk.starts[-1]) + 1, np.int32)
        if hashes:
            made = chunk.records(np.concatenate(hashes), np.concatenate(hot))
            sent = np.zeros(len(made.sent), np.uint32)
            for s, at in _by_shard(made.key, shards):
                sent[at] = masks[s]
            at, doc = chunk.where[made.occ], chunk.doc[made.occ]
            side = length - gram
            every = offsets_mask(made.rows[:, -1], made.rows[:, -2], side)
            # a document with the same record as a smaller one repeats it at every offset
            later = chunk.ids[doc] > made.least[made.number]
            mask = np.where(later, every[made.number], made.masks(sent)[made.number])
            for start in range(side + 1):
                begin = at[(mask >> np.uint32(start) & 1).astype(bool)] - side + start
                np.add.at(change, begin, 1)
                np.add.at(change, begin + length, -1)
        return np.cumsum(change)[:-1] > 0

    def _empty() -> pa.Table:
        return pa.Table.from_arrays([pa.array([], t) for t in TYPES[: 6 if with_spans else 5]], names=NAMES[: 6 if with_spans else 5])

    def _cut(chunk: Chunk, removed: np.ndarray) -> pa.Table:
        ids, n, gone, runs, sha, spans = [], [], [], [], [], []
        for i, text in enumerate(chunk.texts):
            mine = removed[chunk.starts[i] : chunk.starts[i + 1]]
            edges = np.flatnonzero(np.diff(mine.view(np.int8), prepend=0, append=0))
            pairs = edges.reshape(-1, 2)
            kept = np.frombuffer(text, np.uint8)[~mine].tobytes() if len(pairs) else text
            ids.append(None if chunk.null[i] else int(chunk.ids[i]))
            n.append(len(text))
            gone.append(len(text) - len(kept))
            runs.append(len(pairs))
            sha.append(hashlib.sha256(kept).hexdigest())
            spans.append(pairs.tolist())
        columns = [ids, n, gone, runs, sha, spans][: 6 if with_spans else 5]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=False)], names=NAMES[: len(columns)])

    return run


NAMES = ["gl_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]


def _dealt(docs: DataFrame, doc_id: str, text: str, chunk_bytes: int, length: int, gram: int, shard_anchors: int):
    """Documents by chunk; and the number of shards that their anchors fill."""
    if not 0 < length - gram < 32:
        raise ValueError("length - gram must be 1 to 31")
    source = docs.select(docs[doc_id].cast("long").alias("gl_id"), docs[text].cast("string").alias("gl_t"))
    total = source.agg(F.sum(F.octet_length("gl_t"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    spread = F.pmod(F.xxhash64("gl_id", "gl_t"), F.lit(chunks)).cast("long")
    density = 2 / (length - gram + 2)
    return source.withColumn("chunk", spread).repartition(chunks, "chunk"), max(1, round(total * density / shard_anchors))


def _judge(dealt: DataFrame, shards: int, length: int, gram: int, paired: int, wide: float, batch_records: int, with_spans: bool, index: DataFrame | None = None) -> DataFrame:
    """All rounds. index: rows (key, level, record, doc) of stored levels."""
    fine = shards * 4  # round 2: fewer, larger records
    by_chunk = dealt.groupBy("chunk")
    sent = by_chunk.applyInArrow(_first_run(length, gram, shards), SENT)
    if index is not None:
        sent = sent.unionByName(_index_runs(index, shards))
    flags = sent.repartition(shards, "shard").groupBy("shard").applyInArrow(_first_scan(wide), SENT)
    records = by_chunk.cogroup(flags.groupBy("chunk")).applyInArrow(_second_run(length, gram, shards, fine), SENT)
    met = records.repartition(2 * shards, "shard").groupBy("shard")
    scan = _second_scan(length, gram, paired, batch_records)
    if index is None:
        answers = met.applyInArrow(lambda t: scan(t), SENT)
    else:
        shard = F.pmod(F.shiftrightunsigned("key", 40), F.lit(fine)).alias("shard")
        kept = index.select(shard, "level", "record", "doc").repartition(2 * shards, "shard")
        answers = met.cogroup(kept.groupBy("shard")).applyInArrow(lambda t, u: scan(t, u) if t.num_rows else _table([]), SENT)
    kind = [T.LongType()] * 4 + [T.StringType(), T.ArrayType(T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField(n, t) for n, t in list(zip(NAMES, kind, strict=True))[: 6 if with_spans else 5]])
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(_third(length, gram, fine, with_spans), schema)


def remove_repeats(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    chunk_bytes: int = CHUNK_BYTES,
    shard_anchors: int = SHARD_ANCHORS,
    paired: int = PAIRED,
    wide: int = WIDE,
    batch_records: int = BATCH_RECORDS,
    with_spans: bool = True,
) -> DataFrame:
    """Per document row: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, spans (byte positions, end exclusive)."""
    dealt, shards = _dealt(docs, doc_id, text, chunk_bytes, length, gram, shard_anchors)
    out = _judge(dealt, shards, length, gram, paired, wide, batch_records, with_spans)
    return out.withColumnRenamed("gl_id", doc_id)


def _index_runs(index: DataFrame, shards: int) -> DataFrame:
    """Stored anchors as one more run of each shard, which asks for no answer."""

    def run(table: pa.Table) -> pa.Table:
        h = np.unique(table["key"].to_numpy().astype(np.int64).view(np.uint64))
        return _table([(s, -1, pack(h[at], np.zeros(len(at), np.int64))) for s, at in _by_shard(h, shards)])

    shard = F.pmod(F.shiftrightunsigned("key", 40), F.lit(shards)).alias("shard")
    return index.select(shard, "key").distinct().repartition(shards, "shard").groupBy("shard").applyInArrow(run, SENT)


class SuffixIndex:
    """A family that outlives a run: its levels are tables of sorted records below `folder`, the list of them a table too.

    A batch is judged against all documents of smaller ids that the index holds and among its own; answers about earlier batches
    stay as they were given, so batches in order of ids give what one run over all would. A row that is added twice stands once.
    All anchors of all documents are kept (about six times the text, before compression). Hot anchors are not split here.
    """

    def __init__(self, spark: SparkSession, folder: str, *, length: int = LENGTH, gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES, shard_anchors: int = SHARD_ANCHORS):
        self.spark, self.folder, self.length, self.gram = spark, folder.rstrip("/"), length, gram
        self.chunk_bytes, self.shard_anchors = chunk_bytes, shard_anchors

    def levels(self) -> list[tuple[str, int]]:
        """(path, records) of the levels, the largest first."""
        try:
            listed = self.spark.read.parquet(f"{self.folder}/list")
        except AnalysisException:  # nothing was added yet
            return []
        last = listed.agg(F.max("version")).first()[0]
        rows = listed.filter(F.col("version") == last).collect()  # a logarithmic number
        return sorted(((r.path, r.records) for r in rows), key=lambda x: -x[1])

    def _version(self) -> int:
        try:
            return self.spark.read.parquet(f"{self.folder}/list").agg(F.max("version")).first()[0] + 1
        except AnalysisException:
            return 0

    def _records(self, dealt: DataFrame) -> DataFrame:
        length, gram = self.length, self.gram

        def run(table: pa.Table) -> pa.Table:
            chunk = Chunk(table, length, gram)
            made = chunk.records(np.unique(chunk.hashes), chunk.hashes[:0])
            return pa.table({"key": pa.array(made.key.view(np.int64)), "record": pa.array(list(map(bytes, made.sent)), pa.binary()), "doc": pa.array(made.least)})

        return dealt.groupBy("chunk").applyInArrow(run, "key long, record binary, doc long")

    def _write(self, records: DataFrame) -> tuple[str, int]:
        path = f"{self.folder}/level-{uuid.uuid4().hex}"
        one = records.groupBy("key", "record").agg(F.min("doc").alias("doc"))
        one.repartition("key").sortWithinPartitions("record").write.parquet(path)
        return path, self.spark.read.parquet(path).count()

    def add(self, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", paired: int = PAIRED, batch_records: int = BATCH_RECORDS, with_spans: bool = True) -> DataFrame:
        """The rows of remove_repeats for the batch, stored; then the batch is a level, and levels of like size are merged."""
        found = self.levels()
        dealt, shards = _dealt(docs, doc_id, text, self.chunk_bytes, self.length, self.gram, self.shard_anchors)
        index = None
        for i, (path, n) in enumerate(found):
            level = self.spark.read.parquet(path).select("key", F.lit(i).alias("level"), "record", "doc")
            index = level if index is None else index.unionByName(level)
            shards = max(shards, round(n / self.shard_anchors))
        out = C.stored(_judge(dealt, shards, self.length, self.gram, paired, float("inf"), batch_records, with_spans, index), "batch")
        new = self._write(self._records(dealt))
        while found and found[-1][1] <= 2 * new[1]:
            new = self._write(self.spark.read.parquet(found.pop()[0]).unionByName(self.spark.read.parquet(new[0])))
        rows = [(self._version(), *x) for x in [*found, new]]
        self.spark.createDataFrame(rows, "version long, path string, records long").coalesce(1).write.mode("append").parquet(f"{self.folder}/list")
        return out.withColumnRenamed("gl_id", doc_id)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(C.read(spark, sf_dir, "documents"), with_spans=False)
