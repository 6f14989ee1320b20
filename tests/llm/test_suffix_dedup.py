import hashlib
import random

import numpy as np
import pytest

from gleaner.llm import suffix_dedup as S


def brute(rows, length):
    first = {}
    key = lambda d: S.NO_ID if d is None else d
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, S.NO_ID), key(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < key(d):
                gone[i : i + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        out.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(rng):
    passage = "".join(rng.choice("abcdé ") for _ in range(90))
    line = "".join(rng.choice("xyz") for _ in range(49))
    rows = []
    for _ in range(60):
        t = "".join(rng.choice("abcdefgh é\0") for _ in range(rng.choice([0, 10, 49, 50, 51, 120, 400])))
        k = rng.random()
        if k < 0.3:
            at = rng.randint(0, len(t))
            cut = rng.randint(0, 30)
            t = t[:at] + passage[cut:] + t[at:]
        elif k < 0.4:
            t = line + t
        elif k < 0.5 and rows:
            t = rng.choice(rows)[:-3] + "zz"
        elif k < 0.6 and rows:
            t = rng.choice(rows)
        elif k < 0.65:
            t = "a" * rng.choice([60, 300]) + t
        rows.append(t)
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    out = list(zip(ids, rows, strict=True))
    return [*out, out[0], (ids[1], passage * 2), (None, passage), (None, passage), (None, None), (999, None), (998, "")]


@pytest.mark.parametrize("seed,chunk,anchors,paired,wide,batch", [(1, 1 << 20, 10**6, 12, 10**6, 10**6), (2, 500, 100, 12, 3, 5), (3, 2000, 40, 2, 10**6, 20), (4, 300, 40, 3, 0, 1)])
def test_against_brute_force(spark, seed, chunk, anchors, paired, wide, batch):
    rows = corpus(random.Random(seed))
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, chunk int, gl_id string")
    got = S.remove_repeats(df, chunk_bytes=chunk, shard_anchors=anchors, paired=paired, wide=wide, batch_records=batch).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(rows, 50)
    assert all(sum(b - a for a, b in r.spans) == r.n_removed for r in got)


def digest(rows):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=str)


def test_batches_against_a_stored_index_equal_one_run(spark, tmp_path):
    rows = [r for r in corpus(random.Random(6)) if r[0] is not None]
    index, found = S.SuffixIndex(spark, f"file://{tmp_path}/index", chunk_bytes=2000, shard_anchors=200), []
    for lo, hi in ((0, 25), (25, 30), (30, 45), (45, 2000)):
        part = [r for r in rows if lo <= r[0] < hi]
        found += index.add(spark.createDataFrame(part, "doc_id long, text string"), batch_records=50).collect()
    assert digest(found) == brute(rows, 50)
    sizes = [n for _, n in S.SuffixIndex(spark, f"file://{tmp_path}/index").levels()]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and len(sizes) < 4
    for path, n in index.levels():
        level = spark.read.parquet(path)
        assert level.count() == n == level.select("record").distinct().count()
    again = index.add(spark.createDataFrame(rows[:5], "doc_id long, text string"))
    assert again.count() == 5 and set(digest(again.collect())) <= set(brute(rows, 50)), "a batch that is added again is judged alike"


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_window_has_an_anchor():
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 101, n, np.uint8)) for n in (49, 50, 300, 0, 777)] + [b"a" * 120]
    where, _ = S.anchors(texts)
    starts = np.cumsum([0] + [len(t) for t in texts])
    for s, t in zip(starts, texts, strict=False):
        for i in range(len(t) - 49):
            assert ((where >= s + i) & (where + S.GRAM <= s + i + 50)).any()


def records(texts, ids, flagged=None, hot=()):
    chunk = S.Chunk(S.pa.table({"gl_id": S.pa.array(ids, S.pa.int64()), "gl_t": texts}), 50, 22)
    return chunk, chunk.records(np.unique(chunk.hashes) if flagged is None else flagged, np.array(hot, np.uint64))


def test_a_record_is_a_suffix_and_what_stands_before_it():
    text = "".join(random.Random(2).choice("abcdef") for _ in range(200))
    chunk, made = records([text], [1])
    for at in chunk.where.tolist():
        suffix, before = text[at : at + 50], text[max(0, at - 28) : at][::-1]
        row = suffix.encode().ljust(50, b"\0") + before.encode().ljust(28, b"\0") + bytes([len(suffix) - 22, len(before)])
        assert any(bytes(r) == row for r in made.rows)
    level = S.Level.of(made.rows, made.least)
    assert [bytes(r) for r in level.rows] == sorted(bytes(r) for r in made.rows)


@pytest.mark.parametrize("paired,batch", [(12, 7), (1, 7), (3, 100), (2, 1)])
def test_levels_mark_every_repeated_string(paired, batch):
    rng = random.Random(paired * batch)
    base = "".join(rng.choice("abcdef") for _ in range(70))
    texts = []
    for _ in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(70)] = rng.choice("ab\0")
        texts.append("".join(t)[rng.randint(0, 10) : rng.randint(60, 70)])
    ids = [rng.randint(0, 40) for _ in texts]
    _, made = records(texts, ids)
    family = S.LogFamily(50, 22, paired)
    sent = [(made.rows[i : i + batch], made.least[i : i + batch]) for i in range(0, len(made.rows), batch)]
    found = np.concatenate(S.judged(family, sent, batch))
    assert len(family.levels) == 1
    spell = lambda r, s: (s, bytes(r[50 : 50 + 28 - s])[::-1] + bytes(r[: 22 + s]))
    fits = lambda r, s: r[78] >= s and r[79] >= 28 - s
    first = {}
    for r, d in zip(made.rows, made.least.tolist(), strict=True):
        for s in range(29):
            if fits(r, s):
                first[spell(r, s)] = min(first.get(spell(r, s), 10**9), d)
    for r, d, m in zip(made.rows, made.least.tolist(), found.tolist(), strict=True):
        assert m == sum(1 << s for s in range(29) if fits(r, s) and first[spell(r, s)] < d)


def test_levels_grow_geometrically():
    rng, family = np.random.default_rng(5), S.LogFamily(50, 22)
    for _ in range(64):
        family.add(rng.integers(0, 5, (50, 80), np.uint8), rng.integers(0, 1000, 50))
        sizes = [len(x.rows) for x in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    assert len(family.levels) <= 7


def test_hot_records_are_split_into_their_strings():
    texts = ["".join(random.Random(i).choice("abcdef") for _ in range(90)) + "z" * 90 for i in range(4)]
    chunk, _ = records(texts, [1, 2, 3, 4])
    flagged = np.unique(chunk.hashes)
    _, plain = records(texts, [1, 2, 3, 4], flagged)
    _, split = records(texts, [1, 2, 3, 4], flagged, flagged)
    assert not len(split.plain) and (split.sent[:, 79] >= S.SPLIT).all() and ((split.sent[:, 79] & 127) + split.sent[:, 78] == 28).all()
    one = lambda made: made.masks(np.concatenate(S.judged(S.LogFamily(50, 22), [(made.sent, made.sent_least)], 10)))
    assert one(plain).tolist() == one(split).tolist() and any(one(plain).tolist())


def test_packed_names():
    h = np.random.default_rng(1).integers(0, 1 << 63, 100, np.uint64)
    names, extra = S.unpack(S.pack(h, np.arange(100) % 16))
    assert (names == h & S.NAME).all() and (extra == np.arange(100) % 16).all()


def test_a_very_long_text_and_many_rows_without_ids(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefgh ") for _ in range(400_000))
    rows = [(1, long), (2, long[1000:1100]), (3, "q" * 60), *[(None, f"row {i} without an id " * 4) for i in range(30)]]
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=3000)
    by = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    assert (by[1].n_removed, by[2].n_removed, by[3].n_removed) == (0, 100, 0) and got.filter("doc_id is null and n_removed = 0").count() == 30
