import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import quality as Q
from gleaner.llm.common import WordHasher


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


@settings(max_examples=500, deadline=None)
@given(st.text("ab é\n\t#|\u0085\x1c中", max_size=60))
def test_signals(text):
    body = text.encode()
    words = body.split()
    assert Q.base_signals(body, words, WordHasher()(words)) == plain(text)


def test_rows(spark):
    good = " ".join(f"fine{i}" for i in range(120))
    spam = " ".join(f"buy{i}" for i in range(120))
    docs = [(i, good + f" x{i}", "a") for i in range(40)] + [(100 + i, spam + f" y{i}", "a") for i in range(40)]
    docs += [(200, None, "b"), (201, "", "b"), (202, "a b c " * 60, "c"), (0, good + " x0", "a"), (None, spam, "d")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, gl_trusted string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(0, 1), (100, 0), (None, 1), (5, None)], "doc_id long, quality int")
    for rows in (10, 1000):
        got = Q.judge_quality(docs, labels, broadcast_rows=rows).collect()
        assert len(got) == 85
        by = {r.doc_id: r for r in got}
        assert by[200].base_failed and by[201].base_failed and by[202].base_failed and by[202].n_repeat_words == 180
        assert by[100].llr < by[0].llr and by[0].n_words == 121
        assert not by[100].kept and sum(r.kept for r in got) == 41
    assert Q.judge_quality(docs.limit(0), labels).count() == 0
    assert all(r.kept != r.base_failed for r in Q.judge_quality(docs, labels.limit(0)).collect())
    assert np.all(Q.log_ratio(np.zeros(4), np.zeros(4)) == 0)


def brute_verdicts(docs, good_ids, share):
    """llr, threshold and kept with Python numbers; docs: distinct (id, text)."""
    hasher = WordHasher()

    def buckets(text):
        h = [int(x) for x in hasher((text or "").encode().split())]
        pairs = [int(Q.C.mix64(np.array([a * 3 + b * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]) for a, b in zip(h, h[1:], strict=False)]
        return [x % Q.BUCKETS for x in h + pairs]

    found = [(d, t, buckets(t)) for d, t in docs]
    raw, good = Counter(), Counter()
    for d, _, b in found:
        raw.update(b)
        if d in good_ids:
            good.update(b)
    ratio = lambda k: math.log((good[k] + 1) / (good.total() + Q.BUCKETS)) - math.log((raw[k] + 1) / (raw.total() + Q.BUCKETS))
    llr = {i: round(sum(map(ratio, b)) / len(b), 9) if b else 0.0 for i, (_, _, b) in enumerate(found)}
    failed = {i: Q.base_failed(plain(t or "")[0], plain(t or "")[4]) for i, (_, t, _) in enumerate(found)}
    target = sorted(llr[i] for i, (d, _, _) in enumerate(found) if d in good_ids and not failed[i])
    lo, hi, bins = Q.HISTOGRAM
    bin_of = lambda x: min(max(math.floor((x - lo) / (hi - lo) * bins), 0), bins - 1)
    at = next((b for n, b in enumerate(map(bin_of, target), 1) if n > share * len(target) and (n == len(target) or bin_of(target[n]) != b)), None)
    cut = lo if at is None else lo + at * (hi - lo) / bins
    return sorted((d if d is not None else -1, llr[i], not failed[i] and llr[i] >= cut) for i, (d, _, _) in enumerate(found))


def test_verdicts_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    for share in (0.01, 0.3):
        df = spark.createDataFrame([*docs, (None, None), (None, "one " * 60)], "doc_id long, text string")
        got = Q.judge_quality(df, labels, rejected_target_share=share)
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.llr, r.kept) for r in got.collect())
        want = brute_verdicts([*docs, (None, None), (None, "one " * 60)], good, share)
        assert [(d, k) for d, _, k in got] == [(d, k) for d, _, k in want]
        assert max(abs(a[1] - b[1]) for a, b in zip(got, want, strict=True)) < 1e-8


def test_query_keeps_its_contract(spark):
    rows = Q.op10_quality(spark, "/root/testdata/sf0.001")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert rows.columns[:8] == names and [t for _, t in rows.dtypes[:8]] == ["bigint"] * 6 + ["boolean"] * 2
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = rows.collect()
    assert len(got) == len(texts)
    for r in got:
        signals = plain(texts[r.doc_id] or "")
        assert tuple(r)[1:6] == signals and r.base_failed == Q.base_failed(signals[0], signals[4]) and not (r.base_failed and r.kept)


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 400_000), (2, " ".join(f"w{i}" for i in range(200_000)))], "doc_id long, text string")
    got = {r.doc_id: r for r in Q.judge_quality(df, spark.createDataFrame([(2, 1)], "doc_id long, quality int")).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].base_failed) == (400_000, 400_000, True) and got[2].kept
