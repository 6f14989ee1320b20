import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import decontaminate as D


def brute(words, items, window):
    hit, found = [False] * len(words), set()
    for k, item in enumerate(items):
        size = min(window, len(item))
        for j in range(len(item) - size + 1 if item else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == item[j : j + size]:
                    found.add(k)
                    hit[i : i + size] = [True] * size
    return hit, found


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=9), max_size=5),
    st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=40),
    st.integers(1, 5),
)
def test_automaton_against_brute_force(items, words, window):
    auto = D.ItemAutomaton([(str(i), x) for i, x in enumerate(items)], window)
    spans, found = auto.hits(words)
    marked = [False] * len(words)
    for lo, hi in spans:
        marked[lo:hi] = [True] * (hi - lo)
    assert (marked, found) == brute(words, items, window)


def digest(ids):
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_words():
    assert D.words_of("Ab-C9 Éa\u0085b_x".encode()) == ["ab".encode(), b"c9", "Éa\u0085b".encode(), b"x"]


@pytest.fixture
def tables(spark):
    rng = random.Random(1)
    item = [f"w{i}" for i in range(20)]
    docs = [
        (1, " ".join(item)),
        (2, "x " * 300 + " ".join(item[:13])),
        (3, " ".join(item[:12])),
        (4, None),
        (5, ""),
        (1, " ".join(item)),
        (None, "Tiny! thing " + " ".join(rng.choice("abc") for _ in range(9))),
    ]
    return (
        spark.createDataFrame([(*d, "n") for d in docs], "doc_id long, text string, n_words string"),
        spark.createDataFrame([(7, " ".join(item)), (10, "tiny thing"), (11, None), (12, "...")], "item_id long, text string"),
    )


@pytest.mark.parametrize("block_words", [1000, 5])
def test_contract_columns(tables, block_words):
    docs, bench = tables
    got = D.contamination_digest(D.find_contamination(docs, bench, block_words=block_words)).collect()
    rows = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got)
    assert rows == [
        (0, 11, 2, 1, True),
        (1, 20, 20, 1, True),
        (1, 20, 20, 1, True),
        (2, 313, 13, 1, False),
        (3, 12, 0, 0, False),
        (4, 0, 0, 0, False),
        (5, 0, 0, 0, False),
    ]
    assert {r.items_sha256 for r in got if r.doc_id == 1} == {digest(["7"])}
    assert {r.items_sha256 for r in got if r.doc_id == 4} == {digest([])}


@pytest.mark.parametrize("block_words", [1000, 25, 5])
def test_a_repeated_item_counts_once(tables, block_words):
    docs, bench = tables
    twice = bench.union(bench).union(bench.sparkSession.createDataFrame([(7, "tiny thing")], bench.schema)).coalesce(1)
    got = D.contamination_digest(D.find_contamination(docs, twice, block_words=block_words)).collect()
    assert {(r.doc_id, r.n_items, r.items_sha256) for r in got if r.n_items} == {
        (1, 1, digest(["7"])), (2, 1, digest(["7"])), (None, 2, digest(["10", "7"])),
    }


@pytest.mark.parametrize("block_words", [1000, 5])
def test_drop_excise_and_empty(tables, spark, block_words):
    docs, bench = tables
    kept = D.decontaminate(docs, bench, block_words=block_words)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]
    cut = {r.doc_id: r.text for r in D.decontaminate(docs, bench, action="excise", block_words=block_words).collect()}
    assert cut[1] == "" and cut[3].startswith("w0") and cut[4] is None and cut[None].startswith("! ") is False
    assert D.decontaminate(docs.limit(0), bench).count() == 0
    assert D.find_contamination(docs, bench.limit(0)).count() == 7 and D.decontaminate(docs, bench.limit(0)).count() == 7


@pytest.mark.parametrize("block_words", [1000, 25, 5])
def test_an_item_without_an_id_is_no_item(tables, block_words):
    docs, bench = tables
    more = bench.union(bench.sparkSession.createDataFrame([(None, "tiny thing"), (None, "a b c")], bench.schema)).coalesce(1)
    got = {r.doc_id: r for r in D.contamination_digest(D.find_contamination(docs, more, block_words=block_words)).collect()}
    assert got[None].items_sha256 == digest(["10"]) and got[None].n_items == 1
    only = D.contamination_digest(D.find_contamination(docs, more.filter("item_id is null"), block_words=block_words)).collect()
    assert {(r.n_hit, r.n_items, r.items_sha256) for r in only if r.doc_id is None} >= {(2, 0, digest([]))} and any(r.contaminated for r in only)


@pytest.mark.parametrize("action", ["drop", "excise"])
def test_clashing_columns(tables, spark, action):
    names = ["__gl_spans0", "__gl_spans", "spans", "spans0", "n", "gl0", "gl1", "TEXT2"]
    docs, bench = tables
    wide = docs.select("doc_id", "text", *[docs.n_words.alias(c) for c in names])
    got = D.decontaminate(wide, bench, action=action, block_words=5)
    assert got.columns == wide.columns and got.count() == (4 if action == "drop" else 7)


def test_a_very_long_text_and_a_large_benchmark(spark):
    rng = random.Random(3)
    items = [(i, " ".join(f"v{rng.randrange(3000)}" for _ in range(40))) for i in range(2000)]
    text = " ".join(f"v{rng.randrange(3000)}" for _ in range(300_000)) + " " + items[7][1] + " end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = D.contamination_digest(D.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"))).collect()
    assert (row.n_words, row.n_hit, row.items_sha256, row.contaminated) == (300_041, 40, digest(["7"]), False)
