import random
import re

import pytest

from gleaner.llm import jaccard_join as J
from gleaner.llm.components import components


def brute(rows, width, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if sets[i] and sets[j] and den * a >= num * b:
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] if sets[i] else [d]
        out.append((d, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def corpus(rng, bases=12, copies=18):
    vocab = [f"w{i}" for i in range(400)]
    line = " ".join(f"common{i}" for i in range(12))
    rows = []
    for _ in range(bases):
        words = [rng.choice(vocab) for _ in range(rng.choice([2, 8, 40, 90, 200]))]
        for _ in range(rng.randint(1, copies)):
            mine = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                mine[rng.randrange(len(mine))] = rng.choice(vocab)
            rows.append(((line + " ") * (rng.random() < 0.3) + " ".join(mine)).replace("w1", "W1" if rng.random() < 0.2 else "w1"))
    rows += ["", None, "One", "one", "a b", "A\tb", "x y z", " "]
    rng.shuffle(rows)
    out = list(enumerate(rows))
    return [*out, out[3], (None, out[5][1]), (None, "no id and no like")]


@pytest.mark.parametrize("width,num,block,rows,reach,visitors", [(3, 90, 128, 10**6, 1.5, 1024), (5, 80, 4, 10**6, 1.2, 2), (3, 90, 3, 0, 0.5, 3), (1, 50, 5, 10, 1.9, 1)])
def test_against_brute_force(spark, width, num, block, rows, reach, visitors):
    data = corpus(random.Random(width * block))
    df = spark.createDataFrame([(*d, 1) for d in data], "doc_id long, text string, node int").repartition(3)
    got = J.link_documents(df, width=width, num=num, block=block, reach=reach, broadcast_rows=rows, visitors=visitors).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(data, width, num, 100)


def test_drop_and_empty(spark):
    text = " ".join(f"t{i}" for i in range(100))
    df = spark.createDataFrame([(3, text, "a"), (5, text.replace("t50", "u"), "b"), (7, "other text entirely here now", "c"), (9, None, "d"), (None, "", "e")], "doc_id long, text string, gl_id string")
    kept = J.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.gl_id for r in kept.collect()) == ["a", "c", "d", "e"]
    assert J.link_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [10**6, 0])
def test_one_row_of_each_component_stays(spark, rows):
    text, other = " ".join(f"t{i}" for i in range(100)), " ".join(f"o{i}" for i in range(100))
    data = [
        (3, text, "b"), (3, text, "a"), (3, text, "a"), (4, text.replace("t50", "u"), "c"), (5, text.replace("t60", "u"), "d"), (None, text, "e"),
        (None, other, "g"), (None, other, "f"), (None, other.replace("o50", "u"), "f"), (None, "alone without any id here", "h"),
        (8, "twice the very same row here", "i"), (8, "twice the very same row here", "i"), (8, "another text of that id now", "j"),
        (9, None, "k"), (9, None, "k"), (None, "", "l"),
        (11, other.replace("o", "p"), "m"), (11, other.replace("o", "p").replace("p50", "u"), "m"),
    ]
    df = spark.createDataFrame(data, "doc_id long, text string, url string").repartition(3)
    kept = sorted(((r.url, r.doc_id, r.text) for r in J.drop_near_duplicates(df, broadcast_rows=rows).collect()), key=str)
    assert [k[0] for k in kept if k[1] is not None or k[0] in "hl"] == ["a", "h", "i", "j", "k", "k", "l", "m"]
    assert ("a", 3, text) in kept and len([k for k in kept if (k[2] or "").startswith("o0 ")]) == 1 and len(kept) == 9


def test_clashing_columns_and_a_very_long_text(spark):
    text = " ".join(f"t{i}" for i in range(100))
    names = "gl_gone gl_hash gl_stays gl_id gl_h gl_t node root n tokens need copies gl_row gl0 gl1".split()
    long = " ".join(f"x{i}" for i in range(200_000))
    rows = [(1, text), (2, text + " more"), (3, long), (4, long + " tail"), (1, text)]
    df = spark.createDataFrame([(*r, *([7] * len(names))) for r in rows], ["doc_id", "text", *names])
    kept = J.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert {r.doc_id: r.component_id for r in J.link_documents(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (950, 950)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {i: 0 for i in range(201)} | {900: 900, 901: 900}


def test_unfinished_components_are_an_error(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(df, max_rounds=1)
