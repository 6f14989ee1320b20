import random
import re

import corpus_pipeline
from gleaner.llm import bpe, decontaminate, pii, toxicity
from tests.llm.test_jaccard_join import brute


def rows(rng):
    word = lambda: "".join(rng.choice("aeioubcdst") for _ in range(rng.randint(3, 7)))
    item = [word() for _ in range(30)]
    texts = []
    for i in range(120):
        words = [word() for _ in range(rng.randint(30, 90))]
        if i % 6 == 0:
            words[3], words[9], words[15] = "idiot", "scum", "moron"
        if i % 10 == 1:
            words[5:5] = item[:20]
        if i % 9 == 2:
            words[7] = f"user{i}@mail{i}.org"
        texts.append(" ".join(words))
    texts += [texts[3].replace(texts[3].split()[4], "changed"), texts[4], None, "", "mail bob (at) site (dot) org"]
    return [(i, t, "en", "s", None if t is None else len(t), "more") for i, t in enumerate(texts)], " ".join(item)


def test_stages_against_brute_force(spark, tmp_path):
    data, item = rows(random.Random(8))
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(120)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [r for r in data if not (r[1] and "idiot" in r[1])]
    auto = decontaminate.ItemAutomaton([("1", decontaminate.words_of(item.encode()))])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
        if name == "ngram_jaccard_join":
            keep = {d for d, _, c in brute([r[:2] for r in kept], 5, 80, 100) if c == d}
            kept = [r for r in kept if r[0] in keep]
        if name == "benchmark_decontamination":
            clean = []
            for r in kept:
                words = decontaminate.words_of((r[1] or "").encode())
                hit = sum(b - a for a, b in auto.hits(words)[0])
                if not (hit and 20 * hit >= len(words)):
                    clean.append(r)
            kept = clean
        if name == "pii":
            text = lambda t: None if t is None else re.sub(r"user\d+@mail\d+.org|bob \(at\) site \(dot\) org", "[EMAIL]", t)
            kept = [(r[0], t := text(r[1]), *r[2:4], None if t is None else len(t), r[5]) for r in kept]
        assert sorted(tuple(r) for r in docs.collect()) == sorted(kept), name
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in kept} and len(kept) > 60
    v = bpe.Vocabulary(bpe.default_vocabulary())
    for r in kept:
        assert got[r[0]].ids == v.whole.encode(r[1] or "", add_special_tokens=False).ids
    assert pii and toxicity
