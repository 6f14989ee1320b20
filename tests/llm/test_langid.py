import random
import zlib

from gleaner.llm import langid as L

SOUNDS = {"en": "the ing th wh sh ed ly", "de": "der ung ch sch keit ß ä", "fr": "le eau é è ou eux qu", "es": "el ción ñ ado os ll ue", "xx": "kk zq vv jj", "yy": "pp bb mm"}


def sample(lang, rng):
    parts = SOUNDS[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 30)))


def test_hierarchy():
    rng = random.Random(2)
    rows = [(sample(lang, rng), lang) for lang in SOUNDS for _ in range(60)]
    model = L.fit([t for t, _ in rows], [lang for _, lang in rows])
    assert model.families["germanic"] == ["de", "en"] and set(model.pairs) == {("de", "en"), ("es", "fr")}
    tests = [(sample(lang, rng), lang) for lang in SOUNDS for _ in range(40)]
    right = sum(model.predict(t)[0] == lang for t, lang in tests)
    assert right >= 0.97 * len(tests)
    assert all(0 <= model.predict(t)[1] <= 1 for t, _ in tests)
    for text in (None, "", "12 34 !?", " \n"):
        assert model.predict(text) == ("und", 0.0)
    assert L.fit([], []).predict("abc") == ("und", 0.0)
    assert L.fit(["abc"], ["en"]).predict("xyz")[0] == "en"
    assert L.fit(["abc", "xyz"], ["en", "fr"]).predict("abc")[0] == "en"


def test_rows(spark):
    rng = random.Random(4)
    docs = [(i, sample(lang, rng), lang, "s") for i, lang in enumerate(list("enfrdees"[k : k + 2] for k in (0, 2, 4, 6)) * 40)]
    docs += [(900, None, "en", "s"), (901, "", "de", "s"), (902, "123", None, "s"), (0, docs[0][1], "en", "s"), (None, docs[1][1], "fr", "s"), (903, "the " * 100_000, None, "s")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, lang_pred string")
    model = L.train_model(docs, per_lang=25, train=L.in_training_fold)
    rows = L.identify(docs, model, keep=["doc_id"]).collect()
    by = {r.doc_id: r.lang_pred for r in rows}
    assert len(rows) == 166 and by[900] == by[901] == by[902] == "und" and by[903] == "en"
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert sum(by[i] == truth[i] for i in range(160)) >= 150
    assert L.identify(docs.limit(0), L.train_model(docs.limit(0)), keep=["doc_id"]).count() == 0
    few = L.train_model(docs, sample_rows=8, train=L.in_training_fold)
    assert sorted(few.pairs) == [("de", "en"), ("es", "fr")], "two rows of each language"


def test_query_keeps_its_contract_and_finds_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = L.op7_langid(spark, sf)
    assert rows.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.train_model(docs, train=L.in_training_fold)
    got = {r.doc_id: r for r in rows.collect()}
    truth = {r.doc_id: r for r in docs.collect()}
    assert set(got) == set(truth)
    right = []
    for d, r in got.items():
        assert (r.lang_pred, r.score) == model.predict(truth[d].text) and 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert (r.lang_pred == "und") == (not L.has_letter(truth[d].text))
        if r.held_out and truth[d].lang is not None and r.lang_pred != "und":
            right.append(r.lang_pred == truth[d].lang)
    assert len(right) > 100 and sum(right) >= 0.97 * len(right)


def brute_vector(text):
    """Counts of byte 1- to 4-grams by bucket, with Python numbers."""
    body = b" " + b" ".join(text.lower().encode().translate(L.LETTERS).split()) + b" "
    out = [0] * L.DIMENSIONS
    for n in (1, 2, 3, 4):
        for i in range(len(body) - n + 1):
            gram = int.from_bytes(body[i : i + n], "big") + 1
            out[(gram * int(L.SALT[n]) % 2**64) >> 52] += 1
    norm = sum(out) ** 0.5
    return [x**0.5 / norm for x in out]


def test_vectors_against_brute_force():
    for text in ("Hello, wörld 12", "x", "é è"):
        assert max(abs(a - b) for a, b in zip(L.vector(text), brute_vector(text), strict=True)) < 1e-12
