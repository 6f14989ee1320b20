import random
import zlib

import numpy as np

from gleaner.llm import toxicity as X


def feats(text, lexicon=None):
    c = X.Classifier(lexicon or X.Lexicon())
    return dict(zip(X.FEATURES, X.features(c.codes(X.tokens(text)), c.entries), strict=True))


def test_clause_contexts():
    assert feats("You are an idiot.")["asserted"] > 0 and feats("You are an idiot.")["aimed"] > 0
    assert feats("He is not an idiot.")["negated"] > 0 and feats("He is not an idiot.")["asserted"] == 0
    assert feats("Not now. An idiot!")["asserted"] > 0, "negation ends with its clause"
    assert feats("not one of the many other idiot")["asserted"] > 0, "negation reaches four words"
    assert feats("The paper said the man was an idiot")["reported"] > 0
    assert feats("I will kill you")["threats"] > 0 and feats("I kill time")["threats"] == 0
    assert feats("Ich werde dich töten")["threats"] > 0 and feats("you and all of the others kill time")["threats"] == 0
    assert feats("I do not kill you")["threats"] == 0 < feats("I do not kill you")["negated"]
    assert feats("She said they kill you")["threats"] == 0 < feats("She said they kill you")["reported"]
    assert not any(feats("Plain words, nothing else.").values())
    assert not any(feats("").values())


def test_product_automaton_is_the_transducers_side_by_side():
    rng = random.Random(3)
    parts = [X.NEGATION_SCOPE, X.REPORTED_SPEECH, X.AIMED, X.INSULTS_NAMED, X.THREATS_AIMED]
    for _ in range(200):
        state, single = 0, [0] * len(parts)
        for kind in rng.choices(range(7), k=30):
            state, marks = X.GRAMMAR[state][kind]
            steps = [p.step(s, kind) for p, s in zip(parts, single, strict=True)]
            single = [s for s, _ in steps]
            assert marks == sum(m for _, m in steps)


def test_only_asserted_matches_count_as_such():
    for text in ("He is not an idiot.", "The paper said the man was an idiot and a clown"):
        f = feats(text)
        assert not any(f[k] for k in ("asserted", "repeated", "aimed", "threats", "density", "weight")) and f["negated"] + f["reported"] > 0
    logit = lambda t: X.Model().beta[:-1] @ np.array(list(feats(t).values())) + X.Model().beta[-1]
    cut = np.log(X.THRESHOLD / (1 - X.THRESHOLD))
    assert logit("You are an idiot.") > cut and logit("I will kill you.") > cut
    assert max(map(logit, ("He is not an idiot.", "She said he was an idiot", "A calm text."))) < cut


def test_stems_are_learned(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(200):
        words = [word() for _ in range(40)]
        if i % 4 == 0:
            words[5], words[9] = "zornig" + word(), "zornig" + word()
        rows.append((i, int(i % 4 == 0), " ".join(words)))
    sample = spark.createDataFrame([*rows, (900, 0, None)], "gl_id long, y int, t string")
    counts = X.count_stems(sample)
    brute = {}
    for _, y, t in rows:
        for s, n in X.stem_counts(t).items():
            row = brute.setdefault(s, [0, 0, 0, 0])
            row[1 - y] += 1
            row[3 - y] += n > 1
    assert {r.stem: [r.t1, r.c1, r.t2, r.c2] for r in counts.collect()} == brute
    lexicon = X.learn_stems(counts, 50, 151, 1.0)
    assert any(s.startswith("zorni") for s in lexicon.stems)
    x, y = X.feature_rows(sample, lexicon)
    c = X.Classifier(lexicon)
    assert y.tolist() == [r[1] for r in rows] + [0]
    assert np.allclose(x, [X.features(c.codes(X.tokens(t)), c.entries) for _, _, t in rows] + [np.zeros(8)])


def test_query_keeps_its_contract_and_finds_held_out_rows(spark):
    """Scores against a plain second reading of the fitted model; held-out rows of the labelled table."""
    sf = "/root/testdata/sf0.1"
    rows = X.op6_toxicity(spark, sf)
    assert rows.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = X.train_model(docs, labels, train=X.in_training_fold)
    c, truth, got = X.Classifier(model.lexicon), {r.doc_id: r.toxic for r in labels.collect()}, {r.doc_id: r for r in rows.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    right = []
    for d, r in got.items():
        z = X.features(c.codes(X.tokens(texts[d] or "")), c.entries) @ model.beta[:-1] + model.beta[-1]
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-6 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
        if r.held_out and truth.get(d) is not None:
            right.append((truth[d], r.predicted))
    toxic, clean = ([p for t, p in right if t == k] for k in (1, 0))
    assert len(toxic) > 80 and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_rows(spark):
    docs = [(i, "you are a scum idiot here. " * 3 if i % 5 == 0 else "a calm and plain text here. " * 3, "s") for i in range(200)]
    docs += [(300, None, "s"), (301, "", "s"), (0, docs[0][1], "s"), (None, "idiot scum", "s"), (303, "word " * 100_000, "s")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)] + [(None, 1), (4, None), (5, 1)], "doc_id long, toxic int")
    model = X.train_model(docs, labels, train=X.in_training_fold)
    rows = X.score_toxicity(docs, model, keep=["doc_id"]).collect()
    assert len(rows) == 205 and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[5] > 0.3 > by[1] and by[None] > 0.3 and by[300] == by[301] < 0.3 and by[303] < 0.3
    kept = X.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i in range(200) if i % 5] + [300, 301, 303]
    assert X.reject_toxic(docs.limit(0), labels.limit(0)).count() == 0
    assert X.Model().beta is not X.DEFAULT_BETA
